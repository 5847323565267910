"""Word hashes: no fixed collisions, equal for equal bytes, whole results with words that a polynomial hash confuses."""

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import jaccard, kernels, quality
from tests.llm import brute


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def words_of(texts, folded=False):
    (_, _, data, offsets), = kernels.chunks(pa.array(texts), 1 << 30)
    return kernels.Words(data, offsets, folded)


@pytest.mark.parametrize("n", [8, 9, 64, 65, 512, 1024, 2048, 4096, 16384])
def test_complementary_words_differ(n):
    assert len(set(words_of(list(thue_morse(n))).hashes.tolist())) == 2


def test_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 90))) for _ in range(3_000)]
    one = words_of([" ".join(words)]).hashes
    other = words_of(["x " + w for w in words]).hashes[1::2]
    assert (one == other).all()
    assert len(set(one.tolist())) == len(set(words))
    assert (words_of([" ".join(words).upper().replace("É", "é")], True).hashes == one).all()


@pytest.mark.parametrize("n", [512, 1024, 4096, 16384])
def test_jaccard_links_no_complementary_words(spark, n):
    a, b = thue_morse(n)
    rows = [(1, f"one two three {a} four five"), (2, f"one two three {b} four five"), (3, f"one two three {a} four five")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85)
    got = [(r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in found.orderBy("doc_id").collect()]
    assert got == brute.components(rows, 4, 85)


@pytest.mark.parametrize("n", [512, 1024, 16384])
def test_quality_counts_no_repeats_of_complementary_words(spark, n):
    a, b = thue_morse(n)
    text = f"{a} x y\n{b} x y\n{a} x z\n{a} x y"
    counts = quality.text_counts(spark.createDataFrame([(text,)], "text string")).first()["counts"]
    assert counts["n_dup_lines"] == 1
    words = text.split()
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, t in enumerate(three) if three.count(t) > 1 for j in range(3)}
    assert counts["n_repeat_words"] == len(hit)
