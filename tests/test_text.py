import unicodedata

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quern.functions import text as T


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


CLEANED = [
    ("a$b+c<d>e^f`x|y~z", "abcdefxyz"),
    ("«Été», n°5 – 50%…", "«Été», n5 – 50%…"),
    ("abc 日本 где αβ", "abc"),
    ("12 ٣٤ ²", "12"),
    ("é", "é"),
    ("q́", "q"),
    ("  a b  ", "a b"),
    ("hòa Hòa HÒA khỏe thủy", "hoà Hoà HOÀ khoẻ thuỷ"),
    ("hòA", "hòA"),
    ("hòa", "hoà"),
    ("", ""),
    ("   ", ""),
    ("\n", ""),
]


def test_clean_edge_rows(spark):
    assert apply(spark, T.clean_text, [c[0] for c in CLEANED]) == [c[1] for c in CLEANED]


def test_clean_is_idempotent(spark):
    once = apply(spark, T.clean_text, [c[0] for c in CLEANED])
    assert apply(spark, T.clean_text, once) == once


def test_options(spark):
    assert apply(spark, lambda c: T.clean_text(c, keep_punct=False), ["a, b!"]) == ["a b"]
    assert apply(spark, lambda c: T.clean_text(c, strip_ends=False), [" a "]) == [" a "]
    assert apply(spark, T.clean_text, [None]) == [None]


def test_filter_matches_the_unicode_classes(spark):
    """Each known code point is kept or dropped as by the plain pattern."""
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    kept = apply(spark, T.clean_charset, ["[" + c + "]" for c in chars])
    plain = regex.compile(r"[^\p{Latin}\p{Punctuation}0-9\s]+")
    wrong = [c for c, k in zip(chars, kept) if k != plain.sub("", "[" + c + "]")]
    # Characters newer than the JVM's tables are dropped there.
    df = spark.createDataFrame([(c,) for c in wrong], "c string") if wrong else None
    unknown = df.where(F.col("c").rlike(r"\p{Cn}")).count() if wrong else 0
    assert unknown == len(wrong)


def test_nfc_prefilter_misses_nothing(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    probes = [c for c in chars if not unicodedata.is_normalized("NFC", c)]
    probes += ["e" + c for c in chars if unicodedata.combining(c)]
    probes += ["가", "각", "Å", "Å̧"]
    assert apply(spark, T.nfc, probes) == [unicodedata.normalize("NFC", p) for p in probes]


def test_strip_matches_python(spark):
    texts = [c + "a" + c + "b" + c * 2 for c in T.WHITE_SPACE] + ["", " ", "a" + " " * 2000 + "b"]
    assert apply(spark, T.strip, texts) == [t.strip() for t in texts]


def test_tone_pairs_do_not_chain():
    assert len(T.TONE_PAIRS) == 45
    assert not any(old in new for old in T.TONE_PAIRS for new in T.TONE_PAIRS.values())


def test_tone_on_every_pair(spark):
    assert apply(spark, T.normalize_tone, list(T.TONE_PAIRS)) == list(T.TONE_PAIRS.values())


def test_pretokenize(spark):
    words = apply(spark, T.pretokenize, ["Hello, don't a_b 3.5 --x"])[0]
    assert words == "Hello , don ' t a_b 3 . 5 -- x".split()
    assert apply(spark, lambda c: T.pretokenize(c, lowercase=True), ["Ab C"])[0] == ["ab", "c"]


def test_byte_level_pieces(spark):
    texts = ["I'm  here\n\n now, 42x!", "  lead", "trail  ", "a\tb"]
    plain = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    got = apply(spark, T.byte_level_pieces, texts)
    assert got == [plain.findall(t) for t in texts]
    assert ["".join(g) for g in got] == texts


@pytest.mark.parametrize(
    "tokens, text", [(["ab", "##c", "d"], "abc d"), (["##a", "b"], "##a b"), ([], ""), (["x", "##"], "x")]
)
def test_join_word_pieces(spark, tokens, text):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(T.join_word_pieces(F.col("t"))).first()[0] == text


def test_sql_function(spark):
    T.register_sql(spark)
    assert spark.sql("SELECT nfc('é')").first()[0] == "é"


def test_nfc_holds_a_few_texts_at_a_time(spark, monkeypatch):
    """Nulls, texts that need no change and texts that do, over the borders of what is held."""
    monkeypatch.setattr(T, "TEXTS_AT_ONCE", 3)
    texts = [None, "e\u0301", "a", None, None, None, "u\u0308x", "", "n\u0303" * 50] * 3
    array = pa.array(texts, pa.string())
    done = T._nfc_udf().func(array)
    assert done.to_pylist() == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert T._nfc_udf().func(array.slice(0, 0)).to_pylist() == []
    assert apply(spark, T.nfc, texts) == done.to_pylist()
