"""Published byte-level vocabularies: ids equal the libraries' for whole texts, and refusals."""

import base64
import json

import pytest
import tiktoken
from tokenizers import Tokenizer

from quern.operators import encode, vocab
from quern.sources import vocabularies

public = pytest.importorskip("public_tokenizers")
END = "<|endoftext|>"
EXTRA = ["", " ", "\n\n \t", "<|endoftext|> x", "naïve 日本語 кот 👩‍👩‍👧", "a" * 5_000, "  two  spaces\r\nline", "it's we'll 123456 ½", "\x00\x7f"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(-1 - i, t) for i, t in enumerate(EXTRA)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def ids_of(frame):
    return {r["doc_id"]: list(r["tokens"]) for r in frame.collect()}


def test_tokenizer_file_gives_the_library_ids(spark, texts):
    path = public.path("byte_bpe_50k.json")
    words, merges = vocabularies.read_tokenizer(spark, path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encoded = encode.encode_bytes(texts, words, merges=merges).cache()
    got = ids_of(encoded)
    for r in texts.collect():
        assert got[r["doc_id"]] == library.encode(r["text"], add_special_tokens=False).ids + [50256]
    back = encode.decode_ids(encoded, words, ["doc_id"], byte_level=True)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in texts.collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_files_of_ranks_give_the_library_ids(spark, texts, name):
    path = public.path(name)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = vocabularies.read_ranks(spark, path, {END: 50256})
    got = ids_of(encode.encode_bytes(texts, words))
    for r in texts.collect():
        assert got[r["doc_id"]] == library.encode_ordinary(r["text"]) + [50256]


def small(**changes):
    """A tokenizer of the 256 bytes and two merges whose ids don't follow the ranks."""
    shown = {b: c for c, b in vocabularies.byte_of_character().items()}
    tokens = {shown[b]: 300 + b for b in range(256)} | {"ab": 7, "bc": 3}
    model = {"type": "BPE", "vocab": tokens, "merges": [["a", "b"], "b c"]}
    return {"model": model, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
            "normalizer": None, "added_tokens": [{"id": 1, "content": END, "special": True}]} | changes


def test_neighbours_are_merged_by_rank_not_by_id(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(small()))
    words, merges = vocabularies.read_tokenizer(spark, str(path))
    frame = spark.createDataFrame([(1, "abc bc ab"), (2, None)], "doc_id long, text string")
    space, a, c = (300 + ord(x) for x in " ac")
    assert ids_of(encode.encode_bytes(frame, words, merges=merges)) == {1: [7, c, space, 3, space, 7, 1], 2: [1]}
    # by the ids of unions, as without the table, b and c come first
    assert ids_of(encode.encode_bytes(frame, words))[1][:2] == [a, 3]


def test_every_byte_has_one_character():
    table = vocabularies.byte_of_character()
    assert sorted(table.values()) == list(range(256)) and table["Ġ"] == 32 and table["A"] == 65 and table["Ċ"] == 10


@pytest.mark.parametrize("changes, name", [
    ({"normalizer": {"type": "NFC"}}, "normalizer"),
    ({"pre_tokenizer": {"type": "Whitespace"}}, "pre_tokenizer"),
    ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, "add_prefix_space"),
    ({"model": {"type": "WordPiece", "vocab": {}, "merges": []}}, "model"),
])
def test_other_kinds_of_files_are_refused(spark, tmp_path, changes, name):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(small(**changes)))
    with pytest.raises(ValueError, match=name):
        vocabularies.read_tokenizer(spark, str(path))


def test_broken_vocabularies_are_refused(spark, tmp_path):
    found = small()
    del found["model"]["vocab"]["a"]
    found["model"]["merges"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(found))
    with pytest.raises(ValueError, match="no token"):
        vocabularies.read_tokenizer(spark, str(path))
    path.write_text(json.dumps(small(added_tokens=[{"id": 7, "content": "x"}])))
    with pytest.raises(ValueError, match="one id"):
        vocabularies.read_tokenizer(spark, str(path))
    ranks = tmp_path / "r.txt"
    ranks.write_text("QQ== 0\nQQ== 1\n")
    with pytest.raises(ValueError, match="twice"):
        vocabularies.read_ranks(spark, str(ranks))
    ranks.write_text("")
    with pytest.raises(ValueError):
        vocabularies.read_ranks(spark, str(ranks))


def test_decoding_leaves_specials_out(spark):
    words = vocabularies.read_ranks(spark, public.path("byte_bpe_50k.tiktoken"), {END: 50256})
    assert vocab.token_id(words, END) == 50256 and words.count() == 50257
