"""The reference work flows, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions.text import clean_text
from quern.operators import encode, pack, select, vocab
from quern.session import small_batches, stage
from quern.sources.tables import document_lines


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    return small_batches(docs).withColumn(text, clean_text(F.col(text)))


def word_level(docs: DataFrame, vocab_size: int = 20_000, min_freq: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clean documents, take their frequent words as vocabulary, encode.

    Gives the encoded table and the vocabulary. Each table feeds
    several later branches, so each is staged.
    """
    texts = stage(cleaned(docs), "cleaned")
    words = stage(vocab.frequent_words_vocab(vocab.word_counts(texts), vocab_size, min_freq), "vocab")
    return stage(encode.lookup_words(texts, words), "encoded"), words


def web_shards(docs: DataFrame, tokens: DataFrame, shard_size: int, block_size: int) -> DataFrame:
    """Documents to shards with a byte-level vocabulary, text as it is."""
    encoded = stage(encode.encode_bytes(docs, tokens), "encoded")
    return pack.pack_shards(encoded, shard_size, block_size)


def line_streams(docs: DataFrame, tokens: DataFrame, val_size: float, block_size: int) -> DataFrame:
    """Split documents, clean and encode them line by line, one stream per split."""
    lines = document_lines(select.split(docs, val_size)).withColumnRenamed("line", "text")
    encoded = stage(encode.encode_wordpiece(cleaned(lines), tokens), "encoded")
    return pack.flat_stream(encoded, block_size, ["doc_id", "line_no"], ["split"])
