"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if the document's shingles hold at least
``threshold`` of the item's. Comparing signatures of an item and of a document
a hundred times longer says nothing, so signatures are those of the items: the
``s`` smallest hashes of an item's shingles, looked up among *all* shingles of
each document. Items are partitioned by size. In a partition of up to ``m``
shingles a contained item may miss ``floor((1 - threshold) * m)`` of them; the
signature has that many and a fifth of ``m`` more, so a document that contains
the item holds at least a fifth (exactly: all of the signature but those that
may be missing). No contained item is lost, and a document that shares one
common phrase with an item isn't a candidate. Candidates are verified on the
shingles themselves. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import bounded, fresh, require_columns, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signature rows (item, hash) that may be broadcast; more are joined by a shuffle.
BROADCAST_SIGNATURES = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space, letters lower-cased; null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _positions(words: Column, size: int) -> Column:
    """First places of all shingles; none if there are too few words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def shingles(words: Column, size: int) -> Column:
    """The distinct shingles, words joined by a blank."""
    return F.array_distinct(F.transform(_positions(words, size), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))


def hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all shingles, repeated ones too."""
    return F.transform(_positions(words, size), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))


def _percent(threshold: float) -> int:
    percent = round(threshold * 100)
    if not 0 < percent <= 100:
        raise ValueError(f"threshold must be above 0 and at most 1, got {threshold}")
    return percent


def signatures(items: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Staged ``item_id, width, n, needed, least, grams, sig`` of the items that have a word.

    ``width`` is the words of a shingle: ``size``, or the item's words if it has
    fewer. ``least`` shingles are a containment; a document with that many holds
    ``needed`` of the signature.
    """
    rows = items.select(F.col(f"`{key}`").alias("item_id"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.lit(size), F.size("words")))
    by_width = F.lit(None).cast("array<string>")
    for width in range(1, size + 1):
        by_width = F.when(F.col("width") == width, shingles(F.col("words"), width)).otherwise(by_width)
    rows = rows.select("item_id", "width", by_width.alias("grams")).distinct().withColumn("n", F.size("grams"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")  # of the item's partition
    length = F.least(F.col("n"), F.floor(largest * (100 - percent) / 100) + F.ceil(largest / 5)).cast("int")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    hashed = F.slice(F.array_sort(F.transform("grams", lambda g: F.xxhash64(g))), F.lit(1), length)
    rows = rows.withColumn("sig", hashed).withColumn("least", least)
    rows = rows.withColumn("needed", F.size("sig") - (F.col("n") - F.col("least")))
    return stage(rows.withColumn("item", F.xxhash64("item_id", "grams")), "signatures")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _verified(docs: DataFrame, items: DataFrame, size: int, percent: int, text: str, item_key: str, item_text: str) -> DataFrame:
    """Staged ``text_key, item_id, n, n_shared``: items and the texts that contain them, a text by its hash."""
    sigs = signatures(items, size, percent, item_key, item_text)
    widths = sorted(r["width"] for r in sigs.select("width").distinct().collect())  # at most ``size`` values
    parts = []
    for width in widths:
        own = sigs.where(F.col("width") == width)
        posts = stage(own.select("item", "needed", F.explode("sig").alias("hash")), "posts")
        rows = docs.select(_text_key(text).alias("text_key"), words_of(F.col(f"`{text}`").cast("string")).alias("words"))
        rows = rows.select("text_key", F.explode(hashes(F.col("words"), width)).alias("hash"))
        found = rows.join(bounded(posts, BROADCAST_SIGNATURES), "hash").distinct()
        found = found.groupBy("text_key", "item", "needed").agg(F.count("*").alias("hits")).where("hits >= needed")
        parts.append(stage(found.select("text_key", "item", F.lit(width).alias("width")), "candidates"))
    if not parts:
        none = "text_key long, item_id long, n int, n_shared int"
        return docs.sparkSession.createDataFrame([], none)
    candidates = parts[0]
    for more in parts[1:]:
        candidates = candidates.unionByName(more)
    keys = bounded(candidates.select("text_key").distinct())
    texts = docs.select(_text_key(text).alias("text_key"), F.col(f"`{text}`").cast("string").alias("text")).join(keys, "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.any_value("text").alias("text"))
    texts = texts.select("text_key", words_of(F.col("text")).alias("words"))
    checked = []
    for width in widths:
        own = candidates.where(F.col("width") == width).select("text_key", "item")
        own = own.join(texts.select("text_key", shingles(F.col("words"), width).alias("theirs")), "text_key")
        own = own.join(sigs.select("item", "item_id", "n", "least", "grams"), "item")
        own = own.withColumn("n_shared", F.size(F.array_intersect("grams", "theirs"))).where("n_shared >= least")
        checked.append(own.select("text_key", "item_id", "n", "n_shared"))
    out = checked[0]
    for more in checked[1:]:
        out = out.unionByName(more)
    return stage(out, "contained")


def contained_items(
    docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id, doc_id, n_shingles, n_shared, containment`` of each item and each row that contains it.

    Shingles are ``size`` words (runs of characters other than ASCII white
    space, lower-cased) of whole texts. An item of fewer words is one shingle,
    to be found anywhere in a document. Items and documents that are null, empty
    or without words are in no pair. Equal rows of items are one; items that
    share an id but not the text are compared one by one. Every row of ``docs``
    that contains an item is in the result, repeated ones and those with a null
    id, too. Other columns are ignored; empty tables give an empty result.
    """
    require_columns(docs, key, text)
    require_columns(items, item_key, item_text)
    found = _verified(docs, items, size, _percent(threshold), text, item_key, item_text)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), _text_key(text).alias("text_key")).join(bounded(found), "text_key")
    share = (F.col("n_shared") / F.col("n")).alias("containment")
    return rows.select("item_id", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), share)


def without_contained(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    found = _verified(docs, items, size, _percent(threshold), text, item_key, item_text)
    name = fresh(docs, "contaminated_text")
    keys = bounded(stage(found.select(F.col("text_key").alias(name)).distinct(), "contaminated"))
    return docs.join(keys, _text_key(text) == F.col(name), "left_anti")


def contained_sql(size: int = 5, threshold: float = 0.8) -> str:
    """The pairs of tables ``documents`` and ``benchmark`` whose items all have ``size`` words or more, in DuckDB's SQL."""
    grams = f"""unnest(list_distinct([array_to_string(words[i:i + {size - 1}], ' ') FOR i IN range(1, len(words) - {size - 2})]))"""
    words = "[w FOR w IN regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+') IF w <> ''] AS words"
    return f"""
WITH i AS (SELECT item_id, {grams} AS gram FROM (SELECT item_id, {words} FROM benchmark)),
d AS (SELECT doc_id, {grams} AS gram FROM (SELECT doc_id, {words} FROM documents)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
c AS (SELECT item_id, doc_id, count(*) AS n_shared FROM i JOIN d USING (gram) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= {round(threshold * 100)} * n_shingles
"""
