"""Similarity join on word shingles by T-occurrence search (DivideSkip).

A document is the set of its distinct word shingles. Documents of equal sets
are one *class*; classes are joined, so copies are never paired. A class of
``n`` shingles can only link with a class it shares at least
``T = ceil(threshold * n)`` shingles with, which is a T-occurrence problem on
the inverted lists of its shingles. The join

1. puts shingles in the order of their hashes and takes from each class the
   ``n - T + k`` first ones, of which two linked classes share at least ``k``;
   classes with fewer than ``k`` shingles in any other class's list are done
   (most are, as most texts have no near copy);
2. cuts the rest into blocks of an inverted index, near copies side by side,
   and sends each class, as a query, to the blocks that hold one of the rarest
   of these shingles; the ``k - 1`` most frequent aren't needed for that. The
   queries of one block for another are one row, so a group of copies that fills
   many blocks makes rows by pairs of blocks, not of documents;
3. runs the search in each block (:class:`Block`): short lists are merged, long
   lists are probed for the candidates by binary search, and classes that
   reach the required overlap are links. Tasks hold one block and a bounded
   share of its queries, so a group of copies of any size is spread over tasks;
4. joins the links of all blocks to components. A task gives the links of its
   part as a forest (at most one row per class), not as pairs.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quern.llm import kernels
from quern.llm.common import bounded, fresh, require_columns, small_batches, stage
from quern.llm.components import connected_components
from quern.operators.prefix import with_exclusive_sum

#: Shingles of a block of the index, and of the queries sent to it at a time, on average.
BLOCK_TOKENS = 400_000
#: Blocks' worth of shingles that a task copies at a time as queries of one block, beyond the last target.
BUCKET_BLOCKS = 8
#: Postings up to which lists are merged by a heap; longer ones by a stable sort of the runs. Same result.
HEAP_POSTINGS = 4_096
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085


def required(n: int, percent: int) -> int:
    """Shingles a class of ``n`` shares with any class it links with, at least."""
    return -(-percent * n // 100)


def head_size(n: int, percent: int) -> int:
    return n - required(n, percent) + max(1, n // 10) if n else 0


def _needed(n: Column, percent: int) -> Column:
    """Head shingles that a class of ``n`` shares with any class it links with, at least."""
    smallest = F.ceil(n * percent / 100)
    return F.greatest(F.lit(1).cast("long"), F.floor(smallest / 10))


class Block:
    """Inverted lists of some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.docs = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.tokens, firsts = np.unique(tokens[order], return_index=True)
        self.firsts = np.append(firsts, len(order))
        # one sorted array of (list, document), for binary search in any list
        self.keys = np.repeat(np.arange(len(self.tokens)) * max(1, len(sets)), np.diff(self.firsts))
        self.keys += self.docs

    def _merge(self, lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in at least ``least`` of the lists, and in how many."""
        if sum(map(len, lists)) <= HEAP_POSTINGS:
            found = [(d, c) for d, g in groupby(heapq.merge(*(x.tolist() for x in lists))) if (c := sum(1 for _ in g)) >= least]
            docs, counts = np.array(found, np.int64).reshape(-1, 2).T
        else:
            docs, counts = np.unique(np.sort(np.concatenate(lists), kind="stable"), return_counts=True)
            docs, counts = docs[counts >= least], counts[counts >= least]
        return docs, counts

    def search(self, query: np.ndarray) -> np.ndarray:
        """Documents of the block that link with ``query`` (a sorted set), itself too if it is there."""
        n = len(query)
        t = required(n, self.percent)
        at = np.minimum(np.searchsorted(self.tokens, query), max(0, len(self.tokens) - 1))
        at = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        if not n or len(at) < t:
            return np.zeros(0, np.int64)
        lengths = self.firsts[at + 1] - self.firsts[at]
        at = at[np.argsort(-lengths, kind="stable")]
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, lengths.max())) + 1)))
        docs, counts = self._merge([self.docs[self.firsts[i] : self.firsts[i + 1]] for i in at[n_long:]], t - n_long)
        sizes = self.sizes[docs]
        fits = (100 * sizes >= self.percent * n) & (100 * n >= self.percent * sizes)
        docs, counts, sizes = docs[fits], counts[fits], sizes[fits]
        if n_long and len(docs):
            keys = at[None, :n_long] * len(self.sizes) + docs[:, None]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            counts = counts + (self.keys[found] == keys).sum(axis=1)
        return docs[100 * counts >= self.percent * (n + sizes - counts)]


class _Forest:
    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def _sets(size: int, percent: int, whole: bool):
    """Rows ``(id, text, text key)`` to ``id, text key, n, fp, c`` and the whole set (bytes) or its head (longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernels.chunks(batch.column(1)):
                sets = kernels.Words(data, offsets, folded=True).shingle_sets(size)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                if whole:
                    last = pa.array([s.tobytes() for s in sets], pa.binary())
                else:
                    heads = [s[: head_size(len(s), percent)].view(np.int64) for s in sets]
                    ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(np.array([int.from_bytes(p[:8], "little", signed=True) for p in prints], np.int64)),
                        last,
                    ],
                    names=["doc_id", "text_key", "n", "fp", "c", "shingles"],
                )

    return run


def text_key(text: str) -> Column:
    """A hash that tells texts of one id apart; null texts count as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def shingle_rows(docs: DataFrame, size: int, percent: int, key: str, text: str, whole: bool) -> DataFrame:
    fields = [
        StructField("doc_id", docs.schema[key].dataType),
        StructField("text_key", LongType()),
        StructField("n", LongType()),
        StructField("fp", BinaryType()),
        StructField("c", LongType()),
        StructField("shingles", BinaryType() if whole else ArrayType(LongType())),
    ]
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), text_key(text).alias("text_key"))
    return small_batches(rows).mapInArrow(_sets(size, percent, whole), StructType(fields))


def _targets(spans: list[dict]) -> set[int]:
    return {t for s in spans for t in range(s["first"], s["last"] + 1)}


def _traffic(rows: pa.Table) -> pa.Table:
    """Shingles that the queries of one block send to each block."""
    sent: Counter[int] = Counter()
    for n, spans in zip(rows.column("n").to_pylist(), rows.column("spans").to_pylist(), strict=True):
        sent.update(dict.fromkeys(_targets(spans), n))
    home = rows.column("block")[0].as_py()
    return pa.table(
        {"home": pa.array([home] * len(sent), pa.int32()), "block": pa.array(list(sent), pa.int32()), "tokens": pa.array(list(sent.values()), pa.int64())}
    )


def _pack(block: pa.Table, routes: pa.Table) -> pa.Table:
    """The sets of one block as queries to the targets of one bucket, one row per block they go to."""
    place = {fp: i for i, fp in enumerate(block.column("fp").to_pylist())}
    to: dict[int, list[bytes]] = defaultdict(list)
    for fp, spans in zip(routes.column("fp").to_pylist(), routes.column("spans").to_pylist(), strict=True):
        for t in _targets(spans):
            to[t].append(fp)
    home = block.column("home")[0].as_py() if len(block) else 0
    # taken from the column by place, so that no set is copied more than once
    ends = pa.array(np.cumsum([0, *map(len, to.values())]), pa.int32())
    sent = pa.array([place[fp] for fps in to.values() for fp in fps], pa.int64())
    queries = block.column("shingles").combine_chunks().take(sent)
    return pa.table(
        {
            "home": pa.array([home] * len(to), pa.int32()),
            "block": pa.array(list(to), pa.int32()),
            "fps": pa.array(list(to.values()), pa.list_(pa.binary())),
            "queries": pa.ListArray.from_arrays(ends, queries),
        }
    )


def _search(percent: int):
    """A block and some of its queries to the links of these, as ``fp, n_links, root``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        owners = left.column("fp").to_pylist()
        copies = left.column("copies").to_numpy()
        block = Block([np.frombuffer(x.as_buffer(), np.uint64) for x in left.column("shingles")], percent)
        forest, links = _Forest(), Counter()
        for i in range(len(right)):
            for fp, query in zip(right.column("fps")[i].as_py(), right.column("queries")[i].values, strict=True):
                found = [d for d in block.search(np.frombuffer(query.as_buffer(), np.uint64)).tolist() if owners[d] != fp]
                if found:
                    links[fp] += int(copies[found].sum())
                    for d in found:
                        forest.join(fp, owners[d])
        nodes = list(forest.parent)
        return pa.table(
            {
                "fp": pa.array(nodes, pa.binary()),
                "n_links": pa.array([links[x] for x in nodes], pa.int64()),
                "root": pa.array([forest.root(x) for x in nodes], pa.binary()),
            }
        )

    return run


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a link: ``fp, n, copies, rep``, index and query shingles.

    ``rows`` is staged. Classes are aggregated with a combine before the
    shuffle, so a group of copies of any size costs one row per task.
    """
    some = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = some.groupBy("fp", "c").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n").alias("n")
    )
    heads = some.groupBy("fp", "c").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("head"))
    posts = heads.select("c", "n", F.explode("head").alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = (
        posts.join(often, "token")
        .groupBy("c")
        .agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"))
        .where(F.size("by_df") >= _needed(F.col("n"), percent))
    )
    probes = F.slice("by_df.token", F.lit(1), (F.size("by_df") - _needed(F.col("n"), percent) + 1).cast("int"))
    narrow = stage(shared.select("c", F.col("by_df.token").alias("index_tokens"), probes.alias("query_tokens")), "shared")
    return stage(classes.join(narrow, "c"), "candidates")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, n_links, component_id``.

    Two rows link when their sets of ``size``-word shingles have a Jaccard
    similarity of at least ``percent / 100``. Words are runs of characters other
    than ASCII white space, A-Z lower-cased; fewer words than ``size`` are one
    shingle. ``component_id`` is the smallest ``doc_id`` reachable by links,
    ``n_links`` the number of other rows linked directly, copies included.

    A null or empty text, or one without words, has no shingle and links with
    nothing: it is a component of its own. Rows without a ``doc_id`` link with
    nothing, and have no component. Repeated rows are documents of their own
    that link with each other. Other columns are ignored; an empty table gives
    an empty result. Shingles are compared by 64-bit hashes.
    """
    found = _classes(docs, size, percent, key, text, block_tokens)
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("linkable"), F.coalesce(F.col("n_links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("linkable"), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _classes(docs: DataFrame, size: int, percent: int, key: str, text: str, block_tokens: int) -> DataFrame:
    """Per row ``doc_id, text_key, n, fp, linkable`` and, of classes with copies or links, ``copies, n_links, root, least``."""
    require_columns(docs, key, text)
    rows = stage(shingle_rows(docs, size, percent, key, text, whole=False), "shingles")
    links, roots = _links(docs, rows, size, percent, key, text, block_tokens)
    classes = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    found = classes.join(links, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    found = stage(found.where("copies > 1 OR root IS NOT NULL"), "linked")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    ids = found.join(least, "root", "left").select("fp", "copies", "n_links", "root", F.coalesce("least", "rep").alias("least"))
    ids = bounded(stage(ids, "classes"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.drop("c", "shingles").join(ids, "fp", "left").withColumn("linkable", linkable)


def one_of_each(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component.

    The first is the one of the smallest ``doc_id`` (of rows that share it, the
    one of the smallest hash of the text). Of rows that agree in id and text,
    one stays, whichever. Rows without an id, and texts without words, link
    with nothing and stay; see :func:`jaccard_components`.
    """
    rows = _classes(docs, size, percent, key, text, block_tokens).where("linkable AND copies IS NOT NULL")
    members = rows.select("doc_id", "text_key", F.coalesce("root", "fp").alias("group"))
    first = stage(members.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "first")
    times = members.groupBy("doc_id", "text_key", "group").agg(F.count("*").alias("times"))
    members = stage(times.join(bounded(first), "group"), "members")
    own = F.struct("doc_id", "text_key")
    dropped_id, dropped_text = fresh(docs, "dropped_id"), fresh(docs, "dropped_text")
    same = [F.col(f"`{key}`") == F.col(dropped_id), text_key(text) == F.col(dropped_text)]
    names = [F.col("doc_id").alias(dropped_id), F.col("text_key").alias(dropped_text)]
    others = stage(members.where(own != F.col("first")).select(*names), "others")
    kept = docs.join(bounded(others), same, "left_anti")
    repeated = stage(members.where((own == F.col("first")) & (F.col("times") > 1)).select(*names), "repeated")
    once, again = kept.join(bounded(repeated), same, "left_anti"), kept.join(bounded(repeated), same, "left_semi")
    mark = fresh(docs, "text_key_")
    again = again.withColumn(mark, text_key(text)).dropDuplicates([key, mark]).drop(mark)
    return once.unionByName(again)


def _numbered(candidates: DataFrame, n_blocks: int, block_tokens: int) -> DataFrame:
    """``fp, block``: near copies side by side, at most ``block_tokens`` shingles and one class more in a block.

    Ranges are dealt by rows, whose sets may differ in size by any factor, so blocks are cut by running totals.
    """
    near = candidates.select("fp", "n", F.array_min("index_tokens").alias("near"))
    near = near.repartitionByRange(n_blocks, "near", "fp").withColumn("range", F.spark_partition_id())
    near = stage(near, "ranges")
    totals = stage(near.groupBy("range").agg(F.sum("n").alias("total")), "totals")
    base = with_exclusive_sum(totals, "total", "range", "base").select("range", "base")
    before = F.sum("n").over(Window.partitionBy("range").orderBy("near", "fp").rowsBetween(Window.unboundedPreceding, -1))
    place = F.col("base") + F.coalesce("before", F.lit(0))
    placed = near.withColumn("before", before).join(F.broadcast(base), "range")
    return placed.select("fp", F.floor(place / block_tokens).cast("int").alias("block"))


def _links(docs, rows, size, percent, key, text, block_tokens) -> tuple[DataFrame, DataFrame]:
    """``fp, n_links`` and ``node, root`` of the classes that link with others."""
    spark = docs.sparkSession
    candidates = _candidates(rows, percent)
    tokens = candidates.agg(F.sum("n")).first()[0] or 0
    wanted = candidates.select(F.col("rep").alias(key)).distinct()
    again = docs.where(F.col(key).isNotNull()).join(bounded(wanted), key, "left_semi")
    sets = shingle_rows(again, size, percent, key, text, whole=True).groupBy("fp").agg(F.any_value("shingles").alias("shingles"))
    n_blocks = max(1, -(-tokens // block_tokens))
    index = candidates.join(sets, "fp").join(_numbered(candidates, n_blocks, block_tokens), "fp")
    index = stage(index.select("block", "fp", "n", "copies", "index_tokens", "query_tokens", "shingles"), "index")

    # the blocks that hold a shingle, as runs of block numbers: near copies lie side by side
    each = Window.partitionBy("token").orderBy("block")
    places = index.select("block", F.explode("index_tokens").alias("token")).distinct()
    runs = places.withColumn("run", F.col("block") - F.row_number().over(each)).groupBy("token", "run")
    runs = runs.agg(F.struct(F.min("block").alias("first"), F.max("block").alias("last")).alias("span"))
    spans = runs.groupBy("token").agg(F.collect_list("span").alias("spans"))
    asked = index.select("fp", "block", "n", F.explode("query_tokens").alias("token"))
    routes = asked.join(spans, "token").groupBy("fp", "block", "n").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    routes = stage(routes, "routes")

    # queries of one block for another travel as one row; those for one block are dealt to parts of bounded size
    traffic = routes.groupBy("block").applyInArrow(_traffic, "home int, block int, tokens long")
    before = F.sum("tokens").over(Window.partitionBy("block").orderBy("home").rowsBetween(Window.unboundedPreceding, -1))
    # and so are the targets of one block, to buckets: a block's sets are copied for the targets of one at a time
    sent = F.sum("tokens").over(Window.partitionBy("home").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = traffic.select(
        "home",
        "block",
        F.floor(F.coalesce(before, F.lit(0)) / block_tokens).alias("part"),
        F.floor(F.coalesce(sent, F.lit(0)) / (BUCKET_BLOCKS * block_tokens)).alias("bucket"),
    )
    parts = stage(parts, "parts")
    buckets = parts.groupBy("home", "bucket").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    buckets = bounded(stage(buckets, "buckets"))
    within = "transform(filter(spans, s -> s.first <= high AND s.last >= low), s -> struct(greatest(s.first, low) AS first, least(s.last, high) AS last))"
    asking = routes.select(F.col("block").alias("home"), "fp", "spans").join(buckets, "home")
    asking = asking.select(F.col("home").alias("of_home"), F.col("bucket").alias("of_bucket"), "fp", F.expr(within).alias("spans")).where(F.size("spans") > 0)
    sending = index.select(F.col("block").alias("home"), "fp", "shingles").join(buckets.select("home", "bucket"), "home")
    packed = sending.groupBy("home", "bucket").cogroup(asking.groupBy("of_home", "of_bucket"))
    packed = packed.applyInArrow(_pack, "home int, block int, fps array<binary>, queries array<binary>")
    right = packed.join(bounded(parts.drop("bucket")), ["home", "block"]).groupBy("block", "part")
    left = index.select("block", "fp", "copies", "shingles").join(bounded(stage(parts.select("block", "part").distinct(), "parts")), "block")
    schema = "fp binary, n_links long, root binary"
    found = stage(left.groupBy("block", "part").cogroup(right).applyInArrow(_search(percent), schema), "links")
    links = found.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
    return links, connected_components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
