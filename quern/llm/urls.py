"""URL filter: rules by host and path, then a blocked Bloom filter before an exact join.

All of it is DataFrame functions. The filter over the listed canonical URLs is a
table: one row per block, four 64-bit words of it in columns. A URL sets two
bits in each word of one block. Pages whose bits are all set *may* be listed;
only these go on to the exact join, which removes the false ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import bounded, fresh, require_columns, stage

#: ``host, path, verdict``
Rule = tuple[str, str, str]

WORDS = 4  # 64-bit words of a block
KEYS_PER_BLOCK = 12  # about 21 bits a key
#: Blocks that may be broadcast (48 bytes each); a larger filter is joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that name a visit, not a page.
_VISIT = r"^(utm_[^=]*|ref|fbclid|gclid|session_?id)(=|$)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without a slash at its end, and the sorted parameters that don't name a visit; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_VISIT)))
    where = F.concat(host(url), F.regexp_replace(path(url), r"/+\z", ""))
    return F.when(host(url) != "", F.concat(where, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_for(host_: Column, path_: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its verdict; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    Of equally long ones the one of the longer host wins.
    """
    names, verdicts = [F.lit(None).cast("string")], [F.lit(None).cast("string")]
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        names.insert(-1, F.when(fits, F.lit(h + p)))
        verdicts.insert(-1, F.when(fits, F.lit(verdict)))
    return F.coalesce(*names), F.coalesce(*verdicts)


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", one, at)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bloom_table(listed: DataFrame, url: str = "url", keys: int | None = None) -> tuple[DataFrame, int]:
    """``block, word_0 .. word_3`` of the listed URLs, and the number of blocks."""
    keys = listed.count() if keys is None else keys
    blocks = max(1, -(-keys // KEYS_PER_BLOCK))
    rows = listed.where(F.col(url).isNotNull()).select(_block(F.col(url), blocks).alias("block"), *[m.alias(f"word_{i}") for i, m in enumerate(_masks(F.col(url)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(WORDS)]), blocks


def with_listed(pages: DataFrame, listed: DataFrame, url: str, name: str) -> DataFrame:
    """``pages`` and a boolean column: whether the canonical URL in column ``url`` is one of ``listed.url``.

    Null URLs aren't listed. ``pages`` is read twice; only possible hits are joined exactly.
    """
    keys = stage(listed.select("url").where("url IS NOT NULL").distinct(), "listed")
    table, blocks = bloom_table(keys)
    table = stage(table, "bloom")
    table = bounded(table, BROADCAST_BLOCKS)
    at = fresh(pages, "block_")
    words = [fresh(pages, f"word_{i}_") for i in range(WORDS)]
    table = table.select(F.col("block").alias(at), *[F.col(f"word_{i}").alias(w) for i, w in enumerate(words)])
    probed = pages.withColumn(at, _block(F.col(url), blocks)).join(table, at, "left")
    maybe = F.lit(True)
    for w, mask in zip(words, _masks(F.col(url)), strict=True):
        maybe = maybe & (F.coalesce(F.col(w), F.lit(0)).bitwiseAND(mask) == mask)
    maybe = maybe & F.col(url).isNotNull()
    hits = probed.where(maybe).drop(at, *words)
    rest = probed.where(~maybe).drop(at, *words).withColumn(name, F.lit(False))
    key = fresh(pages, "url_")
    exact = keys.select(F.col("url").alias(key), F.lit(True).alias(name)).hint("shuffle_hash")
    hits = hits.join(exact, F.col(url) == F.col(key), "left").drop(key)
    return hits.withColumn(name, F.coalesce(F.col(name), F.lit(False))).unionByName(rest)


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict, listed``.

    The verdict is the longest fitting rule's; without a rule it is ``block``
    if the canonical URL is one of ``listed.url`` (canonical URLs), else
    ``allow``. A null or empty URL, or one without ``://``, has an empty host and
    path, fits no rule and isn't listed. Repeated rows are judged one by one;
    other columns are ignored; empty tables are fine.
    """
    require_columns(pages, key, url)
    require_columns(listed, "url")
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rows = with_listed(rows, listed, "canonical", "listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``url``: the canonical URLs that more than one row has."""
    urls = pages.select(canonical(F.col(url)).alias("url")).where("url IS NOT NULL")
    return urls.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
