"""The queries that SQL can express, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from quern.llm.decontam import contained_sql
from quern.llm.licenses import scan_sql
from quern.llm.queries import URL_RULES
from quern.llm.urls import Rule

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def components_sql(size: int = 4, percent: int = 85) -> str:
    """Sets, links and components of ``documents`` with distinct ids, all pairs that share a shingle counted."""
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})] END)) AS gram
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= {percent} * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x),
c AS (SELECT x AS doc_id, min(root) AS component_id FROM r GROUP BY x),
l AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) JOIN c USING (doc_id)
"""


def verdicts_sql(rules: list[Rule]) -> str:
    """Verdicts on ``pages``; the list is of canonical URLs that more than one page has."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))

    def chain(which: int) -> str:
        cases = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if which else h + p}'" for h, p, v in ordered
        )
        return f"CASE {cases} END"

    return f"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)', 1), {_FOLD}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)\\A.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)\\A.*?://[^?#]*\\?([^#]*)', 1) AS query
  FROM pages),
k AS (
  SELECT *, list_sort([p FOR p IN string_split(query, '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|session_?id)(=|$)')]) AS kept
  FROM u),
c AS (
  SELECT page_id, host, path,
    CASE WHEN host <> '' THEN host || regexp_replace(path, '/+\\z', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM k),
b AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
j AS (SELECT c.*, b.canonical IS NOT NULL AS listed FROM c LEFT JOIN b ON c.canonical = b.canonical)
SELECT page_id, host, path, {chain(0)} AS rule, coalesce({chain(1)}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM j
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": components_sql(),
        "op5_license_scan": scan_sql(),
        "op6_minhash_containment": contained_sql(),
        "op8_url_filter": verdicts_sql(URL_RULES),
    }
