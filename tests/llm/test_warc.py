import hashlib
import html
import json
import random
import re
import time

import pytest

from quern.llm import warc

PAGE = (
    '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no -->'
    '<p>One <b>two</b>\n three</p><ul><li><a href="/x?a=1&amp;b=2">L</a><li><a class=c href=\'y\'>M</a><a href=/x?a=1&amp;b=2>N</a></ul>&copy; caf\u00e9</body></html>'
)
ROWS = [(1, "http://a/1", PAGE), (2, None, None), (3, "http://a/3", ""), (None, "http://a/4", "x"), (4, "http://a/5", "<p>" + "long " * 200_000), (1, "http://a/1", PAGE)]


def _pages(spark):
    return spark.createDataFrame([(*r, "x", b"y") for r in ROWS], "page_id long, url string, html string, record_id string, block binary")


def test_text_and_links():
    assert warc.plain_text(PAGE) == "A & B\nOne two\nthree\nL\nMN\n\u00a9 caf\u00e9"
    assert warc.page_links(PAGE) == ["/x?a=1&b=2", "y"]
    assert warc.plain_text("a < b > c <1> <script>x") == "a < b > c <1>"


def test_records_refer_to_their_source(spark):
    pages = _pages(spark)
    responses = warc.responses_of(pages).collect()
    made = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(made) == 2 * sum(r[0] is not None for r in ROWS)
    sources = {r["record_id"]: r for r in responses if r["record_id"]}
    for r in made:
        source = sources[r["refers_to"]]
        payload = bytes(source["block"]).split(b"\r\n\r\n", 1)[1]
        assert r["payload_digest"] == warc.digest(payload) and r["block_digest"] == warc.digest(bytes(r["block"]))
        assert r["source_headers"]["Content-Length"] == str(len(payload)) and r["target_uri"] == source["target_uri"]
        if r["record_type"] == "conversion":
            assert bytes(r["block"]).decode() == warc.plain_text(payload.decode())
        else:
            about = json.loads(bytes(r["block"]))
            assert about["source"] == r["refers_to"] and about["status"] == "HTTP/1.1 200 OK" and about["links"] == warc.page_links(payload.decode())
    assert len({r["record_id"] for r in made}) == 8  # a repeated row gives repeated records


def test_round_trip_of_bytes(spark):
    made = warc.derivatives(warc.responses_of(_pages(spark)))
    data = b"".join(bytes(r["warc"]) for r in warc.serialised(made).collect())
    back = {h["WARC-Record-ID"]: (h, b) for h, b in warc.parse_records(data)}
    for r in made.collect():
        headers, block = back[r["record_id"]]
        assert block == bytes(r["block"]) and headers["WARC-Type"] == r["record_type"] and headers["WARC-Refers-To"] == r["refers_to"]
        assert headers.get("WARC-Target-URI") == r["target_uri"] and headers["WARC-Block-Digest"] == r["block_digest"]


def test_digest_is_the_published_form():
    assert warc.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(warc.digest(b"x")) == 5 + 32 and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_other_records_and_empty_tables(spark):
    responses = warc.responses_of(_pages(spark)).selectExpr("*", "'request' AS record_type")
    assert warc.derivatives(responses).collect() == []
    assert warc.page_derivatives(_pages(spark).limit(0)).collect() == []
    odd = spark.createDataFrame([("<r>", None, None, b"no http"), ("<s>", None, None, None)], "record_id string, target_uri string, date string, block binary")
    texts = {r["refers_to"]: bytes(r["block"]) for r in warc.derivatives(odd).collect() if r["record_type"] == "conversion"}
    assert texts == {"<r>": b"no http", "<s>": b""}


# The same as single patterns, which take quadratic time on open tags.
_OLD_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>")
_OLD_LINK = re.compile(r"""(?is)<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


def test_pages_read_as_by_single_patterns():
    rng = random.Random(3)
    parts = ["<a ", "<A\n", "href", "href=", ' HREF = "x"', "href='y z'", "href=q", ">", "<", "<!--", "-->", "<!", "<?", "<script", "</script >",
             "<SVG>", "</svg>", "<p>", "</p", "text ", "&amp;", '"', "'", "=", " ", "<b", "\n"]
    for _ in range(30_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        shown = _OLD_DROPPED.sub(" ", page)
        assert warc._visible(page) == shown, page
        links = list(dict.fromkeys(html.unescape(a or b or c) for a, b, c in _OLD_LINK.findall(shown)))
        assert warc.page_links(page) == links, page
        text = warc._TAGS.sub("", warc._BLOCKS.sub("\n", shown))
        lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
        assert warc.plain_text(page) == "\n".join(x for x in lines if x), page


@pytest.mark.parametrize("part", ["<a ", "<a", "<!", "<!--", "<?", "<script", "<a href", "<a href=", "<a href='", "<p", "</script "])
def test_long_open_tags_end_soon(part):
    page = "x" + part * (1_000_000 // len(part))
    started = time.time()
    warc.plain_text(page)
    warc.page_links(page)
    assert time.time() - started < 20
