"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from hrefmill.functions import text, urls
from hrefmill.functions.hosts import canonical_host
from hrefmill.functions.urls import NormalizeConfig

DEFAULT = urls.PRESETS["import_normalized"]
SMART = urls.PRESETS["smart"]

NORMALIZE = [
    ("https://www.example.com/path", NormalizeConfig(remove_www=True), "https://example.com/path"),
    ("https://example.com/path/", NormalizeConfig(remove_trailing_slash=True), "https://example.com/path"),
    ("https://example.com/", NormalizeConfig(remove_trailing_slash=True), "https://example.com/"),
    ("https://example.com:443/path", NormalizeConfig(remove_default_port=True), "https://example.com/path"),
    ("http://example.com:80/path", NormalizeConfig(remove_default_port=True), "http://example.com/path"),
    ("https://example.com:8080/path", NormalizeConfig(remove_default_port=True), "https://example.com:8080/path"),
    ("https://example.com/?b=2&a=1", NormalizeConfig(sort_query_params=True), "https://example.com/?a=1&b=2"),
    ("https://example.com/path#frag", NormalizeConfig(remove_fragment=True), "https://example.com/path"),
    ("http://example.com/path", NormalizeConfig(force_https=True), "https://example.com/path"),
    ("http://example.com:443/path", NormalizeConfig(force_https=True), "https://example.com/path"),
    ("https://www.example.com:443/path/?b=2&a=1#frag", DEFAULT, "https://example.com/path?b=2&a=1"),
    ("https://www.example.com:8080/path/#frag", SMART, "https://example.com:8080/path#frag"),
    ("not-a-url", NormalizeConfig(remove_www=True), "not-a-url"),
    ("http://a.com/x//", NormalizeConfig(remove_trailing_slash=True), "http://a.com/x/"),
    ("http://www.www.a.com/", NormalizeConfig(remove_www=True), "http://www.a.com/"),
    ("http://a.com/#", NormalizeConfig(remove_fragment=True), "http://a.com/"),
    ("http://a.com/?b=1&a=2&b=0", NormalizeConfig(sort_query_params=True), "http://a.com/?a=2&b=1&b=0"),
    ("http://a.com/?q=a%20b", NormalizeConfig(sort_query_params=True), "http://a.com/?q=a+b"),
    ("http://a.com/?B=1&a=2", NormalizeConfig(sort_query_params=True), "http://a.com/?a=2&B=1"),
    ("http://a.com/?", NormalizeConfig(), "http://a.com/?"),
    ("http://a.com/?", NormalizeConfig(sort_query_params=True), "http://a.com/"),
]

PARSED = [
    ("https://example.com", ("https", "example.com", None, "/", "", "")),
    ("http://example.com/path?q=1#h", ("http", "example.com", None, "/path", "?q=1", "#h")),
    ("HTTP://WWW.Example.com:80/a/../b/./c/", ("http", "www.example.com", None, "/b/c/", "", "")),
    ("not-a-url", None),
    ("://", None),
    ("http://", None),
    ("", None),
    ("http://bad host 5", None),
    ("http://a.com:99999/", None),
    ("http://1.2.3.4.5/", None),
    ("ftp://example.com", ("ftp", "example.com", None, "/", "", "")),
    ("http://[2001:DB8:0:0:1:0:0:1]:8080/", ("http", "[2001:db8::1:0:0:1]", "8080", "/", "", "")),
    ("http://0x7f.1/", ("http", "127.0.0.1", None, "/", "", "")),
    ("http://münchen.de/ü", ("http", "xn--mnchen-3ya.de", None, "/%C3%BC", "", "")),
    ("  https://a_b.c/p|q ", ("https", "a_b.c", None, "/p|q", "", "")),
    ("http://a.com/x y?a='b\"", ("http", "a.com", None, "/x%20y", "?a=%27b%22", "")),
    ("http:\\\\exa.com\\p", ("http", "exa.com", None, "/p", "", "")),
    ("http://a.com/%2e%2E/x/%2e", ("http", "a.com", None, "/x/", "", "")),
]


def test_normalize_golden(spark):
    got = {}
    for config in {c for _, c, _ in NORMALIZE}:
        cases = [(i, u) for i, (u, c, _) in enumerate(NORMALIZE) if c == config]
        parsed = urls.with_url_parts(spark.createDataFrame(cases, "i int, url string"), "url")
        got |= {r[0]: r[1] for r in parsed.select("i", urls.normalized("u_", config, F.col("url"))).collect()}
    assert [got[i] for i in range(len(NORMALIZE))] == [e for _, _, e in NORMALIZE]


def test_url_parts_golden(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(PARSED)], "i int, url string")
    rows = {r["i"]: r for r in urls.with_url_parts(df, "url").collect()}
    for i, (url, expected) in enumerate(PARSED):
        r = rows[i]
        got = tuple(r[f"u_{k}"] for k in ("scheme", "host", "port", "path", "search", "hash"))
        assert got == (expected or (None,) * 6), url


def test_normalize_is_idempotent_and_canonical_parse_agrees(spark):
    # Only one slash and one www are stripped, so doubled ones change again.
    cases = [u for u, _, _ in NORMALIZE] + [u for u, _ in PARSED]
    df = spark.createDataFrame([(u,) for u in cases if not u.endswith("//") and "www.www" not in u], "url string")
    for preset in ("smart", "import_normalized", "dedup_normalized"):
        once = urls.with_normalized(df, "url", "once", preset)
        twice = urls.with_normalized(once, "once", "twice", preset)
        plain = urls.with_normalized(twice, "once", "plain", preset, resolve=False)
        assert [r for r in plain.collect() if r["once"] != r["twice"] or r["once"] != r["plain"]] == []


@pytest.mark.parametrize(
    "host, expected",
    [
        ("localhost", True), ("127.0.0.1", True), ("::1", True), ("10.0.0.1", True), ("192.168.1.1", True),
        ("169.254.0.1", True), ("172.16.0.1", True), ("172.31.255.255", True), ("172.15.0.1", False),
        ("172.32.0.1", False), ("8.8.8.8", False), ("11.0.0.1", False), ("10.example.com", True), ("[::1]", False),
    ],
)
def test_private_hosts(spark, host, expected):
    df = spark.createDataFrame([(host,)], "h string")
    assert df.select(urls.is_private_host(F.col("h"))).first()[0] is expected


def test_private_hosts_strict(spark):
    df = spark.createDataFrame([("10.example.com",), ("127.9.9.9",), ("[::1]",), ("8.8.8.8",)], "h string")
    assert [r[0] for r in df.select(urls.is_private_host(F.col("h"), strict_cidr=True)).collect()] == [False, True, True, False]


@pytest.mark.parametrize(
    "host, expected",
    [
        ("[::]", "[::]"), ("[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]"), ("[::ffff:1.2.3.4]", "[::ffff:102:304]"),
        ("[fe80::1%eth0]", None), ("0300.1.2.3", "192.1.2.3"), ("256", "0.0.1.0"), ("1.2.3.999", None),
        ("a%20b", None), ("straße.de", "xn--strae-oqa.de"), ("09.1", None),
    ],
)
def test_canonical_host(host, expected):
    assert canonical_host(host) == expected


def test_entities_and_csv_and_trim(spark):
    df = spark.createDataFrame(
        [("a &amp; b &#128512; &#x41; &#X41; &foo; &#9999999999; & x &amp;lt;", 'a"b,c"d,"x""y",z', " ﻿ x\t")],
        "e string, c string, t string",
    )
    r = df.select(text.decode_entities(F.col("e")), text.csv_fields(F.col("c")), text.js_trim(F.col("t"))).first()
    assert r[0] == "a & b \U0001f600 A &#X41; &foo; &#9999999999; & x &lt;"
    assert r[1][:3] == ["ab,cd", 'x"y', "z"]
    assert r[2] == "x"


def test_like_keeps_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("A\\b_c",), (None,)], "s string")
    got = df.select(
        text.like_contains(F.col("s"), "a\\B"),
        text.like_contains(F.col("s"), "A%C"),
        text.like_contains(F.col("s"), "A%C", literal=True),
    ).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False)]


def test_dedup_key_from_stored_parts_equals_full_parse(spark):
    """The cheap key of stored links is the key that parsing the raw URL gives."""
    from hrefmill.operators.ingest import build_link_rows

    raw = [u for u, _, _ in NORMALIZE] + [u for u, _ in PARSED] + ["http://u:p@a.com:81/x?b=1&a=2#f", "mailto:x@y.z"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(raw)], "seq long, url string").selectExpr(
        "*", "'TXT' AS type", "'normalized' AS strategy", "'f' AS source_file", "seq AS source_order", "'' AS title"
    )
    links = build_link_rows(urls.with_url_parts(df, "url"), F.current_timestamp())
    for preset in ("strict", "smart", "import_normalized", "dedup_normalized"):
        both = urls.with_normalized(urls.with_dedup_key(links, preset, "cheap"), "original_url", "full", preset)
        wrong = [(r["original_url"], r["cheap"], r["full"]) for r in both.collect() if r["cheap"] != r["full"]]
        assert [w for w in wrong if not w[0].startswith("mailto")] == []
