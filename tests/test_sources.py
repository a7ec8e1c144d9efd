"""Reading files from disk, format detection and extraction."""

import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hrefmill.sources import files, formats, records

FILES = {
    "urls.txt": "\n\nhttps://a.com/1\r\n  http://b.com/2  \nftp://no\nplain\n",
    "sub/pipe.txt": "https://a.com | A | more\nnot a url | x\nhttps://b.com\n",
    "dash.txt": "Title - with - https://a.com/x-y\nhttps://bare.com\nT - nope\n",
    "one.ini": "https://a.com * First\n[Group]\nhttps://b.com *\nhttps://c.com\n * x\n",
    "hist.CSV": 'Visit,NavigatedToUrl,PageTitle\n1,https://a.com,"x, ""y"""\n2,ftp://b,z\n3,"https://c.com"\n\n',
    "nohead.csv": "a,b\nhttps://a.com,b\n",
    "arr.txt": '  [ "https://a.com", {"url":"https://b.com","title":"B"}, {"url":5}, 7, null, {"title":"x"}, {"url":"https://c.com","title":3} ]',
    "broken.json": '["https://a.com", ',
    "tail.json": '["https://a.com"] x',
    "my_TableRone_1.txt": '{"export":[{"tabs":[{"url":"https://a.com","title":"A"},5,{"url":"https://b.com"}]},3,{"tabs":4},{"tabs":[{"url":"https://c.com","title":null}]}]}',
    "noexport.json": '{"export":3}',
    "book.html": '<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n<DT><a  href="https://a.com?x=1&amp;y" ADD="1">A &amp; B &#x41;</a>\n<DT><A ID="1" HREF="https://skip.com">s</A>\n<A HREF="https://b.com">two\nlines</A>',
}

EXPECTED = {
    "urls.txt": ("url_only", [("https://a.com/1", ""), ("http://b.com/2", "")]),
    "sub/pipe.txt": ("pipe", [("https://a.com", "A | more")]),
    "dash.txt": ("dash", [("https://a.com/x-y", "Title - with"), ("https://bare.com", "")]),
    "one.ini": ("onetab_ini", [("https://a.com", "First"), ("https://b.com", "")]),
    "hist.CSV": ("csv", [("https://a.com", 'x, "y"'), ("https://c.com", "")]),
    "nohead.csv": ("csv", []),
    "arr.txt": ("json_array", [("https://a.com", ""), ("https://b.com", "B"), ("https://c.com", "")]),
    "broken.json": ("json_array", []),
    "tail.json": ("json_array", []),
    "my_TableRone_1.txt": ("tablerone_json", [("https://a.com", "A"), ("https://b.com", ""), ("https://c.com", "")]),
    "noexport.json": ("json_array", []),
    "book.html": ("bookmarks_html", [("https://a.com?x=1&amp;y", "A & B A"), ("https://b.com", "two\nlines")]),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content.encode())
    return str(base)


def extracted(lines, types=None):
    profile = formats.detect_formats(lines, types)
    rows = sorted(formats.extract_links(lines, profile).collect(), key=lambda r: (r["filename"], r["pos"]))
    found = {r["filename"]: (r["format"], []) for r in profile.collect()}
    for r in rows:
        found[r["filename"]][1].append((r["url"], r["title"]))
    return found


def test_formats_from_whole_files(spark, root):
    assert extracted(files.lines_of(files.read_source_files(spark, root))) == EXPECTED


def test_formats_from_numbered_lines(spark, root):
    assert extracted(files.read_source_lines(spark, root)) == EXPECTED


def test_given_type_wins(spark):
    lines = files.lines_of(spark.createDataFrame([("x.txt", "[Group]\nhttps://a.com * T")], "filename string, content string"))
    types = spark.createDataFrame([("x.txt", "TXT")], "filename string, type string")
    assert extracted(lines)["x.txt"][0] == "json_array"
    assert extracted(lines, types)["x.txt"] == ("onetab_ini", [("https://a.com", "T")])


def test_sniff_window_is_ten_non_blank_lines(spark):
    late = "\n".join(["https://a.com"] * 10 + ["https://b.com | B"])
    early = "\n".join([""] * 30 + ["https://a.com"] * 9 + ["https://b.com | B"])
    lines = files.lines_of(spark.createDataFrame([("late", late), ("early", early)], "filename string, content string"))
    got = {r["filename"]: r["format"] for r in formats.detect_formats(lines).collect()}
    assert got == {"late": "url_only", "early": "pipe"}


def test_json_sniff_looks_at_64_characters(spark):
    rows = [("a", " " * 63 + "[]"), ("b", " " * 64 + "[]"), ("c", "\n" * 63 + "{"), ("d", "\n" * 64 + "{")]
    lines = files.lines_of(spark.createDataFrame(rows, "filename string, content string"))
    got = {r["filename"]: r["type"] for r in formats.profile_files(lines).collect()}
    assert got == {"a": "JSON", "b": "TXT", "c": "JSON", "d": "TXT"}


def test_split_files_are_numbered_densely(spark, tmp_path):
    want = {}
    for name, n in (("big.txt", 5000), ("small.txt", 3)):
        want[name] = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(want[name]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = files.read_source_lines(spark, str(tmp_path))
        rows = lines.collect()
        assert lines.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in want:
        got = sorted((r["pos"], r["line"]) for r in rows if r["filename"] == name)
        # The content ends with a line break, which leaves an empty line.
        assert [g[1] for g in got] == [*want[name], ""]
        assert [g[0] for g in got] == list(range(len(want[name]) + 1))


def test_listing_and_pages_of_lines(spark, root):
    listed = files.list_source_files(spark, root).collect()
    assert {r["filename"]: r["size"] for r in listed} == {k: len(v.encode()) for k, v in FILES.items()}
    lines = files.lines_of(files.read_source_files(spark, root))
    got = files.read_file_lines(lines, "urls.txt", 2, 2).orderBy("pos").collect()
    assert [(r["pos"], r["line"]) for r in got] == [(2, "https://a.com/1\r"), (3, "  http://b.com/2  ")]
    total = files.total_lines(lines).filter("filename = 'urls.txt'").first()["total_lines"]
    assert total == len(FILES["urls.txt"].split("\n"))
    with pytest.raises(ValueError):
        files.read_file_lines(lines, "urls.txt", 0, 501)


def test_plugged_in_extractor(spark):
    tabbed = formats.Extractor(
        "tabbed", "TXT", lambda: F.exists("sniff", lambda x: x.contains("\t")),
        parse_line=lambda line: F.when(
            line.contains("\t"), F.struct(F.split(line, "\t")[0].alias("url"), F.split(line, "\t")[1].alias("title"))
        ),
    )
    lines = files.lines_of(spark.createDataFrame([("t", "https://a.com\tA\nx")], "filename string, content string"))
    chain = [tabbed, *formats.EXTRACTORS]
    got = formats.extract_links(lines, formats.detect_formats(lines, extractors=chain), chain).collect()
    assert [(r["format"], r["url"], r["title"]) for r in got] == [("tabbed", "https://a.com", "A")]


def links_at(lines, size):
    profile, scan = formats.read_formats(lines, size=size)
    rows = formats.extract_links(lines, profile, formats.in_blocks_of(size), scan, size).collect()
    found = {r["filename"]: (r["format"], []) for r in profile.collect()}
    for r in sorted(rows, key=lambda r: (r["filename"], r["pos"])):
        found[r["filename"]][1].append((r["url"], r["title"]))
    return found


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_records_do_not_depend_on_the_block_size(spark, root, size):
    assert links_at(files.read_source_lines(spark, root), size) == EXPECTED


JSON_CASES = [
    "", " ", "5", '"https://a.com"', "[]", " [ ] ", "[[]]", "[1]", "[1,]", "[,1]", "[1 2]", '["a" "b"]', "[1]]", "[1][2]", "{}", "{,}", '{"a"}',
    '{"a":1}', '{"a":1,}', '{"a":1:2}', '{"export":[]}', '{"export":[}', '{"export":[]]', '{"export":{}}', '{"export":[{"tabs":[]}]}',
    '["https://a.com/\\"x]y", "https://b.com/\\\\"]', '["https://a.com/\\\\", {"url":"https://b.com/[{,:}]","title":"t\\"],"}]',
    '[{"url":"https://a.com","more":{"x":[1,[2,{"y":"]"}]]}},\n\n {"title":"b","url":"https://b.com"}\n]\n',
    '{"x":[[1,{"export":[{"tabs":[{"url":"https://no.com"}]}]}]], "export" : [ {"name":"n","tabs":[{"url":"https://a.com","title":"A"} , {"url":"https://b.com"}],"z":{"tabs":[{"url":"https://no.com"}]}}, [{"tabs":[1]}], {"tabs":{"url":1}}, 7, {"tabs":[ ]}, {"tabs":["https://no.com",{"url":"https://c.com","title":5}]} ] }',
    '{"\\u0065xport":[{"ta\\u0062s":[{"url":"https://a.com"}]}]}', '{"export":[{"tabs":[{"url":"https://a.com"}]}],"export":[{"tabs":[{"url":"https://b.com"}]}]}',
    '{"export":[{"tabs":[{"url":"https://a.com"},]}]}', '{"export":[{"tabs":[{"url":"https://a.com"}]}]} x', '["https://a.com"]\u00a0', "[tru]", "['https://a.com']",
    '["https://a.com/\n"]', '{"ex port":[{"tabs":[{"url":"https://a.com"}]}]}', '{"export":[{"tabs" 1:[{"url":"https://a.com"}]}]}', '["https://é.com/日本", "https://b.com"]',
    '{"export":5 [{"tabs":[{"url":"https://a.com"}]}]}', '["https://a.com", {"url":"https://b.com"]', '{"export":[{"tabs":[{"url":"https://a.com"}]]}]}', "[[1,2],[3]", "[NaN]",
]


def plain_json(text):
    """What a parser of the whole document gives: format and links."""
    strict = json.JSONDecoder(parse_constant=lambda c: 1 / 0)
    try:
        data = strict.decode(text.strip("\u00a0 \t\r\n"))
    except (ValueError, ZeroDivisionError):
        return "json_array", []
    web = lambda u: isinstance(u, str) and u.startswith(("http://", "https://"))
    if isinstance(data, dict) and isinstance(data.get("export"), list):
        tabs = [t for g in data["export"] if isinstance(g, dict) and isinstance(g.get("tabs"), list) for t in g["tabs"]]
        return "tablerone_json", [(t["url"], str(t.get("title") or "")) for t in tabs if isinstance(t, dict) and web(t.get("url"))]
    links = []
    for item in data if isinstance(data, list) else []:
        url, title = (item, "") if isinstance(item, str) else (item.get("url"), item.get("title")) if isinstance(item, dict) else (None, "")
        if web(url):
            links.append((url, title if isinstance(title, str) else ""))
    return "json_array", links


def test_json_by_records_equals_a_parser_of_the_whole(spark):
    rows = [(f"{k}.json", text) for k, text in enumerate(JSON_CASES)]
    lines = files.lines_of(spark.createDataFrame(rows, "filename string, content string"))
    want = {name: plain_json(text) for name, text in rows}
    for size in (1, 3, 11, 1 << 18):
        got = links_at(lines, size)
        assert {k: v for k, v in got.items() if v != want[k]} == {}, size


def test_json_records_of_random_documents(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [rng.randrange(100), None, "x\\\"]}[{,:" * rng.randrange(3), "https://h.com/" + "é\\" * rng.randrange(4)][kind]
        if kind < 6:
            return {rng.choice(["url", "title", "export", "tabs", "k"]): value(depth - 1) for _ in range(rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(4))]

    rows = []
    for k in range(120):
        data = [value(3) for _ in range(rng.randrange(6))]
        if k % 2:
            data = {"a": value(2), "export": [{"n": value(2), "tabs": data} if rng.random() < 0.7 else value(2) for _ in range(4)], "z": value(2)}
        text = json.dumps(data, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice('[]{},:" ') + text[at + rng.randrange(2) :]
        rows.append((f"{k}.json", text))
    lines = files.lines_of(spark.createDataFrame(rows, "filename string, content string"))
    want = {name: plain_json(text) for name, text in rows}
    for size in (5, 40):
        got = links_at(lines, size)
        assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}, size


HTML_CASES = [
    '<A HREF="https://a.com">a</A><a href="https://b.com" X=1>b</a>', '<A HREF="https://a.com">no<b></A><A HREF="https://b.com">b</A>',
    '<A\n\n HREF="https://a.\ncom"\nADD="<x"\n>t\nu</A\n></A>', "<A HREF=\"https://a.com\">t</A" + "\n" * 5 + "x", '<A HREF="">e</A><A  HREF="https://c.com"></A>',
    '<A HREF="https://open.com">' + "long " * 50 + "\n" * 9 + "</A>" + '<A HREF="https://z.com">z</A>' * 3, '<A <A HREF="https://q.com">q</A>', '<A HREF="https://never.com', "",
]


def test_anchors_by_blocks_equal_a_search_of_the_whole(spark):
    rows = [(f"{k}.html", text) for k, text in enumerate(HTML_CASES)]
    lines = files.lines_of(spark.createDataFrame(rows, "filename string, content string"))
    pattern = re.compile(r'(?i)<A\s+HREF="([^"]+)"[^>]*>([^<]*)</A>')
    want = sorted((name, k, *found) for name, text in rows for k, found in enumerate(pattern.findall(text)))
    for size in (1, 2, 9, 50, 1 << 18):
        assert sorted(map(tuple, records.scan_anchors(lines, size).collect())) == want, size


def test_lines_and_hashes_of_files_equal_those_of_contents(spark, tmp_path):
    contents = {"end.txt": "a\nb\n", "none.txt": "", "open.txt": "a\r\nb", "breaks.txt": "\n\n", "one.txt": "x", "é ü.txt": "日本\n\n", "big.txt": "line of text\n" * 5000}
    for name, text in contents.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = files.read_source_lines(spark, str(tmp_path))
        got = sorted((r["filename"], r["pos"], r["line"]) for r in lines.collect())
        hashes = {r["filename"]: r["sha256"] for r in files.content_hashes(lines).collect()}
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((name, k, line) for name, text in contents.items() for k, line in enumerate(text.split("\n")))
    assert hashes == {name: hashlib.sha256(text.encode()).hexdigest() for name, text in contents.items()}
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_listing_is_complete_and_newest_first(spark, tmp_path):
    for k, name in enumerate(["old.txt", "b.txt", "a.txt", "empty.txt", "sub/new %41.txt"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.txt" else "x" * k + "y")
        at = 1_700_000_000 + 60 * (k if k in (0, 3, 4) else 1)
        os.utime(tmp_path / name, (at, at))
    got = [(r["filename"], r["size"], int(r["modified_at"].replace(tzinfo=None).timestamp())) for r in files.list_source_files(spark, str(tmp_path)).collect()]
    order = [("sub/new %41.txt", 5, 4), ("empty.txt", 0, 3), ("a.txt", 3, 1), ("b.txt", 2, 1), ("old.txt", 1, 0)]
    assert [g[:2] for g in got] == [o[:2] for o in order]
    assert [g[2] - got[-1][2] for g in got] == [60 * o[2] for o in order]
    assert {r["filename"]: r["content"] for r in files.read_source_files(spark, str(tmp_path)).collect()}["empty.txt"] == ""


def test_broken_json_is_reported(spark):
    rows = [("bad.json", '["https://a.com"'), ("ok.json", '["http://a.b"]'), ("t.txt", "https://a.com")]
    lines = files.lines_of(spark.createDataFrame(rows, "filename string, content string"))
    got = {r["filename"]: r["error"] for r in formats.detect_formats(lines).collect()}
    assert got == {"bad.json": "not valid JSON", "ok.json": None, "t.txt": None}
