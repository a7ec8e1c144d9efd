"""Line CRF, importance resampling and fill-in-the-middle against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hrefmill.llm import common, fill_in_middle, line_crf, resample

SF = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    " \n\n ",
    "a",
    "é😀ß",
    "one two three",
    "One two THREE one two three one",
    "x<P>y",
    "a<S",
    "<M>",
    "ends with <",
    "S> begins",
    "日本語のテキスト with 中文 words " * 30,
    "w" * 70 + " " + "é" * 100 + " short " + "w" * 70,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4,
    "tab\tand | pipe, and $$$ %%% symbols\nsecond line.\n\nThird line!!",
]


def documents(spark, extra=()):
    rows = [(k, t) for k, t in enumerate([*TEXTS, *extra])] + [(3, "a"), (3, "a"), (None, "a b c " * 10), (5, "other text of id five")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


# --- fill in the middle -----------------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:i], text[i:j], text[j:]
    if h[3] % 100 < 20:
        return n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_python(spark):
    rows, docs = documents(spark, ["é x " * 700_000, *(f"text {'<' * k}S> {k} ümlaut" for k in range(60))])
    keys = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    found = fill_in_middle.transform(docs, {k: k for k in keys}).collect()
    assert len(found) == len(rows)
    want = collections.Counter()
    for doc_id, text in rows:
        n, form, i, m, output = plain_fim(doc_id, text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text or "")]
        want[(doc_id, n, form, i, m, output, *sha)] += 1
    assert collections.Counter((r["doc_id"], *(r[k] for k in keys)) for r in found) == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_restores_and_describes(spark):
    rows, docs = documents(spark)
    written = fill_in_middle.transform(docs, {"output": "output", "form": "form", "pieces": "pieces"})
    for r in fill_in_middle.restore(written.withColumnRenamed("text", "before"), text_col="text").collect():
        assert r["text"] == (r["before"] or "")
        raw = (r["before"] or "").encode()
        buffers = {0: raw, 1: b"<P>", 2: b"<S>", 3: b"<M>"}
        assert b"".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]).decode() == r["output"]


def test_fill_in_middle_cut_splits_one_descriptor():
    pieces = [fill_in_middle.Piece(0, 0, 5), fill_in_middle.Piece(1, 0, 3), fill_in_middle.Piece(0, 9, 4)]
    for at in range(13):
        left, right = fill_in_middle.cut(pieces, at)
        assert sum(p.length for p in left) == at and len(left) + len(right) <= 4
        whole = [(p.buffer, p.start + k) for p in [*left, *right] for k in range(p.length)]
        assert whole == [(p.buffer, p.start + k) for p in pieces for k in range(p.length)]


def test_fill_in_middle_raises_on_broken_output(spark):
    broken = spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="no <S>"):
        fill_in_middle.restore(broken).collect()


def test_fill_in_middle_replaces_clashing_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "old", 7)], "doc_id long, text string, FORM string, extra int")
    out = fill_in_middle.transform(docs, {"form": "form"})
    assert out.columns == ["doc_id", "text", "extra", "form"] and out.first()["extra"] == 7
    assert fill_in_middle.transform(docs.limit(0), {"form": "form"}).count() == 0


# --- importance resampling --------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[k : k + size]) for size in (1, 2, 3) for k in range(len(words) - size + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def plain_resample(rows, target, percent=5):
    corpus, wanted = collections.Counter(), collections.Counter()
    for _, text in rows:
        corpus.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s_all, t_all = sum(corpus.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((corpus[b] + 1) * t_all))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, able[: len(able) * percent // 100]


def test_crc_of_many_spans_at_once():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 100, 5000, 300_000]]
    data = np.frombuffer(b"".join(words), "u1")
    off = np.cumsum([0, *map(len, words)])
    crc = resample.direct(data, off[:-1], off[1:])
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert resample.appended(crc, 0x20).tolist() == [zlib.crc32(w + b" ") for w in words]
    pairs = list(itertools.product(range(0, len(words), 7), range(len(words))))
    a, b = (np.array(x) for x in zip(*pairs))
    assert resample.joined(crc[a], crc[b], np.diff(off)[b]).tolist() == [zlib.crc32(words[x] + words[y]) for x, y in pairs]


@pytest.mark.parametrize("head", [(0, 0), (1, 1), (7, 5), (2048, 65_536)])
def test_buckets_do_not_depend_on_the_head(spark, head):
    rows, docs = documents(spark)
    known = resample.vocabulary(docs.select("text"), head_words=head[0], head_pairs=head[1])
    assert len(known.hashes) <= head[0] and len(known.pairs) <= head[1]
    data, off = common.bytes_of(common.strings([t for _, t in rows]))
    words, runs = resample.buckets_of(data, off, known, 10_000)
    for r, (_, text) in enumerate(rows):
        here = [b for word, bucket in runs for w, b in zip(word, bucket) if words.first[r] <= w < words.first[r + 1]]
        assert here == features(text)[1]


def test_head_words_of_one_hash_are_told_apart(spark):
    known = resample.head_of([b"alpha", b"beta"])
    forged = known._replace(hashes=np.sort(np.array([1, 2], "u8")))
    forged.hashes[:] = np.unique(resample.words_of(np.frombuffer(b"gamma delta", "u1"), np.array([0, 11]), None)[1].hashes)
    _, w = resample.words_of(np.frombuffer(b"gamma delta", "u1"), np.array([0, 11]), forged)
    assert w.head.tolist() == [-1, -1] and w.crc.tolist() == [zlib.crc32(b"gamma"), zlib.crc32(b"delta")]


def test_resample_equals_plain_python(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "Straße", "naïve", "x1", "data", "model", "日本"]
    extra = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 60))) for _ in range(150)] + ["word " * 300_000]
    rows, docs = documents(spark, extra)
    target = ["the data model of the data", None, "", "x1 x1 x1"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    weighed = resample.weigh(docs, bench)
    found = resample.draw(weighed.drop("text"), percent=20).collect()
    want, drawn = plain_resample(rows, target, percent=20)
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    assert collections.Counter(tuple(r[k] for k in names) for r in found) == collections.Counter(want)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r[k] for k in names) for r in ranked] == drawn
    assert resample.resample(docs, bench, percent=20).count() == len(drawn)


def test_resample_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "old", 2)], "doc_id long, text string, Rank string, Weight int")
    none = spark.createDataFrame([], "item_id long, text string")
    out = resample.draw(resample.weigh(docs, none), percent=100)
    assert out.count() == 1 and out.first()["rank"] == 1
    assert resample.draw(resample.weigh(docs.limit(0), none)).count() == 0


# --- line quality -----------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 7, 1, 1, 5]
    first = np.concatenate([[True] + [False] * (n - 1) for n in sizes])
    evidence, stay = rng.normal(0, 2, len(first)), np.array([0.7, -0.4])
    good, joint = line_crf.marginals(evidence, stay, first)
    at = pair = 0
    for n in sizes:
        total, single, double = 0.0, np.zeros(n), np.zeros((max(n - 1, 0), 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(evidence[at + k] for k in range(n) if y[k]) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b))
            total += p
            for k in range(n):
                single[k] += p * y[k]
            for k in range(n - 1):
                double[k, y[k], y[k + 1]] += p
        assert np.allclose(good[at : at + n], single / total)
        assert np.allclose(joint[pair : pair + n - 1], double / total)
        at, pair = at + n, pair + n - 1


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    first = np.array([True, False, False, True, True, False, False, False])
    seen, labels = rng.normal(size=(8, 3)), np.array([1, 1, 0, 0, 1, 0, 0, 1])
    theta = rng.normal(size=6)
    _, grad = line_crf._loss(theta, seen, labels, first)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-5
        slope = (line_crf._loss(theta + step, seen, labels, first)[0] - line_crf._loss(theta - step, seen, labels, first)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-6


def test_lines_and_looks():
    texts = ["Good line here.\n\n  \n$$$ &&& ***\nGood line here.", None, "", "a a a"]
    data, off = common.bytes_of(common.strings(texts))
    lines = line_crf.lines_of(data, off)
    assert lines.text.tolist() == [0, 0, 0, 3] and lines.number.tolist() == [0, 3, 4, 0]
    look = lambda name: lines.looks[:, line_crf.LOOKS.index(name)].tolist()
    assert look("repeated_line") == [0, 0, 1, 0] and look("wordless") == [0, 1, 0, 0] and look("symbols")[1] == 1
    assert look("repeats_previous") == pytest.approx([0, 0, 0, math.sqrt(2 / 3)]) and look("ends_in_stop") == [1, 0, 1, 0]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    words = ["the", "and", "house", "river", "walks", "slowly", "green", "under"]
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        lines = [" ".join(rng.choices(words, k=8)).capitalize() + "." for _ in range(rng.randrange(1, 8))]
        if not good:
            lines = lines[:1] + [" ".join(w + rng.choice(["%%%", "&&&"]) for w in line.split()) for line in lines]
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_of_unseen_documents_and_lines(spark, judged):
    docs, labels = judged
    model = line_crf.fit(docs, labels.filter("doc_id < 200"))
    scored = {r["doc_id"]: r for r in line_crf.score(docs, model).collect()}
    right = sum((scored[k]["score"] >= 0.7) == (k % 3 > 0) for k in range(200, 300))
    assert right >= 98
    long = spark.createDataFrame([(1, "The river walks slowly under the green house.\n" * 60_000), (1, None), (None, "")], "id long, text string")
    got = line_crf.score(long, model).collect()
    assert sorted((r["n_lines"], r["score"] > 0.5) for r in got) == [(0, False), (0, False), (60_000, True)]
    lines = line_crf.label_lines(docs, model).collect()
    assert len(lines) == sum(r["n_lines"] for r in scored.values()) and all(0 <= r["good"] <= 1 for r in lines)


def test_quality_without_a_model_and_of_odd_tables(spark, judged):
    docs, labels = judged
    for some, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        assert {r["score"] for r in line_crf.score(docs.limit(3), line_crf.fit(docs, some)).collect()} == {want}
    odd = labels.unionByName(labels.filter("doc_id = 0").selectExpr("doc_id", "1 - quality AS quality")).unionByName(
        spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    )
    model = line_crf.fit(docs.unionByName(docs), odd)
    assert model.constant is None
    clash = docs.selectExpr("doc_id", "text", "'x' AS Score", "1 AS extra")
    assert line_crf.score(clash, model).columns == ["doc_id", "text", "extra", "score", "n_lines", "n_bad_lines"]
    assert line_crf.score(docs.limit(0), model).count() == 0


def test_quality_query_on_unseen_labels(spark):
    scored = line_crf.op11_quality_lines(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 30 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_evidence_equals_wide_rows():
    rng = np.random.default_rng(6)
    text = np.array([0, 0, 0, 1, 2, 2])
    looks = rng.normal(size=(6, 16))
    first = line_crf._starts(text)
    weights = rng.normal(size=51)
    model = line_crf.Model(rng.normal(size=16), np.full(16, 2.0), weights, np.zeros(2))
    wide = line_crf.with_neighbours((looks - model.mean) / model.scale, first)
    assert np.allclose(model.evidence(line_crf.Lines(text, text, text, looks), first), wide @ weights[:-1] + weights[-1])
