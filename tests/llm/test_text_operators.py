"""Operators on single texts, and joins of texts, against brute force on small tables."""

import collections
import hashlib
import re
import struct
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from hrefmill.llm import bpe, decontaminate, html_text, language, near_dedup, quality, sharding, suffix_dedup
from hrefmill.llm.html_text import main_text

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- decontamination ----------------------------------------------------------------------------


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words = fold(text)
        hit, found = [False] * len(words), set()
        for name, item in items:
            w = fold(item)
            for k in range(1 if 0 < len(w) < window else max(0, len(w) - window + 1)):
                part = w[k : k + window]
                for p in range(len(words) - len(part) + 1):
                    if words[p : p + len(part)] == part:
                        hit[p : p + len(part)] = [True] * len(part)
                        if name is not None:
                            found.add(str(name))
        out.append((doc_id, len(words), sum(hit), sorted(found)))
    return sorted(out, key=repr)


TEN = "one two three four five six seven eight nine ten"
LEAKS = [
    (1, f"before {TEN.upper()} after"),
    (2, TEN.replace("ten", "eleven")),
    (3, f"{TEN} eleven, {TEN}"),
    (4, None),
    (5, ""),
    (5, "short ITEM here short item"),
    (None, "Ünï " + TEN),
]
ITEMS = [(10, TEN + " eleven"), (2, "short item"), (2, "short item"), (3, None), (4, "?!"), (None, "here short")]


@pytest.mark.parametrize("block", [1, 10_000])
def test_contamination(spark, block):
    bench = frame(spark, ITEMS, "item_id long, text string")
    got = decontaminate.report(frame(spark, LEAKS), bench, block=block).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=repr) == contamination(LEAKS, ITEMS)


def test_clean_keeps_columns_and_clashing_names(spark):
    docs = frame(spark, [(1, TEN, 7, "x"), (2, "fine", 8, None)], "doc_id long, text string, n_words int, spans string")
    bench = frame(spark, [(1, TEN)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(2, "fine", 8, None)]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 2
    assert decontaminate.clean(docs.limit(0), bench).columns == docs.columns


def test_longest_matches(spark):
    docs = frame(spark, [(1, "a b c d"), (2, "x b c d e y")])
    got = decontaminate.longest_matches(docs, frame(spark, [(7, "b c d e f")], "item_id long, text string"))
    best = {r["item_word"]: (r["length"], r["doc_id"], r["doc_word"]) for r in got.collect()}
    assert best == {0: (4, "2", 1), 1: (3, "2", 2), 2: (2, "2", 3), 3: (1, "2", 4)}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_suffix_array_order(docs):
    words = np.array([ord(w) << 32 for d in docs for w in d], "u8")
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("i8")
    sa = decontaminate.build(words, first, 16)
    tails = [[ord(w) for w in d[i:]] for d in docs for i in range(len(d))]
    assert [tails[i] for i in sa.order] == sorted(tails)


# --- suffix dedup -------------------------------------------------------------------------------


def cut(docs, width):
    firsts = {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (text or "").encode()
        for p in range(len(b) - width + 1):
            firsts.setdefault(b[p : p + width], i)
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if i is not None and firsts[b[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def suffix_cases():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(2, 8)))
    passage = " ".join(word() for _ in range(40))
    docs = []
    for i in range(30):
        own = [" ".join(word() for _ in range(12)) for _ in range(2)]
        k = int(rng.integers(0, 60))
        docs.append((i % 25, f"{own[0]} {passage[k : k + int(rng.integers(20, 160))]} {own[1]}"))
    return docs + [(None, passage), (3, passage), (40, passage), (41, passage), (42, None), (43, ""), (44, "a" * 300), (45, "a" * 200)]


def test_suffix_dedup(spark):
    docs = suffix_cases()
    for width, digits in ((50, (20, 36, 50)), (12, (5, 12))):
        got = suffix_dedup.dedup(frame(spark, docs), width=width, digits=digits).drop("text").collect()
        want = cut(docs, width)
        assert sorted([(*r[:4], bytes(r[4])) for r in got], key=repr) == want
    assert suffix_dedup.dedup(frame(spark, docs).limit(0)).count() == 0


def test_suffix_bit_map(spark):
    """The published map has every anchor, few others, and a full one lets every row through."""
    rng = np.random.default_rng(4)
    anchors = rng.integers(0, 1 << 63, 5000).astype("i8")
    shared = spark.createDataFrame([(int(a),) for a in anchors], "anchor long")
    for most in (suffix_dedup.MOST_BITS, 32768):
        bits = suffix_dedup._set_bits(suffix_dedup.anchor_bits(shared, most))
        assert len(bits) * 8 == (65536 if most > 65536 else 32768)
        place = anchors & (len(bits) * 8 - 1)
        assert (bits[place >> 3] >> (place & 7).astype("u1") & 1).all()
        assert np.unpackbits(bits).sum() == len(np.unique(place))


def test_suffix_alive_parts():
    """Runs of the parts are the runs of the whole text, as far as its windows are alive."""
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"ab c", "u1"), 600)
    whole = suffix_dedup.Runs(data, np.array([0, 600]), 12, 12)
    starts, ends = np.array([200, 3, 30, 215, 588]), np.array([215, 20, 31, 230, 589])
    part, off, at = suffix_dedup._alive_parts(data, starts, ends, 12)
    assert at.tolist() == [3, 30, 200, 588] and off[-1] == len(part)
    runs = suffix_dedup.Runs(part, off, 12, 12)
    first = runs.first + (at - off[:-1])[np.searchsorted(off, runs.first, "right") - 1]
    want = np.flatnonzero(suffix_dedup.inside(600, starts, ends))
    assert first.tolist() == want.tolist()
    assert (runs.string == whole.string[np.searchsorted(whole.first, want)]).all()
    assert len(suffix_dedup._alive_parts(data, starts[:0], ends[:0], 12)[0]) == 0


# --- near-duplicates ----------------------------------------------------------------------------


def jaccard(a, b):
    ws = [fold(t) for t in (a, b)]
    x, y = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {} for w in ws)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def near_cases():
    rng = np.random.default_rng(5)
    vocabulary = ["w%d" % i for i in range(400)]
    docs, n = [], 0
    for _ in range(6):
        base = list(rng.choice(vocabulary, 120))
        for k in range(6):
            text = list(base)
            for p in rng.choice(120, k, replace=False):
                text[p] = "edit%d" % rng.integers(1e9)
            docs.append((n, " ".join(text)))
            n += 1
    docs += [(100, docs[0][1]), (None, docs[0][1]), (101, None), (102, None), (103, ""), (104, ""), (105, "a b"), (106, "a b")]
    return docs + [(106, "a b"), (107, "x y z"), (108, "rep eat " * 50), (109, "rep eat " * 49)]


def test_near_duplicate_classes(spark):
    docs = near_cases()
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(docs):
        for j, (_, b) in enumerate(docs[:i]):
            if a is not None and b is not None and (a == b or jaccard(a, b) >= 0.8):
                group[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(docs[i][0])
    names = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    want = sorted(((docs[i][0], names[find(i)]) for i in range(len(docs))), key=repr)
    got = near_dedup.classes(frame(spark, docs)).collect()
    assert sorted([(r["id"], r["class_id"]) for r in got], key=repr) == want
    kept = near_dedup.distinct(frame(spark, [(*d, 1) for d in docs], DOCS + ", key int"))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(names.values())
    assert near_dedup.classes(frame(spark, docs).limit(0)).count() == 0


@given(st.lists(st.sampled_from("ab cd ef gh ij"), max_size=30), st.lists(st.sampled_from("ab cd ef gh ij"), max_size=30))
@settings(max_examples=50, deadline=None)
def test_similarity(a, b):
    a, b = "".join(a), "".join(b)
    sets = [near_dedup.shingles(np.frombuffer(t.encode(), "u1"), np.array([0, len(t)]))[1:] for t in (a, b)]
    assert abs(near_dedup.similarity(*sets) - jaccard(a, b)) < 1e-9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, m = rng.integers(1, 1 << 60, 300).astype("u8"), 512
    a, b = shared[:250], shared[50:]
    rows = np.repeat([0, 1], [250, 250])
    weights = np.ones(500)
    sig = near_dedup.prob_min_hash(rows, np.concatenate([a, b]), weights, 2, m)
    assert abs((sig[0] == sig[1]).mean() - 200 / 300) < 0.08


# --- quality ------------------------------------------------------------------------------------


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    n, r = len(words), sum(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n)


def test_base_rules(spark):
    texts = [None, "", "\n\n", "a b\na b\n a b\n\na b", "é ü #*|<>&%$ " * 30, "x y z u v w q r s t " * 3, "one\x0btwo three"]
    texts += ["\n".join(f"line {i % 3} of text" for i in range(20)), " lead", "trail \n"]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in quality.judged(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert quality.judged(docs.limit(0)).count() == 0


def plain_kneser_ney(texts, order=4):
    """Log-probability of a character after a context, by interpolated modified Kneser-Ney, in plain Python."""
    level = {order: collections.Counter(("\0" * order + t)[i + 1 : i + 1 + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])
    discount = {}
    for k, counts in level.items():
        n1, n2, n3, n4 = (sum(n == i for n in counts.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discount[k] = [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]

    def p(context, c, k=order):
        if k == 0:
            return 1 / (len(level[1]) + 1)
        context = context[len(context) - (k - 1) :]
        after = {g: n for g, n in level[k].items() if g[:-1] == context}
        if not after:
            return p(context, c, k - 1)
        cut = {g: n - discount[k][min(n, 3) - 1] for g, n in after.items()}
        total = sum(after.values())
        return cut.get(context + c, 0) / total + (1 - sum(cut.values()) / total) * p(context, c, k - 1)

    return p


def packed(text):
    out = 0
    for c in text:
        out = (out << 16) | ord(c)
    return out


@pytest.mark.parametrize("per_file", [7, 1_000_000])
def test_kneser_ney_equals_plain_python(spark, per_file):
    texts = ["abracadabra cadabra", "bra bra \u4e2d\u6587 \u4e2d", "", "ab" * 40]
    docs = frame(spark, [*enumerate(texts), (9, None)])
    trained = quality.train(docs, per_file=per_file)
    assert (len(trained.files) > 5) == (per_file == 7)
    model, p = quality.Model.mapped(trained), plain_kneser_ney(texts)
    alphabet = sorted(set("".join(texts)))
    for context in ("abr", "bra", "zzz", "\0\0\0", "\0\0a", "xab", "\u4e2d\u6587 "):
        found = np.exp(model.score(np.array([packed(context + c) for c in [*alphabet, "z"]], "u8")))
        assert found == pytest.approx([p(context, c) for c in [*alphabet, "z"]])
        assert found.sum() == pytest.approx(1)


def test_model_of_nothing(spark):
    model = quality.Model.mapped(quality.train(frame(spark, [(1, None), (2, "")])))
    assert model.score(np.array([packed("abcd")], "u8")) == pytest.approx([0.0])


def test_log_perplexity_equals_plain_python(spark):
    texts = [" ".join(f"w{i * j * j % 43}" for j in range(1, 40)) for i in range(1, 12)]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counted = [t for t in texts if not base(t)[-1]]
    assert len(counted) > 5
    p = plain_kneser_ney(counted)
    for row in quality.judged(docs).collect():
        text = "\0\0\0" + texts[row["doc_id"]]
        plain = -sum(np.log(p(text[i : i + 3], text[i + 3])) for i in range(len(text) - 3)) / (len(text) - 3)
        assert row["log_perplexity"] == pytest.approx(plain)


def test_quality_keeps_clashing_columns(spark):
    names = ["of", "about", "__of", "__about", "limit", "gram", "n_words", "upper"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    plain = {r["doc_id"] for r in quality.clean(docs).collect()}
    wide = quality.clean(docs.select("*", *[quality.F.lit(i).alias(c) for i, c in enumerate(names)]))
    rows = wide.collect()
    assert wide.columns == ["doc_id", "text", "lang", *names] and {r["doc_id"] for r in rows} == plain
    assert all(tuple(r)[3:] == tuple(range(8)) for r in rows)


def test_quality_rejects_odd_text_only(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    table = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, lower int")
    kept = quality.clean(table)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    judged = {r["doc_id"]: r["base_failed"] for r in quality.judged(table).collect()}
    assert all(i in ids for i in clean if not judged[i])


def test_quality_rejects_tables_and_strewn_symbols(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect() if not r["base_failed"]}
    marks = [" | ", "&&&", "###", "%%%", "$$$", "***"]
    junk = [i for i, q in labels.items() if q == 0 and i in rows and any(m in texts[i] for m in marks)]
    assert len(junk) > 10 and not any(rows[i]["kept"] for i in junk)
    assert all(rows[i]["kept"] for i, q in labels.items() if q == 1 and i in rows)


def test_quality_bands_of_small_classes_take_neighbours(spark):
    rows = [(i, "en", 300, 1.5 + i / 1000, 0, 50, 0) for i in range(40)] + [(99, "en", 600, 4.0, 0, 100, 0)] * 50
    found = frame(
        spark, rows, "id long, lang string, n_chars long, log_perplexity double, n_symbols long, n_words long, n_repeat_words long"
    )
    limits = frame(spark, [("en", 0.1)], "of string, limit double")
    upper = {r["length"]: r["upper"] for r in quality.bands(found, limits, quality.F.col("id")).collect()}
    assert upper[9] < 2.0 and upper[8] < 2.0


# --- BPE ----------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    texts = [None, "", " \n\t", "Hello, WORLD's 42 <|endoftext|>x<|startoftext|>", "ÉÈ ΑΣ ﬁ İ \x1c   漢字 👍", "x" * 500 + "the" * 99]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(texts)]
    for lexicon in (0, 50, 100_000):
        names = {k: k for k in bpe.OUTPUTS}
        got = bpe.encode(frame(spark, rows), bpe.default_tokenizer(), outputs=names, lexicon=lexicon).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, rows), bpe.default_tokenizer()), bpe.default_tokenizer())
    assert back.filter("doc_id = 3").first()["decoded"] == library.decode(
        library.encode(texts[3], add_special_tokens=False).ids, skip_special_tokens=False
    )
    assert bpe.encode(frame(spark, []), bpe.default_tokenizer()).count() == 0


@given(st.sets(st.binary(min_size=0, max_size=6), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
@settings(max_examples=60, deadline=None)
def test_lexicon_finds_its_words_only(words, others):
    words = sorted(words)
    outputs = [[i, i + 1] for i in range(len(words))]
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon(words, outputs), "i8"))
    asked = words + others
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in asked])]).astype("i8")
    places = lexicon.places(np.frombuffer(b"".join(asked), "u1"), offsets)
    for word, place in zip(asked, places):
        if word in words and len(lexicon.keys):
            ids = lexicon.ids[lexicon.offsets[place] : lexicon.offsets[place + 1]].tolist()
            assert ids == outputs[words.index(word)]
        elif word not in words:
            assert place == -1


# --- language -----------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.op8_language(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "der die das und nicht " * 9, "de"), (2, None, "de"), (3, "12 %", None), (4, "", None), (5, "le la les des pour " * 9, "fr"), (5, "le la les des pour", "fr")]
    docs = frame(spark, [(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, Score string, count int")
    assert language.identify(docs, {}).columns == ["doc_id", "text", "lang", "count", "lang_pred", "score", "rejected"]
    made = language.dictionaries(docs)
    assert set(made) == {"de", "fr"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, made).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[1][0] == "de" and got[5][0] == "fr"
    assert language.dictionaries(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}


def smallest(contents, text):
    """Language and score by compressing with every dictionary on its own."""
    raw = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
    if not raw:
        return "und", 0.0
    sizes = []
    for name in sorted(contents):
        words = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = language._settings(len(raw) < language.SHORT)
        words.precompute_compress(compression_params=settings)
        made = zstandard.ZstdCompressor(dict_data=words, compression_params=settings)
        sizes.append((sum(len(made.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)), name))
    first, other = sorted(sizes)[:2]
    return first[1], 1 - first[0] / other[0]


@pytest.mark.parametrize("together", [1, 3, 32])
def test_language_equals_one_dictionary_after_another(spark, together):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    contents = language.dictionaries(docs, sample=20)
    assert len(contents) == 4
    got = language.identify(docs, contents, together=together).collect()
    assert len(got) == docs.count()
    assert all((r["lang_pred"], r["score"]) == smallest(contents, r["text"]) for r in got)


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(300)]
    word = lambda n: n.translate(str.maketrans("0123456789", "qwertyuiop"))
    docs = frame(spark, [(i, f"{word(n)} " * 30, n) for i, n in enumerate(names * 2)], "doc_id long, text string, lang string")
    contents = language.dictionaries(docs, most=100)
    assert sorted(contents) == names
    got = language.identify(docs, contents).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) == 600


def test_language_of_a_very_long_text(spark):
    docs = frame(spark, [(1, "der die das und nicht " * 200_000, "de"), (2, "le la les des pour " * 9, "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.dictionaries(docs)).collect()}
    assert got == {1: "de", 2: "fr"}


# --- sharding -----------------------------------------------------------------------------------


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    return {s: sum(r["size"] for r in by_shard.get(s, [])) for s in range(shards)}


@pytest.mark.parametrize("part", [100, 20_000])
def test_shards(spark, part):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 400)) + str(i)) for i in range(700)]
    rows += [(1000 + i, "copy " * 8) for i in range(40)] + [(1, None), (2, None), (None, ""), (3, "")]
    got = sharding.shard(frame(spark, rows), shards=6, part=part).collect()
    sizes = check_shards(rows, got, 6)
    assert max(sizes.values()) - min(sizes.values()) <= 64


def test_a_giant_group_has_its_shard(spark):
    rows = [(i, "giant" * 10) for i in range(300)] + [(1000 + i, f"small {i}") for i in range(200)]
    sizes = check_shards(rows, sharding.shard(frame(spark, rows), shards=5, part=60).collect(), 5)
    giant, *rest = sorted(sizes.values(), reverse=True)
    assert giant == 300 * 58 and max(rest) - min(rest) <= 16
    assert sharding.shard(frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_differencing_is_a_partition(sizes, bins):
    out = sharding.difference(sizes, bins)
    assert len(out) == len(sizes) and all(0 <= b < bins for b in out)


# --- HTML ---------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("<p>hi", "hi"),
    ("plain &amp; simple", "plain & simple"),
    ("<nav><a href=/>x</a></nav><article><h1>T</h1><p>a<br>b  c</p><p>d &lt;e&gt;&nbsp;f</article><footer>z</footer>", "T\na b c\nd <e> f"),
    ("<body><header>Site</header><main><h1>A</h1><p>x y</p><form><p>f</p></form></main><div class=cookie-notice>k</div>", "A\nx y"),
    ("<div class=sidebar><p>aa, bb</p></div><div id=content><h1>T</h1><p>Text, with commas.</p></div><div id=comments><p>c</p></div>", "T\nText, with commas."),
    ("<article><p>a <button>no</button> b<script>if(a<b){'</p>'}</script></p><style>p{}</style></article>", "a b"),
    ("<a title='x>y' href=q>q</a> 1 < 2 <!-- c > d --> e <br/>z<", "q 1 < 2 e z<"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p>one</p><aside>no</aside><section id=comments><article>c</article></section><p>two</p></article>", "one\ntwo"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_main_text_of_deep_and_broken_pages():
    assert main_text("<div>" * 20_000 + "x") == "x"
    assert main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert main_text("<<<>>><p <a b='<p>c") is not None


def test_small_chunks_give_the_same_classes(spark, monkeypatch):
    docs = frame(spark, near_cases())
    whole = sorted(map(tuple, near_dedup.classes(docs).collect()), key=repr)
    link = near_dedup._link_classes
    monkeypatch.setattr(near_dedup, "_link_classes", lambda m, t, least: link(m, t, least, chunk=2))
    assert sorted(map(tuple, near_dedup.classes(docs).collect()), key=repr) == whole


def test_main_text_of_deep_pages_with_texts():
    for tag in ("div", "b", "article", "li", "blockquote"):
        assert main_text(f"<{tag}>a " * 20_000).count("a") == 20_000


def test_main_text_keeps_what_an_article_holds():
    long = "Some words of the article, which goes on for a while, and then some. " * 3
    page = (
        f'<article><p>{long}</p><p class="share-price">Up 3 points</p><div class="related-work"><p>Work of others</p></div>'
        '<ul><li><a href="/a">Source one</a></li><li><a href="/b">Source two</a></li></ul>'
        '<div class="ad-box-300">Buy</div><div class="ad">Buy</div><nav><a href="/c">Menu</a></nav>'
        '<div class="share-article-now"><a href="/d">Tell all your friends</a></div>'
        '<p>Price <span class="share-price">7</span><span class="ad">Buy</span></p></article>'
    )
    kept = ["Up 3 points", "Work of others", "Source one", "Source two", "Price 7"]
    want = [long.strip(), *kept]
    assert [b for b in main_text(page).split("\n") if "friends" not in b] == want
    doubtful = f'<article><p>{long}</p><div class="share-price-now"><a href="/d">Tell all your friends</a></div></article>'
    assert main_text(doubtful) == long.strip()
    lists = f'<div><p>{long}</p><p>{long}</p><ul><li><a href="/a">One</a></li></ul></div>'
    assert main_text(lists) == f"{long.strip()}\n{long.strip()}"


class Reading(HTMLParser):
    """The blocks inside the article element of a page, by the standard library's parser."""

    FURNITURE = {"nav", "aside", "footer", "form", "script", "style"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.blocks, self.text = 0, 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.text).split())
        self.blocks += [text] if text else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out += tag in self.FURNITURE
        if tag == "br":
            self.text.append(" ")
        elif tag in html_text.BLOCK:
            self.end()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.end()
        self.depth -= tag == "article"
        self.out -= tag in self.FURNITURE

    def handle_data(self, data):
        if self.depth > 0 and not self.out:
            self.text.append(data)


def test_main_text_of_all_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = html_text.op4_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"]).collect()
    assert rows
    for row in rows:
        assert row["text"] == "\n".join(Reading(row["html"] or "").blocks)
        assert row["n_chars"] == len(row["text"])


def test_extract_with_a_clashing_column(spark):
    pages = spark.createDataFrame([(1, "old", "<p>new, in a page</p>"), (2, None, None)], "page_id long, Text string, html string")
    got = html_text.extract(pages).orderBy("page_id")
    assert got.columns == ["page_id", "html", "text"]
    assert [r["text"] for r in got.collect()] == ["new, in a page", ""]


def test_bpe_counts_words_without_python(spark):
    """Workers that count take memory beside the JVM; words of white space of all kinds, empty and null texts."""
    texts = [" a b\tc\n", "a\x0bb\x0c\x0d\na", " x  x", "", " \t ", None, "ß \x1c\x00 ß"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = bpe.word_counts(docs)
    want = {}
    for t in texts:
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            want[w.encode()] = want.get(w.encode(), 0) + 1
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == want
    assert "InArrow" not in counts._jdf.queryExecution().executedPlan().toString()
