"""BPE encoding and decoding with a minimal acyclic transducer for the frequent words of the corpus.

Words here are the runs between ASCII white space, as they stand in the text; the tokenizer's own rules
(special strings, NFC, lower case, its word pattern) never look across white space, so a word's ids do
not depend on its neighbours. Spark counts the words of all texts. The ``lexicon`` most frequent are
encoded once and compiled into a minimal acyclic automaton: words share prefixes and suffixes, and the
numbers on a word's arcs add up to its place in the table of id outputs. The file goes out with Spark's
``addFile`` and is memory-mapped by the tasks. All other words are merged exactly, pair by pair in the
order of the merge ranks. The size of the lexicon bounds file and compile time and changes no result.

Tokenizer files: ``tokenizer.json`` of a BPE model with an end-of-word suffix, byte-level symbols, no
decoder (ids decode to their tokens joined by spaces, special tokens included) and no added tokens other
than special ones. Defined cases: a null or empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import keep, publish

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEXICON = 100_000
PIECE = 1_000_000  # bytes of text that a task looks at together
SEEN = 50_000  # merged words that a task remembers, as packed ids; it changes no result
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
OUTPUTS = {
    "token_ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "n_tokens": (pa.int64(), T.LongType()),
    "ids_sha256": (pa.string(), T.StringType()),
    "decoded": (pa.string(), T.StringType()),
    "decoded_sha256": (pa.string(), T.StringType()),
}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Tokenizer:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = _byte_symbols()
        self.inner = [vocab.get(c, -1) for c in symbols]
        self.final = [vocab.get(c + suffix, -1) for c in symbols]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(vocab[a] << 20) | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    @classmethod
    def of(cls, tables: dict) -> Tokenizer:
        """From the plain tables, which is how a tokenizer travels to the tasks."""
        made = cls.__new__(cls)
        made.__dict__.update(tables)
        return made

    def splitter(self) -> Callable[[str], list[int]]:
        """Exact encoder of one word (a text without ASCII white space)."""
        find = regex.compile(self.pattern).findall
        parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

        def encode(word: str) -> list[int]:
            ids: list[int] = []
            for part in parts(word) if parts and "<" in word else (word,):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    # Lower case goes character by character, without the rule for a final sigma.
                    plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    for piece in find(plain):
                        ids.extend(self.merge(piece.encode()))
            return ids

        return encode

    def merge(self, word: bytes) -> list[int]:
        """Merge the symbols of a word: the pair of lowest rank first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        ids = [i for i in ids if i >= 0]
        if len(ids) > 40:
            return self._merge_long(ids)
        merges = self.merges
        ranks = [merges.get((a << 20) | b, 1 << 60) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best & 0xFFFFF]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = merges.get((ids[k] << 20) | ids[k + 1], 1 << 60)
            if k:
                ranks[k - 1] = merges.get((ids[k - 1] << 20) | ids[k], 1 << 60)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (m := merges.get((ids[k] << 20) | ids[after[k]])) is not None:
                heapq.heappush(heap, (m >> 20, k, m & 0xFFFFF, ids[k], ids[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, new, left, right = heapq.heappop(heap)
            if not alive[k] or ids[k] != left or after[k] >= n or ids[after[k]] != right:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = new, False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i, a in zip(ids, alive) if a]


# --- the automaton ------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """Minimal acyclic transducer of distinct words, as one block of arrays.

    Incremental construction from sorted words: states that can no longer change are merged with an
    equal one. An arc's number counts the words that come before it, so the sum along a path is the word's place
    in sorted order, which finds its ids.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, arcs

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, []]]  # the unfrozen states of the last word: [final, [(byte, state)]]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for i in order:
        word = words[i]
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    close(0)
    start = freeze(path[0])
    count = [0] * len(states)  # words accepted from a state; arcs lead to states frozen before
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for byte, target in arcs:
            keys.append((s << 8) | byte)
            targets.append(target)
            adds.append(total)
            total += count[target]
        count[s] = total
    lengths = [len(outputs[i]) for i in order]
    arrays = [
        np.array([start], "i8"),
        np.array(keys, "i8"),
        np.array(targets, "i8"),
        np.array(adds, "i8"),
        np.array([f for f, _ in states], "i8"),
        np.concatenate([[0], np.cumsum(lengths)]).astype("i8"),
        np.array([x for i in order for x in outputs[i]], "i8"),
    ]
    head = np.array([len(a) for a in arrays], "i8")
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """The arrays of a compiled lexicon, over any buffer (in tasks a memory map)."""

    def __init__(self, block: np.ndarray):
        sizes = block[:7]
        cuts = np.cumsum(np.concatenate([[7], sizes]))
        parts = [block[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        (self.start, self.keys, self.targets, self.adds, self.final, self.offsets, self.ids) = parts

    def places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon, -1 for words it lacks: all words step together."""
        n = len(offsets) - 1
        out = np.full(n, -1, "i8")
        if not len(self.keys):
            return out
        word, at, end = np.arange(n), offsets[:-1].astype("i8"), offsets[1:].astype("i8")
        state, total = np.full(n, self.start[0]), np.zeros(n, "i8")
        while len(word):
            done = at == end
            if done.any():
                ok = done & (self.final[state] == 1)
                out[word[ok]] = total[ok]
                word, at, end, state, total = (x[~done] for x in (word, at, end, state, total))
                continue
            key = (state << 8) | data[at]
            arc = np.searchsorted(self.keys, key)
            found = self.keys[np.minimum(arc, len(self.keys) - 1)] == key
            arc = arc[found]
            word, at, end = word[found], at[found] + 1, end[found]
            state, total = self.targets[arc], total[found] + self.adds[arc]
        return out


# --- tasks --------------------------------------------------------------------------------------


def _words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts as one Arrow array, and the number of each text's first word."""
    starts, ends, first = common.words_in(data, off, ~_SPACE)
    squeezed = data[~_SPACE[data]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(squeezed)]), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of runs given by start and length."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def _encode_task(tokenizer, file: str, text: str, names: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tokenizer.of(tokenizer.value)
        lexicon = Lexicon(np.memmap(SparkFiles.get(file), "i8", "r"))
        encode, seen = tables.splitter(), {}
        spaced = [t.encode() + b" " for t in tables.tokens]
        token_bytes = np.frombuffer(b"".join(spaced), "u1")
        token_off = np.concatenate([[0], np.cumsum([len(t) for t in spaced])])
        for batch in batches:
            for begin, end, data, off in common.pieces(batch.column(batch.schema.get_field_index(text)), PIECE):
                words, first = _words(data, off)
                coded = words.dictionary_encode()
                known = coded.dictionary
                place = lexicon.places(*common.bytes_of(known.cast(pa.large_binary()).view(pa.large_string())))
                rest = known.take(pa.array(np.flatnonzero(place < 0))).to_pylist()
                if len(seen) > SEEN:
                    seen.clear()
                merged = []
                for w in rest:
                    if (ids := seen.get(w)) is None:
                        ids = seen[w] = array("i", encode(w.decode())).tobytes()
                    merged.append(ids)
                # One table of ids for the distinct words: those of the lexicon, then the merged ones.
                extra = np.frombuffer(b"".join(merged), "i4").astype("i8")
                extra_len = np.fromiter(map(len, merged), "i8", len(merged)) // 4
                pool = np.concatenate([lexicon.ids, extra])
                start, length = np.empty(len(known), "i8"), np.empty(len(known), "i8")
                inside = place >= 0
                start[inside] = lexicon.offsets[place[inside]]
                length[inside] = lexicon.offsets[place[inside] + 1] - start[inside]
                start[~inside] = len(lexicon.ids) + np.cumsum(extra_len) - extra_len
                length[~inside] = extra_len
                index = coded.indices.to_numpy(zero_copy_only=False)
                lengths = length[index]
                ids = pool[ragged(start[index], lengths)]
                cut = np.concatenate([[0], np.cumsum(lengths)])[first]
                part = batch.slice(begin, end - begin)
                columns = dict(zip(part.schema.names, part.columns))
                for name, column in _outputs(ids, cut, token_bytes, token_off, set(names)).items():
                    columns[names[name]] = column
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            common.release()

    return run


def _outputs(
    ids: np.ndarray, cut: np.ndarray, token_bytes: np.ndarray, token_off: np.ndarray, wanted: set[str]
) -> dict[str, pa.Array]:
    """The wanted columns for documents whose ids are ``ids[cut[i]:cut[i + 1]]``."""
    out: dict[str, pa.Array] = {}
    pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    if "token_ids" in wanted:
        out["token_ids"] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
    if "n_tokens" in wanted:
        out["n_tokens"] = pa.array(np.diff(cut), pa.int64())
    if "ids_sha256" in wanted:
        raw = ids.astype("<u4")
        out["ids_sha256"] = common.strings([hashlib.sha256(raw[a:b].data).hexdigest() for a, b in pairs])
    if wanted & {"decoded", "decoded_sha256"}:
        sizes = np.diff(token_off)[ids]
        stream = token_bytes[ragged(token_off[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts = [stream[ends[a] : max(ends[a], ends[b] - 1)] for a, b in pairs]  # without the last space
        if "decoded" in wanted:
            out["decoded"] = common.strings([t.tobytes().decode() for t in texts])
        if "decoded_sha256" in wanted:
            out["decoded_sha256"] = common.strings([hashlib.sha256(t.data).hexdigest() for t in texts])
    return {name: out[name] for name in OUTPUTS if name in out}


# --- operators ----------------------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all texts, words as bytes. No Python runs for it."""
    words = docs.select(F.explode(F.split(F.col(text_col), r"[\x09-\x0D\x20]+")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A text that begins or ends with white space has an empty part there.
    return counts.filter("word != ''").select(F.col("word").cast("binary").alias("word"), "n")


def frequent_words(docs: DataFrame, most: int, text_col: str = "text") -> list[bytes]:
    """The words of all texts with the highest counts, at most ``most``: all above one count, ties left out."""
    counts = keep(word_counts(docs, text_col))
    per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = F.sum("words").over(W.orderBy(F.desc("n")))
    # One row for each distinct count.
    least = per_count.select("n", upto.alias("upto")).filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return [] if least is None else [bytes(r[0]) for r in counts.filter(F.col("n") >= least).select("word").collect()]


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    outputs: dict[str, str] | None = None,
    lexicon: int = LEXICON,
) -> DataFrame:
    """``docs`` plus the columns of ``outputs`` (a key of ``OUTPUTS`` -> column name; default ``token_ids``)."""
    spark = docs.sparkSession
    names = outputs or {"token_ids": "token_ids"}
    names = {k: names[k] for k in OUTPUTS if k in names}
    tokenizer = Tokenizer(tokenizer_path)
    exact = tokenizer.splitter()
    words = frequent_words(docs, lexicon, text_col)
    file = publish(spark, "lexicon", compile_lexicon(words, [exact(w.decode()) for w in words]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(v, OUTPUTS[k][1]) for k, v in names.items())])
    task = _encode_task(spark.sparkContext.broadcast(vars(tokenizer)), file, text_col, names)
    return docs.mapInArrow(common.releasing(task), schema)


def _decode_task(tokens, column: str, out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = tokens.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            texts = [" ".join([spaced[i] for i in row or ()]) for row in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, common.strings(texts)], [*batch.schema.names, out])

    return run


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``tokens`` plus the text of its ids; null or no ids give the empty text."""
    spark = tokens.sparkSession
    spaced = spark.sparkContext.broadcast(Tokenizer(tokenizer_path).tokens)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())])
    return tokens.mapInArrow(_decode_task(spaced, ids_col, out), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, in the digest form of the contract."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = {k: k for k in ("n_tokens", "ids_sha256", "decoded_sha256")}
    return encode(docs, default_tokenizer(), outputs=names).drop("text")
