"""Quality rules: counts of words, symbols and repeats, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model over the characters of all reference texts, order ``ORDER``: fixed alphabets
make it small where words would not, and it needs no word list for any language. A reference text passes the base
rules and has at most ``MOST_SYMBOLS`` symbols a word, or as many as the median of its language where that is more:
junk is no reference while it is less than half of a language. Spark counts the n-grams of
every reference text (each task sums up its own first) and derives the lower orders, discounts, context weights and
probabilities as tables, without any cut-off. What scoring needs is sorted by 64-bit n-gram hashes and written by
tasks as files of hash ranges in the shared folder. Every executor fetches them, lays hashes and log-probabilities
out as two arrays on its own disk, a record batch at a time, and its tasks map these into memory and bisect them:
no model passes through the driver or lies in a task's memory. Each executor needs 16 bytes of disk, twice while
they are laid out, for each different n-gram and context.

A document's log-perplexity is compared with those of the different reference texts of its language that are about
as long (the length in characters between the same powers of two, since short texts vary more). Where these are
fewer than ``LEAST_TEXTS``, the length classes next to it count as well, up to ``WIDTHS[-1]`` away; a language with
fewer texts still is judged by those it has. A band reaches ``LOWER_REACH`` quartile ranges below and ``UPPER_REACH``
above the quartiles, ``SLACK`` at least; they were chosen on the labels of check_s.

Defined cases: words are runs between white space; a null text has none and fails; a text of fewer than 20
words, or of which more than 30 % of the words lie in repeated windows of eight, fails; documents without a
language are a language of their own; characters beyond the basic plane count as one; repeated rows are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import fresh, keep, publish_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
PER_FILE = 4_000_000  # rows of a file of the model
BROADCAST_BANDS = 100_000
PIECE = 1_000_000  # bytes of text that a task looks at together
LOWER_REACH, UPPER_REACH, SLACK = 4.0, 4.0, 0.15
MOST_SYMBOLS = 0.1
LEAST_TEXTS, WIDTHS = 30, (0, 1, 2, 4)
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8

_not_space = np.ones(256, bool)
_not_space[[9, 10, 11, 12, 13, 32]] = False
_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True


def masked(order: int) -> int:
    return (1 << (16 * order)) - 1


# --- the text side ------------------------------------------------------------------------------


def grams_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character the packed n-gram that ends with it (16 bits a character, 0 before the text),
    and the first character of each text."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "u4")
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    packed = np.minimum(codes, 0xFFFF).astype("u8")
    out = packed.copy()
    place = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, ORDER):
        before = np.zeros_like(packed)
        before[k:] = packed[:-k]
        before[place < k] = 0
        out |= before << np.uint64(16 * k)
    return out, first


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of values given by the first of each run."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    starts, ends, first = common.words_in(data, off, _not_space)
    prefix = common.Prefix(data, common.byte_values(fold=False))
    heads = (data & 0xC0) != 0x80
    # Lines: a line's hash with its text's number; all but the first of equal ones are repeats.
    breaks = data == 10
    line_first = np.concatenate([off[:-1], np.flatnonzero(breaks) + 1])
    line_row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, np.flatnonzero(breaks), "right") - 1])
    order = np.lexsort((line_first, line_row))
    line_first, line_row = line_first[order], line_row[order]
    same = np.append(line_row[1:] == line_row[:-1], False)
    line_end = np.where(same, np.append(line_first[1:], 0) - 1, off[line_row + 1])
    worded = np.searchsorted(starts, line_first) < np.searchsorted(starts, line_end)
    line_first, line_end, line_row = line_first[worded], line_end[worded], line_row[worded]
    lines = prefix.spans(line_first, line_end)
    repeats = ~_first_of_each(lines, line_row)
    # Windows of words: a word is in a repeat if any window over it occurs twice in its text.
    words = prefix.spans(starts, ends)
    row = common.row_of(first)
    windows = common.chain(words, REPEAT_WINDOW)
    whole = np.flatnonzero(np.arange(len(windows)) + REPEAT_WINDOW <= np.repeat(first[1:], np.diff(first))[: len(windows)])
    twice = whole[_in_pairs(windows[whole], row[whole])]
    step = np.zeros(len(words) + 1, "i4")
    np.add.at(step, twice, 1)
    np.add.at(step, twice + REPEAT_WINDOW, -1)
    return {
        "n_words": np.diff(first),
        "word_chars": per_row(heads & _not_space[data], off),
        "n_symbols": per_row(_symbol[data], off),
        "n_dup_lines": np.bincount(line_row[repeats], minlength=len(off) - 1),
        "n_repeat_words": per_row(np.cumsum(step)[:-1] > 0, first),
    }


def _own(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return common.mix(values ^ common.mix(row.astype("u8") + np.uint64(1)))


def _first_of_each(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values are the first equal ones of their row."""
    out = np.zeros(len(values), bool)
    out[np.unique(_own(values, row), return_index=True)[1]] = True
    return out


def _in_pairs(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values occur more than once in their row."""
    own = _own(values, row)
    ordered = np.sort(own)
    several = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(own, several) if len(several) else np.zeros(len(own), bool)


# --- counting and the model ---------------------------------------------------------------------


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(grams_of(d, o)[0], return_counts=True) for _, _, d, o in common.pieces(batch.column(0), PIECE)]
        if found:
            grams = pa.array(np.concatenate([g for g, _ in found]).view("i8"))
            counts = pa.array(np.concatenate([n for _, n in found]), pa.int64())
            summed = pa.table({"gram": grams, "n": counts}).group_by("gram").aggregate([("n", "sum")])
            yield from summed.rename_columns(["gram", "n"]).to_batches()


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, n)``: how often each packed n-gram of the highest order occurs in all texts."""
    counted = docs.select(text_col).mapInArrow(common.releasing(_count_task), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> list[float]:
    """The three discounts of an order, from how many n-grams have counts of one to four."""
    n1, n2, n3, n4 = (float(x) for x in level.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """From n-gram counts: per order ``(gram, logp)`` and ``(context, weight)`` (logs), and the log-probability
    of an unknown character."""
    level = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before an n-gram
        tail = F.col("gram").bitwiseAND(F.lit(masked(k)))
        level[k] = keep(level[k + 1].select(tail.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    characters = level[1].count()
    uniform = 1.0 / (characters + 1)
    grams_at: dict[int, DataFrame] = {}
    weights_at: dict[int, DataFrame] = {}
    unknown = math.log(uniform)
    for k in range(1, ORDER + 1):
        d = _discounts(level[k])
        n = F.col("n")
        cut = n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        rows = level[k].select("gram", "n", cut.alias("cut"))
        context = F.shiftrightunsigned("gram", 16)
        sums = (F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        if k == 1:
            total, mass = rows.agg(*sums).first()
            if not total:
                return {}, {}, unknown
            weight = 1.0 - mass / total
            grams_at[1] = keep(rows.select("gram", (F.col("cut") / total + weight * uniform).alias("p")))
            unknown = math.log(weight * uniform)
            continue
        contexts = keep(
            rows.groupBy(context.alias("context"))
            .agg(*sums)
            .select("context", "total", (1.0 - F.col("mass") / F.col("total")).alias("weight"))
        )
        lower = grams_at[k - 1].select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
        joined = (
            rows.withColumns({"context": context, "tail": F.col("gram").bitwiseAND(F.lit(masked(k - 1)))})
            .join(contexts, "context")
            .join(lower, "tail")
        )
        grams_at[k] = keep(
            joined.select("gram", (F.col("cut") / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        )
        weights_at[k] = contexts.select("context", F.log("weight").alias("weight"))
    logs = {k: df.select("gram", F.log("p").alias("logp")) for k, df in grams_at.items()}
    return logs, weights_at, unknown


def hashed(grams: np.ndarray, order: int | np.ndarray) -> np.ndarray:
    """Sort key of n-grams or contexts of an order."""
    return common.mix(grams.astype("u8") + np.asarray(order, "u8") * np.asarray(0x9E3779B97F4A7C15, "u8"))


class Trained(NamedTuple):
    """A model: its files in ascending order, the rows of each of its tables, and the log of an unknown character."""

    files: list[str]
    sizes: list[int]
    unknown: float


class Model:
    """Sorted arrays of hashes (signed) and logs, table after table: n-grams by order, then contexts by order."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, sizes: list[int], unknown: float):
        ends = np.cumsum([0, *sizes])
        self.tables = [(keys[a:b], logs[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        self.unknown = unknown

    @classmethod
    def mapped(cls, trained: Trained) -> Model:
        """The model over this executor's copies of its files, laid out once by the first task that needs it."""
        if not trained.files:
            return cls(np.zeros(0, "i8"), np.zeros(0), trained.sizes, trained.unknown)
        paths = [SparkFiles.get(f) for f in trained.files]
        made = {"key": f"{paths[0]}.keys", "log": f"{paths[0]}.logs"}
        for column, path in made.items():
            if not os.path.exists(path):
                with open(f"{path}.{os.getpid()}", "wb") as out:  # tasks that meet here write the same bytes
                    for source in paths:
                        for batch in pq.ParquetFile(source).iter_batches(columns=[column]):
                            out.write(batch.column(0).to_numpy().tobytes())
                os.replace(out.name, path)
        return cls(np.memmap(made["key"], "i8", "r"), np.memmap(made["log"], "f8", "r"), trained.sizes, trained.unknown)

    def _find(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs of the keys, and which of them the table has."""
        hashes, logs = self.tables[table]
        if not len(hashes):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        keys = keys.view("i8")
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return logs[at], hashes[at] == keys

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each packed n-gram given those before it."""
        logp, known = self._find(0, hashed(grams & np.uint64(masked(1)), 1))
        logp = np.where(known, logp, self.unknown)
        for k in range(2, ORDER + 1):
            gram = grams & np.uint64(masked(k)) if k < ORDER else grams
            found, known = self._find(k - 1, hashed(gram, k))
            weight, seen = self._find(ORDER + k - 1, hashed(gram >> np.uint64(16), k))
            logp = np.where(known, found, logp + np.where(seen, weight, 0.0))
        return logp


def _key_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, gram, log = (batch.column(i) for i in range(3))
        orders = place.to_numpy() % ORDER + 1
        keys = hashed(gram.to_numpy(), orders.astype("u8")).view("i8")
        yield pa.RecordBatch.from_arrays([place, pa.array(keys), log], ["place", "key", "log"])


def train(docs: DataFrame, text_col: str = "text", per_file: int = PER_FILE) -> Trained:
    """The model of all texts as files of hash ranges, of some ``per_file`` rows each, on all executors."""
    grams, weights, unknown = kneser_ney(keep(gram_counts(docs, text_col)))
    tables = [df.select(F.lit(k - 1).alias("place"), "gram", F.col("logp").alias("log")) for k, df in grams.items()]
    tables += [df.select(F.lit(ORDER + k - 1), "context", "weight") for k, df in weights.items()]
    if not tables:
        return Trained([], [0] * (2 * ORDER), unknown)
    rows = keep(functools.reduce(DataFrame.union, tables).mapInArrow(_key_task, "place int, key long, log double"))
    found = {r["place"]: r["count"] for r in rows.groupBy("place").count().collect()}
    sizes = [found.get(i, 0) for i in range(2 * ORDER)]
    parts = rows.repartitionByRange(-(-sum(sizes) // per_file), "place", "key").sortWithinPartitions("place", "key")
    return Trained(publish_parts(parts.select("key", "log")), sizes, unknown)


# --- scoring ------------------------------------------------------------------------------------

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score_task(trained: Trained, text: str, names: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.mapped(trained)
        for batch in batches:
            for begin, end, data, off in common.pieces(batch.column(batch.schema.get_field_index(text)), PIECE):
                made = {k: pa.array(v, pa.int64()) for k, v in base_counts(data, off).items()}
                grams, first = grams_of(data, off)
                different = np.unique(grams)
                logs = model.score(different)[np.searchsorted(different, grams)]
                sizes = np.diff(first)
                made["n_chars"] = pa.array(sizes, pa.int64())
                mean = -per_row(logs, first) / np.maximum(sizes, 1)
                made["log_perplexity"] = pa.array(mean, pa.float64(), mask=sizes == 0)
                part = batch.slice(begin, end - begin)
                columns = dict(zip(part.schema.names, part.columns)) | {names[k]: v for k, v in made.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _base_task(text: str, lang: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index(lang))
            for begin, end, data, off in common.pieces(batch.column(batch.schema.get_field_index(text)), PIECE):
                made = base_counts(data, off)
                share = made["n_symbols"] / np.maximum(made["n_words"], 1)
                part = {"of": langs.slice(begin, end - begin), "share": pa.array(share, pa.float64())}
                yield pa.RecordBatch.from_pydict(part).filter(pa.array(_passes(made)))

    return run


def _reference_task(text: str, limit: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = batch.column(batch.schema.get_field_index(limit)).to_numpy(zero_copy_only=False)
            texts = batch.column(batch.schema.get_field_index(text))
            for begin, end, data, off in common.pieces(texts, PIECE):
                made = base_counts(data, off)
                stays = _passes(made) & (made["n_symbols"] <= limits[begin:end] * made["n_words"])
                part = pa.RecordBatch.from_arrays([texts.slice(begin, end - begin)], ["text"])
                yield part.filter(pa.array(stays))

    return run


def _passes(made: dict[str, np.ndarray]) -> np.ndarray:
    return (made["n_words"] >= LEAST_WORDS) & (100 * made["n_repeat_words"] <= MOST_REPEATED * made["n_words"])


def symbol_limits(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(of, limit)``: per language, the symbols a word that a reference text may have."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("of"))
    schema = T.StructType([T.StructField("of", rows.schema["of"].dataType), T.StructField("share", T.DoubleType())])
    median = F.percentile_approx("share", 0.5, 10_000)
    shares = rows.mapInArrow(common.releasing(_base_task("text", "of")), schema)
    return keep(shares.groupBy("of").agg(F.greatest(median, F.lit(MOST_SYMBOLS)).alias("limit")))


def reference(docs: DataFrame, limits: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(text)`` of the documents that the model learns from."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    limited = rows.join(F.broadcast(limits), rows["lang"].eqNullSafe(limits["of"])).select("text", "limit")
    return limited.mapInArrow(common.releasing(_reference_task("text", "limit")), "text string")


def scored(
    docs: DataFrame, limits: DataFrame, text_col: str = "text", lang_col: str = "lang", names: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` plus the counts of the base rules, the length in characters and the log-perplexity."""
    keys = [*_COUNTS, "n_chars", "log_perplexity"]
    names = {k: (names or {}).get(k, k) for k in keys}
    kinds = [T.LongType()] * 6 + [T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[k], t) for k, t in zip(keys, kinds))])
    trained = train(reference(docs, limits, text_col, lang_col))
    return docs.mapInArrow(common.releasing(_score_task(trained, text_col, names)), schema)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words"):
    """The base rules as a column."""
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat_words) > MOST_REPEATED * F.col(n_words))


def bands(found: DataFrame, limits: DataFrame, same, lang: str = "lang") -> DataFrame:
    """``(lang, length, lower, upper)`` of log-perplexity over the reference texts; ``same`` tells texts apart."""
    rows = found.filter(~base_failed()).select(
        F.col(lang).alias("lang"), length_class().alias("about"), "log_perplexity", "n_symbols", "n_words", same.alias("same")
    )
    held = rows.join(F.broadcast(limits), rows["lang"].eqNullSafe(limits["of"]))
    texts = held.filter(F.col("n_symbols") <= F.col("limit") * F.col("n_words")).select(
        "lang", "about", "log_perplexity", "same"
    ).dropDuplicates(["lang", "about", "same"])
    # Every class sees its neighbours; the nearest ones that are enough make its band.
    away = F.explode(F.sequence(F.lit(-WIDTHS[-1]), F.lit(WIDTHS[-1])))
    near = texts.select("lang", "about", "log_perplexity", away.alias("away"))
    within = [F.abs("away") <= w for w in WIDTHS]
    made = near.groupBy("lang", (F.col("about") + F.col("away")).alias("length")).agg(
        *[F.count_if(w).alias(f"n{i}") for i, w in enumerate(within)],
        *[
            F.percentile_approx(F.when(w, F.col("log_perplexity")), [0.25, 0.75], 10_000).alias(f"q{i}")
            for i, w in enumerate(within)
        ],
    )
    q = F.col(f"q{len(WIDTHS) - 1}")
    for i in reversed(range(len(WIDTHS) - 1)):
        q = F.when(F.col(f"n{i}") >= LEAST_TEXTS, F.col(f"q{i}")).otherwise(q)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    reach = lambda by: F.greatest(by * (q3 - q1), F.lit(SLACK))
    return made.select("lang", "length", q.alias("q")).select(
        "lang", "length", (q1 - reach(LOWER_REACH)).alias("lower"), (q3 + reach(UPPER_REACH)).alias("upper")
    )


def length_class():
    return F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")


def _sent(limits: DataFrame) -> DataFrame:
    """The bands, a few dozen a language, for a join that moves no texts unless there are too many languages."""
    limits = keep(limits)
    return F.broadcast(limits) if limits.count() <= BROADCAST_BANDS else limits


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ids, counts, log-perplexity, its band, ``base_failed`` and ``kept``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    symbols = symbol_limits(rows)
    found = keep(scored(rows, symbols).withColumn("same", F.xxhash64("text")).drop("text"))
    limits = _sent(bands(found, symbols, F.col("same"))).withColumnsRenamed({"lang": "of", "length": "about"})
    same = found["lang"].eqNullSafe(limits["of"]) & (length_class() == limits["about"])
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return found.join(limits, same, "left").select(
        "doc_id",
        "lang",
        *_COUNTS,
        "n_chars",
        "log_perplexity",
        "lower",
        "upper",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    keys = [*_COUNTS, "n_chars", "log_perplexity"]
    if {k.lower() for k in [*keys, "lang", "text", "lower", "upper"]} & {c.lower() for c in docs.columns if c not in (text_col, lang_col)}:
        plain = {c: f"__{i}" for i, c in enumerate(docs.columns)}
        renamed = docs.withColumnsRenamed(plain)
        back = clean(renamed, plain[text_col], plain[lang_col])
        return back.withColumnsRenamed({v: k for k, v in plain.items()})
    symbols = symbol_limits(docs, text_col, lang_col)
    found = keep(scored(docs, symbols, text_col, lang_col))
    of, about = fresh("of", found.columns), fresh("about", found.columns)
    limits = _sent(bands(found, symbols, F.xxhash64(text_col), lang_col)).withColumnsRenamed({"lang": of, "length": about})
    same = found[lang_col].eqNullSafe(limits[of]) & (length_class() == limits[about])
    passed = found.filter(~base_failed()).join(limits, same)
    return passed.filter(F.col("log_perplexity").between(F.col("lower"), F.col("upper"))).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang")
