"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its evidence is what it looks like (word lengths, symbols, capitals,
repeats, sentence marks) and what the lines before and after it look like; neighbouring labels depend on each
other by a learned transition. Forward-backward gives each line's probability of being good given its whole
document, and a document's score is the mean of these, weighted by the bytes of the lines' words.

Training documents are labelled as a whole, so their lines take the label of the document. The model is fitted
on a bounded sample: at most ``FIT_DOCUMENTS`` documents a label, drawn by the hash of their id, of those with at
most ``FIT_LINES`` lines. What reaches the driver is one short vector a line of those, 51 MB at most, and
what tasks get back is the model, a few hundred numbers. Scores cover all lines of all documents.

Chains are run as prefix products of 2 x 2 matrices by doubling, over all lines of a piece of text at once, so a
document of a million lines takes as many passes as the logarithm of its length.

Defined cases: null, empty and blank texts have no line and score 0; repeated rows are scored alike; rows of
``labels`` with a null id, another label than 0 or 1, or both labels for one id teach nothing, an id with
several texts teaches its smallest; with no usable label all other documents score 0.5, with one label only
they score that label; an empty table gives no rows; columns named like a result, in any case, are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIT_DOCUMENTS, FIT_LINES = 2000, 200
ROUNDS, PENALTY = 80, 1e-4
THRESHOLD = 0.7


def _bytes_in(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE = _bytes_in(b" \t\n\x0b\x0c\r")
_UPPER = _bytes_in(bytes(range(0x41, 0x5B)))
_LETTER = _UPPER | _bytes_in(bytes(range(0x61, 0x7B))) | _bytes_in(bytes(range(0x80, 0x100)))
_DIGIT = _bytes_in(b"0123456789")
_SYMBOL = _bytes_in(b"#*$%&|<>")
_STOP = _bytes_in(b".!?")
_PUNCTUATION = _bytes_in(b".,;:!?")
_SHORT = 3


# --- lines ----------------------------------------------------------------------------------------


class Lines(NamedTuple):
    """Lines with a word, in order: number of the text, number in it, bytes of words, and looks (one row a line)."""

    text: np.ndarray
    number: np.ndarray
    size: np.ndarray
    looks: np.ndarray


#: What a line's vector holds, in order; shares are square roots, which tells few from none.
LOOKS = [
    "words", "word_bytes", "symbols", "exclamations", "capitals", "digits", "stops", "capitalised", "short_words",
    "repeats_previous", "repeats_any", "repeated_line", "wordless", "odd_endings", "ends_in_stop", "letters",
]


def lines_of(data: np.ndarray, off: np.ndarray) -> Lines:
    """The lines of a piece of texts and what they look like."""
    cuts = np.unique(np.concatenate([off, np.flatnonzero(data == 0x0A) + 1]))
    if len(cuts) < 2:
        return Lines(*(np.zeros(0, "i8") for _ in range(3)), np.zeros((0, len(LOOKS))))
    starts, ends, first = common.words_in(data, cuts, ~_SPACE)
    text = np.searchsorted(off, cuts[:-1], "right") - 1
    firsts = np.searchsorted(cuts, off[text])
    number = np.arange(len(text)) - firsts
    words = np.diff(first)
    live = np.flatnonzero(words > 0)
    # The words of the lines that have some, line by line; reduceat needs no empty groups then.
    n, at = words[live].astype("f8"), first[:-1][live]
    sizes = ends - starts
    size = np.add.reduceat(sizes, at) if len(live) else sizes
    if not len(live):
        return Lines(text[live], number[live], size, np.zeros((0, len(LOOKS))))

    def of_bytes(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[data], cuts[:-1], dtype="i8")[live].astype("f8")

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag, at, dtype="i8") / n

    hashes = common.Prefix(data, common.byte_values(fold=False)).spans(starts, ends)
    line = np.repeat(np.arange(len(live)), words[live])
    previous = np.zeros(len(starts), bool)
    previous[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    # Lines are compared by the hashes of their words in order.
    whole = np.add.reduceat(common.mix(hashes + (np.arange(len(starts)) - at[line]).astype("u8")), at)
    by_text = np.lexsort((np.arange(len(live)), whole, text[live]))
    repeated = np.zeros(len(live), bool)
    repeated[by_text[1:]] = (whole[by_text[1:]] == whole[by_text[:-1]]) & (text[live][by_text[1:]] == text[live][by_text[:-1]])
    # Whether a word has a letter, from the number of letters before each byte.
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype="i4")])
    last = data[ends - 1]
    letter_bytes = np.maximum(of_bytes(_LETTER), 1)
    shares = [
        of_bytes(_SYMBOL) / size,
        of_bytes(_bytes_in(b"!")) / size,
        of_bytes(_UPPER) / letter_bytes,
        of_bytes(_DIGIT) / size,
        of_words(_STOP[last]),
        of_words(_UPPER[data[starts]]),
        of_words(sizes <= _SHORT),
        of_words(previous),
        of_words(again),
        repeated.astype("f8"),
        of_words(letters[ends] == letters[starts]),
        of_words(~_LETTER[last] & ~_DIGIT[last] & ~_PUNCTUATION[last]),
        _STOP[data[ends[at + words[live] - 1] - 1]].astype("f8"),
        of_bytes(_LETTER) / size,
    ]
    looks = np.column_stack([np.log1p(n), np.log(size / n), *(np.sqrt(s) for s in shares)])
    return Lines(text[live], number[live], size, looks)


def _starts(text: np.ndarray) -> np.ndarray:
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    return first


def with_neighbours(looks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Looks of each line, of the line before and of the line after (zeros beyond the text), and both edges."""
    last = np.ones(len(first), bool)
    last[:-1] = first[1:]
    before, after = np.zeros_like(looks), np.zeros_like(looks)
    before[1:], after[:-1] = looks[:-1], looks[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([looks, before, after, first, last])


# --- the chain --------------------------------------------------------------------------------------


class Model(NamedTuple):
    """Scale of the looks, weights of a line's evidence for good, its bias, and the transition between labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stay: np.ndarray  # log potentials of two bad and of two good neighbours; a change has 0
    constant: float | None = None  # the score where labels could not teach a model

    def evidence(self, lines: Lines, first: np.ndarray) -> np.ndarray:
        """What ``with_neighbours`` times the weights gives, without its wide rows."""
        looks = (lines.looks - self.mean) / self.scale
        k = looks.shape[1]
        own, before, after = (looks @ self.weights[i * k : (i + 1) * k] for i in range(3))
        last = np.append(first[1:], True)[: len(first)]
        out = own + self.weights[-1] + first * self.weights[3 * k] + last * self.weights[3 * k + 1]
        out[1:] += np.where(first[1:], 0.0, before[:-1])
        out[:-1] += np.where(last[:-1], 0.0, after[1:])
        return out


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / m.max(axis=(1, 2), keepdims=True)


def marginals(evidence: np.ndarray, stay: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good per line, and joint probabilities of each line and the next (2 x 2) inside a text.

    A text's first matrix ignores what comes before, so the products of neighbouring texts do not mix.
    """
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    u = np.clip(evidence, -30, 30)
    emit = np.stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))], axis=1)
    step = np.exp(np.array([[stay[0], 0.0], [0.0, stay[1]]]) - max(stay[0], stay[1], 0.0))
    link = np.where(first[:, None, None], 1.0, step[None])
    matrices = _scaled(link * emit[:, None, :])
    heads = np.flatnonzero(first)
    longest = int(np.diff(np.append(heads, n)).max())
    forward, backward = matrices.copy(), matrices.copy()
    d = 1
    while d < longest:
        forward[d:] = _scaled(forward[:-d] @ forward[d:])
        backward[:-d] = _scaled(backward[:-d] @ backward[d:])
        d *= 2
    alpha = forward[:, 0, :]
    alpha = alpha / alpha.sum(axis=1, keepdims=True)
    beta = np.ones((n, 2))
    inner = ~first[1:]
    following = backward[1:].sum(axis=2)
    beta[:-1][inner] = following[inner] / following[inner].sum(axis=1, keepdims=True)
    good = alpha * beta
    good = good[:, 1] / good.sum(axis=1)
    joint = alpha[:-1, :, None] * (link * emit[:, None, :])[1:] * beta[1:, None, :]
    joint = joint / joint.sum(axis=(1, 2), keepdims=True)
    return good, joint[inner]


def _loss(theta: np.ndarray, seen: np.ndarray, labels: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood a line, with its gradient. A chain's probability follows from its marginals."""
    weights, stay = theta[:-2], theta[-2:]
    good, joint = marginals(seen @ weights[:-1] + weights[-1], stay, first)
    inner = ~first[1:]
    here, following = labels[:-1][inner], labels[1:][inner]
    tiny = 1e-300
    chosen = np.where(labels == 1, good, 1 - good)
    last = np.append(first[1:], True)
    interior = ~first & ~last
    log_p = np.log(joint[np.arange(len(here)), here, following] + tiny).sum() - np.log(chosen[interior] + tiny).sum()
    log_p += np.log(chosen[first & last] + tiny).sum()
    n = len(labels)
    miss = labels - good
    grad = np.concatenate(
        [seen.T @ miss, [miss.sum()], [((here == y) & (following == y)).sum() - joint[:, y, y].sum() for y in (0, 1)]]
    )
    return -log_p / n + PENALTY / 2 * theta @ theta, -grad / n + PENALTY * theta


def fitted(looks: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Model of labelled lines by quasi-Newton steps (BFGS) from zero; ``labels`` hold both 0 and 1."""
    mean, scale = looks.mean(axis=0), looks.std(axis=0)
    scale[scale < 1e-9] = 1.0
    seen = with_neighbours((looks - mean) / scale, first)
    theta = np.zeros(seen.shape[1] + 3)
    inverse = np.eye(len(theta))
    value, grad = _loss(theta, seen, labels, first)
    for _ in range(rounds):
        step = -inverse @ grad
        slope, size = grad @ step, 1.0
        while True:
            new_value, new_grad = _loss(theta + size * step, seen, labels, first)
            if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        move, turn = size * step, new_grad - grad
        theta, value, grad = theta + move, new_value, new_grad
        if np.abs(grad).max() < 1e-6:
            break
        curvature = turn @ move
        if curvature > 1e-12:
            left = np.eye(len(theta)) - np.outer(move, turn) / curvature
            inverse = left @ inverse @ left.T + np.outer(move, move) / curvature
    return Model(mean, scale, theta[:-2], theta[-2:])


def score_lines(model: Model, lines: Lines) -> np.ndarray:
    """Probability of good per line."""
    if model.constant is not None:
        return np.full(len(lines.text), model.constant)
    first = _starts(lines.text)
    return marginals(model.evidence(lines, first), model.stay, first)[0]


# --- tables -----------------------------------------------------------------------------------------


def _sampled(labels: DataFrame, id_col: str, label_col: str, documents: int) -> DataFrame:
    """Ids and labels of at most ``documents`` documents a label, drawn by the hash of the id."""
    value = F.col(label_col)
    usable = labels.filter(F.col(id_col).isNotNull() & value.isin(0, 1))
    clear = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(value).alias("label"), F.max(value).alias("other"))
    clear = clear.filter("label = other").select("id", F.col("label").cast("int").alias("label"))
    parts = [clear.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(documents) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def _looks_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document the vectors of its lines; documents of too many lines are left out."""
    for batch in batches:
        for first, end, data, off in common.pieces(batch.column(2)):
            lines = lines_of(data, off)
            cuts = np.searchsorted(lines.text, np.arange(end - first + 1))
            n = np.diff(cuts)
            fits = np.flatnonzero((n > 0) & (n <= FIT_LINES))
            rows = [lines.looks[cuts[r] : cuts[r + 1]].ravel().astype("f4") for r in fits]
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [part.column(1).take(pa.array(fits, pa.int64())), pa.array(rows, pa.list_(pa.float32()))], ["label", "looks"]
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    documents: int = FIT_DOCUMENTS,
) -> Model:
    """Model of the labelled documents; ``labels`` has their ids and labels (1 good, 0 bad)."""
    chosen = _sampled(labels, id_col, label_col, documents)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    # At most twice ``documents`` rows are broadcast; an id that owns many rows is folded on the map side.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = found.mapInArrow(_looks_task, "label int, looks array<float>").toArrow()
    label = rows.column("label").to_numpy()
    known = set(label.tolist())
    if len(known) < 2:
        empty = np.zeros(0)
        return Model(empty, empty, empty, empty, float(known.pop()) if known else 0.5)
    looks = [np.array(v, "f8").reshape(-1, len(LOOKS)) for v in rows.column("looks").to_pylist()]
    # One order for one sample, however Spark has dealt the rows.
    order = sorted(range(len(looks)), key=lambda k: (label[k], looks[k].tobytes()))
    sizes = np.array([len(looks[k]) for k in order])
    first = np.zeros(sizes.sum(), bool)
    first[np.cumsum(sizes) - sizes] = True
    return fitted(np.concatenate([looks[k] for k in order]), np.repeat(label[order], sizes).astype("i8"), first)


def _without(docs: DataFrame, names: list[str]) -> tuple[list[int], T.StructType]:
    new = {name.lower() for name in names}
    kept = [k for k, name in enumerate(docs.columns) if name.lower() not in new]
    return kept, T.StructType([docs.schema.fields[k] for k in kept])


def _score_task(text_at: int, kept: list[int], names: list[str], model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in common.pieces(batch.column(text_at)):
                lines = lines_of(data, off)
                good = score_lines(model.value, lines)
                total = np.bincount(lines.text, lines.size, end - first)
                score = np.bincount(lines.text, lines.size * good, end - first) / np.maximum(total, 1)
                n_bad = np.bincount(lines.text, good < 0.5, end - first).astype("i8")
                part = batch.slice(first, end - first)
                found = [pa.array(np.clip(score, 0.0, 1.0)), pa.array(np.bincount(lines.text, minlength=end - first)), pa.array(n_bad)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), *found], [*(part.schema.names[k] for k in kept), *names]
                )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``n_lines`` (lines with a word) and ``n_bad_lines``."""
    names = ["score", "n_lines", "n_bad_lines"]
    kept, schema = _without(docs, names)
    schema = schema.add("score", "double").add("n_lines", "long").add("n_bad_lines", "long")
    task = _score_task(docs.columns.index(text_col), kept, names, docs.sparkSession.sparkContext.broadcast(model))
    return docs.mapInArrow(task, schema)


def label_lines(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row per line with a word: the row's other columns, ``line`` (from 0, blank lines counted) and ``good``."""
    names = [text_col, "line", "good"]
    kept, schema = _without(docs, names)
    text_at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in common.pieces(batch.column(text_at)):
                lines = lines_of(data, off)
                at = pa.array(lines.text + first, pa.int64())
                found = [pa.array(lines.number, pa.int64()), pa.array(score_lines(sent.value, lines), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in kept), *found], [*(batch.schema.names[k] for k in kept), *names[1:]]
                )

    return docs.mapInArrow(run, schema.add("line", "long").add("good", "double"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: the CRC of its id leaves remainder 2 by four (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
