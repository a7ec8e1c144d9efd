"""Language identification by compression: the language whose dictionary makes a text smallest.

Every language gets a raw-content zstandard dictionary of labelled text: the openings of at most ``SAMPLE``
documents (``OPENING`` characters each), drawn by hash among the labelled training rows; with many languages
each has an equal share of ``MOST`` documents, and one at least. That bounds what is collected; the draw is
spread over the whole table. A task holds the compressors of ``TOGETHER`` languages at a time, so more languages
cost time and not memory.
Dictionaries and texts are reduced to lower-case letters, each run of anything else being one space. A text is
cut into blocks of ``BLOCK`` bytes, so that the dictionary counts all through a long text; each block is
compressed with every dictionary, and the smallest sum wins. Texts under ``SHORT`` bytes, where a byte decides,
are compressed with a slower search for the shortest form. The score is how much smaller it is than the
next best, as a share; below ``MARGIN`` the answer is marked as rejected.

Defined cases: a null text and one without a letter are ``und`` with score 0; with no labelled row every
text is; with one language it has score 1; ties take the language that comes first in sorted order; repeated
rows are answered alike; columns with a name of the answer are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE, OPENING, MOST = 300, 600, 76_800
TOGETHER = 32
BROADCAST_LANGUAGES = 100_000
BLOCK, SHORT = 4096, 512
MARGIN = 0.01
UNKNOWN = "und"


def dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST
) -> dict[str, bytes]:
    """Raw dictionary content per language, from rows with a text and a language."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counted = keep(rows.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__count")))
    languages = counted.count()
    sample = max(1, min(sample, most // max(languages, 1)))
    sent = F.broadcast(counted) if languages <= BROADCAST_LANGUAGES else counted
    opening = F.substring(text_col, 1, OPENING)
    # Equal texts draw different numbers, so a text with many copies fills no sample.
    draw = F.xxhash64(*[F.col(c) for c in rows.columns])
    # Some four times the sample, by the language's share of rows, so that few rows meet in the ranking task.
    part = F.shiftrightunsigned(draw, 11) / float(1 << 53) * F.col("__count") < 4 * sample
    named = rows.join(sent, F.col(lang_col) == F.col("__lang"))
    drawn = named.filter(part).select(F.col("__lang").alias("lang"), opening.alias("text"), draw.alias("draw"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    chosen = drawn.withColumn("rank", first).filter(F.col("rank") <= sample)
    found: dict[str, dict[str, None]] = {}
    for row in chosen.orderBy("lang", "rank").select("lang", "text").toLocalIterator():
        found.setdefault(row["lang"], {})[row["text"]] = None
    joined = {lang: reduced(" ".join(texts)).encode() for lang, texts in sorted(found.items())}
    return {lang: content for lang, content in joined.items() if content}


_letters = regex.compile(r"[^\p{L}]+")


def reduced(text: str) -> str:
    """Lower-case letters, with one space for anything between them."""
    return _letters.sub(" ", text.lower()).strip()


def _settings(thorough: bool) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        min_match=3 if thorough else 4,
        strategy=zstandard.STRATEGY_BTOPT if thorough else zstandard.STRATEGY_GREEDY,
        window_log=19,
        hash_log=17,
        chain_log=17,
        search_log=4,
        write_content_size=False,
        write_dict_id=False,
    )


class Classifier:
    """Two compressors per language, for long and for short texts, for a few languages at a time."""

    def __init__(self, contents: dict[str, bytes], together: int = TOGETHER):
        names = sorted(contents)
        self.contents, self.runs = contents, [names[i : i + together] for i in range(0, len(names), together)]
        self.now: tuple[list[str], list] = ([], [])

    def _compressors(self, names: list[str]) -> list:
        if self.now[0] != names:
            self.now = ([], [])
            self.now = (names, [[self._made(self.contents[n], s) for s in (False, True)] for n in names])
        return self.now[1]

    @staticmethod
    def _made(content: bytes, thorough: bool) -> Callable[[bytes], bytes]:
        settings = _settings(thorough)
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress

    def answers(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and the score of each text."""
        raws = [reduced(t or "").encode() for t in texts]
        best: list[tuple[float, str]] = [(float("inf"), UNKNOWN)] * len(raws)
        second = [float("inf")] * len(raws)
        for names in self.runs:
            for name, (long, short) in zip(names, self._compressors(names)):
                for i, raw in enumerate(raws):
                    if not raw:
                        continue
                    compress = short if len(raw) < SHORT else long
                    size = sum(len(compress(raw[at : at + BLOCK])) for at in range(0, len(raw), BLOCK))
                    if size < best[i][0]:
                        second[i], best[i] = best[i][0], (size, name)
                    elif size < second[i]:
                        second[i] = size
        return [(name, 1.0 - size / other if size < float("inf") else 0.0) for (size, name), other in zip(best, second)]


def _answer_task(contents, text: str, names: tuple[str, str, str], margin: float, together: int) -> Callable:
    taken = {n.lower() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents.value, together)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for begin, end, _, _ in common.pieces(texts):
                answers = classifier.answers(texts.slice(begin, end - begin).to_pylist())
                part = batch.slice(begin, end - begin)
                columns = {n: c for n, c in zip(part.schema.names, part.columns) if n.lower() not in taken}
                columns[names[0]] = pa.array([a for a, _ in answers], pa.string())
                columns[names[1]] = pa.array([s for _, s in answers], pa.float64())
                columns[names[2]] = pa.array([s < margin for _, s in answers], pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def identify(
    docs: DataFrame,
    contents: dict[str, bytes],
    text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
    margin: float = MARGIN,
    together: int = TOGETHER,
) -> DataFrame:
    """``docs`` plus the language of each text, the score and whether the margin is too narrow."""
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    others = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    schema = T.StructType([*others, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    task = _answer_task(docs.sparkSession.sparkContext.broadcast(contents), text_col, names, margin, together)
    return docs.mapInArrow(task, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: the CRC of its id leaves remainder 1 by three (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    training = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, dictionaries(training)).drop("text")
