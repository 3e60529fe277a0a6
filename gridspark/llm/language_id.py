"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed by Spark over all labelled rows; the matrix of log probabilities has a fixed number of
columns (``buckets``) and one row for each of at most ``MAX_LANGUAGES`` labels, so what is broadcast is bounded.
Scoring adds up matrix columns for the n-grams of a batch of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridspark.llm.bytetext import byte_view, groups, mix
from gridspark.llm.rows import every, quoted

BUCKETS = 1 << 16
"""Hashed n-grams: width of the matrix."""
ORDERS = (1, 2, 3, 4)
"""Lengths of n-grams, in characters."""
SLICE = 1 << 12
"""Counts travel as arrays of so many buckets."""
MAX_LANGUAGES = 512
"""More labels than this are refused, since the matrix is broadcast."""
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C55)


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in lower case, side by side, and the n+1 offsets of the texts."""
    low = [(t or "").lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in low])))


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that ends at each character; BUCKETS where it leaves its text or has no letter.

    ASCII digits, punctuation and space count as one blank, so numbers and markup say nothing about the language.
    """
    letter = _alphabet()[data]
    code = np.where(letter | (data >= 128), data, 32).astype(np.uint64)
    place = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
    rolled, solid = code.copy(), letter.copy()
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            with np.errstate(over="ignore"):
                rolled = rolled * _BASE
                rolled[n - 1 :] += code[: 1 - n]
            solid[n - 1 :] |= letter[: 1 - n]
        if n in ORDERS:
            bucket = (mix(rolled + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
            yield np.where(solid & (place >= n - 1), bucket, BUCKETS)


def train(labelled: DataFrame, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix of log probabilities (languages x buckets, a prior in front) from ``labelled(text, lang)``.

    Rows with null text or lang teach nothing. All rows count: each task sums its own and passes on one array for
    each language and slice of buckets. More than MAX_LANGUAGES labels are an error, since the matrix would outgrow a broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), object)
            _, offsets = byte_view(batch.column(0))
            for lo, hi in groups(offsets):
                codes = pd.factorize(langs[lo:hi])
                data, own = _characters(batch.column(0).slice(lo, hi - lo).to_pylist())
                row = np.repeat(codes[0], np.diff(own))
                for name, n in zip(codes[1], np.bincount(codes[0])):
                    seen[name] = seen.get(name, 0) + int(n)
                for bucket in _grams(data, own):
                    got = np.bincount(row * (BUCKETS + 1) + bucket, minlength=len(codes[1]) * (BUCKETS + 1)).reshape(-1, BUCKETS + 1)[:, :BUCKETS]
                    for name, counts in zip(codes[1], got):
                        sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * (BUCKETS // SLICE),
                    "slice": list(range(BUCKETS // SLICE)),
                    "docs": [seen[name]] + [0] * (BUCKETS // SLICE - 1),
                    "counts": list(counts.astype(np.int64).reshape(-1, SLICE)),
                },
                pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64()))]),
            )

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        docs: dict[tuple[str, int], int] = {}
        for pdf in batches:
            for name, at, n, counts in pdf.itertuples(index=False):
                key = (name, at)
                docs[key] = docs.get(key, 0) + n
                sums[key] = sums[key] + counts if key in sums else np.array(counts)
        yield pd.DataFrame([(*k, docs[k], v) for k, v in sums.items()], columns=["lang", "slice", "docs", "counts"])

    schema = "lang string, slice int, docs long, counts array<long>"
    parts = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, schema)
    rows = parts.repartition("lang", "slice").mapInPandas(total, schema).limit(MAX_LANGUAGES * (BUCKETS // SLICE) + 1).toPandas()
    names = sorted(rows["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts, docs = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    for name, at, n, part in rows.itertuples(index=False):
        k = names.index(name)
        docs[k] += n
        counts[k, at * SLICE : (at + 1) * SLICE] = part
    model = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * BUCKETS)
    return names, np.hstack((np.log((docs + 1) / (docs.sum() + len(docs)))[:, None], model)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language.

    Null text, text without a letter, and any text when no language was learned: ``und`` with score 0. Ties go to the
    first language by name. Columns of ``docs`` called lang_pred or score are replaced; others pass unread, whatever
    their names and types. An empty table gives an empty one.
    """
    # the last row of zeros is for n-grams that do not count
    table = np.vstack((model.T, np.zeros((1, len(names)), np.float32))) if names else None
    shared = docs.sparkSession.sparkContext.broadcast(table)
    carried = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at = next(i for i, c in enumerate(carried) if c.lower() == "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            _, offsets = byte_view(batch.column(at))
            best, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for lo, hi in groups(offsets, 1 << 20) if names else ():
                data, own = _characters(batch.column(at).slice(lo, hi - lo).to_pylist())
                full = np.flatnonzero(np.diff(own))
                if not len(full):
                    continue
                logs = np.tile(weights[0].astype(np.float64), (hi - lo, 1))
                for bucket in _grams(data, own):
                    for k in range(0, len(names), 16):  # some languages at a time
                        logs[full, k : k + 16] += np.add.reduceat(weights[1:, k : k + 16][bucket], own[:-1][full], axis=0, dtype=np.float64)
                top = logs.argmax(1)
                posterior = 1 / np.exp(np.minimum(logs - logs.max(1, keepdims=True), 0)).sum(1)
                letters = np.add.reduceat(_alphabet()[data], own[:-1][full], dtype=np.int64)
                for i in full[letters > 0]:
                    best[lo + i], score[lo + i] = names[top[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    rows = docs.select(*(F.col(quoted(c)) for c in carried))
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(apply, schema)


def is_training(doc_id: str = "doc_id") -> F.Column:
    """Rows that the model may learn from: crc32 of the id as text leaves another remainder than 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training rows of ``docs`` and predict all of them."""
    return predict(docs, *train(docs.where(is_training())))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = train(docs.where(is_training()))
    return predict(docs.select("doc_id", "text"), names, model).select("doc_id", (~is_training()).alias("held_out"), "lang_pred", "score")


def keep_known(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is found with a posterior of ``least`` or more stay.

    Null and empty texts, and texts without a letter, go. Rows keep all columns unchanged, whatever their names and
    types, also ones called like the columns of ``predict``. Repeated rows are judged each by itself.
    """
    names, model = train(docs.where(is_training()))
    rows = docs.select("text", F.struct(*every(docs)).alias("row"))
    return predict(rows, names, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
