"""Token counts: an exact histogram of encoded lengths, and suffix sums over it for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

VOCABULARY = "byte_bpe_50k.tiktoken"
STEP = 512
"""Lengths are summed in spans of this many, then over spans, so that no window holds more than a span or a list of spans."""

_ENCODERS: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, group: str = "source") -> DataFrame:
    """``(grp, length)``: the number of tokens of each whole text (null: 0), with the value of the column ``group``."""
    import public_tokenizers

    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64))], names=["grp", "length"])

    return docs.select(F.col(group).cast("string").alias("grp"), F.col("text").alias("text")).mapInArrow(count, "grp string, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``(grp, is_total, length, n_docs)`` for each group, null being one, and for all rows together (grp null, is_total); counts are summed before the shuffle."""
    own = lengths.groupBy("grp", "length").agg(F.count("*").alias("n_docs"))
    sides = F.explode(F.array(F.struct("grp", F.lit(False).alias("is_total")), F.struct(F.lit(None).cast("string").alias("grp"), F.lit(True).alias("is_total"))))
    return own.select(sides.alias("g"), "length", "n_docs").groupBy("g.grp", "g.is_total", "length").agg(F.sum("n_docs").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """What every context limit costs, from ``hist(grp, is_total, length, n_docs)``: one row for each group and each length that occurs.

    Taken as a limit L, a row says how many documents fit (``docs_within``), how many are longer (``docs_over``), the
    tokens of the longer ones (``tokens_over``), what is left of all documents cut at L (``truncated_tokens``), and the
    share of documents that fit (``quantile``: the smallest L whose share reaches q is the exact q-quantile).
    Suffix sums run within spans of STEP lengths and then over the spans' totals. Whatever the groups are called, the
    whole table is told by ``is_total`` alone. The histogram is written first, since two steps read it.
    """
    name = F.when(F.col("is_total"), "*").otherwise(F.coalesce(F.concat(F.lit("="), "grp"), F.lit("-")))
    cell = cut(hist.select(name.alias("name"), "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / STEP).alias("span")))
    spans = cell.groupBy("name", "span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    later = Window.partitionBy("name").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("name")
    spans = spans.select(
        "name",
        "span",
        F.coalesce(F.sum("span_docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("span_tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("span_docs").over(every).alias("total_docs"),
        F.sum("span_tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("name", "span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = cell.join(spans, ["name", "span"]).select(
        "*",
        (F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_later")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens_later")).alias("tokens_over"),
    )
    return over.select(
        F.when(F.startswith("name", F.lit("=")), F.substring("name", 2, 1 << 30)).alias("grp"),
        (F.col("name") == "*").alias("is_total"),
        "length",
        "n_docs",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_within"),
        "docs_over",
        "tokens_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def op5_token_lengths(spark, sf_dir: str) -> DataFrame:
    """Every context limit of ``documents``, by source and for the whole table. An empty table gives no row."""
    return limits(histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
