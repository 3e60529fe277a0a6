"""Document fingerprints: SimHash of weighted terms, and a search of all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (one word, if a text has no pair), weighted by 1 + ln(count). Each term's hash
votes for or against each of 256 bits. The search cuts fingerprints into radius + 1 blocks: two within the radius agree
in a whole block, so one table for each block, keyed by it, finds all of them; distances are then checked exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.bytetext import byte_view, groups, lower, mix, shingles, word_hashes, words
from gridspark.plans.lineage import cut

BITS = 256
_SALTS = np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
WEIGHTS = 64
"""Weights are whole numbers of 1 / WEIGHTS, so that sums of votes are exact in any order of products."""
RADIUS = 7
"""Bits in which fingerprints of near documents differ at most: eight tables of 32 bits."""


def simhash(terms: np.ndarray) -> bytes:
    """Fingerprint of a text from its term hashes with repeats; a text without terms has all bits zero. Ties of votes give 0."""
    if not len(terms):
        return bytes(BITS // 8)
    distinct, n = np.unique(terms, return_counts=True)
    # at most 1,500 each and 4,096 at a time: below 2**24, so exact
    weight, votes = np.rint(WEIGHTS * (1 + np.log(n))).astype(np.float32), np.zeros(BITS, np.float64)
    for at in range(0, len(distinct), 4096):
        part = distinct[at : at + 4096]
        bits = np.unpackbits(mix(part[:, None] ^ _SALTS).view(np.uint8), axis=1).astype(np.float32)
        own = weight[at : at + 4096]
        votes += 2.0 * (own @ bits) - own.sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def fingerprints_of(texts: list[str]) -> list[bytes]:
    """Fingerprints of whole texts; words are runs of non-space, A-Z in lower case."""
    data, offsets = byte_view(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in groups(offsets):
        part, own = lower(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = words(part, own)
        hashes = word_hashes(part, starts, ends)
        out += [simhash(shingles(hashes[a:b], 2)) for a, b in zip(first[:-1], first[1:])]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of bits that agree."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` as lowercase hex of each whole text (null: empty)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.hex() for x in fingerprints_of(texts)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, fingerprint string")


def within_radius(queries: DataFrame, candidates: DataFrame, radius: int) -> DataFrame:
    """``(query, fingerprint, distance)`` for all fingerprints of ``candidates`` within ``radius`` bits of one of ``queries``.

    Both have a column ``fingerprint`` (hex); equal ones count once, null ones not at all.
    """
    words_of = range(BITS // 64)
    length = BITS // 4

    def blocks(df: DataFrame, name: str) -> DataFrame:
        step = [round(i * length / (radius + 1)) for i in range(radius + 2)]
        tables = F.array(*(F.struct(F.lit(i).alias("table"), F.substring(name, a + 1, b - a).alias("block")) for i, (a, b) in enumerate(zip(step, step[1:]))))
        return df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(tables).alias("t")).select(name, "t.*")

    if not 0 <= radius < length:
        raise ValueError("radius is from 0 to a quarter of the bits")
    value = lambda name, i: F.conv(F.substring(name, 16 * i + 1, 16), 16, -10).cast("long")
    distance = sum((F.bit_count(value("query", i).bitwiseXOR(value("fingerprint", i))) for i in words_of), F.lit(0))
    pairs = blocks(queries, "query").join(blocks(candidates, "fingerprint"), ["table", "block"]).select("query", "fingerprint", distance.alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint of each row's whole text and of its text edited with that of the next document; see op9.

    Rows are in the order of doc_id (null first), then of the text's digest, equal rows in any; after the last comes the
    first, so one row alone follows itself. Null texts are empty ones. Ranges of that order are walked as streams, each
    holding one row back; only the first and the last row of a range meet those of others. Texts are shuffled once.

    ``n_near``, for rows whose doc_id is divisible by 50 (null for others), is the number of other rows whose
    fingerprints are within ``radius`` bits. An empty table gives an empty one; columns but doc_id and text play no part.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    ranges = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "digest").sortWithinPartitions(F.asc_nulls_first("doc_id"), "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None
        for batch in batches:
            for at in range(0, len(batch), 128):
                own = batch.slice(at, 128)
                texts = own.column(1).to_pylist()
                rows = list(zip(own.column(0).to_pylist(), texts, fingerprints_of(texts)))
                if held is None:
                    part = own.column(2)[0].as_py()
                    yield _edge(rows[0], part, "first")
                else:
                    rows.insert(0, held)
                held = rows[-1]
                yield _edits(rows)
        if held is not None:
            yield _edge(held, part, "last")

    made = cut(ranges.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(walk, _RESULT + ", part int, edge string, text string"))
    heads = made.where("edge = 'first'")
    # as many rows as there are ranges, of two whole numbers each
    order = Window.orderBy("part")
    turn = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("after"))
    seams = made.where("edge = 'last'").select("part", "doc_id", "text").join(turn, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("next")), "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                doc, text, after = (batch.column(i)[at].as_py() for i in range(3))
                prints = fingerprints_of([text, after])
                yield _edits([(doc, text, prints[0]), (None, after, prints[1])]).select(_COLUMNS)

    rows = made.where("edge is null").select(*_COLUMNS).unionByName(seams.select("doc_id", "text", "next").mapInArrow(close, _RESULT))
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    number = rows.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    found = within_radius(rows.where(asks), number, radius).join(number, "fingerprint")
    near = found.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("rows") - 1).alias("n_near"))
    asked = rows.where(asks).join(near, "fingerprint").select(*_COLUMNS, "n_near")
    return asked.unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_WALKED = pa.schema([*zip(_COLUMNS, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _edge(row: tuple, part: int, edge: str) -> pa.RecordBatch:
    """The first or last row of a range, with its text."""
    return pa.RecordBatch.from_pylist([{"doc_id": row[0], "part": part, "edge": edge, "text": row[1]}], _WALKED)


def _edits(rows: list[tuple[int | None, str, bytes]]) -> pa.RecordBatch:
    """Result of each row but the last, from ``(doc_id, text, fingerprint)`` of it and the row after."""
    changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    out = []
    for (doc, text, own), (_, _, after), new, made in zip(rows, rows[1:], changed, fingerprints_of(changed)):
        values = (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), made.hex(), likeness(own, made), likeness(own, after))
        out.append(dict(zip(_COLUMNS, values)))
    return pa.RecordBatch.from_pylist(out, _WALKED)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how many documents are near those divisible by 50."""
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
