"""Approximate nearest neighbours by shifted space-filling curves.

Each curve orders all vectors by the Hilbert index of a shifted projection to a few dimensions. An order is cut into
blocks of about WINDOW vectors by bounds from a sample; a query looks at its own block and the two next to it on each
curve, and the exact inner products decide. Blocks are groups of a shuffle, so curves and blocks run side by side.
Equal vectors are folded first: of each only as many smallest ids are kept as a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

CURVES = 28
DIMENSIONS = 8
BITS = 2
WINDOW = 1024
"""Least vectors in a block; a query sees three blocks of each curve."""
MAX_BLOCKS = 50
"""Blocks of a curve. With more vectors blocks grow, so a query sees the same share of any table: recall falls with that share, not with a block's size."""
SAMPLE = 65_536
"""Most vectors from which bounds of blocks are taken; every vector is indexed."""
NEAREST = 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits; dimensions times bits is at most 63.

    Works on the transposed bit planes: undo the reflections and exchanges from the top plane down, then Gray-decode.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for plane in range(bits - 1, 0, -1):
        bit, lower = 1 << plane, (1 << plane) - 1
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(flip, x[0] ^ lower, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> plane) & 1 == 1, turn ^ ((1 << plane) - 1), turn)
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ turn) >> plane) & 1)
    return out


class Curves:
    """Seeded projections and shifts. Keys carry low bits of one more projection, so cells with many vectors are ordered too."""

    def __init__(self, width: int, curves: int = CURVES, seed: int = 7):
        rng = np.random.default_rng([seed, width])
        self.width, self.n = width, curves
        self.maps = [np.linalg.qr(rng.normal(size=(max(width, DIMENSIONS), DIMENSIONS)))[0][:width] for _ in range(curves)]
        self.shift = rng.uniform(-0.5, 0.5, size=(curves, DIMENSIONS)) / (1 << BITS)
        self.tie = rng.normal(size=(curves, width)) / np.sqrt(width)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Place of each vector (row) on each curve (column)."""
        size = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        unit = vectors / size
        reach = 2.5 / np.sqrt(self.width)
        out = np.empty((len(vectors), self.n), np.int64)
        for c in range(self.n):
            at = (unit @ self.maps[c] / reach + 1) / 2 + self.shift[c]
            cells = np.clip(np.floor(at * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
            low = np.clip((np.tanh(unit @ self.tie[c] * 2) + 1) * 2**19, 0, 2**20 - 1).astype(np.int64)
            out[:, c] = (hilbert_index(cells, BITS) << 20) | low
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can take part: not null, not empty, no null or non-finite component, not all zero."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries(vec_id)`` the k largest inner products found among ``vectors(vec_id, embedding)``.

    The query's own id is no candidate; ties go to the smaller id. Unusable vectors take no part, ids that repeat with
    the same vector count once, vectors are compared only with those of the same length. Fewer than k candidates: all.
    Different vectors under one id share their results. Other columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("key", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    # k + 1 smallest ids of each distinct vector: the query itself may be one of them
    first = Window.partitionBy("key").orderBy("vec_id")
    salted = Window.partitionBy("key", "salt").orderBy("vec_id")
    rows = cut(rows.dropDuplicates(["vec_id", "key"]))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    distinct = cut(few.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = queries.select("vec_id").distinct().join(rows.select("vec_id", "key"), "vec_id")
    asking = asked.select("key").distinct().withColumn("asks", F.lit(True))
    size = distinct.count()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / size)
    sample = distinct.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).toPandas()["v"]
    blocks = int(min(MAX_BLOCKS, max(1, size // window)))
    bounds = {}
    for width in sorted({len(x) for x in sample}):
        own = np.sort(Curves(width, curves).keys(np.array([x for x in sample if len(x) == width])), axis=0)
        at = np.arange(1, blocks) * len(own) // blocks
        bounds[width] = own[at]  # (blocks - 1, curves)
    shared = spark.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("asks", pa.bool_()), ("width", pa.int32()), ("v", pa.binary()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                lists, ids, asks = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                for width in sorted({len(x) for x in lists}):
                    which = [i for i, x in enumerate(lists) if len(x) == width]
                    values = np.array([lists[i] for i in which])
                    made = Curves(width, curves)
                    keys, edges = made.keys(values), shared.value.get(width, np.zeros((0, curves), np.int64))
                    packed = [x.tobytes() for x in values]
                    for c in range(curves):
                        own = np.searchsorted(edges[:, c], keys[:, c], side="left")
                        cell = [(int(o) * curves + c) * 65_536 + width for o in own]
                        yield pa.RecordBatch.from_pydict({"cell": cell, "asks": [False] * len(own), "width": [width] * len(own), "v": packed, "ids": [ids[i] for i in which]}, schema)
                        q = [j for j, i in enumerate(which) if asks[i]]
                        for step in (-1, 0, 1):
                            far = [j for j in q if 0 <= own[j] + step <= len(edges)]
                            if far:
                                cell = [(int(own[j] + step) * curves + c) * 65_536 + width for j in far]
                                yield pa.RecordBatch.from_pydict({"cell": cell, "asks": [True] * len(far), "width": [width] * len(far), "v": [packed[j] for j in far], "ids": [ids[which[j]][:1] for j in far]}, schema)

    def rank_block(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        values = np.frombuffer(b"".join(table["v"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        ids = table["ids"].to_pylist()
        at, data = np.flatnonzero(asks), np.flatnonzero(~asks)
        size = np.linalg.norm(values, axis=1)
        out_q, out_id, out_s = [], [], []
        for lo in range(0, len(at), 256):
            for q in at[lo : lo + 256] if len(data) else ():
                score = values[data] @ values[q]
                take = min(k + 1, len(score))
                least = np.partition(score, len(score) - take)[len(score) - take]
                # sums of products differ by their order: what is within rounding of the last place is ranked exactly
                near = data[score >= least - 1e-12 * (1 + size[q] * size[data].max())]
                near = sorted(((-float(values[j] @ values[q]), i) for j in near for i in ids[j]))[: k + 1]
                out_q += [ids[q][0]] * len(near)
                out_id += [i for _, i in near]
                out_s += [-s for s, _ in near]
        return pa.table({"leader": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    tagged = distinct.join(asking, "key", "left").select("v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    found = tagged.mapInArrow(place, "cell long, asks boolean, width int, v binary, ids array<long>").groupBy("cell").applyInArrow(rank_block, "leader long, vec_id long, score double")
    # each curve's finds of a vector are few; the same find of several curves counts once
    best = found.groupBy("leader", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("leader").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("leader").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    leaders = distinct.select("key", F.col("ids")[0].alias("leader"))
    answers = asked.join(leaders.join(best, "leader"), "key")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), "near").select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op8_hilbert_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
