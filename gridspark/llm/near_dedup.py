"""Near-duplicate detection by DartMinHash signatures in bands, then exact checks.

Each text is a set (or bag) of shingles of five words. Darts with hashed places are thrown on the plane of weight and
rank; those inside a text's element regions are its darts, and the earliest dart of each coordinate is the signature
there. Two texts agree in a coordinate with probability equal to their (weighted) Jaccard similarity.

Equal texts are folded first. Each bucket of a band names as centre the document that meets most others in all its
buckets: in a group of copies that is the text from which the others were made, if it is there. Documents are checked
against centres. Then, in each bucket, documents whose class is still another one than the centre's are held against
all others, exactly, in chunks of bounded size; of what matches in a chunk only the edges of a forest over classes leave
it, so no pairs are listed. Every pair that shares a bucket ends in one class or is compared by its whole shingle sets.
With 28 bands of 4 a pair at similarity 0.8 shares no bucket in 4e-7 of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.bytetext import byte_view, groups, lower, mix, shingles, word_hashes, words
from gridspark.llm.rows import every, text_of
from gridspark.plans.graph import connected_components
from gridspark.plans.lineage import cut

WORDS = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 4
_SMALL = np.array([0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0])
"""Bounds of the rank cells below 1; above, each cell is of width 1."""
CHUNK = 1024
"""Documents of a bucket that are held against as many others in one task at a time."""
ELEMENTS = 1_000_000
"""Shingles of the documents of a chunk, about; one longer text is a chunk of its own."""
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


_WIDTHS = np.append(np.diff(_SMALL), 1.0)
_CDF = [np.cumsum(np.exp(-m) * np.cumprod(np.concatenate(([1.0], m / np.arange(1, 15))))) for m in _WIDTHS]
"""Cumulated Poisson probabilities of 0 to 14 darts, by the width of a cell."""


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the owner, and running number within the owner, for owners with so many things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def dart_signatures(elements: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """For each text and each of k coordinates the hash of the earliest dart in the regions of the text's elements.

    ``elements`` (uint64) holds texts side by side, text i from bounds[i] to bounds[i+1], distinct within a text. An
    element of weight w covers [0, w) on the weight axis; null weights count as 1. The plane is cut into columns of
    width 1 and rank cells; a cell holds a Poisson number of darts, by a hash of element, column and cell, so a
    dart is the same in every text that covers it. Ranks are searched up to a bound that yields about k ln k + 2k
    darts, and further for texts with an empty coordinate. A text without elements gets zeros.
    """
    n = len(bounds) - 1
    signature, found = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    text = np.repeat(np.arange(n), np.diff(bounds))
    owner, column = _spread(np.maximum(np.ceil(weights), 1).astype(np.int64))
    seed = mix(elements[owner] ^ mix(column.astype(np.uint64)))
    limit, home = np.minimum(weights[owner] - column, 1), text[owner]
    total = np.bincount(text, weights, n)
    aim = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    done = np.zeros(n, np.int64)
    until = np.where(aim < 1, np.searchsorted(_SMALL[:-1], aim), len(_SMALL) - 2 + np.ceil(np.minimum(aim, 1e9)).astype(np.int64))
    until[total <= 0] = 0
    while (until > done).any():
        at, step = _spread((until - done)[home])
        cell = step + done[home[at]]
        here, kind = mix(seed[at] + cell.astype(np.uint64)), np.minimum(cell, len(_WIDTHS) - 1)
        u, darts = _uniform(here), np.zeros(len(here), np.int64)
        for i, cdf in enumerate(_CDF):
            if len(own := np.flatnonzero(kind == i)):
                darts[own] = np.searchsorted(cdf, u[own], side="left")
        of, number = _spread(darts)
        dart = mix(here[of] ^ mix(number.astype(np.uint64) + np.uint64(101)))
        if (limit < 1).any():
            inside = _uniform(mix(dart + np.uint64(1))) < limit[at[of]]
            of, dart = of[inside], dart[inside]
        low = np.where(kind < len(_WIDTHS) - 1, _SMALL[kind], cell - (len(_SMALL) - 2))[of]
        rank = low + _WIDTHS[kind[of]] * _uniform(mix(dart + np.uint64(2)))
        place = home[at[of]] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        fresh = ~found[place]  # later cells hold later darts
        place, dart, rank = place[fresh], dart[fresh], rank[fresh]
        order = np.argsort(-rank, kind="stable")
        signature[place[order]] = dart[order]
        found[place] = True
        done, short = until, (~found.reshape(n, k).all(1)) & (total > 0)
        until = np.where(short, done + 1 + done // 2, done)
    return signature.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band, from signatures of bands * rows coordinates."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def shingle_groups(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Hashes of the shingles of each text of a column, with repeats, some texts at a time. Words are runs of non-space, A-Z in lower case."""
    data, offsets = byte_view(column)
    for lo, hi in groups(offsets, 1 << 18):
        part, own = lower(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = words(part, own)
        hashes = word_hashes(part, starts, ends)
        yield [shingles(hashes[a:b], k) for a, b in zip(first[:-1], first[1:])]


def signatures(docs: DataFrame, k: int = WORDS, bands: int = BANDS, rows: int = ROWS, bag: bool = False) -> DataFrame:
    """``(doc_id, text_key, keys)``: md5 of the text and the band keys. Texts without a word have no keys. ``bag`` weighs shingles by their number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for group in shingle_groups(batch.column(2), k):
                for at in range(0, len(group), 64):
                    sets = [np.unique(x, return_counts=True) for x in group[at : at + 64]]
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x, _ in sets])))
                    elements, counts = (np.concatenate(x) for x in zip(*sets))
                    own = band_keys(dart_signatures(elements, bounds, counts if bag else None, bands * rows), bands, rows)
                    full = np.diff(bounds) > 0
                    keys.append(own[full].ravel())
                    sizes.append(full * bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "text_key", "keys"])

    return docs.select("doc_id", F.md5("text").alias("text_key"), "text").mapInArrow(apply, "doc_id long, text_key string, keys array<long>")


def jaccard(a: np.ndarray, b: np.ndarray, bag: bool = False) -> float:
    """Similarity of two lists of shingle hashes as sets, or as bags."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not bag:
        return len(i) / max(1, len(x) + len(y) - len(i))
    both = np.minimum(n[i], m[j]).sum()
    return both / max(1, n.sum() + m.sum() - both)


def similar_pairs(docs: DataFrame, pairs: DataFrame, k: int = WORDS, least: float = SIMILARITY, bag: bool = False) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts are as similar as ``least``, compared exactly."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, len(batch), 64):  # two texts a row: few rows at a time
                left, right = ([x for g in shingle_groups(batch.column(c).slice(at, 64), k) for x in g] for c in (2, 3))
                keep += [jaccard(a, b, bag) >= least for a, b in zip(left, right)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("doc_id", "text")
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(apply, "u long, v long")


def _labels(edges: DataFrame) -> DataFrame:
    return cut(connected_components(edges))


def _label(rows: DataFrame, name: str, labels: DataFrame, out: str) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))


def shingle_sets(docs: DataFrame, k: int = WORDS, bag: bool = False) -> DataFrame:
    """``(doc_id, n, elements)``: the distinct shingle hashes of each text, side by side. Of a bag the i-th of equal shingles is an element of its own, so bags compare as sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for group in shingle_groups(batch.column(1), k):
                for x in group:
                    own, n = np.unique(x, return_counts=True)
                    if bag:
                        of, number = _spread(n)
                        own = np.unique(mix(own[of] ^ mix(number.astype(np.uint64))))
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "n", "elements"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n long, elements binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one list shares with each of the other.

    Elements that many sets hold are counted by products of 0-1 matrices, some columns at a time; for the others the
    few pairs of sets that hold them are counted one by one.
    """
    rows, columns = len(left), len(right)
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(common):
        return np.zeros((rows, columns), np.int64)
    held, who = [], []
    for values, owner in zip(flat, owners):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        fits = common[at] == values
        order = np.argsort(at[fits], kind="stable")
        held.append(at[fits][order])
        who.append(owner[fits][order])
    n = [np.bincount(x, minlength=len(common)) for x in held]
    first = [np.cumsum(x) - x for x in n]
    dense = n[0] * n[1] > 256
    shared = np.zeros((rows, columns), np.float32)
    frequent = np.flatnonzero(dense)
    for lo in range(0, len(frequent), 2048):
        part = frequent[lo : lo + 2048]
        sides = []
        for side, height in enumerate((rows, columns)):
            of, number = _spread(n[side][part])
            grid = np.zeros((height, len(part)), np.float32)
            grid[who[side][first[side][part][of] + number], of] = 1
            sides.append(grid)
        shared += sides[0] @ sides[1].T
    shared = shared.astype(np.int64)
    rare = np.flatnonzero(~dense)
    for part in np.array_split(rare, max(1, len(rare) // 8192)):
        of, number = _spread(n[0][part] * n[1][part])
        i = who[0][first[0][part][of] + number // n[1][part][of]]
        j = who[1][first[1][part][of] + number % n[1][part][of]]
        shared += np.bincount(i * columns + j, minlength=rows * columns).reshape(rows, columns)
    return shared


def forest(cls: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges between classes that join what ``near`` joins, at most one for each class: ``left`` and ``right`` index ``cls``, near is left by right."""
    now, edges = cls.copy(), []
    for i, row in zip(left, near):
        others = np.unique(now[right[row]])
        others = others[others != now[i]]
        for other in others:
            edges.append((max(int(other), int(now[i])), min(int(other), int(now[i]))))
        if len(others):
            now[np.isin(now, others)] = now[i]
    return edges


def _apart(members: DataFrame, docs: DataFrame, labels: DataFrame, k: int, least: float, bag: bool) -> DataFrame:
    """Edges ``(u, v)`` between classes of documents in one bucket that are as similar as ``least``.

    In each bucket the documents outside the centre's class are held against all others but the centre. Both sides are
    dealt into chunks of bounded numbers of documents and shingles, and each pair of chunks is a group, so no bucket
    meets in one task. A group gives fewer edges than it has classes.
    """
    classed = cut(_label(_label(members, "doc_id", labels, "cls"), "centre", labels, "centre_cls").withColumn("apart", F.col("cls") != F.col("centre_cls")))
    open_keys = classed.where("apart").select("key").distinct()
    rows = cut(classed.where("doc_id != centre").join(open_keys, "key", "left_semi").select("key", "doc_id", "cls", "apart"))
    sets = cut(shingle_sets(docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), k, bag))
    chunks = lambda number, size: F.ceil(F.greatest(number / CHUNK, size / ELEMENTS))
    counted = rows.join(sets.select("doc_id", "n"), "doc_id")
    per_bucket = counted.groupBy("key").agg(
        chunks(F.count_if("apart"), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0))).alias("n_apart"), chunks(F.count("*"), F.sum("n")).alias("n_all")
    )
    rows = rows.join(per_bucket, "key")
    spot = F.xxhash64("doc_id")
    left = rows.where("apart").withColumn("a", F.pmod(spot, F.col("n_apart"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)))
    right = rows.withColumn("b", F.pmod(spot, F.col("n_all"))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_apart") - 1)))
    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False))).select("key", "a", "b", "asks", "doc_id", "cls")

    def compare(table: pa.Table) -> pa.Table:
        asks, cls = np.asarray(table["asks"].to_pylist(), bool), table["cls"].to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
            size = np.array([len(x) for x in sets])
            shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
            near = shared / np.maximum(1, size[left][:, None] + size[right] - shared) >= least
            edges = forest(cls, left, right, near)
        u, v = zip(*edges) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return both.join(sets.select("doc_id", "elements"), "doc_id").select("key", "a", "b", "asks", "cls", "elements").groupBy("key", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def near_classes(docs: DataFrame, k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, bag: bool = False) -> DataFrame:
    """``(doc_id, class_id, class_size)`` for each row of ``docs(doc_id, text)``: classes linked by similarity ``least`` or equal text.

    The class id is the smallest doc_id in it. Null texts are equal to each other only if they are null: they and texts
    without a word form classes by equal text alone. Repeated doc_ids are one document if their texts are equal, and
    otherwise link the classes of their texts. Rows with null doc_id are left out.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.md5("text").alias("text_key"))
    # one row for each text, with its smallest id; summed up within each task before the shuffle
    texts = cut(signatures(docs, k, bands, rows, bag).groupBy("text_key").agg(F.min(F.struct("doc_id", "keys")).alias("first")))
    members = texts.where("size(first.keys) > 0").select(F.col("first.doc_id").alias("doc_id"), F.explode("first.keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(buckets, "key"))
    met = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    centres = members.join(met, "doc_id").groupBy("key").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("low"))).alias("c")).select("key", (-F.col("c.low")).alias("centre"))
    members = cut(members.join(centres, "key").select("doc_id", "key", "centre"))
    votes = cut(members.where("doc_id != centre").groupBy("doc_id", "centre").agg(F.count("*").alias("n")))
    # only texts that share a bucket with another are read again, and shuffled whole but once
    wanted = votes.select("doc_id").unionByName(votes.select(F.col("centre").alias("doc_id"))).distinct().join(texts.select(F.col("first.doc_id").alias("doc_id"), "text_key"), "doc_id")
    wanted = wanted.withColumnRenamed("text_key", "wanted_key")
    docs = cut(docs.join(wanted, "doc_id").where(F.md5("text") == F.col("wanted_key")).groupBy("doc_id").agg(F.first("text").alias("text")))
    # first the centre with which a document shares most buckets, then its other centres where the class still differs
    nearest = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), F.col("centre"))).alias("best")).select(F.col("doc_id").alias("u"), F.col("best.centre").alias("v"))
    found = cut(similar_pairs(docs, nearest, k, least, bag).distinct())
    labels = _labels(found)
    open_votes = _label(_label(votes.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")), "u", labels, "cu"), "v", labels, "cv")
    rest = open_votes.where("cu != cv").select("u", "v").join(nearest, ["u", "v"], "left_anti")
    found = cut(found.unionByName(similar_pairs(docs, rest, k, least, bag).distinct()))
    labels = _labels(found)
    # last, the pairs of a bucket that neither share a class nor have been compared
    found = found.unionByName(_apart(members, docs, labels, k, least, bag))
    # a doc_id with several texts links them
    ids = keyed.distinct().join(texts.select("text_key", F.col("first.doc_id").alias("leader")), "text_key").select("doc_id", "leader")
    ids = cut(ids)
    found = found.unionByName(ids.where("doc_id != leader").groupBy("doc_id").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo != hi").select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    labels = _labels(found)
    classes = _label(ids.groupBy("doc_id").agg(F.min("leader").alias("leader")), "leader", labels, "class_id").select("doc_id", "class_id")
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return classes.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate class the document with the smallest id stays, once; rows without an id stay.

    Null and empty texts are one class. Of repeated rows of one id the one whose columns, written as JSON, come first
    stays. All columns pass unchanged, whatever their names and types. An empty table gives an empty one.
    """
    kept = near_classes(docs).where("doc_id = class_id").select("doc_id")
    known = docs.join(kept, "doc_id", "left_semi").select(*every(docs))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    once = known.join(repeated, "doc_id", "left_anti").select(*every(docs))
    many = known.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*every(docs)), text_of(every(docs))).alias("row")).select("row.*")
    return once.unionByName(many).unionByName(docs.where("doc_id is null"))
