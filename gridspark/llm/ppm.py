"""Language-model scoring by prediction by partial matching over bytes.

The text of a document is its lower-cased words, each ended by a blank, and one end mark. A trie of byte contexts up
to ORDER bytes holds how often each byte followed. A byte unseen in a context escapes to the next shorter one with
probability q / 2T (method D: q distinct bytes seen, T times; a seen byte has (n - 1/2) / T), and there all bytes already seen in the longer
context are excluded; below order 0 the bytes left are equally likely. A document's code length is the sum over its bytes.

Since bytes seen in a context are also seen in every suffix of it, exclusion at a level depends on the level above only,
so the trie is made level by level with sums and joins: a row of level j has at most 256 rows above it, and no join has
a hot key. Texts are dealt into blocks of bounded size, long ones in pieces cut between words; a block asks once for each
of its distinct byte strings and words, and the answers go back to it, packed, so no task and no broadcast holds the trie.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.bytetext import byte_view, groups, is_space, lower, word_hashes
from gridspark.plans.lineage import cut, forget

ORDER = 6
"""Bytes of context."""
BLOCK_BYTES = 32 << 20
"""Text in a block, about."""
PIECE_BYTES = 1 << 19
"""Text that a task takes at a time; longer texts are cut into pieces of about this size, between words."""
BUCKET_BYTES = 4 << 20
"""Text for which there is one bucket of keys: at most so many keys of all blocks together meet in a task, about."""
WAVES = 3
"""Parts in which keys are answered and texts scored: the shuffle files of one go before the next, so disk holds a third of them."""
MERGE = 1_250_000
"""Keys that a task gathers before it adds up equal ones and closes a run of them."""
HOLD = 3 * MERGE
"""Keys in closed runs that a task holds before it puts the runs together."""
RANGES = 32
"""Ranges of buckets, put together one at a time."""
SMALL = {"compression": "zstd", "parquet.writer.version": "v2"}
"""Files between steps: sorted keys as differences."""
BUNDLES = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
"""Files of large packed rows: compressed already, and a page must not wait for a hundred of them."""
BATCH_BYTES = 8 << 20
"""Texts that Spark hands to a Python worker at once."""
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_END = np.uint8(10)
_WORD = np.uint64(1) << np.uint64(63)
_GAP = re.compile(rb"[\x20\x09-\x0D]+")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that the model must not learn from: crc32 of the id as text leaves 2 by 7. A null id counts as training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pieces(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, held_out, lead, last, text)`` of ``docs(row, doc_id, held_out, text)``: whole texts, and long ones cut before words.

    ``lead`` holds the ORDER symbols before a piece (end marks before the first), ``last`` marks the piece that ends the text.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                text, lead, start = batch.column(3)[at].as_py().encode(), bytes([_END]) * ORDER, 0
                head = [batch.column(i).slice(at, 1) for i in range(3)]
                while start is not None:
                    gap = _GAP.search(text, start + PIECE_BYTES)
                    end = gap.end() if gap and gap.end() < len(text) else None
                    part = text[start:end]
                    found = part.split() if end else [b""]
                    if found:
                        yield pa.RecordBatch.from_arrays([*head, pa.array([lead], pa.binary()), pa.array([end is None]), pa.array([part.decode()])], names=names)
                    if end and found:
                        lead = (lead + b" ".join(found[-ORDER:]).lower() + b" ")[-ORDER:]
                    start = end

    names = ["row", "doc_id", "held_out", "lead", "last", "text"]
    long = F.octet_length("text") > PIECE_BYTES
    whole = docs.where(~long).select("row", "doc_id", "held_out", F.lit(bytes([_END]) * ORDER).alias("lead"), F.lit(True).alias("last"), "text")
    return whole.unionByName(docs.where(long).select("row", "doc_id", "held_out", "text").mapInArrow(apply, "row long, doc_id long, held_out boolean, lead binary, last boolean, text string"))


def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, data)``: about PIECE_BYTES of rows of a block to a row, compressed, so texts take little of a shuffle."""
    for batch in batches:
        order = np.argsort(batch["block"].to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        size = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
        block = batch["block"].to_numpy()
        for a, b in _edges(block):
            for lo, hi in groups(np.concatenate(([0], np.cumsum(size[a:b], dtype=np.int64))), PIECE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(a + lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])
        batch = None
        _give_back()


def _rows(bundles: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The rows of bundles, one bundle at a time."""
    for data in bundles:
        yield from pa.ipc.open_stream(pa.py_buffer(data.as_py()))


def _symbols(data: np.ndarray, offsets: np.ndarray, leads: list[bytes], last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams that end at each symbol of each piece, bounds of pieces in them, word hashes and bounds of pieces in those."""
    n, length = len(leads), np.diff(offsets)
    starts = np.concatenate(([0], np.cumsum(length + ORDER + 2)))
    raw = np.full(starts[-1], 32, np.uint8)
    before = np.zeros(len(raw), bool)
    for i, lead in enumerate(leads):  # a piece is: what stands before it, its text, a blank and the end mark
        at = starts[i]
        raw[at : at + ORDER] = np.frombuffer(lead, np.uint8)
        before[at : at + ORDER] = True
        raw[at + ORDER : at + ORDER + length[i]] = data[offsets[i] : offsets[i + 1]]
    text, space = lower(raw), is_space(raw)
    solid = ~(space | before)
    after = np.concatenate(([False], solid[:-1]))
    text[space & ~before] = 32
    text[starts[1:] - 1] = _END
    keep = solid | after | before  # of a run of space the first byte stays
    keep[starts[1:] - 1] = last
    first_byte, end_byte = np.flatnonzero(solid & ~after), np.flatnonzero(after & ~solid)
    hashes = word_hashes(np.where(solid, text, np.uint8(32)), first_byte, end_byte) | _WORD
    first = np.searchsorted(first_byte, starts)
    size = np.add.reduceat(keep, starts[:-1], dtype=np.int64) - ORDER if n else np.zeros(0, np.int64)
    one = text[keep].astype(np.uint64)
    two = one.copy()
    two[1:] |= one[:-1] << np.uint64(8)
    four = two.copy()
    four[2:] |= two[:-2] << np.uint64(16)
    grams = four.copy()
    grams[4:] |= (four[:-4] & np.uint64((1 << 8 * (ORDER - 3)) - 1)) << np.uint64(32)
    return grams[~before[keep]], np.concatenate(([0], np.cumsum(size))), hashes, first


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    """Ranges of rows of about PIECE_BYTES, with what ``_symbols`` says of them."""
    data, offsets = byte_view(batch["text"])
    leads, last = batch["lead"].to_pylist(), np.asarray(batch["last"].to_pylist(), bool)
    for lo, hi in groups(offsets, PIECE_BYTES):
        yield lo, hi, _symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], leads[lo:hi], last[lo:hi])


def _give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on after its task and would keep it from the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    values = np.sort(values)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[start], np.diff(np.append(start, len(values)))


def _coded(values: np.ndarray) -> bytes:
    """Values as places in the list of distinct ones, since most answers are one of few."""
    distinct, code = np.unique(values, return_inverse=True)
    body = distinct.tobytes() + code.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32).tobytes()
    return np.int64(len(distinct)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _decoded(data: bytes, n: int) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    body = pa.decompress(data[8:], 8 * size + n * np.dtype(kind).itemsize, codec="zstd")
    return np.frombuffer(body, np.float64, size)[np.frombuffer(body, kind, n, 8 * size)]


def _edges(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:])) if len(values) else []


def asker(buckets: int):
    """For ``mapInArrow``: distinct grams and words of each block, and how often they stand in training rows, as rows ``(bucket, block, n, keys, counts)``.

    A bucket holds the keys with one remainder by ``buckets``. Keys go packed, many to a row. A file has one block, whose keys leave before those of the next file come.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, of = _Asked(buckets), None
        for bundles in batches:
            for block, data in zip(bundles["block"].to_pylist(), bundles["data"]):
                if block != of:
                    yield from asked.rows(of)
                    asked, of = _Asked(buckets), block
                for part in _rows([data]):
                    trains = ~np.asarray(part["held_out"].to_pylist(), bool)
                    for lo, hi, (grams, bounds, hashes, first) in _texts(part):
                        for keys, own in ((grams, bounds), (hashes, first)):
                            learn = np.repeat(trains[lo:hi], np.diff(own))
                            for some, taught in ((keys[learn], 1), (keys[~learn], 0)):
                                seen, n = _distinct(some)
                                asked.add(seen, n * taught)
        yield from asked.rows(of)
        _give_back()

    return apply


class _Asked:
    """Keys of a block with their counts, in RANGES ranges of buckets: each has runs, which are put together once all hold half as much again as after the last time."""

    def __init__(self, buckets: int):
        self.buckets, self.ranges = buckets, [buckets * i // RANGES for i in range(RANGES + 1)]
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(RANGES)]
        self.held, self.most = 0, HOLD

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(n)
        if sum(map(len, self.keys)) > MERGE:
            self._close()

    def _close(self) -> None:
        keys, n, bucket = self._sorted(self.keys, self.counts)
        self.keys, self.counts = [], []
        at = np.searchsorted(bucket, self.ranges)
        for runs, a, b in zip(self.runs, at, at[1:]):
            runs.append((keys[a:b].copy(), _narrow(n[a:b])))
        self.held += len(keys)
        if self.held > self.most:
            self.held = 0
            for i, runs in enumerate(self.runs):
                keys, n, _ = self._sorted(*map(list, zip(*runs)))
                self.runs[i] = [(keys, _narrow(n))]
                runs.clear()
                self.held += len(keys)
            self.most = max(HOLD, self.held * 3 // 2)

    def _sorted(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, in order of buckets and in each of keys; counts; buckets."""
        merged, n = _merge(keys, counts)
        bucket = merged.view(np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        return merged[order], n[order], bucket[order]

    def rows(self, block: int | None) -> Iterator[pa.RecordBatch]:
        self._close()
        for runs in self.runs:
            keys, n, bucket = self._sorted(*map(list, zip(*runs)))
            runs.clear()
            made = [(bucket[a], block, b - a, _squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), _squeezed(n[a:b])) for a, b in _edges(bucket)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "n", "keys", "counts"])


def _narrow(n: np.ndarray) -> np.ndarray:
    """A copy in four bytes each, where that holds them."""
    return n.copy() if n.max(initial=0) >> 32 else n.astype(np.uint32)


def _keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_restored(data, n, np.uint64), dtype=np.uint64)


def unite(asked: pa.Table) -> pa.Table:
    """``(key, n)`` of one bucket, over all blocks."""
    rows = list(zip(*(asked[c].to_pylist() for c in ("n", "keys", "counts"))))
    keys, n = _merge([_keys(k, m) for m, k, _ in rows], [_restored(c, m, np.int64) for m, _, c in rows])
    _give_back()
    return pa.table({"key": keys.view(np.int64), "n": pa.array(n, pa.int64())})


def reply(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """``(block, n, keys, answers)``: what each block asked of one bucket, with its answers."""
    known = answers["key"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(known)
    known, values = known[order], answers["value"].combine_chunks().to_numpy(zero_copy_only=False)[order]
    told = [_coded(values[np.searchsorted(known, _keys(k, m))]) for m, k in zip(asked["n"].to_pylist(), asked["keys"].to_pylist())]
    return pa.table({"block": asked["block"], "n": asked["n"], "keys": asked["keys"], "answers": pa.array(told, pa.binary())})


def _shelf(keys: np.ndarray) -> np.ndarray:
    """One of 256 shelves for each key."""
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)


class _Told:
    """Answers that a block got, looked up by key, in 16 bytes a key: shelves of sorted keys, filled in place."""

    def __init__(self, rows: pa.Table):
        packed = [(n, keys.as_buffer(), answers.as_buffer()) for n, keys, answers in zip(rows["n"].to_pylist(), rows["keys"], rows["answers"])]
        size = np.zeros(256, np.int64)
        for n, keys, _ in packed:
            size += np.bincount(_shelf(_keys(keys, n)), minlength=256)
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        self.keys, self.values = np.empty(self.bounds[-1], np.uint64), np.empty(self.bounds[-1])
        free = self.bounds[:-1].copy()
        for n, keys, answers in packed:
            some, value = _keys(keys, n), _decoded(answers, n)
            for shelf, places in _by_shelf(some):
                to = slice(free[shelf], free[shelf] + len(places))
                self.keys[to], self.values[to] = some[places], value[places]
                free[shelf] = to.stop
        for a, b in zip(self.bounds, self.bounds[1:]):  # a block that two tasks read has asked twice: equal keys have equal answers
            order = np.argsort(self.keys[a:b], kind="stable")
            self.keys[a:b], self.values[a:b] = self.keys[a:b][order], self.values[a:b][order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The answer to each of ``keys``, which the block has asked for."""
        out = np.empty(len(keys))
        for shelf, places in _by_shelf(keys):
            a, b = self.bounds[shelf], self.bounds[shelf + 1]
            out[places] = self.values[a + np.searchsorted(self.keys[a:b], keys[places])]
        return out


def _by_shelf(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shelves that occur, and where their keys stand."""
    shelf = _shelf(keys)
    order = np.argsort(shelf, kind="stable")
    for a, b in _edges(shelf[order]):
        yield int(shelf[order[a]]), order[a:b]


def _merge(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[start], np.add.reduceat(n, start, dtype=np.int64)) if len(keys) else (keys, n.astype(np.int64))


def _squeezed(values: np.ndarray) -> bytes:
    """Eight-byte values, their first bytes together, then their second: near values differ in few of them."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _waves(column: str, n: int) -> list[F.Column]:
    """Conditions that split the numbers 0 to n - 1 in ``column`` into at most WAVES ranges; row groups of one number are skipped by them."""
    bounds = sorted({n * i // WAVES for i in range(WAVES + 1)})
    return [(F.col(column) >= a) & (F.col(column) < b) for a, b in zip(bounds, bounds[1:])]


def _prime(least: int) -> int:
    """An odd number from ``least`` up without a divisor, so remainders of packed bytes spread evenly."""
    n = max(least, 2) | 1
    while any(n % k == 0 for k in range(3, math.isqrt(n) + 1, 2)):
        n += 2
    return n


def trie_scores(grams: DataFrame) -> DataFrame:
    """``(key, value)``: log10 probability of the last byte of each gram after its context, from ``grams(key, n)``.

    ``key`` packs ORDER context bytes, the oldest first, and the byte that follows; ``n`` counts it in training (0:
    only asked for).
    """
    level = grams.select("key", "n")
    levels = {ORDER: level}
    for j in range(ORDER - 1, -1, -1):
        mask = (1 << (8 * (j + 1))) - 1
        levels[j] = cut(levels[j + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")), **SMALL)
    context = F.shiftrightunsigned("key", 8).alias("context")
    # order 0: T and q of the empty context; log of what is left to a byte that no training row holds
    sums = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count_if(F.col("n") > 0).alias("q"))
    below = levels[0].crossJoin(F.broadcast(sums)).select("key", "n", "t", "q", (-F.log10(F.greatest(256 - F.col("q"), F.lit(1)))).alias("rest"))
    rows = None
    for j in range(1, ORDER + 1):
        mask = (1 << (8 * j)) - 1
        up = levels[j].select("key", F.col("n").alias("n_up"), F.col("key").bitwiseAND(F.lit(mask)).alias("short"))
        made = up.join(below.select(F.col("key").alias("short"), "n", "t", "q", "rest"), "short").drop("short")
        done, rows = rows, cut(made, **SMALL)
        # the level below is in these rows: its files go
        forget(levels[j - 1] if done is None else done)
        if 0 < j < ORDER:
            forget(levels[j])
        stats = rows.groupBy(context).agg(
            F.sum("n_up").alias("t_up"), F.count_if(F.col("n_up") > 0).alias("q_up"), F.sum(F.when(F.col("n_up") > 0, F.col("n")).otherwise(0)).alias("gone")
        )
        left_t, left_q = F.col("t") - F.col("gone"), F.col("q") - F.col("q_up")
        seen = F.log10((F.col("n") - 0.5) / left_t)
        escape = F.when(left_t > 0, F.log10(left_q / (2 * left_t))).otherwise(0.0) + F.col("rest")
        rest = F.when(F.col("n_up") > 0, F.lit(None).cast("double")).when(F.col("n") > 0, seen).otherwise(escape)
        below = rows.select("*", context).join(stats, "context").select("key", F.col("n_up").alias("n"), F.col("t_up").alias("t"), F.col("q_up").alias("q"), rest.alias("rest"))
    escape = F.when(F.col("t") > 0, F.log10(F.col("q") / (2 * F.col("t")))).otherwise(0.0) + F.col("rest")
    value = F.when(F.col("n") > 0, F.log10((F.col("n") - 0.5) / F.col("t"))).otherwise(escape)
    return below.select("key", value.alias("value"))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES for what is written meanwhile."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs(doc_id, text)``; null texts are empty.

    Words are told apart by a 63-bit hash: among V words two share one with a chance of about V * V / 2**64. Repeated
    rows are scored (and learned from) each by itself. A null doc_id counts as training. An empty table gives no row.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~held_out()).alias("docs")).first()
    n_blocks = max(1, -(-size.bytes // BLOCK_BYTES))
    learned_docs = int(size.docs)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    # rows are numbered and dealt once, and read again from these files; a file holds one block
    dealt = pieces(texts).withColumn("block", F.pmod(F.xxhash64("row", "lead"), F.lit(n_blocks)).cast("int"))
    with _small_batches(docs.sparkSession):
        texts = cut(dealt.repartitionById(n_blocks, "block").mapInArrow(bundle, "block int, data binary"), **BUNDLES)
    # keys go packed by bucket, so few rows are shuffled for many keys
    buckets = _prime(size.bytes // BUCKET_BYTES)
    asked = texts.mapInArrow(asker(buckets), "bucket long, block int, n int, keys binary, counts binary")
    with _small_batches(docs.sparkSession):
        asked = cut(asked)
    counts = cut(asked.groupBy("bucket").applyInArrow(unite, "key long, n long"), **SMALL)
    grams, words_ = counts.where("key >= 0"), counts.where("key < 0")
    totals_of = words_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    answers = trie_scores(grams).unionByName(words_.select("key", F.col("n").cast("double").alias("value")))
    told = cut(answers.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key", "value"), **SMALL)
    forget(answers)  # with what the trie left
    packed = asked.select("bucket", "block", "n", "keys")
    answered = reduce(
        DataFrame.unionByName,
        [cut(packed.where(w).groupBy("bucket").cogroup(told.where(w).groupBy("bucket")).applyInArrow(reply, "block int, n int, keys binary, answers binary")) for w in _waves("bucket", buckets)],
    )
    forget(told, asked)
    train_tokens, types = int(totals_of.n) + learned_docs, int(totals_of.v) + int(learned_docs > 0)

    def add_up(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        known = _Told(answer)
        out = []
        for part in _rows(table["data"]):
            n, ends = len(part), np.asarray(part["last"].to_pylist(), np.int64)
            tokens, seen, base, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for lo, hi, (grams, bounds, hashes, first) in _texts(part):
                total[lo:hi] = np.add.reduceat(known.of(grams), bounds[:-1])
                count, row = known.of(hashes), np.repeat(np.arange(hi - lo), np.diff(first))
                tokens[lo:hi] = np.diff(first) + ends[lo:hi]
                seen[lo:hi] = np.bincount(row, count > 0, hi - lo).astype(np.int64) + ends[lo:hi] * (learned_docs > 0)
                base[lo:hi] = np.bincount(row, np.log10(count + 1), hi - lo) + ends[lo:hi] * np.log10(learned_docs + 1)
            out.append(pa.RecordBatch.from_arrays([part["row"], part["doc_id"], part["held_out"], *map(pa.array, (tokens, seen, base, total))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]))
        known = None
        _give_back()
        return pa.Table.from_batches(out)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    parts = reduce(
        DataFrame.unionByName, [cut(texts.where(w).groupBy("block").cogroup(answered.where(w).groupBy("block")).applyInArrow(add_up, schema)) for w in _waves("block", n_blocks)]
    )
    forget(texts, answered)
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")))
    base = F.col("logs") - F.col("n_tokens") * math.log10(train_tokens + types + 1)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_ppm(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
