"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are encoded once; longer ones are cut into whole sequences and a rest. Only the histogram of lengths, at most
as many numbers as a sequence has tokens, reaches the driver. There patterns of up to three documents that fill a sequence
exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares, rounded, and what
they leave is packed by best fit, longest first, over counts. The plan says which ranks of each length go where; documents
find their place by their rank among those of their length, told by task and by place in the task, so no length is
gathered anywhere however many documents have it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.bytetext import byte_view, groups
from gridspark.plans.lineage import cut

VOCABULARY = "word_bpe_49k.json"
TOKENS = 2048
END = 0
"""The id that follows each document's own."""
SWEEPS = 8
"""Rounds of the least-squares fit over all blocks of patterns."""
WEIGHT = 4
"""Differences weigh by this power of the length: what is left of short documents is packed without loss."""
SEGMENT = 4 << 20
"""Characters of a text that are encoded at a time; it is cut at white space."""
GROUP_BYTES = 8 << 20
"""Bytes of texts that are encoded together."""
WORDS_KEPT = 1_000_000
"""Encoded words that a worker remembers; beyond, it starts anew."""

_LETTER, _SIGN = "a-zß-öø-ÿ", r"!-&(-;=?@\[-`{}~"
_EDGES = (f"([{_LETTER}])([{_SIGN}])", f"([{_SIGN}])([{_LETTER}])")
"""Between a letter and a sign tokens always end; the apostrophe (contractions) and the signs of special tokens are no such edges."""
_WORD = re.compile(f"[{_LETTER}]+")
_BLANK = re.compile(r"[ \t-\r]")
_CACHES: dict = {}


class _Words:
    """Ids of what stands between white space, as bytes; equal words are encoded once.

    For tokenizers that drop white space and letter case, part letters from signs and mark the ends of words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        made, end = json.loads(self.whole.to_str()), self.whole.model.end_of_word_suffix
        if not end or [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a tokenizer of words without white space and letter case")
        self.letters = Tokenizer(self.whole.model)  # for words of letters alone: what the whole does to them is known
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for w, i in names.items() if w.endswith(end)]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        new = [w for w in words if w not in known]
        plain = [w for w in new if _WORD.fullmatch(w)]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.array(self.letters.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            bounds = [0, *((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()]
            raw = ids.tobytes()
            known.update(zip(some, (raw[a:b] for a, b in zip(bounds, bounds[1:]))))
        rest = [w for w in new if w not in known]
        for w, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(e.ids, self.kind).tobytes()
        return [known[w] for w in words]


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT:
        gap = _BLANK.search(text, at + SEGMENT)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def _encode(texts: pa.Array, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts side by side, and how many each text has."""
    low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens are told by case
    for edge in _EDGES:
        low = pc.replace_substring_regex(low, edge, r"\1 \2")
    split = pc.ascii_split_whitespace(low)
    word = split.flatten().dictionary_encode()
    own = words.ids(word.dictionary.to_pylist())
    size = np.fromiter((len(x) for x in own), np.int64, len(own)) // np.dtype(words.kind).itemsize
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pa.array(np.frombuffer(b"".join(own), words.kind)))
    ids = lists.take(word.indices).flatten().to_numpy()
    ends = np.append(0, np.cumsum(size[word.indices.to_numpy()]))
    return ids.astype(np.uint32), np.diff(ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))])


def encoded_pieces(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, place[, ids])``: documents as pieces of at most ``limit`` ids.

    A text (null: empty) is encoded as the tokenizers library does, without special tokens of its own, and followed by
    END; so every row of ``docs`` makes a piece, repeated rows and rows without doc_id too. ``place`` counts the pieces
    of a length in a task (``part``): the rows must be written before they are used twice.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _CACHES.get(path) or _CACHES.setdefault(path, _Words(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, offsets = byte_view(texts)
            for i, j in groups(offsets, GROUP_BYTES):
                some = pc.fill_null(texts.slice(i, j - i), "")
                if j - i == 1 and offsets[j] - offsets[i] > SEGMENT:
                    runs = [_encode(pa.array([s], pa.large_string()), words)[0] for s in _segments(some[0].as_py())]
                    ids, n = np.concatenate(runs), np.array([sum(map(len, runs))])
                else:
                    ids, n = _encode(some, words)
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                first = np.cumsum(n) - n
                many = -(-n // limit)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start, length = piece * limit, np.minimum(limit, n[doc] - piece * limit)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                begin = (first[doc] + start) * 4
                crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin.tolist(), (begin + length * 4).tolist())]
                order = np.argsort(length, kind="stable")
                sizes, at, count = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(doc), np.int64)
                place[order] = np.arange(len(doc)) - np.repeat(at, count) + np.repeat(seen[sizes], count)
                seen[sizes] += count
                columns = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def _block(a: int, h: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Second and third lengths (0: none) of the patterns whose longest is ``a``, all three (or two) different from it and filling ``limit``."""
    rest = limit - a
    b = np.arange((rest + 1) // 2, min(a - 1, rest) + 1)
    b = b[(h[b] > 0) & ((b == rest) | (h[rest - b] > 0))]
    return b, rest - b


def fit_patterns(hist: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(repeats, lengths)`` of patterns of one to three documents that fill ``limit`` exactly; ``hist[l]`` counts length l.

    Repeats minimise the squared difference between what patterns use and the histogram. The patterns with one longest
    length share nothing else, so the best repeats of such a block, the others held, solve one piecewise linear equation;
    blocks are swept in turn (block coordinate descent). Patterns that repeat their longest length are blocks of one.
    Rounding carries fractions over to the next pattern, and no length is used more often than it occurs.
    """
    h = hist.astype(float)
    r, x, w = h.copy(), {}, (np.arange(limit + 1) / limit) ** WEIGHT
    longest = [a for a in range(limit - 1, (limit - 1) // 3, -1) if h[a] > 0]
    blocks = {a: _block(a, h, limit) for a in longest}
    twice = {a: limit - 2 * a for a in longest if 2 * a <= limit and (2 * a == limit or (h[limit - 2 * a] > 0))}
    for _ in range(SWEEPS):
        for a in longest:
            b, c = blocks[a]
            if len(b):
                two, same = c == 0, b == c
                old = x.get(a, np.zeros(len(b)))
                r[a] += old.sum()
                np.add.at(r, b, old)
                np.add.at(r, c[~two], old[~two])
                total = w[b] * r[b] + np.where(two, 0, w[c] * r[c])
                k = np.where(same, 4.0 * w[b], w[b] + np.where(two, 0, w[c]))
                order = np.argsort(-total)
                # t / w + sum of (total + t) / k over the first m patterns = what is left of a
                s1, s0 = np.cumsum(1 / k[order]), np.cumsum(total[order] / k[order])
                t = (r[a] - s0) / (1 / w[a] + s1)
                fits = np.append(-total[order][1:] >= t[:-1], True)
                new = np.maximum(0.0, (total + t[np.argmax(fits)]) / k) if w[a] * r[a] > -total[order[0]] else np.zeros(len(b))
                x[a] = new
                r[a] -= new.sum()
                np.subtract.at(r, b, new)
                np.subtract.at(r, c[~two], new[~two])
            if a in twice:
                c = twice[a]
                step = {a: 2.0} if c == 0 else {a: 3.0} if c == a else {a: 2.0, c: 1.0}
                old = x.get(-a, 0.0)
                new = max(0.0, old + sum(m * w[v] * r[v] for v, m in step.items()) / sum(m * m * w[v] for v, m in step.items()))
                for v, m in step.items():
                    r[v] += m * (old - new)
                x[-a] = new
    found, left, carry = [], hist.astype(np.int64).copy(), 0.5
    if left[limit]:
        found.append((int(left[limit]), (limit,)))
        left[limit] = 0
    for a in longest:
        b, c = blocks[a]
        wanted = [(v, (a, int(p), int(q))) for v, p, q in zip(x.get(a, np.zeros(0)), b, c)] + ([(x[-a], (a, a, twice[a]))] if a in twice else [])
        for v, lengths in wanted:
            carry += v
            n = int(carry)
            carry -= n
            if n:
                lengths = tuple(v for v in lengths if v)
                n = min(n, *(left[v] // lengths.count(v) for v in lengths))
                if n > 0:
                    found.append((int(n), lengths))
                    for v in lengths:
                        left[v] -= n
    return found


def best_fit(hist: np.ndarray, limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(repeats, [(length, copies), ...])``: best fit, longest first, over counts: sequences of one content are handled together, so the work does not depend on the number of documents."""
    room: list[list] = [[] for _ in range(limit + 1)]
    for size in range(limit, 0, -1):
        n = int(hist[size])
        for rem in range(size, limit):
            while n and room[rem]:
                count, runs = room[rem].pop()
                k = rem // size
                full = min(count, n // k)
                if full:
                    room[rem - k * size].append((full, [*runs, (size, k)]))
                    count, n = count - full, n - full * k
                if count and 0 < n < k:
                    room[rem - n * size].append((1, [*runs, (size, n)]))
                    count, n = count - 1, 0
                if count:
                    room[rem].append((count, runs))
            if not n:
                break
        k = limit // size
        if n // k:
            room[limit - k * size].append((n // k, [(size, k)]))
        if n % k:
            room[limit - n % k * size].append((1, [(size, n % k)]))
    return [g for same in room for g in same]


def plan(hist: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """Where each rank of each length goes: spans of ranks, sorted by ``key`` (length and first rank), with sequence, copies in it and offset.

    At most as many patterns as there are pairs of lengths, whatever the number of documents.
    """
    fitted = fit_patterns(hist, limit)
    left = hist.astype(np.int64).copy()
    for n, lengths in fitted:
        for v in lengths:
            left[v] -= n
    patterns = [(n, [(v, 1) for v in lengths]) for n, lengths in fitted] + best_fit(left, limit)
    rank, sequence, spans = np.zeros(limit + 1, np.int64), 0, []
    for n, runs in patterns:
        offset = 0
        for size, k in runs:
            spans.append((size << 48 | int(rank[size]), sequence, k, offset))
            rank[size] += n * k
            offset += size * k
        sequence += n
    spans = np.array(sorted(spans), np.int64).reshape(-1, 4)
    return {"key": spans[:, 0], "sequence": spans[:, 1], "copies": spans[:, 2], "offset": spans[:, 3]}


def pack(pieces: DataFrame, limit: int = TOKENS) -> DataFrame:
    """Each written piece of ``pieces(length, part, place, ...)`` with ``sequence_id`` and ``offset`` in place of part and place."""
    spark = pieces.sparkSession
    own = pieces.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = cut(own.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    hist = np.zeros(limit + 1, np.int64)
    for row in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        hist[row.length] = row.n
    spans = spark.sparkContext.broadcast(plan(hist, limit))
    ranked = pieces.join(ranks.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")
    names = [c for c in ranked.columns if c != "rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spans.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(p["key"], size << 48 | rank, side="right") - 1
            inside = rank - (p["key"][at] & (1 << 48) - 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p["sequence"][at] + inside // p["copies"][at]), pa.array(p["offset"][at] + inside % p["copies"][at] * size)], names=[*names, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(placed, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_pieces, ids)`` of a packing that carries ids: one row for each sequence, none longer than the limit."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.size("p").alias("n_pieces"), F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``: every row of ``docs(doc_id, text)`` in sequences of at most ``limit`` tokens.

    Null and empty texts are the one id END; rows with equal or no doc_id are packed like others; other columns are not
    looked at; an empty table gives no row.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return pack(cut(encoded_pieces(docs, vocabulary, limit, with_ids)), limit).select(*columns)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` in its sequence of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
