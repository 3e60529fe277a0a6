"""Packing against the tokenizers library, counts packed one by one, and the rules of the contract."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from gridspark.llm import packing

SF = "/root/testdata/sf0.001"
LONG = "thhaat einlich. " * 2500
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "日本語 😀 \u0000x"), (5, "日本語 😀 \u0000x"), (6, "x" * 30_000), (7, "it's 's x'll-'s A.'s (a)b'.c <|endoftext|> <|ENDOFTEXT|>a.b<|startoftext|>"), (None, "no id at all here now"), (8, LONG), (9, "éa.́b≠c İ Σ ΑΣ.x é.é…—. ½x²3,4\x0b\x0cz q w\x1c\x85"), (10, "×÷a×b!a?")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 7, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, place int, `a.b` string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def holds(rows, docs, library, limit):
    """Every rule of the contract; ids are the library's. Returns the number of sequences."""
    want = collections.Counter()
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.append(0, np.cumsum([n for _, n in parts])[:-1])) and sum(n for _, n in parts) <= limit
    return len(by)


def one_by_one(lengths, limit):
    """Best fit, longest first, item by item."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= size
        else:
            rooms.append(limit - size)
    return len(rooms)


def test_whole_table(spark, library):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = packing.op11_packing(spark, SF).collect()
    n = holds(rows, docs, library, packing.TOKENS)
    lengths = [r.length for r in rows]
    assert -(-sum(lengths) // packing.TOKENS) <= n <= one_by_one(lengths, packing.TOKENS) * 1.02 + 1


def test_odd_texts(spark, odd, library, monkeypatch):
    rows = packing.pack_documents(odd, limit=64).collect()
    holds(rows, ODD, library, 64)
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    monkeypatch.setattr(packing, "SEGMENT", 1000)  # the parent's value; workers keep theirs
    assert list(packing._segments(LONG)) and " ".join(packing._segments(LONG)) == LONG
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_long_texts_in_segments(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SEGMENT", 1000)
    words = packing._Words(public_tokenizers.path(packing.VOCABULARY))
    runs = [packing._encode(pa.array([s], pa.large_string()), words)[0] for s in packing._segments(LONG + ODD[9][1])]
    assert len(runs) > 30 and np.concatenate(runs).tolist() == library.encode(LONG + ODD[9][1], add_special_tokens=False).ids


def test_hot_length_and_tasks(spark):
    """A third of the documents have one length; every task counts for itself."""
    docs = spark.createDataFrame([(i, "word " * (300 if i % 3 == 0 else i % 500)) for i in range(900)], "doc_id long, text string").repartition(7)
    rows = packing.pack_documents(docs, limit=512).collect()
    by = collections.defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert len(rows) == 900 and max(by.values()) <= 512 and len(by) <= one_by_one([r.length for r in rows], 512) * 1.02 + 1


def test_sequences_hold_their_documents(spark, library):
    docs = spark.createDataFrame(ODD[:8], "doc_id long, text string")
    packed = packing.pack_documents(docs, limit=4096, with_ids=True).cache()
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert max(map(len, ids.values())) <= 4096


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_document_once(seed):
    rng = np.random.default_rng(seed)
    limit = 60
    lengths = rng.integers(1, limit + 1, 700) if seed % 2 else np.minimum(limit, rng.geometric(0.08, 700))
    hist = np.bincount(lengths, minlength=limit + 1)
    fitted = packing.fit_patterns(hist, limit)
    assert all(sum(v) == limit and len(v) <= 3 for _, v in fitted) and len(fitted) > 5
    p = packing.plan(hist, limit)
    used = collections.defaultdict(list)
    for size in range(1, limit + 1):
        for rank in range(hist[size]):
            at = np.searchsorted(p["key"], size << 48 | rank, side="right") - 1
            inside = rank - (p["key"][at] & (1 << 48) - 1)
            assert p["key"][at] >> 48 == size
            used[p["sequence"][at] + inside // p["copies"][at]].append((p["offset"][at] + inside % p["copies"][at] * size, size))
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= limit
    assert len(used) <= one_by_one(lengths.tolist(), limit) * 1.02 + 1
    assert sorted(packing.best_fit(hist, limit)) and sum(n for n, _ in packing.best_fit(hist, limit)) == one_by_one(lengths.tolist(), limit)


def test_fit_is_a_least_squares_solution(monkeypatch):
    """Where patterns can explain the histogram, the fit leaves nothing but roundings once it has run long enough."""
    monkeypatch.setattr(packing, "SWEEPS", 1000)
    hist = np.zeros(41, int)
    for n, pattern in ((300, (30, 10)), (200, (20, 15, 5)), (90, (14, 13, 13)), (50, (40,)), (70, (16, 16, 8))):
        for v in pattern:
            hist[v] += n
    left = hist.copy()
    for n, pattern in packing.fit_patterns(hist, 40):
        for v in pattern:
            left[v] -= n
    assert left.min() >= 0 and (left * np.arange(41)).sum() < 0.01 * (hist * np.arange(41)).sum()
