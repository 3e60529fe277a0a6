"""Spelling variants against plain Python over whole tables, and SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridspark.llm import spelling

SF = "/root/testdata/sf0.001"


def counted(docs):
    n = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    n = counted(docs)
    near = collections.defaultdict(set)
    keys = collections.defaultdict(list)
    for w in n:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            keys[k].append(w)
    for group in keys.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def told(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = brute(docs)
    assert told(spelling.op13_spelling(spark, SF)) == want
    assert sum(w[0] is not None for w in want.values()) > 3


ODD = (
    [(k, "planning plannings planing planned PLANNING! Straßenbahn STRAßENBAHN straßenbahm") for k in range(60)]
    + [(k, "plannimg plannimgs a×b×c×d×e Élephant élephant") for k in range(60, 64)]
    + [(None, "planning planning"), (None, None), (None, ""), (7, "x" * 100_000), (8, "x" * 99_999 + " " + "x" * 100_001), (7, "x" * 100_000), (8, "x" * 99_999), (9, "elephant́s İstanbul_planning9planning")]
    + [(k, "abcdefgh") for k in range(1000, 1900)] + [(k, "abcdefgx abcdefg") for k in range(1900, 1945)] + [(k, "abcdefgxy abcdefxg") for k in range(1945, 1948)]
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "f") for r in ODD], "doc_id long, text string, n int, form string")


def test_odd_rows(spark, odd):
    got = told(spelling.spelling_variants(odd))
    assert got == brute(ODD)
    assert got["abcdefgxy"][:2] == ("abcdefgx", "abcdefgh") and got["abcdefgh"][0] is None  # a chain of forms
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("groups", "tile"), [(1, 100), (3, 40), (5, 1 << 20), (6, 300)])
def test_blocks_do_not_matter(spark, groups, tile):
    rng = np.random.default_rng(groups)
    words = {"".join(rng.choice(list("abcé"), rng.integers(7, 11))) for _ in range(400)}
    vocab = [(w, int(rng.integers(2, 50))) for w in sorted(words)]
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(spark.createDataFrame(vocab, "word string, n long"), groups, tile).collect()}
    n = dict(vocab)
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        assert got.get(w) == ((len(near), best, n[best]) if near else None)


def test_products_in_slices(monkeypatch):
    monkeypatch.setattr(spelling, "PRODUCT", 50)
    x = np.array([list(b"aaaaaaa"), list(b"aaaaaab"), list(b"abaaaaa"), list(b"bbbbbbb")], np.uint8)
    i, j = spelling.near_pairs(x, x, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2)]
    y = np.array([list(b"aaaaaaab"), list(b"aabaaaaa"), list(b"bbbbbbbb"), list(b"aaaaaacd")], np.uint8)
    i, j = spelling.near_pairs(x, y, False)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 0), (2, 1), (3, 2)]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(spelling.oracle())
    assert rel.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r[0]: r[1:] for r in rel.fetchall()} == told(spelling.op13_spelling(spark, SF))
