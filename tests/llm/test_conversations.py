"""Repairs against a search over all edits, plain Python over whole tables, and SQL."""

import hashlib
import heapq
import itertools
import re
import zlib

import duckdb
import pytest

from gridspark.llm import conversations as cv

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\f\r"


def cheapest(rows):
    """Cost, least audit and rows of the cheapest repair of ``(role, text, fault)``: all edits in order of cost and audit, no sharing of suffixes."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, got, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", got):
            return cost, audit, [(r, t) for r, t in out]
        state = got[-1:]
        if (i, state) in done:
            continue
        done.add((i, state))
        want = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, got + want[0], (*out, (want, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, got, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, got + want[0], (*out, (want, text))))
                if role[:1] == want[0] or role[:1] == "s" and not got:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, got + role[:1], (*out, (role, text))))


def brute(table):
    out, groups = {}, {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        groups[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(BLANK)
            marked.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        count = lambda f: sum(x[2] == f for x in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, kept = cheapest(marked)
        body = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def told(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 2, "user", None), (1, None, "system", "s!"),
    (2, None, None, None), (2, None, "tool", "x"), (2, None, "", "y."), (None, 3, "user", "no id"), (None, 9, "user", "no id"), (None, None, "assistant", "ok. \x0b\r"),
    (3, 0, "assistant", "a."), (3, 1, "assistant", "b."), (3, 5, "user", "c. "), (3, 5, "system", "d! \n"), (4, 7, "sys", "\t"), (5, -3, "user", "z!" * 50_000), (5, 1 << 40, "assistant", "?"),
    *((6, k, ("system", "user", "assistant", "user", "x")[k * k % 5], f"{k % 17}{'.' * (k % 3)}") for k in range(300)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "w", 1) for r in ODD], "conv_id long, turn long, role string, text string, word string, pos int")


def test_whole_table(spark):
    table = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert told(cv.op12_conversations(spark, SF)) == brute(table)


def test_odd_rows(spark, odd):
    assert told(cv.digests(*cv.repair(cv.damage(odd)))) == brute(ODD)
    assert cv.digests(*cv.repair(cv.damage(odd.limit(0)))).count() == 0


def test_every_short_word():
    """All words of up to four signs, in one automaton: cost and audit equal a search without it."""
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    words = ["".join(w) for n in range(5) for w in itertools.product("suaoSUAOd", repeat=n)]
    nodes = cv.Suffixes()
    for w in sorted(words, key=lambda w: w[::-1]):
        rows = [(roles.get(x.lower(), "user"), "t", "blank" if x == "d" else "truncated" if x.isupper() else None) for x in w]
        assert nodes.repair(w) == cheapest(rows)[:2]


def test_nodes_are_shared():
    """A suffix that words share is computed once."""
    nodes, pushed = cv.Suffixes(), []
    push = nodes._push
    nodes._push = lambda sign: (pushed.append(sign), push(sign))
    words = ["suaua" + "ua" * 50, "ua" * 52, "uuaua" + "ua" * 50]
    for w in sorted(words * 40, key=lambda w: w[::-1]):
        nodes.repair(w)
    assert len(pushed) == len({w[k:] for w in words for k in range(len(w))})


def test_hot_word_and_long_conversation(spark):
    """Most conversations have one word; one has a third of the rows."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(300) for t in range(4)] + [(1000, t, ("user", "assistant")[t * 7 % 2], f"{t}!") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert told(cv.digests(*cv.repair(cv.damage(df)))) == brute(rows)


def test_repaired_rows(spark, odd):
    heads, rows = cv.repair(cv.damage(odd))
    by = {}
    for r in sorted(cv.repaired_rows(heads, rows).collect(), key=lambda r: (r.conv_id or -1, r.turn)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, want in brute(ODD).items():
        assert hashlib.sha256("\n".join(by.get(conv, [])).encode()).hexdigest() == want[-1]


def test_equals_sql(spark, odd):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(cv.oracle()).fetchall()}
    assert told(cv.op12_conversations(spark, SF)) == want
    con.execute("create or replace view conversations as select 1 as a")
    con.execute("create table c2 (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into c2 values (?, ?, ?, ?)", ODD)
    con.execute("create or replace view conversations as select * from c2")
    assert {r[0]: r[1:] for r in con.sql(cv.oracle()).fetchall()} == brute(ODD)
