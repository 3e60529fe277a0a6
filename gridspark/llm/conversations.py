"""Repair of conversations: the cheapest edits that bring each to the form ``(system? (user assistant)+)?``.

A conversation is a word of role and fault signs, one for each row. Words are shared from their ends: a node of the
automaton is a suffix, and words that end alike go through the same nodes. Read backwards and in sorted order, words come
to a task as the paths of that automaton from its root, one after another; the nodes of the present path lie on a stack and
each new word adds only those below what it shares with the word before. Cost-to-go and the first edit of the best audit
are computed once for each node and grammar state, whatever the number of conversations that pass it. Ranges of words and
conversation ids deal the work out, so a word that many conversations have is split like any other.

Digests are made in one sorted pass that keeps a conversation's audit, one letter for each edit, and no rows of it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

BLANK = " \t\n\x0b\f\r"
RESET, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
"""Costs of keeping a row, inserting one, giving one another role, deleting one, and of a truncated row that stays."""
START, SYSTEM, USER, ASSISTANT = range(4)
"""Grammar states, by the role that came last; at START and ASSISTANT a conversation may end."""
_NEXT = (USER, USER, ASSISTANT, USER)
"""The state after a row of the role that the state expects: user, or assistant after user."""
_NAME = {USER: "user", ASSISTANT: "assistant"}
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_NONE = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped)``: rows spoilt by the check sum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's. Nulls count as
    one blank in the check sum, the role and the text.
    """
    text_or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text_or_blank("conv_id"), F.lit(":"), text_or_blank("turn")).cast("binary")) % 20
    role, text = text_or_blank("role"), text_or_blank("text")
    spoilt = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 0, "").when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (how == 0).alias("dropped"),
        F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return spoilt.drop("copy")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def marked(rows: DataFrame) -> DataFrame:
    """Each row of ``rows(conv_id, turn, role, text, dropped)`` with its place, its sign and whether it may follow the row before.

    Rows of a conversation are ordered by turn, nulls first, then role and text. The sign of a row that must go is ``d``,
    of others the role's initial (``o``: none of the three), as a capital if the text is cut off. Dropped rows come last.
    """
    rows = rows.repartition("conv_id")
    order = [F.col("dropped"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("seen")]  # of equal rows the first is no duplicate
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(end == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    whole = Window.partitionBy("conv_id").orderBy(*order)
    out = rows.withColumn("seen", seen).withColumns({"pos": F.row_number().over(whole), "pair": F.concat(F.lag(_initial()).over(whole), _initial()), "fault": fault})
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(_initial())).otherwise(_initial())
    return out.select("conv_id", "turn", "pos", "role", "text", "dropped", "fault", (~F.col("pair").isin("su", "ua", "au")).alias("illegal"), sign.alias("sign"))


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``marked`` rows: its faults and ``word``, the signs in order; a conversation of dropped rows has none."""
    there = ~F.col("dropped")
    count = lambda c: F.count_if(there & F.coalesce(c, F.lit(False))).alias
    turn = F.when(there, F.col("turn"))
    signs = F.array_sort(F.collect_list(F.when(there, F.struct("pos", "sign"))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal"))("illegal"),
        F.array_join(F.transform(signs, lambda x: x.sign), "").alias("word"),
    )


class Suffixes:
    """The path of the automaton for one word after another, each read from its end: for each node and grammar state the cost-to-go and the first edit of the best audit."""

    def __init__(self) -> None:
        self.word = b""
        self.cost = array("q", [0, 2 * INSERT, INSERT, 0])
        self.edit = bytearray(b".II.")

    def _push(self, sign: str) -> None:
        """The node of a suffix that begins with ``sign`` and goes on with the suffix on top of the stack."""
        after = self.cost[-4:]
        own, edit = [], []
        low = sign.lower()
        more = TRUNCATED if sign != low else 0
        for q in range(4):
            best = (after[q] + DELETE, "D")
            if low != "d":
                if q in _KEEP[low]:
                    best = min(best, (after[_KEEP[low][q]] + RESET + more, "K"))
                best = min(best, (after[_NEXT[q]] + REROLE + more, "R"))
            own.append(best)
        user, assistant = own[USER], own[ASSISTANT]
        own[USER], own[ASSISTANT] = min(user, (assistant[0] + INSERT, "I")), min(assistant, (user[0] + INSERT, "I"))
        for q in (START, SYSTEM):
            own[q] = min(own[q], (own[USER][0] + INSERT, "I"))
        self.cost.extend(c for c, _ in own)
        self.edit.extend(ord(e) for _, e in own)

    def repair(self, word: str) -> tuple[int, str]:
        """Least cost of a word and of its cheapest audits the ASCII-least."""
        back = word[::-1].encode()
        n = min(len(back), len(self.word))
        apart = np.flatnonzero(np.frombuffer(back, np.uint8, n) != np.frombuffer(self.word, np.uint8, n))
        shared = int(apart[0]) if len(apart) else n
        del self.cost[4 * (shared + 1) :], self.edit[4 * (shared + 1) :]
        for sign in back[shared:].decode():
            self._push(sign)
        self.word = back
        audit, q, at = bytearray(), START, len(back)
        while at or q not in (START, ASSISTANT):
            e = self.edit[4 * at + q]
            audit.append(e)
            if e == 73:  # I
                q = _NEXT[q]
                continue
            at -= 1
            if e == 75:  # K
                q = _KEEP[chr(back[at]).lower()][q]
            elif e == 82:  # R
                q = _NEXT[q]
        return self.cost[4 * len(back) + START], audit.decode()


def repairs(heads: DataFrame) -> DataFrame:
    """Each row of ``heads(word, ...)`` with ``cost`` and ``audit``. Rows are dealt out by ranges of reversed words, then conversations."""
    names = heads.columns
    ranged = heads.withColumn("back", F.reverse("word")).repartitionByRange("back", "conv_id").sortWithinPartitions("back", "conv_id").drop("back")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Suffixes()
        for batch in batches:
            found = [nodes.repair(w) for w in batch.column(names.index("word")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*names, "cost", "audit"])

    kinds = ", ".join(f"{c} {k}" for c, k in heads.dtypes)
    return ranged.mapInArrow(apply, f"{kinds}, cost long, audit string")


class _Repaired:
    """Feeds the rows of one repaired conversation, as its audit has them, to ``sink(role, text)``."""

    def __init__(self, audit: str, sink) -> None:
        self.audit, self.at, self.state, self.sink = audit, 0, START, sink

    def _new(self, text: str) -> None:
        self.state = _NEXT[self.state]
        self.sink(_NAME[self.state], text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._new("")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        e = self.audit[self.at]
        self.at += 1
        if e == "K":
            self.state = _KEEP[role[0]][self.state]
            self.sink(role, text)
        elif e == "R":
            self._new(text)

    def close(self) -> None:
        self._inserted()


_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _with_rows(heads: DataFrame, rows: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(head, close)``: for each conversation the head (all fields) and then its kept rows, in order, in one pass of a sorted partition."""
    first = heads.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_FIELDS)
    kinds = dict(heads.dtypes)
    rest = rows.where("not dropped").select("conv_id", "pos", "role", "text", *(F.lit(None).cast(kinds[c]).alias(c) for c in _FIELDS))
    return first.unionByName(rest).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos").mapInArrow(emit, schema)


def repaired_rows(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: the repaired conversations themselves, turns counted from 0. A conversation may be empty."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, n = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def sink(role: str, text: str) -> None:
                nonlocal n
                out.append((conv, n, role, text))
                n += 1

            for c, pos, role, text, audit in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "pos", "role", "text", "audit"))):
                if pos == 0:
                    if now:
                        now.sink = sink
                        now.close()
                    conv, n, now = c, 0, _Repaired(audit, sink)
                else:
                    now.sink = sink
                    now.row(role, text)
            yield _table(out)
        if now:
            out = []
            now.sink = lambda role, text: out.append((conv, n + len(out), role, text))
            now.close()
            yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text"])

    return _with_rows(heads, rows, emit, "conv_id long, turn long, role string, text string")


def digests(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads`` with ``repaired_sha256``: of the repaired ``role:text`` lines."""
    kinds = {"conv_id": pa.int64(), **{c: pa.int64() for c in _FIELDS}, "audit": pa.string(), "repaired_sha256": pa.string()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = head = sha = None

        def sink(role: str, text: str) -> None:
            sha.update(("\n" if sha.digest() != empty else "").encode() + f"{role}:{text}".encode())

        empty = hashlib.sha256().digest()

        def closed() -> tuple:
            now.close()
            return (*head, sha.hexdigest())

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            done = []
            column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "pos", "role", "text", *_FIELDS)}
            for k, pos in enumerate(column["pos"]):
                if pos == 0:
                    if now:
                        done.append(closed())
                    head = (column["conv_id"][k], *(column[c][k] for c in _FIELDS))
                    sha, now = hashlib.sha256(), _Repaired(column["audit"][k], sink)
                else:
                    now.row(column["role"][k], column["text"][k])
            yield table(done)
        if now:
            yield table([closed()])

    return _with_rows(heads, rows, emit, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written heads (one row a conversation: faults, cost, audit) and rows of ``rows(conv_id, turn, role, text, dropped)``."""
    own = cut(marked(rows))
    return cut(repairs(cut(summaries(own)))), own


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Damaged ``conversations`` with their faults, the cheapest repair and the digest of what it gives.

    Rows without conv_id are one conversation. Other columns than conv_id, turn, role and text are not looked at. Rows of
    one turn are ordered by role and text; repeated rows are duplicates. An empty text is blank; texts and conversations
    may be of any length, but a conversation's audit, a letter for each edit, is one string. An empty table gives no row.
    """
    return digests(*repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _add(letter: str, cost: str, tail: str) -> str:
    """SQL: an audit with its cost in front, as text that sorts by cost and then by audit, with one edit more."""
    return f"(lpad((left({tail}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({tail}, 10))"


def oracle() -> str:
    """DuckDB SQL: a recursion over rows from the end of each conversation, costs and audits of four states as sortable texts."""
    more = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
    free = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"

    def own(q: int) -> str:
        fits = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        keep = ", ".join(f"CASE WHEN {free} AND ini = '{i}' THEN {_add('K', more, f'b{t}')} END" for i, t in fits.items())
        return f"least({_add('D', '3', f'b{q}')}, {keep}, CASE WHEN {free} THEN {_add('R', f'2 + {more}', f'b{_NEXT[q]}')} END) AS c{q}"

    chars = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE tb AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hs AS (SELECT src.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM src, tb),
dm AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS cp FROM hs WHERE h <> 0),
ds AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM dm),
od AS (SELECT conv_id, turn, role, text, seen, rtrim(text, {chars}) AS e, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END) OVER w AS was FROM ds WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
rw AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM od),
dp(conv_id, i, b0, b1, b2, b3) AS (SELECT DISTINCT conv_id, n + 1, '000000000', '000000004II', '000000002I', '000000000' FROM rw UNION ALL
  SELECT conv_id, i, least(c0, {_add('I', '2', f"least(c2, {_add('I', '2', 'c3')})")}), least(c1, {_add('I', '2', f"least(c2, {_add('I', '2', 'c3')})")}), least(c2, {_add('I', '2', 'c3')}), least(c3, {_add('I', '2', 'c2')})
  FROM (SELECT dp.conv_id, dp.i - 1 AS i, {', '.join(own(q) for q in range(4))} FROM dp JOIN rw ON rw.conv_id IS NOT DISTINCT FROM dp.conv_id AND rw.pos = dp.i - 1)),
au AS (SELECT conv_id, left(b0, 9)::BIGINT AS cost, substr(b0, 10) AS audit FROM dp WHERE i = 1),
lt AS (SELECT conv_id, unnest(string_split(audit, '')) AS l, unnest(range(length(audit))) AS k FROM au WHERE audit <> ''),
nm AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS pos, count(*) FILTER (l <> 'D') OVER w AS m FROM lt WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kp AS (SELECT nm.conv_id, k, l, m, rw.role, rw.ini, CASE WHEN l = 'I' THEN '' ELSE text END AS text FROM nm LEFT JOIN rw ON rw.conv_id IS NOT DISTINCT FROM nm.conv_id AND rw.pos = nm.pos AND l <> 'I' WHERE l <> 'D'),
sy AS (SELECT *, max(CASE WHEN m = 1 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM kp),
rp AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM sy GROUP BY conv_id),
ct AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS dup, count(*) FILTER (fault = 'truncated') AS cutoff, count(*) FILTER (was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rw GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cutoff, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN ct ON ct.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN au ON au.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM i.conv_id"""
