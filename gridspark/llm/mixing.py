"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are dealt in blocks. With weights in whole parts that sum to Q, block j of a source of q parts
is released at floor(j*Q/q) and due at ceil((j+1)*Q/q); each slot goes to the released block that is due first. Such a
schedule meets all deadlines, so at every slot each source's blocks differ from its share by less than one, and it
repeats after Q slots: one period (a bounded table) places every block of any number of documents by arithmetic.
When a source runs out its slots are closed up and the others go on in proportion; no document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.rows import every, quoted, text_of

BLOCK = 16
"""Documents in a block."""
WEIGHTS = {"src0": 20, "src1": 6, "src2": 6, "src3": 6, "src4": 6, "src5": 6, "src6": 6, "src7": 6, "src8": 6, "src9": 6}
"""Parts of the registered query; sources not named here share OTHER."""
OTHER = 26
MAX_PARTS = 10_000
"""Most parts, and so slots of a period."""
PLACE = ("stratum", "block_index", "mix_pos")
"""Columns that mixing adds."""


def _strata(weights: dict[str, int], other: int) -> list[tuple[str | None, int]]:
    parts = [*sorted(weights.items()), (None, other)]
    if any(q < 0 or int(q) != q for _, q in parts) or other < 1 or not 0 < sum(q for _, q in parts) <= MAX_PARTS:
        raise ValueError(f"weights are whole numbers from 0, other from 1, with a sum of at most {MAX_PARTS}")
    return [(name, int(q)) for name, q in parts if q]


def period(spark, parts: list[int]) -> DataFrame:
    """``(stratum, turn, slot, placed)``: the slot in a period of the turn-th block of each stratum, by earliest deadline among released blocks, and the blocks of every stratum placed before.

    Ties of deadlines go to the earlier stratum. The state of the fold is the number of blocks placed of each stratum.
    """
    q, total = F.array(*(F.lit(x).cast("long") for x in parts)), sum(parts)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(parts)).alias("n"), F.array().cast("array<struct<stratum:int,turn:bigint,slot:bigint,placed:array<bigint>>>").alias("out"))

    def step(state, slot):
        released = F.filter(
            F.zip_with(
                F.sequence(F.lit(0), F.lit(len(parts) - 1)),
                F.zip_with(state["n"], q, lambda n, w: F.struct(F.ceil((n + 1) * total / w).alias("due"), F.floor(n * total / w).alias("released"), n.alias("turn"))),
                lambda i, b: F.struct(b["due"].alias("due"), i.alias("stratum"), b["released"].alias("released"), b["turn"].alias("turn")),
            ),
            lambda b: b["released"] <= slot,
        )
        pick = F.array_min(released)
        n = F.transform(state["n"], lambda x, i: x + (i == pick["stratum"]).cast("long"))
        return F.struct(n.alias("n"), F.concat(state["out"], F.array(F.struct(pick["stratum"].alias("stratum"), pick["turn"].alias("turn"), slot.alias("slot"), state["n"].alias("placed")))).alias("out"))

    fold = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")), start, step, lambda s: s["out"])
    return spark.range(1).select(F.explode(fold).alias("b")).select("b.*")


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER, block: int = BLOCK, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``stratum``, ``block_index`` and ``mix_pos``: a dense order of all rows that holds the weights at every prefix.

    A source that is not named (or null) belongs to the rest, which shares ``other`` parts. Weight 0 counts as not named.
    Within a stratum rows follow the md5 of the key (without a key: of the whole row), then the key, then a hash of the
    row: an arbitrary but fixed shuffle; rows alike in all columns are interchangeable. Columns of any name and type
    pass unchanged. Ranks are counted in 65,536 cells of each stratum and then
    summed over cells, so a source with any share of all rows is dealt out. Columns named like the results are replaced.
    """
    spark = docs.sparkSession
    strata = _strata(weights, other)
    total = sum(q for _, q in strata)
    names = F.array(*(F.lit(n) for n, _ in strata[:-1])) if len(strata) > 1 else F.array().cast("array<string>")
    place = F.coalesce(F.array_position(names, F.col(quoted(source)).cast("string")), F.lit(0)).cast("int")
    rows = docs.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in PLACE))
    whole = text_of(every(rows))
    spot = F.md5(F.coalesce(F.col(quoted(key)).cast("string"), whole))
    dealt = rows.select(F.struct(*every(rows)).alias("row"), F.when(place > 0, place - 1).otherwise(len(strata) - 1).alias("stratum"), spot.alias("spot"), F.col(quoted(key)).alias("key"), F.xxhash64(whole).alias("tie"))
    dealt = dealt.select("*", F.substring("spot", 1, 2).alias("c1"), F.substring("spot", 3, 2).alias("c2"))
    counts = dealt.groupBy("stratum", "c1", "c2").agg(F.count("*").alias("n"))
    upper = counts.groupBy("stratum", "c1").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("c1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = upper.select("stratum", "c1", before.alias("before"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("stratum", "c1").orderBy("c2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.select("stratum", "c1", "c2", inner.alias("inner")).join(upper, ["stratum", "c1"]).select("stratum", "c1", "c2", (F.col("inner") + F.col("before")).alias("offset"))
    local = F.row_number().over(Window.partitionBy("stratum", "c1", "c2").orderBy("spot", "key", "tie")) - 1
    ranked = dealt.withColumn("local", local).join(cells, ["stratum", "c1", "c2"])
    ranked = ranked.select("row", "stratum", (F.col("local") + F.col("offset")).alias("rank")).select("*", F.floor(F.col("rank") / block).alias("block_index"))
    # slots of one period with the blocks that each stratum has placed before; at most MAX_PARTS rows
    slots = period(spark, [q for _, q in strata])
    # rows of each stratum: one row for each of the bounded number of strata
    sizes = counts.groupBy().pivot("stratum", list(range(len(strata)))).agg(F.sum("n"))
    sizes = sizes.select(F.array(*(F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(len(strata)))).alias("sizes"))
    quota = F.array(*(F.lit(q).cast("long") for _, q in strata))
    placed = slots.select("stratum", "turn", "placed")
    share = quota[F.col("stratum")]
    timed = ranked.withColumn("turn", F.col("block_index") % share).withColumn("round", F.floor(F.col("block_index") / share)).join(F.broadcast(placed), ["stratum", "turn"])
    timed = timed.crossJoin(F.broadcast(sizes))  # one row
    # rows before this block: of each stratum its blocks placed so far, as far as it has rows
    ahead = F.aggregate(
        F.zip_with(F.zip_with(quota, F.col("placed"), lambda q, p: (F.col("round") * q + p) * block), F.col("sizes"), lambda a, s: F.least(a, s)),
        F.lit(0).cast("long"),
        lambda x, y: x + y,
    )
    return timed.select("row.*", F.coalesce(F.try_element_at(names, F.col("stratum") + 1), F.lit("*")).alias("stratum"), "block_index", (ahead + F.col("rank") % block).alias("mix_pos"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Place of every document in the mix. An empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs.select("doc_id", "source")).select("doc_id", "source", "stratum", "block_index", "mix_pos")


def in_mixed_order(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in ranges of the mix, with their place in it. Files are not read in the order of rows, so the place stays with the row."""
    return mixed(docs).orderBy("mix_pos")


def oracle(weights: dict[str, int] = WEIGHTS, other: int = OTHER, block: int = BLOCK) -> str:
    """The result of op4 for DuckDB. The period is found here slot by slot, apart from the fold above."""
    strata = _strata(weights, other)
    total, n, rows = sum(q for _, q in strata), [0] * len(strata), []
    for slot in range(total):
        due = [(-(-(n[i] + 1) * total // q), i) for i, (_, q) in enumerate(strata) if n[i] * total // q <= slot]
        i = min(due)[1]
        rows.append((i, n[i], slot))
        n[i] += 1
    values = ", ".join(map(str, rows))
    known = ", ".join(f"({i}, '{name}', {q})" for i, (name, q) in enumerate(strata[:-1]))
    rest = f"({len(strata) - 1}, '*', {strata[-1][1]})"
    return f"""
    WITH strata(i, name, q) AS (VALUES {known}{", " * bool(known)}{rest}), slots(i, turn, slot) AS (VALUES {values}),
    d AS (SELECT doc_id, source, coalesce(i, {len(strata) - 1}) AS i FROM documents LEFT JOIN strata ON name = source AND name <> '*'),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, source NULLS FIRST) - 1 AS rk FROM d),
    t AS (SELECT doc_id, source, name, rk, rk // {block} AS b, ((rk // {block}) // q) * {total} + slot AS spot
          FROM r JOIN strata USING (i) JOIN slots ON slots.i = r.i AND slots.turn = (rk // {block}) % q)
    SELECT doc_id, source, name AS stratum, b AS block_index, row_number() OVER (ORDER BY spot, rk) - 1 AS mix_pos FROM t"""
