"""Splits, samples and mixes of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_stem(stems: DataFrame) -> DataFrame:
    """``city``, ``row``, ``col`` of stems like CITY_012_034; ``ok`` is false where the form does not fit."""
    form = "^([A-Za-z]+)_([0-9]+)_([0-9]+)$"
    part = lambda i: F.regexp_extract("stem", form, i)
    ok = F.col("stem").rlike(form)
    return stems.select("stem", ok.alias("ok"), F.when(ok, part(1)).alias("city"), F.when(ok, part(2).cast("int")).alias("row"), F.when(ok, part(3).cast("int")).alias("col"))


def block_split(tiles: DataFrame, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """train, val and test as contiguous bands of rows of each city, as near to the shares as cuts allow.

    Costs of all pairs of cuts are compared (rows of a city are few); equal costs go to the earlier cuts. A city with
    fewer than three rows is all train.
    """
    rows = tiles.groupBy("city", "row").agg(F.count("*").alias("n"))
    w = Window.partitionBy("city").orderBy("row")
    rows = rows.select("city", "row", F.sum("n").over(w).alias("upto"), F.row_number().over(w).alias("k"), F.sum("n").over(Window.partitionBy("city")).alias("total"), F.count("*").over(Window.partitionBy("city")).alias("m"))
    a = rows.where("m >= 3").select("city", F.col("k").alias("i"), F.col("upto").alias("ui"), "total", "m")
    b = rows.select("city", F.col("k").alias("j"), F.col("upto").alias("uj"))
    f = lambda c: F.col(c) / F.col("total")
    loss = F.abs(f("ui") - shares[0]) + F.abs((F.col("uj") - F.col("ui")) / F.col("total") - shares[1]) + F.abs(1 - f("uj") - (1 - sum(shares)))
    cuts = a.join(b, "city").where("i < j and j < m").groupBy("city").agg(F.min(F.struct(F.round(loss, 9).alias("loss"), "i", "j")).alias("c")).select("city", "c.i", "c.j")
    split = F.when(F.col("i").isNull() | (F.col("k") <= F.col("i")), "train").when(F.col("k") <= F.col("j"), "val").otherwise("test")
    return rows.join(cuts, "city", "left").select("city", "row", split.alias("split"))


def split_report(splits: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Number and share of each split and whether it is over 5 % off its target."""
    n = splits.groupBy("split").agg(F.count("*").alias("n"))
    total = splits.agg(F.count("*").alias("total"))
    want = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(v))))
    return n.crossJoin(F.broadcast(total)).select("split", "n", (F.col("n") / F.col("total")).alias("share"), (F.abs(F.col("n") / F.col("total") - want[F.col("split")]) > 0.05).alias("off_target"))  # one row


def in_two_splits(splits: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)


def first_of_split(tiles: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first tiles of each split, as a listing asks for them."""
    return tiles.withColumn("rank", F.row_number().over(Window.partitionBy("split").orderBy(*order))).where(F.col("rank") <= limit)
