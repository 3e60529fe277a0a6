"""Catalogues of files, caches, artifacts and scenes; mixes and samples of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.joins import pick_first

KINDS = ("rgb", "agl", "cls")


def discover_triples(files: DataFrame) -> DataFrame:
    """One row for each stem of ``files(stem, kind)`` with its kinds and its problem.

    An image without both heights and classes lacks truth; heights or classes without an image lack one. An image that
    lacks only one of the two is neither whole nor in a list of problems.
    """
    s = files.groupBy("stem").agg(*(F.max((F.col("kind") == k).cast("int")).cast("boolean").alias(f"has_{k}") for k in KINDS))
    problem = F.when(F.col("has_rgb") & ~F.col("has_agl") & ~F.col("has_cls"), "RGB_WITHOUT_TRUTH").when(~F.col("has_rgb"), "TRUTH_WITHOUT_RGB")
    return s.select("*", (F.col("has_rgb") & F.col("has_agl") & F.col("has_cls")).alias("whole"), problem.alias("problem"))


def check_triples(stems: DataFrame, files: DataFrame) -> DataFrame:
    """Every missing kind of every expected stem."""
    wanted = stems.select("stem", F.explode(F.array(*(F.lit(k) for k in KINDS))).alias("kind"))
    return wanted.join(files.select("stem", "kind").distinct(), ["stem", "kind"], "left_anti")


def cache_lookup(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached path of each sample: its own name space first, then the old flat layout; null if there is none. ``cache(sample, layout, path)``."""
    rank = F.when(F.col("layout") == "namespaced", 0).otherwise(1)
    best = pick_first(cache.withColumn("rank", rank), ["sample"], "rank", "path").select("sample", "layout", "path")
    return samples.join(best, "sample", "left")


def cache_worklist(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Samples that have no entry yet."""
    return samples.join(manifest.select("sample"), "sample", "left_anti")


def cache_manifest(px: DataFrame) -> DataFrame:
    """What a cache notes of each scene: shape and range."""
    return px.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.count("*").alias("n"))


def depth_cache_sync(tiles: DataFrame, cached: DataFrame) -> DataFrame:
    """Scenes whose cached shape is not that of the tile."""
    c = cached.select("scene_id", F.col("height").alias("c_height"), F.col("width").alias("c_width"))
    off = (F.col("height") != F.col("c_height")) | (F.col("width") != F.col("c_width"))
    return tiles.join(c, "scene_id").where(off).select("scene_id", F.lit("GRID_MISMATCH").alias("status_code"), F.format_string("%dx%d is not %dx%d", "c_height", "c_width", "height", "width").alias("detail"))


def result_catalog(scenes: DataFrame, artifacts: DataFrame, known: dict[str, str]) -> DataFrame:
    """Known artifacts of each scene and a flag for each capability that one of them gives: ``known`` maps names to capabilities."""
    names = artifacts.where(F.col("name").isin(*known))
    flags = [F.max(F.col("name").isin(*(n for n, c in known.items() if c == cap))).alias(f"can_{cap}") for cap in sorted(set(known.values()))]
    s = names.groupBy("scene_id").agg(F.count_distinct("name").alias("n_artifacts"), *flags)
    joined = scenes.select("scene_id").join(s, "scene_id", "left")
    return joined.select("scene_id", F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), *(F.coalesce(F.col(f"can_{c}"), F.lit(False)).alias(f"can_{c}") for c in sorted(set(known.values()))))


def scene_list(scenes: DataFrame, results: DataFrame, owner: int) -> DataFrame:
    """Scenes of one owner with their place from the newest (equal times by id) and whether they have results."""
    flag = results.select("scene_id").distinct().withColumn("has", F.lit(True))
    own = scenes.where(F.col("owner") == owner).join(flag, "scene_id", "left")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created"), "scene_id"))
    return own.select("scene_id", "owner", "created", F.coalesce("has", F.lit(False)).alias("has_results"), place.alias("place"))


def inspect_scene(scenes: DataFrame, least: int = 64) -> DataFrame:
    """What an upload is: absolute heights need a CRS; a side under ``least`` is refused."""
    small = (F.col("height") < least) | (F.col("width") < least)
    return scenes.select("scene_id", "height", "width", F.when(F.col("crs").isNotNull(), "absolute").otherwise("relative").alias("processing_path"), F.when(small, "IMAGE_TOO_SMALL").otherwise("OK").alias("status_code"))


def scene_results(scenes: DataFrame, jobs: DataFrame, stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each scene: latest job, its status, heights, artifacts."""
    return scenes.select("scene_id", "crs").join(jobs, "scene_id", "left").join(stats, "scene_id", "left").join(catalog, "scene_id", "left")


def apply_splits(samples: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with their split, and those that no split names."""
    return samples.join(splits, "stem"), samples.join(splits.select("stem"), "stem", "left_anti")


def stats_gate(mixed: DataFrame, stats: DataFrame) -> DataFrame:
    """Sources of a mix without verified statistics."""
    good = stats.where("verified").select("source")
    return mixed.select("source").distinct().join(good, "source", "left_anti").select("source", F.lit("STATS_MISSING").alias("status_code"))


# Names and marks by which a reference raster is known.
# Exact names of reference rasters, and what marks others in their stems.
REFERENCE_NAMES = ("reference.tif", "reference_dem.tif", "ref_dem.tif")
REFERENCE_MARKS = ("reference", "truth", "groundtruth", "ground_truth", "_gt")


def pick_reference(files: DataFrame) -> DataFrame:
    """The reference raster of each scene of ``files(scene_id, name, is_input)``: an exact name first, else the only marked one; several marked ones give none. A scene's own input is none; a scene without a reference has a null."""
    low = F.lower("name")
    fits = low.rlike(r"\.tiff?$") & ~F.coalesce("is_input", F.lit(False))
    stem = F.regexp_extract(low, r"^(.*)\.tiff?$", 1)
    exact, marked = fits & low.isin(*REFERENCE_NAMES), fits & stem.rlike("|".join(REFERENCE_MARKS))
    s = files.groupBy("scene_id").agg(F.min(F.when(exact, F.col("name"))).alias("exact"), F.count_if(marked).alias("n"), F.min(F.when(marked, F.col("name"))).alias("marked"))
    return s.select("scene_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("marked"))).alias("reference"), (F.col("exact").isNull() & (F.col("n") > 1)).alias("ambiguous"))


def tile_split(stems: DataFrame, shares: tuple[float, float], seed: int = 42) -> DataFrame:
    """train, val and test by a seeded shuffle: counts are rounded, test takes the rest.

    Ranks are counted in 4,096 cells of the hash and offset by the counts of earlier cells, so no task holds all stems.
    """
    h = F.xxhash64("stem", F.lit(seed))
    cells = stems.select("stem", h.alias("h"), F.pmod(F.shiftright(h, 48), F.lit(4096)).alias("cell"))
    n = cells.groupBy("cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = n.select("cell", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 4,096 rows
    at = F.row_number().over(Window.partitionBy("cell").orderBy("h", "stem")) - 1
    ranked = cells.withColumn("at", at).join(F.broadcast(offsets), "cell").withColumn("rank", F.col("at") + F.col("before"))
    first, second = F.rint(F.col("total") * shares[0]), F.rint(F.col("total") * shares[1])
    return ranked.select("stem", F.when(F.col("rank") < first, "train").when(F.col("rank") < first + second, "val").otherwise("test").alias("split"))


def mix_sources(sources: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """All samples with where they come from and the weight of one: a source's weight is shared among its samples. Names that repeat across sources are marked."""
    out = None
    for name, df in sources.items():
        part = df.select("sample", F.lit(name).alias("source"), F.lit(float(weights[name])).alias("source_weight"))
        out = part if out is None else out.unionByName(part)
    n = out.groupBy("source").agg(F.count("*").alias("n"))
    twice = out.groupBy("sample").agg(F.count_distinct("source").alias("n_sources")).where("n_sources > 1").select("sample", F.lit(True).alias("twice"))
    joined = out.join(F.broadcast(n), "source").join(twice, "sample", "left")  # one row for each source
    return joined.select("sample", "source", (F.col("source_weight") / F.col("n")).alias("weight"), F.coalesce("twice", F.lit(False)).alias("duplicate"))


def random_crop(px: DataFrame, height: int, width: int, size: int, seed: int = 42) -> DataFrame:
    """One window of each scene, the same for all bands, placed by a hash of its id; a smaller scene passes whole."""
    pick = lambda extent, salt: F.pmod(F.xxhash64("scene_id", F.lit(seed + salt)), F.lit(max(extent - size, 0) + 1)).cast("int")
    r0, c0 = pick(height, 0), pick(width, 1)
    inside = px.where((F.col("row") >= r0) & (F.col("row") < r0 + size) & (F.col("col") >= c0) & (F.col("col") < c0 + size))
    return inside.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


def _oldest(jobs: DataFrame, n: int) -> DataFrame:
    """The n first of ``jobs`` by created, then job_id: whole days, of the day that n ends in whole seconds, of its second by rank.

    Days, seconds of one day and jobs of one second are what a task sees.
    """
    when = F.unix_timestamp("created")
    rest, taken = jobs.withColumns({"day": F.floor(when / 86400), "second": F.pmod(when, F.lit(86400)), "left": F.lit(n)}), []
    for unit in ("day", "second"):
        counts = rest.groupBy(unit, "left").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(unit)))
        placed = rest.join(counts.select(unit, "c", "upto"), unit)
        taken.append(placed.where("upto <= left").select(*jobs.columns))
        rest = placed.where("upto > left and upto - c < left").withColumn("left", F.col("left") - (F.col("upto") - F.col("c"))).drop("c", "upto")
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("day", "second").orderBy("created", "job_id"))).where("rank <= left")
    return taken[0].unionByName(taken[1]).unionByName(ranked.select(*jobs.columns))


def job_retention(jobs: DataFrame, now: F.Column, ttl_hours: int = 24, keep: int = 500) -> DataFrame:
    """Jobs that go, of ``jobs(job_id, created, status)``: those past their time, and of the others the oldest ended ones while more than ``keep`` are left."""
    aged = jobs.withColumn("old", F.timestamp_diff("SECOND", F.col("created"), now) > ttl_hours * 3600)
    over = aged.where("not old").agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("over"))  # one row
    ended = aged.where("not old").where(F.col("status").isin("completed", "failed", "cancelled"))
    oldest = _oldest(ended, int(over.first()[0]))
    return aged.where("old").select("job_id", F.lit("expired").alias("why")).unionByName(oldest.select("job_id", F.lit("overflow").alias("why")))


def to_geojson(objects: DataFrame, places: int = 2) -> DataFrame:
    """One GeoJSON feature as text for each of ``objects(object_id, ring, conf, label)``; ring is an array of (x, y), closed in the output."""
    point = lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places))
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), point)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(F.col("object_id").alias("id"), F.round("conf", 3).alias("confidence"), F.col("label").alias("label"))
    return objects.select("object_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def markdown_table(rows: DataFrame, places: int = 3) -> DataFrame:
    """Lines of a Markdown table, numbered: head, rule, then one for each row in the order of the first column."""
    cells = [F.coalesce(F.format_string(f"%.{places}f", c) if t == "double" else F.col(c).cast("string"), F.lit("-")) for c, t in rows.dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(rows.columns[0])) + 1).alias("n"), line.alias("line"))  # a report: few rows
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(rows.columns)} |"), (1, f"|{'|'.join('-' for _ in rows.columns)}|")], "n int, line string")
    return head.unionByName(body)


def quality(checks: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """Faults of all checks as ``(scene_id, op, status_code)``: a fault of one scene leaves the others alone. ``strict`` raises if there is any."""
    out = None
    for op, df in checks.items():
        part = df.where("status_code <> 'OK'").select(F.col("scene_id").cast("long").alias("scene_id"), F.lit(op).alias("op"), "status_code")
        out = part if out is None else out.unionByName(part)
    if strict and (first := out.first()) is not None:
        raise ValueError(f"{first['op']}: {first['status_code']} in scene {first['scene_id']}")
    return out
