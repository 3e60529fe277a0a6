"""Registered queries of pixel and object maps: imaging, georeferencing, costs, damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import costs, damage, georef, imaging, joins, pixels, tiling
from gridspark.plans.registry import _CL, _SLOPE, BOXES, EV, _ok, _smooth, query
from gridspark.sources import fixtures as fx

RC = 's AS scene_id, r AS "row", c AS col'


@query(f"""WITH {EV}, x AS (SELECT s, r, c, CASE s % 3 WHEN 0 THEN truth / 100 WHEN 1 THEN truth ELSE truth * 10 END AS v FROM ev), st AS (SELECT s, min(v) AS lo, max(v) AS hi FROM x GROUP BY s)
SELECT {RC}, CASE WHEN hi > 255 THEN NULL WHEN hi <= 1 THEN round_even(v * 255, 0)::INT ELSE round_even(v, 0)::INT END AS u8, CASE WHEN hi > 255 THEN 'OUT_OF_RANGE' END AS problem FROM x JOIN st USING (s)""")
def b07_to_uint8(spark, d):
    s = F.col("scene_id") % 3
    px = fx.pixels(spark, d).withColumn("v", F.when(s == 0, F.col("truth") / 100).when(s == 1, F.col("truth")).otherwise(F.col("truth") * 10))
    return imaging.to_uint8(px, "v").select("scene_id", "row", "col", "u8", "problem")


@query(f"""WITH {EV}, x AS (SELECT s, r, c, CASE WHEN s % 2 = 1 THEN truth WHEN isnan(z) OR z = -9999 THEN 'nan'::DOUBLE ELSE z * 10 END AS v FROM ev),
st AS (SELECT s, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi, max(v) AS top FROM x WHERE NOT isnan(v) GROUP BY s)
SELECT {RC}, CASE WHEN isnan(v) THEN 0 WHEN lo >= 0 AND hi <= 255 AND top <= 255 THEN floor(least(greatest(v, 0), 255)) WHEN hi - lo < 1e-9 THEN 128 ELSE round_even(least(greatest((v - lo) / (hi - lo), 0), 1) * 255, 0) END::INT AS u8 FROM x JOIN st USING (s)""")
def b08_stretch_u8(spark, d):
    lost = F.isnan("z") | (F.col("z") == fx.NODATA)
    v = F.when(F.col("scene_id") % 2 == 1, F.col("truth")).when(lost, float("nan")).otherwise(F.col("z") * 10)
    return imaging.stretch_u8(fx.pixels(spark, d).withColumn("v", v), "v").select("scene_id", "row", "col", "u8")


@query(f"WITH {EV} SELECT {RC}, round((truth / 255 - 0.485) / 0.229, 6) AS n0, round((truth / 255 - 0.456) / 0.224, 6) AS n1, round((truth / 255 - 0.406) / 0.225, 6) AS n2 FROM ev")
def b13_imagenet_norm(spark, d):
    return fx.pixels(spark, d).select("scene_id", "row", "col", *(imaging.imagenet_norm(F.col("truth"), i).alias(f"n{i}") for i in range(3)))


@query(f"WITH {EV} SELECT {RC}, round(z * 0.15 - 9, 6) AS h, round(greatest(z * 0.15 - 9, 0), 6) AS h0 FROM ok")
def b14_affine_predict(spark, d):
    h = lambda clamp: pixels.affine_predict(F.col("z"), 0.15, -9.0, clamp)
    return _ok(spark, d).select("scene_id", "row", "col", h(False).alias("h"), h(True).alias("h0"))


@query(f"""WITH {EV}, st AS (SELECT s, min(z) AS lo, max(z) AS hi FROM ok GROUP BY s)
SELECT {RC}, round(greatest(truth * 0.4 - 8, 0), 6) AS height, round(truth / 100 * (hi - lo) + greatest(lo, 0), 6) AS depth FROM ev JOIN st USING (s)""")
def b15_scaled_height(spark, d):
    stats = pixels.tile_stats4(fx.pixels(spark, d), fx.NODATA)
    px = fx.pixels(spark, d).join(stats, "scene_id")
    return px.select("scene_id", "row", "col", imaging.scaled_height(F.col("truth") - 20, 0.4).alias("height"), imaging.depth_from_stats(F.col("truth") / 100, F.col("ln_lo"), F.col("ln_range")).alias("depth"))


def soft(column: str, n: int) -> str:
    """SQL of the softmax of 20 times the first n components of an embedding, as list p."""
    return f"e AS (SELECT vec_id, {column}, list_transform(embedding[1:{n}], lambda v: v::DOUBLE * 20) AS l FROM embeddings), x AS (SELECT vec_id, {column}, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM e), pr AS (SELECT vec_id, {column}, list_transform(x, lambda v: v / list_sum(x)) AS p FROM x)"


def probs(spark, d, n: int) -> DataFrame:
    """``(vec_id, label, p)``: probabilities of n classes from the first components of each embedding."""
    logits = F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double") * 20)
    return fx.table(spark, d, "embeddings").select("vec_id", "label", pixels.softmax(logits).alias("p"))


@query(f"""WITH {soft('label', 6)}, pal(k, red, green, blue) AS (VALUES {", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(imaging.PALETTE))})
SELECT vec_id, label, red, green, blue, floor(least(greatest(list_max(p) * 255, 153), 255))::INT AS alpha FROM pr LEFT JOIN pal ON k = label""")
def b18_class_rgba(spark, d):
    return imaging.class_rgba(probs(spark, d, 6).withColumn("conf", F.array_max("p"))).select("vec_id", "label", "red", "green", "blue", "alpha")


@query(f"WITH {EV} SELECT {RC}, 500000 + 20 * s + (c + 0.5) * 0.5 AS x, 5600000 - (r + 0.5) * 0.5 AS y, r::BIGINT AS back_row, c::BIGINT AS back_col FROM ev")
def b19_world_to_pixel(spark, d):
    px = fx.pixels(spark, d).join(fx.scenes(spark, d), "scene_id")
    grid = [F.col(c) for c in ("x0", "y0", "res")]
    x, y = pixels.pixel_to_world(F.col("row"), F.col("col"), *grid, centre=True)
    row, col = georef.world_to_pixel(F.col("x"), F.col("y"), *grid)
    return px.select("scene_id", "row", "col", "x0", "y0", "res", x.alias("x"), y.alias("y")).select("scene_id", "row", "col", "x", "y", row.alias("back_row"), col.alias("back_col"))


_PROFILES = "pf AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'geographic' WHEN 1 THEN 'projected' WHEN 2 THEN 'projected' END AS kind, 0.0001 * (s_suppkey % 5) AS a, -0.0002::DOUBLE AS e, (s_suppkey % 90)::DOUBLE AS f, CASE WHEN s_suppkey % 4 = 1 THEN 0.3048::DOUBLE END AS unit FROM supplier)"


def _profiles(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "geographic").when(k % 4 < 3, "projected")
    return fx.table(spark, d, "supplier").select(k.alias("k"), kind.alias("kind"), (k % 5 * 0.0001).alias("a"), F.lit(-0.0002).alias("e"), (k % 90).cast("double").alias("f"), F.when(k % 4 == 1, 0.3048).alias("unit"))


@query(f"""WITH {_PROFILES}, m AS (SELECT k, CASE WHEN a = 0 OR kind IS NULL THEN NULL WHEN kind = 'geographic' THEN abs(a) * 111320 * greatest(cos(radians(f)), 0) ELSE abs(a) * unit END AS width_m, CASE WHEN a = 0 OR kind IS NULL THEN NULL WHEN kind = 'geographic' THEN abs(e) * 111320 ELSE abs(e) * unit END AS height_m FROM pf)
SELECT k, round(width_m, 6) AS width_m, round(height_m, 6) AS height_m, round(greatest(width_m, height_m), 6) AS gsd_m FROM m""")
def b20_pixel_size(spark, d):
    w, h = georef.pixel_size_m(*(F.col(c) for c in ("kind", "a", "e", "f", "unit")))
    return _profiles(spark, d).select("k", w.alias("width_m"), h.alias("height_m")).withColumn("gsd_m", F.greatest("width_m", "height_m"))


@query("""SELECT k, crs IS NOT NULL OR NOT ident AS ok, CASE WHEN crs IS NOT NULL THEN 'CRS present: ' || crs WHEN NOT ident THEN 'No CRS but non-identity transform' ELSE 'No CRS, identity transform' END AS reason
FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'EPSG:4326' END AS crs, s_suppkey % 2 = 0 AS ident FROM supplier)""")
def b21_georeferenced(spark, d):
    k = F.col("s_suppkey")
    ok, reason = georef.georeferenced(F.when(k % 3 == 0, "EPSG:4326"), k % 2 == 0)
    return fx.table(spark, d, "supplier").select(k.alias("k"), ok.alias("ok"), reason.alias("reason"))


_GRID = f"{EV}, tg AS (SELECT s, ty, tx, least(16, 25 - ty * 16) AS h, least(16, 40 - tx * 16) AS w FROM (SELECT DISTINCT s FROM ev), (VALUES (0), (1)) a(ty), (VALUES (0), (1), (2)) b(tx))"


@query(f"WITH {_GRID} SELECT s AS scene_id, ty, tx, 500000 + 20 * s + tx * 16 * 0.5::DOUBLE AS west, 5600000 - ty * 16 * 0.5::DOUBLE AS north, 500000 + 20 * s + (tx * 16 + w) * 0.5::DOUBLE AS east, 5600000 - (ty * 16 + h) * 0.5::DOUBLE AS south FROM tg")
def b22_window_bounds(spark, d):
    grid = tiling.tile_grid(fx.scenes(spark, d), 16).join(fx.scenes(spark, d).select("scene_id", "x0", "y0", "res"), "scene_id")
    bounds = georef.window_bounds(F.col("x0"), F.col("y0"), F.col("res"), F.col("ty") * 16, F.col("tx") * 16, F.col("h"), F.col("w"))
    return grid.select("scene_id", "ty", "tx", *(v.alias(k) for k, v in bounds.items()))


@query(f"""WITH {EV}, m AS (SELECT s, r, CASE WHEN mi THEN 39 - c ELSE c END AS c, z, mi FROM ok, (VALUES (false), (true)) f(mi)),
o AS (SELECT s, 0 AS k, mi, r, c, z FROM m UNION ALL SELECT s, 1, mi, 39 - c, r, z FROM m UNION ALL SELECT s, 2, mi, 24 - r, 39 - c, z FROM m UNION ALL SELECT s, 3, mi, c, 24 - r, z FROM m)
SELECT s AS scene_id, k, mi AS mirrored, r AS "row", c AS col, round(z, 6) AS z FROM o""")
def b23_orientations(spark, d):
    px = _ok(spark, d).select("scene_id", "row", "col", "z")
    return pixels.union_all([imaging.orientation(px, k, m, fx.HEIGHT, fx.WIDTH).select("scene_id", F.lit(k).alias("k"), F.lit(m).alias("mirrored"), "row", "col", "z") for k in range(4) for m in (False, True)])


@query(f"""WITH {EV}, g AS (SELECT s, r, c, CASE WHEN r > 24 THEN 48 - r ELSE r END AS fr, CASE WHEN c > 39 THEN 78 - c ELSE c END AS fc FROM (SELECT DISTINCT s FROM ev), (SELECT unnest(range(32))::INT AS r), (SELECT unnest(range(48))::INT AS c))
SELECT g.s AS scene_id, g.r AS "row", g.c AS col, round(z, 6) AS z, g.r > 24 OR g.c > 39 AS padded FROM g JOIN ev ON ev.s = g.s AND ev.r = fr AND ev.c = fc""")
def b25_pad_tile(spark, d):
    return imaging.pad_tile(fx.pixels(spark, d), fx.HEIGHT, fx.WIDTH, 32, 48)


@query(f"WITH {_GRID} SELECT s AS scene_id, ty, tx, printf('tile_r%03d_c%03d', ty, tx) AS name FROM tg")
def b28_tile_names(spark, d):
    return tiling.tile_grid(fx.scenes(spark, d), 16).select("scene_id", "ty", "tx", georef.tile_name(F.col("ty"), F.col("tx")).alias("name"))


@query(f"WITH {BOXES} SELECT id, substr(sha256(printf('%.6f,%.6f,%.6f,%.6f,', west, south, east, north) || CASE WHEN id % 3 = 0 THEN 'None' ELSE 'EPSG:4326' END), 1, 8) AS key FROM boxes")
def b29_footprint_keys(spark, d):
    """Keys over all four bounds and the CRS."""
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    return fx.footprints(spark, d).select("id", georef.footprint_key(*box, F.when(F.col("id") % 3 != 0, "EPSG:4326")).alias("key"))


@query(f"WITH {EV}, sc AS (SELECT DISTINCT s FROM ev) SELECT s AS scene_id, CASE WHEN s % 5 <> 4 THEN 'EPSG:32632' END AS scene_crs, 'EPSG:32632' AS dem_crs, CASE WHEN s % 5 <> 4 THEN true END AS same_crs, CASE WHEN s % 5 <> 4 THEN 0.5::DOUBLE END AS gsd_m FROM sc")
def b30_provenance(spark, d):
    return georef.provenance(fx.scenes(spark, d), "EPSG:32632").select("scene_id", "provenance.*")


@query(f"WITH {EV} SELECT {RC}, round(z + 431.25, 6) AS dsm FROM ok")
def b31_anchor_constant(spark, d):
    return georef.anchor_constant(_ok(spark, d), 431.25).select("scene_id", "row", "col", "dsm")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'absolute' WHEN s_suppkey % 4 > 1 THEN 'anchored-constant' ELSE 'relative' END AS kind FROM supplier")
def b32_output_type(spark, d):
    k = F.col("s_suppkey")
    constant = F.when(k % 4 == 1, float("nan")).when(k % 4 > 1, k.cast("double"))
    return fx.table(spark, d, "supplier").select(k.alias("k"), georef.output_type(k % 3 == 0, constant).alias("kind"))


_CELLS = f"{soft('label', 6)}, ce AS (SELECT vec_id, p, list_max(p) AS conf, (vec_id % 40)::DOUBLE AS slope, (vec_id % 10) / 10.0 AS step, vec_id % 4 AS cls, vec_id % 5 AS dmg, list_position(p, list_max(p)) - 1 AS top FROM pr)"
_SOFTC = "CASE WHEN cls >= 2 THEN 1e9 WHEN cls = 1 THEN 1.5 * (1 + 4 * (slope / 25) ** 2 + 3 * (step / 0.5) ** 2) ELSE 1 + 4 * (slope / 25) ** 2 + 3 * (step / 0.5) ** 2 END"
_SEMC = "conf * (1000 * p[1] + 4 * p[2] + 0.65 * p[3] + 1000 * p[4] + p[5] + 1.5 * p[6]) + (1 - conf) * 1.5"
_DMGC = "CASE dmg WHEN 2 THEN 3.0 WHEN 3 THEN 20.0 WHEN 4 THEN 50.0 ELSE 1.0 END"


def _cells(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return probs(spark, d, 6).select("vec_id", "p", F.array_max("p").alias("conf"), (v % 40).cast("double").alias("slope"), (v % 10 / 10.0).alias("step"), (v % 4).alias("cls"), (v % 5).alias("dmg"))


@query(f"WITH {_CELLS} SELECT vec_id, round({_SOFTC}, 6) AS cost FROM ce")
def b33_soft_cost_all(spark, d):
    """Every class from 2 up is blocked."""
    return _cells(spark, d).select("vec_id", costs.soft_cost(F.col("slope"), F.col("step"), F.col("cls"), 25.0, 0.5).alias("cost"))


@query(f"WITH {_CELLS} SELECT vec_id, round({_SEMC}, 6) AS cost, p[1] >= 0.9 OR p[4] >= 0.9 AS blocked FROM ce")
def b34_semantic_cost(spark, d):
    cost, blocked = costs.semantic_cost(F.col("p"), F.col("conf"))
    return _cells(spark, d).select("vec_id", cost.alias("cost"), blocked.alias("blocked"))


@query(f"WITH {_CELLS} SELECT vec_id, round({_DMGC}, 6)::DOUBLE AS cost, dmg = 4 AS blocked FROM ce")
def b35_damage_cost(spark, d):
    cost, blocked = costs.damage_cost(F.col("dmg"))
    return _cells(spark, d).select("vec_id", cost.alias("cost"), blocked.alias("blocked"))


@query(f"WITH {_CELLS} SELECT vec_id, round(ln({_SOFTC}) + ln({_SEMC}) + ln({_DMGC}), 6) AS ln_cost, cls >= 2 OR p[1] >= 0.9 OR p[4] >= 0.9 OR dmg = 4 AS blocked FROM ce")
def b36_combined_cost(spark, d):
    cells = _cells(spark, d)
    geo = costs.soft_cost(F.col("slope"), F.col("step"), F.col("cls"), 25.0, 0.5), F.col("cls") >= 2
    cost, blocked = costs.combined([geo, costs.semantic_cost(F.col("p"), F.col("conf")), costs.damage_cost(F.col("dmg"))])
    return cells.select("vec_id", F.ln(cost).alias("ln_cost"), blocked.alias("blocked"))


@query(f"""WITH {_CELLS} SELECT vec_id, CASE WHEN dmg = 4 THEN 'destroyed' WHEN dmg = 3 THEN 'major' WHEN cls = 2 OR p[1] >= 0.7 OR p[4] >= 0.7 THEN 'blocked' WHEN top = 2 THEN 'road' WHEN top = 4 AND cls = 0 THEN 'ground' WHEN top = 1 THEN 'vegetation' WHEN cls = 1 THEN 'caution' ELSE 'other' END AS risk FROM ce""")
def b37_risk_class(spark, d):
    return _cells(spark, d).select("vec_id", costs.risk_class(F.col("cls"), F.col("p"), F.col("dmg")).alias("risk"))


@query(f"""WITH {EV}, st AS (SELECT s, max(z) - min(z) AS span, CASE WHEN s % 3 = 0 THEN s % 30 + 1.5 END AS rmse, s % 5 <> 4 AS geo FROM ok GROUP BY s),
q AS (SELECT *, CASE WHEN rmse IS NOT NULL AND span > 1e-6 THEN round_even(least(greatest(100 * (1 - rmse / span), 5), 99), 0)::INT END AS percent FROM st)
SELECT s AS scene_id, percent, CASE WHEN percent >= 85 THEN 'high' WHEN percent >= 60 THEN 'medium' WHEN percent IS NOT NULL THEN 'low' WHEN geo THEN 'medium' ELSE 'low' END AS level, round(greatest(span / 65535 / 2, 1e-4), 6) AS precision_m FROM q""")
def b38_elevation_confidence(spark, d):
    s = F.col("scene_id")
    stats = _ok(spark, d).groupBy("scene_id").agg((F.max("z") - F.min("z")).alias("span")).select(s, "span", F.when(s % 3 == 0, s % 30 + 1.5).alias("rmse"), F.when(s % 5 != 4, 0.5).alias("gsd_m"))
    return georef.elevation_confidence(stats)


_DEC = f"{soft('label', 4)}, sh AS (SELECT vec_id, label, list_transform(p, lambda v: v / (list_sum(p) + 1e-8)) AS q FROM pr), de AS (SELECT vec_id, label, list_position(q, list_max(q)) AS lab, list_max(q) AS conf, list_max(q) - list_sort(q, 'DESC')[2] < 0.15 OR list_max(q) < 0.4 AS review FROM sh)"


@query(f"WITH {_DEC} SELECT vec_id, lab::INT AS damage, round(conf, 6) AS conf, review FROM de")
def b39_damage_decision(spark, d):
    label, conf, review = damage.damage_decision(F.col("p"))
    return probs(spark, d, 4).select("vec_id", label.alias("damage"), conf.alias("conf"), review.alias("review"))


@query("""WITH b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 900)::INT AS r0, (s_suppkey * 53 % 950)::INT AS c0, (s_suppkey % 170 + 3)::INT AS h, (s_suppkey % 90 + 5)::INT AS w FROM supplier),
q AS (SELECT id, greatest(0, r0 - greatest(trunc(h * 0.25), 16)) AS a, least(1000, r0 + h + greatest(trunc(h * 0.25), 16)) AS b, greatest(0, c0 - greatest(trunc(w * 0.25), 16)) AS e, least(1000, c0 + w + greatest(trunc(w * 0.25), 16)) AS f FROM b),
m AS (SELECT *, CASE WHEN b - a < 64 THEN floor((64 - (b - a)) / 2) + 1 ELSE 0 END AS mr, CASE WHEN f - e < 64 THEN floor((64 - (f - e)) / 2) + 1 ELSE 0 END AS mc FROM q)
SELECT id, greatest(a - mr, 0)::INT AS row0, least(b + mr, 1000)::INT AS row1, greatest(e - mc, 0)::INT AS col0, least(f + mc, 1000)::INT AS col1 FROM m""")
def b42_crop_context(spark, d):
    k = F.col("s_suppkey")
    b = fx.table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 900).cast("int").alias("r0"), (k * 53 % 950).cast("int").alias("c0"), (k % 170 + 3).cast("int").alias("h"), (k % 90 + 5).cast("int").alias("w"))
    box = damage.crop_context(F.col("r0"), F.col("c0"), F.col("r0") + F.col("h"), F.col("c0") + F.col("w"), 1000, 1000)
    return b.select("id", *(v.cast("int").alias(n) for n, v in box.items()))


@query("SELECT s_suppkey AS id, round(0.35 * (s_suppkey % 10) / 10 + 0.25 * (s_suppkey % 7) / 7 + 0.2 * (s_suppkey % 3) / 3 + 0.2 * (1 - least(coalesce((s_suppkey % 5)::DOUBLE / nullif(s_suppkey % 11, 0), 1.0) / 0.5, 1.0)), 6) AS conf FROM supplier")
def b43_reconstruct_conf(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), damage.reconstruct_conf(k % 10 / 10, k % 7 / 7, k % 3 / 3, (k % 5).cast("double"), (k % 11).cast("double")).alias("conf"))


@query(f"""WITH {EV}, t AS (SELECT s, r // 8 AS tr, c // 8 AS tc, (r % 8) * 8 + c % 8 AS pos, z FROM ev)
SELECT s AS scene_id, tr, tc, count(*) AS n, count(*) = 64 AND sum(isnan(z)::INT) = 0 AS ok, round(sum((pos + 1) * CASE WHEN isnan(z) THEN 0 ELSE z::FLOAT::DOUBLE END), 3) AS weighed FROM t GROUP BY ALL""", 3)
def b44_model_input(spark, d):
    """Each tensor, weighed by place, so that a wrong order of its values shows."""
    t = imaging.model_input(fx.pixels(spark, d), 8)
    full = F.col("n") == 64
    p = t.select("scene_id", "tr", "tc", "ok", F.size("tensor").alias("n"), F.posexplode("tensor").alias("i", "v"))
    # in a border tile of one row the places are those of that row
    return p.groupBy("scene_id", "tr", "tc", "ok", "n").agg(F.sum((F.col("i") + 1) * F.when(F.isnan("v"), 0.0).otherwise(F.col("v").cast("double"))).alias("weighed"))


# --- C: joins -----------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, good AS (SELECT s FROM ev WHERE s % 4 <> 3 GROUP BY s) SELECT {RC}, round(z + truth * 3, 6) AS dsm FROM ok JOIN good USING (s)")
def c03_anchor_dem(spark, d):
    """Scenes whose number leaves 3 by 4 have holes in their DEM and are refused."""
    dem = fx.pixels(spark, d).where("scene_id % 4 <> 3 or col % 7 <> 0").select("scene_id", "row", "col", (F.col("truth") * 3).alias("z"))
    return georef.anchor_dem(_ok(spark, d).select("scene_id", "row", "col", "z"), dem)[0]


@query(f"""WITH {EV}, g AS (SELECT s, CASE WHEN s % 4 = 3 AND c % 7 = 0 THEN NULL ELSE truth * 3 END AS ground FROM ok)
SELECT s AS scene_id, round(min(ground), 6) AS dem_min, round(avg(ground), 6) AS dem_mean, round(max(ground), 6) AS dem_max, count(*) FILTER (ground IS NULL) AS uncovered, CASE WHEN count(*) FILTER (ground IS NULL) > 0 THEN 'DEM_COVERAGE_INSUFFICIENT' ELSE 'OK' END AS status_code FROM g GROUP BY s""")
def c03_dem_stats(spark, d):
    dem = fx.pixels(spark, d).where("scene_id % 4 <> 3 or col % 7 <> 0").select("scene_id", "row", "col", (F.col("truth") * 3).alias("z"))
    return georef.anchor_dem(_ok(spark, d).select("scene_id", "row", "col", "z"), dem)[1]


@query(f"WITH {_DEC} SELECT s_suppkey AS object_id, lab::INT AS damage, round(conf, 6) AS conf FROM supplier LEFT JOIN de ON vec_id = s_suppkey * 3")
def c09_objects_with_damage(spark, d):
    label, conf, _ = damage.damage_decision(F.col("p"))
    found = probs(spark, d, 4).select(F.col("vec_id"), label.alias("damage"), conf.alias("conf"))
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("object_id")).join(found, F.col("object_id") * 3 == F.col("vec_id"), "left").select("object_id", "damage", "conf")


_VEH = "v(vehicle, ms, mst, mr) AS (VALUES ('truck', 88.0::DOUBLE, 90.0::DOUBLE, 30.0::DOUBLE), ('atv', 89.5::DOUBLE, 120.0::DOUBLE, 40.0::DOUBLE))"
_PASS = f"""{_SLOPE}, sl AS (SELECT s, r, c, degrees(atan(sqrt((gy / 0.5) ** 2 + (gx / 0.5) ** 2))) AS slope FROM gr),
st AS (SELECT a.s, a.r, a.c, max(b.z) - min(b.z) AS step FROM k a JOIN k b ON a.s = b.s AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.s, a.r, a.c),
o AS (SELECT a.s, a.r, a.c, greatest(0, least(24, a.r + y.d)) AS nr, greatest(0, least(39, a.c + x.d)) AS nc FROM k a, (SELECT unnest(range(-2, 3)) AS d) y, (SELECT unnest(range(-2, 3)) AS d) x),
ro AS (SELECT o.s, o.r, o.c, stddev_pop(b.z) AS rough FROM o JOIN k b ON b.s = o.s AND b.r = o.nr AND b.c = o.nc GROUP BY ALL), {_VEH},
pc AS (SELECT s, vehicle, r, c, slope, step, rough, CASE WHEN slope > ms OR step > mst OR rough > mr THEN 2 WHEN slope > 0.75 * ms OR step > 0.75 * mst OR rough > 0.75 * mr THEN 1 ELSE 0 END AS cls FROM sl JOIN st USING (s, r, c) JOIN ro USING (s, r, c), v)"""


def _passable(spark, d) -> DataFrame:
    vehicles = spark.createDataFrame([("truck", 88.0, 90.0, 30.0), ("atv", 89.5, 120.0, 40.0)], "vehicle string, max_slope double, max_step double, max_rough double")
    return costs.classify_passability(_smooth(spark, d), vehicles, fx.HEIGHT, fx.WIDTH, 0.5)


@query(f"WITH {_PASS} SELECT s AS scene_id, vehicle, r AS \"row\", c AS col, round(slope, 6) AS slope, round(step, 6) AS step, round(rough, 6) AS rough, cls FROM pc")
def c10_per_vehicle(spark, d):
    """Grids of each vehicle, with the passability of E4."""
    return _passable(spark, d)


@query(f"WITH {_PASS} SELECT s AS scene_id, vehicle, round(avg((cls = 0)::INT) * 100, 6) AS free_pct, round(avg((cls = 1)::INT) * 100, 6) AS caution_pct, round(avg((cls = 2)::INT) * 100, 6) AS blocked_pct FROM pc GROUP BY ALL")
def d33_passability_pct(spark, d):
    return costs.passability_pct(_passable(spark, d))


@query(f"WITH {_CL}, f AS (SELECT s, r // 2 AS r, c // 2 AS c, avg(z) AS z FROM k WHERE r < 24 GROUP BY ALL), n AS (SELECT s, r, c, z, lag(z) OVER (PARTITION BY s, c ORDER BY r) AS u, lead(z) OVER (PARTITION BY s, c ORDER BY r) AS o, lag(z) OVER (PARTITION BY s, r ORDER BY c) AS l, lead(z) OVER (PARTITION BY s, r ORDER BY c) AS g FROM f), t AS (SELECT s, r, c, degrees(atan(sqrt((coalesce((o - u) / 2, o - z, z - u, 0) / 2) ** 2 + (coalesce((g - l) / 2, g - z, z - l, 0) / 2) ** 2))) AS slope FROM n) SELECT s AS scene_id, 'any' AS vehicle, r AS \"row\", c AS col, round(slope, 6) AS slope, CASE WHEN slope > 85 THEN 2 WHEN slope > 63.75 THEN 1 ELSE 0 END AS cls FROM t")
def e04_classify_passability(spark, d):
    """Without a ground distance: slope alone, on blocks of 2 x 2."""
    vehicles = spark.createDataFrame([("any", 85.0, 0.0, 0.0)], "vehicle string, max_slope double, max_step double, max_rough double")
    return costs.classify_passability(_smooth(spark, d), vehicles, fx.HEIGHT, fx.WIDTH, None, cap=20).select("scene_id", "vehicle", "row", "col", "slope", "cls")


_POINTS = "pt AS (SELECT o_orderkey AS point_id, o_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (o_custkey % 25)::INT AS tr, (o_orderkey % 40)::INT AS tc FROM orders WHERE o_orderstatus = 'P')"


def _points(spark, d) -> DataFrame:
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    o = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").crossJoin(F.broadcast(n))  # one row
    return o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % F.col("n_scenes")).alias("scene_id"), (F.col("o_custkey") % 25).cast("int").alias("trow"), (F.col("o_orderkey") % 40).cast("int").alias("tcol"))


@query(f"WITH {EV}, {_POINTS}, m AS (SELECT point_id, r, c, (r - tr) ** 2 + (c - tc) ** 2 AS d2 FROM pt JOIN ev USING (s) WHERE cls = 6) SELECT point_id, r AS \"row\", c AS col, d2::BIGINT AS d2 FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d2, r, c) = 1")
def c20_nearest_reachable(spark, d):
    return costs.nearest_reachable(fx.pixels(spark, d).where("cls = 6").select("scene_id", "row", "col"), _points(spark, d))


@query(f"""WITH {EV}, {_POINTS}, m AS (SELECT point_id, r, c, greatest(abs(r - tr), abs(c - tc), 1) AS ring, (r - tr) ** 2 + (c - tc) ** 2 AS d2 FROM pt JOIN ev USING (s) WHERE cls = 9 AND abs(r - tr) <= 2 AND abs(c - tc) <= 2),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ring, d2, r, c) = 1) SELECT point_id, r AS "row", c AS col, d2::BIGINT AS d2 FROM pt LEFT JOIN b USING (point_id)""")
def c21_nearest_standable(spark, d):
    return costs.nearest_standable(fx.pixels(spark, d).where("cls = 9").select("scene_id", "row", "col"), _points(spark, d), radius=2)


# --- D: damage and classes ----------------------------------------------------------------------------------------


@query(f"WITH {soft('label', 6)}, t AS (SELECT vec_id // 20 AS s, list_position(p, list_max(p)) - 1 AS lab, list_max(p) AS conf FROM pr) SELECT s AS scene_id, {', '.join(f'round(avg((lab = {i})::INT), 6) AS class_{i}' for i in range(6))}, round(avg(conf), 6) AS mean_conf, round(avg((conf < 0.7)::INT), 6) AS low_conf FROM t GROUP BY s")
def d31_semantic_summary(spark, d):
    px = probs(spark, d, 6)
    label, conf = pixels.probs_to_labels(F.col("p"))
    return damage.semantic_summary(px.select(F.floor(F.col("vec_id") / 20).alias("scene_id"), label.alias("label"), conf.alias("conf")), 6)


@query(f"WITH {_DEC} SELECT vec_id // 100 AS scene_id, {', '.join(f'count(*) FILTER (lab = {i + 1}) AS {n}' for i, n in enumerate(('no_damage', 'minor_damage', 'major_damage', 'destroyed')))}, count(*) FILTER (review) AS n_review, count(*) FILTER (vec_id % 9 = 0) AS n_recovered, round(avg(conf), 6) AS mean_conf FROM de GROUP BY 1")
def d32_damage_summary(spark, d):
    label, conf, review = damage.damage_decision(F.col("p"))
    objects = probs(spark, d, 4).select(F.floor(F.col("vec_id") / 100).alias("scene_id"), label.alias("label"), conf.alias("conf"), review.alias("review"), (F.col("vec_id") % 9 == 0).alias("recovered"))
    return damage.damage_summary(objects, "scene_id")


@query(f"""WITH {_DEC}, n AS (SELECT label AS object_id, lab, count(*) AS n, avg(conf) AS conf, sum(count(*)) OVER (PARTITION BY label) AS total FROM de GROUP BY label, lab), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY n DESC, lab) = 1)
SELECT object_id, CASE WHEN n >= 0.25 * total THEN lab END::INT AS label, round(CASE WHEN n >= 0.25 * total THEN conf END, 6) AS conf, round(n / total, 6) AS share FROM b""")
def d41_damage_vote(spark, d):
    label, conf, _ = damage.damage_decision(F.col("p"))
    return damage.damage_vote(probs(spark, d, 4).select(F.col("label").alias("object_id"), label.alias("label"), conf.alias("conf")))


@query(f"""WITH {soft('label', 4)}, g AS (SELECT label AS object_id, {', '.join(f'avg(p[{i}]) FILTER (vec_id % 3 = 0 AND label % 4 <> 0) AS a{i}, avg(p[{i}]) FILTER (vec_id % 2 = 0) AS m{i}' for i in range(1, 5))}, count(*) FILTER (vec_id % 3 = 0 AND label % 4 <> 0) AS n_inside FROM pr GROUP BY label)
SELECT object_id, n_inside, {', '.join(f'round(CASE WHEN n_inside > 0 THEN a{i} ELSE m{i} END, 6) AS p{i}' for i in range(1, 5))} FROM g""")
def d42_object_probs(spark, d):
    px = probs(spark, d, 4).select(F.col("label").alias("object_id"), ((F.col("vec_id") % 3 == 0) & (F.col("label") % 4 != 0)).alias("inside"), (F.col("vec_id") % 2 == 0).alias("central"), F.col("p").alias("probs"))
    return damage.object_probs(px, 4).select("object_id", "n_inside", *(F.col("probs")[i].alias(f"p{i + 1}") for i in range(4)))


@query(f"""WITH {EV}, n AS (SELECT s AS path_id, r * 40 + c AS seq, r, c, truth AS slope, cls % 2 AS cls FROM ev WHERE r % 5 = 0),
g AS (SELECT *, sqrt((lead(r) OVER w - r) ** 2 + (lead(c) OVER w - c) ** 2) * 0.5 AS len FROM n WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT path_id, round(sum(len), 6) AS length_m, max(slope) AS max_slope, round(avg((cls = 1)::INT), 6) AS caution, round(sum(len / (8 * greatest(1 - slope / 60, 0.15))), 6) AS time_s, count(*) AS n FROM g GROUP BY path_id""")
def d40_path_stats(spark, d):
    px = fx.pixels(spark, d).where("row % 5 = 0")
    return costs.path_stats(px.select(F.col("scene_id").alias("path_id"), (F.col("row") * 40 + F.col("col")).alias("seq"), "row", "col", F.col("truth").alias("slope"), (F.col("cls") % 2).alias("cls")), 0.5, 8.0, 60.0)
