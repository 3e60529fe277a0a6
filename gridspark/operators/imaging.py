"""Maps between heights and images: 8-bit conversion, normalising, palettes, padding, tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rasters import clamp, finite
from gridspark.operators.quantiles import percentiles

# Channel means and deviations of the usual image statistics.
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)
# Display colours of the project classes building, vegetation, road, water, ground, other.
PALETTE = [(231, 76, 60), (39, 174, 96), (127, 140, 141), (52, 152, 219), (194, 157, 110), (149, 165, 166)]


def to_uint8(px: DataFrame, column: str = "z") -> DataFrame:
    """``px`` with ``u8`` and ``problem``: values of a scene within [0, 1] are scaled by 255, within [0, 255] rounded (halves to even).

    A scene with a value that is not finite, or beyond [0, 255], is refused: u8 is null and the problem says why.
    """
    v = F.col(column)
    stats = px.groupBy("scene_id").agg(F.count_if(~finite(v)).alias("bad"), F.min(F.when(finite(v), v)).alias("lo"), F.max(F.when(finite(v), v)).alias("hi"))
    problem = F.when(F.col("bad") > 0, "NON_FINITE").when((F.col("lo") < 0) | (F.col("hi") > 255), "OUT_OF_RANGE")
    u8 = F.when(problem.isNotNull(), F.lit(None)).when(F.col("hi") <= 1, F.rint(v * 255)).otherwise(F.rint(v)).cast("int")
    return px.join(stats, "scene_id").select(*px.columns, u8.alias("u8"), problem.alias("problem"))


def stretch_u8(px: DataFrame, column: str = "z") -> DataFrame:
    """``px`` with ``u8``: 8-bit content is kept, wider ranges are stretched between the scene's 2nd and 98th percentile, a flat scene is 128, a value that is not finite 0."""
    v = F.when(finite(F.col(column)), F.col(column))
    stats = px.groupBy("scene_id").agg(F.max(v).alias("top")).join(percentiles(px.withColumn("v", v), ["scene_id"], "v", [0.02, 0.98]).drop("n"), "scene_id", "left")
    lo, hi = F.col("p")[0], F.col("p")[1]
    plain = (lo >= 0) & (hi <= 255) & (F.col("top") <= 255)
    unit = clamp(F.try_divide(F.col(column) - lo, hi - lo), 0.0, 1.0)
    u8 = F.when(~finite(F.col(column)), 0).when(plain, F.floor(clamp(F.col(column), 0.0, 255.0))).when(hi - lo < 1e-9, 128).otherwise(F.rint(unit * 255)).cast("int")
    return px.join(stats, "scene_id").select(*px.columns, u8.alias("u8"))


def imagenet_norm(u8: F.Column, channel: int) -> F.Column:
    return (u8 / 255 - IMAGE_MEAN[channel]) / IMAGE_STD[channel]


def scaled_height(raw: F.Column, scale: F.Column | float) -> F.Column:
    """Metres from raw depth, never below 0."""
    return F.greatest(raw * scale, F.lit(0.0))


def depth_from_stats(unit: F.Column, ln_lo: F.Column, ln_range: F.Column, eps: float = 1e-3) -> F.Column:
    """Metres of a value in [0, 1] from the logarithms of its tile's low and range."""
    return unit * (F.exp(ln_range) - eps) + (F.exp(ln_lo) - eps)


def class_rgba(px: DataFrame, label: str = "label", confidence: str = "conf") -> DataFrame:
    """Colour of each class, as opaque as it is certain: alpha from 153 to 255. A class without a colour gives null."""
    colours = F.array(*(F.array(*(F.lit(x) for x in c)) for c in PALETTE))
    rgb = F.try_element_at(colours, F.col(label) + 1)
    return px.select("*", rgb[0].alias("red"), rgb[1].alias("green"), rgb[2].alias("blue"), F.floor(clamp(F.col(confidence) * 255, 153.0, 255.0)).cast("int").alias("alpha"))


def _reflected(i: int, extent: int, pad: int) -> int:
    """Source index of a padded place: mirrored without repeating the border, or clamped to it if the pad is as long as the line."""
    if pad >= extent:
        return min(i, extent - 1)
    return i if i < extent else 2 * (extent - 1) - i


def _places(at: str, extent: int, to: int) -> F.Column:
    """The places along a padded line that show the pixel ``at``; null for a pixel outside the tile."""
    shown = [[] for _ in range(extent)]
    for i in range(to):
        shown[_reflected(i, extent, to - extent)].append(i)
    return F.get(F.array(*(F.array(*map(F.lit, x)).cast("array<int>") for x in shown)), F.col(at))


def pad_tile(px: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Tiles of ``height`` by ``width`` padded below and right by reflection; each pixel goes to all places that show it, so nothing is joined."""
    put = px.select("scene_id", "col", "z", F.explode(_places("row", height, to_height)).alias("to_row")).select("scene_id", "z", F.col("to_row").alias("row"), F.explode(_places("col", width, to_width)).alias("to_col"))
    return put.select("scene_id", "row", F.col("to_col").alias("col"), "z", ((F.col("row") >= height) | (F.col("to_col") >= width)).alias("padded"))


def model_input(px: DataFrame, size: int, column: str = "z") -> DataFrame:
    """One row of ``size * size`` values in row-major order for each whole tile of a scene; ``ok`` is false where pixels are missing or not finite."""
    tile = px.withColumns({"tr": F.floor(F.col("row") / size).cast("int"), "tc": F.floor(F.col("col") / size).cast("int")})
    place = (F.col("row") % size) * size + F.col("col") % size
    lists = tile.groupBy("scene_id", "tr", "tc").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col(column).cast("float").alias("v")))).alias("p"), F.count_if(finite(F.col(column))).alias("n_finite"))
    return lists.select("scene_id", "tr", "tc", F.transform("p", lambda x: x["v"]).alias("tensor"), ((F.size("p") == size * size) & (F.col("n_finite") == size * size)).alias("ok"))


def orientation(px: DataFrame, quarter_turns: int, mirrored: bool, height: int, width: int) -> DataFrame:
    """One of the eight orientations: ``quarter_turns`` counter-clockwise, after a left-right mirror if wanted."""
    r, c = F.col("row"), (width - 1 - F.col("col")) if mirrored else F.col("col")
    h, w = height, width
    for _ in range(quarter_turns % 4):
        r, c, h, w = w - 1 - c, r, w, h
    return px.withColumns({"row": r.cast("int"), "col": c.cast("int")})
