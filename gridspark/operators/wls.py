"""Edge-aware least squares on whole scenes: smooth where the image is smooth, by conjugate gradients over chunks.

The energy of a scene is the sum of ``conf * (x - z)^2`` over pixels and of ``lam * w * (x - x')^2`` over neighbours, with w
falling where colours differ. Chunks keep their part of the vectors; a round exchanges the rims of one vector with the
four neighbours and adds up two products for each scene, so no pixel reaches the driver and all scenes share their rounds.
Each chunk solves its own part exactly as a preconditioner, which leaves few rounds; the solution does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut, forget

CHUNK = 256
KEY = ["scene_id", "cr", "cc"]
_SHAPE = "row0 int, col0 int, height int, width int"
_SYSTEM = ["diag", "right", "down", "left_rim", "up_rim", "b"]
_STATE = ["x", "r", "p", "s", "u"]
_RIMS = ["upper", "lower", "leftmost", "rightmost"]
_FROM = {"from_below": ("upper", -1, 0), "from_above": ("lower", 1, 0), "from_right": ("leftmost", 0, -1), "from_left": ("rightmost", 0, 1)}
CELLS = 1 << 16
"""So many cells of chunks are worked on together, more only if a single chunk has more."""


def edge_weight(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """Weight of neighbours by the sum of absolute differences of their colours in 0 to 255, last axis."""
    return np.exp(-((np.abs(a - b).sum(-1) / 255.0) ** 2) / max(sigma, 1e-6) ** 2)


def _system(px: DataFrame, lam: float, sigma: float, chunk: int) -> DataFrame:
    """The equations of each chunk: what its pixels weigh, how they are tied to right, down, and over the left and upper rim, and the first guess ``x``."""
    names = ["z", "red", "green", "blue", "conf", "start"]
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / chunk), F.floor((F.col(c) + 1) / chunk)))
    sent = px.select("scene_id", "row", "col", *(F.col(n).cast("double").alias(n) for n in names), span("row").alias("cr")).select("*", span("col").alias("cc"))
    schema = f"scene_id long, cr long, cc long, {_SHAPE}, " + ", ".join(f"{n} binary" for n in [*_SYSTEM, "x"])

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        cr, cc = key[1].as_py(), key[2].as_py()
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        core = (row // chunk == cr) & (col // chunk == cc)
        if not core.any():
            return pa.table({f.name: pa.array([], f.type) for f in kinds})
        # one cell more to each side, whether there are pixels or not
        r0, r1, c0, c1 = row[core].min() - 1, row[core].max() + 2, col[core].min() - 1, col[core].max() + 2
        near = (row >= r0) & (row < r1) & (col >= c0) & (col < c1)
        a = {n: np.full((r1 - r0, c1 - c0), np.nan) for n in names}
        for n in names:
            a[n][row[near] - r0, col[near] - c0] = table[n].to_numpy(zero_copy_only=False)[near]
        rgb = np.stack((a["red"], a["green"], a["blue"]), -1)
        ok = np.isfinite(a["z"]) & np.isfinite(rgb).all(-1)
        rgb = np.where(ok[..., None], rgb, 0)
        right = np.where(ok[:, :-1] & ok[:, 1:], lam * edge_weight(rgb[:, :-1], rgb[:, 1:], sigma), 0)
        down = np.where(ok[:-1] & ok[1:], lam * edge_weight(rgb[:-1], rgb[1:], sigma), 0)
        me = (slice(1, -1), slice(1, -1))
        conf = np.where(ok, np.clip(np.nan_to_num(a["conf"], nan=1.0), 0, 1), 0)[me]
        z = np.where(ok, a["z"], 0)[me]
        guess = np.where(np.isfinite(a["start"][me]), np.nan_to_num(a["start"][me]), z)
        out = {
            "diag": conf + right[1:-1, 1:] + right[1:-1, :-1] + down[1:, 1:-1] + down[:-1, 1:-1],
            "right": right[1:-1, 1:], "down": down[1:, 1:-1], "left_rim": right[1:-1, 0], "up_rim": down[0, 1:-1], "b": conf * z, "x": np.where(ok[me], guess, 0),
        }
        shape = out["diag"].shape
        fixed = [key[0].as_py(), cr, cc, int(r0 + 1), int(c0 + 1), *shape]
        return pa.table([pa.array([v], f.type) for v, f in zip([*fixed, *(out[n].tobytes() for n in [*_SYSTEM, "x"])], kinds)], schema=kinds)

    kinds = pa.schema([("scene_id", pa.int64()), ("cr", pa.int64()), ("cc", pa.int64()), *((n, pa.int32()) for n in ("row0", "col0", "height", "width")), *((n, pa.binary()) for n in [*_SYSTEM, "x"])])
    return sent.groupBy(*KEY).applyInArrow(apply, schema)


def _times(diag: np.ndarray, right: np.ndarray, down: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The own part of the matrix of each chunk times v; what lies beyond counts as 0."""
    out = diag * v
    out[:, :, :-1] -= right[:, :, :-1] * v[:, :, 1:]
    out[:, :, 1:] -= right[:, :, :-1] * v[:, :, :-1]
    out[:, :-1] -= down[:, :-1] * v[:, 1:]
    out[:, 1:] -= down[:, :-1] * v[:, :-1]
    return out


def _summed(v: np.ndarray) -> np.ndarray:
    """The sum over each chunk, in an order that does not depend on the chunks beside it."""
    return v.reshape(len(v), -1).sum(1)


class _Chunks:
    """Rows of chunks of one shape as arrays, the chunk first."""

    def __init__(self, rows: pa.RecordBatch, chunk: int):
        self.rows, self.chunk = rows, chunk
        self.shape = rows.num_rows, rows["height"][0].as_py(), rows["width"][0].as_py()
        self.top, self.left = (rows[n].to_numpy() % chunk for n in ("row0", "col0"))
        self.diag, self.right, self.down = (self.vector(n) for n in ("diag", "right", "down"))

    def vector(self, name: str, shape: tuple = ()) -> np.ndarray:
        return np.frombuffer(b"".join(self.rows[name].to_pylist())).reshape(shape or self.shape)

    def number(self, name: str) -> np.ndarray:
        return self.rows[name].fill_null(0).to_numpy(zero_copy_only=False)[:, None, None]

    def times(self, v: np.ndarray) -> np.ndarray:
        return _times(self.diag, self.right, self.down, v)

    def solved(self, r: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The own equations of chunks ``which`` solved for r; 0 for others."""
        out = np.zeros(self.shape)
        if not len(which):
            return out
        diag, right, down, r = (v[which] for v in (self.diag, self.right, self.down, r))
        inverse = np.where(diag > 1e-12, 1 / np.maximum(diag, 1e-12), 0)
        x, p = np.zeros(r.shape), inverse * r
        rz = first = _summed(r * p)
        for _ in range(4000):
            on = (rz > 1e-26 * first) & (rz > 1e-300)
            if not on.all():
                out[which[~on]] = x[~on]
                which, diag, right, down, inverse, x, r, p, rz, first = (v[on] for v in (which, diag, right, down, inverse, x, r, p, rz, first))
                if not len(which):
                    return out
            q = _times(diag, right, down, p)
            a = (rz / _summed(p * q))[:, None, None]
            x += a * p
            r -= a * q
            z = inverse * r
            rz, before = _summed(r * z), rz
            p = z + (rz / before)[:, None, None] * p
        out[which] = x
        return out

    def rims(self, v: np.ndarray) -> dict[str, np.ndarray]:
        """The rims of v by ``_RIMS``, each as long as a whole chunk, since neighbours may begin and end elsewhere."""
        out = {n: np.zeros((len(v), self.chunk)) for n in _RIMS}
        own = np.arange(len(v))[:, None]
        for n, rim, first in zip(_RIMS, (v[:, 0], v[:, -1], v[:, :, 0], v[:, :, -1]), (self.left, self.left, self.top, self.top)):
            out[n][own, first[:, None] + np.arange(rim.shape[1])] = rim
        return out

    def rim(self, name: str) -> np.ndarray:
        """What of a neighbour's rim lies at the own one."""
        none = bytes(8 * self.chunk)
        whole = np.frombuffer(b"".join(v or none for v in self.rows[name].to_pylist())).reshape(len(self.rows), self.chunk)
        first, size = (self.left, self.shape[2]) if name in ("from_below", "from_above") else (self.top, self.shape[1])
        return whole[np.arange(len(whole))[:, None], first[:, None] + np.arange(size)]


def _mapped(df: DataFrame, make, names: list[str], numbers: list[str], chunk: int) -> DataFrame:
    """``make(chunks)`` gives arrays ``names`` and numbers ``numbers`` of each chunk; chunks of one shape are worked on together, a bounded number at a time."""
    schema = "scene_id long, cr long, cc long, " + ", ".join([*(f"{n} binary" for n in names), *(f"{n} double" for n in numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([batch[n].to_numpy() for n in ("height", "width")], 1)
            for shape in np.unique(shapes, axis=0):
                own, most = np.flatnonzero((shapes == shape).all(1)), max(1, CELLS // int(shape.prod()))
                for k in range(0, len(own), most):
                    rows = batch.take(pa.array(own[k : k + most]))
                    made = make(_Chunks(rows, chunk))
                    columns = [*(rows[n] for n in KEY), *(pa.array([v.tobytes() for v in made[n]], pa.binary()) for n in names), *(pa.array(made[n], pa.float64()) for n in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*KEY, *names, *numbers])

    return df.mapInArrow(run, schema)


def _product(system: DataFrame, state: DataFrame, vector: str, chunk: int) -> DataFrame:
    """``w``, the matrix times ``vector`` of ``state``, and of each chunk gamma = r u, delta = w u and rr (0 if vector is not u); rims come from the four neighbours."""
    # from the chunk below its upper rim, and so on
    sent = F.inline(F.array(*(F.struct((F.col("cr") + a).alias("cr"), (F.col("cc") + b).alias("cc"), F.lit(n).alias("side"), F.col(rim).alias("rim")) for n, (rim, a, b) in _FROM.items())))
    met = state.select("scene_id", sent).groupBy(*KEY).agg(*(F.max(F.when(F.col("side") == n, F.col("rim"))).alias(n) for n in _FROM))

    def make(c: _Chunks) -> dict:
        v = c.vector(vector)
        w = c.times(v)
        w[:, -1] -= c.down[:, -1] * c.rim("from_below")
        w[:, 0] -= c.vector("up_rim", (len(v), -1)) * c.rim("from_above")
        w[:, :, -1] -= c.right[:, :, -1] * c.rim("from_right")
        w[:, :, 0] -= c.vector("left_rim", (len(v), -1)) * c.rim("from_left")
        r = c.vector("r") if vector == "u" else np.zeros(c.shape)
        return {"w": w, "gamma": _summed(r * v), "delta": _summed(w * v), "rr": _summed(r * r)}

    own = state.select(*KEY, vector, *(["r"] if vector == "u" else []))
    return _mapped(own.join(system.drop("b"), KEY).join(met, KEY, "left"), make, ["w"], ["gamma", "delta", "rr"], chunk)


def wls_refine(px: DataFrame, lam: float = 1.0, sigma: float = 0.1, tol: float = 1e-6, most: int = 120, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, row, col, x)``: the minimum of the energy for ``px(scene_id, row, col, z, red, green, blue[, conf][, start])``.

    A pixel whose z or colour is null or not finite takes no part and stays null; ``conf`` (null or missing: 1) is cut to 0 to 1;
    ``start`` is a first guess (else z). A scene is done when its residual is below ``tol`` times its right side, or after ``most`` rounds.
    """
    px = px.withColumns({n: F.lit(None).cast("double") for n in ("conf", "start") if n not in px.columns})
    whole = cut(_system(px, lam, sigma, chunk))
    system = whole.drop("x")
    first = _mapped(whole, lambda c: {"x": c.vector("x")} | c.rims(c.vector("x")), ["x", *_RIMS], [], chunk)

    def residual(c: _Chunks) -> dict:
        b, zero = c.vector("b"), np.zeros(c.shape)
        r = b - c.vector("w")
        u = c.solved(r, np.arange(len(r)))
        return {"x": c.vector("x"), "r": r, "p": zero, "s": zero, "u": u, "bb": _summed(b**2)} | c.rims(u)

    first = cut(first)
    begun = _product(system, first, "x", chunk).select(*KEY, "w")
    state = cut(_mapped(begun.join(whole, KEY), residual, [*_STATE, *_RIMS], ["bb"], chunk))
    forget(first)
    known = state.groupBy("scene_id").agg(F.sum("bb").alias("bb"), F.lit(None).cast("double").alias("gamma_old"), F.lit(None).cast("double").alias("alpha_old"))
    system = system.drop("b")
    for round_ in range(most + 1):
        product = cut(_product(system, state, "u", chunk))
        sums = product.groupBy("scene_id").agg(*(F.sum(n).alias(n) for n in ("gamma", "delta", "rr"))).join(known, "scene_id")
        done = F.sqrt("rr") <= tol * F.greatest(F.sqrt("bb"), F.lit(1e-12))
        if round_:
            now = sums.withColumn("beta", F.try_divide(F.col("gamma"), F.col("gamma_old")))
            now = now.withColumn("alpha", F.try_divide(F.col("gamma"), F.col("delta") - F.try_divide(F.col("beta") * F.col("gamma"), F.col("alpha_old"))))
        else:
            now = sums.withColumns({"beta": F.lit(0.0), "alpha": F.try_divide(F.col("gamma"), F.col("delta"))})
        now = now.withColumn("done", done | F.col("alpha").isNull() | F.col("beta").isNull())
        scalars = cut(now.select("scene_id", "bb", "gamma", "alpha", "beta", "done"))
        if round_ == most or scalars.where("not done").isEmpty():
            break

        def advance(c: _Chunks) -> dict:
            old = {n: c.vector(n) for n in _STATE}
            ended, a, b = c.rows["done"].to_numpy(zero_copy_only=False), c.number("alpha"), c.number("beta")
            p, s = old["u"] + b * old["p"], c.vector("w") + b * old["s"]
            r = old["r"] - a * s
            new = {"x": old["x"] + a * p, "r": r, "p": p, "s": s, "u": c.solved(r, np.flatnonzero(~ended))}
            new = {n: np.where(ended[:, None, None], old[n], v) for n, v in new.items()}
            return new | c.rims(new["u"])

        before = state
        state = cut(_mapped(state.select(*KEY, *_STATE).join(product.select(*KEY, "w"), KEY).join(scalars, "scene_id").join(system, KEY), advance, [*_STATE, *_RIMS], [], chunk))
        forget(before, product)
        known = scalars.select("scene_id", "bb", F.col("gamma").alias("gamma_old"), F.col("alpha").alias("alpha_old"))

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                y, x = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, row["scene_id"])), pa.array((y + row["row0"]).astype(np.int32)), pa.array((x + row["col0"]).astype(np.int32)), pa.array(np.frombuffer(row["x"]))], names=["scene_id", "row", "col", "x"])

    made = state.select(*KEY, "x").join(system.select(*KEY, "row0", "col0", "height", "width"), KEY).mapInArrow(pixels, "scene_id long, row int, col int, x double")
    with_value = px.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in ("z", "red", "green", "blue"))).select("scene_id", "row", "col")
    there = px.select("scene_id", "row", "col").join(with_value.withColumn("ok", F.lit(True)), ["scene_id", "row", "col"], "left")
    return there.join(made, ["scene_id", "row", "col"]).select("scene_id", "row", "col", F.when(F.col("ok"), F.col("x")).alias("x"))
