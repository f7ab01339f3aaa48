"""Linear interpolation between scattered points, over tiles that know their surroundings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.operators.spatial import Packed
from rillmark.operators.staging import settled


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of three point numbers) whose circumcircles hold no other point; points are added one by one."""
    n = len(xy)
    centre, span = xy.mean(axis=0), max(np.ptp(xy, axis=0).max(), 1e-12)
    unit = (xy - centre) / span
    corners = np.array([[-50.0, -50.0], [50.0, -50.0], [0.0, 50.0]])
    points = np.vstack([unit, corners])

    def circles(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = (points[tri[:, k]] for k in range(3))
        d = 2 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        u, v = ((b - a) ** 2).sum(axis=1), ((c - a) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = ((c[:, 1] - a[:, 1]) * u - (b[:, 1] - a[:, 1]) * v) / d
            y = ((b[:, 0] - a[:, 0]) * v - (c[:, 0] - a[:, 0]) * u) / d
        r = x**2 + y**2
        return a + np.stack([x, y], axis=1), np.where(np.isfinite(r), r, np.inf)

    tri = np.array([[n, n + 1, n + 2]])
    mid, square = circles(tri)
    for i in range(n):
        hit = ((mid - points[i]) ** 2).sum(axis=1) < square * (1 + 1e-12)
        edges = np.sort(np.vstack([tri[hit][:, [0, 1]], tri[hit][:, [1, 2]], tri[hit][:, [2, 0]]]), axis=1)
        rim, times = np.unique(edges, axis=0, return_counts=True)
        rim = rim[times == 1]  # edges of one removed triangle only: the border of the hole
        fresh = np.column_stack([rim, np.full(len(rim), i)])
        new_mid, new_square = circles(fresh)
        tri, mid, square = np.vstack([tri[~hit], fresh]), np.vstack([mid[~hit], new_mid]), np.concatenate([square[~hit], new_square])
    return tri[(tri < n).all(axis=1)]


def interpolate(xy: np.ndarray, z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """z at points, linear inside triangles, that of the nearest point outside them."""
    nearest = np.array([((xy - p) ** 2).sum(axis=1).argmin() for p in at])
    out = z[nearest].astype(float)
    tri = triangulate(xy) if len(xy) >= 3 else np.zeros((0, 3), int)
    if not len(tri):
        return out
    a, b, c = (xy[tri[:, k]] for k in range(3))
    d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    flat = np.abs(d) < 1e-12 * max(np.ptp(xy, axis=0).max(), 1e-12) ** 2
    d = np.where(flat, 1.0, d)
    for i, p in enumerate(at):
        u = ((b[:, 1] - c[:, 1]) * (p[0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (p[1] - c[:, 1])) / d
        v = ((c[:, 1] - a[:, 1]) * (p[0] - c[:, 0]) + (a[:, 0] - c[:, 0]) * (p[1] - c[:, 1])) / d
        inside = np.flatnonzero((u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & ~flat)
        if inside.size:
            t = inside[0]
            out[i] = u[t] * z[tri[t, 0]] + v[t] * z[tri[t, 1]] + (1 - u[t] - v[t]) * z[tri[t, 2]]
    return out


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise; two ends where all points lie on a line."""
    inner = np.zeros(len(xy), bool)
    ends = {int(i) for u in ((1, 0), (0, 1), (1, 1), (1, -1)) for i in ((xy @ u).argmin(), (xy @ u).argmax())}
    middle = xy[list(ends)].mean(axis=0)
    if len(xy) > 1000:  # what lies well inside those extremes is no corner
        outline = hull(xy[list(ends)])
        side = [_left(a, b, xy) for a, b in zip(outline, np.roll(outline, -1, axis=0), strict=True)]
        inner = (np.array(side) > 1e-9 * np.abs(xy - middle).max()).all(axis=0)
    rest = xy[~inner]
    rest = rest[np.lexsort((rest[:, 1], rest[:, 0]))]

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return np.array(chain(rest)[:-1] + chain(rest[::-1])[:-1]) if len(rest) > 1 else rest


def _left(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far points lie left of the line from a to b, times its length."""
    return (b[0] - a[0]) * (p[..., 1] - a[1]) - (b[1] - a[1]) * (p[..., 0] - a[0])


def _circle(t: np.ndarray) -> tuple[np.ndarray, float]:
    b, c = t[1] - t[0], t[2] - t[0]
    d = 2 * (b[0] * c[1] - b[1] * c[0])
    u, v = b @ b, c @ c
    middle = np.array([c[1] * u - b[1] * v, b[0] * v - c[0] * u]) / d
    return t[0] + middle, float(np.sqrt(middle @ middle))


class Local:
    """Interpolation between many points: targets' triangles are looked for among points near them, and are the right ones if no
    other point lies in their circles; those that do join the search.

    box: what is known of a larger set is all points in this (x0, y0, x1, y1). Circles beyond it settle nothing.
    """

    def __init__(self, xy: np.ndarray, z: np.ndarray, box: tuple[float, ...] | None = None, near: int = 16):
        self.xy, self.z, self.box, self.near = xy, z, box, near
        self.packed = Packed(xy, np.arange(len(xy)))
        self.place = np.empty(len(xy), np.int64)
        self.place[self.packed.order] = np.arange(len(xy))
        self.corners = hull(xy)

    def _outside(self, p: np.ndarray) -> np.ndarray:
        out = np.full(len(p), len(self.corners) < 3)
        span = np.ptp(self.corners, axis=0).max()
        for a, b in zip(self.corners, np.roll(self.corners, -1, axis=0), strict=True):
            out |= _left(a, b, p) < -1e-9 * span * np.hypot(*(b - a))
        return out

    def _triangle(self, p: np.ndarray, own: list[int]):
        """The triangle of these points that holds p, and p's weights in it."""
        at = self.xy[own]
        for tri in triangulate(at):
            a, b, c = at[tri]
            d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
            if abs(d) < 1e-12 * max(np.ptp(at, axis=0).max(), 1e-12) ** 2:
                continue
            u = ((b[1] - c[1]) * (p[0] - c[0]) + (c[0] - b[0]) * (p[1] - c[1])) / d
            v = ((c[1] - a[1]) * (p[0] - c[0]) + (a[0] - c[0]) * (p[1] - c[1])) / d
            if u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9:
                return [own[i] for i in tri], (u, v, 1 - u - v)
        return None

    def _around(self, p: np.ndarray) -> np.ndarray:
        """The points in a box around places, with a margin."""
        low, high = p.min(axis=0), p.max(axis=0)
        margin = 0.25 * (high - low).max()
        return np.flatnonzero(((self.xy >= low - margin) & (self.xy <= high + margin)).all(axis=1))

    def _together(self, own: np.ndarray, targets: np.ndarray, who: np.ndarray, out: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Settles the targets numbered `who` between the points `own`, of which there is one triangulation for all of them; what
        lies in the circles of their triangles joins it, twice. Returns the targets that are still open."""
        lost = [who[:0]]
        for _ in range(3):
            if len(who) * 64 < len(own) or len(own) < 3:
                break
            at = self.xy[own]
            tri = triangulate(at)
            a, b, c = (at[tri[:, k]] for k in range(3))
            d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
            full = np.abs(d) >= 1e-12 * max(np.ptp(at, axis=0).max(), 1e-12) ** 2
            tri, a, b, c, d = tri[full], a[full], b[full], c[full], d[full]
            if not len(tri):
                return np.concatenate([*lost, who])
            holder, weights = np.full(len(who), -1), np.zeros((len(who), 3))
            for start in range(0, len(who), 256):
                x, y = targets[who[start : start + 256]].T[:, :, None]
                u = ((b[:, 1] - c[:, 1]) * (x - c[:, 0]) + (c[:, 0] - b[:, 0]) * (y - c[:, 1])) / d
                v = ((c[:, 1] - a[:, 1]) * (x - c[:, 0]) + (a[:, 0] - c[:, 0]) * (y - c[:, 1])) / d
                inside = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
                row, t = np.arange(len(x)), inside.argmax(axis=1)
                holder[start : start + 256] = np.where(inside[row, t], t, -1)
                weights[start : start + 256] = np.stack([u[row, t], v[row, t], 1 - u[row, t] - v[row, t]], axis=1)
            lost.append(who[holder < 0])
            who, holder, weights = who[holder >= 0], holder[holder >= 0], weights[holder >= 0]
            held, back = np.unique(holder, return_inverse=True)
            circles = [_circle(at[t]) for t in tri[held]]
            if not circles:
                break
            middle, radius = np.array([m for m, _ in circles]), np.array([r for _, r in circles])
            intruder, apart = self.packed.nearest(middle)
            empty = (apart >= radius * (1 - 1e-9)) | np.isin(intruder, own)
            within = empty if self.box is None else empty & (middle - radius[:, None] >= self.box[:2]).all(axis=1) & (middle + radius[:, None] <= self.box[2:]).all(axis=1)
            sure = within[back]
            out[who[sure]] = (weights[sure] * self.z[own[tri[holder[sure]]]]).sum(axis=1)
            done[who[sure]] = True
            who, own = who[~empty[back]], np.union1d(own, intruder[~empty])
        return np.concatenate([*lost, who])

    def at(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, settled): NaN where a target isn't settled, which happens only with a box.

        Targets that are neighbours on the curve share a triangulation; the few that it leaves open are settled one by one."""
        out, settled = np.full(len(targets), np.nan), np.zeros(len(targets), bool)
        if not len(self.xy) or not len(targets):
            return out, settled | (self.box is None)
        first, _ = self.packed.nearest(targets)
        outside = self._outside(targets)
        if self.box is None:
            out[outside], settled[outside] = self.z[first[outside]], True
        left = np.flatnonzero(~outside)
        left = left[np.argsort(self.place[first[left]], kind="stable")]
        alone, parts = [left[:0]], [left]
        while parts:
            who = parts.pop()
            own = np.arange(len(self.xy)) if len(self.xy) <= SHARED else self._around(targets[who]) if 8 < len(who) <= SHARED else None
            if own is not None and len(own) <= SHARED:
                alone.append(self._together(own, targets, who, out, settled))
            elif len(who) > 8:
                parts += np.array_split(who, 2)
            else:
                alone.append(who)
        for i in np.concatenate(alone):
            out[i], settled[i] = self._one(targets[i], int(first[i]))
        return out, settled

    def _one(self, p: np.ndarray, first: int) -> tuple[float, bool]:
        """Value of a target inside the border, and whether it is settled."""
        apart = ((self.xy - p) ** 2).sum(axis=1)
        own, found, reach = {first}, None, 2 * self.near
        while found is None:
            own |= set(np.argpartition(apart, reach)[:reach].tolist() if reach < len(apart) else range(len(apart)))
            found = self._triangle(p, sorted(own)) if len(own) >= 3 else None
            if found is None and (reach >= len(self.xy) or len(own) > 500):
                own |= set(self.packed.nearest(self.corners)[0].tolist())  # these hold p between them
                found = self._triangle(p, sorted(own))
                break
            reach *= 2
        while found is not None:
            middle, radius = _circle(self.xy[found[0]])
            beyond = self.box is not None and not (self.box[0] <= middle[0] - radius and middle[0] + radius <= self.box[2] and self.box[1] <= middle[1] - radius and middle[1] + radius <= self.box[3])
            inside, apart = self.packed.nearest(middle[None, :])
            if apart[0] >= radius * (1 - 1e-9) or int(inside[0]) in own:
                return (np.nan, False) if beyond else (sum(w * self.z[k] for w, k in zip(found[1], found[0], strict=True)), True)
            own.add(int(inside[0]))
            found = self._triangle(p, sorted(own))
        return (np.nan, False) if self.box is not None else (self.z[first], True)  # on a border, by rounding


#: Most points and targets that share a triangulation.
SHARED = 1024

#: Points of a tile on average, the part of a tile around it that it also knows, and targets of a task.
TILE, HALO, TARGETS = 20_000, 0.25, 20_000


def scattered(points: DataFrame, targets: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """targets (key, x, y, ...) with z from the points (key, x, y, z) of their key; of points at one place the mean counts.

    Linear in the Delaunay triangle that holds a target, and that of the nearest point outside all of them. Points are dealt to
    tiles and those around; a tile settles the targets whose triangle's circle lies within what it knows. Those that are left,
    near or beyond the border of the points, are settled with all points of their key, TARGETS in a task. Targets at one place
    are settled once. Targets of keys without points, or without coordinates, get null.
    """
    whole = [c for c in targets.columns if c != "z"]
    kept = settled(targets.select(*whole))  # read for the places, and for the rows at them
    known = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(z)")
    known = settled(known.groupBy(key, "x", "y").agg(F.avg("z").alias("z")))
    size = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    ends = known.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("x").alias("__x0"), F.min("y").alias("__y0"), size.alias("__size"))
    ends = settled(ends.withColumn("__side", F.when((F.col("__n") > 2 * tile) & (F.col("__size") > 0), F.col("__size") / F.ceil(F.sqrt(F.col("__n") / tile)))))
    asked = kept.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").distinct()
    tiled = ends.where("__side IS NOT NULL")
    at = lambda c, by=0.0: F.floor((F.col(c) - F.col(f"__{c}0")) / F.col("__side") + by).cast("bigint")
    near = known.join(tiled, key)
    for c in "xy":
        near = near.withColumn(f"t{c}", F.explode(F.sequence(at(c, -HALO), at(c, HALO))))
    own = asked.join(tiled, key).withColumns({"tx": at("x"), "ty": at("y")})
    kind = targets.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, x double, y double, z double, done boolean"

    def one(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        box = None
        if "__side" in right and len(right):
            x0, y0, side = right["__x0"].iloc[0], right["__y0"].iloc[0], right["__side"].iloc[0]
            tx, ty = int(group[1]), int(group[2])
            box = (x0 + (tx - HALO) * side, y0 + (ty - HALO) * side, x0 + (tx + 1 + HALO) * side, y0 + (ty + 1 + HALO) * side)
        if not len(right):
            return pd.DataFrame(columns=[key, "x", "y", "z", "done"])
        local = Local(left[["x", "y"]].to_numpy(float), left["z"].to_numpy(float), box) if len(left) else None
        z, done = local.at(right[["x", "y"]].to_numpy(float)) if local else (np.full(len(right), np.nan), np.zeros(len(right), bool))
        return right[[key, "x", "y"]].assign(z=z, done=done)

    tiles = [key, "tx", "ty"]
    found = settled(near.select(*tiles, "x", "y", "z").groupBy(*tiles).cogroup(own.select(*tiles, "x", "y", "__x0", "__y0", "__side").groupBy(*tiles)).applyInPandas(one, schema))
    rest = asked.join(ends.where("__side IS NULL").select(key), key, "left_semi").select(key, "x", "y").unionByName(found.where("NOT done").select(key, "x", "y"))
    shards = rest.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TARGETS).alias("__k"))
    parts = [key, "__part"]
    spread = known.join(shards, key).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1))).select(*parts, "x", "y", "z")
    dealt = rest.join(shards, key).withColumn("__part", F.pmod(F.xxhash64("x", "y"), F.col("__k"))).select(*parts, "x", "y")
    last = spread.groupBy(*parts).cogroup(dealt.groupBy(*parts)).applyInPandas(one, schema)
    both = found.where("done").unionByName(last).select(key, F.col("x").alias("__x"), F.col("y").alias("__y"), "z")
    out = kept.withColumns({"__x": F.col("x").cast("double"), "__y": F.col("y").cast("double")}).join(both, [key, "__x", "__y"], "left")
    return out.select(*whole, F.when(~F.isnan("z"), F.col("z")).alias("z"))
