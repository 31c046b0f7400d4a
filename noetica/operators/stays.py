"""Stays from location histories: sequential clustering, trellis, and the three stages.

The state of a user's timeline depends on all that came before, so a user is one group;
groups are independent and run side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved, saved_with_count
from ..functions.geo import RADIUS, ellipsoid_inverse
from ..functions.prob import hellinger_of

LAMBDA, MIN_STAY, LOOKUP, MOVE_LOOKUP = 0.95, 15 * 60.0, 60 * 60.0, 120 * 60.0


def haversine_of(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))


def ellipsoid_of(lon1, lat1, lon2, lat2):
    return ellipsoid_inverse(lon1, lat1, lon2, lat2)[0]


#: Metres of a radian along any line of the ellipsoid (or of its sphere): no less, no more.
RADIAN_LOW, RADIAN_HIGH = 6_335_439.0 * 0.999, 6_399_594.0 * 1.001
#: Degrees up to which these bounds are used.
NEAR = 1.0


def _far(distance: float, v1: float, v2: float, threshold: float) -> bool:
    """Whether two normals are farther apart than a threshold (Hellinger)."""
    z = 2 * math.sqrt(v1 * v2) / (v1 + v2) * math.exp(-distance * distance / (4 * (v1 + v2)))
    return 1 - z > threshold * threshold


class Cluster:
    """Open cluster: members in growing buffers, and the sums that give its most likely centre
    and variance."""

    def __init__(self, number: int, first: float, last: float, lon: list[float] = (), lat: list[float] = (), var: list[float] = (), ids: list = ()):
        self.number, self.first, self.last, self.ids = number, first, last, []
        self.size, self.p, self.x, self.y = 0, 0.0, 0.0, 0.0
        self.members = np.empty((3, 8))
        for i, *m in zip(ids, lon, lat, var, strict=True):
            self.add(i, *m)

    def add(self, id_, lon: float, lat: float, var: float) -> None:
        if self.size == self.members.shape[1]:
            self.members = np.concatenate([self.members, np.empty_like(self.members)], axis=1)
        self.members[:, self.size] = lon, lat, var
        self.size += 1
        self.ids.append(id_)
        self.p, self.x, self.y = self.p + 1 / var, self.x + lon / var, self.y + lat / var

    def centre(self) -> tuple[float, float, float]:
        return self.x / self.p, self.y / self.p, self.size / self.p

    def state(self) -> dict:
        lon, lat, var = self.members[:, : self.size].tolist()
        return {"number": self.number, "first": self.first, "last": self.last, "lon": lon, "lat": lat, "var": var, "ids": self.ids}

    def takes(self, lon: float, lat: float, var: float, threshold: float, distance) -> bool:
        """Whether all members, with a new one, stay within the threshold of their new centre.

        Bounds of the distance decide most cases; what they leave open is measured.
        """
        p = self.p + 1 / var
        x, y, v = (self.x + lon / var) / p, (self.y + lat / var) / p, (self.size + 1) / p
        # the new member first: it fails most often
        dx, dy, top = abs(lon - x), abs(lat - y), max(abs(lat), abs(y))
        near = dx <= NEAR and dy <= NEAR and top < 89
        if near:
            dx, dy = math.radians(dx), math.radians(dy)
            if _far(RADIAN_LOW * math.hypot(dy, math.cos(math.radians(top)) * dx), v, var, threshold):
                return False
        if not near or _far(RADIAN_HIGH * math.hypot(dy, math.cos(math.radians(min(abs(lat), abs(y)))) * dx), v, var, threshold):
            if _far(float(distance(np.array([lon]), np.array([lat]), x, y)[0]), v, var, threshold):
                return False
        lons, lats, vs = self.members[:, : self.size]
        dx, dy = np.abs(lons - x), np.abs(lats - y)
        if dx.max() <= NEAR and dy.max() <= NEAR and top < 89:
            wide = math.cos(math.radians(max(0.0, abs(y) - float(dy.max()))))
            square = (RADIAN_HIGH * math.pi / 180) ** 2 * (dy * dy + wide * wide * dx * dx)
            z = 2 * np.sqrt(v * vs) / (v + vs) * np.exp(-square / (4 * (v + vs)))
            if (1 - z).max() <= threshold * threshold:
                return True
        n = self.size
        return bool((hellinger_of(distance(lons, lats, np.full(n, x), np.full(n, y)), v, vs) <= threshold).all())


class SequentialClustering:
    """Clusters of a stream of observations in time order; resumable: the open clusters are
    the whole state."""

    def __init__(self, lookup: float = LOOKUP, threshold: float = LAMBDA, distance=ellipsoid_of, open_: list[Cluster] | None = None, number: int = 0):
        self.lookup, self.threshold, self.distance = lookup, threshold, distance
        self.open = list(open_ or [])
        self.number = number

    def add(self, id_, t: float, lon: float, lat: float, acc: float) -> list[Cluster]:
        """Take one observation; the clusters that it closes come back."""
        within = [c for c in self.open if abs(t - c.last) <= self.lookup]
        beyond = [c for c in self.open if abs(t - c.last) > self.lookup]
        if not within and beyond:
            kept, closed = beyond[:1], beyond[1:]
        else:
            kept, closed = within, beyond
        var = max(acc, 1e-9) ** 2
        for c in kept:
            if c.takes(lon, lat, var, self.threshold, self.distance):
                break
        else:
            c = Cluster(self.number, t, t)
            self.number += 1
            kept = [*kept, c]
        c.add(id_, lon, lat, var)
        c.last = t
        self.open = sorted(kept, key=lambda k: (-k.last, -k.number))
        return closed

    def finish(self) -> list[Cluster]:
        out, self.open = sorted(self.open, key=lambda k: (k.last, k.number)), []
        return out


def clusters_of(rows: list[tuple], lookup: float = LOOKUP, distance=ellipsoid_of) -> list[Cluster]:
    """``rows``: (id, t, lon, lat, acc) in time order."""
    own, out = SequentialClustering(lookup, distance=distance), []
    for r in rows:
        out += own.add(*r)
    return out + own.finish()


# -- trellis: is each observation part of a movement or of a stay?


def trellis(rows: list[tuple], lookup: float = MOVE_LOOKUP) -> list[tuple]:
    """``(id, state)`` of the kept observations of a labelled timeline.

    ``rows``: (id, t, lon, lat, cluster or None), cluster = (number, t_to, lon, lat).  States:
    ``("same", i)``, ``("move", i)`` with the cluster left for a detour, ``("stay", i, m)``
    inside a detour begun at m.  The cheapest path through the states is found by dynamic
    programming; a segment ends where one state only is left, which bounds the memory.
    Stationary observations of a detour are left out, and so is each segment's head.
    """
    if not rows:
        return []
    d = lambda a, b: float(haversine_of(a[0], a[1], b[0], b[1]))
    at = lambda i: rows[i][2:4]
    of = lambda i: rows[i][4]
    number = lambda i: of(i)[0] if of(i) else None
    out: list[tuple] = []
    states = {("same", 0, -1, None): (0.0, [("same", 0)])}
    for i in range(1, len(rows)):
        if len(states) == 1 and i > 1:
            ((state, (_, path)),) = states.items()
            out += path[1:]
            states = {state: (0.0, path[-1:])}
        t, new = rows[i][1], {}

        def offer(key: tuple, cost: float, path: list, step: tuple, new=new) -> None:
            if key not in new or cost < new[key][0]:
                new[key] = (cost, [*path, step])

        for (kind, j, m, c), (cost, path) in states.items():
            if kind == "same":
                offer(("same", i, -1, None), cost + d(at(j), at(i)), path, ("same", i))
                left = of(j)
                if left and left[1] >= t and number(i) != left[0]:
                    offer(("move", i, i, left), cost + d(at(j), at(i)) + d(left[2:4], at(j)), path, ("move", i))
                continue
            if t - rows[m][1] > lookup and i != m + 1:
                continue
            if number(i) == c[0]:
                offer(("same", i, -1, None), cost + d(c[2:4], at(i)) + d(at(m), at(i)), path, ("same", i))
            if c[1] >= t:
                offer(("move", i, i, c), cost + d(at(m), at(i)), path, ("move", i))
                if number(i) == c[0]:
                    offer(("stay", i, m, c), cost + d(c[2:4], at(i)), path, ("stay", i))
        states = new
    _, path = min(states.values(), key=lambda x: x[0])
    out += path[1:]
    return [(rows[i][0], kind) for kind, i in out if kind != "stay"]


_STAYS = "t_from timestamp, t_to timestamp, lon double, lat double, accuracy double, n_points int"


def _frame(group: pd.DataFrame) -> list[tuple]:
    group = group.sort_values(["ts", "id"])
    seconds = group["ts"].astype("datetime64[us]").astype("int64") / 1e6
    return list(zip(group["id"], seconds, group["lon"], group["lat"], group["acc"], strict=True))


def _stay_rows(clusters: list[Cluster], least: float) -> list[tuple]:
    out = []
    for c in clusters:
        if c.last - c.first >= least:
            lon, lat, var = c.centre()
            out.append((pd.Timestamp(round(c.first * 1e6), unit="us"), pd.Timestamp(round(c.last * 1e6), unit="us"), lon, lat, var**0.5, len(c.ids)))
    return out


def three_stages(rows: list[tuple], distance=ellipsoid_of) -> list[Cluster]:
    """Stays of one timeline: cluster, decide by trellis, cluster what is left."""
    first = [c for c in clusters_of(rows, LOOKUP, distance) if c.last - c.first >= MIN_STAY]
    label = {}
    for k, c in enumerate(first):
        lon, lat, _ = c.centre()
        for i in c.ids:
            label[i] = (k, c.last, lon, lat)
    kept = [i for i, _ in trellis([(r[0], r[1], r[2], r[3], label.get(r[0])) for r in rows])]
    by_id = {r[0]: r for r in rows}
    # neighbours with the same id count once, and the last observation goes
    kept = [a for a, b in zip(kept, kept[1:], strict=False) if a != b] if len(kept) > 1 else kept
    return clusters_of([by_id[i] for i in kept], 0.0, distance)


def stays(locations: DataFrame, key: str = "user_id", stages: int = 3, min_seconds: float | None = None, spherical: bool = False) -> DataFrame:
    """Stays of each key's locations ``(id, ts, lon, lat, acc)``.

    ``stages=1`` is the sequential clustering alone with its minimum duration.
    """
    schema = f"{key} {locations.schema[key].dataType.simpleString()}, {_STAYS}"
    least = (MIN_STAY if stages == 1 else 0.0) if min_seconds is None else min_seconds
    distance = haversine_of if spherical else ellipsoid_of

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = _frame(group)
        found = clusters_of(rows, LOOKUP, distance) if stages == 1 else three_stages(rows, distance)
        out = pd.DataFrame(_stay_rows(found, least), columns=["t_from", "t_to", "lon", "lat", "accuracy", "n_points"])
        out.insert(0, key, group[key].iloc[0])
        return out

    return locations.select(key, "id", "ts", "lon", "lat", "acc").where(F.col("ts").isNotNull()).groupBy(key).applyInPandas(run, schema)


def with_clusters(locations: DataFrame, items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every location with its cluster's span and centre, all null where it has none.

    ``items``: (cluster, id) of members; ``clusters``: (cluster, c_from, c_to, c_lon, c_lat, c_acc).
    """
    return locations.join(items.join(clusters, "cluster").drop("cluster"), "id", "left")


def greedy_clusters(points: np.ndarray, radius: float) -> list[list[int]]:
    """Global clustering of (lon, lat): the point with most neighbours takes all within a radius."""
    left, out = set(range(len(points))), []
    near = [set(np.flatnonzero(haversine_of(points[i, 0], points[i, 1], points[:, 0], points[:, 1]) <= radius).tolist()) for i in range(len(points))]
    while left:
        seed = max(sorted(left), key=lambda i: len(near[i] & left))
        own = sorted(near[seed] & left, key=lambda j: (float(haversine_of(*points[seed], *points[j])), j))
        out.append(own)
        left -= set(own)
    return out


#: Tiles of ``global_clusters`` in radii: their side, the rim around, and the rounds that it lets one task decide.
TILE, RIM, ROUNDS = 24, 11, 3
#: Neighbours that a task keeps at once; of more it finds them again in each pass.
KEPT_NEIGHBOURS = 40_000_000


def _neighbours(lon: np.ndarray, lat: np.ndarray, metres: float):
    """Chunks ``(first, starts, j)``: for the points first, first + 1, ... the neighbours
    ``j[starts[k]:starts[k + 1]]`` within a distance, itself among them.

    Cells of the distance's size in space, so neither date line nor poles matter; chords decide,
    and where they are too close to the distance, ``haversine_of``.
    """
    p, q = np.radians(lat), np.radians(lon)
    x = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)
    chord = 2 * math.sin(min(metres / (2 * RADIUS), math.pi / 2))
    side = chord * (1 + 1e-6) + 1e-12
    wide = int(2 / side) + 4
    if wide > 2_000_000:  # so small a distance that cells would not fit a number
        side = 2 / 1_999_990
        wide = 1_999_994
    cell = np.floor((x + 1) / side).astype(np.int64) + 1
    key = (cell[:, 0] * wide + cell[:, 1]) * wide + cell[:, 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    at, first, n = 0, 0, len(x)
    while first < n:
        # a chunk of points whose candidates are few millions
        last = min(n, first + 50_000)
        while True:
            c = cell[first:last]
            ranges = []
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    k = ((c[:, 0] + a) * wide + c[:, 1] + b) * wide + c[:, 2]
                    ranges.append((np.searchsorted(key, k - 1, "left"), np.searchsorted(key, k + 1, "right")))
            total = sum(int((hi - lo).sum()) for lo, hi in ranges)
            if total <= 8_000_000 or last == first + 1:
                break
            last = first + max(1, (last - first) * 4_000_000 // total)
        found_i, found_j = [], []
        for lo, hi in ranges:
            size = hi - lo
            i = np.repeat(np.arange(first, last), size)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(size) - size - lo, size)]
            square = ((x[i] - x[j]) ** 2).sum(axis=1)
            good = square <= chord * chord * (1 + 1e-8) + 1e-24
            i, j, square = i[good], j[good], square[good]
            open_ = np.flatnonzero(square >= chord * chord * (1 - 1e-8) - 1e-24)
            keep = np.ones(len(i), bool)
            keep[open_] = haversine_of(lon[i[open_]], lat[i[open_]], lon[j[open_]], lat[j[open_]]) <= metres
            found_i.append(i[keep] - first)
            found_j.append(j[keep])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        by = np.argsort(i, kind="stable")
        at += len(i)
        yield first, np.concatenate(([0], np.cumsum(np.bincount(i, minlength=last - first)))), j[by].astype(np.int32)
        first = last


def _greedy_rounds(ids: np.ndarray, lon: np.ndarray, lat: np.ndarray, core: np.ndarray, metres: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``id, cluster`` of what seeds in the core take within so many rounds of ``global_clusters``."""
    n = len(ids)
    _, code = np.unique(ids, return_inverse=True)
    kept, size = [], 0
    for chunk in _neighbours(lon, lat, metres):
        kept.append(chunk)
        size += len(chunk[2])
        if size > KEPT_NEIGHBOURS:
            kept = None
            break
    chunks = (lambda: kept) if kept is not None else (lambda: _neighbours(lon, lat, metres))
    left = np.ones(n, bool)

    def over(of: np.ndarray, reduce) -> np.ndarray:
        return np.concatenate([reduce(of[j], starts[:-1]) for _, starts, j in chunks()])

    members, names = [], []
    for _ in range(rounds):
        if not (left & core).any():
            break
        counts = over(left.astype(np.int64), np.add.reduceat)
        rank = np.full(n, n, np.int64)
        rank[np.lexsort((code, -counts))] = np.arange(n)
        rank[~left] = n
        best = rank
        for _ in range(2):  # the best within one step, then within two
            best = np.where(left, over(best, np.minimum.reduceat), n)
        seed = left & (best == rank)
        for first, starts, j in chunks():
            for k in np.flatnonzero(seed[first : first + len(starts) - 1]):
                own = j[starts[k] : starts[k + 1]]
                own = own[left[own]]
                left[own] = False
                if core[first + k]:
                    members.append(ids[own])
                    names.append(np.full(len(own), ids[own[np.argmin(code[own])]], ids.dtype))
    empty = np.zeros(0, ids.dtype)
    return np.concatenate([*members, empty]), np.concatenate([*names, empty])


def _tiled(points: DataFrame, metres: float) -> DataFrame:
    """``id, lon, lat`` in each tile that they are in or near: ``band, cell, core``."""
    height, rim = TILE * metres / 111_000.0, RIM * metres / 111_000.0 * 1.01
    row = lambda lat: F.floor((lat + 90) / height).cast("long")
    reached = points.select("id", "lon", "lat", row(F.col("lat")).alias("own")).withColumn("band", F.explode(F.array_distinct(F.array(row(F.col("lat") - rim), F.col("own"), row(F.col("lat") + rim)))))
    low = F.col("band") * height - 90
    edge = F.greatest(F.abs(low - rim), F.abs(low + height + rim))
    n = F.when(F.col("edge") >= 89, 1).otherwise(F.floor(360.0 * F.cos(F.radians("edge")) / height)).cast("long")
    # columns are as wide as a tile is high, or one goes all round
    sized = reached.withColumn("edge", edge).withColumn("n", n).withColumn("n", F.when(F.col("n") < 4, 1).otherwise(F.col("n")))
    near = F.when(F.col("n") == 1, 0.0).otherwise(F.lit(rim / 360) * F.col("n") / F.cos(F.radians(F.least("edge", F.lit(89.0)))))
    put = sized.withColumns({"at": F.pmod((F.col("lon") + 180) / 360, F.lit(1.0)) * F.col("n"), "near": near})
    column = lambda x: F.pmod(F.floor(x).cast("long"), F.col("n"))
    put = put.withColumn("home", column(F.col("at"))).withColumn("cell", F.explode(F.array_distinct(F.array(column(F.col("at") - F.col("near")), F.col("home"), column(F.col("at") + F.col("near"))))))
    return put.select("id", "lon", "lat", "band", "cell", ((F.col("band") == F.col("own")) & (F.col("cell") == F.col("home"))).alias("core"))


def global_clusters(points: DataFrame, metres: float, id_col: str = "id") -> DataFrame:
    """``(id, cluster)`` as ``greedy_clusters`` gives them; the least id names a cluster.

    A round picks at once every point with more neighbours left than any point whose
    neighbours it shares (ties to the smaller id): the greedy order would take it before those,
    as counts only fall, and what it takes changes no count of a point farther away.  What a
    round does with a point depends on points within three radii, and what it leaves on those
    within four; so a tile with a rim of eleven decides three rounds of its own points at once.
    Neighbours are found inside tasks and never written: points travel, pairs do not.
    """
    own = points.select(F.col(id_col).alias("id"), "lon", "lat")
    placed = ~(F.col("lon").isNull() | F.col("lat").isNull() | F.isnan(F.col("lon").cast("double")) | F.isnan(F.col("lat").cast("double")))
    clusters = own.where(~placed).select("id", F.col("id").alias("cluster"))
    kind = own.schema["id"].dataType.simpleString()

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        core = tile["core"].to_numpy(bool)
        if not core.any():
            return pd.DataFrame({"id": tile["id"][:0], "cluster": tile["id"][:0]})
        found, cluster = _greedy_rounds(tile["id"].to_numpy(), tile["lon"].to_numpy(float), tile["lat"].to_numpy(float), core, metres, ROUNDS)
        return pd.DataFrame({"id": found, "cluster": cluster})

    left, n = saved_with_count(own.where(placed), "left", "true")
    while n:
        parts = min(512, max(8, n // 25_000))
        taken = saved(_tiled(left, metres).repartition(parts, "band", "cell").groupBy("band", "cell").applyInPandas(run, f"id {kind}, cluster {kind}"), "taken")
        clusters = clusters.unionByName(taken)
        left, n = saved_with_count(left.join(taken.select("id"), "id", "left_anti"), "left", "true")
    return clusters


def agglomerative_clusters(points: np.ndarray, radius: float) -> list[list[int]]:
    """Pairs by distance, merged while all members stay within the radius of one another."""
    n = len(points)
    dist = haversine_of(points[:, None, 0], points[:, None, 1], points[None, :, 0], points[None, :, 1]) if n else np.empty((0, 0))
    owner, members = list(range(n)), {i: [i] for i in range(n)}
    for _, i, j in sorted((float(dist[i, j]), i, j) for i in range(n) for j in range(i + 1, n) if dist[i, j] <= radius):
        a, b = owner[i], owner[j]
        if a != b and dist[np.ix_(members[a], members[b])].max() <= radius:
            for k in members[b]:
                owner[k] = a
            members[a] += members.pop(b)
    return sorted(sorted(m) for m in members.values())
