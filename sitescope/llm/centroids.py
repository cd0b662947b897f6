"""Exact Lloyd clustering with bounds that geometry keeps tight.

Vectors become integers, so distances, ties and means are exact. Each vector carries an
upper bound of the distance to its own centroid and a lower bound of the distance to
every other. When centroids move, the upper bound grows by the drift of its centroid. The
lower bound shrinks by less than the greatest drift: the vectors of a cluster lie in a
sphere around its old centroid, and seen from the midpoint between the old and new place
of another centroid, that sphere fills a cone in the plane through the three points. A
vector at the angle a to the drift comes nearer by at most ``drift * cos(a)``, and not at all
beyond the right angle, so the edge of the cone bounds the loss of the whole cluster.
Only vectors whose bounds meet are measured; where that does not settle it, all
centroids are scanned in exact arithmetic. Bounds are rounded to the safe side.

Vectors are packed into blocks once. Each round is one narrow pass over the blocks on
executors' disks; what reaches the driver is a sum for each cluster and component. A lost
executor's blocks are computed again from the last written ones.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component are left out; rows that share an id are vectors of their own; a null id is never
a first centroid unless there are too few others; fewer vectors than clusters give a cluster
each; an empty table gives no rows. Components beyond ``LARGEST`` count as that, and distances
and inertias beyond 64 bits as the largest long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows
from sitescope.session import checkpointed

#: Vectors of a block.
BLOCK = 4096
#: Rounds after which the blocks are written to the shared folder, so no lineage is longer.
WRITTEN = 10
LARGEST = 1 << 60
LONG = (1 << 63) - 1
_STATE = "ids array<long>, x binary, cluster binary, upper binary, lower binary, scanned long"
_KIND = pa.schema(
    [("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64())]
)


def usable(vector: str, size: int):
    """Whether a vector has the length and only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return (x.astype(np.int32) if not x.size or np.abs(x).max() < 1 << 31 else x).tobytes()


def _unpacked(raw: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * size else np.int64).reshape(n, size)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``: exact, as floats while they fit and else as Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    a, b = x.astype(object), c.astype(object)
    return np.array([((a - row) ** 2).sum(axis=1) for row in b], object).T.reshape(len(x), len(c))


def _up(bound):
    return bound * (1 + 1e-9) + 1e-6


def _down(bound):
    return np.maximum(bound * (1 - 1e-9) - 1e-6, 0)


def losses(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer any other centroid can have come to a vector of each cluster.

    Row i bounds, over all other centroids j, ``|x - old_j| - |x - new_j|`` for every x within
    ``radius[i]`` of ``old_i``. With m between old_j and new_j and a the angle of x - m to the drift,
    the difference is ``2 drift |x - m| cos(a) / (|x - old_j| + |x - new_j|)``, and the sum below it is
    at least ``2 |x - m|``. The sphere is seen from m within ``asin(radius / |old_i - m|)`` of its centre.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    out = np.zeros(len(old))
    for j in np.flatnonzero(drift):
        view = old - (old[j] + new[j]) / 2
        away = np.sqrt((view * view).sum(axis=1))
        inside = away <= radius * (1 + 1e-9)
        away = np.where(inside, 1, away)
        angle = np.arccos(np.clip(view @ (new[j] - old[j]) / (drift[j] * away), -1, 1))
        angle -= np.arcsin(np.clip(radius / away, 0, 1))
        loss = np.where(inside, drift[j], drift[j] * np.cos(np.clip(angle, 0, np.pi / 2)))
        loss[j] = 0
        out = np.maximum(out, np.minimum(_up(loss), _up(drift[j])))
    return out


def assigned(x, cluster, upper, lower, centroids, half):
    """(cluster, upper, lower, vectors scanned) for centroids that the bounds hold for already."""
    open_ = np.flatnonzero(_up(upper) >= np.maximum(lower, half[cluster]))
    if len(open_):  # measure the own centroid first
        own = np.zeros(len(open_))
        for j in np.unique(cluster[open_]):
            of = cluster[open_] == j
            own[of] = np.sqrt(squares(x[open_[of]], centroids[j : j + 1])[:, 0].astype(np.float64))
        upper[open_] = _up(own)
        open_ = open_[_up(upper[open_]) >= np.maximum(lower[open_], half[cluster[open_]])]
    if len(open_):
        found = squares(x[open_], centroids)
        cluster[open_] = best = np.argmin(found, axis=1)  # the smaller number of equal ones
        rows = np.arange(len(open_))
        far = found.astype(np.float64)
        upper[open_] = _up(np.sqrt(far[rows, best]))
        far[rows, best] = np.inf
        lower[open_] = _down(np.sqrt(far.min(axis=1)))
    return cluster, upper, lower, len(open_)


def _blocks(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows of (id, vector) as blocks that nothing is known of: own centroid 0, no bounds."""

    def run(batches):
        for batch in batches:
            x = whole_numbers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            ids = batch.column(0)
            rows = []
            for k in range(0, len(x), BLOCK):
                part = x[k : k + BLOCK]
                n = len(part)
                rows.append(
                    {
                        "ids": ids[k : k + BLOCK].to_pylist(), "x": _packed(part), "cluster": np.zeros(n, np.int32).tobytes(),
                        "upper": np.full(n, np.inf).tobytes(), "lower": np.zeros(n).tobytes(), "scanned": 0,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_KIND)

    return vectors.mapInArrow(run, _STATE)


def _step(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, loss: np.ndarray, half: np.ndarray) -> DataFrame:
    """The blocks after the centroids have moved."""
    size = centroids.shape[1]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = _unpacked(row["x"], len(row["ids"]), size)
                cluster = np.frombuffer(row["cluster"], np.int32).copy()
                upper = _up(np.frombuffer(row["upper"]) + drift[cluster])
                lower = _down(np.frombuffer(row["lower"]) - loss[cluster])
                cluster, upper, lower, n = assigned(x, cluster, upper, lower, centroids, half)
                out.append(row | {"cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "scanned": row["scanned"] + n})
            yield pa.RecordBatch.from_pylist(out, schema=_KIND)

    return state.mapInArrow(run, _STATE)


def _totals(state: DataFrame, k: int, size: int):
    """(sums, counts, radii, scanned) of the clusters; each task adds up its blocks first."""

    def run(batches):
        sums, counts, reach, scanned = np.zeros((k, size), object), [0] * k, [0.0] * k, 0
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row["x"], len(row["ids"]), size)
                cluster, upper = np.frombuffer(row["cluster"], np.int32), np.frombuffer(row["upper"])
                scanned += row["scanned"]
                exact = np.int64 if not x.size or np.abs(x).max() < 1 << 50 else object
                for j in np.unique(cluster):
                    of = cluster == j
                    sums[j] += x[of].astype(exact).sum(axis=0).astype(object)
                    counts[j] += int(of.sum())
                    reach[j] = max(reach[j], float(upper[of].max()))
        rows = [(j, i, int(sums[j][i]), 0.0) for j in range(k) if counts[j] for i in range(size)]
        rows += [(j, -1, counts[j], reach[j]) for j in range(k) if counts[j]] + [(-1, -1, scanned, 0.0)]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.float64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "total", "reach"])

    found = state.mapInArrow(run, "cluster int, place int, total decimal(38,0), reach double")
    found = found.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.max("reach").alias("reach"))
    sums, counts, reach, scanned = np.zeros((k, size), object), [0] * k, np.zeros(k), 0
    for r in found.collect():  # one row for each cluster and component
        if r.cluster < 0:
            scanned = int(r.total)
        elif r.place < 0:
            counts[r.cluster], reach[r.cluster] = int(r.total), r.reach
        else:
            sums[r.cluster][r.place] = int(r.total)
    return sums, counts, reach, scanned


def _half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other, rounded down."""
    gaps = np.sqrt(squares(c, c).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    return _down(gaps.min(axis=1) / 2)


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of seed and id."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("vector")]
    return np.array([whole_numbers(np.array(r.vector, np.float64), scale) for r in vectors.orderBy(*order).limit(k).collect()])


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3,
    key: str = "vec_id", vector: str = "embedding", report: list | None = None,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    ``report``, if given, gets for each assignment the number of vectors whose distances to all
    centroids were computed, and for each move the greatest drift and loss.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, BLOCK)
    kept = vectors.where(usable(vector, size)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    centroids = first_centroids(kept, k, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)
    state, held, seen = checkpointed(_blocks(kept, scale, size)), [], 0
    drift, loss = np.zeros(k), np.zeros(k)
    for turn in range(rounds + 1):
        state = _step(state, centroids, drift, loss, _half_gaps(centroids))
        if turn == rounds or turn % WRITTEN == WRITTEN - 1:
            state = checkpointed(state)
        else:
            state = state.persist(StorageLevel.DISK_ONLY)
            held.append(state)
        sums, counts, reach, scanned = _totals(state, k, size)
        while held and held[0] is not state:
            held.pop(0).unpersist()
        if report is not None:
            report.append((scanned - seen, float(drift.max()), float(loss.max())))
        seen = scanned
        if turn < rounds:
            moved = np.array([[int(s) // n for s in sums[j]] if (n := counts[j]) else centroids[j].tolist() for j in range(k)], np.int64)
            drift = np.array([_up(float(np.sqrt(float(sum(int(v) ** 2 for v in d))))) if d.any() else 0.0 for d in moved - centroids])
            loss, centroids = losses(centroids, moved, reach), moved

    def run(batches):
        for batch in batches:
            ids, numbers, found = [], [], []
            for row in batch.to_pylist():
                x, cluster = _unpacked(row["x"], len(row["ids"]), size), np.frombuffer(row["cluster"], np.int32)
                distance = np.zeros(len(x), object)
                for j in np.unique(cluster):
                    distance[cluster == j] = [min(int(d), LONG) for d in squares(x[cluster == j], centroids[j : j + 1])[:, 0]]
                ids += row["ids"]
                numbers += cluster.tolist()
                found += distance.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(found, pa.int64())], ["id", "cluster", "distance"])

    placed = state.mapInArrow(run, "id long, cluster int, distance long")
    sums = dict(placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    inertia = min(int(sum(sums.values())), LONG)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(j, min(int(sums[j]), LONG), inertia, digest(centroids[j])) for j in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = placed.join(F.broadcast(facts), "cluster")  # a row for each cluster
    return placed.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
