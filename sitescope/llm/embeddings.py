"""Near-duplicate vectors by an epsilon grid order join.

Two vectors of one label have a cosine of at least t exactly when their unit vectors
are within eps = sqrt(2 - 2 t). Equal vectors form a class. Classes are sorted by
their grid cells (of width eps) on the leading principal dimensions and cut into
sequences of bounded length; two sequences meet only if their cells on the first
dimension are neighbours and their boxes are within eps. A pair of sequences is
joined by halving them, skipping halves whose boxes are further apart than eps;
what remains is compared by cosine in double precision.

A pair of sequences hands on counts of links and the links of a spanning forest, not
the links themselves, so a group of thousands costs its size and not its square.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do those with a null label or id; vectors of different lengths never
link. Repeated rows, also of one id, are vectors of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, components, widened
from sitescope.session import checkpointed

LENGTH = 1024  # vectors of a sequence
LEAF = 128  # below that, sequences are compared as they are
SORTED_DIMENSIONS = 6
#: Vectors that the principal dimensions are fitted on; results do not depend on them.
FITTED = 4096


def _clean(rows: DataFrame) -> DataFrame:
    """(id, label, size, digest, vector) of the vectors that can link."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = (x + 0.0).tobytes()
                for column, value in zip(out, (i, label, len(x), hashlib.blake2b(raw, digest_size=16).digest(), raw), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "label", "size", "digest", "vector"])

    return rows.where("id is not null and label is not null").mapInArrow(run, "id long, label string, size int, digest binary, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of large components
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal dimensions for each vector length, the leading first, from at most ``FITTED`` vectors."""
    by: dict[int, list] = {}
    for r in classes.select("size", "vector").orderBy("digest").limit(FITTED).collect():
        by.setdefault(r["size"], []).append(np.frombuffer(bytes(r["vector"])))
    bases = {}
    for size, vectors in by.items():
        x = _unit(np.array(vectors))
        values, vectors_ = np.linalg.eigh(np.cov(x.T).reshape(size, size) if len(x) > 1 else np.eye(size))
        bases[size] = vectors_[:, np.argsort(-values)]
    return bases


def _sequences(classes: DataFrame, bases, eps: float) -> DataFrame:
    """Classes sorted by grid cells and cut: one row for each sequence, with its box and its vectors."""
    cells = [f"c{i}" for i in range(SORTED_DIMENSIONS)]

    def place(batches):
        for batch in batches:
            sizes, raw = batch.column("size").to_pylist(), batch.column("vector").to_pylist()
            found = np.zeros((len(raw), SORTED_DIMENSIONS), np.int32)
            for i, (size, v) in enumerate(zip(sizes, raw, strict=True)):
                x = _unit(np.frombuffer(v)[None, :])
                x = (x @ bases.value[size] if size in bases.value else x)[0, :SORTED_DIMENSIONS]
                found[i, : len(x)] = np.floor(x / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in found.T]], [*batch.schema.names, *cells])

    def cut(batches):
        rows: list[tuple] = []

        def done():
            x = np.array([np.frombuffer(r[5]) for r in rows])
            y = _unit(x)
            y = y @ bases.value[rows[0][1]] if rows[0][1] in bases.value else y
            first = np.floor(y[:, 0] / eps).astype(int)
            return {
                "sequence": f"{rows[0][4].hex()}-{rows[0][1]}-{rows[0][0]}", "label": rows[0][0], "size": rows[0][1], "low_cell": int(first.min()), "high_cell": int(first.max()),
                "low": y.min(axis=0).tobytes(), "high": y.max(axis=0).tobytes(), "vectors": x.tobytes(),
                "reps": [r[2] for r in rows], "copies": [r[3] for r in rows], "digests": [r[4] for r in rows],
            }

        def out(found):
            return pa.RecordBatch.from_pylist([found], schema=kind)

        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("label", "size", "rep", "copies", "digest", "vector")), strict=True):
                if rows and (len(rows) >= LENGTH or r[:2] != rows[0][:2]):
                    yield out(done())
                    rows = []
                rows.append(r)
        if rows:
            yield out(done())

    kind = pa.schema(
        [("sequence", pa.string()), ("label", pa.string()), ("size", pa.int32()), ("low_cell", pa.int32()), ("high_cell", pa.int32()), ("low", pa.binary()),
         ("high", pa.binary()), ("vectors", pa.binary()), ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))]
    )
    schema = widened(classes, **dict.fromkeys(cells, "integer"))
    keys = ["label", "size", *cells, "digest"]
    placed = classes.mapInArrow(place, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(
        cut,
        "sequence string, label string, size int, low_cell int, high_cell int, low binary, high binary, vectors binary, "
        "reps array<long>, copies array<long>, digests array<binary>",
    )


class _Side:
    def __init__(self, row, basis):
        size = row["size"]
        self.x = _unit(np.frombuffer(row["vectors"]).reshape(-1, size))
        self.y = self.x @ basis if basis is not None else self.x
        self.copies = np.array(row["copies"], np.int64)
        self.links = np.zeros(len(self.x), np.int64)


def _far(a: _Side, i: slice, b: _Side, j: slice, eps: float) -> bool:
    gap = np.maximum(a.y[i].min(axis=0) - b.y[j].max(axis=0), b.y[j].min(axis=0) - a.y[i].max(axis=0))
    gap = np.maximum(gap, 0)
    return float(gap @ gap) > eps * eps * (1 + 1e-9) + 1e-9


def _join(a: _Side, i: slice, b: _Side, j: slice, least: float, eps: float, found: list) -> None:
    """Links between two intervals of sequences; intervals of one sequence meet once."""
    if a is b and i.start > j.start or (a is not b or i != j) and _far(a, i, b, j, eps):
        return
    n, m = i.stop - i.start, j.stop - j.start
    if max(n, m) > LEAF:
        halves = lambda s, k: [slice(s.start, s.start + k // 2), slice(s.start + k // 2, s.stop)] if k > LEAF else [s]
        for p in halves(i, n):
            for q in halves(j, m):
                _join(a, p, b, q, least, eps, found)
        return
    near = a.x[i] @ b.x[j].T >= least
    if a is b and i == j:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    a.links[i] += near @ b.copies[j]
    if not (a is b and i == j):
        b.links[j] += near.T @ a.copies[i]
    left, right = np.arange(i.start, i.stop), np.arange(j.start, j.stop) + (0 if a is b else len(a.x))
    none = 1 << 60
    while True:  # spanning forest of this leaf: the smallest place that each can reach
        new_left = np.minimum(left, np.where(near, right, none).min(axis=1))
        new_right = np.minimum(right, np.where(near.T, new_left, none).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    for begin, labels in ((i.start, left), (j.start + (0 if a is b else len(a.x)), right)):
        own = np.arange(begin, begin + len(labels))
        found += zip(own[own != labels].tolist(), labels[own != labels].tolist(), strict=True)


def _forest(edges: list, n: int) -> list[tuple[int, int]]:
    """The edges of a forest of stars with the same components."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in {v for e in edges for v in e} if find(x) != x]


def links(classes: DataFrame, least: float) -> DataFrame:
    """(digest, label, links, a, b): counts of links of classes, and links of spanning forests."""
    spark = classes.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    bases = spark.sparkContext.broadcast(_bases(classes))
    rows = checkpointed(_sequences(classes, bases, max(eps, 1e-6)))
    arrow_rows(spark, 8)  # each row holds a sequence of vectors
    box = rows.select("sequence", "label", "size", "low_cell", "high_cell", "low", "high")
    left = box.withColumn("cell", F.explode(F.sequence("low_cell", "high_cell")))
    right = box.withColumn("cell", F.explode(F.sequence(F.col("low_cell") - 1, F.col("high_cell") + 1)))
    x, y = left.alias("x"), right.alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("label", "size", "cell")]
    pairs = x.join(y, same[0] & same[1] & same[2] & (F.col("x.sequence") <= F.col("y.sequence")))
    pairs = pairs.select(F.col("x.sequence").alias("s"), F.col("y.sequence").alias("t"), "x.low", "x.high", F.col("y.low").alias("low2"), F.col("y.high").alias("high2"))

    def close(batches):
        for batch in batches:
            keep = []
            for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                gap = np.maximum(np.maximum(np.frombuffer(a) - np.frombuffer(d), np.frombuffer(c) - np.frombuffer(b)), 0)
                keep.append(bool(gap @ gap <= eps * eps * (1 + 1e-9) + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["s", "t"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.distinct().mapInArrow(close, "s string, t string")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                basis = bases.value.get(r["x"]["size"])
                a = _Side(r["x"], basis)
                b = a if r["x"]["sequence"] == r["y"]["sequence"] else _Side(r["y"], basis)
                found: list = []
                _join(a, slice(0, len(a.x)), b, slice(0, len(b.x)), least, eps, found)
                reps = r["x"]["reps"] + ([] if a is b else r["y"]["reps"])
                for row, side in ((r["x"], a),) if a is b else ((r["x"], a), (r["y"], b)):
                    out += [{"label": row["label"], "digest": row["digests"][k], "links": int(side.links[k])} for k in np.flatnonzero(side.links)]
                out += [{"a": reps[v], "b": reps[w]} for v, w in _forest(found, len(reps))]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = pa.schema([("label", pa.string()), ("digest", pa.binary()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    full = rows.select("sequence", "size", "label", "vectors", "reps", "copies", "digests")
    first = full.select(F.col("sequence").alias("s"), F.struct("*").alias("x"))
    second = full.select(F.col("sequence").alias("t"), F.struct("*").alias("y"))
    both = pairs.join(first, "s").join(second, "t").select("x", "y")
    return checkpointed(both.mapInArrow(run, "label string, digest binary, links long, a long, b long"))


def near_vectors(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; see the module for what can link."""
    arrow_rows(vectors.sparkSession, 500)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    clean = checkpointed(_clean(rows))
    classes = checkpointed(
        clean.groupBy("label", "size", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    found = links(classes, least)
    arrow_rows(vectors.sparkSession, 500)
    counts = found.where("digest is not null").groupBy("label", "digest").agg(F.sum("links").alias("links"))
    # Classes whose smallest ids are equal meet in that id.
    whole = clean.select("id", "label", "digest").join(classes.select("label", "digest", "rep", "copies"), ["label", "digest"])
    joined = components(found.where("a != b").select("a", "b"))
    placed = whole.join(counts, ["label", "digest"], "left").join(joined, whole.rep == joined.node, "left")
    placed = placed.select(
        F.col("id").alias(key), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    lone = _unlinked(rows).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return placed.union(lone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _unlinked(rows: DataFrame) -> DataFrame:
    """The rows that can link with nothing."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    usable = F.exists("vector", lambda x: x != 0) & ~F.exists("vector", bad) & F.col("id").isNotNull() & F.col("label").isNotNull()
    return rows.where(~F.coalesce(usable, F.lit(False)))
