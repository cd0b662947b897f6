"""Exact ranked search by sparse ball trees.

A document is a vector over terms whose components are the integers that the score adds
up for one occurrence of the term in a query; a query is the vector of its term counts, so the
score is an inner product. Documents are cut into blocks, and a block is split in
halves along the line between two far documents until few are left. Each node has the
centroid c of its documents and two kinds of radius around it: r over all terms, and r_t in
the direction of each. No document below can score more than ``q . c + |q| r``, nor
more than ``sum of q_t (c_t + r_t)``; the smaller counts. Subtrees are opened best first, bounds
are rounded up, and a node goes unopened only if its bound is below the tenth best score so
far. Leaves are scored in 64-bit integers, so pruning never changes a result.

Only components that a query asks for can count, so those of other terms are not stored.
Queries go in blocks of bounded size, and each block is one pass over the compact vectors.
The number of documents, their terms and, for each term asked for, the documents
that hold it are added up over all documents. Tasks hand on ten documents an item, and ranks
are taken over those.

Defined results: null texts have no terms; documents without terms count nowhere; rows that
share an id are documents, or items, of their own; equal scores go by ascending id, nulls last.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows
from sitescope.session import checkpointed

#: Terms of the queries of one pass, about; a longer query is a pass of its own.
PASS_TERMS = 16_384
#: Documents of a tree, and their components at most.
BLOCK, BLOCK_ENTRIES = 4096, 2_000_000
#: Numbers of the centroids of a tree at most; with very many terms asked for, blocks are smaller.
CENTROIDS = 1 << 23
LEAF = 4
#: Subtrees that are ordered by their bounds.
SUBTREES = 16
TOP = 10
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return _TERM.findall(text.encode("utf-8", "replace").translate(_LOWER)) if text else []


def weight(documents: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64)


def components(times: np.ndarray, lengths: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one occurrence of a query term adds to the score of a document that holds it ``times`` times."""
    norm = 25 + 75 * lengths * documents // max(total, 1)
    return weights * (1_000_000_000 * times // (1000 * times + 8 * norm))


def _above(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none below the value it stands for."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Tree:
    """A ball tree over sparse rows: ``starts`` and ``index``/``value`` as in compressed rows.

    Node k has the children 2 k + 1 and 2 k + 2 and the rows ``low[k]`` to ``high[k]`` of ``order``;
    all leaves are of one depth, as halves differ by one row at most.
    """

    def __init__(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray, size: int):
        self.size, n = size, len(starts) - 1
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        nodes = 2 ** (depth + 1) - 1
        self.first_leaf = nodes // 2
        self.order = np.arange(n)
        self.low, self.high = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.high[0] = n
        self.centroids, self.reach = np.zeros((nodes, size), np.float32), np.zeros((nodes, size), np.float32)
        self.radius = np.zeros(nodes)
        floats, lengths = value.astype(np.float64), np.diff(starts)
        for node in range(nodes):
            low, high = self.low[node], self.high[node]
            rows = self.order[low:high]
            entries = _ranges(starts[rows], lengths[rows])
            at, v = index[entries], floats[entries]
            owner = np.repeat(np.arange(len(rows)), lengths[rows])
            c = self.centroids[node] = _above(np.bincount(at, v, size) / max(len(rows), 1))
            c = c.astype(np.float64)
            # |x - c|^2 is |c|^2 and, for the terms of x, (x - c)^2 - c^2
            far = np.bincount(owner, (v - c[at]) ** 2 - c[at] ** 2, len(rows)) + c @ c
            self.radius[node] = np.sqrt(max(far.max(initial=0), 0) * (1 + 1e-9)) + 1e-3
            if node >= self.first_leaf:
                np.maximum.at(self.reach[node], at, _above(v))
                continue
            if len(rows) > 1:
                p = _dense(starts, index, floats, rows[int(np.argmax(far))], size)
                apart = np.bincount(owner, (v - p[at]) ** 2 - p[at] ** 2, len(rows))
                q = _dense(starts, index, floats, rows[int(np.argmax(apart))], size)
                self.order[low:high] = rows[np.argsort(np.bincount(owner, v * (q - p)[at], len(rows)), kind="stable")]
            middle = low + len(rows) // 2
            self.low[2 * node + 1], self.high[2 * node + 1], self.low[2 * node + 2], self.high[2 * node + 2] = low, middle, middle, high
        for node in range(self.first_leaf - 1, -1, -1):
            np.maximum(self.reach[2 * node + 1], self.reach[2 * node + 2], out=self.reach[node])
        entries = _ranges(starts[self.order], lengths[self.order])
        self.index, self.value = index[entries], value[entries]
        self.starts = np.concatenate([[0], np.cumsum(lengths[self.order])])

    def bounds(self, nodes: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The most that a row below each node can score.

        Along one term, a row is at most ``reach`` (the centroid and the radius in that direction);
        in all directions together it is within ``radius`` of the centroid.
        """
        where = np.ix_(nodes, at)
        ball = self.centroids[where].astype(np.float64) @ times + self.radius[nodes] * np.sqrt(times @ times)
        return np.minimum(ball, self.reach[where].astype(np.float64) @ times) * (1 + 1e-9) + 1

    def search(self, at: np.ndarray, times: np.ndarray, best: list, ids: list, limit: int = TOP) -> int:
        """Adds what the tree holds to ``best``, a heap of the best documents; returns the documents scored.

        Subtrees are opened best first. Within one, all nodes of a level that may still count
        are bounded together, down to the leaves, which are scored together.
        """
        query = np.zeros(self.size, np.int64)
        query[at] = times
        floats, scored = times.astype(np.float64), 0
        least = lambda: best[0][0] if len(best) >= limit else 1  # noqa: E731  # equal scores may win by their ids
        tops = np.array([0])
        while tops[0] < self.first_leaf and len(tops) < SUBTREES:
            tops = np.concatenate([2 * tops + 1, 2 * tops + 2])
        bound = self.bounds(tops, at, floats)
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < least():
                break
            nodes = tops[k : k + 1]
            while len(nodes) and nodes[0] < self.first_leaf:
                nodes = np.concatenate([2 * nodes + 1, 2 * nodes + 2])
                nodes = nodes[self.bounds(nodes, at, floats) >= least()]
            rows = _ranges(self.low[nodes], self.high[nodes] - self.low[nodes])
            if not len(rows):
                continue
            lengths = self.starts[rows + 1] - self.starts[rows]
            entries = _ranges(self.starts[rows], lengths)
            sums = np.add.reduceat(self.value[entries] * query[self.index[entries]], np.cumsum(lengths) - lengths)
            scored += len(rows)
            likely = np.flatnonzero(sums >= least())
            for j in likely[np.argsort(-sums[likely], kind="stable")].tolist():
                if sums[j] < least():
                    break
                _offer(best, int(sums[j]), ids[self.order[rows[j]]], limit)
        return scored


def _offer(best: list, score: int, key, limit: int) -> None:
    """Keeps the highest scores, of equal ones the smallest ids; no id counts as the largest."""
    entry = (score, 0 if key is None else 1, 0 if key is None else -key)
    if len(best) < limit:
        heapq.heappush(best, entry)
    elif entry > best[0]:
        heapq.heapreplace(best, entry)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs with these starts and lengths."""
    total = int(lengths.sum())
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def _dense(starts, index, floats, row, size) -> np.ndarray:
    out = np.zeros(size)
    out[index[starts[row] : starts[row + 1]]] = floats[starts[row] : starts[row + 1]]
    return out


def _sizes(items: DataFrame) -> DataFrame:
    """Items with the number of their terms."""

    def run(batches):
        for batch in batches:
            counts = [len(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n"])

    return items.mapInArrow(run, "item long, item_id long, text string, n long")


def _vectors(documents: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, times) of documents that hold some asked term; (null, n, null, null) sums up the others' lengths.

    ``terms`` and ``times`` are packed 32-bit numbers. Documents without terms leave no row.
    """
    names = documents.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        lookup = names.value
        for batch in batches:
            ids, lengths, at, times, held = [], [], [], [], []
            rest, others = 0, 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                counted = Counter(filter(lookup.__contains__, found))
                if counted:
                    pairs = sorted((lookup[t], n) for t, n in counted.items())
                    ids.append(key)
                    lengths.append(len(found))
                    held.append(1)
                    at.append(np.array([p[0] for p in pairs], np.int32).tobytes())
                    times.append(np.array([p[1] for p in pairs], np.int32).tobytes())
                elif found:
                    rest, others = rest + len(found), others + 1
            if others:
                for column, value in zip((ids, lengths, held, at, times), (None, rest, others, None, None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, lengths, held, at, times), kinds, strict=True)], ["id", "n", "held", "at", "times"])

    return documents.mapInArrow(run, "id long, n long, held long, at binary, times binary")


def _holding(vectors: DataFrame, size: int) -> np.ndarray:
    """For each asked term the documents that hold it; tasks add up theirs first."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(filter(None, batch.column(0).to_pylist())), np.int32), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["term", "n"])

    found = vectors.select("at").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in found.collect():  # one row for each term of the pass
        out[r.term] = r.n
    return out


def _searched(vectors: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, total: int, limit: int) -> DataFrame:
    """(item, id, score) of the best documents of each task, and (-1, null, documents scored)."""
    size = len(weights)
    common = vectors.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = common.value
        most = min(BLOCK, max(LEAF, CENTROIDS // size * LEAF // 2))
        best: list[list] = [[] for _ in queries]
        scored = 0

        def done(rows):
            ids = [r[0] for r in rows]
            at, times = (np.frombuffer(b"".join(r[k] for r in rows), np.int32) for k in (2, 3))
            counts = np.array([len(r[2]) // 4 for r in rows], np.int64)
            lengths = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
            value = components(times.astype(np.int64), lengths, weights[at], documents, total)
            tree = Tree(np.concatenate([[0], np.cumsum(counts)]), at, value, size)
            return sum(tree.search(a, t, heap, ids, limit) for (_, a, t), heap in zip(queries, best, strict=True))

        rows, entries = [], 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in ("id", "n", "at", "times")), strict=True):
                if rows and (len(rows) >= most or entries + len(r[2]) // 4 > BLOCK_ENTRIES):
                    scored += done(rows)
                    rows, entries = [], 0
                rows.append(r)
                entries += len(r[2]) // 4
        if rows:
            scored += done(rows)
        out = [(q[0], -k if some else None, score) for q, heap in zip(queries, best, strict=True) for score, some, k in heap] + [(-1, None, scored)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["item", "id", "score"])

    return vectors.where("at is not null").mapInArrow(run, "item long, id long, score long")


def ranked(
    documents: DataFrame, items: DataFrame, limit: int = TOP, key: str = "doc_id", item: str = "item_id", text: str = "text", report: list | None = None
) -> DataFrame:
    """(item, rank, key, score) of the ``limit`` best documents of every item with a score above 0.

    ``report``, if given, gets for each pass the documents scored at leaves, the queries, and the documents that hold an asked term.
    """
    spark = documents.sparkSession
    arrow_rows(spark, 2000)
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    asked = checkpointed(_sizes(asked))
    passes = 1 + (asked.agg(F.sum("n")).first()[0] or 0) // PASS_TERMS
    found = []
    for turn in range(passes):
        chosen = asked.where("n > 0").where(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn).select("item", "text").collect()  # about PASS_TERMS terms
        names: dict[bytes, int] = {}
        queries = []
        for r in chosen:
            counted = Counter(names.setdefault(t, len(names)) for t in terms(r.text))
            queries.append((r.item, np.array(list(counted), np.int32), np.array(list(counted.values()), np.int64)))
        if not queries:
            continue
        vectors = checkpointed(_vectors(docs, names))
        count, total, held = vectors.agg(F.sum("held"), F.sum("n"), F.count("at")).first()
        if not held:
            continue
        weights = weight(count, _holding(vectors, len(names)))
        part = checkpointed(_searched(vectors, queries, weights, count, total, limit))
        if report is not None:
            report.append((part.where("item = -1").agg(F.sum("score")).first()[0], len(queries), held))
        found.append(part.where("item >= 0"))
    if not found:
        return spark.createDataFrame([], f"{item} long, rank int, {key} long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item), "rank", F.col("id").alias(key), "score")
