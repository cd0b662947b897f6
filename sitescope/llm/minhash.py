"""Near-duplicates by HyperMinHash.

A document is the set of its distinct word shingles, as 64-bit hashes. Each hash
falls into one of 256 buckets by its leading bits; of the smallest hash of a bucket
the number of leading zeros and ten further bits are kept, so a register has two
bytes. Empty buckets borrow from the first full one of a fixed random order.

Documents with equal sets form a class and go on as its smallest id. Classes that
agree on a band of six registers are candidates: in a few rounds each with one hub of
its bands, then, where a band still holds several components, all pairs of different
components in it, in chunks. So a group of thousands of copies costs a pair a member,
and no link between components is passed over. The Jaccard estimate, corrected for chance
collisions, drops only candidates far below the threshold; the rest are confirmed
on the full sets. At a similarity of 0.8 the 42 bands miss three pairs in a million.

Defined results: a text without words, or null, has an empty set and links with
nothing; rows that share an id are one document with all their links; a row with a
null id links with nothing, has no component and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, components
from sitescope.session import checkpointed

BUCKETS, MANTISSA = 256, 10
BANDS, ROWS = 42, 6
#: Expected share of equal registers of disjoint sets (Yu and Weber, 2017, for sets of like size).
COLLISIONS = 0.169919487159739 / 2**MANTISSA
#: Rounds in which a document meets one hub, before what is left meets in pairs.
HUB_ROUNDS = 2
#: Documents of a chunk, about; a set of more bytes than ``CHUNK_SET`` counts as several.
CHUNK, CHUNK_SET = 256, 16 << 10
#: Six standard errors of the estimate at the threshold.
SLACK = 0.155
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
_REST = np.uint64((1 << 56) - 1)


#: Words whose hashes a worker remembers, some 20 MB of them.
REMEMBERED = 100_000


class _Hashes(dict):
    """64-bit hashes of words; bounded, as a cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str) -> list[bytes]:
    """Runs of other characters than blank and \\t\\n\\v\\f\\r, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one for the whole of a shorter text."""
    found = words(text) if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : n - k + 1 + i])
    return np.unique(_mix(out))


def _orders() -> np.ndarray:
    rng = np.random.default_rng(6)
    return np.array([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


_ORDERS = _orders()


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set that is not empty: leading zeros and mantissa bits, two bytes each."""
    at = np.searchsorted(found, _EDGES)
    full = np.minimum(at, len(found) - 1)
    has = (found[full] >> np.uint64(56)) == np.arange(BUCKETS, dtype=np.uint64)
    has &= at < len(found)
    mantissa, exponent = np.frexp(np.maximum(found[full] & _REST, np.uint64(1)).astype(np.float64))
    zeros = 57 - exponent
    registers = (zeros << MANTISSA | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    if not has.all():
        borrowed = _ORDERS[np.arange(BUCKETS), np.argmax(has[_ORDERS], axis=1)]
        registers = np.where(has, registers, registers[borrowed])
    return registers


def signatures(documents: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, digest of the set, band keys) of every row; whole texts."""
    arrow_rows(documents.sparkSession)

    def run(batches):
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                n, digests, sketches = [], [], []
                for t in batch.column(1).to_pylist():
                    found = shingles(t, size, hashes)
                    n.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sketches.append(sketch(found) if len(found) else None)
                full = [k for k, s in enumerate(sketches) if s is not None]
                keys: list = [None] * len(n)
                for k, row in zip(full, band_keys(np.array([sketches[k] for k in full]).reshape(-1, BUCKETS)), strict=True):
                    keys[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())],
                    ["id", "n_shingles", "digest", "bands"],
                )

    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, bands binary")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One hash for each band of each sketch."""
    rows = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        key = _mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, :, i])
    return _mix(key).view(np.int64)


def _bands(reps: DataFrame) -> DataFrame:
    """(band, rep): one row for each band of each representative."""

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "rep"])

    return reps.select("rep", "bands").mapInArrow(run, "band long, rep long")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for collisions of different elements."""
    equal = (a == b).mean(axis=1)
    return (equal - COLLISIONS) / (1 - COLLISIONS)


def _packed(found: np.ndarray) -> bytes:
    """The leading 48 bits of each hash; two different shingles of a pair agree in them once in 10^14."""
    return (found >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _profiles(documents: DataFrame, reps: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(rep, sketch, shingles) of the documents that have a band in common with another."""

    def run(batches):
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [shingles(t, size, hashes) for t in batch.column(1).to_pylist()]
                full = [k for k, f in enumerate(found) if len(f)]
                columns = [pa.array([sketch(found[k]).tobytes() for k in full], pa.binary()), pa.array([_packed(found[k]) for k in full], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full, pa.int64())), *columns], ["rep", "sketch", "shingles"])

    rows = documents.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    return rows.join(reps, "rep", "left_semi").mapInArrow(run, "rep long, sketch binary, shingles binary")


def _registers(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BUCKETS)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate is not far below the threshold and whose full sets reach it."""
    least = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).to_pylist() for k in (4, 5))
                likely = estimate(_registers(batch.column(2).to_pylist()), _registers(batch.column(3).to_pylist())) >= least
                keep = [bool(ok) and _similar(_unpacked(x[k]), _unpacked(y[k]), percent) for k, ok in enumerate(likely)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = profiles.select(F.col("rep").alias("a"), F.col("sketch").alias("ka"), F.col("shingles").alias("sa"))
    right = profiles.select(F.col("rep").alias("b"), F.col("sketch").alias("kb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb", "sa", "sb")
    return both.mapInArrow(run, "a long, b long").distinct()


def _hub_pairs(placed: DataFrame, tried: DataFrame | None) -> DataFrame:
    """One pair for each representative at most: with the hub of one of its bands.

    The hub of a band is the member that meets most others in all its bands, so the
    text that a group was copied from. Only hubs of another component that the member has
    not been compared with count, and of those the best.
    """
    first = F.max(F.struct("known", (-F.col("rep")).alias("low"), "c")).alias("hub")
    hubs = placed.groupBy("band").agg(first, F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("band", "hub")
    open_ = placed.join(hubs, "band").where(F.col("c") != F.col("hub.c"))
    open_ = open_.select("rep", F.col("hub.known").alias("known"), F.col("hub.low").alias("low")).distinct()
    a, b = F.least("rep", -F.col("low")), F.greatest("rep", -F.col("low"))
    open_ = open_.select("rep", "known", "low", a.alias("a"), b.alias("b"))
    if tried is not None:
        open_ = open_.join(tried, ["a", "b"], "left_anti")
    best = open_.groupBy("rep").agg(F.max(F.struct("known", "low", "a", "b")).alias("x"))
    return best.select("x.a", "x.b").distinct()


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows of (hub, rep, c, sketch, shingles) in chunks of bounded size: one row for each, with arrays.

    Documents that are joined by hubs are one cluster. A cluster is split by a hash of the
    hub, and what is still too large by a hash of the document, so the sizes hold
    whatever number of tasks there is.
    """
    rows = checkpointed(rows.withColumn("weight", F.greatest(F.lit(1.0), F.length("shingles") / CHUNK_SET)))
    clusters = components(rows.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    light = rows.select("rep", "hub", "weight").join(clusters, rows.rep == clusters.node, "left")
    light = light.select("rep", "hub", "weight", F.coalesce("component", "rep").alias("cluster"))
    share = lambda total, size, key: F.pmod(F.xxhash64(key), F.ceil(total / size).cast("long"))
    sums = light.groupBy("cluster").agg(F.sum("weight").alias("all"))
    light = light.join(sums, "cluster").withColumn("part", share(F.col("all"), CHUNK / 2, "hub")).drop("all")
    sums = light.groupBy("cluster", "part").agg(F.sum("weight").alias("all"))
    light = light.join(sums, ["cluster", "part"]).withColumn("piece", share(F.col("all"), CHUNK, "rep"))
    light = light.select("rep", F.concat_ws("-", "cluster", "part", "piece").alias("chunk")).distinct()
    full = rows.join(light, "rep").select("chunk", F.struct("rep", "c", "sketch", "shingles").alias("x"))
    lists = full.groupBy("chunk").agg(F.collect_list("x").alias("x"))
    return lists.select(
        "chunk", F.col("x.rep").alias("reps"), F.col("x.c").alias("cs"), F.col("x.sketch").alias("sketches"), F.col("x.shingles").alias("sets")
    )


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, some thousand shingles at a time."""
    names, codes = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(names), 4096):
        part = slice(*np.searchsorted(codes, (low, low + 4096)))
        dense = np.zeros((len(x) + len(y), 4096), np.float32)
        dense[rows[part], codes[part] - low] = 1
        out += dense[: len(x)] @ dense[len(x) :].T
    return np.rint(out).astype(np.int64)


def _linked(x: dict, y: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of two chunks that belong to different components."""
    apart = np.array(x["cs"])[:, None] != np.array(y["cs"])[None, :]
    a, b = _registers(x["sketches"]), _registers(y["sketches"])
    least = percent / 100 - SLACK
    for i in range(len(a)):
        apart[i] &= estimate(a[i : i + 1], b) >= least
    left, right = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
    if not len(left):
        return []
    s, t = [_unpacked(x["sets"][i]) for i in left], [_unpacked(y["sets"][j]) for j in right]
    near = apart[np.ix_(left, right)]
    if near.sum() > 400:
        common, n, m = _common(s, t), np.array([len(v) for v in s]), np.array([len(v) for v in t])
        near &= 100 * common >= percent * (n[:, None] + m[None, :] - common)
    else:
        for i, j in zip(*np.nonzero(near), strict=True):
            near[i, j] = _similar(s[i], t[j], percent)
    root: dict[int, int] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        v, w = x["reps"][left[i]], y["reps"][right[j]]
        p, q = find(v), find(w)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((v, w))
    return out


def _across(placed: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Links that are left between documents which share a band and not a component.

    The documents are put into chunks of bounded size, those of a hub together.
    Chunks that share a band meet once, whatever number of bands and pairs they share, and
    hand on at most a forest, so a group of documents just below the threshold costs
    its pairs in arithmetic, but not in rows.
    """
    top = F.max(F.struct("known", (-F.col("rep")).alias("low")))
    split = placed.groupBy("band").agg(top.alias("hub"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("band", "hub")
    open_ = checkpointed(placed.join(split, "band"))
    best = open_.groupBy("rep", "c").agg(F.max("hub").alias("hub")).select("rep", "c", (-F.col("hub.low")).alias("hub"))
    chunks = checkpointed(_chunks(best.join(profiles, "rep").select("hub", "rep", "c", "sketch", "shingles")))
    seen = chunks.select("chunk", F.explode("reps").alias("rep")).join(open_.select("rep", "band"), "rep").select("chunk", "band").distinct()
    x, y = seen.alias("x"), seen.alias("y")
    meet = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.chunk") <= F.col("y.chunk")))
    meet = meet.select(F.col("x.chunk").alias("x"), F.col("y.chunk").alias("y")).distinct()

    def run(batches):
        for batch in batches:
            links = [link for r in batch.to_pylist() for link in _linked(r["p"], r["q"], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in links], pa.int64()), pa.array([w for _, w in links], pa.int64())], ["a", "b"])

    first = chunks.select(F.col("chunk").alias("x"), F.struct("*").alias("p"))
    second = chunks.select(F.col("chunk").alias("y"), F.struct("*").alias("q"))
    arrow_rows(placed.sparkSession, 4)  # each row holds two chunks
    found = checkpointed(meet.join(first, "x").join(second, "y").select("p", "q").mapInArrow(run, "a long, b long"))
    arrow_rows(placed.sparkSession)
    return found


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Links have ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the
    smallest id reachable by links, and the document of that id is kept.
    """
    arrow_rows(documents.sparkSession)
    marks = checkpointed(signatures(documents, size, key, text))
    full = marks.where("n_shingles > 0 and id is not null")
    reps = checkpointed(
        full.groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("x")).select("digest", F.col("x.id").alias("rep"), "x.bands")
    )
    # Rows that share an id are one document: their classes belong together.
    twice = full.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("id")
    same = full.join(twice, "id", "left_semi").select("id", "digest").join(reps, "digest")
    same = same.select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a != b")

    bands = _bands(reps)
    mates = bands.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    crowded = bands.join(mates, "band")
    crowded = checkpointed(crowded.join(crowded.groupBy("rep").agg(F.sum("mates").alias("known")), "rep").select("band", "rep", "known"))
    profiles = checkpointed(_profiles(documents, crowded.select("rep").distinct(), size, key, text))
    joined, tried = components(same), None
    for last in (*[False] * HUB_ROUNDS, True):
        placed = crowded.join(joined, crowded.rep == joined.node, "left").select("band", "rep", "known", F.coalesce("component", "rep").alias("c"))
        if last:
            links = _across(placed, profiles, percent)
        else:
            pairs = checkpointed(_hub_pairs(placed, tried))
            tried = pairs if tried is None else tried.union(pairs)
            links = _confirmed(pairs, profiles, percent)
        joined = components(links.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    classes = reps.select("digest", "rep").join(joined, reps.rep == joined.node, "left")
    classes = classes.select("digest", F.coalesce("component", "rep").alias("class_component"))
    out = marks.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    out = out.select(
        F.col("id").alias(key),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), as it is.

    Rows that share an id are one document, so one row of the kept id stays: that of the
    longest text, of equally long ones the greatest. Rows with a null id link with nothing
    and all stay.
    """
    judged = near_duplicates(documents).where("doc_id is not null").groupBy("doc_id")
    judged = checkpointed(judged.agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    others = documents.join(judged, "doc_id", "left_anti").select(*documents.columns)
    again = judged.where("kept")
    if again.isEmpty():
        return others
    longest = F.max_by(F.struct("*"), F.struct(F.coalesce(F.length("text"), F.lit(-1)), "text"))
    rows = documents.join(again, "doc_id", "left_semi").select(*documents.columns).groupBy("doc_id").agg(longest.alias("row"))
    return others.union(rows.select(*[F.col("row")[c].alias(c) for c in documents.columns]))
