"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all benchmark items. A document's words
are streamed through it; the state and the longest matching length tell at every
word whether the last ten words stand in some item, and in which. Items shorter
than the window count as a whole. Only runs of benchmark words that are long enough
to hold a window are streamed, as all others end in the root.

Words: A-Z in lower case, runs of digits, letters and everything beyond ASCII. Null
texts have no words; a null item id counts as an item without a name. Items are read
in blocks of ``BLOCK_WORDS`` words, each an automaton of bounded size that is
broadcast; rows pass through one after the other and their hits add up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  # pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, aside

WINDOW = 10
#: Words of one broadcast automaton.
BLOCK_WORDS = 200_000
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD).split() if text else []


class Automaton:
    """Suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        whole: list[tuple] = []  # short items: (state, words, item)
        ends: list[list] = []  # long items: (state at each word, item)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if not ids:
                continue
            last, states = 0, []
            for word in ids:
                last = self._extend(last, word)
                states.append(last)
            if len(ids) < window:
                self.shortest = min(self.shortest, len(ids))
                whole.append((ids, item))
            else:
                ends.append((ids, item))
        self.items: list[set] = [set() for _ in self.next]
        for ids, item in ends:
            for end, state, length in self._walk(ids):
                if length >= window:
                    self.items[self._cut(state)].add(item)
        self.short: list[list] = [[] for _ in self.next]
        for ids, item in whole:
            *_, (_, state, _) = self._walk(ids)
            self.short[self._cut(state, len(ids))].append((len(ids), item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in order:
            self.short[s] = self.short[s] + self.short[self.link[s]] if self.short[self.link[s]] else self.short[s]
        self.at_window = [self._cut(s) if self.length[s] >= window else 0 for s in range(len(self.next))]

    def _extend(self, last: int, word: int) -> int:
        """State of the last sequence with one word more; shared states are split where needed."""
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _state(self, length: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]))
        self.link[copy], self.link[to] = self.link[to], copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _cut(self, state: int, length: int | None = None) -> int:
        """The state that holds this state's last ``length`` words."""
        length = length or self.window
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _walk(self, ids):
        """(place, state, longest matching length) after every word."""
        state = length = 0
        for i, word in enumerate(ids):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(word)
            if to is not None:
                state, length = to, length + 1
            yield i, state, length

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, as (first, end) in order, and the items with a window in ``found``."""
        if len(found) < self.shortest or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set = set()
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for i, state, length in self._walk(ids[begin:end].tolist()):
                size = 0
                if length >= self.window:
                    size = self.window
                    items |= self.items[self.at_window[state]]
                for k, item in self.short[state]:
                    if length >= k:
                        size = max(size, k)
                        items.add(item)
                if size:
                    first, stop = begin + i + 1 - size, begin + i + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, stop))
        return spans, items


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple]]:
    """Items in blocks of bounded size; the driver holds one block's texts at a time while it cuts them."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    blocks, block, total = [], [], 0
    for r in rows.toLocalIterator():
        n = len(words(r.t))
        if block and total + n > BLOCK_WORDS:
            blocks.append(block)
            block, total = [], 0
        block.append((r.i, r.t))
        total += n
    return [*blocks, block] if block else blocks


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``spans`` (first and end word of each hit run) and ``items``.

    Columns of those names are replaced; every row stays. One pass a block of items.
    """
    spark = documents.sparkSession
    arrow_rows(spark)
    frame = documents.drop("n_words", "spans", "items").withColumns(
        {"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<first:int,stop:int>>"), "items": F.array().cast("array<string>")}
    )
    place, schema = frame.columns.index(text), frame.schema
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
    for block in _blocks(benchmark, item, item_text) or [[]]:
        model = spark.sparkContext.broadcast(block)

        def run(batches, model=model):
            automaton = Automaton(model.value, window)
            for batch in batches:
                n, spans, items = [], [], []
                rows = zip(batch.column(place).to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for t, old, named in rows:
                    found = words(t)
                    n.append(len(found))
                    new, hit = automaton.scan(found)
                    if old:
                        new = _merged([(s["first"], s["stop"]) for s in old] + new)
                    spans.append([{"first": a, "stop": b} for a, b in new])
                    items.append(sorted(x for x in hit.union(named) if x is not None))
                columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("n_words", "spans", "items")]
                names = [x for x in batch.schema.names if x not in ("n_words", "spans", "items")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
                    [*names, "n_words", "spans", "items"],
                )

        frame = frame.mapInArrow(run, schema)
    return frame


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((first, stop))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, and the items that have a window in it."""
    found = find_hits(documents.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.first)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each run of words, and what stands between them, replaced by a line break."""
    raw = text.encode("utf-8", "replace")
    plain = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    parts, at = [], 0
    for first, stop in spans:
        parts.append(raw[at : begins[first]])
        at = int(ends[stop - 1])
    return b"\n".join([*parts, raw[at:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, most_cover: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Documents without benchmark passages; columns stay, ``n_chars`` follows the text.

    A document goes if more than ``most_cover`` of its words are hit; of others the hit
    runs go, again until none is left (a cut can bring words together). Untouched
    documents are returned as they are, with null and empty texts.
    """
    rows, names = aside(documents)
    found = find_hits(rows, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.first)
    found = found.where(hit <= F.col("n_words") * most_cover).drop("n_words", "items")
    blocks = [documents.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, "item_id", "text")]
    place = found.columns.index("text")

    def run(batches):
        automata = None
        for batch in batches:
            old, spans = batch.column(place), batch.column("spans")
            touched = pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False).nonzero()[0]
            new = {}
            for k in touched.tolist():
                t, cuts = old[k].as_py(), [(s["first"], s["stop"]) for s in spans[k].as_py()]
                while cuts:
                    t = cut(t, cuts)
                    automata = automata or [Automaton(b.value, window) for b in blocks]
                    cuts = _merged([s for a in automata for s in a.scan(words(t))[0]])
                new[k] = t
            if new:
                column = pa.array([new.get(k, t) for k, t in enumerate(old.to_pylist())], pa.string())
                batch = batch.set_column(place, "text", column)
            yield batch

    clean = found.mapInArrow(run, found.schema)
    values = {c: F.col(n) for c, n in names.items()}
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col(names["n_chars"]))
    return clean.select(*[v.alias(c) for c, v in values.items()])
