"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z in lower case) and one end. The frequent words of the
training documents, the end and one escape have a Huffman code, and all decisions of a
code are predicted bit by bit. Each decision is predicted from several hashed contexts (the
word before, the two before, the last of the most frequent words, which tells languages
apart) and from the decision alone; every predictor gives the log odds of its counts.
Weights, chosen by a gate (how much the contexts have been seen), mix them; a last map
refines the mixed odds. A word behind the escape is coded
by its frequency among all words without a code, each plus one, and one place for
words never seen: the probabilities of all texts add up to at most 1.

Counting reads all training documents; counts are whole numbers that tasks add up, so a score
does not depend on how rows are dealt. Weights and map, some hundred numbers, are fitted on all
training texts too, in one pass: every text is predicted by the counts of all other texts under the first
weights; a Newton step over the sums of all errors gives the weights, and how often each mixed
probability came true gives the map. Sums are of whole numbers as well. Predictor tables have a
fixed number of slots; the counts of words follow the corpus and are joined by Spark, never
broadcast, but for the words with a code.

The work is held down by what a core keeps near: texts are taken in runs of some thousand tokens,
four decisions in a row share a line of each table, and Arrow splits and looks up the words.

A null or empty text is one end. A null id is neither held out nor trained on, and
repeated rows are scored alike; with no training rows every token is unknown.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, fold
from sitescope.session import checkpointed

#: A word has a code if it is more than one in so many tokens, so there are fewer codes than that;
#: and the longest of them in bytes. The code book is broadcast.
CODED, CODED_BYTES = 1 << 18, 64
#: Rows of the last map, by the place of a decision in its code; deeper ones share the last.
LEVELS = 16
TABLE_BITS = 19
CONTEXTS = 3
GATES = 16
#: Symbols, by frequency, that mark a stretch of text.
MARKS = 12
STEPS = 33  # of the last map, over the mixed log odds from -8 to 8
GRID = 1024  # steps of the mixed log odds in the table that scoring looks up
#: The key of the end, and of the escape; neither can be a word.
END, ESCAPE = b" ", b"  "
#: Parts of one in the sums of a fit, for log odds and for probabilities; products add up exactly.
ODDS_PARTS, PARTS = 64, 1024
#: Of the contexts, of the decision alone, and the constant.
FIRST_WEIGHTS = (0.3, 0.3, 0.5, -0.4, 0.0)
#: Decisions that the first weights and the first map count as.
PRIOR = 50
#: Tokens that are taken at once, but for longer texts; their arrays of decisions stay in a core's cache.
RUN = 6_000
#: Rows of counts that a task holds before it adds them up.
HELD = 500_000
_PRIME = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ODD, _SALT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Whole numbers of one, two, four and eight bytes.
_KINDS = (np.uint8, np.uint16, np.uint32, np.int64)
_SLICES = 128  # of each table, for the sum


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, as bytes, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, own = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    kept = pc.greater(pc.binary_length(found), 0)  # white space at an edge leaves an empty one
    row = np.repeat(np.arange(len(own)), own)[kept.to_numpy(zero_copy_only=False)]
    return found.filter(kept), np.bincount(row, minlength=len(own))


def count_words(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over whole training texts with their ends; each task adds up what it holds."""

    def run(batches):
        held, rows, ends = [], 0, 0

        def added():
            every = pa.concat_tables([*held, pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())})])
            return every.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

        for batch in batches:
            found = pc.value_counts(words(batch.column(0))[0])
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            rows, ends = rows + len(found), ends + batch.num_rows
            if rows > HELD:
                yield from added()
                held, rows, ends = [], 0, 0
        if ends:
            yield from added()

    return training.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Book:
    """Codes of the frequent words: for each symbol its decisions and the nodes where they fall."""

    def __init__(self, coded: list[tuple[bytes, int]], total: int, kinds: int):
        self.total, self.kinds = total, kinds
        self.rare_total = total - sum(n for _, n in coded)
        self.rare_kinds = kinds - len(coded)
        names = [w for w, _ in coded]
        if END not in names:
            coded = [*coded, (END, 0)]
        self.count = np.array([n for _, n in coded] + [0], np.int64)
        weight = [n + 1 for _, n in coded] + [self.rare_total + 1]
        self.symbol = {w: i for i, (w, _) in enumerate(coded)}
        self.words = pa.array([w for w, _ in coded], pa.binary())
        self.escape = len(coded)
        self.end = self.symbol[END]
        self._code(weight)
        plain = -math.log10(total + kinds + 1)
        self.base = np.log10(self.count + 1) + plain
        self.plain = plain

    def _code(self, weight: list[int]) -> None:
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        down: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            down[n + len(down)] = (i, j)
            heapq.heappush(heap, (a + b, n + len(down) - 1))
        self.depth = np.zeros(n, np.int64)
        codes: list[tuple] = [((), ())] * n
        open_ = [(heap[0][1], [], [])]
        inner = 0
        while open_:
            at, nodes, bits = open_.pop()
            if at < n:
                self.depth[at], codes[at] = len(nodes), (nodes, bits)
                continue
            i, j = down[at]
            open_ += [(i, [*nodes, inner], [*bits, 0]), (j, [*nodes, inner], [*bits, 1])]
            inner += 1
        self.nodes = max(1, inner)
        self.starts = np.cumsum(self.depth) - self.depth
        self.steps = np.array([2 * v + b for nodes, bits in codes for v, b in zip(nodes, bits, strict=True)], np.int64)
        # Four decisions in a row share a cell of sixteen slots, named by the node of the first; a slot in it, by the bits between.
        self.salt = np.array([nodes[k - k % 4] for nodes, _ in codes for k in range(len(nodes))], np.uint32) * _SALT
        self.local = np.array([_local(bits[k - k % 4 : k]) for _, bits in codes for k in range(len(bits))], np.uint32)

    def symbols(self, found: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(found, value_set=self.words), self.escape).to_numpy(zero_copy_only=False)


def _local(bits: list[int]) -> int:
    """One, and the bits behind it."""
    return sum(b << k for k, b in enumerate([*reversed(bits), 1]))


def _decisions(book: Book, symbols: np.ndarray, first: np.ndarray):
    """(node, bit, slots of each context, token, level) of every decision; ``first`` marks the first token of a text."""
    one = np.empty(len(symbols), np.uint64)
    one[1:] = symbols[:-1] + 1
    one[first] = 0
    two = np.empty(len(symbols), np.uint64)
    two[1:] = one[:-1]
    two[first] = 0
    # The last of the most frequent words before a token, as they tell languages and topics apart.
    at = np.arange(len(symbols))
    begin = np.zeros(len(symbols), np.int64)
    begin[first] = first
    begin = np.maximum.accumulate(begin)
    marks = np.zeros(len(symbols), np.int64)
    marks[1:] = np.where(symbols[:-1] < MARKS, at[1:], 0)
    marks = np.maximum.accumulate(marks)
    mark = np.where(marks > begin, one[marks], np.uint64(0))
    keys = (one * _PRIME[0], (one * _PRIME[1] + two) * _PRIME[2] + _PRIME[0], mark * _PRIME[1] + _PRIME[2])
    depth = book.depth[symbols]
    token = np.repeat(np.arange(len(symbols)), depth)
    begin = np.cumsum(depth) - depth
    at = np.arange(len(token))
    level = at - np.repeat(begin, depth)
    at += np.repeat(book.starts[symbols] - begin, depth)
    node = book.steps[at]
    bit = node & 1
    node >>= 1
    salt, local = book.salt[at], book.local[at]
    shift = np.uint32(32 - TABLE_BITS)
    slots = []
    for key in keys:
        key = (key ^ (key >> np.uint64(29))) * _PRIME[1]
        h = np.repeat((key >> np.uint64(32)).astype(np.uint32), depth)
        h ^= salt
        h *= _ODD
        h >>= shift
        h ^= local
        slots.append(h.astype(np.int64))
    return node, bit, slots, token, level


class Mixer:
    """Tables of counts (two numbers a slot, by the bit), gated weights and the last map."""

    def __init__(self, nodes: int):
        self.sizes = [1 << TABLE_BITS] * CONTEXTS + [nodes]
        self.counts = [np.zeros(2 * s, np.int64) for s in self.sizes]
        self.weights = np.tile(FIRST_WEIGHTS, (GATES, 1))
        self.refined = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (LEVELS, 1)) * 1.0
        self.zeros = None

    def count(self, node, bit, slots) -> None:
        """Every decision adds one to the counts of its slots."""
        for table, at in zip(self.counts, [*slots, node], strict=True):
            np.add.at(table, 2 * at + bit, 1)

    def prepare(self) -> None:
        """What scoring looks up: log odds and gates of every slot, and logs of refined probabilities by bit, level and mixed odds."""
        self.odds = [_odds(c) for c in self.counts]
        self.gates = [_much(c) for c in self.counts[:2]]
        self.gates[0] *= np.int8(4)
        self.columns = np.ascontiguousarray(self.weights.T.astype(np.float32))
        self.columns[-1] *= 0.3
        grid = np.tile((np.arange(GRID + 1) / GRID * 16 - 8).astype(np.float32), LEVELS)
        p = self.refine(grid, np.repeat(np.arange(LEVELS), GRID + 1))[0]
        self.logs = np.concatenate([np.log10(1 - p), np.log10(p)]).astype(np.float32)

    def scored(self, node, bit, slots, level) -> np.ndarray:
        """log10 of the probability of each decision."""
        gate = self.gates[0][slots[0]]
        gate += self.gates[1][slots[1]]
        odds = self.columns[-1][gate]
        for k, at in enumerate([*slots, node]):
            part = self.odds[k][at]
            part *= self.columns[k][gate]
            odds += part
        np.clip(odds, -8, 8, out=odds)
        odds += 8
        odds *= GRID / 16
        odds += 0.5
        at = odds.astype(np.int64)
        at += (bit * LEVELS + np.minimum(level, LEVELS - 1)) * (GRID + 1)
        return self.logs[at]

    def without(self, node, bit, slots, first=(0,)):
        """Inputs, gates and mixed log odds as if the counts of a decision's own text, which begins at ``first``, had not been added."""
        inputs, seen = np.empty((len(node), CONTEXTS + 2), np.float32, order="F"), []
        ends = [*first[1:], len(node)]
        for k, (table, at) in enumerate(zip(self.counts, [*slots, node], strict=True)):
            own, one = self._own(table), table.dtype.type(1)
            kind = np.int64 if table.itemsize == 4 else np.complex128  # both counts of a slot are read at once
            pairs, place = own.view(kind), 2 * at + bit
            left, mine = table.view(kind).take(at), np.empty(len(at), kind)
            for a, b in zip(first, ends, strict=True):
                np.add.at(own, place[a:b], one)
                mine[a:b] = pairs[at[a:b]]
                own[place[a:b]] = 0
            left = left.view(table.dtype)
            left -= mine.view(table.dtype)
            inputs[:, k] = _odds(left)
            if k < 2:
                seen.append(_much(left))
        inputs[:, -1] = 0.3
        gate = (seen[0] * np.int8(4) + seen[1]).astype(np.int64)
        columns = self.weights.T.astype(np.float32)
        odds = columns[0][gate] * inputs[:, 0]
        for k in range(1, CONTEXTS + 2):
            odds += columns[k][gate] * inputs[:, k]
        return inputs, gate, np.clip(odds, -8, 8, out=odds)

    def _own(self, table: np.ndarray) -> np.ndarray:
        """Zeros as long as ``table``; who adds to them sets them back."""
        if self.zeros is None or self.zeros.dtype != table.dtype:
            self.zeros = np.zeros(max(map(len, self.counts)), table.dtype)
        return self.zeros[: len(table)]

    def refine(self, odds, level):
        """The mixed probability, averaged with the map's between its two nearest steps."""
        place = (odds + 8) * ((STEPS - 1) / 16)
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        part = place - low
        mapped = self.refined[level, low] * (1 - part) + self.refined[level, low + 1] * part
        return np.clip((mapped + 1 / (1 + np.exp(-odds))) / 2, 1e-5, 1 - 1e-5), low, part

    def errors(self, node, bit, slots, first, given=None) -> np.ndarray:
        """By gate the sums of error times input, and of the products of inputs times the variance; whole numbers."""
        inputs, gate, odds = given or self.without(node, bit, slots, first)
        n = CONTEXTS + 2
        p = 1 / (1 + np.exp(-odds))
        rows = np.empty((n + 2, len(node)), np.float32)  # inputs, error, variance
        np.multiply(inputs.T, np.float32(ODDS_PARTS), out=rows[:n])
        np.subtract(bit.astype(np.float32), p, out=rows[n])
        np.multiply(p, 1 - p, out=rows[n + 1])
        rows[n:] *= np.float32(PARTS)
        np.rint(rows, out=rows)
        *x, error, spread = rows.take(np.argsort(gate.astype(np.uint8), kind="stable"), axis=1).astype(float)
        hits = np.bincount(gate, minlength=GATES)
        seen = np.flatnonzero(hits)
        begins = (np.cumsum(hits) - hits)[seen]
        sums = np.zeros((n + 1, n, GATES))
        for k, own in enumerate(x):
            sums[0, k, seen] = np.add.reduceat(error * own, begins)
            own = own * spread
            for j in range(k + 1):
                sums[1 + k, j, seen] = sums[1 + j, k, seen] = np.add.reduceat(own * x[j], begins)
        return sums.ravel().astype(np.int64)

    def outcomes(self, node, bit, slots, first, level, given=None) -> np.ndarray:
        """How many decisions fall on each step of the last map, and how many of them are ones."""
        _, _, odds = given or self.without(node, bit, slots, first)
        at = np.minimum(level, LEVELS - 1) * STEPS + np.rint((odds + 8) * np.float32((STEPS - 1) / 16)).astype(np.int64)
        zeros, ones = np.bincount(2 * at + bit, minlength=2 * LEVELS * STEPS).reshape(-1, 2).T
        return np.concatenate([zeros + ones, ones])

    def fit(self, sums: np.ndarray) -> None:
        """Weights and map from the sums of ``errors`` and ``outcomes``, behind each other."""
        split = GATES * (CONTEXTS + 2) * (CONTEXTS + 3)
        self.weigh(sums[:split])
        self.map(sums[split:])

    def weigh(self, sums: np.ndarray) -> None:
        """One Newton step of every gate, from the sums of ``errors``."""
        n = CONTEXTS + 2
        for gate, own in enumerate(sums.reshape(n + 1, n, GATES).transpose(2, 0, 1).astype(float)):
            slope, curve = own[0] / (ODDS_PARTS * PARTS), own[1:] / (ODDS_PARTS**2 * PARTS)
            self.weights[gate] += np.clip(np.linalg.solve(curve + PRIOR * np.eye(n), slope), -1, 1)
        self.weights = np.rint(self.weights * 2**20) / 2**20

    def map(self, sums: np.ndarray) -> None:
        """The share of ones on every step, from the sums of ``outcomes``."""
        hits, ones = sums.reshape(2, LEVELS, STEPS)
        self.refined = (ones + PRIOR * self.refined) / (hits + PRIOR)


def narrowed(table: np.ndarray) -> np.ndarray:
    """The same counts in four bytes each, where they fit: a cache holds twice as many."""
    return table.astype(np.int32) if table.max(initial=0) <= np.iinfo(np.int32).max // 2 else table


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one, from counts of zeros and ones in turn."""
    some = counts.astype(np.float32)
    some += np.float32(0.4)
    return np.log(some[1::2] / some[::2])


def _much(counts: np.ndarray) -> np.ndarray:
    seen = counts[::2] + counts[1::2]
    return (seen >= 1).astype(np.int8) + (seen >= 4) + (seen >= 24)


def _streams(book: Book, texts):
    """Symbols of whole texts, and where each begins."""
    return _ended(book, *words(pa.array(texts, pa.string())))


def _ended(book: Book, found: pa.Array, sizes: np.ndarray):
    """The symbols of ``found`` with the end of each text, and where each begins."""
    first = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.full(len(found) + len(sizes), book.end, np.int64)
    word = np.ones(len(symbols), bool)
    word[first + sizes] = False
    symbols[word] = book.symbols(found)
    return symbols, first


def _runs(symbols: np.ndarray, first: np.ndarray):
    """Runs of about ``RUN`` tokens of whole texts; a longer text is a run of its own."""
    edges = [*np.flatnonzero(np.diff(first // RUN, prepend=-1)).tolist(), len(first)]
    for a, b in zip(edges, edges[1:]):
        yield symbols[first[a] : first[b] if b < len(first) else None], first[a:b] - first[a]


def learn(training: DataFrame, book: Book, text: str = "text") -> Mixer:
    """Tables, weights and map from all training texts; none depends on how rows are dealt.

    Counts are whole numbers: each task adds up its own and Spark adds the slices of the tables.
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(book)

    def run(batches):
        known = shared.value
        mixer, seen = Mixer(known.nodes), False
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in _runs(*_ended(known, *words(batch.column(0)))):
                    node, bit, slots, _, _ = _decisions(known, *part)
                    if len(node):
                        mixer.count(node, bit, slots)
                        seen = True
        for k, table in enumerate(mixer.counts if seen else []):
            for s, part in enumerate(np.array_split(table, _SLICES)):
                small = part.astype(next(k for k in _KINDS if part.max(initial=0) <= np.iinfo(k).max))
                yield pa.RecordBatch.from_arrays([pa.array([k * _SLICES + s], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["slice", "sums"])

    widths = [len(part) for size in Mixer(book.nodes).sizes for part in np.array_split(np.empty(2 * size, np.int8), _SLICES)]

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, _KINDS[max(len(raw) // max(widths[key], 1), 1).bit_length() - 1]).astype(np.int64)
                sums[key] = sums[key] + values if key in sums else values
        for key, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["slice", "sums"])

    parts = training.select(text).mapInArrow(run, "slice int, sums binary")
    found = {r["slice"]: np.frombuffer(bytes(r["sums"]), np.int64) for r in parts.repartition("slice").mapInArrow(add, "slice int, sums binary").collect()}
    mixer = Mixer(book.nodes)
    if found:
        for k in range(CONTEXTS + 1):
            mixer.counts[k] = narrowed(np.concatenate([found[k * _SLICES + s] for s in range(_SLICES)]))
        mixer.fit(_summed(training, book, mixer, text))
    mixer.prepare()
    mixer.counts = None
    return mixer


def _summed(training: DataFrame, book: Book, mixer: Mixer, text: str) -> np.ndarray:
    """The sums of one pass over all training texts, each predicted by the counts of all others."""
    shared = training.sparkSession.sparkContext.broadcast((book, mixer))

    def run(batches):
        known, model = shared.value
        sums = None
        with np.errstate(over="ignore"):
            for batch in batches:
                for symbols, first in _runs(*_ended(known, *words(batch.column(0)))):
                    node, bit, slots, token, level = _decisions(known, symbols, first)
                    if len(node):
                        begins = np.searchsorted(token, first).tolist()
                        given = model.without(node, bit, slots, begins)
                        part = np.concatenate([model.errors(node, bit, slots, begins, given), model.outcomes(node, bit, slots, begins, level, given)])
                        sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.int64())], ["place", "n"])

    parts = training.select(text).mapInArrow(run, "place int, n long")
    size = GATES * (CONTEXTS + 2) * (CONTEXTS + 3) + 2 * LEVELS * STEPS
    sums = np.zeros(size, np.int64)
    for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[r["place"]] = r["n"]
    shared.unpersist()
    return sums


def code_book(counts: DataFrame) -> Book:
    """Codes of the most frequent words, from the counts of all."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    short = counts.where((F.length("word") <= CODED_BYTES) | (F.col("word") == F.lit(END)))
    coded = short.where((F.col("n") * CODED > (total["n"] or 0)) | (F.col("word") == F.lit(END))).collect()
    coded = sorted(((bytes(r["word"]), r["n"]) for r in coded), key=lambda r: (-r[1], r[0]))
    return Book(coded, total["n"] or 0, total["kinds"])


def score(documents: DataFrame, counts: DataFrame, book: Book, mixer: Mixer, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``.

    Scores are log10 probabilities of whole texts. Words without a code are counted by
    document and joined with the corpus counts.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((book, mixer))

    def run(batches):
        known, model = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                found, sizes = words(batch.column(1))
                symbols, first = _ended(known, found, sizes)
                logs = [np.zeros(0)]
                for part in _runs(symbols, first):
                    node, bit, slots, token, level = _decisions(known, *part)
                    logs.append(np.bincount(token, model.scored(node, bit, slots, level), len(part[0])))
                coded = symbols != known.escape
                row = np.repeat(np.arange(len(sizes)), sizes + 1)[~coded]
                rare = pa.table({"row": row, "word": found.filter(pa.array(~np.delete(coded, first + sizes)))})
                rare = rare.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("row")
                own = np.bincount(rare["row"].to_numpy(), minlength=len(sizes))
                pairs = pa.StructArray.from_arrays([rare[c].combine_chunks() for c in ("word", "count_all")], ["word", "times"])
                out = {
                    "n_tokens": pa.array(sizes + 1),
                    "n_bytes": pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    "n_known": pa.array(np.add.reduceat((coded & (known.count[symbols] > 0)).astype(np.int64), first)),
                    "base": pa.array(np.add.reduceat(np.where(coded, known.base[symbols], 0.0), first)),
                    "model": pa.array(np.add.reduceat(np.concatenate(logs), first)),
                    "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)), pa.int32()), pairs),
                }
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.values()], ["row", *out])

    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    others = [c for c in documents.columns if c not in own and c != text]
    rows = documents.select(F.struct(F.monotonically_increasing_id().alias("_row"), *others).alias("row"), text)
    kind = rows.schema["row"].dataType.simpleString()
    scored = checkpointed(
        rows.mapInArrow(run, f"row {kind}, n_tokens long, n_bytes long, n_known long, base double, model double, rare array<struct<word:binary,times:long>>")
    )
    rare = scored.select(F.col("row._row").alias("_row"), F.inline("rare")).join(counts, "word", "left")
    seen = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.groupBy("_row").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(seen + 1)).alias("rare_logs"),
        F.sum("times").alias("rare_times"),
    )
    full = scored.drop("rare").withColumn("_row", F.col("row._row")).join(rare, "_row", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + none("rare_logs") + none("rare_times") * book.plain
    model = F.col("model") + none("rare_logs") - none("rare_times") * math.log10(book.rare_total + book.rare_kinds + 1)
    return full.select(
        *[F.col("row")[c].alias(c) for c in others],
        "n_tokens",
        (F.col("n_known") + none("rare_known")).alias("n_known"),
        F.lit(book.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
        F.when(F.col("n_bytes") > 0, -model / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def scored_documents(documents: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose fold of seven is not 2."""
    arrow_rows(documents.sparkSession)
    rest = fold("doc_id", 7)
    training = documents.where(rest != 2)
    counts = checkpointed(count_words(training))
    book = code_book(counts)
    mixer = learn(training, book)
    rows = documents.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return score(rows, counts, book, mixer)
