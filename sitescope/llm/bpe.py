"""Byte-level BPE by longest matches that are checked pair by pair.

An Aho-Corasick automaton finds every token that starts at every byte of a
pre-token. The encoder walks from the left, takes the longest token that the one
before it is compatible with, and steps back where none fits. Two tokens are
compatible if merging by rank would never cross the border between them, so the one
sequence of compatible tokens is exactly what the merges give, in linear time.
Decoding copies slices out of one byte string by an offset table.

Texts are whole; a null text counts as empty. Ids are packed as little-endian
unsigned 32-bit integers in a binary column, so a text of any length is one value.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, widened

#: A tokenizer file is broadcast; larger files are refused.
MODEL_BYTES = 64 << 20
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Verdicts on borders that a worker remembers.
FITS = 300_000
#: Fixed value: the pre-tokenizer's pattern for byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one tokenizer: inside, a token is 0-255 (a byte) or 256 + its merge's rank."""

    def __init__(self, raw: bytes, remembered: int = REMEMBERED):
        spec = json.loads(raw)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        token = {letter: byte for letter, byte in letters.items()}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        names: list[str] = [""] * 256
        for letter, byte in letters.items():
            names[byte] = letter
        for first, second in merges:
            a, b, whole = token[first], token[second], first + second
            new = token.setdefault(whole, len(names))
            if new == len(names):
                names.append(whole)
                self.left.append(a)
                self.right.append(b)
            self.pair.setdefault((a, b), new)
        self.bytes = [bytes(letters[c] for c in name) for name in names]
        self.size = [len(x) for x in self.bytes]
        self.public = [vocab[name] if name in vocab else -1 for name in names]
        self.finder = ahocorasick.Automaton()
        for t, x in enumerate(self.bytes):
            self.finder.add_word(x.decode("latin-1"), t)
        self.finder.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.remembered = remembered
        self.find_words = regex.compile(PATTERN).findall
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.find_added = None
        if self.added:
            longest = sorted(self.added, key=len, reverse=True)
            self.find_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens ``a`` and ``b``.

        Undoes the later of the two merges next to the border, again and again. A pair
        across it that would have merged before the one just undone breaks the border;
        of equal merges the left one comes first.
        """
        limit = len(self.bytes)
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def tokens(self, data: str) -> list[int]:
        """Tokens of one pre-token, given as one letter a byte."""
        starts: list[list[int]] = [[] for _ in data]
        size, fits = self.size, self.fits
        for end, t in self.finder.iter(data):
            starts[end + 1 - size[t]].append(t)  # shorter ones come first
        out: list[int] = []
        tried: list[int] = []
        dead: set[int] = set()
        at, n = 0, len(data)
        k = len(starts[0]) - 1
        while at < n:
            before, here = out[-1] if out else -1, starts[at]
            while k >= 0:
                t = here[k]
                if at + size[t] not in dead:
                    if before < 0:
                        break
                    key = before << 24 | t
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= FITS:
                            fits.clear()
                        ok = fits[key] = self.compatible(before, t)
                    if ok:
                        break
                k -= 1
            if k >= 0:
                out.append(t)
                tried.append(k)
                at += size[t]
                k = len(starts[at]) - 1 if at < n else -1
            else:
                dead.add(at)
                at -= size[out.pop()]
                k = tried.pop() - 1
        return out

    def packed(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.remembered:
                self.words.clear()
            ids = [self.public[t] for t in self.tokens(word.encode().decode("latin-1"))]
            found = np.array(ids, "<u4").tobytes()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        known, parts = self.words.get, []
        for i, piece in enumerate(self.find_added(text) if self.find_added else [text]):
            if i % 2:
                parts.append(np.uint32(self.added[piece]).astype("<u4").tobytes())
            else:
                parts += [known(w) or self.packed(w) for w in self.find_words(piece)]
        return b"".join(parts)


class Slices:
    """The bytes of all tokens in one piece, and the table of offsets where each begins."""

    def __init__(self, raw: bytes):
        spec, letters = json.loads(raw), byte_letters()
        found = {i: bytes(letters[c] for c in name) for name, i in spec["model"]["vocab"].items() if all(c in letters for c in name)}
        found |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        slices = [found.get(i, b"") for i in range(max(found) + 1)]
        self.offsets = np.cumsum([0, *map(len, slices)])
        self.blob = np.frombuffer(b"".join(slices), np.uint8)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        sizes = self.offsets[ids + np.uint32(1)] - begin
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)].tobytes()


@lru_cache(maxsize=2)
def _model(raw: bytes) -> Bpe:
    return Bpe(raw)


@lru_cache(maxsize=2)
def _slices(raw: bytes) -> Slices:
    return Slices(raw)


def load(spark: SparkSession, path: str):
    """Read a tokenizer file on the driver and hand it to the executors."""
    with open(path, "rb") as file:
        raw = file.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def encode(frame: DataFrame, model, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``frame`` with the packed ids of ``text`` and their number.

    Columns of those names are replaced. Every row stays, repeated ones too; an empty
    or null text gives no ids.
    """
    arrow_rows(frame.sparkSession)
    kept = frame.drop(ids, n_tokens)
    place = kept.columns.index(text)

    def run(batches):
        bpe = _model(model.value)
        for batch in batches:
            packed = [bpe.encode(t) if t else b"" for t in batch.column(place).to_pylist()]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(packed, pa.binary()), counts], [*batch.schema.names, ids, n_tokens]
            )

    return kept.mapInArrow(run, widened(kept, **{ids: "binary", n_tokens: "long"}))


def decode(frame: DataFrame, model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the text of packed ``ids``; bytes that are no UTF-8 become U+FFFD."""
    arrow_rows(frame.sparkSession)
    kept = frame.drop(text)
    place = kept.columns.index(ids)

    def run(batches):
        slices = _slices(model.value)
        for batch in batches:
            texts = [slices.decode(p or b"").decode("utf-8", "replace") for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text]
            )

    return kept.mapInArrow(run, widened(kept, **{text: "string"}))


def bpe_digests(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: ids of its whole text and the text decoded from them, as digests."""
    model = load(documents.sparkSession, path)
    coded = encode(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    back = decode(coded.drop("text"), model)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
