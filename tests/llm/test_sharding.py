"""Against a plain sort in Python, and the laws that the shards must keep."""

import hashlib
import zlib
from collections import Counter

import pytest

from sitescope.llm import sharding
from sitescope.llm.common import read


def brute(rows, shards, seed=12):
    """(doc_id, source, size, crc, shard, slot) by sorting."""
    facts = []
    for i, text, source in rows:
        raw = (text or "").encode()
        draw = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        facts.append((draw, i is not None, i or 0, len(raw) + 1, zlib.crc32(raw), i, source))
    sources = {}
    for f in sorted(facts, key=lambda f: f[:5]):
        sources.setdefault(f[6], []).append(f)
    offset = lambda s: int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:12], 16) / 2.0**48
    line = [((r + offset(s)) / len(of), s is not None, s or "", f) for s, of in sources.items() for r, f in enumerate(of)]
    line.sort(key=lambda x: (*x[:3], x[3][:5]))
    out, slots = [], Counter()
    for place, (_, _, _, f) in enumerate(line):
        shard = place * shards // len(line)
        out.append((f[5], f[6], f[3], f[4], shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.source, r["size"], r.text_crc32, r.shard, r.slot) for r in frame.collect()), key=repr)


def test_whole_table(spark, documents):
    found = sharding.sharded_documents(documents)
    rows = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    assert got(found) == brute(rows, 16)
    assert {(r.law, r.grown_shard) for r in found.collect()} == {("rows", None)}


@pytest.mark.parametrize("parts", [1, 7])
def test_mixture(spark, parts):
    """Counts differ by one at most, slots have no gaps, and every shard has the mixture, a hot source included."""
    rows = [(i, "same text", "hot" if i % 3 else f"s{i % 40}" if i % 2 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    found = got(sharding.sharded_documents(frame, 16))
    assert found == brute(rows, 16)
    sizes = Counter(r[4] for r in found)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r[5] for r in found if r[4] == shard) == list(range(sizes[shard]))
    whole = Counter(r[1] for r in found)
    for source, n in whole.items():
        for shard in range(16):
            assert abs(sum(r[1] == source and r[4] == shard for r in found) - n / 16) <= 2


def test_edges(spark):
    rows = [(1, None, None), (1, "", None), (1, "", None), (None, "x", "a"), (None, None, "a"), (2, "é" * 50_000, "b"), (2, "y", "b")]
    frame = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, source string, shard string, n long")
    for shards in (1, 3, 16):
        assert got(sharding.sharded_documents(frame, shards)) == brute(rows, shards)
    empty = sharding.sharded_documents(frame.limit(0))
    assert empty.collect() == [] and empty.columns[-2:] == ["slot", "grown_shard"]
    with pytest.raises(ValueError):
        sharding.interleave(frame, 0)


def test_written(spark, tmp_path):
    """Whole rows, in the order of their slots."""
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.source) for r in back.collect()) == sorted(rows)
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(frame, 4).collect()}
