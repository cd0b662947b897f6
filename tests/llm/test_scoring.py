"""The base by brute force; the model for being a distribution and for being better."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitescope.llm import scoring
from sitescope.llm.common import arrow_rows, fold
from sitescope.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bases(rows):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    counts = Counter(w for k, t in rows if k is not None and not held[k] for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for k, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        out.append((k, held[k], len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return out


def check(rows, want):
    got = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id))
    want = sorted(want, key=lambda r: (r[0] is None, r[0]))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("coded", [1 << 18, 3000])
def test_whole_table(spark, texts, monkeypatch, coded):
    monkeypatch.setattr(scoring, "CODED", coded)
    rows = QUERIES["op7_lm_score"](spark, "/root/testdata/sf0.01").collect()
    check(rows, bases(sorted(texts.items())))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > (0.97 if coded > 3000 else 0.99) * sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, documents):
    """One, four and sixteen partitions in other orders give the same numbers; only sums of logs are rounded elsewhere."""
    scores = []
    for parts in (1, 4, 16):
        dealt = documents.repartition(parts, "text").sortWithinPartitions("n_chars", ascending=parts > 4)
        scores.append({r.doc_id: r.score for r in scoring.scored_documents(dealt).collect()})
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        assert max(abs(other[k] - scores[0][k]) / abs(scores[0][k]) for k in other) < 1e-9


def test_counts_of_a_text_are_left_out_while_it_is_learned():
    """A text's own decisions add nothing to what predicts it."""
    book = scoring.Book([(scoring.END, 5), (b"a", 4), (b"b", 3)], 14, 4)
    with np.errstate(over="ignore"):
        texts = [scoring._streams(book, [t]) for t in ("a b a", "b b c", "a a a b")]
        both, one = scoring.Mixer(book.nodes), scoring.Mixer(book.nodes)
        for k, stream in enumerate(texts):
            node, bit, slots, _, _ = scoring._decisions(book, *stream)
            both.count(node, bit, slots)
            if k:
                one.count(node, bit, slots)
        node, bit, slots, _, _ = scoring._decisions(book, *texts[0])
        inputs, _, _ = both.without(node, bit, slots)
        one.prepare()
        for k, at in enumerate([*slots, node]):
            assert np.array_equal(inputs[:, k], one.odds[k][at])


def test_codes_are_a_distribution(spark, documents):
    """Over all next words after a context: coded ones, and the escape with all it stands for."""
    arrow_rows(spark)
    training = documents.where(fold("doc_id", 7) != 2)
    counts = scoring.count_words(training).cache()
    book = scoring.code_book(counts)
    mixer = scoring.learn(training, book)
    symbols = np.arange(len(book.depth))
    with np.errstate(over="ignore"):
        for before in ([], [3], [5, 9]):
            streams = np.array([[*before, s] for s in symbols]).ravel()
            first = np.arange(0, len(streams), len(before) + 1)
            node, bit, slots, token, level = scoring._decisions(book, streams, first)
            logs = np.bincount(token, mixer.scored(node, bit, slots, level), len(streams))
            assert abs(np.sum(10 ** logs[first + len(before)]) - 1) < 1e-3
    rare = [r.n for r in counts.collect() if bytes(r.word) not in book.symbol]
    assert sum(n + 1 for n in rare) + 1 == book.rare_total + book.rare_kinds + 1


def test_edges(spark):
    schema = "doc_id long, text string, score string, n_tokens int, rare int, row int, n int"
    rows = [(1, None), (2, ""), (3, " \t"), (None, "A b c"), (5, "a b a b"), (5, "a b a b"), (8, "x" * 100_000 + " a"), (9, "a\x1cb \x85")]
    frame = spark.createDataFrame([(*r, "s", 1, 1, 1, 1) for r in rows], schema)
    check(scoring.scored_documents(frame).collect(), bases(rows))
    assert scoring.scored_documents(frame.limit(0)).count() == 0
    lonely = [(k, t) for k, t in ((i, "a b") for i in range(60)) if zlib.crc32(str(k).encode()) % 7 == 2]
    check(scoring.scored_documents(spark.createDataFrame(lonely, "doc_id long, text string")).collect(), bases(lonely))


def test_weights_and_map_come_from_all_training_texts(spark):
    """Texts of over 64 kB count too, and the sums of several texts are the sums of each, whatever they are read with."""
    arrow_rows(spark)
    texts = [" ".join(f"w{(i * k) % 17}" for i in range(30_000)) for k in range(1, 7)]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    book = scoring.code_book(scoring.count_words(training).cache())
    mixer = scoring.learn(training, book)
    assert np.abs(mixer.weights[:, :-1] - 0.3).max() > 0.01
    assert np.abs(mixer.refined - scoring.Mixer(book.nodes).refined).max() > 0.01
    with np.errstate(over="ignore"):
        fresh = scoring.Mixer(book.nodes)
        alone = [scoring._decisions(book, *scoring._streams(book, [t])) for t in texts]
        for node, bit, slots, _, _ in alone:
            fresh.count(node, bit, slots)
        symbols, first = scoring._streams(book, texts)
        node, bit, slots, token, level = scoring._decisions(book, symbols, first)
        begins = np.searchsorted(token, first).tolist()
        assert np.array_equal(fresh.errors(node, bit, slots, begins), sum(fresh.errors(n, b, s, [0]) for n, b, s, _, _ in alone))
        together = fresh.outcomes(node, bit, slots, begins, level)
        assert np.array_equal(together, sum(fresh.outcomes(n, b, s, [0], v) for n, b, s, _, v in alone))
        assert together[: len(together) // 2].sum() == len(node)


def test_words_are_split_alike():
    """White space at edges and between, null, other blanks and letters that are not A-Z."""
    texts = ["A b\tC\x0b\x0cd\r\ne", None, "", " lead", "tail\n", " \t ", "Ä a\x1cb c\u0085 d", "x"]
    found, sizes = scoring.words(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(words(t)) for t in texts]
    assert [w.decode() for w in found.to_pylist()] == [w for t in texts for w in words(t)]


def test_four_decisions_share_a_line_and_counts_keep_their_width():
    """Slots of up to four decisions in a row lie in sixteen; counts of four and of eight bytes predict alike."""
    book = scoring.Book([(scoring.END, 9)] + [(b"%d" % k, 1 + k % 7) for k in range(300)], 1500, 310)
    with np.errstate(over="ignore"):
        symbols, first = scoring._streams(book, [" ".join(str(k * k % 300) for k in range(500)), "1 2 1", None])
        node, bit, slots, token, level = scoring._decisions(book, symbols, first)
        for at in slots:
            start = level % 4 == 0
            same = ~start[1:]
            assert np.array_equal(at[1:][same] // 16, at[:-1][same] // 16)
            four = {}
            for s, n, t in zip(at.tolist(), node.tolist(), (token * 100 + level // 4).tolist()):
                four.setdefault(t, set()).add((s, n))
            assert all(len({s for s, _ in v}) == len(v) for v in four.values())
        wide, narrow = scoring.Mixer(book.nodes), scoring.Mixer(book.nodes)
        wide.count(node, bit, slots)
        narrow.counts = [scoring.narrowed(c) for c in wide.counts]
        assert narrow.counts[0].itemsize == 4
        begins = np.searchsorted(token, first).tolist()
        for a, b in zip(wide.without(node, bit, slots, begins), narrow.without(node, bit, slots, begins), strict=True):
            assert np.array_equal(a, b)
    assert scoring.narrowed(np.array([1 << 31, 1])).itemsize == 8
