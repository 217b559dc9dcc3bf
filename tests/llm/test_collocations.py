"""Phrase mining against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from starloom.llm import collocations
from starloom.llm.store import reach_workers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        longer = Counter()
        for p in found:
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], counts[p])
        rows = []
        for p in found:
            a = counts[p]
            if len(p) == 2 and p in longer and 100 * longer[p] >= percent * a:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "new york", "Z", "'"]
    weights = np.arange(len(words), 0, -1) / np.arange(1, len(words) + 1).sum()
    seps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!? ", "\r\n"]
    out = []
    for k in range(300):
        text = "".join(rng.choice(words, p=weights) + rng.choice(seps) for _ in range(rng.integers(0, 40)))
        out.append((["en", "de", None, "", "und"][k % 5], text))
    out += [("en", None), (None, None), ("fr", "only two"), ("en", "A b A b A b " * 4000), ("xx", "x")] + [("en", "same text here")] * 30
    return out


@pytest.mark.parametrize("least, percent, top, limit, bits", [(10, 50, 2000, 10**6, 64), (3, 80, 25, 0, 64), (10, 50, 2000, 0, 12)])
def test_phrases_match_plain_counts(spark, monkeypatch, rows, least, percent, top, limit, bits):
    """Also with the shuffled semi-join (limit 0) and with colliding hashes."""
    reach_workers(spark)
    docs = spark.createDataFrame([(t, g, 1) for g, t in rows], "text string, lang string, n int").repartition(5)
    got = collocations.phrase_collocations(docs, least, percent, top, limit, bits)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_empty_table(spark):
    reach_workers(spark)
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.phrase_collocations(docs).count() == 0
    assert collocations.phrase_collocations(spark.createDataFrame([("en", None), (None, "")], docs.schema)).count() == 0


def test_score_is_exact(spark):
    big = 10**12 + 7
    frame = spark.createDataFrame([(big, big, big + 1), (3 * 10**9, 3 * 10**9, 7 * 10**9), (10, 10, 10)], "a long, l long, r long")
    got = [r[0] for r in frame.select(collocations._score("a", "l", "r")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in [(big, big, big + 1), (3 * 10**9, 3 * 10**9, 7 * 10**9), (10, 10, 10)]]


def test_merge_join_of_sorted_occurrences():
    piece, at, word = np.array([0, 0, 0, 2, 2, 5]), np.array([0, 1, 3, 0, 1, 0]), np.array([4, 1, 2, 0, 3, 4])
    items = np.array([10, 11, 12, 13, 14], np.uint64)
    two = collocations.Segment(piece, at, items, [word]).extended()
    assert [w.tolist() for w in two.words] == [[4, 0], [1, 3]] and two.piece.tolist() == [0, 2]
    none = np.zeros(0, np.int64)
    assert len(collocations.Segment(none, none, items, [none]).extended().at) == 0


def test_groups_are_counted_exactly_whatever_the_number_of_items(monkeypatch):
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 5, 400) for _ in range(3)]
    small = collocations.Segment(np.zeros(400, np.int64), np.arange(400), np.arange(5).astype(np.uint64), words)
    wide = collocations.Segment(small.piece, small.at, np.arange(1 << 21).astype(np.uint64), words)  # codes pass 62 bits
    want = Counter(zip(*(w.tolist() for w in words)))
    for segment in (small, wide):
        found, n = segment.groups()
        assert Counter(dict(zip(zip(*(w.tolist() for w in found)), n.tolist()))) == want


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 3], [70000, 1], [1 << 40, 0]):
        x = np.array(values, dtype=np.int64)
        assert np.array_equal(collocations._unpack(collocations._pack(x)), x)
    x = np.array([(1 << 64) - 1, 0], dtype=np.uint64)
    assert np.array_equal(collocations._unpack(collocations._pack(x)), x)


@pytest.mark.parametrize("limit, filtered, known", [(0, 10**6, False), (0, 0, True), (10**6, 0, False)])
def test_many_frequent_groups_do_not_move_the_segments(spark, monkeypatch, rows, limit, filtered, known):
    """Beyond the broadcast's limit a filter of bounded size is sent to the
    segments; only beyond its own limit are they shuffled."""
    tags, kept = [], collocations.stored
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)

    def stored(df, tag):
        tags.append((tag, int(spark.conf.get(size).rstrip("b"))))
        return kept(df, tag)

    monkeypatch.setattr(collocations, "stored", stored)
    reach_workers(spark)
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(3)
    got = collocations.phrase_collocations(docs, 10, 50, 2000, limit, filter_groups=filtered)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 50, 2000)
    assert ("phrases-known" in {t for t, _ in tags}) == known
    assert {n for _, n in tags} == {collocations.BATCH_BYTES} and spark.conf.get(size) == before


@pytest.mark.parametrize("groups", [1, 300, 20000])
def test_filter_keeps_every_key_and_few_others(spark, groups):
    reach_workers(spark)
    words = np.random.default_rng(groups).integers(0, 1 << 63, (groups, 2))
    frame = spark.createDataFrame(words.tolist(), "w1 long, w2 long")
    found = collocations._filter(frame, groups).value
    assert found.has(collocations._group_keys([words[:, 0].astype(np.uint64), words[:, 1].astype(np.uint64)])).all()
    others = collocations.mix(np.arange(50000, dtype=np.uint64) + np.uint64(7))
    assert found.has(others).mean() < 0.05


def test_filter_has_a_bounded_size():
    for groups in (0, 10**6, collocations.FILTER_GROUPS, 10**10):
        log, probes = collocations.Filter.shape(groups)
        assert collocations.SLICES << log <= 8 * collocations.FILTER_BYTES and probes >= 1
