"""The prefix-tree join against all pairs."""

from collections import Counter

import numpy as np
import pytest

from starloom.llm import ngram_join
from starloom.llm.part_keys import part_keys
from starloom.llm.prefix_tree import linked
from starloom.llm.store import reach_workers
from tests.llm.test_operators import LONG, jaccard_components

TEXTS = [(1, "one two three four"), (2, None), (3, ""), (4, " \t "), (5, "ONE two"), (6, "one two"), (7, LONG), (8, LONG + " more"),
         (None, "no id here at all"), (None, "no id here at all"), (9, "No id here at all"), (10, "single")]


def want_rows(rows, words, percent):
    sets, comps = jaccard_components(rows, words, percent)
    least = {}
    for (i, _), c in zip(rows, comps):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return Counter((i, len(s), least[c] if s else i) for (i, _), s, c in zip(rows, sets, comps))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = list(TEXTS)
    for g, n in enumerate((12, 14, 25, 60, 130)):
        base = [f"g{g}w{i}" for i in range(n)]
        for k in range(14):
            w = list(base)
            for at in rng.integers(0, n, rng.integers(0, 4)):
                w[at] = f"new{rng.integers(1000)}"
            if k % 5 == 0:
                w = w[: n - rng.integers(0, 3)]
            out.append((1000 + 100 * g + k, " ".join(w)))
    return out + out[15:25]


@pytest.mark.parametrize("words, percent", [(3, 90), (2, 80), (1, 95), (5, 60)])
def test_components_match_all_pairs(spark, rows, words, percent):
    reach_workers(spark)
    frame = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, n int, block int").repartition(4)
    want = want_rows(rows, words, percent)
    for cells, limit in ((1_000_000, 1_000_000), (200, 0)):  # one tree a block; chunks, heavy and light keys
        got = ngram_join.jaccard_components(frame, words, percent, cells, limit)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    reach_workers(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs, 3, 90).count() == 0


def test_large_groups_of_copies(spark):
    """Many equal and near texts, more than the heavy mark of the joins."""
    reach_workers(spark)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(700)] + [(1000 + i, " ".join([*base, f"x{i}"])) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(frame, 3, 90, 2000, 0).collect()
    assert len(got) == 1400 and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    """Any two linked sets have a common part key, at all sizes."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 80, 3), 200, 700]:
        base = rng.integers(0, 1 << 62, n)
        for _ in range(6):
            drop = rng.integers(0, max(n * (100 - percent) // 100, 1) + 1)
            add = rng.integers(0, max(n * (100 - percent) // 100, 1) + 1)
            one = np.unique(base).astype(np.uint64)
            two = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)]))
            common, both = len(np.intersect1d(one, two)), len(np.union1d(one, two))
            if 100 * common < percent * both or common == both:
                continue
            grams = np.concatenate([one, two])
            row = np.repeat([0, 1], [len(one), len(two)])
            rows, keys = part_keys(row, grams, np.array([len(one), len(two)]), percent)
            assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_tree_matches_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(400):
        base = [set(rng.choice(60, rng.integers(1, 30), replace=False).tolist()) for _ in range(3)]
        sets = set()
        for _ in range(rng.integers(1, 25)):
            one = set(base[rng.integers(3)])
            for _ in range(rng.integers(0, 4)):
                one ^= {int(rng.integers(100))}
            if one:
                sets.add(frozenset(one))
        sets = list(sets)
        percent = int(rng.choice([50, 80, 90]))
        true = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        grams = np.concatenate([sorted(s) for s in sets])
        found = linked(grams, np.cumsum([0, *map(len, sets)]), percent)
        assert {(max(p), min(p)) for p in found} <= true
        assert _classes(len(sets), found) == _classes(len(sets), true)


def _classes(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]
