"""The training-data operators against brute force on small fixtures, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

import hashlib
import html
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import (
    ann, bpe_columns, kd_shards, minhash_dedup, packing, quality_classifier, quality_rules, token_files, url_rules, warc,
)
from starloom.llm.bpe import RankBpe
from starloom.llm.components import connected_components
from starloom.llm.skew import split_left_join
from starloom.llm.store import reach_workers, shared_folder

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"word{i % 701} und" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox.\nIt's here, 'LL see 12 of them!"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "a  b\n\nc 　d\x1ce <|endoftext|> tail "),
    (6, LONG),
    (7, "same words again and again"),
    (7, "same words again and again"),
    (None, "no id at all"),
    (9, "x" * 5000),
    (10, "İstanbul, Σίσυφος. été 😀 中文"),
]


@pytest.fixture(scope="module")
def docs(spark):
    reach_workers(spark)
    rows = [(i, t, "score", k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    reach_workers(spark)
    return spark.createDataFrame([], "doc_id long, text string, n_words string, score int")


def jaccard_components(rows, k, percent):
    """doc index -> component by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_bpe_equals_the_library(docs, none):
    library = Tokenizer.from_file(BYTE)
    got = {}
    for r in bpe_columns.round_trip_digests(docs, BYTE).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i][0]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert sum(map(len, got.values())) == len(TEXTS)
    assert bpe_columns.round_trip_digests(none, BYTE).count() == 0
    both = bpe_columns.decode_ids(bpe_columns.encode_texts(docs.where("doc_id = 10"), BYTE), BYTE)
    assert both.first().text == dict(TEXTS)[10]


def test_bpe_short_and_long_words_agree():
    bpe = RankBpe(open(BYTE, encoding="utf-8").read())
    for word in (b"thingness", b"aaaaaaaaaaaaaaaa", "überprüfung".encode(), b"x"):
        assert bpe._merge_long(word).astype("<u4").tobytes() == bpe.encode_pieces([word])[0]
    assert bpe.decode(np.array([255, 60000], "<u4").tobytes()) == bpe.decode(np.array([255], "<u4").tobytes())


def test_token_files(spark, docs, none):
    path = shared_folder(spark, "t")
    token_files.write_token_files(docs, path, BYTE, 2)
    library = Tokenizer.from_file(BYTE)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        text = next(t for i, t in TEXTS if i == r.doc_id)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.tokens, r.n_tokens) == (start, ids, len(ids))
        start += len(ids)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_digests(spark, path).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows}
    found = token_files.lookup(spark, path, [6, 77])
    assert [r.doc_id for r in found.collect()] == [6]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    empty = shared_folder(spark, "t")
    token_files.write_token_files(none, empty, BYTE, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    room: list[int] = []
    for length in lengths.tolist():
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(64 - length)
    assert windows.max() + 1 == len(room)
    used = Counter()
    for w, o, n in sorted(zip(windows, offsets, lengths)):
        assert o == used[w]
        used[w] += n
    assert sorted(64 - u for u in used.values()) == sorted(room)


def test_packing_keeps_every_id_once(docs, none):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, 2, window=64, group_pieces=40).collect()
    want = Counter()
    for i, text in TEXTS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 64):
            cut = ids[s : s + 64]
            want[(i, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, WORD, 2).count() == 0


def brute_repeats(words, least):
    best = [0] * len(words)
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            n = 0
            while b + n < len(words) and words[a + n] == words[b + n]:
                n += 1
            best[a], best[b] = max(best[a], n), max(best[b], n)
    spans = {p for a, n in enumerate(best) if n >= least for p in range(a, a + n)}
    return len(spans), max((n for n in best if n >= least), default=0)


def test_quality_rules(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(100 + k, " ".join(rng.choice(list("abc"), 60)), "", 0) for k in range(10)]
    rows += [(200, "\n".join(["one line here", "one line here", "", "two"] * 20), "", 0)]
    rows += [(201, " ".join(f"w{i}" for i in range(80)), "", 0)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema)).where("doc_id <> 6 or doc_id is null")
    out = quality_rules.judge_quality(more)
    assert out.columns.count("n_words") == 1
    for r in out.collect():
        text = r.text or ""
        w = WORDS.findall(text)
        c = Counter(zip(w, w[1:], w[2:]))
        repeat = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(text.count(s) for s in "#*$%&|<>")
        assert (r.covered_words, r.longest_repeat) == brute_repeats(w, quality_rules.MIN_REPEAT)
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[201] and not kept[200] and not kept[3]
    assert quality_rules.judge_quality(none).count() == 0


def test_classifier_held_out(spark):
    reach_workers(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = quality_classifier.fit_classifier(docs, labels, rest != 2)
    scored = quality_classifier.score_quality(docs, model).join(labels, "doc_id").where(rest == 2).collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    assert all(0 <= r.score <= 1 for r in scored)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (6, None), (10, 1)], "doc_id long, quality int")
    model = quality_classifier.fit_classifier(docs, labels)
    rows = quality_classifier.score_quality(docs, model).collect()
    assert len(rows) == len(TEXTS) and {r.score for r in rows} == {0.75}
    assert quality_classifier.score_quality(none, quality_classifier.fit_classifier(none, labels)).count() == 0
    x = np.random.default_rng(0).normal(size=(4000, len(quality_classifier.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # only a pair of features tells
    fitted = quality_classifier.fit_tables(x[:3000], y[:3000])
    assert ((fitted.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_minhash_components_match_brute_force(spark, docs, none):
    rng = np.random.default_rng(8)
    base = [f"tok{i}" for i in range(60)]
    rows = [(i, t) for i, t in TEXTS if i != 6]
    for g in range(6):
        own = [f"g{g}{w}" for w in base]
        for k in range(12):
            w = list(own)
            for at in rng.integers(0, 60, rng.integers(0, 9)):
                w[at] = f"new{rng.integers(1000)}"
            rows.append((1000 + 100 * g + k, " ".join(w)))
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp1 int").repartition(4)
    for k in (2, 5):
        sets, comps = jaccard_components(rows, k, 80)
        least = {}
        for (i, _), c in zip(rows, comps):
            least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
        want = Counter(
            (i, len(s), least[c] if s else i, i == (least[c] if s else i)) for (i, _), s, c in zip(rows, sets, comps)
        )
        got = minhash_dedup.near_components(frame, k, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert Counter(map(tuple, got)) == want
    kept = minhash_dedup.drop_near_copies(frame, 2, 80)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and len(ids) == len(set(ids))
    assert minhash_dedup.near_components(none, 2, 80).count() == 0


def test_minhash_rows_without_id_and_long_texts(spark):
    """2,000 rows without id in three components, and long near copies."""
    reach_workers(spark)
    base = [f"w{i}" for i in range(40)]
    bare = [(None, " ".join([*base, f"x{i}"])) for i in range(1200)] + [(None, f"t{i % 2} other text here now") for i in range(800)]
    words = [f"long{i}" for i in range(60000)]
    other = [w if i % 50 else "changed" for i, w in enumerate(words)]
    far = [w if i % 2 else "changed" for i, w in enumerate(words)]
    rows = bare + [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for limit in (minhash_dedup.BROADCAST_ROWS, 0):  # all keys broadcast; heavy ones only
        got = minhash_dedup.near_components(frame, 2, 80, limit).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 3}
        # counted without any set: distinct neighbouring words
        assert {r.doc_id: r.n_shingles for r in got if r.doc_id} == {
            i: len(set(zip(w, w[1:]))) for i, w in ((1, words), (2, other), (3, far))
        }
        bare_comps = Counter(r.comp for r in got if r.doc_id is None)
        assert sorted(bare_comps.values()) == [400, 400, 1200]
    kept = minhash_dedup.drop_near_copies(frame, 2, 80).collect()
    assert Counter(r.doc_id for r in kept) == {None: 3, 1: 1, 3: 1}


def test_minhash_finds_all_links_of_small_sets(spark):
    """Pairs of short texts at the very threshold, where bands alone miss some."""
    reach_workers(spark)
    rows = []
    for k in range(1500):
        words = [f"p{k}w{i}" for i in range(10)]  # nine shingles; the copy has eight of them and no other
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:9]))]
        n = 5 + k % 30
        words = [f"q{k}w{i}" for i in range(n)]
        rows += [(100000 + 2 * k, " ".join(words)), (100001 + 2 * k, " ".join([*words, f"q{k}end"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_components(frame, 2, 80).collect()}
    assert all(got[i] == i - i % 2 for i, _ in rows)


def test_components(spark):
    reach_workers(spark)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    got = dict(connected_components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_shards(spark, none):
    reach_workers(spark)
    rows = [(i, "x" * (i * 37 % 900), "en" if i % 3 else None, f"s{i % 5}", i) for i in range(3000)]
    rows += [(5000 + i, "copy of one text" * 9, "en", "hot", 1) for i in range(1500)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long").repartition(5)
    out = kd_shards.shard_documents(docs, 16).collect()
    assert len(out) == len(rows)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(16))
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r.doc_id: r for r in out}
    assert (by[None]["size"], by[None].text_crc32) == (1, 0)
    assert by[40].text_crc32 == zlib.crc32(b"x" * (40 * 37 % 900))
    assert kd_shards.shard_documents(none, 16).count() == 0


def test_hilbert_neighbours_are_neighbours():
    side, axes, bits = 8, 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = ann.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(side**axes))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_ann(spark):
    reach_workers(spark)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[300]  # a third of the rows are one vector
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)]
    rows += [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [1.0] * 15 + [None], 0), (1150, [float("nan")] * 16, 0)]
    rows += [(1200, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert sorted(got) == list(range(0, 900, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[300:600] = score[300]
        score[q] = -9
        want = np.lexsort((np.arange(900), -score))[:5]
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in found} & set(want.tolist()))
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        if 300 <= q < 600:
            assert [v for _, v, _ in sorted(found)] == want.tolist()
    assert hit >= 0.9 * 5 * len(got)
    assert ann.nearest(frame.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(frame.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def _neighbours(x, ask, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit[ask] @ unit.T
    score[np.arange(len(ask)), ask] = -9
    return {(int(q), int(j)) for q, row in zip(ask, score) for j in np.argsort(-row, kind="stable")[:k]}


def _layouts(monkeypatch):
    """The layouts that searches choose from now on."""
    chosen, choose = [], ann.choose_layout
    monkeypatch.setattr(ann, "choose_layout", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    return chosen


def _share(layout, width):
    return layout.curves * min(1, (2 * ann.REACH + 1) / (layout.cuts[width].shape[1] + 1))


def test_ann_searches_the_given_vectors_on_curves(spark, monkeypatch):
    """No comparison with every row: many curves in short runs."""
    reach_workers(spark)
    chosen = _layouts(monkeypatch)
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    want = _neighbours(x, np.arange(0, len(x), 50), 5)
    assert len(got) == len(want)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    assert chosen[0].curves > 1 and _share(chosen[0], x.shape[1]) < 0.9


@pytest.mark.parametrize("width, most", [(4, 0.15), (8, 0.4)])
def test_ann_layout_follows_the_data(spark, monkeypatch, width, most):
    """The fewer the directions, the smaller the share of rows that is met."""
    reach_workers(spark)
    chosen = _layouts(monkeypatch)
    x = np.random.default_rng(2).normal(size=(12000, width))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    want = _neighbours(x, np.arange(0, len(x), 50), 5)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.93 * len(want)
    assert _share(chosen[0], width) < most


def test_ann_searches_every_length(spark):
    reach_workers(spark)
    rng = np.random.default_rng(5)
    by_width = {w: rng.normal(size=(n, w)) for w, n in ((2, 60), (3, 400), (5, 8))}
    rows, base = [], {}
    for w, x in by_width.items():
        base[w] = 10_000 * w
        rows += [(base[w] + i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for w, x in by_width.items():
        ask = np.arange(0, len(x), 50)
        want = _neighbours(x, ask, 5)
        found = {(q - base[w], v - base[w]) for q, vs in got.items() if q // 10_000 == w for v in vs}
        assert {q for q, _ in found} == set(ask.tolist())
        assert len(want & found) >= 0.9 * len(want) and len(found) == len(want)


def test_ann_of_few_rows_is_exact(spark):
    """One curve with one run is every row, and lists as long as the table."""
    reach_workers(spark)
    x = np.random.default_rng(3).normal(size=(300, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id") % 3 == 0, 5, curves=(1,), runs=(1,), rerank=300).collect()
    assert {(r.query_id, r.vec_id) for r in got} == _neighbours(x, np.arange(0, 300, 3), 5)


@pytest.mark.parametrize("kind", ["offset", "spike", "copies", "tiny"])
def test_ann_finds_neighbours_that_short_codes_do_not_tell_apart(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    if kind == "offset":  # all near one direction
        x = 200 + x
    elif kind == "spike":  # one component hides the others
        x[:, 0] = 1000
    elif kind == "copies":  # large groups of near copies
        x = x[rng.integers(0, 6, 3000)] + 1e-4 * x
    else:
        x *= 1e-200
    frame = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        apart = ((unit - unit[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(apart, kind="stable")[:5].tolist()))
    assert len(got) == 300 and hit >= 0.9 * 300


def test_short_codes():
    x = np.random.default_rng(4).normal(size=(50, 33))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    again = ann.from_codes(ann.short_codes(unit))
    assert again.shape == (50, 34) and np.allclose(again[:, 33], 0)
    assert ((again[:, :33] * unit).sum(1) > 0.985).all()


def test_url_rules(spark):
    reach_workers(spark)
    rules = [("allow", "com", "/"), ("block", "bad.com", "/x"), ("block", "net", "/es/")]
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://A.com/p?q", None), (2, "https://sub.bad.com/xy#f", ""), (3, "http://bad.com", None),
        (4, None, None), (5, "no scheme", ""), (6, "http://q.net/es/1", ""),
        (7, "http://alias.org/1", link.format("http://q.net/es/1")),
        (8, "http://far.org/", '<meta http-equiv="refresh" content="0; url=http://alias.org/1#top">'),
        (9, "http://ok.com/", link.format("http://q.net/es/9")), (10, "http://free.org/", link.format("/free")),
        (11, "http://mixed.org/", link.format("http://ok.com/")), (11, "http://mixed.org/", link.format("http://ok.com/")),
    ]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, rule string")
    want = {
        1: ("a.com", "/p", "com/", "allow"), 2: ("sub.bad.com", "/xy", "bad.com/x", "block"),
        3: ("bad.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("q.net", "/es/1", "net/es/", "block"), 7: ("alias.org", "/1", None, "block"),
        8: ("far.org", "/", None, "block"), 9: ("ok.com", "/", "com/", "allow"),
        10: ("free.org", "/", None, "allow"), 11: ("mixed.org", "/", None, "allow"),
    }
    out = url_rules.judge_urls(pages, rules).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]
    named = pages.select("page_id", url_rules.url_host(F.col("url")).alias("host"), url_rules.url_path(F.col("url")).alias("path"))
    few, many = (sorted(map(str, url_rules.with_rules(named, rules, n).collect())) for n in (200, 0))
    assert few == many
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0


def test_url_links_in_all_forms(spark):
    """Links as pages write them, against urllib and html."""
    reach_workers(spark)
    base = "http://Host.org/a/b/page?q=1#top"
    written = [
        "c", "./c", "../c", "../../../c", "/c/./d/../e", "?x=1", "#part", "//Other.net/z", "https://x.y/a/../b?q#f", "c?u=/../v",
        "a=1&amp;b=2", "?a=1&#38;b=2", "?a=1&#x26;b=2", "?q=&quot;&lt;&gt;&apos;", "?n=&#233;&#x4E2D;&#128512;", "?b=&unknown;&#0;&;&", "d/.", "d/..", "..",
        "x:y", "",
    ]
    links = spark.createDataFrame([(base, w) for w in written], "base string, link string")
    got = links.select("link", url_rules.decoded(F.col("link")).alias("plain")).select(
        "link", "plain", url_rules.normal_url(url_rules.absolute(F.lit(base), F.col("plain"))).alias("node")
    ).collect()
    for r in got:
        # html.unescape drops &#0; to U+FFFD, which is no link
        plain = r.link if "unknown" in r.link else html.unescape(r.link)
        assert r.plain == plain
        if r.link in ("", "x:y"):  # the page itself is dropped before; no scheme without //
            continue
        full = urllib.parse.urlsplit(urllib.parse.urljoin(base, plain))
        if "/." in full.path:  # of an absolute link
            full = full._replace(path=urllib.parse.urljoin("/", full.path))
        want = f"{full.scheme}://{full.netloc.lower()}{full.path or '/'}" + (f"?{full.query}" if full.query else "")
        assert r.node == want, r.link


def test_url_links_of_pages(spark):
    reach_workers(spark)
    rules = [("block", "bad.net", "/")]
    rel = '<link {}>'
    rows = [
        (1, "http://a.org/p", rel.format('rel="shortlink  Canonical" href="http://bad.net/x?a=1&amp;b=2"')),
        (2, "http://b.org/p", rel.format('href="http://bad.net/q/../x?a=1&#38;b=2" rel=canonical')),
        (3, "http://c.org/d/p?old", rel.format("rel='canonical' href='?new'")),
        (4, "http://c.org/d/p?new", '<META http-equiv=Refresh content="5;URL=\'../../d/../e\'">'),
        (5, "http://c.org/e", rel.format('rel="canonical" href="http://bad.net"')),
        (6, "http://d.org/", rel.format('rel="noncanonical" href="http://bad.net/"')),
        (7, "http://e.org/", rel.format('data-rel="canonical" href="http://bad.net/"')),
        (8, None, rel.format('rel="canonical" href="http://bad.net/"')),
    ]
    rows += [(100 + i, "http://c.org/e", None) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert [got[i] for i in range(1, 9)] == ["block"] * 5 + ["allow"] * 3
    assert {got[i] for i in got if i >= 100} == {"block"}


def test_left_join_by_heavy_keys(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else f"k{i}", i) for i in range(3000)], "k string, i long")
    table = spark.createDataFrame([("hot", 1), ("k2", 2), ("nobody", 3)], "k string, v int")
    want = Counter((r.k, r.i, {"hot": 1, "k2": 2}.get(r.k)) for r in rows.collect())
    for limit in (10, 0):
        assert Counter(map(tuple, split_left_join(rows, table, "k", limit).select("k", "i", "v").collect())) == want


def test_warc_round_trip(spark):
    reach_workers(spark)
    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\r\nX: y", big), (4, "u", None), (5, "u", "small"),
            (6, "u", "small"), (7, "u", "y" * 3_000_000), (None, "u", big), (5, "u", "small")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    path = shared_folder(spark, "w")
    warc.archive_pages(pages.repartition(3), path)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(rows)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in out)
    assert kinds[("urn:page:3", "response", None)] == 1
    for i in (1, 2, "null"):
        assert kinds[(f"urn:page:{i}", "revisit", "urn:page:3")] == 1
    for r in out:
        i = r.record_id.split(":")[-1]
        html = next((h or "").encode() for p, _, h in rows if str(p) == i or p is None and i == "null")
        assert r.payload_digest == hashlib.sha1(html).hexdigest() and r.payload_bytes == len(html)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    only = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    assert only.count() == 3 and only.where("payload is not null").count() == 0
    empty = shared_folder(spark, "w")
    warc.archive_pages(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_foreign_members():
    """Plain records and gzip members without a length note are read too."""
    import gzip

    row = {"record_id": "urn:1", "record_type": "response", "target_uri": "u", "refers_to": None,
           "payload_digest": hashlib.sha1(b"hello").hexdigest(), "payload_bytes": 5, "payload": b"hello"}
    own = warc.record_bytes(row)
    plain = gzip.decompress(own)
    for raw in (own * 3, plain * 3, gzip.compress(plain) * 3, own + plain + gzip.compress(plain)):
        got = list(warc.read_records(pa.BufferReader(raw), lambda r: True))
        assert [bytes(r["payload"]) for r in got] == [b"hello"] * 3
        assert list(warc.read_records(pa.BufferReader(raw), lambda r: r["record_type"] == "revisit")) == []
