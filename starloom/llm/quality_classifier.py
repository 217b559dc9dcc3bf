"""Quality classifier: a generalised additive model with pairwise terms.

Features are numeric signals of the whole text only (never label, language,
source or id).  Training boosts shallow trees cyclically, one feature at a
time, on binned values; the sum of a feature's trees is one lookup table over
its bins.  Then the feature pairs that reduce the remaining loss most get
depth-two trees on a coarse grid, boosted the same way.  A score is the
logistic of the added table entries, computed for a block of texts at once.

Training uses at most ``MAX_SAMPLE`` labelled rows (those with the smallest
hash of doc_id), so the driver holds a bounded matrix; every text is scored.

Edge cases: a null or empty text has all signals zero and gets a score like
any other; labels that are null or whose doc_id is null are not used; repeated
labels of one id count once (the smallest value); with no usable label, or one class only, the
score is the smoothed class rate; repeated rows get equal scores; an empty
table gives an empty result; result columns replace input columns of the same
name and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.text_bytes import Block, blocks, lowered, mix

MAX_SAMPLE = 20_000  # labelled rows that a fit may hold on the driver
BINS = 32
ROUNDS = 150
PAIRS = 6
PAIR_BINS = 8
PAIR_ROUNDS = 60
RATE = 0.1
LEAST_LEAF = 5.0  # rows (by weight) in a leaf, at least
THRESHOLD = 0.7

FEATURES = (
    "log_words", "mean_word", "upper_share", "symbol_share", "digit_share", "bang_share",
    "pipe_share", "comma_share", "period_share", "distinct_share", "adjacent_share", "pair_share",
    "dup_line_share", "symbol_word_share", "upper_word_share", "long_word_share", "space_share",
    "non_ascii_share", "line_share", "short_word_share", "other_share",
)


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _marks("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_DIGIT, _SYMBOL, _OTHER = _marks("0123456789"), _marks("#*$%&|<>"), _marks("{}[]()=/\\@^~_+:;\"'`?")


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per row."""
    if not len(keys):
        return np.zeros(n)
    tagged = np.sort(mix(keys + mix(rows.astype(np.uint64) + np.uint64(1))))
    # the hash no longer tells the row: count first occurrences by sorting rows with them
    order = np.argsort(mix(keys + mix(rows.astype(np.uint64) + np.uint64(1))), kind="stable")
    first = np.concatenate(([True], tagged[1:] != tagged[:-1]))
    return np.bincount(rows[order][first], minlength=n).astype(float)


def block_features(block: Block) -> np.ndarray:
    """Matrix of ``FEATURES`` for each text of the block."""
    n, data = block.rows, block.data
    starts, ends, row = block.words
    words = block.count(row).astype(float)
    per = np.maximum(words, 1.0)
    size = np.maximum(np.diff(block.offsets).astype(float), 1.0)
    upper, letter, symbol = _UPPER[data], _LETTER[data], _SYMBOL[data]
    letters = block.per_row(letter).astype(float)

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    lengths = ends - starts
    hashes = lowered(block).hashes(starts, ends)
    same = row[1:] == row[:-1]
    line_s, line_e, line_row = block.lines
    lines = block.count(line_row).astype(float)
    pair_rows, pair_keys = row[1:][same], (mix(hashes[:-1]) + hashes[1:])[same]
    pairs = block.count(pair_rows).astype(float)
    columns = [
        np.log1p(words),
        block.count(row, lengths) / per,
        block.per_row(upper) / np.maximum(letters, 1),
        block.per_row(symbol) / per,
        block.per_row(_DIGIT[data]) / per,
        block.per_row(data == ord("!")) / per,
        block.per_row(data == ord("|")) / per,
        block.per_row(data == ord(",")) / per,
        block.per_row(data == ord(".")) / per,
        _distinct(row, hashes, n) / per,
        block.count(row[1:], same & (hashes[1:] == hashes[:-1])) / per,
        _distinct(pair_rows, pair_keys, n) / np.maximum(pairs, 1),
        1 - _distinct(line_row, block.hashes(line_s, line_e), n) / np.maximum(lines, 1),
        block.count(row, within(symbol) > 0) / per,
        block.count(row, (within(upper) > 1) & (within(upper) == within(letter))) / per,
        block.count(row, lengths > 15) / per,
        (size - block.count(row, lengths)) / size,
        block.per_row(data >= 128) / size,
        lines / per,
        block.count(row, lengths <= 2) / per,
        block.per_row(_OTHER[data]) / per,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Model:
    """Lookup tables: ``edges[j]`` cuts feature j, ``tables[j]`` has a value a
    bin; ``pairs`` holds (j, k, coarse edges of j, of k, grid of values)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for j, k, ej, ek, grid in self.pairs:
            total += grid[
                np.searchsorted(ej, x[:, j], side="right"), np.searchsorted(ek, x[:, k], side="right")
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles; heavy ties give fewer bins."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, w: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a shallow tree: greedily the best cuts of the
    gradient histogram (g gradients, h curvatures, w rows by bin)."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for lo, hi in parts:
            cg, ch, cw = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(w[lo:hi])
            if hi - lo < 2:
                continue
            lg, lh, lw = cg[:-1], ch[:-1], cw[:-1]
            rg, rh, rw = cg[-1] - lg, ch[-1] - lh, cw[-1] - lw
            gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain = np.where((lw >= LEAST_LEAF) & (rw >= LEAST_LEAF), gain, 0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (lo, hi, lo + at + 1))
        if best[1] is None:
            break
        lo, hi, mid = best[1]
        parts.remove((lo, hi))
        parts += [(lo, mid), (mid, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best depth-two tree on a grid: one cut of the first feature, then one
    cut of the second on each side; its gain and its values."""
    def halves(gs: np.ndarray, hs: np.ndarray) -> tuple[float, np.ndarray]:
        cg, ch = np.cumsum(gs), np.cumsum(hs)
        out = np.full(len(gs), _leaf(cg[-1], ch[-1]))
        if len(gs) < 2:
            return cg[-1] ** 2 / (ch[-1] + 1), out
        gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
        at = int(np.argmax(gain)) + 1
        out[:at] = _leaf(cg[at - 1], ch[at - 1])
        out[at:] = _leaf(cg[-1] - cg[at - 1], ch[-1] - ch[at - 1])
        return float(gain[at - 1]), out

    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        ga, a = halves(g[:cut].sum(0), h[:cut].sum(0))
        gb, b = halves(g[cut:].sum(0), h[cut:].sum(0))
        if ga + gb > best:
            best, values = ga + gb, np.vstack([np.tile(a, (cut, 1)), np.tile(b, (g.shape[0] - cut, 1))])
    return best - g.sum() ** 2 / (h.sum() + 1), values


def fit_tables(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the main effects, then of the best pairs."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    rate = (y.sum() + 1) / (n + 2) if n else 0.5
    model = Model(bias=float(np.log(rate / (1 - rate))))
    if n == 0 or y.min() == y.max():
        model.edges = [np.zeros(0)] * width
        model.tables = [np.zeros(1)] * width
        return model
    model.edges = [_cuts(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    counts = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(n, model.bias)
    for _ in range(ROUNDS):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            step = RATE * _tree(
                np.bincount(bins[j], weights=y - p, minlength=size),
                np.bincount(bins[j], weights=p * (1 - p), minlength=size),
                counts[j],
            )
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grids(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[j]) + 1, len(coarse[k]) + 1)
        p = 1 / (1 + np.exp(-total))
        at = cells[j] * shape[1] + cells[k]
        return tuple(
            np.bincount(at, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))
        )

    ranked = sorted(
        ((_grid_tree(*grids(j, k))[0], j, k) for j in range(width) for k in range(j + 1, width)), reverse=True
    )
    chosen = [(j, k, np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1))) for _, j, k in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for j, k, grid in chosen:
            step = RATE * _grid_tree(*grids(j, k))[1]
            grid += step
            total += step[cells[j], cells[k]]
    model.pairs = [(j, k, coarse[j], coarse[k], grid) for j, k, grid in chosen]
    return model


def _features_of(docs: DataFrame, extra: str) -> DataFrame:
    """(extra, features) of ``docs`` (columns text and ``extra``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_features(b) for b in blocks(batch.column("text"))]
            if parts:
                x = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(extra), pa.array(list(x), type=pa.list_(pa.float64()))], names=[extra, "features"]
                )

    kind = dict(docs.dtypes)[extra]
    return docs.mapInArrow(run, f"{extra} {kind}, features array<double>")


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    max_sample: int = MAX_SAMPLE,
) -> Model:
    """Fit on the documents' texts and ``labels`` (doc_id, quality).

    ``usable``: condition on ``doc_id`` that a training row meets.  At most
    ``max_sample`` labelled rows are used: those with the smallest hash of
    their id (ties to the smaller id)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"))
    sample = rows.orderBy(order, "doc_id").limit(max_sample)
    # at most max_sample small rows, so the broadcast has a fixed bound
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y")
    got = _features_of(texts, "y").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = np.array(got.column("features").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the rows' order
    return fit_tables(x[order][:max_sample], y[order][:max_sample])


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 at or above the
    threshold)."""
    text_at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c not in ("score", "predicted")]
    schema = docs.select(*[docs.columns[i] for i in kept]).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables: a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(block_features(b)) for b in blocks(batch.column(text_at))]
            if parts:
                score = np.concatenate(parts)
                columns = [batch.column(i) for i in kept]
                columns += [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                names = [batch.schema.names[i] for i in kept] + ["score", "predicted"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
