"""Approximate nearest neighbours on shifted Hilbert curves.

Each of a number of orderings projects the unit vectors on a few random
orthogonal axes, shifts them, cuts every axis into cells and numbers the cells
along a Hilbert curve; equal numbers are told apart by a hash of the row.  The
curve is cut into runs of about equally many rows, at quantiles of a sample of
``SAMPLE_ROWS`` rows, and all rows are dealt to their runs on every curve.  A
query meets the rows of its own run and of the ``REACH`` runs on each side.

Along the curves goes a code of each row, of 4 to 64 bits a component, not its
vector.  A run's task multiplies the codes of its queries and rows and keeps
the best few a query; the lists of all curves are merged to ``RERANK`` rows a
query, and these are ranked by the exact cosine of the original vectors.

How many curves there are, how short the runs and how long the codes follows
from the data.  ``SAMPLE`` queries are compared with all rows, by their vectors
and by each code; of the numbers of curves, runs and bits with which ``recall``
of their true neighbours are met and lie, by the codes, among the rows that a
list keeps, those of the least cost are taken.  Many short runs need many
curves; vectors that differ little, as near copies or all with one large
component do, need long codes.  Where nothing less finds the neighbours, as in
small tables, one curve with one run meets every row.

Vectors of different lengths share no curve: the length is part of a run's name,
and each length has runs by its share of the sample (one, if it is rare).
Equal vectors lie in one class with one place on the curves, and a class
keeps its smallest ids, so a vector that a third of the rows share is one row
of the search and its copies are still found, ties to the smaller id.

Edge cases: null, zero, or non-finite vectors and vectors with null components
take no part, neither as query nor as candidate; rows with a null vec_id take
no part; of a repeated query id one row asks, and a repeated candidate id is
found once for each vector it has; with fewer candidates than k all are
returned (a query whose length no other row has finds none); other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.store import stored
from starloom.llm.text_bytes import mix

#: bits a component of the codes that are tried, and what a row met costs by them
CODES = {4: 1.0, 8: 1.15, 32: 2.0, 64: 4.0}
#: numbers of curves and of runs that are tried
CURVES = (1, 8, 16, 32, 64, 96, 128)
RUNS = (1, *(int(12 * 1.2**i) for i in range(31)))
#: runs on each side that a query meets beside its own
REACH = 4
AXES = 8
BITS = 4
RECALL = 0.95
SAMPLE = 256
#: rows, and components in all, of the sample that runs are cut by
SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 1 << 22
#: runs that one task holds together, and rows of a query's list
STRETCH = 64
RERANK = 64
SEED = 20240131


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row's cell (n x axes, 0 <= cell < 2**bits) on a Hilbert
    curve, by the transpose form: undo the reflections and exchanges of each
    level, Gray-decode, interleave."""
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        low = q - np.uint64(1)
        for i in range(axes):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        gray ^= np.where((x[-1] & q) != 0, q - np.uint64(1), np.uint64(0))
    x ^= gray
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def curve_maps(width: int, curves: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve random orthogonal axes and a shift of up to half a
    standard deviation each way."""
    out = []
    for c in range(curves):  # a curve is the same whatever the number of curves
        rng = np.random.default_rng((seed, c))
        basis, _ = np.linalg.qr(rng.standard_normal((width, min(axes, width))))
        out.append((basis, rng.uniform(-0.5, 0.5, basis.shape[1])))
    return out


def curve_fits(vectors: np.ndarray, maps) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of a sample's unit vectors on each curve's axes."""
    out = []
    for axes, _ in maps:
        at = vectors @ axes
        spread = at.std(axis=0)
        out.append((at.mean(axis=0), np.where(spread > 1e-12, spread, 1.0)))
    return out


def curve_keys(vectors: np.ndarray, ids: np.ndarray, maps, fits, bits: int) -> np.ndarray:
    """Place of each unit vector on each curve (curves x n): its Hilbert key,
    then a hash of its id.  Cells cover 2.2 deviations each way of the mean
    (``fits``), beyond them the outer cells."""
    tie = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64)
    keys = np.empty((len(maps), len(vectors)), dtype=np.int64)
    for i, ((axes, shift), (mean, spread)) in enumerate(zip(maps, fits, strict=True)):
        at = (vectors @ axes - mean) / spread + shift
        cells = np.clip((at + 2.2) / 4.4 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        keys[i] = (hilbert_keys(cells, bits) << 31) | tie
    return keys


def short_codes(vectors: np.ndarray, bits: int = 4) -> np.ndarray:
    """Codes of unit vectors as bytes (n x bytes).  With 4 and 8 bits a
    component is its share of the row's largest, in sevenths or 127ths; with 32
    and 64 it is a float."""
    if bits > 8:
        return np.ascontiguousarray(vectors, dtype=f"<f{bits // 8}").view(np.uint8)
    top = np.abs(vectors).max(axis=1, keepdims=True)
    if bits == 8:
        return np.rint(vectors / top * 127).astype(np.int8).view(np.uint8)
    steps = (np.rint(vectors / top * 7) + 8).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.concatenate([steps, np.full((len(steps), 1), 8, np.uint8)], axis=1)
    return steps[:, ::2] << 4 | steps[:, 1::2]


def from_codes(codes: np.ndarray, bits: int = 4) -> np.ndarray:
    """Unit vectors of the codes, in single precision (64 bits: double)."""
    if bits > 8:
        return np.ascontiguousarray(codes).view(f"<f{bits // 8}")
    if bits == 8:
        out = np.ascontiguousarray(codes).view(np.int8).astype(np.float32)
    else:
        out = np.empty((len(codes), 2 * codes.shape[1]), dtype=np.float32)
        out[:, ::2], out[:, 1::2] = codes >> 4, codes & 15
        out -= 8
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _code_bytes(width: int, bits: int) -> int:
    return (width * bits + 7) // 8


def _kept(k: int, rerank: int, curves: int) -> int:
    """Rows of a query's list from one stretch of a curve."""
    return max(k + 5, -(-2 * rerank // curves))


@dataclass
class Layout:
    """The curves of a search, and for each length of vectors where they are
    cut into runs (curves x cuts)."""

    curves: int
    axes: int
    bits: int
    seed: int
    cuts: dict[int, np.ndarray]
    #: mean and deviation on the axes of each curve, by length
    fits: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    #: bits a component of the codes
    code: int

    def runs(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The run of each unit vector on each curve (curves x n)."""
        width = vectors.shape[1]
        if width not in self.cuts or not self.cuts[width].shape[1]:
            return np.zeros((self.curves, len(vectors)), dtype=np.int64)
        maps = _maps(width, self.curves, self.axes, self.seed)
        keys = curve_keys(vectors, ids, maps, self.fits[width], self.bits)
        return np.stack([np.searchsorted(c, k, side="right") for c, k in zip(self.cuts[width], keys, strict=True)])


_known_maps: dict[tuple, list] = {}


def _maps(width: int, curves: int, axes: int, seed: int) -> list:
    key = (width, axes, seed)
    if len(_known_maps.get(key, ())) < curves:
        _known_maps[key] = curve_maps(width, curves, axes, seed)
    return _known_maps[key][:curves]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square is too large or too small;
    cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in a column: the rows, and their matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, flat[(ends[rows] - width)[:, None] + np.arange(width)]


def _usable(vector: Column) -> Column:
    number = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(number, lambda v: v != 0)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    curves: tuple[int, ...] = CURVES,
    runs: tuple[int, ...] = RUNS,
    axes: int = AXES,
    bits: int = BITS,
    seed: int = SEED,
    recall: float = RECALL,
    rerank: int = RERANK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of ``rows``
    (vec_id, embedding) the ``k`` nearest rows found, its own id left out.
    ``curves`` and ``runs`` are the numbers of them to choose from, ``recall``
    what a sample of queries must reach, ``rerank`` the rows of a query whose
    exact cosine is taken."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    base = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("q"), "embedding"
    )
    # Classes of equal vectors: the smallest k + 1 ids of each.  The limit of
    # a ranking is applied before its shuffle too, so a hot class sends few rows.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = base.withColumn("n", place).where(F.col("n") <= k + 1)
    classes = members.groupBy("embedding").agg(
        F.min("vec_id").alias("cid"), F.array_sort(F.collect_set("vec_id")).alias("ids")
    )
    asked = base.where("q").select("embedding").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked, "embedding", "left").select("cid", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding")
    # a class is known by a number: one id may have several vectors
    classes = stored(classes.withColumn("num", F.monotonically_increasing_id()), "ann-classes")
    if classes.where("asked").isEmpty():
        return spark.createDataFrame([], result)
    rerank = max(rerank, k + 1)
    layout = choose_layout(classes, k, curves, runs, axes, bits, seed, recall, rerank)
    pairs = _candidates(classes, layout, k, rerank)
    pairs = stored(pairs, "ann-pairs")
    # exact cosines of the lists
    ask = classes.select(F.col("num").alias("qnum"), F.col("embedding").alias("qv"))
    met = pairs.join(ask, "qnum").join(classes.select("num", "cid", "ids", "embedding"), "num")
    scored = met.select("qnum", "cid", "ids", "qv", "embedding").mapInArrow(_cosines, "qnum long, cid long, ids array<long>, score double")
    top = Window.partitionBy("qnum").orderBy(F.desc("score"), "cid")
    scored = scored.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    flat = scored.select("qnum", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qnum").orderBy(F.desc("score"), "vec_id")
    best = flat.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = best.groupBy("qnum").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("found"))
    queries = base.where("q").select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    queries = queries.join(classes.select(F.col("num").alias("qnum"), "embedding"), "embedding").select("query_id", "qnum")
    own = queries.join(lists, "qnum").select(
        "query_id",
        F.slice(F.array_sort(F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))), 1, k).alias("found"),
    )
    out = own.select("query_id", F.posexplode("found").alias("place", "f"))
    return out.select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score")
    )


def choose_layout(classes: DataFrame, k: int, curves, runs, axes: int, bits: int, seed: int, recall: float, rerank: int = RERANK) -> Layout:
    """The curves, runs and codes of least cost that still find ``recall`` of
    the true neighbours of ``SAMPLE`` queries; measured on these and cut by the
    quantiles of ``SAMPLE_ROWS`` rows, both of them bounded.  A neighbour is
    found if a curve meets it and no more rows are as near by the codes as a
    list keeps."""
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    limit = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    picked = classes.orderBy(F.xxhash64("num"), "num").limit(limit).select("num", "embedding").toArrow().combine_chunks()
    near = _true_neighbours(classes, k)
    named = classes.sparkSession.createDataFrame([(int(n),) for n in {n for p in near for n in p}], "num long")
    ends = classes.join(named, "num").select("num", "embedding").toArrow().combine_chunks()
    places = _code_places(classes, near, ends)
    most = max(curves)
    keys: dict[int, np.ndarray] = {}  # sorted sample keys of each length
    fits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for rows, x in _by_length(_chunk(picked, "embedding")):
        ids, maps = _chunk(picked, "num").to_numpy()[rows], _maps(x.shape[1], most, axes, seed)
        fits[x.shape[1]] = curve_fits(_unit(x), maps)
        keys[x.shape[1]] = np.sort(curve_keys(_unit(x), ids, maps, fits[x.shape[1]], bits), axis=1)
    at: dict[int, tuple[int, np.ndarray | None]] = {}
    for rows, x in _by_length(_chunk(ends, "embedding")):
        ids, width = _chunk(ends, "num").to_numpy()[rows], x.shape[1]
        if width in keys:
            found = curve_keys(_unit(x), ids, _maps(width, most, axes, seed), fits[width], bits)
        at |= {int(i): (width, found[:, j] if width in keys else None) for j, i in enumerate(ids)}
    # the pairs by length, each curve's keys of both ends
    pairs: dict[int, list[np.ndarray]] = {}
    for width in keys:
        own = [(at[a][1], at[b][1]) for a, b in near if at[a][0] == width]
        if own:
            pairs[width] = [np.stack(x, axis=1) for x in zip(*own)]
    # as the pairs are taken by their lengths; rare lengths: one run, always met
    lost = [i for i, (a, _) in enumerate(near) if at[a][0] not in keys]
    order = [*lost, *(i for width in pairs for i, (a, _) in enumerate(near) if at[a][0] == width)]
    best: tuple[float, int, int, int] | None = None
    for many in runs:
        met = [np.ones((most, len(lost)), dtype=bool)]
        for width, (a, b) in pairs.items():
            cuts = _cuts(keys[width], many * keys[width].shape[1] / picked.num_rows)
            apart = [np.searchsorted(c, x, "right") - np.searchsorted(c, y, "right") for c, x, y in zip(cuts, a, b, strict=True)]
            met.append(np.abs(np.array(apart).reshape(most, -1)) <= REACH)
        found = np.maximum.accumulate(np.concatenate(met, axis=1), axis=0)
        for c in curves:
            share = c * min(1.0, (2 * REACH + 1) / many)
            for code, price in CODES.items():
                told = found[c - 1] & (places[code][order] <= _kept(k, rerank, c)) if near else None
                if (not near or told.mean() >= recall) and (best is None or (share * price, c) < best[:2]):
                    best = (share * price, c, many, code)
    _, c, many, code = best or (1.0, 1, 1, max(CODES))
    cuts = {w: _cuts(s, many * s.shape[1] / picked.num_rows)[:c] for w, s in keys.items()}
    return Layout(c, axes, bits, seed, cuts, {w: f[:c] for w, f in fits.items()}, code)


def _code_places(classes: DataFrame, near: list[tuple[int, int]], ends: pa.Table) -> dict[int, np.ndarray]:
    """For each code and each pair of ``near``: how many rows are at least as
    near the query by the code as the neighbour is, itself included."""
    sides: dict[int, tuple] = {}
    nums = _chunk(ends, "num").to_numpy()
    for rows, x in _by_length(_chunk(ends, "embedding")):
        spot = {int(n): i for i, n in enumerate(nums[rows])}
        own = [i for i, (a, _) in enumerate(near) if a in spot]
        if own:
            asks, inverse = np.unique([spot[near[i][0]] for i in own], return_inverse=True)
            sides[x.shape[1]] = (np.array(own), _unit(x), asks, inverse, np.array([spot[near[i][1]] for i in own]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {code: np.zeros(len(near), dtype=np.int64) for code in CODES}
        bars: dict[tuple[int, int], tuple] = {}
        for width, (own, unit, asks, inverse, to) in sides.items():
            for code in CODES:
                q, c = (from_codes(short_codes(unit[i], code), code) for i in (asks, to))
                # products of other shapes may differ in the last digits
                bars[width, code] = (own, q, inverse, np.einsum("ij,ij->i", q[inverse], c) - 4 * np.finfo(q.dtype).eps)
        for batch in batches:
            for _, x in _by_length(batch.column("embedding")):
                for lo in range(0, len(x) if x.shape[1] in sides else 0, 2048):
                    unit = _unit(x[lo : lo + 2048])
                    for code in CODES:
                        own, q, inverse, bar = bars[x.shape[1], code]
                        scores = np.sort(q @ from_codes(short_codes(unit, code), code).T, axis=1)
                        below = [np.searchsorted(scores[i], b) for i, b in zip(inverse.tolist(), bar, strict=True)]
                        count[code][own] += len(unit) - np.array(below)
        flat = [pa.array(np.arange(len(near))), *(pa.array(count[c]) for c in CODES)]
        yield pa.RecordBatch.from_arrays(flat, names=["pair", *(f"c{c}" for c in CODES)])

    told = classes.select("embedding").mapInArrow(counted, ", ".join(["pair long", *(f"c{c} long" for c in CODES)]))
    rows = told.groupBy("pair").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in CODES)).collect() if near else []
    out = {code: np.zeros(len(near), dtype=np.int64) for code in CODES}
    for r in rows:
        for code in CODES:
            out[code][r["pair"]] = r[f"c{code}"]
    return out


def _chunk(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _cuts(keys: np.ndarray, runs: float) -> np.ndarray:
    """The inner ends of so many runs on each curve, from its sorted keys."""
    count = max(1, min(round(runs), keys.shape[1]))
    return keys[:, (np.arange(1, count) * keys.shape[1]) // count]


def _true_neighbours(classes: DataFrame, k: int) -> list[tuple[int, int]]:
    """(query, neighbour) of a sample of queries and their ``k`` nearest rows,
    by comparing each with all rows."""
    sample = classes.where("asked").orderBy(F.xxhash64("num"), "num").limit(SAMPLE).select("num", "embedding").collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r["embedding"]) for r in sample}:
        own = [r for r in sample if len(r["embedding"]) == width]
        asked[width] = (np.array([r["num"] for r in own]), _scaled(np.array([r["embedding"] for r in own], dtype=np.float64)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {int(n): [] for nums, _ in asked.values() for n in nums}
        for batch in batches:
            ids = batch.column("num").to_numpy(zero_copy_only=False)
            for rows, x in _by_length(batch.column("embedding")):
                if x.shape[1] not in asked:
                    continue
                nums, q = asked[x.shape[1]]
                for i, near, score in _top(q, _scaled(x), ids[rows], k + 1):
                    n = int(nums[i])
                    best[n] = sorted(best[n] + list(zip((-score).tolist(), ids[rows][near].tolist())))[: k + 1]
        flat = [(n, c, -s) for n, found in best.items() for s, c in found]
        columns = zip(*flat) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["qnum", "num", "score"])

    near = classes.select("num", "embedding").mapInArrow(compared, "qnum long, num long, score double")
    order = Window.partitionBy("qnum").orderBy(F.desc("score"), "num")
    near = near.where(F.col("qnum") != F.col("num")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return [(r["qnum"], r["num"]) for r in near.collect()]


_PARTS = ("runs", "nums", "codes", "q_runs", "q_nums", "q_codes")


def _candidates(classes: DataFrame, layout: Layout, k: int, rerank: int) -> DataFrame:
    """(qnum, num): for each query the ``rerank`` rows met on the curves that
    are nearest by their codes."""
    sent = classes.sparkSession.sparkContext.broadcast(layout)
    keep, bits = _kept(k, rerank, layout.curves), layout.code

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and queries, packed by the stretches of runs that they go to."""
        plan = sent.value
        for batch in batches:
            nums = batch.column("num").to_numpy(zero_copy_only=False)
            asks = batch.column("asked").to_numpy(zero_copy_only=False)
            for rows, x in _by_length(batch.column("embedding")):
                unit, width = _unit(x), x.shape[1]
                codes, ids, ask = short_codes(unit, bits), nums[rows], np.flatnonzero(asks[rows])
                lines = []
                for curve, run in enumerate(plan.runs(unit, ids)):
                    own = run // STRETCH
                    # a query goes to the stretches of the runs beside it too
                    beside = np.unique(np.stack([np.tile(ask, 3), np.concatenate([(run[ask] + d) // STRETCH for d in (-REACH, 0, REACH)])]), axis=1)
                    order, q_order = np.argsort(own, kind="stable"), np.argsort(beside[1], kind="stable")
                    starts, q_starts = own[order], beside[1][q_order]
                    for stretch in np.union1d(starts, q_starts[q_starts >= 0]):
                        mine = order[slice(*np.searchsorted(starts, [stretch, stretch + 1]))]
                        asking = beside[0][q_order[slice(*np.searchsorted(q_starts, [stretch, stretch + 1]))]]
                        parts = [y for at in (mine, asking) for y in (run[at].astype(np.int32), ids[at], codes[at])]
                        lines.append((width, curve, int(stretch), *(p.tobytes() for p in parts)))
                kinds = [pa.int32()] * 3 + [pa.binary()] * len(_PARTS)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*lines), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["width", "curve", "stretch", *_PARTS])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each query of a stretch, from its sorted lines."""
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("width", "curve", "stretch", *_PARTS)]
            for line in zip(*columns, strict=True):
                if held and held[-1][:3] != line[:3]:
                    yield from _stretch(held, keep, bits)
                    held = []
                held.append(line)
        if held:
            yield from _stretch(held, keep, bits)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qnum, lists in zip(batch.column("qnum").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                nums = np.concatenate([np.frombuffer(x["nums"], np.int64) for x in lists])
                scores = np.concatenate([np.frombuffer(x["scores"], np.float64) for x in lists])
                order = np.lexsort((nums, -scores))
                _, first = np.unique(nums[order], return_index=True)
                best = nums[order][np.sort(first)[:rerank]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qnum)), pa.array(best)], names=["qnum", "num"])

    names = ", ".join(f"{p} binary" for p in _PARTS)
    lines = classes.select("num", "asked", "embedding").mapInArrow(dealt, f"width int, curve int, stretch int, {names}")
    lines = lines.repartition("width", "curve", "stretch").sortWithinPartitions("width", "curve", "stretch")
    lists = lines.mapInArrow(searched, "qnum long, nums binary, scores binary")
    # a query has at most a few short lists a curve
    lists = lists.groupBy("qnum").agg(F.collect_list(F.struct("nums", "scores")).alias("lists"))
    return lists.mapInArrow(merged, "qnum long, num long")


def _stretch(lines: list[tuple], keep: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Queries of a stretch against the rows of their run and those beside it."""
    width = _code_bytes(lines[0][0], bits)
    kinds = (np.int32, np.int64, np.uint8)
    runs, nums, codes, q_runs, q_nums, q_codes = (
        np.concatenate([np.frombuffer(line[3 + i], kinds[i % 3]) for line in lines]) for i in range(6)
    )
    if not len(runs) or not len(q_runs):
        return
    order, q_order = np.argsort(runs, kind="stable"), np.argsort(q_runs, kind="stable")
    runs, nums, rows = runs[order], nums[order], from_codes(codes.reshape(-1, width)[order], bits)
    q_runs, q_nums, asks = q_runs[q_order], q_nums[q_order], from_codes(q_codes.reshape(-1, width)[q_order], bits)
    out: list[tuple] = []
    for run in np.unique(q_runs):
        lo, hi = np.searchsorted(runs, [run - REACH, run + REACH + 1])
        first, last = np.searchsorted(q_runs, [run, run + 1])
        if hi == lo:
            continue
        for at in range(first, last, 256):
            scores = asks[at : min(last, at + 256)] @ rows[lo:hi].T
            few = min(keep, hi - lo)
            best = np.argpartition(-scores, few - 1, axis=1)[:, :few]
            found = np.take_along_axis(scores, best, axis=1)
            out += [
                (int(q_nums[at + i]), nums[lo + best[i]].tobytes(), found[i].astype(np.float64).tobytes()) for i in range(len(best))
            ]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["qnum", "nums", "scores"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.empty(batch.num_rows)
        for rows, q in _by_length(batch.column("qv")):
            c = np.stack([batch.column("embedding")[int(i)].values.to_numpy(zero_copy_only=False) for i in rows]).astype(np.float64)
            q, c = _scaled(q), _scaled(c)
            scores[rows] = np.einsum("ij,ij->i", q, c) / (np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], names=["qnum", "cid", "ids", "score"])


def _top(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best rows and their cosines, ties to the smaller id."""
    norm, least = np.linalg.norm(c, axis=1), max(0, len(c) - k)
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        scores = (part @ c.T) / (np.linalg.norm(part, axis=1)[:, None] * norm[None, :])
        bar = np.partition(scores, least, axis=1)[:, least]
        for i, row in enumerate(scores):
            near = np.flatnonzero(row >= bar[i])
            near = near[np.lexsort((ids[near], -row[near]))[:k]]
            yield lo + i, near, row[near]
