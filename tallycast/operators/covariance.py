"""Covariance, correlation and low-rank factors across series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import hash_normal
from tallycast.operators.panel import series_codes
from tallycast.operators.tiles import SIDE, added, blocks_of, centred, inner_products, matrix, packed_tiles, panel_runs, panel_tiles, rows_of, times, turned
from tallycast.session import materialise

DIM_BLOCK = 256
STRIPS = (16, 8, 4, 2, 1)  # blocks of series to a strip, at most and fewer: the sums of a pair of 16 take 128 MB of a task
SMALL_SERIES = 250_000  # up to which their means (some 50 bytes each) are broadcast
PAIRS = "sid_a string, sid_b string, cov double, corr double"
EXTRA = 10  # start vectors beyond the rank
TOLERANCE = 1e-3  # relative change of the leading values in a round, below which iteration ends
MOST_ROUNDS = 200
WHOLE_LIMIT = 2048  # series up to which a whole covariance is factored: 32 MB on the driver


def _multiplied(batches: Iterator[pa.RecordBatch], names: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(a, b, matrix)``: products of two blocks of series, summed over the steps of a pair of strips and salt.

    Rows (p, q, salt, rows, right, columns, data, named) come sorted by pair, salt and rows, so a task holds the tiles of one
    block of steps and the sums of one pair.  Rows without data hold the names of a block, kept in ``names``.
    """
    sums: dict[tuple[int, int], np.ndarray] = {}
    sides: tuple[dict, dict] = ({}, {})
    pair = at = None

    def multiply() -> None:
        left, right = sides if pair and pair[0] != pair[1] else (sides[0], sides[0])
        for a, x in left.items():
            for b, y in right.items():
                if a <= b:
                    steps = min(x.shape[1], y.shape[1])  # behind them, one side has no cells
                    product = x[:, :steps] @ y[:, :steps].T
                    sums[a, b] = np.add(sums[a, b], product, out=sums[a, b]) if (a, b) in sums else product
        sides[0].clear(), sides[1].clear()

    for batch in batches:
        keys = zip(*[c.to_pylist() for c in batch.columns[:6]])
        for k, (p, q, salt, rows, right, columns) in enumerate(keys):
            if (p, q, salt) != pair or rows != at:
                multiply()
            if (p, q, salt) != pair:
                yield from ((*ab, total) for ab, total in sums.items())
                sums.clear()
            pair, at = (p, q, salt), rows
            if batch.column(6)[k].is_valid:
                sides[right][columns] = centred(batch.column(6)[k].as_py())
            else:
                names[columns] = batch.column(7)[k].values
    multiply()
    yield from ((*ab, total) for ab, total in sums.items())


def _pair_rows(a: int, b: int, total: np.ndarray, names: dict, steps: int) -> pa.RecordBatch:
    """``(sid_a, sid_b, cov, corr)`` of a sum of products of two blocks, the upper half if they are the same."""
    (sids_a, sd_a), (sids_b, sd_b) = ((names[k].field("sid"), names[k].field("_sd").to_numpy(zero_copy_only=False)) for k in (a, b))
    cov, scale = total / max(1, steps - 1), np.outer(sd_a, sd_b)
    corr = np.divide(cov, scale, out=np.zeros(cov.shape), where=scale != 0)
    i, j = (x.astype(np.int32) for x in (np.triu_indices(len(total)) if a == b else np.indices(total.shape).reshape(2, -1)))
    cov, scale, corr = (x[i, j] if a == b else x.ravel() for x in (cov, scale, corr))
    none = np.full(len(cov), steps < 2)
    columns = [sids_a.take(pa.array(i)), sids_b.take(pa.array(j)), pa.array(cov, mask=none), pa.array(corr, mask=none | (scale == 0))]
    return pa.RecordBatch.from_arrays(columns, ["sid_a", "sid_b", "cov", "corr"])


def covariance(panel: DataFrame, codes: DataFrame | None = None, value: str = "y", width: int = DIM_BLOCK) -> DataFrame:
    """Sample covariance and correlation of the pairs of series: ``(sid_a, sid_b, cov, corr)``, a <= b.

    The dense panel ``(sid, ts, idx, y)`` is packed where its rows are made, into runs of 256 steps of a series, and only
    those are written and shuffled, to packed tiles of 256 steps and ``width`` series.  Strips of up to
    16 such blocks of series meet pair by pair: a task multiplies the tiles of its pair, one block of steps after
    another, and returns its part of the result by itself, with the names that came along.  So tiles are shuffled once for
    each strip, and the D x D result, D^2 rows by nature, not at all.  Where there are fewer pairs than tasks, the steps of
    a pair are dealt to several and their matrices, no more than tasks, are added up.
    """
    spark = panel.sparkSession
    runs = materialise(panel_runs(panel.select("sid", "idx", F.col(value).alias("y"))), "runs")
    codes = series_codes(runs) if codes is None else codes
    tasks = max(8, 2 * spark.sparkContext.defaultParallelism)
    # means and squares of runs about the least of a series' means, which does not cancel and leaves 0 where nothing varies
    base, off = F.first("_base"), F.col("mean") - F.col("_base")
    about = runs.join(runs.groupBy("sid").agg(F.min("mean").alias("_base")), "sid").groupBy("sid").agg(
        base.alias("_base"), F.sum("n").alias("_t"), F.max("last").alias("_last"), F.sum(F.col("n") * off).alias("_off"), F.sum(F.col("spread") + F.col("n") * off * off).alias("_squares"))
    squares = F.greatest(F.col("_squares") - F.col("_off") * F.col("_off") / F.col("_t"), F.lit(0.0))
    moments = about.select("sid", (F.col("_base") + F.col("_off") / F.col("_t")).alias("_mean"), F.sqrt(squares / F.nullif(F.col("_t") - 1, F.lit(0))).alias("_sd"), "_t", "_last")
    attrs = materialise(moments.join(codes, "sid"))
    count, steps, last = attrs.agg(F.count("*"), F.max("_t"), F.max("_last")).first()
    blocks, steps = max(1, -(-count // width)), steps or 0
    for strip in STRIPS:  # the widest that leaves some pairs for every task
        strips = -(-blocks // strip)
        pairs = strips * (strips + 1) // 2
        if pairs >= 4 * tasks:
            break
    salts = max(1, min(tasks // pairs, (last or 0) // SIDE + 1))

    means = attrs.select("sid", "code", F.col("_mean").alias("center"))
    tiles = packed_tiles(runs.select("sid", "rows", "data").join(F.broadcast(means) if count <= SMALL_SERIES else means, "sid"), count, width)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("code", "sid", "_sd"))), lambda z: F.struct(z["sid"].alias("sid"), z["_sd"].alias("_sd")))
    named = attrs.groupBy(F.floor(F.col("code") / width).alias("columns")).agg(ordered.alias("named"))
    rows = tiles if salts > 1 else tiles.unionByName(named.withColumn("rows", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    if salts > 1:
        rows = rows.withColumn("named", F.lit(None).cast(named.schema["named"].dataType))
    own, other = F.floor(F.col("columns") / strip), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(strips - 1).cast("bigint")))
    met = rows.select("*", own.alias("_own"), other.alias("_other")).select(
        F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"), F.pmod("rows", F.lit(salts)).cast("int").alias("salt"), "rows",
        (F.col("_other") < F.col("_own")).cast("int").alias("right"), "columns", "data", "named")
    dealt = met.repartition(min(pairs * salts, 16 * tasks), "p", "q", "salt").sortWithinPartitions("p", "q", "salt", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        for a, b, total in _multiplied(batches, names):
            yield _pair_rows(a, b, total, names, steps)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, total in _multiplied(batches, {}):
            yield pa.RecordBatch.from_arrays([pa.array([a * blocks + b]), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (block, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = divmod(block, blocks)
                names = {a: batch.column(2)[k].values, b: batch.column(3)[k].values}
                yield _pair_rows(a, b, matrix(raw, len(names[b])), names, steps)

    if salts == 1:
        return dealt.mapInArrow(run, PAIRS)
    one = added(dealt.mapInArrow(sums, "block bigint, data binary"))
    left = named.select(F.col("columns").alias("a"), F.col("named").alias("named_a"))
    right = named.select(F.col("columns").alias("b"), F.col("named").alias("named_b"))
    keyed = one.select("*", F.floor(F.col("block") / blocks).alias("a"), F.pmod("block", F.lit(blocks)).alias("b")).join(left, "a").join(right, "b")
    return keyed.select("block", "data", "named_a", "named_b").mapInArrow(finish, PAIRS)


def pair_covariance(panel: DataFrame, pairs: DataFrame, value: str = "y") -> DataFrame:
    """``(sid_a, sid_b, cov, corr, n)`` of declared pairs (sid_a, sid_b) only, over the steps at which both have a value.

    Two equi-joins and one grouped sum: the work grows with pairs times steps, not with the square of the series.
    """
    values = panel.filter(F.col(value).isNotNull())
    a = values.select(F.col("sid").alias("sid_a"), "ts", F.col(value).alias("a"))
    b = values.select(F.col("sid").alias("sid_b"), "ts", F.col(value).alias("b"))
    both = a.join(pairs.select("sid_a", "sid_b").distinct(), "sid_a").join(b, ["sid_b", "ts"])
    return both.groupBy("sid_a", "sid_b").agg(F.covar_samp("a", "b").alias("cov"), F.corr("a", "b").alias("corr"), F.count("*").alias("n"))


def _whole_rows(centred: DataFrame, steps: int) -> DataFrame:
    """``(code, q)``: each series' centred values over the root of the steps less one, in step order.

    As loadings of one factor per step they give the sample covariance itself, without any product of series.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", "v")))
    root = float(np.sqrt(max(1, steps - 1)))
    return centred.groupBy("code").agg(F.transform(ordered, lambda z: z["v"] / root).alias("q"))


def factor_model(
    panel: DataFrame, rank: int, value: str = "y", iterations: int = MOST_ROUNDS, seed: str = "factors", tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Low-rank plus diagonal covariance: ``(sid, loadings array)`` and ``(sid, diag)``.

    Leading eigenvectors of the sample covariance by subspace iteration: a keyed random start with some vectors more than
    the rank, rounds of series to steps and back, an orthonormal basis in between, and a last rotation.  It ends when
    no leading value changes by more than ``tolerance`` of itself in a round, or after ``iterations`` rounds; a start
    as wide as the steps allow needs one round only, and one as wide as the series none.

    The centred panel is written once as dense tiles; both directions are products of tiles with blocks of the basis in
    numpy and sums of blocks by key, so a plan does not grow with the rank.  Only products as wide as the rank come to the
    driver.  A rank of at least the number of series gives the whole covariance; beyond ``WHOLE_LIMIT`` series, or more
    series than steps, it has one factor per step, the centred values themselves, and nothing is multiplied.
    """
    moments = materialise(panel.groupBy("sid").agg(F.avg(value).alias("_mean"), F.var_samp(value).alias("var"), F.count("*").alias("_t")), "moments")
    count, steps = moments.agg(F.count("*"), F.max("_t")).first()
    rank = min(rank, count, max(1, (steps or 2) - 1)) if count else 0
    if not rank:
        none = moments.select("sid", F.array().cast("array<double>").alias("loadings"))
        return none, moments.select("sid", F.coalesce("var", F.lit(0.0)).alias("diag"))
    most = min(count, max(1, (steps or 2) - 1))
    width = min(rank + EXTRA, most)
    codes = materialise(series_codes(moments), "codes")
    times_ = materialise(series_codes(panel.select(F.col("ts").cast("string").alias("sid")).distinct()), "steps")
    numbered = panel.select("sid", F.col("ts").cast("string").alias("_at"), F.col(value).alias("_y")).join(moments.select("sid", "_mean"), "sid")
    coded = numbered.join(codes, "sid").join(times_.select(F.col("sid").alias("_at"), F.col("code").alias("step")), "_at")
    centred = coded.select("step", "code", F.coalesce(F.col("_y") - F.col("_mean"), F.lit(0.0)).alias("v"))
    if rank == most and (count > most or count > WHOLE_LIMIT):
        table = materialise(_whole_rows(centred, steps), "loadings")
    else:
        table = _leading(centred, codes, count, steps, rank, width, most, iterations, seed, tolerance)
    loadings = table.join(codes, "code").select("sid", F.col("q").alias("loadings"))
    explained = F.aggregate("loadings", F.lit(0.0), lambda acc, v: acc + v * v)
    diag = moments.join(loadings, "sid").select("sid", F.greatest(F.coalesce("var", F.lit(0.0)) - explained, F.lit(0.0)).alias("diag"))
    return loadings, diag


def _leading(centred: DataFrame, codes: DataFrame, count: int, steps: int, rank: int, width: int, most: int, iterations: int, seed: str, tolerance: float) -> DataFrame:
    """``(code, q)``: loadings on the leading factors."""
    tiles = materialise(panel_tiles(centred, count), "tiles")
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: hash_normal(seed, F.col("sid"), j))
    if width == count:  # the series themselves span everything
        start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(j == F.col("code"), 1.0).otherwise(0.0))
        iterations = 0
    basis = materialise(blocks_of(codes.select("code", start.alias("q"))), "basis")
    before = None
    for number in range(iterations if width < most else min(iterations, 1)):
        wide = materialise(times(tiles, times(tiles, basis, width, "columns"), width, "rows"), "factors")
        values, vectors = np.linalg.eigh(inner_products(wide, width))
        kept = values > max(values.max(), 0.0) * 1e-12
        root = np.where(kept, 1.0 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
        basis = materialise(turned(wide, width, vectors * root), "basis")
        leading = np.sqrt(np.maximum(values[::-1][:rank], 0.0))
        if number > 1 and (np.abs(leading - before) <= tolerance * leading).all():  # the first round's start is not orthonormal
            break
        before = leading
    values, vectors = np.linalg.eigh(inner_products(times(tiles, basis, width, "columns"), width) / max(1, steps - 1))
    rotation = (vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0.0)))[:, :rank]
    return materialise(rows_of(turned(basis, width, rotation), rank), "loadings")
