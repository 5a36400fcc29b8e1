"""A panel as dense tiles of steps and series, and products of its tiles with blocks of a matrix, in numpy inside tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256  # steps and series of a tile: 512 KB
KINDS = (np.uint8, np.int16, np.float32, np.float64)  # types of packed values, narrowest first
RUN_CELLS = 1 << 18  # cells that a task gathers before it packs them: some 10 MB


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, columns)


def panel_tiles(cells: DataFrame, series: int) -> DataFrame:
    """``(rows, columns, data)``: tiles of the cells (step, code, v), steps by series; absent cells are 0.

    ``rows`` and ``columns`` number the tiles.  A tile is gathered by itself, so neither a step nor a series is.
    """
    place = F.struct(F.pmod("step", F.lit(SIDE)).cast("int").alias("i"), F.pmod("code", F.lit(SIDE)).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    keyed = cells.select(F.floor(F.col("step") / SIDE).alias("rows"), F.floor(F.col("code") / SIDE).alias("columns"), place.alias("z"))
    gathered = keyed.groupBy("rows", "columns").agg(F.collect_list("z").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, columns, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                i, j, v = (cell.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                tile = np.zeros((SIDE, min(SIDE, series - columns * SIDE)))
                tile[i, j] = v
                yield _batch([(rows, columns, tile.tobytes())], ["rows", "columns", "data"])

    return gathered.select("rows", "columns", "z").mapInArrow(run, "rows bigint, columns bigint, data binary")


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """The number of the narrowest type that holds all values exactly, and their bytes in it."""
    for number, kind in enumerate(KINDS):
        with np.errstate(invalid="ignore", over="ignore"):
            narrow = values.astype(kind)
        if number == len(KINDS) - 1 or (narrow == values).all():
            return number, narrow.tobytes()
    raise AssertionError


def panel_runs(cells: DataFrame) -> DataFrame:
    """``(sid, rows, n, mean, spread, last, data)``: the cells (sid, idx, y) of a series in a block of 256 steps, packed.

    ``spread`` is the sum of squares about the run's ``mean``, ``last`` its highest idx.  Nothing is shuffled: a run has
    those cells that come to a task within ``RUN_CELLS`` of each other.  Cells that come series by series, as the rows of a
    dense grid do, make a run for each series and block; others make more runs, as right and less narrow.
    """

    def runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(0).combine_chunks().dictionary_encode()
        series, idx, y = names.indices.to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
        order = np.lexsort((idx, series))
        series, idx, y = series[order], idx[order], y[order]
        rows = idx // SIDE
        starts = np.r_[0, np.flatnonzero((np.diff(series) != 0) | (np.diff(rows) != 0)) + 1]
        n = np.diff(np.r_[starts, len(idx)])
        mean = y[starts] + np.add.reduceat(y - np.repeat(y[starts], n), starts) / n  # exact for values that do not vary
        spread = np.add.reduceat((y - np.repeat(mean, n)) ** 2, starts)
        steps, data = (idx % SIDE).astype(np.uint8), []
        for a, b in zip(starts, starts + n):
            number, values = _narrow(y[a:b])
            data.append(zlib.compress(bytes([number]) + np.diff(steps[a:b], prepend=np.uint8(0)).tobytes() + values, 1))
        columns = [names.dictionary.take(pa.array(series[starts])), pa.array(rows[starts]), pa.array(n), pa.array(mean), pa.array(spread),
                   pa.array(idx[starts + n - 1]), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["sid", "rows", "n", "mean", "spread", "last", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= RUN_CELLS:
                yield runs(held)
                held, size = [], 0
        if size:
            yield runs(held)

    cells = cells.select(F.col("sid").cast("string"), F.col("idx").cast("bigint"), F.col("y").cast("double"))
    return cells.mapInArrow(run, "sid string, rows bigint, n bigint, mean double, spread double, last bigint, data binary")


def packed_tiles(runs: DataFrame, series: int, width: int = SIDE) -> DataFrame:
    """``(rows, columns, data)``: packed tiles, ``width`` series by steps, of the runs (rows, code, center, data).

    A tile holds the cells as they are, in the narrowest type that does, beside the centers of its series, for tables
    that are shuffled many times over; ``centred`` takes it apart.
    """
    place = F.struct(F.pmod("code", F.lit(width)).cast("int").alias("j"), F.col("center").cast("double").alias("center"), "data")
    gathered = runs.select("rows", F.floor(F.col("code") / width).alias("columns"), place.alias("z")).groupBy("rows", "columns").agg(F.collect_list("z").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, columns, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                j, center = (z.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                centers = np.zeros(min(width, series - columns * width))
                centers[j] = center
                tile, steps = np.repeat(centers[:, None], SIDE, axis=1), 0  # absent cells are at their center
                for at, raw in zip(j, z.values.field(2)):
                    raw = zlib.decompress(raw.as_py())
                    kind = KINDS[raw[0]]
                    n = (len(raw) - 1) // (1 + kind().itemsize)
                    i = np.cumsum(np.frombuffer(raw, np.uint8, n, 1), dtype=np.int64)
                    tile[at, i] = np.frombuffer(raw, kind, n, 1 + n)
                    steps = max(steps, int(i[-1]) + 1)
                number, values = _narrow(tile[:, :steps])
                yield _batch([(rows, columns, zlib.compress(np.array([number, steps], np.int32).tobytes() + centers.tobytes() + values))], ["rows", "columns", "data"])

    return gathered.select("rows", "columns", "z").mapInArrow(run, "rows bigint, columns bigint, data binary")


def centred(raw: bytes) -> np.ndarray:
    """A packed tile less its centers, series by steps up to the last one that has a cell."""
    raw = zlib.decompress(raw)
    number, steps = np.frombuffer(raw, np.int32, 2)
    series = (len(raw) - 8) // (8 + int(steps) * KINDS[number]().itemsize)
    return np.frombuffer(raw, KINDS[number], offset=8 + 8 * series).reshape(series, -1) - np.frombuffer(raw, np.float64, series, 8)[:, None]


def added(parts: DataFrame) -> DataFrame:
    """Sums of the matrices ``data`` of equal ``block``, one after another in a task of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.frombuffer(raw, np.float64)
                sums[block] = sums[block] + one if block in sums else one
        for block, total in sums.items():
            yield _batch([(block, total.tobytes())], ["block", "data"])

    # a task's blocks are added up before they are shuffled, and again behind it
    first = parts.select("block", "data").mapInArrow(run, "block bigint, data binary")
    return first.repartition("block").mapInArrow(run, "block bigint, data binary")


def times(tiles: DataFrame, blocks: DataFrame, width: int, over: str) -> DataFrame:
    """``(block, data)``: the panel times a matrix of ``width`` columns given in ``blocks`` over its series (``over`` =
    "columns"), or its transpose times one over its steps (``over`` = "rows"); a join on the block and sums of products."""
    by = "rows" if over == "columns" else "columns"
    joined = tiles.join(blocks.select(F.col("block").alias(over), F.col("data").alias("other")), over).select(by, "data", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, other in zip(*[c.to_pylist() for c in batch.columns]):
                tile = np.frombuffer(raw, np.float64).reshape(SIDE, -1)
                product = (tile if over == "columns" else tile.T) @ matrix(other, width)
                yield _batch([(block, product.tobytes())], ["block", "data"])

    return added(joined.mapInArrow(run, "block bigint, data binary"))


def inner_products(blocks: DataFrame, width: int) -> np.ndarray:
    """The sum of each block's transpose times itself: ``width`` squared numbers, added up in the cluster in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                one = matrix(raw, width)
                total += one.T @ one
        yield _batch([(k, part.tobytes()) for k, part in enumerate(np.array_split(total, min(16, width)))], ["block", "data"])

    parts = sorted(added(blocks.select("data").mapInArrow(run, "block bigint, data binary")).collect())
    return np.concatenate([matrix(p.data, width) for p in parts]) if parts else np.zeros((width, width))


def turned(blocks: DataFrame, width: int, by: np.ndarray) -> DataFrame:
    """Every block times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*[c.to_pylist() for c in batch.columns]):
                yield _batch([(block, (matrix(raw, width) @ by).tobytes())], ["block", "data"])

    return blocks.select("block", "data").mapInArrow(run, "block bigint, data binary")


def blocks_of(rows: DataFrame) -> DataFrame:
    """``(block, data)`` from rows (code, array column ``q``), in code order."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("code", "q"))), lambda z: z["q"]))
    grouped = rows.groupBy(F.floor(F.col("code") / SIDE).alias("block")).agg(ordered.alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch([(block, np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64).tobytes())], ["block", "data"])

    return grouped.mapInArrow(run, "block bigint, data binary")


def rows_of(blocks: DataFrame, width: int) -> DataFrame:
    """Rows (code, ``q``) from blocks of ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*[c.to_pylist() for c in batch.columns]):
                one = matrix(raw, width)
                offsets = pa.array(np.arange(len(one) + 1, dtype=np.int32) * width)
                values = pa.ListArray.from_arrays(offsets, pa.array(one.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(one)) + block * SIDE), values], ["code", "q"])

    return blocks.select("block", "data").mapInArrow(run, "code bigint, q array<double>")
