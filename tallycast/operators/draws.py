"""Sampling operators.  Every draw is keyed by a hash, so a recomputed task repeats its numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.counts import beta_binomial_quantile, nb_below, nb_quantile
from tallycast.functions.distributions import nb_logpmf, nb_support
from tallycast.functions.numeric import hash_normal, hash_uniform
from tallycast.operators.panel import series_codes
from tallycast.session import materialise

FAN_OUT = 256


def sample_paths(df: DataFrame, samples: int, out: str = "sample_id") -> DataFrame:
    """Replicate each row once per sample path; a narrow generator, nothing is shuffled."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def dequantise(value: Column, seed: str, *keys: Column) -> Column:
    """Count plus uniform noise in [0, 1)."""
    return value + hash_uniform(seed, *keys)


def nb_table(params: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, k, pmf, cdf)`` of the negative binomial (Poisson where ``shape`` is NULL) of every row with ``mu`` and ``shape``.

    k runs over the support that :func:`nb_support` takes from the row's own mean and spread; the running sum is a
    window over one distribution's counts.
    """
    low, top = nb_support(F.col("mu"), F.col("shape"))
    wide = params.withColumn("k", F.explode(F.sequence(low, top)))
    pmf = F.exp(nb_logpmf(F.col("k").cast("double"), F.col("mu"), F.col("shape")))
    mass = wide.select(*keys, "k", F.coalesce(pmf, F.lit(0.0)).alias("pmf"))
    running = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return mass.withColumn("cdf", F.sum("pmf").over(running))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _nb_inverse(uniforms: pd.Series, mu: pd.Series, shape: pd.Series) -> pd.Series:
    """Least counts whose distribution function reaches the uniforms of a row."""
    sizes = uniforms.map(len).to_numpy()
    flat = np.concatenate(uniforms.to_list()) if len(uniforms) else np.empty(0)
    mean, r = (np.repeat(c.to_numpy(dtype=float, na_value=np.nan), sizes) for c in (mu, shape))
    return pd.Series(np.split(nb_quantile(flat, np.nan_to_num(mean), r), np.cumsum(sizes)[:-1]) if len(sizes) else [])


@F.pandas_udf(T.DoubleType())
def nb_cdf(k: pd.Series, mu: pd.Series, shape: pd.Series) -> pd.Series:
    """P(X <= k) of the negative binomial (Poisson where ``shape`` is NULL), without a table."""
    return pd.Series(nb_below(*(c.to_numpy(dtype=float, na_value=np.nan) for c in (k, mu, shape))))


def nb_quantiles(mu: Column, shape: Column, levels: Column) -> Column:
    """Array of quantiles of the negative binomial at an array of levels between 0 and 1."""
    return _nb_inverse(levels, mu, shape)


def nb_samples(df: DataFrame, samples: int, seed: str, keys: list[str], at_least_one: bool = False) -> DataFrame:
    """``samples`` array of negative-binomial draws per row with ``mu`` and ``shape``, by inversion of keyed uniforms.

    Work and memory of a draw do not depend on the spread of the counts.  ``at_least_one`` replaces zeros by 1, the
    rule for totals that are to be split.
    """
    uniforms = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: hash_uniform(seed, *[F.col(k) for k in keys], i))
    drawn = nb_quantiles(F.col("mu"), F.col("shape"), uniforms)
    if at_least_one:
        drawn = F.transform(drawn, lambda v: F.greatest(v, F.lit(1.0)))
    return df.withColumn("samples", drawn).drop("mu", "shape")


def halvings(size: int) -> list[tuple[int, int]]:
    """``(first child, half)`` of the splits in a group of up to ``size`` children, widest first; ``size`` is a power of 2."""
    out, half = [], size // 2
    while half:
        out += [(low, half) for low in range(0, size, 2 * half)]
        half //= 2
    return out


def _split_uniforms(seed: str, keys: list[str], fan_out: int, width: int):
    """The uniforms of a split (low, half) for all draws of a row."""

    def uniforms(s: Column) -> Column:
        first = (F.col("node") * fan_out + s["low"]) * width
        key = [*[F.col(k) for k in keys], first, s["half"] * width]
        return F.transform(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: hash_uniform(seed, *key, i))

    return uniforms


def _split_batches(fan_out: int):
    """Children's counts of every row's draws by conditional beta-binomials down the halves of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("counts", "alphas", "uniforms")}
            every = []
            for counts, alphas, uniforms in zip(*[batch.column(at[n]).to_pylist() for n in ("counts", "alphas", "uniforms")]):
                sums = np.concatenate(([0.0], np.cumsum(alphas)))
                held, size, used = {0: np.array(counts)}, len(alphas), 0
                half = fan_out // 2
                while half:
                    lows = [low for low in range(0, size, 2 * half) if low + half < size]
                    if lows:
                        left = [sums[low + half] - sums[low] for low in lows]
                        right = [sums[min(low + 2 * half, size)] - sums[low + half] for low in lows]
                        draws = len(counts)
                        n = np.concatenate([held[low] for low in lows])
                        u = np.array(uniforms[used : used + len(lows) * draws])
                        used += len(lows) * draws
                        part = beta_binomial_quantile(u, n, np.repeat(left, draws), np.repeat(right, draws)).reshape(len(lows), draws)
                        for low, one in zip(lows, part):
                            held[low + half] = held[low] - one
                            held[low] = one
                    half //= 2
                every.append([held[k].tolist() for k in range(size)])
            kept = [k for k in range(batch.num_columns) if k not in at.values()]
            names = [batch.schema.field(k).name for k in kept]
            columns = [batch.column(k) for k in kept] + [pa.array(every, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "parts"])

    return run


def dm_split(totals: DataFrame, alphas: DataFrame, keys: list[str], slot: str, seed: str, fan_out: int = FAN_OUT) -> DataFrame:
    """Split drawn totals over the series: probabilities ~ Dirichlet(alpha), counts ~ multinomial.

    ``totals``: ``keys`` (which name a row), ``slot`` and ``counts``, an array of totals, one per draw; ``alphas``:
    ``(slot, sid, alpha)``.  Returns ``keys``, ``slot``, ``sid`` and ``counts``, its part of every draw.

    A Dirichlet-multinomial over a tree of nested groups is the same distribution as over the leaves when each node
    carries the sum of its children's alpha, and a node with two children splits by a beta-binomial.  The series, in
    the order of their names, are halved at powers of two; every half gets its part by inversion of a uniform keyed by
    (seed, keys, first series, width of the half, draw).  ``fan_out``, the next power of two, is how many children one
    row carries: it shapes the job, not the draws, and no task holds more alphas of a draw.

    ``alphas`` is read once per level and to number the series, so it is written first.
    """
    fan_out = 1 << (max(fan_out, 2) - 1).bit_length()
    alphas = materialise(alphas)
    codes = materialise(series_codes(alphas))
    leaves = alphas.join(codes, "sid").select(slot, F.col("code").alias("node0"), "alpha")
    size = codes.count()
    levels = [leaves.withColumn("node1", F.floor(F.col("node0") / fan_out))]
    while size > fan_out:
        size = -(-size // fan_out)
        depth = len(levels)
        up = levels[-1].groupBy(slot, F.col(f"node{depth}")).agg(F.sum("alpha").alias("alpha"))
        levels.append(up.withColumn(f"node{depth + 1}", F.floor(F.col(f"node{depth}") / fan_out)))
    names = [*keys, *([] if slot in keys else [slot])]
    current = totals.select(*names, F.lit(0).cast("long").alias("node"), "counts")
    types = dict(totals.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", children array<long>, parts array<array<double>>"
    splits = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(half).alias("half")) for low, half in halvings(fan_out)])
    for depth in range(len(levels), 0, -1):
        child, parent = f"node{depth - 1}", f"node{depth}"
        packed = F.array_sort(F.collect_list(F.struct(F.col(child).alias("child"), "alpha")))
        nodes = levels[depth - 1].groupBy(slot, F.col(parent).alias("node")).agg(packed.alias("_c")).select(
            slot, "node", F.col("_c.child").alias("children"), F.col("_c.alpha").alias("alphas")
        )
        width = fan_out ** (depth - 1)  # series below a child
        real = F.filter(splits, lambda s: s["low"] + s["half"] < F.size("children"))

        uniforms = _split_uniforms(seed, keys, fan_out, width)
        ready = current.join(nodes, [slot, "node"]).withColumn("uniforms", F.flatten(F.transform(real, uniforms)))
        split = ready.select(*names, "children", "counts", "alphas", "uniforms").mapInArrow(_split_batches(fan_out), schema)
        current = split.select(*names, F.explode(F.arrays_zip("children", "parts")).alias("_z")).select(
            *names, F.col("_z.children").alias("node"), F.col("_z.parts").alias("counts")
        )
    return current.join(codes, F.col("node") == F.col("code")).select(*names, "sid", "counts")


def gaussian_draw(mean: Column, sd: Column, seed: str, *keys: Column) -> Column:
    return mean + sd * hash_normal(seed, *keys)


def with_step_normals(rows: DataFrame, samples: int, seed: str, step_keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_normals``, the factor normals of their step: one array per sample, one number per factor.

    They depend on (factor, step, sample) only and are drawn once per step, then met by an equi-join.
    """
    width = rows.agg(F.max(F.size("loadings"))).scalar()
    width = F.coalesce(width, F.lit(0))
    factors = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    step = [F.col(k) for k in step_keys]
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda i: F.transform("_k", lambda k: hash_normal(seed, F.lit("factor"), k, *step, i)),
    )
    steps = rows.select(*step_keys).distinct().withColumn("_k", factors).withColumn("_normals", drawn).drop("_k")
    return rows.join(steps, list(step_keys))


def factor_noise(samples: int, seed: str, step_keys: Sequence[str]) -> Column:
    """Array of correlated zero-mean draws of a row with ``sid``, ``loadings``, ``diag`` and ``_normals``.

    Sample i of a step shares its factor normals with all series of that step; nothing is gathered per step.
    """
    step = [F.col(k) for k in step_keys]

    def draw(i: Column) -> Column:
        shared = F.zip_with("loadings", F.slice(F.col("_normals")[i], 1, F.size("loadings")), lambda v, z: v * z)
        common = F.aggregate(shared, F.lit(0.0), lambda acc, v: acc + v)
        return common + F.sqrt("diag") * hash_normal(seed, F.lit("own"), F.col("sid"), *step, i)

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), draw)
