"""Least squares with several regressors by key: cross products are summed in Spark, each key's small system is solved from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """keys, n, intercept, beta (array, one a regressor), t (its t-statistics), r2; rows with a null are left out.

    Keys with a singular system, or with no more rows than coefficients, give null coefficients. What reaches a task is
    one row of (k + 2)^2 / 2 sums a key, whatever the number of rows.
    """
    own = df.select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).dropna(subset=["_y", *[f"_x{i}" for i in range(len(xs))]])
    names = [*[f"_x{i}" for i in range(len(xs))], "_y"]
    # around the means, so that large levels do not drown the spread
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    spread = [F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    sums = own.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("m"), F.array(*spread).alias("c"))
    return solved(sums, keys, len(xs))


def solved(sums: DataFrame, keys: list[str], k: int) -> DataFrame:
    """As ols, from keys, n, m (means of k regressors and the outcome) and c (their covariances, row by row of the upper triangle)."""
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"intercept": [], "beta": [], "t": [], "r2": []}
            for n, m, c in zip(*(batch.column(name).to_pylist() for name in ("n", "m", "c")), strict=True):
                full = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(pairs, c, strict=True):
                    full[i, j] = full[j, i] = v
                scale = np.sqrt(np.diag(full))
                fits = n > k + 1 and (scale[:k] > 0).all()
                unit = full / np.outer(np.where(scale > 0, scale, 1), np.where(scale > 0, scale, 1))
                fits = fits and np.linalg.matrix_rank(unit[:k, :k], tol=1e-10) == k
                if not fits:
                    for v in out.values():
                        v.append(None)
                    continue
                inverse = np.linalg.inv(unit[:k, :k])
                b = inverse @ unit[:k, k]
                r2 = float(b @ unit[:k, k]) if scale[k] > 0 else None
                left = max(0.0, 1 - (r2 or 0)) / (n - k - 1)
                beta = b * scale[k] / scale[:k]
                out["beta"].append(beta.tolist())
                out["intercept"].append(float(m[k] - beta @ np.array(m[:k])))
                out["r2"].append(r2)
                out["t"].append([float(x / s) if s > 0 else None for x, s in zip(b, np.sqrt(left * np.diag(inverse)), strict=True)])
            kinds = [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=[*keys, "n", *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields[: len(keys)])
    return sums.mapInArrow(solve, f"{schema}, n long, intercept double, beta array<double>, t array<double>, r2 double")


def incremental_r2(df: DataFrame, keys: list[str], y: str, xs: list[str], one: str) -> DataFrame:
    """R squared with and without one regressor, and the difference, over the rows that have all."""
    df = df.dropna(subset=[y, *xs])
    full = ols(df, keys, y, xs).select(*keys, "n", F.col("r2").alias("r2_full"))
    less = ols(df, keys, y, [x for x in xs if x != one]).select(*keys, F.col("r2").alias("r2_less"))
    return full.join(less, keys).withColumn("gain", F.col("r2_full") - F.col("r2_less"))


def shapley_blocks(df: DataFrame, keys: list[str], y: str, first: list[str], second: list[str]) -> DataFrame:
    """Shapley split of R squared between two blocks of regressors."""
    df = df.dropna(subset=[y, *first, *second])
    fit = lambda xs, name: ols(df, keys, y, xs).select(*keys, F.col("r2").alias(name))
    out = fit(first, "r2_1").join(fit(second, "r2_2"), keys).join(fit([*first, *second], "r2_both"), keys)
    a, b, both = F.col("r2_1"), F.col("r2_2"), F.col("r2_both")
    return out.withColumns({"shapley_1": (both - b + a) / 2, "shapley_2": (both - a + b) / 2})
