"""Two-way fixed effects of panels that may have gaps and weights, with several regressors.

The effects of unit and time are swept out of the outcome and of every regressor by alternating projections: weighted
unit means are taken off, then weighted time means, until no mean is left above a tolerance. The effects are written down
after some rounds, so that the plan stays short and lost executors cost those rounds alone. What is left gives one row of
weighted cross products, from which the coefficients are solved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import materialize

ROUNDS_A_STATE, MOST_ROUNDS = 4, 400


def dummies(df: DataFrame, group: str, regime: str, groups: list[str], regimes: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each pair of a group and a regime, and their names; a null belongs to none."""
    names = {f"{g}:{k}": F.when((F.col(group) == g) & (F.col(regime) == k), 1.0).otherwise(0.0) for g in groups for k in regimes}
    return df.withColumns(names), list(names)


def _means(rows: DataFrame, by: str, columns: list[str], prefix: str) -> DataFrame:
    """Weighted means by unit or time, summed up where the rows lie before anything moves."""
    return rows.groupBy(by).agg(*[F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(prefix + c) for c in columns])


def _less(rows: DataFrame, effects: DataFrame, by: str, columns: list[str], prefix: str) -> DataFrame:
    return rows.join(effects, by).withColumns({c: F.col(c) - F.col(prefix + c) for c in columns}).drop(*[prefix + c for c in columns])


def swept(df: DataFrame, unit: str, time: str, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """unit, time, _w and columns rid of unit and time effects; columns are doubles, _w is the weight of a row.

    A round takes the time effects off the rows for new unit effects, and these for new time effects, so each step reads the
    rows and one table of effects; only effects are written down, one row a unit or time. It ends when the largest time mean
    of what is left (unit means are zero by then) is below tolerance times the largest value there was.
    """
    widest = lambda d: d.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(c)) for c in d.columns if c not in (unit, time, "_w")])).first()[0] or 0.0
    scale = widest(df.select(*columns)) or 1.0
    times = _means(df, time, columns, "_t")
    for _ in range(MOST_ROUNDS // ROUNDS_A_STATE):
        for _ in range(ROUNDS_A_STATE - 1):
            times = _means(_less(df, _means(_less(df, times, time, columns, "_t"), unit, columns, "_u"), unit, columns, "_u"), time, columns, "_t")
        times = materialize(times)
        units = materialize(_means(_less(df, times, time, columns, "_t"), unit, columns, "_u"))
        left = _less(_less(df, times, time, columns, "_t"), units, unit, columns, "_u")
        if widest(_means(left, time, columns, "_m")) <= tolerance * scale:
            return left
        times = _means(_less(df, units, unit, columns, "_u"), time, columns, "_t")
    raise ValueError(f"no convergence in {MOST_ROUNDS} rounds")


def two_way(df: DataFrame, unit: str, time: str, y: str, xs: list[str], weight: str | Column | None = None, tolerance: float = 1e-10) -> DataFrame:
    """term, beta, n: the coefficient of each of xs with effects of unit and time, by weighted least squares.

    The panel may lack rows; those with a null in y, xs, unit, time or weight, or a weight that is not above 0, are left
    out. A regressor without any variation beside the effects, or that others add up to, gets a null; of such a set the
    first ones keep theirs. No rows: null coefficients and n = 0. Repeated rows of a unit and time count each.
    """
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    names = ["_y", *[f"_x{i}" for i in range(len(xs))]]
    rows = df.select(F.col(unit).alias("_unit"), F.col(time).alias("_time"), w.alias("_w"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip([y, *xs], names, strict=True)])
    # the same means meet the rows in every round
    rows = materialize(rows.dropna().where("_w > 0"))
    left = swept(rows, "_unit", "_time", names, tolerance)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    product = lambda d: d.agg(F.count("*").alias("n"), *[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    # a row of (k + 1)^2 / 2 sums
    sums, before = product(left), product(rows)
    full = np.zeros((len(names), len(names)))
    for i, j in pairs:
        full[i, j] = full[j, i] = sums[f"c{i}_{j}"] or 0.0
    kept: list[int] = []
    for i in range(1, len(names)):
        own = full[np.ix_(kept, kept)]
        rest = full[i, i] - (full[i, kept] @ np.linalg.solve(own, full[kept, i]) if kept else 0.0)
        if rest > 1e-9 * max(before[f"c{i}_{i}"] or 0.0, 1e-300):
            kept.append(i)
    beta = np.linalg.solve(full[np.ix_(kept, kept)], full[kept, 0]) if kept else np.empty(0)
    found = dict(zip(kept, beta.tolist(), strict=True))
    out = [(x, found.get(i), sums["n"]) for i, x in enumerate(xs, 1)]
    return df.sparkSession.createDataFrame(out, "term string, beta double, n long")
