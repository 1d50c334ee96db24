"""Measures and tests given as data: rows that name metrics, transforms and samples are worked out together, in one plan.

However many specifications there are, each metric is transformed once and each measure is a grouped sum, so a plan has the
same joins for one test as for hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation, half_up


def _transforms(v: Column, w) -> dict[str, Column]:
    """Each transform of a value, given the window of its series by date; lags count rows."""
    year = w.rowsBetween(-11, 0)
    full = F.count(v).over(year) == 12
    return {
        "level": v,
        "log": F.when(v > 0, F.log(v)),
        "change12": v - F.lag(v, 12).over(w),
        "pct1": 100 * F.try_divide(v, F.lag(v).over(w)) - 100,
        "pct12": 100 * F.try_divide(v, F.lag(v, 12).over(w)) - 100,
        "sum12": F.when(full, F.sum(v).over(year)),
        "mean12": F.when(full, F.avg(v).over(year)),
    }


def transformed(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """entity, metric, transform, date, v of the (metric, transform) rows that are wanted; df: entity, metric, date, value.

    Rows without a transformed value are left out. An unknown transform gives no rows.
    """
    w = Window.partitionBy("entity", "metric").orderBy("date")
    each = _transforms(F.col("value"), w)
    rows = df.join(F.broadcast(wanted.select("metric").distinct()), "metric", "left_semi")
    rows = rows.withColumn("_e", F.array(*[F.struct(F.lit(name).alias("transform"), c.cast("double").alias("v")) for name, c in each.items()]))
    rows = rows.select("entity", "metric", "date", F.explode("_e").alias("_e")).select("entity", "metric", "date", "_e.*").where("v is not null")
    return rows.join(F.broadcast(wanted.select("metric", "transform").distinct()), ["metric", "transform"], "left_semi")


def with_ratios(df: DataFrame, ratios: DataFrame) -> DataFrame:
    """df and, for each row (metric, numerator, denominator), the ratio of two metrics of an entity at a date as a metric of that name."""
    side = lambda end, v: df.select("entity", "date", F.col("metric").alias(end), F.col("value").alias(v))
    both = side("numerator", "_x").join(F.broadcast(ratios), "numerator").join(side("denominator", "_y"), ["entity", "date", "denominator"])
    return df.select("entity", "metric", "date", "value").unionByName(both.select("entity", "metric", "date", F.try_divide("_x", "_y").alias("value")).where("value is not null"))


def measured(df: DataFrame, measures: DataFrame) -> DataFrame:
    """test, part, kind, entity, n, statistic, as_of for each measure and entity.

    measures: test, part, kind, x, x_transform, y, y_transform, lead (months by which y is ahead), start (first date of x) and
    cut. Kinds: corr (of x and y), trend (slope of x by years, in per cent), ratio (mean of y where x is below cut, over its
    mean elsewhere; three rows a side at least) and gap (x less y at their last common date). n counts the dates that have
    all; trend needs x alone. A measure whose metrics an entity lacks has no row.
    """
    wanted = measures.select(F.col("x").alias("metric"), F.col("x_transform").alias("transform")).unionByName(measures.where("y is not null").select(F.col("y").alias("metric"), F.col("y_transform").alias("transform")))
    values = transformed(df, wanted)
    side = lambda m, t, v: values.select("entity", "date", F.col("metric").alias(m), F.col("transform").alias(t), F.col("v").alias(v))
    of = F.broadcast(measures)
    xs = side("x", "x_transform", "vx").join(of, ["x", "x_transform"]).where("date >= start")
    ys = side("y", "y_transform", "vy").join(F.broadcast(measures.select("test", "part", "y", "y_transform", "lead")), ["y", "y_transform"]).select("test", "part", "entity", F.expr("add_months(date, -lead)").alias("date"), "vy")
    rows = xs.join(ys, ["test", "part", "entity", "date"], "left").where("y is null or vy is not null")
    low = F.col("vx") < F.col("cut")
    mean = lambda c: F.avg(F.when(c, F.col("vy")))
    years = F.year("date") + (F.month("date") - 1) / 12
    sums = rows.groupBy("test", "part", "kind", "entity").agg(
        F.count("*").alias("n"), F.max("date").alias("as_of"), correlation("vx", "vy").alias("corr"), F.regr_slope("vx", years).alias("slope"),
        F.when((F.count_if(low) >= 3) & (F.count_if(~low) >= 3), F.try_divide(mean(low), mean(~low))).alias("ratio"), F.max_by(F.col("vx") - F.col("vy"), "date").alias("gap"),
    )
    statistic = F.when(F.col("kind") == "corr", F.col("corr")).when(F.col("kind") == "trend", 100 * F.col("slope")).when(F.col("kind") == "ratio", F.col("ratio")).when(F.col("kind") == "gap", F.col("gap"))
    return sums.select("test", "part", "kind", "entity", "n", statistic.alias("statistic"), "as_of")


def holds(value: Column, op: Column, bound: Column) -> Column:
    """Whether a value stands to a bound as op says: >=, >, <=, <, or within (its size is at most the bound)."""
    return F.when(op == ">=", value >= bound).when(op == ">", value > bound).when(op == "<=", value <= bound).when(op == "<", value < bound).when(op == "within", F.abs(value) <= bound)


def verdicts(measures: DataFrame, tests: DataFrame) -> DataFrame:
    """test, entity, verdict, statistic, n, as_of, evidence from `measured` and the tests' thresholds.

    tests: test, least, op1, bound1, op2, bound2, mixed_op, mixed_bound; a test without op2 has one condition. Supported:
    all conditions hold. Mixed: the first statistic passes the mixed bound, or, without one, one condition of two holds.
    Too few dates, or a statistic that is not there, make it Insufficient data.
    """
    of = lambda k, *names: measures.where(F.col("part") == k).select("test", "entity", *[F.col(c).alias(f"{c}{k}") for c in names])
    rows = of(1, "kind", "n", "statistic", "as_of").join(of(2, "kind", "n", "statistic"), ["test", "entity"], "left").join(F.broadcast(tests), "test")
    first, second = holds(F.col("statistic1"), F.col("op1"), F.col("bound1")), holds(F.col("statistic2"), F.col("op2"), F.col("bound2"))
    two = F.col("op2").isNotNull()
    short = (F.col("n1") < F.col("least")) | F.col("statistic1").isNull() | (two & (F.col("statistic2").isNull() | (F.col("n2") < F.col("least"))))
    mixed = F.when(F.col("mixed_op").isNotNull(), holds(F.col("statistic1"), F.col("mixed_op"), F.col("mixed_bound"))).otherwise(two & (first | second))
    verdict = F.when(short, "Insufficient data").when(first & (~two | second), "Supported").when(mixed, "Mixed").otherwise("Not supported")
    said = lambda k: F.format_string("%s %.2f %s %.2f over %d dates", F.concat(f"kind{k}"), half_up(f"statistic{k}"), f"op{k}", f"bound{k}", f"n{k}")
    evidence = F.when(~short, F.concat(said(1), F.when(two, F.concat(F.lit("; "), said(2))).otherwise(F.lit(""))))
    return rows.select("test", "entity", verdict.alias("verdict"), F.col("statistic1").alias("statistic"), F.col("n1").alias("n"), F.col("as_of1").alias("as_of"), evidence.alias("evidence"))


def panel(df: DataFrame, specs: DataFrame, samples: DataFrame) -> DataFrame:
    """spec, sample, entity, n, mean, first, last of each specified outcome within each of its samples.

    specs: spec, metric, transform, sample; samples: sample, start, end (half open).
    """
    rows = transformed(df, specs).join(F.broadcast(specs), ["metric", "transform"]).join(F.broadcast(samples), "sample").where("date >= start and date < end")
    return rows.groupBy("spec", "sample", "entity").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min_by("v", "date").alias("first"), F.max_by("v", "date").alias("last"))
