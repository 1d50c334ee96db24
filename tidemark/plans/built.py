"""Registered queries of the catalogue as a whole, built in stages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import building as B
from tidemark.operators import overlap as O
from tidemark.operators import twins as W
from tidemark.sources import files
from tidemark.sources import tables as X

from .paired import QUALIFIERS, SAME_TITLE, STOP, TOK
from .warehouse import query

AS_OF, LEAST = "2001-12-01", 6

# kind, condition on the supplier's balance, id, title, unit, freq, priority, value (v: month's sales, m: its month), which months
KINDS = [
    ("s", "true", "concat('s/', k)", "plain", "case when bal > 8000 then 'pct' else 'usd' end", "monthly", 0, "v", "true"),
    ("m", "true", "concat('m/', k)", "concat(case when bal < 0 then '012_' else '012. ' end, plain, case when bal between 500 and 1500 then ' rural' else '' end)", "'BRL, US$'", "monthly", 1, "v * 1000 + m", "true"),
    ("x", "true", "concat('x/', k)", "concat(plain, ' (% of total)')", "'odd'", "monthly", 2, "(v * 1000 + m) * 1.001", "true"),
    ("q", "true", "concat('q/', k)", "concat(plain, ' short')", "'kg'", "monthly", 2, "v", "date >= date '2001-08-01'"),
    ("y", "bal > 6000", "concat('wb/S', k, '.BRA')", "concat(plain, ' yearly')", "'kg'", "annual", 2, "v * 7.3", "m = 1"),
    ("z", "bal > 7000", "concat('wb/S', k, '_M.BRA')", "concat(name, ' imports,Price,millions,seas. adj.,')", "null", "monthly", 2, "v * 7.3 + m * m * 100", "true"),
    ("i", "bal between 3000 and 5000", "concat('ilostat/SUP_K', k, '_SEX_NB.M')", "concat(plain, ' by sex')", "null", "monthly", 2, "v * 3.7", "true"),
    ("j", "bal between 3000 and 4000", "concat('ilostat/SUP_K', k, '_NB.M')", "concat(plain, ' staff')", "null", "monthly", 2, "v * 3.7 + m * 5", "true"),
]
BASE = "li AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate)::DATE AS date, round(sum(l_extendedprice), 2) AS v, month(min(l_shipdate)) AS m FROM lineitem GROUP BY 1, 2), su AS (SELECT s_suppkey AS k, s_acctbal AS bal, n_name AS topic, lower(n_name) AS name, lower(n_name) || ' sales' AS plain FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
OBS_SQL = f"""{BASE}, ob AS ({' UNION ALL '.join(f"SELECT {i} AS series_id, topic, date, round({value}::DOUBLE, 2) AS value, {priority} AS priority FROM li JOIN su USING (k) WHERE ({on}) AND ({months})" for _, on, i, _, _, _, priority, value, months in KINDS)}),
ra AS ({' UNION ALL '.join(f"SELECT {i} AS series_id, {title} AS title, {unit} AS unit, '{freq}' AS freq, topic, {priority} AS priority, plain, name, '{kind}' AS kind FROM su WHERE {on}" for kind, on, i, title, unit, freq, priority, _, _ in KINDS)}),
st AS (SELECT series_id, count(*) AS n_obs, min(date) AS first, max(date) AS last FROM ob GROUP BY 1), c0 AS (SELECT * FROM ra JOIN st USING (series_id))"""
STAGES_SQL = f"""{OBS_SQL}, c1 AS (SELECT *, CASE WHEN priority > 0 THEN CASE WHEN regexp_matches(title, '^\\d{{2,3}}_') THEN 'questionnaire item or by-product' WHEN n_obs < {LEAST} THEN 'fewer than {LEAST} observations' END END AS r1 FROM c0),
c2 AS (SELECT * REPLACE (regexp_replace(CASE kind WHEN 'z' THEN name || ' imports (seas. adj.)' ELSE title END, '^\\d{{2,3}}\\.\\s?', '') AS title, CASE kind WHEN 'm' THEN 'US$' WHEN 'x' THEN '% of total' WHEN 'z' THEN 'Price, millions' ELSE unit END AS unit) FROM c1 WHERE r1 IS NULL),
c3 AS (SELECT *, CASE WHEN series_id IN (SELECT replace(series_id, '_M.BRA', '.BRA') FROM c2 WHERE series_id LIKE 'wb/%\\_M.BRA' ESCAPE '\\') THEN 'annual copy of a monthly series' END AS r3 FROM c2),
c4 AS (SELECT *, n > 1 AS protected, CASE WHEN n > 1 AND series_id <> head THEN 'merged into ' || head END AS r4 FROM (SELECT *, count(*) OVER f AS n, first_value(series_id) OVER (PARTITION BY fam ORDER BY kind = 'i', n_obs DESC, series_id) AS head FROM (SELECT *, CASE WHEN kind IN ('i', 'j') THEN replace(series_id, '_SEX', '') ELSE series_id END AS fam FROM c3 WHERE r3 IS NULL) WINDOW f AS (PARTITION BY fam))),
c5 AS (SELECT *, round_even((ln(1 + n_obs) + ln(1 + date_diff('day', first, last) / 365.25)) * CASE WHEN date_diff('day', last, DATE '{AS_OF}') <= 60 THEN 1.0 ELSE 0.5 END, 3) AS rank FROM c4 WHERE r4 IS NULL),
bc AS (SELECT ob.series_id, ob.topic, ob.date, ob.value, ob.priority, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS name, CASE WHEN lag(date) OVER w = (date - INTERVAL 1 MONTH)::DATE THEN value - lag(value) OVER w END AS change FROM ob JOIN c5 USING (series_id) WINDOW w AS (PARTITION BY ob.series_id ORDER BY date)),
ba AS (SELECT a.series_id AS keep, b.series_id AS dup, CASE WHEN a.priority = 0 THEN 'monthly mean' ELSE 'monthly vs flagship' END AS basis, a.value AS x, b.value AS y, a.change AS dx, b.change AS dy FROM bc a JOIN bc b ON a.topic = b.topic AND a.date = b.date AND ((a.priority = 0 AND b.priority > 0) OR (a.priority = 1 AND b.priority > 1))
  UNION ALL SELECT a.series_id, b.series_id, '{SAME_TITLE}', a.value, b.value, a.change, b.change FROM bc a JOIN bc b ON a.name = b.name AND a.date = b.date AND a.series_id <> b.series_id AND a.priority > 0 AND b.priority > 0),
bs AS (SELECT dup, keep, basis, count(*) AS n, round(corr(x, y), 9) AS corr, median(y / x) AS ratio, round(corr(dx, dy), 9) AS changes FROM ba GROUP BY 1, 2, 3 HAVING count(*) > 4),
bp AS (SELECT * FROM bs WHERE n >= CASE basis WHEN '{SAME_TITLE}' THEN 5 ELSE 24 END AND corr >= CASE basis WHEN '{SAME_TITLE}' THEN 0.8 ELSE 0.99 END AND changes >= CASE basis WHEN '{SAME_TITLE}' THEN 0.8 ELSE 0.9 END AND abs(ratio / CASE WHEN basis = 'monthly mean' AND ratio > 0 THEN pow(10, round_even(log10(ratio), 0)) ELSE 1 END - 1) <= CASE basis WHEN '{SAME_TITLE}' THEN 0.35 ELSE 0.02 END),
bt AS (SELECT bp.*, {TOK.format("x.title")} AS td, {TOK.format("y.title")} AS tk, y.unit AS unit_k, x.priority AS pd, y.priority AS pk, x.rank AS rd, y.rank AS rk, x.protected FROM bp JOIN c5 x ON x.series_id = dup JOIN c5 y ON y.series_id = keep),
br AS (SELECT *, len(list_intersect(td, tk)) < CASE WHEN basis = '{SAME_TITLE}' THEN 0 WHEN pk = 0 THEN 1 ELSE 2 END OR list_has_any(list_concat(list_filter(td, lambda w: NOT list_contains(tk, w)), list_filter(tk, lambda w: NOT list_contains(td, w))), ['rural', 'urban', 'female', 'male']) OR ((starts_with(coalesce(unit_k, ''), 'pct') OR starts_with(coalesce(unit_k, ''), 'annual_pct')) AND abs(log10(abs(ratio))) > 0.03) OR NOT (pk < pd OR (pk = pd AND (rk > rd OR (rk = rd AND keep < dup)))) AS out FROM bt),
bq AS (SELECT *, out OR row_number() OVER (PARTITION BY dup ORDER BY out, corr DESC, keep, basis) > 1 AS out2 FROM br), bg AS (SELECT dup, keep, basis FROM bq WHERE NOT out2 AND dup NOT IN (SELECT keep FROM bq WHERE NOT out2) AND NOT protected)"""


def _built(spark, d):
    li = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date(F.trunc("l_shipdate", "month")).alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v")).withColumn("m", F.month("date"))
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("n_name").alias("topic"), F.lower("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit(" sales")).alias("plain"))
    pick = lambda rows, fields: rows.select(*[c for c in rows.columns if c in ("date", "topic")], F.explode(F.array_compact(F.array(*fields))).alias("r")).select("*", "r.*").drop("r")
    obs = pick(li.join(s, "k"), [F.when(F.expr(on) & F.expr(months), F.struct(F.expr(i).alias("series_id"), F.round(F.expr(value).cast("double"), 2).alias("value"), F.lit(p).alias("priority"))) for _, on, i, _, _, _, p, value, months in KINDS])
    obs = files.materialize(obs)
    raw = pick(s, [F.when(F.expr(on), F.struct(F.expr(i).alias("series_id"), F.expr(title).alias("title"), F.expr(unit).cast("string").alias("unit"), F.lit(freq).alias("freq"), F.lit(p).alias("priority"))) for _, on, i, title, unit, freq, p, _, _ in KINDS])
    stats = obs.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.min("date").alias("first"), F.max("date").alias("last"))
    cat = raw.join(stats, "series_id").withColumn("protected", F.lit(False))

    def twins(cat):
        rows = W.with_changes(obs.join(cat.select("series_id"), "series_id", "left_semi"), "series_id", "date", "value", F.add_months("date", -1).cast("date"))
        lists = O.listed(rows, ["series_id", "topic", "priority"], "date", ["value", "change"])
        rows = files.materialize(lists.join(cat.select("series_id", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("name")), "series_id"))
        of = lambda c: rows.where(c)
        pairs = W.twin_candidates(of("priority = 0"), of("priority > 0"), ["topic"], "date", 24, 0.99, 0.02, True, "monthly mean")
        pairs = pairs.unionByName(W.twin_candidates(of("priority = 1"), of("priority > 1"), ["topic"], "date", 24, 0.99, 0.02, False, "monthly vs flagship"))
        pairs = pairs.unionByName(W.twin_candidates(of("priority > 0"), of("priority > 0"), ["name"], "date", 5, 0.8, 0.35, False, SAME_TITLE))
        return B.without_twins(cat, W.judged(pairs, cat, QUALIFIERS, STOP, SAME_TITLE))

    monthly = F.col("series_id").like(r"wb/%\_M.BRA")
    stages = [
        ("curated", lambda c: B.curated(c, LEAST, r"^\d{2,3}_")), ("cleaned", B.cleaned), ("annual", lambda c: B.without_annual_copies(c, monthly, F.replace("series_id", F.lit("_M.BRA"), F.lit(".BRA")))),
        ("families", lambda c: B.merged_families(c, "ilostat/")), ("ranked", lambda c: B.ranked(c, AS_OF)), ("twins", twins), ("rule", B.with_rule),
    ]
    return B.run_stages(cat, stages, files.shared_folder(spark))


AGG = "CASE WHEN freq = 'annual' THEN 'mean' WHEN priority = 0 THEN 'mean' WHEN regexp_matches(lower(concat_ws(' ', title, unit)), '\\b(exports?|imports?)\\b') AND NOT regexp_matches(lower(concat_ws(' ', title, unit)), 'price|index|share|%|unit value|cover|months') THEN 'sum' ELSE 'mean' END"


@query(f"WITH {STAGES_SQL} SELECT series_id, title, unit, topic, freq, n_obs, rank, protected, CASE WHEN series_id IN (SELECT keep FROM bg) THEN 'canonical' ELSE 'single' END AS role, {AGG} AS agg FROM c5 WHERE series_id NOT IN (SELECT dup FROM bg)")
def build_catalog(spark, d):
    """The catalogue after curation, cleaning, annual copies, families, rank, copies and rollup rule."""
    return _built(spark, d)[0].select("series_id", "title", "unit", "topic", "freq", "n_obs", "rank", "protected", "role", "agg")


@query(f"""WITH {STAGES_SQL} SELECT series_id, title, 'curated' AS stage, r1 AS reason FROM c1 WHERE r1 IS NOT NULL UNION ALL SELECT series_id, title, 'annual', r3 FROM c3 WHERE r3 IS NOT NULL UNION ALL SELECT series_id, title, 'families', r4 FROM c4 WHERE r4 IS NOT NULL
UNION ALL SELECT series_id, title, 'twins', 'duplicate of ' || keep || ' (' || basis || ')' FROM bg JOIN c5 ON series_id = dup""")
def build_catalog_log(spark, d):
    """What the stages of the catalogue left out, and why."""
    return _built(spark, d)[1]
