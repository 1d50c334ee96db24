"""Column expressions that clean titles, units and codes, and rules that classify series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, what a unit may hold, ranges of codes by group, breakdown codes of table families.
MONTHS = ["JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ"]
UNITS = (
    r"(?i)(%|percent|us\$|lcu|\$|usd|number|people|persons|tonnes|tons|kilotonnes|kg|index|ratio|years|"
    r"days|hours|per |km|hectares|kwh|gwh|mw|liters|litres|metric|currency|rate|score|scale|share|"
    r"births|deaths|cases|units|thousands|millions|billions|ppp|constant|current|real|nominal)"
)
CODE_GROUPS = {
    "homicide": [("X85", "Y09")],
    "suicide": [("X60", "X84")],
    "traffic": [("V01", "V89")],
    "lung": [("C33", "C34")],
    "ncd": [("C00", "D48"), ("E00", "E90"), ("I00", "I99"), ("J00", "J99")],
}
DIMENSIONS = [
    "SEX", "AGE", "ECO", "OCU", "EDU", "GEO", "CUR", "STE", "IFL", "INS", "EST", "CBR", "MTS", "HHT",
    "DSB", "NOC", "LMS", "NAT", "MJH", "WKT", "IND", "HOW", "DUR", "CAT", "REL", "JOB", "TEN", "MIG", "HHS", "DIS",
    "EC2", "OC2", "JBT", "JBC", "JBF", "CAR", "COI", "DCL", "GAI", "GOV", "INJ", "SKN", "SKS", "SOC", "VOL", "WBL",
]


def none_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def dmy(text: Column) -> Column:
    """A date of unpadded d/M/yyyy, or the first of M/yyyy; else null."""
    p = F.split(text, "/")
    at = lambda i: F.get(p, i).try_cast("int")
    return F.when(F.size(p) == 3, F.make_date(at(2), at(1), at(0))).when(F.size(p) == 2, F.make_date(at(1), at(0), F.lit(1)))


def month_number(name: Column) -> Column:
    """1 to 12 for a Portuguese month name's first three letters; else null."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(F.trim(name), 1, 3)))
    return F.when(at > 0, at.cast("int"))


def days_in_month(date: Column) -> Column:
    return F.day(F.last_day(date))


def clean_unit(unit: Column) -> Column:
    """A short unit that is known, without the scale before it; else null."""
    u = F.regexp_replace(F.trim(unit), r"^[A-Z]{2,4}, ", "")
    return F.when(u.rlike(UNITS) & (F.length(u) <= 60), u)


def unit_of_title(title: Column) -> Column:
    """The last bracketed part of a title that is a unit."""
    found = F.transform(F.regexp_extract_all(title, F.lit(r"\(([^()]*)\)"), 1), clean_unit)
    return F.try_element_at(F.filter(found, lambda u: u.isNotNull()), F.lit(-1))


def packed_title(title: Column) -> tuple[Column, Column]:
    """Title and unit of `name,unit,scale,seas. adj.,`; a title of one part has no unit."""
    parts = F.filter(F.transform(F.split(title, ","), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    adjusted = lambda x: F.lower(x).contains("adj")
    note = F.get(F.filter(rest, adjusted), 0)
    name = F.when(F.size(parts) < 2, title).otherwise(F.concat(F.get(parts, 0), F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit(""))))
    unit = none_if_blank(F.array_join(F.filter(rest, lambda x: ~adjusted(x)), ", "))
    return name, F.when(F.size(parts) >= 2, unit)


def clean_title(title: Column, owner: Column | None = None) -> Column:
    """Without a number in front and mangled apostrophes; led by the owner's name, unless it starts with that."""
    t = F.replace(F.regexp_replace(title, r"^\d{2,3}\.\s?", ""), F.lit("�"), F.lit("'"))
    if owner is None:
        return t
    name = F.substring_index(owner, " (", 1)
    return F.when(F.startswith(t, name), t).otherwise(F.concat(name, F.lit(": "), t))


def breakdown_label(label: Column) -> Column:
    """A label without its last brackets and what follows a double dash; `wages - ISCO level 2` becomes `wages (detailed)`."""
    # fixed values: the patterns of these labels
    t = F.regexp_replace(label, r"\s*\([^()]*\)\s*$", "")
    t = F.regexp_replace(t, r"\s+--\s.*$", "")
    return F.trim(F.regexp_replace(t, r" - IS(IC|CO) level 2", " (detailed)"))


def family_key(series_id: Column) -> tuple[Column, Column]:
    """Family and breakdown codes of `source/A_B_DIM_DIM_UNIT.X`: the code without breakdowns, _Q or _M at its end kept."""
    code = F.regexp_extract(series_id, r"^[^/]*/(.*)\.[^.]*$", 1)
    end = F.regexp_extract(code, r"(_[QM])$", 1)
    t = F.split(F.regexp_replace(code, r"_[QM]$", ""), "_")
    mid = F.slice(t, F.lit(3), F.greatest(F.size(t) - 3, F.lit(0)))
    known = F.array(*[F.lit(x) for x in DIMENSIONS])
    own = F.filter(mid, lambda x: ~F.array_contains(known, x))
    family = F.concat(F.array_join(F.concat(F.slice(t, 1, 2), own, F.slice(t, -1, 1)), "_"), end)
    fits = F.size(t) >= 3
    return F.when(fits, family), F.when(fits, F.filter(mid, lambda x: F.array_contains(known, x))).otherwise(F.array().cast("array<string>"))


def code_group(code: Column) -> Column:
    """Names of the groups whose ranges hold the first three characters of a code."""
    c = F.substring(code, 1, 3)
    inside = lambda ranges: F.when(F.exists(F.array(*[c.between(lo, hi) for lo, hi in ranges]), lambda x: x), True)
    return F.filter(F.array(*[F.when(inside(v), F.lit(k)) for k, v in CODE_GROUPS.items()]), lambda x: x.isNotNull())


def verdict(statistic: Column, supported: float, mixed: float, enough: Column) -> Column:
    """Supported, Mixed or Not supported by two thresholds; too few rows or no statistic are Insufficient data."""
    rule = F.when(statistic >= supported, "Supported").when(statistic >= mixed, "Mixed").otherwise("Not supported")
    return F.when(statistic.isNull() | ~enough, "Insufficient data").otherwise(rule)


def input_refs(text: Column) -> Column:
    """Series of `metric[A,B], other`: an array of metric@A, metric@B, other."""
    tokens = F.transform(F.split(text, r",\s*(?![^\[]*\])"), lambda x: F.trim(x))
    metric = lambda t: F.regexp_extract(t, r"^([a-z0-9_]+)", 1)
    inside = lambda t: F.regexp_extract(t, r"^[a-z0-9_]+\[([A-Z,]+)\]", 1)
    ids = lambda t: F.when(inside(t) == "", F.array(metric(t))).otherwise(F.transform(F.split(inside(t), ","), lambda e: F.concat(metric(t), F.lit("@"), e)))
    return F.flatten(F.transform(F.filter(tokens, lambda t: metric(t) != ""), ids))


def members_of(text: Column) -> Column:
    """Names of a free-text list: notes in brackets go, ; and / part names."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
    return F.filter(F.transform(F.split(plain, "[;/]"), lambda x: F.trim(x)), lambda x: x != "")


# Names of flows and of stocks, codes and words that decide how a series rolls up to a year.
FLOWS = (
    r"^(exports_.*|imports_.*|.*_exports(_kg)?|.*_imports|beef_exports_to_china|trade_balance|"
    r"current_account_usd|bop_goods_.*|caged_net_hires|deaths_.*|homicide_deaths|suicide_deaths|"
    r"traffic_deaths|infant_deaths|vehicle_.*|pix_transactions_.*|revenue_.*|ebit_brl|net_income_.*|"
    r"capex_brl|dividends_paid_brl|dividend_per_share_brl|generation_gwh)$"
)
STOCKS = (
    r"(balance$|_gdp$|_debt_brl|net_debt|gross_public_debt|net_public_debt|cash_brl|fx_reserves|"
    r"_12m_brl$|share_close|total_return|ibovespa_level|^population$)"
)
DEBT, QUARTERLY_GDP = r"^wb/DP\.DOD\.", r"^wb/NYGDPMKTP(SA|NS)?(CD|CN|KD|KN)_Q\."
TRADE, PRICED, HELD = r"\b(exports?|imports?)\b", r"price|index|share|%|unit value|cover|months", r"reserves|stock|outstanding|debt"


def agg_rule(series_id: Column, title: Column, unit: Column, native: Column, yearly: Column) -> Column:
    """How a series rolls up to a year: sum, last or mean.

    Yearly ones by mean. A native id (without what follows @) by the names of flows and stocks; any other by its code, then
    by the words of title and unit: trade is summed unless it is a price or share, what is held takes its last value.
    """
    own, words = F.split_part(series_id, F.lit("@"), F.lit(1)), F.lower(F.concat_ws(" ", title, unit))
    home = F.when(own.rlike(FLOWS), "sum").when(own.rlike(STOCKS), "last").otherwise("mean")
    other = F.when(own.rlike(DEBT), "last").when(own.rlike(QUARTERLY_GDP), "sum").when(words.rlike(TRADE) & ~words.rlike(PRICED), "sum").when(words.rlike(HELD), "last").otherwise("mean")
    return F.when(yearly, "mean").when(native, home).otherwise(other)
