"""Cross-sectional transforms of long tables (date, id, x): one date is one cross-section. Null is missing and stays missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

#: A deviation below this share of the largest value is rounding, not dispersion.
TINY = 1e-12


def _value(df: DataFrame, col: str) -> DataFrame:
    """NaN becomes null, so aggregates skip it; infinities are refused."""
    df = df.withColumn(col, F.when(~F.isnan(col), F.col(col)))
    return refuse(df, F.abs(col) == float("inf"), "an infinite value")


def shelf(x: Column) -> Column:
    """A coarse place of a number that never falls as the number grows: 64 shelves for every doubling, zero in the middle."""
    size = F.floor(F.log2(F.abs(x)) * 64) + 80_000
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * size).cast("int")


def order_values(df: DataFrame, by: tuple[str, ...], ranks: dict[str, Callable[[Column], Column]], col: str = "x") -> DataFrame:
    """by, n and, for every name, the order statistic of the rank, from 1, that `ranks` gives for n values; nulls do not count.

    Exact, in two levels: counts by shelf, which are summed before they move, tell on which shelf a rank lies, and only the values
    of those shelves are sorted. So no section is sorted whole by one task, however many values it has.
    """
    keys = list(by)
    present = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_x"), shelf(F.col(col)).alias("_s"))
    counts = present.groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    section = Window.partitionBy(*keys)  # as many rows as a section has shelves, a few thousand
    upto = F.sum("_c").over(section.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    summed = counts.select(*keys, "_s", "_c", upto.alias("_to"), F.sum("_c").over(section).alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), rank(F.col("n")).cast("long").alias("r")) for k, rank in enumerate(ranks.values())])
    placed = summed.select("*", F.explode(wanted).alias("_w")).where((F.col("_w.r") <= F.col("_to")) & (F.col("_w.r") > F.col("_to") - F.col("_c")))
    targets = placed.select(*keys, "_s", "n", F.col("_w.k").alias("_k"), (F.col("_w.r") - (F.col("_to") - F.col("_c"))).alias("_r"))
    same = lambda a, b, cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    few = present.alias("p").join(targets.select(*keys, "_s").distinct().alias("q"), same("p", "q", [*keys, "_s"]), "left_semi")
    ranked = few.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_x")))
    met = targets.alias("t").join(ranked.alias("v"), [*same("t", "v", [*keys, "_s"]), F.col("t._r") == F.col("v._i")])
    return met.groupBy(*[F.col(f"t.{c}").alias(c) for c in keys]).agg(F.max("t.n").alias("n"), *[F.max(F.when(F.col("t._k") == k, F.col("v._x"))).alias(name) for k, name in enumerate(ranks)])


def quantiles(df: DataFrame, by: tuple[str, ...], at: list[float], col: str = "x") -> DataFrame:
    """by, n and q, an array of the quantiles, linear between neighbours."""
    ranks = {}
    for k, p in enumerate(at):
        ranks |= {f"_l{k}": lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1, f"_h{k}": lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1}
    told = order_values(df, by, ranks, col)
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return told.select(*by, "n", F.array(*[F.when(F.col(f"_l{k}") == F.col(f"_h{k}"), F.col(f"_l{k}")).otherwise(F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * part(p)) for k, p in enumerate(at)]).alias("q"))


def bounds(df: DataFrame, low: float, high: float, by: tuple[str, ...], col: str) -> DataFrame:
    """by, _lo and _hi, the order statistics that bound a winsorised section: the lower rounds down, the upper up."""
    if not 0 <= low < high <= 1:
        raise Refused(f"bounds must satisfy 0 <= {low} < {high} <= 1")
    return order_values(df, by, {"_lo": lambda n: F.floor((n - 1) * F.lit(low)) + 1, "_hi": lambda n: F.ceil((n - 1) * F.lit(high)) + 1}, col).drop("n")


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ("date",), col: str = "x") -> DataFrame:
    """Clip to order statistics of each section."""
    df = _value(df, col)
    clipped = F.when(F.col(col).isNotNull(), F.greatest("_lo", F.least("_hi", col)))
    return df.join(bounds(df, low, high, by, col), list(by), "left").withColumn(col, clipped).drop("_lo", "_hi")


def zscore(df: DataFrame, by: tuple[str, ...] = ("date",), col: str = "x") -> DataFrame:
    """(x - mean) / sample deviation; the whole section is missing with fewer than two values or without dispersion."""
    df = _value(df, col)
    told = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"), F.max(F.abs(col)).alias("_a"), F.count(col).alias("_n"))
    ok = (F.col("_n") >= 2) & (F.col("_s") > TINY * F.col("_a"))
    return df.join(told, list(by), "left").withColumn(col, F.when(ok, (F.col(col) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_a", "_n")


def neutralize(df: DataFrame, group: str = "grp", by: tuple[str, ...] = ("date",), col: str = "x") -> DataFrame:
    """x less the mean of its group; a group with fewer than two values is missing."""
    df = _value(df, col)
    keys = (*by, group)
    told = df.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.avg(col).alias("_m"), F.count(col).alias("_n"))
    joined = df.join(told, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left").select(*df.columns, "_m", "_n")
    return joined.withColumn(col, F.when(F.col("_n") >= 2, F.col(col) - F.col("_m"))).drop("_m", "_n")


def beta_neutralize(df: DataFrame, beta: str = "beta", by: tuple[str, ...] = ("date",), col: str = "x") -> DataFrame:
    """Residual of the regression on beta with an intercept; missing without three pairs or without dispersion of beta."""
    df = _value(_value(df, col), beta)
    pair = F.col(col).isNotNull() & F.col(beta).isNotNull()
    x, b = F.when(pair, F.col(col)), F.when(pair, F.col(beta))
    told = df.groupBy(*by).agg(F.avg(x).alias("_x"), F.avg(b).alias("_b"), F.covar_samp(x, b).alias("_c"), F.var_samp(b).alias("_v"), F.max(F.abs(b)).alias("_a"), F.count(b).alias("_n"))
    ok = (F.col("_n") >= 3) & (F.sqrt("_v") > TINY * F.col("_a"))
    residual = F.col(col) - F.col("_x") - F.col("_c") / F.col("_v") * (F.col(beta) - F.col("_b"))
    return df.join(told, list(by), "left").withColumn(col, F.when(ok & F.col(beta).isNotNull(), residual)).drop("_x", "_b", "_c", "_v", "_a", "_n")


def transform(df: DataFrame, group: str = "grp", beta: str | None = None, low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ("date",), col: str = "x") -> DataFrame:
    """Winsorise, standardise, neutralise by group and, if asked, by beta: what the four steps give one after the other.

    After clipping, every step is linear within a group, so one aggregation by section and group holds all that the
    steps need, and a window over its few rows combines the groups of a section. The rows are then read once more, beside that table.
    """
    df = _value(df, col) if beta is None else _value(_value(df, col), beta)
    edges = bounds(df, low, high, by, col)
    clipped = df.join(edges, list(by), "left").withColumn(col, F.when(F.col(col).isNotNull(), F.greatest("_lo", F.least("_hi", col)))).drop("_lo", "_hi")
    x, b = F.col(col), F.col(beta) if beta else F.lit(None).cast("double")
    pair = x.isNotNull() & b.isNotNull()
    px, pb = F.when(pair, x), F.when(pair, b)
    keys = (*by, group)
    sums = clipped.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v"), F.max(F.abs(x)).alias("a"),
        F.count(pb).alias("pn"), F.avg(px).alias("px"), F.avg(pb).alias("pb"), F.coalesce(F.covar_pop(px, pb), F.lit(0.0)).alias("pc"), F.coalesce(F.var_pop(pb), F.lit(0.0)).alias("pv"), F.max(F.abs(pb)).alias("pa"),
    )
    section = Window.partitionBy(*by)
    over = lambda c: F.sum(c).over(section)
    told = sums.withColumns({"all_n": over(F.col("n")), "all_m": over(F.col("n") * F.col("m"))}).withColumn("all_m", F.col("all_m") / F.when(F.col("all_n") > 0, F.col("all_n")))
    s = F.sqrt(over(F.col("n") * (F.col("v") + (F.col("m") - F.col("all_m")) * (F.col("m") - F.col("all_m")))) / F.when(F.col("all_n") >= 2, F.col("all_n") - 1))
    told = told.withColumns({"s": s, "all_a": F.max("a").over(section)})
    told = told.withColumn("s", F.when((F.col("all_n") >= 2) & (F.col("s") > TINY * F.col("all_a")), F.col("s")))
    # From here on a group of one value is missing.
    told = told.withColumn("ok", (F.col("n") >= 2) & F.col("s").isNotNull())
    w = F.when(F.col("ok"), F.col("pn")).otherwise(0)
    told = told.withColumns({"w": w, "g": F.coalesce((F.col("px") - F.col("m")) / F.col("s"), F.lit(0.0)), "h": F.coalesce("pb", F.lit(0.0))})
    told = told.withColumn("all_p", over(F.col("w")))
    told = told.withColumns({"all_g": over(F.col("w") * F.col("g")) / F.when(F.col("all_p") > 0, F.col("all_p")), "all_h": over(F.col("w") * F.col("h")) / F.when(F.col("all_p") > 0, F.col("all_p"))})
    dg, dh = F.col("g") - F.col("all_g"), F.col("h") - F.col("all_h")
    told = told.withColumns({"all_c": over(F.col("w") * (F.coalesce(F.col("pc") / F.col("s"), F.lit(0.0)) + dg * dh)), "all_v": over(F.col("w") * (F.col("pv") + dh * dh)), "all_b": F.max(F.when(F.col("ok"), F.col("pa"))).over(section)})
    fit = (F.col("all_p") >= 3) & (F.sqrt(F.col("all_v") / F.when(F.col("all_p") >= 2, F.col("all_p") - 1)) > TINY * F.col("all_b"))
    told = told.select(*[F.col(c).alias(f"_{c}") for c in keys], F.when(F.col("ok"), F.col("m")).alias("_m"), F.col("s").alias("_s"), F.col("all_g").alias("_all_g"), F.col("all_h").alias("_all_h"), F.when(fit, F.col("all_c") / F.col("all_v")).alias("_k"))
    joined = clipped.join(told, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left")
    out = (x - F.col("_m")) / F.col("_s")
    if beta:
        out = out - F.col("_all_g") - F.col("_k") * (b - F.col("_all_h"))
    return joined.withColumn(col, out).select(*df.columns)


def realized_premium(df: DataFrame, periods: int = 12, col: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean a year, its standard error and t statistic; a series without dispersion is refused."""
    told = df.groupBy(*by).agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.count(col).alias("n"))
    told = refuse(told, ~(F.col("s") > 0), "no dispersion")
    se = F.col("s") / F.sqrt("n")
    return told.select(*by, (F.col("m") * periods).alias("premium"), (se * periods).alias("standard_error"), (F.col("m") / se).alias("t"), "n")


def verdict(t: Column, premium: Column, low: Column, high: Column, threshold: float = 2.0) -> Column:
    """How a realised premium compares with the published range."""
    return F.when(F.abs(t) < threshold, "none").when(F.signum(premium) != F.signum(low), "opposite").when(~premium.between(low, high), "out of range").otherwise("reproduces")


#: Annual premia that the public literature leads one to expect, by factor: sign, low and high.
EXPECTED = """
momentum_12_1 + 0.03 0.15
short_term_reversal + 0.03 0.30
low_volatility + 0.01 0.12
book_to_price + 0.01 0.08
earnings_yield + 0.02 0.10
gross_profitability + 0.01 0.08
roic + 0.01 0.09
accruals - -0.12 -0.02
asset_growth - -0.13 -0.02
"""


def expectations(spark) -> DataFrame:
    """factor, sign (1 or -1), low and high: what is written down before a factor is measured."""
    rows = [(f, 1 if sign == "+" else -1, float(low), float(high)) for f, sign, low, high in (line.split() for line in EXPECTED.strip().splitlines())]
    return spark.createDataFrame(rows, "factor string, sign int, low double, high double")


def against_expectations(premia: DataFrame, expected: DataFrame, least_t: float = 2.0) -> DataFrame:
    """premia (factor, premium, t) with what was expected and the verdict; a factor without an expectation is 'not expected', one without a premium 'not measured'."""
    told = premia.join(F.broadcast(expected), "factor", "left")
    found = F.when(F.col("sign").isNull(), "not expected").when(F.col("premium").isNull() | F.col("t").isNull(), "not measured").when(F.abs("t") < least_t, "none").when(F.signum("premium") != F.col("sign"), "opposite").when(~F.col("premium").between(F.col("low"), F.col("high")), "out of range")
    return told.withColumn("verdict", F.coalesce(found, F.lit("reproduces")))
