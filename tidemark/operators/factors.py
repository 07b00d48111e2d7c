"""Price factors at a date from bars (id, date, close[, volume]), and the registry of declared factors."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import AsOf, FactSpec, Refused, literal, refuse

#: Bars back to the ends of the momentum and reversal windows, bars of the volatility and illiquidity windows.
MONTH, YEAR, VOLATILITY = 22, 253, 252
STALE_DAYS = 10
MOST_FACTORS = 30


def window(bars: DataFrame, day: dt.date, days: int) -> DataFrame:
    """Bars of the days before `day`; a bar on or after it is refused, since it cannot be known yet."""
    return refuse(bars, F.col("date") >= F.lit(day), "a bar on or after the compute date").where(F.col("date") >= F.lit(day - dt.timedelta(days=days)))


def _ranked(bars: DataFrame, *more: str) -> DataFrame:
    return bars.select("id", "date", "close", *more, F.row_number().over(Window.partitionBy("id").orderBy(F.desc("date"))).alias("back"))


def _close(k: int) -> Column:
    return F.max(F.when((F.col("back") == k) & (F.col("close") > 0), F.col("close")))


def _fresh(day: dt.date) -> Column:
    return F.datediff(F.lit(day), F.max("date")) <= STALE_DAYS


def momentum(bars: DataFrame, day: dt.date, near: int = MONTH, far: int = YEAR, days: int = 400, stale: bool = True) -> DataFrame:
    """ln(close `near` bars back / close `far` bars back); null if stale or short. One window sort, one aggregation."""
    ok = _fresh(day) if stale else F.lit(True)
    return _ranked(window(bars, day, days)).groupBy("id").agg(F.when(ok, F.log(_close(near) / _close(far))).alias("value"))


def reversal(bars: DataFrame, day: dt.date, far: int = MONTH, days: int = 60, stale: bool = True) -> DataFrame:
    """-ln(last close / close `far` bars back)."""
    ok = _fresh(day) if stale else F.lit(True)
    return _ranked(window(bars, day, days)).groupBy("id").agg(F.when(ok, -F.log(_close(1) / _close(far))).alias("value"))


def _returns(bars: DataFrame, n: int, *more: str) -> DataFrame:
    """The last n log returns of each id; a close that is not positive gives none."""
    order = Window.partitionBy("id").orderBy(F.desc("date"))
    price = F.when(F.col("close") > 0, F.log("close"))
    return _ranked(bars, *more).withColumn("r", price - F.lead(price).over(order)).where(F.col("back") <= n)


def low_volatility(bars: DataFrame, day: dt.date, n: int = VOLATILITY, days: int = 400, stale: bool = True) -> DataFrame:
    """-sample deviation of the last n log returns, a year's worth."""
    ok = (F.count("r") == n) & (_fresh(day) if stale else F.lit(True))
    return _returns(window(bars, day, days), n).groupBy("id").agg(F.when(ok, -F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("value"))


def illiquidity(bars: DataFrame, day: dt.date, n: int = VOLATILITY, days: int = 400, stale: bool = True) -> DataFrame:
    """Mean of |return| / dollar volume of the last n bars; null if a volume is not positive."""
    traded = _returns(window(bars, day, days), n, "volume").withColumn("dollars", F.col("close") * F.col("volume"))
    ok = (F.count("r") == n) & F.bool_and(F.col("dollars") > 0) & (_fresh(day) if stale else F.lit(True))
    return traded.groupBy("id").agg(F.when(ok, F.avg(F.abs("r") / F.when(F.col("dollars") > 0, F.col("dollars")))).alias("value"))


@dataclass(frozen=True)
class Factor:
    """A declared factor; one without a computation lacks its source and refuses."""

    name: str
    units: str
    compute: Callable[..., DataFrame] | None = None
    needs: str = ""
    lag: dt.timedelta = dt.timedelta(0)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name) or not self.units:
            raise Refused(f"a factor needs a snake_case name and units: {self.name!r}")


@dataclass
class Registry:
    factors: dict[str, Factor] = field(default_factory=dict)

    def add(self, factor: Factor) -> None:
        if factor.name in self.factors or len(self.factors) >= MOST_FACTORS:
            raise Refused(f"{factor.name} is registered already, or there are {MOST_FACTORS} factors")
        self.factors[factor.name] = factor

    def compute(self, name: str, bars: DataFrame, day: dt.date, requested: dt.datetime | None = None, **options) -> DataFrame:
        """(id, value) as of what was knowable at midnight of the day less the factor's lag; bars carry no later knowledge."""
        self.knowable(name, day, requested)
        return self.factors[name].compute(bars, day, **options)

    def knowable(self, name: str, day: dt.date, requested: dt.datetime | None = None) -> dt.datetime:
        """The instant that a factor of a day may be computed at: midnight of the day less the factor's lag, or the earlier one that is requested."""
        if name not in self.factors:
            raise Refused(f"no factor {name}")
        factor = self.factors[name]
        if isinstance(day, dt.datetime):
            raise Refused(f"a day, not an instant: {day!r}")
        if factor.compute is None:
            raise Refused(f"{name} needs {factor.needs}, for which there is no source")
        cutoff = dt.datetime.combine(day, dt.time(), dt.UTC) - factor.lag
        if requested is None:
            return cutoff
        if requested.tzinfo is None or requested.utcoffset() != dt.timedelta(0):
            raise Refused(f"an instant is aware and in UTC: {requested!r}")
        if requested > cutoff:
            raise Refused(f"{name} may use what was known at {cutoff.isoformat()}, not later")
        return requested

    def compute_asof(self, name: str, prices: DataFrame, spec: FactSpec, securities: DataFrame, day: dt.date, requested: dt.datetime | None = None, days: int = 400, now: dt.datetime | None = None, **options) -> DataFrame:
        """(id, value, units, as_of), one row for every security, computed from the versions of prices that were known at the factor's instant.

        prices are facts of key (id) with close (and volume, where the factor needs it); only the `days` before the day are read, and a
        version of a later bar that is known then is refused, as are two bars of an id on one day, a security that stands twice and one
        without an id. A security without bars, or with too few, has a null value. The range of valid_from and the instant reach the scan.
        """
        at = self.knowable(name, day, requested)
        if days < 1:
            raise Refused(f"a window holds a day or more: {days}")
        told = securities.select("id").groupBy("id").agg(F.count("*").alias("_n"))
        wanted = refuse(told, (F.col("_n") > 1) | F.col("id").isNull(), "a security that stands twice, or none").select("id")
        kind = dict(prices.dtypes)["valid_from"]
        since = literal(dt.datetime.combine(day - dt.timedelta(days=days), dt.time(), dt.UTC), kind)
        view = AsOf(prices.sparkSession, at, now).with_facts(prices.where(F.col("valid_from") >= since), spec)
        bars = view.table(spec.name, spec.payload).join(wanted, "id", "left_semi").withColumn("date", F.to_date("valid_from"))
        bars = bars.withColumn("_n", F.count("*").over(Window.partitionBy("id", "date")))
        bars = refuse(bars, F.col("_n") > 1, "two bars of one security on one day").drop("_n")
        found = self.factors[name].compute(bars, day, days=days, **options)
        return wanted.join(found, "id", "left").select("id", "value", F.lit(self.factors[name].units).alias("units"), literal(at, "timestamp_ntz").alias("as_of"))


def baseline() -> Registry:
    """The twelve declared factors; eight have no source here."""
    found = Registry()
    for name, units, compute in (("momentum_12_1", "log return", momentum), ("short_term_reversal", "log return", reversal), ("low_volatility", "annualised log return", low_volatility), ("amihud_illiquidity", "1/USD", illiquidity)):
        found.add(Factor(name, units, compute))
    for name in ("accruals", "asset_growth", "book_to_price", "earnings_yield", "gross_profitability", "roic"):
        found.add(Factor(name, "ratio", needs="fundamentals"))
    found.add(Factor("size", "log USD", needs="shares outstanding"))
    found.add(Factor("short_interest", "ratio", needs="a short-interest feed", lag=dt.timedelta(days=17)))
    return found
