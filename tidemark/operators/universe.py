"""Which securities were eligible on a date, why others were not, and how membership moved."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

SCREENS = ("exchange", "price", "market_cap", "adv", "borrow")


def is_listed_on(day: Column) -> Column:
    """Listed on the day; the first and the last day count, and a null date does not exclude."""
    return (F.col("first_listed_on").isNull() | (F.col("first_listed_on") <= day)) & (F.col("delisted_on").isNull() | (day <= F.col("delisted_on")))


def lookback_days(bars: int) -> int:
    """Calendar days that hold so many trading days."""
    return math.ceil(bars * 3 / 2) + 10


def average_dollar_volume(bars: DataFrame, day: dt.date, n: int = 20, scale: int = 6) -> DataFrame:
    """id, last close in the window, and adv: the median of the last n dollar volumes, null with fewer. Exact decimals; of an even number the mean of the middle two."""
    start = day - dt.timedelta(days=lookback_days(n) - 1)
    inside = bars.where(F.col("date").between(F.lit(start), F.lit(day)))
    recent = Window.partitionBy("id").orderBy(F.desc("date"))
    dollars = F.col("close").cast(f"decimal(20,{scale})") * F.col("volume").cast("decimal(12,0)")
    ranked = inside.select("id", "date", "close", dollars.alias("dollars"), F.row_number().over(recent).alias("rn")).where(F.col("rn") <= n)
    got = ranked.groupBy("id").agg(F.max_by("close", "date").alias("price"), F.count("*").alias("n"), F.sort_array(F.collect_list("dollars")).alias("v"))  # at most n values
    low, high = F.element_at("v", F.lit((n + 1) // 2)), F.element_at("v", F.lit(n // 2 + 1))
    return got.select("id", "price", F.when(F.col("n") == n, (low + high) / F.lit(2).cast("decimal(1,0)")).cast("double").alias("adv"))


def screen(candidates: DataFrame, exchanges: tuple[str, ...], min_price: float, min_adv: float, min_market_cap: float | None = None, require_borrow: bool = False) -> DataFrame:
    """candidates with failed_filters, all screens that fail, in order; a missing value fails. Screens on inputs that the table lacks are refused."""
    wants = {"market_cap": min_market_cap is not None, "borrow": require_borrow}
    if lacking := [c for c, used in wants.items() if used and c not in candidates.columns]:
        raise Refused(f"no source for {lacking}")
    ok = {"exchange": F.col("exchange").isin(*exchanges), "price": F.col("price") >= min_price, "adv": F.col("adv") >= min_adv}
    if wants["market_cap"]:
        ok["market_cap"] = F.col("market_cap") >= min_market_cap
    if wants["borrow"]:
        ok["borrow"] = F.col("borrow")
    failed = F.array(*[F.when(~F.coalesce(ok[s], F.lit(False)), F.lit(s)) for s in SCREENS if s in ok])
    return candidates.withColumn("failed_filters", F.filter(failed, lambda x: x.isNotNull()))


def waterfall(screened: DataFrame, screens: tuple[str, ...] = ("exchange", "price", "adv"), by: tuple[str, ...] = ()) -> DataFrame:
    """For each screen in order: considered, removed (it fails first), also_failed (it fails later), remaining. One aggregation for all screens."""
    first = F.when(F.size("failed_filters") > 0, F.element_at("failed_filters", 1))
    counts = [F.count("*").alias("n")]
    for s in screens:
        counts += [F.count_if(first == s).alias(f"r_{s}"), F.count_if(F.array_contains("failed_filters", s) & (first != s)).alias(f"a_{s}")]
    told = screened.groupBy(*by).agg(*counts)
    rows, before = [], F.lit(0).cast("long")
    for k, s in enumerate(screens):
        rows.append(F.struct(F.lit(k).alias("step"), F.lit(s).alias("screen"), (F.col("n") - before).alias("considered"), F.col(f"r_{s}").alias("removed"), F.col(f"a_{s}").alias("also_failed"), (F.col("n") - before - F.col(f"r_{s}")).alias("remaining")))
        before = before + F.col(f"r_{s}")
    return told.select(*by, F.inline(F.array(*rows)))


def turnover(members: DataFrame) -> DataFrame:
    """members (date, id), each once: for each date but the first, what entered and left since the date before, and the rate.

    Along a security's dates, numbered, a member has entered if it was none at the date before, and leaves if it is none at the next;
    so one window by security tells both, and the rest is a row a date.
    """
    dates = members.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("k"))  # one row a rebalance date
    along = Window.partitionBy("id").orderBy("k")
    numbered = members.join(F.broadcast(dates), "date").select("date", "k", F.lag("k").over(along).alias("_was"), F.lead("k").over(along).alias("_next"))
    each = numbered.groupBy("date", "k").agg(F.count("*").alias("n"), F.count_if(~F.col("_was").eqNullSafe(F.col("k") - 1)).alias("entered"), F.count_if(~F.col("_next").eqNullSafe(F.col("k") + 1)).alias("_leave"))
    order = Window.orderBy("k")  # one row a rebalance date
    told = each.select("date", "k", "entered", F.lag("_leave").over(order).alias("left"), "n", F.lag("n").over(order).alias("previous")).where("k > 1")
    return told.select("date", "entered", "left", "n", "previous", ((F.col("entered") + F.col("left")) / (F.col("previous") + F.col("n"))).alias("rate"))


def spans(members: DataFrame) -> DataFrame:
    """members (date, id): runs of consecutive rebalance dates; is_open if the run reaches the last date."""
    dates = members.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("k"))  # one row a rebalance date
    last = dates.agg(F.max("k").alias("last"))
    numbered = members.join(F.broadcast(dates), "date").select("id", "date", "k", (F.col("k") - F.row_number().over(Window.partitionBy("id").orderBy("k"))).alias("island"))
    runs = numbered.groupBy("id", "island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_dates"), F.max("k").alias("k"))
    return runs.join(F.broadcast(last)).select("id", "first_date", "last_date", "n_dates", (F.col("k") == F.col("last")).alias("is_open"))


def size_series(screened: DataFrame) -> DataFrame:
    """For each date the candidates, those that pass every screen, and their share."""
    told = screened.groupBy("date").agg(F.count("*").alias("candidates"), F.count_if(F.size("failed_filters") == 0).alias("members"))
    return told.select("date", "candidates", "members", (F.col("members") / F.col("candidates")).alias("inclusion"))


def only_midnight(bars: DataFrame, col: str = "valid_from") -> DataFrame:
    return refuse(bars, F.col(col) != F.date_trunc("day", F.col(col)), "a day bar must begin at midnight")


@dataclass(frozen=True)
class Criteria:
    """What makes a security eligible; None asks nothing."""

    exchanges: tuple[str, ...]
    min_price: float
    min_adv: float
    adv_days: int = 20
    min_market_cap: float | None = None
    require_borrow: bool = False

    def digest(self) -> str:
        """SHA-256 of the criteria as canonical JSON; the order in which exchanges are named does not count."""
        told = asdict(self) | {"exchanges": sorted(set(self.exchanges))}
        return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def build(listings: DataFrame, bars: DataFrame, days: list[dt.date], criteria: Criteria, known_at: dt.date | None = None) -> DataFrame:
    """rebalance_date, id, exchange, price, adv and failed_filters of every security listed on each of the days; members are those without failed filters.

    listings (id, exchange, first_listed_on, delisted_on) and bars (id, date, close, volume) are as they were known; a day after
    known_at, and one that is named twice, is refused. All days are built in one pass: a bar joins the windows that hold it, of
    which the caller's days are the broadcast side, and ranks within a security and day.
    """
    if not days or len(set(days)) < len(days):
        raise Refused("one day or more, each once")
    if known_at is not None and max(days) > known_at:
        raise Refused("a universe may not be built for a day after what is known")
    n, back = criteria.adv_days, lookback_days(criteria.adv_days) - 1
    dates = listings.sparkSession.createDataFrame([(d, d - dt.timedelta(days=back)) for d in days], "rebalance_date date, _from date")
    inside = bars.join(F.broadcast(dates), (F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("rebalance_date")))
    recent = Window.partitionBy("rebalance_date", "id").orderBy(F.desc("date"))
    dollars = F.col("close").cast("decimal(20,6)") * F.col("volume").cast("decimal(12,0)")
    ranked = inside.select("rebalance_date", "id", "date", "close", dollars.alias("dollars"), F.row_number().over(recent).alias("_k")).where(F.col("_k") <= n)
    got = ranked.groupBy("rebalance_date", "id").agg(F.max_by("close", "date").alias("price"), F.count("*").alias("_n"), F.sort_array(F.collect_list("dollars")).alias("_v"))  # at most n values
    middle = (F.element_at("_v", F.lit((n + 1) // 2)) + F.element_at("_v", F.lit(n // 2 + 1))) / F.lit(2).cast("decimal(1,0)")
    priced = got.select("rebalance_date", "id", "price", F.when(F.col("_n") == n, middle).cast("double").alias("adv"))
    listed = listings.crossJoin(F.broadcast(dates.select("rebalance_date"))).where(is_listed_on(F.col("rebalance_date")))
    told = screen(listed.join(priced, ["rebalance_date", "id"], "left"), criteria.exchanges, criteria.min_price, criteria.min_adv, criteria.min_market_cap, criteria.require_borrow)
    return told.select("rebalance_date", "id", "exchange", "price", "adv", "failed_filters")


def members_of(built: DataFrame) -> DataFrame:
    """(date, id) of the eligible, as turnover and spans take them."""
    return built.where(F.size("failed_filters") == 0).select(F.col("rebalance_date").alias("date"), "id")


def snapshots(built: DataFrame, criteria: Criteria, as_of: dt.datetime) -> DataFrame:
    """built as rows to append to a store: with the instant of what was known and the digest of the criteria."""
    return built.withColumns({"as_of": F.lit(as_of), "criteria": F.lit(criteria.digest())})


def latest_snapshots(store: DataFrame, criteria: str, cutoff: dt.datetime) -> DataFrame:
    """Of each rebalance date the rows of the last build under the criteria that was known at the cutoff. A row a build is what is broadcast."""
    seen = store.where((F.col("criteria") == criteria) & (F.col("as_of") <= F.lit(cutoff)))
    last = seen.groupBy("rebalance_date").agg(F.max("as_of").alias("as_of"))
    return seen.join(F.broadcast(last), ["rebalance_date", "as_of"], "left_semi")
