"""Path labels of events and the weights of labels whose spans overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

UP, NEITHER, DOWN, AMBIGUOUS = 1, 0, -1, -128
#: Bars that Python works on at once, at least.
LEAST_ROWS = 50_000


def log_returns(bars: DataFrame) -> DataFrame:
    """bars (id, date, close) with i, the bar's number from 0, and r; the first return of an id is missing, as is that of a close that is not positive."""
    order = Window.partitionBy("id").orderBy("date")
    price = F.when(F.col("close") > 0, F.log("close"))
    return bars.select("*", (F.row_number().over(order) - 1).alias("i"), (price - F.lag(price).over(order)).alias("r"))


def trailing_volatility(returns: DataFrame, window: int) -> DataFrame:
    """returns with sigma: the sample deviation of the last `window` returns, missing unless all are there."""
    if window < 2:
        raise Refused(f"a window needs two returns: {window}")
    rows = Window.partitionBy("id").orderBy("i").rowsBetween(1 - window, 0)
    return returns.withColumn("sigma", F.when(F.count("r").over(rows) == window, F.stddev_samp("r").over(rows)))


def triple_barrier(returns: DataFrame, window: int, horizon: int, multiple: float = 1.0, same_bar: str = "flag", ranges: bool = False) -> DataFrame:
    """id, date, i, outcome, first touching bar i_end and width of every usable event.

    Barriers stand at multiple * sigma * sqrt(horizon) of cumulative log return in (i, i + horizon].
    The path of an event is an array over its next `horizon` bars, so nothing is joined.
    ranges: log highs and lows (hi, lo, relative to the close before) decide instead of closes;
    a bar that touches both barriers is ambiguous, or a loss if same_bar is "loss".
    """
    if horizon < 1 or multiple <= 0 or same_bar not in ("flag", "loss"):
        raise Refused("horizon and multiple must be positive, same_bar flag or loss")
    order = Window.partitionBy("id").orderBy("i")
    told = trailing_volatility(returns, window)
    ahead = order.rowsBetween(1, horizon)
    total = F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("_c", F.coalesce(total, F.lit(0.0)))
    top = F.col("_c") - F.col("r") + F.col("hi") if ranges else F.col("_c")
    low = F.col("_c") - F.col("r") + F.col("lo") if ranges else F.col("_c")
    told = told.withColumns({"_n": F.count("*").over(Window.partitionBy("id")), "_path": F.collect_list(F.struct(top.alias("top"), low.alias("low"))).over(ahead)})
    events = told.where((F.col("i") >= window) & (F.col("i") < F.col("_n") - horizon) & F.col("sigma").isNotNull())
    width = F.lit(multiple) * F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    events = events.withColumn("width", width)
    up = F.transform("_path", lambda p: p["top"] - F.col("_c") >= F.col("width"))
    down = F.transform("_path", lambda p: p["low"] - F.col("_c") <= -F.col("width"))
    events = events.withColumns({"_up": F.array_position(up, True), "_down": F.array_position(down, True)})
    u, d = F.when(F.col("_up") > 0, F.col("_up")), F.when(F.col("_down") > 0, F.col("_down"))
    first = F.coalesce(F.least(u, d), F.lit(horizon).cast("long"))
    outcome = F.when(u.isNull() & d.isNull(), NEITHER).when(u == d, AMBIGUOUS if same_bar == "flag" else DOWN).when(d.isNull() | (u < d), UP).otherwise(DOWN)
    return events.select("id", "date", "i", outcome.cast("int").alias("outcome"), (F.col("i") + first).cast("long").alias("i_end"), "width")


def class_labels(labels: DataFrame) -> DataFrame:
    """labels, refused if one is ambiguous."""
    return refuse(labels, F.col("outcome") == AMBIGUOUS, "an ambiguous label; drop it or choose a policy")


def uniqueness(spans: DataFrame, by: tuple[str, ...] = ("id",), first: str = "first", last: str = "last") -> DataFrame:
    """spans with weight: the mean over its bars of 1 / the spans that cover the bar.

    Starts and ends count +1 and -1, running sums give the concurrency of every stretch, and a
    span's mean is a difference of two prefix sums, so no span is unrolled. Both edges come from one
    row, so spans are computed once, and one partitioning by id serves the sums and the way back.
    """
    names, keys = spans.columns, list(by)
    spans = refuse(spans, F.col(first) > F.col(last), "a span that ends before it begins")
    edge = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).alias("d"))
    edges = spans.select(*names, F.explode(F.array(edge(F.col(first), 1), edge(F.col(last) + 1, -1))).alias("_e")).select(*names, F.col("_e.at").alias("_at"), F.col("_e.d").alias("_d"))
    order = Window.partitionBy(*keys).orderBy("_at")
    # Of edges at one place the last alone has a stretch after it, and all of them have one concurrency.
    told = edges.withColumns({"_c": F.sum("_d").over(order.rangeBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_at").over(order)})
    told = told.withColumn("_share", F.when(F.col("_c") > 0, (F.col("_next") - F.col("_at")) / F.col("_c")).otherwise(0.0))
    told = told.withColumn("_p", F.coalesce(F.sum("_share").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    side = lambda d: F.max(F.when(F.col("_d") == d, F.col("_p")))
    both = told.groupBy(*names).agg(side(1).alias("_from"), side(-1).alias("_to"), F.count_if(F.col("_d") == 1).cast("int").alias("_n"))
    weight = (F.col("_to") - F.col("_from")) / (F.col(last) - F.col(first) + 1)
    return both.select(*names, weight.alias("weight"), F.explode(F.sequence(F.lit(1), "_n")).alias("_k")).drop("_k")


def normalized(weighted: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """weighted with normalized: the weight over the mean weight of its id, so that the weights of an id sum to its labels."""
    return weighted.withColumn("normalized", F.col("weight") / F.avg("weight").over(Window.partitionBy(*by)))


def concurrency(spans: DataFrame, by: tuple[str, ...] = ("id",), first: str = "first", last: str = "last") -> DataFrame:
    """By id the most spans that cover one bar. Starts and ends count +1 and -1, so no span is unrolled."""
    edge = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    edges = spans.select(*by, F.inline(F.array(edge(F.col(first), 1), edge(F.col(last) + 1, -1)))).groupBy(*by, "at").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("c", running).groupBy(*by).agg(F.max("c").alias("concurrency"))


def uniqueness_report(weighted: DataFrame, by: tuple[str, ...] = ("id",), first: str = "first", last: str = "last") -> DataFrame:
    """By id the labels, their effective number and its ratio to theirs, the smallest and the largest weight, and the most labels that run at once."""
    told = weighted.groupBy(*by).agg(F.count("*").alias("n"), F.sum("weight").alias("effective"), (F.sum("weight") / F.count("*")).alias("ratio"), F.min("weight").alias("least"), F.max("weight").alias("most"))
    return told.join(concurrency(weighted, by, first, last), list(by))


def in_order(batches: Iterator[pa.RecordBatch], columns: str, back: int, ahead: int, work: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `work` tells of a task's bars, which come by id and place (_id, _none if there is no id, _i, _n from 1, and columns of numbers): it gets some LEAST_ROWS bars at once with the `back` before and the `ahead` after them, and is told which of them are its own.

    Held are these bars, whatever the length of an id.
    """
    held, rows, before = [], 0, 0
    names = ["_id", "_none", "_i", "_n", *columns]

    def told(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, before
        data = {c: np.concatenate([h[c] for h in held]) for c in names}
        n = data["_n"]
        if ((n[1:] != 1) & ((n[1:] != n[:-1] + 1) | (data["_id"][1:] != data["_id"][:-1]))).any():
            raise ValueError("bars of an id are not in order")
        end = len(n) if last else len(n) - ahead
        yield work(np.arange(before, end), n, data)
        keep = max(0, end - back)
        held, before = [{c: v[keep:] for c, v in data.items()}], end - keep
        rows = len(n) - keep

    for batch in batches:
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
        rows += batch.num_rows
        if rows >= LEAST_ROWS + back + ahead:
            yield from told(False)
    if rows:
        yield from told(True)


def fitted(at: np.ndarray, n: np.ndarray, data: dict[str, np.ndarray], window: int, limit: float) -> tuple[np.ndarray, ...]:
    """Which of the places `at` have a fit, and alpha, market, sector and sigma of these."""
    at = at[n[at] >= window]
    out = []
    for some in np.array_split(at, -(-len(at) // 4096)) if len(at) else ():
        with np.errstate(all="ignore"):
            r, m, s = (sliding_window_view(data[c], window)[some - window + 1] for c in "rms")
            top = np.abs(r).max(axis=1)
            mean = [v.mean(axis=1) for v in (r, m, s)]
            r, m, s = (v - a[:, None] for v, a in zip((r, m, s), mean, strict=True))
            of = lambda x, y: np.einsum("ij,ij->i", x, y) / window
            mm, ss, ms, mr, sr = of(m, m), of(s, s), of(m, s), of(m, r), of(s, r)
            half, turn = (mm + ss) / 2, np.sqrt(((mm - ss) / 2) ** 2 + ms * ms)
            squares = 1 + mm + ss + mean[1] ** 2 + mean[2] ** 2
            good = (half - turn > 1e-13 * (half + turn)) & (squares <= limit * limit * (half - turn))
            det = mm * ss - ms * ms
            market, sector = (mr * ss - sr * ms) / det, (sr * mm - mr * ms) / det
            rest = r - market[:, None] * m - sector[:, None] * s
            sigma = np.sqrt(of(rest, rest) * window / (window - 3))
            good &= sigma > 1e-12 * top
        out.append([v[good] for v in (some, mean[0] - market * mean[1] - sector * mean[2], market, sector, sigma)])
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (at, *[np.empty(0)] * 4)


def _bars(paths: DataFrame) -> DataFrame:
    """paths by id, in the order of i, numbered from 1 within each; a number that is none is no number at all (NaN) in Python."""
    order = Window.partitionBy("id").orderBy("i")
    return paths.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), F.col("i").cast("long").alias("_i"), F.row_number().over(order).alias("_n"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "rms"])


def residual_fit(paths: DataFrame, window: int, limit: float = 1e8) -> DataFrame:
    """id, i, alpha, market, sector and sigma of the regression of r on market and sector over the last `window` bars.

    paths (id, i, r, m, s). Covariances over the frame of each bar solve the regression, and a pass over the frame tells what it
    leaves; frames are views of the bars in order, so none is gathered. A window is missing if it has a number that is none, if its regressors are so
    close to collinear that `limit` squared times the least variance of a combination of them does not reach the mean squares of all
    columns (or that rounding hides that variance), or if nothing is left.
    """
    if window < 5:
        raise Refused("a window needs five bars")

    def work(at: np.ndarray, n: np.ndarray, data: dict[str, np.ndarray]) -> pa.RecordBatch:
        at, *found = fitted(at, n, data, window, limit)
        return pa.RecordBatch.from_arrays([pa.array(data["_id"][at], mask=data["_none"][at]), pa.array(data["_i"][at].astype(np.int32)), *map(pa.array, found)], ["id", "i", "alpha", "market", "sector", "sigma"])

    return _bars(paths).mapInArrow(lambda batches: in_order(batches, "rms", window - 1, 0, work), "id long, i int, alpha double, market double, sector double, sigma double")


def residual_labels(paths: DataFrame, window: int, horizon: int, multiple: float = 1.0, limit: float = 1e8) -> DataFrame:
    """residual_barrier of the fits of the same bars, told in one pass over them: nothing is joined. A return that is no number touches no barrier, nor does one after it."""
    if window < 5 or horizon < 1:
        raise Refused("a window needs five bars, a path one")

    def work(at: np.ndarray, n: np.ndarray, data: dict[str, np.ndarray]) -> pa.RecordBatch:
        at = at[at < len(n) - horizon]
        at, _, market, sector, sigma = fitted(at[n[at + horizon] == n[at] + horizon], n, data, window, limit)
        c, hit, bar = np.zeros(len(at)), np.zeros(len(at), np.int32), np.full(len(at), horizon)
        width = multiple * sigma * np.sqrt(float(horizon))
        for k in range(1, horizon + 1):
            c = c + data["r"][at + k] - market * data["m"][at + k] - sector * data["s"][at + k]
            first = (hit == 0) & (np.abs(c) >= width)
            hit[first], bar[first] = np.where(c[first] >= width[first], UP, DOWN), k
        return pa.RecordBatch.from_arrays([pa.array(data["_id"][at], mask=data["_none"][at]), pa.array(data["_i"][at].astype(np.int32)), pa.array(hit), pa.array(data["_i"][at] + bar)], ["id", "i", "outcome", "i_end"])

    return _bars(paths).mapInArrow(lambda batches: in_order(batches, "rms", window - 1, horizon, work), "id long, i int, outcome int, i_end long")


def residual_barrier(paths: DataFrame, fits: DataFrame, horizon: int, multiple: float = 1.0) -> DataFrame:
    """id, i, outcome and i_end of the barriers of residual returns r - market m - sector s (alpha stays in).

    paths (id, i, r, m, s) give the returns after an event, fits (id, i, market, sector, sigma) the
    betas known at it. The path is an array over the next bars, so the betas of the event apply to all of it.
    """
    order = Window.partitionBy("id").orderBy("i")
    ahead = F.collect_list(F.struct("r", "m", "s")).over(order.rowsBetween(1, horizon))
    told = paths.select("id", "i", ahead.alias("_path")).where(F.size("_path") == horizon).join(fits, ["id", "i"])
    width = F.lit(multiple) * F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"), F.lit(0).alias("hit"), F.lit(0).alias("at"))

    def step(acc, x):
        c, k = acc["c"] + x["r"] - F.col("market") * x["m"] - F.col("sector") * x["s"], acc["k"] + 1
        now = F.when(c >= width, UP).when(c <= -width, DOWN).otherwise(NEITHER)
        first = (acc["hit"] == 0) & (now != NEITHER)
        return F.struct(c.alias("c"), k.alias("k"), F.when(first, now).otherwise(acc["hit"]).alias("hit"), F.when(first, k).otherwise(acc["at"]).alias("at"))

    told = told.withColumn("_r", F.aggregate("_path", start, step))
    return told.select("id", "i", F.col("_r.hit").alias("outcome"), (F.col("i") + F.when(F.col("_r.at") > 0, F.col("_r.at")).otherwise(horizon)).cast("long").alias("i_end"))
