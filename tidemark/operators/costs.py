"""Trading costs, backtest accounting and portfolio statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import new_folder
from tidemark.operators.facts import Refused, refuse

#: The conservative defaults, which calibration may not undercut.
DEFAULTS = {"half_spread_bps": 5.0, "commission_bps": 1.0, "impact_coefficient": 1.0, "daily_volatility_bps": 200.0, "borrow_bps": 100.0}
YEAR_DAYS = 360
#: Assets and bytes of a strip of vectors, about; pairs of a batch.
BLOCK, STRIP, PAIRS = 2048, 2**23, 2**16


def parameters(**changes: float) -> dict[str, float]:
    """The defaults with changes, none of them below its default."""
    told = DEFAULTS | changes
    if set(told) != set(DEFAULTS) or any(not math.isfinite(v) or v < DEFAULTS[k] for k, v in told.items()):
        raise Refused(f"unknown, or below the conservative default: {changes}")
    return told


def bps_to_fraction(x: Column) -> Column:
    return x / 10_000.0


def impact_bps(notional: Column, adv: Column, volatility_bps: Column, coefficient: float) -> Column:
    """Square root of participation, in daily volatilities."""
    return F.lit(coefficient) * volatility_bps * F.sqrt(F.abs(notional) / adv)


def borrow_bps(rate_bps: float, days: Column) -> Column:
    return F.lit(rate_bps) * days / YEAR_DAYS


def quoted_spread_bps(bid: Column, ask: Column) -> Column:
    """Of the mid; a crossed book is missing here and refused by crossed_books()."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 10_000)


def crossed_books(quotes: DataFrame) -> DataFrame:
    return refuse(quotes, (F.col("ask") < F.col("bid")) | (F.col("bid") <= 0), "a crossed or empty book")


def trade_costs(orders: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """orders (notional, adv, volatility_bps?, is_short, days) with the cost in USD by part and in total; nothing traded costs nothing."""
    p = params or parameters()
    orders = refuse(orders, (F.col("notional") < 0) | (F.col("adv") <= 0) | (F.col("days") < 0), "negative notional, volume or days")
    vol = F.coalesce(F.col("volatility_bps"), F.lit(p["daily_volatility_bps"]))
    part = {"spread": F.lit(p["half_spread_bps"]), "commission": F.lit(p["commission_bps"]), "impact": impact_bps(F.col("notional"), F.col("adv"), vol, p["impact_coefficient"]), "borrow": F.when(F.col("is_short"), borrow_bps(p["borrow_bps"], F.col("days"))).otherwise(0.0)}
    usd = {f"{k}_usd": F.when(F.col("notional") == 0, 0.0).otherwise(bps_to_fraction(v) * F.col("notional")) for k, v in part.items()}
    told = orders.withColumns(usd)
    return told.withColumn("cost_usd", sum((F.col(c) for c in usd), F.lit(0.0)))


#: What becomes of a book that loses all it has or more: it is refused, or its periods are told by the same arithmetic, without an equity.
WIPED = ("refuse", "keep")


def grown_log(net: Column) -> Column:
    """ln(1 + net): no number for a loss of more than all, minus infinity for a loss of all, as in SQL, where Spark's own has nulls that sums leave out."""
    return F.when(net < -1, math.nan).when(net == -1, -math.inf).otherwise(F.log1p(net))


def _over(x: Column, y: Column) -> Column:
    """x / y in floating point, by zero too."""
    return F.when(y != 0, x / y).when(x == 0, math.nan).otherwise(F.signum(x) * math.inf)


def _wiped(wiped: str) -> bool:
    if wiped not in WIPED:
        raise Refused(f"a book that is wiped out is one of {WIPED}")
    return wiped == "refuse"


def drifted(weights: DataFrame, by: tuple[str, ...] = ("t",), wiped: str = "refuse") -> DataFrame:
    """weights (…, asset, w, r) with the weight after the returns: w (1 + r) / (1 + sum w r). A book that loses all is refused, or with wiped "keep" divided by what is left of it, whatever its sign."""
    told = weights.groupBy(*by).agg((1 + F.sum(F.col("w") * F.col("r"))).alias("_g"))
    if _wiped(wiped):
        told = refuse(told, F.col("_g") <= 0, "the portfolio is wiped out")
    return weights.join(told, list(by)).withColumn("drifted", _over(F.col("w") * (1 + F.col("r")), F.col("_g"))).drop("_g")


def backtest(targets: DataFrame, fee_bps: float = 6.0, borrow_rate_bps: float = 100.0, days: int = 1, by: tuple[str, ...] = ("strategy",), wiped: str = "refuse") -> DataFrame:
    """Net accounting of strategies whose targets do not depend on equity.

    targets (strategy, t, asset, w, r): the weight chosen before period t and the return in it. Each
    period pays for the change from the drifted weights, then borrow on what is short, then earns.
    A missing return of a held asset is refused. So is a strategy that is wiped out, unless wiped is "keep": then all periods are
    told, and equity is no number from there on. One window for an asset's drift, one aggregation for
    a period, one window for equity.
    """
    keys = list(by)
    targets = refuse(targets, (F.col("w") != 0) & F.col("r").isNull(), "a held asset without a return")
    grown = targets.withColumn("_wr", F.col("w") * F.coalesce("r", F.lit(0.0)))
    period = grown.groupBy(*keys, "t").agg(F.sum("_wr").alias("gross"), F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("short"))
    if _wiped(wiped):
        period = refuse(period, F.col("gross") <= -1, "the portfolio is wiped out")
    after = grown.join(period.select(*keys, "t", "gross"), [*keys, "t"]).select(*keys, "asset", "t", "w", _over(F.col("w") * (1 + F.coalesce("r", F.lit(0.0))), 1 + F.col("gross")).alias("_d"))
    last = F.lag("_d").over(Window.partitionBy(*keys, "asset").orderBy("t"))
    traded = after.withColumn("_p", F.coalesce(last, F.lit(0.0))).groupBy(*keys, "t").agg(F.sum(F.abs(F.col("w") - F.col("_p"))).alias("turnover"))
    told = period.join(traded, [*keys, "t"])
    cost = F.col("turnover") * fee_bps / 10_000
    borrow = F.col("short") * borrow_rate_bps / 10_000 * days / YEAR_DAYS
    net = (1 - cost) * (1 - borrow) * (1 + F.col("gross")) - 1
    told = told.select(*keys, "t", "turnover", cost.alias("cost"), borrow.alias("borrow"), net.alias("net"))
    equity = F.exp(F.sum(grown_log(F.col("net"))).over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return told.withColumn("equity", equity)


def drawdowns(equity: DataFrame, by: tuple[str, ...] = ("strategy",), value: str = "equity") -> DataFrame:
    """The largest fall from a running maximum, the start at 1 included."""
    peak = F.greatest(F.lit(1.0), F.max(value).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return equity.withColumn("_dd", 1 - F.col(value) / peak).groupBy(*by).agg(F.max("_dd").alias("max_drawdown"))


def performance(net: DataFrame, periods: float = 252.0, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Total and annual return, volatility and Sharpe ratio of net returns."""
    total = F.exp(F.sum(grown_log(F.col("net"))))
    s = F.stddev_samp("net")
    return net.groupBy(*by).agg(F.count("*").alias("n"), (total - 1).alias("total"), (F.pow(total, F.lit(periods) / F.count("*")) - 1).alias("annual"), (s * math.sqrt(periods)).alias("volatility"), F.when(s > 0, F.avg("net") / s * math.sqrt(periods)).alias("sharpe"))


def walk_forward(n: int, train: int, test: int, purge: int = 0, anchored: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(window, train start, train end, test start, test end), ends exclusive."""
    if min(train, test) < 1 or purge < 0:
        raise Refused("train and test must be positive")
    out, at = [], train + purge
    while at + test <= n:
        out.append((len(out), 0 if anchored else at - purge - train, at - purge, at, at + test))
        at += test
    if not out:
        raise Refused("no window fits")
    return out


def in_windows(rows: DataFrame, windows: list[tuple[int, int, int, int, int]], t: str = "t") -> DataFrame:
    """rows by window and role, train or test; the list of windows is what is broadcast."""
    told = rows.sparkSession.createDataFrame([(w, role, a, b) for w, a0, a1, b0, b1 in windows for role, a, b in (("train", a0, a1), ("test", b0, b1))], "window int, role string, _a int, _b int")
    return rows.join(F.broadcast(told), (F.col(t) >= F.col("_a")) & (F.col(t) < F.col("_b"))).drop("_a", "_b")


def bootstrap(net: DataFrame, block: int, draws: int, seed: int, by: tuple[str, ...] = ("strategy",), level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by circular blocks, seeded; a strategy is a group."""
    kind = ", ".join(f"{c} {net.schema[c].dataType.simpleString()}" for c in by)

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("t")["net"].to_numpy(float)
        rng, n = np.random.Generator(np.random.PCG64(seed)), len(x)
        starts = rng.integers(0, n, size=(draws, -(-n // block)))
        means = x[(starts[:, :, None] + np.arange(block)) % n].reshape(draws, -1)[:, :n].mean(axis=1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[group[c].iloc[0] for c in by] + [float(x.mean()), float(low), float(high)]], columns=[*by, "mean", "low", "high"])

    return net.groupBy(*by).applyInPandas(draw, f"{kind}, mean double, low double, high double")


def vectors(panel: DataFrame) -> DataFrame:
    """panel (t, asset, r) with a row an asset: ts, its periods in order, and rs, the returns of these. A period that an asset has twice is refused.

    They are written once to a folder that the cluster shares, so that whoever compares them does not make the panel anew.
    """
    rows = panel.where("t IS NOT NULL AND asset IS NOT NULL").groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("t", F.col("r").cast("double").alias("r")))).alias("v"))
    rows = refuse(rows, F.size(F.array_distinct("v.t")) < F.size("v"), "a period that an asset has twice").select("asset", F.col("v.t").alias("ts"), F.col("v.r").alias("rs"))
    path = new_folder(panel.sparkSession, "vectors")
    rows.write.parquet(path)
    return panel.sparkSession.read.schema(rows.schema).parquet(path)


def returns_of(batch: pa.RecordBatch) -> np.ndarray:
    """The returns of a batch of vectors of one length, assets times periods."""
    return batch.column("rs").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1)


def pairs_of_strips(told: DataFrame, block: int | None, of: Callable[[np.ndarray, np.ndarray, pa.Array, pa.Array, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `of` tells of every two strips of vectors: their centred returns (none if the periods of the two differ), their assets, and whether they are one strip.

    Assets are dealt by hash into blocks of about `block`, or of BLOCK assets or STRIP bytes, whichever are fewer, each a partition. Its assets that have the same periods
    are a strip, in the order of their names, in whatever order they arrive. Vectors move once to their block; the product of the blocks reads them from there in a task for
    each pair, so neither what is written nor what a task holds grows with the number of pairs.
    """
    size = told.agg(F.count("*").alias("n"), F.max(F.size("ts")).alias("t")).first()
    parts = max(1, -(-size["n"] // (block or max(1, min(BLOCK, STRIP // 8 // (size["t"] or 1))))))
    kind = told.schema["asset"].dataType.simpleString()
    dealt = told.select(F.pmod(F.hash("asset"), F.lit(parts)).alias("p"), F.sha2(F.to_json(F.struct("ts")), 256).alias("same"), "asset", "rs").repartition(parts, "asset").sortWithinPartitions("asset")

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column("same").to_numpy(zero_copy_only=False)
            for same in dict.fromkeys(names):
                mine = batch.filter(pa.array(names == same))
                held.setdefault((mine.column("p")[0].as_py(), same), []).append(mine)
        for (p, same), found in held.items():
            x = np.concatenate([returns_of(b) for b in found])
            assets = pa.concat_arrays([b.column("asset") for b in found])
            assets = pa.ListArray.from_arrays(pa.array([0, len(assets)], pa.int32()), assets)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([same]), assets, pa.array([(x - x.mean(axis=1, keepdims=True)).tobytes()], pa.binary())], ["p", "same", "assets", "x"])

    rows = dealt.mapInArrow(strips, f"p int, same string, assets array<{kind}>, x binary")
    left, right = (rows.select(F.struct("p", "same").alias(f"{side}_at"), F.col("assets").alias(f"{side}_assets"), F.col("x").alias(f"{side}_x")) for side in "ab")
    both = left.hint("shuffle_replicate_nl").join(right, F.col("a_at") <= F.col("b_at"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a_at, b_at), (a, b) = ([batch.column(f"{side}_{what}")[k] for side in "ab"] for what in ("at", "assets"))
                x, y = (np.frombuffer(batch.column(f"{side}_x")[k].as_buffer()).reshape(len(assets.values), -1) for side, assets in (("a", a), ("b", b)))
                alike = a_at["same"].as_py() == b_at["same"].as_py()
                yield from of(x if alike else None, y if alike else None, a.values, b.values, a_at.as_py() == b_at.as_py())

    return both.mapInArrow(products, schema)


def covariance(panel: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b, cov): population covariances of all pairs of assets a <= b of a complete panel (t, asset, r); null if the two have different periods."""
    return covariances(vectors(panel), block)


def covariances(told: DataFrame, block: int | None = None) -> DataFrame:
    """The covariances of vectors. The products of two strips are matrix products of some PAIRS pairs each, which leave the task as they are made."""
    kind = told.schema["asset"].dataType.simpleString()

    def products(x: np.ndarray | None, y: np.ndarray | None, a: pa.Array, b: pa.Array, one: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // len(b))
        for at in range(0, len(a), step):
            n = min(step, len(a) - at)
            i, j = np.repeat(np.arange(at, at + n), len(b)), np.tile(np.arange(len(b)), n)
            found = np.full(n * len(b), np.nan) if x is None else (x[at : at + n] @ y.T).ravel() / x.shape[1]
            first, second = a.take(pa.array(i)), b.take(pa.array(j))
            if one:
                # By name, since the strip is made once for each side and its assets may arrive in another order.
                once = pc.less_equal(first, second)
                first, second, found = first.filter(once), second.filter(once), found[once.to_numpy(zero_copy_only=False)]
            # A pair with a hole has no number, which becomes a null.
            yield pa.RecordBatch.from_arrays([pc.min_element_wise(first, second), pc.max_element_wise(first, second), pa.array(found, from_pandas=True)], ["a", "b", "cov"])

    return pairs_of_strips(told, block, products, f"a {kind}, b {kind}, cov double")


def matrix(cov: DataFrame) -> tuple[list, np.ndarray]:
    """Assets and their covariance matrix on the driver, for a panel of portfolio size."""
    rows = cov.collect()
    names = sorted({r["a"] for r in rows})
    at, out = {a: i for i, a in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["cov"]
    return names, out


def ledoit_wolf(panel: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to a multiple of the identity, and the weight of that target."""
    t, n = panel.shape
    if t < 3 or not np.isfinite(panel).all():
        raise Refused("three complete observations or more")
    x = panel - panel.mean(axis=0)
    s = x.T @ x / t
    mu = np.trace(s) / n
    delta = ((s - mu * np.eye(n)) ** 2).sum() / n
    beta = min(delta, (((x**2).T @ (x**2) / t - s**2).sum()) / (n * t))
    weight = float(beta / delta) if delta > 0 else 1.0
    return (1 - weight) * s + weight * mu * np.eye(n), weight


def optimize(alpha: np.ndarray, cov: np.ndarray, current: np.ndarray, risk: float = 1.0, trade: float = 0.0, net: float = 1.0, cap: float = 0.1, gross: float = 1.0, steps: int = 4000) -> np.ndarray:
    """argmax of alpha w - risk w'Cw - trade |w - current| under sum w = net, |w_i| <= cap and sum |w| <= gross, by ADMM; refused if not feasible."""
    n = len(alpha)
    if abs(net) > min(gross, n * cap) + 1e-12:
        raise Refused("the net exposure cannot be reached under the caps")
    rho = max(1e-3, float(np.trace(cov)) / n * 2 * risk + 1e-6)
    kkt = np.block([[2 * risk * cov + 2 * rho * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    inverse = np.linalg.inv(kkt)
    z, y = np.clip(np.full(n, net / n), -cap, cap), current.astype(float).copy()
    u, v = np.zeros(n), np.zeros(n)
    for _ in range(steps):
        w = (inverse @ np.concatenate([alpha + rho * (z - u + y - v), [net]]))[:n]
        z_old = z
        z = bounded(w + u, cap, gross)
        d = w + v - current
        y = current + np.sign(d) * np.maximum(np.abs(d) - trade / rho, 0)
        u, v = u + w - z, v + w - y
        if max(np.abs(w - z).max(), np.abs(w - y).max(), np.abs(z - z_old).max()) < 1e-9:
            break
    if abs(z.sum() - net) > 1e-6 or np.abs(z).max() > cap + 1e-6 or np.abs(z).sum() > gross + 1e-6:
        raise Refused("no portfolio meets the constraints")
    return z


def bounded(x: np.ndarray, cap: float, gross: float) -> np.ndarray:
    """The nearest point with |x_i| <= cap and sum |x| <= gross."""
    out = np.clip(x, -cap, cap)
    if np.abs(out).sum() <= gross:
        return out
    low, high = 0.0, float(np.abs(x).max())
    for _ in range(80):
        mid = (low + high) / 2
        if np.minimum(np.maximum(np.abs(x) - mid, 0), cap).sum() > gross:
            low = mid
        else:
            high = mid
    return np.sign(x) * np.minimum(np.maximum(np.abs(x) - high, 0), cap)


def constraint_breaches(weights: DataFrame, cap: float, gross: float, sector_cap: float, tolerance: float = 1e-6, net: float | None = None, beta: float | None = None, beta_target: float = 0.0) -> DataFrame:
    """weights (t, asset, sector, w): the limits that are broken, one row each. net is what weights sum to; beta (which needs a column beta) is how far the book's may be from its target."""
    single = weights.where(F.abs("w") > cap + tolerance).select("t", F.lit("position").alias("limit"), F.col("asset").cast("string").alias("what"), F.abs("w").alias("value"))
    sector = weights.groupBy("t", "sector").agg(F.sum(F.abs("w")).alias("value")).where(F.col("value") > sector_cap + tolerance).select("t", F.lit("sector").alias("limit"), F.col("sector").cast("string").alias("what"), "value")
    # The limits of whole books come from one aggregation.
    told = {"gross": (F.sum(F.abs("w")), lambda v: v > gross + tolerance)}
    if net is not None:
        told["net"] = (F.sum("w"), lambda v: F.abs(v - net) > tolerance)
    if beta is not None:
        told["beta"] = (F.sum(F.col("w") * F.col("beta")), lambda v: F.abs(v - beta_target) > beta + tolerance)
    books = weights.groupBy("t").agg(*[x.alias(f"_{c}") for c, (x, _) in told.items()])
    rows = F.array(*[F.when(bad(F.col(f"_{c}")), F.struct(F.lit(c).alias("limit"), F.lit("").alias("what"), F.col(f"_{c}").alias("value"))) for c, (_, bad) in told.items()])
    whole = books.select("t", F.inline(F.filter(rows, lambda v: v.isNotNull())))
    return single.unionByName(whole).unionByName(sector)


def buy_and_hold(returns: DataFrame, weights: DataFrame, fee_bps: float = 6.0, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """returns (strategy, t, asset, r) and entry weights (strategy, asset, w): net equity of a book that is bought once and drifts.

    A position grows by itself, so equity is the sum of positions: one window for growth, one aggregation.
    """
    keys = list(by)
    returns = refuse(returns, F.col("r").isNull(), "a held asset without a return")
    grown = F.exp(F.sum(F.log1p("r")).over(Window.partitionBy(*keys, "asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    cost = weights.groupBy(*keys).agg((1 - F.sum(F.abs("w")) * fee_bps / 10_000).alias("_after"), (1 - F.sum("w")).alias("_cash"))
    held = returns.withColumn("_g", grown).join(weights, [*keys, "asset"])
    return held.groupBy(*keys, "t").agg(F.sum(F.col("w") * F.col("_g")).alias("_v")).join(cost, keys).select(*keys, "t", (F.col("_after") * (F.col("_v") + F.col("_cash"))).alias("equity"))


def relaxed(alpha: np.ndarray, cov: np.ndarray, current: np.ndarray, ladder: list[dict], **limits: float) -> tuple[np.ndarray, int]:
    """The optimum under the first rung of limits that is feasible, and the rung: 0 is no relaxation."""
    for rung, change in enumerate([{}, *ladder]):
        try:
            return optimize(alpha, cov, current, **(limits | change)), rung
        except Refused:
            continue
    raise Refused("infeasible on every rung")


def schedule_cost(children: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """Cost by parent of child orders (parent, notional, adv, ...)."""
    return trade_costs(children, params).groupBy("parent").agg(F.count("*").alias("children"), F.sum("cost_usd").alias("cost_usd"))


def seed_sweep(spark, seeds: int, periods: int, assets: int, alpha: float, sigma: float) -> DataFrame:
    """Synthetic markets r = alpha + sigma e, one seed a group: the realised Sharpe ratio of the equal-weight book of each."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seed = int(group["seed"].iloc[0])
        r = np.random.Generator(np.random.PCG64(seed)).normal(alpha, sigma, size=(periods, assets)).mean(axis=1)
        return pd.DataFrame([(seed, float(r.mean() / r.std(ddof=1)))], columns=["seed", "sharpe"])

    return spark.range(seeds).withColumnRenamed("id", "seed").groupBy("seed").applyInPandas(run, "seed long, sharpe double")
