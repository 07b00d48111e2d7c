"""What a portfolio's limits leave within reach: the range of an exposure, and the most net weight, each with a proof by duality."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused

if TYPE_CHECKING:
    from tidemark.operators.portfolio import Limits

NOISE = 1e-9


def exposure_range(rows: DataFrame, net: float, cap: float, gross: float, by: tuple[str, ...] = ("t",), exposure: str = "beta") -> DataFrame:
    """By date n, low and high, the exact range of an exposure among the books of this net weight under caps and gross, and low_bound and high_bound, which prove it; all null where no book has that net.

    A book of the largest exposure buys the largest and sells the smallest until gross or the caps are used up. The bound is that of
    duality, net * lambda + gross * mu + cap * sum of max(0, |exposure - lambda| - mu), which no book can pass whatever lambda
    and mu >= 0 are: where it equals the value, the value is the largest. Nulls of the exposure count as no asset. Both ends are told
    in one pass over windows by date and end.
    """
    if cap <= 0 or gross < 0:
        raise Refused("caps are positive and gross is not negative")
    each, e = Window.partitionBy(*by, "_end"), F.col("_e")
    ends = rows.where(F.col(exposure).isNotNull()).select(*by, "asset", F.col(exposure).cast("double").alias("_x"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("_end"))
    told = ends.withColumn("_e", F.col("_x") * F.col("_end")).withColumn("_n", F.count("*").over(each))
    room = F.least(F.lit(float(gross)), F.col("_n") * F.lit(float(cap)))
    fill = lambda budget, order: F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), budget - cap * (F.row_number().over(each.orderBy(*order)) - 1)))
    told = told.withColumn("_long", fill((room + net) / 2, (F.desc("_e"), F.desc("asset")))).withColumn("_short", fill((room - net) / 2, (F.asc("_e"), F.asc("asset"))))
    # The last that is bought and the last that is sold price net and gross; gross is free where the caps alone bind.
    top = F.coalesce(F.min(F.when(F.col("_long") > NOISE, e)).over(each), F.max(e).over(each))
    low = F.coalesce(F.max(F.when(F.col("_short") > NOISE, e)).over(each), F.min(e).over(each))
    told = told.withColumn("_lambda", (top + low) / 2).withColumn("_mu", F.when(F.col("_n") * cap <= gross, 0.0).otherwise(F.greatest(F.lit(0.0), (top - low) / 2)))
    over = F.greatest(F.lit(0.0), F.abs(e - F.col("_lambda")) - F.col("_mu"))
    each_end = told.groupBy(*by, "_end").agg(F.count("*").alias("n"), F.sum((F.col("_long") - F.col("_short")) * e).alias("_v"), (F.first("_lambda") * net + F.first("_mu") * gross + cap * F.sum(over)).alias("_b"))
    able = F.lit(abs(net)) <= F.least(F.lit(float(gross)), F.col("n") * F.lit(float(cap))) + NOISE
    end = lambda c, k: F.max(F.when((F.col("_end") == k) & able, k * F.col(c)))
    return each_end.groupBy(*by).agg(F.max("n").alias("n"), end("_v", -1).alias("low"), end("_v", 1).alias("high"), end("_b", -1).alias("low_bound"), end("_b", 1).alias("high_bound"))


def range_of(betas: np.ndarray, net: float, cap: float, gross: float) -> tuple[float, float] | None:
    """The same range for one book."""
    n = len(betas)
    room = min(gross, n * cap)
    if abs(net) > room + NOISE:
        return None

    def most(e: np.ndarray) -> float:
        order, k = np.sort(e)[::-1], np.arange(n)
        fill = lambda budget: np.clip(budget - cap * k, 0, cap)
        return float(fill((room + net) / 2) @ order - fill((room - net) / 2) @ order[::-1])

    return -most(-betas), most(betas)


def _linear(a: np.ndarray, b: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, basis: list[int], x: np.ndarray, steps: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """argmax c x under a x = b and low <= x <= high, from a feasible x whose columns outside the basis are at a bound, and the prices of the rows.

    The simplex method with bounds: the column of the best price enters, the first by number after a step of no length, which cannot cycle.
    """
    still = False
    for _ in range(steps):
        prices = np.linalg.solve(a[:, basis].T, c[basis])
        gain = c - prices @ a
        gain[basis] = 0
        useful = np.flatnonzero(((gain > NOISE) & (x < high - NOISE)) | ((gain < -NOISE) & (x > low + NOISE)))
        if not len(useful):
            return x, prices
        enter = int(useful[0] if still else useful[np.argmax(np.abs(gain[useful]))])
        way = np.sign(gain[enter])
        move = -way * np.linalg.solve(a[:, basis], a[:, enter])
        room = np.full(len(basis), np.inf)
        up, down, at = move > NOISE, move < -NOISE, x[basis]
        room[up], room[down] = (high[basis][up] - at[up]) / move[up], (low[basis][down] - at[down]) / move[down]
        room = np.maximum(room, 0)
        step = min(float(room.min()), float(high[enter] - low[enter]))
        if not np.isfinite(step):
            raise Refused("a programme without a limit")
        x[basis] = at + step * move
        x[enter] += way * step
        still = step <= NOISE
        if room.min() <= step:
            first = np.flatnonzero(room <= room.min() + 1e-12)
            leave = int(first[np.argmin(np.array(basis)[first])])
            gone = basis[leave]
            x[gone] = high[gone] if move[leave] > 0 else low[gone]
            basis[leave] = enter
    raise Refused("a programme that does not end")


def most_net(sectors: np.ndarray, betas: np.ndarray, limits: Limits) -> tuple[float, np.ndarray, float]:
    """The most net weight that a book can have under all limits but that of net, such a book, and the bound that proves it.

    The targets of sectors and of beta belong to limits.net and shrink with what is deployed, so a smaller book is no other one. A
    linear programme over what is bought, sold and deployed; no book at all meets every limit, so it starts from there.
    """
    if limits.net <= 0:
        raise Refused("there is no net weight to reduce")
    n, targets = len(betas), dict(limits.targets)
    rows, scaled, bands = [np.ones(n)], [1.0], [0.0]
    if limits.sector is not None:
        for s in sorted({*sectors.tolist(), *targets}):
            rows.append((sectors == s).astype(float)), scaled.append(targets.get(s, 0.0) / limits.net), bands.append(limits.sector)
    if limits.beta is not None:
        rows.append(betas.astype(float)), scaled.append(limits.beta_target / limits.net), bands.append(limits.beta)
    e, k = np.array(rows), len(rows)
    # Columns: bought, sold, deployed, what each row but the first misses, unused gross.
    a = np.zeros((k + 1, 2 * n + 1 + k))
    a[:k, :n], a[:k, n : 2 * n], a[:k, 2 * n] = e, -e, -np.array(scaled)
    a[1:k, 2 * n + 1 : 2 * n + k] = -np.eye(k - 1)
    a[k, : 2 * n], a[k, -1] = 1.0, 1.0
    b = np.concatenate([np.zeros(k), [limits.gross]])
    band = np.array(bands[1:])
    low = np.concatenate([np.zeros(2 * n + 1), -band, [0.0]])
    high = np.concatenate([np.full(2 * n, limits.cap), [limits.gross], band, [limits.gross]])
    c, x = np.zeros(a.shape[1]), np.zeros(a.shape[1])
    c[2 * n], x[-1] = 1.0, limits.gross
    x, prices = _linear(a, b, c, low, high, list(range(2 * n, 2 * n + 1 + k)), x)
    gain = c - prices @ a
    bound = float(prices @ b + np.where(gain > 0, gain * high, gain * low).sum())
    return float(x[2 * n]), x[:n] - x[n : 2 * n], bound


def deployable(rows: DataFrame, limits: Limits, by: str = "t") -> DataFrame:
    """By date n, net, the most net weight that a book under the limits can have, and bound, which proves it. rows (t, asset, sector, beta); a date is one group, of the size of its universe."""
    kind = rows.schema[by].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("asset")
        net, _, bound = most_net(g["sector"].to_numpy(), g["beta"].to_numpy(float), limits)
        return pd.DataFrame({by: g[by].iloc[:1], "n": [len(g)], "net": [net], "bound": [bound]})

    return rows.select(by, "asset", "sector", "beta").groupBy(by).applyInPandas(solve, f"{by} {kind}, n long, net double, bound double")
