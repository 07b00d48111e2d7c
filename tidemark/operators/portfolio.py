"""Portfolios under sector, beta and exposure limits, and what those limits leave within reach."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import reach
from tidemark.operators.costs import bounded
from tidemark.operators.facts import Refused
from tidemark.operators.reach import NOISE
from tidemark.operators.risk import Risk, shrunk_factors


@dataclass(frozen=True)
class Limits:
    """net: sum of weights; cap: of one weight; gross: sum of absolute weights; sector: how far the net of one sector may be from its target; beta: how far the beta of the book; tolerance: how far a solution may miss; targets: (sector, net), 0 for the others; beta_target: of the book."""

    net: float = 0.0
    cap: float = 0.1
    gross: float = 1.0
    sector: float | None = None
    beta: float | None = None
    tolerance: float = 1e-6
    targets: tuple[tuple[object, float], ...] = ()
    beta_target: float = 0.0

    def scaled(self, net: float) -> Limits:
        """The limits of a book of less net weight: targets shrink with it, bands and caps stay."""
        share = net / self.net
        return replace(self, net=net, targets=tuple((s, w * share) for s, w in self.targets), beta_target=self.beta_target * share)


def reachable(exposure: np.ndarray, cap: float, gross: float) -> float:
    """The largest exposure of a book under the caps: the largest absolute exposures are filled first, each up to its cap, until gross is used."""
    left, total = gross, 0.0
    for x in sorted(np.abs(exposure), reverse=True):
        used = min(cap, left)
        total, left = total + used * float(x), left - used
    return total


def diagnosis(sectors: np.ndarray, betas: np.ndarray, limits: Limits) -> list[str]:
    """Why no book can meet the limits, as far as arithmetic tells; an empty list is no proof that one can."""
    n, out = len(sectors), []
    if abs(limits.net) > n * limits.cap + limits.tolerance:
        out.append("net exceeds what all caps hold")
    if abs(limits.net) > limits.gross + limits.tolerance:
        out.append("net exceeds gross")
    if limits.sector is not None:
        targets, held = dict(limits.targets), 0.0
        for s in sorted({*sectors.tolist(), *targets}):
            able, target = limits.cap * int((sectors == s).sum()), np.sign(limits.net) * targets.get(s, 0.0)
            held += min(target + limits.sector, able)
            if abs(target) > able + limits.sector + limits.tolerance:
                out.append(f"the target of sector {s} exceeds what its caps hold")
        if abs(limits.net) > held + limits.tolerance:
            out.append("net exceeds what the sectors hold")
    if limits.beta is not None and n and (ends := reach.range_of(betas, limits.net, limits.cap, limits.gross)):
        if ends[0] > limits.beta_target + limits.beta + limits.tolerance or ends[1] < limits.beta_target - limits.beta - limits.tolerance:
            out.append(f"beta cannot be brought within its limit; books of this net reach {ends[0]:.4g} to {ends[1]:.4g}")
    return out


def optimum(alpha: np.ndarray, cov: np.ndarray | Risk, current: np.ndarray, sectors: np.ndarray, betas: np.ndarray, limits: Limits, risk: float = 1.0, trade: float = 0.0, steps: int = 8000) -> np.ndarray:
    """argmax of alpha w - risk w'Cw - trade |w - current| under the limits, by splitting: linear equations for w, then one projection for caps and gross, one for trades and one for the rows of net, sectors and beta. Refused with its reasons if there is none.

    A covariance given by factors is never made a matrix: the linear equations are solved by its factors and the rows of the limits.
    """
    if why := diagnosis(sectors, betas, limits):
        raise Refused("; ".join(why))
    n = len(alpha)
    rows, low, high = [np.ones(n)], [limits.net], [limits.net]
    if limits.sector is not None:
        targets = dict(limits.targets)
        for s in sorted({*sectors.tolist(), *targets}):
            rows.append((sectors == s).astype(float)), low.append(targets.get(s, 0.0) - limits.sector), high.append(targets.get(s, 0.0) + limits.sector)
    if limits.beta is not None:
        rows.append(betas.astype(float)), low.append(limits.beta_target - limits.beta), high.append(limits.beta_target + limits.beta)
    a, low, high = np.array(rows), np.array(low), np.array(high)
    if isinstance(cov, Risk):
        rho = max(1e-3, 2 * risk * cov.trace() / n)
        solve = cov.solver(2 * risk, 2 * rho, np.sqrt(rho) * a)
    else:
        rho = max(1e-3, 2 * risk * float(np.trace(cov)) / n)
        inverse = np.linalg.inv(2 * risk * cov + rho * (2 * np.eye(n) + a.T @ a))
        solve = lambda v: inverse @ v
    z, y, s = np.zeros(n), current.astype(float).copy(), np.clip(np.zeros(len(a)), low, high)
    u, v, q = np.zeros(n), np.zeros(n), np.zeros(len(a))
    for _ in range(steps):
        w = solve(alpha + rho * (z - u + y - v + a.T @ (s - q)))
        old = z
        z = bounded(w + u, limits.cap, limits.gross)
        d = w + v - current
        y = current + np.sign(d) * np.maximum(np.abs(d) - trade / rho, 0)
        s = np.clip(a @ w + q, low, high)
        u, v, q = u + w - z, v + w - y, q + a @ w - s
        if max(np.abs(w - z).max(), np.abs(w - y).max(), np.abs(a @ w - s).max(), np.abs(z - old).max()) < 1e-9:
            break
    missed = np.maximum(a @ z - high, low - a @ z).max()
    if missed > max(limits.tolerance, 1e-5):
        raise Refused(f"no portfolio meets the limits; the nearest misses one by {missed:.2g}")
    return z


def optimized(rows: DataFrame, limits: Limits, risk: float = 1.0, trade: float = 0.0, ladder: tuple[Limits, ...] = (), by: str = "t", history: str | None = None, floor: float | None = None) -> DataFrame:
    """t, asset, w and rung of the optimum of every date; rung 0 is the limits given, others are the first of the ladder that can be met, and a date that none can be met at has null weights.

    With `floor` there is one rung more: the last limits of the ladder with the most net weight that they leave within reach, if that is
    no less than floor, with the targets of sectors and beta in proportion. It is not tried for a book without net weight.
    rows (t, asset, alpha, beta, sector, current) and either a variance, for a covariance of one market factor, beta_i beta_j v + own
    variances, or in the column `history` an array of each asset's returns over one lookback, for their covariance shrunk as by Ledoit and Wolf,
    kept as factors. A date needs one row an asset and is one group, of the size of its universe (times the lookback).
    """
    kind, what = rows.schema[by].dataType.simpleString(), rows.schema["asset"].dataType.simpleString()
    steps = (limits, *ladder)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("asset")
        betas, sectors = g["beta"].to_numpy(float), g["sector"].to_numpy()
        if history:
            cov = shrunk_factors(np.array(g[history].tolist(), dtype=float).T)
        else:
            own = g["variance"].to_numpy(float)
            cov = Risk(own, betas[None, :] * np.sqrt(float(np.median(own))))
        tell = lambda now: optimum(g["alpha"].to_numpy(float), cov, g["current"].to_numpy(float), sectors, betas, now, risk, trade)
        w, at = None, None
        for rung, now in enumerate(steps):
            try:
                w, at = tell(now), rung
                break
            except Refused:
                continue
        if w is None and floor is not None and steps[-1].net > 0:
            net = min(reach.most_net(sectors, betas, steps[-1])[0], steps[-1].net)
            if net >= max(floor, NOISE):
                try:
                    w, at = tell(steps[-1].scaled(net)), len(steps)
                except Refused:
                    pass
        return pd.DataFrame({by: g[by], "asset": g["asset"], "w": w if w is not None else [None] * len(g), "rung": pd.array([at] * len(g), "Int32")})

    return rows.select(by, "asset", "alpha", history or "variance", "beta", "sector", "current").groupBy(by).applyInPandas(solve, f"{by} {kind}, asset {what}, w double, rung int")


def greedy_fill(rows: DataFrame, cap: float, gross: float, by: tuple[str, ...] = ("t",), exposure: str = "beta") -> DataFrame:
    """rows with fill, the weight each gets in the book of the largest exposure: by absolute exposure, largest first (ties by asset), up to the cap until gross is used; the sign is that of the exposure."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(exposure)), "asset")) - 1
    room = F.greatest(F.lit(0.0), F.least(F.lit(cap), F.lit(gross) - cap * rank))
    return rows.withColumn("fill", room * F.signum(exposure))


def reachable_exposure(rows: DataFrame, cap: float, gross: float, by: tuple[str, ...] = ("t",), exposure: str = "beta") -> DataFrame:
    """By date the largest exposure that a book under the caps can have, and the assets that it takes."""
    told = greedy_fill(rows, cap, gross, by, exposure)
    return told.groupBy(*by).agg(F.sum(F.col("fill") * F.col(exposure)).alias("reachable"), F.count_if(F.col("fill") != 0).alias("assets"))
