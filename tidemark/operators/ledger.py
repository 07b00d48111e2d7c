"""State as a fold over events: settings, orders, books, spending, slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

#: From each state, the events that are legal and the states they lead to.
LEGAL = """
draft release pending_new
draft abandon cancelled
pending_new acknowledge acknowledged
pending_new reject rejected
pending_new expire expired
acknowledged partial_fill partially_filled
acknowledged fill_complete filled
acknowledged request_cancel pending_cancel
acknowledged expire expired
acknowledged venue_cancel cancelled
partially_filled partial_fill partially_filled
partially_filled fill_complete filled
partially_filled request_cancel pending_cancel_partial
partially_filled expire expired
partially_filled venue_cancel cancelled
pending_cancel cancel_confirmed cancelled
pending_cancel cancel_rejected acknowledged
pending_cancel partial_fill pending_cancel_partial
pending_cancel fill_complete filled
pending_cancel expire expired
pending_cancel_partial cancel_confirmed cancelled
pending_cancel_partial cancel_rejected partially_filled
pending_cancel_partial partial_fill pending_cancel_partial
pending_cancel_partial fill_complete filled
pending_cancel_partial expire expired
"""
TRANSITIONS = tuple(tuple(line.split()) for line in LEGAL.strip().splitlines())
FINAL = ("filled", "cancelled", "rejected", "expired")
SKEW_SECONDS = 300


def latest(events: DataFrame, key: tuple[str, ...], order: str = "event_id") -> DataFrame:
    """The current row of each key: that of the largest event id, whatever its clock says."""
    rest = [c for c in events.columns if c not in key]
    won = events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_w"))
    return won.select(*key, *[F.col(f"_w.{c}").alias(c) for c in rest])


def with_next_state(events: DataFrame) -> DataFrame:
    """events (state, event) with to_state, and what a pair that is not legal is: final, unknown or illegal."""
    table = events.sparkSession.createDataFrame(TRANSITIONS, "state string, event string, to_state string")
    known = [e for _, e, _ in TRANSITIONS]
    told = events.join(F.broadcast(table), ["state", "event"], "left")
    why = F.when(F.col("to_state").isNotNull(), "ok").when(F.col("state").isin(*FINAL), "final").when(~F.col("event").isin(*known), "unknown").otherwise("illegal")
    return told.withColumn("verdict", why)


def replay(log: DataFrame, quantity: str = "quantity") -> DataFrame:
    """log (order_id, sequence, from_state, to_state, fill, quantity) to state, filled and n by order; status names the first thing that is wrong."""
    order = Window.partitionBy("order_id").orderBy("sequence")
    told = log.select("*", F.row_number().over(order).alias("_k"), F.lag("to_state").over(order).alias("_was"), F.sum(F.coalesce("fill", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_filled"))
    wrong = F.when(F.col("sequence") != F.col("_k"), "gap in sequence").when(F.col("_was").isNotNull() & (F.col("_was") != F.col("from_state")), "broken chain").when(F.col("_filled") > F.col(quantity), "overfill")
    got = told.withColumn("_wrong", wrong).groupBy("order_id").agg(F.max_by("to_state", "sequence").alias("state"), F.max_by("_filled", "sequence").alias("filled"), F.count("*").alias("n"), F.min_by("_wrong", F.when(F.col("_wrong").isNotNull(), F.col("sequence"))).alias("_why"))
    return got.select("order_id", "state", "filled", "n", F.coalesce("_why", F.lit("ok")).alias("status"))


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 of the named parts as JSON, whatever their order; nulls are written as such."""
    told = F.from_json(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), "map<string,string>")
    pairs = F.array_sort(F.map_entries(told))
    return F.sha2(F.to_json(pairs, {"ignoreNullFields": "false"}), 256)


def reconcile(ours: DataFrame, theirs: DataFrame, key: tuple[str, ...] = ("account", "security")) -> DataFrame:
    """Positions (account, security, shares) that differ, and how: missing at either side, another sign or another size."""
    both = ours.select(*key, F.col("shares").alias("ours")).join(theirs.select(*key, F.col("shares").alias("theirs")), list(key), "full_outer")
    a, b = F.coalesce("ours", F.lit(0)), F.coalesce("theirs", F.lit(0))
    kind = F.when(a == b, "match").when(F.col("theirs").isNull() | (b == 0), "only ours").when(F.col("ours").isNull() | (a == 0), "only theirs").when(F.signum(a) != F.signum(b), "opposite side").otherwise("quantity")
    return both.select(*key, a.alias("ours"), b.alias("theirs"), kind.alias("kind"))


def reconcile_cash(books: DataFrame, tolerance: float) -> DataFrame:
    """books (account, ours, theirs, ours_at, theirs_at): cash that differs beyond the tolerance; snapshots too far apart are refused."""
    apart = F.abs(F.unix_micros("ours_at") - F.unix_micros("theirs_at")) > SKEW_SECONDS * 1_000_000
    return refuse(books, apart, "the snapshots are too far apart").withColumn("kind", F.when(F.abs(F.col("ours") - F.col("theirs")) <= tolerance, "match").otherwise("cash"))


def kill_switch(state: DataFrame, max_drawdown: float, max_age_hours: float) -> DataFrame:
    """state (account, drawdown, age_hours, matched, manual) with halt and its reason; what is not known halts."""
    why = (
        F.when(F.coalesce("manual", F.lit(True)), "manual")
        .when(~F.coalesce(F.col("drawdown") < max_drawdown, F.lit(False)), "drawdown")
        .when(~F.coalesce(F.col("age_hours") <= max_age_hours, F.lit(False)), "freshness")
        .when(~F.coalesce("matched", F.lit(False)), "reconciliation")
    )
    return state.withColumn("reason", why).withColumn("halt", F.col("reason").isNotNull())


def committed(ledger: DataFrame) -> DataFrame:
    """Sum of deltas by provider and window."""
    return ledger.groupBy("provider", "window").agg(F.sum("delta").alias("committed"))


def admitted(requests: DataFrame, cap: Column) -> DataFrame:
    """requests (provider, window, seq, amount) in order, with whether each fits: what came before and it stay within the cap.

    A request that does not fit takes nothing. That makes admission a fold along a provider's window: its rows come
    sorted, in batches, and all that is held between rows is the sum so far, however many requests there are.
    Ties of seq are taken by amount.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("provider", "window", "seq", "amount")}
    told = requests.select("provider", "window", "seq", "amount", cap.cast(kinds["amount"]).alias("_cap"))
    sorted_ = told.repartition("provider", "window").sortWithinPartitions("provider", "window", "seq", "amount")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, spent = None, 0
        for batch in batches:
            ok = []
            for provider, window, amount, limit in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
                if group != (provider, window):
                    group, spent = (provider, window), 0
                fits = amount is not None and limit is not None and spent + amount <= limit
                spent += amount if fits else 0
                ok.append(fits)
            yield pa.record_batch([*batch.columns[:4], pa.array(ok, pa.bool_())], names=["provider", "window", "seq", "amount", "admitted"])

    return sorted_.mapInArrow(fold, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", admitted boolean")


def call_cost(text: Column, usd_per_million: Column, extra_tokens: int = 1024) -> Column:
    """An upper bound of what a call costs: a token a byte, and some, rounded up at ten places."""
    tokens = (F.octet_length(text) + extra_tokens).cast("decimal(20,0)")
    exact = tokens * usd_per_million.cast("decimal(12,4)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.ceil(exact, F.lit(10)).cast("decimal(38,10)")


def volume_profile(sessions: DataFrame) -> DataFrame:
    """sessions (security, session_date, volumes) with profile: bucket sums over strictly earlier sessions, null for the first."""
    flat = sessions.select("security", "session_date", F.posexplode("volumes").alias("bucket", "v"))
    before = Window.partitionBy("security", "bucket").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    summed = flat.withColumn("before", F.sum("v").over(before))
    return summed.select("security", "session_date", "bucket", "before")


def u_curve(n: int, edge: int = 3) -> list[int]:
    """Integer weights of a parabola that is `edge` times as high at its ends as in the middle."""
    if n < 1:
        raise Refused("one slice or more")
    span = (n - 1) ** 2
    return [span + (edge - 1) * (2 * i - (n - 1)) ** 2 for i in range(n)] if n > 1 else [1]


#: What is used in a lambda is bound by a list of one element, since a column would be told anew for every element.
DEALT = """transform(array(struct(CAST(_rest AS BIGINT) AS rest, CAST(_base AS BIGINT) AS base, _w AS w)), s -> transform(array(aggregate(s.w, 0L, (a, v) -> a + coalesce(v.weight, 0L))), total ->
 transform(array(array_sort(transform(s.w, v -> struct(-((s.rest * v.weight) % total) AS behind, v.idx AS idx, s.rest * v.weight div total AS part)))), p -> transform(array(s.rest - aggregate(p, 0L, (a, v) -> a + coalesce(v.part, 0L))), short ->
 transform(p, (v, k) -> struct(v.idx AS idx, s.base + v.part + IF(k < short, 1L, 0L) AS shares)))[0])[0])[0])[0]"""


def dealt(rows: DataFrame) -> DataFrame:
    """parent, idx and shares of rows (parent, _base, _rest, _w: an array of idx and weight in order of idx): whole parts of the rest, then one each by largest remainder, ties by index.

    All of it is done within a parent's row, so nothing is shuffled or sorted, however many parents there are.
    """
    return rows.select("parent", F.inline(F.expr(DEALT)))


def apportion(parents: DataFrame, weights: DataFrame, least: int = 0) -> DataFrame:
    """Shares of each parent's quantity in proportion to weights (idx, weight): everyone gets the minimum, then whole parts, then one each by largest remainder, ties by index."""
    told = parents.join(F.broadcast(weights.agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_w")).where(F.size("_w") > 0)))  # one row, the caller's curve
    told = told.withColumn("_base", F.lit(least)).withColumn("_rest", F.col("quantity") - F.lit(least) * F.size("_w"))
    return dealt(refuse(told, F.col("_rest") < 0, "less than the minimum for every slice"))
