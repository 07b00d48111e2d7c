"""Canonical texts and their digests: equal values have equal texts, on the driver and in columns."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused


def canonical_decimal(x: Decimal) -> str:
    """A finite decimal without exponent or trailing zeros."""
    if not x.is_finite():
        raise Refused(f"not finite: {x}")
    text = format(x.normalize(), "f")
    return "0" if Decimal(text) == 0 else text


def canonical_json(value: object) -> str:
    """Sorted keys, no white space; dicts with text keys, lists, texts, integers, finite floats, decimals, booleans and null only."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            if bad := [k for k in v if not isinstance(k, str)]:
                raise Refused(f"keys must be texts: {bad}")
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if isinstance(v, Decimal):
            return canonical_decimal(v)
        if v is None or isinstance(v, str | bool | int | float):
            return v
        raise Refused(f"no canonical form for {type(v).__name__}")

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_digest(**columns: Column) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names; nulls are written out."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def _finite(x: Column, what: str) -> Column:
    """x, which fails if it is no finite number; null stays null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.raise_error(F.lit(f"{what} must be finite")).cast("double")).otherwise(x.cast("double"))


def bps(fraction: Column) -> Column:
    return _finite(fraction, "a fraction") * 10_000.0


def fraction_of_bps(x: Column) -> Column:
    return _finite(x, "basis points") / 10_000.0


def percent(fraction: Column) -> Column:
    return _finite(fraction, "a fraction") * 100.0


def bps_of_percent(x: Column) -> Column:
    return _finite(x, "a percentage") * 100.0


def percent_of_bps(x: Column) -> Column:
    return _finite(x, "basis points") / 100.0


def usd_of_bps(x: Column, notional: Column) -> Column:
    """Of the size of a notional, whichever side it is on."""
    return fraction_of_bps(x) * F.abs(_finite(notional, "a notional"))


def bps_of_usd(cost: Column, notional: Column) -> Column:
    """A cost as basis points of the size of a notional; of no notional it fails unless the cost is zero."""
    size = F.abs(_finite(notional, "a notional"))
    cost = _finite(cost, "a cost")
    return F.when(size > 0, bps(cost / size)).when(cost == 0, 0.0).when(cost.isNotNull() & size.isNotNull(), F.raise_error(F.lit("a cost of no notional")).cast("double"))
