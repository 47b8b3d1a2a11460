"""Small numeric helpers with explicit NULL behaviour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Modulus and multipliers of the portable integer hash below (fixed values).
_PRIME = 2147483647


def clip(c: Column, lo=None, hi=None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    out = c
    if lo is not None and hi is not None:
        out = F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)
    elif lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(c)
    elif hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(c)
    return out


def clamp_nested(c: Column, lo=None, hi=None) -> Column:
    """Clamp that mentions its input once, for deep expressions. The caller guards NULL input."""
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    return c


def round_even(c: Column | str, digits: int) -> Column:
    """Half-to-even rounding of the scaled binary value, without negative zero.

    The arithmetic of array libraries; generated code, where `bround` builds a decimal per row.
    """
    c = F.col(c) if isinstance(c, str) else c
    factor = float(10 ** digits)
    return F.rint(c.cast("double") * factor) / factor + F.lit(0.0)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode raises otherwise)."""
    return a / F.nullif(b, F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def hash_uniform(key: Column, seed: int = 42) -> Column:
    """Deterministic number in [0, 1) per integer key: independent of partitioning and of run order.

    Two words of 31 bits give about 53 bits, so very many keys see different draws; negative keys draw their own.
    Integer arithmetic only up to the last step, so any SQL engine reproduces it.
    """
    k = F.abs(key.cast("bigint"))
    sign = F.when(key < 0, 1).otherwise(0)

    def word(first: int, second: int, seed: int) -> Column:
        h = ((k % _PRIME) * first + (k / _PRIME).cast("bigint") % _PRIME + sign * 7919 + seed * 16807) % _PRIME
        return (((h * h + 12345) % _PRIME) * second + h + seed) % _PRIME

    prime = F.lit(float(_PRIME))
    return (word(48271, 69621, seed) + word(39373, 62089911, seed + 1) / prime) / prime


def hash_uniform_numpy(key: np.ndarray, seed: int = 42) -> np.ndarray:
    """The same number for an array of keys."""
    k, sign = np.abs(key), (key < 0).astype(np.int64)

    def word(first: int, second: int, seed: int) -> np.ndarray:
        h = ((k % _PRIME) * first + (k / float(_PRIME)).astype(np.int64) % _PRIME + sign * 7919 + seed * 16807) % _PRIME
        return (((h * h + 12345) % _PRIME) * second + h + seed) % _PRIME

    return (word(48271, 69621, seed) + word(39373, 62089911, seed + 1) / float(_PRIME)) / float(_PRIME)


def hash_uniform_sql(key: str, seed: int = 42) -> str:
    """The same number as plain SQL text (used where a check runs outside Spark)."""
    k = f"abs(CAST({key} AS BIGINT))"
    sign = f"CASE WHEN {key} < 0 THEN 7919 ELSE 0 END"

    def word(first: int, second: int, seed: int) -> str:
        h = (f"((({k} % {_PRIME}) * {first} + CAST(floor({k} / CAST({_PRIME} AS DOUBLE)) AS BIGINT) % {_PRIME}"
             f" + {sign} + {seed * 16807}) % {_PRIME})")
        return f"((((({h}) * ({h}) + 12345) % {_PRIME}) * {second} + {h} + {seed}) % {_PRIME})"

    return f"((CAST({word(48271, 69621, seed)} AS DOUBLE) + CAST({word(39373, 62089911, seed + 1)} AS DOUBLE) / {_PRIME}.0e0) / {_PRIME}.0e0)"


def unit_scale(c: Column, lo: float, hi: float) -> Column:
    """(x - lo) / (hi - lo), not clamped."""
    return (c - lo) / (hi - lo)


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value half to even (like C's %.nf;
    `format_string` would round the shortest decimal form half up)."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))
