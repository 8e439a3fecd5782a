"""Weighted sums over a centred window, as expressions.

Sums are in FLOAT and from left to right: a sum that differs in the last bit can flip a thresholded bit.
Taps are decimal strings, so that every engine reads the same 32-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taps of the default kernel, from left to right.
DEFAULT_TAPS = ("0.00025177", "0.008666992", "0.078025818", "0.24130249", "0.343757629", "0.24130249", "0.078025818", "0.008666992", "0.000125885")
IDENTITY_TAPS = ("0", "0", "0", "0", "1", "0", "0", "0", "0")
UNIFORM_TAPS = ("0.11111111",) * 9

REPLICATE, ZERO_PAD = "replicate", "zero_pad"


def checked(taps: Sequence[str | float]) -> tuple[str, ...]:
    out = tuple(str(t) for t in taps)
    if not out or len(out) % 2 == 0:
        raise ValueError("a kernel needs an odd number of taps")
    if not all(math.isfinite(float(t)) for t in out):
        raise ValueError("kernel taps must be finite")
    return out


def check_policy(policy: str) -> str:
    if policy not in (REPLICATE, ZERO_PAD):
        raise ValueError(f"unknown edge policy {policy!r}")
    return policy


def weighted(values: Sequence[Column], taps: Sequence[str]) -> Column:
    """values[0] * taps[0] + values[1] * taps[1] + ..., in FLOAT. Taps of zero add nothing and are left out."""
    terms = [v.cast("float") * F.lit(float(t)).cast("float") for v, t in zip(values, taps) if float(t) != 0]
    if not terms:
        return F.lit(0.0).cast("float")
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def padded(line: Column, half: int, policy: str) -> Column:
    """The line with half values more at each end, as FLOAT; an empty line stays empty."""
    zero = F.lit(0).cast("float")
    line = line.cast("array<float>")
    first = F.get(line, F.lit(0)) if policy == REPLICATE else zero
    last = F.get(line, F.size(line) - 1) if policy == REPLICATE else zero
    return F.when(F.size(line) > 0, F.concat(F.array_repeat(first, half), line, F.array_repeat(last, half))).otherwise(line)


def at_place(padded_line: Column, place: Column, taps: Sequence[str]) -> Column:
    """The weighted sum centred at a place (0-based) of the line that was padded."""
    return weighted([F.get(padded_line, place + k) for k in range(len(taps))], taps)


def above(value: Column, threshold: int | Column) -> Column:
    """1 if the value is at least the threshold, else 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (value >= limit.cast("float")).cast("int")
