"""Column expressions: luma, radix digits, durations, file and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in the luma.
LUMA = (0.299, 0.587, 0.114)


def luma(r, g, b) -> Column:
    """Grey level 0-255, in double arithmetic, truncated; a grey pixel may come out one lower."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (r, g, b)]
    terms = [F.lit(k) * c for k, c in zip(LUMA, cols)]
    return (terms[0] + terms[1] + terms[2]).cast("int")


def digit(value, place: int, bits: int = 2) -> Column:
    """The ``place``-th digit of ``bits`` bits, from the lowest."""
    c = F.col(value) if isinstance(value, str) else value
    return F.shiftright(c, place * bits).bitwiseAND((1 << bits) - 1)


def seconds(nanoseconds) -> Column:
    return F.col(nanoseconds) / F.lit(1e9)


def truth_path(path) -> Column:
    """Name of the ground-truth file that belongs to an edge file."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\.csv$", "_mst_gt.csv")


def run_name(prefix, n, density) -> Column:
    return F.concat(F.concat_ws("_", F.col(prefix), F.col(n).cast("string"), F.col(density).cast("string")), F.lit(".csv"))


#: The prime modulus and the multipliers of ``number_hash``.
HASH_MODULUS = (1 << 31) - 1
HASH_FACTORS = (48271, 69621, 16807)


def number_hash(value, seed: int = 0) -> Column:
    """A hash of a whole number that is not negative, from 0 to below 2**62; plain integer arithmetic, the same in any engine."""
    return F.expr(number_hash_sql(value, seed))


def number_hash_sql(value: str, seed: int = 0, divide: str = "div", xor: str = "^") -> str:
    """The expression of ``number_hash``; ``divide`` and ``xor`` are an engine's operators (xor may be a function's name)."""
    p, (f, g, h) = HASH_MODULUS, HASH_FACTORS
    mix = (lambda a, b: f"{xor}({a}, {b})") if xor.isalpha() else (lambda a, b: f"({a} {xor} {b})")
    one = f"((({value}) % {p} * {f} + (({value}) {divide} {p}) * {g} + {seed + 1}) % {p})"
    low = f"(({mix(one, f'({one} {divide} 8192)')} * {h} + 12345) % {p})"
    return f"(({mix(low, f'({low} {divide} 128)')} * {g} + 777) % {p} * {p + 1} + {low})"
