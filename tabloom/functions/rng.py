"""Counter-based randomness: a value depends on (seed, label, row id) only.

Nothing here depends on partitioning, task order or retries, so a lost executor recomputes the
same rows. ``md5`` streams can be reproduced by any SQL engine; ``xxhash64`` is the faster choice
when that is not needed.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F

MASK64 = (1 << 64) - 1


def normalize_seed(seed: int | str) -> int:
    """64-bit seed; text is hashed with SHA-256 and reduced to its low 64 bits."""
    if isinstance(seed, str):
        return int(hashlib.sha256(seed.encode()).hexdigest()[-16:], 16)
    return int(seed) & MASK64


def subseed(seed: int | str, label: str) -> int:
    return normalize_seed(f"{normalize_seed(seed)}::{label}")


def _digits(seed: int | str, label: str, ids: tuple) -> Column:
    """The 32 hexadecimal md5 digits of (seed, label, ids)."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{label}"), *[c.cast("string") for c in cols]))


def _share(digits: Column, start: int) -> Column:
    """13 digits as a double in [0, 1)."""
    return F.conv(F.substring(digits, start, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform(seed: int | str, label: str, *ids: Column | str, method: str = "md5") -> Column:
    """Uniform double in [0, 1) from 52 hash bits."""
    if method == "xxhash64":
        cols = [F.col(i) if isinstance(i, str) else i for i in ids]
        h = F.xxhash64(F.lit(normalize_seed(seed) & 0x7FFFFFFFFFFFFFFF), F.lit(label), *cols)
        return F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(1 << 52))
    return _share(_digits(seed, label, ids), 1)


def normal(seed: int | str, label: str, *ids: Column | str, method: str = "md5") -> Column:
    """Standard normal by Box-Muller; ``1 - u`` keeps the logarithm finite.

    Both uniforms come from one md5 (digits 1-13 and 14-26).
    """
    if method == "xxhash64":
        u1, u2 = (uniform(seed, f"{label}/{part}", *ids, method=method) for part in ("a", "b"))
    else:
        d = _digits(seed, label, ids)
        u1, u2 = _share(d, 1), _share(d, 14)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def octets(seed: int | str, label: str, *ids: Column | str) -> list[Column]:
    """Four numbers 0..255 from one md5."""
    d = _digits(seed, label, ids)
    return [F.conv(F.substring(d, 2 * i + 1, 2), 16, 10) for i in range(4)]


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) by inversion; the half-step offset keeps u away from 0."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    c = u + F.lit(2.0**-53) - F.lit(0.5)
    return -scale * F.signum(c) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(c))


#: Rounds of the permutation, and how often an image outside the domain is mapped again.
FEISTEL_ROUNDS, WALKS = 4, 12


def grid(n: int) -> tuple[int, int]:
    """(a, b) with ``n <= a * b < n + a``: the sides of the smallest grid that the permutation mixes."""
    if n < 1 or n > 1 << 61:
        raise ValueError(f"domain size {n} outside 1..2^61")
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def bijection(idc: Column, n: int, seed: int | str, label: str) -> Column:
    """A keyed permutation of 0..n-1 that stays mixed for any n.

    The id is a place (row, column) of a grid of about sqrt(n) by sqrt(n); rounds shift the row by a hash of the column
    and the column by a hash of the row. Fewer than sqrt(n) places lie outside the domain; an image there is
    mapped again (a walk along its cycle), which a row needs with a probability below 1 / sqrt(n) each time.
    """
    a, b = grid(n)
    key = subseed(seed, label) >> 1

    def shift(half: Column, other: Column, size: int, step: int) -> Column:
        return F.pmod(half + F.pmod(F.xxhash64(F.lit(key), F.lit(step), other), F.lit(size)), F.lit(size))

    def image(x: Column) -> Column:
        row, column = F.call_function("div", x, F.lit(b)), F.pmod(x, F.lit(b))
        for step in range(FEISTEL_ROUNDS):
            row, column = (shift(row, column, a, step), column) if step % 2 == 0 else (row, shift(column, row, b, step))
        return row * F.lit(b) + column

    out = image(idc.cast("long"))
    if a * b > n:
        out = F.aggregate(F.array_repeat(F.lit(0), WALKS), out, lambda x, _: F.when(x < n, x).otherwise(image(x)))
        out = F.when(out < n, out).otherwise(F.raise_error(F.lit(f"{label}: an id of {n} left the domain {WALKS} times")).cast("long"))
    return out


def choose(values: list, u: Column) -> Column:
    """Uniform pick from a short driver-side list."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


def cumulative(probs) -> list[float]:
    """Running sums in list order; the last one is exactly 1."""
    total, run, out = float(sum(probs)), 0.0, []
    for q in probs:
        run += float(q) / total
        out.append(run)
    out[-1] = 1.0
    return out


def weighted_choice(values: list, probs: list | None, u: Column) -> Column:
    """Inverse CDF over a short driver-side list; no probabilities means uniform.

    The position is a plain sum of comparisons, so the draw is evaluated once per row.
    """
    edges = cumulative(probs if probs else [1.0] * len(values))[:-1]
    if len(edges) > 32:
        place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= u))
    else:
        place = sum(((u >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)
