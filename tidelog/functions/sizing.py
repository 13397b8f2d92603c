"""Sizing of filters and levels: small driver-side formulas, and the same as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bloom_bits(n: Column, p: float) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p."""
    return F.ceil(n * F.lit(math.log(p)) / F.lit(math.log(1 / 2 ** math.log(2))))


def bloom_hashes(n: Column, bits: Column) -> Column:
    return F.round(F.lit(math.log(2)) * bits / n).cast("long")


def rate_from_memory(entries: int, bits: int) -> float:
    """False-positive rate of a filter with so many bits and the best number of hashes."""
    k = max(1, round(math.log(2) * bits / entries))
    return (1 - math.exp(-k * entries / bits)) ** k


def level_rates(levels: int, factor: float, total_rate: float) -> list[float]:
    """Rates that grow with the level's size, so the sum of false positives is least for the memory
    (optimal allocation: proportional to the level's number of keys), scaled to the given total."""
    share = [factor**k for k in range(levels)]
    scale = total_rate / sum(share)
    return [min(1.0, scale * s) for s in share]


def size_factor(total: int, first: int, levels: int) -> float:
    """The smallest factor for which levels of first * factor**k rows hold total rows."""
    lo, hi = 1.0, max(2.0, total / max(first, 1))
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(first * mid**k for k in range(levels)) >= total:
            hi = mid
        else:
            lo = mid
    return hi


def pinned_size_factor(total: int, first: int, levels: int, pinned: int, pinned_factor: float) -> float:
    """As size_factor, with the first levels growing by their own factor."""
    held = sum(first * pinned_factor**k for k in range(pinned))
    last = first * pinned_factor ** max(0, pinned - 1)
    rest = levels - pinned
    return size_factor(max(1, int(total - held)) + int(last), max(1, int(last)), rest + 1) if rest else pinned_factor


def split_memory(bytes_total: int, keys_of_level: list[int], mode: str = "uniform", last_rate: float = 0.25) -> list[dict]:
    """Filter bytes and rates of each level; what remains is for pinned levels.

    modes: none (no filters), uniform (one rate), proportional (see level_rates), fixed (last_rate)."""
    out, used = [], 0.0
    rates = {
        "none": [1.0] * len(keys_of_level), "uniform": [0.1] * len(keys_of_level), "fixed": [last_rate] * len(keys_of_level),
        "proportional": level_rates(len(keys_of_level), max(1.0, (keys_of_level[-1] / max(1, keys_of_level[0])) ** (1 / max(1, len(keys_of_level) - 1))), 0.1 * len(keys_of_level)),
    }[mode]
    for k, (n, p) in enumerate(zip(keys_of_level, rates, strict=True)):
        need = 0.0 if p >= 1 else -n * math.log(p) / math.log(2) ** 2 / 8
        used += need
        out.append({"level": k, "keys": n, "rate": p, "bytes": math.ceil(need), "pinned": used <= bytes_total})
    return out
