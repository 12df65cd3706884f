"""Column expressions and plain functions for weights, qualities, priors and tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Hill's algorithm AS 66 for the normal tail (Applied Statistics 22, 1973)
P, Q, R = 0.398942280444, 0.39990348504, 0.398942280385
A = (5.75885480458, 2.62433121679, 5.92885724438)
B = (-29.8213557807, 48.6959930692)
C = (-3.8052e-8, 3.98064794e-4, -0.151679116635, 4.8385912808, 0.742380924027, 3.99019417011)
D = (1.00000615302, 1.98615381364, 5.29330324926, -15.1508972451, 30.789933034)
NEAR, FAR_LOWER, FAR_UPPER = 1.28, 7.0, 18.66


def _near(x, y):
    """The rational form of the centre; x and y = x * x / 2 are numbers or columns."""
    inner = y + A[2]
    for a, b in ((A[1], B[1]), (A[0], B[0])):
        inner = y + a + b / inner
    return 0.5 - x * (P - Q * y / inner)


def _far(x, decay):
    """The continued fraction of the tail, from its innermost term."""
    inner = x + C[5]
    for c, d in zip(reversed(C[:5]), reversed(D), strict=True):
        inner = x + c + d / inner
    return R * decay / inner


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution by AS 66."""
    x = F.abs(z)
    y = 0.5 * x * x
    tail = F.when(x <= NEAR, _near(x, y)).when((x <= FAR_LOWER) | ((z >= 0) & (x <= FAR_UPPER)), _far(x, F.exp(-y))).otherwise(0.0)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def normal_tail_value(z: float) -> float:
    """The same for one number."""
    x = abs(z)
    y = 0.5 * x * x
    if x <= NEAR:
        tail = _near(x, y)
    else:
        tail = _far(x, math.exp(-y)) if x <= FAR_LOWER or (z >= 0 and x <= FAR_UPPER) else 0.0
    return tail if z >= 0 else 1 - tail


def assignment_weight(similarity: Column, ref_similarity: float = 0.8, has_n: Column | None = None) -> Column:
    """Weight of a read by its similarity: 1, 0.5, 0.1 and 0.01 in bands of a quarter of what the threshold leaves; a tenth with N."""
    band = max((1 - ref_similarity) / 4, 0.01)
    w = F.when(similarity < 1 - 3 * band, 0.01).when(similarity < 1 - 2 * band, 0.1).when(similarity < 1 - band, 0.5).otherwise(1.0)
    return w if has_n is None else F.when(has_n, w / 10).otherwise(w)


def discriminative_phred(best: Column, second: Column) -> Column:
    """-10 log10 of the runner-up's share, cut to 0..60 and truncated; 60 without a runner-up."""
    q = F.least(F.lit(60.0), F.greatest(F.lit(0.0), -10 * F.log10(second / (best + second))))
    return F.when(second <= 0, 60).otherwise(q.cast("int")).cast("int")


def hwe_log_prior(f1: Column, f2: Column, same: Column) -> Column:
    """Log prior of a genotype at Hardy-Weinberg equilibrium."""
    return F.when(same, 2 * F.log(f1)).otherwise(math.log(2) + F.log(f1) + F.log(f2))


def log_normal_score(x: Column, mean: Column, sd: Column) -> Column:
    """Log density of a normal distribution without its constant."""
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd)


def null_penalty(penalty: float, first_null: Column, second_null: Column, homozygous: Column) -> Column:
    """The penalty (0 to 16) for each haplotype of altered expression; a homozygous one counts twice."""
    p = min(16.0, max(0.0, penalty))
    n = F.when(homozygous, 2 * first_null.cast("int")).otherwise(first_null.cast("int") + second_null.cast("int"))
    return p * n


def python_float(x: Column) -> Column:
    """A number as Python prints it; null, an untouched cell, as 0."""
    plain = F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & (x == F.floor(x)), F.concat(F.format_string("%.0f", x), F.lit(".0"))).otherwise(x.cast("string"))
    return F.when(x.isNull(), "0").otherwise(plain)


def hit_length(mean_length: float, paired: bool, aligned: bool = False) -> int:
    """Bases that a read's hits must cover: a fifth of the mean length, with a floor by input and pairing."""
    floor = (21 if paired else 17) if aligned else (27 if paired else 23)
    return max(floor, int(mean_length) // 5)


def infer_kmer_length(total_bases: int) -> int:
    """One more than the base-4 digits of the reference's length."""
    digits = 0
    while total_bases > 0:
        total_bases //= 4
        digits += 1
    return digits + 1


def check_range(name: str, value: float, low: float, high: float) -> float:
    """The value, or ValueError unless it is a finite number from low to high."""
    if not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low:g} to {high:g}, not {value}")
    return value


class Rand48:
    """The 48-bit linear congruential generator of the C library's drand48, for seeded random bases."""

    # fixed values: multiplier, increment and low seed word of the standard
    A, C, LOW = 0x5DEECE66D, 0xB, 0x330E

    def __init__(self, seed: int = 17):
        self.state = (seed & 0xFFFFFFFF) << 16 | self.LOW

    def next(self) -> float:
        self.state = (self.A * self.state + self.C) & (1 << 48) - 1
        return self.state / (1 << 48)

    def bases(self, n: int) -> str:
        return "".join("ACGT"[int(self.next() * 4)] for _ in range(n))
