"""Scalar expressions used across operators (all stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def neg_log10(p: Column, floor: float = 1e-16) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def zero_if_missing(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def poisson_upper_tail(k: Column, mu: Column) -> Column:
    """P(X > k) for X ~ Poisson(mu), summed term by term in log space.

    Summing the tail itself keeps precision where ``1 - cdf`` is only noise.
    """
    far = F.greatest(k.cast("double"), mu)
    last = F.ceil(far + 12 * F.sqrt(far) + 60).cast("int")
    start = F.struct((-mu).alias("lt"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        lt = acc["lt"] + F.log(mu / i)
        return F.struct(
            lt.alias("lt"),
            (acc["s"] + F.when(i > k, F.exp(lt)).otherwise(F.lit(0.0))).alias("s"),
        )

    tail = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["s"])
    return F.when(k < 0, F.lit(1.0)).otherwise(tail)


def poisson_tail_table(mu: Column, floor: float) -> Column:
    """Array of P(X > k) for k = 0, 1, ... until it falls under ``floor``.

    Its length grows like mu + O(sqrt(mu)), so it is a small lookup table.
    """
    last = F.ceil(mu + 14 * F.sqrt(mu) + 70).cast("int")
    start = F.struct((-mu).alias("lt"), F.array(F.exp(-mu)).alias("pmf"))

    def step(acc: Column, i: Column) -> Column:
        lt = acc["lt"] + F.log(mu / i)
        return F.struct(lt.alias("lt"), F.concat(acc["pmf"], F.array(F.exp(lt))).alias("pmf"))

    pmf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["pmf"])
    # suffix sums from the small end: tail[k] = pmf[k+1] + pmf[k+2] + ...
    suffix = F.aggregate(
        F.reverse(pmf),
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("t")),
        lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["t"], F.array(acc["s"])).alias("t")),
        lambda acc: F.reverse(acc["t"]),
    )
    return F.filter(suffix, lambda v, i: (v >= floor) | (i == 0))


def normal_upper_tail(z: Column) -> Column:
    """Upper tail of the standard normal (rational erfc fit, |error| < 1.2e-7 relative)."""
    # fixed values: coefficients of the erfc approximation, lowest power first
    coef = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    half = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def regularized_gamma_upper(shape: Column, x: Column) -> Column:
    """Q(shape, x): series below shape+1, continued fraction above.

    Both need about the square root of the shape in terms, times a constant."""
    terms = F.ceil(100 + 20 * F.sqrt(shape)).cast("int")
    front = shape * F.log(x) - x - log_gamma(shape)
    series = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct((1.0 / shape).alias("t"), (1.0 / shape).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * x / (shape + i)).alias("t"), (a["s"] + a["t"] * x / (shape + i)).alias("s")
        ),
        lambda a: a["s"],
    )
    b0 = x + 1.0 - shape
    tiny = 1e-300
    fraction = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(
            b0.alias("b"), F.lit(1.0 / tiny).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h")
        ),
        lambda a, i: _lentz(a, i, shape),
        lambda a: a["h"],
    )
    return (
        F.when(x <= 0, F.lit(1.0))
        .when(x < shape + 1, 1.0 - F.exp(front) * series)
        .otherwise(F.exp(front) * fraction)
    )


def _lentz(a: Column, i: Column, shape: Column) -> Column:
    an = -i * (i - shape)
    b = a["b"] + 2.0
    d = 1.0 / (an * a["d"] + b)
    c = b + an / a["c"]
    return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (a["h"] * d * c).alias("h"))


def log_gamma(x: Column) -> Column:
    """log Γ(x), x > 0: shift up by 12, then the Stirling series."""
    y = x + 12.0
    shift = F.log(x)
    for i in range(1, 12):
        shift = shift + F.log(x + float(i))
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (
        F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 360) - inv2 * (F.lit(1.0 / 1260) - inv2 * F.lit(1.0 / 1680)))
    )
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - shift


def feature_name(prefix: str, low: Column, high: Column, strand: Column) -> Column:
    return F.format_string(f"{prefix}_%d_%d_%s", low, high, strand)


def label_of(bound: Column, ambiguous: Column) -> Column:
    """B when bound, else A when ambiguous, else U."""
    return F.when(bound, F.lit("B")).when(ambiguous, F.lit("A")).otherwise(F.lit("U"))


def cell_name(line: Column, kind: Column, tissue: Column) -> Column:
    """Upper-cased line, or line_type_tissue when the line is NONE."""
    return F.when(F.upper(line) == "NONE", F.upper(F.concat_ws("_", line, kind, tissue))).otherwise(F.upper(line))
