"""Scalar scores. Times are epoch seconds or timestamps; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric scales per platform (fixed values).
PLATFORM_SCALES = {
    "x": {"likes": 500, "reposts": 100, "replies": 75, "quotes": 40, "views": 50_000},
    "threads": {"likes": 250, "replies": 50, "reposts": 50, "quotes": 25},
    "telegram": {"views": 25_000, "forwards": 100, "reactions": 300, "replies": 50},
    "reddit": {"score": 500, "comments": 150},
    "bluesky": {"likes": 35, "reposts": 15, "replies": 15, "quotes": 10},
    "mastodon": {"likes": 50, "reposts": 25, "replies": 20},
    "hacker_news": {"points": 45, "comments": 35},
    "github": {"stars": 500, "forks": 100, "comments": 50},
    "youtube": {"views": 100_000, "likes": 5_000, "comments": 1_000},
    "tiktok": {"views": 250_000, "likes": 15_000, "comments": 1_000, "shares": 1_000, "favorites": 3_000},
    "instagram": {"likes": 5_000, "comments": 500},
    "gdelt": {"mentions": 25},
    "rss": {},
    "mock": {"likes": 30, "shares": 15, "comments": 10},
}
#: Platforms that count as social (fixed values).
SOCIAL = ["x", "threads", "telegram", "reddit", "youtube", "instagram", "tiktok", "facebook", "linkedin", "bluesky", "mastodon"]


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals (0 to 15): the nearest by the exact value of the double, half to even where it is a tie.

    So 2.675, which as a double lies below the tie, gives 2.67, and 0.125 gives
    0.12.  x times the power of ten is kept as a product and the error of its
    rounding, both exact, as x and the power are cut in halves whose products
    fit a double.  Magnitudes beyond 2^53 steps have no further digits and stay.
    """
    scale = 10.0**digits
    high = float((scale * 134217729.0) - (scale * 134217729.0 - scale))
    low = scale - high

    def exact(v: Column) -> Column:
        wide = v * F.lit(134217729.0)
        top = wide - (wide - v)
        rest = v - top
        product = v * F.lit(scale)
        error = ((top * high - product) + top * low + rest * high) + rest * low
        below = F.floor(product).cast("double")
        over = (product - below) - 0.5 + error  # its sign is right: the first term is exact, and the second far smaller than its steps
        up = (over > 0) | ((over == 0) & (below % 2 != 0))
        return F.when(F.abs(product) < F.lit(float(1 << 53)), (below + up.cast("double")) / scale).otherwise(v)

    return F.get(F.transform(F.array(x.cast("double")), exact), F.lit(0))  # x is computed once


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def freshness(published: Column, now: Column, half_life_hours: float = 48.0) -> Column:
    """100 at age 0, halved each half life; future dates are age 0, missing ones 25."""
    age = F.greatest(F.lit(0.0), (_micros(now) - _micros(published)) / 3.6e9)
    return F.when(published.isNull(), 25.0).otherwise(rounded(100 * F.pow(F.lit(0.5), age / half_life_hours), 2))


def temporal_proximity(a: Column, b: Column, half_life_hours: float = 336.0) -> Column:
    gap = F.abs(_micros(a) - _micros(b)) / 3.6e9
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), gap / half_life_hours))


def cross_source(n_sources: Column) -> Column:
    return F.when(n_sources <= 1, 0.0).otherwise(F.least(F.lit(100.0), 40.0 + 20.0 * (n_sources - 2)))


def engagement(metrics: dict[str, Column], scales: dict[str, float]) -> Column:
    """Mean of the present metrics on a log scale; no metric or no scale: 0. Missing is no zero."""
    parts = [(metrics[m].cast("double"), s) for m, s in scales.items() if m in metrics]
    if not parts:
        return F.lit(0.0)
    total, count = F.lit(0.0), F.lit(0)
    for value, scale in parts:
        share = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), value)) / F.log1p(F.lit(float(scale))))
        total = total + F.when(value.isNull(), 0.0).otherwise(share)
        count = count + value.isNotNull().cast("int")
    return F.when(count > 0, rounded(100 * total / count, 2)).otherwise(0.0)


def social_reach(source: Column, score: Column, n_platforms: Column) -> Column:
    spread = 100 * (1 - F.exp(-F.greatest(F.lit(0.0), n_platforms - 1.0) / 2))
    return F.when(source.isin(SOCIAL), rounded(F.least(F.lit(100.0), 0.8 * score + 0.2 * spread), 2))


def token_rarity(df: Column, n: Column) -> Column:
    return F.when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), F.log((n + 1.0) / (df + 1.0)) / F.log(n + 1.0)))


def cluster_weight(df: Column, n: Column, in_query: Column) -> Column:
    base = F.log((n + 1.0) / (df + 0.5)) + 1.0
    return base * F.when(in_query, 0.05).when(df / n > 0.35, 0.25).otherwise(1.0)


def discovery_weight(precision: Column, yields: Column, failures: Column, requests: Column) -> Column:
    return F.when(requests == 0, 1.0).otherwise(0.75 + 0.25 * (0.45 * precision + 0.35 * yields + 0.2 * (1 - failures)))


def split_evenly(total: Column, n: Column, position: Column) -> Column:
    """Share of the position-th of n receivers (from 1): quotient, and one more for the first remainder."""
    return F.floor(total / n) + (position <= total % n).cast("long")
