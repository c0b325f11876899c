"""Dates, decay, scores and vectors as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(c: Column) -> Column:
    """ISO text as a timestamp; without offset it is UTC (the session's zone)."""
    return F.try_to_timestamp(c)


def day(c: Column) -> Column:
    """The date in the first ten characters; null where that is no date."""
    return F.substring(c, 1, 10).try_cast("date")


def iso_week(c: Column) -> Column:
    """``2026-W07``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def recency(last: Column, now: Column, half_life: float = 90.0) -> Column:
    """Halves every ``half_life`` days; a date ahead counts as today; null without a date. Rounded to 2."""
    age = F.datediff(now, last)
    return F.round(F.pow(F.lit(0.5), F.when(age < 0, 0).otherwise(age) / half_life), 2)


def edge_decay(last: Column, now: Column, year: float = 365.0) -> Column:
    """1 within a year, then halving each year."""
    age = F.datediff(now, last)
    return F.when(age <= year, 1.0).otherwise(F.pow(F.lit(0.5), age / year))


def log_mass(total: Column) -> Column:
    return F.round(F.log1p(total), 2)


def span_weeks(first: Column, last: Column) -> Column:
    """Weeks between two instants, rounded to 1."""
    return F.round((F.unix_micros(last) - F.unix_micros(first)) / 1e6 / 604800.0, 1)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def closeness(observed: Column, target: Column) -> Column:
    """How much of a target is reached: 1 at or above it; null where the value is unknown or the target is not above 0."""
    return F.when((target > 0) & observed.isNotNull(), F.least(F.lit(1.0), observed / target))


def mean_and_best(mean: Column, best: Column, mean_weight: float = 0.6) -> Column:
    return F.round(mean_weight * mean + (1 - mean_weight) * best, 1)


def weighted_mean(scores: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Mean over the scores that are there; a missing score gives its weight to the rest; null when none is there."""
    w = [F.when(s.isNotNull(), F.coalesce(x.cast("double"), F.lit(0.0))).otherwise(0.0) for s, x in zip(scores, weights)]
    total = sum(w[1:], w[0])
    value = sum((F.coalesce(s.cast("double"), F.lit(0.0)) * x for s, x in list(zip(scores, w))[1:]), F.coalesce(scores[0].cast("double"), F.lit(0.0)) * w[0])
    return F.when(total > 0, value / total)


def diversity(kinds: Column) -> Column:
    """1.0 for two kinds of evidence or more, 0.8 for one, 0.5 for none."""
    n = F.size(F.array_distinct(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return F.when(n >= 2, 1.0).when(n == 1, 0.8).otherwise(0.5)


def confidence(weights: Sequence[Column], coverage: Sequence[Column], diverse: Sequence[Column], present: Sequence[Column]) -> Column:
    """Weight-averaged coverage times diversity over the scored categories, by all weights. Rounded to 2."""
    total = sum(weights[1:], weights[0])
    parts = [F.when(p, w * F.coalesce(c, F.lit(1.0)) * d).otherwise(0.0) for w, c, d, p in zip(weights, coverage, diverse, present)]
    return F.round(F.when(total > 0, sum(parts[1:], parts[0]) / total).otherwise(0.0), 2)


def collaboration_score(contexts: Column, years: Column, team: Column) -> Column:
    """90 for two shared contexts or two years, 65 for one context, 30 for none; null for one person alone."""
    return F.when(team < 2, None).when((contexts >= 2) | (years >= 2.0), 90.0).when(contexts == 1, 65.0).otherwise(30.0)


def institution_score(prestige: Column, outcome: Column, floor: float = 35.0) -> Column:
    """Half each of prestige and outcome; unknown institutions get the floor."""
    return F.coalesce(50 * prestige + 50 * outcome, F.lit(floor))


def in_regions(country: Column, regions: Column, members: dict[str, Sequence[str]]) -> Column:
    """Whether a country is in a list of countries and regions; an unknown country passes."""
    hit = F.array_contains(regions, country)
    for region, countries in members.items():
        hit = hit | (F.array_contains(regions, region) & country.isin(*countries))
    return country.isNull() | (F.size(regions) == 0) | hit


def call_cost(searches: Column, tokens: Column, rate: float) -> Column:
    """A cent a search, and ``rate`` a million tokens."""
    return searches * 0.01 + tokens / 1e6 * rate


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as databases do it, the scaled number to the nearest whole one: 258.4815 times 1000 lies below the
    half, while ``round`` goes by the decimal digits that are shown."""
    return F.round(c * float(10**digits)) / float(10**digits)


def rounded_share(c: Column, digits: int) -> Column:
    """``rounded`` of numbers that are not negative and have a whole part of moderate size, by the fraction of the scaled number
    and not by way of decimals, which take longer than all that a share is worked out from."""
    scaled = c * float(10**digits)
    whole = F.floor(scaled)
    return (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / float(10**digits)
