"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 6) -> Column:
    """Half-up rounding, also below zero."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def r6(x: Column) -> Column:
    return F.round(x, 6)


def exact_avg(x: Column) -> Column:
    """A mean that no order of rows changes: values to twelve digits are summed exactly, their high and low bits apart, and divided once."""
    v = F.floor(x * 1e12 + 0.5)
    high, low = F.sum(F.shiftright(v, 20)).cast("decimal(20,0)"), F.sum(v.bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)")
    return (high * F.lit(1 << 20).cast("decimal(7,0)") + low).cast("double") / (F.count(x) * F.lit(1e12))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def path_score(average: Column, least_weight: Column, hops: Column) -> Column:
    """Average confidence, dampened by the weakest edge's weight and the number of hops."""
    return average * F.log1p(least_weight) / (1 + 0.1 * (hops - 1))


def support_boost(n: Column, boost: float = 0.3) -> Column:
    """What n independent sources add to a confidence."""
    return F.when(n > 1, 1 - F.pow(F.lit(1 - boost), n - 1)).otherwise(0.0)


#: Words that end a class name and say nothing of its subject.
NAME_SUFFIXES = ("service", "controller", "entity", "repository", "repo", "dao", "dto", "handler", "manager", "provider", "component", "module", "mapper")


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a camelCase, kebab, snake, dotted or spaced name, of two letters or more, without NAME_SUFFIXES."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*NAME_SUFFIXES)))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def segments(path: Column) -> Column:
    """Path segments with placeholders ({x}, ${x}, :x) as {*}."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike(r"^(\$?\{.*\}|:.+|\*+)$"), "{*}").otherwise(F.lower(s)),
    )


def dynamic_segment(s: Column) -> Column:
    """Digits, long hex strings, UUIDs, and segments that mix digits and letters."""
    return s.rlike("^[0-9]+$") | s.rlike("^[0-9a-f]{24}$") | s.rlike("^[0-9a-f]{32,}$") | (s.rlike("[0-9]") & s.rlike("[a-z]"))


def path_compatibility(call: Column, endpoint: Column) -> Column:
    """How well a called path (segments) fits an endpoint's (segments), 0 to 1."""
    shared = F.least(F.size(call), F.size(endpoint))
    gap = F.abs(F.size(call) - F.size(endpoint))

    def fit(c: Column, e: Column) -> Column:
        return (
            F.when(c.isNull() | e.isNull(), -0.4)
            .when(e == "{*}", F.when((c == "{*}") | dynamic_segment(c), 0.9).otherwise(0.5))
            .when(c == "{*}", 0.7)
            .when(c == e, 1.0)
            .otherwise(-0.4)
        )

    def total(c: Column, e: Column) -> Column:
        n = F.size(endpoint)
        return F.aggregate(F.zip_with(F.slice(c, 1, n), e, fit), F.lit(0.0), lambda a, x: a + x)

    score = F.greatest(F.lit(0.0), total(call, endpoint) / F.greatest(F.lit(1), shared) - 0.2 * gap)
    stem = F.size(endpoint) - 1
    wild = (F.size(endpoint) > 0) & (F.element_at(endpoint, -1) == "{*}")
    prefix = F.when(F.slice(call, 1, F.greatest(stem, F.lit(0))) == F.slice(endpoint, 1, F.greatest(stem, F.lit(0))), 0.55).otherwise(0.0)
    return (
        F.when((F.size(call) == 0) & (F.size(endpoint) == 0), 1.0)
        .when(wild & (F.size(call) != F.size(endpoint)), prefix)
        .when(gap > 1, 0.0)
        .otherwise(score)
    )


def cursor(offset: Column) -> Column:
    """URL-safe base64 of an offset, without padding."""
    return F.translate(F.base64(offset.cast("string").cast("binary")), "+/=", "-_")
