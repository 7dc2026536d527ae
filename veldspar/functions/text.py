"""Text, date, vector and value functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value patterns, fixed values: each must match a whole sample.
EMAIL, PHONE = r"^[\w\.-]+@[\w\.-]+\.\w+$", r"^[\d\s\-\+\(\)]{7,}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def week_bucket(ts: Column) -> Column:
    """Year and Monday-first week of year 00 to 53."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.format_string("%d-%02d", F.year(ts), week)


def time_bucket(ts: Column, period: str) -> Column:
    if period == "week":
        return week_bucket(ts)
    return F.date_format(ts, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[period])


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-]+", "_")


def unigrams(text: Column) -> Column:
    """Lower-cased words of [a-z0-9_]."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " ")), r"\s+")
    return F.filter(words, lambda w: w != "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once a row, however often then refers to it, inner lambdas included."""
    return F.element_at(F.transform(F.array(value), then), 1)


def terms(text: Column) -> Column:
    """Words and adjacent pairs joined by an underscore."""

    def with_pairs(words: Column) -> Column:
        n = F.size(words)
        pairs = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(words, pairs)

    return once(unigrams(text), with_pairs)


#: One letter, digit or underscore of any script; a form that Java's and RE2's patterns read alike.
RUN = r"[\p{L}\p{N}_]"


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters whose decomposition is one plain character, and those characters."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(point):
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents, and combining marks gone."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")


def ngrams(words: Column, most: int = 3) -> Column:
    """1 to most neighbouring words of an array, space-joined."""
    none = F.array().cast("array<string>")

    def runs(words: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))

    def every(words: Column) -> Column:
        return F.concat(words, *[F.when(F.size(words) >= n, runs(words, n)).otherwise(none) for n in range(2, most + 1)])

    return once(words, every)


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct words of least or more of a-z and underscores, with no letter or digit of any script at either end."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"({RUN}+)"), 1)
    return F.array_distinct(F.filter(runs, lambda w: w.rlike(f"^[a-z_]{{{least},}}$")))


def canonical_json(names: list[str]) -> Column:
    """A row as JSON with sorted keys, no spaces, ASCII only and nulls."""
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(names)]), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})


def char_grams(name: Column, n: int = 2) -> Column:
    """Distinct character n-grams of a name's parts; parts shorter than n stay whole."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"[_\-.]", " "), r"\s+"), lambda p: p != "")
    grams = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) < n, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: p.substr(i, F.lit(n))))))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of numbers; 0 if one is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def canonical(value: Column, kind: str) -> Column:
    """A value's canonical text: sentinels for null, NaN and empty; trimmed strings; lower-case booleans; plain numbers, infinite ones and those that six places can't hold as Spark prints them."""
    if kind in ("double", "float"):
        text = F.when(F.isnan(value), "__NAN__").when(F.abs(value) >= 1e30, value.cast("string")).otherwise(F.round(value, 6).cast("decimal(38,6)").cast("string"))
    elif kind == "string":
        text = F.when(F.trim(value) == "", "__EMPTY__").otherwise(F.trim(value))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("__NULL__"))


def all_match(samples: Column, pattern: str) -> Column:
    return (F.size(samples) > 0) & F.forall(samples, lambda s: F.lower(s).rlike(pattern))


#: Status vocabulary, fixed values.
STATUSES = "active inactive pending completed cancelled approved rejected open closed new processing shipped delivered failed success enabled disabled true false".split()


def value_pattern(samples: Column) -> Column:
    """email, phone, uuid or status if every sample matches; else null. Phones need a digit."""
    status = (F.size(samples) > 0) & F.forall(samples, lambda s: F.lower(s).isin(*STATUSES))
    return F.when(all_match(samples, UUID), "uuid").when(all_match(samples, EMAIL), "email").when(all_match(samples, PHONE), "phone").when(status, "status")
