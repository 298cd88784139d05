"""Column functions shared by the analytics: names, money, dates, confidence, concentration, bands, strength."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import schema


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int = 0) -> Column:
    """Rounded half up, where a double a millionth of the last digit below a tie counts as the tie: the same in any
    engine with IEEE doubles, whatever order sums were taken in. Beyond 1e12 the double itself."""
    x, scale = _c(x).cast("double"), float(10**digits)
    return F.when(F.abs(x) < 1e12, F.floor(x * scale + 0.500001) / scale).otherwise(x)


def canonical(name) -> Column:
    """Trimmed, lower-cased, white space collapsed; Unicode white space counts."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(name), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def uid(prefix: str, number) -> Column:
    """PREFIX-%08d."""
    return F.format_string(f"{prefix}-%08d", _c(number).cast("long"))


def relation_id(source, kind, target) -> Column:
    """The first 16 hex digits of SHA-256 of ``source:kind:target``."""
    return F.substring(F.sha2(F.concat_ws(":", _c(source), _c(kind), _c(target)), 256), 1, 16)


def is_kind(column, *kinds: str) -> Column:
    """Whether a uid is of one of these node kinds; the prefix tells."""
    return F.substring(_c(column), 1, 3).isin([schema.PREFIXES[k] for k in kinds])


def truthy(x) -> Column:
    """The text, or null where it is empty, ``0`` or ``0.0``: what a chain of alternatives passes over."""
    x = _c(x)
    return F.when((x != "") & ~x.rlike(r"^[+-]?0+(\.0*)?$"), x)


def first_truthy(attributes, *keys: str) -> Column:
    a = _c(attributes)
    return F.coalesce(*[truthy(a[k]) for k in keys])


def money(x) -> Column:
    """Text to double, of which only digits and dots count: the sign is lost; null if that is no number."""
    return F.regexp_replace(_c(x).cast("string"), r"[^0-9.]", "").try_cast("double")


def number(x) -> Column:
    """Text to double where it is a plain number, else null; money with letters or commas is null."""
    x = F.regexp_replace(F.trim(_c(x).cast("string")), r"(?<=\d)_(?=\d)", "")
    return F.when(x.rlike(r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf(inity)?)$"), x.try_cast("double"))


def year(date) -> Column:
    return F.substring(_c(date), 1, 4).try_cast("int")


def month(date) -> Column:
    return F.substring(_c(date), 6, 2).try_cast("int")


def confidence(n) -> Column:
    """min(1, 0.3 + 0.07 min(10, n))."""
    return rounded(F.least(F.lit(1.0), 0.3 + 0.07 * F.least(F.lit(10), _c(n))), 4)


def ratio(a, b, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0 or null."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.coalesce(rounded(F.when(b != 0, a / b), digits), F.lit(0.0))


def hhi(count) -> Column:
    """Aggregate: sum of squared shares, 0 of nothing."""
    c = _c(count).cast("double")
    return F.coalesce(rounded(F.when(F.sum(c) != 0, F.sum(c * c) / F.pow(F.sum(c), F.lit(2.0))), 4), F.lit(0.0))


def concentration(h) -> Column:
    h = _c(h)
    return F.when(h >= 0.25, "highly_concentrated").when(h >= 0.15, "moderately_concentrated").otherwise("competitive")


def bands(x, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first step that ``x`` reaches."""
    out = F
    for limit, label in steps:
        out = out.when(_c(x) >= limit, label)
    return out.otherwise(otherwise)


BUYER_BUCKETS = (("micro", 10_000), ("small", 100_000), ("medium", 1_000_000), ("large", 10_000_000), ("mega", None))
OPPORTUNITY_BUCKETS = (("micro", 25_000), ("small", 250_000), ("medium", 2_500_000), ("large", 25_000_000), ("mega", None))


def buyer_bucket(value) -> Column:
    """Half-open value bands; a negative value has none."""
    v = _c(value)
    out = F.when(v < 0, F.lit(None))
    for name, limit in BUYER_BUCKETS[:-1]:
        out = out.when(v < limit, name)
    return out.when(v.isNotNull(), "mega")


def opportunity_bucket(value) -> Column:
    """Half-open value bands of another scale; a negative value is in the last."""
    v = _c(value)
    out = F.when(v < 0, "mega")
    for name, limit in OPPORTUNITY_BUCKETS[:-1]:
        out = out.when(v < limit, name)
    return out.when(v.isNotNull(), "mega")


def months_until(date, as_of: str) -> Column:
    """Days from ``as_of`` to the date's first ten characters, in months of 30.44 days; null for no date."""
    return rounded(F.datediff(F.try_to_date(F.substring(_c(date), 1, 10), "yyyy-MM-dd"), F.lit(as_of).cast("date")) / 30.44, 1)


def weight(kind) -> Column:
    """Weight of an edge kind as evidence."""
    table = F.create_map(*[F.lit(x) for pair in schema.WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _c(kind)), F.lit(schema.DEFAULT_WEIGHT))


def strength(weights) -> Column:
    """Array of weights to min(1, sum of w_i 0.7^i), the largest first."""
    w = F.sort_array(_c(weights), asc=False)
    powered = F.transform(w, lambda x, i: x * F.pow(F.lit(0.7), i.cast("double")))
    return rounded(F.least(F.lit(1.0), F.aggregate(powered, F.lit(0.0), lambda a, x: a + x)), 4)


def equal_strength(n, w: float = schema.DEFAULT_WEIGHT) -> Column:
    """Strength of ``n`` pieces of evidence of one weight: the closed form of the geometric sum."""
    return rounded(F.least(F.lit(1.0), F.lit(w) * (1 - F.pow(F.lit(0.7), _c(n).cast("double"))) / F.lit(0.3)), 4)


def strength_confidence(s, n) -> Column:
    return rounded(F.least(F.lit(1.0), 0.5 * _c(s) + 0.5 * F.least(F.lit(1.0), _c(n) / 3.0)), 4)


def evidence(uid_, kind, name, relation) -> Column:
    return F.struct(_c(uid_).alias("uid"), _c(kind).alias("kind"), _c(name).alias("name"), _c(relation).alias("relation"))


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as a regular expression of the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return f"^{out}$"
