"""Nested attributes: entities whose attributes are VARIANT values, asked for by path and by containment, with keys that are
asked for often kept as typed columns beside them, where filters reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "attr_"  # of promoted columns


def _quoted(key: str) -> str:
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


def at(v: Column, *keys: str | int, as_: str = "variant") -> Column:
    """What stands at a path of object keys and array positions, as a type; null where there is none or it is of another type.

    A key may hold any characters but a quote."""
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"[{_quoted(k)}]" for k in keys)
    return F.try_variant_get(v, path, as_)


def _is(v: Column, *names: str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.schema_of_variant(v).startswith(n) for n in names]), F.lit(False))


def contains(v: Column, wanted) -> Column:
    """Whether a VARIANT holds a value of dictionaries, lists and scalars: an object all the keys, each with a value that holds the
    wanted one; an array for each wanted element one that holds it, in any order; a scalar an equal one. A number equals
    a number of the same value, never a text, and a wanted null only a JSON null. Without a value it holds nothing."""
    if isinstance(wanted, dict):
        return reduce(lambda a, b: a & b, [contains(at(v, k), x) for k, x in wanted.items()], _is(v, "OBJECT"))
    if isinstance(wanted, (list, tuple)):
        own = F.try_variant_get(v, "$", "array<variant>")
        some = lambda x: F.coalesce(F.exists(own, lambda e: contains(e, x)), F.lit(False))
        return reduce(lambda a, b: a & b, [some(x) for x in wanted], _is(v, "ARRAY"))
    if wanted is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(wanted, bool):
        return F.coalesce(F.try_variant_get(v, "$", "boolean") == wanted, F.lit(False)) & _is(v, "BOOLEAN")
    if isinstance(wanted, (int, float)):
        return F.coalesce(F.try_variant_get(v, "$", "double") == float(wanted), F.lit(False)) & _is(v, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.coalesce(F.try_variant_get(v, "$", "string") == str(wanted), F.lit(False)) & _is(v, "STRING")


def write(df: DataFrame, folder: str, hot: dict[str, str], attributes: str = "attributes") -> None:
    """Writes rows whose ``attributes`` are JSON text, as VARIANT, with hot keys (name: type) as columns too. Text that is no JSON
    becomes null. A key's column is null where its value is of another type, and finds nothing then; see ``find``."""
    v = F.try_parse_json(F.col(attributes))
    out = df.withColumn(attributes, v)
    out = out.withColumns({PREFIX + k: _typed(F.col(attributes), k, t) for k, t in hot.items()})
    out.write.parquet(folder)


def _typed(v: Column, key: str, kind: str) -> Column:
    """The key's value if it is of the kind that containment would ask for: a text that looks like a number is none."""
    own = at(v, key)
    names = ("STRING",) if kind == "string" else ("BOOLEAN",) if kind == "boolean" else ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(_is(own, *names), F.try_variant_get(own, "$", kind))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def find(df: DataFrame, wanted: dict, attributes: str = "attributes") -> DataFrame:
    """Rows whose attributes hold ``wanted``, without the promoted columns. Scalars of promoted keys are compared with the columns,
    which reaches the scan, in place of the VARIANT."""
    kinds = dict(df.dtypes)
    hot = {k: x for k, x in wanted.items() if PREFIX + k in kinds and _suits(x, kinds[PREFIX + k])}
    rest = {k: x for k, x in wanted.items() if k not in hot}
    for k, x in hot.items():
        df = df.filter(F.col(PREFIX + k) == F.lit(x))
    out = df.filter(contains(F.col(attributes), rest)) if rest or not hot else df
    return out.drop(*[c for c in df.columns if c.startswith(PREFIX)])


def _suits(x, kind: str) -> bool:
    """Whether a wanted scalar is of the promoted column's type, so that both ways of asking say the same."""
    if isinstance(x, bool) or kind == "boolean":
        return isinstance(x, bool) and kind == "boolean"
    return isinstance(x, str) and kind == "string" or isinstance(x, (int, float)) and kind == "double"
