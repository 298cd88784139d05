"""Integer vectors for clustering and compression: what is usable, rounding down, exact nearest entries, and joins that spread hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magnitude up to which integer components are taken: sums of squared differences of some hundred of them fit in 64 bits.
MOST = 1 << 27
#: A key is hot with more rows than this part of all. Less than HOT keys are.
HOT = 4096
_AT_ONCE = 1 << 20  # products held at once


def finite(v: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    fine = F.forall(F.transform(v, lambda c: c.cast("double")), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def integers(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double. Components beyond MOST stop the job with a message."""
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    far = F.exists(x, lambda c: (c > MOST) | (c < -MOST))
    said = F.raise_error(F.lit(f"a vector has a component whose {scale}-fold is beyond {MOST}"))
    return F.when(far, said.cast("array<int>")).otherwise(F.transform(x, lambda c: F.when(c.between(-MOST, MOST), c).cast("int")))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the first of equals, and its squared distance; exact."""
    code, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    exact = 4 * x.shape[1] * int(most) ** 2 < 1 << 53  # sums of products are then whole numbers that a double holds
    step = max(1, _AT_ONCE // max(1, len(entries) if exact else entries.size))
    e = entries.astype(np.float64) if exact else entries.astype(np.int64)
    own = (e * e).sum(1)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step].astype(e.dtype)
        d = own - 2 * (part @ e.T) + (part * part).sum(1)[:, None] if exact else ((part[:, None, :] - e) ** 2).sum(2)
        best = d.argmin(1)
        code[lo : lo + step], distance[lo : lo + step] = best, d[np.arange(len(part)), best]
    return code, distance


def spread(rows: DataFrame, keys: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """``rows`` with what ``keys``, stored and one row for each key with its number of rows, says of their key, null as a value.

    The keys that hold more than one row of HOT are fewer than HOT, whatever the tables' size: those are broadcast, and
    the rest is shuffled, so that no task gets more of one key than that part."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total // HOT
    more = [c for c in keys.columns if c not in (*on, count)]
    sides = []
    for side in (F.broadcast(keys.filter(hot)), keys.filter(~hot)):
        named = side.select(*[F.col(c).alias(f"_{c}") for c in on], *[F.col(c).alias(f"_{c}") for c in more])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
        own = rows if not sides else rows.join(F.broadcast(keys.filter(hot).select(*[F.col(c).alias(f"_{c}") for c in on])), same, "left_anti")
        sides.append(own.join(named, same).select(*rows.columns, *[F.col(f"_{c}").alias(c) for c in more]))
    return sides[0].unionByName(sides[1])
