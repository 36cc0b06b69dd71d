"""Exact linear quantiles without the values in one place: counts by cells, and then by cells of the cells that hold what is asked."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024  # of each interval that is looked into


def quantiles(df: DataFrame, group: Column | str, value: Column | str, points: Sequence[float], sets: Mapping | None = None) -> dict:
    """{name: values at `points`, or None without a value} of the union of each set of groups; sets: name to groups, by default each group by itself.

    As in Spark's percentile nulls do not count and NaN is the largest. A pass counts the rows of each group by cells of the open
    intervals, at most CELLS for each rank that is still sought; the least and the greatest value of a cell bound the next pass."""
    x = F.col("x")
    rows = df.select((F.col(group) if isinstance(group, str) else group).alias("g"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).where("x IS NOT NULL")
    rows = rows.withColumn("x", F.when(x == 0, 0.0).otherwise(x))  # zeros have no sign here
    finite = F.when(F.abs(x) < float("inf"), F.signum(x) * F.log1p(F.abs(x)))
    low, high = rows.agg(F.min(finite), F.max(finite)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    wide = high - low or 1.0
    cell = F.when(F.isnan(x), CELLS + 2).when(finite.isNull(), F.when(x > 0, CELLS + 1).otherwise(-1)).otherwise(F.floor((finite - low) / wide * CELLS)).cast("int")
    found: dict[tuple, float] = {}
    sought: dict[tuple, list] = {}  # (name, rank): the groups whose rows count, and the rank within the interval it is in
    intervals: list[tuple[float, float]] | None = None
    members: Mapping[object, Collection] | None = sets
    sizes: dict = {}
    while True:
        got = rows.withColumn("c", cell).where("c IS NOT NULL").groupBy("c", "g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        cells: dict[int, dict] = {}
        bounds: dict[int, tuple[float, float]] = {}
        for c, g, n, a, b in got:
            cells.setdefault(c, {})[g] = n
            lo, hi = bounds.get(c, (a, b))
            bounds[c] = (min(lo, a), max(hi, b)) if a == a and b == b else (a, b)
        if intervals is None:
            groups = {g for c in cells.values() for g in c}
            members = {g: {g} for g in groups} if members is None else members
            sizes = {name: sum(n for c in cells.values() for g, n in c.items() if g in own) for name, own in members.items()}
            for name, n in sizes.items():
                for p in points if n else ():
                    for r in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                        sought[name, r] = [None, r]
        order = sorted(cells)
        later, narrowed = {}, []
        for (name, rank), (at, left) in sought.items():
            for c in order:
                if at is not None and c // (CELLS + 1) != at:
                    continue
                n = sum(k for g, k in cells[c].items() if g in members[name])
                if left < n:
                    break
                left -= n
            a, b = bounds[c]
            if a == b or a != a:
                found[name, rank] = a
            else:
                if (a, b) not in narrowed:
                    narrowed.append((a, b))
                later[name, rank] = [narrowed.index((a, b)), left]
        if not later:
            break
        sought, intervals = later, narrowed
        # Halves, as the width of an interval may be too large for a double; one too small for it has no values but its ends.
        inside = lambda a, b: F.least(F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * CELLS), F.lit(CELLS)) if b / 2 - a / 2 > 0 else (x > a).cast("long")
        cell = F.coalesce(*[F.when(x.between(a, b), i * (CELLS + 1) + inside(a, b)) for i, (a, b) in enumerate(intervals)]).cast("int")

    def at(name, p: float) -> float:
        where = (sizes[name] - 1) * p
        i, j = math.floor(where), math.ceil(where)
        a, b = found[name, i], found[name, j]
        return a if i == j or a == b else (j - where) * a + (where - i) * b

    return {name: [at(name, p) for p in points] if n else None for name, n in sizes.items()}
