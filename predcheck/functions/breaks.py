"""Cut points: round numbers, regular sequences, closed edges, interval labels and lookup expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the round-number rule: the bias towards larger units and towards five, the shrink factor
# for a range that is tiny next to its values, the rounding tolerance and the double precision epsilon.
BIAS, BIAS_FIVE, SHRINK, ROUNDING, EPS = 1.5, 2.75, 0.75, 1e-10, 2.0 ** -52


def spaced(lo: Column, hi: Column, n: Column) -> Column:
    """``n + 1`` evenly spaced values from ``lo`` to ``hi``, both ends exact."""
    step = (hi - lo) / n
    return F.transform(F.sequence(F.lit(0), n.cast("int")),
                       lambda i: F.when(i == 0, lo).when(i == n, hi).otherwise(lo + i * step))


def with_pretty(df: DataFrame, lo: Column, hi: Column, n: Column, name: str, min_n: int | None = None, shrink: float = SHRINK,
                bias: float = BIAS, bias_five: float | None = None) -> DataFrame:
    """Add about ``n`` intervals of width 1, 2 or 5 times a power of ten that cover ``lo``..``hi``; at least ``min_n``
    (a third of ``n``). A greater ``bias`` favours wider intervals, ``bias_five`` those of width 5."""
    bias, shrink = float(bias), float(shrink)
    bias_five = BIAS_FIVE - 1.5 * BIAS + 1.5 * bias if bias_five is None else float(bias_five)
    steps = [
        {"__lo": lo, "__hi": hi, "__n": n.cast("int")},
        {"__least": "n div 3" if min_n is None else F.lit(int(min_n)).cast("long"), "__scale": "greatest(abs(lo), abs(hi))", "__zero": "hi = lo and hi = 0"},
        # A range that is tiny next to its values gets a cell that fits the values instead.
        {"__tiny": f"zero or hi - lo < scale * {1 + 1 / (1 + bias)!r}D * greatest(1, n) * {3 * EPS!r}D", "__size": "if(zero, 1D, scale)"},
        {"__cell": f"if(tiny, if(size > 10, 9 + size / 10, size) * {shrink}D / greatest(1, least), (hi - lo) / greatest(1, n))"},
        {"__power": "pow(10D, floor(log10(cell)))"},
        {"__two": f"2 * power - cell < {bias}D * (cell - power)", "__five": f"5 * power - cell < {bias_five}D * (cell - 2 * power)",
         "__ten": f"10 * power - cell < {bias}D * (cell - 5 * power)"},
        {"__unit": "power * case when two and five and ten then 10 when two and five then 5 when two then 2 else 1 end"},
        {"__first": f"floor(lo / unit + {ROUNDING}D)", "__last": f"ceil(hi / unit - {ROUNDING}D)"},
        {"__short": "greatest(least - (last - first), 0L)", "__at": "lo = 0 and first = 0 and hi != 0"},
        {"__up": "if(at, short, short div 2 + if(first >= 0, 0, short % 2))", "__down": "if(at, 0, short div 2 + if(first >= 0, short % 2, 0))"},
        {"__from": "least(lo, (first - down) * unit)", "__to": "greatest(hi, (last + up) * unit)", "__count": "last + up - first + down"},
    ]
    own = sorted({k[2:] for step in steps for k in step}, key=len, reverse=True)
    word = re.compile(r"\b(" + "|".join(own) + r")\b(?!\()")
    out = df
    for step in steps:
        out = out.withColumns({k: F.expr(word.sub(r"__\1", v)) if isinstance(v, str) else v for k, v in step.items()})
    near_zero = 1e-14 * (F.col("__to") - F.col("__from")) / F.col("__count")
    values = F.transform(spaced(F.col("__from"), F.col("__to"), F.col("__count")),
                         lambda s: F.when(F.abs(s) < near_zero, 0.0).otherwise(s))
    return out.withColumn(name, values).drop(*["__" + c for c in own])


def closed_edges(breaks: Column, lo: Column, hi: Column) -> Column:
    """Sorted distinct breaks, extended to the data range where the range goes beyond them."""
    inner = F.array_sort(F.array_distinct(breaks))
    below = F.when(lo < F.element_at(inner, 1), F.array(lo)).otherwise(F.array().cast("array<double>"))
    above = F.when(hi > F.element_at(inner, -1), F.array(hi)).otherwise(F.array().cast("array<double>"))
    edges = F.concat(below, inner, above)
    # One value only: a single closed interval [v, v].
    return F.when(F.size(edges) == 1, F.array_repeat(F.element_at(edges, 1), 2)).otherwise(edges)


#: Arrays of at most this many elements are looked through, longer ones are halved; LONGEST is the longest array that can be.
LINEAR, LONGEST = 24, 1 << 24


def passed(sorted_values: Column, test: Callable[[Column], Column], longest: int = LONGEST) -> Column:
    """How many elements pass ``test``, which holds for a first part of the array: log2(longest) reads of a long array."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(longest.bit_length()))])
    halved = F.aggregate(steps, F.lit(0), lambda at, step: F.when(test(F.get(sorted_values, at + step - 1)), at + step).otherwise(at))
    return F.when(F.size(sorted_values) <= LINEAR, F.size(F.filter(sorted_values, test))).otherwise(halved)


def interval(x: Column, edges: Column, right: bool = False) -> Column:
    """1-based interval of ``x``; the outer interval is closed on both sides."""
    below = passed(edges, (lambda e: e < x) if right else (lambda e: e <= x))
    return F.when(x.isNotNull() & edges.isNotNull(), F.greatest(F.lit(1), F.least(below, F.size(edges) - 1)))


def closest(x: Column, centers: Column) -> Column:
    """The nearest of sorted centres; the lower one on a tie."""
    best = F.array_min(F.transform(centers, lambda c: F.struct(F.abs(x - c).alias("d"), c.alias("c"))))["c"]
    at = passed(centers, lambda c: c < x)
    least = F.least(F.abs(x - F.get(centers, at - 1)), F.abs(x - F.get(centers, at)))
    halved = F.get(centers, passed(centers, lambda c: x - c > least))  # rounding can make more than two equally near
    return F.when(x.isNotNull(), F.when(F.size(centers) <= LINEAR, best).otherwise(halved))


def interval_labels(edges, right: bool = False) -> list[str]:
    """``[a,b)`` labels with as few significant digits (3 to 12) as keep all edges apart."""
    edges = [float(e) for e in edges]
    count = len(edges) - 1
    if count == 1 and edges[0] == edges[1]:
        return [f"[{edges[0]:.3g},{edges[1]:.3g}]"]
    for digits in range(3, 13):
        text = [f"{e:.{digits}g}" for e in edges]
        if len(set(text)) == len(text):
            break
    else:
        return [f"Range_{i}" for i in range(1, count + 1)]
    labels = []
    for i in range(count):
        open_left = right and i > 0
        open_right = not right and i < count - 1
        labels.append(f"{'(' if open_left else '['}{text[i]},{text[i + 1]}{')' if open_right else ']'}")
    return labels


def labels_column(edges: Column, right: bool = False) -> Column:
    """Labels for a column of edge arrays: one row per stratum, never one per data row."""
    @F.pandas_udf("array<string>")
    def build(series: pd.Series) -> pd.Series:
        return series.map(lambda e: None if e is None else interval_labels(e, right))
    return build(edges)
