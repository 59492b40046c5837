"""Assigning observations to bins, per stratum or pooled.

``fit_bins`` reads the data once or twice and keeps one small table of cut points, centres or thresholds per
stratum; ``BinModel.transform`` joins that table to the rows (broadcast when its counted size allows) and
evaluates a row-wise expression. The rows of a stratum are never brought together, so a stratum that holds
most of the data costs no more than the others.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.breaks import closed_edges, closest, interval, labels_column, passed, spaced, with_pretty
from ..functions.quantiles import grouped_quantiles, select_ranks, steps_within_groups
from ..functions.values import as_column, as_double, null_safe_join, number_text
from ..plans.storage import compact, materialize, small, split_rows
from . import clusters
from .align import dense_index
from .states import Mergeable, merged

# The interval styles and the other method names.
STYLES = ("fixed", "sd", "equal", "pretty", "quantile", "kmeans", "hclust", "bclust", "fisher", "jenks", "dpih")
METHODS = ("centers", "breaks", "ntile", "eqcut", "pam", *STYLES)
CLUSTERED = ("pam", "kmeans", "hclust", "bclust", "fisher", "jenks")
# What each method takes beside its main parameter.
OPTIONS = {"fixed": {"fixedBreaks"}, "quantile": {"type"}, "pretty": {"min_n", "shrink", "bias", "bias_five"}, "hclust": {"linkage"},
           "bclust": {"seed", "iter_base", "base_centers"}, "dpih": {"gridsize"}}
NO_STRATUM = "strata with missing values can't be used"
NEEDS = {"centers": "centers", "breaks": "breaks", "ntile": "nbins", "eqcut": "nbins", "pam": "nbins"}

BIN_COLUMNS = ("bin", "bin_num", "bin_left", "bin_right")
POOLED = "__all"


@dataclass(frozen=True)
class BinRule:
    """One binning request: a ``method`` by name, a ``column`` that is the bin, or a user ``func``.

    ``func(x, **values)`` gets the x column, the stratum columns and the per-stratum aggregates named in
    ``stats``, and returns a Column. With ``grouped=True`` it gets, per stratum, pandas Series ``x`` (distinct
    values) and ``n`` (their counts) and the stratum values, and returns one bin per distinct value. A ``Mergeable`` sees all values of a stratum, however
    many, in states that are merged; it finishes with the breaks of the stratum.
    """

    method: str | None = None
    column: Any = None
    func: Callable | None = None
    nbins: Any = None
    centers: Any = None
    breaks: Any = None
    stats: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    grouped: bool = False
    x: Any = None
    stratum: Any = None
    by_strata: bool = True
    right: bool = False
    quantile_type: int = 7
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if sum(v is not None for v in (self.method, self.column, self.func)) != 1:
            raise ValueError("give exactly one of a bin column, a method and a function")
        if self.method is not None:
            if self.method not in METHODS:
                raise ValueError(f"no such binning method: {self.method}")
            unknown = set(self.options) - OPTIONS.get(self.method, set())
            if unknown:
                raise ValueError(f"{self.method} does not know {', '.join(sorted(unknown))}")
        elif self.func is None and self.options:
            raise ValueError(f"a bin column takes no {', '.join(sorted(self.options))}")
        if isinstance(self.func, Mergeable) and (self.grouped or self.stats or self.options):
            raise ValueError("a Mergeable takes no grouped, stats or further arguments")
        if self.method is not None:
            needed = NEEDS.get(self.method)
            if needed and getattr(self, needed) is None:
                raise ValueError(f"method {self.method} needs {needed}")
            if self.method == "fixed" and self.options.get("fixedBreaks") is None:
                raise ValueError("method fixed needs fixedBreaks")
        for name in ("centers", "breaks", "nbins"):
            value = getattr(self, name)
            if isinstance(value, DataFrame):
                if not self.by_strata:
                    raise ValueError(f"a table of {name} has rows by stratum, so bins can't be pooled")
                if name not in value.columns:
                    raise ValueError(f"the table given as {name} has no column {name}")
            elif name != "nbins" and value is not None:
                if isinstance(value, (str, Column)) or any(v is None or v != v for v in value):
                    raise ValueError(f"{name} must be numbers without missing values, or a DataFrame")
        if self.stratum is not None:
            if not isinstance(self.stratum, (dict, list, tuple, DataFrame)):
                raise ValueError("stratum must be a dict, a list of dicts or a DataFrame")
            if not self.by_strata:
                raise ValueError("bins of chosen strata can't be pooled")


# ---------------------------------------------------------------------------------------------- parameters

def _selected(table: DataFrame, rule: BinRule, strata: Sequence[str]) -> DataFrame:
    """The strata a rule applies to."""
    chosen = rule.stratum
    if chosen is None:
        return table
    if isinstance(chosen, DataFrame):
        return null_safe_join(table, chosen, list(chosen.columns), "left_semi")
    keep = F.lit(False)
    for level in [chosen] if isinstance(chosen, dict) else chosen:
        unknown = set(level) - set(strata)
        if unknown:
            raise ValueError(f"stratum names unknown columns: {sorted(unknown)}")
        match = F.lit(True)
        for name, value in level.items():
            match = match & F.col(name).isin(list(value) if isinstance(value, (list, tuple, set)) else [value])
        keep = keep | match
    return table.filter(keep)


def _lookup(table: DataFrame, params: DataFrame, name: str) -> DataFrame:
    """Attach a parameter keyed by any subset of the strata; it must be found, and ``nbins`` be unique."""
    keys = [c for c in params.columns if c != name]
    unknown = set(keys) - set(table.columns)
    if unknown or not keys:
        raise ValueError(f"{name} table must be keyed by strata, not by {sorted(unknown)}")
    single = name == "nbins"
    value = F.sort_array(F.collect_set(F.col(name).cast("int"))) if single else F.collect_list(F.col(name).cast("double"))
    bad = F.count_if(F.col(name).isNull() | F.isnan(F.col(name).cast("double")))
    joined = null_safe_join(table, params.groupBy(*keys).agg(value.alias(name), bad.alias("__bad")), keys)
    wrong = F.col(name).isNull() | (F.col("__bad") > 0)
    if joined.filter(wrong | (F.size(name) != 1) if single else wrong).limit(1).count():
        raise ValueError("every stratum needs exactly one nbins" if single else f"missing or non-numeric {name} in the table")
    joined = joined.drop("__bad")
    return joined.withColumn(name, F.element_at(name, 1)) if single else joined


def _with_parameter(table: DataFrame, rows: DataFrame, strata: list[str], rule: BinRule, name: str) -> DataFrame:
    value = rule.options.get("fixedBreaks") if rule.method == "fixed" else getattr(rule, name)
    if isinstance(value, DataFrame):
        return _lookup(table, value, name)
    if name != "nbins":
        return table.withColumn(name, F.array(*[F.lit(float(v)) for v in value]))
    if value is None:
        # Default of the interval styles: log2 of the number of values, plus one, rounded up.
        return table.withColumn(name, F.ceil(F.log2(F.col("n_all")) + 1).cast("int"))
    if isinstance(value, (str, Column)):
        return _lookup(table, rows.select(*strata, as_column(value).cast("int").alias(name)).distinct(), name)
    return table.withColumn(name, F.lit(int(value)))


# ------------------------------------------------------------------------------------------------- methods

def _least_bins(table: DataFrame, rule: BinRule) -> int | None:
    """The smallest number of bins in use; None without strata."""
    return int(rule.nbins) if isinstance(rule.nbins, (int, float)) else table.agg(F.min("nbins")).first()[0]


def _quantile_breaks(rows, strata, table, rule, qtype, largest, closed):
    """Breaks at i/nbins, the ends included for ``closed``; ``nbins`` may differ between strata."""
    least = _least_bins(table, rule)
    if least is not None and least < 1:
        raise ValueError("nbins must be at least 1")
    if isinstance(rule.nbins, (int, float)):
        k = least  # one bin has no inner quantile; both ends then make one closed bin
        probs = [i / k for i in range(k + 1)] if closed or k == 1 else [i / k for i in range(1, k)]
        found = grouped_quantiles(rows, strata, "__x", probs, qtype, largest=largest).drop("n")
    else:
        found = steps_within_groups(rows, strata, "__x", table.select(*strata, F.col("nbins").alias("k"), "n"), closed, qtype, largest)
    return null_safe_join(table, found, strata).withColumnRenamed("q", "breaks")


def _rank_starts(rows, strata, table, largest):
    """(strata, __x, __id, __b): the first row of every rank group but the first.

    Of n values in k groups, rank r (ties in id order) belongs to group ``k*(r-1) div n + 1``.
    """
    data = rows.filter(F.col("__x").isNotNull()).select(*strata, "__x", "__id")
    sizes = table.select(*strata, F.col("nbins").cast("long").alias("k"), "n")
    if largest <= split_rows(rows.sparkSession):
        w = Window.partitionBy(*strata).orderBy("__x", "__id")
        ranked = data.withColumn("r", F.row_number().over(w).cast("long"))
        return null_safe_join(ranked, F.broadcast(sizes), strata, "inner") \
            .filter("r > 1 and k * (r - 1) div n > k * (r - 2) div n") \
            .select(*strata, "__x", "__id", F.expr("k * (r - 1) div n + 1").alias("__b"))

    # Group b + 1 starts at rank ceil(b * n / k) + 1: find the value there, then the id among its ties.
    starts = sizes.filter("k > 1").select(*strata, "k", "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("b"))
    starts = starts.select(*strata, F.expr("(b * n + k - 1) div k + 1").alias("r"), F.col("b"), "n").filter("r <= n")
    starts = materialize(starts.groupBy(*strata, "r").agg((F.max("b") + 1).alias("__b")))
    data = materialize(data)
    at = materialize(select_ranks(data, strata, "__x", starts, largest).withColumnRenamed("v", "__t"))
    points = F.broadcast(at.groupBy(*strata).agg(F.sort_array(F.collect_set("__t")).alias("__ts")))
    near = null_safe_join(data, points, strata, "inner").select(
        *strata, "__x", "__id", F.array_contains("__ts", F.col("__x")).alias("tie"),
        F.expr("size(filter(__ts, t -> t < __x))").alias("s"))
    spans = near.groupBy(*strata, "s").agg(F.count(F.lit(1)).alias("c"), F.count_if("tie").alias("tied"),
                                           F.max(F.when(F.col("tie"), F.col("__x"))).alias("__t"))
    upto = F.sum("c").over(Window.partitionBy(*strata).orderBy("s"))
    spans = spans.withColumn("below", upto - F.col("tied")).filter("__t is not null")
    local = null_safe_join(at, spans.select(*strata, "__t", "below", "tied"), [*strata, "__t"], "inner")
    local = materialize(local.select(*strata, "__t", F.col("r").alias("rank"), (F.col("r") - F.col("below")).alias("r")))
    # The ties of one value may be a large share of the data: number them all at once, whatever the type of the id.
    ties = dense_index(near.filter("tie").select(*strata, F.col("__x").alias("__t"), "__id"), [*strata, "__t", "__id"], "__at")
    firsts = ties.groupBy(*strata, "__t").agg(F.min("__at").alias("first"))
    places = null_safe_join(local, firsts, [*strata, "__t"], "inner") \
        .select(*strata, "__t", "rank", F.expr("first + r - 1 as __at"))
    found = places.join(ties.select("__at", "__id"), "__at").drop("__at")
    starts = starts.withColumnRenamed("r", "rank")
    return null_safe_join(found, starts, [*strata, "rank"], "inner") \
        .select(*strata, F.col("__t").alias("__x"), "__id", "__b")


def _grouped_function(rows, strata, rule):
    """(strata, __x, bin, bin_num) from a user function over the distinct values of each stratum."""
    values = rows.groupBy(*strata, "__x").agg(F.count(F.lit(1)).alias("n"))
    most = values.groupBy(*strata).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0
    if most > split_rows(rows.sparkSession):
        raise ValueError("too many distinct values for a grouped bin function; give a Mergeable or the Column form")
    schema = T.StructType([rows.schema[s] for s in strata] + [
        T.StructField("__x", T.DoubleType()), T.StructField("bin", T.StringType()), T.StructField("bin_num", T.DoubleType())])
    names = [s for s in strata if s != POOLED]
    func, options = rule.func, rule.options

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x").reset_index(drop=True)
        got = list(func(pdf["__x"], pdf["n"], **{s: pdf[s].iloc[0] for s in names}, **options))
        if len(got) != len(pdf):
            raise ValueError("a bin function gives one bin for each value it gets")
        num = pd.to_numeric(pd.Series(got), errors="coerce").astype(float)
        text = [None if g is None or g != g else g if isinstance(g, str) else f"{g:.15g}" for g in got]
        return pd.DataFrame({**{s: pdf[s] for s in strata}, "__x": pdf["__x"], "bin": text, "bin_num": num})

    return values.groupBy(*strata).applyInPandas(run, schema)


# ------------------------------------------------------------------------------------------ fit / transform

@dataclass(frozen=True)
class BinModel:
    """A fitted rule: one stored row of cuts per stratum, ready to be applied to any number of rows."""

    rule: BinRule
    strata: list[str]
    table: DataFrame
    rows: int
    #: Rows of the largest stratum, hence an upper bound for the rows of a bin; None when nothing was counted.
    largest: int | None = None
    #: Estimated size of a row of the table.
    row_bytes: int = 1024

    def transform(self, df: DataFrame, x: str = "__x", id: str = "__id", column: str = "__bin") -> DataFrame:
        """Add bin, bin_num, bin_left and bin_right. Bins already there stay where the rule does not apply."""
        rule, table = self.rule, self.table
        keys = self.strata
        pooled = keys == [POOLED]
        if rule.grouped:
            mapping = table.withColumnsRenamed({"__x": "__mx", "bin": "__mb", "bin_num": "__mn"})
            by = ["__mx"] if pooled else [*keys, "__mx"]
            joined = null_safe_join(df.withColumn("__mx", F.col(x)), small(mapping, self.rows), by).drop("__mx")
            hit = F.col("__hit").isNotNull()
        elif rule.stratum is None and rule.column is not None:
            joined, hit = df, F.lit(True)
        else:
            if pooled:  # one row of cuts for all the data, sent to every task like any table of cuts
                df = df.withColumn(POOLED, F.lit(0))
            joined = null_safe_join(df, small(table, self.rows, self.row_bytes), keys)
            hit = F.col("__hit").isNotNull()
        if self._cut:  # the lookup is done once for all columns made from it
            joined = joined.withColumn("__i", interval(F.col(x), F.col("__cuts"), rule.right and rule.method in ("breaks", None)))
        made = self._expressions(joined, F.col(x), F.col(id), column)
        if "bin" in df.columns:
            made = {c: F.when(hit, e).otherwise(F.col(c)) for c, e in made.items()}
        out = joined.withColumns(made)
        extra = [c for c in out.columns if c not in df.columns and c not in BIN_COLUMNS]
        return out.drop(*extra, POOLED)

    @property
    def _cut(self) -> bool:
        """Whether bins are intervals between cuts."""
        return isinstance(self.rule.func, Mergeable) or self.rule.method not in (None, "centers", "pam", "ntile")

    def _expressions(self, df, x, id, column) -> dict[str, Column]:
        rule = self.rule
        none = F.lit(None).cast("double")
        if rule.grouped:
            return dict(zip(BIN_COLUMNS, (F.col("__mb"), F.col("__mn"), none, none)))
        if rule.method in ("centers", "pam"):
            num = closest(x, F.col("__cuts"))
            return dict(zip(BIN_COLUMNS, (number_text(num), num, none, none)))
        if rule.method == "ntile":
            cuts = F.col("__cuts")
            before = passed(cuts, lambda s: (s["__x"] < x) | ((s["__x"] == x) & (s["__id"] <= id)))
            number = F.coalesce(F.get(cuts, before - 1)["__b"], F.lit(1).cast("long"))
            number = F.when(x.isNotNull() & F.col("__hit").isNotNull(), number)
            return dict(zip(BIN_COLUMNS, (number.cast("string"), number.cast("double"), none, none)))
        if self._cut:
            i = F.col("__i")
            left, right = (F.when(i.isNotNull(), F.try_element_at("__cuts", i + d)) for d in (0, 1))
            return dict(zip(BIN_COLUMNS, (F.when(i.isNotNull(), F.try_element_at("__labels", i)), i.cast("double"), left, right)))
        if rule.func is not None:
            names = [s for s in self.strata if s != POOLED] + [f"__stat_{s}" for s in rule.stats]
            value = rule.func(x, **{n.removeprefix("__stat_"): F.col(n) for n in names}, **rule.options)
        else:
            value = F.col(column)
        kind = df.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, T.NumericType):
            num = as_double(value)
            return dict(zip(BIN_COLUMNS, (number_text(num), num, none, none)))
        return dict(zip(BIN_COLUMNS, (value.cast("string"), none, none, none)))


def fit_bins(rows: DataFrame, rule: BinRule, strata: Sequence[str] = (), whole: bool = False) -> BinModel:
    """Fit ``rule`` to ``rows``, which hold the strata, ``__x`` (double) and, for rank groups, ``__id``.

    ``whole`` refuses strata with missing values."""
    names = list(strata) if rule.by_strata and strata else []
    if rule.stratum is not None and not strata:
        raise ValueError("chosen strata need a stratification")
    keys = names or [POOLED]
    if keys == [POOLED]:
        rows = rows.withColumn(POOLED, F.lit(0))
    if rule.column is not None and rule.stratum is None:
        return BinModel(rule, keys, rows.sparkSession.createDataFrame([], T.StructType([])), 0)
    x = F.col("__x")
    stats = [f(x).alias(f"__stat_{name}") for name, f in rule.stats.items()]
    table, groups = compact(rows.groupBy(*keys).agg(
        F.count(x).alias("n"), F.count(F.lit(1)).alias("n_all"), F.min(x).alias("xmin"), F.max(x).alias("xmax"),
        F.avg(x).alias("xmean"), F.stddev_samp(x).alias("sd"), *stats))
    infinite = float("inf")
    no_stratum = F.lit(False)
    for k in keys:
        no_stratum = no_stratum | F.col(k).isNull()
    largest, missing, unbounded, outside = table.agg(
        F.max("n_all"), F.sum(F.col("n_all") - F.col("n")), F.count_if((F.col("xmin") == -infinite) | (F.col("xmax") == infinite)), F.count_if(no_stratum)).first()
    if whole and outside:
        raise ValueError(NO_STRATUM)
    largest = largest or 0
    if missing:
        warnings.warn("some x are missing values; they get no bin", stacklevel=3)
    if unbounded:
        warnings.warn("some x are non-finite values; bins may reach to infinity", stacklevel=3)
    table = _selected(table, rule, keys)
    if rule.stratum is not None:
        rows = null_safe_join(rows, small(table.select(*keys), groups), keys, "left_semi")
    if rule.grouped:
        made, count = compact(_grouped_function(rows, keys, rule).withColumn("__hit", F.lit(True)))
        return BinModel(rule, keys, made, count, largest)

    method, payload = rule.method, []
    if isinstance(rule.func, Mergeable):
        found = materialize(merged(rows, keys, "__x", rule.func, T.ArrayType(T.DoubleType()), "__cuts"))
        if found.filter(F.size("__cuts") == 0).limit(1).count():
            raise ValueError("a bin function gave no breaks for a stratum")
        table = null_safe_join(table, found, keys)
        table = table.withColumn("__cuts", closed_edges(F.col("__cuts"), F.col("xmin"), F.col("xmax"))).withColumn("__labels", labels_column(F.col("__cuts"), rule.right))
        payload = ["__cuts", "__labels"]
    elif method is not None:
        needed = {"fixed": "breaks", **NEEDS}.get(method, "nbins")
        table = _with_parameter(table, rows, keys, rule, needed)
        if needed == "nbins" and method in STYLES and method != "dpih" and (_least_bins(table, rule) or 2) < 2:
            raise ValueError("interval styles need at least 2 bins")
        table = _cuts(rows, keys, table, rule, largest)
        payload = ["__cuts"]
        if method not in ("centers", "pam", "ntile"):
            table = table.withColumn("__cuts", closed_edges(F.col("__cuts"), F.col("xmin"), F.col("xmax")))
            table = table.withColumn("__labels", labels_column(F.col("__cuts"), rule.right and method == "breaks"))
            payload.append("__labels")
    made, count = compact(table.select(*keys, *payload, *[f"__stat_{n}" for n in rule.stats], F.lit(True).alias("__hit")))
    cuts = (made.agg(F.max(F.size("__cuts"))).first()[0] or 0) if payload else 0
    return BinModel(rule, keys, made, count, largest, 1024 + 64 * cuts)


def _cuts(rows, keys, table, rule, largest) -> DataFrame:
    """Add ``__cuts``: centres, rank starts, or breaks still to be closed at the ends of the data."""
    method, lo, hi, n = rule.method, F.col("xmin"), F.col("xmax"), F.col("nbins") if "nbins" in table.columns else None
    if method == "centers":
        return table.withColumn("__cuts", F.array_sort(F.array_distinct("centers")))
    if method in ("breaks", "fixed"):
        return table.withColumn("__cuts", F.col("breaks"))
    if method in ("eqcut", "quantile"):
        qtype = rule.quantile_type if method == "eqcut" else rule.options.get("type", 7)
        return _quantile_breaks(rows, keys, table, rule, qtype, largest, method == "quantile").withColumnRenamed("breaks", "__cuts")
    if method == "ntile":
        starts = _rank_starts(rows, keys, table, largest).groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("__x", "__id", F.col("__b").cast("long").alias("__b")))).alias("__cuts"))
        joined = null_safe_join(table, starts, keys)
        empty = F.array().cast(joined.schema["__cuts"].dataType)
        return joined.withColumn("__cuts", F.coalesce(F.col("__cuts"), empty))
    if method == "equal":
        return table.withColumn("__cuts", spaced(lo, hi, n))
    if method == "pretty":
        return with_pretty(table, lo, hi, n, "__cuts", **rule.options)
    if method == "sd":
        mean, sd = F.col("xmean"), F.col("sd")
        table = with_pretty(table, (lo - mean) / sd, (hi - mean) / sd, n, "__z")
        return table.withColumn("__cuts", F.transform("__z", lambda z: z * sd + mean))
    if method == "dpih":
        fitted = clusters.fit_plug_in(rows, keys, table, largest, int(rule.options.get("gridsize", clusters.GRID)))
    else:
        fitted = clusters.fit(rows, keys, table, method, rule.options)
    return null_safe_join(table, fitted.withColumnRenamed("cuts", "__cuts"), keys)


def assign_bins(df: DataFrame, x, rule: BinRule, by: Sequence[str] = (), id=None) -> DataFrame:
    """Stand-alone form: add bin, bin_num, bin_left and bin_right to ``df``."""
    rows = df.withColumn("__x", as_double(x))
    rows = rows.withColumn("__id", as_column(id) if id is not None else F.lit(0).cast("long"))
    if rule.method == "ntile" and id is None:
        raise ValueError("ntile needs an id column that orders tied values")
    if rule.column is not None:
        rows = rows.withColumn("__bin", as_column(rule.column))
    model = fit_bins(rows, rule, by)
    return model.transform(rows).drop("__x", "__id", "__bin")
