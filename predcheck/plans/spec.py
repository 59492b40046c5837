"""The predictive check as an immutable description of its steps.

Each method returns a new ``VPC``. Nothing is computed until a result table is used, apart from the small
reads that fit bins and count group sizes.
"""

from __future__ import annotations

import dataclasses
import hashlib
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.quantiles import CELL_PILOTS, COUNTING_CONF, PILOTS, bracketed_quantiles, brackets_pay, counted_quantiles, counting_pays, grouped_quantiles
from ..functions.values import as_column, as_double, null_safe_join
from ..operators import align, bininfo as info, correct, statistics as st, strata as sf
from ..operators.binning import NO_STRATUM, BinModel, BinRule, fit_bins
from ..operators.states import Mergeable, merged
from .storage import broadcast_bytes, compact, group_sizes, materialize, small, split_rows

#: Size of one observation (id, group, limit, correction) in a broadcast table.
OBS_ROW_BYTES = 64


def _id_column(id) -> Column:
    if isinstance(id, (list, tuple)):
        return F.struct(*id) if len(id) > 1 else as_column(id[0])
    return as_column(id)


# What the kept intermediate results depend on.
_OBS_FIELDS = ("data", "id", "x", "y", "pred", "blq", "lloq", "strat_rows", "strat_cols", "layers", "drop_blq")
_CACHED = {"_obs": _OBS_FIELDS, "_groups": (*_OBS_FIELDS, "by_strata", "xbin", "predcor"),
           "sizes": (*_OBS_FIELDS, "by_strata", "xbin", "predcor"), "_replicates": ("data", "id", "sim")}


@dataclass(frozen=True)
class Layer:
    """A fitted bin rule and the inputs it reads from the observed table."""
    model: BinModel
    x: Any
    column: Any


@dataclass(frozen=True, eq=False)
class VPC:
    data: DataFrame
    id: Any
    x: Any
    y: Any
    pred: Any = None
    blq: Any = None
    lloq: Any = float("-inf")
    positions: int | None = None
    sim: DataFrame | None = None
    strat_rows: tuple = ()
    strat_cols: tuple = ()
    two_sided: bool = False
    layers: tuple[Layer, ...] = ()
    by_strata: bool = True
    xbin: Any = "xmedian"
    predcor: bool = False
    log: bool = False
    lower_bound: float = 0.0
    drop_blq: bool = False
    check: bool = True
    qpred: tuple[float, ...] | None = None
    conf_level: float = 0.95
    quantile_type: int = 7
    store: str | None = None

    # ------------------------------------------------------------------------------------------ the steps

    def update(self, **fields) -> "VPC":
        """Replace named fields; ``None`` removes an optional one."""
        out = dataclasses.replace(self, **fields)
        for name, depends in _CACHED.items():
            if name in self.__dict__ and all(fields.get(f, getattr(self, f)) is getattr(self, f) for f in depends):
                out.__dict__[name] = self.__dict__[name]
        return out

    def _joined(self, data: DataFrame | None) -> "VPC":
        """The check with the columns of ``data``, one row per observation, added to its table (or replacing columns)."""
        if data is None:
            return self
        keys = list(self.id) if isinstance(self.id, (list, tuple)) else [self.id]
        if self.positions is not None or not all(isinstance(k, str) for k in keys):
            raise ValueError("data= needs observations that are identified by named columns")
        added = [c for c in data.columns if c not in keys]
        return self.update(data=self.data.drop(*added).join(data.select(*keys, *added), keys, "left"))

    def simulated(self, data: DataFrame, y, *, id=None, repl="repl", order: Sequence | str | None = None, check: bool = True) -> "VPC":
        """Replicates. Either ``id`` and ``repl`` say which observation and replicate a row belongs to, or
        ``order`` says how to number the rows (the observations must then have been given an order too): columns, or ``"files"`` for the order of the files read.

        With ids, ``statistics`` checks that every replicate has every observation once; ``check=False`` leaves it out."""
        if order is not None:
            if self.positions is None:
                raise ValueError("simulated(order=...) needs observed(order=...)")
            value = [as_double(y).alias("y")]
            if order == align.FILES:
                rows, number = align.file_index(data, value)
            else:
                rows = align.placed_rows(data, value, order)
                number = rows.count()
            if number % max(self.positions, 1):
                raise ValueError("the number of simulated rows must be a multiple of the number of observations")
            numbered = align.number_replicates(rows, self.positions)
            return self.update(sim=numbered.select("obs_id", "repl", "y"), check=False)
        return self.update(sim=data.select(_id_column(self.id if id is None else id).alias("obs_id"),
                                           as_column(repl).cast("int").alias("repl"), as_double(y).alias("y")), check=check)

    def censoring(self, blq=None, lloq=None, *, data: DataFrame | None = None) -> "VPC":
        """Replace the flag, the limit or both; what is left out keeps its value, also a flag that came from the limit.

        Once censored rows are left out, another flag means other rows: bins and correction have to be given again."""
        flag = blq if blq is not None else self.blq if self.blq is not None else as_double(self.y) < as_double(self.lloq)
        out = self._joined(data).update(blq=flag, lloq=self.lloq if lloq is None else lloq)
        return out._unbinned() if self.drop_blq else out

    def filter_blq(self) -> "VPC":
        """Leave out observations below the limit, and simulated values below it.

        A missing flag leaves an observation out; a missing simulated value, or limit, leaves a simulated row in. An
        observation that is left out takes its simulated values with it. Bins that were fitted to the rows left out
        are dropped, and the correction with them."""
        return self if self.drop_blq else self.update(drop_blq=True)._unbinned()

    def _unbinned(self) -> "VPC":
        return self.update(layers=(), predcor=False, qpred=None)

    def stratify(self, formula: str | None = None, *, rows: Sequence = (), cols: Sequence = (),
                 derived: dict[str, Column] | None = None, data: DataFrame | None = None) -> "VPC":
        """``"~ a + b"``, ``"a ~ b"`` or explicit sides, with terms such as ``cut(x, 2)``. Bins and correction have to be given again."""
        two_sided = bool(rows)
        if formula is not None:
            rows, cols, two_sided = sf.split_formula(formula)
        joined = self._joined(data)
        left, right = (sf.as_terms(side, derived or {}, joined._observed()) for side in (rows, cols))
        sf.check_terms(left, right)
        return joined.update(strat_rows=tuple(left), strat_cols=tuple(right), two_sided=two_sided)._unbinned()

    def binning(self, bin=None, *, method: str | None = None, func: Callable | None = None, nbins=None, centers=None,
                breaks=None, xbin: Any = "xmedian", altx=None, stratum=None, by_strata: bool = True, right: bool = False,
                quantile_type: int = 7, stats: dict | None = None, grouped: bool = False, data: DataFrame | None = None,
                **options) -> "VPC":
        """Bins from a column (``bin``), a named ``method``, a ``func``, or a numeric ``xbin`` column.

        ``options`` are those of the method, or further arguments of ``func``; a method refuses names it does not know."""
        if data is not None:
            return self._joined(data).binning(bin, method=method, func=func, nbins=nbins, centers=centers, breaks=breaks, xbin=xbin, altx=altx, stratum=stratum,
                                              by_strata=by_strata, right=right, quantile_type=quantile_type, stats=stats, grouped=grouped, **options)
        if isinstance(xbin, Column):
            bin, method, func = xbin, None, None
        elif not callable(xbin) and not isinstance(xbin, Mergeable) and xbin not in info.INFO_COLUMNS:
            raise ValueError(f"xbin must be a Column, a function, a Mergeable or one of {', '.join(info.INFO_COLUMNS)}")
        elif bin is None and method is None and func is None:
            method = "centers" if centers is not None else "breaks" if breaks is not None else None
        per_row = nbins if isinstance(nbins, (str, Column)) else None
        rule = BinRule(method=method, column=bin, func=func, nbins="__nbins" if per_row is not None else nbins,
                       centers=centers, breaks=breaks, stats=stats or {}, grouped=grouped, stratum=stratum,
                       by_strata=by_strata, right=right, quantile_type=quantile_type, options=options)
        x = self.x if altx is None else altx
        inputs = {"__x": as_double(x), "__id": _id_column(self.id)}
        if per_row is not None:
            inputs["__nbins"] = as_column(per_row)
        rows = self._observed().select(*[c.alias(n) for n, c in self._strata()], *[c.alias(n) for n, c in inputs.items()])
        model = fit_bins(rows, rule, self.strata if by_strata or stratum is not None else [], whole=True)
        kept = self.layers if stratum is not None else ()
        return self.update(layers=(*kept, Layer(model, x, bin)), by_strata=by_strata, xbin=xbin, predcor=False, qpred=None)

    def predcorrect(self, pred=None, *, log: bool = False, lower_bound: float = 0.0, data: DataFrame | None = None) -> "VPC":
        if data is not None:
            return self._joined(data).predcorrect(pred, log=log, lower_bound=lower_bound)
        pred = self.pred if pred is None else pred
        if pred is None:
            raise ValueError("prediction correction needs pred")
        if not self.layers:
            raise ValueError("prediction correction needs bins: call binning first")
        return self.update(pred=pred, predcor=True, log=log, lower_bound=lower_bound)

    def nopredcorrect(self) -> "VPC":
        return self.update(predcor=False)

    def statistics(self, qpred: Sequence[float] = (0.05, 0.5, 0.95), *, conf_level: float = 0.95,
                   quantile_type: int = 7, store: str | None = None) -> "VPC":
        """Ask for the quantile and percent-below-limit tables, ``stats`` and ``pctblq``.

        ``store`` is a shared folder that keeps the quantiles of every replicate. A later check of the same observations, bins and
        options computes only the replicates that it does not hold yet; a replicate whose values changed is computed again."""
        if not self.layers:
            raise ValueError("statistics needs bins: call binning first")
        if self.sim is None:
            raise ValueError("statistics needs replicates: call simulated first")
        out = self.update(qpred=tuple(float(p) for p in qpred), conf_level=conf_level, quantile_type=quantile_type, store=store)
        if out.sizes["missing_bins"]:
            warnings.warn("some observations have no bin; not every stratum may have been binned", stacklevel=2)
        if out.check and (bad := out._replicates["misaligned"]):
            raise ValueError(f"{bad} replicates do not have every observation exactly once, e.g. {out._replicates['example']}; "
                             "see alignment(), or pass check=False to simulated()")
        return out

    def alignment(self) -> DataFrame:
        """One row per replicate: repl, rows, and aligned, whether it has every observation exactly once.

        Ids are compared by their number and checksums, so the simulated rows are read once and never shuffled."""
        keys = self.data.select(_id_column(self.id).alias("obs_id"))
        sums = align.checksums("obs_id")
        unique = F.count(F.lit(1)) == F.count_distinct("obs_id")
        want = keys.agg(*[c.alias(f"want_{n}") for n, c in sums.items()], unique.alias("unique"))
        right = F.col("unique")
        for n in sums:
            right = right & F.col(n).eqNullSafe(F.col(f"want_{n}"))
        by_replicate = self.sim.groupBy("repl").agg(*[c.alias(n) for n, c in sums.items()])
        return by_replicate.join(F.broadcast(want)).select("repl", "rows", (right & F.col("repl").isNotNull()).alias("aligned"))

    @cached_property
    def _replicates(self) -> dict:
        """Replicates, those that are misaligned and one of them, and pilots: replicate numbers spread over all of them."""
        shares = [(i + 0.5) / PILOTS for i in range(PILOTS)]
        row = self.alignment().agg(F.count("repl"), F.count_if(~F.col("aligned")), F.min(F.when(~F.col("aligned"), F.col("repl"))),
                                   F.percentile_approx("repl", shares, 1000)).first()
        return {"count": row[0], "misaligned": row[1], "example": row[2], "pilots": sorted(set(row[3] or []))}

    # ------------------------------------------------------------------------------------- working tables

    @property
    def strata(self) -> list[str]:
        return [n for n, _ in self._strata()]

    def _strata(self):
        return [*self.strat_rows, *self.strat_cols]

    def _flag(self) -> Column:
        if self.blq is not None:
            return as_column(self.blq).cast("boolean")
        return as_double(self.y) < as_double(self.lloq)

    def _observed(self) -> DataFrame:
        return self.data.filter(~self._flag()) if self.drop_blq else self.data

    def obs(self) -> DataFrame:
        """obs_id, x, y, pred, blq, lloq, strata, and bin, bin_num once there are bins."""
        return self._obs

    @cached_property
    def _obs(self) -> DataFrame:
        pred = as_double(self.pred) if self.pred is not None else F.lit(None).cast("double")
        cols = [_id_column(self.id).alias("obs_id"), as_double(self.x).alias("x"), as_double(self.y).alias("y"),
                pred.alias("pred"), self._flag().alias("blq"), as_double(self.lloq).alias("lloq"),
                *[c.alias(n) for n, c in self._strata()]]
        for i, layer in enumerate(self.layers):
            cols.append(as_double(layer.x).alias(f"__x{i}"))
            if layer.column is not None:
                cols.append(as_column(layer.column).alias(f"__bin{i}"))
        df = self._observed().select(*cols)
        if not self.layers:
            return df
        if self.layers[0].model.rule.stratum is not None:
            text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
            df = df.withColumns({"bin": text, "bin_num": number, "bin_left": number, "bin_right": number})
        for i, layer in enumerate(self.layers):
            df = layer.model.transform(df, x=f"__x{i}", id="obs_id", column=f"__bin{i}")
        extra = [c for c in df.columns if c.startswith("__")]
        return df.drop(*extra, "bin_left", "bin_right")

    def _need_bins(self) -> None:
        if not self.layers:
            raise ValueError("there are no bins yet: call binning first")

    @cached_property
    def _bound(self) -> tuple[int, int]:
        """(largest bin, number of bins), both upper bounds: from the strata counted when bins were fitted, if those are
        small enough to decide every plan, else counted."""
        known = [layer.model.largest for layer in self.layers]
        if None not in known and max(known) <= split_rows(self.data.sparkSession):
            return max(known), max(known)
        groups, largest = group_sizes(self.obs(), [*self.strata, "bin"])
        return largest, groups

    @cached_property
    def _groups(self) -> DataFrame:
        """Every (strata, bin) once: gid, bin_num, xbin, rows, below, and mpred under prediction correction.

        ``gid`` stands for the strata and the bin in everything that is done with the replicates.
        """
        self._need_bins()
        keys = [*self.strata, "bin"]
        table = self._bins({"rows": F.count(F.lit(1)), "below": F.count_if("blq")})
        if self.predcor:
            medians = correct.median_prediction(self.obs(), keys, self._bound[0])
            table = null_safe_join(table, medians, keys)
        stored, count = compact(table.withColumn("gid", F.monotonically_increasing_id()))
        return small(stored, count)

    @cached_property
    def sizes(self) -> dict:
        """Rows of the largest bin, bins, rows without a bin, rows, observations below the limit."""
        no_stratum = F.lit(False)
        for s in self.strata:
            no_stratum = no_stratum | F.col(s).isNull()
        row = self._groups.agg(F.max("rows").alias("largest"), F.count(F.lit(1)).alias("bins"),
                               F.sum(F.when(F.col("bin").isNull(), F.col("rows"))).alias("missing_bins"),
                               F.sum("rows").alias("rows"), F.sum("below").alias("below"), F.count_if(no_stratum).alias("no_stratum")).first()
        if row["no_stratum"]:
            raise ValueError(NO_STRATUM)
        return {k: row[k] or 0 for k in ("largest", "bins", "missing_bins", "rows", "below")}

    def _grouped_obs(self) -> DataFrame:
        """Binned observations with the gid of their bin, and pc and ypc under prediction correction."""
        keys = [*self.strata, "bin"]
        carried = ["gid", "mpred"] if self.predcor else ["gid"]
        rows = null_safe_join(self.obs(), self._groups.select(*keys, *carried), keys)
        return correct.with_correction(rows, self.log, self.lower_bound) if self.predcor else rows

    def _grouped_sim(self, *carried: str) -> DataFrame:
        """Simulated rows with the gid (and more, if named) of their observation; ``y`` raw, ``v`` corrected."""
        names = dict.fromkeys(["gid", *carried, *(["lloq"] if self.drop_blq else []), *(["pc"] if self.predcor else [])])
        obs = self._grouped_obs().select("obs_id", *names)
        # Observations go to every executor only when their counted rows are few; the simulated rows never do, whatever
        # size Spark estimates for them. Beyond that, each task builds a table of its observations: no sort of the replicates.
        fits = self.sizes["rows"] * OBS_ROW_BYTES <= broadcast_bytes(self.data.sparkSession)
        rows = self.sim.join(F.broadcast(obs) if fits else obs.hint("shuffle_hash"), "obs_id")
        if self.drop_blq:
            rows = rows.filter("y >= lloq or y is null or lloq is null")
        value = correct.corrected(F.col("y"), F.col("pc"), self.log, self.lower_bound) if self.predcor else F.col("y")
        return rows.withColumn("v", value)

    def corrected_obs(self) -> DataFrame:
        """Binned observations with mpred and ypc when prediction correction is on."""
        self._need_bins()
        return self._grouped_obs().drop("gid") if self.predcor else self.obs()

    def corrected_sim(self) -> DataFrame:
        """Simulated rows with the stratum, bin, limit and correction of their observation."""
        rows = self._grouped_sim(*self.strata, "bin", "lloq").drop("gid")
        return rows.withColumnRenamed("v", "ypc") if self.predcor else rows.drop("v")

    # -------------------------------------------------------------------------------------------- results

    def _info(self, by_strata: bool, extra: dict | None = None) -> DataFrame:
        self._need_bins()
        # Pooled bins span strata; the bound of a bin within its stratum does not hold for them.
        pooled = bool(self.strata) and not by_strata and any(layer.model.rule.by_strata for layer in self.layers)
        largest, bins = (None, self._bound[1]) if pooled else self._bound
        needed = [*self.strata, "bin", "bin_num", "x", *(["blq"] if extra else [])]
        return info.bin_information(self.obs().select(*needed), self.strata, by_strata, largest, bins, extra)

    def bininfo(self, by_strata: bool | None = None) -> DataFrame:
        """One row per (strata, bin): nobs, xmedian, xmean, xmin, xmax, xmid, xleft, xright, xcenter."""
        by_strata = self.by_strata if by_strata is None else by_strata
        return self._info(by_strata).orderBy(*self.strata, "xmin", "bin")

    def _bins(self, extra: dict[str, Column]) -> DataFrame:
        keys = [*self.strata, "bin"]
        if isinstance(self.xbin, str):
            return self._info(self.by_strata, extra).select(*keys, "bin_num", F.col(self.xbin).alias("xbin"), *extra)
        if isinstance(self.xbin, Mergeable):
            rows = self._obs_with_x()
            counted = rows.groupBy(*keys).agg(F.min("bin_num").alias("bin_num"), *[c.alias(n) for n, c in extra.items()])
            return null_safe_join(counted, merged(rows, keys, "__bx", self.xbin, T.DoubleType(), "xbin"), keys)
        value = F.min("__bx") if isinstance(self.xbin, Column) else self.xbin(F.col("__bx"))
        return self._obs_with_x().groupBy(*keys).agg(F.min("bin_num").alias("bin_num"), value.alias("xbin"),
                                                     *[c.alias(n) for n, c in extra.items()])

    def _obs_with_x(self) -> DataFrame:
        """Binned observations plus ``__bx``: the column that is xbin, else the variable that was binned last."""
        wanted = self.xbin if isinstance(self.xbin, Column) else self.layers[-1].x
        return dataclasses.replace(self, pred=wanted).obs().withColumnRenamed("pred", "__bx")

    def bins(self) -> DataFrame:
        """(strata, bin, bin_num, xbin): the x value that represents each bin."""
        return self._groups.select(*self.strata, "bin", "bin_num", "xbin")

    def _named(self, df: DataFrame, *columns: str) -> DataFrame:
        """Replace gid by the strata and the bin, plus more columns of the bin if named."""
        return df.join(self._groups.select("gid", *self.strata, "bin", *columns), "gid").drop("gid")

    def _observed_quantiles(self) -> DataFrame:
        value = F.col("ypc" if self.predcor else "y")
        rows = self._grouped_obs().select("gid", st.censored(value, F.col("blq")).alias("v"))
        return st.long_quantiles(rows, ["gid"], "v", self.qpred, self.quantile_type, self.sizes["largest"])

    def observed_quantiles(self) -> DataFrame:
        """(strata, bin, q_index, y), values below the limit ranking lowest."""
        return self._named(self._observed_quantiles()).select(*self.strata, "bin", "q_index", "y")

    def _replicate_quantiles(self) -> DataFrame:
        """(gid, repl, q_index, y): the heavy step, one shuffle of the simulated rows or of those near a quantile."""
        rows, largest = self._grouped_sim().select("gid", "repl", "v"), self.sizes["largest"]
        if self.store is None and brackets_pay(largest, 10 * PILOTS, self.qpred):
            known = self._replicates
            if brackets_pay(largest, known["count"], self.qpred):
                return st.to_long(bracketed_quantiles(rows, ["gid"], "repl", known["pilots"], "v", self.qpred, self.quantile_type, largest),
                                  ["gid", "repl"])
        return st.to_long(self._per_replicate, ["gid", "repl"])

    @cached_property
    def _per_replicate(self) -> DataFrame:
        """(gid, repl, q, below): the quantiles of every replicate and its percentage below the limit, from one pass.

        Stored if anything is below the limit, because both tables of results are then made from it."""
        if self.store is not None:
            return self._from_store()
        flagged = bool(self.sizes["below"])
        rows = self._grouped_sim(*["lloq"] * flagged).select("gid", "repl", "v", F.expr("y < lloq" if flagged else "false").alias("blq"))
        asked = self.data.sparkSession.conf.get(COUNTING_CONF, "false").lower() == "true"
        known = self._replicates if asked and counting_pays(self.sizes["rows"], self.sizes["bins"], 20) else {"count": 0}
        if counting_pays(self.sizes["rows"], self.sizes["bins"], known["count"]):
            sums = {"__blq": F.count_if("blq"), "__flags": F.count("blq"), "__all": F.count(F.lit(1))}
            got = counted_quantiles(rows, ["gid"], "repl", known["pilots"][::max(1, len(known["pilots"]) // CELL_PILOTS)][:CELL_PILOTS], "v", self.qpred, self.quantile_type, sums)
            got = got.withColumn("below", st.share_of("__blq", "__flags", "__all")).drop(*sums)
            return materialize(got) if flagged else got
        # Replicates of a bin resemble each other, so split points of large groups are shared between them.
        got = grouped_quantiles(rows, ["gid", "repl"], "v", self.qpred, self.quantile_type, extra=[st.share_below().alias("below")],
                                largest=self.sizes["largest"], split_keys=["gid"])
        return materialize(got) if flagged else got

    def _fingerprint(self) -> str:
        """Of all that the quantiles of a replicate depend on, beside its own values."""
        used = self._grouped_obs().select("obs_id", *self.strata, "bin", "blq", "lloq", *(["pc"] if self.predcor else []))
        sums = used.select(F.struct(*used.columns).alias("row")).agg(*[c.alias(n) for n, c in align.checksums("row").items()]).first()
        asked = (self.qpred, self.quantile_type, self.strata, self.predcor, self.log, self.lower_bound, self.drop_blq)
        return hashlib.sha256(repr((tuple(sums), asked)).encode()).hexdigest()[:32]

    def _from_store(self) -> DataFrame:
        """(gid, repl, q, below) of all replicates, read from the store once those that it lacks have been added to it.

        A replicate is known by its number and checksums of its values, which take one aggregate without a shuffle of rows."""
        spark, keys = self.data.sparkSession, [*self.strata, "bin"]
        folder = f"{self.store.rstrip('/')}/{self._fingerprint()}"
        sums = align.checksums("row")
        marks = self.sim.select("repl", F.struct("obs_id", "y").alias("row")).groupBy("repl").agg(*[c.alias(n) for n, c in sums.items()])
        wanted, number = compact(marks.select("repl", F.concat_ws(" ", *sums).alias("mark")))
        try:
            held = spark.read.parquet(folder).select("repl", "mark").distinct()
            lacking = null_safe_join(wanted, held, ["repl", "mark"], "left_anti")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            lacking = wanted
        lacking, missing = compact(lacking)
        if missing:
            rows = null_safe_join(self.sim, small(lacking.select("repl"), missing), ["repl"], "left_semi")
            added = self.update(store=None, sim=rows)._per_replicate
            named = null_safe_join(self._named(added), small(lacking, missing), ["repl"])
            named.select(*keys, "repl", "mark", "q", "below").write.mode("append").parquet(folder)
        kept = null_safe_join(spark.read.parquet(folder), small(wanted, number), ["repl", "mark"], "left_semi")
        return null_safe_join(kept, self._groups.select(*keys, "gid"), keys).select("gid", "repl", "q", "below")

    def replicate_quantiles(self) -> DataFrame:
        """(strata, bin, repl, q_index, y)."""
        return self._named(self._replicate_quantiles()).select(*self.strata, "bin", "repl", "q_index", "y")

    def interval_table(self) -> DataFrame:
        """The ``stats`` columns plus bin_num and q_index, in no particular order."""
        if self.qpred is None:
            raise ValueError("call statistics() first")
        intervals = st.over_replicates(self._replicate_quantiles(), ["gid", "q_index"], self.conf_level, self.quantile_type, 0)
        observed = small(self._observed_quantiles(), self.sizes["bins"] * len(self.qpred))
        names = F.array(*[F.lit(f"q{p:.15g}") for p in self.qpred])
        return self._named(intervals.join(observed, ["gid", "q_index"], "left"), "bin_num", "xbin") \
            .withColumn("qname", F.element_at(names, F.col("q_index") + 1))

    @property
    def stats(self) -> DataFrame:
        """strata, bin, xbin, qname, y, lo, md, hi; sorted by strata, xbin and the order of ``qpred``."""
        return self.interval_table().orderBy(*self.strata, "xbin", "q_index") \
            .select(*self.strata, "bin", "xbin", "qname", "y", "lo", "md", "hi")

    @property
    def pctblq(self) -> DataFrame | None:
        """strata, bin, xbin, y, lo, md, hi in percent; ``None`` when no observation is below its limit."""
        if self.qpred is None:
            raise ValueError("call statistics() first")
        if not self.sizes["below"]:
            return None
        if self.store is not None or "_per_replicate" in self.__dict__:  # asked for the quantiles before: their pass has counted the flags too
            share = self._per_replicate.select("gid", F.col("below").alias("y"))
        else:
            share = st.percent_below(self._grouped_sim("lloq").select("gid", "repl", F.expr("y < lloq as blq")), ["gid", "repl"])
        intervals = st.over_replicates(share, ["gid"], self.conf_level, self.quantile_type, 0)
        observed = small(st.percent_below(self._grouped_obs().select("gid", "blq"), ["gid"]), self.sizes["bins"])
        return self._named(intervals.join(observed, "gid", "left"), "xbin").orderBy(*self.strata, "xbin") \
            .select(*self.strata, "bin", "xbin", "y", "lo", "md", "hi")

    def summary(self) -> DataFrame:
        """One row: replicates, prediction_corrected, stratified_by, has_stats."""
        replicates = F.lit(None).cast("long") if self.sim is None else F.count_distinct("repl").cast("long")
        counts = (self.data.limit(1) if self.sim is None else self.sim).agg(replicates.alias("replicates"), F.lit(self.predcor).alias("prediction_corrected"))
        return counts.withColumns({"stratified_by": F.lit(", ".join(self.strata)), "has_stats": F.lit(self.qpred is not None)})


def observed(data: DataFrame, x, yobs=None, *, y=None, id=None, order: Sequence | str | None = None, pred=None, blq=None,
             lloq=float("-inf")) -> VPC:
    """Start a check. ``id`` identifies an observation; ``order`` numbers them 0..n-1 by the given columns instead,
    or, if it is ``"files"``, by their places in the files that ``data`` is read from."""
    value = yobs if yobs is not None else y
    if value is None:
        raise ValueError("the observed variable is missing")
    if (id is None) == (order is None):
        raise ValueError("give either id or order")
    if order is None:
        return VPC(data, id, x, value, pred, blq, lloq)
    if order == align.FILES:
        placed, number = align.file_index(data, name="__position")
    else:
        placed = align.dense_index(data, order, "__position")
        number = placed.count()
    return VPC(placed, "__position", x, value, pred, blq, lloq, positions=number)
