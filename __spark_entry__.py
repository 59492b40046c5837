"""

Each query is registered with ``@query``; its SQL follows the function and is built from the shared table
expressions below. A query without SQL has no reasonable SQL form; the tests cover it against brute force.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F  # noqa: E402

import predcheck as pk  # noqa: E402
from predcheck.functions.quantiles import bracketed_quantiles, counted_quantiles, grouped_quantiles  # noqa: E402
from predcheck.functions.values import natural_log  # noqa: E402
from predcheck.operators import report as rp  # noqa: E402
from predcheck.operators.correct import median_prediction  # noqa: E402
from predcheck.operators.statistics import censored, long_quantiles, percent_below  # noqa: E402
from predcheck.plans.storage import shared_dir  # noqa: E402
from check_tables import load, obs_events, obs_orders, sim_events  # noqa: E402

ENTRY_DIR = "/root/testdata/sf0.001"
REPLICATES = 20
QPRED = (0.05, 0.5, 0.95)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = six_decimals(sql)
        return fn
    return register


# Engines may differ in the last bit of a sum, and they round a final 5 differently. Both sides therefore keep six
# decimals by the same arithmetic, with an offset that no value of a few decimals hits.
SCALE, OFFSET = 1e6, 0.50037


def rounded(df: DataFrame) -> DataFrame:
    def six(name):
        return (F.floor(F.col(name) * SCALE + OFFSET).cast("double") / SCALE).alias(name.strip("`"))
    return df.select(*[six(f"`{n}`") if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def six_decimals(sql: str) -> str:
    """Write every ``round(expression, 6)`` of the SQL as the arithmetic of ``rounded``."""
    while (start := sql.find("round(")) >= 0 and (end := _closing(sql, start + 5)):
        inner = sql[start + 6:end]
        if not inner.endswith(", 6"):
            sql = sql[:start] + "ROUND(" + sql[start + 6:]
            continue
        sql = sql[:start] + f"floor(({inner[:-3]}) * {SCALE!r}::DOUBLE + {OFFSET}::DOUBLE) / {SCALE!r}::DOUBLE" + sql[end + 1:]
    return sql


def _closing(text: str, opening: int) -> int:
    depth = 0
    for i in range(opening, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced parentheses")


# ------------------------------------------------------------------------------- shared SQL table expressions

OBS = """obs AS (SELECT event_id AS obs_id, event_type AS strat, hour(ts)::DOUBLE + minute(ts) / 60::DOUBLE AS x, value AS y,
  (hour(ts) + 30)::DOUBLE AS pred, CASE WHEN event_type IN ('click', 'view') THEN 5::DOUBLE ELSE 2::DOUBLE END AS lloq,
  value < CASE WHEN event_type IN ('click', 'view') THEN 5::DOUBLE ELSE 2::DOUBLE END AS blq FROM events)"""
SIM = f"""sim AS (SELECT event_id AS obs_id, r.repl::INTEGER AS repl,
  value * (((event_id * 31 + r.repl * 17 + event_id * r.repl) % 101)::DOUBLE / 100::DOUBLE + 0.5::DOUBLE) AS y_sim
  FROM events, range(1, {REPLICATES + 1}) r(repl))"""
ORD = """obs AS (SELECT o_orderkey AS obs_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS x, o_totalprice AS y,
  o_orderstatus AS status, o_orderpriority AS priority,
  (date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1000)::DOUBLE AS pred FROM orders)"""


def ntile_sql(k=6, by="strat", src="obs"):
    part = f"PARTITION BY {by} " if by else ""
    return f"""binned AS (SELECT *, ({k} * (row_number() OVER ({part}ORDER BY x, obs_id) - 1)) // count(*) OVER ({part}) + 1 AS b FROM {src})"""


BINNED = ntile_sql()
CORR = "corr AS (SELECT *, (median(pred) OVER (PARTITION BY strat, b) / pred) * y AS ypc, median(pred) OVER (PARTITION BY strat, b) / pred AS pc FROM binned)"
PLAIN = "corr AS (SELECT *, y AS ypc, 1::DOUBLE AS pc FROM binned)"


def info_sql(by="strat", key="strat, b", name="info"):
    part = f"PARTITION BY {by} " if by else ""
    return f"""basic AS (SELECT {key}, count(x) AS nobs, median(x) AS xmedian, avg(x) AS xmean, min(x) AS xmin, max(x) AS xmax,
  0.5::DOUBLE * (min(x) + max(x)) AS xmid FROM binned GROUP BY {key}),
edged AS (SELECT *, coalesce(0.5::DOUBLE * (xmin + lag(xmax) OVER ({part}ORDER BY xmin, b)), xmin) AS xleft,
  coalesce(0.5::DOUBLE * (xmax + lead(xmin) OVER ({part}ORDER BY xmin, b)), xmax) AS xright FROM basic),
{name} AS (SELECT *, 0.5::DOUBLE * (xleft + xright) AS xcenter FROM edged)"""


INFO = info_sql()
INFO_OUT = ", ".join(["nobs", *[f"round({c}, 6) AS {c}" for c in ("xmedian", "xmean", "xmin", "xmax", "xmid", "xleft", "xright", "xcenter")]])


def quantile_ctes(qpred=QPRED, conf=0.95, sim_value="s.y_sim * o.pc", sim_filter="", censor=True, keys="strat, b"):
    ps = "[" + ", ".join(map(str, qpred)) + "]"
    tail = (1 - conf) / 2
    value = "CASE WHEN blq THEN '-infinity'::DOUBLE ELSE ypc END" if censor else "ypc"
    okeys = ", ".join("o." + k.strip() for k in keys.split(","))
    return f"""qo AS (SELECT {keys}, unnest(q) AS y, generate_subscripts(q, 1) AS i FROM
  (SELECT {keys}, quantile_cont({value}, {ps}) AS q FROM corr GROUP BY {keys})),
qr AS (SELECT {keys}, repl, unnest(q) AS y, generate_subscripts(q, 1) AS i FROM
  (SELECT {okeys}, s.repl, quantile_cont({sim_value}, {ps}) AS q FROM sim s JOIN corr o USING (obs_id) {sim_filter} GROUP BY {okeys}, s.repl)),
qq AS (SELECT {keys}, i, quantile_cont(y, {tail!r}) AS lo, quantile_cont(y, 0.5) AS md, quantile_cont(y, {1 - tail!r}) AS hi FROM qr GROUP BY {keys}, i)"""


def stats_select(qpred=QPRED, keys="strat", xbin="xmedian", bin="b::VARCHAR", join=None):
    names = "[" + ", ".join(f"'q{p:.15g}'" for p in qpred) + "]"
    join = join or f"({keys}, b)"
    return f"""SELECT {keys}, {bin} AS bin, round({xbin}, 6) AS xbin, ({names})[i] AS qname,
  round(CASE WHEN qo.y <> '-infinity'::DOUBLE THEN qo.y END, 6) AS y, round(lo, 6) AS lo, round(md, 6) AS md, round(hi, 6) AS hi
  FROM qq LEFT JOIN qo USING ({keys}, b, i) LEFT JOIN info USING {join}"""


def with_(*ctes, select):
    return "WITH " + ",\n".join(ctes) + "\n" + select


# -------------------------------------------------------------------------------------- shared Spark pieces

def base(spark, sf, **kw):
    return pk.observed(obs_events(spark, sf), "x", "y", id="obs_id", pred="pred", blq="blq", lloq="lloq", **kw)


def stratified(spark, sf):
    return base(spark, sf).stratify("~ strat")


def simulated(spark, sf):
    return stratified(spark, sf).simulated(sim_events(spark, sf, REPLICATES), "y_sim")


def ntiles(spark, sf):
    return simulated(spark, sf).binning(method="ntile", nbins=6)


def flagship(spark, sf):
    return ntiles(spark, sf).predcorrect().statistics(QPRED)


def row_bins(vpc, strata=("strat",), number="int") -> DataFrame:
    return rounded(vpc.obs().select("obs_id", *strata, F.col("bin_num").cast(number).alias("bin_num")))


def info_rows(vpc, strata=("strat",)) -> DataFrame:
    return rounded(vpc.bininfo().drop("bin_num"))


FLAGSHIP_SQL = with_(OBS, SIM, BINNED, CORR, INFO, quantile_ctes(), select=stats_select())


@query(FLAGSHIP_SQL)
def interval_statistics(spark, sf):
    return rounded(flagship(spark, sf).stats)


# ------------------------------------------------------------------------- ingest, alignment, preparation

@query(with_(OBS, select="SELECT obs_id, round(x, 6) AS x, y, pred, lloq, blq FROM obs"))
def observed_points(spark, sf):
    return rounded(base(spark, sf).obs().select("obs_id", "x", "y", "pred", "lloq", "blq"))


@query(with_(OBS, SIM, select="SELECT obs_id, repl, round(x, 6) AS x, round(y_sim, 6) AS y FROM sim JOIN obs USING (obs_id)"))
def simulated_by_key(spark, sf):
    v = base(spark, sf).simulated(sim_events(spark, sf, REPLICATES), "y_sim")
    return rounded(v.sim.join(v.obs().select("obs_id", "x"), "obs_id"))


def _by_position(spark, sf):
    v = pk.observed(obs_events(spark, sf), "x", "y", order=["obs_id"])
    return v.simulated(sim_events(spark, sf, REPLICATES).withColumnRenamed("obs_id", "key"), "y_sim", order=["repl", "key"])


_POSITIONS = with_(OBS, SIM, """o AS (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS p FROM obs)""",
                   """s AS (SELECT *, row_number() OVER (ORDER BY repl, obs_id) - 1 AS p, (SELECT count(*) FROM obs) AS n FROM sim)""",
                   """a AS (SELECT s.p % s.n AS obs_id, (s.p // s.n + 1)::INTEGER AS repl, s.y_sim AS y FROM s)""", select="{}")


@query(with_(OBS, select="SELECT obs_id, round(y * 2, 6) AS y, lloq * 3 AS lloq, y * 2 < lloq * 3 AS blq FROM obs"))
def updated_fields(spark, sf):
    """Fields of a check replaced by name; the flag is then that of the new limit."""
    return rounded(base(spark, sf).update(y="y * 2", lloq="lloq * 3", blq=None).obs().select("obs_id", "y", "lloq", "blq"))


@query(_POSITIONS.format("SELECT a.obs_id, a.repl, round(o.x, 6) AS x, round(a.y, 6) AS y FROM a JOIN o ON o.p = a.obs_id"))
def simulated_by_position(spark, sf):
    v = _by_position(spark, sf)
    return rounded(v.sim.join(v.obs().select("obs_id", "x"), "obs_id"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM orders),
l AS (SELECT l_extendedprice AS y, row_number() OVER () - 1 AS place FROM lineitem),
p AS (SELECT y, place % n AS i, (place // n + 1)::INTEGER AS repl FROM l, (SELECT DISTINCT n FROM o))
SELECT o_orderkey, o_orderstatus, repl, y FROM p JOIN o USING (i)""")
def simulated_by_file_order(spark, sf):
    """Lines are replicates of the orders, by the places of both in their files."""
    v = pk.observed(load(spark, sf, "orders"), "o_orderkey", "o_totalprice", order="files").simulated(load(spark, sf, "lineitem"), "l_extendedprice", order="files")
    return v.sim.join(v.data.select(F.col("__position").alias("obs_id"), "o_orderkey", "o_orderstatus"), "obs_id").select("o_orderkey", "o_orderstatus", "repl", "y")


@query(_POSITIONS.format("SELECT repl, count(*) AS n, min(obs_id) AS first_obs, max(obs_id) AS last_obs FROM a GROUP BY repl"))
def replicate_numbers(spark, sf):
    return _by_position(spark, sf).sim.groupBy("repl").agg(
        F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first_obs"), F.max("obs_id").alias("last_obs"))


def _order_tables(spark, sf):
    obs = obs_events(spark, sf).select(F.col("obs_id").alias("ID"), F.col("x").alias("TIME"))
    sim = sim_events(spark, sf, REPLICATES).join(obs.withColumnRenamed("ID", "obs_id"), "obs_id")
    return obs, sim.select(F.col("obs_id").cast("double").alias("ID"), (F.col("TIME") + 1e-6).alias("TIME"), "repl")


@query(with_(OBS, SIM, select=f"""SELECT (SELECT count(*) FROM obs) AS n_obs, count(*) AS n_sim,
  count(*) / (SELECT count(*) FROM obs)::DOUBLE AS nrep, count(*) % (SELECT count(*) FROM obs) = 0 AS multiple_ok,
  bool_and(a.obs_id = b.obs_id) AS id_ok, bool_and(abs(a.x - (b.x + 0.000001::DOUBLE)) < 0.00001::DOUBLE) AS time_ok FROM
  (SELECT obs_id, x, row_number() OVER (ORDER BY obs_id) - 1 AS p FROM obs) a JOIN
  (SELECT sim.obs_id, x, (row_number() OVER (ORDER BY repl, sim.obs_id) - 1) % (SELECT count(*) FROM obs) AS p
   FROM sim JOIN obs USING (obs_id)) b USING (p)"""))
def order_check(spark, sf):
    obs, sim = _order_tables(spark, sf)
    return pk.order_report(obs, sim, ["ID"], ["repl", "ID"])


@query("SELECT event_id, event_type, value FROM events")
def source_scan(spark, sf):
    return pk.read_table(spark, f"{sf}/events.parquet").select("event_id", "event_type", "value")


@query(with_(OBS, select="SELECT obs_id, y FROM obs WHERE strat <> 'error' AND y >= lloq AND pred IS NOT NULL"))
def record_filter(spark, sf):
    return pk.keep_records(obs_events(spark, sf), "strat <> 'error' and y >= lloq", present=["pred"]).select("obs_id", "y")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_acctbal FROM orders
  LEFT JOIN (SELECT c_custkey AS o_custkey, c_mktsegment, c_acctbal FROM customer) USING (o_custkey)""")
def covariate_join(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return pk.natural_left_join(orders, customers, ["o_custkey", "c_mktsegment", "c_acctbal"])


@query(with_(OBS, select="""SELECT obs_id, x AS "TIME", 0 AS "REPLICATE", CASE WHEN strat = 'click' THEN 100::DOUBLE ELSE 25::DOUBLE END AS limit_value,
  round(y * 2, 6) AS doubled FROM obs""").replace("x AS", "round(x, 6) AS"))
def derived_columns(spark, sf):
    df = pk.derive(obs_events(spark, sf), TIME="x", REPLICATE=0, limit_value="if(strat = 'click', 100D, 25D)", doubled="y * 2")
    return rounded(df.select("obs_id", "TIME", "REPLICATE", "limit_value", "doubled"))


@query(with_(OBS, SIM, select='SELECT obs.obs_id, y, round(y_sim, 6) AS "PRED" FROM obs LEFT JOIN (SELECT * FROM sim WHERE repl = 1) s USING (obs_id)'))
def pred_from_replicate(spark, sf):
    got = pk.from_replicate(obs_events(spark, sf).select("obs_id", "y"), sim_events(spark, sf, REPLICATES), "y_sim", "PRED")
    return rounded(got.select("obs_id", "y", "PRED"))


@query(with_(OBS, SIM, select="SELECT sim.obs_id, repl, strat, lloq FROM sim LEFT JOIN obs USING (obs_id)"))
def spread_over_replicates(spark, sf):
    return pk.spread_over_replicates(obs_events(spark, sf), sim_events(spark, sf, REPLICATES), ["strat", "lloq"]).drop("y_sim")


@query(with_(OBS, select="""SELECT obs_id, CASE (row_number() OVER (ORDER BY obs_id) - 1) % 2 WHEN 0 THEN 'F' ELSE 'M' END AS "SEX" FROM obs"""))
def cyclic_label(spark, sf):
    numbered = pk.dense_index(obs_events(spark, sf).select("obs_id"), ["obs_id"])
    return pk.cyclic_label(numbered, ["F", "M"], name="SEX").drop("row_index")


# ----------------------------------------------------------------------------------------------- censoring

@query(with_(OBS, select="SELECT obs_id, y < lloq AS blq FROM obs"))
def default_limit_flag(spark, sf):
    return pk.observed(obs_events(spark, sf).drop("blq"), "x", "y", id="obs_id", lloq="lloq").obs().select("obs_id", "blq")


@query(with_(OBS, select="SELECT obs_id, y < 10 AS blq, 10::DOUBLE AS lloq FROM obs"))
def censoring_override(spark, sf):
    return base(spark, sf).censoring(blq=F.col("y") < 10, lloq=10.0).obs().select("obs_id", "blq", "lloq")


@query(with_(OBS, BINNED, PLAIN, """qo AS (SELECT strat, b, unnest(q) AS y, generate_subscripts(q, 1)::INTEGER - 1 AS q_index FROM
  (SELECT strat, b, quantile_cont(CASE WHEN blq THEN '-infinity'::DOUBLE ELSE y END, [0.02, 0.05, 0.1, 0.5]) AS q FROM corr GROUP BY strat, b))""",
             select="SELECT strat, b::VARCHAR AS bin, q_index::INTEGER AS q_index, round(CASE WHEN y <> '-infinity'::DOUBLE THEN y END, 6) AS y FROM qo"))
def censored_quantiles(spark, sf):
    rows = stratified(spark, sf).binning(method="ntile", nbins=6).obs()
    rows = rows.select("strat", "bin", censored(F.col("y"), F.col("blq")).alias("v"))
    return rounded(long_quantiles(rows, ["strat", "bin"], "v", [0.02, 0.05, 0.1, 0.5], 7, None))


@query(with_(OBS, SIM, BINNED, select="""SELECT strat, b::VARCHAR AS bin, repl, round(100 * avg((y_sim < lloq)::INTEGER), 6) AS y
  FROM sim JOIN binned USING (obs_id) GROUP BY strat, b, repl"""))
def simulated_limit_share(spark, sf):
    flagged = ntiles(spark, sf).corrected_sim().withColumn("blq", F.col("y") < F.col("lloq"))
    return rounded(percent_below(flagged, ["strat", "bin", "repl"]))


@query(with_(OBS.replace("obs AS", "raw AS"), "obs AS (SELECT * FROM raw WHERE NOT blq)", SIM, BINNED, PLAIN, INFO,
             quantile_ctes(sim_value="s.y_sim", sim_filter="WHERE s.y_sim >= o.lloq"), select=stats_select()))
def statistics_without_censored(spark, sf):
    v = simulated(spark, sf).filter_blq().binning(method="ntile", nbins=6).statistics(QPRED)
    return rounded(v.stats)


# ------------------------------------------------------------------------------------------- stratification

@query(with_(ORD, ntile_sql(4, "status, priority"), info_sql("status, priority", "status, priority, b"),
             select=f"SELECT status, priority, b::VARCHAR AS bin, {INFO_OUT} FROM info"))
def strata_one_sided(spark, sf):
    v = pk.observed(obs_orders(spark, sf), "x", "y", id="obs_id").stratify("~ status + priority").binning(method="ntile", nbins=4)
    return info_rows(v)


@query(with_(ORD, select="""SELECT status, priority, count(*) AS nobs, dense_rank() OVER (ORDER BY status)::INTEGER AS facet_row,
  dense_rank() OVER (ORDER BY priority)::INTEGER AS facet_col FROM obs GROUP BY status, priority"""))
def strata_two_sided(spark, sf):
    return rp.facets(pk.observed(obs_orders(spark, sf), "x", "y", id="obs_id").stratify("status ~ priority"))


@query(with_(ORD, select="""SELECT status, count(*) AS nobs, dense_rank() OVER (ORDER BY status)::INTEGER AS facet_row, 1 AS facet_col
  FROM obs GROUP BY status"""))
def strata_one_empty_side(spark, sf):
    return rp.facets(pk.observed(obs_orders(spark, sf), "x", "y", id="obs_id").stratify("status ~ ."))


@query(with_(ORD, "s AS (SELECT *, y > 250000 AS large FROM obs)", ntile_sql(3, "large", "s"),
             select="SELECT obs_id, large, b::INTEGER AS bin_num FROM binned"))
def strata_derived(spark, sf):
    v = pk.observed(obs_orders(spark, sf), "x", "y", id="obs_id").stratify(cols=[("large", F.col("y") > 250000)])
    return row_bins(v.binning(method="ntile", nbins=3), ["large"])


@query(with_(OBS, SIM, BINNED, select="SELECT strat, b::VARCHAR AS bin, repl, count(*) AS n, round(sum(y_sim), 4) AS total FROM sim JOIN binned USING (obs_id) GROUP BY strat, b, repl"))
def strata_on_replicates(spark, sf):
    return ntiles(spark, sf).corrected_sim().groupBy("strat", "bin", "repl").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(with_(ORD, ntile_sql(5, "status"), info_sql("status", "status, b"), select=f"SELECT status, b::VARCHAR AS bin, {INFO_OUT} FROM info"))
def stratify_again(spark, sf):
    v = pk.observed(obs_orders(spark, sf), "x", "y", id="obs_id").stratify("~ priority").binning(method="ntile", nbins=4)
    return info_rows(v.stratify("~ status").binning(method="ntile", nbins=5))


# -------------------------------------------------------------------------------------------------- binning

@query(with_(OBS, "binned AS (SELECT *, x AS b FROM obs)", INFO, select=f"SELECT strat, round(b, 6) AS bin_num, {INFO_OUT} FROM info"))
def bin_is_column(spark, sf):
    return rounded(stratified(spark, sf).binning("x").bininfo().drop("bin"))


@query(with_(OBS, select="SELECT DISTINCT strat, (2 * floor(x / 2) + 1)::DOUBLE AS bin_num, (2 * floor(x / 2) + 1)::DOUBLE AS xbin FROM obs"))
def bin_is_numeric_xbin(spark, sf):
    v = stratified(spark, sf).binning(xbin=(F.floor(F.col("x") / 2) * 2 + 1).cast("double"))
    return v.bins().drop("bin")


def cut_sql(breaks, right=False, src="obs"):
    """Rows with their interval number, breaks extended to the data of every stratum."""
    op = "<" if right else "<="
    return f"""lim AS (SELECT strat, min(x) AS lo, max(x) AS hi FROM {src} GROUP BY strat),
e0 AS (SELECT strat, lo, hi, list_sort(list_distinct({breaks})) AS e FROM lim),
e1 AS (SELECT strat, CASE WHEN lo < e[1] THEN [lo] ELSE [] END || e || CASE WHEN hi > e[len(e)] THEN [hi] ELSE [] END AS e FROM e0),
cut AS (SELECT o.*, e, greatest(1, least(len(list_filter(e, lambda z: z {op} o.x)), len(e) - 1)) AS i FROM {src} o JOIN e1 USING (strat))"""


CUT_OUT = "SELECT obs_id, strat, i::INTEGER AS bin_num, round(e[i], 6) AS bin_left, round(e[i + 1], 6) AS bin_right FROM cut"


def cut_rows(spark, sf, **rule):
    got = pk.assign_bins(obs_events(spark, sf), "x", pk.BinRule(**rule), ["strat"], "obs_id")
    return rounded(got.select("obs_id", "strat", F.col("bin_num").cast("int").alias("bin_num"), "bin_left", "bin_right"))


@query(with_(OBS, cut_sql("[4::DOUBLE, 9::DOUBLE, 9::DOUBLE, 16.5::DOUBLE]"), select=CUT_OUT))
def bin_by_breaks(spark, sf):
    return cut_rows(spark, sf, method="breaks", breaks=[9, 4, 16.5, 9])


@query(with_(OBS, cut_sql("[4::DOUBLE, 9::DOUBLE, 16.5::DOUBLE]", right=True), select=CUT_OUT))
def bin_by_breaks_right(spark, sf):
    return cut_rows(spark, sf, method="breaks", breaks=[4, 9, 16.5], right=True)


@query(with_(OBS, cut_sql("[4::DOUBLE, 9::DOUBLE, 16.5::DOUBLE]"), select="""SELECT obs_id, printf('[%.3g,%.3g', e[i], e[i + 1]) ||
  CASE WHEN i = len(e) - 1 THEN ']' ELSE ')' END AS bin FROM cut"""))
def bin_labels(spark, sf):
    return stratified(spark, sf).binning(breaks=[4, 9, 16.5]).obs().select("obs_id", "bin")


@query(with_(OBS, select="""SELECT obs_id, strat, CASE WHEN abs(x - 3) <= least(abs(x - 9), abs(x - 20)) THEN 3::DOUBLE
  WHEN abs(x - 9) <= abs(x - 20) THEN 9::DOUBLE ELSE 20::DOUBLE END AS bin_num FROM obs"""))
def bin_by_nearest_center(spark, sf):
    return row_bins(stratified(spark, sf).binning(centers=[20, 3, 9]), number="double")


@query(with_(OBS, BINNED, select="SELECT obs_id, strat, b::INTEGER AS bin_num FROM binned"))
def bin_by_rank_groups(spark, sf):
    return row_bins(stratified(spark, sf).binning(method="ntile", nbins=6))


@query(with_(OBS, cut_sql("quantiles").replace("min(x) AS lo", "quantile_cont(x, [0.25, 0.5, 0.75]) AS quantiles, min(x) AS lo")
             .replace("SELECT strat, lo, hi, list_sort", "SELECT strat, lo, hi, list_sort"), select=CUT_OUT))
def bin_by_equal_counts(spark, sf):
    return cut_rows(spark, sf, method="eqcut", nbins=4)


# R-style quantile of one type over sorted values v (list) with n values, as SQL on the list.
def list_quantile(p, t, v="v"):
    n = f"len({v})"
    const = {4: (0.0, 1.0), 5: (0.5, 0.5), 6: (0.0, 0.0), 8: (1 / 3, 1 / 3), 9: (0.375, 0.375)}
    fuzz = repr(4 * 2.0 ** -52) + "::DOUBLE"
    P = f"{p}::DOUBLE"
    if t == 7:
        h, f = f"(({n} - 1) * {P} + 1)", "0"
    elif t in const:
        a, b = const[t]
        h, f = f"({a!r}::DOUBLE + {P} * ({n} + {1 - a - b!r}::DOUBLE))", fuzz
    else:
        h, f = f"({n} * {P} - {0.5 if t == 3 else 0.0}::DOUBLE)", fuzz
    j = f"floor({h} + {f})"
    if t == 1:
        g = f"(CASE WHEN {h} > {j} THEN 1 ELSE 0 END)::DOUBLE"
    elif t == 2:
        g = f"(CASE WHEN {h} > {j} THEN 1::DOUBLE ELSE 0.5::DOUBLE END)"
    elif t == 3:
        g = f"(CASE WHEN {h} <> {j} OR abs({j}) % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE"
    else:
        g = f"(CASE WHEN abs({h} - {j}) < {fuzz} THEN 0::DOUBLE ELSE {h} - {j} END)"
    lo, hi = (f"{v}[greatest(1, least({n}, {k}))::BIGINT]" for k in (j, f"{j} + 1"))
    return f"(CASE WHEN {lo} = {hi} OR {g} = 0 THEN {lo} WHEN {g} = 1 THEN {hi} ELSE (1 - {g}) * {lo} + {g} * {hi} END)"


@query(with_(OBS, "vals AS (SELECT strat AS s, list(x ORDER BY x) AS v FROM obs GROUP BY strat)",
             f"qs AS (SELECT s, [{', '.join(list_quantile(p, 6) for p in (0.2, 0.4, 0.6, 0.8))}] AS quantiles FROM vals)",
             cut_sql("quantiles").replace("FROM lim", "FROM lim JOIN qs ON s = strat"), select=CUT_OUT))
def bin_by_equal_counts_type6(spark, sf):
    return cut_rows(spark, sf, method="eqcut", nbins=5, quantile_type=6)


@query(with_(OBS, "vals AS (SELECT strat AS s, length(strat) AS k, list(x ORDER BY x) AS v FROM obs GROUP BY strat)",
             f"qs AS (SELECT s, list_transform(range(1, k), lambda z: {list_quantile('(z / k)', 7)}) AS quantiles FROM vals)",
             cut_sql("quantiles").replace("FROM lim", "FROM lim JOIN qs ON s = strat"), select="SELECT obs_id, strat, i::INTEGER AS bin_num FROM cut"))
def bin_equal_counts_per_stratum(spark, sf):
    table = obs_events(spark, sf).select("strat", F.length("strat").alias("nbins")).distinct()
    return row_bins(stratified(spark, sf).binning(method="eqcut", nbins=table))


@query(with_(OBS, cut_sql("[2::DOUBLE, 12::DOUBLE, 23::DOUBLE]"), select=CUT_OUT))
def bin_style_fixed(spark, sf):
    return cut_rows(spark, sf, method="fixed", options={"fixedBreaks": [2, 12, 23]})


def pretty_sql(lo, hi, n, source, name="pb"):
    """Round-number breaks as a table (strat, brk list); the data range here is never tiny next to its values."""
    return f"""p0 AS (SELECT strat, {lo} AS plo, {hi} AS phi, (({hi}) - ({lo})) / {n} AS cell FROM {source}),
p1 AS (SELECT *, pow(10::DOUBLE, floor(log10(cell))) AS u FROM p0),
p2 AS (SELECT *, u * CASE WHEN 2*u - cell < 1.5 * (cell - u) THEN CASE WHEN 5*u - cell < 2.75 * (cell - 2*u)
  THEN CASE WHEN 10*u - cell < 1.5 * (cell - 5*u) THEN 10 ELSE 5 END ELSE 2 END ELSE 1 END AS unit FROM p1),
p3 AS (SELECT *, floor(plo / unit + 1e-10) AS a, ceil(phi / unit - 1e-10) AS z FROM p2),
{name} AS (SELECT strat AS s, list_transform(range(0, (z - a + 1)::BIGINT), lambda k: (a + k) * unit) AS brk FROM p3)"""


@query(with_(OBS, "mm AS (SELECT strat, min(x) AS mn, max(x) AS mx FROM obs GROUP BY strat)", pretty_sql("mn", "mx", 5, "mm"),
             cut_sql("brk").replace("FROM lim", "FROM lim JOIN pb ON s = strat"), select=CUT_OUT))
def bin_style_pretty(spark, sf):
    return cut_rows(spark, sf, method="pretty", nbins=5)


@query(with_(OBS, "mm AS (SELECT strat, avg(x) AS m, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM obs GROUP BY strat)",
             pretty_sql("(mn - m) / sd", "(mx - m) / sd", 5, "mm"),
             "sb AS (SELECT s, list_transform(brk, lambda q: q * sd + m) AS brk FROM pb JOIN mm ON s = strat)",
             cut_sql("brk").replace("FROM lim", "FROM lim JOIN sb ON s = strat"), select=CUT_OUT))
def bin_style_sd(spark, sf):
    return cut_rows(spark, sf, method="sd", nbins=5)


def equal_sql(n):
    return cut_sql(f"list_transform(range(0, {n} + 1), lambda k: CASE WHEN k = 0 THEN lo WHEN k = {n} THEN hi ELSE lo + k * ((hi - lo) / {n}) END)")


@query(with_(OBS, equal_sql(7), select=CUT_OUT))
def bin_style_equal(spark, sf):
    return cut_rows(spark, sf, method="equal", nbins=7)


@query(with_(OBS, cut_sql("quantiles").replace("min(x) AS lo", "quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS quantiles, min(x) AS lo"), select=CUT_OUT))
def bin_style_quantile(spark, sf):
    return cut_rows(spark, sf, method="quantile", nbins=5)


@query(with_(OBS, equal_sql("n").replace("min(x) AS lo", "ceil(log2(count(*)) + 1)::BIGINT AS n, min(x) AS lo")
             .replace("SELECT strat, lo, hi, list_sort", "SELECT strat, lo, hi, n, list_sort"), select=CUT_OUT))
def bin_style_default_count(spark, sf):
    return cut_rows(spark, sf, method="equal")


def intervals_sql(k, src="obs", absolute=False):
    """The k intervals of least cost of every stratum by dynamic programming over all pairs of distinct values:
    best(strat, cost, parts), parts being {a, b, m} with the lowest, highest and lower median value of an interval."""
    if absolute:
        # the lower median of the sorted rows f..t is row (f + t) // 2
        prefix = f"""r AS (SELECT strat, x, row_number() OVER (PARTITION BY strat ORDER BY x) AS n, sum(x) OVER (PARTITION BY strat ORDER BY x ROWS UNBOUNDED PRECEDING) AS S FROM {src}),
v AS (SELECT strat, x, row_number() OVER (PARTITION BY strat ORDER BY x) AS i, f, t FROM (SELECT strat, x, min(n) AS f, max(n) AS t FROM r GROUP BY strat, x)),
c AS (SELECT a.strat, a.i, z.i AS j, (h.x * (h.n - a.f + 1) - (h.S - fr.S + fr.x)) + ((tr.S - h.S) - h.x * (z.t - h.n)) AS cost, h.x AS m
  FROM v a JOIN v z ON a.strat = z.strat AND z.i >= a.i JOIN r h ON h.strat = a.strat AND h.n = (a.f + z.t) // 2
  JOIN r fr ON fr.strat = a.strat AND fr.n = a.f JOIN r tr ON tr.strat = a.strat AND tr.n = z.t)"""
    else:
        prefix = f"""r AS (SELECT strat, x, count(*)::DOUBLE AS w, avg(avg(x)) OVER (PARTITION BY strat) AS o FROM {src} GROUP BY strat, x),
v AS (SELECT strat, x, row_number() OVER u AS i, sum(w) OVER u AS W, sum(w * (x - o)) OVER u AS S, sum(w * (x - o) * (x - o)) OVER u AS Q
  FROM r WINDOW u AS (PARTITION BY strat ORDER BY x)),
q AS (SELECT strat, i + 1 AS i, W, S, Q FROM v UNION ALL SELECT DISTINCT strat, 1, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM v),
c AS (SELECT a.strat, a.i, z.i AS j, (z.Q - a.Q) - (z.S - a.S) * (z.S - a.S) / (z.W - a.W) AS cost, NULL::DOUBLE AS m FROM q a JOIN v z ON a.strat = z.strat AND z.i >= a.i)"""
    layers = ["l1 AS (SELECT strat, j, cost, [{'i': i, 'j': j, 'm': m}] AS parts FROM c WHERE i = 1)"]
    for n in range(2, k + 1):
        layers.append(f"""l{n} AS (SELECT c.strat, c.j, min(l.cost + c.cost) AS cost, arg_min(l.parts || [{{'i': c.i, 'j': c.j, 'm': c.m}}], l.cost + c.cost) AS parts
  FROM c JOIN l{n - 1} l ON l.strat = c.strat AND l.j = c.i - 1 GROUP BY c.strat, c.j)""")
    last = f"""w AS (SELECT l.strat, cost, unnest(parts) AS p, generate_subscripts(parts, 1) AS n FROM l{k} l JOIN (SELECT strat, max(i) AS i FROM v GROUP BY strat) e ON e.strat = l.strat AND e.i = l.j),
best AS (SELECT w.strat AS s, any_value(cost) AS cost, list({{'a': f.x, 'b': t.x, 'm': p.m}} ORDER BY n) AS parts
  FROM w JOIN v f ON f.strat = w.strat AND f.i = p.i JOIN v t ON t.strat = w.strat AND t.i = p.j GROUP BY w.strat)"""
    return ",\n".join([prefix, *layers, last])


HALFWAY = "[parts[1].a] || list_transform(range(2, len(parts) + 1), lambda z: (parts[z - 1].b + parts[z].a) / 2) || [parts[len(parts)].b]"
UPPER_ENDS = "[parts[1].a] || list_transform(parts, lambda z: z.b)"
CLUSTER_LABEL = """binned AS (SELECT *, i AS b FROM cut),
labels AS (SELECT DISTINCT strat, i AS b, printf('[%.3g,%.3g', e[i], e[i + 1]) || CASE WHEN i = len(e) - 1 THEN ']' ELSE ')' END AS bin FROM cut)"""


def clusters_sql(breaks):
    return with_(OBS, intervals_sql(4), cut_sql(breaks).replace("FROM lim", "FROM lim JOIN best ON s = strat"), CLUSTER_LABEL, INFO,
                 select=f"SELECT strat, bin, b::DOUBLE AS bin_num, {INFO_OUT} FROM info JOIN labels USING (strat, b)")


def agglomeration_sql(k):
    """Complete linkage: the two neighbours with the least distance from end to end are merged, the lower ones of equal pairs, until k are left."""
    merge = """merged AS (SELECT strat, list(x ORDER BY x) AS lo, list(x ORDER BY x) AS hi FROM (SELECT DISTINCT strat, x FROM obs) GROUP BY strat UNION ALL
  SELECT strat, lo[:i] || lo[i + 2:], hi[:i - 1] || hi[i + 1:] FROM (SELECT *, list_position(gaps, list_min(gaps)) AS i FROM
    (SELECT *, list_transform(range(1, len(lo)), lambda z: hi[z + 1] - lo[z]) AS gaps FROM merged WHERE len(lo) > """ + str(k) + ")))"
    return merge + f", best AS (SELECT strat AS s, list_transform(range(1, {k} + 1), lambda z: {{'a': lo[z], 'b': hi[z]}}) AS parts FROM merged WHERE len(lo) = {k})"


AGGLOMERATION = "WITH RECURSIVE " + with_(OBS, agglomeration_sql(4), cut_sql(HALFWAY).replace("FROM lim", "FROM lim JOIN best ON s = strat"), CLUSTER_LABEL, INFO,
                                          select=f"SELECT strat, bin, b::DOUBLE AS bin_num, {INFO_OUT} FROM info JOIN labels USING (strat, b)").removeprefix("WITH ")
# Distances of whole minutes leave several best sets of medoids; those of prices are compared below.
_CLUSTERS = {"hclust": AGGLOMERATION, "kmeans": clusters_sql(HALFWAY), "fisher": clusters_sql(HALFWAY), "jenks": clusters_sql(UPPER_ENDS)}


def _clustered(method):
    def run(spark, sf):
        v = stratified(spark, sf).binning(method=method, nbins=4)
        return rounded(v.bininfo())
    run.__name__ = "bin_by_medoids" if method == "pam" else f"bin_style_{method}"
    return query(_CLUSTERS.get(method))(run)


for _m in ("pam", "kmeans", "hclust", "bclust", "fisher", "jenks", "dpih"):
    _clustered(_m)


def linkage_sql(k, gap, center, spread):
    """Merging neighbours by centres m, weights w and spreads s of clusters: the pair of least ``gap`` becomes one, until k are left."""
    at = {"a": "[i]", "b": "[i + 1]"}

    def of(sql, a, b):
        return sql.format(**{f"{n}{c}": f"{c}{at_}" for n, at_ in (("a", a), ("b", b)) for c in "mws"})
    lists = ", ".join(f"{c}[:i - 1] || [{of(sql, at['a'], at['b'])}] || {c}[i + 2:] AS {c}" for c, sql in (("m", center), ("w", "{aw} + {bw}"), ("s", spread)))
    gaps = of(gap, "[z]", "[z + 1]")
    merge = f"""merged AS (SELECT strat, list(x ORDER BY x) AS lo, list(x ORDER BY x) AS hi, list(x ORDER BY x) AS m, list(n ORDER BY x) AS w, list(0::DOUBLE) AS s
    FROM (SELECT strat, x, count(*)::DOUBLE AS n FROM obs GROUP BY strat, x) GROUP BY strat UNION ALL
  SELECT strat, lo[:i] || lo[i + 2:], hi[:i - 1] || hi[i + 1:], {lists} FROM (SELECT *, list_position(gaps, list_min(gaps)) AS i FROM
    (SELECT *, list_transform(range(1, len(lo)), lambda z: {gaps}) AS gaps FROM merged WHERE len(lo) > {k})))"""
    best = f"best AS (SELECT strat AS s, list_transform(range(1, {k} + 1), lambda z: {{'a': lo[z], 'b': hi[z]}}) AS parts FROM merged WHERE len(lo) = {k})"
    return "WITH RECURSIVE " + with_(OBS, merge, best, cut_sql(HALFWAY).replace("FROM lim", "FROM lim JOIN best ON s = strat"), CLUSTER_LABEL, INFO,
                                     select=f"SELECT strat, bin, b::DOUBLE AS bin_num, {INFO_OUT} FROM info JOIN labels USING (strat, b)").removeprefix("WITH ")


_APART, _WEIGHED = "({bm} - {am} - {as} - {bs})", "({aw} * {am} + {bw} * {bm}) / ({aw} + {bw})"
_LINKAGES = {"ward.D2": ("2 * {aw} * {bw} / ({aw} + {bw}) * ({bm} - {am}) * ({bm} - {am})", _WEIGHED, "0::DOUBLE"),
             "centroid": (_APART, _WEIGHED, "{aw} / ({aw} + {bw}) * {as} + {bw} / ({aw} + {bw}) * {bs} + {aw} / ({aw} + {bw}) * ({bw} / ({aw} + {bw})) * " + _APART),
             "median": (_APART, "({am} + {bm}) * 0.5::DOUBLE", "0.5::DOUBLE * {as} + 0.5::DOUBLE * {bs} + 0.25::DOUBLE * " + _APART)}


def _linked(linkage):
    def run(spark, sf):
        return rounded(stratified(spark, sf).binning(method="hclust", nbins=4, linkage=linkage).bininfo())
    run.__name__ = f"bin_style_hclust_{linkage.replace('.', '_').lower()}"
    return query(linkage_sql(4, *_LINKAGES[linkage]))(run)


for _m in _LINKAGES:
    _linked(_m)


# The least cost is unique even where several sets of intervals reach it. Prices have thousands of distinct values a stratum.
PRICES = "obs AS (SELECT o_orderpriority AS strat, o_totalprice AS x FROM orders)"


def prices(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("strat"), F.col("o_totalprice").alias("x"))


@query(with_(PRICES, intervals_sql(3, absolute=True), select="SELECT s AS strat, unnest(list_transform(parts, lambda z: z.m)) AS center FROM best"))
def medoids_of_prices(spark, sf):
    """The centres themselves: prices have one best set."""
    got = pk.assign_bins(prices(spark, sf), "x", pk.BinRule(method="pam", nbins=3), ["strat"], "id")
    return got.select("strat", F.col("bin_num").alias("center")).distinct()


@query(with_(PRICES, intervals_sql(3), select="SELECT s AS strat, round(cost / 1e6, 6) AS cost FROM best"))
def cluster_cost_squared(spark, sf):
    got = pk.assign_bins(prices(spark, sf), "x", pk.BinRule(method="fisher", nbins=3), ["strat"], "id")
    parts = got.groupBy("strat", "bin_num").agg((F.var_pop("x") * F.count("x")).alias("c"))
    return rounded(parts.groupBy("strat").agg((F.sum("c") / 1e6).alias("cost")))


@query(with_(PRICES, intervals_sql(3, absolute=True), select="SELECT s AS strat, round(cost, 6) AS cost FROM best"))
def cluster_cost_absolute(spark, sf):
    got = pk.assign_bins(prices(spark, sf), "x", pk.BinRule(method="pam", nbins=3), ["strat"], "id")
    return rounded(got.groupBy("strat").agg(F.sum(F.abs(F.col("x") - F.col("bin_num"))).alias("cost")))


# Every replicate of an odd number misses its first observation; one replicate has an id that no observation has.
@query(with_(OBS, SIM, select="""SELECT repl, count(*) AS rows, repl % 2 = 0 AND repl <> 4 AS aligned
  FROM sim WHERE NOT (repl % 2 = 1 AND obs_id = (SELECT min(obs_id) FROM obs)) GROUP BY repl"""))
def replicate_alignment(spark, sf):
    first = obs_events(spark, sf).agg(F.min("obs_id")).first()[0]
    broken = sim_events(spark, sf, REPLICATES).filter(~((F.col("repl") % 2 == 1) & (F.col("obs_id") == first)))
    broken = broken.withColumn("obs_id", F.when((F.col("repl") == 4) & (F.col("obs_id") == first), -1).otherwise(F.col("obs_id")))
    return stratified(spark, sf).simulated(broken, "y_sim").alignment()


@query(with_(OBS, "binned AS (SELECT *, floor(x / 6) AS b FROM obs)", INFO, select=f"SELECT strat, round(b, 6) AS bin_num, {INFO_OUT} FROM info"))
def bin_function_argument(spark, sf):
    v = stratified(spark, sf).binning(func=lambda x, strat, width: F.floor(x / width).cast("double"), width=6.0)
    return rounded(v.bininfo().drop("bin"))


@query(with_(OBS, "lim AS (SELECT event_id AS obs_id, 3 + event_id % 4 AS l FROM events)",
             select="SELECT obs_id, y < l AS blq, l::DOUBLE AS lloq FROM obs JOIN lim USING (obs_id)"))
def censoring_from_other_data(spark, sf):
    limits = load(spark, sf, "events").select(F.col("event_id").alias("obs_id"), (F.col("event_id") % 4 + 3).alias("limit_there"))
    return base(spark, sf).censoring(blq=F.col("y") < F.col("limit_there"), lloq="limit_there", data=limits).obs().select("obs_id", "blq", "lloq")


@query(with_(OBS, "st AS (SELECT strat, min(x) AS mn, max(x) AS mx FROM obs GROUP BY strat)", select="""SELECT obs_id, strat,
  least(4, floor((x - mn) / (mx - mn) * 5))::INTEGER AS bin_num FROM obs JOIN st USING (strat)"""))
def bin_by_user_expression(spark, sf):
    def fifths(x: Column, strat: Column, mn: Column, mx: Column) -> Column:
        return F.least(F.lit(4), F.floor((x - mn) / (mx - mn) * 5))
    return row_bins(stratified(spark, sf).binning(func=fifths, stats={"mn": F.min, "mx": F.max}))


@query(with_(OBS, "d AS (SELECT strat, x, dense_rank() OVER (PARTITION BY strat ORDER BY x) AS r FROM (SELECT DISTINCT strat, x FROM obs))",
             select="SELECT obs_id, strat, ((r - 1) // 100 + 1)::INTEGER AS bin_num FROM obs JOIN d USING (strat, x)"))
def bin_by_user_group_function(spark, sf):
    def hundreds(x, n, strat):
        return [i // 100 + 1 for i in range(len(x))]
    return row_bins(stratified(spark, sf).binning(func=hundreds, grouped=True))


@query(with_(OBS.replace("obs AS", "raw AS"), "obs AS (SELECT * REPLACE (y AS x), x AS x0 FROM raw)", ntile_sql(4).replace("FROM obs", "FROM obs"),
             "back AS (SELECT * REPLACE (x0 AS x) FROM binned)", INFO.replace("FROM binned", "FROM back"),
             select=f"SELECT strat, b::VARCHAR AS bin, {INFO_OUT} FROM info"))
def bin_on_other_variable(spark, sf):
    return info_rows(stratified(spark, sf).binning(method="ntile", nbins=4, altx="y"))


@query(with_(OBS, ntile_sql(6, ""), select="SELECT obs_id, strat, b::INTEGER AS bin_num FROM binned"))
def bin_pooled(spark, sf):
    return row_bins(stratified(spark, sf).binning(method="ntile", nbins=6, by_strata=False))


@query(with_(OBS, "binned AS (SELECT *, CASE WHEN strat IN ('click', 'view') THEN (4 * (row_number() OVER (PARTITION BY strat ORDER BY x, obs_id) - 1))"
             " // count(*) OVER (PARTITION BY strat) + 1 WHEN strat = 'error' THEN CASE WHEN x < 12 THEN 1 ELSE 2 END END AS b FROM obs)",
             select="SELECT obs_id, strat, b::INTEGER AS bin_num FROM binned"))
def bin_selected_strata(spark, sf):
    v = stratified(spark, sf).binning(method="ntile", nbins=2, stratum={"strat": ["click", "error"]})
    v = v.binning(method="ntile", nbins=4, stratum=[{"strat": "click"}, {"strat": "view"}])
    return row_bins(v.binning(breaks=[12], stratum={"strat": "error"}))


@query(with_(OBS, """binned AS (SELECT *, (k * (row_number() OVER (PARTITION BY strat ORDER BY x, obs_id) - 1)) // count(*) OVER (PARTITION BY strat) + 1 AS b
  FROM (SELECT *, length(strat) AS k FROM obs))""", select="SELECT obs_id, strat, b::INTEGER AS bin_num FROM binned"))
def bin_count_per_stratum(spark, sf):
    table = obs_events(spark, sf).select("strat", F.length("strat").alias("nbins")).distinct()
    return row_bins(stratified(spark, sf).binning(method="ntile", nbins=table))


@query(with_(OBS, """binned AS (SELECT *, (k * (row_number() OVER (PARTITION BY strat ORDER BY x, obs_id) - 1)) // count(*) OVER (PARTITION BY strat) + 1 AS b
  FROM (SELECT *, CASE WHEN lloq > 3 THEN 3 ELSE 5 END AS k FROM obs))""", select="SELECT obs_id, strat, b::INTEGER AS bin_num FROM binned"))
def bin_count_per_row(spark, sf):
    return row_bins(stratified(spark, sf).binning(method="ntile", nbins=F.when(F.col("lloq") > 3, 3).otherwise(5)))


@query(with_(OBS, cut_sql("[6::DOUBLE, 6::DOUBLE + length(strat)]"), select=CUT_OUT))
def bin_breaks_per_stratum(spark, sf):
    first = obs_events(spark, sf).select("strat").distinct()
    table = first.select("strat", F.explode(F.array(F.lit(6.0), F.length("strat") + F.lit(6.0))).alias("breaks"))
    return cut_rows(spark, sf, method="breaks", breaks=table)


@query(with_(OBS, select="""SELECT obs_id, strat, CASE WHEN abs(x - 2) <= abs(x - (10 + length(strat))) THEN 2::DOUBLE
  ELSE (10 + length(strat))::DOUBLE END AS bin_num FROM obs"""))
def bin_centers_per_stratum(spark, sf):
    first = obs_events(spark, sf).select("strat").distinct()
    table = first.select("strat", F.explode(F.array(F.lit(2.0), F.length("strat") + F.lit(10.0))).alias("centers"))
    return row_bins(stratified(spark, sf).binning(centers=table), number="double")


@query(with_(OBS, BINNED, INFO, select="SELECT strat, b::VARCHAR AS bin, round(xmean, 6) AS xbin FROM info"))
def xbin_by_name(spark, sf):
    return rounded(stratified(spark, sf).binning(method="ntile", nbins=6, xbin="xmean").bins().drop("bin_num"))


@query(with_(OBS, BINNED, select="SELECT strat, b::VARCHAR AS bin, round((min(x) + 3 * max(x)) / 4, 6) AS xbin FROM binned GROUP BY strat, b"))
def xbin_by_function(spark, sf):
    v = stratified(spark, sf).binning(method="ntile", nbins=6, xbin=lambda x: (F.min(x) + F.max(x) * 3) / 4)
    return rounded(v.bins().drop("bin_num"))


# ------------------------------------------------------------------------------------------ bin information

@query(with_(OBS, BINNED, INFO, select=f"SELECT strat, b::VARCHAR AS bin, {INFO_OUT} FROM info"))
def bin_information(spark, sf):
    return info_rows(stratified(spark, sf).binning(method="ntile", nbins=6))


@query(with_(OBS, ntile_sql(6, ""), info_sql("", "b"), "pairs AS (SELECT DISTINCT strat, b FROM binned)",
             select=f"SELECT strat, b::VARCHAR AS bin, {INFO_OUT} FROM pairs JOIN info USING (b)"))
def bin_information_pooled(spark, sf):
    return info_rows(stratified(spark, sf).binning(method="ntile", nbins=6, by_strata=False))


# ------------------------------------------------------------------------------------ prediction correction

@query(with_(OBS, BINNED, select="SELECT strat, b::VARCHAR AS bin, median(pred) AS mpred FROM binned GROUP BY strat, b"))
def median_prediction_per_bin(spark, sf):
    v = stratified(spark, sf).binning(method="ntile", nbins=6)
    return median_prediction(v.obs(), ["strat", "bin"], v.sizes["largest"])


def corrected_sql(expr):
    return with_(OBS, SIM, BINNED, "m AS (SELECT *, median(pred) OVER (PARTITION BY strat, b) AS mpred FROM binned)",
                 "a AS (SELECT obs_id, 0 AS repl, y, pred, mpred FROM m UNION ALL SELECT obs_id, repl, y_sim, pred, mpred FROM sim JOIN m USING (obs_id))",
                 select=f"SELECT obs_id, repl, round({expr}, 6) AS ypc FROM a")


def corrected_rows(v):
    obs = v.corrected_obs().select("obs_id", F.lit(0).alias("repl"), "ypc")
    return rounded(obs.unionByName(v.corrected_sim().select("obs_id", "repl", "ypc")))


@query(corrected_sql("mpred / pred * y"))
def correction_ratio(spark, sf):
    return corrected_rows(ntiles(spark, sf).predcorrect())


@query(corrected_sql("(mpred - pred) + y"))
def correction_log(spark, sf):
    return corrected_rows(ntiles(spark, sf).predcorrect("pred", log=True))


@query(corrected_sql("1 + (y - 1) * ((mpred - 1) / (pred - 1))"))
def correction_lower_bound(spark, sf):
    return corrected_rows(ntiles(spark, sf).predcorrect(lower_bound=1.0))


@query(with_(OBS, SIM, BINNED, PLAIN, INFO, quantile_ctes(), select=stats_select()))
def statistics_uncorrected(spark, sf):
    return rounded(ntiles(spark, sf).predcorrect().nopredcorrect().statistics(QPRED).stats)


# ----------------------------------------------------------------------------------------------- statistics

def split_sql(value):
    return with_(OBS, select=f"SELECT strat, count({value}) AS n, " + ", ".join(
        f"round(quantile_cont({value}, {p}), 6) AS q{i}" for i, p in enumerate(QPRED)) + " FROM obs GROUP BY strat")


def split_quantiles_of(df, value):
    got = grouped_quantiles(df.withColumn("v", value), ["strat"], "v", QPRED, limit=150)
    return rounded(got.select("strat", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(3)]))


# Groups of more than 150 rows are cut into ranges of values, as groups of millions are without the argument.
@query(split_sql("y"))
def split_quantiles(spark, sf):
    return split_quantiles_of(obs_events(spark, sf), F.col("y"))


@query(split_sql("floor(x / 5)"))
def split_quantiles_of_ties(spark, sf):
    return split_quantiles_of(obs_events(spark, sf), F.floor(F.col("x") / 5).cast("double"))


@query(with_(OBS, SIM, select="SELECT strat, repl, " + ", ".join(f"round(quantile_cont(y_sim, {p}), 6) AS q{i}" for i, p in enumerate(QPRED)) +
             " FROM sim JOIN obs USING (obs_id) GROUP BY strat, repl"))
def bracketed_replicates(spark, sf):
    rows = sim_events(spark, sf, REPLICATES).join(obs_events(spark, sf).select("obs_id", "strat"), "obs_id")
    got = bracketed_quantiles(rows, ["strat"], "repl", [2, 8, 14, 20], "y_sim", QPRED)
    return rounded(got.select("strat", "repl", *[F.col("q")[i].alias(f"q{i}") for i in range(3)]))


@query(_SQL["bracketed_replicates"])
def counted_replicates(spark, sf):
    """The same quantiles from two passes, of which only the second shuffles values, those near a quantile."""
    rows = sim_events(spark, sf, REPLICATES).join(obs_events(spark, sf).select("obs_id", "strat"), "obs_id")
    got = counted_quantiles(rows, ["strat"], "repl", [4, 10, 16], "y_sim", QPRED)
    return rounded(got.select("strat", "repl", *[F.col("q")[i].alias(f"q{i}") for i in range(3)]))


@query(with_(OBS, "vals AS (SELECT strat, list(y ORDER BY y) AS v FROM obs GROUP BY strat)", select=" UNION ALL ".join(
    f"SELECT strat, {t} AS qtype, " + ", ".join(f"round({list_quantile(p, t)}, 6) AS q{i}" for i, p in enumerate((0.05, 0.5, 0.95, 0.333))) + " FROM vals"
    for t in range(1, 10))))
def quantile_types(spark, sf):
    rows = obs_events(spark, sf).select("strat", "y")
    out = None
    for t in range(1, 10):
        got = grouped_quantiles(rows, ["strat"], "y", [0.05, 0.5, 0.95, 0.333], t)
        got = got.select("strat", F.lit(t).alias("qtype"), *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(4)])
        out = got if out is None else out.unionByName(got)
    return out


@query(with_(OBS, SIM, BINNED, CORR, quantile_ctes(), select="""SELECT strat, b::VARCHAR AS bin, (i - 1)::INTEGER AS q_index,
  round(CASE WHEN y <> '-infinity'::DOUBLE THEN y END, 6) AS y FROM qo"""))
def observed_quantiles(spark, sf):
    return rounded(flagship(spark, sf).observed_quantiles())


@query(with_(OBS, SIM, BINNED, CORR, quantile_ctes(), select="SELECT strat, b::VARCHAR AS bin, repl, (i - 1)::INTEGER AS q_index, round(y, 6) AS y FROM qr"))
def replicate_quantiles(spark, sf):
    return rounded(flagship(spark, sf).replicate_quantiles())


@query(with_(OBS, SIM, BINNED, INFO, f"""po AS (SELECT strat, b, 100 * avg(blq::INTEGER) AS y FROM binned GROUP BY strat, b),
pr AS (SELECT strat, b, repl, 100 * avg((y_sim < lloq)::INTEGER) AS y FROM sim JOIN binned USING (obs_id) GROUP BY strat, b, repl),
pq AS (SELECT strat, b, quantile_cont(y, 0.025) AS lo, quantile_cont(y, 0.5) AS md, quantile_cont(y, 0.975) AS hi FROM pr GROUP BY strat, b)""",
             select="""SELECT strat, b::VARCHAR AS bin, round(xmedian, 6) AS xbin, round(y, 6) AS y, round(lo, 6) AS lo, round(md, 6) AS md,
  round(hi, 6) AS hi FROM pq JOIN po USING (strat, b) JOIN info USING (strat, b)"""))
def percent_below_limit(spark, sf):
    return rounded(flagship(spark, sf).pctblq)


@query(with_(OBS, SIM, BINNED, CORR, INFO, quantile_ctes((0.1, 0.25, 0.75, 0.9), 0.8), select=stats_select((0.1, 0.25, 0.75, 0.9))))
def statistics_other_levels(spark, sf):
    return rounded(ntiles(spark, sf).predcorrect().statistics((0.1, 0.25, 0.75, 0.9), conf_level=0.8).stats)


def _type6_sql():
    def one(src, value, keys):
        return f"(SELECT {keys}, list({value} ORDER BY {value}) AS v FROM {src} GROUP BY {keys})"
    qs = "[" + ", ".join(list_quantile(p, 6) for p in QPRED) + "]"
    return with_(
        OBS, SIM, BINNED, CORR, INFO,
        f"""qo AS (SELECT strat, b, unnest(q) AS y, generate_subscripts(q, 1) AS i FROM (SELECT strat, b, {qs} AS q FROM
  (SELECT strat, b, list(z ORDER BY z) AS v FROM (SELECT strat, b, CASE WHEN blq THEN '-infinity'::DOUBLE ELSE ypc END AS z FROM corr) GROUP BY strat, b)))""",
        f"""qr AS (SELECT strat, b, repl, unnest(q) AS y, generate_subscripts(q, 1) AS i FROM (SELECT strat, b, repl, {qs} AS q FROM
  (SELECT strat, b, repl, list(z ORDER BY z) AS v FROM (SELECT strat, b, repl, y_sim * pc AS z FROM sim JOIN corr USING (obs_id)) GROUP BY strat, b, repl)))""",
        f"""qq AS (SELECT strat, b, i, {list_quantile(0.025, 6)} AS lo, {list_quantile(0.5, 6)} AS md, {list_quantile(0.975, 6)} AS hi FROM
  {one('qr', 'y', 'strat, b, i')})""", select=stats_select())


@query(_type6_sql())
def statistics_type6(spark, sf):
    return rounded(ntiles(spark, sf).predcorrect().statistics(QPRED, quantile_type=6).stats)


@query(with_(ORD, ntile_sql(5, "status, priority"),
             f"sim AS (SELECT obs_id, r.repl::INTEGER AS repl, y * (((obs_id * 7 + r.repl * 13) % 51)::DOUBLE / 50::DOUBLE + 0.5::DOUBLE) AS y_sim FROM obs, range(1, {REPLICATES + 1}) r(repl))",
             "corr AS (SELECT *, (median(pred) OVER (PARTITION BY status, priority, b) / pred) * y AS ypc, median(pred) OVER (PARTITION BY status, priority, b) / pred AS pc FROM binned)",
             info_sql("status, priority", "status, priority, b"), quantile_ctes(censor=False, keys="status, priority, b"),
             select=stats_select(keys="status, priority", xbin="xmid")))
def statistics_two_way_strata(spark, sf):
    obs = obs_orders(spark, sf)
    sim = obs.select("obs_id", "y", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))).alias("repl"))
    factor = ((F.col("obs_id") * 7 + F.col("repl") * 13) % 51).cast("double") / 50.0 + 0.5
    v = pk.observed(obs, "x", "y", id="obs_id", pred="pred").simulated(sim.withColumn("y_sim", F.col("y") * factor), "y_sim")
    return rounded(v.stratify("status ~ priority").binning(method="ntile", nbins=5, xbin="xmid").predcorrect().statistics(QPRED).stats)


# --------------------------------------------------------------------------------------- reports, plot data

@query(with_(OBS, SIM, select="""SELECT (SELECT count(*) FROM sim) // (SELECT count(*) FROM obs) AS replicates, true AS prediction_corrected,
  'strat' AS stratified_by, true AS has_stats"""))
def summary(spark, sf):
    return flagship(spark, sf).summary()


@query(with_(OBS, SIM, BINNED, CORR, INFO, quantile_ctes(), select="SELECT strat, xbin, qname, (['5%', '50%', '95%'])[list_position(['q0.05', 'q0.5', 'q0.95'], qname)] AS label, y, lo, md, hi FROM (" + stats_select() + ")"))
def plot_ribbon(spark, sf):
    return rounded(rp.ribbon(flagship(spark, sf)))


@query(with_(OBS, BINNED, CORR, select="SELECT obs_id, strat, round(x, 6) AS x, round(ypc, 6) AS y FROM corr"))
def plot_points(spark, sf):
    return rounded(rp.points(flagship(spark, sf)))


@query(with_(OBS, BINNED, "m AS (SELECT strat, b, row_number() OVER (PARTITION BY strat ORDER BY avg(x), b::VARCHAR)::INTEGER AS color FROM binned GROUP BY strat, b)",
             select="SELECT obs_id, strat, b::VARCHAR AS bin, round(x, 6) AS x, y, color FROM binned JOIN m USING (strat, b)"))
def plot_bin_colors(spark, sf):
    return rounded(rp.colored_points(ntiles(spark, sf)))


@query(with_(OBS, BINNED, INFO, select="SELECT DISTINCT strat, round(unnest([xleft, xright]), 6) AS x FROM info"))
def plot_boundaries(spark, sf):
    return rounded(rp.boundaries(ntiles(spark, sf)))


@query(with_(OBS, select="SELECT strat, count(*) AS nobs, row_number() OVER (ORDER BY strat)::INTEGER AS facet FROM obs GROUP BY strat"))
def plot_facets(spark, sf):
    return rp.facets(stratified(spark, sf))


COORDS = "round(xmin, 6) AS \"XMIN\", round(xmax, 6) AS \"XMAX\", round(xmid, 6) AS \"XMID\", round(xmedian, 6) AS \"XMED\", round(xmean, 6) AS \"XMEAN\", round(xleft, 6) AS \"XLEFT\", round(xright, 6) AS \"XRIGHT\", round(xcenter, 6) AS \"XCENTER\""


@query(with_(OBS, SIM, BINNED, CORR, INFO, quantile_ctes(), select=f"""SELECT strat, (['5%PI', '50%PI', '95%PI'])[i] AS "QNAME",
  round(CASE WHEN qo.y <> '-infinity'::DOUBLE THEN qo.y END, 6) AS "RAWOBS", round(lo, 6) AS "SIM2.5%CI", round(md, 6) AS "SIM50%CI",
  round(hi, 6) AS "SIM97.5%CI", {COORDS} FROM qq JOIN qo USING (strat, b, i) JOIN info USING (strat, b)"""))
def report_intervals(spark, sf):
    return rounded(pk.report(flagship(spark, sf))["PI"])


@query(with_(OBS, BINNED, INFO, "l AS (SELECT strat, b, min(lloq) AS \"LLOQ\" FROM binned GROUP BY strat, b)",
             select=f'SELECT strat, nobs AS "NOBS", "LLOQ", {COORDS} FROM info JOIN l USING (strat, b)'))
def report_bins(spark, sf):
    return rounded(pk.report(flagship(spark, sf))["BINS"])


@query(with_(OBS, BINNED, CORR, select='SELECT strat, round(x, 6) AS "TIME", round(ypc, 6) AS "DVC" FROM corr'))
def report_corrected_points(spark, sf):
    return rounded(pk.report(flagship(spark, sf))["DVC"])


@query(with_(OBS, SIM, BINNED, INFO, f"""po AS (SELECT strat, b, 100 * avg(blq::INTEGER) AS y FROM binned GROUP BY strat, b),
pr AS (SELECT strat, b, repl, 100 * avg((y_sim < lloq)::INTEGER) AS y FROM sim JOIN binned USING (obs_id) GROUP BY strat, b, repl),
pq AS (SELECT strat, b, quantile_cont(y, 0.025) AS lo, quantile_cont(y, 0.5) AS md, quantile_cont(y, 0.975) AS hi FROM pr GROUP BY strat, b)""",
             select=f"""SELECT strat, 'PCTBLQ' AS "QNAME", round(y, 6) AS "RAWOBS", round(lo, 6) AS "SIM2.5%CI", round(md, 6) AS "SIM50%CI",
  round(hi, 6) AS "SIM97.5%CI", {COORDS} FROM pq JOIN po USING (strat, b) JOIN info USING (strat, b)"""))
def report_percent_below(spark, sf):
    return rounded(pk.report(flagship(spark, sf))["PCTBLQ"])


@query("SELECT * FROM (" + FLAGSHIP_SQL + ") WHERE strat IN ('click', 'view')")
def filter_levels(spark, sf):
    return rounded(rp.filter_levels(flagship(spark, sf).stats, {"strat": ["click", "view"]}))


LOGGED = OBS.replace("value AS y", "ln(value) AS y")


@query(with_(LOGGED, SIM.replace("value *", "ln(value) *"), BINNED, "corr AS (SELECT *, y AS ypc, 1::DOUBLE AS pc FROM binned)", INFO,
             quantile_ctes(censor=False), select="SELECT strat, bin, xbin, qname, " + ", ".join(f"round(exp({c}), 4) AS {c}" for c in ("y", "lo", "md", "hi")) + " FROM ("
             + stats_select().replace(", 6)", ", 12)").replace("round(xmedian, 12)", "round(xmedian, 6)") + ")"))
def back_transformed(spark, sf):
    obs, sim = obs_events(spark, sf), sim_events(spark, sf, REPLICATES, natural_log(F.col("value")))
    v = pk.observed(obs, "x", natural_log(F.col("y")), id="obs_id", blq=F.lit(False)).simulated(sim, "y_sim").stratify("~ strat")
    stats = rp.back_transform(v.binning(method="ntile", nbins=6).statistics(QPRED).stats)
    return stats.select("strat", "bin", F.round("xbin", 6).alias("xbin"), "qname", *[F.round(c, 4).alias(c) for c in ("y", "lo", "md", "hi")])


@query("SELECT strat, bin, xbin, qname, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 5::DOUBLE) END AS {c}" for c in ("y", "lo", "md", "hi")) + " FROM (" + FLAGSHIP_SQL + ")")
def floored_values(spark, sf):
    return rounded(rp.floor_values(flagship(spark, sf).stats, 5.0))


@query("SELECT qname, round(avg(y), 4) AS mean_y, dense_rank() OVER (ORDER BY avg(y))::INTEGER AS place FROM (" + FLAGSHIP_SQL + ") GROUP BY qname")
def quantile_order(spark, sf):
    return rp.quantile_order(flagship(spark, sf).stats).withColumn("mean_y", F.round("mean_y", 4))


@query("SELECT strat, bin, qname, round(lo, 6) AS lo, round(hi, 6) AS hi, 95::DOUBLE AS width FROM (" + FLAGSHIP_SQL + ")")
def interval_width_label(spark, sf):
    v = flagship(spark, sf)
    return rounded(v.stats.select("strat", "bin", "qname", "lo", "hi", F.lit(rp.interval_width(v)).alias("width")))


@query(with_(OBS, BINNED, INFO, select="SELECT strat, round(xmid, 6) AS x, nobs AS label FROM info"))
def plot_observation_labels(spark, sf):
    return rounded(rp.observation_labels(ntiles(spark, sf)))


@query(with_(OBS, BINNED, INFO, select="SELECT strat, round(xleft, 6) AS xleft, round(xright, 6) AS xright FROM info"))
def plot_rug(spark, sf):
    return rounded(rp.rug(ntiles(spark, sf)))


@query(with_(OBS, SIM, "binned AS (SELECT *, hour(ts)::DOUBLE AS b FROM obs JOIN (SELECT event_id AS obs_id, ts FROM events) USING (obs_id))",
             "cut0 AS (SELECT * REPLACE (b AS x) FROM binned)", PLAIN.replace("FROM binned", "FROM cut0"), INFO.replace("FROM binned", "FROM cut0"),
             quantile_ctes(), select=stats_select(bin="b::BIGINT::VARCHAR")))
def statistics_without_binning(spark, sf):
    hourly = obs_events(spark, sf).withColumn("x", F.floor("x").cast("double"))
    v = pk.observed(hourly, "x", "y", id="obs_id", blq="blq", lloq="lloq").stratify("~ strat").simulated(sim_events(spark, sf, REPLICATES), "y_sim")
    return rounded(v.binning("x").statistics(QPRED).stats)


MANY_BREAKS = 5000


@query(with_("obs AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders)",
             f"lim AS (SELECT min(x) AS lo, max(x) AS hi FROM obs), given AS (SELECT (range * 100)::DOUBLE AS e FROM range({MANY_BREAKS}))",
             "edges AS (SELECT e FROM given UNION SELECT lo FROM lim WHERE lo < (SELECT min(e) FROM given) UNION SELECT hi FROM lim WHERE hi > (SELECT max(e) FROM given))",
             "n AS (SELECT count(*) AS n FROM edges), numbered AS (SELECT e, row_number() OVER (ORDER BY e) AS i FROM edges)",
             select="SELECT o.id, greatest(1, least(c.i, n - 1))::DOUBLE AS bin_num FROM (obs o ASOF JOIN numbered c ON o.x >= c.e), n"))
def bin_by_many_breaks(spark, sf):
    """Thousands of cuts, pooled, looked up by halving."""
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return pk.assign_bins(rows, "x", pk.BinRule(method="breaks", breaks=[i * 100.0 for i in range(MANY_BREAKS)])).select("id", "bin_num")


@query(with_("obs AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders)", f"given AS (SELECT (range * 100)::DOUBLE AS c FROM range({MANY_BREAKS}))",
             "b AS (SELECT o.*, c AS lower FROM obs o ASOF LEFT JOIN given ON o.x >= given.c)",
             select="SELECT b.id, CASE WHEN lower IS NULL THEN u.c WHEN u.c IS NULL OR abs(x - lower) <= abs(x - u.c) THEN lower ELSE u.c END AS bin_num FROM b ASOF LEFT JOIN given u ON b.x < u.c"))
def bin_by_many_centers(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return pk.assign_bins(rows, "x", pk.BinRule(method="centers", centers=[i * 100.0 for i in range(MANY_BREAKS)])).select("id", "bin_num")


@query(with_(OBS, "lim AS (SELECT min(x) AS lo, max(x) AS hi, min(y) AS a, median(y) AS m, max(y) AS b FROM obs)",
             """cut AS (SELECT strat, y, x <= lo + (hi - lo) / 2 AS early, y <= m AS small, printf('%.3g', lo - (hi - lo) / 1000) AS p, printf('%.3g', lo + (hi - lo) / 2) AS q,
  printf('%.3g', hi + (hi - lo) / 1000) AS r, printf('%.3g', a) AS ya, printf('%.3g', m) AS ym, printf('%.3g', b) AS yb FROM obs, lim)""",
             select="""SELECT CASE WHEN early THEN '(' || p || ',' || q || ']' ELSE '(' || q || ',' || r || ']' END AS cut_x_2,
  CASE WHEN small THEN '[' || ya || ',' || ym || ']' ELSE '(' || ym || ',' || yb || ']' END AS level, count(*) AS n, round(avg(y), 6) AS mean_y FROM cut GROUP BY ALL"""))
def strata_fitted(spark, sf):
    """Strata that need the range or the quantiles of the data."""
    v = base(spark, sf).stratify("cut(x, 2) ~ level = quantiles(y, 2)")
    return rounded(v.obs().groupBy("cut_x_2", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


def _moments() -> pk.Mergeable:
    """Breaks at the mean and one standard deviation to both sides."""
    def finish(state, group):
        n, mean, squares = state
        sd = (squares / (n - 1)) ** 0.5
        return [mean - sd, mean, mean + sd]

    def merge(a, b):
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * b[0] / max(n, 1), a[2] + b[2] + apart * apart * a[0] * b[0] / max(n, 1)

    return pk.Mergeable(lambda: (0, 0.0, 0.0), lambda s, x: merge(s, (len(x), x.mean(), ((x - x.mean()) ** 2).sum())), merge, finish)


@query(with_(OBS, "m AS (SELECT strat, avg(x) AS a, stddev_samp(x) AS sd FROM obs GROUP BY strat)",
             "binned AS (SELECT obs.*, (1 + (x >= a - sd)::INTEGER + (x >= a)::INTEGER + (x >= a + sd)::INTEGER) AS b FROM obs JOIN m USING (strat))",
             select="""SELECT strat, b::DOUBLE AS bin_num, count(*) AS nobs, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(avg(DISTINCT floor(x)), 6) AS xbin
  FROM binned GROUP BY strat, b"""))
def bin_by_mergeable_function(spark, sf):
    """Breaks and the x of a bin from states that are merged: moments, and the set of hours that occur."""
    hours = pk.Mergeable(set, lambda s, x: s | set(x.astype(int).tolist()), lambda a, b: a | b, lambda s, group: sum(s) / len(s))
    v = stratified(spark, sf).binning(func=_moments(), xbin=hours)
    return rounded(v.bininfo().select("strat", "bin_num", "nobs", "xmin", "xmax").join(v.bins().select("strat", "bin_num", "xbin"), ["strat", "bin_num"]))


@query(_SQL["interval_statistics"])
def statistics_of_added_replicates(spark, sf):
    """The flagship after half of its replicates were checked before: only the others are computed."""
    store, sim = f"{shared_dir(spark)}/quantiles-{uuid.uuid4().hex}", sim_events(spark, sf, REPLICATES)

    def stated(rows):
        return base(spark, sf).simulated(rows, "y_sim").stratify("~ strat").binning(method="ntile", nbins=6).predcorrect().statistics(QPRED, store=store).stats

    stated(sim.filter(F.col("repl") <= REPLICATES // 2)).count()
    return rounded(stated(sim))


@query(_SQL["interval_statistics"])
def statistics_of_stored_replicates(spark, sf):
    """The flagship from replicates that are stored in buckets by observation."""
    name = f"replicates_{uuid.uuid4().hex}"
    stored = pk.store_replicates(sim_events(spark, sf, REPLICATES), name, "y_sim", "obs_id", buckets=16, path=f"{shared_dir(spark)}/{name}")
    return rounded(base(spark, sf).simulated(stored, "y_sim").stratify("~ strat").binning(method="ntile", nbins=6).predcorrect().statistics(QPRED).stats)


# ------------------------------------------------------------------------------------------ driver contract

def entry(spark: SparkSession) -> DataFrame:
    """The flagship check on the smallest tables."""
    return flagship(spark, ENTRY_DIR).stats


def _add_corpus_queries() -> None:
    """The queries for training data, if their subpackage is there; any other failed import is an error."""
    parts = ("predcheck.llm", "predcheck.llm.queries", "corpus_pipeline")
    try:
        from predcheck.llm import queries as corpus
    except ModuleNotFoundError as e:
        if e.name not in parts:
            raise
        return
    _QUERIES.update(corpus.QUERIES)
    _SQL.update(corpus.SQL)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name not in parts:
            raise
        return
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


_add_corpus_queries()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
