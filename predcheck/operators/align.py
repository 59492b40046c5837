"""Row positions, and the alignment of simulated rows with observed rows.

Spark rows have no order, so a position comes from columns the caller names, or from the places of the rows in the files they are read from. The first is
a range sort plus per-partition offsets, the second needs no sort; no step orders the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.values import as_column
from ..plans.storage import compact, materialize, small

_LOCAL_BITS = 33


def dense_index(df: DataFrame, order: Sequence, name: str = "row_index") -> DataFrame:
    """Add 0-based positions 0..n-1 in the order of the given columns, which should be unique together."""
    ranged = df.repartitionByRange(*[as_column(c) for c in order]).sortWithinPartitions(*[as_column(c) for c in order])
    # The provisional id is partition << 33 plus the row's place in the partition. It is stored before it is used,
    # so that a recomputed partition cannot renumber rows.
    stored = materialize(ranged.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", _LOCAL_BITS)
    sizes = stored.groupBy(part.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__start"))
    placed = stored.withColumn("__pid", part).join(F.broadcast(offsets), "__pid")
    local = F.col("__mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return placed.withColumn(name, F.col("__start") + local).drop("__pid", "__start", "__mid")


#: The order in which rows stand in the files they are read from.
FILES = "files"


def file_index(df: DataFrame, columns: Sequence | None = None, name: str = "row_index") -> tuple[DataFrame, int]:
    """(columns and 0-based positions in the order of the files, number of rows); files in the order of their paths.

    ``df`` is a table read from files, possibly with filters and columns added. If no row of it was left out and the format numbers the rows of a
    file (Parquet), a position is that number plus the file's offset: no sort, no shuffle, nothing stored. Otherwise the rows are stored as they are scanned, and
    numbered by their place in the scanned piece of the file plus the piece's offset, again without a sort.
    """
    wanted = [F.col(c) for c in df.columns] if columns is None else list(columns)
    file, block, row = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.col("_metadata.row_index").alias("__row")
    try:
        tagged, numbered = df.select(*wanted, file, row), True
    except AnalysisException:  # text formats do not number their rows
        numbered = False
    if numbered:
        files, number = compact(tagged.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"), (F.max("__row") + 1).alias("__top")))
        if not files.filter("__n <> __top").limit(1).count():
            placed = _from_offsets(tagged, files, number, ["__file"], F.col("__row"), name)
            return placed, files.agg(F.sum("__n")).first()[0] or 0
    try:
        tagged = df.select(*wanted, file, block)
    except AnalysisException as e:
        raise ValueError("an order of files needs a table that is read from files") from e
    stored = materialize(tagged.withColumn("__mid", F.monotonically_increasing_id()))
    pieces, number = compact(stored.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"), (F.max("__mid") + 1).alias("__end")))
    if pieces.filter("__end - __first <> __n").limit(1).count():
        raise ValueError("the rows of a file are not in the order of the file: number them before joins and other shuffles")
    placed = _from_offsets(stored, pieces, number, ["__file", "__block"], F.col("__mid") - F.col("__first"), name)
    return placed, pieces.agg(F.sum("__n")).first()[0] or 0


def _from_offsets(rows: DataFrame, pieces: DataFrame, number: int, keys: list[str], place: Column, name: str) -> DataFrame:
    """Positions from the place of a row in its piece and the rows of all pieces before."""
    offsets = pieces.withColumn("__start", F.sum("__n").over(Window.orderBy(*keys)) - F.col("__n")).drop("__n")
    joined = rows.join(small(offsets, number), keys)
    return joined.withColumn(name, F.col("__start") + place).drop(*[c for c in joined.columns if c in {"__file", "__block", "__row", "__mid", "__first", "__end", "__top", "__start"}])


def placed_rows(df: DataFrame, columns: Sequence, order, name: str = "row_index") -> DataFrame:
    """The columns and positions in the given order, or that of the files."""
    if isinstance(order, str) and order == FILES:
        return file_index(df, columns, name)[0]
    keys = {f"__o{i}": as_column(c) for i, c in enumerate(order)}
    return dense_index(df.select(*columns, *[c.alias(n) for n, c in keys.items()]), list(keys), name).drop(*keys)


def checksums(id: str) -> dict[str, Column]:
    """Aggregates that tell two multisets of ids apart: their number, the exclusive or of their hashes, and the sums of
    two pieces of 20 bits, which stay within 64 bits up to 2**43 ids."""
    h, low = F.xxhash64(id), F.lit((1 << 20) - 1)
    return {"rows": F.count(F.lit(1)), "low": F.sum(h.bitwiseAND(low)), "high": F.sum(F.shiftright(h, 20).bitwiseAND(low)), "xor": F.bit_xor(h)}


def number_replicates(sim: DataFrame, n_obs: int, index: str = "row_index") -> DataFrame:
    """Position i belongs to observation ``i mod n`` of replicate ``i div n + 1``."""
    position = F.col(index)
    return sim.withColumns({"obs_id": F.pmod(position, F.lit(n_obs)), "repl": (F.expr(f"`{index}` div {int(n_obs)}") + 1).cast("int")})


def cyclic_label(df: DataFrame, labels: Sequence, index: str = "row_index", name: str = "label") -> DataFrame:
    """Repeat ``labels`` along the row positions."""
    values = F.array(*[F.lit(v) for v in labels])
    return df.withColumn(name, F.element_at(values, (F.pmod(F.col(index), F.lit(len(labels))) + 1).cast("int")))


def spread_over_replicates(obs: DataFrame, sim: DataFrame, columns: Sequence[str], on: str = "obs_id") -> DataFrame:
    """Give every replicate row the value of its observation."""
    return sim.join(obs.select(on, *columns), on, "left")


def from_replicate(obs: DataFrame, sim: DataFrame, value, name: str, on: str = "obs_id", repl: str = "repl",
                   number: int = 1) -> DataFrame:
    """Add to the observations a column of one replicate."""
    one = sim.filter(F.col(repl) == number).select(on, as_column(value).alias(name))
    return obs.join(one, on, "left")


def _comparable_id(df: DataFrame, name: str, exact: bool) -> Column:
    """Integers as integers if both tables have them, other numbers as doubles."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name)
    return F.col(name).cast("long" if exact else "double")


def order_report(obs: DataFrame, sim: DataFrame, order_obs: Sequence, order_sim: Sequence,
                 tol: float = 1e-5) -> DataFrame:
    """One row: n_obs, n_sim, nrep, multiple_ok, id_ok, time_ok. Columns 1 and 2 are the id and the time."""
    o = placed_rows(obs, [F.col(c) for c in obs.columns[:2]], order_obs)
    s = placed_rows(sim, [F.col(c) for c in sim.columns[:2]], order_sim)
    kinds = [isinstance(d.schema[d.columns[0]].dataType, T.NumericType) for d in (obs, sim)]
    exact = all(isinstance(d.schema[d.columns[0]].dataType, T.IntegralType) for d in (obs, sim))
    n_obs, n_sim = o.count(), s.count()
    left = o.select(F.col("row_index").alias("obs_id"), _comparable_id(obs, obs.columns[0], exact).alias("id_o"),
                    F.col(obs.columns[1]).cast("double").alias("t_o"))
    right = s.select(F.pmod("row_index", F.lit(max(n_obs, 1))).alias("obs_id"),
                     _comparable_id(sim, sim.columns[0], exact).alias("id_s"), F.col(sim.columns[1]).cast("double").alias("t_s"))
    same = F.col("id_o").eqNullSafe(F.col("id_s")) if kinds[0] == kinds[1] else F.lit(False)
    close = F.coalesce(F.abs(F.col("t_o") - F.col("t_s")) < tol, F.lit(False))
    return right.join(left, "obs_id", "left").agg(
        F.lit(n_obs).cast("long").alias("n_obs"), F.lit(n_sim).cast("long").alias("n_sim"),
        (F.lit(n_sim) / F.lit(n_obs or None)).cast("double").alias("nrep"),
        F.lit(n_obs > 0 and n_sim % n_obs == 0).alias("multiple_ok"),
        F.coalesce(F.every(same), F.lit(True)).alias("id_ok"), F.coalesce(F.every(close), F.lit(True)).alias("time_ok"))


def check_order(obs: DataFrame, sim: DataFrame, order_obs: Sequence, order_sim: Sequence, tol: float = 1e-5) -> int:
    """Number of replicates; raises when the two tables do not line up."""
    row = order_report(obs, sim, order_obs, order_sim, tol).first()
    if not row["multiple_ok"]:
        raise ValueError("the number of simulated rows must be a multiple of the number of observations")
    if not row["id_ok"]:
        raise ValueError("some ID differs between the two tables")
    if not row["time_ok"]:
        raise ValueError("some Time differs between the two tables")
    return int(row["nrep"])
