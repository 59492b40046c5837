"""Missing and special values, and joins that treat a missing key as a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NEG_INF = float("-inf")


def as_column(value) -> Column:
    """A column name or SQL expression, a Column, or a literal."""
    if isinstance(value, Column):
        return value
    return F.expr(value) if isinstance(value, str) else F.lit(value)


def literal(value, kind: T.DataType) -> Column:
    """A constant of any type, arrays and structs included."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        items = [literal(v, kind.elementType) for v in value]
        return F.array(*items) if items else F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def no_nan(c: Column) -> Column:
    """NaN counts as missing everywhere in this package."""
    return F.nanvl(c, F.lit(None).cast("double"))


def as_double(value) -> Column:
    return no_nan(as_column(value).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with signed infinity for a zero divisor and null for 0/0."""
    at_zero = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(NEG_INF))
    return F.when(den == 0, at_zero).otherwise(no_nan(num / F.when(den != 0, den)))


def natural_log(c: Column) -> Column:
    """Minus infinity for zero; a negative number has no logarithm."""
    return F.when(c == 0, F.lit(NEG_INF)).otherwise(F.ln(c))


def number_text(c: Column) -> Column:
    """Text of a number, whole numbers without a decimal point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns of ``left`` are kept."""
    renamed = {k: f"__r_{k}" for k in keys}
    cond = " and ".join(f"{quoted(k)} <=> {quoted(r)}" for k, r in renamed.items()) or "true"
    joined = left.join(right.withColumnsRenamed(renamed), F.expr(cond), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())
