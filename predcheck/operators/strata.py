"""Stratification variables: one-sided or two-sided, by names, expressions, Columns or terms that are fitted to the data.

``cut(x, k)`` cuts the range of an expression into k intervals of equal width, ``cut(x, [a, b, c])`` at given places, ``quantiles(x, k)`` into k intervals of
about equally many rows. A fitted term is one aggregate over the observations, then an expression of constants: the levels of one
table are those of every table it is applied to. ``name = cut(x, k)`` names the stratum, else it is called ``cut_x_k``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.values import as_double

# Names that results use and strata must not.
RESERVED = ("x", "y", "ypc", "pred", "blq", "lloq", "repl", "bin", "xbin", "qname", "lo", "md", "hi", "nobs", "xmedian",
            "xmean", "xmin", "xmax", "xmid", "xleft", "xright", "xcenter",
            "obs_id", "bin_num", "mpred", "bin_left", "bin_right", "q_index")

Term = tuple[str, Column]


#: Fixed value: share of the range by which the outer cuts of equal widths lie beyond it.
BEYOND = 1e-3
_FITTED = re.compile(r"(?:(?P<name>\w+)\s*=\s*)?(?P<kind>cut|quantiles)\s*\((?P<inside>.*)\)$", re.DOTALL)


def _split(text: str, sign: str) -> list[str]:
    """Parts between the signs that stand outside of all brackets and quotes."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == sign and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    if depth or quote:
        raise ValueError(f"brackets or quotes are not closed in {text!r}")
    return [p.strip() for p in parts]


def _terms(side: str) -> list[str]:
    side = side.strip()
    return [] if side in ("", ".") else _split(side, "+")


def _breaks(kind: str, data: DataFrame, x: Column, given: str) -> list[float]:
    """Outer and inner cuts of a term."""
    if given.startswith("["):
        if kind != "cut":
            raise ValueError("quantiles takes a number of intervals")
        return sorted({float(v) for v in given.strip("[]").split(",")})
    if not given.isdigit() or int(given) < 2:
        raise ValueError(f"{kind} needs at least 2 intervals, or places in square brackets for cut")
    k, rows = int(given), data.select(as_double(x).alias("v"))
    if kind == "quantiles":
        return sorted(set(grouped_quantiles(rows, [], "v", [i / k for i in range(k + 1)]).first()["q"]) - {None})
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None or hi <= lo:
        return []
    more = (hi - lo) * BEYOND
    return [lo - more, *[lo + (hi - lo) * i / k for i in range(1, k)], hi + more]


def _labels(breaks: list[float], closed: bool) -> list[str]:
    for digits in range(3, 18):
        text = [f"{b:.{digits}g}" for b in breaks]
        if len(set(text)) == len(text):
            break
    return [f"{'[' if closed and not i else '('}{a},{b}]" for i, (a, b) in enumerate(zip(text, text[1:]))]


def fitted_term(text: str, data: DataFrame) -> Term | None:
    """The stratum of ``cut(...)`` or ``quantiles(...)``, its intervals closed on the right; None for any other term.

    Values outside given places, and missing ones, have no level. The least value belongs to the first interval of quantiles."""
    found = _FITTED.fullmatch(text)
    if not found:
        return None
    inside = _split(found["inside"], ",")
    if len(inside) < 2:
        raise ValueError(f"{found['kind']} takes an expression and a number or places: {text}")
    x, given = F.expr(", ".join(inside[:-1])), inside[-1]
    breaks = _breaks(found["kind"], data, x, given)
    if len(breaks) < 2:
        raise ValueError(f"there is nothing to cut in {text}")
    name = found["name"] or re.sub(r"\W+", "_", f"{found['kind']}_{found['inside']}").strip("_")
    closed, v, level = found["kind"] == "quantiles", as_double(x), None
    for label, a, b in zip(_labels(breaks, closed), breaks, breaks[1:]):
        above = v >= a if closed and level is None else v > a
        level = F.when(above & (v <= b), label) if level is None else level.when(above & (v <= b), label)
    return name, level


def split_formula(formula: str) -> tuple[list[str], list[str], bool]:
    """``~ a + b`` gives columns only, ``a ~ b`` rows and columns; ``.`` is an empty side."""
    if not isinstance(formula, str) or formula.count("~") != 1:
        raise ValueError("a stratification formula has one ~, as in '~ a' or 'a ~ b'")
    left, right = formula.split("~")
    return _terms(left), _terms(right), bool(left.strip())


def as_terms(values: Sequence, derived: dict[str, Column], data: DataFrame | None = None) -> list[Term]:
    """(name, Column) of every term; those to be fitted are fitted to ``data``."""
    terms = []
    for v in values:
        if isinstance(v, str) and v not in derived and data is not None and (fitted := fitted_term(v, data)):
            terms.append(fitted)
        elif isinstance(v, tuple):
            terms.append((v[0], v[1] if isinstance(v[1], Column) else F.expr(v[1])))
        elif isinstance(v, str):
            terms.append((v, derived.get(v, F.col(v))))
        else:
            raise ValueError("give strata as names or (name, Column) pairs")
    return terms


def check_terms(rows: list[Term], cols: list[Term]) -> None:
    names = [n for n, _ in rows + cols]
    if not names:
        raise ValueError("the stratification names no variable")
    if set(names) & set(RESERVED) or any(n.startswith("__") for n in names):
        raise ValueError("these names are taken and can't be strata: " + ", ".join(RESERVED))
    if len(set(names)) != len(names):
        raise ValueError("a stratification variable is given twice")
