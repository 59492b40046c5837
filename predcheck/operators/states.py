"""User functions of many values as states that can be merged, for functions that no Column can express.

Each task folds its values into one state for every group it meets, a batch at a time; states of different tasks are merged in rounds of FAN, so no
task holds the values of a group and no task gets more than FAN states of one. States travel pickled; rounds are written to the shared folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.storage import materialize

#: States of a group that one task merges, and groups of which a task keeps a state; neither changes a result.
FAN, HELD = 32, 4096


@dataclass(frozen=True)
class Mergeable:
    """``start()`` gives an empty state, ``add(state, x)`` the state with a numpy array of values (no missing ones), ``merge(state, state)``
    that of both, ``finish(state, group)`` the result, a number or a list of numbers; ``group`` is a dict of the strata and the bin. ``add`` and ``merge`` may change
    and return their first argument; the order in which they see the values is not defined."""
    start: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[..., Any]


def _pack(fields: Sequence[str], types, states: dict, slot: int) -> pa.RecordBatch:
    columns = list(zip(*states)) if states and fields else [[] for _ in fields]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([slot] * len(states), pa.int64()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())],
                                      names=[*fields, "__slot", "__state"])


def merged(rows: DataFrame, keys: Sequence[str], value: str, states: Mergeable, result: T.DataType, name: str = "result") -> DataFrame:
    """(keys, ``name``): the finished state of every group, a double or an array of doubles. Missing values do not count; a group without values finishes an empty state."""
    keys = list(keys)
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("__slot", T.LongType()), T.StructField("__state", T.BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot, types = {}, TaskContext.get().partitionId(), None
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            groups = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * len(b)
            numbers: dict = {}
            code = np.fromiter((numbers.setdefault(g, len(numbers)) for g in groups), np.int64, len(groups))
            x = b.column(len(keys)).to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(code, kind="stable")
            at = np.searchsorted(code[order], np.arange(len(numbers) + 1))
            for g, lo, hi in zip(numbers, at[:-1], at[1:]):
                part = x[order[lo:hi]]
                part = part[~np.isnan(part)]
                state = held[g] if g in held else states.start()
                held[g] = states.add(state, part) if len(part) else state
            if len(held) > HELD:
                yield _pack(keys, types, held, slot)
                held = {}
        if held:
            yield _pack(keys, types, held, slot)

    def joined(table):
        found = None
        for blob in table.column("__state").to_pylist():
            state = pickle.loads(blob)
            found = state if found is None else states.merge(found, state)
        return found

    def merge_some(key, table):
        types = [table.schema.field(k).type for k in keys]
        group = tuple(k.as_py() for k in key[:len(keys)])
        return pa.Table.from_batches([_pack(keys, types, {group: joined(table)}, key[len(keys)].as_py())])

    def finish(key, table):
        group = tuple(k.as_py() for k in key)
        out = states.finish(joined(table), {k: v for k, v in zip(keys, group) if not k.startswith("__")})
        many = isinstance(result, T.ArrayType)
        out = [float(v) for v in out] if many else None if out is None else float(out)
        return pa.table({**{k: pa.array([v], table.schema.field(k).type) for k, v in zip(keys, group)}, name: pa.array([out], pa.list_(pa.float64()) if many else pa.float64())})

    some = materialize(rows.select(*keys, F.col(value).cast("double").alias(value)).mapInArrow(fold, schema))
    while (some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > FAN:
        place = F.pmod(F.col("__slot"), F.lit(-(-(some.agg(F.max("__slot")).first()[0] + 1) // FAN)))
        some = materialize(some.withColumn("__slot", place).groupBy(*keys, "__slot").applyInArrow(merge_some, schema))
    return some.groupBy(*keys).applyInArrow(finish, T.StructType([*fields, T.StructField(name, result)]))
