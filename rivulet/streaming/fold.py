"""A fold with state for each key over a streaming DataFrame.

Each micro-batch's records of a key are sorted by arrival order before the
state moves, so within a micro-batch the result is that of the bounded plan;
order across micro-batches is the order in which they come.  The state is a
pickled Python value in the query's state store.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], made: str, initial: Any, step: Step, carried: list[str]) -> DataFrame:
    """``step(state, row)`` gives the new state and output rows (fields of ``made``).

    ``carried``: input columns that every output row takes from its input row.
    """
    outer = [c for c in dict.fromkeys([*carried, *order])]
    schema = T.StructType([*T._parse_datatype_string(made).fields, *(df.schema[c] for c in outer)])
    names = [f.name for f in T._parse_datatype_string(made).fields]
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]  # one state for the whole stream

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        value = pickle.loads(state.get[0]) if state.exists else copy.deepcopy(initial)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for r in rows.to_dict("records"):
            value, got = step(value, r)
            out += [{**{n: g.get(n) for n in names}, **{c: r[c] for c in outer}} for g in got]
        state.update((pickle.dumps(value),))
        if out:
            yield pd.DataFrame(out, columns=[*names, *outer])

    rows = df.select(*dict.fromkeys([*keys, *inputs, *outer]))
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
