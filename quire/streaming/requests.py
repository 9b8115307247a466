"""Requests as a stream: those overtaken by a newer generation are marked stale."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def mark_stale(requests: DataFrame, key: str, order: list[str], generation: str, carry: list[str]) -> DataFrame:
    """carry, key and stale of a stream of requests: stale where the key had a higher generation by then.

    Rows of a key are taken in `order` inside a micro-batch, and micro-batches in the order of their arrival.
    The state of a key is one number. Null generations are never stale and leave the state as it is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*carry, key])

    def step(_: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        before = state.get[0] if state.exists else float("-inf")
        seen = rows["_generation"].cummax().ffill().clip(lower=before).fillna(before)
        state.update((float(seen.iloc[-1]),))
        yield rows[[*carry, key]].assign(stale=(rows["_generation"] < seen).astype(bool))

    kept = list(dict.fromkeys([*carry, key, *order]))
    rows = requests.select(*kept, F.col(generation).cast("double").alias("_generation"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{schema}, stale boolean", "newest double", "append", GroupStateTimeout.NoTimeout)
