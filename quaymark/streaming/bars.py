"""Daily bars and running volatility from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(events: DataFrame, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Open, high, low, close and volume of each code and window; works on a stream or a table.

    ``events``: code, ts, price. Events later than the watermark are dropped
    on a stream.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    found = marked.groupBy("code", F.window("ts", length)).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count("*").alias("volume"),
    )
    return found.select("code", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def running_sigma(events: DataFrame, decay: float = 0.94) -> DataFrame:
    """``code, ts, price, sigma`` of a stream: exponentially weighted volatility carried in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, var = state.get if state.exists else (float("nan"), float("nan"))
        for batch in batches:
            out = []
            for row in batch.sort_values("ts").itertuples(index=False):
                if last == last and row.price > 0 and last > 0:
                    r2 = (row.price / last - 1) ** 2
                    var = r2 if var != var else decay * var + (1 - decay) * r2
                last = row.price
                out.append((key[0], row.ts, row.price, var**0.5 if var == var else None))
            yield pd.DataFrame(out, columns=["code", "ts", "price", "sigma"])
        state.update((last, var))

    return events.groupBy("code").applyInPandasWithState(
        step, "code string, ts timestamp, price double, sigma double", "last double, var double", "append", GroupStateTimeout.NoTimeout
    )
