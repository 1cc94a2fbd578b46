"""Structured Streaming versions of the two stateful parts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_rules(events: DataFrame, rules: list[tuple[str, list[str]]], *, key: str, at: str, cls: str, delay: str = "10 minutes", most: int = 256) -> DataFrame:
    """Matches of sequence rules over a keyed event stream (STM1).

    The state of a key is its live matchers: (rule, next item, first time). An
    event moves those whose next item is its class and drops the others; rules
    are contiguous. State that sees nothing until the watermark passes expires.
    More than ``most`` live matchers of one key is an error, not a silent cut.
    """
    table = dict(rules)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = json.loads(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for t, c in sorted(zip(pdf[at], pdf[cls])):
                moved = []
                for name, i, first in [*live, *[(name, 0, t.isoformat()) for name in table]]:
                    if table[name][i] == c:
                        if i + 1 == len(table[name]):
                            out.append((k[0], name, pd.Timestamp(first), t))
                        else:
                            moved.append((name, i + 1, first))
                live = moved
                if len(live) > most:
                    raise RuntimeError(f"over {most} live matchers for one key")
        state.update((json.dumps(live),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, 1) + 600_000)
        yield pd.DataFrame(out, columns=[key, "rule", "first", "last"])

    kind = dict(events.dtypes)[key]
    watched = events.select(key, at, cls).withWatermark(at, delay)
    return watched.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, rule string, first timestamp, last timestamp", "live string", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_form(forms: DataFrame, uid: str = "uid", payload: str = "payload", final: str = "final") -> DataFrame:
    """Latest state of a form per user (STM2): the final one, else the longest
    partial one. A plain aggregate, so it runs in update or complete mode."""
    order = F.struct(F.coalesce(F.col(final), F.lit(False)), F.length(payload), F.col(payload))
    return forms.groupBy(uid).agg(F.max_by(payload, order).alias(payload), F.max(F.coalesce(F.col(final), F.lit(False))).alias("complete"))


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts with a watermark."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
