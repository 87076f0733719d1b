"""Nudges over a stream of turns: the batch fold with its call state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators.nudges import OUT, Budget, NudgeSettings, exploded, gated

STATE = "last map<string,long>, fired int"


def stream_nudges(signals: DataFrame, settings: NudgeSettings = NudgeSettings(), idle_ms: int | None = None) -> DataFrame:
    """Fired and withheld nudges from a stream of (conv_id, turn, ord, kind, confidence, evidence). A turn's signals
    come in one micro-batch; turns of a call come in order. A call that is idle for idle_ms is forgotten: a query that
    runs for ever should set it, one that takes what is available shouldn't, as waiting for timeouts it doesn't end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        budget = Budget(settings, *state.get) if state.exists else Budget(settings)
        rows = pd.concat(list(batches)).sort_values(["turn", "priority", "confidence", "ord"], ascending=[True, False, False, True], kind="stable")
        reasons = [w or budget.decide(int(t), k, int(c)) for w, t, k, c in zip(rows["withheld"].where(rows["withheld"].notna(), None), rows["turn"], rows["kind"], rows["cooldown"], strict=True)]
        budget.settle()
        state.update((budget.last, budget.fired))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(fired=[not r for r in reasons], reason=reasons)[[c.split()[0] for c in OUT.split(", ")]]

    return gated(signals, settings).groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def analyse(turns: DataFrame, settings: NudgeSettings = NudgeSettings()) -> DataFrame:
    """From a stream of turns (conv_id, turn, caller, agent, ...) to nudges: stateless signals, then the keyed fold."""
    return stream_nudges(exploded(S.lexical(turns)), settings)


def fresh(turns: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Turns once each, within a watermark."""
    return turns.withWatermark(at, late).dropDuplicatesWithinWatermark(["conv_id", "turn"])


def trace_ids(turns: DataFrame) -> DataFrame:
    return turns.withColumn("trace", F.concat(F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string")))
