"""State along a stream, on Structured Streaming.

A lane's state is small (the unfinished integration, or the last taps), and
lanes are partitioned by key, so state is spread over the cluster and kept by
the state store through the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accumulate_stream(stream: DataFrame, nframe: int, lane: str = "lane", frame: str = "frame", value: str = "value", horizon: int = 1024) -> DataFrame:
    """Sums of ``nframe`` frames of each lane, given out when complete.

    State: for each open integration its sum and count, so frames may come in
    any order; an unfinished one at the end is not given out.  One that is
    more than ``horizon`` integrations behind the lane's newest has lost
    frames and is dropped, so the state is bounded.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_: dict[int, list] = {g: [s, n] for g, s, n in zip(*state.get, strict=True)} if state.exists else {}
        done = []
        for batch in batches:
            groups = batch.groupby(batch[frame] // nframe)[value].agg(["sum", "count"])
            for g, s, n in groups.itertuples():
                cell = open_.setdefault(int(g), [0.0, 0])
                cell[0] += float(s)
                cell[1] += int(n)
                if cell[1] >= nframe:
                    done.append((int(g), cell[0]))
                    del open_[int(g)]
        if open_:
            newest = max([*open_, *[g for g, _ in done]])
            open_ = {g: c for g, c in open_.items() if g >= newest - horizon}
        state.update((list(open_), [c[0] for c in open_.values()], [c[1] for c in open_.values()]))
        yield pd.DataFrame({lane: [key[0]] * len(done), frame: [g for g, _ in done], value: [s for _, s in done]})

    kind = stream.schema[lane].dataType.simpleString()
    return stream.groupBy(lane).applyInPandasWithState(step, f"{lane} {kind}, {frame} long, {value} double", "g array<long>, s array<double>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def fir_stream(stream: DataFrame, taps: list[float], lane: str = "lane", frame: str = "frame", value: str = "value") -> DataFrame:
    """A FIR filter whose last inputs are carried from batch to batch.

    Frames of a lane must come in order from batch to batch.
    """
    h = np.array(taps, float)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0]) if state.exists else np.zeros(len(h) - 1)
        rows = pd.concat(list(batches)).sort_values(frame)
        x = np.concatenate((held, rows[value].to_numpy(float)))
        y = np.correlate(x, h, "valid")
        state.update((x[len(x) - len(h) + 1 :].tolist(),))
        yield pd.DataFrame({lane: [key[0]] * len(y), frame: rows[frame].to_numpy(), value: y})

    kind = stream.schema[lane].dataType.simpleString()
    return stream.groupBy(lane).applyInPandasWithState(step, f"{lane} {kind}, {frame} long, {value} double", "x array<double>", "append", GroupStateTimeout.NoTimeout)


def running(stream: DataFrame, op: str = "sum", lane: str = "lane", frame: str = "frame", value: str = "value") -> DataFrame:
    """A running sum, min or max of each lane, carried from batch to batch."""
    how = {"sum": np.add, "min": np.minimum, "max": np.maximum}[op]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(frame)
        x = rows[value].to_numpy(float)
        if state.exists:
            x = np.concatenate(([state.get[0]], x))
        y = how.accumulate(x)
        state.update((float(y[-1]),))
        yield pd.DataFrame({lane: [key[0]] * len(rows), frame: rows[frame].to_numpy(), value: y[len(y) - len(rows) :]})

    kind = stream.schema[lane].dataType.simpleString()
    return stream.groupBy(lane).applyInPandasWithState(step, f"{lane} {kind}, {frame} long, {value} double", "x double", "append", GroupStateTimeout.NoTimeout)
