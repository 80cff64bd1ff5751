"""Shock scores as a stream: forecast, innovation and score of each bar, from a state that holds what the next one needs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shockwell.functions.columns import EPSILON, MAD_SCALE
from shockwell.operators.har import COEFFICIENTS, LEAST_SCORED, MONTH

SCORED = "asset string, pos int, begin timestamp_ntz, actual_log_variance double, forecast_log_variance double, innovation double, innovation_scale double, shock_score double"
#: What is kept of an asset: its last bar, the variances and the innovations that the next bar's forecast and scale need.
STATE = "last int, history array<double>, innovations array<double>"


class OnlineScore(StatefulProcessor):
    """Scores an asset's bars in the order of pos. The state is bounded: 22 variances and `mad_window` innovations."""

    def __init__(self, coefficients: dict[str, float], initial: int, mad_window: int):
        self.beta = [float(coefficients[c]) for c in COEFFICIENTS]
        self.initial, self.mad_window = initial, mad_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", STATE)

    def _forecast(self, history: list[float]) -> float:
        const, daily, weekly, monthly, smearing = self.beta
        states = np.log(np.array([history[-1], np.mean(history[-5:]), np.mean(history[-MONTH:])]) + EPSILON)
        return float(np.exp(np.clip(const + states @ np.array([daily, weekly, monthly]), -40, 20)) * smearing)

    def _scored(self, pos: int, begin: Any, variance: float, history: list[float], past: list[float]) -> tuple:
        actual = forecast = innovation = scale = score = None
        if variance > 0:
            actual = float(np.log(variance + EPSILON))
            if pos >= self.initial and len(history) == MONTH:
                forecast = float(np.log(self._forecast(history) + EPSILON))
                innovation = actual - forecast
                if len(past) >= LEAST_SCORED:
                    middle = float(np.median(past))
                    spread = MAD_SCALE * float(np.median(np.abs(np.array(past) - middle)))
                    if spread > 1e-8:
                        scale, score = spread, (innovation - middle) / spread
                past.append(innovation)
                del past[: -self.mad_window]
            history.append(variance)
            del history[:-MONTH]
        return pos, begin, actual, forecast, innovation, scale, score

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, history, past = self.kept.get() if self.kept.exists() else (-1, [], [])
        history, past = list(history), list(past)
        bars = pd.concat(list(rows), ignore_index=True).sort_values("pos", kind="stable")
        out = []
        for pos, begin, variance in zip(bars["pos"].tolist(), bars["begin"], bars["variance"].tolist(), strict=True):
            if pos <= last:
                continue
            last = pos
            out.append((key[0], *self._scored(pos, begin, variance if variance is not None else float("nan"), history, past)))
        self.kept.update((last, history, past))
        names = [f.split()[0] for f in SCORED.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({c: "float64" for c in names[3:]})

    def close(self) -> None:
        return None


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store: set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_shock_scores(bars: DataFrame, coefficients: dict[str, float], variance: str = "gap_rogers_satchell", initial: int = 252, mad_window: int = 250) -> DataFrame:
    """SCORED rows of a stream of bars (asset, pos, begin, variance), as `innovations` gives them with the same coefficients.

    Nothing of a bar or after it enters its forecast or scale: its state is what the bars before it left. Bars of an asset
    must come in the order of pos from one micro-batch to the next, in any order inside one; a bar at or before the last
    one scored is late, or a repeat after a restart, and is dropped. A bar without a positive variance has no score and
    leaves the state as it is. One asset's bars in a micro-batch are held together: their number is set by the trigger.
    """
    if initial < 120 or mad_window < LEAST_SCORED:
        raise ValueError("initial must be at least 120, mad_window 30")
    rows = bars.selectExpr("asset", "CAST(pos AS INT) AS pos", "begin", f"CAST(`{variance}` AS DOUBLE) AS variance").where("asset IS NOT NULL AND pos IS NOT NULL")
    return rows.groupBy("asset").transformWithStateInPandas(statefulProcessor=OnlineScore(coefficients, initial, mad_window), outputStructType=SCORED, outputMode="Append", timeMode="None")
