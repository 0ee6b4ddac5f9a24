"""Fitted models in a stream: each series goes on from its row of ``operators.adapters.states``.

The forecast of a row is made before it is seen; the row then moves history,
residuals, recursions and the interval's level, as the batch model's windows and
folds would.  The readout stays as it was fitted.  A row that does not come after
the last one is late and changes nothing; a series without a state begins with its
bare prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.adapters import NAMES, STATE, Adapter

OUT = "series_id string, ds date, y double, p double, raw double, gate double, pred double, lower double, upper double, alpha double, n_scores int, status string"


class Adapted(StatefulProcessor):
    def __init__(self, prior: str = "rolling_mean"):
        self.prior = prior

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update(Adapter({k: r[k] for k in NAMES}).row())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ds")
        a = Adapter(dict(zip(NAMES, self.state.get()))) if self.state.exists() else Adapter.bare(self.prior)
        out = []
        for ds, y in zip(new["ds"], new["y"].astype(float)):
            if a.last_ds is not None and ds <= a.last_ds:
                out.append((key[0], ds, y, None, None, None, None, None, None, a.alpha, len(a.scores), "late"))
                continue
            f = a.predict()
            p, pred = (y, y) if f["p"] != f["p"] else (f["p"], f["pred"])
            out.append((key[0], ds, y, p, f["raw"], f["gate"], pred, pred - f["half"], pred + f["half"], a.alpha, len(a.scores), "prior" if a.kind == "none" else "ok"))
            a.see(y)
            a.last_ds = ds
        self.state.update(a.row())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def forecasts(observations: DataFrame, states: DataFrame, prior: str = "rolling_mean") -> DataFrame:
    """Forecasts of a stream of (series_id, ds, y) by the fitted ``states``. Needs the RocksDB state store."""
    begin = states.select("series_id", *NAMES).groupBy("series_id")
    return observations.groupBy("series_id").transformWithStateInPandas(Adapted(prior), OUT, "append", "none", initialState=begin)
