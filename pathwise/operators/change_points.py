"""Online Bayesian change points of scores -1, 0, 1: each run of one regime is categorical under a Dirichlet prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pathwise.operators.sequence import KEY

#: Runs whose posterior falls below this are forgotten, which bounds a trajectory's state whatever its length.
FORGET = 1e-12


class Regimes:
    """Posterior over the current run's begin: one row of class counts and one weight per run still possible."""

    def __init__(self, hazard: float, prior: float):
        self.hazard, self.prior = hazard, prior
        self.counts, self.weights = np.full((1, 3), prior), np.ones(1)

    def observe(self, kind: int) -> float:
        """Takes a class in and returns the probability that a run begins with it."""
        grown = self.weights * (1 - self.hazard) * self.counts[:, kind] / self.counts.sum(1)
        joint = np.append(grown, self.hazard / 3)  # a fresh run sees the symmetric prior alone
        joint /= joint.sum()
        counts = np.vstack([self.counts, np.full(3, self.prior)])
        counts[:, kind] += 1
        keep = joint > FORGET
        keep[-1] = True
        self.counts, self.weights = counts[keep], joint[keep] / joint[keep].sum()
        return float(joint[-1])


def change_points(df: DataFrame, score: str = "score", keys=KEY, order: str = "t_index", hazard: float = 0.1, prior: float = 1.0) -> DataFrame:
    """(keys, order, p_change) of every row with a score, in order.

    Rows are dealt by key, sorted by Spark and streamed through, so a task holds one trajectory's posterior and one batch.
    """
    names = [*keys, order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, regimes = None, None
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in keys), pdf["_kind"], strict=True):
                if row[:-1] != current:
                    current, regimes = row[:-1], Regimes(hazard, prior)
                out.append(regimes.observe(int(row[-1])))
            yield pdf[names].assign(p_change=out)

    kind = f"case when {score} < -0.5 then 0 when {score} < 0.5 then 1 else 2 end as _kind"
    rows = df.where(f"{score} is not null").selectExpr(*names, kind).repartition(*keys).sortWithinPartitions(*names)
    kinds = dict(df.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", p_change double")
