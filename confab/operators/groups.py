"""Small numeric work on bounded groups: one pass over sorted partitions, numpy inside."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from confab.operators.greedy import whole_groups


def per_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], list[dict]],
              out: str) -> DataFrame:
    """``fn`` gets a group's rows in ``order`` and returns output rows; groups must be bounded.

    The caller caps the groups before (24, 160 or 240 rows are the caps in use), so a partition
    holds many small groups and no group can outgrow a task.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name in keys] + T.StructType.fromDDL(out).fields)
    names = schema.names

    def run(batches):
        for pdf, edges in whole_groups(batches, keys):
            rows = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                g = pdf.iloc[lo:hi]
                head = {k: g[k].iloc[0] for k in keys}
                rows.extend({**head, **r} for r in fn(g))
            yield pd.DataFrame(rows, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-8)
