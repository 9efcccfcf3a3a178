"""Per-read Python steps over sorted partitions: one Arrow stream a task instead of a call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_key(df: DataFrame, keys: list[str], order: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, list] | None], schema: str) -> DataFrame:
    """work sees the columns of one group at a time, rows in order, and returns the columns of its result. A group is held by one task, as it
    is a single read's rows; rows of one key never meet in the driver."""
    names = df.columns
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = None
        out: dict[str, list] = {}

        def close() -> None:
            group = held[0] if len(held) == 1 else {n: np.concatenate([h[n] for h in held]) for n in names}
            for k, v in (work(group) or {}).items():
                out.setdefault(k, []).extend(v)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            at = [0, *np.flatnonzero(change).tolist(), n]
            for a, b in zip(at, at[1:]):
                key = tuple(cols[k][a] for k in keys)
                if held and key != last:
                    close()
                    held = []
                last = key
                held.append({c: v[a:b] for c, v in cols.items()})
            if out and len(next(iter(out.values()))) >= 10_000:
                yield pa.RecordBatch.from_pydict(out)
                out.clear()
        if held:
            close()
        if out and len(next(iter(out.values()))):
            yield pa.RecordBatch.from_pydict(out)

    return sorted_rows.mapInArrow(run, schema)
