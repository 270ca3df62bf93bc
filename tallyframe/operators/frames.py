"""Work on one frame's rows at a time, without a group for each frame.

Rows are dealt by frame and sorted, and a task goes through its frames as arrays: a frame that a batch cuts is held
until the rest comes. So a frame costs microseconds, and memory is a batch and one frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import shipped

#: A frame's columns as arrays of equal length, in the given order of rows.
Arrays = dict[str, np.ndarray]


def per_frame(df: DataFrame, order: list[str], work: Callable[[int, Arrays], list[tuple]], schema: str) -> DataFrame:
    """Apply `work` to (frame id, arrays) of every frame; it returns rows of `schema`. The column frame_id deals the rows; those without one belong to no frame and are left out."""
    shipped(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def frames(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            columns = {n: table.column(n).to_numpy() for n in table.column_names}
            ids = columns["frame_id"]
            edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])).tolist()
            rows: list[tuple] = []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                rows += work(int(ids[s]), {n: c[s:e] for n, c in columns.items()})
            values = zip(*rows, strict=True) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("frame_id").to_numpy()
            change = np.flatnonzero(ids != ids[-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if held and (cut or held[-1].column("frame_id")[0].as_py() != ids[0]):
                done = [*held, b.slice(0, cut)] if cut else held
                yield frames(done)
                held = []
            elif cut:
                yield frames([b.slice(0, cut)])
            held.append(b.slice(cut))
        if held:
            yield frames(held)

    # dealt by a hash of the id: Spark leaves out an exchange by the id itself where the input has it, as a union of two windows
    # does, and adaptive execution then merges the partitions of each part of the union on its own
    dealt = df.filter("frame_id is not null").repartition(F.xxhash64("frame_id"))
    return dealt.sortWithinPartitions("frame_id", *order).mapInArrow(run, kind)
