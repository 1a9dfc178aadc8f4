"""Document queries over streams.

Stages that look at one document at a time run on a streaming DataFrame as they are; a group needs a watermark and a
window in its key or complete output, which Spark checks. Expiry filters a stream by the time of each batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..errors import UnsupportedOperator
from ..operators.frame import Frame, utc_now
from ..operators.stages import RUN
from ..plans.pipeline import parse, rewrite
from ..sources.indexes import Index, sweep

#: Stages whose result on a stream is that on all its documents so far.
ROW_STAGES = {"$match", "$project", "$addFields", "$unset", "$replaceRoot", "$unwind", "$lookup"}


def stream_pipeline(df: DataFrame, pipeline: list[dict], id_col: str | None = None, plain: bool = False, foreign: Callable[[str], DataFrame | None] = lambda name: None) -> DataFrame:
    """A pipeline of row-wise stages, then at most one $group, over a streaming DataFrame."""
    frame = Frame(df, id_col, plain=plain, foreign=foreign)
    stages = rewrite(parse(pipeline))
    for i, stage in enumerate(stages):
        grouped = stage.name in ("$group", "$count") and not any(s.name in ("$group", "$count") for s in stages[:i])
        if stage.name not in ROW_STAGES and not grouped:
            raise UnsupportedOperator(f"{stage.name} of a stream; use foreach_batch")
        if stage.name == "$lookup" and stage.notes.get("join") not in ("inner", "left", "semi"):
            raise UnsupportedOperator("$lookup of a stream joins: unwind its result")
        frame = RUN[stage.name](frame, stage)
    return frame.df


def foreach_batch(df: DataFrame, pipeline: list[dict], sink: Callable[[DataFrame, int], None], id_col: str | None = None, plain: bool = False) -> DataStreamWriter:
    """A writer that runs any pipeline on each micro-batch."""
    from ..operators.stages import run_pipeline

    return df.writeStream.foreachBatch(lambda batch, n: sink(run_pipeline(Frame(batch, id_col, plain=plain), pipeline).df, n))


def expire_batches(df: DataFrame, indexes: list[Index], sink: Callable[[DataFrame, int], None], id_col: str | None = None, now: Callable[[], dt.datetime] = utc_now) -> DataStreamWriter:
    """A writer that passes on the documents of each micro-batch whose time hasn't run out."""
    return df.writeStream.foreachBatch(lambda batch, n: sink(sweep(Frame(batch, id_col), indexes, now()), n))
