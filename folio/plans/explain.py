"""What a plan does, read from Spark's own explanation."""

from __future__ import annotations

import re

from ..operators.frame import Frame


def explain_frame(frame: Frame) -> dict:
    """plan, full_scan, pushed_filters, read_schema and the text of Spark's formatted plan.

    index_used is None throughout: scans are pruned by file statistics, not by indexes.
    """
    text = frame.df._jdf.queryExecution().explainString(frame.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [x for m in re.findall(r"PushedFilters: \[([^\n]*)\]", text) for x in re.split(r", (?=[A-Z])", m) if x]
    return {"plan": "COLLSCAN", "index_used": None, "full_scan": not pushed, "pushed_filters": pushed, "read_schema": re.findall(r"ReadSchema: (\S+)", text), "spark_plan": text}
