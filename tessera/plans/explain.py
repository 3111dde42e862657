"""What EXPLAIN says: the steps of the dialect, then Spark's plan."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from ..errors import ExecutionError
from ..sql.compiler import Plan


def _spark(plan: Plan) -> str:
    return plan.frame._jdf.queryExecution().explainString(plan.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def steps(plan: Plan) -> str:
    """The last step first, each below what it feeds."""
    return "\n".join("  " * depth + step for depth, step in enumerate(reversed(plan.steps)))


def tree(plan: Plan) -> str:
    return f"{steps(plan)}\n\n{_spark(plan)}"


def _metrics(node: object, depth: int = 0) -> list[str]:
    """A line per operator of an executed plan: its name and what Spark counted in it; stages and adaptive wrappers are passed through."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _metrics(node.executedPlan(), depth)
    if name.endswith("QueryStage"):
        return _metrics(node.plan(), depth)
    counted, held = [], node.metrics().iterator()
    while held.hasNext():
        pair = held.next()
        if pair._2().value() > 0:
            counted.append(f"{pair._2().name().get() if pair._2().name().isDefined() else pair._1()}: {pair._2().value()}")
    lines, children = ["  " * depth + name + (" (" + ", ".join(sorted(counted)) + ")" if counted else "")], node.children().iterator()
    while children.hasNext():
        lines += _metrics(children.next(), depth + 1)
    return lines


def run(plan: Plan) -> tuple[int, str]:
    """Runs the plan; its rows, and the report of its operators. A failure carries the report so far."""
    execution = plan.frame._jdf.queryExecution()
    start = time.monotonic()
    report = lambda rows: f"{steps(plan)}\n\nrows: {rows}\nseconds: {time.monotonic() - start:.3f}\n\n" + "\n".join(_metrics(execution.executedPlan())) + f"\n\n{_spark(plan)}"
    try:
        rows = execution.toRdd().count()
    except (Py4JJavaError, PySparkException) as e:
        raise ExecutionError(str(e), report("unknown, as the statement failed")) from e
    return rows, report(rows)
