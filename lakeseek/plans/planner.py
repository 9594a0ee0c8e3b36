"""A plan is a list of steps; each names the steps it depends on and yields a lazy DataFrame or a small value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lakeseek.plans.registry import Registry

functions = Registry("plan function")


@dataclass
class PlanStep:
    """One step: ``function`` is called with the results of ``after`` (by name) and ``params``."""

    name: str
    function: str | Callable[..., Any]
    after: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    status: str = "pending"


def execute(steps: list[PlanStep], debug: bool = False) -> dict[str, Any]:
    """Results by step; a step whose dependency is missing or failed raises ``RuntimeError``."""
    done: dict[str, Any] = {}
    for s in steps:
        if missing := [a for a in s.after if a not in done]:
            s.status = "blocked"
            raise RuntimeError(f"step {s.name} needs {', '.join(missing)}")
        run = functions.resolve(s.function) if isinstance(s.function, str) else s.function
        try:
            done[s.name] = run(*[done[a] for a in s.after], **s.params)
        except Exception:
            s.status = "failed"
            raise
        s.status = "done"
    return done


def as_mermaid(steps: list[PlanStep]) -> str:
    lines = ["graph TD"]
    for s in steps:
        lines.append(f'    {s.name}["{s.name} ({s.status})"]')
        lines += [f"    {a} --> {s.name}" for a in s.after]
    return "\n".join(lines)


def as_dot(steps: list[PlanStep]) -> str:
    nodes = [f'  "{s.name}" [label="{s.name}\\n{s.status}"];' for s in steps]
    return "\n".join(["digraph plan {", *nodes, *(f'  "{a}" -> "{s.name}";' for s in steps for a in s.after), "}"])


def as_text(steps: list[PlanStep]) -> str:
    marks = {"done": "+", "failed": "!", "blocked": "-"}
    return "\n".join(f"[{marks.get(s.status, ' ')}] {i}. {s.name}" + (f" <- {', '.join(s.after)}" if s.after else "") for i, s in enumerate(steps, 1))


def explain(results: dict[str, Any]) -> str:
    """The physical plans of all steps that gave a DataFrame."""
    return "\n\n".join(f"== {k}\n{df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}" for k, df in results.items() if isinstance(df, DataFrame))
