"""Plans and runbooks: a checked list of steps, expanded, run in order and resumed from the tables that finished steps left."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from paperlake.operators.order import finished


@dataclass(frozen=True)
class Tool:
    """A step that can be planned: a function of the session, the tables so far and parameters, what it needs and what it makes."""

    name: str
    stage: str
    run: Callable[[SparkSession, dict[str, DataFrame], dict[str, Any]], DataFrame]
    requires: tuple[str, ...] = ()
    provides: str = ""
    defaults: dict[str, Any] = field(default_factory=dict)


@dataclass
class Step:
    tool: str
    params: dict[str, Any] = field(default_factory=dict)
    ordinal: int = 0

    def id(self, stage: str) -> str:
        """Stable id of the step; its place is part of it, so equal steps differ."""
        args = json.dumps(self.params, sort_keys=True, ensure_ascii=False, default=str)
        return hashlib.sha256("\0".join((stage, self.tool, args, str(self.ordinal))).encode()).hexdigest()[:12]


def validate(plan: list[Step], tools: dict[str, Tool], given: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a plan: unknown tools, and needs that nothing before provides."""
    have, errors = set(given), []
    for s in plan:
        tool = tools.get(s.tool)
        if tool is None:
            errors.append(f"unknown tool {s.tool}")
            continue
        errors += [f"{s.tool} needs {r}" for r in tool.requires if r not in have]
        have.add(tool.provides)
    return errors


def fill(value: Any, params: dict[str, Any], previous: dict[str, Any]) -> Any:
    """Placeholders {p:name} and {prev:tool} replaced; a string that is one placeholder keeps the value's type."""
    if isinstance(value, dict):
        return {k: fill(v, params, previous) for k, v in value.items()}
    if isinstance(value, list):
        return [fill(v, params, previous) for v in value]
    if not isinstance(value, str):
        return value
    look = lambda m: (params if m[1] == "p" else previous).get(m[2], "")
    whole = re.fullmatch(r"\{(p|prev):([^}]+)\}", value)
    return look(whole) if whole else re.sub(r"\{(p|prev):([^}]+)\}", lambda m: str(look(m)), value)


def expand(plan: list[Step], tools: dict[str, Tool]) -> list[Step]:
    """Runbook: numbered steps with the tools' defaults filled in; given nulls do not override."""
    return [Step(s.tool, tools[s.tool].defaults | {k: v for k, v in s.params.items() if v is not None}, i) for i, s in enumerate(plan)]


def execute(spark: SparkSession, plan: list[Step], tools: dict[str, Tool], warehouse: str, params: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, tries: int = 2) -> list[dict]:
    """Run a plan; each step's output is a Parquet table named by its id, and one that is there is read, not made again.

    The answer has a state per step; a step that fails after its tries stops the run, and those behind it stay pending.
    """
    if errors := validate(plan, tools, tuple(tables or ())):
        raise ValueError("; ".join(errors))
    have, out, previous, stopped = dict(tables or {}), [], {}, False
    for s in expand(plan, tools):
        tool = tools[s.tool]
        path = f"{warehouse.rstrip('/')}/{tool.stage}-{s.id(tool.stage)}"
        state = {"step": asdict(s), "id": s.id(tool.stage), "status": "pending", "attempts": 0, "error": "", "path": path}
        out.append(state)
        if stopped:
            continue
        if finished(spark, path):
            have[tool.provides] = spark.read.parquet(path)
            state["status"] = "skipped"
        else:
            while state["attempts"] < tries and state["status"] != "succeeded":
                state["attempts"] += 1
                try:
                    tool.run(spark, have, fill(s.params, params or {}, previous)).write.mode("overwrite").parquet(path)
                    have[tool.provides] = spark.read.parquet(path)
                    state["status"] = "succeeded"
                except Exception as e:
                    state |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
            stopped = state["status"] == "failed"
        previous[s.tool] = path
    return out


def catalogue(tools: dict[str, Tool]) -> list[tuple[str, str, str, str]]:
    return sorted((t.name, t.stage, ",".join(t.requires), t.provides) for t in tools.values())
