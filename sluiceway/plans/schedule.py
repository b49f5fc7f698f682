"""Schedules: stage order, cron expressions, and texts for other schedulers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import current

# Fields of a cron expression with their ranges, and the named expressions.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day-of-month", 1, 31), ("month", 1, 12), ("day-of-week", 0, 7))
ALIASES = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
RETRIES, RETRY_SECONDS, STAGE_SECONDS = 3, 300, 3600


def stage_order(stages: list[str], dependencies: dict[str, list[str]]) -> list[str]:
    """Stages after all they depend on, otherwise in the order given; unknown stages and cycles are errors."""
    place = {s: i for i, s in enumerate(stages)}
    if strangers := sorted({x for k, v in dependencies.items() for x in (k, *v)} - place.keys()):
        raise ValueError(f"unknown stages: {', '.join(strangers)}")
    waits = {s: set(dependencies.get(s, ())) for s in stages}
    ready = [place[s] for s in stages if not waits[s]]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        done = stages[heapq.heappop(ready)]
        out.append(done)
        for s in stages:
            if done in waits[s]:
                waits[s].discard(done)
                if not waits[s]:
                    heapq.heappush(ready, place[s])
    if len(out) < len(stages):
        raise ValueError(f"cycle among stages: {', '.join(s for s in stages if s not in out)}")
    return out


def cron_values(field: str, name: str, low: int, high: int) -> set[int]:
    """The numbers a field stands for: lists of ``*``, ``n``, ``a-b``, each with an optional ``/step``."""
    out: set[int] = set()
    for item in field.split(","):
        span, _, step = item.partition("/")
        if "/" in item and not (step.isdigit() and int(step)):
            raise ValueError(f"{name}: step {step!r} is no positive number")
        first, dash, last = span.partition("-")
        if span == "*":
            a, b = low, high
        elif first.isdigit() and (last.isdigit() if dash else True):
            a, b = int(first), int(last) if dash else (high if step else int(first))
        else:
            raise ValueError(f"{name}: {item!r} can't be read")
        if not low <= a <= b <= high:
            raise ValueError(f"{name}: {item!r} lies outside {low}-{high}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def parse_cron(expression: str) -> list[set[int]]:
    fields = ALIASES.get(expression.strip(), expression).split()
    if len(fields) != len(FIELDS):
        raise ValueError(f"a cron expression has 5 fields, not {len(fields)}")
    values = [cron_values(f, *spec) for f, spec in zip(fields, FIELDS, strict=True)]
    values[4] = {d % 7 for d in values[4]}
    return values


def next_runs(expression: str, after: datetime | None = None, count: int = 5, days: int = 1500) -> list[datetime]:
    """The next moments after ``after`` that all five fields allow.

    If both day fields are restricted, either one is enough, as cron has it.
    """
    minutes, hours, dom, months, dow = parse_cron(expression)
    fields = ALIASES.get(expression.strip(), expression).split()
    either = fields[2] != "*" and fields[4] != "*"
    start = (after or datetime.now(UTC)).replace(second=0, microsecond=0) + timedelta(minutes=1)
    out: list[datetime] = []
    for n in range(days):
        day = (start + timedelta(days=n)).replace(hour=0, minute=0)
        by_month, by_week = day.day in dom, day.isoweekday() % 7 in dow
        if day.month in months and (by_month or by_week if either else by_month and by_week):
            moments = (day.replace(hour=h, minute=m) for h in sorted(hours) for m in sorted(minutes))
            out += [t for t in moments if t >= start][: count - len(out)]
            if len(out) >= count:
                break
    return out


def upcoming(schedules: DataFrame, after: datetime | None = None) -> DataFrame:
    """``pipeline_id, run_at``: the next run of each row's cron expression, worked out by the tasks that have the rows."""
    moment = after or datetime.now(UTC).replace(tzinfo=None)

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            runs = [next_runs(cron, moment, 1) for cron in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] if r else None for r in runs], pa.timestamp("us"))], names=["pipeline_id", "run_at"])

    return schedules.select("pipeline_id", "cron").mapInArrow(work, "pipeline_id string, run_at timestamp_ntz")


def describe_cron(expression: str) -> str:
    minute, hour, dom, month, dow = ALIASES.get(expression.strip(), expression).split()
    if (minute, hour, dom, month, dow) == ("*",) * 5:
        return "Every minute"
    if minute.startswith("*/") and (hour, dom, month, dow) == ("*",) * 4:
        return f"Every {minute[2:]} minutes"
    if hour == "*" and minute.isdigit() and (dom, month, dow) == ("*",) * 3:
        return f"Every hour at minute {int(minute)}"
    if minute.isdigit() and hour.isdigit():
        at = f"at {int(hour):02d}:{int(minute):02d}"
        if (dom, month, dow) == ("*",) * 3:
            return f"Every day {at}"
        if (dom, month) == ("*", "*"):
            return f"On weekdays {dow} {at}"
        if (month, dow) == ("*", "*"):
            return f"On day {dom} of every month {at}"
    return f"Cron schedule {expression}"


def validate_cron(expression: str, after: datetime | None = None) -> dict:
    try:
        runs = next_runs(expression, after)
        return {"valid": True, "expression": expression, "next_runs": [r.isoformat() for r in runs], "description": describe_cron(expression), "error": None}
    except ValueError as problem:
        return {"valid": False, "expression": expression, "next_runs": [], "description": "", "error": str(problem)}


def airflow_dag(config: dict, tenant_id: str) -> str:
    """A DAG file with one bash task per stage that runs the pipeline's stage."""
    stages, needs = config["stages"], config.get("dependencies", {})
    retry = config.get("retry", {})
    name = config.get("pipeline_id", "pipeline")
    lines = [
        "from datetime import datetime, timedelta",
        "from airflow import DAG",
        "from airflow.operators.bash import BashOperator",
        "",
        f"defaults = dict(owner={tenant_id!r}, retries={retry.get('max_retries', RETRIES)}, retry_delay=timedelta(seconds={retry.get('delay_seconds', RETRY_SECONDS)}), execution_timeout=timedelta(seconds={retry.get('timeout_seconds', STAGE_SECONDS)}))",
        f"with DAG({name!r}, schedule={config.get('schedule', '@daily')!r}, start_date=datetime(2024, 1, 1), catchup=False, default_args=defaults) as dag:",
        "    tasks = {}",
    ]
    lines += [f"    tasks[{s!r}] = BashOperator(task_id={s!r}, bash_command={'spark-submit run_stage.py ' + name + ' ' + s!r})" for s in stage_order(stages, needs)]
    lines += [f"    tasks[{up!r}] >> tasks[{s!r}]" for s in stages for up in needs.get(s, ())]
    return "\n".join(lines) + "\n"


def temporal_workflow(config: dict, tenant_id: str) -> dict:
    """A workflow description: activities in order with their retry policies."""
    retry = config.get("retry", {})
    delay = retry.get("delay_seconds", RETRY_SECONDS)
    policy = {"maximum_attempts": retry.get("max_retries", RETRIES), "initial_interval_seconds": delay, "backoff_coefficient": 2.0, "maximum_interval_seconds": 10 * delay}
    needs = config.get("dependencies", {})
    return {
        "workflow_id": f"{tenant_id}-{config.get('pipeline_id', 'pipeline')}",
        "schedule": config.get("schedule"),
        "activities": [{"name": s, "depends_on": list(needs.get(s, ())), "start_to_close_timeout_seconds": retry.get("timeout_seconds", STAGE_SECONDS), "retry_policy": policy} for s in stage_order(config["stages"], needs)],
    }


SCHEDULES = "tenant_id string, pipeline_id string, cron string, stages string, dependencies string, active boolean, updated_at string"

RUNS = "tenant_id string, pipeline_id string, run_id string, status string, metadata string, updated_at string"


def track_run(records, pipeline_id: str, run_id: str, status: str, metadata: dict | None = None, tenant_id: str = "default") -> None:
    """Append a state of a run to :class:`~sluiceway.plans.jobs.Records`."""
    records.append("pipeline_runs", [{"tenant_id": tenant_id, "pipeline_id": pipeline_id, "run_id": run_id, "status": status, "metadata": json.dumps(metadata or {}, default=str), "updated_at": datetime.now(UTC).isoformat()}], RUNS)


def run_history(runs: DataFrame, pipeline_id: str, tenant_id: str = "default", limit: int = 20) -> DataFrame:
    """The newest state of the latest runs."""
    mine = runs.filter((F.col("tenant_id") == tenant_id) & (F.col("pipeline_id") == pipeline_id))
    return current(mine, ["run_id"], "updated_at").orderBy(F.desc("updated_at"), "run_id").limit(limit)
