"""Services: one job record around each operator, and the whole pipeline.

Each function here is the counterpart of one service call: it records the job,
runs the operator, writes Parquet where it has an output, and records the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as cleaning
from ..operators import deidentify as deid
from ..operators import features, gate, lineage, monitor, profile, sketch_profile
from ..operators import sample as sampling
from ..operators.plan_lineage import field_mappings
from ..sources.readers import ConfigError, read_source
from ..sources.sinks import append_event, post_webhook, staging_uri, write_parquet
from . import schedule as plan_times
from . import watermarks
from .jobs import Records, current
from .keyed_files import KeyedFiles
from .plugins import PluginRegistry
from .version_store import VersionStore
from .versions import commit_version


PROFILES = "profile_id string, tenant_id string, job_id string, uri string, row_count bigint, column_count bigint, parts string, created_at string"
REPORTS = "report_id string, tenant_id string, job_id string, uri string, status string, quality_score double, results string, created_at string"


def _post_events(endpoint: str, rows: Iterable) -> None:
    for row in rows:
        post_webhook(endpoint, json.loads(row["event"]))


@dataclass
class Outcome:
    job_id: str
    status: str
    output_uri: str | None = None
    row_count: int = 0
    details: dict = field(default_factory=dict)


class Services:
    """The operators as recorded jobs of one tenant under one root folder."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str = "default"):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant_id
        self.records = Records(spark, f"{self.root}/meta")

    def _event(self, kind: str, payload: dict) -> None:
        append_event(self.spark, f"{self.root}/meta/events_log", kind, payload | {"tenant_id": self.tenant})

    def _run(self, job_type: str, source: dict, work: Callable[[str], Outcome]) -> Outcome:
        job = self.records.job(self.tenant, job_type, source, status="running")
        self._event("pipeline.job.created", {"job_id": job, "job_type": job_type})
        try:
            out = work(job)
        except Exception as problem:
            self.records.job(self.tenant, job_type, source, job_id=job, status="failed", error_message=str(problem).splitlines()[0][:500] if str(problem) else type(problem).__name__)
            self._event("pipeline.job.failed", {"job_id": job})
            raise
        known = {k: out.details[k] for k in ("quality_score", "data_version", "column_count") if k in out.details}
        self.records.job(self.tenant, job_type, source, job_id=job, status=out.status, row_count=out.row_count, output_uri=out.output_uri, **known)
        self._event(f"pipeline.job.{out.status}", {"job_id": job, "output_uri": out.output_uri})
        return out

    def _store(self, df: DataFrame, job: str, name: str) -> Outcome:
        uri = write_parquet(df, staging_uri(self.root, self.tenant, job, name))
        return Outcome(job, "completed", uri, self.spark.read.parquet(uri).count(), {"column_count": len(df.columns), "schema": dict(df.dtypes)})

    def ingest(self, source_type: str, config: dict) -> Outcome:
        return self._run("ingest", {"type": source_type} | config, lambda job: self._store(read_source(self.spark, source_type, config), job, "data"))

    def profile(self, uri: str) -> Outcome:
        """The exact profile of a table, kept as a record that can be looked up by its id or its job's."""

        def work(job: str) -> Outcome:
            df = self.spark.read.parquet(uri)
            parts = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in profile.profile(df).items()}
            rows, found = df.count(), uuid.uuid4().hex
            row = {"profile_id": found, "tenant_id": self.tenant, "job_id": job, "uri": uri, "row_count": rows, "column_count": len(df.columns), "parts": json.dumps(parts, default=str), "created_at": datetime.now(UTC).isoformat()}
            self.records.append("profiles", [row], PROFILES)
            return Outcome(job, "completed", None, rows, parts | {"profile_id": found})

        return self._run("profile", {"uri": uri}, work)

    def find_profile(self, profile_id: str | None = None, job_id: str | None = None) -> dict:
        """The record of a profile; an unknown one is an error."""
        return self._find("profiles", PROFILES, "profile_id", profile_id, job_id, "parts")

    def find_report(self, report_id: str | None = None, job_id: str | None = None) -> dict:
        """The record of a quality check with the results of all its rules; an unknown one is an error."""
        return self._find("quality_reports", REPORTS, "report_id", report_id, job_id, "results")

    def _find(self, table: str, schema: str, key: str, value: str | None, job_id: str | None, parsed: str) -> dict:
        wanted = F.col(key) == value if value is not None else F.col("job_id") == job_id
        row = self.records.read(table, schema).filter((F.col("tenant_id") == self.tenant) & wanted).orderBy(F.desc("created_at")).first()
        if row is None:
            raise KeyError(f"no {key} {value or job_id}")
        return row.asDict() | {parsed: json.loads(row[parsed])}

    def profile_batch(self, dataset: str, batch: str, uri: str) -> Outcome:
        """Keep the states of one batch of a dataset; a batch profiled again counts once, as it was last."""

        def work(job: str) -> Outcome:
            states = sketch_profile.profile_states(self.spark.read.parquet(uri))
            named = states.withColumns({"tenant_id": F.lit(self.tenant), "dataset": F.lit(dataset), "batch": F.lit(batch), "created_at": F.lit(datetime.now(UTC).isoformat())})
            named.coalesce(1).write.mode("append").parquet(f"{self.root}/meta/profile_states")
            rows = named.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
            return Outcome(job, "completed", uri, rows, {"dataset": dataset, "batch": batch})

        return self._run("profile", {"uri": uri, "batch": batch}, work)

    def dataset_profile(self, dataset: str) -> DataFrame:
        """The merged profile of a dataset's batches, with the sketches' error bounds; no rows are read."""
        schema = sketch_profile.STATE + ", tenant_id string, dataset string, batch string, created_at string"
        mine = self.records.read("profile_states", schema).filter((F.col("tenant_id") == self.tenant) & (F.col("dataset") == dataset))
        return sketch_profile.estimates(sketch_profile.merged(current(mine, ["batch", "column"], "created_at")))

    def clean(self, uri: str, config: dict) -> Outcome:
        return self._run("clean", {"uri": uri}, lambda job: self._store(cleaning.clean(self.spark.read.parquet(uri), config), job, "cleaned"))

    def transform(self, uri: str, config: dict) -> Outcome:
        return self._run("transform", {"uri": uri}, lambda job: self._store(features.transform(self.spark.read.parquet(uri), config), job, "transformed"))

    def deidentify(self, uri: str, config: dict) -> Outcome:
        def work(job: str) -> Outcome:
            found = deid.deidentify(self.spark.read.parquet(uri), config, job, self.tenant)
            out = self._store(found.dataframe, job, "deidentified")
            out.details |= {"audit_log": [r.asDict() for r in found.audit_log.collect()], "pii_columns": found.pii_columns} | (risk := found.risk.first().asDict())
            if risk["above_threshold"]:
                self._event("deidentify.risk", {"uri": out.output_uri, "risk_score": risk["risk_score"]})
            return out

        return self._run("transform", {"uri": uri}, work)

    def sample(self, uri: str, config: dict) -> Outcome:
        def work(job: str) -> Outcome:
            drawn = sampling.sample(self.spark.read.parquet(uri), config)
            out = self._store(drawn.dataframe, job, "sample")
            out.details |= {"strategy": drawn.strategy, "sampling_ratio": drawn.sampling_ratio, "bias": {k: [r.asDict() for r in v.collect()] for k, v in drawn.bias.items()}}
            return out

        return self._run("transform", {"uri": uri}, work)

    def load_delta(self, source_uri: str, staged_uri: str | None, config: dict) -> Outcome:
        def work(job: str) -> Outcome:
            uri = staging_uri(self.root, self.tenant, job, "merged")
            staged = self.spark.read.parquet(staged_uri) if staged_uri else None
            load = watermarks.run_load(self.spark, f"{self.root}/meta", self.spark.read.parquet(source_uri), staged, config, uri, self.tenant)
            return Outcome(job, "completed", uri, self.spark.read.parquet(uri).count(), {"inserted_rows": load.inserted_rows, "updated_rows": load.updated_rows, "deleted_rows": load.deleted_rows, "watermark": load.watermark})

        return self._run("ingest", {"uri": source_uri}, work)

    def check_quality(self, uri: str, rules: list[dict], as_of: str | None = None, webhook: str | None = None) -> Outcome:
        """A failed rule makes the job failed, without an exception.

        Metrics join the tenant's history, failed rules that alert its alert table;
        ``webhook`` is told of each of those too.
        """

        def work(job: str) -> Outcome:
            df = self.spark.read.parquet(uri)
            v = monitor.run_rules(df, rules, as_of)
            now = datetime.now(UTC)
            if v.rule_results:
                self.records.append("metric_history", monitor.history_rows(v.rule_results, self.tenant, int(now.timestamp() * 1_000_000)), monitor.HISTORY_ROWS)
            sent = self._alert(v.alerts, uri, now.isoformat(), webhook)
            status, found = "completed" if v.passed else "failed", uuid.uuid4().hex
            self.records.append("quality_reports", [{"report_id": found, "tenant_id": self.tenant, "job_id": job, "uri": uri, "status": status, "quality_score": v.quality_score, "results": json.dumps(v.rule_results, default=str), "created_at": now.isoformat()}], REPORTS)
            return Outcome(job, status, uri, df.count(), {"quality_score": v.quality_score, "results": v.rule_results, "alerts": v.alerts, "webhook_calls": sent, "report_id": found})

        return self._run("transform", {"uri": uri}, work)

    def _alert(self, alerts: list[dict], uri: str, at: str, webhook: str | None) -> int:
        """Store alerts and tell the webhook; how many calls it took well."""
        if not alerts:
            return 0
        rows = monitor.alert_rows(alerts, self.tenant, uri, at)
        self.records.append("alerts", rows, monitor.ALERTS)
        self._event("quality.alert", {"uri": uri, "rules": [a["rule"] for a in alerts]})
        return sum(post_webhook(webhook, r) for r in rows) if webhook else 0

    def alerts(self) -> DataFrame:
        return self.records.read("alerts", monitor.ALERTS).filter(F.col("tenant_id") == self.tenant)

    def metric_history(self) -> DataFrame:
        """``key, seq, value`` of this tenant's checks."""
        return self.records.read("metric_history", monitor.HISTORY_ROWS).filter(F.col("tenant_id") == self.tenant).select("key", "seq", "value")

    def monitoring(self) -> DataFrame:
        """One row a metric: ``key, n, latest, mean, std, trend, z_score, is_anomaly`` of its newest value."""
        last = monitor.anomalies(monitor.recent(self.metric_history())).groupBy("key").agg(F.max_by(F.struct("z_score", "is_anomaly"), "seq").alias("last"))
        return last.join(monitor.trends(self.metric_history()), "key", "left").select("key", "n", "latest", "mean", "std", "trend", "last.z_score", "last.is_anomaly")

    def export(self, registry: PluginRegistry, name: str, uri: str, config: dict | None = None) -> Outcome:
        """A table through one of the tenant's exporter plugins."""

        def work(job: str) -> Outcome:
            df = self.spark.read.parquet(uri)
            if registry.named(self.tenant, name).kind != "exporter":
                raise ConfigError(f"plugin {name!r} is no exporter")
            return Outcome(job, "completed", str(registry.execute(self.tenant, name, df, config)), df.count())

        return self._run("transform", {"uri": uri, "exporter": name}, work)

    def lineage(self, uri: str, field: str | None = None, max_depth: int = lineage.MAX_DEPTH) -> dict[str, DataFrame]:
        """What a dataset came from, what came from it, what a change affects, and, with ``field``, that field's sources."""
        edges = self.edges()
        out = lineage.dataset_lineage(edges, uri, self.tenant, max_depth) | {"impact": lineage.impact(edges, uri, self.tenant, max_depth)}
        return out | ({"field": lineage.trace_field(edges, uri, field, self.tenant, max_depth)} if field else {})

    def publish_runs(self, endpoint: str | None = None) -> int:
        """Store a run event for each edge that has none yet, and post those to ``endpoint``; how many there were.

        Events are stored before they are posted; posting is best effort and runs in tasks.
        """
        known = self.records.read("run_events", "edge_id string, event string")
        new = lineage.run_events(self.edges().filter(F.col("tenant_id") == self.tenant)).join(known.select("edge_id"), "edge_id", "left_anti")
        batch = f"{self.root}/meta/run_batches/{uuid.uuid4().hex}"
        new.write.parquet(batch)
        stored = self.spark.read.schema("edge_id string, event string").parquet(batch)
        stored.write.mode("append").parquet(f"{self.root}/meta/run_events")
        if endpoint:
            stored.foreachPartition(partial(_post_events, endpoint))
        return stored.count()

    def schedule(self, pipeline_id: str, cron: str, stages: list[str], dependencies: dict[str, list[str]] | None = None, active: bool = True) -> list[str]:
        """Keep a pipeline's schedule, the newest one counting; its stages in order. Bad cron texts and cycles are errors."""
        seen = plan_times.validate_cron(cron)
        if not seen["valid"]:
            raise ConfigError(seen["error"])
        order = plan_times.stage_order(stages, dependencies or {})
        row = {"tenant_id": self.tenant, "pipeline_id": pipeline_id, "cron": cron, "stages": json.dumps(order), "dependencies": json.dumps(dependencies or {}), "active": active, "updated_at": datetime.now(UTC).isoformat()}
        self.records.append("schedules", [row], plan_times.SCHEDULES)
        return order

    def schedules(self) -> DataFrame:
        mine = self.records.read("schedules", plan_times.SCHEDULES).filter(F.col("tenant_id") == self.tenant)
        return current(mine, ["pipeline_id"], "updated_at").filter("active")

    def upcoming(self, after: datetime | None = None) -> list[tuple[datetime, str]]:
        """The next run of each scheduled pipeline, soonest first."""
        found = plan_times.upcoming(self.schedules(), after).filter("run_at IS NOT NULL").orderBy("run_at", "pipeline_id")
        return [(r["run_at"], r["pipeline_id"]) for r in found.toLocalIterator()]

    def run_pipeline(self, pipeline_id: str, work: dict[str, Callable[[], object]]) -> str:
        """Run a scheduled pipeline's stages in order and track the run; a failing stage ends it and is raised."""
        found = self.schedules().filter(F.col("pipeline_id") == pipeline_id).first()
        if found is None:
            raise ConfigError(f"no schedule for {pipeline_id!r}")
        run, done = uuid.uuid4().hex, []
        note = lambda status: plan_times.track_run(self.records, pipeline_id, run, status, {"done": done}, self.tenant)
        note("running")
        try:
            for stage in json.loads(found["stages"]):
                work[stage]()
                done.append(stage)
        except Exception:
            note("failed")
            raise
        note("completed")
        return run

    def runs(self, pipeline_id: str, limit: int = 20) -> DataFrame:
        return plan_times.run_history(self.records.read("pipeline_runs", plan_times.RUNS), pipeline_id, self.tenant, limit)

    def snapshot(self, uri: str, keys: list[str], metadata: dict | None = None) -> str:
        """Store a table as a version, sharing what earlier ones have."""
        return self.store().commit(self.spark.read.parquet(uri), keys, metadata)

    def store(self) -> VersionStore:
        return VersionStore(self.spark, f"{self.root}/versions", self.tenant)

    def merge_files(self, source_uri: str, table_uri: str, config: dict) -> Outcome:
        """Merge a delta into a table of files, rewriting only those it touches; then move the watermark."""

        def work(job: str) -> Outcome:
            done, mark = watermarks.merge_load(self.spark, f"{self.root}/meta", self.spark.read.parquet(source_uri), KeyedFiles(self.spark, table_uri), config, self.tenant)
            return Outcome(job, "completed", table_uri, done.inserted_rows + done.updated_rows, asdict(done) | {"watermark": mark})

        return self._run("ingest", {"uri": source_uri}, work)

    def commit(self, uri: str, metadata: dict | None = None) -> str:
        return commit_version(self.spark, f"{self.root}/meta", uri, metadata, self.tenant)

    def record_stage(self, step: str, inputs: list[str], output: str, fields: dict[str, list[str]] | None = None, job_id: str = "") -> None:
        lineage.record(self.spark, step, inputs, output, fields, None, job_id, self.tenant).coalesce(1).write.mode("append").parquet(f"{self.root}/meta/lineage_edges")

    def edges(self) -> DataFrame:
        return self.records.read("lineage_edges", lineage.EDGES)

    def orchestrate(self, config: dict) -> Outcome:
        """ingest, profile, clean, transform, gate, version; the gate sees the rows that come out.

        ``source_type, source_config`` or ``input_uri``; ``skip_profile, cleaning,
        transform, suite, quality_threshold, version (true)``.
        """

        def work(job: str) -> Outcome:
            uri, details = config.get("input_uri"), {}
            if not uri:
                if not config.get("source_type"):
                    raise ConfigError("input_uri or source_type is missing")
                uri = self.ingest(config["source_type"], config.get("source_config", {})).output_uri
            if not config.get("skip_profile"):
                details["profile_job"] = self.profile(uri).job_id
            df = self.spark.read.parquet(uri)
            if config.get("cleaning") is not None:
                df = cleaning.clean(df, config["cleaning"])
            if config.get("transform") is not None:
                df = features.transform(df, config["transform"])
            out = self._store(df, job, "result")
            self.record_stage("orchestrate", [uri], out.output_uri, field_mappings(df), job)
            if config.get("suite") is not None:
                suite = config["suite"] if isinstance(config["suite"], dict) else gate.load_suite(self.spark, config["suite"])
                threshold = config.get("quality_threshold", gate.PASS_MARK)
                seen = gate.validate(self.spark.read.parquet(out.output_uri), suite, threshold)
                details |= {"quality_score": seen.quality_score, "gate": seen.results}
                if not seen.passed:
                    raise ValueError(f"quality score {seen.quality_score} is under {threshold}")
            if config.get("version", True):
                details["data_version"] = self.commit(out.output_uri, {"job_id": job})
            out.details |= details
            return out

        return self._run("orchestrate", config.get("source_config", {"uri": config.get("input_uri")}), work)
