"""JSON plans of steps, run as one lazy DataFrame.

A plan is {"steps": [{"operator": ..., "params": {...}}, ...], "logical_circuit_id": ...} or one flat step
{"operation": ..., **parameters}. Sources start a plan, transforms take the rows of the step before, terminal steps end
it. What can be known beforehand is checked beforehand; only names, scopes and facts of single entities are looked up
while a plan is built.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import graph, history, latest, records, resolve, transitions
from quillon.operators.records import VERSION_FIELDS, PlanError
from quillon.session import cut

# Statuses of an answer.
STATUSES = ("ANSWERABLE", "PARTIALLY_ANSWERABLE", "MISSING_DATA", "UNSUPPORTED_OPERATION", "AMBIGUOUS", "UNKNOWN_ENTITY", "INVALID_PLAN")
# Names of a submission's official evaluation in plans, and the columns of the evaluations table.
EVALUATION_FIELDS = {
    "evaluation.peak_qubits": "official_peak_qubits",
    "evaluation.avg_executed_toffoli": "official_avg_executed_toffoli",
    "evaluation.score": "official_score",
    "evaluation.passed": "passed",
    "platform.status": "platform_status",
    "platform.rejection_reason": "rejection_reason",
    "platform.promotion_status": "promotion_status",
    "platform.promotion_reason": "promotion_reason",
    "platform.created_at": "platform_created_at",
    "platform.updated_at": "platform_updated_at",
    "platform.promotion_finished_at": "promotion_finished_at",
    "platform.submission_commit_sha": "submission_commit_sha",
    "platform.promoted_source_ref": "promoted_source_ref",
}
# Fields that are numbers by their names.
NUMERIC_FIELDS = ("absolute_change", "percentage_change", "metric_before", "metric_after", "count", "sum", "mean", "min", "max", "sequence_no", "toffoli_count", "peak_qubits", "score", "qubit_count", "operation_count")
NUMERIC_SUFFIXES, NUMERIC_PREFIXES = ("_delta", "_pct_change", "_before", "_after"), ("structural.", "evaluation.")
#: Candidates that an answer names, versions that one step describes, and related versions that it lists.
NAMED, DESCRIBED, PREVIEW = 20, 10, 5


@dataclass
class Step:
    operator: str
    params: dict


@dataclass
class Plan:
    steps: list[Step]
    circuit: str | None = None

    @classmethod
    def parse(cls, plan: str | dict) -> Plan:
        if isinstance(plan, str):
            try:
                plan = json.loads(plan)
            except ValueError as e:
                raise PlanError(str(e)) from e
        if not isinstance(plan, dict):
            raise PlanError("a plan is an object")
        raw = plan["steps"] if "steps" in plan else [{k: v for k, v in plan.items() if k != "logical_circuit_id"}]
        if not isinstance(raw, list) or not raw:
            raise PlanError("a plan has steps")
        steps = []
        for x in raw:
            name = x.get("operator", x.get("operation")) if isinstance(x, dict) else None
            if not isinstance(name, str):
                raise PlanError("a step has an operator")
            own = x["params"] if isinstance(x.get("params"), dict) else {k: v for k, v in x.items() if k not in ("operator", "operation", "params")}
            steps.append(Step(name, dict(own)))
        return cls(steps, plan.get("logical_circuit_id"))

    def normal_form(self) -> str:
        """Text that plans of one meaning share: default parameters filled in, conditions sorted."""
        out = []
        for s in self.steps:
            p = DEFAULTS.get(s.operator, {}) | s.params
            if isinstance(p.get("conditions"), list):
                p = p | {"conditions": sorted(p["conditions"], key=lambda c: json.dumps(c, sort_keys=True))}
            out.append({"operator": s.operator, "params": p})
        return json.dumps({"steps": out, "logical_circuit_id": self.circuit}, sort_keys=True)


@dataclass
class Result:
    status: str
    data: DataFrame | None = None
    message: str = ""
    missing_fields: list[str] = field(default_factory=list)
    available_fields: list[str] = field(default_factory=list)
    #: One row (missing, total): records that were left out for want of a metric, counted when note() is called.
    left_out: DataFrame | None = None

    def note(self) -> str:
        """The message, with how many records were left out."""
        if self.left_out is None:
            return self.message
        missing, total = self.left_out.first()
        more = f"{missing} of {total} record(s) lack a metric that the plan needs and were left out" if missing else ""
        return "; ".join(x for x in (self.message, more) if x)


class Stop(Exception):
    """Ends a plan with a result."""

    def __init__(self, status: str, message: str = "", missing: list[str] | None = None, available: list[str] | None = None):
        super().__init__(message)
        self.result = Result(status, None, message, missing or [], available or [])


def submission_scoped(metric) -> bool:
    return isinstance(metric, str) and metric.startswith(("evaluation.", "platform."))


@dataclass
class Store:
    """The tables that plans run on; columns that a table lacks are null, tables but versions may be None.

    versions: VERSION_FIELDS, realized_from_submission_id. metrics: version_id and one column for each metric. edges:
    src, dst, relation, perhaps edge_id. submissions: submission_id, external_submission_key, status. evaluations:
    submission_id, snapshot_id, fetched_at and the columns of EVALUATION_FIELDS. contributors: contributor_identity_id,
    current_handle, source_identity_key, alias. contributions: submission_id, contributor_identity_id, role,
    evidence_class, declared_reference, source_field, snapshot_id, fetched_at.
    """

    versions: DataFrame
    metrics: DataFrame | None = None
    edges: DataFrame | None = None
    submissions: DataFrame | None = None
    evaluations: DataFrame | None = None
    contributors: DataFrame | None = None
    contributions: DataFrame | None = None
    circuit: str | None = None

    COLUMNS = {
        "versions": (*VERSION_FIELDS, "realized_from_submission_id"),
        "submissions": ("submission_id", "external_submission_key", "status"),
        "evaluations": ("submission_id", "snapshot_id", "fetched_at", *EVALUATION_FIELDS.values()),
        "contributors": ("contributor_identity_id", "current_handle", "source_identity_key", "alias"),
        "contributions": ("submission_id", "contributor_identity_id", "role", "evidence_class", "declared_reference", "source_field", "snapshot_id", "fetched_at"),
    }

    def __post_init__(self) -> None:
        for name, columns in self.COLUMNS.items():
            df = getattr(self, name)
            if df is not None:
                setattr(self, name, df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)))

    def need(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise Stop("MISSING_DATA", f"there are no {name}", [name])
        return found

    def scoped(self, circuit: str | None) -> Store:
        """The store with one circuit: the named one, or the only one there is."""
        if circuit is None:
            found = [r[0] for r in self.versions.select("logical_circuit_id").distinct().orderBy("logical_circuit_id").limit(NAMED).collect()]
            if not found:
                raise Stop("MISSING_DATA", "there are no circuits")
            if len(found) > 1:
                raise Stop("AMBIGUOUS", "several circuits: name a logical_circuit_id", available=found)
            circuit = found[0]
        return replace(self, circuit=circuit, versions=self.versions.where(F.col("logical_circuit_id").eqNullSafe(F.lit(circuit))))

    def metric_names(self) -> list[str]:
        return [c for c in self.metrics.columns if c != "version_id"] if self.metrics is not None else []

    def records(self, versions: DataFrame | None = None, record_status: str | None = None) -> DataFrame:
        """Version records: identity fields and all metrics."""
        rows = (self.versions if versions is None else versions).select(*VERSION_FIELDS)
        metrics = self.metrics if self.metrics is not None else rows.select("version_id").limit(0)
        return records.list_versions(rows, metrics, record_status)

    def find_version(self, reference) -> dict | None:
        """The version by id, then external key, then label (this only of the plan's circuit, if it names one)."""
        found = resolve.first(self.versions, str(reference), ["version_id", "external_version_key", "version_label"]).collect()
        return found[0].asDict() if found else None

    def version(self, reference) -> dict:
        if not reference or not isinstance(reference, (str, int)):
            raise PlanError("a version is a name")
        found = self.find_version(reference)
        if found is None:
            raise Stop("MISSING_DATA", f"no version {reference!r}")
        return found

    def values(self, version) -> dict:
        """The recorded metrics of one version."""
        if self.metrics is None:
            return {}
        found = self.metrics.where(F.col("version_id") == F.lit(version)).limit(1).collect()
        return {k: v for k, v in found[0].asDict().items() if k != "version_id" and v is not None} if found else {}

    def submission(self, reference) -> tuple[dict, dict | None] | None:
        """The submission that a version realises, or the one of an external key; and the version."""
        version = self.find_version(reference)
        rows = self.need("submissions")
        if version is not None:
            rows = rows.where(F.col("submission_id") == F.lit(version["realized_from_submission_id"]))
        else:
            rows = rows.where(F.col("external_submission_key") == F.lit(str(reference)))
        found = rows.limit(1).collect()
        return (found[0].asDict(), version) if found else None

    def latest_evaluations(self) -> DataFrame:
        return latest.latest_row(self.need("evaluations"), ["submission_id"], ["fetched_at", "snapshot_id"])

    def evaluation(self, submission) -> dict | None:
        """The newest evaluation of one submission by the plan's names, with its snapshot."""
        if self.evaluations is None:
            return None
        rows = self.evaluations.where(F.col("submission_id") == F.lit(submission))
        found = rows.orderBy(F.col("fetched_at").desc_nulls_last(), F.col("snapshot_id").desc_nulls_last()).limit(1).collect()
        return {name: found[0][c] for name, c in EVALUATION_FIELDS.items()} | {"snapshot_id": found[0]["snapshot_id"]} if found else None

    def latest_contributions(self) -> DataFrame:
        return latest.latest_set(self.need("contributions"), ["submission_id"], ["fetched_at", "snapshot_id"])

    def contributor(self, reference) -> dict:
        """One contributor identity by the first rule that has any."""
        if not isinstance(reference, str) or not reference:
            raise PlanError("a contributor is a name")
        names = self.need("contributors").select(F.col("contributor_identity_id").alias("identity"), F.col("current_handle").alias("handle"), F.col("source_identity_key").alias("account"), "alias")
        found = history.resolve_contributor(names, reference).orderBy("identity").limit(NAMED).collect()
        if not found:
            raise Stop("UNKNOWN_ENTITY", f"no contributor {reference!r} is known", available=[])
        if len(found) > 1:
            raise Stop("AMBIGUOUS", f"several contributors {reference!r}", available=[r["identity"] for r in found])
        return found[0].asDict()


def identity_of(submission: dict, version: dict | None) -> dict:
    key = submission["external_submission_key"]
    found = {"submission_id": submission["submission_id"], "external_submission_key": key, "submission_uuid": key.partition(":")[2] or key if key else key, "lifecycle_status": submission["status"]}
    return found | {c: version[c] if version else None for c in ("external_version_key", "version_label", "version_id")}


def one_row(store: Store, values: dict) -> DataFrame:
    """A table of one row from plain values."""
    kind = lambda v: T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
    plain = {k: v if v is None or isinstance(v, (bool, int, float, str)) else str(v) for k, v in values.items()}
    return store.versions.sparkSession.createDataFrame([tuple(plain.values())], T.StructType([T.StructField(k, kind(v)) for k, v in plain.items()]))


def _conditions(params: dict) -> list[tuple]:
    found = params.get("conditions")
    if not isinstance(found, list) or not found:
        raise PlanError("conditions is a list")
    for c in found:
        if not isinstance(c, dict) or not {"metric", "operator", "value"} <= set(c):
            raise PlanError("a condition has metric, operator and value")
        if c["operator"] not in records.COMPARATORS:
            raise PlanError(f"unknown comparator {c['operator']!r}")
    return [(c["metric"], c["operator"], c["value"]) for c in found]


def _whole(value, name: str, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise PlanError(f"{name} is a whole number of {least} or more")
    return value


def _list_versions(store: Store, _, p: dict):
    return store.records(record_status=p.get("record_status"))


def _filter_versions(store: Store, _, p: dict):
    rows, left_out = records.filter_versions(store.records(), _conditions(p))
    return Result("ANSWERABLE", rows, left_out=left_out)


def _list_transitions(store: Store, _, p: dict):
    return transitions.list_transitions(store.need("edges"), store.versions, p.get("relation_type", transitions.SUCCESSOR), store.metrics, _recorded(store, p["metric"]) if p.get("metric") is not None else None)


def _recorded(store: Store, metric) -> str:
    if metric not in store.metric_names():
        raise Stop("MISSING_DATA", f"no version has {metric}", [str(metric)], store.metric_names())
    return metric


def _compute_delta(store: Store, rows: DataFrame, p: dict):
    ends = [p.get("before_field", "parent_version_id"), p.get("after_field", "child_version_id")]
    if not p.get("metric"):
        raise PlanError("compute_delta needs a metric")
    if missing := [e for e in ends if e not in rows.columns]:
        raise PlanError(f"the rows have no {missing}")
    return transitions.compute_delta(rows, store.need("metrics"), p["metric"], *ends)


def _rank(store: Store, _, p: dict):
    order, limit = p.get("order", transitions.ORDERS[0]), _whole(p.get("limit", 10), "limit")
    if order not in transitions.ORDERS:
        raise PlanError(f"unknown order {order!r}")
    relation = p.get("relation_type", transitions.SUCCESSOR)
    every = transitions.list_transitions(store.need("edges"), store.versions, relation)
    rows = transitions.list_transitions(store.edges, store.versions, relation, store.metrics, _recorded(store, p["metric"]))
    ranked = cut(transitions.rank_transitions(rows, order, limit))  # computed once: whether there is any, and the answer
    if limit and not ranked.limit(1).count():
        raise Stop("MISSING_DATA", f"no transition has {p['metric']} on both ends", [p["metric"]])
    have = store.metrics.where(records.field(p["metric"]).isNotNull()).select(F.col("version_id").alias("_have"))
    ends = every.join(have, F.col("parent_version_id") == F.col("_have"), "left_semi").join(have, F.col("child_version_id") == F.col("_have"), "left_semi")
    left_out = every.agg(F.count("*").alias("total")).join(ends.agg(F.count("*").alias("with_metric"))).select((F.col("total") - F.col("with_metric")).alias("missing"), "total")
    return Result("ANSWERABLE", transitions.rank_transitions(ranked, order, limit), left_out=left_out)


def _top_k(store: Store, rows, p: dict):
    direction = p.get("direction", "decrease")
    if direction not in ("decrease", "increase"):
        raise PlanError(f"unknown direction {direction!r}")
    return _rank(store, rows, {"metric": p["metric"], "order": f"largest_{direction}", "limit": p.get("k", 5), "relation_type": p.get("relation_type", transitions.SUCCESSOR)})


# Directions of a traversal, and whether they follow edges once.
DIRECTIONS = {"predecessors": ("in", True), "successors": ("out", True), "ancestors": ("in", False), "descendants": ("out", False)}


def _traverse(store: Store, _, p: dict):
    direction, hops = p.get("direction", "successors"), p.get("max_hops")
    if direction not in DIRECTIONS:
        raise PlanError(f"unknown direction {direction!r}")
    if hops is not None:
        _whole(hops, "max_hops", 1)
    way, once = DIRECTIONS[direction]
    relations = None if p.get("relation_type") is None else [p["relation_type"]]
    found = graph.traverse(store.need("edges"), store.version(p["version"])["version_id"], way, relations, 1 if once else hops)
    rows = store.records().join(found, F.col("version_id") == F.col("node")).drop("node")
    return Result("ANSWERABLE", rows.orderBy("hops", F.col("version_id").cast("string")))


def _scope(store: Store, reference) -> tuple[dict, dict | None]:
    found = store.submission(reference)
    if found is None:
        raise Stop("MISSING_DATA", f"no submission {reference!r}")
    return found


def _get_metric(store: Store, _, p: dict):
    metric = p["metric"]
    if submission_scoped(metric):
        submission, version = _scope(store, p["version"])
        values = store.evaluation(submission["submission_id"])
        if values is None:
            raise Stop("MISSING_DATA", f"{p['version']} has no official evaluation", [metric])
        if metric not in EVALUATION_FIELDS:
            raise PlanError(f"{metric!r} is no field of an evaluation")
        if values[metric] is None:
            raise Stop("MISSING_DATA", f"the evaluation of {p['version']} has no {metric}", [metric], sorted(k for k in EVALUATION_FIELDS if values[k] is not None))
        return Result("ANSWERABLE", one_row(store, identity_of(submission, version) | {"entity_scope": "submission", "metric": metric, "value": values[metric], "evaluation_snapshot_id": values["snapshot_id"]}))
    version = store.version(p["version"])
    values = store.values(version["version_id"])
    if metric not in values:
        raise Stop("MISSING_DATA", f"{p['version']} has no {metric}", [metric], sorted(values))
    return Result("ANSWERABLE", one_row(store, {c: version[c] for c in ("version_id", "version_label", "external_version_key")} | {"metric": metric, "value": float(values[metric])}))


def _side(store: Store, reference, evaluated: bool) -> dict | None:
    """Everything that is known of one side of a comparison, by name."""
    version, values = store.find_version(reference), {}
    if version is not None:
        values |= store.values(version["version_id"])
    elif not evaluated:
        return None
    if evaluated:
        found = store.submission(reference)
        if found is None and version is None:
            return None
        known = store.evaluation(found[0]["submission_id"]) if found else None
        values |= {k: v for k, v in (known or {}).items() if k in EVALUATION_FIELDS and v is not None}
    return values


def _compare(store: Store, _, p: dict):
    asked = p.get("metrics")
    sides = [_side(store, p[k], any(map(submission_scoped, asked or ()))) for k in ("version_a", "version_b")]
    if None in sides:
        raise Stop("MISSING_DATA", "no version " + " or ".join(repr(p[k]) for k, x in zip(("version_a", "version_b"), sides, strict=True) if x is None))
    names = list(asked) if asked else sorted(sides[0].keys() | sides[1].keys())
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    rows, missing = [], []
    for name in names:
        before, after = (x.get(name) for x in sides)
        if before is None or after is None:
            missing.append(name)
        both = number(before) and number(after)
        text = [None if v is None or number(v) else str(v) for v in (before, after)]
        rows.append((name, *(float(v) if number(v) else None for v in (before, after)), float(after - before) if both else None, (after - before) / before * 100.0 if both and before else None, *text))
    data = store.versions.sparkSession.createDataFrame(rows, "name string, before double, after double, absolute_change double, percentage_change double, before_text string, after_text string")
    status = "PARTIALLY_ANSWERABLE" if asked and missing else "ANSWERABLE"
    return Result(status, data, f"not on both sides: {', '.join(missing)}" if missing else "", missing, [n for n in names if n not in missing])


def _list_submissions(store: Store, _, p: dict):
    rows = store.need("submissions")
    versions = store.versions.where("realized_from_submission_id is not null").groupBy(F.col("realized_from_submission_id").alias("submission_id")).agg(F.min_by(F.struct("external_version_key", "version_label", "version_id"), F.col("version_id")).alias("v")).select("submission_id", "v.*")
    key = F.col("external_submission_key")
    uuid = F.when(F.instr(key, ":") > 0, F.expr("substr(external_submission_key, instr(external_submission_key, ':') + 1)")).otherwise(key)
    rows = rows.select("submission_id", "external_submission_key", uuid.alias("submission_uuid"), F.col("status").alias("lifecycle_status")).join(versions, "submission_id", "left")
    if p.get("lifecycle_status") is not None:
        rows = rows.where(F.col("lifecycle_status") == p["lifecycle_status"])
    if store.evaluations is not None:
        known = store.latest_evaluations().select("submission_id", F.lit(True).alias("_known"), *(F.col(c).alias(name) for name, c in EVALUATION_FIELDS.items()))
        rows = rows.join(known, "submission_id", "left").withColumn("has_official_evaluation", F.coalesce("_known", F.lit(False))).drop("_known")
    else:
        rows = rows.withColumn("has_official_evaluation", F.lit(False))
    if p.get("platform_status") is not None:
        rows = rows.where(records.field("platform.status") == p["platform_status"]) if store.evaluations is not None else rows.limit(0)
    if store.contributions is not None:
        own = store.latest_contributions()
        submitter = own.where("role = 'SUBMITTER'").groupBy("submission_id").agg(F.min("contributor_identity_id").alias("contributor.submitter_identity_id"))
        others = own.where("role = 'COAUTHOR' and declared_reference is not null").groupBy("submission_id").agg(F.sort_array(F.collect_set("declared_reference")).alias("contributor.declared_coauthors"))
        rows = rows.join(submitter, "submission_id", "left").join(others, "submission_id", "left")
        if store.contributors is not None:
            names = store.contributors.groupBy(F.col("contributor_identity_id").alias("contributor.submitter_identity_id")).agg(F.min("current_handle").alias("contributor.submitter"))
            names = names.withColumnRenamed("contributor.submitter_identity_id", "_identity")
            rows = rows.join(names, records.field("contributor.submitter_identity_id") == F.col("_identity"), "left").drop("_identity")
    if p.get("contributor") is not None:
        rows = rows.where(records.field("contributor.submitter_identity_id") == store.contributor(p["contributor"])["identity"]) if store.contributions is not None else rows.limit(0)
    return rows.orderBy(F.coalesce("external_submission_key", F.col("submission_id").cast("string")))


def _list_contributors(store: Store, _, p: dict):
    reference, version = p.get("contributor"), p.get("version")
    if reference is not None and version is not None:
        raise PlanError("list_contributors takes a contributor or a version")
    if version is not None:
        if not isinstance(version, str) or not version:
            raise PlanError("a version is a name")
        identity = identity_of(*_scope(store, version))
        rows = store.latest_contributions().where(F.col("submission_id") == F.lit(identity["submission_id"]))
        if not rows.limit(1).count():
            raise Stop("MISSING_DATA", f"{version} has no known contributors")
        people = store.need("contributors").groupBy(F.col("contributor_identity_id").alias("_id")).agg(F.min("current_handle").alias("current_handle"), F.min("source_identity_key").alias("source_identity_key"))
        rows = rows.join(people, F.col("contributor_identity_id") == F.col("_id"), "left")
        who = F.coalesce("current_handle", "contributor_identity_id", "declared_reference", F.lit("?"))
        way = F.concat_ws(" -> ", F.lit(identity["external_version_key"]), F.lit(identity["submission_uuid"]), F.col("role"), who)
        named = (F.lit(v).alias(k) for k, v in identity.items() if k != "submission_id")
        return rows.select("submission_id", *named, "role", "evidence_class", "contributor_identity_id", "current_handle", "source_identity_key", "declared_reference", "source_field", "snapshot_id", way.alias("attribution_path"))
    people = store.need("contributors").groupBy("contributor_identity_id").agg(F.min("source_identity_key").alias("source_identity_key"), F.min("current_handle").alias("current_handle"), F.sort_array(F.collect_set("alias")).alias("historical_handles"))
    if reference is not None:
        found = store.contributor(reference)
        people = people.where(F.col("contributor_identity_id") == F.lit(found["identity"])).withColumn("resolved_via", F.lit(found["tier"]))
    own = store.latest_contributions().select("submission_id", F.col("contributor_identity_id").alias("_id"), "role").distinct()
    versions = store.versions.select(F.col("realized_from_submission_id").alias("submission_id")).where("submission_id is not null").distinct().withColumn("_version", F.lit(True))
    own = own.join(versions, "submission_id", "left")
    if store.evaluations is not None:
        own = own.join(store.latest_evaluations().select("submission_id", F.col("official_score").alias("_score"), F.col("platform_created_at").alias("_at")), "submission_id", "left")
    else:
        own = own.withColumns({"_score": F.lit(None), "_at": F.lit(None).cast("string")})
    mine = F.col("role") == "SUBMITTER"
    counts = own.groupBy("_id").agg(
        F.count_if(mine).alias("submission_count"),
        F.count_if(F.col("role") == "COAUTHOR").alias("coauthor_count"),
        F.count_if(mine & F.col("_version").isNotNull()).alias("submissions_with_circuit_version"),
        F.count_if(mine & F.col("_score").isNotNull()).alias("submissions_with_official_evaluation"),
        F.min(F.when(mine, F.col("_at"))).alias("first_submission_at"),
        F.max(F.when(mine, F.col("_at"))).alias("last_submission_at"),
    )
    rows = people.join(counts, F.col("contributor_identity_id") == F.col("_id"), "left").drop("_id")
    return rows.fillna(0, ["submission_count", "coauthor_count", "submissions_with_circuit_version", "submissions_with_official_evaluation"])


def _relationships(store: Store, version) -> dict:
    """For each relation the predecessors and successors of a version: how many, and the first few by key."""
    if store.edges is None:
        return {}
    near = graph.directed(store.edges, "out").withColumn("way", F.lit("successors")).unionByName(graph.directed(store.edges, "in").withColumn("way", F.lit("predecessors")))
    near = near.where(F.col("here") == F.lit(version))
    keys = store.versions.select(F.col("version_id").alias("there"), F.coalesce("external_version_key", F.col("version_id").cast("string")).alias("key"))
    first = history.first_of(near.join(keys, "there"), ["relation", "way"], "key", PREVIEW)
    found: dict = {}
    for r in near.groupBy("relation", "way").agg(F.count("*").alias("count")).join(first, ["relation", "way"], "left").orderBy("relation", "way").collect():
        found.setdefault(r["relation"], {w: {"count": 0, "preview": []} for w in ("predecessors", "successors")})[r["way"]] = {"count": r["count"], "preview": r["first"] or []}
    return found


def _document(store: Store, submission: dict | None, version: dict | None) -> dict:
    """Every stored fact of a version (with its submission) or of a submission without version."""
    metrics = store.values(version["version_id"]) if version else {}
    relations = _relationships(store, version["version_id"]) if version else {}
    evaluation = store.evaluation(submission["submission_id"]) if submission else None
    people = []
    if submission and store.contributions is not None:
        people = [r.asDict() for r in store.latest_contributions().where(F.col("submission_id") == F.lit(submission["submission_id"])).select("role", "evidence_class", "contributor_identity_id", "declared_reference").orderBy("role", "contributor_identity_id", "declared_reference").limit(NAMED).collect()]
    known = lambda x: "available" if x else "unavailable"
    return {
        "entity_type": "circuit_version" if version else "submission",
        "identity": {c: version[c] for c in ("version_id", "logical_circuit_id", "external_version_key", "version_label", "sequence_no")} if version else {k: v for k, v in identity_of(submission, None).items() if k.startswith(("external_submission", "submission"))},
        "status": {"record_status": version["record_status"] if version else None, "submission_status": submission["status"] if submission else None},
        "timestamps": {"historical_time": version["historical_time"] if version else None},
        "metrics": [{"name": k, "value": v} for k, v in sorted(metrics.items())],
        "relationships": relations,
        "evaluation": {"available": bool(evaluation)} | {k: v for k, v in (evaluation or {}).items() if v is not None},
        "contributors": people,
        "availability": {"circuit_version": known(version), "submission": known(submission), "metrics": known(metrics) if version else "not_applicable", "relationships": known(relations) if version else "not_applicable", "official_evaluation": known(evaluation), "contributor_provenance": known(people)},
    }


def _describe(store: Store, rows: DataFrame | None, p: dict):
    given = [k for k in ("version", "submission", "contributor") if p.get(k) is not None]
    if len(given) > 1:
        raise PlanError("describe_entity takes one entity")
    documents = []
    if given == ["contributor"]:
        person = _list_contributors(store, None, {"contributor": p["contributor"]}).collect()[0].asDict()
        documents.append({"entity_type": "contributor"} | person)
    elif given == ["submission"]:
        found = store.need("submissions").where(F.col("external_submission_key") == F.lit(str(p["submission"]))).limit(1).collect()
        if not found:
            raise Stop("MISSING_DATA", f"no submission {p['submission']!r}")
        submission = found[0].asDict()
        versions = store.versions.where(F.col("realized_from_submission_id") == F.lit(submission["submission_id"])).orderBy("version_id").limit(NAMED).collect()
        if len(versions) > 1:
            raise Stop("AMBIGUOUS", f"{p['submission']!r} has several versions", available=[v["external_version_key"] or str(v["version_id"]) for v in versions])
        documents.append(_document(store, submission, versions[0].asDict() if versions else None))
    else:
        if given:
            wanted = [store.version(p["version"])]
        else:
            if rows is None or "version_id" not in rows.columns:
                raise PlanError("describe_entity takes an entity or rows of versions")
            ids = [r[0] for r in rows.select("version_id").limit(DESCRIBED + 1).collect()]
            if not 0 < len(ids) <= DESCRIBED:
                raise PlanError(f"describe_entity takes 1 to {DESCRIBED} rows: limit them first")
            wanted = [store.version(str(i)) for i in ids]
        for version in wanted:
            own = None
            if store.submissions is not None and version["realized_from_submission_id"] is not None:
                found = store.submissions.where(F.col("submission_id") == F.lit(version["realized_from_submission_id"])).limit(1).collect()
                own = found[0].asDict() if found else None
            documents.append(_document(store, own, version))
    return Result("ANSWERABLE", store.versions.sparkSession.createDataFrame([(json.dumps(d, default=str, sort_keys=True),) for d in documents], "document string"))


def _sort(_, rows: DataFrame, p: dict):
    if not p.get("by"):
        raise PlanError("sort needs a field")
    return records.sort_rows(rows, p["by"], p.get("order", "asc"), p.get("tie_breaker", "version_id"))


@dataclass
class Operator:
    run: Callable
    kind: str  # source, transform or terminal
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


OPERATORS: dict[str, Operator] = {
    "list_versions": Operator(_list_versions, "source", (), ("record_status",)),
    "list_transitions": Operator(_list_transitions, "source", (), ("relation_type", "metric")),
    "list_submissions": Operator(_list_submissions, "source", (), ("lifecycle_status", "platform_status", "contributor")),
    "list_contributors": Operator(_list_contributors, "source", (), ("contributor", "version")),
    "filter": Operator(lambda _, rows, p: records.filter_rows(rows, _conditions(p)), "transform", ("conditions",)),
    "sort": Operator(_sort, "transform", ("by",), ("order", "tie_breaker")),
    "limit": Operator(lambda _, rows, p: records.limit_rows(rows, p["k"]), "transform", ("k",)),
    "compute_delta": Operator(_compute_delta, "transform", ("metric",), ("before_field", "after_field")),
    "group_by": Operator(lambda _, rows, p: records.group_by(rows, p["key"], p.get("agg", "count"), p.get("metric")), "transform", ("key",), ("metric", "agg")),
    "traverse": Operator(_traverse, "terminal", ("version",), ("direction", "relation_type", "max_hops")),
    "get_metric": Operator(_get_metric, "terminal", ("version", "metric")),
    "compare_versions": Operator(_compare, "terminal", ("version_a", "version_b"), ("metrics",)),
    "filter_versions": Operator(_filter_versions, "terminal", ("conditions",)),
    "rank_transitions": Operator(_rank, "terminal", ("metric",), ("order", "limit", "relation_type")),
    "top_k_changes": Operator(_top_k, "terminal", ("metric",), ("direction", "k", "relation_type")),
    "describe_entity": Operator(_describe, "either", (), ("version", "submission", "contributor")),
}
DEFAULTS = {
    "sort": {"order": "asc", "tie_breaker": "version_id"},
    "group_by": {"agg": "count"},
    "list_transitions": {"relation_type": transitions.SUCCESSOR},
    "compute_delta": {"before_field": "parent_version_id", "after_field": "child_version_id"},
    "rank_transitions": {"order": transitions.ORDERS[0], "limit": 10, "relation_type": transitions.SUCCESSOR},
    "top_k_changes": {"direction": "decrease", "k": 5, "relation_type": transitions.SUCCESSOR},
    "traverse": {"direction": "successors"},
}
#: Operators that look at the whole store and not at one circuit.
UNSCOPED = ("list_submissions", "list_contributors", "get_metric", "compare_versions", "traverse", "describe_entity")


def _numeric(name) -> bool:
    return isinstance(name, str) and (name in NUMERIC_FIELDS or name.endswith(NUMERIC_SUFFIXES) or name.startswith(NUMERIC_PREFIXES))


def validate(plan: Plan, metrics: list[str] | None = None, relations: list[str] | None = None) -> list[tuple[str, str]]:
    """(status, message) of everything that is wrong with a plan, worst first."""
    problems = []
    for i, s in enumerate(plan.steps):
        o = OPERATORS.get(s.operator)
        if o is None:
            problems.append(("UNSUPPORTED_OPERATION", f"unknown operator {s.operator!r}"))
            continue
        problems += [("INVALID_PLAN", f"{s.operator} has no parameter {k!r}") for k in s.params if k not in o.required + o.optional]
        problems += [("INVALID_PLAN", f"{s.operator} needs {k!r}") for k in o.required if s.params.get(k) in (None, "")]
        before = OPERATORS.get(plan.steps[i - 1].operator) if i else None
        if o.kind == "transform" and not i:
            problems.append(("INVALID_PLAN", f"{s.operator} needs rows of a step before it"))
        if o.kind == "source" and i:
            problems.append(("INVALID_PLAN", f"{s.operator} can only start a plan"))
        if before is not None and before.kind == "terminal":
            problems.append(("INVALID_PLAN", f"nothing can follow {plan.steps[i - 1].operator}"))
        conditions = s.params.get("conditions")
        for c in conditions if isinstance(conditions, list) else []:
            if not isinstance(c, dict):
                continue
            if c.get("operator") not in records.COMPARATORS:
                problems.append(("INVALID_PLAN", f"unknown comparator {c.get('operator')!r}"))
            value = c.get("value")
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            if c.get("operator") in ("<", "<=", ">", ">=") and _numeric(c.get("metric")) and not number:
                problems.append(("INVALID_PLAN", f"{c.get('metric')} {c['operator']} {value!r}: a finite number is needed"))
        if metrics is not None and s.operator != "group_by" and not submission_scoped(s.params.get("metric")) and s.params.get("metric") not in (None, *metrics):
            problems.append(("MISSING_DATA", f"unknown metric {s.params['metric']!r}"))
        if relations is not None and s.params.get("relation_type") not in (None, *relations):
            problems.append(("MISSING_DATA", f"unknown relation {s.params['relation_type']!r}"))
    order = ("INVALID_PLAN", "UNSUPPORTED_OPERATION", "MISSING_DATA")
    return sorted(problems, key=lambda p: order.index(p[0]))


def _bound(params: dict, store: Store) -> dict:
    """The parameters with every {"bind": plan, "field": name} replaced by that field of the plan's first row."""
    out = {}
    for name, value in params.items():
        if isinstance(value, dict) and "bind" in value:
            found = execute(value["bind"], store)
            if found.data is None:
                raise Stop(found.status, f"{name}: {found.message}", found.missing_fields, found.available_fields)
            if value.get("field") not in found.data.columns:
                raise PlanError(f"{name}: the bound plan has no {value.get('field')!r}")
            first = found.data.select(records.field(value["field"])).limit(1).collect()
            if not first:
                raise Stop("MISSING_DATA", f"{name}: the bound plan has no row")
            value = first[0][0] if isinstance(first[0][0], (bool, int, float)) and name not in ("version", "version_a", "version_b") else str(first[0][0])
        out[name] = value
    return out


def execute(plan: Plan | str | dict, store: Store) -> Result:
    """Runs a plan; the data stays lazy, but for names, scopes, facts of single entities and rankings, which are computed once."""
    try:
        plan = plan if isinstance(plan, Plan) else Plan.parse(plan)
        if problems := validate(plan):
            return Result(problems[0][0], None, problems[0][1])
        if plan.circuit is not None or plan.steps[0].operator not in UNSCOPED:
            store = store.scoped(plan.circuit)
        rows = None
        for s in plan.steps:
            rows = OPERATORS[s.operator].run(store, rows, _bound(s.params, store))
            if isinstance(rows, Result):
                return rows
        return Result("ANSWERABLE", rows)
    except Stop as e:
        return e.result
    except PlanError as e:
        return Result("INVALID_PLAN", None, str(e))


def same_entity(store: Store, a, b) -> str:
    """SAME or DIFFERENT versions, or UNKNOWN if one of the references names none."""
    found = [store.find_version(x) for x in (a, b)]
    return "UNKNOWN" if None in found else "SAME" if found[0]["version_id"] == found[1]["version_id"] else "DIFFERENT"


def canonical(plan: Plan, store: Store) -> Plan:
    """The plan with every known version reference by its id; unknown ones stay."""
    def known(x):
        found = store.find_version(x) if isinstance(x, (str, int)) and not isinstance(x, bool) else None
        return str(found["version_id"]) if found else x

    return Plan([Step(s.operator, {k: known(v) if k in ("version", "version_a", "version_b") else v for k, v in s.params.items()}) for s in plan.steps], plan.circuit)
