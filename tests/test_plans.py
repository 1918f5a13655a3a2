"""Plans over two lines of a small garden of versions with a branch, a merge and gaps, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import records, transitions
from quillon.plans import plan as plans
from quillon.plans import questions
from quillon.plans.plan import Plan, Store, execute, validate

VERSIONS = [
    # id, circuit, key, label, sequence, time, status, submission
    ("oak", "garden", "repo:0a1", "L1", 1, "2021-03-05", "verified", "s-oak"),
    ("elm", "garden", "repo:0b2", None, 2, "2021-11-20", "verified", None),
    ("ash", "garden", "repo:0c3", "L3", 3, "2022-02-01", "draft", "s-ash"),
    ("yew", "garden", "repo:0d4", None, None, None, "verified", None),
    ("fig", "garden", "repo:0e5", "L5", 5, "2022-02-17", "verified", "s-fig"),
    ("kelp", "pond", "repo:9z9", "P1", 1, "2020-01-01", "verified", None),
]
METRICS = [("oak", 640, 31, 2.5), ("elm", 512, None, None), ("ash", 704, 29, 0.0), ("yew", 512, 33, None), ("fig", None, 27, 4.25), ("kelp", 9, 9, 9.0)]
EDGES = [("oak", "elm", "historical_successor"), ("elm", "ash", "historical_successor"), ("ash", "fig", "historical_successor"), ("oak", "yew", "branched_from"), ("yew", "fig", "merged_into"), ("elm", "yew", "branched_from")]


def frames(spark, circuits=("garden",)):
    v = spark.createDataFrame([x for x in VERSIONS if x[1] in circuits], "version_id string, logical_circuit_id string, external_version_key string, version_label string, sequence_no int, historical_time string, record_status string, realized_from_submission_id string")
    m = spark.createDataFrame(METRICS, "version_id string, toffoli_count long, qubit_count long, score double")
    e = spark.createDataFrame(EDGES, "src string, dst string, relation string")
    sub = spark.createDataFrame([("s-oak", "hub:u1", "PROMOTED"), ("s-ash", "hub:u2", "SUBMITTED"), ("s-fig", "hub:u3", "PROMOTED"), ("s-lone", "hub:u4", "VALIDATED")], "submission_id string, external_submission_key string, status string")
    ev = spark.createDataFrame([("s-oak", "n1", "2022-01-01", "accepted", 30, 1.5), ("s-oak", "n2", "2022-03-01", "accepted", 31, 1.25), ("s-lone", "n2", "2022-03-01", "rejected", None, None)], "submission_id string, snapshot_id string, fetched_at string, platform_status string, official_peak_qubits int, official_score double")
    people = spark.createDataFrame([("p1", "Rowan", "acc:1", "rowan-old"), ("p2", "Hazel", "acc:2", None), ("p3", "rowan", "acc:3", None)], "contributor_identity_id string, current_handle string, source_identity_key string, alias string")
    given = [("s-oak", "p1", "SUBMITTER", None, "n1"), ("s-oak", "p2", "SUBMITTER", None, "n2"), ("s-oak", None, "COAUTHOR", "a friend", "n2"), ("s-lone", "p2", "SUBMITTER", None, "n2")]
    given = spark.createDataFrame([(*x, "2022-01-01" if x[4] == "n1" else "2022-03-01") for x in given], "submission_id string, contributor_identity_id string, role string, declared_reference string, snapshot_id string, fetched_at string")
    return Store(v, m, e, sub, ev, people, given)


@pytest.fixture(scope="module")
def store(spark):
    return frames(spark)


def run(store, *steps, **more):
    return execute({"steps": [{"operator": o, "params": p} for o, p in steps], **more}, store)


def rows(store, *steps, **more):
    result = run(store, *steps, **more)
    assert result.status == "ANSWERABLE", result
    return result.data.collect()


def status(store, *steps):
    return run(store, *steps).status


def test_versions_and_scope(spark, store):
    found = rows(store, ("list_versions", {}))
    assert {r.version_id for r in found} == {"oak", "elm", "ash", "yew", "fig"}
    assert found[0].asDict().keys() == {*records.VERSION_FIELDS, "toffoli_count", "qubit_count", "score"}
    assert [r.version_id for r in rows(store, ("list_versions", {"record_status": "draft"}))] == ["ash"]
    two = frames(spark, ("garden", "pond"))
    assert (status(two, ("list_versions", {})), run(two, ("list_versions", {})).available_fields) == ("AMBIGUOUS", ["garden", "pond"])
    assert [r.version_id for r in rows(two, ("list_versions", {}), logical_circuit_id="pond")] == ["kelp"]
    assert status(frames(spark, ()), ("list_versions", {})) == "MISSING_DATA"
    ordered = store.versions.orderBy(*records.version_order()).collect()
    assert [r.version_id for r in ordered] == ["oak", "elm", "ash", "fig", "yew"]


def test_transitions(store):
    every = rows(store, ("list_transitions", {}))
    assert {(r.parent_version_id, r.child_version_id, r.parent_label, r.child_external_key) for r in every} == {("oak", "elm", "L1", "repo:0b2"), ("elm", "ash", None, "repo:0c3"), ("ash", "fig", "L3", "repo:0e5")}
    assert len({r.edge_id for r in every}) == 3 and {r.relation_type for r in every} == {"historical_successor"}
    with_metric = {(r.parent_version_id, r.child_version_id): (r.absolute_change, round(r.percentage_change, 3)) for r in rows(store, ("list_transitions", {"metric": "toffoli_count"}))}
    assert with_metric == {("oak", "elm"): (-128, -20.0), ("elm", "ash"): (192, 37.5)}
    branched = rows(store, ("list_transitions", {"relation_type": "branched_from", "metric": "toffoli_count"}))
    assert {(r.parent_version_id, r.absolute_change) for r in branched} == {("oak", -128), ("elm", 0)}
    from_zero = rows(store, ("list_transitions", {"metric": "score"}))
    assert [(r.metric_before, r.percentage_change) for r in from_zero] == [(0.0, None)]
    assert status(store, ("list_transitions", {"metric": "depth"})) == "MISSING_DATA"


def test_rankings(store):
    first = rows(store, ("top_k_changes", {"metric": "toffoli_count", "k": 1}))
    assert [(r.parent_version_id, r.absolute_change) for r in first] == [("oak", -128)]
    up = rows(store, ("top_k_changes", {"metric": "toffoli_count", "direction": "increase", "relation_type": "branched_from"}))
    assert [(r.parent_version_id, r.absolute_change) for r in up] == [("elm", 0), ("oak", -128)]
    size = run(store, ("rank_transitions", {"metric": "toffoli_count", "order": "largest_absolute_change"}))
    assert [r.absolute_change for r in size.data.collect()] == [192, -128] and size.note().startswith("1 of 3")
    assert status(store, ("rank_transitions", {"metric": "toffoli_count", "relation_type": "merged_into"})) == "MISSING_DATA"
    assert status(store, ("rank_transitions", {"metric": "toffoli_count", "order": "largest"})) == "INVALID_PLAN"
    assert status(store, ("rank_transitions", {"metric": "toffoli_count", "limit": -1})) == "INVALID_PLAN"
    assert status(store, ("top_k_changes", {"metric": "toffoli_count", "direction": "sideways"})) == "INVALID_PLAN"


def test_filters_and_sort(store):
    few = {"metric": "toffoli_count", "operator": "<=", "value": 640}
    result = run(store, ("filter_versions", {"conditions": [few, {"metric": "qubit_count", "operator": ">", "value": 30}]}))
    assert {r.version_id for r in result.data.collect()} == {"oak", "yew"} and result.note() == "2 of 5 record(s) lack a metric that the plan needs and were left out"
    assert rows(store, ("list_versions", {}), ("filter", {"conditions": [{"metric": "depth", "operator": "<", "value": 3}]})) == []
    order = lambda **p: [r.version_id for r in rows(store, ("list_versions", {}), ("sort", p))]
    assert order(by="toffoli_count") == ["elm", "yew", "oak", "ash", "fig"]
    assert order(by="toffoli_count", order="desc") == ["ash", "oak", "elm", "yew", "fig"]
    assert order(by="toffoli_count", tie_breaker="external_version_key") == ["elm", "yew", "oak", "ash", "fig"]
    assert order(by="nothing") == ["ash", "elm", "fig", "oak", "yew"]
    assert status(store, ("list_versions", {}), ("sort", {"by": "score", "order": "down"})) == "INVALID_PLAN"
    assert [r.version_id for r in rows(store, ("list_versions", {}), ("sort", {"by": "score", "order": "desc"}), ("limit", {"k": 2}))] == ["fig", "oak"]


def test_types_are_never_coerced(store):
    bad = lambda metric, operator, value: status(store, ("list_versions", {}), ("filter", {"conditions": [{"metric": metric, "operator": operator, "value": value}]}))
    assert bad("version_label", "<", 3) == bad("toffoli_count", "<", "600") == bad("toffoli_count", ">=", float("inf")) == bad("x_delta", "<", "-10%") == "INVALID_PLAN"
    assert bad("toffoli_count", "~", 3) == "INVALID_PLAN" and bad("toffoli_count", "!=", "600") == "ANSWERABLE"
    assert status(store, ("list_versions", {}), ("limit", {"k": True})) == "INVALID_PLAN"


def test_deltas_and_groups(store):
    delta = rows(store, ("list_transitions", {}), ("compute_delta", {"metric": "qubit_count"}), ("compute_delta", {"metric": "toffoli_count"}))
    assert {(r.child_version_id, r.qubit_count_delta, r.toffoli_count_delta) for r in delta} == {("elm", None, -128), ("ash", None, 192), ("fig", -2, None)}
    assert status(store, ("list_versions", {}), ("compute_delta", {"metric": "score"})) == "INVALID_PLAN"
    years = rows(store, ("list_versions", {}), ("group_by", {"key": "historical_time:year", "metric": "toffoli_count", "agg": "sum"}))
    assert {(r.group, r["count"], r["sum"]) for r in years} == {("2021", 2, 1152), ("2022", 2, 704), (None, 1, 512)}
    counts = rows(store, ("list_versions", {}), ("group_by", {"key": "record_status"}))
    assert {(r.group, r["count"]) for r in counts} == {("verified", 4), ("draft", 1)}
    assert status(store, ("list_versions", {}), ("group_by", {"key": "record_status", "agg": "sum"})) == "INVALID_PLAN"
    assert status(store, ("list_versions", {}), ("group_by", {"key": "historical_time:day"})) == "INVALID_PLAN"


def test_traversal(store):
    walk = lambda **p: [(r.version_id, r.hops) for r in rows(store, ("traverse", p))]
    assert walk(version="L1") == [("elm", 1), ("yew", 1)]
    assert walk(version="oak", direction="descendants") == [("elm", 1), ("yew", 1), ("ash", 2), ("fig", 2)]
    assert walk(version="oak", direction="descendants", relation_type="historical_successor", max_hops=2) == [("elm", 1), ("ash", 2)]
    assert walk(version="repo:0d4", direction="predecessors") == [("elm", 1), ("oak", 1)]
    assert walk(version="fig", direction="ancestors", relation_type="merged_into") == [("yew", 1)]
    for bad in ({"max_hops": 0}, {"max_hops": True}, {"direction": "up"}):
        assert status(store, ("traverse", {"version": "oak", **bad})) == "INVALID_PLAN"
    assert status(store, ("traverse", {"version": "moss"})) == "MISSING_DATA"
    assert status(store, ("traverse", {"version": "oak"}), ("limit", {"k": 1})) == "INVALID_PLAN"


def test_single_metrics(store):
    r = rows(store, ("get_metric", {"version": "L5", "metric": "score"}))[0]
    assert (r.version_id, r.external_version_key, r.metric, r.value) == ("fig", "repo:0e5", "score", 4.25)
    gap = run(store, ("get_metric", {"version": "elm", "metric": "score"}))
    assert (gap.status, gap.missing_fields, gap.available_fields) == ("MISSING_DATA", ["score"], ["toffoli_count"])
    official = rows(store, ("get_metric", {"version": "oak", "metric": "evaluation.score"}))[0]
    assert (official.value, official.entity_scope, official.submission_uuid, official.evaluation_snapshot_id) == (1.25, "submission", "u1", "n2")
    assert rows(store, ("get_metric", {"version": "hub:u4", "metric": "platform.status"}))[0].value == "rejected"
    lacking = run(store, ("get_metric", {"version": "hub:u4", "metric": "evaluation.score"}))
    assert lacking.status == "MISSING_DATA" and "platform.status" in lacking.available_fields
    assert status(store, ("get_metric", {"version": "ash", "metric": "evaluation.score"})) == "MISSING_DATA"
    assert status(store, ("get_metric", {"version": "elm", "metric": "evaluation.score"})) == "MISSING_DATA"
    assert status(store, ("get_metric", {"version": "oak", "metric": "evaluation.colour"})) == "INVALID_PLAN"


def test_comparisons(store):
    compared = run(store, ("compare_versions", {"version_a": "oak", "version_b": "ash"}))
    assert {(r.name, r.before, r.after, r.absolute_change, r.percentage_change) for r in compared.data.collect()} == {("qubit_count", 31, 29, -2, -2 / 31 * 100), ("score", 2.5, 0, -2.5, -100), ("toffoli_count", 640, 704, 64, 10)}
    part = run(store, ("compare_versions", {"version_a": "L1", "version_b": "elm", "metrics": ["toffoli_count", "score"]}))
    assert (part.status, part.missing_fields, part.available_fields) == ("PARTIALLY_ANSWERABLE", ["score"], ["toffoli_count"])
    gaps = run(store, ("compare_versions", {"version_a": "L1", "version_b": "elm"}))
    assert gaps.status == "ANSWERABLE" and set(gaps.missing_fields) == {"score", "qubit_count"}
    mixed = run(store, ("compare_versions", {"version_a": "oak", "version_b": "hub:u4", "metrics": ["platform.status", "evaluation.score"]}))
    assert mixed.status == "PARTIALLY_ANSWERABLE" and mixed.missing_fields == ["evaluation.score"]
    assert [(r.before_text, r.after_text, r.absolute_change) for r in mixed.data.collect() if r.name == "platform.status"] == [("accepted", "rejected", None)]
    assert status(store, ("compare_versions", {"version_a": "oak", "version_b": "moss"})) == "MISSING_DATA"
    assert status(store, ("compare_versions", {"a": "oak", "b": "ash"})) == "INVALID_PLAN"


def test_submissions_and_contributors(store):
    found = rows(store, ("list_submissions", {}))
    assert [(r.submission_uuid, r.version_id, r.has_official_evaluation, r["evaluation.score"], r["contributor.submitter"]) for r in found] == [("u1", "oak", True, 1.25, "Hazel"), ("u2", "ash", False, None, None), ("u3", "fig", False, None, None), ("u4", None, True, None, "Hazel")]
    assert found[0]["contributor.declared_coauthors"] == ["a friend"]
    assert [r.submission_uuid for r in rows(store, ("list_submissions", {"lifecycle_status": "PROMOTED"}))] == ["u1", "u3"]
    assert [r.submission_uuid for r in rows(store, ("list_submissions", {"platform_status": "rejected"}))] == ["u4"]
    assert [r.submission_uuid for r in rows(store, ("list_submissions", {"contributor": "@HAZEL"}), ("filter", {"conditions": [{"metric": "evaluation.score", "operator": "<", "value": 2}]}))] == ["u1"]
    assert status(store, ("list_submissions", {"contributor": "moss"})) == "UNKNOWN_ENTITY"
    assert status(store, ("list_submissions", {"contributor": "ROWAN"})) == "AMBIGUOUS"
    people = {r.contributor_identity_id: (r.submission_count, r.submissions_with_circuit_version, r.submissions_with_official_evaluation) for r in rows(store, ("list_contributors", {}))}
    assert people == {"p1": (0, 0, 0), "p2": (2, 1, 1), "p3": (0, 0, 0)}
    assert [(r.contributor_identity_id, r.current_handle) for r in rows(store, ("list_contributors", {"contributor": "rowan-old"}))] == [("p1", "Rowan")]
    paths = {r.attribution_path for r in rows(store, ("list_contributors", {"version": "oak"}))}
    assert paths == {"repo:0a1 -> u1 -> SUBMITTER -> Hazel", "repo:0a1 -> u1 -> COAUTHOR -> a friend"}
    assert status(store, ("list_contributors", {"version": "ash"})) == status(store, ("list_contributors", {"version": "elm"})) == "MISSING_DATA"
    assert status(store, ("list_contributors", {"version": "oak", "contributor": "Hazel"})) == "INVALID_PLAN"


def test_descriptions(store):
    about = lambda *steps: [json.loads(r.document) for r in rows(store, *steps)]
    yew = about(("describe_entity", {"version": "yew"}))[0]
    assert yew["metrics"] == [{"name": "qubit_count", "value": 33}, {"name": "toffoli_count", "value": 512}]
    assert yew["relationships"] == {"branched_from": {"predecessors": {"count": 2, "preview": ["repo:0a1", "repo:0b2"]}, "successors": {"count": 0, "preview": []}}, "merged_into": {"predecessors": {"count": 0, "preview": []}, "successors": {"count": 1, "preview": ["repo:0e5"]}}}
    assert yew["availability"]["submission"] == "unavailable"
    oak = about(("describe_entity", {"submission": "hub:u1"}))[0]
    assert oak["entity_type"] == "circuit_version" and oak["evaluation"]["evaluation.score"] == 1.25 and len(oak["contributors"]) == 2
    lone = about(("describe_entity", {"submission": "hub:u4"}))[0]
    assert (lone["entity_type"], lone["availability"]["metrics"]) == ("submission", "not_applicable")
    assert about(("describe_entity", {"contributor": "Hazel"}))[0]["submission_count"] == 2
    assert len(about(("list_versions", {}), ("limit", {"k": 3}), ("describe_entity", {}))) == 3
    assert status(store, ("describe_entity", {"version": "oak", "submission": "hub:u1"})) == status(store, ("describe_entity", {})) == "INVALID_PLAN"
    assert status(store, ("describe_entity", {"submission": "hub:u9"})) == "MISSING_DATA"


def test_shapes_of_plans(store):
    assert execute({"operation": "get_metric", "version": "oak", "metric": "score"}, store).data.first().value == 2.5
    assert validate(Plan.parse({"operator": "nothing"}))[0][0] == "UNSUPPORTED_OPERATION"
    assert validate(Plan.parse({"operator": "limit", "k": 1}))[0][0] == "INVALID_PLAN"
    assert validate(Plan.parse({"operation": "get_metric", "version": "oak", "metric": "depth"}), ["score"])[0][0] == "MISSING_DATA"
    assert validate(Plan.parse({"operation": "list_transitions", "relation_type": "cousin"}), None, ["branched_from"])[0][0] == "MISSING_DATA"
    assert execute("not json", store).status == execute({"steps": []}, store).status == execute({}, store).status == "INVALID_PLAN"
    a = Plan.parse({"steps": [{"operator": "filter_versions", "conditions": [{"metric": "a", "operator": "<", "value": 1}, {"metric": "b", "operator": "<", "value": 1}]}]})
    b = Plan.parse({"operation": "filter_versions", "conditions": [{"metric": "b", "operator": "<", "value": 1}, {"metric": "a", "operator": "<", "value": 1}]})
    assert a.normal_form() == b.normal_form()
    assert Plan.parse({"operation": "top_k_changes", "metric": "x"}).normal_form() == Plan.parse({"operation": "top_k_changes", "metric": "x", "k": 5}).normal_form()
    assert (plans.same_entity(store, "oak", "L1"), plans.same_entity(store, "oak", "elm"), plans.same_entity(store, "oak", "moss")) == ("SAME", "DIFFERENT", "UNKNOWN")
    assert plans.canonical(Plan.parse({"operation": "compare_versions", "version_a": "L1", "version_b": "moss"}), store).steps[0].params == {"version_a": "oak", "version_b": "moss"}


def test_bound_parameters(store):
    worst = {"bind": {"operation": "rank_transitions", "metric": "toffoli_count", "order": "largest_increase", "limit": 1}, "field": "child_version_id"}
    assert [r.version_id for r in rows(store, ("traverse", {"version": worst, "relation_type": "historical_successor"}))] == ["fig"]
    assert status(store, ("traverse", {"version": worst | {"field": "colour"}})) == "INVALID_PLAN"
    assert status(store, ("traverse", {"version": {"bind": {"operation": "list_versions", "record_status": "lost"}, "field": "version_id"}})) == "MISSING_DATA"


def test_questions(store):
    plan = questions.read("largest toffoli decrease").plan
    assert execute(plan, store).data.first().absolute_change == -128
    assert questions.read("which is best?").clarify and questions.read("toffoli or qubit decrease?").clarify
    plan = questions.read("versions with toffoli below 600 and qubit count above 32").plan
    assert [r.version_id for r in execute(plan, store).data.collect()] == ["yew"]
    assert execute(questions.read("compare oak with ash?").plan, store).data.count() == 3
    plan = questions.read("toffoli drop of at least 10 percent by 15 %").plan
    assert plan and questions.month_range("on March 31, 2024") == ("2024-03-31", "2024-04-01")
    assert questions.month_range("in December 2023") == ("2023-12-01", "2024-01-01") and questions.month_range("March") is None


def test_guard():
    plan = lambda **p: Plan.parse(p)
    wrong = plan(operator="rank_transitions", metric="qubit_count", order="largest_increase")
    fixed = questions.guard("largest toffoli drop", wrong)
    assert fixed.repaired and fixed.plan.steps[0].params == {"metric": "toffoli_count", "order": "largest_decrease"}
    assert questions.guard("submissions", plan(operator="list_submissions", contributor="Hazel")).reject
    assert questions.guard("submissions of Hazel", plan(operator="list_submissions", contributor="@hazel")).plan
    assert questions.guard("submissions", plan(operator="list_submissions", platform_status="rejected")).reject
    assert questions.guard("toffoli changes of branches", plan(operator="list_transitions", metric="toffoli_count")).plan.steps[0].params["relation_type"] == "branched_from"
    assert questions.guard("toffoli changes", plan(operator="list_transitions", metric="toffoli_count", relation_type="branched_from")).repaired
    assert questions.guard("versions on March 3", plan(operator="list_versions")).clarify == "of which year?"


def test_rendering(store):
    text = questions.render(run(store, ("rank_transitions", {"metric": "toffoli_count"})), 1).splitlines()
    assert text[0].startswith("edge_id") and "absolute_change -128" in text[0] and text[1:] == ["and more", "1 of 3 record(s) lack a metric that the plan needs and were left out"]
    assert questions.render(run(store, ("get_metric", {"version": "elm", "metric": "score"}))) == "Missing data: elm has no score. Known: toffoli_count."
    assert questions.render(run(store, ("list_versions", {"record_status": "lost"}))) == "no rows"


def test_improvements(store):
    both = transitions.improvements(run(store, ("list_transitions", {"metric": "toffoli_count"})).data, {"toffoli_count": "lower"})
    assert {(r.child_version_id, r.improved) for r in both.collect()} == {("elm", True), ("ash", False)}
    unknown = transitions.improvements(run(store, ("list_transitions", {"metric": "score"})).data, {})
    assert [r.improved for r in unknown.collect()] == [None]


def test_sanity(spark, store):
    plan = Plan.parse({"steps": [{"operator": "list_versions"}, {"operator": "filter", "conditions": [{"metric": "toffoli_count", "operator": "<", "value": 700}]}, {"operator": "sort", "by": "toffoli_count"}, {"operator": "limit", "k": 3}]})
    good = execute(plan, store).data
    assert questions.sanity(plan, good) == []
    bad = store.records().orderBy(F.desc("toffoli_count"))
    assert len(questions.sanity(plan, bad)) == 3
    rank = Plan.parse({"operation": "rank_transitions", "metric": "toffoli_count"})
    assert questions.sanity(rank, execute(rank, store).data) == []
    assert questions.sanity(rank, execute(Plan.parse({"operation": "rank_transitions", "metric": "toffoli_count", "order": "largest_increase"}), store).data)
