"""The operators bound to the test tables, each with the SQL that says the same.

Binding: orders are versions of one circuit; lineitem gives an order's metrics; edges join consecutive finished orders
of a customer (historical_successor) and open orders to the finished one before them (branched_from); the events of a
user and type are the evaluations of a submission, which the order of the user's number realises if they are clicks;
events are also operations of a stream; documents carry fingerprints and labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import canonical, scalars, sketch
from quillon.operators import asof, graph, history, latest, pareto, quality, records, resolve, sequences, stats, transitions
from quillon.plans import questions
from quillon.plans.plan import Plan, Store, execute
from quillon.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def versions(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("circuit_id"), F.lit("orders").alias("logical_circuit_id"), F.col("o_orderkey").cast("string").alias("external_version_key"), F.col("o_orderstatus").alias("record_status"), F.col("o_orderdate").alias("historical_time"), F.concat("o_orderkey", F.lit("-click")).alias("realized_from_submission_id"))


def metrics(s, d):
    # an order has a few lines: one exchange by order, then both groupings are local
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_partkey", "l_quantity").repartition("version_id")
    parts = lines.groupBy("version_id", "l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    rows = parts.groupBy("version_id").agg(F.sum("n").alias("operation_count"), F.count("l_partkey").alias("qubit_count"), F.sum("quantity").cast("long").alias("toffoli_count"))
    return rows.withColumn("score", F.col("qubit_count") * F.col("toffoli_count"))


def next_edges(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'")
    return sequences.chain(done, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("src", "dst", F.lit("historical_successor").alias("relation"))


def branch_edges(s, d):
    orders = table(s, d, "orders")
    done = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("parent"))
    done = latest.latest_row(done, ["o_custkey", "o_orderdate"], ["parent"])
    found = asof.asof_join(orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderdate", "o_orderkey"), done, ["o_custkey"], ["o_orderdate"], ["parent"])
    return found.where("asof_parent is not null").select(F.col("asof_parent").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("branched_from").alias("relation"))


def edges(s, d):
    return next_edges(s, d).unionByName(branch_edges(s, d))


def trade_edges(s, d):
    """Nation to nation, from suppliers to customers: dense and cyclic, two relations."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    rows = lines.join(o, "l_orderkey").join(c, "o_custkey").join(p, "l_suppkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other")
    return rows.groupBy("src", "dst", kind.alias("relation")).agg(F.count("*").alias("weight"))


def operations(s, d):
    """Events of a user in order: the type is the name, the property k and the hour are operands."""
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.row_number().over(sequences.W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("circuit"), at.cast("long").alias("idx"), F.col("event_type").alias("name"), F.array(F.coalesce(k, F.lit(0)) % 16, 16 + F.hour("ts") % 8).alias("qubits"), F.array().cast("array<int>").alias("classical_bits"), F.array().cast("array<string>").alias("parameters"))


def store(s, d):
    e = table(s, d, "events")
    name, at = F.concat_ws("-", "user_id", "event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    sub = e.select(name.alias("submission_id"), F.concat(F.lit("hub:"), name).alias("external_submission_key"), F.col("event_type").alias("status")).distinct()
    ev = e.select(name.alias("submission_id"), F.when(F.col("value") > 50, "scored").otherwise("open").alias("platform_status"), F.col("value").alias("official_score"), at.alias("platform_created_at"), at.alias("fetched_at"), F.col("event_id").alias("snapshot_id"))
    who = F.col("user_id").cast("string")
    people = e.select(who.alias("contributor_identity_id"), F.concat(F.lit("user"), who).alias("current_handle"), F.concat(F.lit("acc:"), who).alias("source_identity_key")).distinct()
    role = F.when(F.col("event_type") == "view", "COAUTHOR").otherwise("SUBMITTER")
    given = e.select(name.alias("submission_id"), who.alias("contributor_identity_id"), role.alias("role"), at.alias("fetched_at"), F.col("event_id").alias("snapshot_id"))
    return Store(versions(s, d), metrics(s, d), edges(s, d).select("src", "dst", "relation"), sub, ev, people, given)


def planned(s, d, *steps) -> DataFrame:
    result = execute({"steps": [{"operator": o, **p} for o, p in steps]}, store(s, d))
    if result.data is None:
        raise ValueError(f"{result.status}: {result.message}")
    return result.data


V = "versions AS (SELECT o_orderkey AS version_id, o_custkey AS circuit_id, 'orders' AS logical_circuit_id, o_orderstatus AS record_status, o_orderdate AS historical_time FROM orders)"
M = "metrics AS (SELECT l_orderkey AS version_id, count(*) AS operation_count, count(DISTINCT l_partkey) AS qubit_count, CAST(sum(l_quantity) AS BIGINT) AS toffoli_count, count(DISTINCT l_partkey) * CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1)"
NEXT = "nexts AS (SELECT src, dst, 'historical_successor' AS relation FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders WHERE o_orderstatus = 'F') x WHERE dst IS NOT NULL)"
BRANCH = "branches AS (SELECT max_by(f.o_orderkey, (f.o_orderdate, f.o_orderkey)) AS src, o.o_orderkey AS dst, 'branched_from' AS relation FROM orders o JOIN orders f ON f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND f.o_orderdate <= o.o_orderdate WHERE o.o_orderstatus <> 'F' GROUP BY o.o_orderkey)"
EDGES = f"{NEXT}, {BRANCH}, edges AS (SELECT * FROM nexts UNION ALL SELECT * FROM branches)"
TRADE = "trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS relation, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"
TRANS = f"{V}, {M}, {EDGES}, trans AS (SELECT e.src, e.dst, relation, a.toffoli_count AS metric_before, b.toffoli_count AS metric_after, b.toffoli_count - a.toffoli_count AS absolute_change, CASE WHEN a.toffoli_count <> 0 THEN (b.toffoli_count - a.toffoli_count) / CAST(a.toffoli_count AS DOUBLE) * 100 END AS percentage_change FROM edges e JOIN metrics a ON a.version_id = e.src JOIN metrics b ON b.version_id = e.dst)"
OPS = "ops AS (SELECT user_id AS circuit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS name, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) % 16 AS q1, 16 + hour(ts) % 8 AS q2 FROM events)"
SHINGLES = f"{OPS}, tokens AS (SELECT circuit, idx, name, '[\"' || name || '\",[' || q1 || ',' || q2 || '],[],[]]' AS t FROM ops), lagged AS (SELECT circuit, idx, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM tokens WINDOW w AS (PARTITION BY circuit ORDER BY idx)), hashes AS (SELECT circuit, substr(sha256('[' || t || ',' || t1 || ',' || t2 || ']'), 1, 16) AS hash FROM lagged WHERE t2 IS NOT NULL)"


SUCCESSORS = f"{TRANS}, steps AS (SELECT src AS parent_version_id, dst AS child_version_id, relation AS relation_type, metric_before, metric_after, absolute_change, percentage_change FROM trans WHERE relation = 'historical_successor')"


@query(f"WITH {SUCCESSORS} SELECT parent_version_id, child_version_id, relation_type, metric_before, metric_after, absolute_change, round(percentage_change, 4) AS percentage_change FROM steps WHERE percentage_change <= -10")
def transitions_top_decrease(s, d):
    rows = planned(s, d, ("list_transitions", {"metric": "toffoli_count"}), ("filter", {"conditions": [{"metric": "percentage_change", "operator": "<=", "value": -10.0}]}), ("sort", {"by": "percentage_change", "tie_breaker": "parent_version_id"}))
    return rows.select("parent_version_id", "child_version_id", "relation_type", "metric_before", "metric_after", "absolute_change", F.round("percentage_change", 4).alias("percentage_change"))


@query(f"WITH {EDGES} SELECT src AS parent_version_id, dst AS child_version_id, CAST(src AS VARCHAR) AS parent_external_key, strftime(b.o_orderdate, '%Y-%m-%d') AS child_day FROM branches JOIN orders b ON b.o_orderkey = dst")
def list_transitions(s, d):
    return planned(s, d, ("list_transitions", {"relation_type": "branched_from"})).select("parent_version_id", "child_version_id", "parent_external_key", F.date_format("child_historical_time", "yyyy-MM-dd").alias("child_day"))


@query(f"WITH {V}, {M} SELECT v.version_id, logical_circuit_id, CAST(v.version_id AS VARCHAR) AS external_version_key, record_status, strftime(historical_time, '%Y-%m-%d') AS day, operation_count, qubit_count, toffoli_count, score FROM versions v LEFT JOIN metrics m ON m.version_id = v.version_id WHERE record_status = 'F'")
def list_versions(s, d):
    return planned(s, d, ("list_versions", {"record_status": "F"})).select("version_id", "logical_circuit_id", "external_version_key", "record_status", F.date_format("historical_time", "yyyy-MM-dd").alias("day"), "operation_count", "qubit_count", "toffoli_count", "score")


@query(f"WITH {V}, {M} SELECT v.version_id, score FROM versions v JOIN metrics m ON m.version_id = v.version_id WHERE toffoli_count > 0 ORDER BY score, CAST(v.version_id AS VARCHAR) LIMIT 10")
def lowest_versions(s, d):
    return planned(s, d, ("list_versions", {}), ("filter", {"conditions": [{"metric": "toffoli_count", "operator": ">", "value": 0}]}), ("sort", {"by": "score"}), ("limit", {"k": 10})).select("version_id", "score")


@query(f"WITH {V}, {M} SELECT v.version_id, qubit_count, toffoli_count FROM versions v JOIN metrics m ON m.version_id = v.version_id WHERE qubit_count < 4 AND toffoli_count >= 60")
def filter_versions(s, d):
    return planned(s, d, ("filter_versions", {"conditions": [{"metric": "qubit_count", "operator": "<", "value": 4}, {"metric": "toffoli_count", "operator": ">=", "value": 60}]})).select("version_id", "qubit_count", "toffoli_count")


@query(f"WITH {V}, {M} SELECT count(*) FILTER (WHERE qubit_count IS NULL) AS missing, count(*) AS total FROM versions v LEFT JOIN metrics m ON m.version_id = v.version_id")
def filter_versions_missing(s, d):
    return execute({"operation": "filter_versions", "conditions": [{"metric": "qubit_count", "operator": "<", "value": 4}]}, store(s, d)).left_out


@query(f"WITH {V}, {M}, {NEXT} SELECT e.src AS parent_version_id, e.dst AS child_version_id, b.toffoli_count - a.toffoli_count AS toffoli_count_delta, b.qubit_count - a.qubit_count AS qubit_count_delta, round(CASE WHEN a.qubit_count <> 0 THEN (b.qubit_count - a.qubit_count) / CAST(a.qubit_count AS DOUBLE) * 100 END, 4) AS qubit_count_pct FROM nexts e LEFT JOIN metrics a ON a.version_id = e.src LEFT JOIN metrics b ON b.version_id = e.dst")
def compute_delta_two_metrics(s, d):
    rows = planned(s, d, ("list_transitions", {}), ("compute_delta", {"metric": "toffoli_count"}), ("compute_delta", {"metric": "qubit_count"}))
    return rows.select("parent_version_id", "child_version_id", "toffoli_count_delta", "qubit_count_delta", F.round("qubit_count_pct_change", 4).alias("qubit_count_pct"))


@query(f"WITH {V}, {M} SELECT strftime(historical_time, '%Y') AS \"group\", count(*) AS \"count\", round(avg(score), 4) AS mean FROM versions v LEFT JOIN metrics m ON m.version_id = v.version_id GROUP BY 1")
def group_by_year(s, d):
    return planned(s, d, ("list_versions", {}), ("group_by", {"key": "historical_time:year", "agg": "mean", "metric": "score"})).select("group", "count", F.round("mean", 4).alias("mean"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS \"group\", count(*) AS \"count\" FROM orders GROUP BY 1")
def group_by_month_count(s, d):
    return planned(s, d, ("list_versions", {}), ("group_by", {"key": "historical_time:year_month"}))


@query(f"WITH {M}, a AS (SELECT * FROM metrics WHERE version_id = 1), b AS (SELECT * FROM metrics WHERE version_id = 2), la AS (UNPIVOT a ON operation_count, qubit_count, toffoli_count, score INTO NAME name VALUE v), lb AS (UNPIVOT b ON operation_count, qubit_count, toffoli_count, score INTO NAME name VALUE v) SELECT coalesce(la.name, lb.name) AS name, CAST(la.v AS DOUBLE) AS before, CAST(lb.v AS DOUBLE) AS after, CAST(lb.v - la.v AS DOUBLE) AS absolute_change FROM la FULL JOIN lb ON la.name = lb.name")
def compare_versions(s, d):
    return planned(s, d, ("compare_versions", {"version_a": "1", "version_b": "2"})).select("name", "before", "after", "absolute_change")


@query(f"WITH {M} SELECT version_id, CAST(version_id AS VARCHAR) AS external_version_key, 'score' AS metric, CAST(score AS DOUBLE) AS value FROM metrics WHERE version_id = 2")
def get_metric(s, d):
    return planned(s, d, ("get_metric", {"version": "2", "metric": "score"})).select("version_id", "external_version_key", "metric", "value")


@query("SELECT '3-click' AS submission_uuid, 3 AS version_id, 'submission' AS entity_scope, 'evaluation.score' AS metric, max_by(value, (ts, event_id)) AS value FROM events WHERE user_id = 3 AND event_type = 'click'")
def get_submission_metric(s, d):
    return planned(s, d, ("get_metric", {"version": "3", "metric": "evaluation.score"})).select("submission_uuid", F.col("version_id").cast("int").alias("version_id"), "entity_scope", "metric", "value")


@query(f"WITH {SUCCESSORS} SELECT parent_version_id, child_version_id, absolute_change FROM steps ORDER BY absolute_change, CAST(parent_version_id AS VARCHAR), CAST(child_version_id AS VARCHAR) LIMIT 10")
def rank_transitions(s, d):
    return planned(s, d, ("rank_transitions", {"metric": "toffoli_count"})).select("parent_version_id", "child_version_id", "absolute_change")


@query(f"WITH {TRANS} SELECT src AS parent_version_id, dst AS child_version_id, absolute_change FROM trans WHERE relation = 'branched_from' ORDER BY -absolute_change, CAST(src AS VARCHAR), CAST(dst AS VARCHAR) LIMIT 5")
def top_k_changes(s, d):
    return planned(s, d, ("top_k_changes", {"metric": "toffoli_count", "direction": "increase", "relation_type": "branched_from"})).select("parent_version_id", "child_version_id", "absolute_change")


@query(f"WITH {SUCCESSORS} SELECT parent_version_id, child_version_id, absolute_change < 0 AS improved FROM steps")
def improvements(s, d):
    rows = planned(s, d, ("list_transitions", {"metric": "toffoli_count"}))
    return transitions.improvements(rows, {"toffoli_count": "lower"}).select("parent_version_id", "child_version_id", "improved")


@query(f"WITH {M} SELECT 'score is the product' AS \"check\", count(*) FILTER (WHERE score <> qubit_count * toffoli_count) AS violations FROM metrics")
def score_products(s, d):
    return quality.violations(metrics(s, d), [("score is the product", ~quality.score_mismatch(F.col("score"), F.col("qubit_count"), F.col("toffoli_count")))])


@query(ORACLE_SQL["rank_transitions"])
def asked_question(s, d):
    """A question, read, guarded and run."""
    question = "What are the 10 largest toffoli decreases?"
    return execute(questions.guard(question, questions.read(question).plan).plan, store(s, d)).data.select("parent_version_id", "child_version_id", "absolute_change")


@query("WITH last AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT user_id || '-' || event_type AS submission_uuid, event_type AS lifecycle_status, o_orderkey AS version_id, true AS has_official_evaluation, CASE WHEN v > 50 THEN 'scored' ELSE 'open' END AS status, v AS score, CASE WHEN event_type <> 'view' THEN 'user' || user_id END AS submitter FROM last LEFT JOIN orders ON event_type = 'click' AND o_orderkey = user_id")
def list_submissions(s, d):
    field = records.field
    return planned(s, d, ("list_submissions", {})).select("submission_uuid", "lifecycle_status", "version_id", "has_official_evaluation", field("platform.status").alias("status"), field("evaluation.score").alias("score"), field("contributor.submitter").alias("submitter"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT CAST(user_id AS VARCHAR) AS contributor_identity_id, 'user' || user_id AS current_handle, count(*) FILTER (WHERE event_type <> 'view') AS submission_count, count(*) FILTER (WHERE event_type = 'view') AS coauthor_count, count(*) FILTER (WHERE event_type = 'click' AND user_id IN (SELECT o_orderkey FROM orders)) AS submissions_with_circuit_version FROM s GROUP BY user_id")
def list_contributors(s, d):
    return planned(s, d, ("list_contributors", {})).select("contributor_identity_id", "current_handle", "submission_count", "coauthor_count", "submissions_with_circuit_version")


@query(f"WITH {EDGES} SELECT 'circuit_version' AS entity_type, '5' AS version_id, (SELECT count(*) FROM branches WHERE dst = 5) AS parents, (SELECT count(*) FROM branches WHERE src = 5) AS branches, max_by(value, (ts, event_id)) AS score FROM events WHERE user_id = 5 AND event_type = 'click'")
def describe_entity(s, d):
    document = lambda path: F.get_json_object("document", path)
    count = lambda way: F.coalesce(document(f"$.relationships.branched_from.{way}.count").cast("long"), F.lit(0).cast("long"))
    return planned(s, d, ("describe_entity", {"version": "5"})).select(document("$.entity_type").alias("entity_type"), document("$.identity.version_id").alias("version_id"), count("predecessors").alias("parents"), count("successors").alias("branches"), document("$.evaluation['evaluation.score']").cast("double").alias("score"))


@query("SELECT event_id, user_id, event_type, value FROM events e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_evaluation(s, d):
    return latest.latest_row(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def latest_set(s, d):
    return latest.latest_set(table(s, d, "orders"), ["o_custkey"], ["o_orderdate"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH t AS (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = '12' THEN 1 WHEN lower(p_name) = '12' THEN 2 WHEN lower(p_brand) = '12' THEN 3 END AS tier FROM part), u AS (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = 'part 12' THEN 1 WHEN lower(p_name) = 'part 12' THEN 2 WHEN lower(p_brand) = 'part 12' THEN 3 WHEN contains(lower(p_name), 'part 12') THEN 4 END AS tier FROM part) SELECT p_partkey, tier, (SELECT count(*) > 20 FROM u WHERE tier IS NOT NULL) AS truncated FROM u WHERE tier IS NOT NULL ORDER BY tier, p_name, p_partkey LIMIT 20")
def search_tiers(s, d):
    return resolve.search(table(s, d, "part"), "part 12", "p_partkey", "p_name", "p_brand", 20).select("p_partkey", "tier", "truncated")


@query("""WITH refs AS (SELECT DISTINCT substr(c_name, 1, 17) AS ref FROM customer UNION SELECT n_name FROM nation), names AS (SELECT 'customer' AS space, c_name AS name, c_name AS entity FROM customer UNION ALL SELECT 'nation', n_name, n_name FROM nation), hits AS (SELECT ref, entity, space, CASE WHEN name = ref THEN 1 ELSE 2 END AS tier FROM refs JOIN names ON starts_with(name, ref) AND (name = ref OR length(ref) >= 4)), best AS (SELECT ref, min(tier) AS tier FROM hits GROUP BY 1)
SELECT r.ref, CASE WHEN count(DISTINCT entity) = 1 THEN 'RESOLVED' WHEN count(DISTINCT entity) > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS status, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) END AS entity, coalesce(min(b.tier), 0) AS tier FROM refs r LEFT JOIN best b ON b.ref = r.ref LEFT JOIN hits h ON h.ref = r.ref AND h.tier = b.tier GROUP BY r.ref""")
def resolver_namespaces(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    refs = c.select(F.substring("c_name", 1, 17).alias("ref")).union(n.select("n_name")).distinct()
    return resolve.namespaces(refs, {"customer": c.select(F.col("c_name").alias("name"), F.col("c_name").alias("entity")), "nation": n.select(F.col("n_name").alias("name"), F.col("n_name").alias("entity"))}).select("ref", "status", "entity", "tier")


def _start(s, d):
    """The first finished order of the customer with most finished orders."""
    done = table(s, d, "orders").where("o_orderstatus = 'F'")
    who = done.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").first()[0]
    rows = done.where(F.col("o_custkey") == who)
    return rows.orderBy("o_orderdate", "o_orderkey").first()["o_orderkey"], rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).first()["o_orderkey"]


WHO = "who AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), ends AS (SELECT min_by(o_orderkey, (o_orderdate, o_orderkey)) AS a, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS b FROM orders WHERE o_orderstatus = 'F' AND o_custkey = (SELECT o_custkey FROM who))"


@query(f"WITH RECURSIVE {EDGES}, {WHO}, walk AS (SELECT a AS node, 0 AS hops FROM ends UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.hops < 3) SELECT node, min(hops) AS hops FROM walk WHERE hops > 0 GROUP BY 1")
def traverse_descendants(s, d):
    return planned(s, d, ("traverse", {"version": str(_start(s, d)[0]), "direction": "descendants", "max_hops": 3})).select(F.col("version_id").alias("node"), "hops")


@query(f"WITH RECURSIVE {EDGES}, {WHO}, walk AS (SELECT b AS node, 0 AS hops FROM ends UNION SELECT e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node) SELECT node, min(hops) AS hops FROM walk WHERE hops > 0 GROUP BY 1")
def traverse_ancestors(s, d):
    return planned(s, d, ("traverse", {"version": str(_start(s, d)[1]), "direction": "ancestors"})).select(F.col("version_id").alias("node"), "hops")


@query(f"WITH {TRADE}, one AS (SELECT DISTINCT src, dst FROM trade WHERE relation = 'urgent'), a AS (SELECT 1 AS node, 0 AS h UNION ALL SELECT src, 1 FROM one WHERE dst = 1 AND src <> 1), b AS (SELECT 2 AS node, 0 AS h UNION ALL SELECT src, 1 FROM one WHERE dst = 2 AND src <> 2), x AS (SELECT a.node, a.h AS hops_a, b.h AS hops_b, a.h + b.h AS hops FROM a JOIN b ON a.node = b.node) SELECT node, hops_a, hops_b, hops FROM x WHERE hops = (SELECT min(hops) FROM x)")
def common_ancestors(s, d):
    return graph.common_ancestors(trade_edges(s, d), 1, 2, ["urgent"])


@query(f"WITH RECURSIVE {NEXT}, {WHO}, walk AS (SELECT a AS node, 0 AS hops FROM ends UNION ALL SELECT e.dst, w.hops + 1 FROM walk w JOIN nexts e ON e.src = w.node) SELECT node, hops FROM walk")
def chain_walk(s, d):
    return graph.distances(next_edges(s, d), s.range(1).select(F.lit(_start(s, d)[0]).alias("node")), "out")


@query(f"WITH {BRANCH} SELECT src, dst, relation FROM branches")
def asof_parent(s, d):
    return branch_edges(s, d)


RUN = "w AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)"


@query(f"WITH {RUN}, i AS (SELECT *, sum(CASE WHEN coalesce(o_totalprice < previous, false) THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY pos) AS island FROM w), r AS (SELECT o_custkey, island, count(*) AS length, min(pos) AS start FROM i WHERE o_totalprice < previous GROUP BY 1, 2) SELECT o_custkey, length, start FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY length DESC, start) = 1")
def longest_decreasing_run(s, d):
    rows = sequences.steps(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return sequences.longest_run(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("delta") < 0)


@query(f"WITH {RUN}, i AS (SELECT *, abs(o_totalprice - previous) <= 50000 AS flat FROM w), j AS (SELECT *, sum(CASE WHEN coalesce(flat, false) THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY pos) AS island FROM i), r AS (SELECT o_custkey, island, count(*) AS length, min(pos) AS start FROM j WHERE flat GROUP BY 1, 2) SELECT o_custkey, length, start FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY length DESC, start) = 1")
def flat_runs(s, d):
    rows = sequences.steps(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return sequences.longest_run(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.abs("delta") <= 50000)


@query(f"WITH {RUN} SELECT a.o_custkey, a.o_orderkey, (SELECT min(b.pos) FROM w b WHERE b.o_custkey = a.o_custkey AND b.pos > a.pos AND b.o_totalprice < a.previous) - a.pos AS distance FROM w a WHERE a.o_totalprice > a.previous")
def recovery_distance(s, d):
    return sequences.recovery(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, first_value, last_value, round(last_value - first_value, 2) AS change FROM (SELECT o_custkey, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS first_value, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last_value FROM orders GROUP BY 1) x")
def cumulative_change(s, d):
    return sequences.cumulative_change(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "first_value", "last_value", F.round("change", 2).alias("change"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders QUALIFY position BETWEEN 2 AND 4")
def window_slice(s, d):
    return sequences.window_slice(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 4).select("o_custkey", "o_orderkey", "position")


@query("SELECT p_partkey, p_size, p_retailprice FROM part b WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_size <= b.p_size AND a.p_retailprice <= b.p_retailprice AND (a.p_size < b.p_size OR a.p_retailprice < b.p_retailprice))")
def pareto_2d(s, d):
    return pareto.front_2d(table(s, d, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("WITH last AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v, max(ts) AS last_ts FROM events GROUP BY 1, 2) SELECT user_id || '-' || event_type AS submission_uuid, v AS score FROM last WHERE v < 10 ORDER BY last_ts, submission_uuid LIMIT 3")
def earliest_below_bound(s, d):
    """The first submissions whose official score is below a bound."""
    rows = planned(s, d, ("list_submissions", {}), ("filter", {"conditions": [{"metric": "evaluation.score", "operator": "<", "value": 10}]}), ("sort", {"by": "platform.created_at", "tie_breaker": "submission_uuid"}), ("limit", {"k": 3}))
    return rows.select("submission_uuid", records.field("evaluation.score").alias("score"))


@query(f"WITH {TRANS} SELECT src AS parent_version_id, dst AS child_version_id, absolute_change FROM trans JOIN orders ON o_orderkey = dst WHERE relation = 'branched_from' AND o_orderstatus = 'P' AND absolute_change < 0")
def unfinished_cheaper(s, d):
    """Children of one status that cost less than what they branched from."""
    rows = planned(s, d, ("list_transitions", {"relation_type": "branched_from", "metric": "toffoli_count"}), ("filter", {"conditions": [{"metric": "absolute_change", "operator": "<", "value": 0}]}))
    child = versions(s, d).where("record_status = 'P'").select(F.col("version_id").alias("child_version_id"))
    return rows.join(child, "child_version_id", "left_semi").select("parent_version_id", "child_version_id", "absolute_change")


POPULATIONS = {"finished": "record_status = 'F'", "finished by the cutoff": "record_status = 'F' AND historical_time <= TIMESTAMP '1995-06-30 00:00:00'", "by the cutoff": "historical_time <= TIMESTAMP '1995-06-30 00:00:00'", "all": "true"}


@query(f"WITH {V}, {M}, x AS (SELECT m.version_id, qubit_count, -toffoli_count AS cost, record_status, historical_time FROM metrics m JOIN versions v ON v.version_id = m.version_id), p AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS population, * FROM x WHERE {c}' for n, c in POPULATIONS.items())}), l AS (SELECT population, qubit_count, min(cost) AS cost FROM p GROUP BY 1, 2), f AS (SELECT *, min(cost) OVER (PARTITION BY population ORDER BY qubit_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) SELECT p.population, p.version_id FROM p JOIN f ON f.population = p.population AND f.qubit_count = p.qubit_count AND f.cost = p.cost WHERE before IS NULL OR p.cost < before")
def population_fronts(s, d):
    x = metrics(s, d).join(versions(s, d), "version_id").withColumn("cost", -F.col("toffoli_count"))
    return pareto.population_fronts(x, "qubit_count", "cost", [(n, F.expr(c)) for n, c in POPULATIONS.items()]).select("population", "version_id")


@query(f"WITH {RUN}, s AS (SELECT *, o_totalprice - previous AS delta FROM w WHERE previous IS NOT NULL) SELECT o_custkey, count(*) AS steps, min_by(o_orderkey, (delta, o_orderdate, o_orderkey)) AS fall_key, round(min(delta), 2) AS fall, min_by(o_orderkey, (-delta, o_orderdate, o_orderkey)) AS rise_key, round(max(delta), 2) AS rise FROM s GROUP BY 1")
def extreme_steps(s, d):
    found = sequences.extreme_steps(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "o_orderkey")
    return found.select("o_custkey", "steps", "fall_key", F.round("fall", 2).alias("fall"), "rise_key", F.round("rise", 2).alias("rise"))


@query("SELECT event_type, count(value) AS n, min(value) AS least, median(value) AS median, max(value) AS most FROM events GROUP BY 1")
def value_spread(s, d):
    return stats.spread(table(s, d, "events"), ["event_type"], "value")


@query(f"WITH {SHINGLES}, n AS (SELECT circuit, hash, count(*) AS n FROM hashes GROUP BY 1, 2) SELECT circuit, CAST(sum(n) AS BIGINT) AS shingles, count(*) AS \"distinct\", round(count(*) FILTER (WHERE n = 1) / CAST(count(*) AS DOUBLE), 6) AS singleton_share FROM n GROUP BY 1")
def shingle_frequencies(s, d):
    return sketch.shingle_frequencies(sketch.shingles(_tokens(s, d), "token")).select("circuit", "shingles", "distinct", F.round("singleton_share", 6).alias("singleton_share"))


@query(f"WITH {OPS}, e AS (SELECT count(*) AS w FROM ops WHERE q1 <> q2 GROUP BY least(q1, q2), greatest(q1, q2)), r AS (SELECT w, row_number() OVER (ORDER BY w DESC) AS pos, count(*) OVER () AS n FROM e) SELECT part, round(sum(w) FILTER (WHERE pos <= greatest(1, n // part)) / CAST(sum(w) AS DOUBLE), 6) AS share FROM r CROSS JOIN (VALUES (100), (10)) v(part) GROUP BY part")
def percent_mass(s, d):
    e = sketch.interactions(operations(s, d).withColumn("circuit", F.lit(0)))
    return stats.percent_mass(e, "weight").select("part", F.round("share", 6).alias("share"))


@query("WITH x AS (SELECT p_size, CAST(floor(p_retailprice / 100) AS BIGINT) AS price, p_brand, p_partkey FROM part) SELECT p_size, price, count(*) AS members, count(DISTINCT p_brand) AS \"values\", min(p_partkey) AS first_member FROM x GROUP BY 1, 2 HAVING count(DISTINCT p_brand) > 1")
def differ_only_in_brand(s, d):
    return history.differ_only_in(table(s, d, "part").withColumn("price", F.floor(F.col("p_retailprice") / 100)), ["p_size", "price"], "p_brand", "p_partkey")


@query(f"WITH {TRANS} SELECT relation, count(*) AS n, count(*) FILTER (WHERE absolute_change < 0) AS fell, round(avg(absolute_change), 6) AS mean_change FROM trans GROUP BY 1")
def compare_branches(s, d):
    rows = edges(s, d)
    for name in ("toffoli_count",):
        rows = transitions.compute_delta(rows, metrics(s, d), name, "src", "dst").where("toffoli_count_delta is not null")
    return history.by_parameter(rows, "relation", "toffoli_count_delta").withColumn("mean_change", F.round("mean_change", 6))


@query(f"WITH {EDGES}, k AS (SELECT src, relation, count(DISTINCT dst) AS n FROM edges GROUP BY 1, 2) SELECT src, CAST(sum(n) AS BIGINT) AS children, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS pairs FROM k GROUP BY 1 HAVING sum(n) * sum(n) > sum(n * n)")
def differing_siblings(s, d):
    return graph.differing_siblings(edges(s, d), "relation")


@query(f"WITH {SUCCESSORS}, worst AS (SELECT child_version_id AS v FROM steps ORDER BY -absolute_change, CAST(parent_version_id AS VARCHAR), CAST(child_version_id AS VARCHAR) LIMIT 1) SELECT dst AS version_id FROM nexts WHERE src = (SELECT v FROM worst)")
def after_largest_rise(s, d):
    """A dependent plan: what follows the child of the largest rise."""
    worst = {"bind": {"operation": "rank_transitions", "metric": "toffoli_count", "order": "largest_increase", "limit": 1}, "field": "child_version_id"}
    return planned(s, d, ("traverse", {"version": worst, "relation_type": "historical_successor"})).select("version_id")


@query(f"WITH {TRADE}, e AS (SELECT DISTINCT src, dst FROM trade WHERE relation = 'urgent'), one AS (SELECT src || '>' || dst AS path FROM e WHERE src = 1 AND dst = 2), two AS (SELECT a.src || '>' || a.dst || '>' || b.dst AS path FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 1 AND b.dst = 2 AND a.dst NOT IN (1, 2)) SELECT path FROM one UNION ALL SELECT path FROM two")
def ways_between(s, d):
    return graph.paths(trade_edges(s, d), 1, 2, 2, ["urgent"]).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("WITH a AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00') SELECT o_orderkey, o_totalprice FROM a WHERE o_totalprice = (SELECT min(o_totalprice) FROM a)")
def best_at_cutoff(s, d):
    return records.best_with_ties(table(s, d, "orders").where("o_orderdate <= timestamp_ntz '1996-06-30 00:00:00'"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM part b WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_brand = b.p_brand AND a.p_size <= b.p_size AND a.p_retailprice <= b.p_retailprice AND (a.p_size < b.p_size OR a.p_retailprice < b.p_retailprice))")
def pareto_per_group(s, d):
    return pareto.front_2d(table(s, d, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "p_partkey", "p_size", "p_retailprice")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, s_nationkey, -s_acctbal AS x, s_suppkey % 7 AS y, s_suppkey % 11 AS z FROM supplier) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT s_suppkey, s_nationkey, -s_acctbal AS x, s_suppkey % 7 AS y, s_suppkey % 11 AS z FROM supplier) a WHERE a.s_nationkey = b.s_nationkey AND a.x <= b.x AND a.y <= b.y AND a.z <= b.z AND (a.x < b.x OR a.y < b.y OR a.z < b.z))")
def pareto_3d(s, d):
    rows = table(s, d, "supplier").select("s_suppkey", "s_nationkey", (-F.col("s_acctbal")).alias("x"), (F.col("s_suppkey") % 7).alias("y"), (F.col("s_suppkey") % 11).alias("z"))
    return pareto.front(rows, ["x", "y", "z"], ["s_nationkey"]).select("s_suppkey")


@query("SELECT b.p_partkey, count(a.p_partkey) AS dominators, min(a.p_partkey) AS first_dominator FROM part b LEFT JOIN part a ON a.p_brand = b.p_brand AND a.p_size <= b.p_size AND a.p_retailprice <= b.p_retailprice AND (a.p_size < b.p_size OR a.p_retailprice < b.p_retailprice) GROUP BY 1")
def dominated_by(s, d):
    return pareto.dominated_by(table(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand"])


@query(f"WITH {V}, {M} SELECT v.version_id, circuit_id, score FROM versions v JOIN metrics m ON m.version_id = v.version_id QUALIFY rank() OVER (PARTITION BY circuit_id ORDER BY score) = 1")
def best_with_ties(s, d):
    return records.best_with_ties(versions(s, d).join(metrics(s, d), "version_id"), "score", True, ["circuit_id"]).select("version_id", "circuit_id", "score")


@query("SELECT p_brand, count(*) FILTER (WHERE p_size = ms AND p_retailprice = mp) AS common, count(*) FILTER (WHERE p_size = ms AND p_retailprice = mp) = 0 AS conflict FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS ms, min(p_retailprice) OVER (PARTITION BY p_brand) AS mp FROM part) x GROUP BY 1")
def common_optimum(s, d):
    return records.common_optimum(table(s, d, "part"), ["p_size", "p_retailprice"], ["p_brand"])


@query("SELECT sha256(text) AS fingerprint, count(*) AS members, min(doc_id) AS first_member FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicates_by_fingerprint(s, d):
    return canonical.duplicate_groups(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint")), "fingerprint", "doc_id")


@query(f"WITH {OPS} SELECT circuit, 'structural-fingerprint/v1:sha256:' || sha256('[\"structural-fingerprint/v1\",' || (max(q2) + 1) || ',0,[' || string_agg('[' || idx || ',\"' || name || '\",[' || q1 || ',' || q2 || '],[],[]]', ',' ORDER BY idx) || ']]') AS fingerprint FROM ops GROUP BY circuit")
def canonical_fingerprint(s, d):
    return canonical.fingerprints(operations(s, d))


@query(ORACLE_SQL["canonical_fingerprint"])
def streamed_fingerprint(s, d):
    return canonical.streamed_fingerprints(operations(s, d))


@query(f"WITH {OPS}, h AS (SELECT circuit, name, count(*) AS n FROM ops GROUP BY 1, 2) SELECT circuit, name, n, round(n / sum(n) OVER (PARTITION BY circuit), 6) AS share FROM h")
def histogram_distribution(s, d):
    return sketch.distribution(operations(s, d)).select("circuit", "name", "n", F.round("share", 6).alias("share"))


@query(f"WITH {OPS} SELECT circuit, least(q1, q2) AS a, greatest(q1, q2) AS b, count(*) AS weight FROM ops WHERE q1 <> q2 GROUP BY 1, 2, 3")
def interaction_edges(s, d):
    return sketch.interactions(operations(s, d))


def _tokens(s, d):
    return operations(s, d).withColumn("token", canonical.operation(index=False))


@query(f"WITH {SHINGLES} SELECT circuit, hash FROM (SELECT DISTINCT circuit, hash FROM hashes) x QUALIFY row_number() OVER (PARTITION BY circuit ORDER BY hash) <= 128")
def bottom_k_sketch(s, d):
    return sketch.bottom_k(sketch.shingles(_tokens(s, d), "token"))


PAIRS = "pairs AS (SELECT u AS \"left\", lead(u) OVER (ORDER BY u) AS \"right\" FROM (SELECT DISTINCT user_id AS u FROM events) x QUALIFY \"right\" IS NOT NULL)"


def _neighbour_pairs(ops):
    ids = ops.select(F.col("circuit").alias("left")).distinct()
    ranked = records.ranks(ids, ["left"], ["left"])
    return ranked.join(ranked.select(F.col("left").alias("right"), (F.col("rank") - 1).alias("rank")), "rank").select("left", "right")


@query(f"WITH {OPS}, {PAIRS}, h AS (SELECT circuit, name, count(*) AS n FROM ops GROUP BY 1, 2), names AS (SELECT DISTINCT name FROM h) SELECT \"left\", \"right\", round(sum(coalesce(x.n, 0) * coalesce(y.n, 0)) / sqrt(CAST(sum(coalesce(x.n, 0) * coalesce(x.n, 0)) * sum(coalesce(y.n, 0) * coalesce(y.n, 0)) AS DOUBLE)), 6) AS cosine, round(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / CAST(sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))) AS DOUBLE), 6) AS jaccard FROM pairs CROSS JOIN names LEFT JOIN h x ON x.circuit = \"left\" AND x.name = names.name LEFT JOIN h y ON y.circuit = \"right\" AND y.name = names.name GROUP BY 1, 2")
def pair_similarities(s, d):
    ops = operations(s, d)
    found = sketch.pair_similarities(sketch.histogram(ops), _neighbour_pairs(ops), "circuit", ["name"], "n")
    return found.select("left", "right", F.round("cosine", 6).alias("cosine"), F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {OPS}, e AS (SELECT circuit % 2 AS side, least(q1, q2) AS a, greatest(q1, q2) AS b, count(*) AS w FROM ops WHERE q1 <> q2 GROUP BY 1, 2, 3), j AS (SELECT coalesce(x.w, 0) AS x, coalesce(y.w, 0) AS y FROM (SELECT * FROM e WHERE side = 0) x FULL JOIN (SELECT * FROM e WHERE side = 1) y ON x.a = y.a AND x.b = y.b) SELECT round(sum(least(x, y)) / CAST(sum(greatest(x, y)) AS DOUBLE), 6) AS similarity FROM j")
def weighted_jaccard(s, d):
    e = sketch.interactions(operations(s, d).withColumn("circuit", F.col("circuit") % 2))
    return sketch.weighted_jaccard(e.where("circuit = 0"), e.where("circuit = 1"), ["a", "b"], "weight").select(F.round("similarity", 6).alias("similarity"))


@query(f"WITH {OPS}, h AS (SELECT circuit % 2 AS side, name, count(*) AS n FROM ops GROUP BY 1, 2) SELECT round(sum(x.n * y.n) / sqrt(CAST((SELECT sum(n * n) FROM h WHERE side = 0) AS DOUBLE) * (SELECT sum(n * n) FROM h WHERE side = 1)), 6) AS similarity FROM (SELECT * FROM h WHERE side = 0) x JOIN (SELECT * FROM h WHERE side = 1) y ON x.name = y.name")
def histogram_cosine(s, d):
    h = sketch.histogram(operations(s, d).withColumn("circuit", F.col("circuit") % 2))
    return sketch.cosine(h.where("circuit = 0"), h.where("circuit = 1"), ["name"], "n").select(F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SHINGLES}, u AS (SELECT hash, count(DISTINCT circuit % 2) AS n FROM hashes GROUP BY 1 ORDER BY hash LIMIT 128) SELECT round(count(*) FILTER (WHERE n = 2) / CAST(count(*) AS DOUBLE), 6) AS similarity FROM u")
def kmv_jaccard(s, d):
    h = sketch.shingles(_tokens(s, d), "token").withColumn("side", F.col("circuit") % 2)
    a, b = (sketch.bottom_k(h.where(F.col("side") == k).select(F.col("side").alias("circuit"), "hash")) for k in (0, 1))
    return sketch.kmv_jaccard(a, b).select(F.round("similarity", 6).alias("similarity"))


@query(f"WITH {OPS} SELECT circuit, idx // 10 AS block, count(*) AS n FROM ops WHERE idx % 10 < 4 GROUP BY 1, 2")
def sampled_windows(s, d):
    return sketch.sampled(operations(s, d), 10, 4).groupBy("circuit", "block").agg(F.count("*").alias("n"))


@query(f"WITH {OPS} SELECT circuit, name, count(*) AS n FROM ops GROUP BY 1, 2")
def block_merge(s, d):
    parts = sketch.blocks(operations(s, d), 8).groupBy("circuit", "block", "name").agg(F.count("*").alias("n"))
    return sketch.merge_histograms(parts)


@query(f"WITH {SHINGLES}, b AS (SELECT DISTINCT circuit, hash FROM hashes) SELECT circuit, count(*) AS distinct_shingles FROM b GROUP BY 1")
def block_shingles(s, d):
    """Blocks that overlap by the width less one hold every shingle of the whole."""
    ops = sketch.blocks(_tokens(s, d), 8, sketch.WIDTH - 1)
    return sketch.shingles(ops, "token", extra=("block",)).groupBy("circuit").agg(F.count_distinct("hash").alias("distinct_shingles"))


@query(f"WITH {OPS}, {PAIRS}, h AS (SELECT circuit, idx // 8 AS block, name, count(*) AS n FROM ops GROUP BY 1, 2, 3), t AS (SELECT circuit, block, sum(n) AS total FROM h GROUP BY 1, 2), c AS (SELECT \"left\", \"right\", x.block, y.block AS other, x.total + y.total AS total, coalesce((SELECT sum(least(a.n, b.n)) FROM h a JOIN h b ON a.name = b.name WHERE a.circuit = x.circuit AND a.block = x.block AND b.circuit = y.circuit AND b.block = y.block), 0) AS shared FROM pairs JOIN t x ON x.circuit = \"left\" JOIN t y ON y.circuit = \"right\" AND abs(x.block - y.block) <= 2), j AS (SELECT *, CAST(shared AS DOUBLE) / (total - shared) AS similarity FROM c) SELECT \"left\", \"right\", block, round(max(similarity), 6) AS similarity, min_by(other, (-similarity, abs(block - other), other)) AS best FROM j GROUP BY 1, 2, 3")
def change_localization(s, d):
    ops = operations(s, d)
    return sketch.localize(sketch.blocks(ops, 8).groupBy("circuit", "block", "name").agg(F.count("*").alias("n")), _neighbour_pairs(ops), 2).select("left", "right", "block", F.round("similarity", 6).alias("similarity"), "best")


@query(f"WITH {OPS}, e AS (SELECT least(q1, q2) AS a, greatest(q1, q2) AS b, count(*) AS w FROM ops WHERE q1 <> q2 GROUP BY 1, 2), r AS (SELECT w, row_number() OVER (ORDER BY w DESC) AS pos FROM e) SELECT k, round(sum(w) FILTER (WHERE pos <= k) / CAST(sum(w) AS DOUBLE), 6) AS share FROM r CROSS JOIN (VALUES (1), (10), (100)) v(k) GROUP BY k")
def interaction_mass(s, d):
    e = sketch.interactions(operations(s, d).withColumn("circuit", F.lit(0)))
    return stats.mass(e, "weight").select("k", F.round("share", 6).alias("share"))


@query(f"WITH {OPS} SELECT least(q1, q2) AS a, greatest(q1, q2) AS b, count(*) AS weight FROM ops WHERE q1 <> q2 GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 20")
def heavy_hitters(s, d):
    return sketch.heavy_hitters(sketch.interactions(operations(s, d)), ["a", "b"], "weight", 20)


@query(f"WITH {OPS} SELECT a, b FROM (SELECT DISTINCT least(q1, q2) AS a, greatest(q1, q2) AS b FROM ops WHERE q1 <> q2) x ORDER BY sha256('0|' || a || '|' || b) LIMIT 25")
def edge_sample(s, d):
    return sketch.hash_sample(sketch.interactions(operations(s, d)), ["a", "b"], 25)


@query("WITH f AS (SELECT l_partkey, min(l_orderkey) AS first, count(*) AS w FROM lineitem GROUP BY 1) SELECT budget, count(*) FILTER (WHERE first < budget) AS distinct_items, round(sum(w) FILTER (WHERE first < budget) / CAST(sum(w) AS DOUBLE), 6) AS weight_share FROM f CROSS JOIN (VALUES (100), (1000), (10000)) v(budget) GROUP BY 1")
def discovery_curve(s, d):
    return stats.discovery_curve(table(s, d, "lineitem"), "l_partkey", "l_orderkey", [100, 1000, 10000]).withColumn("weight_share", F.round("weight_share", 6))


def _labels(s, d):
    return table(s, d, "labels")


@query("WITH grid AS (SELECT a.t, b.g FROM (VALUES (0), (1)) a(t) CROSS JOIN (VALUES (0), (1)) b(g)), c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2) SELECT t AS truth, g AS guess, coalesce(n, 0) AS n FROM grid LEFT JOIN c ON quality = t AND toxic = g")
def confusion_matrix(s, d):
    return stats.confusion(_labels(s, d), "quality", "toxic", [0, 1])


@query("SELECT label, round(CASE WHEN count(*) FILTER (WHERE toxic = label) > 0 THEN count(*) FILTER (WHERE toxic = label AND quality = label) / CAST(count(*) FILTER (WHERE toxic = label) AS DOUBLE) END, 6) AS precision, round(CASE WHEN count(*) FILTER (WHERE quality = label) > 0 THEN count(*) FILTER (WHERE toxic = label AND quality = label) / CAST(count(*) FILTER (WHERE quality = label) AS DOUBLE) END, 6) AS recall FROM labels CROSS JOIN (VALUES (0), (1)) v(label) GROUP BY 1")
def precision_recall(s, d):
    return stats.precision_recall(_labels(s, d), "quality", "toxic", [0, 1]).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(median(value), 6) AS median, round(max(value) FILTER (WHERE pos = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)), 6) AS p95 FROM r GROUP BY 1")
def median_p95(s, d):
    return stats.nearest_rank(table(s, d, "events"), ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS \"view\" FROM events GROUP BY 1")
def pivot_metrics(s, d):
    return records.wide_metrics(table(s, d, "events").select(F.col("user_id"), F.col("event_type").alias("name"), "value"), ["click", "view"], "user_id")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def conditional_counts(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_distinct("o_custkey").alias("customers"))


@query("WITH i AS (SELECT CASE WHEN l_quantity > 40 THEN 'large' END AS a, CASE WHEN l_discount > 0.08 THEN 'cheap' END AS b, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END AS c FROM lineitem) SELECT issue, count(*) AS n FROM (SELECT a AS issue FROM i UNION ALL SELECT b FROM i UNION ALL SELECT c FROM i) x WHERE issue IS NOT NULL GROUP BY 1")
def issue_validation(s, d):
    rules = [("large", F.col("l_quantity") > 40), ("cheap", F.col("l_discount") > 0.08), ("flag", ~F.col("l_returnflag").isin("A", "N"))]
    return quality.issue_counts(quality.with_issues(table(s, d, "lineitem"), rules))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def duplicate_keys(s, d):
    return quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT 'price_positive' AS \"check\", count(*) FILTER (WHERE NOT o_totalprice > 0) AS violations FROM orders UNION ALL SELECT 'known_status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders")
def check_violations(s, d):
    return quality.violations(table(s, d, "orders"), [("price_positive", F.col("o_totalprice") > 0), ("known_status", F.col("o_orderstatus").isin("F", "O"))])


@query("WITH a AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1, 2), b AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN b.user_id IS NULL THEN 'only_old' WHEN a.user_id IS NULL THEN 'only_new' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (user_id, event_type)")
def snapshot_diff(s, d):
    """The newest values up to a day against those of all events."""
    e, key = table(s, d, "events"), ["user_id", "event_type"]
    old, new = (latest.latest_row(x, key, ["ts", "event_id"]) for x in (e.where("ts < timestamp_ntz '2024-01-03'"), e))
    return latest.snapshot_diff(old, new, key, ["value"]).select(*key, "state")


@query("SELECT user_id, max_by(value, (side, ts, event_id)) AS value FROM (SELECT *, 0 AS side FROM events WHERE event_type = 'view' UNION ALL SELECT *, 1 FROM events WHERE event_type = 'click') x GROUP BY 1")
def upsert(s, d):
    old, new = (latest.latest_row(table(s, d, "events").where(F.col("event_type") == k), ["user_id"], ["ts", "event_id"]) for k in ("view", "click"))
    return latest.upsert(old, new, ["user_id"]).select("user_id", "value")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) b UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) c")
def set_operations(s, d):
    c, p = table(s, d, "customer").select("c_nationkey"), table(s, d, "supplier").select("s_nationkey")
    rows = {"union": c.union(p).distinct(), "intersect": c.intersect(p), "except": table(s, d, "part").select("p_partkey").subtract(table(s, d, "lineitem").select("l_partkey"))}
    out = None
    for name, x in rows.items():
        row = x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'with_orders' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_and_anti_join(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.lit("with_orders").alias("kind"), F.count("*").alias("n")).unionByName(c.join(o, "c_custkey", "left_anti").agg(F.lit("without_orders").alias("kind"), F.count("*").alias("n")))


@query(f"WITH {NEXT} SELECT e.src, e.dst, a.o_totalprice AS src_price, b.o_totalprice AS dst_price FROM nexts e JOIN orders a ON a.o_orderkey = e.src JOIN orders b ON b.o_orderkey = e.dst WHERE b.o_totalprice < a.o_totalprice")
def edge_double_join(s, d):
    v = table(s, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("price"))
    return transitions.endpoints(next_edges(s, d), v, ["price"]).where("dst_price < src_price").select("src", "dst", "src_price", "dst_price")


@query("SELECT CASE WHEN n IS NULL THEN 'no_orders' WHEN f > 5 THEN 'many_finished' WHEN f > 0 THEN 'some_finished' ELSE 'other' END AS stage, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1")
def coverage_funnel(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return stats.funnel(table(s, d, "customer").join(o, "c_custkey", "left"), [("no_orders", "n is null"), ("many_finished", "f > 5"), ("some_finished", "f > 0")])


@query(f"WITH {V}, {M} SELECT 'score' AS metric, count(score) AS with_metric, count(*) - count(score) AS missing FROM versions v LEFT JOIN metrics m ON m.version_id = v.version_id")
def metric_coverage(s, d):
    return records.coverage(records.list_versions(versions(s, d), metrics(s, d)), ["score"])


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def forward_fill(s, d):
    head = F.when(F.col("role") == "user", F.col("text"))
    return sequences.forward_fill(table(s, d, "conversations"), ["conv_id"], ["turn"], head).select("conv_id", "turn", "heading")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) SELECT o_orderkey, pos AS rank FROM r WHERE pos IN (SELECT CAST(round(i * ((SELECT count(*) FROM orders) - 1) / 10.0) AS BIGINT) FROM range(11) t(i))")
def even_spread(s, d):
    return records.even_spread(table(s, d, "orders"), 11, ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rank")


@query(f"WITH {TRADE}, near AS (SELECT DISTINCT CASE WHEN src = 3 THEN dst ELSE src END AS node FROM trade WHERE (src = 3) <> (dst = 3)) SELECT node, n_name AS key FROM near JOIN nation ON n_nationkey = node WHERE node <> 4 ORDER BY n_name, node LIMIT 5")
def neighbourhood_expand(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.lit(None).cast("timestamp").alias("time"), F.col("n_name").alias("key"))
    loaded = s.range(1).select(F.lit(4).alias("node"))
    return graph.expand(trade_edges(s, d), loaded, 3, n, 5)[0].select("node", "key")


@query(f"WITH RECURSIVE {NEXT}, {WHO}, both_ways AS (SELECT src AS x, dst AS y FROM nexts UNION ALL SELECT dst, src FROM nexts), walk AS (SELECT b AS node FROM ends UNION SELECT y FROM walk JOIN both_ways ON x = node) SELECT node FROM walk")
def component_projection(s, d):
    return graph.project_component(next_edges(s, d), _start(s, d)[1]).select("node")


@query(f"WITH RECURSIVE {NEXT}, walk AS (SELECT src AS node, 0 AS depth FROM nexts WHERE src NOT IN (SELECT dst FROM nexts) UNION ALL SELECT e.dst, depth + 1 FROM walk JOIN nexts e ON e.src = node) SELECT node, max(depth) AS depth FROM walk GROUP BY 1")
def topological_depth(s, d):
    return graph.longest_depth(next_edges(s, d))


@query(f"WITH RECURSIVE {NEXT}, {WHO}, down AS (SELECT a AS node, 0 AS from_a FROM ends UNION ALL SELECT e.dst, from_a + 1 FROM down JOIN nexts e ON e.src = node), up AS (SELECT b AS node, 0 AS to_b FROM ends UNION ALL SELECT e.src, to_b + 1 FROM up JOIN nexts e ON e.dst = node) SELECT node, from_a, to_b FROM down JOIN up USING (node)")
def path_slice(s, d):
    return graph.path_slice(next_edges(s, d), *_start(s, d))


@query(f"WITH {EDGES}, k AS (SELECT src, count(DISTINCT dst) AS children FROM edges GROUP BY 1) SELECT src, children, CAST(children * (children - 1) / 2 AS BIGINT) AS pairs FROM k WHERE children > 1")
def siblings(s, d):
    return graph.siblings(edges(s, d))


@query(f"WITH {TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade WHERE src <> dst) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) x GROUP BY 1")
def graph_degrees(s, d):
    return graph.degrees(trade_edges(s, d))


@query(f"WITH {TRADE} SELECT relation, count(*) FILTER (WHERE src = 3) AS n_out, count(*) FILTER (WHERE dst = 3) AS n_in FROM trade WHERE src = 3 OR dst = 3 GROUP BY 1")
def relationship_summary(s, d):
    return graph.relationship_summary(trade_edges(s, d), 3).select("relation", "n_out", "n_in")


@query(f"WITH {EDGES}, c AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1) SELECT 'duplicate_id' AS rule, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) x UNION ALL SELECT 'missing_source', count(*) FROM edges WHERE src NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'missing_target', count(*) FROM edges WHERE dst NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'several_parents', count(*) FROM c WHERE n > 1 UNION ALL SELECT 'self_link', count(*) FROM edges WHERE src = dst UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT src, dst, relation FROM edges GROUP BY 1, 2, 3 HAVING count(*) > 1) y")
def graph_integrity(s, d):
    return graph.integrity(versions(s, d), edges(s, d))


@query(f"WITH f AS ({ORACLE_SQL['canonical_fingerprint']}), {OPS}, m AS (SELECT circuit, count(*) // 5 AS fives, count(DISTINCT name) AS kinds FROM ops GROUP BY 1) SELECT fives, kinds, count(DISTINCT fingerprint) AS prints FROM m JOIN f USING (circuit) GROUP BY 1, 2 HAVING count(DISTINCT fingerprint) > 1")
def same_metrics_different_fingerprint(s, d):
    ops = operations(s, d)
    m = ops.groupBy("circuit").agg(F.floor(F.count("*") / 5).alias("fives"), F.count_distinct("name").alias("kinds"))
    rows = m.join(canonical.fingerprints(ops), "circuit").withColumnRenamed("fingerprint", "print")
    return rows.groupBy("fives", "kinds").agg(F.count_distinct("print").alias("prints")).where("prints > 1")


@query(f"WITH RECURSIVE {M}, {EDGES}, {WHO}, walk AS (SELECT a AS node FROM ends UNION SELECT e.dst FROM walk JOIN edges e ON e.src = node), r AS (SELECT node, score FROM walk JOIN metrics ON version_id = node WHERE node <> (SELECT a FROM ends)) SELECT node, score FROM r WHERE score = (SELECT min(score) FROM r)")
def min_metric_descendant(s, d):
    found = graph.traverse(edges(s, d), _start(s, d)[0]).join(metrics(s, d), F.col("node") == F.col("version_id"))
    return records.best_with_ties(found, "score").select("node", "score")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(s, d):
    return streams.tumbling(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS w FROM events CROSS JOIN range(4) t(i)) x GROUP BY 1, 2")
def sliding_windows(s, d):
    return streams.sliding(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, k")
def session_windows(s, d):
    return streams.sessions(table(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'absent' ELSE 'value' END AS presence FROM events")
def json_extraction(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), quality.presence(F.col("props"), "k").alias("presence"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS tags, len(regexp_extract_all(html, '(?i)<a[ >]')) AS links FROM pages")
def regex_counts(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_count("html", F.lit("<[a-zA-Z]")).alias("tags"), F.regexp_count("html", F.lit("(?i)<a[ >]")).alias("links"))


@query(f"WITH {V}, {M} SELECT v.version_id, CASE WHEN score >= 1000 THEN round(score / 1000.0, 1) || 'K' ELSE CAST(score AS VARCHAR) END AS short FROM versions v JOIN metrics m ON m.version_id = v.version_id")
def compact_numbers(s, d):
    return metrics(s, d).join(versions(s, d).select("version_id"), "version_id").select("version_id", scalars.compact(F.col("score")).alias("short"))


@query(f"WITH {OPS} SELECT circuit, count(*) FILTER (WHERE q1 = q2) AS one_qubit, count(*) FILTER (WHERE q1 <> q2) AS two_qubit, count(*) AS total FROM ops GROUP BY 1")
def arity_counts(s, d):
    return canonical.arity_counts(operations(s, d)).select("circuit", "one_qubit", "two_qubit", "total")


@query(f"WITH RECURSIVE {OPS}, run AS (SELECT DISTINCT circuit, CAST(-1 AS BIGINT) AS idx, list_transform(range(24), lambda x: CAST(0 AS BIGINT)) AS levels FROM ops UNION ALL SELECT run.circuit, o.idx, list_transform(levels, lambda x, i: CASE WHEN i - 1 IN (q1, q2) THEN greatest(levels[q1 + 1], levels[q2 + 1]) + 1 ELSE x END) FROM run JOIN ops o ON o.circuit = run.circuit AND o.idx = run.idx + 1) SELECT circuit, list_max(max_by(levels, idx)) AS depth FROM run GROUP BY 1")
def circuit_depth(s, d):
    return canonical.circuit_depth(operations(s, d))


@query("SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(text, '~'), coalesce(lang, '~'), coalesce(source, '~'), coalesce(CAST(n_chars AS VARCHAR), '~'))), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM documents")
def table_digest(s, d):
    return stats.table_digest(table(s, d, "documents"))


@query("WITH n AS (SELECT substr(c_name, 1, 18) AS prefix, c_name AS name FROM customer), o AS (SELECT prefix, min(name) AS name FROM n GROUP BY 1 HAVING count(*) = 1) SELECT prefix, name FROM o")
def prefix_join(s, d):
    names = table(s, d, "customer").select(F.col("c_name").alias("name"))
    return resolve.prefix_join(names.select(F.substring("name", 1, 18).alias("prefix")).distinct(), names, 18)


@query("SELECT s.version_id, name, min_by(value, tier) AS value FROM (SELECT l_orderkey AS version_id, 'quantity' AS name, CAST(sum(l_quantity) AS DOUBLE) AS value, 1 AS tier FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'quantity' ELSE 'price' END, o_totalprice, 0 FROM orders) s GROUP BY 1, 2")
def unified_metrics(s, d):
    a = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.sum("l_quantity").alias("value")).select("version_id", F.lit("quantity").alias("name"), "value")
    b = table(s, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "quantity").otherwise("price").alias("name"), F.col("o_totalprice").alias("value"))
    return records.unified_metrics(a, b)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'promoted' WHEN o_orderstatus = 'F' THEN 'validated' ELSE 'submitted' END AS class FROM orders")
def submission_classes(s, d):
    f = F.col("o_orderstatus") == "F"
    return history.classify(table(s, d, "orders"), [("promoted", f & (F.col("o_orderpriority") == "1-URGENT")), ("validated", f)], "submitted").select("o_orderkey", "class")


@query("SELECT user_id AS contributor, count(*) FILTER (WHERE event_type = 'click') AS submitted, count(*) FILTER (WHERE event_type = 'view') AS coauthored, count(*) FILTER (WHERE event_id % 3 = 0) AS with_version, count(value) AS scored, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY 1")
def contributor_rollup(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("contributor"), F.when(F.col("event_type") == "click", "SUBMITTER").when(F.col("event_type") == "view", "COAUTHOR").otherwise("OTHER").alias("role"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("version_id"), F.col("value").alias("score"), F.col("event_id").alias("at"))
    return history.contributor_rollup(e)


@query("SELECT n_nationkey, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT c_nationkey AS n_nationkey, 'customer' AS role FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) x GROUP BY 1")
def merged_roles(s, d):
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("role")), table(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("role"))
    return history.merge_roles([a, b], ["n_nationkey"])


@query("SELECT c_name AS identity, 3 AS tier FROM customer WHERE lower(c_name) = (SELECT lower(min(c_name)) FROM customer)")
def contributor_resolution(s, d):
    c = table(s, d, "customer")
    name = c.agg(F.min("c_name")).first()[0]
    return history.resolve_contributor(c.select(F.col("c_name").alias("identity"), F.col("c_name").alias("handle"), F.col("c_custkey").cast("string").alias("account"), F.col("c_mktsegment").alias("alias")), f"@{name.upper()}")


@query("WITH n AS (SELECT l_orderkey, count(*) AS operations, sum(l_quantity) AS bytes FROM lineitem GROUP BY 1) SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority = '1-URGENT' THEN 'failed_before' WHEN bytes IS NULL THEN 'no_artifact' WHEN bytes > 150 THEN 'too_large' WHEN operations > 4 THEN 'too_long' ELSE 'todo' END AS state, count(*) AS n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1")
def extraction_states(s, d):
    o = table(s, d, "orders")
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("operations"), F.sum("l_quantity").alias("bytes"))
    return history.extraction_states(o.join(n, "o_orderkey", "left"), o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "o_orderkey", 150, 4).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) AS total FROM events")
def outcome_totals(s, d):
    return history.outcome_totals(table(s, d, "events"), "event_type", ["click", "view"])


@query("SELECT user_id, event_type AS name, CAST(floor(value / 10) AS BIGINT) AS value, string_agg(DISTINCT CAST(event_id % 3 AS VARCHAR), ',' ORDER BY CAST(event_id % 3 AS VARCHAR)) AS sources FROM events GROUP BY 1, 2, 3")
def merged_facts(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("name"), F.floor(F.col("value") / 10).alias("value"), (F.col("event_id") % 3).cast("string").alias("source"))
    return history.merge_facts(e, ["user_id"])


@query("SELECT p_size, p_brand, count(*) AS members, count(DISTINCT sha256(p_name)) AS fingerprints, min(p_partkey) AS first_member FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def identical_metrics(s, d):
    return history.identical_metrics(table(s, d, "part").withColumn("print", F.sha2("p_name", 256)), ["p_size", "p_brand"], "p_partkey", "print")


@query("SELECT 'p_size' AS field, count(p_size) AS n, CAST(sum(p_size) AS DOUBLE) AS total, CAST(min(p_size) AS DOUBLE) AS least, CAST(max(p_size) AS DOUBLE) AS most FROM part UNION ALL SELECT 'p_partkey', count(p_partkey), CAST(sum(p_partkey) AS DOUBLE), CAST(min(p_partkey) AS DOUBLE), CAST(max(p_partkey) AS DOUBLE) FROM part")
def sample_summary(s, d):
    return history.summary(table(s, d, "part"), ["p_size", "p_partkey"])


@query(f"WITH {M}, {NEXT}, c AS (SELECT e.src, e.dst, b.qubit_count - a.qubit_count AS q, b.toffoli_count - a.toffoli_count AS t FROM nexts e LEFT JOIN metrics a ON a.version_id = e.src LEFT JOIN metrics b ON b.version_id = e.dst) SELECT CASE WHEN q IS NULL OR t IS NULL THEN 'unknown' WHEN least(q, t) < 0 AND greatest(q, t) > 0 THEN 'mixed' WHEN least(q, t) < 0 THEN 'improved' WHEN greatest(q, t) > 0 THEN 'worse' ELSE 'same' END AS verdict, count(*) AS n FROM c GROUP BY 1")
def trade_offs(s, d):
    m = metrics(s, d)
    rows = next_edges(s, d)
    for name in ("qubit_count", "toffoli_count"):
        rows = transitions.compute_delta(rows, m, name, "src", "dst")
    return rows.groupBy(history.trade_off([F.col("qubit_count_delta"), F.col("toffoli_count_delta")]).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders")
def best_so_far(s, d):
    return history.best_so_far(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "best")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_runs(s, d):
    return history.newest(table(s, d, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice, p_partkey LIMIT 25")
def lexicographic_ranking(s, d):
    return history.lexicographic(table(s, d, "part"), ["p_size", "p_retailprice"], "p_partkey", 25).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def reproducible(s, d):
    return history.reproducible(table(s, d, "events").select("user_id", F.col("event_type").alias("kind")), "user_id", ["click", "view", "purchase"])


@query(f"WITH {V}, {M}, x AS (SELECT v.version_id, historical_time, qubit_count, toffoli_count FROM versions v JOIN metrics m ON m.version_id = v.version_id), r AS (SELECT * FROM x WHERE version_id = (SELECT min(version_id) FROM x)) SELECT x.version_id FROM x, r WHERE x.historical_time > r.historical_time AND x.qubit_count < r.qubit_count AND x.toffoli_count < r.toffoli_count")
def better_and_later(s, d):
    x = versions(s, d).join(metrics(s, d), "version_id")
    first = metrics(s, d).agg(F.min("version_id")).first()[0]
    return history.better_and_later(x, F.col("version_id") == first, "historical_time", ["qubit_count", "toffoli_count"]).select("version_id")


@query(f"WITH {OPS} SELECT circuit, least(6, count(DISTINCT q1)) AS counters, true AS bounded, true AS frequent_kept FROM ops GROUP BY 1")
def space_saving(s, d):
    """Six counters over up to 16 items: true counts lie within the bounds, and frequent items are all there."""
    ops = operations(s, d).select("circuit", "idx", F.col("qubits")[0].cast("string").alias("item"))
    kept = sketch.space_saving(ops, "item", 6)
    n = ops.groupBy("circuit", "item").agg(F.count("*").alias("n")).join(ops.groupBy("circuit").agg(F.count("*").alias("total")), "circuit")
    rows = n.join(kept, ["circuit", "item"], "left")
    bounded = F.col("weight").isNull() | ((F.col("n") <= F.col("weight")) & (F.col("n") >= F.col("weight") - F.col("error")))
    frequent = F.col("weight").isNotNull() | (F.col("n") * 6 <= F.col("total"))
    return rows.groupBy("circuit").agg(F.count("weight").alias("counters"), F.bool_and(bounded).alias("bounded"), F.bool_and(frequent).alias("frequent_kept"))


@query(f"WITH {OPS} SELECT circuit, least(5, count(DISTINCT q1)) AS kept, true AS members FROM ops GROUP BY 1")
def reservoir(s, d):
    """Five of up to 16 distinct items, all of the circuit's own."""
    ops = operations(s, d).withColumn("item", F.col("qubits")[0])
    own = ops.select("circuit", F.col("item").cast("string").alias("item"), F.lit(True).alias("own")).distinct()
    kept = sketch.reservoir(ops, "item", 5).join(own, ["circuit", "item"], "left")
    return kept.groupBy("circuit").agg(F.count_distinct("item").alias("kept"), F.bool_and(F.coalesce("own", F.lit(False))).alias("members"))


@query("SELECT n_regionkey, max(CASE WHEN role = 'c' THEN n END) AS customers, max(CASE WHEN role = 's' THEN n END) AS suppliers FROM (SELECT n_regionkey, 'c' AS role, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT n_regionkey, 's', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) x GROUP BY 1")
def three_way_join(s, d):
    n = table(s, d, "nation")
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("customers"))
    p = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("suppliers"))
    return c.join(p, "n_regionkey", "full_outer")


@query("SELECT c_custkey, n, c_acctbal > avg(c_acctbal) OVER () AS above FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def scalar_subquery(s, d):
    c = table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey")
    return c.join(F.broadcast(c.agg(F.avg("c_acctbal").alias("mean")))).select("c_custkey", "n", (F.col("c_acctbal") > F.col("mean")).alias("above"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(s, d):
    return table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT d.lang, count(*) AS docs, count(*) FILTER (WHERE l.quality = 1) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def label_coverage(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("quality") == 1).alias("good"))
