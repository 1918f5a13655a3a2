import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from quillon.functions import canonical, scalars, sketch
from quillon.operators import asof, graph, history, latest, pareto, quality, records, resolve, sequences, stats, transitions
from quillon.sources import readers, writers


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, relation string")


def test_cycles_and_self_links(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")])
    assert {(r.node, r.hops) for r in graph.traverse(e, "a").collect()} == {("b", 1), ("c", 2)}
    assert graph.traverse(e, "d").count() == 0
    assert {r.node for r in graph.project_component(e, "c").collect()} == {"a", "b", "c"}
    assert {(r.node, r.degree) for r in graph.degrees(e).collect()} == {("a", 2), ("b", 2), ("c", 2)}
    assert graph.inner_edges(e, graph.project_component(e, "d")).count() == 1
    bad = {r.rule: r.violations for r in graph.integrity(spark.createDataFrame([("a",), ("b",), ("c",)], "version_id string"), e).collect()}
    assert bad == {"duplicate_id": 0, "missing_source": 1, "missing_target": 1, "several_parents": 1, "self_link": 1, "duplicate_edge": 1}
    with pytest.raises(ValueError):
        graph.longest_depth(edges(spark, [("r", "a"), ("a", "b"), ("b", "a")])).count()
    assert graph.longest_depth(edges(spark, [])).count() == 0


def test_ancestors_and_paths(spark):
    e = edges(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "d"), ("c", "x"), ("d", "x")])
    assert [(r.node, r.hops) for r in graph.common_ancestors(e, "c", "d").collect()] == [("r", 4)]
    assert {r.node for r in graph.path_slice(e, "a", "x").collect()} == {"a", "c", "x"}
    assert {(r.node, r.depth) for r in graph.longest_depth(e).collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2), ("x", 3)}
    order = spark.createDataFrame([("a", None, "2"), ("b", None, "1")], "node string, time string, key string")
    shown, hidden = graph.expand(e, spark.createDataFrame([("x",)], "node string"), "r", order, 1)
    assert ([r.node for r in shown.collect()], hidden.first()[0]) == (["b"], 1)


def test_latest_set_is_not_latest_row(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), (None, 1, "n")], "key string, t int, v string")
    assert latest.latest_row(df, ["key"], ["t", "v"]).count() == 2
    assert {r.v for r in latest.latest_set(df, ["key"], ["t"]).collect()} == {"b", "c", "n"}
    diff = latest.snapshot_diff(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), ["k"], ["v"])
    assert {(r.k, r.state, r.fields) for r in diff.collect()} == {(1, "only_old", ""), (2, "changed", "v"), (3, "only_new", "")}
    assert latest.write_once_conflicts(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string"), ["k"], "v").count() == 1


def test_asof_and_band(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "two"), ("k", 5, "five")], "k string, t int, v string")
    assert {(r.k, r.t, r.asof_v) for r in asof.asof_join(left, right, ["k"], ["t"], ["v"]).collect()} == {("k", 5, "five"), ("k", 1, None), ("z", 9, None)}
    nums = spark.createDataFrame([("k", i) for i in range(10)], "k string, t int")
    assert {(r.t, r.right_t) for r in asof.band_join(nums, nums, ["k"], "t", 2).collect()} == {(a, b) for a in range(10) for b in range(10) if abs(a - b) <= 2}


def test_pareto(spark):
    rows = [(1, 1, 5), (2, 2, 2), (3, 2, 2), (4, 3, 2), (5, 5, 1), (6, 1, 6)]
    df = spark.createDataFrame(rows, "k int, x int, y int")
    want = {k for k, x, y in rows if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in rows)}
    assert {r.k for r in pareto.front_2d(df, "x", "y").collect()} == want == {r.k for r in pareto.front(df, ["x", "y"]).collect()}
    assert {r.k: r.dominators for r in pareto.dominated_by(df, "k", ["x", "y"]).collect()}[4] == 2


def test_dominators_without_pairs(spark):
    rows = [(f"k{i}", ("a", "b", None)[i % 7 % 3], i * 37 % 11, (i * 53 % 13 / 2, float("nan"), None, -0.0, float("inf"))[i % 17 % 5], i * 29 % 7) for i in range(400)] + [(None, "a", 0, 0.5, 0), ("k8", "a", 9, 9.0, 6)]
    df = spark.createDataFrame(rows, "k string, g string, x int, y double, z int")
    order = lambda v: (v != v, 0 if v != v else v)  # noqa: E731  (NaN is the greatest)
    for metrics, by in ((1, True), (2, True), (2, False), (3, True), (3, False)):
        names = ["x", "y", "z"][:metrics]
        points = [(k, g, tuple(map(order, v[:metrics]))) for k, g, *v in rows if None not in v[:metrics] and not (by and g is None)]
        want = {k: [0, None] for k, *_ in rows}
        for k, g, v in points:
            above = [j for j, h, u in points if j is not None and (h == g or not by) and u != v and all(a <= b for a, b in zip(u, v, strict=True))]
            want[k] = [want[k][0] + len(above), min([c for c in (want[k][1], *above) if c is not None], default=None)]
        found = pareto.dominated_by(df, "k", names, ["g"] if by else [])
        assert {r.k: [r.dominators, r.first_dominator] for r in found.collect()} == want
        assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "<" in line]


def test_sequences(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([9, 8, 7, 10, 9, 9, 6])], "c string, i int, v int")
    run = sequences.longest_run(sequences.steps(df, ["c"], ["i"], "v"), ["c"], ["i"], F.col("delta") < 0).first()
    assert (run.length, run.start) == (2, 2)
    assert [(r.i, r.distance) for r in sequences.recovery(df, ["c"], ["i"], "v", "i").collect()] == [(3, 3)]
    assert sequences.cumulative_change(df, ["c"], ["i"], "v").first().change == -3


def test_resolution(spark):
    df = spark.createDataFrame([("abc1", "e1"), ("abc2", "e2"), ("zzz9", "e3")], "name string, entity string")
    found = {r.ref: (r.status, r.entity) for r in resolve.namespaces(spark.createDataFrame([("abc1",), ("zzz9",), ("abc",), ("none1",)], "ref string"), {"n": df}, 3).collect()}
    assert found == {"abc1": ("RESOLVED", "e1"), "zzz9": ("RESOLVED", "e3"), "abc": ("AMBIGUOUS", None), "none1": ("UNKNOWN", None)}
    v = spark.createDataFrame([("v1", "repo:abc1", "First"), ("v2", "repo:ABC2", None), ("abc", "x", None), ("v4", "abc", "l"), ("v5", None, "ABC"), ("v6", "no", "no")], "id string, key string, label string")
    look = lambda text, n: [(r.id, r.tier, r.truncated) for r in resolve.search(v, text, "id", "key", "label", n).collect()]
    assert look("abc", 9) == [("abc", 1, False), ("v4", 2, False), ("v5", 3, False), ("v2", 4, False), ("v1", 4, False)]
    assert look("abc", 2) == [("abc", 1, True), ("v4", 2, True)] and look("ab", 9) == [] and look("first", 9) == [("v1", 3, False)]


def test_stats(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(21)], "g string, v double")
    r = stats.nearest_rank(df, ["g"], "v").first()
    assert (r.median, r.p95) == (10.0, 19.0)
    c = {(r.truth, r.guess): r.n for r in stats.confusion(spark.createDataFrame([(1, 0), (1, 1)], "t int, g int"), "t", "g", [0, 1]).collect()}
    assert c == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    assert records.ranks(df, ["v"], ["v"]).where("rank <> v").count() == 0
    a, b = df.repartition(3), df.repartition(2).orderBy(F.desc("v"))
    assert stats.table_digest(a).first() == stats.table_digest(b).first()


def test_quality(spark):
    df = spark.createDataFrame([(2**40, 2**20, 2**60), (3, 4, 13), (None, 4, 5)], "a long, b long, s long")
    q = quality.with_issues(df, [("score_mismatch", quality.score_mismatch(F.col("s"), F.col("a"), F.col("b")))])
    assert [len(r.issues) for r in q.collect()] == [0, 1, 0]
    good, bad = quality.split_valid(q)
    assert (good.count(), bad.count()) == (2, 1)
    raw = spark.createDataFrame([('{"k":null}',), ('{"k":""}',), ('{"k":1.50}',), ("{}",)], "raw string")
    assert [r[0] for r in raw.select(quality.presence(F.col("raw"), "k")).collect()] == ["null", "empty", "value", "absent"]
    assert [r[0] for r in raw.select(scalars.number_token(F.col("raw"), "k")).collect()] == [None, None, "1.50", None]


def test_scalars(spark):
    r = spark.sql("select 1150 a").select(scalars.reduction_percent(F.lit(1477492400), F.lit(1258525947)).alias("x"), scalars.reduction_percent(F.lit(0), F.lit(5)).alias("n"), scalars.compact(F.lit(1234567)).alias("c"), scalars.signed_percent(F.lit(2.5)).alias("p"), scalars.iso_instant(F.lit("2024-01-01T00:00:00Z")).isNotNull().alias("z"), scalars.iso_instant(F.lit("2024-01-01T00:00:00")).alias("naive")).first()
    assert (round(r.x, 4), r.n, r.c, r.p, r.z, r.naive) == (14.8201, None, "1.23M", "+2.50%", True, None)


OPS = "circuit string, idx long, name string, qubits array<int>, classical_bits array<int>, parameters array<string>"


def circuit(n=50):
    names = [("h", 1), ("cx", 2), ("cx", 2), ("t", 1), ("ccx", 3)]
    out = [(name, [(i + j) % 20 for j in range(k)], [], []) for i in range(n) for name, k in names]
    return out + [("measure", [i], [i], []) for i in range(20)]


def table(spark, **circuits):
    return spark.createDataFrame([(c, i, *op) for c, ops in circuits.items() for i, op in enumerate(ops)], OPS)


def test_fingerprints(spark):
    ops = circuit()
    moved = ops[5:] + ops[:5]
    df = table(spark, a=ops, b=ops, c=moved, d=[("rz", [0], [], ['p"\\'])])
    got = {r.circuit: r.fingerprint for r in canonical.fingerprints(df).collect()}
    assert got["a"] == got["b"] != got["c"]
    assert got["a"] == canonical.reference_fingerprint(20, 20, [(i, *op) for i, op in enumerate(ops)])
    assert got["d"] == canonical.reference_fingerprint(1, 0, [(0, "rz", [0], [], ['p"\\'])])
    assert got == {r.circuit: r.fingerprint for r in canonical.streamed_fingerprints(df).collect()}
    depth = {r.circuit: r.depth for r in canonical.circuit_depth(table(spark, x=[("h", [0], [], []), ("h", [1], [], []), ("cx", [0, 1], [], []), ("measure", [1], [0], [])])).collect()}
    assert depth == {"x": 3}


def test_sketches(spark):
    ops = circuit()
    df = table(spark, a=ops, b=ops[:102] + ops[103:], c=[("x", [i % 7], [], []) for i in range(100)]).withColumn("token", canonical.operation(index=False))
    e = sketch.interactions(df)
    side = lambda t, c: t.where(F.col("circuit") == c)
    one = sketch.weighted_jaccard(side(e, "a"), side(e, "a"), ["a", "b"], "weight").first()[0]
    near = sketch.weighted_jaccard(side(e, "a"), side(e, "b"), ["a", "b"], "weight").first()[0]
    none = sketch.weighted_jaccard(side(e, "c"), side(e, "zz"), ["a", "b"], "weight").first()[0]
    assert one == 1.0 and 0.9 < near < 1.0 and none == 1.0
    h = sketch.histogram(df)
    assert sketch.cosine(side(h, "zz"), side(h, "zz"), ["name"], "n").first()[0] == 1.0
    assert sketch.cosine(side(h, "a"), side(h, "zz"), ["name"], "n").first()[0] == 0.0
    k = sketch.bottom_k(sketch.shingles(df, "token"))
    score = {c: sketch.kmv_jaccard(side(k, "a"), side(k, c)).first()[0] for c in "abc"}
    assert score["a"] == 1.0 > score["b"] > score["c"] == 0.0
    flat = {tuple(r) for r in sketch.shingles(df, "token").distinct().collect()}
    parts = sketch.shingles(sketch.blocks(df, 16, 2), "token", extra=("block",))
    assert {(r.circuit, r.hash) for r in parts.collect()} == flat
    assert parts.count() == sketch.shingles(df, "token").count()
    assert sketch.shingles(sketch.sampled(df, 10, 2), "token", extra=("block",)).count() == 0


def test_qasm(spark):
    text = 'OPENQASM 2.0;\ninclude "x.inc";\nqreg q[2]; qreg r[1];\ncreg c[2];\ngate g a { h a; }\n// cx q[0],q[1];\nh q;\ncx q[0],q[1];\nrz(pi/2) r[0];\nbarrier q;\nmeasure q -> c;\n'
    df = spark.createDataFrame([("p", text), ("bad", "qreg q[1]; h z;")], "path string, source string")
    counts = {(r.path, r.name): r.n for r in readers.qasm_counts(df).collect()}
    assert counts == {("p", "h"): 1, ("p", "cx"): 1, ("p", "rz"): 1, ("p", "barrier"): 1, ("p", "measure"): 1, ("bad", "h"): 1}
    assert {(r.path, r.qubit_count, r.bit_count) for r in readers.qasm_registers(df).collect()} == {("p", 3, 2), ("bad", 1, 0)}
    ops = readers.qasm_operations(df).collect()
    assert [(r.name, r.qubits, r.classical_bits) for r in ops if r.circuit == "p"] == [("h", [0], []), ("h", [1], []), ("cx", [0, 1], []), ("rz", [2], []), ("barrier", [0, 1], []), ("measure", [0], [0]), ("measure", [1], [1])]
    assert [bool(r.error) for r in ops if r.circuit == "bad"] == [True]


def test_files(spark, tmp_path):
    import zstandard

    body = bytes(range(56)) * 3
    path = tmp_path / "ops.bin"
    path.write_bytes(struct.pack(readers.HEADER, b"OPSBIN01", 3) + zstandard.ZstdCompressor().compress(body))
    head = readers.packed_header(spark, str(path)).first()
    assert (head.magic, head.operations) == ("OPSBIN01", 3)
    assert [(r.idx, bytes(r.record)) for r in readers.packed_records(spark, str(path), 2).collect()] == [(i, body[:56]) for i in range(3)]
    expected = spark.createDataFrame([("ops.bin", hashlib.sha256(path.read_bytes()).hexdigest()), ("no", "0")], "name string, sha256 string")
    found, lost = readers.pinned_files(spark, str(path), expected)
    assert (found.count(), [r.name for r in lost.collect()]) == (1, ["no"])
    (tmp_path / "m.json").write_text('{"versions":[{"label":"V1","metrics":{"q":1}},{"label":"V2","metrics":{"q":2}}],"transformation_edges":[{"edge_id":"e","from":"V1","to":"V2","relation":"next"}]}')
    versions, links = readers.manifest(spark, str(tmp_path / "m.json"))
    assert versions.count() == 2 and tuple(links.first()) == ("e", "V1", "V2", "next")
    (tmp_path / "log").write_text("a\x1fb\x1e\nc\x1fd\x1e")
    assert [tuple(r) for r in readers.delimited_log(spark, str(tmp_path / "log"), ["x", "y"]).collect()] == [("a", "b"), ("c", "d")]
    (tmp_path / "api.json").write_text('{"submissions":[{"id":"1","score":1.50},{"id":"2"}]}')
    api = readers.api_body(spark, str(tmp_path / "api.json"), "id string, score double").orderBy("ordinal").collect()
    assert [(r.id, r.score) for r in api] == [("1", 1.5), ("2", None)] and '1.50' in api[0].raw
    writers.write_batch(spark.range(3), str(tmp_path / "out"), ["id"])
    with pytest.raises(writers.Rejected):
        writers.write_batch(spark.range(3).union(spark.range(1)), str(tmp_path / "out2"), ["id"])
    lines = spark.createDataFrame([("f", 1, "# A"), ("f", 2, "x"), ("f", 3, "# B"), ("f", 4, "y")], "f string, n int, text string")
    assert [(r.text, r.heading) for r in readers.headed_lines(lines, ["f"], ["n"], "^# (.*)").orderBy("n").collect()] == [("x", "A"), ("y", "B")]


def test_transitions_without_baseline(spark):
    m = spark.createDataFrame([("a", 0), ("b", 5)], "version_id string, x int")
    v = spark.createDataFrame([("a", "A", "k", "2020"), ("b", None, None, None)], "version_id string, version_label string, external_version_key string, historical_time string")
    r = transitions.list_transitions(edges(spark, [("a", "b"), ("a", "z")]), v, "r", m, "x").collect()
    assert [(x.parent_label, x.absolute_change, x.percentage_change) for x in r] == [("A", 5, None)]


def test_recovery_against_brute_force(spark):
    import random

    r = random.Random(7)
    rows = [(c, i, r.choice([None, *map(float, range(9))]), f"{c}{i}") for c in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, t int, v double, key string")
    want = {}
    for c in ("a", "b", None):
        own = [x for x in rows if x[0] == c and x[2] is not None]
        for i in range(1, len(own)):
            level = own[i - 1][2]
            if own[i][2] > level:
                want[own[i][3]] = next((j - i for j in range(i + 1, len(own)) if own[j][2] < level), None)
    assert {x.key: x.distance for x in sequences.recovery(df, ["c"], ["t"], "v", "key").collect()} == want
    assert sequences.recovery(df.limit(0), ["c"], ["t"], "v", "key").count() == 0


def test_front_against_brute_force(spark):
    import random

    r = random.Random(8)
    rows = [(i, r.choice("xy"), *(r.randint(0, 12) for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, a int, b int, c int")
    better = lambda p, q: all(x <= y for x, y in zip(p, q, strict=True)) and p != q
    for by in ([], ["g"]):
        want = {x[0] for x in rows if not any((not by or y[1] == x[1]) and better(y[2:], x[2:]) for y in rows)}
        assert {x.k for x in pareto.front(df, ["a", "b", "c"], by).collect()} == want


def test_canonical_text_is_ascii_json(spark):
    import json

    texts = ["", "plain", 'quote " and \\ slash', "line\nbreak\t\r\f\b", "\x01\x1f\x7f", "αβγ", "é\u2028", "𝒳 and 🙂", "x\n", "~ !"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(canonical.json_text(F.col("t"))).collect()] == [json.dumps(t) for t in texts]
    ops = [(0, "θ\n", [0, 2], [], ["α=1", 'x"y']), (1, "🙂", [1], [0], [])]
    frame = spark.createDataFrame([("c", *o) for o in ops], "circuit string, idx long, name string, qubits array<int>, classical_bits array<int>, parameters array<string>")
    want = canonical.reference_fingerprint(3, 1, ops)
    assert canonical.fingerprints(frame).first().fingerprint == want == canonical.streamed_fingerprints(frame).first().fingerprint


def test_any_text_is_ascii_json(spark):
    import json

    from hypothesis import strategies as st
    from hypothesis import HealthCheck, given, settings

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
    def check(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical.json_text(F.col("t")).alias("t")).collect()
        assert [r.t for r in sorted(rows)] == [json.dumps(t) for t in texts]

    check()


def test_packed_operations(spark, tmp_path):
    import zstandard

    none = 2**64 - 1
    records = [(8, 0, none, 3, 5, none, none, none), (13, 0, 1, 2, 0, none, 7, none), (1, 0, none, none, none, 4, none, 9)]
    body = b"".join(struct.pack("<IIQQQQQQ", *r) for r in records)
    (tmp_path / "a.bin").write_bytes(struct.pack("<8sQ", b"ANYMAGIC", 3) + zstandard.ZstdCompressor().compress(body))
    found = readers.packed_operations(spark, str(tmp_path / "a.bin"), 2).orderBy("idx").collect()
    assert [(r.idx, r.name, r.qubits, r.classical_bits, r.parameters) for r in found] == [(0, "cx", [3, 5], [], []), (1, "ccx", [1, 2, 0], [], ["c_condition=7"]), (2, "register", [], [4], ["r_target=9"])]
    assert [bytes(r.record) for r in readers.packed_records(spark, str(tmp_path / "a.bin"), 2).orderBy("idx").collect()] == [body[i : i + 56] for i in range(0, 168, 56)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<8sQ", b"ANYMAGIC", 1) + zstandard.ZstdCompressor().compress(struct.pack("<IIQQQQQQ", 99, 0, 0, 0, 0, 0, 0, 0)))
    with pytest.raises(Exception, match="unknown kind 99"):
        readers.packed_operations(spark, str(tmp_path / "b.bin")).collect()


def test_evaluation_records(spark):
    import json

    uuid, sha = "0123abcd-0000-4000-8000-0123456789ab", "a" * 40
    good = {"id": uuid, "benchmarkId": "b", "status": "accepted", "promotionStatus": None, "officialMetrics": {"qubits": 3, "toffoli": 7}, "officialScore": 21, "createdAt": "2024-01-02T03:04:05Z", "updatedAt": "2024-01-02T03:04:05.678Z", "submissionCommitSha": sha}
    other = lambda i, **x: good | {"id": uuid[:-2] + f"{i:02d}"} | x
    cases = [
        (good, []),
        (["x"], ["not_an_object"]),
        (other(1, id="zz"), ["bad_submission_uuid"]),
        (other(2, benchmarkId="c"), ["benchmark_mismatch"]),
        (other(3, status="open", promotionStatus="maybe"), ["unknown_platform_status", "unknown_promotion_status"]),
        (other(4, officialMetrics="7", officialScore=None), ["bad_official_metrics"]),
        (other(5, officialMetrics={"qubits": 3, "toffoli": 7, "depth": 1}), ["unexpected_metric_keys"]),
        (other(6, officialScore=None), ["partial_metric_triple"]),
        (other(7, officialMetrics={"qubits": "3", "toffoli": 7}), ["bad_metric_value"]),
        (other(8, officialScore=22), ["score_mismatch"]),
        (other(9, createdAt="soon"), ["bad_timestamp"]),
        (other(10, submissionCommitSha="short", promotedSourceRef=5), ["bad_commit_sha"]),
        (other(11, officialMetrics=None, officialScore=None), []),
        (other(12), ["duplicate_submission_uuid"]),
        (other(12, officialScore=0), ["score_mismatch", "duplicate_submission_uuid"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "ordinal int, raw string")
    got = {r.ordinal: r.issues for r in quality.evaluation_issues(df, "b").collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]
    person = {"id": uuid, "solverAccountId": "7", "solverUsername": "a-b", "coauthors": ["x"]}
    people = [(person, []), (person | {"id": "zz", "solverUsername": "-a"}, ["bad_submission_uuid", "bad_solver_username"]), (5, ["not_an_object"])]
    people += [(person | {"id": uuid[:-2] + f"{i:02d}", "coauthors": c, "solverAccountId": a}, w) for i, (c, a, w) in enumerate([([], "7", []), (None, "7", []), ([None], "7", ["bad_coauthors"]), (["x", 1], " ", ["missing_solver_account_id", "bad_coauthors"]), ("x", 7, ["missing_solver_account_id", "bad_coauthors"])])]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(people)], "ordinal int, raw string")
    assert [r.issues for r in quality.contributor_issues(df).orderBy("ordinal").collect()] == [w for _, w in people]
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("m", 3, "b"), ("m", 4, "c")], "key string, at int, v string")
    once, conflicts = quality.identical_once(rows, ["key"], "at")
    assert [(r.key, r.at) for r in once.collect()] == [("k", 1)] and conflicts.count() == 2


def test_history(spark):
    ids = spark.createDataFrame([("i1", "Ann", "7", "annie"), ("i2", "ann", "8", None), ("i3", "bob", "9", "robert")], "identity string, handle string, account string, alias string")
    found = lambda ref: {(r.identity, r.tier) for r in history.resolve_contributor(ids, ref).collect()}
    assert found("@Ann") == {("i1", 2)} and found("ANN") == {("i1", 3), ("i2", 3)} and found("9") == {("i3", 4)} and found("Robert") == {("i3", 5)} and not found("x")
    mails = spark.createDataFrame([("12+Foo@users.noreply.host.com",), ("12+foo@users.noreply.host.com",), ("13+bar@users.noreply.host.com",), ("14+bar@users.noreply.host.com",), ("a@b.c",)], "mail string")
    assert [tuple(r) for r in history.mail_aliases(mails, "mail").select("account", "login").collect()] == [("12", "foo")]
    v = spark.createDataFrame([(1, 5, 5), (2, None, None), (3, 99, 1), (4, 1, 99), (5, 1, 1), (6, 1, 1)], "k int, bytes long, operations long")
    states = history.extraction_states(v, v.where("k = 1").select("k"), v.where("k = 6").select("k"), "k", 10, 10)
    assert {r.k: r.state for r in states.collect()} == {1: "done", 2: "no_artifact", 3: "too_large", 4: "too_long", 5: "todo", 6: "failed_before"}
    c = spark.createDataFrame([(-1, 1), (-1, 0), (1, 0), (0, 0), (None, 1)], "a int, b int")
    assert [r[0] for r in c.select(history.trade_off([F.col("a"), F.col("b")])).collect()] == ["mixed", "improved", "worse", "same", "unknown"]


def test_bounded_summaries(spark):
    import collections
    import random

    r = random.Random(1)
    items = [str(min(int(r.expovariate(0.3)), 40)) for _ in range(3000)]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(items)], "circuit string, idx long, item string")
    true, kept = collections.Counter(items), sketch.space_saving(df, "item", 12).collect()
    assert len(kept) == 12 and all(k.weight - k.error <= true[k["item"]] <= k.weight for k in kept)
    assert {x for x, n in true.items() if n > 3000 / 12} <= {k["item"] for k in kept}
    sample = [x["item"] for x in sketch.reservoir(df, "item", 5, seed=3).collect()]
    assert len(set(sample)) == 5 and sample == [x["item"] for x in sketch.reservoir(df.repartition(3), "item", 5, seed=3).collect()]
    with pytest.raises(ValueError):
        sketch.require_compatible({"width": 3, "size": 128}, {"width": 3, "size": 64})


def test_parameters_and_catalogs(spark, tmp_path):
    df = table(spark, a=[("rz", [0], [], ["0.1", "pi"])], b=[("rz", [0], [], ["0.10000000000000002", "pi"])])
    prints = lambda ops: {r.circuit: r.fingerprint for r in canonical.fingerprints(ops).collect()}
    assert len(set(prints(canonical.rounded_parameters(df)).values())) == 1
    assert len(set(prints(canonical.exact_parameters(df)).values())) == 2
    assert canonical.exact_parameters(df).where("circuit = 'a'").first().parameters == [0.1.hex(), "pi"]
    (tmp_path / "a.json").write_text('{"circuit_id":"a","metrics":{"depth":3,"gate_histogram":{"h":1}}}')
    (tmp_path / "b.json").write_text('{"circuit_id":"b",\n"metrics":{"gate_histogram":{"cx":2}}}')
    assert {tuple(r) for r in readers.gate_histogram(readers.catalog(spark, str(tmp_path))).collect()} == {("a", "h", 1), ("b", "cx", 2)}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "d.json").write_text('{"circuits":[{"source_id":1,"name":"n","baseline":[9,9],"runs":[{"order":"A","run_id":1,"status":"OK","verified":true,"final":[5,5],"steps":[[7,7],[5,5]]},{"order":"B","run_id":1,"status":"OK","verified":true,"final":[5,6],"steps":[[5,5]]}]}]}')
    runs = readers.optimization_runs(spark, str(tmp_path / "runs"))
    assert {r.rule: r.violations for r in readers.optimization_problems(runs).collect()} == {"duplicate_run": 1, "last_step_is_final": 1, "duplicate_order": 0}
    assert readers.optimization_steps(runs).count() == 3


def test_prefixes_with_cues(spark):
    refs = spark.createDataFrame([("ab12", None), ("1234", None), ("1234", True), ("x-9", None), ("gold", None)], "ref string, cue boolean")
    spaces = {"commit": spark.createDataFrame([("ab12cd", "v1"), ("123456", "v2")], "name string, entity string"), "label": spark.createDataFrame([("golden", "v3"), ("x-9", "v4")], "name string, entity string")}
    found = lambda r, **k: {(x.ref, x.status, x.entity) for x in resolve.namespaces(r, spaces, **k).collect()}
    plain = refs.where("cue is null")
    assert found(plain, hexadecimal=["commit"]) == {("ab12", "RESOLVED", "v1"), ("1234", "UNKNOWN", None), ("x-9", "RESOLVED", "v4"), ("gold", "UNKNOWN", None)}
    assert ("1234", "RESOLVED", "v2") in found(refs.where("ref = '1234' and cue"), hexadecimal=["commit"], cue="cue")


def test_prefixes_without_pairs(spark):
    names = {"n": [(f"name{i % 90}é{i}", f"e{i % 7}" if i % 3 else "e0") for i in range(300)] + [("name1", None), ("name2", "e1"), (None, "e2"), ("nam", "e3")], "m": [("name3é33", "e0"), ("name4", "e4"), ("nobody", None)]}
    refs = sorted({v[:n] for rows in names.values() for v, _ in rows if v for n in (0, 3, 4, 6, 7, 20)} | {"name9999", "x"}) + [None, "name1"]
    want = set()
    for ref in {*refs}:
        hits = [(1 if v == ref else 2, e, s) for s, rows in names.items() for v, e in rows if ref is not None and v and v.startswith(ref) and (v == ref or len(ref) >= 4)]
        tier = min((t for t, *_ in hits), default=0)
        entities = {e for t, e, _ in hits if t == tier and e}
        status = "UNKNOWN" if not entities else "RESOLVED" if len(entities) == 1 else "AMBIGUOUS"
        want.add((ref, status, min(entities) if len(entities) == 1 else None, tier, ",".join(sorted({s for t, _, s in hits if t == tier}))))
    spaces = {s: spark.createDataFrame(rows, "name string, entity string") for s, rows in names.items()}
    found = resolve.namespaces(spark.createDataFrame([(r,) for r in refs], "ref string"), spaces)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "StartsWith" in line]


def test_ways_and_statuses(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("b", "c"), ("d", "a"), ("a", "z")])
    assert {tuple(r.path) for r in graph.paths(e, "a", "d", 3).collect()} == {("a", "b", "d"), ("a", "c", "d"), ("a", "b", "c", "d")}
    assert {tuple(r.path) for r in graph.paths(e, "a", "d", 2).collect()} == {("a", "b", "d"), ("a", "c", "d")}
    old = spark.createDataFrame([(1, "open"), (2, "done")], "k int, status string")
    new = spark.createDataFrame([(1, "done"), (2, "open"), (3, "open")], "k int, status string")
    assert [r.k for r in latest.status_conflicts(old, new, ["k"], [("open", "done")]).collect()] == [2]


def test_stores_of_contents(spark, tmp_path):
    files = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    path = str(tmp_path / "store")
    assert writers.put_contents(files, path).count() == 2 and writers.put_contents(files, path).count() == 0
    assert spark.read.parquet(path).count() == 2 and writers.damaged_contents(spark, path).count() == 0
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.write_batch(spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string"), str(tmp_path / "new"), ["k"], store=store)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "new")).collect()] == [(3, "c")]
    with pytest.raises(writers.Rejected):
        writers.write_batch(spark.createDataFrame([(1, "z")], "k int, v string"), str(tmp_path / "bad"), ["k"], store=store)
    writers.version_records(spark.createDataFrame([("c", "v1", None), ("d", "v2", "L")], "logical_circuit_id string, version_id string, version_label string"), str(tmp_path / "records"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "records" / "*" / "*.txt")).collect()) == ['{"logical_circuit_id":"c","version_id":"v1"}', '{"logical_circuit_id":"d","version_id":"v2","version_label":"L"}']


def test_more_sources_and_scalars(spark, tmp_path):
    (tmp_path / "bom.json").write_bytes(b"\xef\xbb\xbf" + b'{"versions":[{"label":"V1"}],"transformation_edges":[{"edge_id":"e","from":"V1","to":"V2","relation":"r"}]}')
    assert readers.manifest(spark, str(tmp_path / "bom.json"))[0].first().label == "V1"
    (tmp_path / "side").mkdir()
    for name, text in (("a", "x"), ("b", "y"), ("c", "z")):
        (tmp_path / "side" / name).write_text(text)
        if name != "c":
            (tmp_path / "side" / f"{name}.sha256").write_text(hashlib.sha256(b"x").hexdigest().upper() + f"  {name}")
    assert [r.path.rsplit("/", 1)[1] for r in readers.sidecar_mismatches(spark, str(tmp_path / "side")).collect()] == ["b"]
    log = spark.createDataFrame([("1", "Title\n\nBody: no\nmore\n\nCo-authored-by: A <a@b>\nReviewed-by: B\n"), ("2", None)], "sha string, message string")
    assert {tuple(r) for r in readers.trailers(log, "sha", "message").collect()} == {("1", "Co-authored-by", "A <a@b>"), ("1", "Reviewed-by", "B")}
    texts = ["", "abc", "θ"]
    hashes = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(canonical.blake2b64(F.col("t"))).collect()
    assert [r[0] for r in hashes] == [*(hashlib.blake2b(t.encode(), digest_size=8).hexdigest() for t in texts), None]
    x = spark.createDataFrame([(1234567, -2), (12, 0), (None, None)], "a long, b int").select(scalars.thousands(F.col("a")), scalars.arrow(F.col("b")), scalars.preview(F.lit("abcdef"), 3))
    assert [tuple(r) for r in x.collect()] == [("1,234,567", "\u2193", "abc\u2026"), ("12", "\u2192", "abc\u2026"), (None, None, "abc\u2026")]
    ops = spark.createDataFrame([("c", 0, "h", [2], [0], [])], "circuit string, idx long, name string, qubits array<int>, classical_bits array<int>, parameters array<string>")
    assert canonical.summary(ops).select("qubit_count", "classical_bit_count", "operation_count").first() == (3, 1, 1)
    before, after = (spark.createDataFrame(r, "k int, x int") for r in ([(1, 5), (2, 6)], [(1, 3)]))
    assert {tuple(r) for r in history.overview(before, after, "k", ["x"]).collect()} == {(1, 5, 3, -2), (2, 6, None, None)}
