import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.llm import chat_threads, mixing, url_cascade
from quillon.llm.store import cut

DOCS = "doc_id long, text string, source string"


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", None, "Z", "é"][i % 5 if i % 3 else 0]) for i in range(90)] + [(5, "w", "a"), (5, "w", "a"), (200, None, "a"), (None, "x y", "b"), (201, "", "empty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", target int").withColumn("key", F.lit("k"))
    got = mixing.mix(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert len(got) == len(rows) and sum(size.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted((s for s in size if s is not None)) + [None])}
    want = {s: 0.0 for s in size}
    left, open_ = 1.5 * sum(size.values()), {s for s in size if size[s]}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in full or open_:
            want[s] = 2 * size[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_keep_their_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rows = [(i, "w " * (i % 11) if i % 13 else None, ["a", "b", None, "c"][i % 4 if i % 3 else 0]) for i in range(150)] + [(None, "x y z", "d") for _ in range(40)]
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], DOCS + ", size int, taken string")
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
    want = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect() if r.doc_id is not None}
    rows = got.collect()
    assert {r.doc_id: (r["size_"], r.source_size, r.target, r["taken_"]) for r in rows if r.doc_id is not None} == want and len(rows) == docs.count()
    tied = [r for r in rows if r.doc_id is None]
    assert len({r["taken_"] for r in tied}) == 1 and 0 <= int(tied[0].target) - sum(r["taken_"] for r in tied) < len(tied)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    keys = cut(keys)
    levels = url_cascade.cascade(keys)
    assert len(levels) > 1
    assert keys.where(url_cascade.listed(F.col("key"), levels) != F.col("listed")).count() == 0
    assert url_cascade.cascade(keys.where("not listed")) == []
    all_listed = keys.where("listed")
    assert all_listed.where(~url_cascade.listed(F.col("key"), url_cascade.cascade(all_listed))).count() == 0


def test_urls(spark, monkeypatch):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/", "HTTP://spam-farm.net?x", "ftp://spamfarm.net#y", "no url", None, "://", "http://org/", "http://my.casino.net/a", "http://x.net/a\n/b", "http://cheap-pills.com/fr/", "http://x.com/de/", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(urls)] + [(None, "http://x.org/", None, None)], "page_id long, url string, html string, host string")
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de", None, "allow"), ("x.com", "/de/", "com/de/", "block"), ("spam-farm.net", "", None, "block"), ("spamfarm.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/", "org/", "allow"), ("my.casino.net", "/a", None, "block"), ("x.net", "/a\n/b", None, "allow"), ("cheap-pills.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("notexample.org", "/es/", "org/", "allow")]
    got = {r.page_id: tuple(r)[1:] for r in url_cascade.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == want and got[None] == ("x.org", "/", "org/", "allow")
    assert url_cascade.judge(pages.limit(0)).count() == 0
    monkeypatch.setattr(url_cascade, "MOST_BITS", 1)  # the way for lists above the bound
    assert {r.page_id: tuple(r)[1:] for r in url_cascade.judge(pages).collect()} == got


def test_key_table(spark, monkeypatch):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.format_string("http://n%d.site%d.net/%d", F.col("id") % 3000, F.col("id") % 7, "id").alias("url"), F.lit("x").alias("key"))
    keys = spark.range(0, 9000, 3).select(F.format_string("N%d.site%d.net", "id", F.col("id") % 5).alias("key"), F.lit(0).alias("listed"))
    keys = keys.union(keys.limit(50)).union(spark.createDataFrame([(None, 1), ("", 1)], "key string, listed int"))
    known = {r.key.lower() for r in keys.collect() if r.key}
    got = url_cascade.judge(pages, keys=keys).collect()
    want = {r.page_id: "block" if r.host in known else "allow" for r in got}
    assert len(got) == 6000 and {r.page_id: r.verdict for r in got} == want and 100 < sum(v == "block" for v in want.values()) < 3000
    assert {r.verdict for r in url_cascade.judge(pages, keys=keys.limit(0)).collect()} == {"allow"}
    monkeypatch.setattr(url_cascade, "MOST_BITS", 64)
    assert {r.page_id: r.verdict for r in url_cascade.judge(pages, keys=keys).collect()} == want


def test_hot_and_equal_keys_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rows = [(None, "w " * (i % 3), "hot") for i in range(200)] + [(7, "a b", "hot") for _ in range(50)] + [(i, "x " * 400, "long") for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.mix(docs.orderBy(F.rand(3)).repartition(3)).collect(), key=str)
    hot = [r for r in got if r.source == "hot"]
    assert sum(r.taken for r in hot) == int(hot[0].target + 1e-9) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    many = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 400}") for i in range(1200)], DOCS)
    mixed = mixing.mix(many).collect()
    targets = {r.source: r.target for r in mixed}
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in mixed)) < 1e-6 and len(targets) == 400


def test_threads(spark):
    rows = [
        (1, 0, "user", "Hello there\nmy friend"),
        (1, 1, "assistant", "> Hello   THERE\nHi!"),
        (1, 2, "user", "  other, unquoted  "),
        (1, 3, "user", ">> Hello there\n> Hi!\nthanks"),
        (1, 4, "user", "> other, unquoted\n> nowhere\nyes"),
        (1, 5, "user", "> thanks"),
        (2, 0, "user", "> Hello there\nfirst"),
        (2, 1, "user", "Hello there"),
        (3, 7, "user", None),
        (3, 7, "user", ""),
        (None, 1, "user", "> Hello there"),
        (3, None, None, "x"),
    ]
    got = chat_threads.reply_ordered(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, thread int")).collect()
    first = [(r.turn, r.text, r.reply_to, r.thread, r.quotes) for r in got if r.conv_id == 1]
    assert first == [(0, "Hello there\nmy friend", None, 0, 0), (1, "Hi!", 0, 0, 1), (3, "thanks", 1, 0, 2), (5, "", 3, 0, 1), (2, "  other, unquoted  ", None, 2, 0), (4, "yes", 2, 2, 1)]
    assert [(r.turn, r.reply_to) for r in got if r.conv_id == 2] == [(0, None), (1, None)]
    assert len(got) == len(rows) and sum(r.conv_id is None for r in got) == 1
    assert chat_threads.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_threads(rows):
    """Reply order of each message, written out: conv_id, turn, own text, reply_to, thread, quotes."""
    normal = lambda t: " ".join(t.lower().split())
    mark = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
    level = lambda line: (m := mark.match(line)) and m[1].count(">") or 0
    first, split = {}, []
    for conv, turn, _, text in rows:
        lines = re.split("\r?\n", text or "")
        quoted = any(level(x) for x in lines)
        own = "\n".join(x for x in lines if not level(x)).strip(" ") if quoted else text or ""
        split.append((conv, turn, own, lines))
        for t in {normal(own), *map(normal, own.split("\n"))} - {""}:
            first[conv, t] = min(first.get((conv, t), turn), turn)
    reply = {}
    for conv, turn, _, lines in split:
        runs, last = [], 0
        for x in lines:
            now = level(x)
            if now and now == last:
                runs[-1][1].append(mark.sub("", x, count=1))
            elif now:
                runs.append((now, [mark.sub("", x, count=1)]))
            last = now
        found = []
        for depth, body in runs:
            for t in {normal("\n".join(body)), *map(normal, body)} - {""}:
                if first.get((conv, t), turn) < turn:
                    found.append((depth, first[conv, t], t))
        if found:
            least = min(d for d, _, _ in found)
            reply[conv, turn] = max(o for d, o, _ in found if d == least), len({t for _, _, t in found})
    out = []
    for conv, turn, own, _ in split:
        root = turn
        while (conv, root) in reply:
            root = reply[conv, root][0]
        out.append((conv, root, turn, own, *reply.get((conv, turn), (None, 0))))
    return sorted(out, key=lambda x: x[:3])


def test_threads_against_brute_force(spark):
    r = random.Random(11)
    said, rows = {}, []
    for conv in range(12):
        for turn in range(r.choice((1, 4, 15, 40))):
            lines = [" ".join(r.choice(("yes", "No", "maybe", "so", "it", "IS")) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 3))]
            for _ in range(r.randint(0, 3)):
                old = r.choice(said.get(conv, ["never said"])).split("\n")
                depth = r.choice((">", "> ", ">>", "> > "))
                lines[:0] = [depth + (x.upper() if r.random() < 0.2 else x) for x in (old if r.random() < 0.5 else old[:1])]
            text = "\n".join(lines)
            said.setdefault(conv, []).append(text)
            rows.append((conv, turn, "user", text if r.random() < 0.95 else r.choice((None, ""))))
    rows.append((99, 0, "user", "long " * 60_000))
    rows.append((99, 1, "user", "> " + "long " * 60_000 + "\nhere"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(g.conv_id, g.thread, g.turn, g.text, g.reply_to, g.quotes) for g in chat_threads.reply_ordered(df).collect()]
    assert got == brute_threads(rows) and sum(g[4] is not None for g in got) > 40
