import math
import random
import re
from collections import Counter

import numpy as np

from quillon.llm import decontaminate, license_scan, multiprobe_ann
from quillon.llm.textkern import seeded


def brute_neighbours(rows, queries, top):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    asked = [(i, np.array(v, dtype=float)) for i, v in queries]
    out = {}
    for q, x in asked:
        found = sorted((-(v * x).sum(), i) for i, v in good if i != q)
        best = {}
        for s, i in found:
            best.setdefault(i, s)
        out[q] = [(i, -s) for i, s in sorted(best.items(), key=lambda p: (p[1], p[0]))[:top]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (None, [1.0] * 8), (2004, [float("inf")] * 8)]
    df = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<float>, label int")
    queries = df.where("vec_id % 20 = 0 and vec_id < 2000")
    got = multiprobe_ann.neighbours(df, queries, 20).collect()
    want = brute_neighbours(rows, [(i, v) for i, v in rows if i is not None and i % 20 == 0 and i < 2000], 20)
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(by) == set(want)
    hits = sum(len({v for _, v, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert [(s, v) for _, v, s in found] == sorted(((s, v) for _, v, s in found), key=lambda p: (-p[0], p[1]))
    copies = sorted(by[1000])[:20]
    assert [v for _, v, _ in copies] == [0, *range(1001, 1020)]


def recall(spark, x, top=20):
    """Recall of 20 nearest and the share of entries in visited buckets, over every 20th vector."""
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for g in multiprobe_ann.neighbours(df, df.where("vec_id % 20 = 0"), top).collect():
        by.setdefault(g.query_id, set()).add(g.vec_id)
    hits = 0
    for k in range(0, len(x), 20):
        score = x @ x[k]
        hits += len(by[k] & {int(i) for i in np.lexsort((np.arange(len(x)), -score)) if i != k and (score > score[i]).sum() <= top})
    model = multiprobe_ann.fit(multiprobe_ann.usable(df), len(x), top)
    visited = []
    buckets = [model.buckets(x, t) for t in range(multiprobe_ann.TABLES)]
    for k in range(0, len(x), 20):
        seen = np.zeros(len(x), dtype=bool)
        for t, own in enumerate(buckets):
            code, chance = model.probes(x[k : k + 1], t)
            assert (np.diff(chance[0]) <= 0).all()
            seen |= np.isin(own, code[0][chance[0] > 0])
        visited.append(seen.mean())
    return hits / (top * len(by)), float(np.mean(visited))


def test_recall_on_noise_and_on_clusters(spark, monkeypatch):
    r = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(spark, unit(r.standard_normal((2400, 32))))[0] >= 0.9
    centres = unit(r.standard_normal((60, 32)))
    near = unit(centres[r.integers(0, 60, 4000)] + 0.08 * r.standard_normal((4000, 32)))
    found, visited = recall(spark, near)
    assert found >= 0.9 and visited < 0.4
    monkeypatch.setattr(multiprobe_ann, "CELL_ENTRIES", 50)  # hot buckets are dealt over cells
    monkeypatch.setattr(multiprobe_ann, "CELL_PROBES", 7)
    assert recall(spark, near[:1500])[0] >= 0.9


def test_small_tables_are_searched_whole(spark):
    r = np.random.default_rng(2)
    for n in (2, 6, 30, 60):
        x = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((n, 6)))]
        df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
        got = multiprobe_ann.neighbours(df, df.where("vec_id % 20 = 0")).groupBy("query_id").count().collect()
        assert {g["count"] for g in got} == {min(20, n - 1)} and len(got) == -(-n // 20)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in multiprobe_ann.neighbours(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert multiprobe_ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_vectors_of_other_lengths(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((60, 8)).astype(np.float32))]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>")
    found = lambda x: sorted(map(tuple, multiprobe_ann.neighbours(frame(x), frame(x).where("vec_id % 5 = 0"), 5).collect()))
    others = [(100, [9.0] * 9), (105, [50.0] * 12), (110, [1.0] * 3), (115, [2.0])]
    want = found(rows)
    assert len(want) == 60 and found(rows + others) == want
    assert found([*rows, others[0]]) == want and found([*rows, others[2]]) == want


def test_block_max_wand_finds_all():
    r = random.Random(2)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randint(3, 14)))) for i in range(90)]
    index = decontaminate.Index(items)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 25)))
        score = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                score[d] = score.get(d, 0) + x
        for least in (0.2, 0.5):
            want = {d for d, s in score.items() if s >= least + 1e-9}
            got = {d for d, _ in index.search(terms, least)}
            assert want <= got and all(score[d] >= least - 1e-9 for d in got)


def test_leaks(spark, frame):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(20)).capitalize() + ". " + " ".join(word() for _ in range(9)).capitalize() + ".") for i in range(30)]
    filler = [word() for _ in range(3000)]
    rows, want = [], set()
    for i in range(60):
        w = [r.choice(filler) for _ in range(r.choice((10, 150, 700)))]
        if i % 2:
            item = r.choice(items)
            at = r.randrange(len(w))
            w[at:at] = item[1].upper().split() if i % 4 == 1 else item[1].split()
            want.add((i, item[0]))
        rows.append((i, " ".join(w)))
    question_only = items[0][1].split(". ")[0]
    rows += [(100, question_only + " and " + " ".join(filler[:40])), (101, None), (102, ""), (None, "clean words"), (103, items[1][1]), (103, items[1][1])]
    want |= {(103, 1)}
    benchmark = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    got = decontaminate.contaminated(frame(rows), benchmark).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want
    kept = decontaminate.remove_contaminated(frame(rows), benchmark)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(frame(rows), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(frame([]), benchmark).count() == 0


def brute_leaks(rows, items, least, overlap):
    """Straight from the definitions: every passage against every item."""
    d = decontaminate
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    texts = {t: split(t) for _, t in items if split(t)}
    held = Counter(w for x in texts.values() for w in set(x))
    mean = sum(map(len, texts.values())) / max(1, len(texts))
    grams = lambda x: [tuple(x[i : i + min(3, len(x))]) for i in range(len(x) - min(3, len(x)) + 1)] if x else []
    known = {}
    for t, x in texts.items():
        raw = {w: math.log(1 + (len(texts) - held[w] + 0.5) / (held[w] + 0.5)) * n * (d.K1 + 1) / (n + d.K1 * (1 - d.B + d.B * len(x) / mean)) for w, n in Counter(x).items()}
        sentences = [y for y in re.split(r"(?<=[.?!])\s+", t.strip()) if split(y)]
        parts = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (t, t)
        half = d.HALF_WORDS
        while half < len(x):
            half *= 2
        known[t] = ({w: v / sum(raw.values()) for w, v in raw.items()}, half, [grams(split(y)) for y in parts])
    out = set()
    for doc_id, text in rows:
        x = split(text)
        for item, t in set(items):
            if t not in known:
                continue
            impact, half, parts = known[t]
            best = None
            for start in range(0, len(x), half):
                score = sum(impact.get(w, 0) for w in set(x[start : start + 2 * half]))
                if score >= least:
                    own = x[max(0, start - half) : start + 3 * half]
                    near = {tuple(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
                    q, a = (sum(g in near for g in y) / max(1, len(y)) for y in parts)
                    if q >= overlap and a >= overlap and (best is None or (score, -start) > best[:2]):
                        best = (score, -start, q, a)
            if best:
                out.add((doc_id, item, round(best[0], 9), best[2], best[3], -best[1], 2 * half))
    return out


def test_partial_leaks_against_brute_force(spark, frame, monkeypatch):
    r = random.Random(6)
    pool = ["".join(r.choice("bcdfgaeiou") for _ in range(5)) for _ in range(150)]
    common = lambda n: " ".join(pool[min(int(r.expovariate(0.03)), 149)] for _ in range(n))
    items = [(i, common(r.choice((4, 8, 20))) + ". " + common(r.choice((2, 4, 10, 70)))) for i in range(60)]
    rows = []
    for i in range(150):  # leaks with a share of their words replaced, in texts of some passages
        w, lost = r.choice(items)[1].split(), r.choice((0.0, 0.1, 0.25, 0.4, 0.6))
        w = [pool[r.randrange(150)] if r.random() < lost else x for x in w]
        at = r.choice((0, 30, 100, 250))
        rows.append((i, " ".join([r.choice(pool) for _ in range(at)] + w + [r.choice(pool) for _ in range(at)])))
    items += [(60, ""), (61, " .. "), (62, None), (None, items[3][1]), (63, items[5][1]), (5, items[5][1])]
    rows += [(200, None), (201, ""), (None, items[0][1]), (0, rows[0][1])]
    frame_of = lambda x: spark.createDataFrame([(*y, 1, "x") for y in x], "item_id long, text string, key int, shard string")
    found = lambda x, least: {(g.doc_id, g.item_id, round(g.score, 9), g.question_overlap, g.answer_overlap, g.first_word, g.passage_words) for g in decontaminate.contaminated(frame(rows), frame_of(x), least, 0.2).collect()}
    for least in (0.35, 0.5, 0.8):
        want = brute_leaks(rows, items, least, 0.2)
        assert found(items, least) == want and len({x[2] for x in want}) > 20
    kept = {x.doc_id for x in decontaminate.remove_contaminated(frame(rows), frame_of(items), 0.5, 0.2).collect()}
    want = brute_leaks(rows, items, 0.5, 0.2)
    assert kept == {i for i, _ in rows} - {x[0] for x in want} and 0 < len(kept) < len(rows)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1000)  # many broadcasts, the same result
    assert found(items, 0.5) == want
    assert {x.doc_id for x in decontaminate.remove_contaminated(frame(rows), frame_of(items), 0.5, 0.2).collect()} == kept
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1 << 20)
    long = [*items, (99, " ".join(f"long{i}" for i in range(4000)))]  # leaves the other items' passages alone
    assert {(x[:2], x[5:]) for x in found(long, 0.5)} == {(x[:2], x[5:]) for x in brute_leaks(rows, long, 0.5, 0.2)} and {x[6] for x in found(long, 0.5)} == {x[6] for x in want}


def test_licences(frame):
    mit = license_scan.TEMPLATES[0][1]
    rows = [(1, "x All Rights, RESERVED. cc by cc-by General Public-License"), (2, f"head {mit} tail"), (3, None), (4, ""), (None, "cc by"), (5, "the software is here"), (6, "licensed under the MIT license"), (7, "all rights all rights reserved"), (7, "all rights all rights reserved")]
    got = {r.doc_id: r for r in license_scan.scan(frame(rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (11, 4, 1, 8, "cc-by,gpl,reserved")
    assert (got[2].labels, got[2].base_labels, got[2].n_base, got[2].first_word) == ("mit", "", 0, None) and got[2].score > 0.9
    assert (got[3].n_words, got[3].score, got[4].labels) == (0, 0.0, "") and got[None].n_base == 1
    assert (got[5].labels, got[6].labels, got[7].n_base, got[7].first_word) == ("", "mit", 1, 2)


def test_licences_inside_longer_matches(frame):
    notice = "Licensed under the Apache License, Version 2.0"
    share_alike = license_scan.TEMPLATES[17][1]
    rows = [(1, f"{notice}."), (2, f'{notice} (the "License");'), (3, share_alike), (4, license_scan.TEMPLATES[13][1]), (5, "under the Apache License of old")]
    got = {r.doc_id: r for r in license_scan.scan(frame(rows)).collect()}
    assert (got[1].labels, got[1].score, got[1].template_words) == ("apache", 1.0, 8)
    assert (got[2].labels, got[2].score) == ("apache", 1.0)
    assert got[3].labels == "cc-by-sa" and got[4].labels == "agpl,gpl" and got[5].labels == ""


def brute_scan(text):
    """Places of the base phrases and the best chain of every template, straight from the definitions."""
    s = license_scan
    x = license_scan.words_of(text or "")
    places = [(i, label) for phrase, label in s.PHRASES for i in range(len(x)) if x[i : i + len(phrase.split())] == phrase.split()]
    known = [license_scan.words_of(t) for _, t in s.TEMPLATES] + [p.split() for p, _ in s.PHRASES]
    inside = lambda run, t: next((j for j in range(len(t) - len(run) + 1) if t[j : j + len(run)] == run), None)
    longest = []  # for each end the longest run that stands in a template or phrase
    for end in range(1, len(x) + 1):
        n = 0
        while n < end and any(inside(x[end - n - 1 : end], t) is not None for t in known):
            n += 1
        longest.append(n)
    matches = [(end - n, n) for end, n in enumerate(longest, 1) if n >= s.LEAST and (end == len(x) or longest[end] <= n)]
    best, chains = {}, []
    for m, (at, n) in enumerate(matches):
        fresh = []
        for t, words in enumerate(known[: len(s.TEMPLATES)]):
            if inside(x[at : at + n], words) is not None:
                runs = [(at, n)]
            else:  # its own longest runs within the match
                ends = [max((k for k in range(e - at + 1) if inside(x[e - k : e], words) is not None), default=0) for e in range(at, at + n + 1)]
                runs = [(at + i - k, k) for i, k in enumerate(ends) if k >= s.LEAST and (i == n or ends[i + 1] <= k)]
            for start, k in runs:
                offsets = [j + k for j in range(len(words) - k + 1) if words[j : j + k] == x[start : start + k]]
                fresh.append((t, start, k, offsets))
        best_of = {}
        for t, start, k, offsets in fresh:
            had = max((c for u, text_end, template_end, c, match in chains if u == t and match < m and text_end <= start and start - text_end <= s.GAP and any(0 <= o - k - template_end <= s.GAP for o in offsets)), default=0)
            best[t] = max(best.get(t, 0), min(1.0, (had + k) / len(known[t])))
            best_of[t, start, k] = [(t, start + k, o, had + k, m) for o in offsets[:1]]
        chains += [c for own in best_of.values() for c in own]
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    more = {s.TEMPLATES[t][0] for t, share in best.items() if share >= s.COVERED}
    return len(x), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def test_scan_against_brute_force(frame):
    r = random.Random(12)
    filler = ["the", "software", "is", "license", "general", "public", "cc", "by", "all", "rights", "reserved", "word", "é", "4"]
    rows = [(0, None), (1, ""), (2, "cc by cc BY all rights reserved")]
    for i in range(3, 90):
        own = r.choice(license_scan.TEMPLATES)[1].split()
        a = r.randrange(len(own))
        cut = own[a : a + r.randint(2, len(own))] if i % 3 else list(own)
        if i % 4 == 0 and len(cut) > 6:  # a hole in the middle
            del cut[len(cut) // 2 : len(cut) // 2 + r.randint(1, 3)]
        rows.append((i, " ".join([r.choice(filler) for _ in range(r.randint(0, 9))] + cut + [r.choice(filler) for _ in range(r.randint(0, 9))])))
    got = {g.doc_id: (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) for g in license_scan.scan(frame(rows)).collect()}
    for i, t in rows:
        want = brute_scan(t)
        assert got[i][:5] == want[:5] and got[i][5] == want[5], (i, t, got[i], want)


def test_automaton_statistics():
    r = random.Random(8)
    texts = [[r.randrange(4) for _ in range(r.randint(2, 15))] for _ in range(12)]
    a = license_scan.Automaton(texts)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(40):
        query = [r.randrange(5) for _ in range(30)]
        state = length = 0
        for i, token in enumerate(query):
            state, length = a.step(state, length, token)
            assert length == max((n for n in range(i + 2) if not n or tuple(query[i + 1 - n : i + 1]) in runs), default=0)
            for t, end in a.ends[state].items():
                assert not length or texts[t][end - length : end] == query[i + 1 - length : i + 1]


def test_gaussian():
    x = multiprobe_ann.gaussian(1, (20_000,))
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and len(set(seeded(1, 100).tolist())) == 100
