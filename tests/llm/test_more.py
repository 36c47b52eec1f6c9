"""Vectors of one direction, clashing names, contexts beside punctuation, the bootstrap in plain Python, and what it finds among planted identifiers."""

import math
import random
import re
from collections import defaultdict

import numpy as np

from rankloom.llm import components, covertree, nearjoin, pii, warc


def test_vectors_of_one_direction_end(spark, monkeypatch):
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    rows = [(i, "a", (one * 2.0 ** (i % 40 - 20) * (1 + i // 40)).tolist()) for i in range(600)] + [(700, "a", rng.normal(size=8).tolist()), (701, "b", one.tolist()), (702, None, one.tolist())]
    levels = []
    grow = covertree.grow
    monkeypatch.setattr(covertree, "grow", lambda *a: levels.append(0) or (lambda r: levels.append(r[2]) or r)(grow(*a)))
    got = {r["vec_id"]: r for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), block=300).collect()}
    assert all(got[i]["n_links"] == 599 and got[i]["component_id"] == 0 for i in range(600))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (700, 701, 702)) and levels[-1] <= 3


def test_components_end_where_they_should(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 40)] + [(5, 5), (None, 3)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_own_columns_stay_whatever_their_names(spark):
    text = "write to someone@example.org today or tomorrow"
    docs = spark.createDataFrame([(1, text, "mine", "too", "x", 7), (2, text, "other", "y", "z", 8)], "doc_id long, text string, __key string, __spans string, __ROW string, ___key int")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["__key"] == "mine" and got[1]["__spans"] == "too" and got[2]["___key"] == 8 and "[EMAIL]" in got[1]["text"]
    kept = nearjoin.deduplicate(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], r["__ROW"]) for r in kept.collect()] == [(1, "x")]


def contexts(spark, text):
    _, spans = pii.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return {r["match"]: set(r["contexts"]) for r in spans.collect()}


def test_contexts_beside_punctuation(spark):
    got = contexts(spark, "section k12 . . . . . . page k35 end")
    assert {"l1:section", "r1:page", "r2:page k35"} <= got["k12"] and {"l1:page", "l2:k12 page", "r1:end"} <= got["k35"]
    got = contexts(spark, "mail -- - (a1b2c3) ... ; tel:x99 ! last")
    assert {"l1:mail", "glued:(", "r1:tel:x99"} <= got["a1b2c3"] and {"glued:tel:", "r1:last"} <= got["x99"]
    got = contexts(spark, "q1 one two three four five q2")
    assert {"r1:one", "r2:one two"} <= got["q1"] and {"l1:five", "l2:four five"} <= got["q2"]
    assert not any(c.startswith("shape:") for cs in got.values() for c in cs) and "sl:five a9" in got["q2"]


def plain_bootstrap(spans, support, confidence, score, rounds):
    base = [s for s in spans if s["kind"] != "token"]
    seeds = {}
    for s in base:
        i = s["match"].lower()
        seeds[i] = min(seeds.get(i, s["kind"]), s["kind"])
    free = [s for s in spans if s["kind"] == "token" and s["end"] - s["start"] >= 4 and not any(b["key"] == s["key"] and b["start"] < s["end"] and b["end"] > s["start"] for b in base)]
    graph = defaultdict(set)
    for s in [*base, *free]:
        for c in s["contexts"]:
            graph[c].add(s["match"].lower())
    graph = {c: x for c, x in graph.items() if len(x) > support}
    known = {(i, k): 1.0 for i, k in seeds.items()}
    for _ in range(rounds):
        by_instance = defaultdict(list)
        for (i, k), v in known.items():
            by_instance[i].append((k, v))
        patterns = {}
        for c, members in graph.items():
            mass = defaultdict(float)
            for i in members:
                for k, v in by_instance.get(i, ()):
                    mass[k] += v
            for k, m in mass.items():
                if m >= support and m >= confidence * len(members):
                    patterns[c, k] = min(m / len(members), 0.99)
        new = defaultdict(float)
        for (c, k), p in patterns.items():
            for i in graph[c]:
                if i not in seeds:
                    new[i, k] += math.log(1 - p)
        best = {}
        for (i, k), v in new.items():
            if 1 - math.exp(v) >= score:
                best[i] = max(best.get(i, (0.0, "")), (1 - math.exp(v), k))
        known = {(i, k): 1.0 for i, k in seeds.items()} | {(i, k): v for i, (v, k) in best.items()}
    return set(patterns), {(i, k) for i, (v, k) in best.items()}


def planted(n=300, seed=6):
    """Texts with valid cards and addresses beside their words, mistyped ones in the same places, and other numbers elsewhere."""
    rng = random.Random(seed)
    words = ["alpha", "bravo", "carol", "delta", "early", "fable", "gamma", "house", "idea", "joker"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))

    def luhn(s):
        return sum(sum(divmod(int(c) * 2, 10)) if (len(s) - i) % 2 == 0 else int(c) for i, c in enumerate(s)) % 10 == 0

    def card(valid):
        while True:
            s = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(s) == valid:
                return s

    texts, hidden = [], set()
    for i in range(n):
        parts = [say(6)]
        if i % 3 == 0:
            parts.append(f"card number {card(True)} issued to {say(2)}")
        if i % 12 == 1:
            hidden.add(c := card(False))  # a digit mistyped
            parts.append(f"card number {c} issued to {say(2)}")
        if i % 4 == 0:
            parts.append(f"contact: u{i}@{rng.choice(words)}.example.org for {say(2)}")
        if i % 16 == 2:
            hidden.add(c := f"u{i}@localhost")
            parts.append(f"contact: {c} for {say(2)}")
        parts.append(f"order {rng.randrange(10**7, 10**8)} of {say(1)} digest {rng.getrandbits(64):016x} batch {card(False)} {say(2)}")
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    return texts, hidden


def test_bootstrap_in_plain_python_and_its_precision(spark):
    texts, hidden = planted()
    _, spans = pii.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = [r.asDict() for r in spans.collect()]
    for parameters in ({}, {"support": 2, "confidence": 0.4, "score": 0.5, "rounds": 2}):
        patterns, found = pii.bootstrap(spans, **parameters)
        got = {tuple(r) for r in patterns.collect()}, {tuple(r) for r in found.collect()}
        assert got == plain_bootstrap(rows, **({"support": pii.SUPPORT, "confidence": pii.CONFIDENCE, "score": pii.SCORE, "rounds": pii.ROUNDS} | parameters))
    found = {r["instance"] for r in pii.bootstrap(spans)[1].collect()}
    assert len(found & hidden) >= 0.95 * len(hidden) and len(found & hidden) >= 0.95 * len(found)  # recall and precision
    _, all_spans = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all_spans.where("not base").count() == len(hidden)


def test_archives_of_repeated_rows_and_pages_without_an_id(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "u", "same"), (3, "v", "same"), (5, "u", "else"), (None, "w", "same"), (None, "w", "only"), (7, "x", None), (8, "x", ""), (9, "y", "z" * 300_000), (10, "y", "z" * 300_000)]
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"{tmp_path}/w").collect()), key=str)
    want = [(5, 4, "revisit", 3), (5, 4, "revisit", 3), (3, 4, "response", None), (5, 4, "response", None), (None, 4, "revisit", 3), (None, 4, "response", None), (7, 0, "response", None), (8, 0, "revisit", 7), (9, 300_000, "response", None), (10, 300_000, "revisit", 9)]
    assert got == sorted(want, key=str)
    plan = warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter.*page_id", plan)
