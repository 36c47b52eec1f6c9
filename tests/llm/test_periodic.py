"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import periodic, queries


def brute(w, shortest=24, exponent=3):
    """For each period, maximal stretches whose words agree with those a period on; of those, the ones without a smaller period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        agree = [w[j] == w[j + q] for j in range(n - q)]
        j = 0
        while j < n - q:
            k = j
            while k < n - q and agree[k]:
                k += 1
            size = k - j + q
            if k > j and size >= max(shortest, exponent * q) and not any(all(w[x] == w[x + d] for x in range(j, j + size - d)) for d in range(1, q)):
                out.append((j, size, q))
            j = k + 1
    return sorted(out)


def test_runs_of_ids():
    rng = random.Random(5)
    seen = 0
    for _ in range(400):
        w = []
        while len(w) < rng.randint(0, 150):
            w += [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 14))] * rng.choice([1, 1, 2, 3, 5, 9])
        for shortest, exponent in ((24, 3), (6, 2), (4, 3)):
            want = brute(w, shortest, exponent)
            assert periodic.runs_of(np.array(w, np.int64), shortest, exponent) == want
            seen += len(want)
    assert seen > 1000


def test_suffixes():
    rng = random.Random(6)
    for n in (0, 1, 2, 50, 300):
        w = [rng.randrange(3) for _ in range(n)]
        sa, common = periodic.suffixes(np.array(w, np.int64))
        assert sa.tolist() == sorted(range(n), key=lambda i: w[i:])
        for k in range(1, n):
            a, b = w[sa[k - 1] :], w[sa[k] :]
            assert common[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def texts():
    rng = random.Random(8)
    some = ["".join(rng.choice("abcé\xa0") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    out = [None, "", " \n\t ", "one", "x " * 700, "\x0b".join(["a b c"] * 40), "  lead " + "go on\n" * 30 + "end  "]
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 200):
            w += [rng.choice(some) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 1, 2, 4, 30])
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    out += [out[20], out[20], "y" * 3_000_000 + " z" * 50, " ".join(f"w{i}" for i in range(30000))]
    return out


def test_query(spark, tmp_path):
    rows = [(i if i % 37 else None, t, 5, "x", 1) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, collapsed string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in queries.op11_kruskal_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, t, *_ in rows:
        w = planted(doc_id, words(t))
        runs = brute(w) if len(w) < 2000 else brute_long(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append({
            "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
        })
    assert got == sorted(want, key=str) and sum(r["n_runs"] > 0 for r in got) > 30


def brute_long(w):
    """Distinct words but for a tail that planted() may have made periodic: runs of one period, found from its first repeated word."""
    first, n = {}, len(w)
    for i, x in enumerate(w):
        if x in first:
            q, s = i - first[x], first[x]
            return [(s, n - s, q)] if n - s >= max(24, 3 * q) else []
        first[x] = i
    return []


def test_find_keeps_ids_and_reads_nothing_else(spark):
    docs = spark.createDataFrame([("a", "b " * 40, 1), (None, None, 2)], "name string, body string, runs int")
    got = {r["name"]: (r["runs"], r["collapsed"]) for r in periodic.find(docs, id_col="name", text_col="body").collect()}
    assert got["a"][1] == "b" and [tuple(x) for x in got["a"][0]] == [(0, 40, 1)] and got[None] == ([], "")
    assert periodic.find(docs.where("false"), id_col="name", text_col="body").count() == 0
    tie = spark.createDataFrame([([(9, 30, 3), (0, 40, 4), (50, 20, 2)],)], f"runs {periodic.RUNS}").select(periodic.strongest(F.col("runs")).alias("x")).first()["x"]
    assert tuple(tie) == (0, 40, 4)


def test_words_across_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "_CHUNK", 16)
    monkeypatch.setattr(periodic, "_UP", periodic._powers(periodic._STEP, 17))
    monkeypatch.setattr(periodic, "_DOWN", periodic._powers(pow(periodic._STEP, -1, 2**64), 17))
    rng = random.Random(1)
    for _ in range(200):
        parts = ["".join(rng.choice("ab  ") for _ in range(rng.randint(0, 40))).replace("b", "b" * rng.choice([1, 1, 30])) for _ in range(5)]
        data, offsets = np.frombuffer("".join(parts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        start, end, codes = periodic.words_of(data, offsets)
        want = [(o + m.start(), o + m.end()) for p, o in zip(parts, offsets) for m in re.finditer("[ab]+", p)]
        assert list(zip(start.tolist(), end.tolist())) == want
        text = "".join(parts)
        assert len(set(codes.tolist())) == len({text[a:b] for a, b in want})
