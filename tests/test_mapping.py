"""Ambiguity codes against a comparison of every window, and groups against plain components."""

import random

from rankloom.functions.sequences import IUPAC
from rankloom.operators import groups, mapping

COMPLEMENT = {frozenset(b): c for c, b in IUPAC.items()}


def reverse(s):
    pair = dict(zip("ACGT", "TGCA"))
    return "".join(COMPLEMENT[frozenset(pair[b] for b in IUPAC[c])] for c in reversed(s))


def compatible(a, b):
    return all(set(IUPAC[x]) & set(IUPAC[y]) for x, y in zip(a, b))


def brute(targets, templates):
    out = set()
    for t in targets:
        hits = {}
        for mode in ("exact_acgt", "iupac_compatible"):
            for o, q in (("forward", t), ("reverse_complement", reverse(t))):
                for no, group, text in templates:
                    for i in range(len(text) - len(t) + 1):
                        w = text[i : i + len(t)]
                        if (mode == "exact_acgt" and w == q and set(w) <= set("ACGT")) or (mode != "exact_acgt" and w != q and compatible(w, q)):
                            hits.setdefault(mode, set()).add((t, no, group, i, o, mode))
        out |= hits.get("exact_acgt") or hits.get("iupac_compatible", set())
    return out


def test_hits_with_many_codes(spark):
    rng = random.Random(4)
    letters = lambda n, codes="": "".join(rng.choice("ACGT" * 5 + codes) for _ in range(n))
    templates = []
    for no in range(40):
        text = list(letters(60, "RYN" if no % 2 else ""))
        if no % 3 == 0:  # runs of N: 4 ** 12 spellings, windows of nothing else among them
            at = rng.randrange(0, 40)
            text[at : at + rng.choice([8, 12, 20])] = "N" * 12
        templates.append((no, f"g{no // 9}", "".join(text)[:60]))
    targets = []
    for i in range(60):
        text = templates[rng.randrange(40)][2]
        at = rng.randrange(0, 45)
        t = list(text[at : at + rng.choice([9, 12])])
        for j in range(len(t)):
            t[j] = rng.choice(IUPAC[t[j]])
        if i % 4 == 0:
            t[rng.randrange(len(t))] = "N"
        if i % 5 == 0:
            t[2:8] = "NNNNNN"
        if i % 3 == 0:
            t[0] = "R"
        targets.append("".join(t))
    targets += ["ACG", "N", "NNNN", "NNNANNNANNNA", "ANNNNNNNNNNN"]
    windows = sum(1 for _, _, x in templates for i in range(49) if x[i : i + 12].count("N") >= 6)
    assert windows > 100
    made = spark.createDataFrame([(t,) for t in sorted(set(targets))], "target string"), spark.createDataFrame(templates, "template_no int, template_group_id string, template_sequence_clean string")
    want = brute(sorted(set(targets)), templates)
    assert len(want) > 500
    for most in (1024, 16, 1):
        got = {tuple(r) for r in mapping.all_hits(*made, most).select("target", "template_no", "template_group_id", "start_0based", "orientation", "match_mode").collect()}
        assert not got ^ want, (most, sorted(got - want)[:3], sorted(want - got)[:3], len(got), len(want))


def test_no_join_on_length_alone(spark):
    """Windows of mostly N and plain queries meet at spelt stretches: far fewer pairs than all of one length."""
    rng = random.Random(5)
    w = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(6)) + "N" * 18, i) for i in range(1000)], "window string, i int")
    q = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(24)), i) for i in range(1000)], "query string, j int")
    met = mapping._seeds(w, "window", True).join(mapping._seeds(q, "query", False), "key").count()
    assert met < 1000 * 1000 / 500


def test_protocol_groups(spark):
    rng = random.Random(7)
    rows = [(i, f"T{rng.randrange(60)}", f"G{rng.randrange(40)}", ";".join(str(rng.randrange(50)) for _ in range(rng.choice([0, 1, 1, 2])))) for i in range(150)]
    df = spark.createDataFrame(rows, "record_id long, target string, guide string, mapping_candidate_template_nos string")

    def plain(both):
        near = {}
        for _, t, g, m in rows:
            for x in [f"m:{n}" for n in m.split(";") if n] + ([f"g:{g}"] if both else []):
                near.setdefault(f"t:{t}", set()).add(x)
                near.setdefault(x, set()).add(f"t:{t}")
        name = {}
        for start in sorted(near):
            todo = [] if start in name else [start]
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = start
                    todo += near[x]
        return {i: name.get(f"t:{t}", f"t:{t}") for i, t, _, _ in rows}

    got = {}
    for r in groups.protocol_groups(df).collect():
        got.setdefault(r["protocol_id"], {})[r["record_id"]] = r["group_id"]
    assert got == {"target": {r[0]: r[1] for r in rows}, "guide": {r[0]: r[2] for r in rows}, "atomic_template": plain(False), "dual_atomic": plain(True)}
    assert {r["record_id"]: r["group_id"] for r in groups.component_groups(df, True).collect()} == plain(True)
