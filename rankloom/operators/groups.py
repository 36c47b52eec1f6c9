"""Identity groups, balanced folds, nested roles and leakage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, stored
from ..functions.sequences import template_atoms

ROLES = ("outer_fit", "outer_query")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Alternating stars over an edge table that never grows, until every node is linked to one node that is linked to none. Minima
    are taken before the shuffle, so a hub is no task of its own.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while unsettled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def unsettled(e: DataFrame) -> int:
    """How many nodes of edges (u, v), u > v, are linked to several smaller ones, or to one that is itself linked to a smaller one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _grouped(df: DataFrame, protocols: dict[str, bool], target: str, guide: str, templates: str) -> DataFrame:
    """(protocol_id, t, group_id) of targets (t: their node's name): components of all protocols in one run; protocols: whether guides count.

    Nodes are numbered once, and edges are pairs of numbers that stand apart by protocol, so no text is in the loop. A component is named by its smallest name.
    """
    t = F.concat(F.lit("t:"), F.col(target))
    by_template = df.select(target, templates).distinct().select(t.alias("a"), F.explode_outer(template_atoms(templates)).alias("n")).select("a", F.coalesce(F.concat(F.lit("m:"), F.col("n").cast("string")), "a").alias("b"), F.lit(False).alias("by_guide"))
    named = stored(by_template.unionByName(df.select(t.alias("a"), F.concat(F.lit("g:"), F.col(guide)).alias("b"), F.lit(True).alias("by_guide"))).where("a is not null").select("a", F.coalesce("b", "a").alias("b"), "by_guide").distinct())
    names = named.select(F.col("a").alias("name")).unionByName(named.select(F.col("b").alias("name"))).distinct()
    numbers = stored(names.select("name", F.monotonically_increasing_id().alias("node")))
    ends = named.join(numbers.select(F.col("name").alias("a"), F.col("node").alias("x")), "a").join(numbers.select(F.col("name").alias("b"), F.col("node").alias("y")), "b").select("x", "y", "by_guide")
    k = len(protocols)
    tagged = None
    for i, both in enumerate(protocols.values()):
        part = (ends if both else ends.where("not by_guide")).select((F.col("x") * k + i).alias("a"), (F.col("y") * k + i).alias("b"))
        tagged = part if tagged is None else tagged.unionByName(part)
    of = components(tagged.distinct()).select(F.expr(f"node div {k}").alias("node"), (F.col("node") % k).cast("int").alias("i"), "component")
    of = stored(of.join(numbers, "node").select("i", "component", "name"))
    first = of.groupBy("component").agg(F.min("name").alias("group_id"))
    protocol = F.array(*map(F.lit, protocols))
    return of.where(F.col("name").startswith("t:")).join(first, "component").select(F.get(protocol, F.col("i")).alias("protocol_id"), F.col("name").alias("t"), "group_id")


def component_groups(df: DataFrame, include_guide: bool, target: str = "target", guide: str = "guide", templates: str = "mapping_candidate_template_nos") -> DataFrame:
    """df with group_id: rows that share a target, a candidate template or, if asked, a guide are in one group.

    Groups are named by the smallest node of their component, so a name doesn't depend on other groups.
    """
    of = _grouped(df, {"all": include_guide}, target, guide, templates).select(F.col("t").alias("__n"), "group_id")
    return df.join(of, F.concat(F.lit("t:"), F.col(target)) == F.col("__n")).drop("__n")


def protocol_groups(df: DataFrame, target: str = "target", guide: str = "guide", templates: str = "mapping_candidate_template_nos") -> DataFrame:
    """(record_id, protocol_id, group_id) for the four protocols; components of both atomic ones come from one run."""
    rows = df.select("record_id", F.explode(F.array(*[F.struct(F.lit(n).alias("protocol_id"), F.col(c).alias("group_id")) for n, c in (("target", target), ("guide", guide))])).alias("x")).select("record_id", "x.*")
    of = _grouped(df, {"atomic_template": False, "dual_atomic": True}, target, guide, templates)
    atomic = df.select("record_id", F.concat(F.lit("t:"), F.col(target)).alias("t")).join(of, "t")
    return rows.unionByName(atomic.select("record_id", "protocol_id", "group_id"))


def _fold_cycles(counts: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, from, to, folds): of the groups of a size, in order, those from `from` on and before `to` go round these folds.

    Of (size, number of groups) pairs, sizes descending. Groups of one size fill the lightest folds up to the load of
    the next one, which then joins the round; once all folds are in it, it lasts. So a size has at most k rounds.
    """
    loads, out = [0] * k, []
    for size, n in counts:
        order, done = sorted(range(k), key=lambda i: (loads[i], i)), 0
        for p in range(1, k + 1):
            active = sorted(order[:p], key=lambda i: (loads[i], i))
            upto = n - done
            if p < k:  # turns at a load below the next fold's, or equal to it where the fold's number is lower
                nxt = order[p]
                upto = min(upto, sum(max(0, -((loads[i] - loads[nxt]) // size) if i > nxt else (loads[nxt] - loads[i]) // size + 1) for i in active))
            if upto:
                out.append((size, done, done + upto, active))
                for at, i in enumerate(active):
                    loads[i] += size * ((upto - at + p - 1) // p)
                done += upto
            if done == n:
                break
    return out


def balanced_group_folds(df: DataFrame, group: str = "group_id", k: int = 5, most: int = 200_000) -> DataFrame:
    """(group, size, fold): groups by size, descending, then name, each to the lightest fold so far.

    Up to `most` groups, if they are few, are walked inside Spark. Else only the different sizes and their numbers of groups,
    at most about sqrt(2 * rows), reach the driver, which settles the order of the folds for each size in closed form;
    a group's fold follows from its rank among those of its size. Both give the same folds.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    load = F.array(*[F.lit(0).cast("long")] * k)
    start = F.struct(load.alias("load"), F.array().cast("array<int>").alias("folds"))

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(a["load"], F.array_min(a["load"])) - 1
        return F.struct(F.transform(a["load"], lambda v, i: v + F.when(i == at, x["size"]).otherwise(0)).alias("load"), F.concat(a["folds"], F.array(at.cast("int"))).alias("folds"))

    if sizes.count() <= min(2_000, most):
        one = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), F.col(group).alias("g"), "size"))).alias("all"))
        walked = one.select("all", F.aggregate("all", start, step, lambda a: a["folds"]).alias("folds"))
        return walked.select(F.explode(F.arrays_zip("all", "folds")).alias("x")).select(F.col("x.all.g").alias(group), F.col("x.all.size").alias("size"), F.col("x.folds").alias("fold"))
    # ranges of (size, name), so that many groups of one size are many tasks
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(sizes.select(F.col(group).alias("g"), "size").repartitionByRange(parts, F.desc("size"), F.asc("g")).withColumn("part", F.spark_partition_id()))
    here = placed.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part", "size").orderBy("g")) - 1)
    ranked = ranked.join(offsets, ["size", "part"]).select("g", "size", (F.col("before") + F.col("nth")).alias("nth"))
    counts = [(r["size"], r["n"]) for r in here.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("size")).collect()]
    rounds: dict[int, list] = {}
    for size, lo, hi, folds in _fold_cycles(counts, k):
        rounds.setdefault(size, []).append((lo, hi, folds))
    cycles = df.sparkSession.createDataFrame(list(rounds.items()), "size long, rounds array<struct<lo:long,hi:long,folds:array<int>>>")
    own = F.filter("rounds", lambda x: (x["lo"] <= F.col("nth")) & (F.col("nth") < x["hi"]))[0]
    dealt = ranked.join(F.broadcast(cycles), "size").withColumn("own", own)
    turn = F.pmod(F.col("nth") - F.col("own.lo"), F.size("own.folds")).cast("int")
    return dealt.select(F.col("g").alias(group), "size", F.get("own.folds", turn).alias("fold"))


def nested_roles(assignments: DataFrame, folds: int = 5) -> DataFrame:
    """(record_id, group_id, fold, outer, inner, role): for outer fold f and inner fold g <> f, rows of f are outer_query, of g inner_validation, others inner_fit."""
    spark = assignments.sparkSession
    pairs = spark.createDataFrame([(f, g) for f in range(folds) for g in range(folds) if f != g], "outer int, inner int")
    j = assignments.crossJoin(F.broadcast(pairs))  # 20 fixed rows
    return j.withColumn("role", F.when(F.col("fold") == F.col("outer"), "outer_query").when(F.col("fold") == F.col("inner"), "inner_validation").otherwise("inner_fit"))


def isolation_violations(roles: DataFrame, split: list[str], identity: str) -> DataFrame:
    """Identities that have several roles in one split."""
    return roles.groupBy(*split, identity).agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def overlap_audit(df: DataFrame, fold: str = "fold", identities: tuple[str, ...] = ("record_id", "target", "guide"), templates: str = "mapping_candidate_template_nos") -> DataFrame:
    """For each fold and identity: how many of its different values the fold's rows have, the others' have, and both."""
    parts = [df.select(F.col(fold).alias("fold"), F.lit(i).alias("identity"), F.col(i).cast("string").alias("value")) for i in identities]
    parts.append(df.select(F.col(fold).alias("fold"), F.lit("template_atom").alias("identity"), F.explode(F.transform(template_atoms(templates), lambda x: x.cast("string"))).alias("value")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # in how many folds a value is: with its own fold's row alone, no other fold has it
    spread = long.distinct().groupBy("identity", "value").agg(F.collect_set("fold").alias("folds"))
    folds = df.select(F.col(fold).alias("fold")).distinct()
    per = spread.crossJoin(F.broadcast(folds)).select("identity", "fold", F.array_contains("folds", F.col("fold")).alias("own"), (F.size(F.array_remove("folds", F.col("fold"))) > 0).alias("others"))
    return per.groupBy("fold", "identity").agg(F.count_if("own").alias("query_values"), F.count_if("others").alias("fit_values"), F.count_if(F.col("own") & F.col("others")).alias("overlap"))


def assignment_audit(df: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    """Per fold: records, groups, and groups that are in other folds too."""
    by = df.groupBy(group, fold).agg(F.count("*").alias("n"))
    crossing = by.groupBy(group).agg(F.count("*").alias("folds"))
    return by.join(crossing, group).groupBy(fold).agg(F.sum("n").alias("records"), F.count("*").alias("groups"), F.count_if(F.col("folds") > 1).alias("crossing_groups"))


def encoding_folds(assignments: DataFrame, protocol: str, exclude: int) -> DataFrame:
    """(record_id, fold) of a protocol without its outer fold; two folds at least must be left."""
    out = assignments.where((F.col("protocol_id") == protocol) & (F.col("fold") != exclude)).select("record_id", "fold")
    if out.select("fold").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two folds to encode from")
    return out


def load_cohort(rows: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """core: labelled training rows; common: those with an admitted context (status ok), guides asserted equal."""
    core = rows.where((F.col("baseline_split") == "baseline_train") & F.col("label_normalized").isNotNull())
    if contexts is None:
        return core
    ok = contexts.where("context_status = 'ok'").select("record_id", "target_context_45", F.col("guide").alias("__guide"))
    out = core.join(ok, "record_id")
    if out.where("not (crRNA_sequence <=> __guide)").limit(1).count():
        raise ValueError("guides of rows and contexts differ")
    return out.drop("__guide")


def stop_roles(assignments: DataFrame, folds: int = 5) -> DataFrame:
    """For each outer fold: outer_query, internal_stop (the next fold) and inner_fit rows; all but the query are the outer fit."""
    outer = assignments.sparkSession.createDataFrame([(f,) for f in range(folds)], "outer int")
    role = F.when(F.col("fold") == F.col("outer"), "outer_query").when(F.col("fold") == (F.col("outer") + 1) % folds, "internal_stop").otherwise("inner_fit")
    return assignments.crossJoin(F.broadcast(outer)).withColumn("role", role)


def context_audit(cohort: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per context status: rows, rows of the cohort, and cohort rows whose guide or label differs."""
    j = contexts.alias("c").join(cohort.alias("r"), "record_id", "left")
    known = F.col("r.crRNA_sequence").isNotNull()
    return j.groupBy("context_status").agg(F.count("*").alias("n"), F.count_if(known).alias("in_cohort"), F.count_if(known & ~F.col("c.guide").eqNullSafe(F.col("r.crRNA_sequence"))).alias("guide_differs"), F.count_if(known & ~F.col("c.y_true").eqNullSafe(F.col("r.label_normalized"))).alias("label_differs"))


def protocol_audit(cohort: DataFrame, contexts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per protocol and context status: records of the cohort, their groups and folds. assignments: record_id, protocol_id, group_id, fold."""
    status = cohort.select("record_id").join(contexts.select("record_id", "context_status"), "record_id", "left")
    j = assignments.join(status, "record_id").withColumn("context_status", F.coalesce("context_status", F.lit("no_context")))
    each = j.groupBy("protocol_id", "context_status", "group_id", "fold").agg(F.count("*").alias("n"))  # what is counted apart are groups, not their records
    return each.groupBy("protocol_id", "context_status").agg(F.sum("n").alias("records"), F.count_distinct("group_id").alias("groups"), F.count_distinct("fold").alias("folds"))


def data_audit(df: DataFrame, target: str = "target", guide: str = "guide", label: str = "label_normalized") -> DataFrame:
    """Per split: rows, different targets and guides, label range, and targets with several guides."""
    multi = df.groupBy("baseline_split", target).agg(F.count_distinct(guide).alias("g")).groupBy("baseline_split").agg(F.count_if(F.col("g") > 1).alias("targets_with_several_guides"))
    return df.groupBy("baseline_split").agg(F.count("*").alias("n"), F.count_distinct(target).alias("targets"), F.count_distinct(guide).alias("guides"), F.min(label).alias("label_min"), F.max(label).alias("label_max")).join(multi, "baseline_split")


def pending_work(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned units (keys, ids_sha256) that no completed unit with the same ids covers."""
    return plan.join(done.where(F.col("status") == "complete").select(*keys, "ids_sha256"), [*keys, "ids_sha256"], "left_anti")
