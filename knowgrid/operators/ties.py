"""Ties between subjects: co-occurrence, pruning, related subjects, regions, one-person connections, people nearby."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.functions.text import same_family
from knowgrid.session import discard, hot_keys, look_up, materialise

#: Subjects of a unit of work that pairs are made from, at most: larger units say nothing about any pair.
MAX_SUBJECTS, LEAST_ITEMS, LEAST_SEEN, KEEP = 18, 3, 5, 12
#: Nodes that may look up the same one in one task; those of a larger group are spread over copies of it.
HOT_NODES = 100_000


def units(work: DataFrame, max_subjects: int = MAX_SUBJECTS) -> DataFrame:
    """``unit, t, who``: the subjects of each unit of work (``unit, topic, who``) that has two to ``max_subjects`` of them.

    Larger units are about no pair in particular. Pairs and counts both come from this one aggregation.
    """
    u = work.groupBy("unit").agg(F.array_sort(F.collect_set("topic")).alias("t"), F.min("who").alias("who"))
    return u.where(F.size("t").between(2, max_subjects))


def _units(work: DataFrame, max_subjects: int) -> DataFrame:
    return work if "t" in work.columns else units(work, max_subjects)


def cooccurrence(work: DataFrame, max_subjects: int = MAX_SUBJECTS) -> DataFrame:
    """``a, b, n, witnesses, one`` of unordered subject pairs from ``unit, topic, who`` (or from ``units``).

    A unit makes at most 153 pairs, so no unit, however hot, can blow up. Pairs are made in the row that holds a
    unit's subjects, without a join. Names of one family are no pair.
    """
    unit = _units(work, max_subjects)
    pairs = unit.select("who", F.explode("t").alias("a"), "t").select("who", "a", F.explode(F.filter("t", lambda x: x > F.col("a"))).alias("b"))
    pairs = pairs.where(~same_family(F.col("a"), F.col("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("who").alias("witnesses"), F.min("who").alias("one"))


def weigh(pairs: DataFrame, work: DataFrame, max_share: float = 0.35, max_subjects: int = MAX_SUBJECTS) -> DataFrame:
    """``a, b, weight, witnesses, sole``, both directions: Jaccard of the units, after the gates.

    Pairs seen three times, subjects seen five times, and subjects in more than ``max_share`` of 200 or more units
    are left out.
    """
    unit = _units(work, max_subjects)
    seen = unit.select(F.explode("t").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("seen"))
    items = unit.agg(F.count(F.lit(1)).alias("items"))
    ok = seen.crossJoin(items).where((F.col("seen") >= LEAST_SEEN) & ((F.col("items") < 200) | (F.col("seen") <= max_share * F.col("items"))))
    na, nb = ok.select(F.col("topic").alias("a"), F.col("seen").alias("na")), ok.select(F.col("topic").alias("b"), F.col("seen").alias("nb"))
    w = pairs.where(F.col("n") >= LEAST_ITEMS).join(na, ["a"]).join(nb, ["b"])
    w = w.withColumn("weight", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 9)).where("weight >= 0.001")
    w = w.select("a", "b", "weight", "witnesses", F.when(F.col("witnesses") == 1, F.col("one")).alias("sole"))
    return w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "witnesses", "sole"))


def drop_spread(ties: DataFrame, work: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """Without subjects that more than ``share`` of all containers (``topic, container``) have, if there are ``least`` or
    more: what is everywhere says nothing about what belongs together."""
    seen = work.where("container is not null").select("topic", "container").distinct()
    total = seen.agg(F.count_distinct("container").alias("total"))
    wide = seen.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).crossJoin(total).where((F.col("total") >= least) & (F.col("n") > share * F.col("total")))
    return ties.join(wide.select(F.col("topic").alias("a")), ["a"], "left_anti").join(wide.select(F.col("topic").alias("b")), ["b"], "left_anti")


def standing_only(ties: DataFrame, standing: DataFrame) -> DataFrame:
    """Ties with a name that stands by itself (``topic``) on one side at least; all of them where no such name is known."""
    names = standing.select("topic").distinct().withColumn("_is", F.lit(True))
    any_ = names.agg((F.count(F.lit(1)) > 0).alias("_any"))
    j = ties.join(names.select(F.col("topic").alias("a"), F.col("_is").alias("_a")), ["a"], "left").join(names.select(F.col("topic").alias("b"), F.col("_is").alias("_b")), ["b"], "left").crossJoin(any_)
    return j.where("not _any or _a or _b").select(*ties.columns)


def strongest_claim(claims: DataFrame) -> DataFrame:
    """``a, b, weight, witnesses, sole, source``: of what several sources say about a pair the strongest, whole; of equal
    ones that of the smaller source name. Claims of a subject with itself or without weight are none."""
    good = claims.where("a <> b and weight > 0")
    best = good.groupBy("a", "b").agg(F.min(F.struct((-F.col("weight")).alias("w"), "source", "witnesses", "sole")).alias("c"))
    return best.select("a", "b", (-F.col("c.w")).alias("weight"), F.col("c.witnesses").alias("witnesses"), F.col("c.sole").alias("sole"), F.col("c.source").alias("source"))


def path_units(paths: DataFrame, common: DataFrame, max_subjects: int = MAX_SUBJECTS) -> DataFrame:
    """``unit, a, b, who``: subjects of different paths of a commit (``unit, path, topic, who``), without those in
    ``common`` (``unit, topic``), which only say where code lives. Two subjects of one and the same path are no pair."""
    own = paths.select("unit", "path", "topic", "who").distinct().join(common, ["unit", "topic"], "left_anti")
    per = own.groupBy("unit", "topic").agg(F.array_sort(F.collect_set("path")).alias("p"), F.min("who").alias("who"))
    unit = per.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("t"), F.min("who").alias("who")).where(F.size("t").between(2, max_subjects))
    two = unit.select("unit", "who", "t", F.explode("t").alias("x")).select("unit", "who", "x", F.explode(F.filter("t", lambda y: y["topic"] > F.col("x.topic"))).alias("y"))
    return two.where((F.size(F.array_union("x.p", "y.p")) >= 2) & ~same_family(F.col("x.topic"), F.col("y.topic"))).select("unit", F.col("x.topic").alias("a"), F.col("y.topic").alias("b"), "who")


def span_groups(spans: DataFrame) -> DataFrame:
    """``person, region, topics, ties, weakest``: what a person alone holds together, as connected groups of ``sole_spans``,
    with the weight of the weakest connection."""
    key = lambda c: F.concat(F.col("person"), F.lit("\x01"), F.col(c))
    cc = components(spans.select(key("a").alias("a"), key("b").alias("b")))
    placed = spans.withColumn("node", key("a")).join(cc, ["node"])
    root = placed.groupBy("person", "root").agg(F.count(F.lit(1)).alias("ties"), F.min("weight").alias("weakest"))
    topics = cc.groupBy("root").agg(F.count(F.lit(1)).alias("topics"))
    return root.join(topics, ["root"]).select("person", F.substring_index("root", "\x01", -1).alias("region"), "topics", "ties", "weakest")


def strongest(ties: DataFrame, keep: int = KEEP) -> DataFrame:
    """The ``keep`` strongest ties of each subject with their rank."""
    order = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    return ties.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)


def drop_scaffold(ties: DataFrame, least: int = 20, share: float = 0.35) -> DataFrame:
    """Without subjects tied to more than ``share`` of all, if there are ``least`` or more."""
    degree = ties.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    total = degree.agg(F.count(F.lit(1)).alias("total"))
    hubs = degree.crossJoin(total).where((F.col("total") >= least) & (F.col("degree") > share * F.col("total")))
    return ties.join(hubs.select("a"), ["a"], "left_anti").join(hubs.select(F.col("a").alias("b")), ["b"], "left_anti")


def related(pt: DataFrame, least: float = 0.6) -> DataFrame:
    """``topic, other, shared, overlap``: subjects whose holders are mostly holders of ``topic``, too."""
    held = pt.where("w > 0").select("person", "topic").distinct()
    n = held.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    pairs = held.join(held.select("person", F.col("topic").alias("other")), ["person"]).where("topic <> other")
    shared = pairs.groupBy("topic", "other").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(n.select(F.col("topic").alias("other"), "n"), ["other"])
    return out.withColumn("overlap", F.round(F.col("shared") / F.col("n"), 9)).where(F.col("overlap") >= least).select("topic", "other", "shared", "overlap")


def families(names: DataFrame, col: str = "name") -> DataFrame:
    """``a, b`` (a < b) of names of which one holds the other: each name meets the names among its own substrings,
    by an equality join."""
    n = names.select(F.col(col).alias("x")).where(F.length("x") > 0).distinct()
    starts = n.select("x", F.explode(F.sequence(F.lit(1), F.length("x"))).alias("i"))
    subs = starts.select("x", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - F.col("i") + 1), lambda k: F.substring("x", F.col("i"), k))).alias("s")).distinct()
    return subs.join(n.select(F.col("x").alias("s")), ["s"]).where("s <> x").select(F.least("s", "x").alias("a"), F.greatest("s", "x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: smallest node reached, for edges ``a, b``.

    Stars are contracted round by round: every node finds the smallest of its neighbours and itself, edges are moved to
    these, and those within one are dropped, so each round has fewer edges and nodes than the one before. At the
    end the rounds' answers are looked up one after the other, from the last to the first; the nodes of a giant group
    do that in many tasks.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds = []
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # A node's smallest neighbour may itself have a smaller one: two steps at once.
        step = low.select(F.col("a").alias("_at"), F.col("m").alias("_m"))
        label = materialise(look_up(low, "m", "a", step, hot_keys(low, "m", now.count(), HOT_NODES)).select(F.col("a").alias("node"), F.col("_m").alias("root")), "cc")
        rounds.append(label)
        to = label.select(F.col("node").alias("_at"), "root")
        n = now.count()
        moved = look_up(now, "a", "b", to, hot_keys(now, "a", n, HOT_NODES)).withColumnRenamed("root", "_a")
        moved = look_up(moved, "b", "a", to, hot_keys(now, "b", n, HOT_NODES)).withColumnRenamed("root", "_b").where("_a <> _b")
        last, now = now, materialise(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "cc-edges")
        discard(last)
        if now.isEmpty():
            break
    out = rounds[-1]
    for level in reversed(rounds[:-1]):
        up = out.select(F.col("node").alias("_at"), F.col("root").alias("_r"))
        out = look_up(level, "root", "node", up, hot_keys(level, "root", level.count(), HOT_NODES), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out


def regions(ties: DataFrame, lead: DataFrame, least: int = 3) -> DataFrame:
    """``lead, region, topic``: tied subjects under one lead (``topic, person``), connected, ``least`` or more."""
    l1 = lead.select(F.col("topic").alias("a"), F.col("person").alias("la"))
    l2 = lead.select(F.col("topic").alias("b"), F.col("person").alias("lb"))
    same = ties.join(l1, ["a"]).join(l2, ["b"]).where("la = lb")
    cc = components(same.select("a", "b"))
    named = cc.join(lead.select(F.col("topic").alias("node"), F.col("person").alias("lead")), ["node"])
    big = named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return named.join(big.select("root"), ["root"]).select("lead", F.col("root").alias("region"), F.col("node").alias("topic"))


def sole_spans(ties: DataFrame, rank: int = 3) -> DataFrame:
    """``person, a, b, weight``: ties that one person alone makes and that rank high on both sides."""
    r = strongest(ties, rank)
    back = r.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rank").alias("back"))
    return r.where("witnesses = 1 and a < b").join(back, ["a", "b"]).select(F.col("sole").alias("person"), "a", "b", "weight")


def near_groups(members: DataFrame, person: object, max_size: int = 200) -> DataFrame:
    """``other, weight``: people who share groups with ``person``; a group of n gives 1 / (n - 1). The person's own groups
    are picked before the join."""
    size = members.groupBy("grp").agg(F.count_distinct("person").alias("size")).where(F.col("size").between(2, max_size))
    mine = members.where(F.col("person") == person).select("grp").distinct().join(size, ["grp"])
    return members.where(F.col("person") != person).select("grp", "person").distinct().join(mine, ["grp"]).groupBy(F.col("person").alias("other")).agg(F.round(F.sum(1 / (F.col("size") - 1)), 9).alias("weight"))


def near_topics(pt: DataFrame, person: object) -> DataFrame:
    """``other, weight``: shared weight over both reaches' roots, halved."""
    reach = pt.groupBy("person").agg(F.sum("w").alias("reach"))
    mine = pt.where(F.col("person") == person).select("topic", F.col("w").alias("mw")).join(reach.where(F.col("person") == person).select(F.col("reach").alias("mr")))
    j = pt.where(F.col("person") != person).join(mine, ["topic"]).join(reach, ["person"])
    return j.groupBy(F.col("person").alias("other")).agg(F.round(F.sum(F.least("w", "mw") / (F.sqrt("reach") * F.sqrt("mr")) * 0.5), 6).alias("weight"))
