"""Knowledge risk: person-topic facts, leaders, bus factor, departures, ownership, places, directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a topic's weight that its fewest experts must hold, and the weight a challenger of an owner needs.
BUS_SHARE, CHALLENGER = 0.8, 4.5


def person_topics(facts: DataFrame, recent_from: str, stated_sources: tuple[str, ...], weight: float = 3.0) -> DataFrame:
    """``person, topic, w, stated, recent, direct`` from ``person, topic, source, at, base, decayed``.

    All measures in one aggregation: ``w`` is decayed weight, ``stated`` that of sources of record, ``recent`` that
    since ``recent_from``, ``direct`` the undecayed base.
    """
    d = F.col("decayed") * weight
    return facts.groupBy("person", "topic").agg(
        F.sum(d).alias("w"),
        F.sum(F.when(F.col("source").isin(*stated_sources), d).otherwise(0.0)).alias("stated"),
        F.sum(F.when(F.col("at") >= F.to_timestamp(F.lit(recent_from)).cast("timestamp_ntz"), d).otherwise(0.0)).alias("recent"),
        F.sum(F.col("base") * weight).alias("direct"),
    )


def leaders(pt: DataFrame, k: int = 3, exponent: float = 0.5) -> DataFrame:
    """``topic, person, score, rank``: work over total work to ``exponent``, so that breadth is discounted. What a source
    of record states about a person is no work."""
    work = pt.select("person", "topic", (F.col("w") - F.col("stated")).alias("work")).where("round(work, 9) > 0")
    total = work.groupBy("person").agg(F.sum("work").alias("total"))
    scored = work.join(total, ["person"]).withColumn("score", F.round(F.col("work") / F.pow("total", F.lit(exponent)), 9))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "person")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("topic", "person", "score", "rank")


def top_topics(pt: DataFrame, salient: DataFrame, n: int = 3) -> DataFrame:
    """``person, topic, w, rank``: each person's ``n`` heaviest topics, of the salient ones (``topic``) where the person has
    any, else of all; equal weights by name."""
    mark = pt.where("w > 0").select("person", "topic", "w").join(salient.select("topic").distinct().withColumn("_s", F.lit(True)), ["topic"], "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    has = mark.groupBy("person").agg(F.bool_or("_s").alias("_has"))
    kept = mark.join(has, ["person"]).where("_s or not _has")
    order = Window.partitionBy("person").orderBy(F.desc("w"), "topic")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("person", "topic", "w", "rank")


def ranked_prefix(df: DataFrame, group: str, value: str, tie: str, amount: str | None = None) -> DataFrame:
    """``df`` with ``before`` (sum of ``amount``, or of ``value``, of the group's rows that rank before) and ``total``.

    Rows rank by value, largest first, then by ``tie``. Values (positive) are put in bins of a quarter of a power of
    two; a prefix sum over a group's few bins plus one inside each bin gives the sum before a row, so that a group
    that holds a third of all rows is sorted by as many tasks as it has bins.
    """
    amount = amount or value
    df = df.withColumn("_bin", F.floor(F.log2(value) * 4))
    bins = df.groupBy(group, "_bin").agg(F.sum(amount).alias("_t"))
    w = Window.partitionBy(group).orderBy(F.desc("_bin"))
    bins = bins.select(group, "_bin", F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_o"), F.sum("_t").over(Window.partitionBy(group)).alias("total"))
    inner = Window.partitionBy(group, "_bin").orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_i", F.coalesce(F.sum(amount).over(inner), F.lit(0.0))).join(bins, [group, "_bin"])
    return out.withColumn("before", F.col("_o") + F.col("_i")).drop("_bin", "_o", "_i")


def bus_factor(pt: DataFrame, share: float = BUS_SHARE) -> DataFrame:
    """``topic, total, experts, bus``: the fewest people who together hold ``share`` of a topic's weight."""
    s = ranked_prefix(pt.where("w > 0").select("topic", "person", "w"), "topic", "w", "person")
    need = F.sum(F.when(F.round(F.col("before") / F.col("total"), 9) < share, 1).otherwise(0))
    return s.groupBy("topic").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("experts"), need.alias("bus"))


def level(experts: Column, bus: Column) -> Column:
    return F.when((experts == 1) | (bus <= 1), "critical").when(bus == 2, "elevated").otherwise("ok")


def risk(pt: DataFrame, slight_from: int = 12) -> DataFrame:
    """``topic, total, experts, bus, level``: topics below the upper median weight are one level lower, if there are
    ``slight_from`` topics or more."""
    b = bus_factor(pt).withColumn("total", F.round("total", 6))
    # The weight at the upper middle, by counts of equal weights: no task or row holds all topics.
    n = b.agg(F.count(F.lit(1)).alias("n"))
    before = ranked_prefix(b.select(F.lit(1).alias("g"), "total").groupBy("g", "total").agg(F.count(F.lit(1)).cast("double").alias("k")).withColumnRenamed("total", "t"), "g", "t", "t", "k")
    mid = before.crossJoin(n).where((F.col("n") >= slight_from) & (F.col("before") < F.ceil(F.col("n") / 2)) & (F.col("before") + F.col("k") >= F.ceil(F.col("n") / 2)))
    mid = n.join(mid.select(F.col("t").alias("median")), how="left").select(F.coalesce("median", F.lit(-1.0)).alias("median"))
    lv = level(F.col("experts"), F.col("bus"))
    low = F.when(lv == "critical", "elevated").otherwise("ok")
    return b.crossJoin(mid).select("topic", "total", "experts", "bus", F.when(F.col("total") < F.col("median"), low).otherwise(lv).alias("level"))


def exposure(pt: DataFrame, risks: DataFrame) -> DataFrame:
    """``person, sole, leads``: topics a person alone holds, and topics at risk that the person leads."""
    lead = leaders(pt, 1).select("topic", "person")
    j = lead.join(risks, ["topic"])
    return j.groupBy("person").agg(F.count_if(F.col("experts") == 1).alias("sole"), F.count_if(F.col("level") != "ok").alias("leads")).where("sole > 0 or leads > 0")


def departure(pt: DataFrame, risks: DataFrame, person: object) -> DataFrame:
    """Topics that would lose their leader with ``person``."""
    return leaders(pt, 1).where(F.col("person") == person).join(risks, ["topic"]).select("topic", "experts", "bus", "level")


def is_group_owner(owner: Column) -> Column:
    """A team (a slash after the source's prefix) or a machine account, which cannot work and so cannot lose an area."""
    bare = F.regexp_replace(owner, r"^[^:]*:", "")
    machine = F.exists(F.split(F.regexp_replace(F.lower(bare), r"[-_. \[\]]+", " "), " "), lambda x: (x == "bot") | (x.endswith("bot") & (F.length(x) >= 8)))
    return bare.contains("/") | machine


def squad_teams(owners: DataFrame, teams: DataFrame, suffixes: tuple[str, ...], least: int = 3) -> DataFrame:
    """``owner, team``: the one team of the org chart (``team, name``) that a squad's name means.

    Names are compared without signs, with or without a decoration such as "squad" on either side; a squad that fits
    two teams, or none, has no row.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")
    cut = lambda c, n: F.array(*[F.when(c.endswith(x) & (F.length(c) - len(x) >= n), F.substring(c, F.lit(1), F.length(c) - len(x))) for x in suffixes])
    slug = flat(F.regexp_replace(F.regexp_replace("owner", r"^[^:]*:", ""), r"^[^/]*/", ""))
    forms = owners.select("owner").distinct().select("owner", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(slug), cut(slug, least))))).alias("form"))
    name = flat(F.col("name"))
    named = teams.select("team", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(name), cut(name, 1))))).alias("form"))
    fits = forms.where("form <> ''").join(named, ["form"]).groupBy("owner").agg(F.min("team").alias("team"), F.max("team").alias("_last"))
    return fits.where("team = _last").select("owner", "team")


def owned_areas(declared: DataFrame, pt: DataFrame, squads: DataFrame | None = None) -> DataFrame:
    """``topic, owners, standing, actual``: what became of areas with declared owners (``topic, owner``).

    An area whose owners are all teams or machines is judged by the members of its squads (``owner, person``) where
    the org chart knows any, else its standing is 'group' and nobody is named. The actual owner has the most direct
    work, then the most other work, then the smallest id; without direct work, the most work for its breadth. Owners
    hold an area if one of them is the actual owner, or if one works there and the actual owner has less than
    ``CHALLENGER`` or no more than they. Else they are silent (no work anywhere), unworked (none here) or
    trailing. Areas that nobody has any weight in are left out.
    """
    work = pt.withColumn("other", F.round(F.col("w") - F.col("stated"), 9))
    paths = work.groupBy("person").agg(F.bool_or(F.col("direct") > 0).alias("has_direct"))
    work = work.join(paths, ["person"]).withColumn("here", F.when(F.col("has_direct"), F.col("direct")).otherwise(F.greatest("other", F.lit(0.0))))
    order = Window.partitionBy("topic").orderBy(F.desc("direct"), F.desc("other"), "person")
    first = work.where("direct > 0").withColumn("r", F.row_number().over(order)).where("r = 1").select("topic", F.col("person").alias("direct_lead"))
    lead = leaders(pt, 1).select("topic", F.col("person").alias("lead"))
    actual = pt.where("w > 0").select("topic").distinct().join(first, ["topic"], "left").join(lead, ["topic"], "left").select("topic", F.coalesce("direct_lead", "lead").alias("actual"))
    actual = actual.join(work.select("topic", F.col("person").alias("actual"), F.col("here").alias("best")), ["topic", "actual"], "left")
    named = declared.select("topic", F.col("owner").cast("string").alias("owner")).distinct().withColumn("group", is_group_owner(F.col("owner")))
    groups = named.groupBy("topic").agg(F.bool_and("group").alias("group"))
    people = named.join(groups.where("not group").select("topic"), ["topic"], "left_semi").select("topic", "owner")
    if squads is not None:
        members = named.join(groups.where("group").select("topic"), ["topic"], "left_semi").join(squads.select("owner", F.col("person").alias("_m")), ["owner"])
        people = people.unionByName(members.select("topic", F.col("_m").alias("owner")).distinct())
    mine = work.select("topic", F.col("person").cast("string").alias("owner"), F.col("here").alias("mine"), (F.col("other") > 0).alias("works_here"))
    anywhere = work.where("other > 0").select(F.col("person").cast("string").alias("owner")).distinct().withColumn("works", F.lit(True))
    own = people.join(mine, ["topic", "owner"], "left").join(anywhere, ["owner"], "left").join(actual, ["topic"])
    per = own.groupBy("topic").agg(
        F.array_sort(F.collect_set("owner")).alias("owners"),
        F.bool_or(F.col("owner") == F.col("actual").cast("string")).alias("leads"),
        F.max(F.coalesce("mine", F.lit(0.0))).alias("most"),
        F.bool_or(F.coalesce("works", F.lit(False))).alias("works"),
        F.bool_or(F.coalesce("works_here", F.lit(False))).alias("works_here"),
        F.max("best").alias("best"),
        F.min("actual").alias("actual"),
    )
    displaced = (F.col("most") <= 0) | ((F.coalesce("best", F.lit(0.0)) >= CHALLENGER) & (F.col("best") > F.col("most")))
    standing = F.when(F.coalesce("leads", F.lit(False)) | ~displaced, "held").when(~F.col("works"), "silent").when(~F.col("works_here"), "unworked").otherwise("trailing")
    judged = per.select("topic", "owners", standing.alias("standing"), F.col("actual").cast("string").alias("actual"))
    rest = groups.where("group").join(judged.select("topic"), ["topic"], "left_anti").join(actual.select("topic"), ["topic"], "left_semi")
    return judged.unionByName(rest.select("topic", F.array().cast("array<string>").alias("owners"), F.lit("group").alias("standing"), F.lit(None).cast("string").alias("actual")))


def ownership_report(areas: DataFrame) -> DataFrame:
    """Counts of each standing, and the share of the areas that can be judged whose owners have lost them."""
    n = lambda s: F.count_if(F.col("standing") == s).alias(s)
    out = areas.agg(F.count(F.lit(1)).alias("declared"), n("held"), n("silent"), n("unworked"), n("trailing"), n("group"))
    judged, moved = F.col("declared") - F.col("group"), F.col("silent") + F.col("unworked") + F.col("trailing")
    return out.withColumn("share", F.when(judged > 0, F.round(moved / judged, 6)).otherwise(F.lit(0.0)))


def place_leads(work: DataFrame, exponent: float = 0.25) -> DataFrame:
    """``place, people, work, holder, share, bus`` from ``place, person, n``: holders by work over breadth."""
    w = work.groupBy("place", "person").agg(F.sum("n").cast("double").alias("n"))
    breadth = w.groupBy("person").agg(F.sum("n").alias("b"))
    s = w.join(breadth, ["person"]).withColumn("s", F.round(F.col("n") / F.pow("b", F.lit(exponent)), 9))
    s = ranked_prefix(s, "place", "s", "person")
    first = F.min(F.struct((-F.col("s")).alias("k"), "person"))
    out = s.groupBy("place").agg(
        F.count(F.lit(1)).alias("people"), F.sum("n").alias("work"), first.alias("f"), F.max("total").alias("total"),
        F.sum(F.when(F.round(F.col("before") / F.col("total"), 9) < BUS_SHARE, 1).otherwise(0)).alias("bus"),
    )
    return out.select("place", "people", "work", F.col("f.person").alias("holder"), F.round(-F.col("f.k") / F.col("total"), 6).alias("share"), "bus")


def ubiquitous(pt: DataFrame, least_people: int = 60, share: float = 0.35) -> DataFrame:
    """``topic, holders, ubiquitous``: held by more than ``share`` of at least ``least_people`` people."""
    held = pt.where("w > 0")
    people = held.agg(F.count_distinct("person").alias("people"))
    holders = held.groupBy("topic").agg(F.count_distinct("person").alias("holders"))
    return holders.crossJoin(people).select("topic", "holders", ((F.col("people") >= least_people) & (F.col("holders") > share * F.col("people"))).alias("ubiquitous"))
