"""Subjects and people beyond rankings: topic groups, family collapse, credit, reasons, lookups, facts, erasure, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.functions.text import reads_as_name, same_family


def salient(curated: Column, n_sources: Column, topic: Column, ubiquitous: Column) -> Column:
    """A subject: stated somewhere, or from two sources, hyphenated and reading as a name; never one that everybody has."""
    return ~ubiquitous & (curated | ((n_sources > 1) & topic.contains("-") & reads_as_name(topic)))


def topic_groups(holders: DataFrame, least: float = 0.6) -> DataFrame:
    """``topic, grp``: fragments folded into the compound that most of their holders hold, up to the root.

    ``holders`` is distinct ``topic, person``. A compound has all the fragment's words and more; candidates share the
    fragment's first word, so no pair of unrelated topics is looked at. Every step of a chain adds a word, so the rounds are
    log2 of the words of the longest topic.
    """
    t = holders.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.split("topic", "[-_]"))
    frag = t.select(F.col("topic").alias("f"), F.col("n").alias("fn"), F.col("w").alias("fw"), F.element_at("w", 1).alias("k"))
    comp = t.select(F.col("topic").alias("c"), F.col("w").alias("cw"), F.explode(F.array_distinct("w")).alias("k"))
    cand = frag.join(comp, ["k"]).where((F.size("cw") > F.size("fw")) & (F.size(F.array_except("fw", "cw")) == 0))
    h1, h2 = holders.select(F.col("topic").alias("f"), "person"), holders.select(F.col("topic").alias("c"), "person")
    shared = cand.select("f", "c", "fn", F.size("cw").alias("len")).join(h1, ["f"]).join(h2, ["c", "person"]).groupBy("f", "c", "fn", "len").agg(F.count(F.lit(1)).alias("s"))
    best = shared.withColumn("o", F.round(F.col("s") / F.col("fn"), 9)).where(F.col("o") >= least)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("o"), "len", "c"))).where("r = 1").select("f", "c")
    out = t.select("topic", F.col("topic").alias("grp"))
    steps, longest = 1, t.agg(F.max(F.size("w"))).first()[0] or 0
    while steps <= longest:
        nxt = best.select(F.col("f").alias("grp"), F.col("c").alias("_up"))
        out = out.join(nxt, ["grp"], "left").select("topic", F.coalesce("_up", "grp").alias("grp"))
        up = best.select(F.col("f").alias("c"), F.col("c").alias("_u"))
        best = best.join(up, ["c"], "left").select("f", F.coalesce("_u", "c").alias("c"))
        steps *= 2
    return out


def collapse_family(ranked: DataFrame, group: str, name: str, order: list[Column]) -> DataFrame:
    """Of each group's ranked names (short lists), those of no family with one kept before: a fold over the sorted list."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = ranked.withColumn("_r", F.row_number().over(w)).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(name).alias("n")))).alias("l"))
    kept = F.aggregate("l", F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda k: same_family(k, x["n"])), acc).otherwise(F.concat(acc, F.array(x["n"]))))
    return rows.select(group, F.posexplode(kept).alias("pos", name)).select(group, (F.col("pos") + 1).cast("long").alias("pos"), name)


def review_credit(participants: DataFrame, dirs: DataFrame, work: DataFrame, credit: float = 0.5) -> DataFrame:
    """``place, person, n``: commit work plus ``credit`` for every directory of a change that a person took part in."""
    extra = participants.distinct().join(dirs.distinct(), ["pull"]).select("place", "person", F.lit(credit).alias("n"))
    return work.select("place", "person", F.col("n").cast("double").alias("n")).unionByName(extra).groupBy("place", "person").agg(F.sum("n").alias("n"))


def common_to_all(paths: DataFrame) -> DataFrame:
    """``unit, topic`` of subjects in every path of a unit (``unit, path, topic``) but not in the deepest directory's
    (``deep``): where code lives rather than what it is about."""
    n = paths.groupBy("unit").agg(F.count_distinct("path").alias("paths"))
    each = paths.groupBy("unit", "topic").agg(F.count_distinct("path").alias("k"), F.max(F.col("deep").cast("int")).alias("deep"))
    return each.join(n, ["unit"]).where("k = paths and paths > 1 and deep = 0").select("unit", "topic")


def reasons(hits: DataFrame) -> DataFrame:
    """``entity, reasons``: why each was found, strongest field first per term, from ``entity, term, field, value, how``."""
    order = F.when(F.col("field") == "topic", 0).when(F.col("field") == "title", 1).when(F.col("field") == "team", 2).otherwise(3)
    w = Window.partitionBy("entity", "term").orderBy(order, "value")
    best = hits.withColumn("r", F.row_number().over(w)).where("r = 1")
    text = F.concat(F.col("field"), F.lit(" "), F.col("value"), F.when(F.col("how") == "fuzzy", F.concat(F.lit(", read for "), "term")).when(F.col("how") == "synonym", F.concat(F.lit(", for "), "term")).when(F.col("how") == "tie", F.lit(", travels with it")).otherwise(F.lit("")))
    return best.groupBy("entity").agg(F.array_sort(F.collect_set(text)).alias("reasons"))


def find_person(people: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """At most one id: canonical id, then address, then name; fuzzy: the smallest id in which anything holds ``query``."""
    q = query.strip().lower()
    name, mail = F.lower("name"), F.lower("email")
    tier = F.when(F.lower("id") == q, 0).when(mail == q, 1).when(name == q, 2)
    if fuzzy:
        tier = F.when(F.lower("id") == q, 0).when(F.lower("id").contains(q) | mail.contains(q) | name.contains(q), 1)
    return people.select("id", tier.alias("tier")).where("tier is not null").orderBy("tier", "id").limit(1).select("id")


def ordered_distinct(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each ``key`` in the given (total) order; rows with an empty or NULL key are dropped."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_r", r).where("_r = 1").drop("_r")


def matching(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose named fields equal the values, whatever their case; a value of None asks nothing, all None match nothing."""
    cond = [F.lower(c) == v.lower() for c, v in wanted.items() if v is not None]
    out = F.lit(bool(cond))
    for c in cond:
        out = out & F.coalesce(c, F.lit(False))
    return rows.where(out)


def mentioned(facts: DataFrame, words: list[str]) -> DataFrame:
    """Facts (``subject, object, detail``) that a word of three letters or more occurs in."""
    text = F.lower(F.concat_ws(" ", "subject", "object", "detail"))
    asked = [w.lower() for w in words if len(w) >= 3]
    return facts.where(F.exists(F.array(*[F.lit(w) for w in asked]).cast("array<string>"), lambda w: text.contains(w)))


def forget(rows: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Without rows of a person, under any of their ids."""
    return rows.where(F.col(column).isNull() | ~F.lower(column).isin([i.lower() for i in ids]))


def same_questions(now: DataFrame, before: DataFrame) -> DataFrame:
    """``areas, same, agreement_before, agreement_now`` over the areas (``topic, named, declared``) answerable in both."""
    a, b = now.where("named is not null"), before.where("named is not null").select("topic", F.col("named").alias("was"))
    j = a.join(b, ["topic"])
    share = lambda c: F.round(F.avg(F.coalesce((F.col(c) == F.col("declared")).cast("double"), F.lit(0.0))), 6)
    return j.agg(F.count(F.lit(1)).alias("areas"), F.count_if(F.col("named") == F.col("was")).alias("same"), share("was").alias("agreement_before"), share("named").alias("agreement_now"))


def squashed_authors(commits: DataFrame) -> DataFrame:
    """``hash, email``: a no-reply address that two or more names use is replaced by each name's own most used address."""
    no = F.lower("email").contains("noreply")
    shared = commits.where(no).groupBy("email").agg(F.count_distinct("name").alias("names")).where("names >= 2").select("email", F.lit(True).alias("shared"))
    own = commits.where(~no).groupBy("name", F.col("email").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "own"))).where("r = 1").select("name", "own")
    return commits.join(shared, ["email"], "left").join(own, ["name"], "left").select("hash", F.when(F.col("shared"), F.coalesce("own", "email")).otherwise(F.col("email")).alias("email"))


def expand_by_ties(asked: DataFrame, ties: DataFrame, per_word: int = 2, least: float = 0.02, most: int = 3, discount: float = 0.45) -> DataFrame:
    """``token, penalty``: what the question's subjects (``topic``) travel with, strongest first, not asked already."""
    t = ties.join(asked.select(F.col("topic").alias("a")), ["a"]).where(F.col("weight") >= least)
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where(F.col("r") <= per_word)
    t = t.join(asked.select(F.col("topic").alias("b")), ["b"], "left_anti").groupBy("b").agg(F.max("weight").alias("weight"))
    return t.orderBy(F.desc("weight"), "b").limit(most).select(F.col("b").alias("token"), F.lit(discount).alias("penalty"))
