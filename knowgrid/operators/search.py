"""Expert search: postings, lengths, BM25-like scores, coverage and strength, fuzzy terms, fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowgrid.session import materialise

#: How fast repeated weight saturates, how much a long profile is discounted, and the bounds of both.
K1, B, TERM_CAP, NORM_CAP = 1.2, 0.75, 4.0, 1.75
#: Evidence by field, and the window in which it re-ranks.
EVIDENCE = {"topic": 1.0, "title": 0.85, "team": 0.7, "mention": 0.5}
RERANK_WINDOW = 64


def postings(fields: DataFrame) -> DataFrame:
    """``entity, token, w`` summed from ``entity, tokens, weight``; the weights of a task combine before the shuffle."""
    return fields.select("entity", "weight", F.explode("tokens").alias("token")).groupBy("entity", "token").agg(F.sum("weight").alias("w"))


def lengths(post: DataFrame) -> DataFrame:
    """``entity, len``: total weight of an entity."""
    return post.groupBy("entity").agg(F.sum("w").alias("len"))


def idf(n: Column, df: Column) -> Column:
    return 1 + F.log(n / df)


def term_score(w: Column, length: Column, average: Column, idf_: Column, penalty: Column) -> Column:
    """One term's score: weight beyond the cap counts logarithmically, long profiles are discounted within bounds."""
    capped = F.when(w > TERM_CAP, TERM_CAP * (1 + F.log(w / TERM_CAP))).otherwise(w)
    norm = F.least(F.lit(NORM_CAP), F.greatest(F.lit(1.0), 1 - B + B * length / average))
    return penalty * idf_ * capped * (K1 + 1) / (capped + K1 * norm)


def score(post: DataFrame, terms: DataFrame, entities: DataFrame | None = None, lens: DataFrame | None = None) -> DataFrame:
    """``entity, score, covered, n_terms`` for query terms (``token, penalty, covers``).

    ``terms`` is one question and is joined to the postings by token; document frequencies come from all postings.
    ``covers`` is the word of the question a term stands for: coverage is the share of these that an entity has.
    The number of documents is that of all ``entities`` (those with postings, if none are given); ``lens`` are
    stored lengths (``entity, len``), so that a question reads its own words' postings only.
    """
    lens = lengths(post) if lens is None else lens
    n = lens.agg(F.count(F.lit(1)).alias("n")) if entities is None else entities.agg(F.count_distinct("entity").alias("n"))
    stats = lens.agg(F.avg("len").alias("avg_len")).crossJoin(n)
    asked = terms.agg(F.count_distinct("covers").alias("n_terms"))
    hits = post.join(F.broadcast(terms), ["token"])
    df = hits.groupBy("token").agg(F.count_distinct("entity").alias("df"))
    scored = hits.join(df, ["token"]).join(lens, ["entity"]).crossJoin(stats).crossJoin(asked)
    s = term_score(F.col("w"), F.col("len"), F.col("avg_len"), idf(F.col("n"), F.col("df")), F.col("penalty"))
    return scored.groupBy("entity").agg(F.sum(s).alias("score"), (F.count_distinct("covers") / F.max("n_terms")).alias("covered"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows with their rank; every ranking has a total order."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_all(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Every row with its rank by ``value``, largest first, then by ``tie`` (a key of the rows).

    No task sees all rows: they are cut into ranges in the order of the ranking, ranked within each, and moved by
    the counts of the ranges before. Of these there are as many as the session has shuffle partitions. Rows without
    a value come last.
    """
    order = (F.desc(value), F.col(tie))
    # Written once: cuts of the ranges are sampled, and another reading might cut elsewhere.
    cut = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = cut.withColumn("_k", within).join(F.broadcast(before), ["_range"])
    return ranked.withColumn("rank", F.col("_k") + F.col("_o")).drop("_range", "_k", "_o")


def rerank(scored: DataFrame, evidence: DataFrame, window: int = RERANK_WINDOW) -> DataFrame:
    """All scored entities; the best ``window`` boosted by their strongest field (0.4 + 0.9 evidence), the rest as they are.

    ``evidence`` is ``entity, field``; an entity without any counts as a mention. ``head`` tells the boosted ones,
    which rank before the others whatever the boost makes of them.
    """
    table = F.create_map(*[F.lit(x) for p in EVIDENCE.items() for x in p])
    best = evidence.groupBy("entity").agg(F.max(table[F.col("field")]).alias("evidence"))
    # At most ``window`` rows, whatever the data.
    head = top(scored.select("entity", "score"), window, F.desc("score"), F.col("entity")).select("entity", F.lit(True).alias("head"))
    j = scored.join(F.broadcast(head), ["entity"], "left").join(best, ["entity"], "left")
    ev, first = F.coalesce("evidence", F.lit(EVIDENCE["mention"])), F.coalesce("head", F.lit(False))
    return j.select("entity", F.when(first, F.col("score") * (0.4 + 0.9 * ev)).otherwise(F.col("score")).alias("score"), (ev * F.col("covered")).alias("strength"), first.alias("head"))


def resolve_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, token, dist, penalty``: the posted token of each asked word (``term``).

    Exact if it is posted; else, from four letters on, the nearest token within one edit (two from nine letters on),
    then the one more entities have (``df``), then by name; each edit costs 0.7. Candidates are joined by length, so a
    word meets only the tokens whose length is in reach.
    """
    exact = asked.join(vocabulary, asked["term"] == vocabulary["token"]).select("term", "token", F.lit(0).alias("dist"))
    rest = asked.join(vocabulary.select(F.col("token").alias("term")), ["term"], "left_anti").where(F.length("term") >= 4)
    rest = rest.withColumn("edits", F.when(F.length("term") >= 9, 2).otherwise(1))
    reach = rest.select("term", "edits", F.explode(F.sequence(F.length("term") - F.col("edits"), F.length("term") + F.col("edits"))).alias("n"))
    near = reach.join(vocabulary.withColumn("n", F.length("token")), ["n"])
    near = near.withColumn("dist", F.levenshtein("term", "token")).where("dist <= edits")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("dist", F.desc("df"), "token"))).where("r = 1")
    return exact.unionByName(best.select("term", "token", "dist")).withColumn("penalty", F.pow(F.lit(0.7), F.col("dist")))


def expand_synonyms(asked: list[str], groups: tuple[tuple[str, ...], ...], discount: float = 0.8) -> list[tuple[str, float, str]]:
    """(term, penalty, covered word) of a question's words and of what else names the same thing.

    A word or phrase of two or three neighbours that is in a group adds the group's other single words. Groups are a
    fixed list and a question is a line, so this is the driver's work.
    """
    out = [(w, 1.0, w) for w in dict.fromkeys(asked)]
    known = {w for w, _, _ in out}
    for n in (3, 2, 1):
        for i in range(len(asked) - n + 1):
            phrase = " ".join(asked[i : i + n])
            for g in groups:
                if phrase in g:
                    for m in g:
                        if " " not in m and m not in known:
                            known.add(m)
                            out.append((m, discount, asked[i]))
    return out


def feedback_factor(net: Column) -> Column:
    """1.25 to the votes' sum, within three either way."""
    return F.pow(F.lit(1.25), F.least(F.lit(3), F.greatest(F.lit(-3), net)))


def apply_feedback(scored: DataFrame, votes: DataFrame, terms: list[str]) -> DataFrame:
    """Scores times the factor of the votes (``entity, rule, vote``) whose rule's words are all in the question."""
    fits = F.size(F.array_except("rule", F.array(*[F.lit(t) for t in terms]))) == 0
    net = votes.where(fits).groupBy("entity").agg(F.sum("vote").alias("net"))
    return scored.join(net, ["entity"], "left").withColumn("score", F.col("score") * feedback_factor(F.coalesce("net", F.lit(0)))).drop("net")


def fuse(lists: DataFrame, damp: float = 60.0) -> DataFrame:
    """``entity, score``: reciprocal ranks of several lists (``list, entity, rank``) summed."""
    return lists.groupBy("entity").agg(F.sum(1 / (F.lit(damp) + F.col("rank"))).alias("score"))


def top_members(members: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """``channel, person, place``: the best-scored members of each channel; ties by their order there."""
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "pos", "person")
    return members.join(scores, ["person"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("channel", "person", F.col("place").cast("long").alias("place"))


def direct_search(people: DataFrame, query: str) -> DataFrame:
    """``id, score, matched`` of people whose name, address, title or team holds ``query``; the best tier counts."""
    q = query.lower()
    tiers = [
        (F.lower("name") == q, 100, "name"), (F.lower("name").startswith(q), 60, "name"), (F.lower("name").contains(q), 40, "name"),
        (F.lower("email").contains(q), 30, "email"), (F.lower("title").contains(q), 15, "title"), (F.lower("team").contains(q), 12, "team"),
    ]
    s = F.greatest(*[F.when(c, v).otherwise(0) for c, v, _ in tiers])
    kinds = F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, k) for c, _, k in tiers]))), ",")
    return people.select("id", s.alias("score"), kinds.alias("matched")).where("score > 0")


def suggest(people: DataFrame, question: str, k: int = 20, least: int = 3) -> DataFrame:
    """``id, score, matched`` for a question that found nothing: each of its words of ``least`` letters or more looked up by
    itself, everyone with their best word; of equal ones the first in the alphabet."""
    import re

    words = [w for w in dict.fromkeys(re.findall(r"\w+", question.lower())) if len(w) >= least]
    found = None
    for w in words:  # the words of one line
        hit = direct_search(people, w)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return direct_search(people, "").limit(0)
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "matched")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("score"), F.col("b.matched").alias("matched")).orderBy(F.desc("score"), "id").limit(k)


def name_match(people: DataFrame, question: str, prefixes: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """``id, strength`` of the people a question names: whole name 1.0, address or its local part 0.95, every word a
    prefix or (from four letters) one edit away from a part of the name 0.9."""
    q = question.lower().strip(" ?")
    for p in prefixes:
        if q.startswith(p):
            q = q[len(p) :]
            break
    for s in suffixes:
        if q.endswith(s):
            q = q[: -len(s)]
            break
    words = [F.lit(w) for w in q.split()]
    parts = F.split(F.lower("name"), r"\s+")
    meets = lambda w: F.exists(parts, lambda p: p.startswith(w) | ((F.length(w) >= 4) & (F.length(p) >= 4) & (F.levenshtein(p, w) <= 1)))
    every = F.forall(F.array(*words), meets) if len(words) >= 2 else F.lit(False)
    s = F.when(F.lower("name") == q, 1.0).when((F.lower("email") == q) | (F.substring_index(F.lower("email"), "@", 1) == q), 0.95).when(every, 0.9)
    return people.select("id", s.alias("strength")).where("strength is not null")
