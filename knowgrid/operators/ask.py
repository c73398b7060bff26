"""Who knows, from question to explained answer: the operators of search, ties and feedback in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowgrid.functions import words as W
from knowgrid.functions.stem import stem
from knowgrid.operators import knowledge, search


def question_terms(spark: SparkSession, question: str) -> tuple[DataFrame, list[str]]:
    """``term, asked, penalty, covers, how`` of a question, stemmed, with what names the same thing; and its own stems.

    A question is one line: this is driver work, a handful of rows.
    """
    import re

    words = [w for w in re.findall(r"[^\W_]+", question.lower()) if len(w.encode()) >= 2]
    kept = [w for w in words if w not in W.STOPWORDS]
    rows, seen = [], set()
    for t, p, c in search.expand_synonyms(kept, W.SYNONYMS):
        s = stem(t)
        if s not in seen:
            seen.add(s)
            rows.append((s, t, p, stem(c), "word" if p == 1.0 else "synonym"))
    schema = "term string, asked string, penalty double, covers string, how string"
    return spark.createDataFrame(rows, schema), [stem(w) for w in dict.fromkeys(kept)]


def ask(
    spark: SparkSession,
    question: str,
    post: DataFrame,
    fields: DataFrame,
    ties: DataFrame | None = None,
    votes: DataFrame | None = None,
    k: int = 10,
    entities: DataFrame | None = None,
    lens: DataFrame | None = None,
) -> DataFrame:
    """``entity, score, strength, label, reasons, rank`` for a question over postings of stems (``entity, token, w``).

    Words and synonyms resolve to posted stems, exactly or within an edit; subjects that travel with the question's
    (``ties``: ``a, b, weight``) add reach but no coverage, for entities that nothing else reached. Scores take the
    votes, the best 64 are boosted by their strongest field (``fields``: ``entity, field, token, value``), and only
    the rows returned are explained. ``entities`` are all that could be asked for and ``lens`` stored lengths, as
    ``search.score`` takes them. An empty question, or one of stop words only, gives an empty answer.
    """
    asked, stems = question_terms(spark, question)
    vocabulary = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    found = search.resolve_terms(asked.select("term"), vocabulary).select("term", "token", "dist").join(asked, ["term"])
    weight = F.col("penalty") * F.pow(F.lit(0.7), F.col("dist"))
    best_term = found.groupBy("token").agg(F.max(F.struct(weight.alias("penalty"), "covers", "how", "dist", "asked")).alias("b"))
    terms = best_term.select("token", "b.*")
    scored = search.score(post, terms.select("token", "penalty", "covers"), entities, lens).withColumn("score", F.round("score", 9))
    if ties is not None:
        extra = knowledge.expand_by_ties(asked.select(F.col("term").alias("topic")), ties)
        reach = search.score(post, extra.withColumn("covers", F.lit("")), entities, lens)
        reach = reach.join(scored, ["entity"], "left_anti").withColumn("covered", F.lit(0.0))
        scored = scored.unionByName(reach)
    if votes is not None:
        scored = search.apply_feedback(scored, votes, stems)
    hit = fields.join(terms.select("token", "covers", "how", "dist", "asked"), ["token"])
    ranked = search.rerank(scored, hit.select("entity", "field"))
    ranked = ranked.select("entity", F.round("score", 9).alias("score"), F.round("strength", 6).alias("strength"), "head")
    best = search.top(ranked, k, F.desc("head"), F.desc("score"), F.col("entity"))
    how = F.when(F.col("dist") > 0, "fuzzy").otherwise(F.col("how"))
    why = knowledge.reasons(hit.join(best.select("entity"), ["entity"], "left_semi").select("entity", F.col("asked").alias("term"), "field", "value", how.alias("how")))
    label = F.when(F.col("strength") >= 0.75, "strong").when(F.col("strength") >= 0.45, "moderate").when(F.col("strength") > 0, "weak")
    return best.join(why, ["entity"], "left").select("entity", "score", "strength", label.alias("label"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "rank")


def hybrid(named: DataFrame, lists: list[DataFrame], k: int = 10) -> DataFrame:
    """``entity, score``: people a question names outright, then the fused ranking of several lists (``entity, score``)."""
    ranked = []
    for i, l in enumerate(lists):
        r = search.top(l.select("entity", "score"), max(3 * k, 15), F.desc("score"), F.col("entity"))
        ranked.append(r.select(F.lit(i).alias("list"), "entity", "rank"))
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    fused = search.fuse(all_)
    first = named.select(F.col("id").alias("entity"), (F.lit(10.0) + F.col("strength")).alias("score"))
    both = first.unionByName(fused).groupBy("entity").agg(F.max("score").alias("score"))
    return search.top(both, k, F.desc("score"), F.col("entity"))


def routes(post: DataFrame, terms: DataFrame, members: DataFrame, person_scores: DataFrame, k: int = 5) -> DataFrame:
    """``channel, score, members``: channels by their own postings, without a boost, with their best three members."""
    best = search.top(search.score(post, terms), k, F.desc("score"), F.col("entity")).withColumnRenamed("entity", "channel")
    m = members.join(best.select("channel"), ["channel"], "left_semi")
    top3 = search.top_members(m, person_scores).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("place", "person"))).alias("l"))
    return best.join(top3, ["channel"], "left").select("channel", F.round("score", 6).alias("score"), F.transform("l", lambda x: x["person"]).alias("members"), "rank")


def topic_experts(topics: DataFrame, leaders: DataFrame, per_topic: int = 4) -> DataFrame:
    """``entity, score``: the leaders of the topics nearest to a question (``topic, score``), weighted by nearness."""
    lead = leaders.where(F.col("rank") <= per_topic)
    return lead.join(topics.select("topic", F.col("score").alias("near")), ["topic"]).groupBy(F.col("person").alias("entity")).agg(F.sum(F.col("near") / F.col("rank")).alias("score"))


def recall(episodes: DataFrame, participants: DataFrame, found: DataFrame, person: object) -> DataFrame:
    """``episode, score, strength, others``: found episodes of a person with who else was there; refused without a person."""
    if person in (None, ""):
        raise ValueError("recall needs the person who asks")
    mine = participants.where(F.col("person") == person).select("episode").distinct()
    others = participants.where(F.col("person") != person).groupBy("episode").agg(F.array_sort(F.collect_set("person")).alias("others"))
    w = Window.orderBy(F.desc("score"), "episode")
    return found.join(mine, ["episode"], "left_semi").join(episodes.select("episode"), ["episode"], "left_semi").join(others, ["episode"], "left").withColumn("rank", F.row_number().over(w).cast("long"))
