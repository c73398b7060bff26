"""Queries of the training-data operators for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.llm import components, languages, leaks, names, packing, personal
from knowgrid.session import table

LINK_CONFIDENCE = 0.6


def _groups(spark: SparkSession, d: str) -> DataFrame:
    edges = components.match_edges(table(spark, d, "autojoin"), "alias", "canonical", "confidence", LINK_CONFIDENCE)
    return components.connected_groups(edges).select(F.col("v").alias("member_id"), F.col("root").alias("group_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = _groups(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, names.Habits]:
    people = table(spark, d, "people").select("rec_id", "name", "email", "title", "team", "org", "manager")
    mm = table(spark, d, "mailmap")
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "team", "org", "manager")]
    proper, commit = mm.select("rec_id", "name", "email", *none), mm.select("rec_id", F.col("commit_name").alias("name"), F.col("commit_email").alias("email"), *none)
    rows = people.unionByName(proper).unionByName(commit.where("name is not null or email is not null"))
    return rows, names.fit_habits(people)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(*_mentions(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(_entities(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Records with their group and its number of records."""
    groups = _entities(spark, d)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_records"), F.min("rec_id").alias("first_rec_id"))
    return groups.join(sizes, ["group_id"]).select("rec_id", "first_rec_id", "n_records")


def p1_hits(spark: SparkSession, d: str) -> DataFrame:
    """Records by what the trie join says of their typed names: the fewest edits of a hit (-1: none is found), and
    whether an address of the record spells a name itself."""
    m = names.materialise(names.read_mentions(*_mentions(spark, d)), "mentions")
    hits = names.typed_hits(m)[1].groupBy("rec_id").agg(F.min("edits").alias("edits"))
    asked = m.where("size(guess) > 0").groupBy("rec_id").agg(F.bool_or(F.coalesce("spelt", F.lit(False))).alias("spelt"))
    return asked.join(hits, ["rec_id"], "left").groupBy(F.coalesce("edits", F.lit(-1)).alias("edits"), "spelt").agg(F.count(F.lit(1)).alias("n_records"))


def _free_texts(spark: SparkSession, d: str) -> tuple[DataFrame, personal.Lexicon]:
    fields = (("pd_incidents", "description"), ("pd_notes", "content"), ("matters", "narrative"))
    texts = personal.union_texts([(n, table(spark, d, n), c) for n, c in fields])
    return texts, personal.fit_lexicon(table(spark, d, "people").select("rec_id", "name"), texts.select("row_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_pieces(*_free_texts(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_pieces(*_free_texts(spark, d), redacted=True)


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, d, "documents"), "doc_id", "text")).drop("by_program")


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their tokens, the fewest possible by volume, the share of unused space, and of pieces that the
    program placed rather than the packing of its remainder."""
    packed = packing.pack(packing.count_tokens(table(spark, d, "documents"), "doc_id", "text"))
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.count_if("by_program").alias("p"))
    out = full.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.sum("n").alias("n_pieces"), F.round(F.sum("p") / F.sum("n"), 4).alias("by_program"))
    bound = F.ceil(F.col("n_tokens") / packing.CAPACITY)
    return out.withColumn("least_containers", bound).withColumn("unused", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * packing.CAPACITY), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("item_id", "doc_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items by the documents they leaked into and the longest passage."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("span").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    segs = languages.label_stretches(table(spark, d, "documents"))
    return segs.where("n_segs > 1 or label_state <> 'right'").select("doc_id", "seg_no", "lang_code")


def p10_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Languages of all documents with prose: stretches, words and mean confidence."""
    segs = languages.label_stretches(table(spark, d, "documents"))
    return segs.groupBy("lang_code", "label_state").agg(
        F.count(F.lit(1)).alias("n_segs"), F.sum("words").alias("n_words"), F.round(F.avg("confidence"), 4).alias("confidence")
    )


_P4_CTE = """
WITH RECURSIVE i AS (SELECT lower(trim(alias)) AS a, lower(trim(canonical)) AS b, confidence AS s FROM autojoin),
m AS (SELECT a AS id FROM i WHERE a <> '' UNION SELECT b FROM i WHERE b <> ''),
e AS (SELECT a AS x, b AS y FROM i WHERE a <> '' AND b <> '' AND s >= 0.6 UNION SELECT b, a FROM i WHERE a <> '' AND b <> '' AND s >= 0.6),
t(id, g) AS (SELECT id, id FROM m UNION SELECT e.y, t.g FROM t JOIN e ON e.x = t.id AND t.g < e.y),
f AS (SELECT id AS member_id, min(g) AS group_id FROM t GROUP BY id)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_hits": p1_hits,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p4_found": p4_found,
    "p4_sizes": p4_sizes,
    "p8_packing": p8_packing,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_confidence": p10_confidence,
}
ORACLE = {
    "p4_found": _P4_CTE + "SELECT member_id, group_id FROM f",
    "p4_sizes": _P4_CTE + "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM f GROUP BY group_id) GROUP BY size",
}
