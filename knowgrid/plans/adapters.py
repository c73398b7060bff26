"""The test tables as the engine's own relations: postings, work, person-topic facts, ties, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions.identity import normalize_email
from knowgrid.operators import risk, search
from knowgrid.session import materialise, spread, table

AS_OF = "2001-11-05"
RECENT_FROM = "2001-05-09"


def document_fields(spark: SparkSession, d: str) -> DataFrame:
    """``entity, tokens, weight``: the words of a place's documents (0.5) and of its name (3)."""
    docs = spread(table(spark, d, "documents").where("place is not null").select("place", "text"))
    body = docs.select(F.col("place").alias("entity"), T.ascii_tokens(F.col("text")).alias("tokens"), F.lit(0.5).alias("weight"))
    name = docs.select("place").distinct().select(F.col("place").alias("entity"), T.ascii_tokens(F.col("place")).alias("tokens"), F.lit(3.0).alias("weight"))
    return body.unionByName(name)


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(document_fields(spark, d))


KNOWN_ON = "2026-09-01"
#: What a word weighs in each field of a person.
FIELD_WEIGHT = {"title": 2.0, "team": 1.0, "topic": 3.0, "text": 0.5}


def people_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The stored index of people: ``posting`` (``entity, token, w``) of stems, ``length``, ``field`` (``entity, field,
    token, value``) and ``entity``.

    A person is an address. Words of titles and teams count as they are, those of the components of a person's
    issues and of the texts they wrote decay with age. Text is folded and split where it lies; only distinct words
    are stemmed. Tables are written once; a question reads them.
    """
    address = lambda c: normalize_email(F.col(c))
    people = table(spark, d, "people").select(address("email").alias("entity"), "title", "team").where("entity like '%@%'")
    issues = table(spark, d, "fakeapi").select(address("assignee_email").alias("entity"), "components", "ingested_at").where("entity like '%@%'")
    docs = spread(table(spark, d, "documents").select(address("author_email").alias("entity"), "text", "created_at").where("entity like '%@%'"))
    one = F.lit(1.0)
    part = lambda df, c, field, fresh: df.where(F.col(c).isNotNull()).select("entity", F.lit(field).alias("field"), F.col(c).alias("value"), fresh.alias("fresh"))
    named = part(people.select("entity", "title").distinct(), "title", "title", one).unionByName(part(people.select("entity", "team").distinct(), "team", "team", one))
    named = named.unionByName(part(issues, "components", "topic", T.decay(F.col("ingested_at"), KNOWN_ON)))
    weight = F.create_map(*[F.lit(x) for p in FIELD_WEIGHT.items() for x in p])
    words = named.unionByName(part(docs, "text", "text", T.decay(F.col("created_at"), KNOWN_ON))).select("entity", "field", F.when(F.col("field") != "text", F.col("value")).alias("value"), (weight[F.col("field")] * F.col("fresh")).alias("w"), F.explode(T.tokens(T.fold("value"))).alias("word"))
    grouped = materialise(words.groupBy("entity", "field", "value", "word").agg(F.sum("w").alias("w")), "words")
    stems = materialise(T.stemmed_vocabulary(grouped, "word").select(F.col("token").alias("word"), F.col("stem").alias("token")), "stems")
    stemmed = grouped.join(stems, ["word"])
    post = materialise(stemmed.groupBy("entity", "token").agg(F.sum("w").alias("w")).repartitionByRange("token").sortWithinPartitions("token"), "posting")
    every = people.select("entity").unionByName(issues.select("entity")).unionByName(docs.select("entity")).distinct()
    fields = stemmed.select("entity", F.when(F.col("field") == "text", "mention").otherwise(F.col("field")).alias("field"), "token", F.coalesce("value", "word").alias("value")).distinct()
    return {"posting": post, "length": materialise(search.lengths(post), "length"), "field": materialise(fields, "field"), "entity": materialise(every, "entity")}


def brand_work(spark: SparkSession, d: str) -> DataFrame:
    """``person, topic, unit, container, at``: a customer's lines on brands, an order being the unit of work."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("container"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").alias("at"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("topic"))
    j = l.join(p, l["l_partkey"] == p["p_partkey"]).join(o, l["l_orderkey"] == o["o_orderkey"])
    return j.select("person", "topic", F.col("l_orderkey").alias("unit"), "container", "at")


def nation_facts(spark: SparkSession, d: str) -> DataFrame:
    """``person, topic, w, stated, recent, direct``: suppliers on their nations, decayed from a fixed day."""
    l = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("at"), "l_returnflag")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("topic"))
    j = l.join(s, l["l_suppkey"] == s["person"]).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    facts = j.select("person", "topic", F.col("l_returnflag").alias("source"), "at", F.lit(1.0).alias("base"), T.decay(F.col("at"), AS_OF).alias("decayed"))
    return risk.person_topics(facts, RECENT_FROM, ("R",))


def brand_facts(spark: SparkSession, d: str) -> DataFrame:
    """``person, topic, w, stated, recent, direct`` of customers on brands, undecayed."""
    w = brand_work(spark, d)
    return risk.person_topics(w.select("person", "topic", F.col("container").alias("source"), "at", F.lit(1.0).alias("base"), F.lit(1.0).alias("decayed")), RECENT_FROM, ("1-URGENT",))


# The same relations in SQL, as common table expressions.
STOP = "(" + ", ".join(f"'{w}'" for w in T.W.STOPWORDS) + ")"
POSTINGS_SQL = f"""
f AS (SELECT place AS entity, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS token, 0.5 AS weight FROM documents WHERE place IS NOT NULL
  UNION ALL SELECT place, unnest(regexp_extract_all(lower(place), '([a-z0-9]+)', 1)), 3.0 FROM (SELECT DISTINCT place FROM documents WHERE place IS NOT NULL)),
post AS (SELECT entity, token, CAST(sum(weight) AS DOUBLE) AS w FROM f WHERE length(token) >= 2 AND token NOT IN {STOP} GROUP BY ALL)
"""
_MAIL = r"CASE WHEN {0} LIKE '%@users.noreply.forgehub.example' THEN {0} ELSE regexp_replace({0}, '^([^@+]+)\+[^@]*@', '\1@') END"
_BARE = "lower(trim(CASE WHEN regexp_extract({0}, '<([^<>]*)>', 1) <> '' THEN regexp_extract({0}, '<([^<>]*)>', 1) ELSE {0} END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_FRESH = f"CASE WHEN {{0}} IS NULL OR {{0}} >= TIMESTAMP '{KNOWN_ON}' THEN 1.0 ELSE power(2.0, -(epoch_us(TIMESTAMP '{KNOWN_ON}') - epoch_us({{0}})) / 86400000000.0 / 180.0) END"
PEOPLE_SQL = rf"""
pe AS (SELECT {_MAIL.format('b')} AS entity, title, team FROM (SELECT {_BARE.format('email')} AS b, title, team FROM people) WHERE b LIKE '%@%'),
ie AS (SELECT {_MAIL.format('b')} AS entity, components, ingested_at FROM (SELECT {_BARE.format('assignee_email')} AS b, components, ingested_at FROM fakeapi) WHERE b LIKE '%@%'),
de AS (SELECT {_MAIL.format('b')} AS entity, text, created_at FROM (SELECT {_BARE.format('author_email')} AS b, text, created_at FROM documents) WHERE b LIKE '%@%'),
vals AS (SELECT DISTINCT entity, 'title' AS field, title AS value, 2.0 AS w FROM pe WHERE title IS NOT NULL UNION ALL SELECT DISTINCT entity, 'team', team, 1.0 FROM pe WHERE team IS NOT NULL
  UNION ALL SELECT entity, 'topic', components, 3.0 * {_FRESH.format('ingested_at')} FROM ie WHERE components IS NOT NULL UNION ALL SELECT entity, 'text', text, 0.5 * {_FRESH.format('created_at')} FROM de WHERE text IS NOT NULL),
wd AS (SELECT entity, field, value, w, unnest(regexp_extract_all(lower(strip_accents(value)), '[\p{{L}}\p{{Nd}}]+')) AS word FROM vals),
kept AS (SELECT entity, field, value, w, word, CASE word {{stems}} ELSE word END AS token FROM wd WHERE strlen(word) >= 2 AND word NOT IN {STOP}),
post AS (SELECT entity, token, CAST(sum(w) AS DOUBLE) AS w FROM kept GROUP BY ALL), ents AS (SELECT entity FROM pe UNION SELECT entity FROM ie UNION SELECT entity FROM de),
len AS (SELECT entity, sum(w) AS len FROM post GROUP BY 1)
"""
BRAND_SQL = """
work AS (SELECT o_custkey AS person, p_brand AS topic, l_orderkey AS unit, o_orderpriority AS container, l_shipdate AS dt
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""
NATION_SQL = f"""
nf AS (SELECT s_suppkey AS person, n_name AS topic, l_returnflag AS source, l_shipdate AS dt,
  CASE WHEN l_shipdate IS NULL OR l_shipdate >= TIMESTAMP '{AS_OF}' THEN 1.0 ELSE power(2.0, -(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(l_shipdate)) / 86400000000.0 / 180.0) END AS decayed
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
pt AS (SELECT person, topic, sum(3.0 * decayed) AS w, sum(CASE WHEN source = 'R' THEN 3.0 * decayed ELSE 0.0 END) AS stated,
  sum(CASE WHEN dt >= TIMESTAMP '{RECENT_FROM}' THEN 3.0 * decayed ELSE 0.0 END) AS recent, sum(3.0) AS direct FROM nf GROUP BY ALL)
"""
BRANDPT_SQL = BRAND_SQL + f""",
pt AS (SELECT person, topic, CAST(3 * count(*) AS DOUBLE) AS w, CAST(3 * count(*) FILTER (container = '1-URGENT') AS DOUBLE) AS stated,
  CAST(3 * count(*) FILTER (dt >= TIMESTAMP '{RECENT_FROM}') AS DOUBLE) AS recent, CAST(3 * count(*) AS DOUBLE) AS direct FROM work GROUP BY person, topic)
"""
