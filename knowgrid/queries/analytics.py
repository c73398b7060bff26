"""Queries of the expertise and risk operators, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions import words as W
from knowgrid.functions.identity import normalize_email
from knowgrid.operators import ask, episodes, risk, search, ties, vectors
from knowgrid.plans import adapters as A
from knowgrid.session import materialise, spread, table
from knowgrid.sources import records

QUESTION = ("ledger", "export", "tokens", "retries")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


def _terms(spark: SparkSession, terms) -> DataFrame:
    return spark.createDataFrame([(t, p, c) for t, p, c in terms], "token string, penalty double, covers string")


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, t[1] AS first_term, array_to_string(list_sort(list_distinct(t))[1:5], ' ') AS some FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1), lambda x: length(x) >= 2 AND x NOT IN {A.STOP}) AS t FROM documents)")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.get("t", F.lit(0)).alias("first_term"), F.concat_ws(" ", F.slice(F.sort_array(F.array_distinct("t")), 1, 5)).alias("some"))


@query(None)
def stemmed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of all documents with their stems, and how many words share one."""
    words = spread(table(spark, d, "documents").select("text")).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    v = T.stemmed_vocabulary(words)
    return v.groupBy("stem").agg(F.count(F.lit(1)).alias("n_words"), F.min("token").alias("first_word"))


_TITLE = "list_filter(regexp_extract_all(lower(coalesce(title, '')), '([a-z0-9]+)', 1), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in sorted({*W.CODE_STOP, *W.NOISE_WORDS})) + "))"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(CASE WHEN len(t) >= 2 THEN list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])) ELSE t END) AS token FROM (SELECT {_TITLE} AS t FROM pd_incidents)) GROUP BY token")
def phrase_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pd_incidents").select(F.explode(T.phrase_tokens(F.col("title"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT trim(regexp_replace(lower(service_name), '[^a-z0-9]+', '-', 'g'), '-') AS id, CASE trim(regexp_replace(lower(service_name), '[^a-z0-9]+', '-', 'g'), '-') WHEN 'pg' THEN 'postgres' WHEN 'k8s' THEN 'kubernetes' ELSE trim(regexp_replace(lower(service_name), '[^a-z0-9]+', '-', 'g'), '-') END AS topic FROM pd_incidents WHERE service_name IS NOT NULL""")
def topic_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "pd_incidents").where("service_name is not null")
    return s.select(T.slug(F.col("service_name")).alias("id"), T.topic_id(F.col("service_name")).alias("topic")).distinct()


@query(r"""WITH x AS (SELECT rec_id, lower(trim(CASE WHEN regexp_extract(email, '<([^<>]*)>', 1) <> '' THEN regexp_extract(email, '<([^<>]*)>', 1) ELSE email END)) AS a FROM people WHERE email IS NOT NULL)
SELECT rec_id, CASE WHEN a LIKE '%@users.noreply.forgehub.example' THEN a ELSE regexp_replace(a, '^([^@+]+)\+[^@]*@', '\1@') END AS address FROM x""")
def email_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people").where("email is not null").select("rec_id", normalize_email(F.col("email")).alias("address"))


_ADDRESS = r"""CASE WHEN {0} LIKE '%@users.noreply.forgehub.example' THEN {0} ELSE regexp_replace({0}, '^([^@+]+)\+[^@]*@', '\1@') END"""
_BARE = """lower(trim(CASE WHEN regexp_extract({0}, '<([^<>]*)>', 1) <> '' THEN regexp_extract({0}, '<([^<>]*)>', 1) ELSE {0} END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"""


@query("SELECT strpos(a, '@') > 1 AND split_part(a, '@', 1) IN (" + ", ".join(f"'{w}'" for w in W.ROLE_LOCALS) + ") AS role, count(*) AS n FROM (SELECT " + _ADDRESS.format("b") + " AS a FROM (SELECT " + _BARE.format("email") + " AS b FROM people WHERE email LIKE '%@%')) GROUP BY 1")
def role_mailboxes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "people").where("email like '%@%'").select(normalize_email(F.col("email")).alias("a"))
    return a.groupBy(T.is_role_mailbox(F.col("a")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT rec_id, (name LIKE '%[bot]' OR regexp_matches(regexp_replace(lower(name), '[-_. +]+', ' ', 'g'), '(^| )(bot|robot|mergebot|dependabot|renovatebot)( |$)')) AS bot FROM mailmap WHERE name IS NOT NULL""")
def automation_authors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mailmap").where("name is not null")
    return m.select("rec_id", T.is_automation(F.col("name"), F.lit("")).alias("bot"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|private[_-]?key|auth)\b(\s*[:=]+\s*)["'']?[^\s"'']{6,}["'']?', '\1\2[redacted]', 'g'), '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[redacted]', 'g') AS clean FROM (SELECT doc_id, text || ' token=' || doc_id || 'abcdef AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, '0') AS t FROM documents WHERE text IS NOT NULL)""")
def scrub_secrets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    leaky = F.concat("text", F.lit(" token="), "doc_id", F.lit("abcdef AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))
    return t.select("doc_id", T.scrub(leaky)[0].alias("clean"))


_SERVICES = "SELECT DISTINCT regexp_replace(lower(trim(service_name)), '[^a-z0-9]+', '-', 'g') AS s FROM pd_incidents WHERE trim(service_name) <> ''"


@query(f"WITH n AS ({_SERVICES} UNION SELECT DISTINCT lower(project_key) FROM fakeapi WHERE trim(project_key) <> '' UNION SELECT DISTINCT unnest(string_split(s, '-')) FROM ({_SERVICES})) SELECT a.s AS a, b.s AS b FROM n a, n b WHERE a.s < b.s AND a.s <> '' AND b.s <> '' AND (contains(a.s, b.s) OR contains(b.s, a.s))")
def same_family(spark: SparkSession, d: str) -> DataFrame:
    """Names of services, their words and projects that belong to one family: candidates from shared substrings, then the rule."""
    name = F.regexp_replace(F.lower(F.trim("service_name")), "[^a-z0-9]+", "-")
    services = table(spark, d, "pd_incidents").where("trim(service_name) <> ''").select(name.alias("s")).distinct()
    projects = table(spark, d, "fakeapi").where("trim(project_key) <> ''").select(F.lower("project_key").alias("s"))
    words = services.select(F.explode(F.split("s", "-")).alias("s"))
    names = services.unionByName(projects).unionByName(words).where("s <> ''").distinct()
    return ties.families(names, "s").where(T.same_family(F.col("a"), F.col("b")))


@query("SELECT p_partkey, CAST(CASE WHEN n <= 4 THEN n ELSE least(16, round(4 * (1 + ln(n / 4.0)))) END AS INTEGER) AS repeats FROM (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def topic_repeat(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("p_partkey", T.topic_repeat(F.col("n")).alias("repeats"))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_shipdate >= TIMESTAMP '{A.AS_OF}' THEN 1.0 ELSE power(2.0, -(epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(l_shipdate)) / 86400000000.0 / 180.0) END, 6) AS weight FROM lineitem")
def decay_weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.decay(F.col("l_shipdate"), A.AS_OF), 6).alias("weight"))


@query("SELECT doc_id, substr(place, 1, 8) AS cut FROM documents WHERE place IS NOT NULL")
def truncate_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("place is not null").select("doc_id", T.truncate_bytes(F.col("place"), 8).alias("cut"))


@query(r"""SELECT DISTINCT place, CASE WHEN lower(place) LIKE '%-dev' THEN substr(lower(place), 1, length(place) - 4) WHEN lower(place) LIKE '%-read' THEN substr(lower(place), 1, length(place) - 5) ELSE lower(trim(place)) END AS grp FROM documents WHERE place IS NOT NULL""")
def fold_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("place is not null").select("place", T.fold_group_name(F.col("place")).alias("grp")).distinct()


# --- search -----------------------------------------------------------------------------------------------------------


@query("WITH " + A.POSTINGS_SQL + "SELECT entity, token, round(w, 6) AS w FROM post")
def posting_build(spark: SparkSession, d: str) -> DataFrame:
    return A.document_postings(spark, d).select("entity", "token", r6("w"))


@query("WITH " + A.POSTINGS_SQL + "SELECT entity, round(sum(w), 6) AS len FROM post GROUP BY entity")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return search.lengths(A.document_postings(spark, d)).select("entity", r6("len"))


_SCORED = "WITH " + A.POSTINGS_SQL + """,
len AS (SELECT entity, sum(w) AS len FROM post GROUP BY entity), st AS (SELECT count(*) AS n, avg(len) AS a FROM len),
q(token, penalty, covers) AS (VALUES %s),
h AS (SELECT post.*, penalty, covers FROM post JOIN q USING (token)), df AS (SELECT token, count(DISTINCT entity) AS df FROM h GROUP BY token),
c AS (SELECT entity, covers, penalty * (1 + ln(n / df)) AS pi, CASE WHEN w > 4 THEN 4 * (1 + ln(w / 4)) ELSE w END AS cw, least(1.75, greatest(1.0, 0.25 + 0.75 * len / a)) AS norm
  FROM h JOIN df USING (token) JOIN len USING (entity), st),
s AS (SELECT entity, sum(pi * cw * 2.2 / (cw + 1.2 * norm)) AS score, count(DISTINCT covers) / (SELECT count(DISTINCT covers) FROM q) AS covered FROM c GROUP BY entity)
"""
_PLAIN = ", ".join(f"('{t}', 1.0, '{t}')" for t in QUESTION)


@query(_SCORED % _PLAIN + "SELECT entity, round(score, 6) AS score, round(covered, 6) AS covered, row_number() OVER (ORDER BY round(score, 6) DESC, entity) AS rank FROM s ORDER BY rank LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    s = search.score(A.document_postings(spark, d), _terms(spark, [(t, 1.0, t) for t in QUESTION])).select("entity", r6("score"), r6("covered"))
    return search.top(s, 10, F.desc("score"), F.col("entity"))


@query(_SCORED % _PLAIN + """, ev AS (SELECT DISTINCT place AS entity, CASE WHEN regexp_matches(lower(place), 'ledger|export|tokens|retries') THEN 1.0 ELSE 0.5 END AS e FROM documents WHERE place IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, entity) <= 64 AS head FROM s)
SELECT entity, round(CASE WHEN head THEN round(score, 6) * (0.4 + 0.9 * e) ELSE score END, 6) AS score, round(e * covered, 6) AS strength, head FROM r JOIN ev USING (entity)""")
def evidence_rerank(spark: SparkSession, d: str) -> DataFrame:
    s = search.score(A.document_postings(spark, d), _terms(spark, [(t, 1.0, t) for t in QUESTION])).withColumn("score", F.round("score", 6))
    places = table(spark, d, "documents").where("place is not null").select(F.col("place").alias("entity")).distinct()
    ev = places.select("entity", F.when(F.lower("entity").rlike("|".join(QUESTION)), "topic").otherwise("mention").alias("field"))
    return search.rerank(s, ev).select("entity", r6("score"), r6("strength"), "head")


_SYN = ", ".join(f"('{t}', {p}, '{c}')" for t, p, c in search.expand_synonyms(["outage", "billing", "export"], W.SYNONYMS))


@query(_SCORED % _SYN + "SELECT entity, round(score, 6) AS score, round(covered, 6) AS covered FROM s")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    terms = search.expand_synonyms(["outage", "billing", "export"], W.SYNONYMS)
    return search.score(A.document_postings(spark, d), _terms(spark, terms)).select("entity", r6("score"), r6("covered"))


@query("WITH " + A.POSTINGS_SQL + """, v AS (SELECT token, count(DISTINCT entity) AS df FROM post GROUP BY token), a(term) AS (VALUES ('legder'), ('exprot'), ('retriez'), ('pipelnie'), ('duplicated'), ('tokens')),
m AS (SELECT term, token, 0 AS dist, df FROM a JOIN v ON term = token), n AS (SELECT term, token, levenshtein(term, token) AS dist, df FROM a, v WHERE term NOT IN (SELECT term FROM m) AND length(term) >= 4
  AND levenshtein(term, token) <= CASE WHEN length(term) >= 9 THEN 2 ELSE 1 END)
SELECT term, token, CAST(dist AS INTEGER) AS dist, round(power(0.7, dist), 6) AS penalty FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY dist, df DESC, token) AS r FROM (SELECT * FROM m UNION ALL SELECT * FROM n)) WHERE r = 1""")
def fuzzy_resolve(spark: SparkSession, d: str) -> DataFrame:
    v = A.document_postings(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = spark.createDataFrame([(t,) for t in ("legder", "exprot", "retriez", "pipelnie", "duplicated", "tokens")], "term string")
    return search.resolve_terms(asked, v).select("term", "token", "dist", r6("penalty"))


@query(_SCORED % _PLAIN + "SELECT entity, round(score * power(1.25, least(3, greatest(-3, CASE WHEN entity LIKE '%a' THEN -1 WHEN entity LIKE '%s' THEN 5 ELSE 0 END))), 6) AS score FROM s")
def feedback_rerank(spark: SparkSession, d: str) -> DataFrame:
    s = search.score(A.document_postings(spark, d), _terms(spark, [(t, 1.0, t) for t in QUESTION]))
    places = table(spark, d, "documents").where("place is not null").select(F.col("place").alias("entity")).distinct()
    votes = places.select("entity", F.array(F.lit("ledger")).alias("rule"), F.expr("case when entity like '%a' then -1 when entity like '%s' then 5 else 0 end").alias("vote"))
    other = places.select("entity", F.array(F.lit("elsewhere")).alias("rule"), F.lit(1).alias("vote"))
    return search.apply_feedback(s, votes.unionByName(other), list(QUESTION)).select("entity", r6("score"))


_RANKS = """WITH l AS (SELECT * FROM (SELECT 'balance' AS list, c_custkey AS entity, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer
UNION ALL SELECT 'orders', o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))) """


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of whole tables."""
    bal = search.rank_all(table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal"), "c_acctbal", "entity")
    n = search.rank_all(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n")), "n", "entity")
    return bal.select(F.lit("balance").alias("list"), "entity", "rank").unionByName(n.select(F.lit("orders").alias("list"), "entity", "rank"))


@query(_RANKS + "SELECT entity, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY entity")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse(_two_lists(spark, d)).select("entity", F.round("score", 9).alias("score"))


@query(_RANKS + "SELECT entity, round(sum(1.0 / (1 + rank)), 9) AS score FROM l GROUP BY entity")
def fuse_ranks(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse(_two_lists(spark, d), 1.0).select("entity", F.round("score", 9).alias("score"))


@query("""WITH m AS (SELECT place AS channel, author_email AS person, min(doc_id) AS pos FROM documents WHERE place IS NOT NULL AND author_email IS NOT NULL GROUP BY ALL),
s AS (SELECT author_email AS person, count(*) AS score FROM documents WHERE author_email IS NOT NULL GROUP BY 1)
SELECT channel, person, place FROM (SELECT channel, person, row_number() OVER (PARTITION BY channel ORDER BY score DESC, pos, person) AS place FROM m JOIN s USING (person)) WHERE place <= 3""")
def channel_members(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("author_email is not null")
    m = docs.where("place is not null").groupBy(F.col("place").alias("channel"), F.col("author_email").alias("person")).agg(F.min("doc_id").alias("pos"))
    return search.top_members(m, docs.groupBy(F.col("author_email").alias("person")).agg(F.count(F.lit(1)).alias("score")))


@query("""SELECT rec_id AS id, greatest(CASE WHEN lower(name) = 'mira' THEN 100 ELSE 0 END, CASE WHEN lower(name) LIKE 'mira%' THEN 60 ELSE 0 END, CASE WHEN lower(name) LIKE '%mira%' THEN 40 ELSE 0 END,
 CASE WHEN lower(email) LIKE '%mira%' THEN 30 ELSE 0 END, CASE WHEN lower(title) LIKE '%mira%' THEN 15 ELSE 0 END, CASE WHEN lower(team) LIKE '%mira%' THEN 12 ELSE 0 END) AS score,
 array_to_string(list_filter([CASE WHEN lower(name) LIKE '%mira%' THEN 'name' END, CASE WHEN lower(email) LIKE '%mira%' THEN 'email' END, CASE WHEN lower(title) LIKE '%mira%' THEN 'title' END, CASE WHEN lower(team) LIKE '%mira%' THEN 'team' END], lambda x: x IS NOT NULL), ',') AS matched
 FROM people WHERE lower(name) LIKE '%mira%' OR lower(email) LIKE '%mira%' OR lower(title) LIKE '%mira%' OR lower(team) LIKE '%mira%'""")
def direct_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "people").select(F.col("rec_id").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "email", "title", "team")])
    return search.direct_search(p, "mira")


def _tiers(w: str) -> str:
    sc = f"greatest(CASE WHEN lower(name) = '{w}' THEN 100 ELSE 0 END, CASE WHEN lower(name) LIKE '{w}%' THEN 60 ELSE 0 END, CASE WHEN lower(name) LIKE '%{w}%' THEN 40 ELSE 0 END, CASE WHEN lower(email) LIKE '%{w}%' THEN 30 ELSE 0 END, CASE WHEN lower(title) LIKE '%{w}%' THEN 15 ELSE 0 END, CASE WHEN lower(team) LIKE '%{w}%' THEN 12 ELSE 0 END)"
    mt = ", ".join(f"CASE WHEN lower({c}) LIKE '%{w}%' THEN '{c}' END" for c in ("name", "email", "title", "team"))
    return f"SELECT rec_id AS id, {sc} AS score, array_to_string(list_filter([{mt}], lambda x: x IS NOT NULL), ',') AS matched FROM people"


@query(f"WITH f AS ({_tiers('mira')} UNION ALL {_tiers('lund')}) SELECT id, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, matched) AS r FROM f WHERE score > 0) WHERE r = 1 ORDER BY score DESC, id LIMIT 20")
def suggest_people(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "people").select(F.col("rec_id").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "email", "title", "team")])
    return search.suggest(p, "is Mira of Lund?")


@query("""SELECT rec_id AS id, CASE WHEN lower(name) = 'hana rovnypald' THEN 1.0 ELSE 0.9 END AS strength FROM people WHERE lower(name) = 'hana rovnypald' OR (
 len(list_filter(string_split_regex(lower(name), '\\s+'), lambda p: starts_with(p, 'hana') OR (length(p) >= 4 AND levenshtein(p, 'hana') <= 1))) > 0 AND
 len(list_filter(string_split_regex(lower(name), '\\s+'), lambda p: starts_with(p, 'rovnypald') OR (length(p) >= 4 AND levenshtein(p, 'rovnypald') <= 1))) > 0)""")
def name_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "people").select(F.col("rec_id").alias("id"), "name", F.coalesce("email", F.lit("")).alias("email"))
    return search.name_match(p, "Who is Hana Rovnypald?", W.NAME_PREFIXES, W.NAME_SUFFIXES)


ASKED = "Who do I talk to about the ledger export and retries?"
_ASK = "WITH " + A.PEOPLE_SQL.replace("{stems}", "WHEN 'ledgers' THEN 'ledger' WHEN 'exports' THEN 'export' WHEN 'exported' THEN 'export' WHEN 'exporting' THEN 'export' WHEN 'retries' THEN 'retri' WHEN 'retry' THEN 'retri' WHEN 'retried' THEN 'retri' WHEN 'talk' THEN 'talk' WHEN 'talks' THEN 'talk' WHEN 'talked' THEN 'talk' WHEN 'talking' THEN 'talk'") + """,
h AS (SELECT * FROM post WHERE token IN ('ledger', 'export', 'retri', 'talk')), df AS (SELECT token, count(*) AS df FROM h GROUP BY 1),
c AS (SELECT h.entity, token, 1 + ln((SELECT count(*) FROM ents) / df) AS i, CASE WHEN w > 4 THEN 4 * (1 + ln(w / 4)) ELSE w END AS cw, least(1.75, greatest(1.0, 0.25 + 0.75 * len / (SELECT avg(len) FROM len))) AS norm FROM h JOIN df USING (token) JOIN len ON len.entity = h.entity),
sc AS (SELECT entity, round(sum(i * cw * 2.2 / (cw + 1.2 * norm)), 9) AS score, count(DISTINCT token) / (SELECT count(*) FROM df) AS covered FROM c GROUP BY 1),
ev AS (SELECT entity, max(CASE field WHEN 'topic' THEN 1.0 WHEN 'title' THEN 0.85 WHEN 'team' THEN 0.7 ELSE 0.5 END) AS e FROM kept WHERE token IN ('ledger', 'export', 'retri', 'talk') GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity) <= 64 AS head FROM sc),
bo AS (SELECT entity, head, round(CASE WHEN head THEN score * (0.4 + 0.9 * e) ELSE score END, 9) AS score, round(e * covered, 6) AS strength FROM rk JOIN ev USING (entity)),
top AS (SELECT *, row_number() OVER (ORDER BY head DESC, score DESC, entity) AS rank FROM bo ORDER BY rank LIMIT 10)
"""


def _answer(spark: SparkSession, d: str) -> DataFrame:
    x = A.people_index(spark, d)
    return ask.ask(spark, ASKED, x["posting"], x["field"], entities=x["entity"], lens=x["length"])


@query(_ASK + "SELECT entity, round(score, 6) AS score, strength, CASE WHEN strength >= 0.75 THEN 'strong' WHEN strength >= 0.45 THEN 'moderate' WHEN strength > 0 THEN 'weak' END AS label, rank FROM top")
def ask_topk(spark: SparkSession, d: str) -> DataFrame:
    """Who knows about something: a question over the stored index of people, ranked."""
    return _answer(spark, d).select("entity", r6("score"), "strength", "label", "rank")


@query(_ASK + """, hit AS (SELECT DISTINCT entity, token, CASE WHEN field = 'text' THEN 'mention' ELSE field END AS field, CASE WHEN field = 'text' THEN word ELSE value END AS value FROM kept JOIN top USING (entity) WHERE token IN ('ledger', 'export', 'retri', 'talk')),
best AS (SELECT *, row_number() OVER (PARTITION BY entity, token ORDER BY CASE field WHEN 'topic' THEN 0 WHEN 'title' THEN 1 WHEN 'team' THEN 2 ELSE 3 END, value) AS r FROM hit)
SELECT entity, array_to_string(list_sort(list(DISTINCT field || ' ' || value)), '; ') AS reasons FROM best WHERE r = 1 GROUP BY 1""")
def ask_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each of them was named: the strongest field for each word of the question."""
    return _answer(spark, d).select("entity", F.array_join("reasons", "; ").alias("reasons"))


# --- facts, risk, ownership, places ---------------------------------------------------------------------------------


@query("WITH " + A.NATION_SQL + "SELECT person, topic, round(w, 6) AS w, round(stated, 6) AS stated, round(recent, 6) AS recent, round(direct, 6) AS direct FROM pt")
def person_topic_facts(spark: SparkSession, d: str) -> DataFrame:
    return A.nation_facts(spark, d).select("person", "topic", *[r6(c) for c in ("w", "stated", "recent", "direct")])


@query("WITH " + A.BRANDPT_SQL + "SELECT topic, count(DISTINCT person) AS holders, (SELECT count(DISTINCT person) FROM pt) >= 60 AND count(DISTINCT person) > 0.35 * (SELECT count(DISTINCT person) FROM pt) AS ubiquitous FROM pt WHERE w > 0 GROUP BY topic")
def ubiquity_mark(spark: SparkSession, d: str) -> DataFrame:
    return risk.ubiquitous(A.brand_facts(spark, d))


_LEAD = """, wk AS (SELECT person, topic, w - stated AS work FROM pt WHERE round(w - stated, 9) > 0), tot AS (SELECT person, sum(work) AS total FROM wk GROUP BY person),
lead AS (SELECT topic, person, round(work / power(total, 0.5), 9) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(work / power(total, 0.5), 9) DESC, person) AS rank FROM wk JOIN tot USING (person))"""
_BUS = """, b0 AS (SELECT *, sum(w) OVER (PARTITION BY topic) AS total, coalesce(sum(w) OVER (PARTITION BY topic ORDER BY w DESC, person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pt WHERE w > 0),
bus AS (SELECT topic, round(max(total), 6) AS total, count(*) AS experts, count(*) FILTER (round(before / total, 9) < 0.8) AS bus FROM b0 GROUP BY topic),
med AS (SELECT CASE WHEN count(*) >= 12 THEN list_sort(list(total))[CAST(floor(count(*) / 2) AS INTEGER) + 1] ELSE -1 END AS m FROM bus),
risk AS (SELECT topic, total, experts, bus, CASE WHEN total < m THEN CASE WHEN experts = 1 OR bus <= 1 THEN 'elevated' ELSE 'ok' END ELSE CASE WHEN experts = 1 OR bus <= 1 THEN 'critical' WHEN bus = 2 THEN 'elevated' ELSE 'ok' END END AS level FROM bus, med)"""


@query("WITH " + A.NATION_SQL + _LEAD + " SELECT topic, person, round(score, 6) AS score, rank FROM lead WHERE rank <= 3")
def leaders_topk(spark: SparkSession, d: str) -> DataFrame:
    return risk.leaders(A.nation_facts(spark, d)).select("topic", "person", r6("score"), "rank")


@query("WITH " + A.BRANDPT_SQL + """, k AS (SELECT person, topic, w, topic LIKE '%3' AS s, bool_or(topic LIKE '%3') OVER (PARTITION BY person) AS h FROM pt WHERE w > 0)
SELECT person, topic, round(w, 6) AS w, rank FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY w DESC, topic) AS rank FROM k WHERE s OR NOT h) WHERE rank <= 3""")
def person_top_topics(spark: SparkSession, d: str) -> DataFrame:
    salient = table(spark, d, "part").where("p_brand like '%3'").select(F.col("p_brand").alias("topic"))
    return risk.top_topics(A.brand_facts(spark, d), salient).select("person", "topic", r6("w"), "rank")


@query("WITH " + A.NATION_SQL + _BUS + " SELECT topic, total, experts, CAST(bus AS BIGINT) AS bus, level FROM risk")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    return risk.risk(A.nation_facts(spark, d)).withColumn("bus", F.col("bus").cast("long"))


@query("WITH " + A.NATION_SQL + _LEAD + _BUS + " SELECT person, count(*) FILTER (experts = 1) AS sole, count(*) FILTER (level <> 'ok') AS leads FROM lead JOIN risk USING (topic) WHERE rank = 1 GROUP BY person HAVING sole > 0 OR leads > 0")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    pt = A.nation_facts(spark, d)
    return risk.exposure(pt, risk.risk(pt))


@query("WITH " + A.NATION_SQL + _LEAD + _BUS + " SELECT topic, experts, CAST(bus AS BIGINT) AS bus, level FROM lead JOIN risk USING (topic) WHERE rank = 1 AND person = (SELECT min(person) FROM lead WHERE rank = 1)")
def departure_impact(spark: SparkSession, d: str) -> DataFrame:
    """What the first of the leaders, by id, would leave behind."""
    pt = A.nation_facts(spark, d)
    first = risk.leaders(pt, 1).agg(F.min("person")).first()[0]
    return risk.departure(pt, risk.risk(pt), first).select("topic", "experts", F.col("bus").cast("long").alias("bus"), "level")


@query("WITH " + A.NATION_SQL + _BUS + " SELECT count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'elevated') AS elevated, count(*) FILTER (experts = 1) AS single_point, count(*) AS topics FROM risk")
def headline_counts(spark: SparkSession, d: str) -> DataFrame:
    r = risk.risk(A.nation_facts(spark, d))
    return r.agg(F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "elevated").alias("elevated"), F.count_if(F.col("experts") == 1).alias("single_point"), F.count(F.lit(1)).alias("topics"))


_OWN = """, dec AS (SELECT n_name AS topic, CAST(min(s_suppkey) AS VARCHAR) AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0 GROUP BY 1
  UNION ALL SELECT n_name, 'owners:acme/' || lower(n_name) || '-squad' FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT n_name, 'owners:release-bot' FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT n_name, '-1' FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey % 7 <> 0),
team AS (SELECT n_nationkey AS team, n_name AS name FROM nation WHERE n_nationkey <> 21 UNION ALL SELECT 100 + n_nationkey, n_name || ' Team' FROM nation WHERE n_nationkey = 14),
fl AS (SELECT team, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f FROM team), tf AS (SELECT team, f FROM fl UNION SELECT team, regexp_replace(f, 'team$', '') FROM fl),
sq AS (SELECT owner, min(team) AS team FROM dec JOIN tf ON f = regexp_replace(regexp_replace(split_part(owner, '/', 2), '-squad$', ''), '[^a-z0-9]', '', 'g') WHERE owner LIKE '%/%' GROUP BY 1 HAVING count(DISTINCT team) = 1),
grp AS (SELECT topic, bool_and(owner LIKE '%/%' OR owner LIKE '%-bot') AS g FROM dec GROUP BY 1),
own AS (SELECT topic, owner FROM dec JOIN grp USING (topic) WHERE NOT g UNION SELECT topic, CAST(s_suppkey AS VARCHAR) FROM dec JOIN grp USING (topic) JOIN sq USING (owner) JOIN supplier ON s_nationkey = team WHERE g AND s_suppkey % 2 = 0),
hd AS (SELECT person, bool_or(direct > 0) AS h FROM pt GROUP BY 1),
wo AS (SELECT pt.*, round(w - stated, 9) AS other, CASE WHEN h THEN direct ELSE greatest(round(w - stated, 9), 0) END AS here FROM pt JOIN hd USING (person)),
act AS (SELECT topic, person AS actual, here AS best FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY direct DESC, other DESC, person) AS r FROM wo WHERE direct > 0) WHERE r = 1),
o AS (SELECT own.topic, list_sort(list(DISTINCT owner)) AS owners, bool_or(owner = CAST(actual AS VARCHAR)) AS leads, max(coalesce(here, 0)) AS most, bool_or(owner IN (SELECT CAST(person AS VARCHAR) FROM wo WHERE other > 0)) AS works, bool_or(coalesce(other > 0, false)) AS wh, max(best) AS best, min(actual) AS actual
  FROM own JOIN act USING (topic) LEFT JOIN wo ON wo.topic = own.topic AND CAST(wo.person AS VARCHAR) = owner GROUP BY 1),
areas AS (SELECT topic, array_to_string(owners, ',') AS owners, CASE WHEN leads OR NOT (most <= 0 OR (best >= 4.5 AND best > most)) THEN 'held' WHEN NOT works THEN 'silent' WHEN NOT wh THEN 'unworked' ELSE 'trailing' END AS standing, CAST(actual AS VARCHAR) AS actual FROM o
  UNION ALL SELECT topic, '', 'group', NULL FROM grp WHERE g AND topic NOT IN (SELECT topic FROM o) AND topic IN (SELECT topic FROM act))"""


def _areas(spark: SparkSession, d: str) -> DataFrame:
    """Nations as areas: suppliers, squads (one of two teams' name, one of no team's) and machines own them."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("topic"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("person"))
    one = s.join(n.where("k % 7 <> 0"), ["k"]).groupBy("topic").agg(F.min("person").cast("string").alias("owner"))
    squad = n.where("k % 7 = 0").select("topic", F.concat(F.lit("owners:acme/"), F.lower("topic"), F.lit("-squad")).alias("owner"))
    machine = n.where("k % 5 = 0").select("topic", F.lit("owners:release-bot").alias("owner"))
    gone = n.where("k % 5 = 1 and k % 7 <> 0").select("topic", F.lit("-1").alias("owner"))
    teams = n.where("k <> 21").select(F.col("k").cast("long").alias("team"), F.col("topic").alias("name"))
    teams = teams.unionByName(n.where("k = 14").select((F.col("k") + 100).cast("long").alias("team"), F.concat("topic", F.lit(" Team")).alias("name")))
    known = risk.squad_teams(squad, teams, W.TEAM_SUFFIXES)
    members = known.join(s.where("person % 2 = 0").select(F.col("k").cast("long").alias("team"), F.col("person").cast("string").alias("person")), ["team"]).select("owner", "person")
    return risk.owned_areas(one.unionByName(squad).unionByName(machine).unionByName(gone), A.nation_facts(spark, d), members)


@query("WITH " + A.NATION_SQL + _OWN + " SELECT topic, owners, standing, actual FROM areas")
def owned_areas(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).withColumn("owners", F.array_join("owners", ","))


@query("WITH " + A.NATION_SQL + _OWN + """, c AS (SELECT count(*) AS declared, count(*) FILTER (standing = 'held') AS held, count(*) FILTER (standing = 'silent') AS silent, count(*) FILTER (standing = 'unworked') AS unworked, count(*) FILTER (standing = 'trailing') AS "trailing", count(*) FILTER (standing = 'group') AS "group" FROM areas)
SELECT *, CASE WHEN declared > "group" THEN round((silent + unworked + "trailing") / (declared - "group"), 6) ELSE 0.0 END AS share FROM c""")
def ownership_report(spark: SparkSession, d: str) -> DataFrame:
    return risk.ownership_report(_areas(spark, d))


_PLACES = """WITH w AS (SELECT place, author_email AS person, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE place IS NOT NULL AND author_email IS NOT NULL GROUP BY ALL), br AS (SELECT person, sum(n) AS b FROM w GROUP BY 1),
s AS (SELECT *, round(n / power(b, 0.25), 9) AS s FROM w JOIN br USING (person)), t AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY s DESC, person) AS r, sum(s) OVER (PARTITION BY place) AS total,
 coalesce(sum(s) OVER (PARTITION BY place ORDER BY s DESC, person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
p AS (SELECT place, count(*) AS people, sum(n) AS work, max(person) FILTER (r = 1) AS holder, round(max(s / total) FILTER (r = 1), 6) AS share, CAST(count(*) FILTER (round(before / total, 9) < 0.8) AS BIGINT) AS bus FROM t GROUP BY place)"""


def _place_work(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("place is not null and author_email is not null").select("place", F.col("author_email").alias("person"), F.lit(1).alias("n"))


@query(_PLACES + " SELECT * FROM p")
def place_leads(spark: SparkSession, d: str) -> DataFrame:
    return risk.place_leads(_place_work(spark, d)).withColumn("bus", F.col("bus").cast("long"))


@query(_PLACES + " SELECT place, bus, work FROM p ORDER BY bus, work DESC, place LIMIT 10")
def most_fragile(spark: SparkSession, d: str) -> DataFrame:
    return risk.place_leads(_place_work(spark, d)).select("place", F.col("bus").cast("long").alias("bus"), "work").orderBy("bus", F.desc("work"), "place").limit(10)


# --- ties --------------------------------------------------------------------------------------------------------------

_TIES = "WITH " + A.BRAND_SQL + """, u AS (SELECT DISTINCT unit, topic, person FROM work), ok AS (SELECT unit FROM u GROUP BY unit HAVING count(DISTINCT topic) BETWEEN 2 AND 18), v AS (SELECT u.* FROM u JOIN ok USING (unit)),
pr AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n, count(DISTINCT x.person) AS witnesses, min(x.person) AS one FROM v x JOIN v y ON x.unit = y.unit AND x.topic < y.topic AND NOT contains(x.topic, y.topic) AND NOT contains(y.topic, x.topic) GROUP BY ALL),
seen AS (SELECT topic, count(*) AS seen FROM v GROUP BY topic), it AS (SELECT count(DISTINCT unit) AS items FROM v), good AS (SELECT topic, seen FROM seen, it WHERE seen >= 5 AND (items < 200 OR seen <= 0.35 * items)),
w AS (SELECT a, b, round(n / (x.seen + y.seen - n), 9) AS weight, witnesses, CASE WHEN witnesses = 1 THEN one END AS sole FROM pr JOIN good x ON x.topic = a JOIN good y ON y.topic = b WHERE n >= 3 AND n / (x.seen + y.seen - n) >= 0.001),
ties AS (SELECT * FROM w UNION ALL SELECT b, a, weight, witnesses, sole FROM w)"""


def _ties(spark: SparkSession, d: str) -> DataFrame:
    u = materialise(ties.units(A.brand_work(spark, d).select("unit", "topic", F.col("person").alias("who"))), "units")
    return ties.weigh(ties.cooccurrence(u), u)


@query(_TIES + " SELECT a, b, round(weight, 6) AS weight, witnesses FROM ties")
def ties_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).select("a", "b", r6("weight"), "witnesses")


@query(_TIES + " SELECT a, b, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM ties) WHERE rank <= 12")
def ties_strongest(spark: SparkSession, d: str) -> DataFrame:
    return ties.strongest(_ties(spark, d)).select("a", "b", r6("weight"), "rank")


@query(_TIES + """, deg AS (SELECT a, count(*) AS k FROM ties GROUP BY a), hub AS (SELECT a FROM deg WHERE (SELECT count(*) FROM deg) >= 20 AND k > 0.99 * (SELECT count(*) FROM deg))
SELECT a, b, round(weight, 6) AS weight FROM ties WHERE a NOT IN (SELECT a FROM hub) AND b NOT IN (SELECT a FROM hub)""")
def ties_scaffold_drop(spark: SparkSession, d: str) -> DataFrame:
    return ties.drop_scaffold(_ties(spark, d), share=0.99).select("a", "b", r6("weight"))


@query("WITH " + A.BRANDPT_SQL + """, h AS (SELECT DISTINCT person, topic FROM pt WHERE w > 0), n AS (SELECT topic, count(*) AS n FROM h GROUP BY 1)
SELECT x.topic, y.topic AS other, count(*) AS shared, round(count(*) / max(n), 6) AS overlap FROM h x JOIN h y ON x.person = y.person AND x.topic <> y.topic JOIN n ON n.topic = y.topic GROUP BY ALL HAVING round(count(*) / max(n), 9) >= 0.6""")
def related_by_experts(spark: SparkSession, d: str) -> DataFrame:
    return ties.related(A.brand_facts(spark, d)).select("topic", "other", "shared", r6("overlap"))


_SUPTIES = """WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(alias)) AS a, lower(trim(canonical)) AS b FROM autojoin WHERE trim(alias) <> '' AND trim(canonical) <> '' AND confidence >= 0.6 AND lower(trim(alias)) <> lower(trim(canonical))),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t(id, r) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, t.r FROM t JOIN g ON g.a = t.id AND t.r < g.b)"""


@query(_SUPTIES + " SELECT id AS node, min(r) AS root FROM t GROUP BY id")
def identity_cc(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lower(F.trim("alias")), F.lower(F.trim("canonical"))
    e = table(spark, d, "autojoin").where("confidence >= 0.6").select(a.alias("a"), b.alias("b")).where("a <> '' and b <> '' and a <> b")
    return ties.components(e)


_CHAIN = """WITH RECURSIVE ts AS (SELECT p_partkey AS k, 't' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS topic, (p_partkey // 10) % 3 AS lead FROM part),
tie AS (SELECT a.topic AS a, b.topic AS b FROM ts a JOIN ts b ON b.k = a.k + 1 WHERE a.k % 10 <> 6), same AS (SELECT a, b FROM tie JOIN ts x ON x.topic = a JOIN ts y ON y.topic = b WHERE x.lead = y.lead),
e AS (SELECT a, b FROM same UNION SELECT b, a FROM same), r(t, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.t AND r.root < e.b), m AS (SELECT t, min(root) AS region FROM r GROUP BY 1)
SELECT lead, region, t AS topic FROM m JOIN ts ON ts.topic = t WHERE region IN (SELECT region FROM m GROUP BY 1 HAVING count(*) >= 3)"""


@query(_CHAIN)
def regions_cc(spark: SparkSession, d: str) -> DataFrame:
    """Subjects tied in chains, ten under one lead, with a gap in each chain: regions of seven and of three, whose ends
    only components join; the pairs at the ends of the table are too small for one."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("t"), F.lpad(c.cast("string"), 8, "0"))
    parts = table(spark, d, "part").select("p_partkey")
    nxt = parts.select((k - 1).alias("p_partkey"))
    tie = parts.where("p_partkey % 10 <> 6").join(nxt, ["p_partkey"]).select(name(k).alias("a"), name(k + 1).alias("b"))
    both = tie.unionByName(tie.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return ties.regions(both, parts.select(name(k).alias("topic"), F.expr("(p_partkey div 10) % 3").alias("person")))


@query("""WITH work AS (SELECT row_id AS unit, unnest([upper(matter), lower(service)]) AS topic, who FROM (SELECT row_id, split_part(assignee_email, '@', 1) AS matter, service_name AS service, assignee_email AS who FROM pd_incidents WHERE service_name IS NOT NULL AND assignee_email IS NOT NULL)),
v AS (SELECT DISTINCT unit, topic, who FROM work WHERE unit IN (SELECT unit FROM work GROUP BY unit HAVING count(DISTINCT topic) BETWEEN 2 AND 18)), pr AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n, count(DISTINCT x.who) AS witnesses, min(x.who) AS one FROM v x JOIN v y ON x.unit = y.unit AND x.topic < y.topic AND NOT contains(x.topic, y.topic) AND NOT contains(y.topic, x.topic) GROUP BY ALL),
seen AS (SELECT topic, count(*) AS seen FROM v GROUP BY 1), it AS (SELECT count(DISTINCT unit) AS items FROM v), good AS (SELECT topic, seen FROM seen, it WHERE seen >= 5 AND (items < 200 OR seen <= 0.35 * items)),
w AS (SELECT a, b, round(n / (x.seen + y.seen - n), 9) AS weight, witnesses, one FROM pr JOIN good x ON x.topic = a JOIN good y ON y.topic = b WHERE n >= 3 AND n / (x.seen + y.seen - n) >= 0.001), t AS (SELECT * FROM w UNION ALL SELECT b, a, weight, witnesses, one FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rk FROM t) SELECT r.one AS person, r.a, r.b, round(r.weight, 6) AS weight FROM r JOIN r k ON k.a = r.b AND k.b = r.a WHERE r.witnesses = 1 AND r.a < r.b AND r.rk <= 3 AND k.rk <= 3""")
def sole_spans(spark: SparkSession, d: str) -> DataFrame:
    """Connections of services and personal queues that one assignee alone makes."""
    i = table(spark, d, "pd_incidents").where("service_name is not null and assignee_email is not null")
    topics = F.explode(F.array(F.upper(F.substring_index("assignee_email", "@", 1)), F.lower("service_name")))
    w = i.select(F.col("row_id").alias("unit"), topics.alias("topic"), F.col("assignee_email").alias("who"))
    return ties.sole_spans(ties.weigh(ties.cooccurrence(w), w)).select("person", "a", "b", r6("weight"))


@query(_TIES + """, one AS (SELECT DISTINCT topic, CASE WHEN topic LIKE '%1' THEN 'p' || (person % 40) ELSE 'p' || (person % 9) END AS c FROM work), w2 AS (SELECT topic FROM one GROUP BY 1 HAVING (SELECT count(DISTINCT c) FROM one) >= 3 AND count(*) > 0.5 * (SELECT count(DISTINCT c) FROM one))
SELECT a, b, round(weight, 6) AS weight FROM ties WHERE a NOT IN (SELECT topic FROM w2) AND b NOT IN (SELECT topic FROM w2)""")
def ties_spread_drop(spark: SparkSession, d: str) -> DataFrame:
    """Without brands that most of the (made-up) places have."""
    w = A.brand_work(spark, d)
    place = F.when(F.col("topic").endswith("1"), F.concat(F.lit("p"), F.col("person") % 40)).otherwise(F.concat(F.lit("p"), F.col("person") % 9))
    return ties.drop_spread(_ties(spark, d), w.select("topic", place.alias("container"))).select("a", "b", r6("weight"))


@query(_TIES + " SELECT a, b, round(weight, 6) AS weight FROM ties WHERE a LIKE '%5' OR b LIKE '%5'")
def ties_standing(spark: SparkSession, d: str) -> DataFrame:
    standing = table(spark, d, "part").where("p_brand like '%5'").select(F.col("p_brand").alias("topic"))
    return ties.standing_only(_ties(spark, d), standing).select("a", "b", r6("weight"))


@query(_TIES + """, c AS (SELECT a, b, weight, witnesses, sole, 'orders' AS source FROM ties UNION ALL SELECT a, b, CASE WHEN a LIKE '%2' THEN weight * 2 ELSE weight END, 1, NULL, 'board' FROM ties WHERE b LIKE '%3')
SELECT a, b, round(weight, 6) AS weight, witnesses, source FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, source) AS r FROM c) WHERE r = 1""")
def ties_claims(spark: SparkSession, d: str) -> DataFrame:
    """Of two sources' claims the stronger one of each pair."""
    t = materialise(_ties(spark, d), "ties")
    board = t.where("b like '%3'").select("a", "b", F.when(F.col("a").like("%2"), F.col("weight") * 2).otherwise(F.col("weight")).alias("weight"), F.lit(1).cast("long").alias("witnesses"), F.lit(None).cast(t.schema["sole"].dataType).alias("sole"))
    return ties.strongest_claim(t.withColumn("source", F.lit("orders")).unionByName(board.withColumn("source", F.lit("board")))).select("a", "b", r6("weight"), "witnesses", "source")


@query("""WITH m AS (SELECT DISTINCT place AS grp, author_email AS person FROM documents WHERE place IS NOT NULL AND author_email IS NOT NULL), f AS (SELECT min(person) AS p FROM m), z AS (SELECT grp, count(*) AS size FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
mine AS (SELECT grp, size FROM m JOIN z USING (grp), f WHERE person = p) SELECT person AS other, round(sum(1.0 / (size - 1)), 6) AS weight FROM m JOIN mine USING (grp), f WHERE person <> p GROUP BY 1""")
def near_people(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("place is not null and author_email is not null").select(F.col("place").alias("grp"), F.col("author_email").alias("person"))
    first = m.agg(F.min("person")).first()[0]
    return ties.near_groups(m, first).select("other", r6("weight"))


@query("WITH " + A.BRANDPT_SQL + """, r AS (SELECT person, sum(w) AS reach FROM pt GROUP BY 1), me AS (SELECT topic, w AS mw, reach AS mr FROM pt JOIN r USING (person) WHERE person = 1)
SELECT person AS other, round(sum(least(w, mw) / (sqrt(reach) * sqrt(mr)) * 0.5), 6) AS weight FROM pt JOIN me USING (topic) JOIN r USING (person) WHERE person <> 1 GROUP BY 1""")
def near_by_topics(spark: SparkSession, d: str) -> DataFrame:
    return ties.near_topics(A.brand_facts(spark, d), 1)


# --- vectors, episodes, evaluation ---------------------------------------------------------------------------------


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


_COS = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q)"


@query(_COS + " SELECT vec_id, score FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(table(spark, d, "embeddings"), _first_vector(spark, d), 20)
    return near.select("vec_id", r6("score"))


@query(_COS + ", l AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20), m AS (SELECT list_reverse_sort(list(score))[11] AS m FROM l) SELECT vec_id, score, round(least(1.0, greatest(0.0, (score - m) / 0.15)), 4) AS standout FROM l, m WHERE (score - m) / 0.15 >= 0.05")
def standout(spark: SparkSession, d: str) -> DataFrame:
    near = cosine_topk(spark, d)
    return vectors.standout(near).select("vec_id", "score", F.round("standout", 4).alias("standout"))


@query("""WITH e AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127.0 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / scale) AS BIGINT))) AS BIGINT) AS total FROM e""")
def quantize(spark: SparkSession, d: str) -> DataFrame:
    q, scale = vectors.quantise(F.col("embedding"))
    e = table(spark, d, "embeddings").select("vec_id", q.alias("q"), F.round(scale, 9).alias("scale"))
    return e.select("vec_id", "scale", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"))


_SESS = """WITH x AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x)"""


@query(_SESS + " SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM y GROUP BY ALL")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = episodes.sessions(table(spark, d, "events"), "user_id", "ts")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_EPI = f"""WITH p AS (SELECT doc_id AS episode, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS token FROM documents WHERE text IS NOT NULL %s) WHERE length(token) >= 2 AND token NOT IN {A.STOP} GROUP BY ALL),
h AS (SELECT episode, sum(tf / (tf + 3)) AS s, count(DISTINCT token) AS met FROM p WHERE token IN ('ledger', 'export', 'stale') GROUP BY 1)
SELECT episode, round(s * (met / 3) * CASE WHEN created_at IS NULL OR created_at >= TIMESTAMP '2026-09-01' THEN 1.0 ELSE power(0.5, (epoch_us(TIMESTAMP '2026-09-01') - epoch_us(created_at)) / 86400000000.0 / 365.0) END, 6) AS score, round(met / 3, 6) AS strength
FROM h JOIN documents ON doc_id = episode ORDER BY score DESC, episode LIMIT 5"""


def _episode_posts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "created_at"))
    posts = docs.select(F.col("doc_id").alias("episode"), F.explode(T.ascii_tokens(F.col("text"))).alias("token")).groupBy("episode", "token").agg(F.count(F.lit(1)).alias("tf"))
    return posts, docs.select(F.col("doc_id").alias("episode"), F.col("created_at").alias("occurred"))


@query(_EPI % "")
def episode_search(spark: SparkSession, d: str) -> DataFrame:
    posts, eps = _episode_posts(spark, d)
    return episodes.search(posts, eps, ["ledger", "export", "stale"], "2026-09-01").select("episode", r6("score"), "strength")


@query(_EPI % "AND author_email = (SELECT min(author_email) FROM documents)")
def recall_scoped(spark: SparkSession, d: str) -> DataFrame:
    posts, eps = _episode_posts(spark, d)
    who = table(spark, d, "documents").select(F.col("doc_id").alias("episode"), F.col("author_email").alias("person"))
    first = who.agg(F.min("person")).first()[0]
    return episodes.search(episodes.scoped(posts, who, first), eps, ["ledger", "export", "stale"], "2026-09-01").select("episode", r6("score"), "strength")


@query("""WITH old AS (SELECT o_custkey AS k, max(o_totalprice) AS price, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT o_custkey AS k, max(o_totalprice) AS price, CAST(NULL AS TIMESTAMP) AS at FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT k, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, coalesce(n.at, o.at) AS at FROM old o FULL JOIN new n USING (k)""")
def incremental_fold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    agg = lambda x, at: x.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), at.alias("at"))
    old, new = agg(o.where("o_orderkey % 2 = 0"), F.max("o_orderdate")), agg(o.where("o_orderkey % 2 = 1"), F.max(F.lit(None).cast("timestamp_ntz")))
    return episodes.upsert(old, new, "k", ("at",))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT k, 'added' AS change FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'removed' FROM a WHERE k NOT IN (SELECT k FROM b)""")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") < F.to_timestamp(F.lit("1998-01-01")).cast("timestamp_ntz")).alias("before"))
    a, b = o.where("before").select("k").distinct(), o.where("not before").select("k").distinct()
    return b.join(a, ["k"], "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, ["k"], "left_anti").withColumn("change", F.lit("removed")))


@query("""SELECT address, name FROM (SELECT address, name, row_number() OVER (PARTITION BY address ORDER BY n DESC, name) AS r
FROM (SELECT lower(trim(email)) AS address, name, count(*) AS n FROM people WHERE email LIKE '%@%' AND name IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def modal_name(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, d, "people").where("email like '%@%' and name is not null").groupBy(F.lower(F.trim("email")).alias("address"), "name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("address").orderBy(F.desc("n"), "name"))).where("r = 1").select("address", "name")


@query("SELECT p_brand AS topic, count(DISTINCT o_custkey) AS holders, count(*) AS uses, max(l_shipdate) AS last_at FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def directory_topics(spark: SparkSession, d: str) -> DataFrame:
    return A.brand_work(spark, d).groupBy("topic").agg(F.count_distinct("person").alias("holders"), F.count(F.lit(1)).alias("uses"), F.max("at").alias("last_at"))


@query("SELECT team, count(*) AS size, count(DISTINCT manager) AS managers FROM people WHERE team IS NOT NULL GROUP BY team")
def directory_teams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people").where("team is not null").groupBy("team").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("manager").alias("managers"))


@query("WITH " + A.BRAND_SQL + """, past AS (SELECT topic, person, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, person) AS r FROM work WHERE dt < TIMESTAMP '1999-01-01' GROUP BY topic, person),
fut AS (SELECT topic, person, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, person) AS r FROM work WHERE dt >= TIMESTAMP '1999-01-01' GROUP BY topic, person)
SELECT past.topic, past.person AS lead, coalesce(min(fut.r), 0) AS later_rank FROM past LEFT JOIN fut ON fut.topic = past.topic AND fut.person = past.person WHERE past.r = 1 GROUP BY ALL""")
def holdout_eval(spark: SparkSession, d: str) -> DataFrame:
    """Leaders of the past and their rank in what followed."""
    from pyspark.sql import Window

    cut = F.to_timestamp(F.lit("1999-01-01")).cast("timestamp_ntz")
    w = A.brand_work(spark, d)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "person")).cast("long")
    past = w.where(F.col("at") < cut).groupBy("topic", "person").agg(F.count(F.lit(1)).alias("n")).withColumn("r", rank).where("r = 1")
    fut = w.where(F.col("at") >= cut).groupBy("topic", "person").agg(F.count(F.lit(1)).alias("n")).withColumn("later_rank", rank)
    return past.select("topic", F.col("person").alias("lead")).join(fut.select("topic", F.col("person").alias("lead"), "later_rank"), ["topic", "lead"], "left").withColumn("later_rank", F.coalesce("later_rank", F.lit(0)))


@query("""WITH p AS (SELECT l_suppkey AS k, count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS past, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS future FROM lineitem GROUP BY 1)
SELECT k, past, future, future < 0.1 * past AS quiet FROM p""")
def survival_eval(spark: SparkSession, d: str) -> DataFrame:
    cut = F.to_timestamp(F.lit("1999-01-01")).cast("timestamp_ntz")
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_shipdate") < cut).alias("past"), F.count_if(F.col("l_shipdate") >= cut).alias("future"))
    return p.withColumn("quiet", F.col("future") < 0.1 * F.col("past"))


@query("WITH " + A.BRAND_SQL + """, truth AS (SELECT topic, min(person) AS person FROM (SELECT topic, person, count(*) AS n, rank() OVER (PARTITION BY topic ORDER BY count(*) DESC) AS r FROM work GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1),
g AS (SELECT topic, person, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, person) AS r FROM work GROUP BY 1, 2)
SELECT round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS p1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS p3, round(avg(1.0 / r), 6) AS mrr FROM truth JOIN g USING (topic, person)""")
def precision_mrr(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = A.brand_work(spark, d).groupBy("topic", "person").agg(F.count(F.lit(1)).alias("n"))
    truth = n.withColumn("r", F.rank().over(Window.partitionBy("topic").orderBy(F.desc("n")))).where("r <= 2").groupBy("topic").agg(F.min("person").alias("person"))
    got = n.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "person")))
    j = truth.join(got, ["topic", "person"])
    return j.agg(*[F.round(F.avg(c), 6).alias(k) for k, c in (("p1", F.when(F.col("r") == 1, 1.0).otherwise(0.0)), ("p3", F.when(F.col("r") <= 3, 1.0).otherwise(0.0)), ("mrr", 1 / F.col("r")))])


@query("WITH " + A.POSTINGS_SQL + """, g AS (SELECT token, sum(w) AS g FROM post GROUP BY 1 HAVING sum(w) >= 3), gg AS (SELECT sum(w) AS all_w FROM post), t AS (SELECT entity, sum(w) AS tot FROM post GROUP BY 1),
l AS (SELECT entity, token, round((w / tot) / (g / all_w), 6) AS lift FROM post JOIN g USING (token) JOIN t USING (entity), gg), many AS (SELECT token FROM l WHERE lift > 1 GROUP BY 1 HAVING count(*) > greatest(1, 0.25 * (SELECT count(*) FROM t)))
SELECT entity, token, lift FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY lift DESC, token) AS r FROM l WHERE token NOT IN (SELECT token FROM many)) WHERE r <= 6""")
def vocab_lift(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    post = A.document_postings(spark, d)
    g = post.groupBy("token").agg(F.sum("w").alias("g")).where("g >= 3")
    tot, all_ = post.groupBy("entity").agg(F.sum("w").alias("tot")), post.agg(F.sum("w").alias("all_w"), F.count_distinct("entity").alias("n"))
    l = post.join(g, ["token"]).join(tot, ["entity"]).crossJoin(all_).withColumn("lift", F.round((F.col("w") / F.col("tot")) / (F.col("g") / F.col("all_w")), 6))
    many = l.where("lift > 1").groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where(F.col("k") > F.greatest(F.lit(1.0), 0.25 * F.col("n")))
    kept = l.join(many.select("token"), ["token"], "left_anti")
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("lift"), "token"))).where("r <= 6").select("entity", "token", "lift")


@query("""WITH m AS (SELECT rec_id, name, email, commit_name, commit_email, lower(commit_email) AS e, lower(commit_name) AS n FROM mailmap WHERE name IS NOT NULL AND email IS NOT NULL),
both_ AS (SELECT e, n, min({'a': email, 'b': name}) AS s FROM m WHERE n IS NOT NULL GROUP BY 1, 2), alone AS (SELECT e, min({'a': email, 'b': name}) AS s FROM m WHERE n IS NULL GROUP BY 1)
SELECT rec_id, coalesce(both_.s.b, alone.s.b, commit_name) AS name, coalesce(both_.s.a, alone.s.a, commit_email) AS email FROM mailmap x LEFT JOIN both_ ON both_.e = lower(x.commit_email) AND both_.n = lower(x.commit_name) LEFT JOIN alone ON alone.e = lower(x.commit_email)""")
def mailmap_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every commit identity under its proper name and address, by the whole files."""
    m = table(spark, d, "mailmap")
    proper = m.where("name is not null and email is not null").select(F.col("name").alias("proper_name"), F.col("email").alias("proper_email"), "commit_name", "commit_email")
    return records.mailmap_resolve(m.select("rec_id", F.col("commit_name").alias("name"), F.col("commit_email").alias("email")), proper).select("rec_id", "name", "email")


@query("SELECT source, max(created_at) AS cursor_at FROM documents WHERE created_at IS NOT NULL GROUP BY 1")
def watermarks(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").where("created_at is not null").select("source", F.lit("all").alias("scope"), F.col("created_at").alias("cursor"), F.lit(True).alias("complete"))
    return episodes.watermarks(runs).select("source", F.col("cursor").alias("cursor_at"))


@query("SELECT source, count(*) AS records, count(text) AS with_content, min(created_at) AS oldest, max(created_at) AS newest FROM documents GROUP BY source")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("text").alias("with_content"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


@query("SELECT p.rec_id, b.name AS boss, p.team, p.org FROM people p LEFT JOIN (SELECT lower(trim(email)) AS e, min(name) AS name FROM people WHERE email LIKE '%@%' GROUP BY 1) b ON b.e = lower(trim(p.manager))")
def profiles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "people")
    boss = p.where("email like '%@%'").groupBy(F.lower(F.trim("email")).alias("e")).agg(F.min("name").alias("boss"))
    return p.join(boss, F.lower(F.trim("manager")) == F.col("e"), "left").select("rec_id", "boss", "team", "org")


@query("""WITH f AS (SELECT team, regexp_replace(lower(team), '[^a-z0-9]', '', 'g') AS flat FROM (SELECT DISTINCT team FROM people WHERE team IS NOT NULL)),
g AS (SELECT team, flat AS form FROM f UNION SELECT team, CASE WHEN flat LIKE '%squad' THEN flat[:-6] WHEN flat LIKE '%team' THEN flat[:-5] WHEN flat LIKE '%group' THEN flat[:-6] WHEN flat LIKE '%crew' THEN flat[:-5] WHEN flat LIKE '%engineering' THEN flat[:-12] WHEN flat LIKE '%eng' THEN flat[:-4] WHEN flat LIKE '%developers' THEN flat[:-11] WHEN flat LIKE '%dev' THEN flat[:-4] END FROM f),
s AS (SELECT DISTINCT 'owners:acme/' || lower(replace(trim(team), ' ', '-')) || '-squad' AS owner, regexp_replace(lower(team), '[^a-z0-9]', '', 'g') AS form FROM f)
SELECT owner, min(team) AS team FROM s JOIN g USING (form) WHERE form <> '' GROUP BY 1 HAVING count(DISTINCT team) = 1""")
def squad_teams(spark: SparkSession, d: str) -> DataFrame:
    """Squads of an ownership file with the one team of the org chart that each means; spellings of one team are several."""
    t = table(spark, d, "people").where("team is not null").select("team").distinct()
    squads = t.select(F.concat(F.lit("owners:acme/"), F.lower(F.replace(F.trim("team"), F.lit(" "), F.lit("-"))), F.lit("-squad")).alias("owner"))
    return risk.squad_teams(squads, t.select("team", F.col("team").alias("name")), W.TEAM_SUFFIXES)
