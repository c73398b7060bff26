"""Queries of identities, subjects, conversations and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions import words as W
from knowgrid.functions.identity import normalize_email
from knowgrid.operators import conversations, episodes, identity, ingest, knowledge, risk, ties
from knowgrid.plans import adapters as A
from knowgrid.queries.analytics import _ADDRESS, _BARE, _TIES, _TITLE, _ties
from knowgrid.session import table
from knowgrid.sources import records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_PEOPLE = "p AS (SELECT lower(trim(email)) AS id, min(name) AS name, lower(trim(email)) AS email FROM people WHERE email LIKE '%@%' AND name IS NOT NULL AND email NOT LIKE '%<%' GROUP BY 1)"
_HANDLES = "h AS (SELECT DISTINCT 'git:' || split_part(ce, '@', 1) AS id FROM (SELECT lower(trim(commit_email)) AS ce FROM mailmap WHERE commit_email LIKE '%@%' AND commit_email NOT LIKE '%+%'))"


def _people(spark: SparkSession, d: str) -> DataFrame:
    mail = F.lower(F.trim("email"))
    return table(spark, d, "people").where("email like '%@%' and name is not null and email not like '%<%'").groupBy(mail.alias("id")).agg(F.min("name").alias("name")).withColumn("email", F.col("id"))


def _handles(spark: SparkSession, d: str) -> DataFrame:
    ce = F.lower(F.trim("commit_email"))
    return table(spark, d, "mailmap").where("commit_email like '%@%' and commit_email not like '%+%'").select(F.concat(F.lit("git:"), F.substring_index(ce, "@", 1)).alias("id")).distinct()


_FLAT = r"regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]', '', 'g')"


@query(f"WITH {_PEOPLE}, {_HANDLES}, k AS (SELECT id, {_FLAT.format('name')} AS k FROM p UNION SELECT id, {_FLAT.format('split_part(email, chr(64), 1)')} FROM p), j AS (SELECT h.id AS alias, k.id AS t FROM h JOIN k ON {_FLAT.format('substr(h.id, 5)')} = k WHERE length(k) >= 3) SELECT alias, min(t) AS canonical FROM j GROUP BY alias HAVING count(DISTINCT t) = 1")
def identity_flat_name(spark: SparkSession, d: str) -> DataFrame:
    return identity.pass_flat_name(_handles(spark, d), _people(spark, d)).select("alias", "canonical")


@query(f"WITH {_PEOPLE}, {_HANDLES}, s AS (SELECT id, {_FLAT.format('list_last(w)')} AS s, w[1][1] AS i FROM (SELECT id, string_split_regex(lower(trim(name)), '\\s+') AS w FROM p) WHERE len(w) >= 2), k AS (SELECT id, unnest([s, i || s]) AS k FROM s WHERE length(s) >= 5), j AS (SELECT h.id AS alias, k.id AS t FROM h JOIN k ON {_FLAT.format('substr(h.id, 5)')} = k) SELECT alias, min(t) AS canonical FROM j GROUP BY alias HAVING count(DISTINCT t) = 1")
def identity_initial_surname(spark: SparkSession, d: str) -> DataFrame:
    return identity.pass_initial_surname(_handles(spark, d), _people(spark, d)).select("alias", "canonical")


@query(f"WITH {_PEOPLE}, {_HANDLES}, q AS (SELECT id, {_FLAT.format('name')} AS f FROM p WHERE len(string_split_regex(trim(name), '\\s+')) >= 2), j AS (SELECT h.id AS alias, q.id AS t FROM (SELECT id, {_FLAT.format('substr(id, 5)')} AS h FROM h) h JOIN q ON length(h) >= 8 AND length(f) >= 8 AND (starts_with(h, f) OR starts_with(f, h))) SELECT alias, min(t) AS canonical FROM j GROUP BY alias HAVING count(DISTINCT t) = 1")
def identity_prefix(spark: SparkSession, d: str) -> DataFrame:
    return identity.pass_prefix(_handles(spark, d), _people(spark, d)).select("alias", "canonical")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """``id, topic``: where people write and which components they work on."""
    docs = table(spark, d, "documents").where("author_email is not null and place is not null").select(normalize_email(F.col("author_email")).alias("id"), F.col("place").alias("topic"))
    return docs.unionByName(table(spark, d, "fakeapi").where("assignee_email is not null and components is not null").select(normalize_email(F.col("assignee_email")).alias("id"), F.lower("components").alias("topic"))).distinct()


def _everyone(spark: SparkSession, d: str) -> DataFrame:
    """``id, name, email`` of every address with each name typed beside it."""
    mail = normalize_email(F.col("email"))
    return table(spark, d, "people").where("email like '%@%' and trim(name) <> ''").select(mail.alias("id"), F.trim("name").alias("name"), mail.alias("email")).distinct()


_ALL = "en AS (SELECT DISTINCT " + _ADDRESS.format("b") + " AS id, name FROM (SELECT " + _BARE.format("email") + " AS b, trim(name, ' ') AS name FROM people WHERE email LIKE '%@%' AND trim(name, ' ') <> ''))"
_SUBJ = "sj AS (SELECT " + _ADDRESS.format("b") + " AS id, place AS topic FROM (SELECT " + _BARE.format("author_email") + " AS b, place FROM documents WHERE author_email IS NOT NULL AND place IS NOT NULL) UNION SELECT " + _ADDRESS.format("b") + ", lower(components) FROM (SELECT " + _BARE.format("assignee_email") + " AS b, components FROM fakeapi WHERE assignee_email IS NOT NULL AND components IS NOT NULL))"


@query(f"WITH {_ALL}, {_SUBJ}, two AS (SELECT lower(name) AS k, min(id) AS a, max(id) AS b FROM en WHERE name LIKE '% %' GROUP BY 1 HAVING count(DISTINCT id) = 2), sh AS (SELECT a, b FROM two JOIN sj x ON x.id = a JOIN sj y ON y.id = b AND y.topic = x.topic GROUP BY k, a, b HAVING count(*) >= 1) SELECT DISTINCT b AS alias, a AS canonical FROM sh")
def identity_same_name(spark: SparkSession, d: str) -> DataFrame:
    """Pass 6, with one shared subject for the test tables' few."""
    return identity.pass_same_name(_everyone(spark, d), _subjects(spark, d), 1).select("alias", "canonical")


@query(f"WITH {_ALL}, l AS (SELECT DISTINCT id, CASE WHEN id LIKE '%noreply%' THEN regexp_replace(regexp_replace(split_part(id, '@', 1), '^[0-9]+\\+', ''), '\\.', '', 'g') ELSE regexp_replace(split_part(id, '@', 1), '\\.', '', 'g') END AS k FROM en WHERE NOT (strpos(id, '@') > 1 AND split_part(id, '@', 1) IN (" + ", ".join(f"'{w}'" for w in W.ROLE_LOCALS) + f"""))), {_SUBJ},
two AS (SELECT k, min(id) AS a, max(id) AS b FROM l WHERE length(k) >= 5 GROUP BY 1 HAVING count(*) = 2), nm AS (SELECT id, min(name) AS n FROM en GROUP BY 1), g AS (SELECT k, a, b, x.n AS an, y.n AS bn FROM two JOIN nm x ON x.id = a JOIN nm y ON y.id = b),
ok AS (SELECT a, b FROM g WHERE NOT (lower(an) = lower(bn) AND an NOT LIKE '% %') AND {_FLAT.format("string_split_regex(an, '[ 	]+')[1]")} <> k AND {_FLAT.format("string_split_regex(bn, '[ 	]+')[1]")} <> k)
SELECT b AS alias, a AS canonical FROM ok JOIN sj x ON x.id = a JOIN sj y ON y.id = b AND y.topic = x.topic GROUP BY a, b HAVING count(*) >= 1""")
def identity_same_mailbox(spark: SparkSession, d: str) -> DataFrame:
    """Pass 8, with one shared subject for the test tables' few."""
    return identity.pass_same_local(_everyone(spark, d), _subjects(spark, d), 1).select("alias", "canonical")


@query(None)
def identity_ledger(spark: SparkSession, d: str) -> DataFrame:
    """All ten passes in sequence: handles that those before them left, then people."""
    handles = _handles(spark, d).select("id", F.col("id").alias("name"), F.lit(None).cast("string").alias("email"))
    return identity.infer(_everyone(spark, d).unionByName(handles), _subjects(spark, d))


_CC = """WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(alias)) AS a, lower(trim(canonical)) AS b FROM autojoin WHERE trim(alias) <> '' AND trim(canonical) <> '' AND confidence >= 0.6 AND lower(trim(alias)) <> lower(trim(canonical))),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t(id, r) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, t.r FROM t JOIN g ON g.a = t.id AND t.r < g.b), c AS (SELECT id, min(r) AS root FROM t GROUP BY 1)"""


@query(_CC + " SELECT c.id AS alias, list_sort(list_transform(list(c2.id), lambda x: CASE WHEN x LIKE '%@%' THEN '0' WHEN x LIKE '%:%' THEN '2' ELSE '1' END || x))[1][2:] AS canonical FROM c JOIN c c2 USING (root) GROUP BY c.id")
def identity_aliases(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lower(F.trim("alias")), F.lower(F.trim("canonical"))
    return identity.aliases(table(spark, d, "autojoin").where("confidence >= 0.6").select(a.alias("a"), b.alias("b")).where("a <> '' and b <> '' and a <> b"))


@query(f"WITH w AS (SELECT assignee_email AS a, reporter_email AS r, components AS c, project_key AS p, {_TITLE.replace('title', 'summary')} AS t FROM fakeapi), x AS (SELECT unnest(list_distinct(list_filter([a, r], lambda z: z IS NOT NULL))) AS person, * FROM w), y AS (SELECT person, trim(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '-') AS topic, true AS stated FROM x WHERE c IS NOT NULL UNION ALL SELECT person, unnest(CASE WHEN len(t) >= 2 THEN list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])) ELSE t END), false FROM x UNION ALL SELECT person, lower(p), false FROM x WHERE p IS NOT NULL) SELECT person, topic, stated, count(*) AS n FROM y WHERE topic <> '' GROUP BY ALL")
def issue_topics(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "fakeapi")
    comp = F.when(F.col("components").isNotNull(), F.array("components"))
    return records.issues(i.select(F.col("assignee_email").alias("assignee"), F.col("reporter_email").alias("reporter"), comp.alias("components"), F.lit(None).cast("array<string>").alias("labels"), F.col("project_key").alias("project"), "summary"))


@query("SELECT timekeeper_email AS person, practice_area AS topic, count(*) AS n, count(DISTINCT matter) AS matters FROM matters WHERE timekeeper_email IS NOT NULL AND practice_area IS NOT NULL GROUP BY ALL")
def time_entry_topics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "matters").where("timekeeper_email is not null and practice_area is not null")
    return m.groupBy(F.col("timekeeper_email").alias("person"), F.col("practice_area").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("matter").alias("matters"))


@query("""WITH h AS (SELECT DISTINCT unnest([project_key_l, project_key_l || '-' || c, project_key_l || '-' || c || '-area']) AS topic, person FROM (SELECT lower(project_key) AS project_key_l, lower(replace(components, ' ', '')) AS c, assignee_email AS person FROM fakeapi WHERE project_key IS NOT NULL AND components IS NOT NULL AND assignee_email IS NOT NULL)),
t AS (SELECT topic, count(*) AS n, string_split(topic, '-') AS w FROM h GROUP BY 1), cand AS (SELECT f.topic AS f, c.topic AS c, f.n AS fn, len(c.w) AS l FROM t f JOIN t c ON len(c.w) > len(f.w) AND list_contains(c.w, f.w[1]) AND len(list_filter(f.w, lambda x: NOT list_contains(c.w, x))) = 0),
s AS (SELECT f, c, l, round(count(*) / any_value(fn), 9) AS o FROM cand JOIN h h1 ON h1.topic = f JOIN h h2 ON h2.topic = c AND h2.person = h1.person GROUP BY ALL), b AS (SELECT f, c FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY o DESC, l, c) AS r FROM s WHERE o >= 0.6) WHERE r = 1)
SELECT t.topic, coalesce(b2.c, b1.c, t.topic) AS grp FROM t LEFT JOIN b b1 ON b1.f = t.topic LEFT JOIN b b2 ON b2.f = b1.c""")
def topic_groups(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "fakeapi").where("project_key is not null and components is not null and assignee_email is not null")
    p, c = F.lower("project_key"), F.lower(F.replace(F.col("components"), F.lit(" "), F.lit("")))
    h = i.select(F.explode(F.array(p, F.concat_ws("-", p, c), F.concat_ws("-", p, c, F.lit("area")))).alias("topic"), F.col("assignee_email").alias("person")).distinct()
    return knowledge.topic_groups(h)


@query(None)
def related_families(spark: SparkSession, d: str) -> DataFrame:
    """The strongest ties of each brand, one of a family only."""
    return knowledge.collapse_family(ties.strongest(_ties(spark, d)), "a", "b", [F.desc("weight"), F.col("b")])


@query("""WITH w AS (SELECT source AS place, author_email AS person, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE author_email IS NOT NULL GROUP BY ALL)
SELECT place, person, sum(n) AS n FROM (SELECT * FROM w UNION ALL SELECT DISTINCT s.source, n.author_email, 0.5 FROM pd_notes n, (SELECT DISTINCT source FROM documents WHERE source = 'pagerduty') s WHERE n.author_email IS NOT NULL) GROUP BY ALL""")
def review_credit(spark: SparkSession, d: str) -> DataFrame:
    """Work on places plus half a credit for whoever wrote notes on incidents."""
    docs = table(spark, d, "documents")
    work = docs.where("author_email is not null").groupBy(F.col("source").alias("place"), F.col("author_email").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    took = table(spark, d, "pd_notes").where("author_email is not null").select(F.lit(1).alias("pull"), F.col("author_email").alias("person")).distinct()
    dirs = docs.where("source = 'pagerduty'").select(F.lit(1).alias("pull"), F.col("source").alias("place")).distinct()
    return knowledge.review_credit(took, dirs, work)


@query("SELECT incident_id AS episode, count(*) AS messages, count(DISTINCT author_email) AS speakers FROM (SELECT DISTINCT incident_id, author_email, noted_at, content FROM pd_notes) WHERE incident_id IN (SELECT incident_id FROM pd_incidents) GROUP BY 1")
def incident_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = conversations.incident_episodes(table(spark, d, "pd_incidents"), table(spark, d, "pd_notes")).where("messages > 0")
    notes = table(spark, d, "pd_notes").groupBy(F.col("incident_id").alias("episode")).agg(F.count_distinct("author_email").alias("speakers"))
    return e.join(notes, ["episode"]).select("episode", "messages", "speakers")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS w FROM events) WHERE u <= 4 OR w <= 8")
def conversation_ends(spark: SparkSession, d: str) -> DataFrame:
    return conversations.both_ends(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "ts")


@query("SELECT place, doc_id FROM (SELECT place, doc_id, row_number() OVER (PARTITION BY place ORDER BY created_at DESC NULLS LAST, doc_id) AS r FROM documents WHERE place IS NOT NULL) WHERE r <= 200")
def newest_episodes(spark: SparkSession, d: str) -> DataFrame:
    return conversations.newest(table(spark, d, "documents").where("place is not null"), "place", "created_at", "doc_id").select("place", "doc_id")


@query("SELECT place, doc_id FROM (SELECT place, doc_id, coalesce(sum(strlen(text)) OVER (PARTITION BY place ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE place IS NOT NULL) WHERE b < 8000")
def text_budget(spark: SparkSession, d: str) -> DataFrame:
    return conversations.within_budget(table(spark, d, "documents").where("place is not null"), "place", "doc_id", "text", 8000).select("place", "doc_id")


@query("SELECT source, count(*) AS n FROM documents WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-06-01' GROUP BY 1")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return conversations.purge(table(spark, d, "documents"), "created_at", "2024-06-01").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE author_email IS NULL OR lower(author_email) <> (SELECT lower(min(author_email)) FROM documents) GROUP BY 1")
def erased(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("author_email")).first()[0]
    return knowledge.forget(docs, "author_email", [first]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rec_id, team, org FROM people WHERE lower(team) = 'payments' AND lower(org) = 'engineering'")
def filtered_facts(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.matching(table(spark, d, "people"), team="PAYMENTS", org="engineering", title=None).select("rec_id", "team", "org")


@query("SELECT rec_id FROM people WHERE contains(lower(concat_ws(' ', name, team, org)), 'ledger') OR contains(lower(concat_ws(' ', name, team, org)), 'hana')")
def mentioned_facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "people").select("rec_id", F.col("name").alias("subject"), F.col("team").alias("object"), F.col("org").alias("detail"))
    return knowledge.mentioned(f, ["ledger", "Hana", "of"]).select("rec_id")


@query("WITH " + A.NATION_SQL + """, a AS (SELECT topic, person AS named FROM (SELECT topic, person, row_number() OVER (PARTITION BY topic ORDER BY direct DESC, person) AS r FROM pt) WHERE r = 1), b AS (SELECT topic, person AS was FROM (SELECT topic, person, row_number() OVER (PARTITION BY topic ORDER BY stated DESC, person) AS r FROM pt WHERE stated > 0) WHERE r = 1),
dec AS (SELECT n_name AS topic, min(s_suppkey) AS declared FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT count(*) AS areas, count(*) FILTER (named = was) AS same, round(avg(CASE WHEN was = declared THEN 1.0 ELSE 0 END), 6) AS agreement_before, round(avg(CASE WHEN named = declared THEN 1.0 ELSE 0 END), 6) AS agreement_now FROM a JOIN b USING (topic) JOIN dec USING (topic)""")
def eval_same_questions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    pt = A.nation_facts(spark, d)
    lead = lambda df, c, out: df.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(c), "person"))).where("r = 1").select("topic", F.col("person").alias(out))
    dec = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("topic")).agg(F.min("s_suppkey").alias("declared"))
    return knowledge.same_questions(lead(pt, "direct", "named").join(dec, ["topic"]), lead(pt.where("stated > 0"), "stated", "named"))


@query(_TIES + ", q AS (SELECT min(topic) AS t FROM work), l AS (SELECT b, weight FROM ties, q WHERE a = t AND weight >= 0.02 ORDER BY weight DESC, b LIMIT 2) SELECT b AS token, 0.45 AS penalty FROM l")
def tie_expansion(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").agg(F.min("p_brand").alias("topic"))
    return knowledge.expand_by_ties(asked, _ties(spark, d))


@query("SELECT topic, count(DISTINCT src) AS sources, bool_or(src = 'people') AS curated, contains(topic, '-') AND count(DISTINCT src) > 1 OR bool_or(src = 'people') AS salient FROM (SELECT trim(regexp_replace(lower(team), '[^a-z0-9]+', '-', 'g'), '-') AS topic, 'people' AS src FROM people WHERE team IS NOT NULL UNION ALL SELECT trim(regexp_replace(lower(components), '[^a-z0-9]+', '-', 'g'), '-'), 'fakeapi' FROM fakeapi WHERE components IS NOT NULL UNION ALL SELECT trim(regexp_replace(lower(service_name), '[^a-z0-9]+', '-', 'g'), '-'), 'pd' FROM pd_incidents WHERE service_name IS NOT NULL) GROUP BY topic")
def salience(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, c, s: table(spark, d, t).where(F.col(c).isNotNull()).select(T.slug(F.col(c)).alias("topic"), F.lit(s).alias("src"))
    all_ = part("people", "team", "people").unionByName(part("fakeapi", "components", "fakeapi")).unionByName(part("pd_incidents", "service_name", "pd"))
    g = all_.groupBy("topic").agg(F.count_distinct("src").alias("sources"), F.bool_or(F.col("src") == "people").alias("curated"))
    return g.withColumn("salient", knowledge.salient(F.col("curated"), F.col("sources"), F.col("topic"), F.lit(False)))


@query("""WITH m AS (SELECT rec_id AS hash, lower(commit_email) AS email, commit_name AS name FROM mailmap WHERE commit_email IS NOT NULL AND commit_name IS NOT NULL), cnt AS (SELECT name, email, count(*) AS n FROM m WHERE email NOT LIKE '%noreply%' GROUP BY name, email), own AS (SELECT name, email AS own FROM (SELECT name, email, row_number() OVER (PARTITION BY name ORDER BY n DESC, email) AS r FROM cnt) WHERE r = 1),
sh AS (SELECT email FROM m WHERE email LIKE '%noreply%' GROUP BY 1 HAVING count(DISTINCT name) >= 2) SELECT hash, CASE WHEN m.email IN (SELECT email FROM sh) THEN coalesce(own, m.email) ELSE m.email END AS email FROM m LEFT JOIN own ON own.name = m.name""")
def squashed_authors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mailmap").where("commit_email is not null and commit_name is not null")
    return knowledge.squashed_authors(m.select(F.col("rec_id").alias("hash"), F.lower("commit_email").alias("email"), F.col("commit_name").alias("name")))


@query("SELECT lower(trim(alias)) AS handle FROM autojoin WHERE alias LIKE '%:%' AND alias NOT LIKE '%@%' EXCEPT SELECT lower(trim(alias)) FROM autojoin WHERE confidence >= 0.6 AND canonical LIKE '%@%'")
def unlinked_handles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "autojoin").select(F.lower(F.trim("alias")).alias("handle"), "canonical", "confidence")
    linked = a.where("confidence >= 0.6 and canonical like '%@%'").select("handle").distinct()
    return a.where(identity.handle_only(F.col("handle"))).select("handle").distinct().join(linked, ["handle"], "left_anti")


@query("SELECT id FROM (SELECT lower(trim(email)) AS id, CASE WHEN contains(lower(email), 'lund') OR contains(lower(name), 'lund') THEN 1 END AS t FROM people WHERE email LIKE '%@%') WHERE t = 1 ORDER BY id LIMIT 1")
def find_person(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "people").where("email like '%@%'").select(F.lower(F.trim("email")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "email")
    return knowledge.find_person(p, "lund", fuzzy=True)


_RECS = "rc AS (SELECT " + _ADDRESS.format("b") + " AS id, * EXCLUDE (b) FROM (SELECT " + _BARE.format("email") + " AS b, * FROM people WHERE email LIKE '%@%'))"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people").where("email like '%@%'").withColumn("id", normalize_email(F.col("email")))


_REAL = "name NOT LIKE '@%' AND name NOT LIKE '%:%'"


@query(f"WITH {_RECS}, m AS (SELECT id, max({{'a': coalesce(loaded_at, TIMESTAMP '1970-01-01'), 'b': rec_id, 'v': name}}) FILTER (WHERE name <> '' AND {_REAL}) AS n1, max({{'a': coalesce(loaded_at, TIMESTAMP '1970-01-01'), 'b': rec_id, 'v': name}}) FILTER (WHERE name <> '') AS n2, "
       + ", ".join(f"max({{'a': coalesce(loaded_at, TIMESTAMP '1970-01-01'), 'b': rec_id, 'v': {c}}}) FILTER (WHERE {c} <> '') AS {c[0]}x" for c in ("title", "manager", "org")) + ", max({'a': coalesce(loaded_at, TIMESTAMP '1970-01-01'), 'b': rec_id, 'v': team}) FILTER (WHERE team <> '') AS zx FROM rc GROUP BY id) SELECT id, coalesce(n1.v, n2.v) AS name, tx.v AS title, mx.v AS manager, zx.v AS team, ox.v AS org FROM m")
def ingest_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity fields of every address, folded over all its rows in the order they were loaded."""
    r = _records(spark, d).withColumn("at", F.coalesce("loaded_at", F.to_timestamp(F.lit("1970-01-01")).cast("timestamp_ntz")))
    return ingest.fold_identities(r, ["at", "rec_id"], ("title", "manager", "team", "org"))


@query(f"WITH {_RECS} SELECT id, count(title) AS titles, coalesce(array_to_string(list_sort(list(DISTINCT team)), '|'), '') AS teams, max(loaded_at) AS last_at FROM rc GROUP BY id")
def ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Every second row as what is held and the rest as a delta: folded they are what one fold of all rows gives."""
    listed = lambda c: F.array_compact(F.array(c))
    r = _records(spark, d).select("rec_id", "id", listed("title").alias("titles"), listed("team").alias("teams"), F.col("loaded_at").alias("last_at"))
    folded = dict(joined=("titles",), united=("teams",), largest=("last_at",))
    none = r.drop("rec_id").limit(0)
    held = ingest.fold_records(none, r.where("rec_id % 2 = 0").drop("rec_id"), **folded)
    out = ingest.fold_records(held, r.where("rec_id % 2 <> 0").drop("rec_id"), **folded)
    return out.select("id", F.size("titles").cast("long").alias("titles"), F.array_join("teams", "|").alias("teams"), "last_at")


_MM = "mm AS (SELECT " + _ADDRESS.format("c") + " AS alias, min(" + _ADDRESS.format("b") + ") AS canonical FROM (SELECT " + _BARE.format("commit_email") + " AS c, " + _BARE.format("email") + " AS b FROM mailmap WHERE commit_email LIKE '%@%' AND email LIKE '%@%') GROUP BY 1)"


@query(f"WITH {_MM}, f AS (SELECT {_ADDRESS.format('b')} AS person, place FROM (SELECT {_BARE.format('author_email')} AS b, place FROM documents WHERE author_email IS NOT NULL AND place IS NOT NULL)) SELECT coalesce(canonical, person) AS person, place, CAST(count(*) AS BIGINT) AS n FROM f LEFT JOIN mm ON mm.alias = person GROUP BY 1, 2")
def merge_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Work on places under the proper address of whoever wrote."""
    m = table(spark, d, "mailmap").where("commit_email like '%@%' and email like '%@%'")
    alias = m.groupBy(normalize_email(F.col("commit_email")).alias("alias")).agg(F.min(normalize_email(F.col("email"))).alias("canonical"))
    work = table(spark, d, "documents").where("author_email is not null and place is not null").select(normalize_email(F.col("author_email")).alias("person"), "place", F.lit(1).cast("long").alias("n"))
    return ingest.merge_canonical(work, alias, ("n",), ("place",))


@query(f"WITH {_RECS} SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY coalesce(loaded_at, TIMESTAMP '1970-01-01'), rec_id) AS r FROM rc WHERE id <> '') WHERE r = 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first loaded name of every address."""
    at = F.coalesce("loaded_at", F.to_timestamp(F.lit("1970-01-01")).cast("timestamp_ntz"))
    return knowledge.ordered_distinct(_records(spark, d), "id", [at, F.col("rec_id")]).select("id", "name")


@query("SELECT source, w AS word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1, 2")
def raw_words(spark: SparkSession, d: str) -> DataFrame:
    """Every ASCII word of the documents of a source, stop words and single letters included."""
    words = table(spark, d, "documents").select("source", F.explode(T.raw_words(F.col("text"))).alias("word"))
    return words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT source, count(*) AS old FROM documents GROUP BY 1), a AS (SELECT source, count(*) AS new FROM documents WHERE text IS NOT NULL AND length(text) > 600 GROUP BY 1)
SELECT b.source, old, coalesce(new, 0) AS new FROM b LEFT JOIN a ON a.source = b.source WHERE coalesce(new, 0) < old * 0.5""")
def shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which a run that brings long texts only would lose more than half."""
    docs = table(spark, d, "documents")
    n = lambda x: x.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return episodes.shrink_guard(n(docs), n(docs.where("text is not null and length(text) > 600")))


@query("WITH c AS (SELECT lower(components) AS topic, assignee_email AS person, count(*) AS n, max(count(*)) OVER (PARTITION BY lower(components)) AS m FROM fakeapi WHERE components IS NOT NULL AND assignee_email IS NOT NULL GROUP BY 1, 2), s AS (SELECT topic, person, round(n / m, 2) AS strength FROM c) SELECT topic, person, strength, CASE WHEN strength >= 0.75 THEN 'strong' WHEN strength >= 0.45 THEN 'moderate' WHEN strength > 0 THEN 'weak' ELSE 'none' END AS label FROM s")
def strength_labels(spark: SparkSession, d: str) -> DataFrame:
    """People on components by their share of what the busiest one did, in words."""
    n = table(spark, d, "fakeapi").where("components is not null and assignee_email is not null").groupBy(F.lower("components").alias("topic"), F.col("assignee_email").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy("topic").agg(F.max("n").alias("m"))
    s = n.join(most, ["topic"]).select("topic", "person", F.round(F.col("n") / F.col("m"), 2).alias("strength"))
    return s.withColumn("label", T.strength_label(F.col("strength")))
