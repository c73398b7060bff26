"""Sources as file readers, each giving the one ingest row: org charts, time entries, ownership files, commits, chat, tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions import text as T
from knowgrid.functions.identity import normalize_email
from knowgrid.operators.conversations import within_budget

RECORD = (
    "kind string, person_id string, name string, email string, alt_ids array<string>, title string, team string, org string, manager string, topics array<string>, "
    "recent_topics array<string>, direct_topics array<string>, weak_topics array<string>, members array<string>, text string, source string, weight double, time timestamp"
)
# The headings under which an org chart's columns may appear, without case and separators.
HEADERS = {
    "name": ("name", "fullname", "displayname", "employee", "employeename"), "email": ("email", "emailaddress", "mail", "workemail", "userprincipalname"),
    "title": ("title", "jobtitle", "role", "position"), "team": ("team", "department", "group", "squad"), "org": ("org", "organization", "organisation", "division", "businessunit"),
    "manager": ("manager", "manageremail", "reportsto", "supervisor"), "topics": ("topics", "skills", "expertise", "areas", "tags"),
}


def as_records(df: DataFrame, kind: str, source: str, **columns: Column) -> DataFrame:
    """The ingest schema; columns not given are NULL, empty strings are NULL, weight 1 unless given."""
    out = []
    for part in RECORD.split(", "):
        name, type_ = part.split(" ", 1)
        c = {"kind": F.lit(kind), "source": F.lit(source)}.get(name, columns.get(name, F.lit(1.0 if name == "weight" else None)))
        c = c.cast(type_)
        out.append((F.when(F.trim(c) != "", c) if type_ == "string" else c).alias(name))
    return df.select(*out)


def org_chart(spark: SparkSession, path: str) -> DataFrame:
    """CSV with headings by any synonym; rows with neither name nor address are dropped."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    flat = {c.lower().replace(" ", "").replace("_", "").replace("-", ""): c for c in raw.columns}
    col = lambda k: next((F.col(f"`{flat[h]}`") for h in HEADERS[k] if h in flat), F.lit(None).cast("string"))
    topics = F.filter(F.transform(F.split(col("topics"), ";"), lambda t: F.trim(t)), lambda t: t != "")
    out = as_records(raw, "person", "org-csv", name=col("name"), email=normalize_email(col("email")), title=col("title"), team=col("team"), org=col("org"), manager=normalize_email(col("manager")), topics=topics)
    return out.where("name is not null or email is not null")


def time_entries(spark: SparkSession, path: str, as_of: str, window_days: int = 180) -> DataFrame:
    """Per timekeeper: phrases of practice and matter, words of the narrative, and those of the recent window."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lower().replace(" ", "_") for c in raw.columns])
    day = F.coalesce(*[F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "dd-MMM-yyyy", "yyyy/MM/dd")])
    stated = F.concat(T.phrase_tokens(F.col("practice_area")), T.phrase_tokens(F.col("matter")))
    e = raw.select(normalize_email(F.col("timekeeper_email")).alias("email"), F.col("timekeeper").alias("name"), stated.alias("topics"), T.title_tokens(F.col("narrative")).alias("weak"), day.alias("day"))
    recent = F.when(F.col("day") >= F.date_sub(F.to_date(F.lit(as_of)), window_days), F.col("topics")).otherwise(F.array().cast("array<string>"))
    key = F.coalesce("email", T.slug(F.col("name")))
    g = e.groupBy(key.alias("id")).agg(F.min("email").alias("email"), F.min("name").alias("name"), F.flatten(F.collect_list("topics")).alias("topics"), F.flatten(F.collect_list("weak")).alias("weak"), F.flatten(F.collect_list(recent)).alias("recent"), F.max("day").alias("day"))
    return as_records(g, "person", "matters", person_id=F.col("id"), name=F.col("name"), email=F.col("email"), topics=F.col("topics"), weak_topics=F.col("weak"), recent_topics=F.col("recent"), time=F.col("day"))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records in the ingest schema; anything malformed fails the read."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def owners_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``pattern owner…`` to ``pattern, owner``; comments and ``[section]`` headings are skipped."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    p = spark.read.text(path).select(F.split(line, r"\s+").alias("p")).where(F.element_at("p", 1) != "").where(~F.element_at("p", 1).rlike(r"^\^?\["))
    return p.select(F.element_at("p", 1).alias("pattern"), F.explode(F.filter(F.slice(F.col("p"), F.lit(2), F.size("p")), lambda o: o.contains("@"))).alias("owner"))


def owners(spark: SparkSession, path: str) -> DataFrame:
    """One record per owner: subjects of the patterns it owns; ``@login`` and ``@org/team`` become prefixed ids."""
    f = owners_file(spark, path)
    id_ = F.when(F.col("owner").startswith("@"), F.concat(F.lit("codeowners:"), F.lower(F.substring("owner", 2, 200)))).otherwise(normalize_email(F.col("owner")))
    g = f.groupBy(id_.alias("id")).agg(F.flatten(F.collect_list(T.path_topics(F.col("pattern")))).alias("topics"))
    return as_records(g, "person", "codeowners", person_id=F.col("id"), email=F.when(~F.col("id").startswith("codeowners:"), F.col("id")), topics=F.col("topics"))


def mailmap_resolve(rows: DataFrame, mailmap: DataFrame) -> DataFrame:
    """``rows`` (``name, email``) under proper names: by commit name and address first, then by address alone.

    ``mailmap`` is ``proper_name, proper_email, commit_name, commit_email``; of several lines for one key the one with
    the smallest address, then name, holds.
    """
    m = mailmap.select(F.lower("commit_email").alias("_e"), F.lower("commit_name").alias("_n"), "proper_name", "proper_email")
    both = m.where("_n is not null").groupBy("_e", "_n").agg(F.min(F.struct("proper_email", "proper_name")).alias("_b"))
    alone = m.where("_n is null").groupBy("_e").agg(F.min(F.struct("proper_email", "proper_name")).alias("_a"))
    r = rows.withColumn("_e", F.lower("email")).withColumn("_n", F.lower("name")).join(both, ["_e", "_n"], "left").join(alone, ["_e"], "left")
    return r.withColumn("name", F.coalesce("_b.proper_name", "_a.proper_name", "name")).withColumn("email", F.coalesce("_b.proper_email", "_a.proper_email", "email")).drop("_e", "_n", "_b", "_a")


def commit_work(commits: DataFrame, max_dirs: int = 18, max_root_files: int = 100) -> DataFrame:
    """``email, topic, commits, direct, last_at`` from ``hash, email, authored_at, parents, paths, co_authors``.

    A commit credits each subject once, its author and co-authors; those that touch more than ``max_dirs``
    directories give no direct credit; merges and vast first commits are left out.
    """
    c = commits.where("parents <= 1").where(~((F.col("parents") == 0) & (F.size("paths") > max_root_files)))
    dirs = F.size(F.array_distinct(F.transform("paths", lambda p: F.regexp_replace(p, "/?[^/]*$", ""))))
    who = F.explode(F.array_distinct(F.concat(F.array("email"), F.coalesce("co_authors", F.array().cast("array<string>")))))
    c = c.select("hash", "authored_at", (dirs <= max_dirs).alias("focused"), F.array_distinct(F.flatten(F.transform("paths", T.path_topics))).alias("t"), who.alias("email"))
    return c.select("*", F.explode("t").alias("topic")).groupBy("email", "topic").agg(F.count(F.lit(1)).alias("commits"), F.count_if("focused").alias("direct"), F.max("authored_at").alias("last_at"))


def dir_work(commits: DataFrame) -> DataFrame:
    """``place, person, n``: commits of a person under every directory prefix of the paths they touch."""
    parts = lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    prefixes = lambda p: F.transform(F.when(F.size(parts(p)) > 0, F.sequence(F.lit(1), F.size(parts(p)))).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws("/", F.slice(parts(p), F.lit(1), i)))
    c = commits.select("hash", F.col("email").alias("person"), F.array_distinct(F.flatten(F.transform("paths", prefixes))).alias("d"))
    return c.select("hash", "person", F.explode("d").alias("place")).groupBy("place", "person").agg(F.count(F.lit(1)).alias("n"))


def trailers(message: Column) -> Column:
    """Credited people of a commit message: ``array<struct<kind, name, email>>``."""
    rx = r"(?mi)^((?:Co-authored-by|Reviewed-by|Acked-by|Tested-by|Suggested-by):[ \t]*[^<\n]*?[ \t]*<[^>\n]+>)[ \t]*$"
    lines = F.regexp_extract_all(message, F.lit(rx), F.lit(1))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("kind"), F.trim(F.regexp_extract(x, r":([^<]*)<", 1)).alias("name"), F.lower(F.regexp_extract(x, "<([^>]+)>", 1)).alias("email")))


def chat_export(spark: SparkSession, folder: str, text_limit: int = 8000) -> DataFrame:
    """Channel and person records of an exported workspace: ``users.json``, ``channels.json`` and a folder of days each."""
    users = spark.read.option("multiLine", True).json(f"{folder}/users.json")
    msgs = spark.read.option("multiLine", True).json(f"{folder}/*/*.json").withColumn("channel", F.element_at(F.split(F.input_file_name(), "/"), -2))
    msgs = msgs.where(F.col("user").isNotNull() & F.col("subtype").isNull() if "subtype" in msgs.columns else F.col("user").isNotNull())
    said = msgs.select("channel", "user", F.col("ts").cast("double").cast("timestamp").alias("at"), T.scrub(F.coalesce("text", F.lit("")))[0].alias("text"))
    person = users.select(F.col("id").alias("user"), F.coalesce(F.col("profile.real_name"), F.col("name")).alias("name"), normalize_email(F.col("profile.email")).alias("email"), F.col("profile.title").alias("title"))
    # Bytes are counted before anything is collected, so nobody's list outgrows the limit by more than a message.
    first = within_budget(said, "user", F.struct("at", "text"), "text", text_limit)
    latest = said.groupBy("user").agg(F.max("at").alias("at"))
    per = first.groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text")).join(latest, ["user"])
    people = as_records(
        person.join(per, ["user"], "left"), "person", "chat", person_id=F.coalesce("email", F.concat(F.lit("slack:"), F.lower("user"))), name=F.col("name"), email=F.col("email"), title=F.col("title"), text=T.truncate_bytes(F.substring("text", 1, text_limit), text_limit), time=F.col("at")
    )
    ch = said.join(person.select("user", F.coalesce("email", F.concat(F.lit("slack:"), F.lower("user"))).alias("pid")), ["user"], "left")
    ch = ch.groupBy("channel").agg(F.array_sort(F.collect_set("pid")).alias("members"), F.max("at").alias("at"))
    return people.unionByName(as_records(ch, "channel", "chat", name=F.col("channel"), members=F.col("members"), time=F.col("at")))


def issues(rows: DataFrame) -> DataFrame:
    """``person, topic, stated`` of tickets: assignee and reporter on components, labels, project and words of the summary.

    ``rows`` is ``assignee, reporter, components, labels, project, summary``.
    """
    none = F.array().cast("array<string>")
    stated = F.transform(F.concat(F.coalesce("components", none), F.coalesce("labels", none)), lambda t: T.topic_id(t))
    words = F.concat(T.phrase_tokens(F.col("summary")), F.array_compact(F.array(F.lower("project"))))
    who = rows.select(F.explode(F.array_distinct(F.array_compact(F.array("assignee", "reporter")))).alias("person"), stated.alias("stated"), words.alias("words"))
    both = who.select("person", F.explode("stated").alias("topic"), F.lit(True).alias("stated")).unionByName(who.select("person", F.explode("words").alias("topic"), F.lit(False).alias("stated")))
    return both.where("topic is not null and topic <> ''").groupBy("person", "topic", "stated").agg(F.count(F.lit(1)).alias("n"))


def oncall_topics(services: DataFrame, oncalls: DataFrame) -> DataFrame:
    """``person, topic``: words of the services that a person's escalation policies cover (weak evidence)."""
    s = services.select("policy", F.explode(T.title_tokens(F.col("service"))).alias("topic")).distinct()
    return s.join(oncalls.select("policy", "person").distinct(), ["policy"]).select("person", "topic").distinct()


def write_records(records: DataFrame, path: str) -> None:
    """Replaces each source's part and no other; text is kept only as sorted distinct stems."""
    words = records.select(F.explode(T.tokens(T.fold(F.col("text")))).alias("token"))
    vocabulary = T.stemmed_vocabulary(words)
    keyed = records.withColumn("_id", F.monotonically_increasing_id())
    stems = keyed.select("_id", F.explode(T.tokens(T.fold(F.col("text")))).alias("token")).join(vocabulary, ["token"]).groupBy("_id").agg(F.array_sort(F.collect_set("stem")).alias("terms"))
    out = keyed.join(stems, ["_id"], "left").drop("_id", "text")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
