"""Identities: explicit ties, heuristic passes as set queries, ranked representatives, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowgrid.functions.text import is_role_mailbox
from knowgrid.functions.words import COMMON_SURNAMES
from knowgrid.operators.ties import components
from knowgrid.session import materialise


def handle_only(c: Column) -> Column:
    """A prefixed handle without an address."""
    return (F.instr(c, ":") > 1) & ~c.contains("@")


def rank(c: Column) -> Column:
    """Addresses represent before plain ids, plain ids before prefixed handles."""
    return F.when(c.contains("@"), 0).when(c.contains(":"), 2).otherwise(1)


def flatten(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def explicit_edges(people: DataFrame) -> DataFrame:
    """``a, b``: a person's id with the address (unless it is a shared mailbox) and every other id (``id, email, alt_ids``)."""
    mail = people.where(F.col("email").isNotNull() & ~is_role_mailbox(F.col("email"))).select(F.col("id").alias("a"), F.col("email").alias("b"))
    alt = people.select(F.col("id").alias("a"), F.explode("alt_ids").alias("b")).where(F.col("b").isNotNull() & ~is_role_mailbox(F.col("b")))
    return mail.unionByName(alt).where("a <> b").distinct()


def _unique(pairs: DataFrame, confidence: float, reason: str) -> DataFrame:
    """Pairs (``handle, target``) of handles with exactly one target."""
    n = pairs.distinct().groupBy("handle").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    return n.where("n = 1").select(F.col("handle").alias("alias"), F.col("target").alias("canonical"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def pass_flat_name(handles: DataFrame, people: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """A handle that is somebody's flattened name or mailbox, three letters or more, and nobody else's.

    Where several fit, the one who shares the handle's team (``team`` of both, where there is such a column) is taken,
    else the one who shares two of its topics (``id, topic``); if that are none or several, the handle stays apart.
    """
    keys = people.select("id", F.explode(F.array_distinct(F.array(flatten(F.col("name")), flatten(F.substring_index("email", "@", 1))))).alias("k"))
    h = handles.select(F.col("id").alias("handle"), flatten(F.substring_index("id", ":", -1)).alias("k")).where(F.length("k") >= 3)
    fits = h.join(keys, ["k"]).select("handle", F.col("id").alias("target")).distinct()
    sole = _unique(fits, 0.9, "unique name match")
    rest = fits.join(sole.select(F.col("alias").alias("handle")), ["handle"], "left_anti")
    team = rest.select("handle", "target").limit(0)
    if "team" in people.columns and "team" in handles.columns:
        t = rest.join(handles.select(F.col("id").alias("handle"), F.col("team").alias("_h")), ["handle"]).join(people.select(F.col("id").alias("target"), F.col("team").alias("_t")), ["target"])
        team = t.where("_h = _t and _h <> ''").select("handle", "target")
    told = team.withColumn("confidence", F.lit(0.8))
    if topics is not None:
        pairs = rest.join(team, ["handle", "target"], "left_anti").select(F.col("handle").alias("a"), F.col("target").alias("b"))
        told = told.unionByName(shared_topics(pairs, topics).where("shared >= 2").select(F.col("a").alias("handle"), F.col("b").alias("target"), F.lit(0.7).alias("confidence")))
    one = told.groupBy("handle").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"), F.max("confidence").alias("confidence")).where("n = 1")
    why = F.when(F.col("confidence") == 0.8, "name and shared team").otherwise("name and shared topics")
    return sole.unionByName(one.select(F.col("handle").alias("alias"), F.col("target").alias("canonical"), "confidence", why.alias("reason")))


def shared_topics(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """``a, b, shared``: how many topics (``id, topic``) both of a pair have; only the pairs' own topics are joined."""
    t = topics.select("id", "topic").distinct()
    j = pairs.select("a", "b").distinct().join(t.select(F.col("id").alias("a"), "topic"), ["a"])
    return j.join(t.select(F.col("id").alias("b"), "topic"), ["b", "topic"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def pass_domain_label(handles: DataFrame, people: DataFrame) -> DataFrame:
    """A handle that is the label of a domain with one person on it."""
    d = people.where("email is not null").select("id", F.element_at(F.split(F.substring_index("email", "@", -1), r"\."), -2).alias("k"))
    one = d.groupBy("k").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1")
    h = handles.select(F.col("id").alias("handle"), flatten(F.substring_index("id", ":", -1)).alias("k"))
    return _unique(h.join(one, ["k"]).select("handle", "target"), 0.85, "email domain label")


def pass_prefix(handles: DataFrame, people: DataFrame, least: int = 8) -> DataFrame:
    """Handle and full name, ``least`` letters or more, where one begins the other: joined by their first letters."""
    p = people.where(F.size(F.split(F.trim("name"), r"\s+")) >= 2).select("id", flatten(F.col("name")).alias("full")).where(F.length("full") >= least)
    h = handles.select(F.col("id").alias("handle"), flatten(F.substring_index("id", ":", -1)).alias("h")).where(F.length("h") >= least)
    j = h.withColumn("k", F.substring("h", 1, least)).join(p.withColumn("k", F.substring("full", 1, least)), ["k"]).where(F.col("h").startswith(F.col("full")) | F.col("full").startswith(F.col("h")))
    return _unique(j.select("handle", F.col("id").alias("target")), 0.8, "name prefix")


def pass_initial_surname(handles: DataFrame, people: DataFrame, common: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """A handle that is an initial and a surname, or a surname, of five letters or more and not a common one."""
    parts = F.split(F.lower(F.trim("name")), r"\s+")
    s = people.where(F.size(parts) >= 2).select("id", flatten(F.element_at(parts, -1)).alias("s"), F.substring(F.element_at(parts, 1), 1, 1).alias("i")).where((F.length("s") >= least) & ~F.col("s").isin(*common, ""))
    keys = s.select("id", F.explode(F.array(F.col("s"), F.concat("i", "s"))).alias("k"))
    h = handles.select(F.col("id").alias("handle"), flatten(F.substring_index("id", ":", -1)).alias("k"))
    return _unique(h.join(keys, ["k"]).select("handle", F.col("id").alias("target")), 0.75, "initial and surname")


def pass_email_variant(people: DataFrame, least: int = 3) -> DataFrame:
    """Addresses whose mailbox without dots is the full name of two words or more, and the same one."""
    mail, name = people.where(F.col("email").isNotNull() & ~is_role_mailbox(F.col("email"))), F.trim("name")
    k = F.regexp_replace(F.substring_index(F.lower("email"), "@", 1), r"\.", "")
    p = mail.where(name.contains(" ")).select("id", k.alias("k"), flatten(F.col("name")).alias("n")).where((F.col("k") == F.col("n")) & (F.length("k") >= least))
    first = p.groupBy("k").agg(F.min("id").alias("canonical"))
    return p.join(first, ["k"]).where("id <> canonical").select(F.col("id").alias("alias"), "canonical", F.lit(0.85).alias("confidence"), F.lit("matching email variant").alias("reason")).distinct()


def _two(keyed: DataFrame) -> DataFrame:
    """``k, a, b``: keys that exactly two ids have (``k, id``), the smaller first."""
    return keyed.distinct().groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n = 2").select("k", "a", "b")


def _joined(pairs: DataFrame, confidence: float, reason: str) -> DataFrame:
    """The better-ranked id of each pair stands for both."""
    swap = rank(F.col("b")) < rank(F.col("a"))
    alias, canonical = F.when(swap, F.col("a")).otherwise(F.col("b")), F.when(swap, F.col("b")).otherwise(F.col("a"))
    return pairs.select(alias.alias("alias"), canonical.alias("canonical"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason")).distinct()


def _persons(people: DataFrame) -> DataFrame:
    return people.where(~handle_only(F.col("id")))


def _local(email: Column) -> Column:
    """The mailbox of an address without dots; at a no-reply host the login."""
    part = F.substring_index(F.lower(email), "@", 1)
    login = F.when(F.lower(email).contains("noreply"), F.regexp_replace(part, r"^[0-9]+\+", "")).otherwise(part)
    return F.regexp_replace(login, r"\.", "")


def pass_same_name(people: DataFrame, topics: DataFrame, least_shared: int = 3) -> DataFrame:
    """The same full name of two words or more, exactly two people, who share three topics or more."""
    name = F.lower(F.trim("name"))
    two = _two(_persons(people).where(name.contains(" ")).select(name.alias("k"), "id"))
    return _joined(shared_topics(two, topics).where(F.col("shared") >= least_shared), 0.65, "same name and shared subjects")


def pass_same_surname(people: DataFrame, topics: DataFrame, least_shared: int = 3, least: int = 5, common: tuple[str, ...] = tuple(COMMON_SURNAMES)) -> DataFrame:
    """The same uncommon surname of five letters or more, which exactly two people's names end with, one of them behind a
    private address, who share three topics or more."""
    p = _persons(people)
    words = F.split(F.lower(F.trim("name")), r"\s+")
    last = p.where(F.size(words) >= 2).select(F.element_at(words, -1).alias("k"), "id").where((F.length("k") >= least) & ~F.col("k").isin(list(common)))
    two = _two(last)
    # Flattened names are asked by their endings, so that no name is compared with every surname.
    flat = p.select("id", flatten(F.col("name")).alias("f")).where(F.length("f") >= least)
    ends = flat.select("id", F.explode(F.transform(F.sequence(F.lit(least), F.length("f")), lambda n: F.right(F.col("f"), n))).alias("e"))
    held = two.select("k", flatten(F.col("k")).alias("e")).join(ends, ["e"]).groupBy("k").agg(F.count_distinct("id").alias("held")).where("held = 2")
    private = F.col("a").contains("noreply") | F.col("b").contains("noreply")
    return _joined(shared_topics(two.join(held.select("k"), ["k"], "left_semi").where(private), topics).where(F.col("shared") >= least_shared), 0.65, "same surname, one private address, and shared subjects")


def _given_name_local(name: Column, local: Column) -> Column:
    """The mailbox is nothing but the first word of a name."""
    return F.coalesce(flatten(F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), 1)) == local, F.lit(False))


def pass_same_local(people: DataFrame, topics: DataFrame, least_shared: int = 3, least: int = 5) -> DataFrame:
    """The same mailbox of five letters or more at two domains, exactly two people, who share three topics or more; not
    where the mailbox is shared by role or only a given name, or both have the same name of one word."""
    p = _persons(people).where(F.col("email").isNotNull() & ~is_role_mailbox(F.col("email")))
    two = _two(p.select(_local(F.col("email")).alias("k"), "id").where(F.length("k") >= least))
    name = people.groupBy("id").agg(F.min(F.trim("name")).alias("name"))
    two = two.join(name.select(F.col("id").alias("a"), F.col("name").alias("an")), ["a"], "left").join(name.select(F.col("id").alias("b"), F.col("name").alias("bn")), ["b"], "left")
    bare = F.coalesce((F.lower("an") == F.lower("bn")) & ~F.col("an").contains(" "), F.lit(False))
    two = two.where(~bare & ~_given_name_local(F.col("an"), F.col("k")) & ~_given_name_local(F.col("bn"), F.col("k")))
    return _joined(shared_topics(two, topics).where(F.col("shared") >= least_shared), 0.65, "same distinctive mailbox name at two domains, and shared subjects")


def pass_login_name(people: DataFrame, least: int = 3) -> DataFrame:
    """A display name of one word that is a login (at a no-reply host, or a ``git:`` handle) which exactly one other has."""
    mail = F.lower("email")
    held = people.where(mail.contains("noreply")).select(flatten(_local(F.col("email"))).alias("k"), "id").unionByName(people.where(F.col("id").startswith("git:")).select(flatten(F.substring_index("id", ":", -1)).alias("k"), "id"))
    held = held.where(F.length("k") >= least).distinct().groupBy("k").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n = 1")
    name = F.trim("name")
    named = people.where((name != "") & ~name.rlike(r"\s")).select(flatten(name).alias("k"), "id").where(F.length("k") >= least).distinct()
    other = named.join(held.select("k", "holder"), ["k"]).where("id <> holder").groupBy("k", "holder").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return _joined(other.select(F.least("id", "holder").alias("a"), F.greatest("id", "holder").alias("b")), 0.9, "display name is a login of one other")


def pass_same_name_mailboxes(people: DataFrame, least: int = 5, least_surname: int = 4, least_given: int = 3) -> DataFrame:
    """The same name, exactly two people, whose mailboxes both spell it but in different ways: one goes on where the other
    ends, or has a number more, or has the words the other way round, or shortens the given name differently."""
    name = F.lower(F.trim("name"))
    p = _persons(people).where(~F.coalesce(is_role_mailbox(F.col("email")), F.lit(False))).where(F.length(flatten(name)) >= least)
    two = _two(p.select(name.alias("k"), "id"))
    local = p.groupBy("id", name.alias("k")).agg(F.min(_local(F.col("email"))).alias("l"))
    two = two.join(local.select("k", F.col("id").alias("a"), F.col("l").alias("la")), ["k", "a"]).join(local.select("k", F.col("id").alias("b"), F.col("l").alias("lb")), ["k", "b"])
    la, lb = F.col("la"), F.col("lb")
    da, db = F.regexp_replace(la, "[0-9]", ""), F.regexp_replace(lb, "[0-9]", "")
    words = F.split("k", r"\s+")
    forward, backward = flatten(F.col("k")), flatten(F.array_join(F.reverse(words), ""))
    goes_on = lambda x, y: (F.length(x) >= least) & y.startswith(x)
    spells = lambda x: (F.size(words) >= 2) & ((x == forward) | (x == backward))
    given, surname = flatten(F.element_at(words, 1)), flatten(F.element_at(words, -1))
    cut = lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(surname))
    short = lambda x: (F.size(words) >= 2) & (F.length(surname) >= least_surname) & x.endswith(surname) & (F.length(cut(x)) >= least_given) & given.startswith(cut(x))
    agree = F.when(da == db, la.rlike("[0-9]") != lb.rlike("[0-9]")).otherwise(
        goes_on(da, db) | goes_on(db, da) | (spells(da) & spells(db) & ((da == forward) != (db == forward))) | (short(da) & short(db) & (cut(da) != cut(db)))
    )
    ok = (la != "") & (lb != "") & (la != lb) & ~_given_name_local(F.col("k"), la) & ~_given_name_local(F.col("k"), lb)
    return _joined(two.where(ok & agree), 0.65, "same name, and both mailboxes spell it")


def aliases(edges: DataFrame) -> DataFrame:
    """``alias, canonical``: the best-ranked id of each connected group (``a, b``)."""
    cc = components(edges)
    best = cc.groupBy("root").agg(F.min(F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("id"))).alias("b"))
    return cc.join(best, ["root"]).select(F.col("node").alias("alias"), F.col("b.id").alias("canonical"))


def infer(people: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The ledger (``alias, canonical, confidence, reason``) of inferred joins by ten passes.

    The first four look at handles (ids such as ``chat:jdoe``), each at those that the passes before it left. The others
    join people, each over the ids that the passes before it made of them. ``people`` is ``id, name, email`` (and
    ``team``, if known); ``topics`` is ``id, topic``, without which the passes that want shared subjects find
    nothing. Every pass is one set query over the state the one before left, so row order doesn't matter.
    """
    handles, known = people.where(handle_only(F.col("id"))), people.where(~handle_only(F.col("id")))
    topics = people.select("id", F.lit(None).cast("string").alias("topic")).limit(0) if topics is None else topics
    ledger, common = None, tuple(COMMON_SURNAMES)
    steps = (lambda h: pass_flat_name(h, known, topics), lambda h: pass_domain_label(h, known), lambda h: pass_prefix(h, known), lambda h: pass_initial_surname(h, known, common))
    for step in steps:
        found = materialise(step(handles), "ledger")
        ledger = found if ledger is None else ledger.unionByName(found)
        handles = handles.join(found.select(F.col("alias").alias("id")), ["id"], "left_anti")
    everyone = resolve(people, ledger.groupBy("alias").agg(F.min("canonical").alias("canonical")), "id")
    seen = resolve(topics, ledger.groupBy("alias").agg(F.min("canonical").alias("canonical")), "id")
    later = (lambda p, t: pass_email_variant(p), pass_same_name, pass_same_surname, pass_same_local, lambda p, t: pass_login_name(p), lambda p, t: pass_same_name_mailboxes(p))
    for step in later:
        found = materialise(step(everyone, seen), "ledger")
        ledger = ledger.unionByName(found)
        to = found.groupBy("alias").agg(F.min("canonical").alias("canonical"))
        everyone, seen = materialise(resolve(everyone, to, "id"), "people"), resolve(seen, to, "id")
    return ledger


def merge_ledger(old: DataFrame, fresh: DataFrame, people: DataFrame) -> DataFrame:
    """The restored ledger with what was found anew: a fresh join of an alias replaces the old one, and joins whose
    person (``id``) has gone are dropped."""
    kept = old.join(fresh.select("alias").distinct(), ["alias"], "left_anti").unionByName(fresh)
    return kept.join(people.select(F.col("id").alias("canonical")).distinct(), ["canonical"], "left_semi").select(*fresh.columns)


def resolve(rows: DataFrame, alias: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its canonical id, itself where it has none."""
    a = alias.select(F.col("alias").alias(column), F.col("canonical").alias("_canonical"))
    return rows.join(a, [column], "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")
