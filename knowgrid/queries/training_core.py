"""Queries of the general training-data operators: bad rows, timestamps, hierarchies, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowgrid.functions.identity import normalize_email
from knowgrid.operators import badrows, hierarchy, packed, timestamps
from knowgrid.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "people_raw").where("line_no is null or line_no <> 1")
    return badrows.separate_bad_rows(raw).where("reason is not null").select("raw_id", "reason")


def p3_people(spark: SparkSession, d: str) -> DataFrame:
    """The sound lines as people rows, blank fields NULL."""
    raw = table(spark, d, "people_raw").where("line_no is null or line_no <> 1")
    good = badrows.separate_bad_rows(raw).where("reason is null")
    return good.select("raw_id", *[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in badrows.PEOPLE_COLUMNS])


def _clock_values(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, site: str, fields: tuple[str, ...]) -> DataFrame:
        t = table(spark, d, name)
        values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")
        t = t.select("row_id", F.col(site).alias("site"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("ingested_us"), values)
        return t.select(F.lit(name).alias("src"), "row_id", "site", "ingested_us", "x.field", "x.value").where("value is not null")

    return (
        part("pd_incidents", "site", ("created_at", "resolved_at"))
        .unionByName(part("fakeapi", "site", ("updated",)))
        .unionByName(part("matters", "office", ("entry_date",)))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalise(_clock_values(spark, d), table(spark, d, "sites"), ("src", "row_id", "field"))
    return out.where("utc_us is not null").select("src", "row_id", "field", "utc_us")


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """For every site, the offset history that its zoneless readings fit best, as if none were declared."""
    sites = table(spark, d, "sites")
    values = _clock_values(spark, d).where("src <> 'matters'")
    parsed = timestamps.parse_wall(values.join(sites.select("site", "day_first"), ["site"]), "value", "day_first")
    free = parsed.where("_wall is not null and _offset is null and field in ('created_at', 'updated')").select("site", "_wall", "ingested_us")
    candidates = sites.select("site").distinct().crossJoin(sites.select(F.col("time_zone").alias("zone")).distinct())
    best = timestamps.align_zones(free, candidates, "site")
    return best.join(sites.select("site", F.col("time_zone").alias("declared_zone")), ["site"]).select("site", "zone", "declared_zone", "violations", "n")


def _reporting_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per normalised address with the manager of its latest row."""
    people = table(spark, d, "people").select(
        normalize_email(F.col("email")).alias("node"), normalize_email(F.col("manager")).alias("manager"), "loaded_at", "rec_id"
    )
    people = people.where(F.length("node") - F.length(F.replace(F.col("node"), F.lit("@"))) == 1)
    last = people.groupBy("node").agg(F.max(F.struct("loaded_at", "rec_id", "manager")).alias("r"))
    return last.select("node", F.col("r.manager").alias("parent"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_reporting_lines(spark, d)).select("node", "root_node", "lvl", "node_path")


def p6_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Size and depth of every tree, from the nested sets."""
    tree = hierarchy.hierarchy(_reporting_lines(spark, d)).where("not in_circle")
    return tree.groupBy("root_node").agg(
        F.max(F.when(F.col("lvl") == 0, F.col("size"))).alias("n_nodes"), F.max("lvl").cast("long").alias("depth"), (F.max("lft") - F.min("lft") + 1).alias("width")
    )


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Everyone above and below each other, from the nested sets."""
    return hierarchy.descendants(hierarchy.hierarchy(_reporting_lines(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack_values(table(spark, d, "people"), "rec_id", "topics").select("rec_id", "pos", "topic")


def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pieces whose quotes or brackets are malformed."""
    return packed.unpack_values(table(spark, d, "people"), "rec_id", "topics").where("error is not null")


_P3_SQL = r"""
WITH l AS (SELECT raw_id, regexp_replace(raw_line, '\r?\n?\z', '') AS s FROM people_raw WHERE line_no IS NULL OR line_no <> 1),
q AS (SELECT raw_id, s, regexp_matches(s, '\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z') AS sound,
  regexp_matches(s, '\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*)){6}\z') AS seven,
  '\A("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),(?:"(?:[^"]|"")*"|[^",]*),(?:"(?:[^"]|"")*"|[^",]*),(?:"(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),' AS re FROM l),
f AS (SELECT raw_id, sound, seven, list_transform([regexp_extract(s, re, 1), regexp_extract(s, re, 2), regexp_extract(s, re, 3)],
  lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS v FROM q),
r AS (SELECT raw_id, CASE WHEN sound IS NULL THEN 'columns' WHEN NOT sound THEN 'quoting' WHEN NOT seven THEN 'columns'
  WHEN (v[1] = '' AND v[2] = '')
    OR NOT regexp_matches(v[2], '\A(?:[^@\s,;:<>()\[\]\\"]+@[^@\s.,;:<>()\[\]\\"]+(?:\.[^@\s.,;:<>()\[\]\\"]+)+)?\z')
    OR NOT regexp_matches(v[3], '\A(?:[^@\s,;:<>()\[\]\\"]+@[^@\s.,;:<>()\[\]\\"]+(?:\.[^@\s.,;:<>()\[\]\\"]+)+)?\z')
    OR (v[1] <> '' AND (NOT regexp_matches(v[1], '\p{L}') OR regexp_matches(v[1], '[\x00-\x1f\x7f-\x{9f}\x{fffd}]'))) THEN 'value' END AS reason FROM f)
SELECT raw_id, reason FROM r WHERE reason IS NOT NULL
"""

_F = r"(\"(?:[^\"]|\"\")*\"|[^\",]*)"
_EXTRACT = r"regexp_extract(s, '\A" + ",".join([_F] * 7) + r"\z', {0})"
_P3_PEOPLE_SQL = _P3_SQL.rsplit("SELECT raw_id, reason FROM r", 1)[0] + rf""",
g AS (SELECT raw_id, [{', '.join(_EXTRACT.format(i) for i in range(1, 8))}] AS v FROM q WHERE raw_id IN (SELECT raw_id FROM r WHERE reason IS NULL)),
w AS (SELECT raw_id, list_transform(v, lambda x: nullif(trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '')) AS c FROM g)
SELECT raw_id, c[1] AS name, c[2] AS email, c[3] AS title, c[4] AS team, c[5] AS org, c[6] AS manager, c[7] AS topics FROM w
"""

_LINES_SQL = r"""
raw AS (SELECT rec_id, loaded_at, [email, manager] AS a FROM people),
n AS (SELECT rec_id, loaded_at, list_transform(a, lambda x: lower(trim(CASE WHEN regexp_extract(x, '<([^<>]*)>', 1) <> '' THEN regexp_extract(x, '<([^<>]*)>', 1) ELSE x END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))) AS b FROM raw),
m AS (SELECT rec_id, loaded_at, list_transform(b, lambda x: CASE WHEN x LIKE '%@users.noreply.forgehub.example' THEN x ELSE regexp_replace(x, '^([^@+]+)\+[^@]*@', '\1@') END) AS c FROM n),
k AS (SELECT c[1] AS node, c[2] AS manager, row_number() OVER (PARTITION BY c[1] ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS rn FROM m
  WHERE length(c[1]) - length(replace(c[1], '@', '')) = 1),
e AS (SELECT a.node, b.node AS parent FROM (SELECT * FROM k WHERE rn = 1) a LEFT JOIN (SELECT * FROM k WHERE rn = 1) b ON a.manager = b.node),
t(node, root_node, lvl, node_path) AS (SELECT node, node, 0, node FROM e WHERE parent IS NULL
  UNION ALL SELECT e.node, t.root_node, t.lvl + 1, t.node_path || '>' || e.node FROM e JOIN t ON e.parent = t.node)
"""
_P6_SQL = "WITH RECURSIVE " + _LINES_SQL + """
SELECT node, root_node, lvl, node_path FROM t
UNION ALL SELECT node, 'cycle', -1, '' FROM e WHERE node NOT IN (SELECT node FROM t)
"""
_P6_RANGES_SQL = "WITH RECURSIVE " + _LINES_SQL + """
SELECT root_node, count(*) AS n_nodes, CAST(max(lvl) AS BIGINT) AS depth, count(*) AS width FROM t GROUP BY root_node
"""
_P6_DESC_SQL = "WITH RECURSIVE " + _LINES_SQL + """
SELECT u AS ancestor, node FROM (SELECT node, unnest(string_split(node_path, '>')[:-2]) AS u FROM t WHERE lvl > 0)
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_people": p3_people,
    "p5_found": p5_found,
    "p5_zones": p5_zones,
    "p6_found": p6_found,
    "p6_ranges": p6_ranges,
    "p6_descendants": p6_descendants,
    "p7_found": p7_found,
    "p7_errors": p7_errors,
}
ORACLE = {"p3_found": _P3_SQL, "p3_people": _P3_PEOPLE_SQL, "p6_found": _P6_SQL, "p6_ranges": _P6_RANGES_SQL, "p6_descendants": _P6_DESC_SQL}
