"""Mixed timestamp formats and zones: one parse in the JVM, zones aligned with ingestion times, one UTC instant."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours east of UTC that a written abbreviation stands for.
ZONE_HOURS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "NPT": 5.75, "IST": 5.5, "JST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "AWST": 8, "NZST": 12, "NZDT": 13,
    "BRT": -3, "BRST": -2, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

_SEP = "\x01"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,?\s+)?"
_DATE = (
    r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"  # 1-4: year first
    r"|(\d{4})(\d{2})(\d{2})"  # 5-7: basic form
    r"|(\d{1,2})(?:\.\s*|-|\s+)([A-Za-z]{3,9})\.?(?:-|,?\s+)(\d{4})"  # 8-10: day, month name
    r"|([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"  # 11-13: month name, day
    r"|(\d{1,2})([-/.])(\d{1,2})\15(\d{4}))"  # 14-17: order of the site
)
_TIME = r"(?:(?:T|,?\s+(?:at\s+)?)(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?\s*(Z|z|[A-Za-z]{2,5}|[-+]\d{2}(?::?\d{2})?)?)?"
_PATTERN = rf"^{_WEEKDAY}{_DATE}{_TIME}$"
_GROUPS = 23
_DAY_US = 86_400_000_000


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month(name: Column) -> Column:
    """1-12 of an English month name or its first three letters; NULL for other words."""
    low = F.lower(name)
    names = {m[:3].lower() for m in MONTHS} | {m.lower() for m in MONTHS} | {"sept"}
    place = F.instr(F.lit("".join(m[:3].lower() for m in MONTHS)), F.substring(low, 1, 3))
    return F.when(low.isin(*sorted(names)), ((place + 2) / 3).cast("int"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row, so that later filters and projections use their values
    instead of being pushed below and repeating their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse_wall(df: DataFrame, value: str, day_first: str) -> DataFrame:
    """Adds ``_wall`` (microseconds of the written clock reading, as if UTC), ``_offset`` (written offset in
    microseconds, NULL without a zone) and ``_instant`` (epoch numbers). All three NULL: no existing date.

    One regular expression reads every written form; whole-stage code, no Python.
    """
    v = F.regexp_replace(F.col(value), r"^[\s ]+|[\s ]+$", "")
    marked = F.regexp_replace(v, _PATTERN, _SEP + _SEP.join(f"${i}" for i in range(1, _GROUPS + 1)) + _SEP)
    df = _once(df, _v=v, _p=F.when(v.rlike(r"^[-+]?\d{9,19}(\.\d+)?$"), F.lit(None)).otherwise(F.split(marked, _SEP)))
    p = lambda i: F.col("_p")[i]
    has = lambda i: p(i) != ""
    ok = F.size("_p") == _GROUPS + 2
    first, second = _int(p(14)), _int(p(16))
    # Each part of the clock reading once.
    fields = {
        "_y": F.coalesce(_int(p(1)), _int(p(5)), _int(p(10)), _int(p(13)), _int(p(17))),
        "_m": F.coalesce(_int(p(3)), _int(p(6)), _month(F.concat(p(9), p(11))), F.when(F.col(day_first), second).otherwise(first)),
        "_d": F.coalesce(_int(p(4)), _int(p(7)), _int(p(8)), _int(p(12)), F.when(F.col(day_first), first).otherwise(second)),
        "_h": F.coalesce(_int(p(18)), F.lit(0)),
        "_mi": F.coalesce(_int(p(19)), F.lit(0)),
        "_s": F.coalesce(_int(p(20)), F.lit(0)),
        "_us": F.coalesce(_int(F.rpad(F.substring(p(21), 1, 6), 6, "0")), F.lit(0)),
        "_half": F.lower(p(22)),
        "_zone": F.upper(p(23)),
    }
    df = _once(df, **{k: F.when(ok, c) for k, c in fields.items()})
    f = SimpleNamespace(**{k[1:]: F.col(k) for k in fields})
    last = F.when(f.m.isin(4, 6, 9, 11), 30).when(f.m == 2, F.when((f.y % 4 == 0) & ((f.y % 100 != 0) | (f.y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    hour = F.when(f.half == "", f.h).when(f.half == "p", f.h % 12 + 12).otherwise(f.h % 12)
    clock = (f.h < 24) & (f.mi < 60) & (f.s < 60) & ((f.half == "") | f.h.between(1, 12))
    valid = f.y.between(1, 9999) & f.m.between(1, 12) & (f.d >= 1) & (f.d <= last) & clock
    hours = F.create_map(*[F.lit(x) for k, h in ZONE_HOURS.items() for x in (k, int(h * 3_600_000_000))])
    sign = F.when(f.zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(f.zone, "[-+:]", "")
    written = F.when(
        f.zone.rlike(r"^[-+]"), sign * (_int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))).cast("long") * 60_000_000
    ).when(f.zone.isin(*ZONE_HOURS), hours[f.zone])
    known = (f.zone == "") | f.zone.rlike(r"^[-+]") | f.zone.isin(*ZONE_HOURS)
    wall = F.when(
        valid & known,
        F.unix_date(F.make_date(f.y, f.m, f.d)).cast("long") * _DAY_US + ((hour * 60 + f.mi) * 60 + f.s).cast("long") * 1_000_000 + f.us,
    )
    whole, frac = F.regexp_extract("_v", r"^[-+]?(\d+)", 1), F.regexp_extract("_v", r"\.(\d+)$", 1)
    unit = F.when(F.length(whole) <= 11, 1_000_000).when(F.length(whole) <= 14, 1_000).otherwise(1).cast("long")
    epoch = F.when(
        F.col("_v").rlike(r"^[-+]?\d{9,17}(\.\d+)?$"),
        F.when(F.col("_v").startswith("-"), -1).otherwise(1)
        * (whole.try_cast("long") * unit + F.floor(F.coalesce(_int(F.rpad(F.substring(frac, 1, 6), 6, "0")), F.lit(0)) * unit / 1_000_000)),
    )
    df = _once(df, _wall=wall, _written=written, _instant=epoch.cast("long"))
    return df.withColumn("_offset", F.when(F.col("_wall").isNotNull(), F.col("_written"))).drop("_v", "_p", "_written", *fields)


def to_utc(wall: Column, zone: Column) -> Column:
    """Instant of a wall clock reading: a repeated one is the first of the two, a skipped one moves on by the gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def align_zones(values: DataFrame, candidates: DataFrame, site: str = "site", slack_us: int = 2 * 3_600_000_000) -> DataFrame:
    """The offset history of each site that breaks the fewest alignments with ingestion: ``site, zone, violations, n``.

    ``values`` holds ``site, _wall, ingested_us`` of readings without zone, ``candidates`` rows of ``site, zone``:
    the histories a site may have (one where it is declared, all where it isn't). Under a candidate a reading is
    violated if its instant lies after its ingestion or more than ``slack_us`` before it. Fewest violations
    win, then the smaller total distance, then the zone's name. Counts are combined before the shuffle, which
    carries one row per site and candidate.
    """
    lag = F.col("ingested_us") - to_utc(F.col("_wall"), F.col("zone"))
    tallies = (
        values.join(candidates, [site])
        .groupBy(site, "zone")
        .agg(
            F.sum(F.when((lag < 0) | (lag > slack_us), 1).otherwise(0)).alias("violations"),
            F.sum(F.least(F.abs(lag), F.lit(10 * slack_us)).cast("double")).alias("_far"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    best = tallies.groupBy(site).agg(F.min(F.struct("violations", "_far", "zone", "n")).alias("b"))
    return best.select(site, F.col("b.zone").alias("zone"), F.col("b.violations").alias("violations"), F.col("b.n").alias("n"))


def normalise(values: DataFrame, sites: DataFrame, keep: tuple[str, ...], day_slack_us: int = 2 * 3_600_000_000) -> DataFrame:
    """``values`` (``*keep, value, site, ingested_us``) as ``*keep, utc_us``; unreadable ones have NULL.

    Digits are an epoch number by magnitude or, if eight, a day. A written offset or abbreviation holds as
    written. Other readings are wall time under their site's offset history: the declared one, and where a
    site isn't declared or is NULL, the one among all declared histories that ``align_zones`` finds. Without any
    history such readings are UTC. NULL and blank values are unreadable, repeated rows come out repeated, an
    empty table gives an empty one. ``sites`` is ``site, time_zone, day_first``, one row per site.
    """
    values = values.select(*dict.fromkeys((*keep, "value", "site", "ingested_us")))
    declared = sites.select("site", F.col("time_zone").alias("_declared"), F.col("day_first").alias("_day_first"))
    parsed = parse_wall(values.join(declared, ["site"], "left").withColumn("_day_first", F.coalesce("_day_first", F.lit(False))), "value", "_day_first")
    # A scan of the sites alone tells whether any has to be aligned; as a rule none has.
    lost = values.select(F.coalesce("site", F.lit("")).alias("site")).distinct().join(declared, ["site"], "left_anti")
    if lost.isEmpty():
        parsed = parsed.withColumn("_found", F.lit(None).cast("string"))
    else:
        strays = values.withColumn("site", F.coalesce("site", F.lit(""))).join(declared, ["site"], "left_anti").withColumn("_day_first", F.lit(False))
        unknown = parse_wall(strays, "value", "_day_first").where("_wall is not null and _offset is null and ingested_us is not null")
        # Every stray site under every declared history: as many rows as sites times zones, not as readings.
        histories = sites.select(F.col("time_zone").alias("zone")).distinct()
        found = align_zones(unknown.select("site", "_wall", "ingested_us"), lost.crossJoin(histories), "site", day_slack_us)
        parsed = parsed.join(found.select(F.col("site").alias("_s"), F.col("zone").alias("_found")), F.coalesce(parsed["site"], F.lit("")) == F.col("_s"), "left")
    zone = F.coalesce("_declared", "_found", F.lit("UTC"))
    utc = F.when(F.col("_instant").isNotNull(), F.col("_instant")).when(F.col("_offset").isNotNull(), F.col("_wall") - F.col("_offset")).when(F.col("_wall").isNotNull(), to_utc(F.col("_wall"), zone))
    return parsed.select(*keep, utc.alias("utc_us"))
