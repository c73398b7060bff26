"""The assessment: risk, ownership, departures, places and connections from one set of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowgrid.operators import risk, ties
from knowgrid.session import materialise


def assess(pt: DataFrame, declared: DataFrame, places: DataFrame, links: DataFrame, k: int = 3) -> dict[str, DataFrame]:
    """Findings by name, from person-topic facts, declared owners, work on places and ties.

    Facts are written once and every finding reads them; all departures come from one join of leaders and risks rather
    than one pass a person.
    """
    pt = materialise(pt, "facts")
    risks = materialise(risk.risk(pt), "risks")
    lead = risk.leaders(pt, k)
    areas = risk.owned_areas(declared, pt)
    return {
        "risks": risks,
        "leaders": lead,
        "departures": lead.where("rank = 1").join(risks, ["topic"]).select("person", "topic", "experts", "bus", "level"),
        "exposure": risk.exposure(pt, risks),
        "owned_areas": areas,
        "ownership": risk.ownership_report(areas),
        "places": risk.place_leads(places),
        "spans": ties.sole_spans(links),
        "regions": ties.regions(links, lead.where("rank = 1")),
        "counts": risks.agg(F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "elevated").alias("elevated"), F.count(F.lit(1)).alias("topics")),
    }
