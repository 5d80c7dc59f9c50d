"""Joins by time: each fact with the version of its key that was in force when it happened.

Facts and versions of a key are put in one order of time and the last version is carried along (`scan.running`), so a key with very many
facts spreads over slices like any other. A version that starts at the time of a fact counts for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.scalars import TICKET_RATE
from turnstile.operators.scan import running
from turnstile.session import materialise

_VALUES = ["event_name", "city", "category", "base_ticket_price"]


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, ended: str | None = None) -> DataFrame:
    """`facts` with the other columns of the version of their `key` that was the last to start by time `at`.

    Facts before the first version of their key, and those whose last version has `ended` true, are left out. A key has at most one version at
    a time; a NULL key or time has none.
    """
    values = [c for c in versions.columns if c not in (key, since, ended)]
    flag = f"coalesce({ended}, false)" if ended else "false"
    both = facts.where(f"{key} is not null and {at} is not null").select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(True).alias("_fact"), F.struct(*facts.columns).alias("_row"))
    both = both.unionByName(versions.where(f"{key} is not null and {since} is not null").select(
        F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(False).alias("_fact"),
        F.struct(F.expr(flag).alias("_ended"), *values).alias("_version")), allowMissingColumns=True)
    found = running(both, ["_key"], ["_at", "_fact"], {"_found": ("last", "_version")})
    return found.where("_fact and not _found._ended").select("_row.*", *(f"_found.{c}" for c in values))


def catalog_versions(snapshots: DataFrame, taken: str = "snapshot_ts") -> DataFrame:
    """(event_id, since, ended, values) out of whole copies of the catalog, tagged with the time they were `taken`.

    A row is a version where it differs from the copy before, and an event that a copy leaves out has ended then. A copy without rows is no
    copy: the one before stays in force.
    """
    copies = snapshots.selectExpr("event_id", f"cast({taken} as timestamp) as since", f"struct({', '.join(_VALUES)}) as v")
    times = copies.select("since").distinct().withColumn("_all", F.lit("all"))
    numbered = materialise(running(times, ["_all"], ["since"], {"nth": ("sum", "1L")}).select("since", "nth"), "times")
    of_event = Window.partitionBy("event_id").orderBy("nth")
    rows = copies.join(numbered, "since").select(
        "event_id", "since", "nth", "v", F.lag("v").over(of_event).alias("before"), F.lag("nth").over(of_event).alias("before_nth"),
        F.lead("nth").over(of_event).alias("next_nth"))
    started = rows.where("before is null or before_nth < nth - 1 or not v <=> before").selectExpr("event_id", "since", "false as ended", "v.*")
    gone = rows.where("next_nth is null or next_nth > nth + 1").selectExpr("event_id", "nth + 1 as nth", "v").join(numbered, "nth").selectExpr(
        "event_id", "since", "true as ended", "v.*")
    return started.unionByName(gone)


def price_sales_asof(raw: DataFrame, snapshots: DataFrame, taken: str = "snapshot_ts") -> DataFrame:
    """Sales (`key, ts, seq, sale_id, event_id, ticket_type, quantity`) with name, city, category and price of the copy in force when they were made."""
    priced = as_of(raw.select("key", "ts", "seq", "sale_id", "event_id", "ticket_type", "quantity"), catalog_versions(snapshots, taken),
                   "event_id", "ts", "since", "ended")
    return priced.selectExpr("key", "ts", "seq", "sale_id", "event_id", "event_name", "city", "category", "ticket_type",
                             f"cast(base_ticket_price as double) * {TICKET_RATE} as ticket_price", "quantity")
