"""Timestamps in mixed formats and zones, brought to one UTC instant."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.instants import read_instants, to_utc
from tallyloom.session import cut

#: Clocks are compared by quarters of an hour, the finest step between zones.
STEP_US = 900_000_000
#: A registered zone gives way only to one whose share of violations is smaller by this much.
MARGIN = 0.2
#: Offsets are looked up for weeks that begin on Sunday, when clocks are changed: days from 1970-01-01 to the first such Sunday.
SUNDAY = 4


def public_zones() -> list[str]:
    """The names of places in the public zone database; its size is fixed."""
    return sorted(z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/", "posix/", "right/")))


def zone_weeks(zones: list[str], own: list[str], first: int, last: int) -> list[tuple[str, int, int]]:
    """(zone, week, offset) in quarters of an hour for each week from first to last, of all zones in `own` and of the others; of
    other zones with the same offsets throughout only the first one listed."""
    seen, out = set(), []
    middles = [datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(days=7 * w - SUNDAY + 3) for w in range(first, last + 1)]
    for zone in dict.fromkeys(own + zones):
        clock = ZoneInfo(zone)
        offsets = tuple(int(clock.utcoffset(m.astimezone(clock)).total_seconds() * 1_000_000 // STEP_US) for m in middles)
        if zone in own or offsets not in seen:
            seen.add(offsets)
            out += [(zone, w, o) for w, o in zip(range(first, last + 1), offsets, strict=True)]
    return out


def zone_histories(records: DataFrame, own: list[str], zones: list[str] | None = None) -> DataFrame:
    """How often each zone's offset history puts a site's local times out of order: (site, zone, violations, compared).

    own: the zones that sites are registered with; zones: the others that are tried, all of the public database unless given.
    records: (group, site, rank, utc_us, local_us). Within a group, records of rank 0 (arrivals) come before those of rank 1
    (what was made of them). A local time of rank 1 that would lie before the group's first arrival known in UTC, or one of
    rank 0 that would lie after the group's first record of rank 1 known in UTC, violates the order; the former speaks
    against zones too far east, the latter against zones too far west.

    Both sides are aggregated before they meet, by group, and by group and quarter of an hour; no group is gathered. What
    they leave is, for each site and week, how many records any offset breaks; the zones meet that as histories of offsets
    by week, so their number costs next to nothing.
    """
    named = records.filter("group is not null and site is not null")
    known = named.filter("utc_us is not null").groupBy("group").agg(F.min(F.when(F.col("rank") == 0, F.col("utc_us"))).alias("arrived"), F.min(F.when(F.col("rank") == 1, F.col("utc_us"))).alias("made"))
    local = named.filter("local_us is not null").groupBy("group", "site", "rank", F.floor(F.col("local_us") / STEP_US).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    # a record of rank 1 is broken by offsets of more than `bound` quarters, one of rank 0 by offsets of less
    bound = F.when(F.col("rank") == 1, F.floor(F.col("q") + 1 - F.col("arrived") / STEP_US)).otherwise(F.ceil(F.col("q") - F.col("made") / STEP_US))
    tried = local.join(known, "group").select("site", "rank", F.floor((F.floor(F.col("q") / 96) + SUNDAY) / 7).alias("week"), F.greatest(F.least(bound, F.lit(100)), F.lit(-100)).alias("bound"), "n").filter("bound is not null")
    tried, seen = cut(tried.groupBy("site", "week", "rank", "bound").agg(F.sum("n").alias("n")), first=F.min("week"), last=F.max("week"))
    weeks = zone_weeks(public_zones() if zones is None else zones, own, seen["first"], seen["last"]) if seen["first"] is not None else []
    table = records.sparkSession.createDataFrame(weeks, "zone string, week bigint, offset bigint")
    offsets = sorted({o for _, _, o in weeks})
    broken = F.when(F.col("rank") == 1, F.col("offset") > F.col("bound")).otherwise(F.col("offset") < F.col("bound"))
    each = tried.select("*", F.explode(F.array(*map(F.lit, offsets)).cast("array<bigint>")).alias("offset"))
    counted = each.groupBy("site", "week", "offset").agg(F.sum(F.when(broken, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("compared"))
    return counted.join(table, ["week", "offset"]).groupBy("site", "zone").agg(F.sum("violations").alias("violations"), F.sum("compared").alias("compared"))


def choose_zones(histories: DataFrame, registered: DataFrame) -> DataFrame:
    """One zone a site: (site, zone, basis, violations, compared, estimate).

    The zone with the fewest violations, by name among equals, is the estimate. The registered one stands before it unless it
    breaks the order of clearly more records. `basis` is `registered`, `corrected` or `estimated`.
    """
    both = histories.join(registered.select("site", F.col("zone").alias("own")), "site", "full").withColumn("zone", F.coalesce("zone", "own"))
    share = F.coalesce(F.col("violations") / F.col("compared"), F.lit(0.0))
    is_own = F.col("zone").eqNullSafe(F.col("own"))
    cost = F.when(F.col("own").isNotNull() & ~is_own, share + MARGIN).otherwise(share)
    least = lambda cost: F.min(F.struct(cost, (~is_own).alias("other"), "zone", "own", "violations", "compared"))
    best = both.groupBy("site").agg(least(cost.alias("cost")).alias("b"), least(share.alias("cost")).alias("e"))
    basis = F.when(F.col("b.own").isNull(), "estimated").when(F.col("b.own") == F.col("b.zone"), "registered").otherwise("corrected")
    return best.select("site", "b.zone", basis.alias("basis"), "b.violations", "b.compared", F.col("e.zone").alias("estimate"))


def listed_zones(sites: DataFrame) -> list[str]:
    """The zones that sites are registered with; each has to be in the public database, which bounds their number."""
    own = sorted(r[0] for r in sites.filter("zone is not null").select("zone").distinct().limit(2_000).collect())
    if unknown := [z for z in own if z not in available_timezones()]:
        raise ValueError(f"zones that the public database does not know: {unknown[:5]}")
    return own


def normalised(records: DataFrame, sites: DataFrame, keep=lambda df: df) -> DataFrame:
    """Every record once with its instant: (table_name, row_key, done, utc_us, basis).

    records: (table_name, row_key, group, site, rank, text); sites: (site, zone, day_order). `basis` says what told the
    zone: `text`, or the way in which the site's zone was found (`registered`, `corrected`, `estimated`); null where the
    text tells no instant. The zones tried are those registered and all of the public database. `keep` is applied to the records once read and may cut their lineage, so that they are read once.

    Edge cases: null, blank and unreadable texts have no instant; copies of a record count once; sites that are listed
    twice count once; an empty table gives no rows; other columns of the inputs aren't read.
    """
    listed = sites.filter("site is not null").groupBy("site").agg(F.min("zone").alias("zone"), F.min("day_order").alias("day_order"))
    with_order = records.filter("table_name is not null and row_key is not null").select("table_name", "row_key", "group", "site", "rank", "text").join(listed.select("site", "day_order"), "site", "left")
    read = keep(read_instants(with_order, "text", "day_order", lambda df: df.dropDuplicates(["table_name", "row_key"])))
    chosen = choose_zones(zone_histories(read, listed_zones(listed)), listed.select("site", "zone"))
    out = read.join(chosen.select("site", "zone", "basis"), "site", "left")
    from_site = F.col("utc_us").isNull() & F.col("local_us").isNotNull() & F.col("zone").isNotNull()
    out = out.withColumn("basis", F.when(F.col("utc_us").isNotNull(), "text").when(from_site, F.col("basis")))
    out = out.withColumn("utc_us", F.when(from_site, to_utc(F.col("local_us"), F.col("zone"))).otherwise(F.col("utc_us")))
    return out.select("table_name", "row_key", "done", "utc_us", "basis")
