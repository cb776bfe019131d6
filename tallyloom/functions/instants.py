"""Instants written in many notations, read with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import BLANK, half_width, trimmed

# Minutes east of UTC of abbreviations that one zone only has.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "MDT": -360, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that several zones share.
SHARED = ("CST", "CDT", "IST", "BST", "AST", "ADT", "PST", "MST", "GST", "ECT", "WST", "SST")
# Months.
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
#: Day 0 of the serial numbers of spreadsheets, as days since 1970.
SERIAL_ZERO = -25569

DONE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
_ZONE = r"(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2})?"
_HALF = "上午|下午|凌晨|早上|中午|晚上"
# Each pattern and the order in which its groups give: zone word before, year, month, day, half of the day, hour, minute, second, fraction, am/pm, zone.
_YEAR_FIRST = rf"^(北京时间)? ?(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?[T ]?({_HALF})?(\d{{1,2}})[:时](\d{{1,2}})(?:[:分](\d{{1,2}}))?[分秒]?(?:[.,](\d{{1,9}}))? ?([AaPp][Mm])? ?{_ZONE}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"
_DAY_ORDER = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[T ](\d{{1,2}}):(\d{{1,2}})(?::(\d{{1,2}}))?(?:[.,](\d{{1,9}}))? ?([AaPp][Mm])? ?{_ZONE}$"
_MONTH_NAME = rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]{{0,6}}[ -](\d{{4}}),? (\d{{1,2}})[:.](\d{{1,2}})(?:[:.](\d{{1,2}}))?(?:[.,](\d{{1,9}}))? ?([AaPp][Mm])? ?{_ZONE}$"


def read_instants(df: DataFrame, text: str, order: str, between=lambda df: df) -> DataFrame:
    """Puts `done`, `utc_us` and `local_us` in the place of the columns `text` and `order`.

    done: already ISO with Z. utc_us: microseconds since 1970 where the text tells the zone. local_us: microseconds of the
    local clock, for texts that tell a time but no zone, or one by an abbreviation that several zones share.
    `order` (DMY, MDY or YMD, may be null) says how all-digit dates that do not start with the year are ordered; where it
    is neither DMY nor MDY such a text is not read.

    A day's hour 24 is the next midnight; fractions of a day are rounded to the second. Texts that tell no instant, days
    that no calendar has and unknown abbreviations give nulls. All of it stays in the JVM: first each text is brought to
    one canonical form by a pattern a notation, then the numbers are read; `between` is applied in the middle, as for a
    shuffle that is needed anyway, and keeps the two parts in separate compiled stages.
    """
    keep = [c for c in df.columns if c not in (text, order)]
    df = df.select(*keep, F.regexp_replace(trimmed(half_width(F.col(text))), BLANK + "+", " ").alias("i_t"), F.col(order).alias("i_o"))
    bar = lambda pattern, groups: F.regexp_replace("i_t", pattern, "|".join(groups))
    day_first, month_first = ["", "$3", "$2", "$1", "$8", "$4", "$5", "$6", "$7", "$9"], ["", "$3", "$1", "$2", "$8", "$4", "$5", "$6", "$7", "$9"]
    canonical = (
        F.when(F.col("i_t").rlike(DONE), F.lit("done"))
        .when(F.col("i_t").rlike(r"^\d+(\.\d{1,12})?$") & ~F.col("i_t").rlike(r"^\d{14}$"), F.col("i_t"))
        .when(F.col("i_t").rlike(_YEAR_FIRST), bar(_YEAR_FIRST, ["$1", "$2", "$3", "$4", "$5$10", "$6", "$7", "$8", "$9", "$11"]))
        .when(F.col("i_t").rlike(_COMPACT), bar(_COMPACT, ["", "$1", "$2", "$3", "", "$4", "$5", "$6", "", ""]))
        .when(F.col("i_t").rlike(_MONTH_NAME), bar(_MONTH_NAME, day_first))
        .when((F.col("i_o") == "DMY") & F.col("i_t").rlike(_DAY_ORDER), bar(_DAY_ORDER, day_first))
        .when((F.col("i_o") == "MDY") & F.col("i_t").rlike(_DAY_ORDER), bar(_DAY_ORDER, month_first))
    )
    df = between(df.select(*keep, canonical.alias("i_c")))
    df = df.select(*keep, F.col("i_c"), F.split("i_c", r"\|").alias("i_p"))
    words = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    numbers = F.transform("i_p", lambda x: F.coalesce(x.try_cast("int"), F.try_element_at(words, F.lower(x)), F.lit(0)))
    df = df.select("*", numbers.alias("i_n"))
    n = lambda i: F.get("i_n", F.lit(i))
    part = lambda i: F.get("i_p", F.lit(i))
    zone = F.when(part(0) == "北京时间", F.lit("+0800")).otherwise(part(9))
    half, h = part(4), n(5)
    hour = (
        F.when(half.rlike("^(下午|[Pp][Mm])$") & (h < 12), h + 12).when(half.rlike("^(上午|凌晨|早上|[Aa][Mm])$") & (h == 12), 0)
        # noon is from ten to three, an evening ends in the small hours of the next day
        .when((half == "中午") & (h < 4), h + 12).when((half == "晚上") & (h < 13), F.when(h == 12, 24).when(h < 5, h + 24).otherwise(h + 12)).otherwise(h)
    )
    date = F.concat_ws("-", part(1), n(2).cast("string"), part(3)).try_cast("date")
    df = df.select(*keep, "i_c", "i_n", zone.alias("i_z"), hour.alias("i_h"), F.unix_date(date).alias("i_d"), F.rpad(F.substring(part(8), 1, 6), 6, "0").try_cast("bigint").alias("i_f"), (F.size("i_p") > 1).alias("i_many"), F.coalesce(part(4) == "晚上", F.lit(False)).alias("i_late"))
    seconds = F.col("i_h") * 3600 + n(6) * 60 + n(7)
    valid = F.col("i_many") & (n(1) > 0) & (n(6) < 60) & (n(7) < 60) & (seconds <= F.when(F.col("i_late"), 105_000).otherwise(86400))
    clock = F.col("i_d").cast("bigint") * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + F.coalesce("i_f", F.lit(0))
    serial = F.round((F.col("i_c").try_cast("decimal(20,12)") + SERIAL_ZERO) * 86400, 0).cast("bigint") * 1_000_000
    fixed = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    offset = F.substring("i_z", 2, 2).try_cast("int") * 60 + F.substring("i_z", -2, 2).try_cast("int")
    minutes = F.when(F.col("i_z").startswith("-"), -offset).when(F.col("i_z").startswith("+"), offset).otherwise(F.try_element_at(fixed, F.col("i_z")))
    df = df.select(
        *keep, "i_c", F.col("i_z").alias("i_z"), minutes.cast("bigint").alias("i_min"),
        F.when(valid, clock).when(F.col("i_c").rlike(r"^\d{5}\.\d+$"), serial).alias("i_clock"),
        F.when(F.col("i_c").rlike(r"^(\d{10}|\d{13}|\d{16})$"), F.rpad("i_c", 16, "0").try_cast("bigint")).alias("i_epoch"),
    )
    open_zone = F.coalesce("i_z", F.lit("")).isin("", *SHARED)
    return df.select(
        *keep, F.coalesce(F.col("i_c") == "done", F.lit(False)).alias("done"),
        F.coalesce("i_epoch", F.col("i_clock") - F.col("i_min") * 60_000_000).alias("utc_us"),
        F.when(open_zone, F.col("i_clock")).alias("local_us"),
    )


def to_utc(local_us: Column, zone: Column) -> Column:
    """The UTC microseconds of a local clock's; a time that occurs twice is its first occurrence, one that is skipped moves on with the clock."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
