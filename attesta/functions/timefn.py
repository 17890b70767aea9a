"""Time: absent, date-only, ambiguous and missing local times stay what they are.

Sessions are in UTC. Local times are resolved by trying offsets and keeping those instants that
read back as the local time: none in a gap, two in an overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest epoch second that has four year digits: a fixed value.
LAST_SECOND = 253402300799


def epoch_instant(seconds: Column) -> Column:
    """Epoch seconds as an instant; zero, negative, null and out-of-range mean absent."""
    s = seconds.cast("long")
    return F.when(s.between(1, LAST_SECOND), F.timestamp_seconds(s))


def instants_of(local: Column, zone: Column | str) -> Column:
    """All instants that read as ``local`` (a timestamp whose UTC fields are the local ones) in ``zone``, in order."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    micros = F.unix_micros(local)

    def shifted(hours: Column) -> Column:
        probe = F.timestamp_micros(micros + hours * 3_600_000_000)
        offset = F.unix_micros(F.from_utc_timestamp(probe, z)) - F.unix_micros(probe)
        return F.timestamp_micros(micros - offset)

    tried = F.transform(F.sequence(F.lit(-36), F.lit(36), F.lit(6)), lambda h: shifted(h.cast("long")))
    return F.array_sort(F.array_distinct(F.filter(tried, lambda t: F.from_utc_timestamp(t, z) == local)))


def normalize(original: Column, date: Column, date_time: Column, zone: Column) -> Column:
    """``(kind, instant, date, zone, reason)`` of a source's date.

    An offset in the text decides, and one that the zone doesn't have is noted; without an offset
    the zone decides if it gives exactly one instant; a date alone is a date.
    """
    offset = F.regexp_extract(date_time, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    has_offset = offset != ""
    local = F.try_to_timestamp(F.regexp_replace(date_time, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    shift = F.when(offset == "Z", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    by_offset = F.timestamp_micros(F.unix_micros(local) - shift.cast("long") * 60_000_000)
    candidates = F.when(local.isNotNull() & zone.isNotNull(), instants_of(local, zone))
    n = F.size(candidates)
    kind = F.when(date_time.isNull() & F.try_to_date(date).isNotNull(), "date_only").when(has_offset & local.isNotNull(), "instant").when(n == 1, "instant").otherwise("unresolved")
    reason = (
        F.when(date_time.isNull() & date.isNull(), "absent")
        .when(date_time.isNull() & F.try_to_date(date).isNull(), "invalid")
        .when(date_time.isNotNull() & local.isNull(), "invalid")
        .when(has_offset & zone.isNotNull() & (F.from_utc_timestamp(by_offset, F.coalesce(zone, F.lit("UTC"))) != local), "offset_zone_mismatch")
        .when(has_offset | date_time.isNull(), F.lit(None))
        .when(zone.isNull(), "missing_zone")
        .when(n == 0, "nonexistent_local_time")
        .when(n > 1, "ambiguous_local_time")
    )
    instant = F.when(has_offset, by_offset).when(n == 1, F.get(candidates, 0))
    return F.struct(original.alias("original"), kind.alias("kind"), instant.alias("instant"), F.try_to_date(date).alias("date"), zone.alias("zone"), reason.alias("reason"))


def displays(instant: Column, zones: Sequence[str]) -> Column:
    """Wall times of an instant in several zones."""
    return F.array(*[F.struct(F.lit(z).alias("zone"), F.date_format(F.from_utc_timestamp(instant, z), "yyyy-MM-dd HH:mm:ss").alias("local")) for z in zones])


def local_state(local: Column, zone: Column | str) -> Column:
    n = F.size(instants_of(local, zone))
    return F.when(n == 0, "nonexistent").when(n == 1, "unique").otherwise("ambiguous")


def schedule_windows(days: DataFrame, day: str, zone: str, times: Sequence[str], duration_seconds: int, starts: Column, expires: Column) -> DataFrame:
    """Windows of wall-clock times on each day, clipped to ``starts..expires``.

    A local time that doesn't exist has no window; one that exists twice has its first.
    """
    at = F.explode(F.array(*[F.lit(t) for t in times]))
    local = days.withColumn("time", at).withColumn("_local", F.to_timestamp(F.concat_ws(" ", F.col(day).cast("string"), F.concat("time", F.lit(":00")))))
    first = local.withColumn("_start", F.array_min(instants_of(F.col("_local"), zone))).filter("_start is not null")
    end = F.col("_start") + F.make_dt_interval(secs=F.lit(duration_seconds))
    clipped = first.withColumns({"window_start": F.greatest("_start", starts), "window_end": F.least(end, expires)})
    return clipped.filter("window_start < window_end").drop("_local", "_start")


def milliseconds(code: Column) -> Column:
    """``[h:]mm:ss[.,]mmm`` in milliseconds; null if it isn't one."""
    part = lambda i: F.regexp_extract(code, r"^(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[.,](\d{3})$", i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(part(3) != "", ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + number(4))


def date_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str], dates: str | None = None) -> DataFrame:
    """Unpivoted dates of entities: named epoch fields, and at most twenty of an array of ``(label, timestamp)``."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), epoch_instant(F.col(f)).alias("at")) for f in fields])
    if dates:
        rows = F.concat(rows, F.transform(F.slice(F.coalesce(F.col(dates), F.array()), 1, 20), lambda d: F.struct(d["label"].alias("field"), epoch_instant(d["timestamp"]).alias("at"))))
    return df.select(*keys, F.explode(rows).alias("_d")).select(*keys, "_d.field", "_d.at").filter("at is not null")
