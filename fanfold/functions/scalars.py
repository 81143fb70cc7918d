"""Times, durations, states and names as columns; "now" and the zone are always arguments."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units of a duration such as ``90m``.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

# States and severities by class.
STATE_CLASSES = {
    "success": ["SUCCEEDED", "COMPLETED", "SUCCESS"],
    "failure": ["FAILED", "CANCELLED", "CANCELED", "FAILURE"],
    "active": ["ACTIVE", "RUNNING", "PENDING", "QUEUED", "WORKING"],
    "scheduled": ["SCHEDULED"],
}
SEVERITY_CLASSES = {
    "error": ["ERROR", "CRITICAL", "EMERGENCY", "ALERT"],
    "warning": ["WARNING", "NOTICE"],
    "info": ["INFO"],
    "debug": ["DEBUG"],
}
# Names of the three stages.
STAGE_LETTERS = {"builder": "A", "runner": "B", "output": "C"}

_ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?\z"


def instant(iso: Column) -> Column:
    """ISO text to a timestamp, NULL when it cannot be read."""
    return F.when(iso.rlike(_ISO_DAY), iso.try_cast("timestamp"))


def wall_clock(iso: Column) -> Column:
    """ISO text to its own wall clock, whatever offset it carries."""
    return F.when(iso.rlike(_ISO_DAY), iso.try_cast("timestamp_ntz"))


def fmt_full(iso: Column) -> Column:
    return F.coalesce(F.date_format(wall_clock(iso), "yyyy-MM-dd HH:mm:ss"), F.substring(iso, 1, 19))


def fmt_time(iso: Column) -> Column:
    cut = F.when(F.length(iso) >= 19, F.substring(iso, 12, 8)).otherwise(iso)
    return F.coalesce(F.date_format(wall_clock(iso), "HH:mm:ss"), cut)


@cache
def zone_changes(zone: str) -> list[tuple[int, str]]:
    """Instants (seconds) from which a zone goes by another name, with the name, from 1900 to 2100 in order.

    Read from the zone's own rules: a change is looked for between neighbouring days and then halved down to its second.
    """
    rules, day = ZoneInfo(zone), 86_400
    at = lambda s: (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)).astimezone(rules).tzname()
    first = (datetime(1900, 1, 1) - datetime(1970, 1, 1)).days * day
    changes = [(first, at(first))]
    for begin in range(first, first + 200 * 366 * day, day):
        low, high = begin, begin + day
        if at(high) == changes[-1][1]:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if at(middle) == changes[-1][1] else (low, middle)
        changes.append((high, at(high)))
    return changes


def zone_name(utc: Column, zone: str) -> Column:
    """The name that holds in a zone at an instant: that of the last change before it."""
    changes = F.array(*[F.struct(F.lit(s).cast("bigint").alias("at"), F.lit(n).alias("name")) for s, n in zone_changes(zone)])
    seconds = F.unix_timestamp(utc)
    past = F.filter(changes, lambda c: c["at"] <= seconds)
    return F.coalesce(F.try_element_at(past, F.lit(-1))["name"], F.lit(zone_changes(zone)[0][1]))


def fmt_local(iso: Column, zone: str) -> Column:
    utc = instant(iso)
    local = F.from_utc_timestamp(utc, zone)
    text = F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), zone_name(utc, zone))
    return F.when(utc.isNotNull(), text).otherwise(F.substring(iso, 1, 19))


def duration_seconds(start: Column, end: Column, now: Column | str) -> Column:
    """Whole seconds between two ISO texts; an open end means ``now``."""
    closing = F.coalesce(F.nullif(end, F.lit("")), F.lit(now) if isinstance(now, str) else now)
    return F.unix_timestamp(instant(closing)) - F.unix_timestamp(instant(start))


def duration_text(seconds: Column) -> Column:
    """Two largest units (``2h 30m``); a zero second unit is left out."""

    def pair(unit: str, rest: str) -> Column:
        size, small = UNIT_SECONDS[unit], UNIT_SECONDS[rest]
        big = F.floor(seconds / size).cast("string")
        left = F.floor(F.pmod(seconds, F.lit(size)) / small)
        return F.when(left > 0, F.concat(big, F.lit(f"{unit} "), left.cast("string"), F.lit(rest))
                      ).otherwise(F.concat(big, F.lit(unit)))

    return (F.when(seconds.isNull(), "unknown")
            .when(seconds < 0, "0s")
            .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
            .when(seconds < 3600, pair("m", "s"))
            .when(seconds < 86400, pair("h", "m"))
            .otherwise(pair("d", "h")))


def duration_parse(text: Column) -> Column:
    """``<number><unit>`` to seconds; NULL for anything else."""
    amount = F.regexp_extract(text, r"^([+-]?[0-9]+)[smhd]\z", 1).try_cast("bigint")
    size = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    return amount * F.try_element_at(size, F.right(text, F.lit(1)))


def since(text: Column, now: str) -> Column:
    """Moment meant by ``2h`` and the like, counted back from ``now``; else ISO; bad → NULL."""
    base = F.lit(now).cast("timestamp")
    back = F.timestamp_seconds(F.unix_timestamp(base) - duration_parse(text))
    return F.coalesce(back, instant(text))


def since_moment(text: str, now: datetime) -> datetime:
    """Argument form of :func:`since`: a bad value is an error, not a missing filter."""
    found = re.fullmatch(r"([+-]?\d+)([smhd])", text)
    if found:
        return now - timedelta(seconds=int(found[1]) * UNIT_SECONDS[found[2]])
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a relative or ISO time: {text!r}") from None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def _class_of(value: Column, classes: dict[str, list[str]]) -> Column:
    upper = F.upper(value)
    chain = F
    for name, members in classes.items():
        chain = chain.when(upper.isin(members), name)
    return chain.otherwise("other")


def state_class(state: Column) -> Column:
    return _class_of(state, STATE_CLASSES)


def severity_class(severity: Column) -> Column:
    return _class_of(severity, SEVERITY_CLASSES)


def stage_letter(stage: Column) -> Column:
    """``builder/runner/output`` and ``a/b/c`` in any case to ``A/B/C``; other text in upper case."""
    upper = F.upper(F.trim(stage))
    chain = F
    for name, letter in STAGE_LETTERS.items():
        chain = chain.when(upper == name.upper(), letter)
    return chain.otherwise(upper)


def make_run_id(ts: Column, execution_id: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(execution_id, 1, 8))


def image_tag(uri: Column) -> Column:
    """Tag of an image, first seven digits of a digest, ``latest`` when it names neither."""
    last = F.substring_index(uri, "/", -1)
    digest = F.concat(F.lit("sha256:"), F.substring(F.substring_index(uri, "@sha256:", -1), 1, 7))
    return (F.when(uri.isNull() | (uri == ""), "unknown")
            .when(uri.contains("@sha256:"), digest)
            .when(last.contains(":"), F.substring_index(uri, ":", -1))
            .otherwise("latest"))


def short_id(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def full_name(execution_id: Column, parent: str) -> Column:
    """The full resource name; a name that is already full stays."""
    return F.when(execution_id.startswith("projects/"), execution_id
                  ).otherwise(F.concat(F.lit(f"{parent}/executions/"), execution_id))


def job_exp_id(env: Column, labels: Column) -> Column:
    return F.coalesce(F.try_element_at(env, F.lit("EXP_ID")),
                      F.try_element_at(labels, F.lit("exp_id")), F.lit("unknown"))


def effective_end(events: Column, update_time: Column, create_time: Column) -> Column:
    """Time of the last status event, else of the update, else of the creation."""
    last = F.try_element_at(events, F.lit(-1)).getField("event_time")
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (last, update_time, create_time)])


def machine_parts(machine_type: Column) -> Column:
    """``family-kind-vcpus`` as a struct; missing parts are NULL."""
    parts = F.split(machine_type, "-")
    return F.struct(F.get(parts, 0).alias("family"), F.get(parts, 1).alias("kind"),
                    F.get(parts, 2).try_cast("int").alias("vcpus"))


def number_override(override: Column, default: Column) -> Column:
    return F.when(override > 0, override).otherwise(default)


def text_override(override: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), default)


def offset_date(reference: Column, days: Column) -> Column:
    return F.date_add(reference, F.round(days).cast("int"))
