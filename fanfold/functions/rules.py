"""Row-quality rules: a struct ``(valid, reason)`` per row; no row is ever dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanfold.functions.paths import RUN_ID

# Limits and names the rules test against.
MAX_EXP_ID = 200
MAX_FREE_RUN_ID = 100
MAX_LABEL = 63
STAGE_NAMES = ["a", "b", "c", "builder", "runner", "output"]
TOKEN_PREFIXES = ["github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
TOKEN_LENGTHS = (20, 300)


def stripped(value: Column) -> Column:
    """Without white space (tabs and line ends too) at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+\z", "")


def _verdict(*failures: tuple[Column, str]) -> Column:
    """The first failing rule is the reason; none failing means valid."""
    chain = F
    for failed, reason in failures:
        chain = chain.when(failed, reason)
    reason = chain.otherwise(F.lit(None).cast("string"))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def _blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def check_exp_id(exp_id: Column) -> Column:
    value = stripped(exp_id)
    return _verdict(
        (_blank(value), "empty"),
        (value.contains("..") | value.contains("\\"), "path traversal"),
        (~value.rlike(r"^[a-zA-Z0-9_/-]+\z"), "invalid characters"),
        (F.length(value) > MAX_EXP_ID, "too long"),
    )


def check_run_id(run_id: Column) -> Column:
    """Ranges are tested part by part, so 30 February passes here (but has no timestamp)."""
    value = stripped(run_id)
    generated = value.rlike(rf"^{RUN_ID}\z")

    def part(start: int, length: int) -> Column:
        return F.substring(value, start, length).try_cast("int")

    return _verdict(
        (_blank(value), "empty"),
        (generated & ~part(1, 4).between(2020, 2100), "year"),
        (generated & ~part(5, 2).between(1, 12), "month"),
        (generated & ~part(7, 2).between(1, 31), "day"),
        (generated & (part(10, 2) > 23), "hour"),
        (generated & (part(12, 2) > 59), "minute"),
        (generated & (part(14, 2) > 59), "second"),
        (~value.rlike(r"^[a-zA-Z0-9_-]+\z"), "format"),
        (F.length(value) > MAX_FREE_RUN_ID, "too long"),
    )


def check_stage(stage: Column) -> Column:
    value = F.lower(stripped(stage))
    return _verdict((_blank(value), "empty"), (~value.isin(STAGE_NAMES), "unknown stage"))


def check_machine(machine_type: Column) -> Column:
    value = stripped(machine_type)
    return _verdict((_blank(value), "empty"), (~value.rlike(r"^[a-z0-9]+-[a-z0-9-]+\z"), "format"))


def check_token(token: Column) -> Column:
    """Format of an access token; neither the result nor the reason holds the token."""
    value = stripped(token)
    return _verdict(
        (_blank(value), "empty"),
        (~value.rlike(f"^(?:{'|'.join(TOKEN_PREFIXES)})"), "prefix"),
        (~F.length(value).between(*TOKEN_LENGTHS), "length"),
    )


def token_flag(text: Column) -> Column:
    """True where any word (cut at white space) of the whole text has the format of a token."""
    low, high = TOKEN_LENGTHS
    return text.rlike(rf"(?<!\S)(?=\S{{{low},{high}}}(?!\S))(?:{'|'.join(TOKEN_PREFIXES)})")


def sanitize_label(value: Column) -> Column:
    """Other characters → ``-``, lower case, cut to 63, then ``-`` and ``_`` stripped at the ends."""
    clean = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "-"))
    return F.regexp_replace(F.substring(clean, 1, MAX_LABEL), r"^[-_]+|[-_]+\z", "")
