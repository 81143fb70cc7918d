"""Paths, run ids, glob patterns and content types."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a run id and of the parts of an artifact path.
RUN_ID = "[0-9]{8}-[0-9]{6}-[a-f0-9]{8}"
TASK_WIDTH = 5
TEXT_END = 2**31 - 1

# Content type by file extension; ``.gz`` wins over all of them.
CONTENT_TYPES = {
    ".csv": "text/csv",
    ".json": "application/json",
    ".txt": "text/plain",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".png": "image/png",
    ".pdf": "application/pdf",
    ".svg": "image/svg+xml",
    ".pkl": "application/octet-stream",
    ".parquet": "application/octet-stream",
}
GZIP_TYPE = "application/gzip"
DEFAULT_TYPE = "application/octet-stream"

# Report files wanted of every experiment, and of hospital experiments on top.
BASE_TARGETS = ["posterior_grid.pdf", "quantiles_grid_sidebyside.pdf"]
HOSPITAL_PREFIX = "hosp_"
HOSPITAL_TARGETS = [*BASE_TARGETS, "categorical_rate_trends.pdf"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def artifact_path(prefix: str, exp_id: Column, run_id: Column, *parts: Column | str,
                  bucket: str | None = None) -> Column:
    """``prefix/exp/run/parts…``; with ``bucket`` the path starts with it (local layout)."""
    head = [F.lit(bucket)] if bucket else []
    if prefix.rstrip("/"):
        head.append(F.lit(prefix.rstrip("/")))
    tail = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("/", *head, exp_id, run_id, *tail)


def task_file(kind: str, task_index: Column) -> Column:
    """Zero-padded to five digits; wider numbers keep all their digits."""
    return F.format_string(f"{kind}_%0{TASK_WIDTH}d.pkl.gz", task_index)


def content_type(path: Column) -> Column:
    chain = F.when(path.endswith(".gz"), GZIP_TYPE)
    for extension, kind in CONTENT_TYPES.items():
        chain = chain.when(path.endswith(extension), kind)
    return chain.otherwise(DEFAULT_TYPE)


def below(path: Column, prefix: str) -> Column:
    """The path without ``prefix``, for rows known to start with it."""
    return F.substring(path, len(prefix) + 1, TEXT_END)


def relative(path: Column, prefix: str) -> Column:
    """The path below ``prefix``; NULL for a path outside it."""
    return F.when(path.startswith(prefix), below(path, prefix))


# ``exp/run``: everything up to the first component, after the leading one, that is a run id.
# Each helper names its input once: a filter on a derived column is evaluated by inserting the
# definition of the column, so every further mention would run the regex again.
RUN_HEAD = rf"(?s)^(.*?/{RUN_ID})(?:/|\z)"


def run_head(rel: Column) -> Column:
    """``exp/run`` of a relative path, empty outside a run."""
    return F.regexp_extract(rel, RUN_HEAD, 1)


def head_exp(head: Column) -> Column:
    return F.regexp_extract(head, "(?s)^(.*)/", 1)


def head_run(head: Column) -> Column:
    return basename(head)


def is_run_id(value: Column) -> Column:
    return value.rlike(rf"^{RUN_ID}\z")


def run_ts(run_id: Column) -> Column:
    """UTC start time in a run id; NULL for other shapes and impossible dates."""
    return F.when(is_run_id(run_id),
                  F.try_to_timestamp(F.substring(run_id, 1, 15), F.lit("yyyyMMdd-HHmmss")))


def destination(path: Column, long: bool = False, prefix: str = "") -> Column:
    """File name of a copy: the base name, or the whole path below ``prefix`` joined by ``_``."""
    if not long:
        return basename(path)
    below = F.coalesce(relative(path, prefix), path) if prefix else path
    return F.replace(below, F.lit("/"), F.lit("_"))


def target_list(exp_id: Column) -> Column:
    return F.when(basename(exp_id).startswith(HOSPITAL_PREFIX),
                  F.array(*map(F.lit, HOSPITAL_TARGETS))
                  ).otherwise(F.array(*map(F.lit, BASE_TARGETS)))


# --- glob patterns (shell rules; ``*`` also crosses ``/``) -------------------------------------


def _quoted(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def _bracket(body: str) -> str:
    """A Java character class for the inside of ``[…]``; backwards ranges match nothing."""
    negated, body = body.startswith("!"), body.removeprefix("!")
    items = []
    for low, high, single in re.findall(r"(?s)(.)-(.)|(.)", body):
        if single:
            items.append(_quoted(single))
        elif low <= high:
            items.append(f"{_quoted(low)}-{_quoted(high)}")
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def _glob_body(pattern: str) -> str:
    token = re.compile(r"(?s)\*+|\?|\[(!?+\]?+[^\]]*)\]|.")
    parts = []
    for found in token.finditer(pattern):
        text = found.group(0)
        if text.startswith("*"):
            parts.append(".*")
        elif text == "?":
            parts.append(".")
        elif found.group(1) is not None:
            parts.append(_bracket(found.group(1)))
        else:
            parts.append(_quoted(text))
    return "".join(parts)


def glob_regex(*patterns: str) -> str:
    """Anchored Java regex that matches what any of the shell patterns matches; an unclosed ``[``
    is literal."""
    return "(?s)^(?:" + "|".join(map(_glob_body, patterns)) + r")\z"


def literal_part(pattern: str) -> str:
    """The text before the first wildcard."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def folder_part(pattern: str) -> str:
    """The folder in which a scan for a pattern begins; a pattern without wildcard is its own."""
    literal = literal_part(pattern)
    return pattern.rstrip("/") if literal == pattern else literal.rpartition("/")[0]


def meanings(pattern: Column) -> Column:
    """The patterns a given one stands for, as an array. A name or folder (``name``, ``name/``) stands for itself
    and for all that lies below; a pattern with a wildcard only for itself."""
    name = F.regexp_replace(pattern, "/+$", "")
    below = F.array(name, F.concat(name, F.lit("/*")))
    return F.when(name.rlike(r"[*?\[]") & ~pattern.endswith("/"), F.array(pattern)).otherwise(below)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_match(value: Column, patterns: Iterable[str]) -> Column:
    """True where any pattern matches; one regex for all of them."""
    return value.rlike(glob_regex(*patterns))


def glob_starts(path: Column, patterns: Iterable[str], prefix: str = "") -> Column:
    """True for every path that a match can have: an ``OR`` of the patterns' literal starts.

    A pattern is anchored, so a match begins with all that stands before the first wildcard. Spark pushes
    ``startswith`` on a stored column into the Parquet scan, which a regex is not.
    """
    return any_of(path.startswith(prefix + start) for start in sorted({literal_part(p) for p in patterns}))


# --- patterns in a column ----------------------------------------------------------------------

# Lengths by which the literal starts of patterns are filed; a start counts by its first so many characters.
START_CLASSES = (0, 1, 2, 4, 8, 16, 32, 64, 128)


def _literal(char: Column) -> Column:
    """One character as a regex that matches it alone, inside and outside of brackets."""
    plain = (char >= "\u0080") | char.rlike("[A-Za-z0-9]")
    return F.when(plain, char).otherwise(F.concat(F.lit("\\"), char))


def _class_of(body: Column) -> Column:
    """:func:`_bracket` for a column."""
    negated = body.startswith("!")
    items = F.regexp_extract_all(F.when(negated, F.substring(body, 2, TEXT_END)).otherwise(body), F.lit("(?s).-.|."), F.lit(0))

    def item(text: Column) -> Column:
        low, high = F.substring(text, 1, 1), F.substring(text, 3, 1)
        ranged = F.when(low <= high, F.concat(_literal(low), F.lit("-"), _literal(high))).otherwise("")
        return F.when(F.length(text) == 3, ranged).otherwise(_literal(text))

    inside = F.array_join(F.transform(items, item), "")
    return F.when(inside == "", F.when(negated, ".").otherwise("(?!)")).otherwise(
        F.concat(F.lit("["), F.when(negated, "^").otherwise(""), inside, F.lit("]")))


def glob_regex_of(pattern: Column) -> Column:
    """:func:`glob_regex` for patterns in a column."""
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\*+|\?|\[(?:!?+\]?+[^\]]*)\]|."), F.lit(0))

    def part(token: Column) -> Column:
        bracket = (F.length(token) > 2) & token.startswith("[")
        return (F.when(token.startswith("*"), ".*").when(token == "?", ".")
                .when(bracket, _class_of(F.substring(token, F.lit(2), F.length(token) - 2)))
                .otherwise(_literal(token)))

    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(tokens, part), ""), F.lit(r")\z"))


def start_class(length: Column) -> Column:
    """The greatest of :data:`START_CLASSES` that is not above a length."""
    return F.array_max(F.filter(F.array(*map(F.lit, START_CLASSES)), lambda c: c <= length))
