"""Path, pattern, time and rule functions on hand-made values."""

from __future__ import annotations

import fnmatch
import random
import re
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fanfold.functions import paths as P
from fanfold.functions import rules as Q
from fanfold.functions import scalars as S
from fanfold.operators.catalog import expand_patterns, match_patterns


def values(spark, texts, make, kind="STRING"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i INT, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("x"))).collect()]


# --- patterns ----------------------------------------------------------------------------------

NAMES = ["202605/hosp_a", "202605/ed_b", "test", "test/x/y", "a[b", "a.b", "axb", "line\nbreak", "-", "]", "!x", "A", "", "a-c", "^"]
PATTERNS = ["*", "202605/*", "*hosp*", "test", "?est", "a[b", "a.b", "a?b", "[!x]*", "[a-c]*", "[]]", "[!]]", "line*", "[c-a]*", "[",
            "[]", "[!", "[!]", "a**b", "[^]", "[-]", "[a-]*", "*/", "\\*", "(*)", "[[]*", "[a&&b]*", "[\\]"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_glob_has_the_meaning_of_the_shell(spark, pattern):
    got = values(spark, NAMES, lambda c: P.glob_match(c, [pattern]))
    assert got == [fnmatch.fnmatchcase(n, pattern) for n in NAMES]


@settings(max_examples=300, deadline=None)
@given(st.text("ab-[]!?*/.^", max_size=8), st.text("ab-[]!?*/.^", max_size=8))
def test_glob_regex_property(pattern, name):
    expected = fnmatch.fnmatchcase(name, pattern)
    assert bool(re.match(P.glob_regex(pattern).replace(r"\z", r"\Z"), name)) == expected


def test_names_and_folders_mean_what_lies_below_too(spark):
    given = ["wave7", "wave7/", "wave7/west//", "w*ve", "w?ve/", "[w]ave7"]
    assert values(spark, given, P.meanings) == [
        ["wave7", "wave7/*"], ["wave7", "wave7/*"], ["wave7/west", "wave7/west/*"], ["w*ve"], ["w?ve", "w?ve/*"], ["[w]ave7"]]
    assert expand_patterns(spark, ["b/", "a*"]) == ["a*", "b", "b/*"]


def test_patterns_in_a_column_mean_the_same(spark):
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab-[]!?*/.^\\é") for _ in range(rng.randrange(9))) for _ in range(600)]
    names = ["".join(rng.choice("ab-[]!/.^\\é") for _ in range(rng.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in patterns], "p STRING").withColumn("r", P.glob_regex_of(F.col("p")))
    for row in df.collect():
        regex = re.compile(row.r.replace(r"\z", r"\Z"))
        assert [n for n in names if regex.match(n)] == [n for n in names if fnmatch.fnmatchcase(n, row.p)], row


def test_tables_of_patterns(spark):
    rng = random.Random(9)
    names = sorted({f"{rng.choice(['flu', 'rsv', 'f'])}/{rng.choice(['y2030', 'y2031'])}/{'n' * rng.randrange(40)}{rng.randrange(9)}" for _ in range(200)})
    patterns = ["*", "", "flu/*", "rsv/y203[!1]/*", "f/y2030/nnnn?", "*/n*3", "flu/y2030/" + "n" * 20 + "*", names[0], names[5] + "*", "?su/*", "zzz"]
    df = spark.createDataFrame([(n, 1) for n in names], "name STRING, one INT")
    table = spark.createDataFrame(list(enumerate(patterns)), "number INT, pattern STRING")
    found = match_patterns(df, "name", table)
    assert found.columns == ["name", "one", "number", "pattern"]
    assert sorted((r.name, r.number) for r in found.collect()) == sorted(
        (n, i) for n in names for i, p in enumerate(patterns) if fnmatch.fnmatchcase(n, p))


@settings(max_examples=200, deadline=None)
@given(st.text("ab-[]!?*/.^", max_size=8), st.text("ab-[]!?*/.^", max_size=8))
def test_matches_begin_with_the_literal_part(pattern, name):
    if fnmatch.fnmatchcase(name, pattern):
        assert name.startswith(P.literal_part(pattern))


def test_scan_starts_cover_unrelated_patterns(spark):
    """Two patterns without a common start both keep what stands before their wildcard."""
    got = values(spark, ["p/a/x", "p/bc/x", "p/b/x", "q/a/x"], lambda c: P.glob_starts(c, ["a/*", "bc/*"], "p/"))
    assert got == [True, True, False, False]
    assert values(spark, ["p/year9/x", "p/year8/x"], lambda c: P.glob_starts(c, ["year9*/*"], "p/")) == [True, False]


# --- paths -------------------------------------------------------------------------------------


def test_run_head_takes_the_first_run_after_the_leading_component(spark):
    run, other = "20310704-081530-0f1e2d3c", "20310705-081530-0f1e2d3c"
    texts = [f"e/{run}/f", f"a/b/{run}/{other}/f", f"{run}/f", f"{run}/x/{other}", f"e/{run}x/f", f"e/x{run}/f", f"/{run}/f", "e/f"]
    assert values(spark, texts, lambda c: P.run_head(c)) == [
        f"e/{run}", f"a/b/{run}", "", f"{run}/x/{other}", "", "", f"/{run}", ""]
    assert values(spark, [f"a/b/{run}"], P.head_exp) == ["a/b"]
    assert values(spark, [f"a/b/{run}"], P.head_run) == [run]


def test_run_time_and_rule_on_impossible_dates(spark):
    ids = ["20310704-081530-0f1e2d3c", "20310231-081530-0f1e2d3c", "20310704-081530-0F1E2D3C", "free"]
    assert values(spark, ids, lambda c: P.run_ts(c).cast("string")) == ["2031-07-04 08:15:30", None, None, None]
    assert values(spark, ids, lambda c: Q.check_run_id(c)["valid"]) == [True, True, True, True]


def test_names(spark):
    assert values(spark, [7, 123456], lambda c: P.task_file("result", c), "INT") == ["result_00007.pkl.gz", "result_123456.pkl.gz"]
    paths = ["p/q/e/f.pdf", "other/f.pdf", "f.pdf"]
    assert values(spark, paths, lambda c: P.destination(c, True, "p/q/")) == ["e_f.pdf", "other_f.pdf", "f.pdf"]
    assert values(spark, paths, P.destination) == ["f.pdf"] * 3
    assert values(spark, ["a.csv.gz", "a.csv", "a.yml", "a.bin", "a.parquet"], P.content_type) == [
        "application/gzip", "text/csv", "text/yaml", "application/octet-stream", "application/octet-stream"]
    path = lambda c: P.artifact_path("pre/", F.lit("e"), c, "x", bucket="b")
    assert values(spark, ["r"], path) == ["b/pre/e/r/x"]


# --- times -------------------------------------------------------------------------------------


def test_times_keep_their_wall_clock_and_fall_back(spark):
    texts = ["2031-03-09T16:45:20Z", "2031-03-09T16:45:20.654321+02:00", "2031-03-09", "2031-77-09T16:45:20Z!", "2031", None]
    assert values(spark, texts, S.fmt_full) == ["2031-03-09 16:45:20", "2031-03-09 16:45:20", "2031-03-09 00:00:00",
                                                "2031-77-09T16:45:20", "2031", None]
    assert values(spark, texts[:4], S.fmt_time) == ["16:45:20", "16:45:20", "00:00:00", "16:45:20"]


def test_local_time_follows_summer_time(spark):
    got = values(spark, ["2025-01-07T10:30:00Z", "2025-07-07T10:30:00Z", "bad"], lambda c: S.fmt_local(c, "America/New_York"))
    assert got == ["2025-01-07 05:30:00 EST", "2025-07-07 06:30:00 EDT", "bad"]


# Instants and what clocks showed there.
CLOCKS = [
    ("Europe/Moscow", "2005-07-01T00:00:00Z", "2005-07-01 04:00:00 MSD"), ("Europe/Moscow", "2005-12-01T00:00:00Z", "2005-12-01 03:00:00 MSK"),
    ("Europe/Moscow", "2012-07-01T00:00:00Z", "2012-07-01 04:00:00 MSK"), ("Europe/Moscow", "2020-07-01T00:00:00Z", "2020-07-01 03:00:00 MSK"),
    ("Europe/Istanbul", "2015-07-01T12:00:00Z", "2015-07-01 15:00:00 EEST"), ("Europe/Istanbul", "2020-07-01T12:00:00Z", "2020-07-01 15:00:00 +03"),
    ("Europe/London", "1970-01-01T00:00:00Z", "1970-01-01 01:00:00 BST"), ("Europe/London", "2026-01-01T00:00:00Z", "2026-01-01 00:00:00 GMT"),
    ("America/New_York", "2026-03-08T06:59:59Z", "2026-03-08 01:59:59 EST"), ("America/New_York", "2026-03-08T07:00:00Z", "2026-03-08 03:00:00 EDT"),
    ("America/New_York", "1944-07-01T00:00:00Z", "1944-06-30 20:00:00 EWT"), ("UTC", "2026-03-08T07:00:00Z", "2026-03-08 07:00:00 UTC"),
]


def test_zone_names_are_those_of_the_instant(spark):
    for zone in sorted({c[0] for c in CLOCKS}):
        mine = [c for c in CLOCKS if c[0] == zone]
        assert values(spark, [c[1] for c in mine], lambda c, z=zone: S.fmt_local(c, z)) == [c[2] for c in mine]


def test_duration_text(spark):
    seconds = [0, 17, 120, 134, 7200, 15000, 172800, 190800, -3, None]
    assert values(spark, seconds, S.duration_text, "BIGINT") == [
        "0s", "17s", "2m", "2m 14s", "2h", "4h 10m", "2d", "2d 5h", "0s", "unknown"]


def test_since_argument():
    now = datetime(2025, 11, 7, 12, tzinfo=timezone.utc)
    assert S.since_moment("2d", now) == datetime(2025, 11, 5, 12, tzinfo=timezone.utc)
    assert S.since_moment("2025-11-01T00:00:00Z", now).day == 1
    with pytest.raises(ValueError):
        S.since_moment("soon", now)


def test_image_tags(spark):
    uris = ["host/p/img:v1", "host:5000/p/img", "host/img@sha256:0123456789", "", None]
    assert values(spark, uris, S.image_tag) == ["v1", "latest", "sha256:0123456", "unknown", "unknown"]


def test_classes_and_stages(spark):
    assert values(spark, ["succeeded", "CANCELED", "Queued", "SCHEDULED", "?", None], S.state_class) == [
        "success", "failure", "active", "scheduled", "other", "other"]
    assert values(spark, ["builder", "b", " OUTPUT "], S.stage_letter) == ["A", "B", "C"]
    assert values(spark, ["ALERT", "notice", "x"], S.severity_class) == ["error", "warning", "other"]


# --- rules -------------------------------------------------------------------------------------


def test_rules(spark):
    reason = lambda rule: lambda c: rule(c)["reason"]
    assert values(spark, ["a/b-c_1", " a ", "", "\t", "a/../b", "a\\b", "a b", "x" * 201, None], reason(Q.check_exp_id)) == [
        None, None, "empty", "empty", "path traversal", "path traversal", "invalid characters", "too long", "empty"]
    assert values(spark, ["n2-standard-4", "N2-standard", "n2"], reason(Q.check_machine)) == [None, "format", "format"]


def test_run_id_fields_are_checked_in_turn(spark):
    """Ids made from their fields; the first field outside its range is the reason."""
    ranges = {"year": (2020, 2100), "month": (1, 12), "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59)}
    rng, ids, expected = random.Random(6), [], []
    for _ in range(300):
        fields = [rng.choice([low - (low > 0), low, rng.randint(low, high), high, high + 1]) if rng.random() < 0.4 else rng.randint(low, high)
                  for low, high in ranges.values()]
        ids.append("{:04}{:02}{:02}-{:02}{:02}{:02}-".format(*fields) + f"{rng.randrange(16 ** 8):08x}")
        expected.append(next((n for n, f in zip(ranges, fields) if not ranges[n][0] <= f <= ranges[n][1]), None))
    got = values(spark, [*ids, "2044-05-06", "x.y"], lambda c: Q.check_run_id(c)["reason"])
    assert got == [*expected, None, "format"] and len(set(expected)) == 7


def test_labels_are_cut_before_they_are_stripped(spark):
    texts = ["test/Flu 1", "--a__", "é/x", "x" * 62 + "-y", "a.b"]
    assert values(spark, texts, Q.sanitize_label) == ["test-flu-1", "a", "é-x", "x" * 62, "a-b"]


def test_token_flag_reads_whole_words(spark):
    good = "ghp_" + "a" * 36
    texts = [good, f"x {good}\ny", f"x{good}", "ghp_short", "github_pat_" + "b" * 300, f"a {good}.", None]
    assert values(spark, texts, Q.token_flag) == [True, True, False, False, False, True, None]
    assert values(spark, [good, "x", "ghp_1"], lambda c: Q.check_token(c)["reason"]) == [None, "prefix", "length"]
