"""Layered settings and configuration documents of many experiments at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.functions import paths as P
from fanfold.operators.ordering import prefix_sum
from fanfold.session import materialize

# Document types by the JSON path that marks them, and preferred output files.
DOC_MARKS = {"basemodel": "$.model", "sampling": "$.modelset.sampling",
             "calibration": "$.modelset.calibration", "output": "$.output"}
OUTPUT_FILES = ["output.yaml", "output.yml"]
PLACEHOLDER = "your-"
CHILDREN_PER_SALT = 100_000
ROLES = {"basemodel": "basemodel", "sampling": "modelset", "calibration": "modelset", "output": "output"}


# --- settings ----------------------------------------------------------------------------------


def merge_layers(df: DataFrame, children_per_salt: int = CHILDREN_PER_SALT) -> DataFrame:
    """``(scope, key_path, value, layer)`` rows to the value that holds per scope and key.

    A later layer wins. A key also goes when a later layer set something above it (a value in
    place of the subtree) or below it (a subtree in place of the value). Both tests compare with
    one greatest layer per path, so no join multiplies rows.
    """
    held = materialize(df.groupBy("scope", "key_path").agg(
        F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer")))
    parts = F.split("key_path", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                          lambda i: F.array_join(F.slice(parts, 1, i), "."))
    links = (held.where(F.size(parts) > 1)
             .select("scope", "key_path", "layer", F.explode(parents).alias("parent")))
    # One small row per parent, used for both tests and for the salts.
    below = materialize(links.groupBy("scope", F.col("parent").alias("key_path")).agg(
        F.max("layer").alias("__below"), F.ceil(F.count(F.lit(1)) / children_per_salt).alias("__salts")))
    # Only paths that are both a key and a parent can replace a subtree. A parent's row is repeated once per
    # ``children_per_salt`` keys below it, so however many there are, no task meets more. Parents of so many keys are few.
    many = below.where("__salts > 1").select("scope", F.col("key_path").alias("parent"), "__salts")
    owners = held.join(below.select("scope", "key_path", "__salts"), ["scope", "key_path"]).select(
        "scope", F.col("key_path").alias("parent"), F.col("layer").alias("__layer"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1)).alias("__salt"))
    salt = F.pmod(F.xxhash64("key_path"), F.coalesce("__salts", F.lit(1).cast("bigint"))).alias("__salt")
    salted = links.join(many, ["scope", "parent"], "left").select("scope", "key_path", "parent", salt)
    above = (salted.join(owners, ["scope", "parent", "__salt"])
             .groupBy("scope", "key_path").agg(F.max("__layer").alias("__above")))
    kept = held.join(below.drop("__salts"), ["scope", "key_path"], "left").join(above, ["scope", "key_path"], "left")
    later = F.greatest(F.coalesce("__below", "layer"), F.coalesce("__above", "layer"))
    return kept.where(later <= F.col("layer")).select("scope", "key_path", "value", "layer")


def interpolate(text: Column, values: Mapping[str, Column | str]) -> Column:
    """Replaces ``{name}`` for each given name."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.lit(value) if isinstance(value, str) else value)
    return text


def lookup(df: DataFrame, scopes: DataFrame, path: str, default: str | None = None) -> DataFrame:
    """The value of one dotted path in every scope, or the default."""
    found = df.where(F.col("key_path") == path).select("scope", "value")
    return scopes.select("scope").join(found, "scope", "left").select(
        "scope", F.coalesce("value", F.lit(default)).alias("value"))


def required_fields(df: DataFrame, scopes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every required field of every scope with ``ok``: present, not empty, not a placeholder."""
    wanted = scopes.select("scope", F.explode(F.array(*map(F.lit, fields))).alias("key_path"))
    value = F.coalesce("value", F.lit(""))
    return (wanted.join(df.where(F.col("key_path").isin(list(fields))), ["scope", "key_path"], "left")
            .select("scope", "key_path", ((value != "") & ~value.startswith(PLACEHOLDER)).alias("ok")))


# --- documents ---------------------------------------------------------------------------------


def doc_type(doc: Column) -> Column:
    """Type of a JSON document by the first mark it holds; NULL for none or broken JSON."""
    parsed = F.try_parse_json(doc)
    chain = F
    for name, path in DOC_MARKS.items():
        chain = chain.when(F.try_variant_get(parsed, path, "variant").isNotNull(), name)
    return chain.otherwise(F.lit(None).cast("string"))


def with_type(docs: DataFrame) -> DataFrame:
    return docs.withColumn("type", doc_type(F.col("doc")))


def _preference(file: Column) -> Column:
    return F.when(file == OUTPUT_FILES[0], 2).when(file == OUTPUT_FILES[1], 1).otherwise(0)


def resolve_docs(typed: DataFrame) -> DataFrame:
    """The one document of each type per experiment, or the error ``multiple``."""
    rank = F.struct(_preference(F.col("file")), "file")
    best = typed.where("type is not null").groupBy("exp_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("file", rank).alias("file"))
    sure = (F.col("n") == 1) | ((F.col("type") == "output") & F.col("file").isin(OUTPUT_FILES))
    return best.select("exp_id", "type", "n", F.when(sure, F.col("file")).alias("file"),
                       F.when(~sure, "multiple").alias("error"))


def resolve_output(typed: DataFrame, name: str | None = None) -> DataFrame:
    """The output document per experiment: the named file, else a preferred one, else the only one."""
    is_output = F.coalesce(F.col("type") == "output", F.lit(False))
    if name:
        named = F.col("file") == name
        hits = typed.groupBy("exp_id").agg(F.bool_or(named).alias("there"),
                                           F.bool_or(named & is_output).alias("fits"))
        error = F.when(~F.col("there"), "not found").when(~F.col("fits"), "not an output document")
        return hits.select("exp_id", F.when(F.col("fits"), name).alias("file"), error.alias("error"))
    rank = F.struct(_preference(F.col("file")), "file")
    hits = typed.groupBy("exp_id").agg(
        F.count_if(is_output).alias("n"),
        F.max_by(F.when(is_output, F.col("file")), F.when(is_output, rank)).alias("file"))
    sure = (F.col("n") == 1) | F.col("file").isin(OUTPUT_FILES)
    error = F.when(F.col("n") == 0, "not found").when(~sure, "multiple")
    return hits.select("exp_id", F.when(sure, F.col("file")).alias("file"), error.alias("error"))


def locate(wanted: DataFrame, dirs: DataFrame) -> DataFrame:
    """Directory of each asked experiment: its own path, else its last name at the top or one level
    down; two hits are the error ``ambiguous``.

    Directories are counted per last name before the join, so a common name gives one row.
    """
    depth = F.size(F.split("dir", "/"))
    by_name = (dirs.where(depth <= 2).groupBy(P.basename(F.col("dir")).alias("name"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("dir").alias("found")))
    direct = dirs.select(F.col("dir").alias("exp_id"), F.lit(True).alias("direct"))
    asked = wanted.select("exp_id", P.basename(F.col("exp_id")).alias("name")).join(direct, "exp_id", "left")
    hits = asked.join(by_name, "name", "left")
    place = (F.when(F.col("direct"), F.col("exp_id")).when(F.col("n") == 1, F.col("found")))
    error = (F.when(F.col("direct"), None).when(F.col("n").isNull(), "not found")
             .when(F.col("n") > 1, "ambiguous"))
    return hits.select("exp_id", place.alias("dir"), error.alias("error"))


# --- configuration sets ------------------------------------------------------------------------


def with_role(typed: DataFrame) -> DataFrame:
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return typed.where("type is not null").withColumn("role", roles[F.col("type")])


def set_counts(typed: DataFrame) -> DataFrame:
    """Size of base model × model set × (output or none) per experiment, by multiplication.

    With a boolean column ``ok`` also the number of sets all of whose members are ok.
    """
    roles = ("basemodel", "modelset", "output")
    ok = F.coalesce("ok", F.lit(False)) if "ok" in typed.columns else F.lit(True)
    is_role = lambda r: F.col("role") == r
    counts = with_role(typed.withColumn("__ok", ok)).groupBy("exp_id").agg(
        *[F.count_if(is_role(r)).alias(f"n_{r}") for r in roles],
        *[F.count_if(is_role(r) & F.col("__ok")).alias(f"__ok_{r}") for r in roles])
    product = lambda a, b, c: F.col(a) * F.col(b) * c
    sets = product("n_basemodel", "n_modelset", F.greatest("n_output", F.lit(1)))
    passed = product("__ok_basemodel", "__ok_modelset",
                     F.when(F.col("n_output") == 0, 1).otherwise(F.col("__ok_output")))
    return counts.select("exp_id", *[f"n_{r}" for r in roles], sets.alias("n_sets"), passed.alias("n_passed"))


def set_members(typed: DataFrame) -> DataFrame:
    """The sets in factored form: each document once, with its place in its role.

    Set ``k`` of an experiment holds the member of a role whose ``ordinal`` is
    ``(k div stride) mod n_role``; the table grows with the documents, not with their product.
    """
    members = prefix_sum(with_role(typed).select("exp_id", "role", "file"), ["exp_id", "role"], ["file"],
                         name="ordinal")
    counts = set_counts(typed)
    size = (F.when(F.col("role") == "basemodel", F.col("n_basemodel"))
            .when(F.col("role") == "modelset", F.col("n_modelset")).otherwise(F.col("n_output")))
    outputs = F.greatest("n_output", F.lit(1))
    stride = (F.when(F.col("role") == "basemodel", F.greatest("n_modelset", F.lit(1)) * outputs)
              .when(F.col("role") == "modelset", outputs).otherwise(F.lit(1)))
    return members.join(counts, "exp_id").select(
        "exp_id", "role", "file", "ordinal", size.alias("n_role"), stride.alias("stride"), "n_sets")


def pick_sets(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files of the asked sets ``(exp_id, set_no)``, one row per member, by equi-join.

    Each asked set reads one document per role; the full product is never formed.
    """
    shape = members.groupBy("exp_id", "role").agg(
        F.first("n_role").alias("n_role"), F.first("stride").alias("stride"), F.first("n_sets").alias("n_sets"))
    places = wanted.join(shape, "exp_id").where("set_no >= 0 and set_no < n_sets").select(
        "exp_id", "set_no", "role", F.expr("(set_no div stride) % n_role").alias("ordinal"))
    return places.join(members.select("exp_id", "role", "ordinal", "file"), ["exp_id", "role", "ordinal"]).select(
        "exp_id", "set_no", "role", "file")


def validation_summary(typed: DataFrame, mode: str = "by_directory") -> DataFrame:
    """Passed, failed and errored directories, or passed and failed sets.

    A directory without base model or without model set is an error. Needs the column ``ok``.
    """
    missing = (F.col("n_basemodel") == 0) | (F.col("n_modelset") == 0)
    dirs = typed.select("exp_id").distinct().join(set_counts(typed), "exp_id", "left").na.fill(0)
    errored = F.count_if(missing).alias("errored")
    if mode == "by_directory":
        clean = F.col("n_passed") == F.col("n_sets")
        return dirs.agg(F.count(F.lit(1)).alias("total"), F.count_if(~missing & clean).alias("passed"),
                        F.count_if(~missing & ~clean).alias("failed"), errored)
    if mode == "by_set":
        return dirs.agg(F.sum("n_sets").alias("total"), F.sum("n_passed").alias("passed"),
                        F.sum(F.col("n_sets") - F.col("n_passed")).alias("failed"), errored)
    raise ValueError(f"unknown mode: {mode!r}")


def expand_ids(exps: DataFrame, pattern: str) -> DataFrame:
    return exps.where(P.glob_match(F.col("exp_id"), [pattern])).select("exp_id").distinct()
