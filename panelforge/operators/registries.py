"""Registries kept as JSON: contributor cards, literature, agreement of sources.

Documents come as rows of text. Each is parsed once as a variant, so that a number where a text belongs is seen as one, and
every rule that it breaks is named: rows without reasons are valid, the others are the quarantine. What cards and
entries point to (callables, files, tests) is looked up in a table of known surfaces, by a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelforge.plans import dsl
from panelforge.sources.shared import fresh_folder

# Fields, kinds and roles of a card, points for its parts, statuses of literature in their order.
CARD_FIELDS = (
    "schemaVersion", "submissionId", "title", "contributor", "kind", "paper", "hypothesis", "causalBoundary", "counterfactual", "testSelector", "prefixCausalityTested", "adversarialTested",
)
CARD_OPTIONS = ("implementation", "expression", "counterExpression", "allowedFields", "allowedWindows", "reproductionExample", "futureDataRole")
CARD_TEXTS = {"title": 4, "contributor": 1, "hypothesis": 20, "causalBoundary": 20, "counterfactual": 10}
KINDS, ROLES = ("mechanism", "factor"), ("none", "offline_label_only")
PAPER_AND_TEXTS, PREFIX_POINTS, ADVERSARIAL_POINTS, EXAMPLE_POINTS = 20 + 15 + 20 + 15, 15, 10, 5
ENTRY_FIELDS = ("paperId", "title", "year", "url", "domain", "status", "systemMapping", "implementationBoundary", "requiredData", "nextFalsifiableStep", "repositorySurfaces")
ENTRY_TEXTS = {"title": 8, "domain": 3, "systemMapping": 10, "implementationBoundary": 10, "requiredData": 10, "nextFalsifiableStep": 10}
STATUSES = ("implemented", "partially_mapped", "extension_candidate", "data_gated", "deferred", "reference_only", "out_of_scope")
MAPPED = ("implemented", "partially_mapped")


def _at(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "variant")


def _type(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(name)), F.lit("VOID"))


def _text(name: str) -> Column:
    """A text without the white space around it; null for anything else."""
    return F.when(_type(name) == "STRING", F.regexp_replace(F.try_variant_get("_v", f"$.{name}", "string"), r"(?U)^\s+|\s+$", ""))


def _is_null(name: str) -> Column:
    return _type(name) == "VOID"


def _short(name: str, least: int) -> Column:
    return F.when(F.coalesce(F.length(_text(name)), F.lit(0)) < least, F.lit(f"{name} needs {least} characters"))


def _wrong(unless: Column, reason: str) -> Column:
    """The reason where a condition does not hold; null counts as not holding."""
    return F.when(~F.coalesce(unless, F.lit(False)), F.lit(reason))


def _fields(needed: Iterable[str], allowed: Iterable[str]) -> list[Column]:
    keys = F.json_object_keys("document")
    lacking, odd = (F.array_sort(x) for x in (F.array_except(F.array(*map(F.lit, needed)), keys), F.array_except(keys, F.array(*map(F.lit, allowed)))))
    return [F.when(F.size(x) > 0, F.concat(F.lit(f"{what} fields: "), F.array_join(x, ", "))) for what, x in (("missing", lacking), ("unknown", odd))]


def _with_reasons(rows: DataFrame, rules: list[Column], key: Column) -> DataFrame:
    """``reasons``, one only for what is no JSON object; ids that repeat are valid nowhere."""
    object_ = F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT")
    rows = rows.withColumn("_id", F.when(object_, key))
    twice = rows.where("_id is not null").groupBy(F.col("_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(twice, F.col("_id") == F.col("_twice"), "left")
    repeats = F.when(F.col("_twice").isNotNull(), F.lit("id repeats"))
    found = F.array_compact(F.array(*rules, repeats))
    return rows.withColumn("reasons", F.when(object_, found).otherwise(F.array(F.lit("no JSON object"))))


def expression_fault(expression: str | None, fields: list[str] | None, windows: list[int] | None) -> str | None:
    """Why an expression in JSON is refused, or null."""
    try:
        dsl.validate(json.loads(expression or "null"), fields, windows)
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as e:
        return str(e) or type(e).__name__
    return None


@F.pandas_udf(StringType())
def _expression_fault(expression: pd.Series, fields: pd.Series, windows: pd.Series) -> pd.Series:
    return pd.Series([expression_fault(e, None if f is None else list(f), None if w is None else [int(x) for x in w]) for e, f, w in zip(expression, fields, windows)], dtype=object)


def _known(rows: DataFrame, surfaces: DataFrame, **asked: Column) -> DataFrame:
    """A boolean for each column asked: whether the table of surfaces has it."""
    known = surfaces.select(F.col(surfaces.columns[0]).cast("string").alias("_s")).where("_s is not null").distinct()
    for name, c in asked.items():
        side = known.select(F.col("_s").alias(f"_of_{name}"))
        rows = rows.withColumn(f"_asked_{name}", c).join(side, F.col(f"_asked_{name}") == F.col(f"_of_{name}"), "left")
        rows = rows.withColumn(name, F.col(f"_of_{name}").isNotNull()).drop(f"_of_{name}", f"_asked_{name}")
    return rows


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """name (of the file, without its ending) and document, one row a JSON file; a source skips empty files, whose names come from
    the source's listing, which the driver holds anyway."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    names = [(unquote(path.rsplit("/", 1)[-1]).removesuffix(".json"),) for path in rows.inputFiles()]
    read = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), F.col("value").alias("document"))
    return spark.createDataFrame(names, "name string").distinct().join(read, "name", "left")


def cards(documents: DataFrame, surfaces: DataFrame, version: str) -> DataFrame:
    """Of card documents (name, document): submission_id, title, contributor, kind, score, tier and reasons.

    Every card has a row; one that breaks a rule has reasons and neither score nor tier. A null or malformed document is a
    row with the reason "no JSON object"; other columns are ignored; no documents give no rows."""
    rows = documents.select(F.col("name").cast("string").alias("name"), F.col("document").cast("string").alias("document")).withColumn("_v", F.try_parse_json("document"))
    rows = _known(rows, surfaces, _callable=_text("implementation"), _test=_text("testSelector"), _example=_text("reproductionExample"))
    fields, windows = F.try_variant_get("_v", "$.allowedFields", "array<string>"), F.try_variant_get("_v", "$.allowedWindows", "array<int>")
    for name in ("expression", "counterExpression"):
        text = F.when(F.coalesce(_text("kind"), F.lit("")) == "factor", F.to_json(_at(name)))
        rows = rows.withColumn(f"_{name}", _expression_fault(text, F.when(text.isNotNull(), fields), F.when(text.isNotNull(), windows)))
    mechanism, factor = (F.coalesce(_text("kind") == k, F.lit(False)) for k in KINDS)
    selector, no_test = F.split_part(_text("testSelector"), F.lit("::"), F.lit(2)), _is_null("testSelector")
    year = F.try_variant_get("_v", "$.paper.year", "long")
    rules = [
        *_fields(CARD_FIELDS, CARD_FIELDS + CARD_OPTIONS),
        _wrong(_text("schemaVersion") == version, "unsupported schemaVersion"),
        _wrong(_text("submissionId").rlike(r"^[a-z0-9][a-z0-9_-]+\z") & (_text("submissionId") == F.col("name")), "name and submissionId must match"),
        *[_short(name, least) for name, least in CARD_TEXTS.items()],
        _wrong(_text("kind").isin(*KINDS), "kind must be mechanism or factor"),
        _wrong(_type("paper").startswith("OBJECT"), "paper must be an object"),
        _short("paper.title", 1),
        _wrong(_text("paper.url").startswith("https://"), "paper.url must use https"),
        _wrong((_type("paper.year") == "BIGINT") & (year >= 1900), "paper.year is invalid"),
        F.when(mechanism & ~F.col("_callable"), F.lit("implementation is not callable")),
        F.when(mechanism & ~(_is_null("expression") & _is_null("counterExpression")), F.lit("mechanism cards have no expressions")),
        F.when(factor & ~F.coalesce((F.size(fields) > 0) & (F.size(windows) > 0), F.lit(False)), F.lit("factor cards need allowedFields and allowedWindows")),
        *[F.when(factor, F.concat(F.lit(f"{name}: "), F.col(f"_{name}"))) for name in ("expression", "counterExpression")],
        F.when(factor & ~_is_null("implementation"), F.lit("factor cards have no implementation")),
        F.when(~no_test & ~F.coalesce(selector.startswith("test_"), F.lit(False)), F.lit("testSelector must be path::test_name")).when(~no_test & ~F.col("_test"), F.lit("test does not exist")),
        F.when(~_is_null("reproductionExample") & ~F.col("_example"), F.lit("reproductionExample does not exist")),
        F.when(F.array_contains(F.json_object_keys("document"), "futureDataRole"), _wrong(_text("futureDataRole").isin(*ROLES), "invalid futureDataRole")),
        *[_wrong(_type(name) == "BOOLEAN", f"{name} must be boolean") for name in ("prefixCausalityTested", "adversarialTested")],
    ]
    rows = _with_reasons(rows, rules, _text("submissionId"))
    prefix, adversarial = (F.coalesce(F.try_variant_get("_v", f"$.{name}", "boolean"), F.lit(False)) for name in ("prefixCausalityTested", "adversarialTested"))
    tested = F.col("_test")
    points = [(prefix & tested, PREFIX_POINTS), (adversarial & tested, ADVERSARIAL_POINTS), (F.col("_example"), EXAMPLE_POINTS)]
    score = sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(PAPER_AND_TEXTS))
    tier = F.when((score >= 90) & prefix & adversarial, "research-grade").when(prefix & tested, "causal-tested").when(score >= 60, "reproducible-implementation").otherwise("documented")
    valid = F.size("reasons") == 0
    return rows.select("name", F.col("_id").alias("submission_id"), _text("title").alias("title"), _text("contributor").alias("contributor"), _text("kind").alias("kind"), F.when(valid, score).alias("score"), F.when(valid, tier).alias("tier"), "reasons")


def read_literature(spark: SparkSession, path: str, version: str) -> DataFrame:
    """document, one row an entry of a registry file; raises if it is of another version, without a purpose or empty."""
    rows = spark.read.option("wholetext", True).text(path)
    held = rows.select(F.from_json("value", "schemaVersion string, purpose string, entries array<variant>").alias("r")).select("r.*")
    for r in held.select("schemaVersion", F.length(F.trim("purpose")).alias("purpose"), F.size("entries").alias("entries")).collect():  # one row a registry file
        if r["schemaVersion"] != version or (r["purpose"] or 0) < 20 or (r["entries"] or 0) < 1:
            raise ValueError("a registry has its version, a purpose of 20 characters and entries")
    return held.select(F.explode("entries").alias("entry")).select(F.to_json("entry").alias("document"))


def literature(documents: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Of entries (document): paper_id, title, year, status, place (of its status in the order of statuses) and reasons.

    Every entry has a row. A null or malformed document has the reason "no JSON object"; an entry that claims a mapping must
    name a surface, and every surface named must be known."""
    rows = documents.select(F.col("document").cast("string").alias("document")).withColumn("_row", F.monotonically_increasing_id()).withColumn("_v", F.try_parse_json("document"))
    named = F.when(_type("repositorySurfaces").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get("_v", "$.repositorySurfaces", "array<string>"))
    rows = rows.withColumn("_named", named).withColumn("_named", F.when(~F.exists("_named", lambda x: x.isNull()), F.col("_named")))
    year = F.try_variant_get("_v", "$.year", "long")
    rules = [
        *_fields(ENTRY_FIELDS, ENTRY_FIELDS),
        _wrong(_text("paperId").rlike(r"^[a-z0-9][a-z0-9-]+\z"), "invalid paperId"),
        *[_short(name, least) for name, least in ENTRY_TEXTS.items()],
        _wrong((_type("year") == "BIGINT") & year.between(1900, 2100), "year is invalid"),
        _wrong(_text("url").startswith("https://"), "url must use https"),
        _wrong(_text("status").isin(*STATUSES), "status is invalid"),
        _wrong(F.col("_named").isNotNull(), "repositorySurfaces must be texts"),
    ]
    place = F.array_position(F.array(*map(F.lit, STATUSES)), _text("status"))
    object_ = F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT")
    read = rows.select(
        "_row", F.when(object_, _text("paperId")).alias("_id"), _text("title").alias("title"), year.alias("year"), _text("status").alias("status"), place.alias("place"), "_named", object_.alias("_object"), F.array_compact(F.array(*rules)).alias("_reasons")
    )
    # documents are parsed once; only what was read of them goes on to the joins
    folder = fresh_folder(documents.sparkSession, "entries")
    read.write.parquet(folder)
    read = documents.sparkSession.read.schema(read.schema).parquet(folder)

    known = surfaces.select(F.col(surfaces.columns[0]).cast("string").alias("_s")).where("_s is not null").distinct()
    asked = read.select("_row", F.explode("_named").alias("_a")).join(known, F.col("_a") == F.col("_s"), "left").where("_s is null").groupBy("_row").agg(F.array_sort(F.collect_set("_a")).alias("_unknown"))
    twice = read.where("_id is not null").groupBy(F.col("_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1")
    read = read.join(asked, "_row", "left").join(twice, F.col("_id") == F.col("_twice"), "left")
    more = F.array(
        F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown surfaces: "), F.array_join("_unknown", ", "))),
        F.when(F.col("status").isin(*MAPPED) & (F.size("_named") == 0), F.lit("a mapping needs a surface")),
        F.when(F.col("_twice").isNotNull(), F.lit("id repeats")),
    )
    reasons = F.when(F.col("_object"), F.concat("_reasons", F.array_compact(more))).otherwise(F.array(F.lit("no JSON object")))
    return read.select(F.col("_id").alias("paper_id"), "title", "year", "status", "place", reasons.alias("reasons"))


def literature_counts(entries: DataFrame) -> DataFrame:
    """Valid entries of each status, those without one included, and last the number refused."""
    spark = entries.sparkSession
    state = F.when(F.size("reasons") == 0, F.col("status")).otherwise("refused")
    found = entries.groupBy(state.alias("status")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s, k) for k, s in enumerate((*STATUSES, "refused"), 1)], "status string, place int")
    return every.join(found, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("entries"))


def agreement(sessions: DataFrame) -> DataFrame:
    """Share of sessions in which two sources put the same name first, and the median rank of one's first in the other."""
    return sessions.agg(F.count("*").alias("sessions"), F.avg(F.col("same").cast("double")).alias("agreement"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
