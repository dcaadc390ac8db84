"""Screening policies: thresholds, weights and safety switches, with overlays from JSON."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "2026.1"

# Thresholds and weights of the balanced policy.
THRESHOLDS = {"likely_match": 0.7, "possible_match": 0.35, "reference_likely": 0.7, "reference_possible": 0.4, "title_likely": 0.55, "title_possible": 0.3}
WEIGHTS = {
    "doi": 1.0, "pmid": 1.0, "name_exact": 0.48, "name_variant": 0.42, "surname_initials": 0.35, "surname_first_initial": 0.25,
    "institution_high": 0.24, "institution_partial": 0.14, "email_domain": 0.1, "institution_conflict": -0.2,
    "title_high": 0.55, "title_partial": 0.3, "authors": 0.25, "authors_surname": 0.12, "year": 0.1, "year_conflict": -0.15, "journal": 0.08,
}
SAFETY = {"auxiliary_for_likely": True, "hard_identifiers_only": False}


@dataclass(frozen=True)
class Policy:
    version: str = VERSION
    mode: str = "balanced"
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    safety: dict[str, bool] = field(default_factory=lambda: dict(SAFETY))


BALANCED = Policy()
STRICT = replace(
    BALANCED,
    version=f"{VERSION}-strict",
    mode="strict",
    thresholds=THRESHOLDS | dict.fromkeys(("likely_match", "possible_match", "reference_likely", "reference_possible"), 1.01),
    safety=SAFETY | {"hard_identifiers_only": True},
)


def load(name: str | None = None, strict: bool = False, text: str | None = None) -> Policy:
    """balanced, strict, or a JSON overlay on the balanced policy; unknown or unsound values are refused."""
    if strict or name == "strict":
        return STRICT
    if name in (None, "balanced") and text is None:
        return BALANCED
    if text is None:
        with open(name, encoding="utf-8") as file:
            text = file.read()
    raw = json.loads(text)
    parts = {}
    for part, base, sound in (("thresholds", THRESHOLDS, _number), ("weights", WEIGHTS, _number), ("safety", SAFETY, lambda v: isinstance(v, bool))):
        given = raw.get(part, {})
        for key, value in given.items():
            if key not in base or not sound(value):
                raise ValueError(f"policy: {part}.{key} = {value!r}")
        parts[part] = base | given
    return Policy(version=str(raw.get("version", f"{VERSION}-custom")), mode="custom", **parts)


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


# --- policies as data: many overlays, one pass -----------------------------------------------------------

#: What an overlay may set: path, kind and the balanced policy's value (a flag as 1 or 0).
RULES = (
    *((f"thresholds.{k}", "number", v) for k, v in THRESHOLDS.items()),
    *((f"weights.{k}", "number", v) for k, v in WEIGHTS.items()),
    *((f"safety.{k}", "boolean", float(v)) for k, v in SAFETY.items()),
)
PARTS = ("thresholds", "weights", "safety")


@dataclass(frozen=True)
class Overlaid:
    """settings: (policy_id, path, value, changed) of every setting of every sound policy; versions: (policy_id,
    version, mode, n_changed) of those; problems: (policy_id, path, reason) of the others."""

    settings: DataFrame
    versions: DataFrame
    problems: DataFrame


def overlay(policies: DataFrame) -> Overlaid:
    """Overlays (policy_id, body: JSON text) on the balanced policy, path by path.

    Bodies are read as variants, so a setting keeps the type that it was given with, and their paths are joined to
    RULES. A policy is refused whole if its body is no JSON object, if it sets a path that no rule
    names, or a value that is not of the rule's kind or not finite. A null or empty body changes nothing. Of equal
    ids only the sound ones' first rows (by body) count. Parts that are null are taken as absent.
    """
    spark = policies.sparkSession
    read = policies.groupBy("policy_id").agg(F.min("body").alias("body")).withColumn("v", F.try_parse_json(F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.col("body")).otherwise("{}")))
    shaped = read.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    part = "SELECT policy_id, '{0}.' || e.key AS path, e.value AS value FROM {{shaped}}, LATERAL variant_explode(CASE WHEN object THEN try_variant_get(v, '$.{0}', 'variant') END) AS e"
    given = spark.sql(" UNION ALL ".join(part.format(p) for p in PARTS), shaped=shaped)
    kinds = F.schema_of_variant("value")
    number, flag = F.expr("try_variant_get(value, '$', 'double')"), F.expr("try_variant_get(value, '$', 'boolean')")
    told = given.select("policy_id", "path", kinds.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$").alias("is_number"), (kinds == "BOOLEAN").alias("is_flag"), number.alias("number"), flag.cast("double").alias("flag"))
    rules = spark.createDataFrame([*RULES], "path string, kind string, base double")
    met = told.join(rules, "path", "left")
    sound = F.when(F.col("kind") == "number", F.col("is_number") & ~F.isnan("number") & (F.abs("number") != float("inf"))).when(F.col("kind") == "boolean", F.col("is_flag"))
    wrong = F.when(F.col("kind").isNull(), "no such setting").when(~F.coalesce(sound, F.lit(False)), F.concat(F.lit("no "), F.col("kind")))
    problems = met.select("policy_id", "path", wrong.alias("reason")).where("reason IS NOT NULL").unionByName(shaped.where("NOT object").select("policy_id", F.lit("$").alias("path"), F.lit("no object").alias("reason")))
    kept = shaped.join(problems.select("policy_id").distinct(), "policy_id", "left_anti")
    every = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(b).cast("double").alias("base")) for p, _, b in RULES)))
    values = met.select(F.col("policy_id").alias("_id"), F.col("path").alias("_path"), F.when(F.col("kind") == "boolean", F.col("flag")).otherwise(F.col("number")).alias("given"))
    full = kept.select("policy_id", every.alias("r")).select("policy_id", "r.*")
    settings = full.join(values, (F.col("policy_id") == F.col("_id")) & (F.col("path") == F.col("_path")), "left").select("policy_id", "path", F.coalesce("given", "base").alias("value"), F.coalesce(F.col("given") != F.col("base"), F.lit(False)).alias("changed"))
    named = kept.select("policy_id", F.coalesce(F.expr("try_variant_get(v, '$.version', 'string')"), F.lit(f"{VERSION}-custom")).alias("version"))
    changes = settings.groupBy(F.col("policy_id").alias("_id")).agg(F.sum(F.col("changed").cast("int")).alias("n_changed"))
    versions = named.join(changes, F.col("policy_id") == F.col("_id")).select("policy_id", "version", F.lit("custom").alias("mode"), "n_changed")
    return Overlaid(settings, versions, problems)


def score_all(evidence: DataFrame, settings: DataFrame, id_column: str, likely: str = "reference_likely", possible: str = "reference_possible") -> DataFrame:
    """(id, policy_id, score, verdict) of evidence rows (id, weight: a key of `weights`) under every policy at once.

    Each row of evidence meets its weight in each policy by an equi-join on the path; sums are combined before they are
    shuffled, and thresholds are settings of the same table.
    """
    weights = settings.select("policy_id", "path", "value")
    met = evidence.select(F.col(id_column), F.concat(F.lit("weights."), "weight").alias("path")).join(weights, "path")
    scored = met.groupBy(id_column, "policy_id").agg(F.round(F.sum("value"), 6).alias("score"))
    bars = settings.groupBy("policy_id").agg(*(F.max(F.when(F.col("path") == f"thresholds.{k}", F.col("value"))).alias(k) for k in (likely, possible)))
    verdict = F.when(F.col("score") >= F.col(likely), "likely").when(F.col("score") >= F.col(possible), "possible").otherwise("no_match")
    return scored.join(bars, "policy_id").select(id_column, "policy_id", "score", verdict.alias("verdict"))
