"""Queries of policies as data (C15, K11): overlays in JSON, validated by rules, all of them scored in one pass."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import policy as P
from .bridge import records, references, sql
from .registry import query

#: Sound overlays by id, and some that are to be refused.
OVERLAYS = {
    "balanced": {},
    "loose": {"version": "loose-1", "thresholds": {"reference_possible": 0.1, "reference_likely": 0.2}},
    "dated": {"version": "dated-2", "weights": {"year": 0.3, "year_conflict": -0.4}},
    "venues": {"weights": {"journal": 0.5}, "safety": {"auxiliary_for_likely": False}},
    "hard": {"version": "hard-1", "thresholds": {"reference_likely": 1, "reference_possible": 0.9}, "safety": {"hard_identifiers_only": True}},
}
REFUSED = {"unknown": '{"weights": {"colour": 1}}', "typed": '{"weights": {"year": "0.1"}}', "flagged": '{"safety": {"auxiliary_for_likely": 1}}', "list": "[1]", "broken": "{"}


def _merged() -> list[tuple[str, str, float, bool]]:
    out = []
    for name, body in OVERLAYS.items():
        for path, _, base in P.RULES:
            part, key = path.split(".")
            value = float(body.get(part, {}).get(key, base))
            out.append((name, path, value, value != base))
    return out


_EVIDENCE_SQL = """settings(policy_id, path, value, changed) AS (VALUES """ + ", ".join(f"('{n}', '{p}', {v}::DOUBLE, {str(c).upper()})" for n, p, v, c in _merged()) + """),
versions(policy_id, version) AS (VALUES """ + ", ".join(f"('{n}', '{b.get('version', P.VERSION + '-custom')}')" for n, b in OVERLAYS.items()) + """),
pairs AS (SELECT ref_id, a.doi, b.original_doi, a.year AS ya, b.year AS yb, a.journal AS ja, b.journal AS jb FROM refs a JOIN records b ON b.record_id = 'D' || lpad((ref_id - 1)::VARCHAR, 8, '0')),
evidence AS (
    SELECT ref_id, 'doi' AS weight FROM pairs WHERE doi = original_doi UNION ALL SELECT ref_id, CASE WHEN abs(ya - yb) <= 1 THEN 'year' ELSE 'year_conflict' END FROM pairs
    UNION ALL SELECT ref_id, 'journal' FROM pairs WHERE ja = jb UNION ALL SELECT ref_id, 'title_partial' FROM pairs WHERE ref_id % 4 = 1
),
scored AS (SELECT ref_id, policy_id, round(sum(value), 6) AS score FROM evidence JOIN settings ON path = 'weights.' || weight GROUP BY ref_id, policy_id),
bars AS (SELECT policy_id, max(value) FILTER (path = 'thresholds.reference_likely') AS likely, max(value) FILTER (path = 'thresholds.reference_possible') AS possible FROM settings GROUP BY policy_id),
told AS (SELECT ref_id, policy_id, score, CASE WHEN score >= likely THEN 'likely' WHEN score >= possible THEN 'possible' ELSE 'no_match' END AS verdict FROM scored JOIN bars USING (policy_id))"""


def _overlaid(spark) -> P.Overlaid:
    rows = [(k, json.dumps(v)) for k, v in OVERLAYS.items()] + list(REFUSED.items())
    return P.overlay(spark.createDataFrame(rows, "policy_id string, body string"))


def _told(spark, d, overlaid):
    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    notices = records(spark, d).select("record_id", "original_doi", F.col("year").alias("_year"), F.col("journal").alias("_journal"))
    pairs = references(spark, d).withColumn("record_id", key).join(notices, "record_id")
    found = F.array(
        F.when(F.col("doi") == F.col("original_doi"), "doi"), F.when(F.abs(F.col("year") - F.col("_year")) <= 1, "year").otherwise("year_conflict"),
        F.when(F.col("journal") == F.col("_journal"), "journal"), F.when(F.col("ref_id") % 4 == 1, "title_partial"),
    )
    return P.score_all(pairs.select("ref_id", F.explode(F.array_compact(found)).alias("weight")), overlaid.settings, "ref_id")


@query("c15_policy_overlays", sql(_EVIDENCE_SQL + "\nSELECT * FROM told", "records", "refs"))
def c15(spark, d):
    """Every pair under every sound overlay."""
    return _told(spark, d, _overlaid(spark))


@query("k11_policy_metadata", sql(_EVIDENCE_SQL + """
SELECT policy_id, version, 'custom' AS mode, n_changed, count(*) FILTER (verdict = 'likely') AS n_likely, count(*) FILTER (verdict = 'possible') AS n_possible, count(*) AS n_pairs
FROM told JOIN versions USING (policy_id) JOIN (SELECT policy_id, sum(changed::INT)::BIGINT AS n_changed FROM settings GROUP BY policy_id) USING (policy_id) GROUP BY policy_id, version, n_changed""", "records", "refs"))
def k11(spark, d):
    """What each policy is, and what it says of the pairs."""
    overlaid = _overlaid(spark)
    is_ = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    counts = _told(spark, d, overlaid).groupBy("policy_id").agg(is_("likely").alias("n_likely"), is_("possible").alias("n_possible"), F.count("*").alias("n_pairs"))
    return overlaid.versions.join(counts, "policy_id")
