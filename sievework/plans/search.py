"""Queries of indexed search: prefixes in logs (J14), substrings (P08, J05) and near titles (F29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..sources.shared import new_path
from .bridge import logs, records, references, sql, table
from .registry import query
from .scalars import N, search_terms

_INDEXES: dict[tuple[str, str], search.WordIndex] = {}

#: A search for each benchmark item: the fronts of its first and third word.
ASKED_SQL = r"""asked AS (
    SELECT item_id AS query_id, list_distinct(list_filter([substring(coalesce(w[1], ''), 1, 2 + item_id % 3), substring(coalesce(w[3], ''), 1, 2)], lambda t: t <> '')) AS terms
    FROM (SELECT item_id, string_split(""" + N.format("coalesce(text, '')") + r""", ' ') AS w FROM benchmark)
)"""


def log_index(spark, d) -> search.WordIndex:
    """The index of file names and titles, built once an application for each folder of tables."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _INDEXES:
        words = F.split(T.normalize_text(F.concat_ws(" ", "file_name", "title")), " ")
        _INDEXES[known] = search.WordIndex.build(logs(spark, d), words, new_path(spark, "log-index"))
    return _INDEXES[known]


@query("j14_indexed_search", sql(ASKED_SQL + ",\nw AS (SELECT id, string_split(" + N.format("file_name || ' ' || title") + """, ' ') AS words FROM logs)
SELECT query_id, id FROM asked, w WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: len(list_filter(words, lambda x: x <> '' AND starts_with(x, t))) > 0)) = len(terms)""", "logs"))
def j14_batch(spark, d):
    """A batch of searches on the inverted index of the logs."""
    word = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split(T.normalize_text(F.coalesce("text", F.lit(""))), " ").alias("w"))
    front = F.substr(word(1), F.lit(1), (2 + F.col("query_id") % 3).cast("int"))
    raw = asked.select("query_id", F.concat(F.lit('"'), front, F.lit("* "), F.substring(word(3), 1, 2)).alias("raw"))
    return log_index(spark, d).search(raw, search_terms(F.col("raw")))


@query("p08_substrings", sql("""tokens AS (SELECT DISTINCT substring(n, 2 + item_id % 5, (1 + item_id % 12)::INT) AS token FROM (SELECT item_id, """ + N.format("coalesce(text, '')") + """ AS n FROM benchmark))
SELECT record_id, token FROM tokens JOIN (SELECT record_id, """ + N.format("title") + """ AS t FROM records) ON token <> '' AND contains(t, token)""", "records"))
def p08_batch(spark, d):
    """Tokens of 1 to 12 characters inside titles, by trigrams."""
    plain = F.substr(T.normalize_text(F.coalesce("text", F.lit(""))), (2 + F.col("item_id") % 5).cast("int"), (1 + F.col("item_id") % 12).cast("int"))
    tokens = table(spark, d, "benchmark").select(plain.alias("token"))
    titles = records(spark, d).select("record_id", T.normalize_text(F.col("title")).alias("t"))
    return search.substring_pairs(titles, "record_id", "t", tokens).select(F.col("key").alias("record_id"), "token")


@query("j05_passage_containment", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text)")
def j05_passages(spark, d):
    """Passages found whole inside documents."""
    return search.passage_pairs(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query("j05_short_passages", r"""
SELECT item_id, doc_id FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN p[1] WHEN 1 THEN p[1] || p[2] || substring(coalesce(p[3], ''), 1, 3) WHEN 2 THEN substring(p[3], 2, 4) ELSE substring(p[1], 2) || p[2] END AS passage
    FROM (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM benchmark)) b
JOIN documents d ON passage <> '' AND contains(d.text, passage)""")
def j05_short(spark, d):
    """Passages of one or two words, or parts of words, inside whole documents."""
    p = lambda i: F.try_element_at("p", F.lit(i))
    cut = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(search.PIECE), F.lit(0)).alias("p"))
    kind = F.col("item_id") % 4
    passage = (
        F.when(kind == 0, p(1)).when(kind == 1, F.concat(p(1), p(2), F.substring(F.coalesce(p(3), F.lit("")), 1, 3)))
        .when(kind == 2, F.substring(p(3), 2, 4)).otherwise(F.concat(F.substr(p(1), F.lit(2)), p(2)))
    )
    return search.passage_pairs(table(spark, d, "documents"), "doc_id", "text", cut.select("item_id", passage.alias("passage")), "item_id", "passage")


_PLAIN = r"regexp_replace(" + N.format("title") + r", '[^\x00-\x7F]', '', 'g')"


@query("f29_near_titles", sql(f"""a AS (SELECT ref_id, {_PLAIN} AS x FROM refs), b AS (SELECT record_id, {_PLAIN} AS y FROM records)
SELECT ref_id, record_id, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6)::DOUBLE AS ratio FROM a JOIN b
ON x <> '' AND y <> '' AND 100 * least(length(x), length(y)) >= 92 * greatest(length(x), length(y)) AND 100 * (greatest(length(x), length(y)) - levenshtein(x, y)) >= 92 * greatest(length(x), length(y))""", "records", "refs"))
def f29_near(spark, d):
    """All pairs of a reference and a notice whose titles pass the gate."""
    plain = F.regexp_replace(T.normalize_text(F.col("title")), r"[^\x00-\x7F]", "")
    left, right = references(spark, d).select("ref_id", plain.alias("t")), records(spark, d).select("record_id", plain.alias("t"))
    return search.near_pairs(left, "ref_id", "t", right, "record_id", "t", 0.92).withColumn("ratio", F.round("ratio", 6))
