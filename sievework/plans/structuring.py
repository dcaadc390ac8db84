"""Queries of text structuring (T), running groups and marker runs (R17-R20), tiers and enrichment (C16, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structuring as S
from .bridge import records, references, sql, table
from .registry import query


@query("t04_reference_likeness", sql(r"""SELECT ref_id, length(raw) >= 30 AND (regexp_matches(raw, '\b(?:19|20)\d{2}\b') OR regexp_matches(raw, '10\.\d{4,9}/')) AND (regexp_matches(raw[:120], '^[A-Z][a-zA-Z''\-]+, [A-Z]\.')) AS likely FROM refs""", "refs"))
def t04(spark, d):
    return references(spark, d).select("ref_id", S.is_likely_reference(F.col("raw")).alias("likely"))


@query("t05_regex_structure", sql("SELECT ref_id, CASE WHEN doi <> '' THEN doi END AS doi, CASE WHEN pmid <> '' THEN pmid END AS pmid, year, doi <> '' OR pmid <> '' AS resolved FROM refs", "refs"))
def t05(spark, d):
    doi, pmid = T.extract_doi(F.col("raw")), T.extract_pmid(F.col("raw"))
    return references(spark, d).select("ref_id", doi.alias("doi"), pmid.alias("pmid"), T.extract_year(F.col("raw")).alias("year"), (doi.isNotNull() | pmid.isNotNull()).alias("resolved"))


@query("t06_heuristic_title", sql(r"""SELECT ref_id, CASE WHEN length(t) < 8 OR NOT regexp_matches(t, '[A-Za-z]') THEN NULL ELSE t[:250] END AS title
FROM (SELECT ref_id, CASE WHEN t = '' THEN trim(regexp_replace(regexp_extract(raw, '(Journal of .*)$', 1), '\.\s+PMID.*$', '')) ELSE t END AS t FROM (SELECT ref_id, raw, trim(regexp_extract(raw, '\((?:19|20)\d{2}\)\. ([^.]*)\. ', 1)) AS t FROM refs))""", "refs"))
def t06(spark, d):
    return references(spark, d).select("ref_id", S.heuristic_title(F.col("raw")).alias("title"))


@query("t07_heuristic_authors", sql(r"""SELECT ref_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_extract(raw, '^(.*?)\s*\((?:19|20)\d{2}', 1), ', '), lambda p: trim(p)), lambda p: length(p) > 1), '|'), '\|([A-Z]\.)', ' \1', 'g') AS authors FROM refs""", "refs"))
def t07(spark, d):
    return references(spark, d).select("ref_id", F.array_join(S.heuristic_authors(F.col("raw")), "|").alias("authors"))


@query("t08_heuristic_journal", sql(r"""SELECT ref_id, CASE WHEN length(t) >= 8 AND regexp_matches(t, '[A-Za-z]') THEN j END AS journal
FROM (SELECT ref_id, trim(regexp_extract(raw, '\((?:19|20)\d{2}\)\. ([^.]*)\. ', 1)) AS t, trim(regexp_extract(raw, '\. (Journal of [^.,;]*),', 1)) AS j FROM refs)""", "refs"))
def t08(spark, d):
    return references(spark, d).select("ref_id", S.heuristic_journal(F.col("raw")).alias("journal"))


def lines(spark, d) -> DataFrame:
    """Reference sections: per manuscript, lines with and without numbers."""
    refs = references(spark, d)
    numbered = F.concat(F.lit("["), (F.floor(F.col("ref_id") / 50) + 1).cast("string"), F.lit("] "), F.col("raw"))
    half = F.floor(F.length(numbered) / 2).cast("int")
    parts = F.array(F.substr(numbered, F.lit(1), half), F.substr(numbered, half + 1))
    return refs.select("ms_id", "ref_id", F.posexplode(parts).alias("part", "line")).select("ms_id", (F.col("ref_id") * 2 + F.col("part")).alias("pos"), "line")


_LINES = """lines AS (SELECT ms_id, ref_id * 2 + part AS pos, line FROM (
    SELECT ms_id, ref_id, unnest([0, 1]) AS part, unnest([n[:length(n) // 2], n[length(n) // 2 + 1:]]) AS line FROM (SELECT *, '[' || (ref_id // 50 + 1) || '] ' || raw AS n FROM refs)))"""


@query("r17_running_groups", sql(_LINES + r"""
SELECT ms_id, grp, string_agg(trim(line), ' ' ORDER BY pos) AS entry FROM (SELECT *, sum(regexp_matches(line, '^\s*\[\d{1,3}\]\s+')::INT) OVER (PARTITION BY ms_id ORDER BY pos)::BIGINT AS grp FROM lines) GROUP BY ms_id, grp""", "refs"))
def r17(spark, d):
    return S.running_groups(lines(spark, d), "ms_id", "pos", "line", F.col("line").rlike(r"^\s*\[\d{1,3}\]\s+"))


def marker_texts(spark, d) -> DataFrame:
    """Every document, whole, with marks after it that rise from a number of one to eight, or from three, or not at all."""
    mark = F.concat(F.lit(" ["), (F.col("doc_id") % 9).cast("string"), F.lit("] A "))
    text = F.concat("text", mark, F.lit("b [7] C d [8] E f [9] G h"), F.when(F.col("doc_id") % 3 == 0, " [3] X y [5] Y z [6] Z z").otherwise(""))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


_MARK = r"(?:^|[\s)\].])(?:\[(\d{1,3})\]|(\d{1,3})\.)\s+[A-Z\x{4e00}-\x{9fff}]"


@query("r18_marker_run", rf"""
WITH t AS (SELECT doc_id, text || ' [' || doc_id % 9 || '] A b [7] C d [8] E f [9] G h' || CASE WHEN doc_id % 3 = 0 THEN ' [3] X y [5] Y z [6] Z z' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_MARK}')) AS m, unnest(string_split_regex(t, '{_MARK}')) AS b, unnest(range(len(string_split_regex(t, '{_MARK}')))) AS k FROM t),
p AS (SELECT doc_id, k, regexp_extract(m, '\d{{1,3}}')::INT AS n, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM m WHERE m IS NOT NULL),
l AS (SELECT *, lead(n) OVER w AS n2, lead(n, 2) OVER w AS n3, lead(stop, 2) OVER w - stop AS far FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, first_marker FROM documents LEFT JOIN (SELECT doc_id, arg_min(n, k) AS first_marker FROM l WHERE n BETWEEN 1 AND 5 AND n < n2 AND n2 < n3 AND far <= 4000 GROUP BY doc_id) USING (doc_id)""")
def r18(spark, d):
    """The number that begins the first rising run of three markers in the whole text."""
    rows = marker_texts(spark, d)
    return rows.select("doc_id").join(S.marker_runs(rows, "doc_id", "text"), "doc_id", "left").select("doc_id", "first_marker")


@query("r19_section_start", "SELECT doc_id, len(string_split(t, chr(10) || 'References' || chr(10)))::BIGINT - 1 AS n, length(t) - position(reverse(chr(10) || 'References' || chr(10)) IN reverse(t)) - 11 AS start FROM (SELECT doc_id, coalesce(text, '') || chr(10) || 'References' || chr(10) || coalesce(text, '') || chr(10) || 'References' || chr(10) || 'tail' AS t FROM documents)")
def r19(spark, d):
    """How many section headers there are and where the last begins (0-based), in twice the whole text with headers after each."""
    body, head = F.coalesce("text", F.lit("")), F.lit("\nReferences\n")
    rows = table(spark, d, "documents").select("doc_id", F.concat(body, head, body, head, F.lit("tail")).alias("t"))
    return rows.select("doc_id", F.regexp_count("t", F.lit(r"\n(?=References\n)")).cast("long").alias("n"), S.references_start(F.col("t")).alias("start"))


@query("r20_section_end", r"SELECT doc_id, CASE WHEN p > 200 THEN p ELSE length(t) END AS stop FROM (SELECT doc_id, t, length(string_split_regex(t, '\n\s*Appendix\s*\n')[1]) AS p FROM (SELECT doc_id, coalesce(text, '') || chr(10) || 'Appendix' || chr(10) || coalesce(text, '') AS t FROM documents))")
def r20(spark, d):
    """Where the section that is the whole text ends: its first stop header, if that is past 200 characters."""
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", S.references_end(F.concat(body, F.lit("\nAppendix\n"), body)).alias("stop"))


_TIER = "CASE WHEN doi <> '' OR pmid <> '' THEN 'resolved' WHEN source = 'bibtex' AND author <> ' ; ' AND title <> '' THEN 'bibtex' WHEN title <> '' THEN 'title_year' ELSE 'raw_only' END"


@query("c16_reference_tiers", sql(f"SELECT ref_id, tier, CASE tier WHEN 'resolved' THEN 1.0 WHEN 'bibtex' THEN 0.9 WHEN 'title_year' THEN 0.6 ELSE 0.2 END::DOUBLE AS confidence FROM (SELECT ref_id, {_TIER} AS tier FROM (SELECT *, CASE WHEN ref_id % 5 = 0 THEN 'bibtex' ELSE 'regex' END AS source FROM (SELECT ref_id, doi, pmid, author, CASE WHEN ref_id % 7 = 0 THEN '' ELSE title END AS title FROM refs)))", "refs"))
def c16(spark, d):
    rows = references(spark, d).withColumn("title", F.when(F.col("ref_id") % 7 == 0, "").otherwise(F.col("title"))).withColumn("source", F.when(F.col("ref_id") % 5 == 0, "bibtex").otherwise("regex"))
    tier = S.tier(F.col("doi"), F.col("pmid"), F.col("author"), F.col("title"), F.col("year"), F.col("source"))
    return rows.select("ref_id", tier.alias("tier"), S.tier_confidence(tier).alias("confidence"))


@query("c17_provenance", sql("SELECT ref_id, array_to_string(list_sort(list_filter([CASE WHEN doi <> '' THEN 'doi=1.0' END, CASE WHEN pmid <> '' THEN 'pmid=1.0' END, CASE WHEN title <> '' THEN 'title=0.6' END, 'year=0.6'], lambda x: x IS NOT NULL)), '|') AS fields FROM refs", "refs"))
def c17(spark, d):
    fields = S.provenance({"doi": (F.col("doi"), 1.0), "pmid": (F.col("pmid"), 1.0), "title": (F.col("title"), 0.6), "year": (F.col("year").cast("string"), 0.6)}, "regex")
    shown = F.transform(F.map_entries("p"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["confidence"].cast("string")))
    return references(spark, d).select("ref_id", fields.alias("p")).select("ref_id", F.array_join(F.array_sort(shown), "|").alias("fields"))


@query("e02_fill_missing", sql("""SELECT r.ref_id, CASE WHEN r.ref_id % 3 = 0 THEN coalesce(n.title, '') ELSE r.title END AS title, coalesce(r.ref_id % 3 <> 0 AND n.title <> r.title, false) AS title_conflict, coalesce(n.journal <> r.journal, false) AS journal_conflict
FROM refs r LEFT JOIN records n ON r.doi <> '' AND r.doi = n.original_doi""", "records", "refs"))
def e02(spark, d):
    """Fill from the canonical work; what differs from a local value is kept local and recorded."""
    works = records(spark, d).select(F.col("original_doi").alias("doi"), F.col("title").alias("w_title"), F.col("journal").alias("w_journal"))
    local = references(spark, d).withColumn("title", F.when(F.col("ref_id") % 3 == 0, "").otherwise(F.col("title")))
    both = local.join(works, "doi", "left")
    return both.select("ref_id", S.fill(F.col("title"), F.col("w_title")).alias("title"), S.conflicts(F.col("title"), F.col("w_title")).alias("title_conflict"), S.conflicts(F.col("journal"), F.col("w_journal")).alias("journal_conflict"))


@query("e03_title_chain", sql("""SELECT r.ref_id, coalesce(CASE WHEN r.doi <> '' THEN r.doi END, a.doi, b.doi, '') AS doi, CASE WHEN r.doi <> '' THEN 'local' WHEN a.doi IS NOT NULL THEN 'first' WHEN b.doi IS NOT NULL THEN 'second' ELSE '' END AS source
FROM refs r LEFT JOIN (SELECT title, min(original_doi) AS doi FROM records WHERE year % 2 = 0 GROUP BY title) a ON a.title = r.title LEFT JOIN (SELECT title, min(original_doi) AS doi FROM records WHERE year % 2 = 1 GROUP BY title) b ON b.title = r.title""", "records", "refs"))
def e03(spark, d):
    """Identifier by title from sources in order; a later one is only asked where the earlier found nothing."""
    works = records(spark, d)
    source = lambda k, name: works.where(F.col("year") % 2 == k).groupBy("title").agg(F.min("original_doi").alias(name))
    both = references(spark, d).join(source(0, "d1"), "title", "left").join(source(1, "d2"), "title", "left")
    own = F.when(F.col("doi") != "", F.col("doi"))
    label = F.when(own.isNotNull(), "local").when(F.col("d1").isNotNull(), "first").when(F.col("d2").isNotNull(), "second").otherwise("")
    return both.select("ref_id", F.coalesce(own, "d1", "d2", F.lit("")).alias("doi"), label.alias("source"))


@query("e04_pmid_to_doi", sql("SELECT ref_id, coalesce(CASE WHEN r.doi <> '' THEN r.doi END, n.original_doi, '') AS doi FROM refs r LEFT JOIN records n ON r.pmid <> '' AND r.pmid = n.original_pmid", "records", "refs"))
def e04(spark, d):
    works = records(spark, d).select(F.col("original_pmid").alias("pmid"), "original_doi")
    return references(spark, d).join(works, "pmid", "left").select("ref_id", F.coalesce(F.when(F.col("doi") != "", F.col("doi")), "original_doi", F.lit("")).alias("doi"))


@query("e05_call_budget", sql("SELECT ms_id, least(count(*), 6) AS n_called, greatest(count(*) - 6, 0) AS n_skipped FROM refs WHERE doi = '' GROUP BY ms_id", "refs"))
def e05(spark, d):
    """At most six calls a manuscript, in reference order; the rest pass through and are counted."""
    order = Window.partitionBy("ms_id").orderBy("ref_id")
    rows = references(spark, d).where("doi = ''").withColumn("called", F.row_number().over(order) <= 6)
    return rows.groupBy("ms_id").agg(F.count_if("called").alias("n_called"), F.count_if(~F.col("called")).alias("n_skipped"))


@query("e06_decision_trace", sql("""SELECT ref_id, field, accepted, after FROM (SELECT ref_id, unnest(['doi', 'title']) AS field, unnest([doi <> '', title <> '']) AS accepted, unnest([CASE WHEN doi <> '' THEN doi END, title]) AS after FROM refs)""", "refs"))
def e06(spark, d):
    trace = F.array(*(F.struct(F.lit(n).alias("field"), ok.alias("accepted"), after.alias("after")) for n, ok, after in (("doi", F.col("doi") != "", F.when(F.col("doi") != "", F.col("doi"))), ("title", F.col("title") != "", F.col("title")))))
    return references(spark, d).select("ref_id", F.explode(trace).alias("t")).select("ref_id", "t.*")


@query("e08_cache_keys", sql("SELECT ref_id, sha256('model-1' || chr(10) || 'v3' || chr(10) || raw) AS cache_key FROM refs", "refs"))
def e08(spark, d):
    return references(spark, d).select("ref_id", F.sha2(F.concat_ws("\n", F.lit("model-1"), F.lit("v3"), "raw"), 256).alias("cache_key"))


@query("t15_footnote_marks", sql("SELECT record_id, pos::INT AS pos, name AS bare, CASE WHEN pos % 2 = 1 THEN 'one' ELSE 'two' END AS affiliation FROM (SELECT record_id, unnest(string_split(author, ';')) AS name, generate_subscripts(string_split(author, ';'), 1) AS pos FROM records)", "records"))
def t15(spark, d):
    """Names without their footnote marks, and the affiliation that the mark stands for."""
    each = records(spark, d).select("record_id", F.posexplode(F.split("author", ";")).alias("at", "name")).withColumn("pos", F.col("at") + 1)
    marked = each.withColumn("raw", F.concat("name", F.when(F.col("pos") % 2 == 1, "1*").otherwise("2")))
    table_ = F.create_map(F.lit("1"), F.lit("one"), F.lit("2"), F.lit("two"))
    mark = F.regexp_extract("raw", r"(\d)\W*$", 1)
    return marked.select("record_id", "pos", F.regexp_replace("raw", r"[\d*†‡§]+$", "").alias("bare"), F.coalesce(F.try_element_at(table_, mark), F.lit("one")).alias("affiliation"))
