"""Queries that apply operators of scalars, sources and structuring to the whole texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structuring as S
from ..sources import readers
from .bridge import records, references, sql, table
from .registry import query
from .scalars import _NAMES, _PAIRS, TITLE_TOKENS, N, _neighbours, joined


_CLASSES = f"""
names AS (SELECT *, t[-1] AS surname, array_to_string(list_filter(t[:len(t) - 1], lambda w: length(w) > 1), '') AS given FROM {_NAMES} WHERE n <> ''),
classes AS (SELECT DISTINCT surname, given FROM names)
"""


def _names(spark, d):
    rows = records(spark, d).select("record_id", F.posexplode(F.split("author", ";")).alias("at", "name")).withColumn("n", T.name_parts(F.col("name")))
    given = T._given(F.col("n"))
    return rows.where("n.normalized != ''").select("record_id", (F.col("at") + 1).alias("pos"), F.col("n.surname").alias("surname"), given.alias("given"))


@query("f09_name_classes", sql(_CLASSES + "SELECT record_id, pos::INT AS pos, surname, given FROM names", "records"))
def f09_classes(spark, d):
    """The class (surname, given name) of every name, whatever its length."""
    return _names(spark, d)


@query("f09_class_conflicts", sql(_CLASSES + """
SELECT a.surname, a.given, b.given AS other_given FROM classes a JOIN classes b ON a.surname = b.surname AND a.given < b.given WHERE a.given <> ''""", "records"))
def f09_conflicts(spark, d):
    """Classes of one surname whose given names conflict; with the classes of names, all conflicts of names."""
    classes = _names(spark, d).where("given != ''").select("surname", "given").distinct()
    a, b = classes.alias("a"), classes.alias("b")
    return a.join(b, (F.col("a.surname") == F.col("b.surname")) & (F.col("a.given") < F.col("b.given"))).select("a.surname", "a.given", F.col("b.given").alias("other_given"))


@query("f14_normalize_title", "SELECT doc_id, md5(" + N.format("text") + ") AS title FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_title(F.col("text"))).alias("title"))


@query("f15_title_tokens", f"SELECT doc_id, md5(coalesce(array_to_string(list_sort({TITLE_TOKENS.format('text')}), '|'), '')) AS tokens FROM documents")
def f15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(joined(T.title_tokens(F.col("text")))).alias("tokens"))


@query("f25_unwrap_blob", r"""
SELECT doc_id, md5(CASE WHEN length(b) >= 3000 AND len(regexp_extract_all(b, ' (?:\d{1,3}\.\s+|\[\d+\]\s+)[A-Z\x{4e00}-\x{9fff}]')) >= 5 THEN regexp_replace(b, ' ((?:\d{1,3}\.\s+|\[\d+\]\s+)[A-Z\x{4e00}-\x{9fff}])', chr(10) || '\1', 'g') ELSE b END) AS block
FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), '. ', '. ' || doc_id % 90 || '. ') AS b FROM documents)""")
def f25(spark, d):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    numbered = F.replace(flat, F.lit(". "), F.concat(F.lit(". "), (F.col("doc_id") % 90).cast("string"), F.lit(". ")))
    return table(spark, d, "documents").select("doc_id", F.md5(T.unwrap_blob(numbered)).alias("block"))


@query("f26_safe_file_name", r"""
SELECT doc_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(replace('C:\dir/..' || text || '..tex', chr(92), '/'), '/')[-1], '^\.+', '_'), '[^A-Za-z0-9._\x{4e00}-\x{9fff}\-]+', '_', 'g'), '\.{2,}', '.', 'g'), '_{2,}', '_', 'g'), 1, 200) AS name
FROM documents""")
def f26(spark, d):
    """Every document, those with a slash too, whose name is what follows the last one."""
    return table(spark, d, "documents").select("doc_id", T.safe_file_name(F.concat(F.lit("C:\\dir/.."), "text", F.lit("..tex"))).alias("name"))


@query("f29_levenshtein_gate", sql(_PAIRS.format(r"regexp_replace(" + N.format("a.title") + r", '[^\x00-\x7F]', '', 'g')", r"regexp_replace(" + N.format("b.title") + r", '[^\x00-\x7F]', '', 'g')") + """
SELECT ref_id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END::DOUBLE, 6) AS ratio FROM pairs
""", "records", "refs"))
def f29(spark, d):
    """Whole titles; a title is defined as the first 120 characters of a document."""
    x, y = (F.regexp_replace(T.normalize_text(F.col(c)), r"[^\x00-\x7F]", "") for c in ("title", "r_title"))
    return _neighbours(spark, d).select("ref_id", F.round(T.levenshtein_ratio(x, y), 6).alias("ratio"))


@query("s09_strip_latex", r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(text, chr(10), ' '), '%', ''), chr(92), ''), '[{}$&~ \t\n\r\f]+', ' ', 'g'))) AS body FROM documents")
def s09(spark, d):
    plain = F.regexp_replace(F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("%"), F.lit("")), F.lit("\\"), F.lit("")), r"[{}$&~]", " ")
    dressed = F.concat(F.lit("% a comment\n\\documentclass[a4paper]{article}\\begin{document}\\section{Gone} "), plain, F.lit(" \\emph{gone} % more\n\\end{document}"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(readers.strip_latex(dressed), r"[ \t\n\r\f]+", " "))).alias("body"))


@query("s15_upload_status", r"""
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'ok' WHEN 4 THEN 'unsupported' WHEN 2 THEN 'encrypted'
       ELSE CASE WHEN doc_id % 5 = 1 AND NOT contains(t, '%%EOF') THEN 'truncated' WHEN contains(t, '/Encrypt') THEN 'encrypted' ELSE 'ok' END END AS status
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def s15(spark, d):
    """Every document, those with the mark of encryption too, whole as the upload's body."""
    k = F.col("doc_id") % 5
    body = F.coalesce("text", F.lit(""))
    head = F.when(k == 3, F.concat(F.lit("\\documentclass{x} "), body)).when(k == 4, F.concat(F.lit("?"), F.regexp_replace(body, r"\\", ""))).otherwise(F.concat(F.lit("%PDF-1.7 "), body))
    tail = F.when(k == 1, body).when(k == 2, F.lit("/Encrypt %%EOF")).otherwise("%%EOF")
    return table(spark, d, "documents").select("doc_id", readers.upload_status(F.encode(head, "UTF-8"), F.encode(tail, "UTF-8"), F.lit(1000)).alias("status"))


@query("r18_references_by_marker")
def r18(spark, d):
    """Where numbered references begin in the last half of every document, -1 if nowhere."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", S.references_by_marker(text).alias("start"))


@query("r19_references_section")
def r19(spark, d):
    """Where the reference section of every document begins, -1 if no header is there, and its length."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("start", S.references_start(F.col("t")))
    tail = F.substr(F.col("t"), (F.col("start") + 1).cast("int"))
    return rows.select("doc_id", "start", F.when(F.col("start") >= 0, S.references_end(tail)).alias("length"))


def cited(spark, d):
    """Documents that end in a reference section: each with its own text and the references of its manuscript, laid out in four ways."""
    from .bridge import references

    raws = references(spark, d).select((F.col("ref_id") / 20).cast("long").alias("doc_id"), "ref_id", "raw")
    listed = raws.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "raw"))).alias("r")).withColumn("r", F.transform("r", lambda x: x["raw"]))
    k = F.col("doc_id") % 4
    number = lambda left, right: F.transform("r", lambda x, i: F.concat(F.lit(left), (i + 1).cast("string"), F.lit(right), x))
    block = F.when(k == 0, F.array_join(number("[", "] "), "\n")).when(k == 1, F.array_join("r", "\n")).when(k == 2, F.array_join(number("[", "] "), " ")).otherwise(F.array_join("r", "\n\n"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nReferences\n"), block, F.lit("\n"))
    return table(spark, d, "documents").join(listed, "doc_id").select("doc_id", text.alias("text"))


@query("t01_located_references")
def t01(spark, d):
    """Every document: where its references begin, how many there are, and whether they are too few to be trusted."""
    found = S.located_references(table(spark, d, "documents").select("doc_id", "text").unionByName(cited(spark, d).withColumn("doc_id", -F.col("doc_id") - 1)))
    return found.select("doc_id", "start", F.size("refs").cast("long").alias("n_refs"), "needs_fallback")


@query("t02_split_references")
def t02(spark, d):
    """The references of documents that have a section of them, in order."""
    return S.located_references(cited(spark, d)).select("doc_id", F.posexplode("refs").alias("at", "raw"))


@query("t03_split_overlong")
def t03(spark, d):
    """All references of a manuscript in one line, cut where another one begins."""
    from .bridge import references

    one = references(spark, d).groupBy((F.col("ref_id") / 20).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ref_id", F.trim("raw").alias("raw")))).alias("r"))
    return one.select("doc_id", F.posexplode(S.split_overlong(F.array_join(F.transform("r", lambda x: x["raw"]), " "))).alias("at", "raw"))


@query("t09_candidates")
def t09(spark, d):
    """The fields of every reference that a section holds, with their source, tier and provenance."""
    refs = S.located_references(cited(spark, d)).select("doc_id", F.posexplode("refs").alias("at", "raw"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("provenance"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"]))), "|")
    return S.candidates(refs).select("doc_id", "at", "doi", "pmid", "title", F.array_join("authors", "|").alias("author_list"), "year", "journal", "source", "tier", shown.alias("told"))


def headed(spark, d):
    """Documents with a head of a title, authors with marks, affiliations and an address before their own text."""
    word = lambda i: F.initcap(F.lower(F.coalesce(F.try_element_at("ws", F.lit(i)), F.lit("Name"))))
    docs = table(spark, d, "documents").withColumn("ws", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z]{4,}"), F.lit(0)))
    title = F.concat(F.lit("A study of "), F.array_join(F.transform(F.slice("ws", 5, 6), lambda w: F.lower(w)), " "))
    names = F.concat(word(1), F.lit(" "), word(2), F.lit("1, "), word(3), F.lit(" "), word(4), F.lit("2"))
    places = F.concat(F.lit("1Department of "), word(5), F.lit(", University of "), word(6), F.lit("\n2Institute of "), word(7))
    noted = F.when(F.col("doc_id") % 3 == 0, "All rights reserved\nPreprint\nin press\n").otherwise("")
    mail = F.concat(F.lower(word(1)), F.lit("@"), F.lower(word(2)), F.lit(".org"))
    return docs.select("doc_id", F.concat_ws("\n", F.concat(noted, title), names, places, mail, F.lit("Abstract"), F.coalesce("text", F.lit(""))).alias("text"))


@query("t10_headers")
def t10(spark, d):
    """Title, identifier, authors and abstract of every document's head."""
    from ..operators import header as H

    found = H.headers(headed(spark, d), name="h")
    shown = F.array_join(F.transform("h.authors", lambda a: F.concat_ws("/", a["name"], a["email"], a["affiliation"])), "|")
    return found.select("doc_id", "h.title", "h.doi", shown.alias("author_list"), F.length("h.abstract").cast("long").alias("abstract_chars"))


@query("t12_title_ranges")
def t12(spark, d):
    """Where the title stands in the head of every document as it is, if a line there is like one; lines before it that are notes are gone (T11)."""
    from ..operators import header as H

    rows = table(spark, d, "documents").select("doc_id", H.header_lines(F.array().cast("array<string>"), F.coalesce("text", F.lit(""))).alias("raw"))
    lines = rows.select("doc_id", F.size("raw").alias("n"), H.stripped(H.describe(F.col("raw"))).alias("lines"))
    found = lines.select("doc_id", (F.col("n") - F.size("lines")).alias("n_stripped"), H.title_of(H.settle_kinds(F.col("lines"))).alias("t"))
    first = F.try_element_at("t", F.lit(1))
    return found.select("doc_id", "n_stripped", first["title"].alias("title"), first["first"].alias("first"), first["last"].alias("last"))


@query("t13_author_names")
def t13(spark, d):
    """The names of every author block, once each, with their marks (T13, T14, T16)."""
    from ..operators import header as H

    rows = headed(spark, d).select("doc_id", H.header_lines(F.array().cast("array<string>"), F.col("text")).alias("lines"))
    blocks = rows.select("doc_id", H.author_block(F.col("lines"), H.title_range(F.col("lines"))).alias("block"))
    names = blocks.select("doc_id", F.posexplode_outer(H.distinct_names(H.author_names(F.col("block")))).alias("at", "n"))
    return names.select("doc_id", "at", "n.base", F.array_join("n.marks", "").alias("marks"))


@query("t17_merged_headers", sql("""SELECT ref_id, coalesce(l_title, o_title) AS title, coalesce(l_doi, o_doi) AS doi, CASE WHEN len(o) >= len(l) THEN array_to_string(o, '|') ELSE array_to_string(l, '|') END AS author_list, coalesce(l_abstract, o_abstract) AS abstract
FROM (SELECT ref_id, CASE WHEN ref_id % 3 <> 0 THEN a.title END AS l_title, nullif(a.doi, '') AS l_doi, list_filter(string_split(a.author, ';'), lambda x: x <> ' ') AS l, CASE WHEN ref_id % 5 = 0 THEN a.raw END AS l_abstract,
             b.title AS o_title, b.original_doi AS o_doi, string_split(b.author, ';')[1:(ref_id % 4)::INT] AS o, b.journal AS o_abstract
      FROM refs a JOIN records b ON b.record_id = 'D' || lpad((ref_id - 1)::VARCHAR, 8, '0'))""", "records", "refs"))
def t17(spark, d):
    """Every reference's own header, merged with that of the notice before it as the second opinion."""
    from ..operators.structuring import merge_headers

    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    other = F.struct("title", F.col("original_doi").alias("doi"), F.slice(F.split("author", ";"), 1, (F.substr("record_id", F.lit(2)).cast("long") + 1).cast("int") % 4).alias("authors"), F.col("journal").alias("abstract"))
    local = F.struct(
        F.when(F.col("ref_id") % 3 != 0, F.col("title")).alias("title"), F.nullif("doi", F.lit("")).alias("doi"),
        F.filter(F.split("author", ";"), lambda x: x != " ").alias("authors"), F.when(F.col("ref_id") % 5 == 0, F.col("raw")).alias("abstract"),
    )
    both = references(spark, d).select("ref_id", key.alias("record_id"), local.alias("local")).join(records(spark, d).select("record_id", other.alias("other")), "record_id")
    merged = both.select("ref_id", merge_headers(F.col("local"), F.col("other")).alias("m"))
    return merged.select("ref_id", "m.title", "m.doi", F.array_join("m.authors", "|").alias("author_list"), "m.abstract")
