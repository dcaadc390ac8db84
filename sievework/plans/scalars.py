"""Queries of the scalar functions (F) and of row predicates that stand alone (P, S)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .bridge import logs, records, references, sql, table
from .registry import query

#: normalize_text in SQL.
N = r"trim(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
STOP_TITLE = ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS)
STOP_PLACE = ", ".join(f"'{w}'" for w in T.INSTITUTION_STOP_WORDS)
#: title_tokens in SQL, for texts without Han characters.
TITLE_TOKENS = "list_distinct(list_filter(string_split(" + N + f", ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP_TITLE})))"
PLACE_TOKENS = "list_distinct(list_filter(string_split(" + N + f", ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP_PLACE})))"


def joined(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), "|")


def _docs(spark, d):
    return table(spark, d, "documents")


@query("f01_prefix_terms", sql("""
SELECT id, len(list_filter(terms, lambda t: len(list_filter(words, lambda w: starts_with(w, t))) > 0)) = len(terms) AS hit
FROM (SELECT id, string_split(""" + N.format("title") + """, ' ') AS words,
      list_filter(string_split(lower(regexp_replace(w1 || ' ' || substring(w2, 1, 2), '["()*\\-+:^~]', '', 'g')), ' '), lambda t: t <> '') AS terms
      FROM (SELECT *, string_split(""" + N.format("title") + """, ' ')[1] AS w1, coalesce(string_split(""" + N.format("title") + """, ' ')[3], '') AS w2 FROM logs))
""", "logs"))
def f01(spark, d):
    """Prefix search: every term begins some word of the row."""
    words = F.split(T.normalize_text(F.col("title")), " ")
    rows = logs(spark, d).select("id", words.alias("words"))
    asked = F.concat(F.col("words")[0], F.lit(" "), F.substring(F.coalesce(F.try_element_at("words", F.lit(3)), F.lit("")), 1, 2))
    return rows.select("id", prefix_match(F.col("words"), search_terms(asked)).alias("hit"))


def search_terms(raw):
    """Terms of a search string: split at white space, operators of the search language deleted."""
    return F.filter(F.split(F.lower(F.regexp_replace(raw, '["()*\\-+:^~]', "")), r"\s+"), lambda t: t != "")


def prefix_match(words, terms):
    return F.forall(terms, lambda t: F.exists(words, lambda w: w.startswith(t)))


@query("f02_normalize_text", "SELECT doc_id, md5(" + N.format("text") + ") AS normal FROM documents")
def f02(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


@query("f03_normalize_doi", sql(r"""
SELECT ref_id, CASE WHEN k = 2 THEN '' WHEN doi = '' THEN '' ELSE lower(doi) END AS doi
FROM (SELECT *, ref_id % 7 AS k FROM refs)
""", "refs"))
def f03(spark, d):
    k = F.col("ref_id") % 7
    dressed = F.when(k == 0, F.concat(F.lit(" HTTPS://dx.doi.org/"), F.upper("doi"), F.lit(".) "))).when(k == 1, F.concat(F.lit("doi: "), "doi", F.lit(";'"))).when(k == 2, "Unavailable").otherwise(F.col("doi"))
    return references(spark, d).select("ref_id", T.normalize_doi(F.when(F.col("doi") == "", F.when(k == 2, "unavailable").otherwise("")).otherwise(dressed)).alias("doi"))


@query("f04_normalize_pmid", sql("SELECT ref_id, CASE WHEN ref_id % 3 = 0 AND pmid = '' THEN '' ELSE pmid END AS pmid FROM refs", "refs"))
def f04(spark, d):
    dressed = F.when(F.col("pmid") == "", F.when(F.col("ref_id") % 3 == 0, " 0 ").otherwise("")).otherwise(F.concat(F.lit("PMID "), "pmid", F.lit(".")))
    return references(spark, d).select("ref_id", T.normalize_pmid(dressed).alias("pmid"))


_MAILS = r"(SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}'))) AS mail FROM documents)"


def mails(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.extract_emails(F.col("text"))).alias("mail"))


@query("f05_email_domain", f"SELECT doc_id, mail, string_split(lower(mail), '@')[-1] AS domain FROM {_MAILS}")
def f05(spark, d):
    return mails(spark, d).select("doc_id", "mail", T.email_domain(F.col("mail")).alias("domain"))


@query("f06_public_domain", f"SELECT doc_id, mail, string_split(lower(mail), '@')[-1] IN ({', '.join(repr(x) for x in T.PUBLIC_DOMAINS)}) AS is_public FROM {_MAILS}")
def f06(spark, d):
    return mails(spark, d).select("doc_id", "mail", T.is_public_domain(T.email_domain(F.col("mail"))).alias("is_public"))


@query("f07_domain_tokens", "SELECT doc_id, mail, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(" + N.format("array_to_string(p[:len(p) - 1], ' ')") + f", ' '), lambda w: length(w) > 2))), '|'), '') AS tokens FROM (SELECT *, string_split(string_split(lower(mail), '@')[-1], '.') AS p FROM {_MAILS})")
def f07(spark, d):
    return mails(spark, d).select("doc_id", "mail", joined(T.domain_tokens(T.email_domain(F.col("mail")))).alias("tokens"))


_NAMES = "(SELECT record_id, pos, name, string_split(n, ' ') AS t, n FROM (SELECT record_id, pos, name, " + N.format("name") + " AS n FROM (SELECT record_id, unnest(string_split(author, ';')) AS name, generate_subscripts(string_split(author, ';'), 1) AS pos FROM records)))"


@query("f08_normalize_name", sql(f"""
SELECT record_id, pos::INT AS pos, n AS normalized, CASE WHEN n = '' THEN '' ELSE t[-1] END AS surname,
       array_to_string(list_transform(t, lambda w: w[1:1]), '') AS initials,
       CASE WHEN n = '' THEN '' ELSE t[-1] || ':' || array_to_string(list_transform(t, lambda w: w[1:1]), '') END AS signature,
       CASE WHEN n = '' THEN '' WHEN len(t) = 1 THEN n ELSE array_to_string(list_sort(list_distinct([n, array_to_string(list_reverse(t), ' '), t[1][1:1] || ' ' || t[-1]])), '|') END AS variants
FROM {_NAMES}
""", "records"))
def f08(spark, d):
    rows = records(spark, d).select("record_id", F.posexplode(F.split("author", ";")).alias("at", "name"))
    name = T.name_parts(F.col("name"))
    return rows.withColumn("n", name).select("record_id", (F.col("at") + 1).alias("pos"), "n.normalized", "n.surname", "n.initials", "n.signature", joined(F.col("n.variants")).alias("variants"))


@query("f09_given_name_conflict", sql(f"""
, names AS (SELECT *, t[-1] AS surname, array_to_string(list_filter(t[:len(t) - 1], lambda w: length(w) > 1), '') AS given FROM {_NAMES} WHERE n <> '')
SELECT record_id, pos::INT AS pos, surname, given, CASE WHEN given = '' THEN 0 ELSE kinds - 1 END AS n_conflicts, CASE WHEN given = '' OR kinds < 2 THEN NULL WHEN given = low THEN high ELSE low END AS other_given
FROM names JOIN (SELECT surname, count(DISTINCT nullif(given, '')) AS kinds, min(nullif(given, '')) AS low, max(nullif(given, '')) AS high FROM names GROUP BY surname) USING (surname)
""".lstrip("\n, "), "records"))
def f09(spark, d):
    """Every name, with how many full given names of its surname conflict with its own, and one of them.

    Two names conflict if their surname is one and their given names, both full, differ; so names with the
    given names of each surname tell all conflicts, and no pair of names is made.
    """
    rows = records(spark, d).select("record_id", F.posexplode(F.split("author", ";")).alias("at", "name")).withColumn("n", T.name_parts(F.col("name"))).where("n.normalized != ''")
    names = rows.select("record_id", (F.col("at") + 1).alias("pos"), F.col("n.surname").alias("surname"), T._given(F.col("n")).alias("given"))
    full = names.where("given != ''").groupBy("surname", "given").agg(F.lit(1).alias("one")).groupBy("surname").agg(F.count("*").alias("n"), F.min("given").alias("low"), F.max("given").alias("high"))
    both = names.join(full, "surname", "left")
    named = F.col("given") != ""
    other = F.when(named & (F.col("n") > 1), F.when(F.col("given") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    return both.select("record_id", "pos", "surname", "given", F.when(named, F.col("n") - 1).otherwise(0).cast("long").alias("n_conflicts"), other.alias("other_given"))


@query("f11_institution_tokens", sql(f"SELECT record_id, coalesce(array_to_string(list_sort({PLACE_TOKENS.format('institution')}), '|'), '') AS tokens FROM records", "records"))
def f11(spark, d):
    return records(spark, d).select("record_id", joined(T.institution_tokens(F.col("institution"))).alias("tokens"))


_PAIRS = "pairs AS (SELECT a.ref_id, b.record_id, {0} AS x, {1} AS y FROM refs a JOIN records b ON b.record_id = 'D' || lpad((a.ref_id - 1)::VARCHAR, 8, '0'))"


def _neighbours(spark, d):
    """Each reference with the record before it."""
    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    return references(spark, d).withColumn("record_id", key).join(records(spark, d).select("record_id", F.col("title").alias("r_title"), F.col("author").alias("r_author")), "record_id")


@query("f12_token_overlap", sql(_PAIRS.format(TITLE_TOKENS.format("a.title"), TITLE_TOKENS.format("b.title")) + """
SELECT ref_id, round(CASE WHEN least(len(x), len(y)) = 0 THEN 0 WHEN s < 2 THEN s / greatest(len(x), len(y)) ELSE s / least(len(x), len(y)) END::DOUBLE, 6) AS overlap
FROM (SELECT *, len(list_intersect(x, y))::DOUBLE AS s FROM pairs)
""", "records", "refs"))
def f12(spark, d):
    return _neighbours(spark, d).select("ref_id", F.round(T.token_overlap(T.title_tokens(F.col("title")), T.title_tokens(F.col("r_title"))), 6).alias("overlap"))


@query("f13_jaccard", sql(_PAIRS.format(TITLE_TOKENS.format("a.title"), TITLE_TOKENS.format("b.title")) + """
SELECT ref_id, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE s / (len(x) + len(y) - s) END::DOUBLE, 6) AS engine,
       round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE s / (len(x) + len(y) - s) END::DOUBLE, 6) AS benchmark
FROM (SELECT *, len(list_intersect(x, y))::DOUBLE AS s FROM pairs)
""", "records", "refs"))
def f13(spark, d):
    x, y = T.title_tokens(F.col("title")), T.title_tokens(F.col("r_title"))
    return _neighbours(spark, d).select("ref_id", F.round(T.jaccard(x, y), 6).alias("engine"), F.round(T.jaccard(x, y, 1.0), 6).alias("benchmark"))


@query("f17_extract_doi", sql("SELECT ref_id, CASE WHEN doi <> '' THEN doi END AS doi FROM refs", "refs"))
def f17(spark, d):
    return references(spark, d).select("ref_id", T.extract_doi(F.col("raw")).alias("doi"))


@query("f18_extract_pmid", sql("SELECT ref_id, CASE WHEN pmid <> '' THEN pmid END AS pmid FROM refs", "refs"))
def f18(spark, d):
    return references(spark, d).select("ref_id", T.extract_pmid(F.col("raw")).alias("pmid"))


@query("f19_extract_year", "SELECT doc_id, CASE WHEN y <> '' THEN y::INT END AS year FROM (SELECT doc_id, regexp_extract(text, '(?:19|20)[0-9]{2}') AS y FROM documents)")
def f19(spark, d):
    return _docs(spark, d).select("doc_id", T.extract_year(F.col("text")).alias("year"))


@query("f20_emails_orcids", r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}')))::BIGINT AS n_emails,
       coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}'))), '|'), '') AS emails,
       len(list_distinct(regexp_extract_all(text, '\b(?:https?://orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b', 1)))::BIGINT AS n_orcids
FROM documents""")
def f20(spark, d):
    mail, orcid = T.extract_emails(F.col("text")), T.extract_orcids(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(mail).cast("long").alias("n_emails"), joined(mail).alias("emails"), F.size(orcid).cast("long").alias("n_orcids"))


@query("f21_semicolon_list", sql("SELECT record_id, array_to_string(list_filter(list_transform(string_split(author, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM records", "records"))
def f21(spark, d):
    return records(spark, d).select("record_id", F.array_join(T.semicolon_list(F.col("author")), "|").alias("names"))


@query("f22_title_noise", r"""
SELECT doc_id, k::INT AS k, length(trim(t)) < 8 OR NOT regexp_matches(t, '[A-Za-z\x{4e00}-\x{9fff}]') OR regexp_matches(trim(t), '^[A-Z][a-z]{2}\.?\s*\d+\s*[;:]')
       OR regexp_matches(trim(t), '^\d+\s*\(\d+\)\s*[:;]') OR regexp_matches(trim(t), '^(19|20)\d{2}\s*[;:]\s*\d+') OR regexp_matches(trim(t), '^\d+\s*:\s*\d+[\s\-–]?\d*\.?$') OR regexp_matches(trim(t), '^pp?\.?\s*\d+') AS noise
FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS k, unnest([text, doc_id || '(' || doc_id % 9 || '): p. 3-4 in it', 'Aug ' || doc_id % 28 || ';57(6):365 and on', 'pp. ' || doc_id || ' and more words', (2000 + doc_id % 20) || ';57:365-88']) AS t FROM documents)""")
def f22(spark, d):
    k = F.col("doc_id")
    number = k.cast("string")
    shapes = F.array(
        F.col("text"), F.concat(number, F.lit("("), (k % 9).cast("string"), F.lit("): p. 3-4 in it")),
        F.concat(F.lit("Aug "), (k % 28).cast("string"), F.lit(";57(6):365 and on")), F.concat(F.lit("pp. "), number, F.lit(" and more words")), F.concat((k % 20 + 2000).cast("string"), F.lit(";57:365-88")),
    )
    return _docs(spark, d).select("doc_id", F.posexplode(shapes).alias("k", "t")).select("doc_id", "k", T.is_title_noise(F.col("t")).alias("noise"))


@query("f23_clean_page_text", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, ' the ', '-' || chr(10) || 'the '), chr(13), '', 'g'), '-\n([a-z])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned
FROM documents""")
def f23(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_page_text(F.replace("text", F.lit(" the "), F.lit("-\nthe ")))).alias("cleaned"))


@query("f24_fix_split_doi", sql("SELECT ref_id, doi || CASE WHEN doi <> '' THEN ' end' ELSE 'none' END AS fixed FROM refs", "refs"))
def f24(spark, d):
    broken = F.when(F.col("doi") != "", F.concat(F.regexp_replace("doi", "/", "/ "), F.lit(" end"))).otherwise("none")
    once = F.regexp_replace(broken, " end$", "")
    return references(spark, d).select("ref_id", F.when(F.col("doi") != "", F.concat(T.fix_split_doi(once), F.lit(" end"))).otherwise(broken).alias("fixed"))


@query("f27_ip_pseudonym", "SELECT event_id, substring(sha256('salt:10.0.' || user_id % 256 || '.' || event_id % 256), 1, 16) AS ip_hash FROM events")
def f27(spark, d):
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    return table(spark, d, "events").select("event_id", T.ip_pseudonym(ip, "salt").alias("ip_hash"))


@query("f28_field_encryption", "SELECT event_id, 'enc:v1' AS frame, props AS back FROM events")
def f28(spark, d):
    key = bytes(range(32))
    rows = table(spark, d, "events").withColumn("coded", T.encrypt_field(F.col("props"), key))
    return rows.select("event_id", F.substring("coded", 1, 6).alias("frame"), T.decrypt_field(F.col("coded"), key).alias("back"))


@query("f30_found_in_source", sql(r"SELECT ref_id, doi <> '' AS doi_found, regexp_matches(raw, '\b' || year || '\b') AS year_found FROM refs", "refs"))
def f30(spark, d):
    spaced = F.regexp_replace("doi", "/", " / ")
    return references(spark, d).select("ref_id", T.found_without_spaces(spaced, F.col("raw")).alias("doi_found"), F.col("raw").rlike(r"\b(?:19|20)\d{2}\b").alias("year_found"))


@query("s16_file_type", sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'pdf' ELSE 'latex' END AS file_type FROM logs", "logs"))
def s16(spark, d):
    return logs(spark, d).select("id", T.file_type(F.col("file_name")).alias("file_type"))
