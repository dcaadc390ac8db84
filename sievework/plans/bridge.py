"""Bibliographic views over the given tables, written twice: as DataFrames and as SQL.

A title is by definition the first 120 characters of a document, a log's title the first 60, and names are its
first words; twenty documents in a row are a manuscript's. Operators see these columns whole.

Even documents are notice records, odd ones cited references; screening logs, manuscripts, projects,
uploads and audit rows come from documents, orders, customers and events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NATURES = ("Retraction", "Correction", "Expression of concern", "Reinstatement")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(i: int) -> Column:
    return F.coalesce(F.try_element_at(F.col("ws"), F.lit(i)), F.lit(""))


#: Words that the views use, and characters that hold so many in most texts.
WORDS_USED, FRONT = 12, 400


def _with_words(docs: DataFrame) -> DataFrame:
    """Column ws: the words of a text, its first WORDS_USED at least. Only texts whose front holds fewer are read on to their end."""
    found = lambda text: F.regexp_extract_all(text, F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    front = docs.withColumn("_front", found(F.left(F.coalesce("text", F.lit("")), F.lit(FRONT))))
    # The last word of a front may be cut. The words come out of a generator, which no filter on them is pushed
    # through: else they would be looked for again in every such filter.
    words = F.when(F.size("_front") > WORDS_USED, F.col("_front")).otherwise(found(F.coalesce("text", F.lit(""))))
    return front.select(*docs.columns, F.explode(F.array(words)).alias("ws"))


def _identifiers(docs: DataFrame, kind: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return docs.select(
        "*",
        F.substring(F.coalesce("text", F.lit("")), 1, 120).alias("title"),
        F.concat(_word(1), F.lit(" "), _word(2), F.lit(";"), _word(3), F.lit(" "), _word(4)).alias("author"),
        F.concat(F.lit("journal "), (F.col("doc_id") % 7).cast("string")).alias("journal"),
        (F.col("doc_id") % 20 + 2000).cast("int").alias("year"),
        F.concat(F.lit("10."), (F.col("doc_id") % 97 + 1000).cast("string"), F.lit(f"/{kind}"), number).alias("own_doi"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices: one row per even document."""
    docs = _identifiers(_with_words(table(spark, sf_dir, "documents").where("doc_id % 2 = 0")), "d")
    natures = F.array(*(F.lit(n) for n in NATURES))
    return docs.select(
        F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("record_id"),
        "title", "author", "journal", "year",
        F.concat(F.col("source"), F.lit(" institute "), F.col("lang"), F.lit(";"), F.lit("academy "), F.col("lang")).alias("institution"),
        F.col("own_doi").alias("original_doi"),
        F.replace("own_doi", F.lit("/d"), F.lit("/r")).alias("retraction_doi"),
        (F.col("doc_id") + 1000000).cast("string").alias("original_pmid"),
        F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") + 2000000).cast("string")).otherwise("").alias("retraction_pmid"),
        F.element_at(natures, (F.col("doc_id") % 8 / 2 + 1).cast("int")).alias("nature"),
        F.concat(F.lit("1/15/"), F.col("year").cast("string"), F.lit(" 0:00")).alias("original_date"),
    )


RECORDS_SQL = """records AS (
    SELECT 'D' || lpad(doc_id::VARCHAR, 8, '0') AS record_id, substring(coalesce(text, ''), 1, 120) AS title,
           coalesce(ws[1], '') || ' ' || coalesce(ws[2], '') || ';' || coalesce(ws[3], '') || ' ' || coalesce(ws[4], '') AS author,
           'journal ' || (doc_id % 7) AS journal, (2000 + doc_id % 20)::INT AS year,
           source || ' institute ' || lang || ';academy ' || lang AS institution,
           '10.' || (1000 + doc_id % 97) || '/d' || doc_id AS original_doi, '10.' || (1000 + doc_id % 97) || '/r' || doc_id AS retraction_doi,
           (doc_id + 1000000)::VARCHAR AS original_pmid, CASE WHEN doc_id % 6 = 0 THEN (doc_id + 2000000)::VARCHAR ELSE '' END AS retraction_pmid,
           ['Retraction', 'Correction', 'Expression of concern', 'Reinstatement'][(doc_id % 8) // 2 + 1] AS nature,
           '1/15/' || (2000 + doc_id % 20) || ' 0:00' AS original_date
    FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}') AS ws FROM documents) WHERE doc_id % 2 = 0
)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited references: one row per odd document; every fiftieth cites a notice by identifier."""
    docs = _identifiers(_with_words(table(spark, sf_dir, "documents").where("doc_id % 2 = 1")), "x")
    before = F.col("doc_id") - 1
    cited = F.concat(F.lit("10."), (before % 97 + 1000).cast("string"), F.lit("/d"), before.cast("string"))
    doi = F.when(F.floor(F.col("doc_id") / 2) % 50 == 0, cited).otherwise("")
    pmid = F.when(F.floor(F.col("doc_id") / 2) % 75 == 1, (before + 1000000).cast("string")).otherwise("")
    initial = lambda i: F.upper(F.substring(_word(i), 1, 1))
    capital = lambda i: F.concat(initial(i), F.lower(F.substr(_word(i), F.lit(2))))
    title = F.initcap(F.lower(F.array_join(F.slice("ws", 5, 8), " ")))
    raw = F.concat(
        capital(1), F.lit(", "), initial(2), F.lit("., "), capital(3), F.lit(", "), initial(4), F.lit(". ("), F.col("year").cast("string"), F.lit("). "),
        title, F.lit(". Journal of "), capital(6), F.lit(", "), (F.col("doc_id") % 40).cast("string"), F.lit(". "),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi, F.lit("."))).otherwise(""),
        F.when(pmid != "", F.concat(F.lit(" PMID: "), pmid)).otherwise(""),
    )
    return docs.select(F.col("doc_id").alias("ref_id"), F.floor(F.col("doc_id") / 20).cast("long").alias("ms_id"), "title", "author", "journal", "year", doi.alias("doi"), pmid.alias("pmid"), raw.alias("raw"))


REFERENCES_SQL = """refs AS (
    SELECT doc_id AS ref_id, doc_id // 20 AS ms_id, title, author, journal, year, doi, pmid,
           upper(w1[1:1]) || lower(w1[2:]) || ', ' || upper(w2[1:1]) || '., ' || upper(w3[1:1]) || lower(w3[2:]) || ', ' || upper(w4[1:1]) || '. (' || year || '). '
           || coalesce(array_to_string(list_transform(ws[5:12], lambda w: upper(w[1:1]) || lower(w[2:])), ' '), '')
           || '. Journal of ' || upper(w6[1:1]) || lower(w6[2:]) || ', ' || (doc_id % 40) || '. '
           || CASE WHEN doi <> '' THEN 'https://doi.org/' || doi || '.' ELSE '' END
           || CASE WHEN pmid <> '' THEN ' PMID: ' || pmid ELSE '' END AS raw
    FROM (
        SELECT *, substring(coalesce(text, ''), 1, 120) AS title, w1 || ' ' || w2 || ';' || w3 || ' ' || w4 AS author,
               'journal ' || (doc_id % 7) AS journal, (2000 + doc_id % 20)::INT AS year,
               CASE WHEN (doc_id // 2) % 50 = 0 THEN '10.' || (1000 + (doc_id - 1) % 97) || '/d' || (doc_id - 1) ELSE '' END AS doi,
               CASE WHEN (doc_id // 2) % 75 = 1 THEN (doc_id - 1 + 1000000)::VARCHAR ELSE '' END AS pmid
        FROM (
            SELECT *, coalesce(ws[1], '') AS w1, coalesce(ws[2], '') AS w2, coalesce(ws[3], '') AS w3, coalesce(ws[4], '') AS w4, coalesce(ws[6], '') AS w6
            FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}') AS ws FROM documents) WHERE doc_id % 2 = 1
        )
    )
)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening logs: a row per document that has an event of its number."""
    docs, labels, events = (table(spark, sf_dir, n) for n in ("documents", "labels", "events"))
    label = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "REVIEW").otherwise("PASS")
    joined = docs.join(label, "doc_id", "left").join(events.select(F.col("event_id").alias("doc_id"), "ts", "user_id"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("w"), (F.col("doc_id") % 5).cast("string"))).alias("workspace_id"),
        F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".TEX")).alias("file_name"),
        F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), verdict.alias("verdict"), F.col("ts").alias("created_at"),
        (F.col("doc_id") % 4).alias("n_refs"), (F.col("doc_id") % 3).alias("n_authors"), (F.col("doc_id") % 2).alias("n_possible"),
    )


LOGS_SQL = """logs AS (
    SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN user_id END AS user_id, CASE WHEN doc_id % 3 = 0 THEN 'w' || (doc_id % 5) END AS workspace_id,
           'file_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.TEX' END AS file_name, substring(coalesce(text, ''), 1, 60) AS title,
           CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict, ts AS created_at,
           doc_id % 4 AS n_refs, doc_id % 3 AS n_authors, doc_id % 2 AS n_possible
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
    JOIN (SELECT event_id AS doc_id, ts, user_id FROM events) USING (doc_id)
)"""


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "parsing").otherwise("error")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), (F.col("o_orderkey") % 5 == 0).alias("archived"),
        F.col("o_orderdate").alias("created_at"), F.concat(F.lit("h"), (F.col("o_orderkey") % 500).cast("string")).alias("sha256"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("w"), (F.col("o_orderkey") % 6).cast("string"))).alias("workspace_id"), (F.col("o_custkey") % 40).alias("user_id"),
        F.when(status == "done", F.element_at(F.array(F.lit("PASS"), F.lit("REVIEW"), F.lit("FAIL")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("verdict"),
    )


MANUSCRIPTS_SQL = """manuscripts AS (
    SELECT o_orderkey AS id, o_custkey AS project_id, status, o_orderkey % 5 = 0 AS archived, o_orderdate AS created_at, 'h' || (o_orderkey % 500) AS sha256,
           CASE WHEN o_orderkey % 4 = 0 THEN 'w' || (o_orderkey % 6) END AS workspace_id, o_custkey % 40 AS user_id,
           CASE WHEN status = 'done' THEN ['PASS', 'REVIEW', 'FAIL'][o_orderkey % 3 + 1] END AS verdict
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'parsing' ELSE 'error' END AS status FROM orders)
)"""

VIEWS = {"records": RECORDS_SQL, "refs": REFERENCES_SQL, "logs": LOGS_SQL, "manuscripts": MANUSCRIPTS_SQL}


def sql(body: str, *views: str) -> str:
    """A statement over the views named; `body` may begin with further ones and a comma after each."""
    return "WITH " + ",\n".join(VIEWS[v] for v in views) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
