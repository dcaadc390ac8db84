"""Queries over screening logs, manuscripts, audit rows and users (A, J, P, R, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import paging
from ..operators.ordering import numbered
from .bridge import logs, manuscripts, records, references, sql, table
from .registry import query
from .scalars import N, prefix_match, search_terms

AS_OF = "2024-01-31 00:00:00"


def now() -> Column:
    """The instant that recency is measured from: a parameter, never the clock."""
    return F.lit(AS_OF).cast("timestamp")


def log_filter(df: DataFrame, verdicts=None, since=None, until=None, user_id=..., workspace_id=...) -> DataFrame:
    """Conjunction of optional filters; ... means any, None means missing."""
    parts = []
    if verdicts:
        parts.append(F.col("verdict").isin(*verdicts))
    if since:
        parts.append(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        parts.append(F.col("created_at") <= F.lit(until).cast("timestamp"))
    for name, value in (("user_id", user_id), ("workspace_id", workspace_id)):
        if value is not ...:
            parts.append(F.col(name).isNull() if value is None else F.col(name) == value)
    return df.where(reduce(Column.__and__, parts)) if parts else df


@query("a01_filtered_count", sql("SELECT count(*) AS n FROM logs WHERE verdict IN ('FAIL', 'REVIEW') AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND workspace_id IS NULL", "logs"))
def a01(spark, d):
    return log_filter(logs(spark, d), ["FAIL", "REVIEW"], since="2024-01-02 00:00:00", workspace_id=None).agg(F.count("*").alias("n"))


_STATS = "count(*) AS total, count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'REVIEW') AS n_review, count(*) FILTER (verdict = 'FAIL') AS n_fail"


@query("a02_log_stats", sql(f"SELECT {_STATS}, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS last_30d FROM logs", "logs"))
def a02(spark, d):
    n = lambda v: F.count_if(F.col("verdict") == v)
    return logs(spark, d).agg(F.count("*").alias("total"), n("PASS").alias("n_pass"), n("REVIEW").alias("n_review"), n("FAIL").alias("n_fail"), F.count_if(F.col("created_at") >= now() - F.expr("INTERVAL 30 DAYS")).alias("last_30d"))


@query("a03_dashboard", sql(f"SELECT workspace_id, {_STATS}, count(*) FILTER (status = 'parsing') AS n_parsing, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (created_at >= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY) AS last_7d FROM manuscripts GROUP BY workspace_id", "manuscripts"))
def a03(spark, d):
    n = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    week = F.count_if(F.col("created_at") >= F.lit("1998-01-01").cast("timestamp") - F.expr("INTERVAL 7 DAYS"))
    return manuscripts(spark, d).groupBy("workspace_id").agg(F.count("*").alias("total"), n("verdict", "PASS").alias("n_pass"), n("verdict", "REVIEW").alias("n_review"), n("verdict", "FAIL").alias("n_fail"), n("status", "parsing").alias("n_parsing"), n("status", "error").alias("n_error"), week.alias("last_7d"))


@query("a04_project_counts", sql("SELECT c_custkey AS project_id, c_name AS name, (SELECT count(*) FROM manuscripts m WHERE m.project_id = c_custkey AND NOT archived) AS n FROM customer", "manuscripts"))
def a04(spark, d):
    counts = manuscripts(spark, d).where("NOT archived").groupBy("project_id").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name")).join(counts, "project_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("a05_active_counts", sql("SELECT user_id, count(*) FILTER (status = 'done' AND NOT archived) AS n_active, count(DISTINCT workspace_id) AS n_workspaces FROM manuscripts GROUP BY user_id", "manuscripts"))
def a05(spark, d):
    return manuscripts(spark, d).groupBy("user_id").agg(F.count_if((F.col("status") == "done") & ~F.col("archived")).alias("n_active"), F.countDistinct("workspace_id").alias("n_workspaces"))


@query("a08_hits_per_log", sql("SELECT id, n_refs + n_authors + n_possible AS hits FROM logs", "logs"))
def a08(spark, d):
    return logs(spark, d).select("id", (F.col("n_refs") + F.col("n_authors") + F.col("n_possible")).alias("hits"))


@query("a09_breakdown", sql("""SELECT dimension, value, count(*) AS n, sum(hits)::BIGINT AS hits FROM (
SELECT unnest(['verdict', 'workspace', 'type']) AS dimension, unnest([verdict, coalesce(workspace_id, '-'), right(lower(file_name), 3)]) AS value, n_refs + n_authors AS hits FROM logs) GROUP BY ALL""", "logs"))
def a09(spark, d):
    """Histograms over several dimensions in one pass."""
    dims = {"verdict": F.col("verdict"), "workspace": F.coalesce("workspace_id", F.lit("-")), "type": F.lower(F.substring("file_name", -3, 3))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in dims.items()))).alias("x")
    rows = logs(spark, d).select(each, (F.col("n_refs") + F.col("n_authors")).alias("h")).groupBy("x.dimension", "x.value")
    return rows.agg(F.count("*").alias("n"), F.sum("h").alias("hits"))


@query("a10_presence", sql("SELECT verdict, CASE WHEN count(*) FILTER (n_refs > 0) > 0 THEN round(100.0 * count(*) FILTER (n_refs > 0 AND n_authors > 0) / count(*) FILTER (n_refs > 0), 1)::DOUBLE END AS pct FROM logs GROUP BY verdict", "logs"))
def a10(spark, d):
    base, hit = F.count_if(F.col("n_refs") > 0), F.count_if((F.col("n_refs") > 0) & (F.col("n_authors") > 0))
    return logs(spark, d).groupBy("verdict").agg(F.when(base > 0, F.round(100.0 * hit / base, 1)).alias("pct"))


_SIDES = "sides AS (SELECT CASE WHEN id % 2 = 0 THEN 'before' ELSE 'after' END AS side, * FROM logs)"


@query("a11_delta_table", sql(f"""{_SIDES}, m AS (SELECT side, unnest(['rows', 'refs', 'authors']) AS metric, unnest([count(*), sum(n_refs), sum(n_authors)])::BIGINT AS v FROM sides GROUP BY side)
SELECT metric, max(v) FILTER (side = 'before') AS before, max(v) FILTER (side = 'after') AS after, max(v) FILTER (side = 'after') - max(v) FILTER (side = 'before') AS delta FROM m GROUP BY metric""", "logs"))
def a11(spark, d):
    side = F.when(F.col("id") % 2 == 0, "before").otherwise("after")
    sums = logs(spark, d).groupBy(side.alias("side")).agg(F.count("*").alias("rows"), F.sum("n_refs").alias("refs"), F.sum("n_authors").alias("authors"))
    long = sums.unpivot("side", ["rows", "refs", "authors"], "metric", "v")
    v = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    return long.groupBy("metric").agg(v("before").alias("before"), v("after").alias("after"), (v("after") - v("before")).alias("delta"))


@query("a12_pipeline_diff", sql("SELECT CASE WHEN ref_id % 4 = 1 THEN 'left' ELSE 'right' END AS side, count(*) AS n, round(avg((doi <> '')::INT), 6) AS doi_rate, round(avg((pmid <> '')::INT), 6) AS pmid_rate, round(avg(length(title)), 6) AS title_length FROM refs GROUP BY 1", "refs"))
def a12(spark, d):
    rate = lambda c: F.round(F.avg((F.col(c) != "").cast("int")), 6)
    side = F.when(F.col("ref_id") % 4 == 1, "left").otherwise("right").alias("side")
    return references(spark, d).groupBy(side).agg(F.count("*").alias("n"), rate("doi").alias("doi_rate"), rate("pmid").alias("pmid_rate"), F.round(F.avg(F.length("title")), 6).alias("title_length"))


_TRUTH = """truth AS (SELECT r.ref_id, r.ms_id, list_distinct(string_split(r.author, ';')) AS want, list_distinct(string_split(n.author, ';')) AS got, r.doi AS doi_want, CASE WHEN r.ref_id % 3 = 0 THEN n.original_doi ELSE '' END AS doi_got
FROM refs r JOIN records n ON n.record_id = 'D' || lpad((r.ref_id - 1)::VARCHAR, 8, '0')),
paper AS (SELECT *, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, got))::DOUBLE / len(want) END AS author_recall, CASE WHEN doi_want = '' THEN 1.0 WHEN doi_want = doi_got THEN 1.0 ELSE 0.0 END::DOUBLE AS doi_recall, len(list_filter(got, lambda x: NOT list_contains(want, x)))::BIGINT AS n_extra FROM truth)"""


def papers(spark, d) -> DataFrame:
    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    both = references(spark, d).withColumn("record_id", key).join(records(spark, d).select("record_id", F.col("author").alias("other"), "original_doi"), "record_id")
    want, got = F.array_distinct(F.split("author", ";")), F.array_distinct(F.split("other", ";"))
    doi_got = F.when(F.col("ref_id") % 3 == 0, F.col("original_doi")).otherwise("")
    recall = F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, got)) / F.size(want))
    return both.select("ref_id", "ms_id", recall.alias("author_recall"), F.when((F.col("doi") == "") | (F.col("doi") == doi_got), 1.0).otherwise(0.0).alias("doi_recall"), F.size(F.array_except(got, want)).cast("long").alias("n_extra"))


@query("a13_recall", sql(f"{_TRUTH}\nSELECT ref_id, round(author_recall, 6) AS author_recall, doi_recall, n_extra FROM paper", "records", "refs"))
def a13(spark, d):
    return papers(spark, d).select("ref_id", F.round("author_recall", 6).alias("author_recall"), "doi_recall", "n_extra")


@query("a14_findings", sql(f"{_TRUTH}\nSELECT finding, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN author_recall < 0.8 THEN 'author_recall' END, CASE WHEN doi_recall < 0.6 THEN 'doi_recall' END, CASE WHEN n_extra > 1 THEN 'extra' END], lambda x: x IS NOT NULL)) AS finding FROM paper) GROUP BY finding", "records", "refs"))
def a14(spark, d):
    """Findings of each paper (C18) and their histogram."""
    kinds = F.array_compact(F.array(F.when(F.col("author_recall") < 0.8, "author_recall"), F.when(F.col("doi_recall") < 0.6, "doi_recall"), F.when(F.col("n_extra") > 1, "extra")))
    return papers(spark, d).select(F.explode(kinds).alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


@query("a15_layout_groups", sql(f"{_TRUTH}\nSELECT ms_id % 2 = 0 AS single, count(*) AS n, round(avg(author_recall), 6) AS author_recall, count(*) FILTER (doi_recall < 0.6) AS n_poor FROM paper GROUP BY 1", "records", "refs"))
def a15(spark, d):
    return papers(spark, d).groupBy((F.col("ms_id") % 2 == 0).alias("single")).agg(F.count("*").alias("n"), F.round(F.avg("author_recall"), 6).alias("author_recall"), F.count_if(F.col("doi_recall") < 0.6).alias("n_poor"))


@query("j09_audit_users", "SELECT event_id, event_type AS action, c_name AS username FROM events LEFT JOIN customer ON user_id = c_custkey ORDER BY event_id DESC LIMIT 500")
def j09(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    newest = table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(500)  # the limit first: the join adds no row
    return newest.join(users, "user_id", "left").select("event_id", F.col("event_type").alias("action"), "username")


@query("j10_user_workspaces", "SELECT n_nationkey AS workspace_id, n_name AS name, s_suppkey AS user_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY n_regionkey, n_nationkey)::INT AS pos FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey")
def j10(spark, d):
    spaces = table(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_nationkey") % 5).alias("k"))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("k", "workspace_id"))
    return members.join(spaces, "k").withColumn("pos", pos).select("workspace_id", "name", "user_id", "pos")


@query("j11_member_order", "SELECT c_nationkey AS workspace_id, c_custkey AS user_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_mktsegment = 'MACHINERY' DESC, c_custkey)::INT AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j11(spark, d):
    role = F.col("c_mktsegment")
    order = Window.partitionBy("c_nationkey").orderBy((role == "BUILDING").desc(), (role == "MACHINERY").desc(), "c_custkey")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("user_id"), F.row_number().over(order).alias("pos"))


@query("j12_unprotected_uploads", sql("SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND event_id NOT IN (SELECT id FROM manuscripts WHERE status IN ('parsing', 'done'))", "manuscripts"))
def j12(spark, d):
    """Uploads due for deletion (P16) that no running or finished manuscript protects."""
    kept = manuscripts(spark, d).where(F.col("status").isin("parsing", "done")).select(F.col("id").alias("event_id"))
    return table(spark, d, "events").where("ts <= timestamp '2024-01-20'").select("event_id", "user_id").join(kept, "event_id", "left_anti")


@query("j13_revoked_shares", sql("SELECT event_id FROM events WHERE event_id IN (SELECT id FROM manuscripts WHERE workspace_id = 'w2')", "manuscripts"))
def j13(spark, d):
    gone = manuscripts(spark, d).where("workspace_id = 'w2'").select(F.col("id").alias("event_id"))
    return table(spark, d, "events").select("event_id").join(gone, "event_id", "left_semi")


@query("j14_log_search", sql("SELECT id, verdict FROM logs WHERE len(list_filter(string_split(" + N.format("file_name || ' ' || title") + ", ' '), lambda w: starts_with(w, 'th'))) > 0 AND len(list_filter(string_split(" + N.format("file_name || ' ' || title") + ", ' '), lambda w: starts_with(w, 'file'))) > 0", "logs"))
def j14(spark, d):
    words = F.split(T.normalize_text(F.concat_ws(" ", "file_name", "title")), " ")
    return logs(spark, d).where(prefix_match(words, search_terms(F.lit('TH* "file')))).select("id", "verdict")


@query("j15_ghosts", sql("SELECT id FROM manuscripts WHERE status = 'done' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3)", "manuscripts"))
def j15(spark, d):
    """Finished manuscripts whose folder is not in the listing."""
    there = table(spark, d, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("id"))
    return manuscripts(spark, d).where("status = 'done'").select("id").join(there, "id", "left_anti")


@query("j16_run_pairs", sql("SELECT a.project_id, a.id AS before_id, b.id AS after_id FROM manuscripts a JOIN manuscripts b ON a.project_id = b.project_id AND a.sha256 = b.sha256 AND a.id < b.id WHERE a.status = 'done' AND b.status = 'done'", "manuscripts"))
def j16(spark, d):
    done = manuscripts(spark, d).where("status = 'done'").select("id", "project_id", "sha256")
    a, b = done.withColumnRenamed("id", "before_id"), done.withColumnRenamed("id", "after_id")
    return a.join(b, ["project_id", "sha256"]).where("before_id < after_id").select("project_id", "before_id", "after_id")


@query("j17_truth_join", sql("SELECT doc_id, coalesce(verdict, 'missing') AS parsed, coalesce(quality, -1) AS truth FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT id AS doc_id, verdict FROM logs WHERE verdict <> 'REVIEW') USING (doc_id)", "logs"))
def j17(spark, d):
    truth = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    parsed = logs(spark, d).where("verdict != 'REVIEW'").select(F.col("id").alias("doc_id"), "verdict")
    rows = table(spark, d, "documents").select("doc_id").join(truth, "doc_id", "left").join(parsed, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("verdict", F.lit("missing")).alias("parsed"), F.coalesce("q", F.lit(-1)).alias("truth"))


@query("j18_user_labels", sql("SELECT id, coalesce(c_name, user_id::VARCHAR, '-') AS user_label FROM logs LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON user_id = c_custkey", "logs"))
def j18(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return logs(spark, d).join(users, "user_id", "left").select("id", F.coalesce("c_name", F.col("user_id").cast("string"), F.lit("-")).alias("user_label"))


@query("p01_canonical_records", sql("SELECT record_id, original_doi AS doi, original_pmid AS pmid, trim(title) AS title FROM records", "records"))
def p01(spark, d):
    raw = records(spark, d).withColumn("doi", F.concat(F.lit(" https://doi.org/"), F.upper("original_doi"), F.lit(". "))).withColumn("pmid", F.concat(F.lit(" PMID"), "original_pmid"))
    return raw.select("record_id", T.normalize_doi(F.col("doi")).alias("doi"), T.normalize_pmid(F.col("pmid")).alias("pmid"), F.trim("title").alias("title"))


@query("p02_searchable_text", sql("SELECT record_id, " + N.format("concat_ws(' ', title, journal, author, institution, nature)") + " AS searchable FROM records", "records"))
def p02(spark, d):
    return records(spark, d).select("record_id", T.normalize_text(F.concat_ws(" ", "title", "journal", "author", "institution", "nature")).alias("searchable"))


@query("p03_notice_types", sql("SELECT record_id, nature FROM records WHERE nature IN ('Retraction', 'Correction')", "records"))
def p03(spark, d):
    asked = list(dict.fromkeys(t.strip() for t in ("Retraction", " Correction ", "", "Retraction") if t.strip()))  # P04
    rows = records(spark, d).select("record_id", "nature")
    return rows.where(F.col("nature").isin(asked)) if asked else rows


@query("p04_type_inputs", sql(r"SELECT record_id, nature || CASE WHEN nature <> 'Correction' THEN '|Correction' ELSE '' END || CASE WHEN trim(title) <> '' THEN '|' || regexp_replace(title, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') ELSE '' END AS types FROM records", "records"))
def p04(spark, d):
    """Types as asked for, with blanks, white space around them and repeats, in order."""
    nature = F.col("nature")
    asked = F.array(F.lit(" "), F.concat(F.lit("\t"), nature, F.lit(" \n")), F.lit("Correction"), F.lit(None).cast("string"), nature, F.lit(""), F.concat(F.lit(" "), F.col("title"), F.lit(" ")))
    return records(spark, d).select("record_id", F.array_join(T.distinct_values(asked), "|").alias("types"))


@query("p05_clamped_limit", "SELECT event_id, greatest(1, least(50, trunc(value)))::INT AS n FROM events")
def p05(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(F.col("value"), F.lit(10.0)).cast("int"))).alias("n"))


@query("p23_request_filters", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PASS|FAIL' WHEN 1 THEN 'REVIEW' END AS verdicts,
       CASE event_id % 5 WHEN 4 THEN 50 ELSE greatest(1, least(200, trunc(value - 20))) END::INT AS n, CASE WHEN event_id % 3 > 0 THEN greatest(0, user_id - 7) END AS skipped, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS cursor FROM events""")
def p23(spark, d):
    """Requests made of events: what of their raw verdicts, limits, offsets and cursors counts."""
    k = F.col("event_id")
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    verdicts = F.when(k % 4 == 0, words("PASS", "pass", "FAIL")).when(k % 4 == 1, words("", "REVIEW")).when(k % 4 == 2, words("OTHER"))
    limit = F.when(k % 5 == 4, "many").otherwise((F.col("value") - 20).cast("string"))
    cursor = F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))).when(k % 3 == 1, "")
    asked = table(spark, d, "events").select("event_id", paging.request_filters(verdicts, limit, (F.col("user_id") - 7).cast("string"), cursor).alias("f"))
    return asked.select("event_id", F.array_join("f.verdicts", "|").alias("verdicts"), F.col("f.limit").alias("n"), F.col("f.offset").alias("skipped"), "f.cursor")


@query("p07_ordered_fetch", sql("SELECT record_id, pos::INT AS pos, title FROM records JOIN (SELECT unnest(ids) AS record_id, generate_subscripts(ids, 1) AS pos FROM (SELECT list('D' || lpad(item_id::VARCHAR, 8, '0') ORDER BY item_id DESC) AS ids FROM benchmark)) USING (record_id)", "records"))
def p07(spark, d):
    """Records by id, in the caller's order."""
    asked = numbered(table(spark, d, "benchmark").select("item_id"), [F.col("item_id").desc()], "pos")
    asked = asked.select(F.concat(F.lit("D"), F.lpad(F.col("item_id").cast("string"), 8, "0")).alias("record_id"), F.col("pos").cast("int").alias("pos"))
    return records(spark, d).join(asked, "record_id").select("record_id", "pos", "title")


@query("p08_substring", sql("SELECT record_id FROM records WHERE contains(" + N.format("institution") + ", 'src3')", "records"))
def p08(spark, d):
    return records(spark, d).where(T.normalize_text(F.col("institution")).contains("src3")).select("record_id")


@query("p09_log_filters", sql("SELECT id FROM logs WHERE user_id IS NULL AND verdict IN ('PASS', 'FAIL') AND created_at >= TIMESTAMP '2024-01-01 06:00:00' AND created_at <= TIMESTAMP '2024-01-03 00:00:00'", "logs"))
def p09(spark, d):
    return log_filter(logs(spark, d), ["PASS", "FAIL"], "2024-01-01 06:00:00", "2024-01-03 00:00:00", user_id=None).select("id")


@query("p10_tenant_scope", sql("SELECT id FROM manuscripts WHERE user_id = 7 AND workspace_id IS NULL AND NOT archived", "manuscripts"))
def p10(spark, d):
    return manuscripts(spark, d).where((F.col("user_id") == 7) & F.col("workspace_id").isNull() & ~F.col("archived")).select("id")


@query("p11_user_search", "SELECT c_custkey FROM customer WHERE contains(lower(coalesce(c_name, '')), '#00000001') OR contains(lower(coalesce(c_mktsegment, '')), 'build')")
def p11(spark, d):
    has = lambda c, q: F.lower(F.coalesce(c, F.lit(""))).contains(q.lower())
    return table(spark, d, "customer").where(has("c_name", "#00000001") | has("c_mktsegment", "Build")).select("c_custkey")


@query("p12_access", sql("""SELECT id, can_access, can_delete FROM (SELECT m.id, m.user_id = s_suppkey OR k IS NOT NULL AS can_access, m.user_id = s_suppkey OR coalesce(k, 1) = 0 AS can_delete
FROM manuscripts m JOIN supplier ON s_suppkey = m.id % 50 + 1 LEFT JOIN (SELECT 'w' || (n_nationkey % 6) AS w, n_nationkey AS u, min(n_regionkey) AS k FROM nation GROUP BY ALL) ON w = m.workspace_id AND u = s_nationkey)""", "manuscripts"))
def p12(spark, d):
    """May a user read, and delete, a manuscript: its uploader, or a member (an owner) of its workspace."""
    members = table(spark, d, "nation").groupBy(F.concat(F.lit("w"), (F.col("n_nationkey") % 6).cast("string")).alias("workspace_id"), F.col("n_nationkey").alias("s_nationkey")).agg(F.min("n_regionkey").alias("k"))
    asked = manuscripts(spark, d).withColumn("s_suppkey", F.col("id") % 50 + 1).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(members, ["workspace_id", "s_nationkey"], "left")
    own = F.col("user_id") == F.col("s_suppkey")
    return asked.select("id", (own | F.col("k").isNotNull()).alias("can_access"), (own | (F.coalesce("k", F.lit(1)) == 0)).alias("can_delete"))


@query("p14_live_tokens", "SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-31'")
def p14(spark, d):
    return table(spark, d, "events").where((F.col("event_type") != "error") & (F.col("ts") + F.expr("INTERVAL 7 DAYS") >= now())).select("event_id")


@query("p15_recency", "SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS last_7d, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS last_30d FROM events GROUP BY user_id")
def p15(spark, d):
    recent = lambda days: F.count_if(F.col("ts") >= now() - F.expr(f"INTERVAL {days} DAYS"))
    return table(spark, d, "events").groupBy("user_id").agg(recent(7).alias("last_7d"), recent(30).alias("last_30d"))


@query("p18_audit_allowlist", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def p18(spark, d):
    """Only allowed keys of an audit detail stay."""
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("page", "file_name", "verdict"))
    return table(spark, d, "events").select("event_id", F.try_element_at(kept, F.lit("page")).alias("page"))


@query("p21_user_lookup", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def p21(spark, d):
    return table(spark, d, "customer").where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007"))).select("c_custkey")


@query("p22_batch_defaults", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 9 END, 25) AS lim FROM events")
def p22(spark, d):
    own = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9)
    return table(spark, d, "events").select("event_id", F.coalesce(own, F.lit(25).cast("long")).alias("lim"))


@query("r09_offset_page", sql("SELECT id, created_at FROM manuscripts WHERE NOT archived ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", "manuscripts"))
def r09(spark, d):
    return manuscripts(spark, d).where("NOT archived").orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(100).limit(50).select("id", "created_at")


@query("r10_keyset_page", sql("""SELECT id, verdict FROM logs WHERE (created_at, id) < (SELECT (created_at, id) FROM logs ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 99) ORDER BY created_at DESC, id DESC LIMIT 51""", "logs"))
def r10(spark, d):
    """The page after the hundredth row, by its cursor, with one row more to tell whether there is a next."""
    rows = logs(spark, d)
    last = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(100).orderBy("created_at", "id").limit(1).select("created_at", "id").first()
    cursor = paging.encode_cursor(last["created_at"], last["id"]) if last else None
    return paging.keyset_page(rows, cursor, 50).select("id", "verdict")


@query("r12_recent", sql("SELECT id FROM manuscripts WHERE NOT archived ORDER BY created_at DESC, id DESC LIMIT 5", "manuscripts"))
def r12(spark, d):
    return manuscripts(spark, d).where("NOT archived").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(5).select("id")


@query("r13_first_per_group", sql("SELECT status, id FROM manuscripts QUALIFY row_number() OVER (PARTITION BY status ORDER BY id) <= 20", "manuscripts"))
def r13(spark, d):
    order = Window.partitionBy("status").orderBy("id")
    return manuscripts(spark, d).withColumn("at", F.row_number().over(order)).where("at <= 20").select("status", "id")


@query("r14_worst", sql(f"{_TRUTH}\nSELECT ref_id, round(author_recall, 6) AS author_recall FROM paper ORDER BY paper.author_recall, ref_id LIMIT 20", "records", "refs"))
def r14(spark, d):
    return papers(spark, d).orderBy("author_recall", "ref_id").limit(20).select("ref_id", F.round("author_recall", 6).alias("author_recall"))


@query("r15_largest_deltas", "SELECT o_custkey AS id, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END), 2) AS delta FROM orders GROUP BY o_custkey ORDER BY abs(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END)) DESC, id LIMIT 30")
def r15(spark, d):
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(signed).alias("x"))
    return sums.orderBy(F.abs("x").desc(), "id").limit(30).select("id", F.round("x", 2).alias("delta"))


@query("r16_newest_same_hash", sql("SELECT coalesce(workspace_id, '') AS scope, sha256, id FROM manuscripts WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY coalesce(workspace_id, ''), sha256 ORDER BY created_at DESC, id DESC) = 1", "manuscripts"))
def r16(spark, d):
    done = manuscripts(spark, d).where("status = 'done'")
    return done.groupBy(F.coalesce("workspace_id", F.lit("")).alias("scope"), "sha256").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("r21_share_list", "SELECT user_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def r21(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").where("event_type = 'click'").withColumn("at", F.row_number().over(order)).where("at <= 50").select("user_id", "event_id")


@query("r22_two_slices", sql("SELECT archived, id FROM manuscripts QUALIFY row_number() OVER (PARTITION BY archived ORDER BY created_at DESC, id DESC) <= CASE WHEN archived THEN 30 ELSE 80 END", "manuscripts"))
def r22(spark, d):
    order = Window.partitionBy("archived").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return manuscripts(spark, d).withColumn("at", F.row_number().over(order)).where("at <= 80").where(F.col("at") <= F.when(F.col("archived"), 30).otherwise(80)).select("archived", "id")


_KEYED = """keyed AS (SELECT ref_id, ms_id, ref_id % 4 AS source_rank, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN pmid <> '' THEN 'pmid:' || pmid WHEN trim(title) <> '' THEN 't:' || regexp_replace(trim(lower(title)), '[ \\t\\n\\r\\f]+', ' ', 'g') ELSE 'raw:' || raw[:200] END AS key FROM refs)"""


@query("u05_reference_dedupe", sql(f"{_KEYED}\nSELECT ref_id, key FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank, ref_id) = 1", "refs"))
def u05(spark, d):
    """One reference per identifier, title or raw text; the better source wins, then the earlier one."""
    title = F.regexp_replace(F.trim(F.lower("title")), r"[ \t\n\r\f]+", " ")
    key = F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")).when(F.col("pmid") != "", F.concat(F.lit("pmid:"), "pmid")).when(F.trim("title") != "", F.concat(F.lit("t:"), title)).otherwise(F.concat(F.lit("raw:"), F.substring("raw", 1, 200)))
    keyed = references(spark, d).select("ref_id", key.alias("key"), (F.col("ref_id") % 4).alias("source_rank"))
    return keyed.groupBy("key").agg(F.min_by("ref_id", F.struct("source_rank", "ref_id")).alias("ref_id"))


@query("u06_author_dedupe", sql("""marked AS (SELECT record_id, pos, raw, regexp_replace(raw, '[0-9*]+$', '') AS bare FROM (SELECT record_id, pos, name || CASE WHEN (length(name) + pos) % 2 = 0 THEN '*' ELSE '' END AS raw FROM (SELECT record_id, generate_subscripts(l, 1) AS pos, unnest(l) AS name FROM (SELECT record_id, string_split(author || ';' || author, ';') AS l FROM records))))
SELECT record_id, min(pos)::INT AS pos, arg_max(raw, (CASE WHEN raw <> bare THEN 1000 ELSE 0 END) - pos) AS name FROM marked GROUP BY record_id, bare""", "records"))
def u06(spark, d):
    """Authors once each, at their first place; the spelling with footnote marks wins."""
    each = records(spark, d).select("record_id", F.posexplode(F.split(F.concat("author", F.lit(";"), "author"), ";")).alias("at", "name"))
    pos = F.col("at") + 1
    raw = F.concat("name", F.when((F.length("name") + pos) % 2 == 0, "*").otherwise(""))
    marked = each.select("record_id", pos.alias("pos"), raw.alias("raw")).withColumn("bare", F.regexp_replace("raw", r"[0-9*]+$", ""))
    best = F.max_by("raw", F.struct(F.col("raw") != F.col("bare"), -F.col("pos")))
    return marked.groupBy("record_id", "bare").agg(F.min("pos").alias("pos"), best.alias("name")).drop("bare")


@query("u07_content_duplicates", sql("SELECT n.id, o.id AS duplicate_of FROM manuscripts n LEFT JOIN (SELECT sha256, max(id) AS id FROM manuscripts WHERE status = 'done' GROUP BY sha256) o ON n.sha256 = o.sha256 AND n.status <> 'done' WHERE n.status <> 'done'", "manuscripts"))
def u07(spark, d):
    rows = manuscripts(spark, d)
    done = rows.where("status = 'done'").groupBy("sha256").agg(F.max("id").alias("duplicate_of"))
    return rows.where("status != 'done'").join(done, "sha256", "left").select("id", "duplicate_of")


@query("u09_latest_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def u09(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("p13_active_scope", "SELECT s_suppkey AS user_id, n_name AS workspace FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey % 2 = 0")
def p13(spark, d):
    """The active workspace where the user still is a member, else none (personal)."""
    members = table(spark, d, "nation").where("n_regionkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("workspace"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_nationkey").join(members, "s_nationkey", "left").select("user_id", "workspace")


@query("p16_retention", sql("SELECT id, status FROM manuscripts WHERE status = 'error' AND created_at <= TIMESTAMP '1996-01-01' - INTERVAL 72 HOUR", "manuscripts"))
def p16(spark, d):
    cutoff = F.lit("1996-01-01").cast("timestamp") - F.expr("INTERVAL 72 HOURS")
    return manuscripts(spark, d).where((F.col("status") == "error") & (F.col("created_at") <= cutoff)).select("id", "status")


@query("r11_export_pages", sql("SELECT (k - 1) // 500 AS page, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT id, row_number() OVER (PARTITION BY status ORDER BY id) AS k FROM manuscripts WHERE status = 'parsing') GROUP BY 1", "manuscripts"))
def r11(spark, d):
    """Pages of 500 rows for an export."""
    rows = numbered(manuscripts(spark, d).where("status = 'parsing'").select("id"), ["id"], "k")
    return rows.groupBy(F.floor((F.col("k") - 1) / 500).alias("page")).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("u08_set_difference", sql(f"{_TRUTH}\nSELECT ref_id, coalesce(array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(got, x))), '|'), '') AS missing, coalesce(array_to_string(list_sort(list_filter(got, lambda x: NOT list_contains(want, x))), '|'), '') AS extra FROM truth", "records", "refs"))
def u08(spark, d):
    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    both = references(spark, d).withColumn("record_id", key).join(records(spark, d).select("record_id", F.col("author").alias("other")), "record_id")
    want, got = F.array_distinct(F.split("author", ";")), F.array_distinct(F.split("other", ";"))
    line = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), "|")
    return both.select("ref_id", line(want, got).alias("missing"), line(got, want).alias("extra"))


@query("a17_evidence_fold", sql("SELECT id, array_to_string(list_filter([CASE WHEN n_refs > 0 THEN 'refs' END, CASE WHEN n_authors > 0 THEN 'authors' END, CASE WHEN n_possible > 0 THEN 'possible' END], lambda x: x IS NOT NULL), '|') AS fields, round(n_refs * 0.5 + n_authors * 0.25 + n_possible * 0.125, 3)::DOUBLE AS total FROM logs", "logs"))
def a17(spark, d):
    """Evidence of a row as an array, folded to its sum and its fields."""
    weights = {"refs": 0.5, "authors": 0.25, "possible": 0.125}
    found = F.array_compact(F.array(*(F.when(F.col(f"n_{k}") > 0, F.struct(F.lit(k).alias("field"), (F.col(f"n_{k}") * w).alias("delta"))) for k, w in weights.items())))
    total = F.aggregate("e", F.lit(0.0), lambda sum_, x: sum_ + x["delta"])
    return logs(spark, d).select("id", found.alias("e")).select("id", F.array_join(F.transform("e", lambda x: x["field"]), "|").alias("fields"), F.round(total, 3).alias("total"))
