"""Queries of sources and sinks (S, K) that show their transformations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, refresh, writers
from ..sources.bibtex import bibtex_fields
from ..sources.shared import new_path
from .bridge import logs, records, references, sql, table
from .registry import query


@query("s01_csv_round_trip", sql("SELECT record_id, title, author FROM records", "records"))
def s01(spark, d):
    """Records written as CSV lines, quotes and line breaks included, and read back."""
    options = {"quote": '"', "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"}
    lines = records(spark, d).select(F.to_csv(F.struct("record_id", "title", "author"), options).alias("line"))
    return lines.select(F.from_csv("line", F.lit("record_id string, title string, author string"), options).alias("r")).select("r.record_id", F.coalesce("r.title", F.lit("")).alias("title"), "r.author")


@query("s01_notice_files", sql(r"""
SELECT record_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || t || chr(10) || 'second "line", ' || source ELSE t END AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE journal END AS journal, CASE WHEN doc_id % 7 = 0 THEN '' ELSE author END AS author
FROM (SELECT *, regexp_replace(coalesce(title, ''), '[\r\n]', ' ', 'g') AS t FROM records JOIN (SELECT doc_id, source FROM documents) ON record_id = 'D' || lpad(doc_id::VARCHAR, 8, '0'))""", "records"))
def s01_files(spark, d):
    """Notice files as they come: a mark of byte order, a header, blank and ragged lines, quotes and line breaks inside fields.

    Records are written as 64 such files and read by the reader of notices.
    """
    path = new_path(spark, "notices")
    source = table(spark, d, "documents").select(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("record_id"), "source", "doc_id")
    rows = records(spark, d).join(source, "record_id").withColumn("title", F.regexp_replace("title", "[\r\n]", " "))
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "title", F.lit('\nsecond "line", '), "source")).otherwise(F.col("title"))
    whole = [F.col("record_id"), title, F.lit(""), F.lit(""), F.col("journal"), F.lit(""), F.lit(""), F.col("author")]
    # Some rows end after the title, some are followed by a blank line.
    line = F.when(F.col("doc_id") % 7 == 0, writers.csv_line([F.col("record_id"), title])).otherwise(writers.csv_line(whole))
    lines = rows.select(F.concat(line, F.when(F.col("doc_id") % 3 == 0, "\r\n\r\n").otherwise("\r\n")).alias("line"))
    head = "\ufeff" + ",".join(readers.NOTICE_COLUMNS) + "\r\n"
    files = lines.groupBy(F.pmod(F.xxhash64("line"), F.lit(64)).alias("file")).agg(F.concat(F.lit(head), F.array_join(F.collect_list("line"), "")).alias("value"))
    files.write.partitionBy("file").text(path)  # a folder and a file for each
    return readers.read_notices(spark, path).select("record_id", "title", "journal", "author")


@query("k01_snapshot_versions", sql(f"""a AS (SELECT record_id, n FROM (SELECT record_id, unnest(string_split(author, ';')) AS n FROM records) WHERE trim(n) <> ''),
i AS (SELECT record_id, unnest([original_doi, retraction_doi, original_pmid, retraction_pmid]) AS doi FROM records),
c AS (SELECT record_id, 'records' AS name FROM records UNION ALL SELECT record_id, 'authors' FROM a UNION ALL SELECT record_id, 'identifiers' FROM i WHERE doi <> ''
      UNION ALL SELECT record_id, 'institutions' FROM (SELECT record_id, unnest(string_split(institution, ';')) AS p FROM records) WHERE trim(p) <> ''),
v AS (SELECT '2024-01' AS version, name FROM c JOIN records USING (record_id) WHERE year < 2012 UNION ALL SELECT '2024-02', name FROM c)
SELECT version, name, count(*) AS n, version = '2024-02' AS newest FROM v GROUP BY version, name""", "records"))
def k01(spark, d):
    """Two refreshes of the notice tables, one of them repeated, and a third that stopped between tables: the rows that readers see."""
    path, notices = new_path(spark, "notice-snapshots"), records(spark, d)
    for _ in range(2):
        refresh.refresh(refresh.star(notices.where("year < 2012")), path, "2024-01")
    refresh.refresh(refresh.star(notices), path, "2024-02")
    notices.limit(1).write.parquet(f"{path}/versions/2024-03/records")
    last = refresh.newest(spark, path)
    seen = [refresh.read(spark, path, t, v).select(F.lit(v).alias("version"), F.lit(t).alias("name")) for v in ("2024-01", "2024-02") for t in refresh.TABLES]
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    return every.groupBy("version", "name").agg(F.count("*").alias("n")).withColumn("newest", F.col("version") == last)


@query("s03_snapshot_row", sql("SELECT count(*) AS row_count, max(length(title)) AS longest, sum(length(author))::BIGINT AS n_chars FROM records", "records"))
def s03(spark, d):
    return records(spark, d).agg(F.count("*").alias("row_count"), F.max(F.length("title")).cast("long").alias("longest"), F.sum(F.length("author")).alias("n_chars"))


@query("s05_point_read", sql("SELECT record_id, title, journal FROM records WHERE record_id = 'D00000010'", "records"))
def s05(spark, d):
    return records(spark, d).where("record_id = 'D00000010'").select("record_id", "title", "journal")


@query("s06_parameters", "SELECT doc_id, source FROM documents WHERE source = 'src1' AND n_chars >= 1000")
def s06(spark, d):
    docs = table(spark, d, "documents")
    return spark.sql("SELECT doc_id, source FROM {docs} WHERE source = :s AND n_chars >= :n", args={"s": "src1", "n": 1000}, docs=docs)


@query("s14_bib_items", sql("SELECT ms_id, ref_id AS at, year, CASE WHEN doi <> '' THEN doi END AS doi FROM refs", "refs"))
def s14(spark, d):
    """Items of generated bibliographies, a block per manuscript, in order."""
    items = F.array_sort(F.collect_list(F.struct("ref_id", F.concat(F.lit("\\bibitem{k} "), "raw").alias("raw"))))
    blocks = references(spark, d).groupBy("ms_id").agg(items.alias("i"))
    text = F.concat(F.lit("\\begin{thebibliography}{9}\n"), F.array_join(F.transform("i", lambda x: x["raw"]), "\n"), F.lit("\n\\end{thebibliography} tail"))
    found = blocks.select("ms_id", F.posexplode(F.arrays_zip(F.transform("i", lambda x: x["ref_id"]).alias("at"), readers.bib_items(text).alias("b"))).alias("p", "z"))
    return found.select("ms_id", "z.at", "z.b.year", "z.b.doi")


@query("k03_log_rows", "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,24}'), lambda x: lower(x)))), '|'), '') AS emails, substring(text, 1, 200) AS shown FROM documents")
def k03(spark, d):
    """A log row: distinct lower-cased addresses, and a title that falls back to the first 200 characters."""
    from ..functions.text import EMAIL_PATTERN

    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(EMAIL_PATTERN), F.lit(0)), lambda x: F.lower(x)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), "|").alias("emails"), F.coalesce(F.lit(None).cast("string"), F.substring("text", 1, 200)).alias("shown"))


_FIELD = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query("k04_log_export", sql("SELECT id, id || ',' || verdict || ',' || " + _FIELD.format("title") + " || ',' || coalesce(workspace_id, '') AS line FROM logs", "logs"))
def k04(spark, d):
    return logs(spark, d).select("id", writers.csv_line([F.col(c) for c in ("id", "verdict", "title", "workspace_id")]).alias("line"))


@query("k06_history_lines", sql("""SELECT id, '{"id":' || id || ',"verdict":"' || verdict || '","n_refs":' || n_refs || '}' AS line FROM logs UNION ALL SELECT NULL, '{"manifest":{"version":1,"count":' || count(*) || '}}' FROM logs""", "logs"))
def k06(spark, d):
    """A line per manuscript, and the manifest with their number."""
    rows = logs(spark, d)
    count = rows.agg(F.count("*").alias("count")).select(F.lit(None).cast("long").alias("id"), F.to_json(F.struct(F.struct(F.lit(1).alias("version"), "count").alias("manifest"))).alias("line"))
    return rows.select("id", F.to_json(F.struct("id", "verdict", "n_refs")).alias("line")).unionByName(count)


@query("s03_snapshot_digests", """SELECT doc_id, sha256(coalesce(text, '')) AS csv_sha256, octet_length(encode(coalesce(text, '')))::BIGINT AS csv_bytes, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS generated_on FROM documents""")
def s03_digests(spark, d):
    """Every document as a raw snapshot: digest, length in bytes, and the day that its note tells."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    note = F.concat(F.lit("The data were generated on 2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" by the source."))
    return table(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("csv_sha256"), F.octet_length(body).cast("long").alias("csv_bytes"), F.regexp_extract(note, r"generated on (\d{4}-\d{2}-\d{2})", 1).alias("generated_on"))


@query("k03_log_fields", """SELECT doc_id, array_to_string(list_sort(list_distinct([coalesce(source, '') || ' lab', coalesce(lang, '') || ' hall'])), '|') AS affiliations, coalesce(CASE WHEN doc_id % 3 > 0 THEN nullif(trim(string_split(text, chr(10))[1]), '') END, substring(text, 1, 200)) AS shown FROM documents""")
def k03_fields(spark, d):
    """A log row: distinct trimmed affiliations, and the title, or the first 200 characters of a text without one."""
    places = F.array(*(F.concat(left, F.coalesce(c, F.lit("")), right) for c, left, right in (("source", F.lit(" "), F.lit(" lab ")), ("lang", F.lit(""), F.lit(" hall")), ("source", F.lit(""), F.lit(" lab")))))
    title = F.when(F.col("doc_id") % 3 > 0, F.trim(F.split("text", "\n")[0]))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: F.trim(x)))), "|").alias("affiliations"), F.coalesce(F.nullif(title, F.lit("")), F.substring("text", 1, 200)).alias("shown"))


@query("k08_public_records", sql("SELECT record_id, title, array_to_string(list_filter(list_transform(string_split(author, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors, array_to_string(string_split(institution, ';'), '|') AS institutions FROM records", "records"))
def k08(spark, d):
    shown = writers.public_record(records(spark, d), ["original_pmid", "retraction_pmid"])
    return shown.select("record_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("institutions", "|").alias("institutions"))


@query("k09_share_rows", sql("""SELECT id, '{"file_name":"' || file_name || '","verdict":"' || verdict || '"}' AS shared FROM logs""", "logs"))
def k09(spark, d):
    """What a share shows: internal fields are absent, not null."""
    row = F.struct("id", "user_id", "workspace_id", "file_name", "verdict").dropFields("id", "user_id", "workspace_id")
    return logs(spark, d).select("id", F.to_json(row).alias("shared"))



def page_items(spark, d):
    """Positioned items: every second page in two columns, 600 wide."""
    q, odd, page = F.col("l_quantity"), F.col("l_linenumber") % 2 == 1, F.col("l_suppkey")
    x = F.when(page % 2 == 0, F.when(odd, q * 4 + 330).otherwise(q * 4 + 50)).otherwise(q * 10 + 50)
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(page.alias("page"), item.alias("item"), x.cast("double").alias("x"), (F.col("l_orderkey") % 700).cast("double").alias("y"), F.lit(10.0).alias("height"), F.concat("l_returnflag", "l_linestatus").alias("str"))


_ITEMS = """items AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS item, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_linenumber % 2 = 1 THEN 330 + l_quantity * 4 ELSE 50 + l_quantity * 4 END ELSE 50 + l_quantity * 10 END::DOUBLE AS x,
    (l_orderkey % 700)::DOUBLE AS y, l_returnflag || l_linestatus AS str FROM lineitem),
gaps AS (SELECT *, (x + nx) / 2 AS mid, nx - x AS gap FROM (SELECT *, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM items)),
best AS (SELECT page, mid, gap FROM gaps WHERE mid BETWEEN 180 AND 420 AND gap > 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap DESC, mid) = 1),
counted AS (SELECT page, count(*) AS n, any_value(gap) AS gap, any_value(mid) AS mid, count(*) FILTER (x < mid) AS l FROM items LEFT JOIN best USING (page) GROUP BY page),
cols AS (SELECT page, CASE WHEN two THEN 2 ELSE 1 END::INT AS columns, CASE WHEN two THEN mid END AS split_x FROM (SELECT *, coalesce(n >= 30 AND gap >= 48 AND l >= n * 0.25 AND n - l >= n * 0.25, false) AS two FROM counted))"""


@query("s12_column_detection", f"WITH {_ITEMS} SELECT page, columns, split_x FROM cols")
def s12(spark, d):
    from ..operators.layout import detect_columns

    return detect_columns(page_items(spark, d), 600.0)


@query("s12_page_text", f"""WITH {_ITEMS},
placed AS (SELECT *, CASE WHEN split_x IS NOT NULL AND x >= split_x THEN 1 ELSE 0 END AS side FROM items JOIN cols USING (page)),
broken AS (SELECT *, lag(y) OVER (PARTITION BY page, side ORDER BY y DESC, x, item, str) AS py FROM placed)
SELECT page, md5(trim(regexp_replace(string_agg(CASE WHEN py IS NULL THEN CASE WHEN side = 1 THEN chr(10) || chr(10) ELSE '' END WHEN py - y > 16 THEN chr(10) || chr(10) WHEN py - y > 6 THEN chr(10) ELSE ' ' END || str, '' ORDER BY side, y DESC, x, item, str), '[ \\t]{{2,}}', ' ', 'g'))) AS text FROM broken GROUP BY page""")
def s12_text(spark, d):
    from ..operators.layout import detect_columns, render_pages

    items = page_items(spark, d)
    return render_pages(items, detect_columns(items, 600.0)).select("page", F.md5("text").alias("text"))


@query("s13_bibtex", sql(r"""
SELECT ref_id, 'article' AS type, title_ AS title, CASE WHEN ref_id % 3 = 0 THEN 'Annals of Nested Braces' ELSE 'Journal ' || (ref_id % 7) END AS journal, year::VARCHAR AS year,
       'Anna Öst and Bo' AS author
FROM (SELECT ref_id, year, trim(regexp_replace(regexp_replace(title, '[^A-Za-z, ]', ' ', 'g'), '\s+', ' ', 'g')) AS title_ FROM refs)""", "refs"))
def s13(spark, d):
    """A file for each manuscript, with nested braces, quoted and bare values, commas, strings and many entries."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("title", "[^A-Za-z, ]", " "), r"\s+", " "))
    title = F.when(F.col("ref_id") % 2 == 0, F.concat(F.lit("{{"), clean, F.lit("}}"))).otherwise(F.concat(F.lit('"{'), clean, F.lit('}"')))
    journal = F.when(F.col("ref_id") % 3 == 0, "anb").otherwise(F.concat(F.lit('"Journal {'), (F.col("ref_id") % 7).cast("string"), F.lit('}"')))
    entry = F.concat(F.lit("@Article{r"), F.col("ref_id").cast("string"), F.lit(",\n  title = "), title, F.lit(',\n author = {Anna {{Ö}{st}} and Bo},journal='), journal, F.lit(", year = "), F.col("year").cast("string"), F.lit("\n}\n"))
    files = references(spark, d).groupBy("ms_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), "a@b.c, }").alias("text"))
    text = F.concat(F.lit('% notes {of} @ all\n@comment{no, x = {y}}@string{anb = "Annals of {N}ested Braces"}'), "text", F.lit("@book{open, title = {never"))
    fields = bibtex_fields(files.select("ms_id", text.alias("text")), "ms_id", "text")
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    ref = F.substr("cite_key", F.lit(2)).cast("long").alias("ref_id")
    return fields.groupBy(ref, "type").agg(of("title"), of("journal"), of("year"), of("author"))
