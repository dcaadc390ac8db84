"""Queries of Han romanisation (F10) and of titles across scripts (F16), over titles spelt in the library's dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import han
from ..operators import matching
from .bridge import records, references, sql
from .registry import query
from .scalars import STOP_TITLE

_ENTRIES = [x.split(" ", 1) for x in han.DICTIONARY.replace("\n", " ").strip().split(", ")]
_N = len(_ENTRIES)
_WORDS_SQL = "words(i, char, pinyin) AS (VALUES " + ", ".join(f"({i}, '{c}', '{p}')" for i, (c, p) in enumerate(_ENTRIES)) + ")"
_LONG = "|".join(sorted((c for c, _ in _ENTRIES if len(c) > 1), key=len, reverse=True))
#: A title of six entries for every tenth notice, by its number; and its reading.
_HAN_SQL = f"""{_WORDS_SQL},
numbered AS (SELECT record_id, substring(record_id, 2)::BIGINT AS n FROM records),
spelt AS (SELECT record_id, string_agg(char, '' ORDER BY k) || ' Vol ' || n % 5 AS title FROM numbered, range(6) AS r(k), words WHERE n % 10 = 0 AND i = (n * 7 + k * (n // 10 + 3)) % {_N} GROUP BY record_id, n),
cut AS (SELECT record_id, unnest(m) AS char, generate_subscripts(m, 1) AS pos FROM (SELECT record_id, regexp_extract_all(title, '{_LONG}|.') AS m FROM spelt)),
readings AS (SELECT record_id, trim(regexp_replace(string_agg(CASE WHEN pinyin IS NULL THEN lower(char) ELSE ' ' || pinyin || ' ' END, '' ORDER BY pos), '\\s+', ' ', 'g')) AS pinyin FROM cut LEFT JOIN words USING (char) GROUP BY record_id)"""


def han_records(spark, d):
    """(record_id, title): every tenth notice under a Han title."""
    words = F.array(*(F.lit(c) for c, _ in _ENTRIES))
    n = F.substr("record_id", F.lit(2)).cast("long")
    char = lambda k: F.element_at(words, ((n * 7 + k * (F.floor(n / 10) + 3)) % _N + 1).cast("int"))
    title = F.concat(*(char(k) for k in range(6)), F.lit(" Vol "), (n % 5).cast("string"))
    return records(spark, d).where(n % 10 == 0).select("record_id", title.alias("title"))


@query("f10_han_names", sql(f"{_HAN_SQL}\nSELECT record_id, title, pinyin FROM spelt JOIN readings USING (record_id)", "records"))
def f10(spark, d):
    """Han titles read by the longest entries of the dictionary."""
    rows = han_records(spark, d)
    return rows.join(han.romanize(rows, "record_id", "title", han.dictionary(spark)), "record_id").select("record_id", "title", "pinyin")


_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 2 AND w NOT IN (" + STOP_TITLE + ")))"


@query("f16_cross_script_titles", sql(f"""{_HAN_SQL},
r AS (SELECT record_id, {_TOKENS.format("pinyin")} AS y FROM readings),
q AS (SELECT ref_id, {_TOKENS.format("pinyin || ' study'")} AS x FROM refs JOIN readings ON record_id = 'D' || lpad((ref_id - 1)::VARCHAR, 8, '0'))
SELECT ref_id, record_id, round(s / (len(x) + len(y) - s), 6) AS title_similarity FROM (SELECT *, len(list_intersect(x, y))::DOUBLE AS s FROM q, r) WHERE s > 0 AND s / (len(x) + len(y) - s) >= 0.3::DOUBLE""", "records", "refs"))
def f16(spark, d):
    """References that cite Han titles in Latin letters find them."""
    rows, words = han_records(spark, d), han.dictionary(spark)
    key = F.concat(F.lit("D"), F.lpad((F.col("ref_id") - 1).cast("string"), 8, "0"))
    cited = references(spark, d).select("ref_id", key.alias("record_id")).join(han.romanize(rows, "record_id", "title", words), "record_id")
    refs = cited.select("ref_id", F.concat(F.initcap("pinyin"), F.lit(" Study")).alias("title"))
    return matching.cross_script_pairs(refs, rows, words, 0.3).withColumn("title_similarity", F.round("title_similarity", 6))
