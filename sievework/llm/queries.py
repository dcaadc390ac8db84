"""The numbered queries: each applies one operator to its whole table, plus their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, html_extract, lexical_rank, license_scan, mixing, packing, quality_classifier, quality_rules, recompression
from .dart_minhash import near_duplicates
from .suffix_dedup import suffix_dedup
from .vptree import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of `documents`, under the base and the standard policy."""
    found = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.MEASURES, "failed_bits", (~quality_rules.passes("base-1")).alias("base_failed"), quality_rules.passes("standard-1").alias("kept"))


_W = r"[^\x20\x09-\x0D]"
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT r, doc_id, t, regexp_extract_all(t, '{_W}+') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
    FROM d
),
pos AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (
    SELECT r, i, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN
        concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) END AS g
    FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)
),
f AS (SELECT r, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 THEN 1 ELSE 0 END AS f FROM g),
c AS (SELECT r, max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM f),
n AS (SELECT r, sum(c) AS n FROM c GROUP BY r),
m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           len(ls)::BIGINT AS n_lines,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN n USING (r)
),
b AS (
    SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)::BIGINT AS failed_bits
    FROM m
)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` and conversation -1, folded, rendered, and read back from what was rendered."""
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = chat_format.format_chats(chat_format.events_of(rows))
    read = chats.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
o AS (
    SELECT *, length(role) + length(text) + 20
        + length(role || text) - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '[', '')) AS n
    FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"), html_extract.usual_field())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 2048 tokens."""
    return packing.sequences(table(spark, sf_dir, "documents"), capacity=2048)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` mixed to 150% of their words, sources weighing 5, 2, 1 in turn."""
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, of all `embeddings`."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` in 400-byte strings that also start anywhere else."""
    found = suffix_dedup(table(spark, sf_dir, "documents"), unit="byte", threshold=400)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What is left, readable: a character that a cut goes through is U+FFFD.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8).select("doc_id", "class_id", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of which at least 0.8 of the shingles are in a document."""
    return license_scan.scan(table(spark, sf_dir, "documents"), containment=0.8).select("doc_id", "license", "n_shared", "n_shingles")


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES.items())
_T = r"(?:[A-Za-z0-9]|[^\x00-\x7F])+"
OP9_SQL = rf"""
WITH t(license, t) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
    SELECT license, 0 AS r, unnest(w) AS x, generate_subscripts(w, 1) AS i
    FROM (SELECT license, regexp_extract_all(lower(t), '{_T}') AS w FROM t)
    UNION ALL
    SELECT NULL, r, unnest(w), generate_subscripts(w, 1)
    FROM (SELECT r, regexp_extract_all(lower(t), '{_T}') AS w FROM d)
),
s AS (
    SELECT DISTINCT license, r, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g
    FROM p WINDOW o AS (PARTITION BY license, r ORDER BY i) QUALIFY lead(x, 4) OVER o IS NOT NULL
),
n AS (SELECT license, count(*) AS n_shingles FROM s WHERE r = 0 GROUP BY license),
m AS (
    SELECT a.license, b.r, count(*) AS n_shared
    FROM s a JOIN s b ON a.g = b.g AND a.r = 0 AND b.r > 0 GROUP BY a.license, b.r
)
SELECT doc_id, license, n_shared, n_shingles
FROM m JOIN n USING (license) JOIN d USING (r) WHERE n_shared >= 0.8 * n_shingles
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by co-training on `labels`."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", "score", "kept")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` in windows of 20 words that start earlier too."""
    found = recompression.dedup(table(spark, sf_dir, "documents"), threshold=20)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after the planned damage."""
    broken = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    found = conversation_repair.repair(broken, F.col("present"))
    digests = conversation_repair.digests(found.rows).withColumnRenamed("conv_id", "_id")
    said = found.summary.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return said.select(*found.summary.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# States: e (nothing yet), s (after a system row), u (after a user row), a (after an assistant row), each
# {c: cost, a: audit, t: text so far}; a state that can't be has a cost of a million.
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 't': {0}.t || {3}}}"
_NEVER = "{'c': 1000000, 'a': '', 't': ''}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _say(state: str, cost: str, letter: str, line: str) -> str:
    return _ADD.format(state, cost, letter, f"chr(10) || {line}")


_USER, _ASSISTANT = "'user:'", "'assistant:'"
_INSERTED_USER = _least("u", *(_say(x, "2", "I", _USER) for x in "esa"))


def _after(state: str) -> str:
    """The best way into a state by row x: its row kept or reroled onto what fits before, or deleted."""
    ways = [_ADD.format(state, "3", "D", "''")]
    if state == "s":
        ways.append(f"CASE WHEN fault IN (1, 2) OR i <> 's' THEN {_NEVER} ELSE {_say('e', 'cut', 'K', 'line')} END")
    if state == "u":
        for x in "esa":
            ways.append(f"CASE WHEN fault IN (1, 2) OR i <> 'u' THEN {_NEVER} ELSE {_say(x, 'cut', 'K', 'line')} END")
            said = _say(x, "2 + cut", "R", "'user:' || text")
            ways.append(f"CASE WHEN fault IN (1, 2) THEN {_NEVER} ELSE {said} END")
    if state == "a":
        ways.append(f"CASE WHEN fault IN (1, 2) OR i <> 'a' THEN {_NEVER} ELSE {_say('u', 'cut', 'K', 'line')} END")
        said = _say("u", "2 + cut", "R", "'assistant:' || text")
        ways.append(f"CASE WHEN fault IN (1, 2) THEN {_NEVER} ELSE {said} END")
    return _least(*ways)


_PLAIN_WHITE = r"[\x20\x09-\x0D]"
OP12_SQL = rf"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295) % 20 AS k
    FROM conversations
),
d AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0
),
o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
           role || ':' || text AS line, substr(role, 1, 1) AS i
    FROM d
),
f AS (
    SELECT *, lag(i) OVER c AS before,
           CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault
    FROM o WINDOW c AS (PARTITION BY conv_id ORDER BY n)
),
r AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cut FROM f),
p AS (
    SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 't': ''}} AS e, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT q.conv_id, r.n, {_ADD.format("e", "3", "D", "''")}, {_after("s")}, {_after("u")}, {_after("a")}
    FROM (
        SELECT conv_id, n, e, s, {_INSERTED_USER} AS u, a
        FROM (SELECT conv_id, n, e, s, u, {_least("a", _say("v", "2", "I", _ASSISTANT))} AS a FROM (SELECT *, {_INSERTED_USER} AS v FROM p))
    ) q JOIN r ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = q.n + 1
),
z AS (
    SELECT conv_id, {_least("e", "a", _say("v", "2", "I", _ASSISTANT))} AS best
    FROM (SELECT *, {_INSERTED_USER} AS v FROM p) QUALIFY n = max(n) OVER (PARTITION BY conv_id)
),
g AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring of all `documents` for every `benchmark` item."""
    return lexical_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{lexical_rank.UPPER}', '{lexical_rank.LOWER}'), '{lexical_rank.TERM}')"


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("text")} AS ts FROM documents),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * docs) // terms AS m FROM d, total WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest({_terms_sql("text")}) AS x FROM benchmark),
tf AS (
    SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(ts) AS x FROM d) WHERE x IN (SELECT x FROM i) GROUP BY r, x
),
w AS (SELECT x, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT x, count(*) AS df FROM tf GROUP BY x), total),
s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM i JOIN tf USING (x) JOIN w USING (x) JOIN m USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_html_extract": op3_html_extract,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_nearest": op6_nearest,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_recompression": op11_recompression,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_rank": op13_lexical_rank,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op9_license_scan": OP9_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_lexical_rank": OP13_SQL,
}
