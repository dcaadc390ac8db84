"""Scalar functions on golden cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import paging, policy, structuring
from sievework.sources import readers


def value(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("f, given, want", [
    (T.normalize_text, "  Ångström—Née,  O’Brien!", "angstrom nee o brien"),
    (T.normalize_doi, " https://DOI.org/10.1000/ABC.). ", "10.1000/abc"),
    (T.normalize_doi, "doi: 10.1/x\"", "10.1/x"),
    (T.normalize_doi, "Unavailable", ""),
    (T.normalize_doi, None, ""),
    (T.normalize_pmid, "PMID 123-4", "1234"),
    (T.normalize_pmid, "0", ""),
    (T.email_domain, "a@b@www.Mail.Example.org ", "mail.example.org"),
    (T.email_domain, "nobody@local", ""),
    (T.extract_doi, "see (10.1234/abc.def.pdf).", "10.1234/abc.def"),
    (T.extract_doi, "none here", None),
    (T.extract_pmid, "PubMed: 1234567", "1234567"),
    (T.extract_year, "in A2019B", 2019),
    (T.title_tokens, "The role of 机器学习 in AI-based vision 2020", ["role", "机器", "器学", "学习", "vision", "2020"]),
    (T.institution_tokens, "Department of Physics, University of Nowhere", ["physics", "nowhere"]),
    (T.semicolon_list, " a; ;b;", ["a", "b"]),
    (T.is_title_noise, "57(6): 365-88", True),
    (T.is_title_noise, "A real title of a paper", False),
    (T.fix_split_doi, "x 10.1000/ab cd-1 rest", "x 10.1000/abcd-1 rest"),
    (T.safe_file_name, "..\\..\\a b.pdf", "a_b.pdf"),
    (T.safe_file_name, "", "upload.bin"),
    (T.file_type, "x.TEX", "latex"),
    (T.file_type, "x", "unknown"),
    (structuring.heuristic_title, "Smith, J., Doe, A. (2019a). A study of things. Journal of Stuff, 3.", "A study of things"),
    (structuring.heuristic_authors, "[3] Smith, J., Doe A and Brown B. (2019) X.", ["Smith J.", "Doe A", "Brown B."]),
    (structuring.heuristic_journal, "Smith, J. (2019). A study of things. Journal of Stuff, 3.", "Journal of Stuff"),
    (structuring.is_likely_reference, "Smith, J. (2019). A study of all things. Journal, 3.", True),
    (structuring.is_likely_reference, "Sales, inventory) capable of 2019 more things here", False),
])
def test_golden(spark, f, given, want):
    assert value(spark, f, given) == want


def test_overlaps(spark):
    row = spark.range(1).select(F.array(*map(F.lit, "abc")).alias("x"), F.array(*map(F.lit, "bcd")).alias("y"), F.array().cast("array<string>").alias("z"), F.array(F.lit("a")).alias("w"))
    got = row.select(T.jaccard(F.col("x"), F.col("y")), T.jaccard(F.col("z"), F.col("z")), T.jaccard(F.col("z"), F.col("z"), 1.0), T.token_overlap(F.col("x"), F.col("y")), T.token_overlap(F.col("x"), F.col("w")), T.token_overlap(F.col("x"), F.col("z"))).first()
    assert [round(g, 6) for g in got] == [0.5, 0.0, 1.0, round(2 / 3, 6), round(1 / 3, 6), 0.0]


def test_names(spark):
    name = value(spark, T.name_parts, "Wei  Zhang")
    assert (name["surname"], name["initials"], name["signature"]) == ("zhang", "wz", "zhang:wz") and set(name["variants"]) == {"wei zhang", "zhang wei", "w zhang"}
    assert value(spark, T.name_parts, "")["surname"] == ""
    conflict = lambda a, b: value(spark, lambda x, y: T.given_names_conflict(T.name_parts(x), T.name_parts(y)), a, b)
    assert conflict("Wei Zhang", "Wen Zhang") and not conflict("W Zhang", "Wei Zhang") and not conflict("Wei Zhang", "Wei Li")


def test_encryption(spark):
    coded = value(spark, lambda c: T.encrypt_field(c, bytes(32)), "secret ü")
    assert coded.startswith("enc:v1:") and value(spark, lambda c: T.decrypt_field(c, bytes(32)), coded) == "secret ü"
    assert value(spark, lambda c: T.decrypt_field(c, bytes(32)), "plain") == "plain"


def test_unwrap(spark):
    block = "Intro " + " ".join(f"{i}. Author {'word ' * 120}" for i in range(1, 8))
    assert value(spark, T.unwrap_blob, block).count("\n") == 7 and value(spark, T.unwrap_blob, block[:2000]) == block[:2000]


def test_policy():
    assert policy.load("strict").safety["hard_identifiers_only"] and policy.load().weights["doi"] == 1.0
    assert policy.load(text=json.dumps({"weights": {"doi": 0.5}})).weights["doi"] == 0.5
    for bad in ({"weights": {"nope": 1}}, {"thresholds": {"likely_match": "x"}}, {"safety": {"hard_identifiers_only": 1}}):
        with pytest.raises(ValueError):
            policy.load(text=json.dumps(bad))


def test_cursor():
    from datetime import datetime

    at = datetime(2024, 1, 2, 3, 4, 5)
    assert paging.decode_cursor(paging.encode_cursor(at, 7)) == (at, 7)
    assert paging.decode_cursor("???") is None and paging.decode_cursor(None) is None


def test_archives():
    import io
    import zipfile

    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files.items():
                z.writestr(name, content)
        return out.getvalue()

    assert readers.unzip_guarded(archive(**{"a.tex": "x"})) == {"a.tex": b"x"}
    for name in ("../a.tex", "/a.tex", "b.zip"):
        with pytest.raises(ValueError):
            readers.unzip_guarded(archive(**{name: "x"}))


def test_overlong_entries(spark):
    one = "Smith, J., & Doe, A. (2019). " + "A long title about many things in the world of study, " * 3 + "Journal of Stuff, 3"
    two = "Nesher Cement Enterprises Ltd. (2014). " + "Another report with words and words and more words, " * 3 + "Series 4"
    assert value(spark, structuring.split_overlong, f"{one}. {two}.") == [one + ".", two + "."]
    assert value(spark, structuring.split_overlong, "short. Smith, J. (2019). x") == ["short. Smith, J. (2019). x"]


def test_romanisation(spark):
    from sievework.functions import han

    dictionary = spark.createDataFrame([("张", "Zhang"), ("伟", "wei"), ("学", "xue"), ("习", "xi")], "char string, pinyin string")
    rows = spark.createDataFrame([(1, "张伟"), (2, "Wei Zhang"), (3, "学习 AI龘")], "id long, name string")
    assert {r["id"]: r["pinyin"] for r in han.romanize(rows, "id", "name", dictionary).collect()} == {1: "zhang wei", 2: "", 3: "xue xi ai龘"}
    got = spark.range(1).select(han.title_similarity(F.lit("xue deep zhang"), F.lit("学习"), F.lit("xue xi"), F.lit("")).alias("x"), han.title_similarity(F.lit("deep nets"), F.lit("deep nets"), F.lit(""), F.lit("")).alias("y")).first()
    assert round(got["x"], 4) == round(1 / 3, 4) and got["y"] == 1.0


def test_request_values(spark):
    rows = spark.createDataFrame(
        [(0, ["PASS", "pass", "FAIL"], "500", "-3", None), (1, [], None, None, ""), (2, None, "x", "y", "c"), (3, ["no"], "-1", "12", "")],
        "k int, verdicts array<string>, size string, skip string, cursor string",
    )
    asked = rows.select("k", paging.request_filters(F.col("verdicts"), F.col("size"), F.col("skip"), F.col("cursor")).alias("f"))
    assert {r["k"]: tuple(r["f"]) for r in asked.collect()} == {0: (["PASS", "FAIL"], 200, 0, None), 1: (None, 50, 0, None), 2: (None, 50, None, "c"), 3: (None, 1, 12, None)}
    lists = spark.createDataFrame([(0, [" a ", "", None, "a", "\tb\n"]), (1, None), (2, [])], "k int, v array<string>")
    assert {r["k"]: r["v"] for r in lists.select("k", T.distinct_values(F.col("v")).alias("v")).collect()} == {0: ["a", "b"], 1: [], 2: []}


def test_longest_entries_and_cross_script_pairs(spark):
    from sievework.functions import han
    from sievework.operators import matching

    words = han.dictionary(spark)
    entries = {r["char"]: r["pinyin"] for r in words.collect()}
    texts = {1: "重庆大学", 2: "重大成都银行业", 3: "no Han", 4: None, 5: "龘校长 A音乐"}
    longest = max(map(len, entries))

    def brute(text):
        if not text or not any("一" <= c <= "鿿" for c in text):
            return ""
        out, at = "", 0
        while at < len(text):
            size = next((k for k in range(longest, 0, -1) if text[at : at + k] in entries), 0)
            out += f" {entries[text[at : at + size]]} " if size else text[at].lower()
            at += size or 1
        return " ".join(out.split())

    rows = spark.createDataFrame(list(texts.items()), "id long, title string")
    assert {r["id"]: r["pinyin"] for r in han.romanize(rows, "id", "title", words).collect()} == {k: brute(t) for k, t in texts.items()}
    refs = spark.createDataFrame([(1, "Chong Qing Da Xue"), (2, "网络模型"), (3, "Deep nets")], "ref_id long, title string")
    records = spark.createDataFrame([("a", "重庆大学"), ("b", "Wang Luo Mo Xing"), ("c", "Deep nets"), ("d", "网络模型")], "record_id string, title string")
    found = {(r["ref_id"], r["record_id"]) for r in matching.cross_script_pairs(refs, records, words, 0.5).collect()}
    assert found == {(1, "a"), (2, "b"), (2, "d"), (3, "c")}


def test_long_file_names_are_told_from_their_front(spark):
    names = ["a" * 5000, "!" * 3000 + "b" * 300, "x" + "." * 2500 + "y", "d/" + "é" * 1500 + "/", "dir\\" + "ab " * 400 + "//", "/" * 2000, None, "", "q" * 199 + "-" + "r" * 2000]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, n string").select("k", T.safe_file_name(F.col("n")).alias("n"))
    got = [r["n"] for r in sorted(rows.collect(), key=lambda r: r["k"])]
    assert got == ["a" * 200, "_" + "b" * 199, "x.y", "_", ("ab_" * 400)[:200], "upload.bin", None, "upload.bin", "q" * 199 + "-"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The characters after the front are only gone through where the front gives fewer than 200.
    assert f"> {T.NAME_FRONT}" in plan
