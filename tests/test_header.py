"""The head of manuscripts, on the cases that its steps are for."""

from __future__ import annotations

from pyspark.sql import functions as F
from sievework.operators import header as H

PLAIN = """Research Article
A study of many things and of
their places in the world
Anna Smith1*, Bob C. Doe2 and Carl Weiss1
1Department of Things, University of Somewhere, Town
2Institute of Places, College of Elsewhere
anna@some.edu, bob@else.org
0000-0001-2345-678X
Abstract
We look at things. They are many, and some of them are in their places, which we count.

Introduction
Text, doi:10.1234/abc.5"""
NOTED = """All rights reserved
© 2020 The Authors
Preprint
Highlights
A first title of the work in short
• one point
• another point
that goes on here
A full title of this work again
Anna Smith, Bob Doe
Abstract"""


def heads(spark, *texts):
    rows = H.headers(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", name="h").collect()
    return [r["h"] for r in sorted(rows, key=lambda r: r["k"])]


def test_headers(spark):
    plain, noted, mails, empty, none = heads(spark, PLAIN, NOTED, "x@y.org, z@w.org\n", "", None)
    assert plain["title"] == "A study of many things and of their places in the world" and plain["doi"] == "10.1234/abc.5"
    assert [(a["name"], a["email"], a["orcid"], a["affiliation"]) for a in plain["authors"]] == [
        ("Anna Smith", "anna@some.edu", "0000-0001-2345-678X", "Department of Things, University of Somewhere, Town"),
        ("Bob C. Doe", "bob@else.org", None, "Institute of Places, College of Elsewhere"),
        ("Carl Weiss", None, None, "Department of Things, University of Somewhere, Town"),
    ]
    assert plain["abstract"].startswith("We look at things.") and plain["abstract"].endswith("which we count.")
    assert noted["title"] == "A full title of this work again" and [a["name"] for a in noted["authors"]] == ["Anna Smith", "Bob Doe"]
    assert [(a["name"], a["email"]) for a in mails["authors"]] == [("x", "x@y.org"), ("z", "z@w.org")]
    assert empty["title"] is None and empty["authors"] == [] and none["title"] is None and none["abstract"] is None


def test_names(spark):
    rows = [("Anna Smith Bob Doe Carl Weiss Dora Green", ["Anna Smith", "Bob Doe", "Carl Weiss", "Dora Green"]), ("Forest. On the position-offset split", []), ("Detection of Things", []), ("李明华, 王芳丽, 李明", ["李明华", "王芳丽"]), ("محمد علي، فاطمة حسن", ["محمد علي", "فاطمة حسن"]), ("Smith", [])]
    got = spark.createDataFrame([(i, [r[0]]) for i, r in enumerate(rows)], "k int, b array<string>").select("k", H.author_names(F.col("b")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {i: r[1] for i, r in enumerate(rows)}
    marks = spark.createDataFrame([("Anna Smith1,2*",), ("Bob Doe a",), ("Bob Doea",), ("Eva Maria",), ("Li",)], "n string").select(H.unmarked(F.col("n")).alias("u")).collect()
    assert [(r["u"]["base"], r["u"]["marks"]) for r in marks] == [("Anna Smith", ["1", "2", "*"]), ("Bob Doe", ["a"]), ("Bob Doe", ["a"]), ("Eva Mari", ["a"]), ("Li", [])]


def test_header_queries(spark, sf_dir):
    import __spark_entry__

    queries = __spark_entry__.queries()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = queries["t10_headers"](spark, sf_dir).collect()
    assert len(rows) == docs and sum((r["title"] or "").startswith("A study of ") for r in rows) > 0.9 * docs
    assert sum("/" in r["author_list"] for r in rows) > 0.8 * docs
    assert queries["t12_title_ranges"](spark, sf_dir).count() == docs
    names = queries["t13_author_names"](spark, sf_dir).collect()
    assert {r["marks"] for r in names} >= {"1", "2"}


def test_white_space_of_any_kind(spark):
    crlf, tabs, wide = heads(spark, PLAIN.replace("\n", "\r\n"), "\t" + PLAIN.replace("\n", " \t\n\t "), PLAIN.replace(" ", "\u00a0"))
    for found in (crlf, tabs, wide):
        assert found["title"] == "A study of many things and of their places in the world"
        assert [a["name"] for a in found["authors"]] == ["Anna Smith", "Bob C. Doe", "Carl Weiss"]
        assert found["authors"][1]["affiliation"] == "Institute of Places, College of Elsewhere"


def titles(spark, *texts):
    return [r["title"] for r in heads(spark, *("\n".join(t) for t in texts))]


def test_titles(spark):
    byline = "Anna Smith, Bob Doe"
    cases = {
        ("N E W S R E P O R T", "Measuring the flow of water in old canals", byline): "Measuring the flow of water in old canals",
        ("Short Communication", "Measuring Water", "in Old Canals", byline): "Measuring Water in Old Canals",
        ("The 9th International Conference on Water and Canals", "July 3-5, 2021, Ghent, Belgium", "A Measured Flow of Water for an Old and Quiet", "Canal System", byline): "A Measured Flow of Water for an Old and Quiet Canal System",
        ("International Conference on Big Canals", "and Quiet Water 2019", "A Real Title of the Paper", byline): "A Real Title of the Paper",
        ("International Conference on Water Technology and", "Quantitative Management", "A Real Title of the Paper", byline): "A Real Title of the Paper",
        ("(WACA 2021)", "Annals of Canals", "Water: a review", byline): "Water: a review",
        ("European Journal of", "Old Canals", "2021, Vol. 3(1) 5-26", "Walking with water: A long", "way to a canal", byline): "Walking with water: A long way to a canal",
        ("Does Quiet Water Sleep?", "Dreams of Quiet Canals in the Low Countries", byline): "Does Quiet Water Sleep? Dreams of Quiet Canals in the Low Countries",
        ("Is Water Awake?", "Do Canals Dream?", byline): "Is Water Awake?",
        ("Walls that promote quiet water by", "asking old canals to relay their calm", "Anna Smith1, Bob Doe1"): "Walls that promote quiet water by asking old canals to relay their calm",
        ("A Quiet Water Paradigm for Event-", "based canals", "Anna Maria Pongo a", "a NIDO, Old Town Rd, Ghent and 10110, Belgium"): "A Quiet Water Paradigm for Event-based canals",
    }
    # A hyphen before small letters is taken for one that a line break has made.
    found = titles(spark, *cases)
    want = [t.replace("Event-based", "Eventbased") if t.startswith("A Quiet") else t for t in cases.values()]
    assert found == want


def test_notes_before_the_paper(spark):
    notes = [
        "Since March 2021 Elsevier has kept a resource centre with", "free information on the novel virus.", "The resource centre is hosted on Elsevier Connect, the", "company's public news website.",
        "Elsevier hereby grants permission to make all its research", "that is available there immediately available to all", "for unrestricted use by any means", "with acknowledgement of the source. These permissions are", "granted for free as long as it", "remains active.",
        "ScienceDirect", "1877-0509 © 2021 The Authors. Published by Elsevier B.V.", "10.1016/j.abcde.2021.03.074", "Available online at www.sciencedirect.com", "Procedia Canals 00 (2021) 000-000", "The 6th International Conference on Canals", "March 15-17, 2021, Ghent, Belgium",
    ]
    paper = ["A Measured Flow of Water for an Old and Quiet Canal System", "Anna Smith, Bob Doe"]
    graphical = ["Graphical Abstract", "A Paper in Short", "A picture of water goes here for some lines.", "and goes on in small letters", "A Real Title of Water", "Anna Smith, Bob Doe"]
    later = ["A circuit of water that goes round and comes", "back", "Anna Smith1, Bob Doe1,2,*", "Northern University", "Graphical Abstract", "*Correspondence: bob@x.org."]
    assert titles(spark, [*notes, *paper], graphical, later) == [paper[0], "A Real Title of Water", "A circuit of water that goes round and comes back"]
    rows = spark.createDataFrame([(0, ["Highlights"]), (1, paper), (2, [*notes, *paper])], "k int, l array<string>").select("k", H.strip_preamble(F.col("l")).alias("l")).collect()
    assert {r["k"]: r["l"] for r in rows} == {0: ["Highlights"], 1: paper, 2: paper}


def test_marks_and_organisations(spark):
    lettered = ["Measuring Old Canals in Quiet Cities with Water", "Mira Xua, Liz Zangb and Pia Houc", "aSchool of Canals, Northern University, Ghent.", "bHoma.AI Technology Co., Ltd, Ghent 1010, Belgium.", "cSchool of Rivers, Southern University.", "A R T I C L E I N F O", "Keywords:", "Quiet Water"]
    plain = ["Measuring Old Canals in Quiet Cities with Water", "Eva Maria, Google DeepMind, Bob Doe, Microsoft Research Asia", "Northern University"]
    first, second = heads(spark, "\n".join(lettered), "\n".join(plain))
    assert [(a["name"], a["affiliation"]) for a in first["authors"]] == [("Mira Xu", "School of Canals, Northern University, Ghent."), ("Liz Zang", "Homa.AI Technology Co., Ltd, Ghent 1010, Belgium."), ("Pia Hou", "School of Rivers, Southern University.")]
    assert [a["name"] for a in second["authors"]] == ["Eva Maria", "Bob Doe"]


def test_lines_are_described_once(spark, sf_dir):
    from sievework.plans import registry

    registry.load()
    for name in ("t10_headers", "t12_title_ranges", "t13_author_names"):
        plan = registry.QUERIES.get(name, registry.WITHOUT_SQL.get(name))(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("jan|feb|mar") == 1, name


def test_kinds_of_lines(spark):
    lines = ["Anna Smith1, Bob Doe2", "Anna Smith", "a b c d e", "Review Article", "All rights reserved", "1Department of Things", "", "x" * 401 + ", Anna Smith & Bob", "The K and its Ring of x"]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(H.describe(F.col("l")).alias("d")).first()["d"]
    assert [x["kind"] for x in row] == ["names", "name?", "spaced", "type", "notice", "place", "type", "text", "text"]
    assert [(x["n"], x["capitals"], x["glue"]) for x in row][-1] == (7, 3, 3)
