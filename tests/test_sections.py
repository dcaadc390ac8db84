"""Random reference sections of known entries, laid out in every way that is split; every registered query of manuscripts, run whole."""

from __future__ import annotations

import random

import __spark_entry__
import pytest
from pyspark.sql import functions as F
from sievework.operators import header as H
from sievework.operators import structuring as S

SURNAMES = "Abel Brandt Carver Dorn Ekman Fiala Gruber Holm Ibsen Jansen Krause Lindt".split()
THINGS = "canals rivers bridges harbours mills towers gardens markets".split()


def entry(draw: random.Random) -> str:
    authors = ", ".join(f"{draw.choice(SURNAMES)}, {draw.choice('ABCDEFG')}." for _ in range(draw.randint(1, 4)))
    title = f"On the {draw.choice(THINGS)} and {draw.choice(THINGS)} of old towns"
    return f"{authors} ({draw.randint(1950, 2023)}). {title}. Journal of {draw.choice(THINGS).title()}, {draw.randint(1, 99)}."


def sections(draw: random.Random) -> list[tuple[list[str], str]]:
    out = []
    for _ in range(40):
        own = [entry(draw) for _ in range(draw.randint(5, 25))]
        wrap = lambda t: t.replace(" and ", "\n and ", 1) if draw.random() < 0.5 else t
        left, right = draw.choice([("[", "]"), ("(", ")"), ("", ".")])
        space = draw.choice([" ", " ", "\t", "  "])
        out.append((own, "\n".join(f"{left}{i}{right}{space}{wrap(t)}" for i, t in enumerate(own, 1))))
        out.append((own, draw.choice(["", "References\n"]) + draw.choice(["\n", "\r\n"]).join(own)))
        out.append((own, " ".join(f"[{i}] {t}" for i, t in enumerate(own, 1))))
        out.append((own[:3], "Bibliography\n\n" + "\n\n".join(own[:3])))
    return out


def test_random_sections(spark):
    cases = sections(random.Random(8))
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "k int, t string").select("k", S.split_references(F.col("t")).alias("r"))
    found = {r["k"]: r["r"] for r in rows.collect()}
    assert found == {k: own for k, (own, _) in enumerate(cases)}


def test_random_overlong_entries(spark):
    draw = random.Random(9)
    cases = [[entry(draw) for _ in range(draw.randint(1, 8))] for _ in range(60)]
    rows = spark.createDataFrame([(k, " ".join(own)) for k, own in enumerate(cases)], "k int, t string").select("k", S.split_overlong(F.col("t")).alias("r"))
    for r in rows.collect():
        own = cases[r["k"]]
        assert r["r"] == (own if len(" ".join(own)) > 350 else [" ".join(own)])


def test_random_heads(spark):
    """Heads put together from a title, a byline with marks, affiliations and addresses, under notes and white space of any kind."""
    draw, cases = random.Random(10), []
    notes = ["All rights reserved", "© 2020 The Authors", "Preprint", "Published by Elsevier B.V.", "www.example.com/locate", "Available online at www.example.com"]
    for _ in range(60):
        n = draw.randint(1, 4)
        people = [f"{draw.choice(['Anna', 'Bob', 'Carl', 'Dora', 'Eve'])} {s}" for s in draw.sample(SURNAMES, n)]
        letters = draw.random() < 0.5
        mark = lambda i: "abcd"[i] if letters else str(i + 1)  # noqa: E731, B023
        title = f"Measuring the {draw.choice(THINGS)} and {draw.choice(THINGS)} of old towns"
        places = [f"Department of {draw.choice(THINGS).title()}, University of Ghent" for _ in people]
        lines = [*draw.sample(notes, draw.choice([0, 3, 5])), title, ", ".join(f"{p}{mark(i)}" for i, p in enumerate(people)), *(f"{mark(i)}{x}" for i, x in enumerate(places)), "Abstract", "We measure them all here."]
        text = draw.choice(["\n", "\r\n", " \n\t"]).join(lines)
        cases.append((text.replace(" ", " ") if draw.random() < 0.3 else text, title, list(zip(people, places, strict=True))))
    rows = H.headers(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, text string")).collect()
    for r in rows:
        _, title, authors = cases[r["k"]]
        assert r["header"]["title"] == title
        assert [(a["name"], a["affiliation"]) for a in r["header"]["authors"]] == authors


@pytest.mark.parametrize("name", ["t01_located_references", "t02_split_references", "t03_split_overlong", "t09_candidates", "t10_headers", "t12_title_ranges", "t13_author_names", "r18_references_by_marker", "r19_references_section"])
def test_registered(spark, sf_dir, name):
    rows = __spark_entry__.queries()[name](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows
    assert {abs(r["doc_id"]) - (r["doc_id"] < 0) for r in rows} <= set(docs)
    if name in ("t10_headers", "t12_title_ranges", "r18_references_by_marker", "r19_references_section"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name == "r19_references_section":
        headers = [h for h in S.SECTION_HEADERS]
        for r in rows:
            assert r["start"] < 0 or any(h in docs[r["doc_id"]][r["start"] : r["start"] + 40] for h in headers)
    if name == "t02_split_references":
        assert all(30 <= len(r["raw"]) for r in rows)
