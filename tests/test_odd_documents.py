"""Queries against their SQL over documents that the given tables hardly have."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

#: Without words, with words of one text in another, frequent names, equal and nearly equal titles.
TEXTS = [
    "Theand thble reingwh thorin as innd thre the erndou thes ate", "Theand thble reingwh thorin as innd thre the erndou thes ates", "12 34", "", None, "The and the and the and the and the and",
    "Anders the Brown the anders", "Nichtnicht aber den wie Nichtnicht", "Nichtnicht aber den wie Nichtnichtig Wort", "And the other words of this and that, one more time", "Die the kleine die Worte aus", "The and of",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, TEXTS[i * 7 // 5 % len(TEXTS)], "en" if i % 3 else "de", f"src{i % 4}", 0) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def shown(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def agree(spark, folder: str, name: str) -> int:
    """Rows of a query, which are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(found.columns)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in result.description]
    wanted = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in found.collect()) == wanted
    return len(wanted)


def test_weak_names_with_identifiers(spark, odd):
    assert agree(spark, odd, "c13_author_screen")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_title_pairs_are_measured_where_they_meet(spark, odd):
    assert agree(spark, odd, "j05_title_pairs")
    told = plan(__spark_entry__.queries()["j05_title_pairs"](spark, odd))
    assert "hashpartitioning(q_id" not in told and "keys=[q_id" not in told


def test_references_are_judged_where_they_meet(spark, odd):
    assert agree(spark, odd, "a07_manuscript_verdicts") and agree(spark, odd, "c11_reference_scores")
    assert "Window" not in plan(__spark_entry__.queries()["a07_manuscript_verdicts"](spark, odd))


def test_open_people_are_found_without_pairs(spark, odd):
    assert agree(spark, odd, "j06_institution_fallback")
    found = __spark_entry__.queries()["j06_institution_fallback"](spark, odd)
    assert "min(priority" not in plan(found)
