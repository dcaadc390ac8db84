"""Operators on whole texts against brute force."""

from __future__ import annotations

import random
import re

import __spark_entry__
from pyspark.sql import functions as F
from sievework.operators import structuring as S


def start_of(text: str) -> int:
    found = (m.start() for h in S.SECTION_HEADERS for m in re.finditer(rf"(?:\A|\n)\s*{h}[\s0-9.:;,()\-]*(?:\n|\Z)", text))
    return max(found, default=-1)


def end_of(tail: str) -> int:
    first = (re.search(rf"\n\s*{h}\s*\n", tail, re.I) for h in S.STOP_HEADERS)
    return min((m.start() for m in first if m and m.start() > 200), default=len(tail))


def test_sections_in_whole_texts(spark):
    draw = random.Random(5)
    parts = ["References", "REFERENCES 1.", " 参考文献:", "Bibliography", "Works Cited", "\n", "\n\n", "in References to\n", "word " * 400, "x" * 210, "\nfunding\n", "Appendix\n", "\n致谢\n", "\u00a0"]
    texts = ["", "References", "word " * 2000 + "\nReferences\n[1] A b", "References\nReferences\n", *("".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("s", S.references_start(F.col("t"))).withColumn("e", S.references_end(F.col("t")))
    found = {r["k"]: (r["s"], r["e"]) for r in rows.collect()}
    assert found == {k: (start_of(t), end_of(t)) for k, t in enumerate(texts)}
    assert found[2][0] == 10000


def marker_of(text: str) -> int:
    if len(text) < 400:
        return -1
    skipped = len(text) // 2
    found = re.finditer(r"(?:\A|[\s)\].])(?:\[([0-9]{1,3})\]|([0-9]{1,3})\.)\s+(?=[A-Z\u4e00-\u9fff])", text[skipped:])
    hits = [(m.start(), n) for m in found if (n := int(m[1] or m[2])) >= 1]
    for (i, a), (_, b), (k, c) in zip(hits, hits[1:], hits[2:], strict=False):
        if k - i <= 4000 and a <= 5 and a < b < c:
            return skipped + i
    return -1


def test_markers_in_whole_texts(spark, sf_dir):
    draw = random.Random(7)
    parts = ["[0] A", " [1] Ab", "\n2. Cd", ".[3] 中", ") 4. E", " [7] G", "[12] X", "9. y", "word " * 30, "w" * 4000, "\n", "\u00a0[5]\u3000Z", "x" * 90]
    run = "[1] Aa b. [2] Bb c. [3] Cc d. "
    texts = ["", run, run + "word " * 400, "word " * 400 + run, run + "word " * 400 + run, "a" * 370 + run[:-1], "a" * 369 + run[:-1]]
    texts += ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(400)]
    found = {r["k"]: r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", S.references_by_marker(F.col("t")).alias("s")).collect()}
    assert found == {k: marker_of(t) for k, t in enumerate(texts)}
    assert found[2] == -1 and found[3] == 1999 and sum(v >= 0 for v in found.values()) > 20
    got = sorted((r["doc_id"], r["start"]) for r in __spark_entry__.queries()["r18_references_by_marker"](spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted((r["doc_id"], marker_of(r["text"] or "")) for r in docs)


def test_cases_that_filters_left_out(spark, tmp_path):
    texts = ["Li Wang Yu Wang more words of text", None, "Le Wang Yo Wang more words", "a/b %%EOF", "Li Wang Bo Wang /Encrypt", "x\\y/z w", "y " * 60000 + "/end"]
    rows = [(2 * i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    rows.append((11, "an /Encrypt dictionary, %%EOF", "en", "s0", 29))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    queries = __spark_entry__.queries()
    run = lambda name: [tuple(r) for r in queries[name](spark, str(tmp_path)).collect()]
    assert dict(run("f26_safe_file_name")) == {0: "_Li_Wang_Yu_Wang_more_words_of_text.tex", 2: None, 4: "_Le_Wang_Yo_Wang_more_words.tex", 6: "b_EOF.tex", 8: "Encrypt.tex", 10: "z_w.tex", 12: "end.tex", 11: "Encrypt_dictionary_EOF.tex"}
    assert dict(run("s15_upload_status")) == {0: "ok", 2: "encrypted", 4: "unsupported", 6: "ok", 8: "ok", 10: "ok", 12: "encrypted", 11: "encrypted"}
    names = spark.createDataFrame([(2 * i, t, "en", "s0", 1) for i, t in enumerate(["Anna Wang Bob Lee", "Anne Wang Bob Lee", "Anna Wang Rob Lee"])], "doc_id long, text string, lang string, source string, n_chars long")
    names.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert set(run("f09_class_conflicts")) == {("wang", "anna", "anne"), ("lee", "bob", "rob")}
    assert len(run("f09_name_classes")) == 6
