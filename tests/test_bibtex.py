"""BibTeX in columns against a reader that goes character by character."""

from __future__ import annotations

import random
import re

from sievework.sources.bibtex import bibtex_fields


def brute(text: str) -> list[tuple]:
    entries, depth, start, number = [], 0, None, 0
    for i, c in enumerate(text):
        if c == "@" and depth == 0:
            start, number = i, number + 1
        elif c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0 and start is not None:
                entries.append((number, text[start : i + 1]))
                start = None
    fields, macros = [], {}
    for number, entry in entries:
        head, body = entry.split("{", 1)
        kind = re.fullmatch(r"@\s*(\w+)\s*", head)
        if not kind or kind[1].lower() in ("comment", "preamble"):
            continue
        parts, part, depth, quoted = [], "", 0, False
        for c in body[:-1]:
            depth += (c == "{") - (c == "}")
            if c == '"' and depth == 0:
                quoted = not quoted
            if c == "," and depth == 0 and not quoted:
                parts.append(part)
                part = ""
            else:
                part += c
        parts.append(part)
        kind = kind[1].lower()
        for part in parts if kind == "string" else parts[1:]:
            if m := re.fullmatch(r"\s*([\w\-:.]+)\s*=\s*(.*?)\s*", part, re.S):
                if kind == "string":
                    macros[m[1].lower()] = m[2]
                else:
                    fields.append((number, kind, " ".join(parts[0].split()), m[1].lower(), m[2]))
    out = []
    for *front, value in fields:
        if not re.search(r'[{}"]', value):
            value = macros.get(value.lower(), value)
        value = re.sub(r'^"(.*)"$', r"\1", value, flags=re.S)
        out.append((*front, " ".join(re.sub("[{}]", "", value).split())))
    return sorted(out)


def test_against_characters(spark):
    draw = random.Random(1)
    bits = ["{", "}", "{", "}", ",", '"', "@", "@article{k,", "@string{m = {M x}}", "@comment{", "a = ", "b=", "m", "12", " ", "\n", "x y", "title = {T {U} v}", "= "]
    texts = [draw.choice(["", "@article{k,"]) + "".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) + draw.choice(["", "}", "}}"]) for _ in range(400)]
    texts += ['@Book{ key one , Title = {A {B {C}} D}, note = "x, {y, "z"} w", year=1999, pub = M, }@string{m="The \n Press"}', "", "no entries", "}}@misc{k, a={1}}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None)]
    found: dict = {}
    for r in bibtex_fields(spark.createDataFrame(rows, "f long, t string"), "f", "t").collect():
        found.setdefault(r["f"], []).append((r["entry"], r["type"], r["cite_key"], r["name"], r["value"]))
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
    assert len(found) > 30
    assert (1, "book", "key one", "title", "A B C D") in found[400] and (1, "book", "key one", "pub", "The Press") in found[400]


def test_entries_of_a_file(spark):
    text = '@article{k1, title = {A {Nested} Title}, author="One, A and Two, B", year=2019}\n@comment{x, y}\n@book{k2, title = "B", }'
    found = bibtex_fields(spark.createDataFrame([(1, text)], "f long, t string"), "f", "t").collect()
    assert sorted((r["cite_key"], r["name"], r["value"]) for r in found) == [("k1", "author", "One, A and Two, B"), ("k1", "title", "A Nested Title"), ("k1", "year", "2019"), ("k2", "title", "B")]
