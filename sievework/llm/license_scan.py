"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Tokens are runs of letters, digits and non-ASCII bytes, ASCII letters lower-cased, so punctuation and
line breaks don't matter. Texts and templates are taken as shingles of five tokens. Text windows of
WINDOW shingles begin at every STRIDE-th shingle; templates are indexed by all their runs of
PART = WINDOW - STRIDE + 1 shingles (or whole, if shorter), and every such run lies whole inside
some text window. A window that holds one indexed run of p shingles agrees with it in a MinHash band of
one row with probability p / WINDOW at least, so some of the BANDS bands retrieves it with
probability 1 - (1 - p / WINDOW)^BANDS: above 1 - 1.1e-6 even for a template of a single shingle, and
above 1 - 1e-28 for one of three. A retrieved template is then verified: at least `containment` of its
distinct shingles must be in the text. All of them are counted; shingles are told apart by hashes of 61 bits at a point that
the run draws (`_text.Spans`).

Templates are a bounded list: the notices and full texts that go with the code, or the caller's own
(a dict, or a folder of text files by `read_templates`). Texts never leave their partition, so there
is no shuffle.

Defined results: null and empty texts match nothing; templates of fewer than five tokens are refused;
very long texts are windowed whole; equally good templates are all reported;
a text that is repeated in the table is reported for each of its rows; an empty table gives no rows;
only the text and the carried columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import hash_key, map_batches, schema_of, text_or_empty
from ._text import BYTE_VALUES, U64, Spans, buffers, mix64, shingles, slices, words
from .license_texts import LICENSE_TEXTS

SHINGLE, WINDOW, STRIDE, BANDS = 5, 4, 2, 48
PART = WINDOW - STRIDE + 1
#: Bounds of a caller's templates, which go to every task.
MAX_TEMPLATES, MAX_TEMPLATE_BYTES = 5000, 16 << 20

# The public wording of license notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

TEMPLATES = NOTICES | LICENSE_TEXTS

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_SOLID = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 48) & (_CODES <= 57)) | (_CODES >= 128)
GAPS = ~_SOLID
LOWER_VALUES = BYTE_VALUES[np.where(_UPPER, _CODES + 32, _CODES)]
_SEEDS = mix64(np.arange(1, 2 * BANDS + 1, dtype=U64))
ADD, TIMES = (_SEEDS[:BANDS] >> U64(32)).astype(np.uint32), (_SEEDS[BANDS:] >> U64(32)).astype(np.uint32) | np.uint32(1)


def token_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first shingle of each row, token starts, ends, first token of each row)."""
    starts, ends, first = words(data, offsets, GAPS)
    keys, own = shingles(Spans(LOWER_VALUES[data]).hash(starts, ends), first, SHINGLE)
    return keys, own, starts, ends, first


def _band(keys: np.ndarray, j: int) -> np.ndarray:
    return ((keys >> U64(32)).astype(np.uint32) ^ ADD[j]) * TIMES[j]


class Index:
    """The band keys of the templates' runs: for each band sorted minima with their templates, and a table to look up first."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.sets = sorted(templates), []
        parts: list[tuple[np.ndarray, int]] = []
        for at, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), dtype=np.uint8)
            keys, _, starts, _, _ = token_shingles(raw, np.array([0, len(raw)]))
            if len(starts) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} tokens")
            self.sets.append(np.unique(keys))
            size = min(PART, len(keys))
            parts += [(keys[i : i + size], at) for i in range(len(keys) - size + 1)]
        self.minima, self.of, self.tables = [], [], []
        for j in range(BANDS):
            low = np.array([_band(keys, j).min() for keys, _ in parts])
            order = np.argsort(low, kind="stable")
            table = np.zeros(1 << 16, dtype=bool)
            table[low >> 16] = True
            self.minima.append(low[order])
            self.of.append(np.array([at for _, at in parts])[order])
            self.tables.append(table)

    def candidates(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Pairs (row, template), as rows of an array, that some band retrieves. Windows end where their row ends."""
        if not len(keys):
            return np.zeros((0, 2), np.int64)
        size = np.diff(own)
        begins = np.concatenate([[0], np.cumsum(-(-size // STRIDE) * STRIDE + WINDOW)])
        row = np.repeat(np.arange(len(size)), size)
        place = begins[row] + np.arange(len(keys)) - own[row]
        at = np.arange(0, begins[-1] - WINDOW + 1, STRIDE)
        of = np.searchsorted(begins, at, side="right") - 1
        inside = at - begins[of] < size[of]
        at, of = at[inside], of[inside]
        found, hashed = [], np.full(begins[-1], 0xFFFFFFFF, dtype=np.uint32)
        for j in range(BANDS):
            hashed[place] = _band(keys, j)
            low = hashed[at]
            for step in range(1, WINDOW):
                low = np.minimum(low, hashed[at + step])
            maybe = np.flatnonzero(self.tables[j][low >> 16])
            begin, end = (np.searchsorted(self.minima[j], low[maybe], side=s) for s in ("left", "right"))
            hits = np.repeat(maybe, end - begin)
            if len(hits):
                nth = np.arange(len(hits)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
                found.append(np.stack([of[hits], self.of[j][np.repeat(begin, end - begin) + nth]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def read_templates(spark: SparkSession, folder: str, most: int = MAX_TEMPLATES, most_bytes: int = MAX_TEMPLATE_BYTES) -> dict[str, str]:
    """Templates from a folder of text files, named by their files without the ending; refused if there are too many or they are too large."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = spark.read.text(folder, wholetext=True).select(name.alias("name"), "value")
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).first()
    if size["n"] > most or size["bytes"] > most_bytes:
        raise ValueError(f"{size['n']} templates of {size['bytes']} bytes; at most {most} of {most_bytes} bytes")
    return {r["name"]: r["value"] for r in files.collect()}


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """A row for each license found in a document: carried columns (default doc_id), license,
    n_shared, n_shingles (distinct shingles of the template: in the text, in all) and spans
    (array<struct<start, end>>: byte ranges of the text that its shingles cover, merged)."""
    carry = ["doc_id"] if carry is None else carry
    hash_key(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates)
    plain = docs.select(*(F.col(f"`{c}`") for c in carry), text_or_empty(text).alias("_text"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            data, offsets = buffers(part.column("_text"))
            keys, own, starts, ends, first = token_shingles(data, offsets)
            out = []
            for row, at in index.candidates(keys, own).tolist():
                mine, wanted = keys[own[row] : own[row + 1]], index.sets[at]
                if first[row + 1] - first[row] < SHINGLE:
                    continue
                place = np.flatnonzero(np.isin(mine, wanted))
                shared = len(np.unique(mine[place]))
                if shared and shared >= containment * len(wanted) - 1e-9:
                    begin = starts[first[row] + place] - offsets[row]
                    end = ends[first[row] + place + SHINGLE - 1] - offsets[row]
                    new = np.concatenate([[True], begin[1:] > end[:-1]])
                    spans = [{"start": s, "end": e} for s, e in zip(begin[new].tolist(), end[np.concatenate([np.flatnonzero(new)[1:], [len(end)]]) - 1].tolist(), strict=True)]
                    out.append((row, index.names[at], shared, len(wanted), spans))
            row, name, shared, size, spans = zip(*out, strict=True) if out else ((), (), (), (), ())
            at = pa.array(row, pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in carry), pa.array(name, pa.string()), pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, kind)], names=[*carry, "license", "n_shared", "n_shingles", "spans"])

    return map_batches(plain, rows, schema_of(plain.drop("_text"), ("license", "string"), ("n_shared", "bigint"), ("n_shingles", "bigint"), ("spans", "array<struct<start: bigint, end: bigint>>")))
