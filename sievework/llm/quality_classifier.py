"""Quality classifier by co-training.

Two views of a document: its *text content* (hashed word frequencies, character and repetition
statistics) and its *page metadata* (source, language, stated length, and the layout of the page: how
many lines there are, how long they are, what they begin and end with, and marks of cells; no word is
read). Each has a logistic classifier. Both start from the labelled
documents; then over ROUNDS rounds each gives the other the unlabelled documents that it is most sure
of as pseudo-labels, as many of each class as the classes' shares allow. Both are then calibrated on
labelled documents that neither was trained on, and a logistic layer over the two calibrated log odds,
fitted there too with weights of zero or more, gives the score.

The second view is for the most part one of layout, which is read off the text; what is metadata in the strict sense
(source, language, stated length) tells little on its own. Rounds help where both views are weak and independent; where
one is all but perfect from its labels on, as on the given tables, they change nothing or lose a little.

Training takes a bounded sample of labelled documents only: MAX_LABELLED, those with the least hashes of
their ids. The pool of pseudo-labels is every unlabelled document: features are written once, each round
scores all of them on Spark, and the surest rows that a view tells the other, SHARE_A_ROUND of the pool but
A_ROUND at most, come to the driver. Scoring reads every document, by numpy passes over Arrow batches, with no shuffle.

Defined results: null texts are empty; null sources and languages are values of their own; documents
with several labels count with the mean of them, several documents of one id as one of them in training; labels of unknown documents and null labels are left
out, and so are rows without an id, in training; texts of any length are read whole; ties in sureness go by a hash of
the id; without labels of both classes every score is the share of good ones (1 if there are none, so
nothing is rejected); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from ._spark import map_batches, schema_of, settle, text_or_empty
from ._text import U64, buffers, mix64, slices, word_hashes, words

#: Bounds of the labelled sample, and of the pseudo-labels that a view gives in a round.
MAX_LABELLED, A_ROUND = 4000, 200
ROUNDS, SURE, SHARE_A_ROUND = 5, 0.95, 0.05
#: Features are binned by hashes of a fixed key, so that a model means the same in every run.
FIXED = 1
WORD_BINS, NAME_BINS = 512, 32
THRESHOLD = 0.5

_CODES = np.arange(256)
CLASSES = (
    (_CODES >= 65) & (_CODES <= 90),  # capitals
    (_CODES >= 97) & (_CODES <= 122),  # small letters
    (_CODES >= 48) & (_CODES <= 57),  # digits
    _CODES >= 128,  # bytes beyond ASCII
    np.isin(_CODES, np.frombuffer(b".,;:'\"-()", dtype=np.uint8)),  # prose marks
    np.isin(_CODES, np.frombuffer(b"!?", dtype=np.uint8)),
    np.isin(_CODES, np.frombuffer(b"#*$%&|<>=+/\\_{}[]@^~`", dtype=np.uint8)),  # symbols
)


def _per(total: np.ndarray, of: np.ndarray) -> np.ndarray:
    return total / np.maximum(of, 1)


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Content features of each row: hashed word frequencies and statistics."""
    starts, ends, first = words(data, offsets)
    n, n_words = len(offsets) - 1, np.diff(first)
    row = np.repeat(np.arange(n), n_words)
    hashes = word_hashes(data, starts, ends, FIXED)
    bins = np.bincount(row * WORD_BINS + (hashes % U64(WORD_BINS)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    found = quality_rules.measure(data, offsets)
    pair = mix64(hashes ^ mix64(row.astype(U64) + U64(1)))
    _, at = np.unique(pair, return_index=True)
    distinct = np.bincount(row[at], minlength=n)
    size = np.diff(offsets)
    stats = [_per(quality_rules._sums(c[data], offsets), size) for c in CLASSES]
    lengths = ends - starts
    mean = _per(np.bincount(row, weights=lengths, minlength=n), n_words)
    spread = np.sqrt(np.maximum(_per(np.bincount(row, weights=lengths.astype(np.float64) ** 2, minlength=n), n_words) - mean**2, 0))
    stats += [mean / 10, spread / 10, _per(distinct, np.sqrt(n_words + 1.0)) / 10, _per(distinct, n_words), _per(found["n_repeat_words"], n_words), _per(found["n_symbols"], n_words), n_words == 0]
    return np.hstack([np.sqrt(bins / np.maximum(n_words, 1)[:, None]) * 4, np.column_stack([np.asarray(s, dtype=np.float64) for s in stats]) * 4]).astype(np.float32)


def _named(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    full = np.flatnonzero(np.diff(offsets))
    at = np.zeros(len(offsets) - 1, dtype=np.int64)
    if len(full):
        at[full] = 1 + (word_hashes(data, offsets[:-1][full], offsets[1:][full], FIXED) % U64(NAME_BINS - 1)).astype(np.int64)
    return np.eye(NAME_BINS, dtype=np.float32)[at]


def _layout(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row's lines that are not empty: what they begin and end with, and their lengths."""
    n = len(offsets) - 1
    start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    row = np.searchsorted(offsets, start, side="right") - 1
    end = end - (data[np.maximum(end, 1) - 1] == 10) if len(start) else end
    full = end > start
    start, end, row = start[full], end[full], row[full]
    size, count = end - start, np.bincount(row, minlength=n)
    first, last = data[start], data[end - 1]
    share = lambda flag: _per(np.bincount(row[flag], minlength=n), count)
    mean = _per(np.bincount(row, weights=size, minlength=n), count)
    spread = np.sqrt(np.maximum(_per(np.bincount(row, weights=size.astype(np.float64) ** 2, minlength=n), count) - mean**2, 0))
    ends = [share(np.isin(last, np.frombuffer(marks, dtype=np.uint8))) for marks in (b".", b"!?", b",;:", b"|*#$%&-")]
    begins = [share((first >= 65) & (first <= 90)), share(np.isin(first, np.frombuffer(b"-*#|>", dtype=np.uint8)))]
    cells = _per(quality_rules._sums(data == 124, offsets), count) / 4
    return [*ends, *begins, share(size < 40), share(size > 400), np.log1p(mean) / 8, np.log1p(spread) / 8, np.log1p(cells)]


def page_view(data: np.ndarray, offsets: np.ndarray, source: pa.Array, lang: pa.Array, stated: np.ndarray) -> np.ndarray:
    """Metadata features of each row: names, lengths and layout; no word is read."""
    breaks = quality_rules._sums(data == 10, offsets)
    size = np.diff(offsets)
    blank = np.zeros(len(data), dtype=bool)
    blank[1:] = (data[1:] == 10) & (data[:-1] == 10)
    bits = [np.log1p(size) / 8, np.log1p(np.maximum(stated, 0)) / 8, np.log1p(breaks) / 4, np.log1p(size / (breaks + 1)) / 8, _per(quality_rules._sums(blank, offsets), breaks), size < 64, size > 16384, np.abs(stated - size) > 0.5 * size]
    lengths = np.log1p(size)[:, None]
    hat = np.maximum(0, 1 - np.abs(lengths - np.arange(0, 14)[None, :]))
    columns = [np.asarray(b, dtype=np.float64) for b in (*bits, *(4 * x for x in _layout(data, offsets)))]
    return np.hstack([_named(source), _named(lang), np.column_stack(columns), hat]).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200, start: np.ndarray | None = None, signed: bool = True) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient descent on the log loss, in single precision.

    signed: if not, all weights but the bias stay at zero or more."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    penalty = np.full(x.shape[1], ridge, dtype=np.float32)
    penalty[-1] = 0
    step = np.float32(1 / (0.25 * float((x**2).sum(axis=1).mean()) + ridge))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32) if start is None else start
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * ((p - y) @ x / np.float32(len(x)) + penalty * ahead)
        if not signed:
            new[:-1] = np.maximum(new[:-1], 0)
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def logit_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    """Classifiers of the two views, their calibrations (slope, offset), and the layer over both."""

    text: np.ndarray | None
    page: np.ndarray | None
    text_scale: tuple[float, float] = (1.0, 0.0)
    page_scale: tuple[float, float] = (1.0, 0.0)
    layer: tuple[float, float, float] = (0.5, 0.5, 0.0)
    prior: float = 1.0

    def views(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of the views."""
        return tuple(scale[0] * logit_of(x, w) + scale[1] for x, w, scale in ((text, self.text, self.text_scale), (page, self.page, self.page_scale)))

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.prior)
        a, b = self.views(text, page)
        return 1 / (1 + np.exp(-np.clip(self.layer[0] * a + self.layer[1] * b + self.layer[2], -30, 30)))


class Pool:
    """Every unlabelled document, one row per id, with its features in the shared folder."""

    def __init__(self, features: DataFrame, ids: DataFrame):
        self.features, self.ids = features, settle(ids, "pool")
        self.size = self.ids.count()

    def surest(self, models: list[np.ndarray], scales: list[tuple[float, float]], told: tuple[dict, dict], most: dict[float, int]) -> list[tuple[int, float, int]]:
        """(view, class, row) of the rows each view is most sure of and has not told the other yet."""
        bound = float(np.log(SURE / (1 - SURE)))

        def odds(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not batch.num_rows:
                return
            found = [np.round(scales[v][0] * logit_of(x, models[v]).astype(np.float64) + scales[v][1], 5) for v, x in enumerate(_arrays(batch))]
            sure = pa.array(np.flatnonzero(np.maximum(np.abs(found[0]), np.abs(found[1])) >= bound))
            yield pa.RecordBatch.from_arrays([batch.column("_uid").take(sure), *(pa.array(x).take(sure) for x in found)], names=["_uid", "_odds0", "_odds1"])

        scored = map_batches(self.features.select("_uid", "_text", "_page"), odds, "_uid bigint, _odds0 double, _odds1 double")
        sure = settle(scored.join(self.ids, "_uid"), "sure")
        out = []
        for v in (0, 1):
            known = list(told[1 - v])
            for good, sign in ((1.0, 1), (0.0, -1)):
                rows = sure.where(F.col(f"_odds{v}") * sign >= bound)
                rows = rows.where(~F.col("_uid").isin(known)) if known else rows
                best = rows.orderBy(F.col(f"_odds{v}") * -sign, "_draw", "_uid").limit(most[good]).select("_uid").collect()
                out += [(v, good, r["_uid"]) for r in best]
        return out

    def fetch(self, rows: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Features of these rows."""
        if not rows:
            return {}
        found = self.features.where(F.col("_uid").isin(rows)).select("_uid", "_text", "_page").toArrow()
        return dict(zip(found.column("_uid").to_pylist(), zip(*_arrays(found), strict=True), strict=True))


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([np.frombuffer(r, dtype=np.float32) for r in rows.column(n).to_pylist()]) for n in ("_text", "_page"))


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool: Pool, a_round: int = A_ROUND, rounds: int = ROUNDS) -> Model:
    """y: 1 good, 0 bad. Every fourth labelled row is held out for calibration."""
    labelled = np.arange(len(y))
    prior = float(np.mean(y))
    held, train = labelled[3::4], labelled[labelled % 4 != 3]
    if any(len(np.unique(y[part] >= 0.5)) < 2 for part in (held, train)):
        return Model(None, None, prior=prior)
    hard = (y >= 0.5).astype(np.float64)
    views, told, brought = (text, page), ({}, {}), {}

    def fit(v: int, start: np.ndarray | None = None) -> np.ndarray:
        x = np.vstack([views[v][train], *(brought[r][v][None, :] for r in told[v])])
        return fit_logistic(x, np.concatenate([hard[train], np.array(list(told[v].values()), dtype=np.float64)]), steps=250 if start is None else 60, start=start)

    def scale(logits: np.ndarray) -> tuple[float, float]:
        spread = float(np.std(logits)) or 1.0
        w = fit_logistic((logits / spread)[:, None], hard[held], ridge=1e-4, steps=400)
        return max(float(w[0]) / spread, 0.0), float(w[1])

    models = [fit(0), fit(1)]
    most = {good: int(np.ceil(min(SHARE_A_ROUND * pool.size, a_round) * share)) for good, share in ((1.0, prior), (0.0, 1 - prior))}
    for _ in range(rounds if pool.size else 0):
        scales = [scale(logit_of(views[v][held], models[v])) for v in (0, 1)]
        chosen = pool.surest(models, scales, told, most)
        if not chosen:
            break
        brought |= pool.fetch(sorted({r for _, _, r in chosen} - brought.keys()))
        for v, good, row in chosen:
            told[1 - v][row] = good
        models = [fit(0, models[0]), fit(1, models[1])]
    scales = [scale(logit_of(views[v][held], models[v])) for v in (0, 1)]
    odds = np.column_stack([s[0] * logit_of(views[v][held], models[v]) + s[1] for v, s in enumerate(scales)])
    layer = fit_logistic(np.clip(odds, -10, 10), hard[held], ridge=1e-3, steps=600, signed=False)
    return Model(models[0], models[1], scales[0], scales[1], tuple(float(x) for x in layer), prior)


@dataclass(frozen=True)
class Columns:
    id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    lang: str = "lang"
    n_chars: str = "n_chars"


def _plain(docs: DataFrame, c: Columns, carry: list[str]) -> DataFrame:
    names = (F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(a) for n, a in ((c.source, "_source"), (c.lang, "_lang")))
    return docs.select(*(F.col(f"`{n}`") for n in carry), text_or_empty(c.text).alias("_text"), *names, F.coalesce(F.col(f"`{c.n_chars}`").cast("long"), F.lit(0)).alias("_stated"))


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(part.column("_text"))
    return text_view(data, offsets), page_view(data, offsets, part.column("_source"), part.column("_lang"), part.column("_stated").to_numpy())


def train(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), target: str = "quality", max_labelled: int = MAX_LABELLED, a_round: int = A_ROUND, rounds: int = ROUNDS) -> Model:
    """Co-train on a bounded sample of the labelled and on all other `docs`, with labels (id, target 0 or 1)."""
    known = labels.where(F.col(columns.id).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(columns.id).alias("_id")).agg(F.avg(target).cast("double").alias("_y"))
    plain = _plain(docs.where(F.col(f"`{columns.id}`").isNotNull()), columns, [columns.id]).withColumnRenamed(columns.id, "_id").withColumn("_hash", F.xxhash64("_text", "_source", "_lang", "_stated"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_hash"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in _views(part))], names=["_id", "_hash", "_text", "_page"])

    found = map_batches(plain, rows, schema_of(plain.select("_id", "_hash"), ("_text", "binary"), ("_page", "binary")))
    features = settle(found.withColumn("_uid", F.monotonically_increasing_id()), "features")
    ids = settle(features.groupBy("_id").agg(F.min(F.struct("_hash", "_uid")).alias("r")).select("_id", "r._uid"), "ids")
    chosen = ids.join(known, "_id").orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(max_labelled)
    sample = features.select("_uid", "_text", "_page").join(F.broadcast(chosen), "_uid").select(F.col("_id").cast("string"), "_y", "_text", "_page").toArrow().sort_by([("_id", "ascending")])
    if not sample.num_rows:
        return Model(None, None)
    y = np.array(sample.column("_y").to_pylist(), dtype=np.float64)
    pool = Pool(features, ids.join(known, "_id", "left_anti").select("_uid", F.xxhash64("_id", F.lit(2)).alias("_draw")))
    return co_train(*_arrays(sample), y, pool, a_round, rounds)


def score(docs: DataFrame, model: Model, columns: Columns = Columns(), carry: list[str] | None = None) -> DataFrame:
    """Carried columns (default the id), score, text_odds, page_odds (calibrated log odds of the views) and kept."""
    carry = [columns.id] if carry is None else carry
    plain = _plain(docs, columns, carry)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            text, page = _views(part)
            total = model.score(text, page)
            odds = model.views(text, page) if model.text is not None else (np.zeros(len(total)),) * 2
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(np.asarray(v, dtype=np.float64)) for v in (total, *odds)), pa.array(total >= THRESHOLD)], names=[*carry, "score", "text_odds", "page_odds", "kept"])

    return map_batches(plain, rows, schema_of(plain.drop("_text", "_source", "_lang", "_stated"), ("score", "double"), ("text_odds", "double"), ("page_odds", "double"), ("kept", "boolean")))
