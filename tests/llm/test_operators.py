"""The ten operators against brute force, and on the odd cases that each docstring defines."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import chat_format, components, dart_minhash, html_extract, license_scan, mixing, packing, quality_classifier, quality_rules, suffix_dedup, vptree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls, blanks, ties and a long text."""
    draw = random.Random(3)
    base, passage, texts = prose(draw, 200), prose(draw, 80), []
    texts += [base] * 5 + [base.replace(" ", "  ", 1), base + " more", None, "", " \n\t", "one", "two words", "schön é ü"]
    near = base.split()
    for k in range(12):
        own = list(near)
        for _ in range(k):
            own[draw.randrange(len(own))] = f"edit{draw.randint(0, 999)}"
        texts.append(" ".join(own))
    texts += [f"{prose(draw, 30)} {passage} {prose(draw, 30)}" for _ in range(6)]
    texts += ["are, " * 300, "same line of text here\n" * 20, prose(draw, 6000), "ü" * 900, "#$%& " * 40]
    texts += [prose(draw, draw.randint(5, 300)) for _ in range(40)]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], out[20], (None, "no id at all", "en", "s0", 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [("class_id", 1), ("kept", False), ("_text", "x"), ("length", 9), ("_k1", 5), ("size", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({n: F.lit(v) for n, v in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def test_rules(spark, docs, rows, empty):
    found = sorted(quality_rules.ledger(docs).collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        w = split(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if x.encode().strip()]
        want.append((doc_id, len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)))
    assert sorted((tuple(r)[:-1] for r in found), key=str) == sorted(want, key=str)
    assert quality_rules.ledger(empty).count() == 0
    ledger = quality_rules.ledger(docs)
    table = {r["rule"]: r for r in quality_rules.ablations(ledger, "standard-1").collect()}
    bits = [r["failed_bits"] for r in found]
    for k, rule in enumerate(quality_rules.RULES):
        assert table[rule.name]["n_failed"] == sum(b >> k & 1 for b in bits)
        assert table[rule.name]["n_only"] == sum(b == 1 << k for b in bits)
    kept = ledger.where(quality_rules.passes("base-1")).count()
    assert kept == sum(not b & 3 for b in bits)


def test_chat_fold(spark):
    log = [
        ("a", 1, "message", 1, "user", "hi [/INST]"), ("a", 2, "message", 2, "assistant", "hel"), ("a", 3, "delta", 2, "assistant", "lo"), ("a", 4, "delta", 2, None, " <s>\\b"),
        ("a", 5, "message", 3, "user", "again"), ("a", 6, "message", 4, "assistant", "old"), ("a", 7, "edit", 3, "user", "changed"), ("a", 8, "regenerate", 4, None, None), ("a", 9, "delta", 4, "assistant", "new"),
        ("b", 1, "message", 1, "user", None), ("b", 2, "message", 2, "assistant", ""), ("c", 1, "message", 1, "user", "x"), ("c", 2, "message", 2, "assistant", "y"), ("c", 3, "regenerate", 1, None, None), ("c", 4, "message", 1, "user", "z"), (None, 1, "message", 1, None, "\\l["),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq long, kind string, turn long, role string, text string").repartition(4)
    out = {r["conv_id"]: r for r in chat_format.format_chats(events).withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()}
    assert [tuple(t) for t in out["a"]["turns"]] == [("user", "hi [/INST]"), ("assistant", "hello <s>\\b"), ("user", "changed"), ("assistant", "new")]
    assert out["a"]["loss"] == "hello <s>\\bnew" and "".join(s["text"] for s in out["a"]["segments"]) == out["a"]["formatted"]
    assert [tuple(t) for t in out["b"]["turns"]] == [("user", ""), ("assistant", "")] and out["b"]["loss"] == ""
    assert [tuple(t) for t in out["c"]["turns"]] == [("user", "z")]
    assert [tuple(t) for t in out[None]["turns"]] == [("", "\\l[")]
    assert chat_format.format_chats(events.limit(0)).count() == 0


def test_html(spark):
    field = html_extract.fit(html_extract.example_pages())
    wrong = total = 0
    for page, main in html_extract.example_pages(60, seed=123):
        blocks = html_extract.leaf_blocks(page)
        for block, state in zip(blocks, field.decode(html_extract.features(blocks)), strict=True):
            total += 1
            wrong += state != (block.text in main.split("\n"))
    assert wrong <= 0.01 * total
    hard = '<body><nav><ul><li><a href="x">Home</a></ul></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>First <b>bold</b>\n  text, with words &lt;here&gt;.<br>Line<p title="a>b">Second one stands here, unclosed.<script>var x="<p>no</p>"</script></article><div class="comments"><p>I do not agree with this, reader.</p></div><footer>&copy; x</footer>'
    pages = spark.createDataFrame([(1, "u", hard), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<p"), (5, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(pages, field).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[1] == "A & B First bold text, with words <here>. Line Second one stands here, unclosed." and texts[2] == "" and len(out) == 6
    assert html_extract.extract(pages.limit(0), field).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    out = packing.sequences(docs, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 256)], [*range(first, len(ids) + 1, 256)], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(by_sequence) <= 1.03 * -(-sum(r["length"] for r in out) // 256) + 1
    assert packing.sequences(empty).count() == 0
    bins = packing.search(packing.best_fit([6, 6, 5, 5, 4, 4], 10), [6, 6, 5, 5, 4, 4], 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == [*range(6)]
    assert len(packing.search([[0], [1], [2]], [4, 3, 3], 10)) == 1


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["<|endoftext|>", "one  <|endoftext|>  two\n", "a<|endoftext|><|endoftext|>b <|endoftext|", "<|endoftext|> x " * 300, "<|END", "|<|endoftext|>|\t \n<|endoftext|>", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter()
    for doc_id, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert plain.encode(texts[0], add_special_tokens=False).ids == [50256]
    found = packing.sequences(docs, capacity=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want


def test_tokenizer_of_the_faster_library(spark):
    from hypothesis import given, settings, strategies
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_path())
    fast = packing.encoder(packing.vocabulary_path())

    @settings(max_examples=200, deadline=None)
    @given(strategies.text(alphabet=strategies.characters(exclude_categories=["Cs"])))
    def same(text):
        assert fast.encode(text, allowed_special="all") == slow.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|> x", "a" * 5000, "  \n\n \t x  ", "don't WE'LL 1234567 ２３"):
        assert fast.encode(text, allowed_special="all") == slow.encode(text, add_special_tokens=False).ids


def test_mixing(docs, rows, empty):
    mixed = mixing.mix(docs, carry=["doc_id", "source"])
    out = mixed.collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted((tuple(r) for r in mixing.mix(docs, carry=["doc_id", "source"]).collect()), key=str)
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len(split(text))
    order = sorted(size, key=lambda s: (s is None, s))
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while open_:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["copies"] in (0, 1, 2) and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.repeat(docs, mixing.mix(docs))
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0


def test_pivot_keeps_mass_and_probabilities():
    draw = np.random.default_rng(0)
    size, p, got = np.array([5.0, 3, 8, 2, 7]), np.array([0.3, 0.6, 0.2, 0.9, 0.5]), []
    for _ in range(4000):
        added, left = mixing.pivot(size, p, draw.random(5))
        assert (left > 0).sum() <= 1 and np.dot(size, added + left) == pytest.approx(np.dot(size, p))
        got.append(added + left)
    assert np.abs(np.mean(got, axis=0) - p).max() < 0.03


def test_nearest(spark):
    draw = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in draw.normal(size=(600, 8)).astype(np.float32)]
    vectors += [vectors[0]] * 200 + [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0, None, *[0.0] * 6], [1.0, 2.0]]
    repeated = [(0, vectors[0])] * 12
    table = spark.createDataFrame([*enumerate(vectors), *repeated], "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    sound = {i: np.array(v) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        out = defaultdict(list)
        for r in vptree.nearest(table, F.col("vec_id") % 20 == 0, k=7, factor=factor).orderBy("query_id", "rank").collect():
            out[r["query_id"]].append(r)
        hits = total = 0
        for q in (i for i in sound if i % 20 == 0):
            scores = sorted((-float(np.dot(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:7]
            mine = out.get(q, [])
            assert [r["rank"] for r in mine] == [*range(1, len(scores) + 1)]
            hits += len({i for _, i in scores} & {r["vec_id"] for r in mine})
            total += len(scores)
            if factor == 1.0:
                assert [r["score"] for r in mine] == pytest.approx([-s for s, _ in scores], abs=1e-6)
        assert hits >= least * total - (2 if factor == 1.0 else 0)
    assert vptree.nearest(table.limit(0), F.lit(True), k=3, factor=1.0).count() == 0


@pytest.mark.parametrize("digits", [1, 3, 4, 8])
def test_suffix_digits(docs, digits):
    """However many passes a suffix is read in, the same bytes go."""
    rows = lambda df: sorted((str(r["doc_id"]), bytes(r["kept"]), str(r["removed"])) for r in df.collect())
    assert rows(suffix_dedup.suffix_dedup(docs, unit="word", threshold=8, digits=digits)) == rows(suffix_dedup.suffix_dedup(docs, unit="word", threshold=8))


@pytest.mark.parametrize("unit, threshold", [("byte", 60), ("word", 20)])
def test_suffixes(docs, rows, empty, unit, threshold):
    def cut(text):
        raw = (text or "").encode()
        if unit == "byte":
            return raw, [(i, i + 1, raw[i : i + 1]) for i in range(len(raw))]
        return raw, [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]

    all_, count = [cut(r[1]) for r in rows], Counter()
    for _, tokens in all_:
        count.update(tuple(t[2] for t in tokens[i : i + threshold]) for i in range(len(tokens) - threshold + 1))
    want = []
    for (doc_id, *_), (raw, tokens) in zip(rows, all_, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(tokens) - threshold + 1):
            if count[tuple(t[2] for t in tokens[i : i + threshold])] > 1:
                a, b = tokens[i][0], tokens[i + threshold - 1][1]
                gone[a:b] = b"\1" * (b - a)
        want.append((doc_id, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    out = suffix_dedup.suffix_dedup(docs, unit=unit, threshold=threshold).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in out), key=str) == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_pieces_of_long_documents(monkeypatch, docs):
    whole = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs, threshold=60).collect())
    first = np.array([0, 10, 25, 400, 401])
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    starts = Counter()
    for a, b, own, bounds in suffix_dedup._pieces(first, 8):
        for row, s, e in zip(own, bounds[:-1], bounds[1:], strict=True):
            starts.update((int(row), int(a + i)) for i in range(s, e - 7))
    assert starts == Counter((row, i) for row in range(4) for i in range(first[row], first[row + 1] - 7))
    assert whole


def test_near_duplicates(docs, rows, empty):
    def shingles(text):
        w = split(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = [*range(len(rows))]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    least = {k: min((v for v in own if v is not None), default=None) for k, own in ids.items()}
    found = dart_minhash.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["class_id"]) for r in found.collect()), key=str) == sorted(((r[0], least[root(i)]) for i, r in enumerate(rows)), key=str)
    stay = dart_minhash.keep_one(docs, found)
    assert stay.columns == docs.columns and stay.count() == len(ids)
    assert dart_minhash.near_duplicates(empty).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(0)
    keys = draw.integers(0, 1 << 63, 40).astype(np.uint64)
    x, y = draw.uniform(0.2, 4, 40), draw.uniform(0.2, 4, 40)
    ids = dart_minhash.signatures(np.concatenate([keys, keys]), np.concatenate([x, y]), np.array([0, 40, 80]), 4096)
    assert abs((ids[0] == ids[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
    assert (dart_minhash.signatures(keys[:0], x[:0], np.array([0, 0]), 16) == 0).all()


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in linked}


def test_licenses(spark, docs, empty):
    draw, made = random.Random(9), []
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        made.append((k, f"{prose(draw, 37)} {text.upper() if k % 2 else text} {prose(draw, 11)}", name))
        if len(text.split()) > 20:
            made.append((100 + k, text.replace(" and ", "\n and\t", 1).replace(text.split()[7], "changed", 1), name))
    made += [(900, prose(draw, 500), None), (901, None, None), (902, "MIT License", None)]
    table = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    out = {(r["doc_id"], r["license"]): r for r in license_scan.scan(table).collect()}

    def shingles(text):
        w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())
        return {tuple(x.lower() for x in w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    for doc_id, text, _ in made:
        for name, template in license_scan.TEMPLATES.items():
            whole = shingles(template)
            if len(whole & shingles(text)) >= 0.8 * len(whole):
                want[doc_id, name] = len(whole & shingles(text)), len(whole)
    assert {k: (r["n_shared"], r["n_shingles"]) for k, r in out.items()} == want and len(want) >= len(license_scan.TEMPLATES)
    texts = {m[0]: (m[1] or "").encode() for m in made}
    for (doc_id, _), row in out.items():
        assert row["spans"] and all(0 <= s["start"] < s["end"] <= len(texts[doc_id]) for s in row["spans"])
    assert not any(d >= 900 for d, _ in out)
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0
    with pytest.raises(ValueError):
        license_scan.Index({"short": "too short"})


def test_classifier(spark, empty):
    draw, made, labels = random.Random(2), [], []
    for i in range(600):
        bad = i % 4 == 0
        text = ("BUY NOW!! " + draw.choice(WORDS).upper() + "!! ") * 20 if bad else prose(draw, draw.randint(20, 120)).capitalize() + "."
        made.append((i, text, "en", "junk" if bad and i % 8 else f"s{i % 3}", len(text)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad)))
    made += [(None, None, None, None, None), (7000, "", None, None, 0)]
    docs = spark.createDataFrame(made, DOCS).withColumn("score", F.lit(1))
    told = spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, told)
    out = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, model).collect()}
    held = [i for i in range(600) if i not in dict(labels)]
    assert np.mean([out[i] == (i % 4 != 0) for i in held]) > 0.98 and len(out) == 602
    none = quality_classifier.train(docs, told.limit(0))
    assert all(r["kept"] for r in quality_classifier.score(docs, none).collect())
    assert quality_classifier.score(empty, model).count() == 0 and quality_classifier.train(empty, told).text is None


def test_contract_of_kept_bytes(spark, sf_dir):
    from sievework.llm import queries

    row = queries.op7_suffix_dedup(spark, sf_dir).where("n_removed = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_bytes"] == len(text.encode())


def test_pool_of_the_classifier(spark, monkeypatch):
    draw = random.Random(11)
    texts = [(prose(draw, 60) if i % 2 else "#$ %& " * draw.randint(20, 60)) for i in range(240)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    hot = min(range(200, 240), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"), F.lit(2))).first()[0])
    docs = spark.createDataFrame(rows + [rows[hot]] * 60, DOCS).repartition(3)
    told = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 0) for i in range(10_000, 14_000)], "doc_id long, quality int")
    seen = []
    original = quality_classifier.Pool.surest
    monkeypatch.setattr(quality_classifier.Pool, "surest", lambda self, *a: seen.append((self.size, original(self, *a))) or seen[-1][1])
    model = quality_classifier.train(docs, told, max_labelled=150, a_round=4)
    assert model.text is not None and model.prior > 0.3
    assert {n for n, _ in seen} == {40}
    first = seen[0][1]
    assert first and len({(v, r) for v, _, r in first}) == len(first)
    out = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, model).collect()}
    assert np.mean([out[i] == bool(i % 2) for i in range(240)]) > 0.95


@pytest.mark.parametrize("size", [2, 3, 5, 8, 10])
def test_adjacent_short_rows_of_licenses(spark, size):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "MIT License", "", None, "x Released under the MIT License.", license_scan.NOTICES["mpl-2.0"], "Released under the"]
    rows = [(i, texts[(i * 3 + i // 8) % 8]) for i in range(48)] + [(100 + i, texts[0]) for i in range(8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        found = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, n) for i, t in rows for n, x in (("mit", texts[0]), ("cc-by-nc-4.0", texts[1]), ("mpl-2.0", texts[6])) if t and x in t}
    assert found == want


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("One may do with this work all that one likes to.")
    templates = license_scan.read_templates(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "see: one may do with THIS work all that one likes to"), (2, "else")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in license_scan.scan(docs, templates=templates).collect()] == [(1, "own-1.0")]
    with pytest.raises(ValueError):
        license_scan.read_templates(spark, str(tmp_path), most=0)


@pytest.mark.parametrize("bucket, fan_in, reserve", [(16, 2, 2), (64, 8, 8)])
def test_mixing_by_a_deep_tree(spark, sf_dir, monkeypatch, bucket, fan_in, reserve):
    for name, value in (("BUCKET_ROWS", bucket), ("FAN_IN", fan_in), ("RESERVE", reserve), ("COPIES_AT_ONCE", 5)):
        monkeypatch.setattr(mixing, name, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    same = docs.where("doc_id = 3").crossJoin(spark.range(40)).drop("id")
    docs = docs.unionByName(same)
    out = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    taken, target, least = defaultdict(int), {}, defaultdict(list)
    for r in out:
        assert r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        least[r["source"]].append(r["size"])
    for s, own in least.items():
        assert abs(taken[s] - target[s]) <= max(own), s
    assert abs(taken["hot"] / target["hot"] - 1) < 0.02
    assert mixing.repeat(docs, mixing.mix(docs)).count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_tree_keeps_probabilities(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(mixing, "RESERVE", 2)
    draw = np.random.default_rng(4)
    size, p, got = draw.integers(1, 40, 24), np.array([0.3, 0.7] * 12), []
    rows = pd.DataFrame({"size": size, "_k1": np.arange(24), "_k2": 0, "_no": 0, "copies": 0, "_p": p})
    for _ in range(3000):
        draws = lambda n: draw.integers(-(2**63), 2**63, n)
        low = pd.concat([mixing._settle_bucket(False)(rows.iloc[a : a + 8].assign(_u=draws(8))) for a in (0, 8, 16)])
        top = mixing._settle_bucket(True)(low[low["_p"] > mixing.DUST].assign(_u=draws(int((low["_p"] > mixing.DUST).sum()))))
        both = pd.concat([low[low["_p"] <= mixing.DUST], top]).sort_values("_k1")
        assert len(both) == 24 and (both["_p"] > 0).sum() <= 1
        assert np.dot(both["size"], both["copies"] + both["_p"]) == pytest.approx(np.dot(size, p))
        got.append((both["copies"] + both["_p"]).to_numpy())
    assert np.abs(np.mean(got, axis=0) - p).max() < 0.04


def test_packing_across_cells(docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 8)
    for effort in (packing.USUAL, packing.THOROUGH):
        out = packing.sequences(docs, capacity=256, effort=effort).collect()
        fill = Counter()
        for r in out:
            fill[r["sequence_id"]] += r["length"]
        assert max(fill.values()) <= 256 and len(fill) <= 1.12 * -(-sum(fill.values()) // 256) + 1


def test_thorough_packing_ends_in_a_local_optimum():
    draw = random.Random(6)
    lengths = [draw.randint(1, 60) for _ in range(60)]
    bins = packing.search(packing.best_fit(lengths, 100), lengths, 100, packing.THOROUGH)
    fill = [sum(lengths[i] for i in b) for b in bins]
    parts = [[(), *((i,) for i in b), *((i, j) for n, i in enumerate(b) for j in b[n + 1 :])] for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            if a == b or fill[a] == 100 or fill[b] > fill[a]:
                continue
            for x in parts[a]:
                for y in parts[b]:
                    gain = sum(lengths[i] for i in y) - sum(lengths[i] for i in x)
                    assert not (y and len(x) + len(y) < 4 and 0 < gain <= 100 - fill[a])


def test_html_of_unseen_names():
    field = html_extract.usual_field()
    strange = lambda page: re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="' + " ".join("q" + hashlib.md5(w.encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for w in m[2].split()) + '"', page)
    wrong = total = 0
    for page, main in html_extract.example_pages(60, seed=123):
        blocks = html_extract.leaf_blocks(strange(page))
        for block, state in zip(blocks, field.decode(html_extract.features(blocks)), strict=True):
            total += 1
            wrong += state != (block.text in main.split("\n"))
    assert wrong <= 0.07 * total
    inside = '<article class="post"><h1>A title of it</h1><p>The first words, which are long enough to be read.</p><div class="comments"><p>Reader here, I do not agree.</p></div><p>The last words, which are long enough, too.</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></article>'
    blocks = html_extract.leaf_blocks(inside)
    main = [b.text for b, m in zip(blocks, field.decode(html_extract.features(blocks)), strict=True) if m]
    assert main[:3] == ["A title of it", "The first words, which are long enough to be read.", "The last words, which are long enough, too."] and "Reader here, I do not agree." not in main
    assert [b.text for b in html_extract.leaf_blocks("<p>a<noscript>b<p>c<svg><text>d</text></svg><math><mi>x</mi><mo>=</mo></math><script>e")] == ["ab", "c", "d", "x="]


def test_html_takes_memory_in_proportion():
    import tracemalloc

    peaks = []
    for n in (2000, 8000):
        tracemalloc.start()
        blocks = html_extract.leaf_blocks("<div class='a b c'>w" * n)
        html_extract.features(blocks)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(blocks) == n
    assert peaks[1] < 6 * peaks[0]


def test_field_against_enumeration():
    from itertools import product

    draw = np.random.default_rng(8)
    moves, start = draw.normal(size=(2, 2)), draw.normal(size=2)
    unary, y, on = draw.normal(size=(3, 5, 2)), draw.integers(0, 2, (3, 5)), np.arange(5)[None, :] < np.array([[5], [3], [1]])
    y, unary = y * on, unary * on[:, :, None]
    single, pair, first = html_extract.gradients(unary, moves, start, y, on)
    want_single, want_pair, want_first = np.zeros((3, 5, 2)), np.zeros((2, 2)), np.zeros(2)
    for i in range(3):
        n = int(on[i].sum())
        score = lambda s, i=i, n=n: start[s[0]] + sum(unary[i, t, s[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(s, s[1:], strict=False))
        paths = list(product((0, 1), repeat=n))
        odds = np.exp([score(s) for s in paths])
        for s, p in [*zip(paths, -odds / odds.sum(), strict=True), (tuple(y[i, :n]), 1.0)]:
            want_first[s[0]] += p
            for t in range(n):
                want_single[i, t, s[t]] += p
            for a, b in zip(s, s[1:], strict=False):
                want_pair[a, b] += p
        weights = {str(t): tuple(unary[i, t]) for t in range(n)}
        assert html_extract.Field(weights, moves, start).decode([[str(t)] for t in range(n)]) == [bool(v) for v in max(paths, key=score)]
    assert np.allclose(single, want_single) and np.allclose(pair, want_pair) and np.allclose(first, want_first)


class ListedPool:
    """The pool of a small table in memory."""

    def __init__(self, text: np.ndarray, page: np.ndarray):
        self.views, self.size = (text, page), len(text)

    def surest(self, models, scales, told, most):
        bound, out = np.log(quality_classifier.SURE / (1 - quality_classifier.SURE)), []
        for v in (0, 1):
            odds = scales[v][0] * quality_classifier.logit_of(self.views[v], models[v]) + scales[v][1]
            for good, sign in ((1.0, 1), (0.0, -1)):
                best = [int(i) for i in np.argsort(-sign * odds, kind="stable") if sign * odds[i] >= bound and int(i) not in told[1 - v]]
                out += [(v, good, i) for i in best[: most[good]]]
        return out

    def fetch(self, rows):
        return {r: (self.views[0][r], self.views[1][r]) for r in rows}


def test_rounds_help_where_views_are_independent():
    draw, gains = np.random.default_rng(12), []
    for _ in range(8):
        y = draw.integers(0, 2, 4000).astype(float)
        views = [(np.outer(2 * y - 1, draw.normal(size=30) * 0.35) + draw.normal(size=(4000, 30))).astype(np.float32) for _ in range(2)]
        known, pool, held = slice(0, 48), slice(48, 2000), slice(2000, 4000)
        right = []
        for rounds in (0, 5):
            model = quality_classifier.co_train(views[0][known], views[1][known], y[known], ListedPool(views[0][pool], views[1][pool]), rounds=rounds)
            assert min(model.layer[:2]) >= 0
            right.append(np.mean((model.score(views[0][held], views[1][held]) >= 0.5) == y[held]))
        gains.append(right[1] - right[0])
    assert np.mean(gains) > 0.005, gains


def test_page_view_alone(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit(77)) % 2 == 0
    model = quality_classifier.train(docs, labels.where(half))
    out = quality_classifier.score(docs, model).join(labels.where(~half), "doc_id").select("quality", "score", "text_odds", "page_odds").toPandas()
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    for name, least in (("score", 0.99), ("text_odds", 0.99), ("page_odds", 0.95)):
        area = np.searchsorted(np.sort(bad[name].to_numpy()), good[name].to_numpy()).sum() / (len(good) * len(bad))
        assert area > least, (name, area)
    assert min(model.layer[:2]) >= 0


@pytest.mark.parametrize("rows, cells, block", [(64, 1024, 8), (64, 3, 4096), (4096, 1024, 4)])
def test_nearest_over_cells_shards_and_blocks(spark, monkeypatch, rows, cells, block):
    for name, value in (("SHARD_ROWS", rows), ("MAX_CELLS", cells), ("BLOCK_QUERIES", block), ("LEAF", 8)):
        monkeypatch.setattr(vptree, name, value)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 6)) * 3
    vectors = [list(map(float, (centres[i % 6] + draw.normal(size=6)).astype(np.float32))) for i in range(900)] + [[1.0, 2.0], [3.0, 1.0]]
    vectors[40] = vectors[43]
    table = spark.createDataFrame([*enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    out = defaultdict(list)
    for r in vptree.nearest(table, F.col("vec_id") % 20 == 0, k=5, factor=1.0).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    loose = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(table, F.col("vec_id") % 20 == 0, k=5, factor=1.1).collect()}
    hits = total = 0
    for q in range(0, 902, 20):
        scores = sorted((-float(np.dot(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q and len(v) == len(vectors[q]))[:5]
        assert [i for i, _ in out[q]] == [i for _, i in scores] and [s for _, s in out[q]] == pytest.approx([-s for s, _ in scores], abs=1e-6)
        hits, total = hits + sum((q, i) in loose for _, i in scores), total + len(scores)
    assert hits >= 0.9 * total


def test_near_duplicates_by_similarity(spark, monkeypatch):
    """Every pair of similarity 0.8 or more is caught, none below; with buckets in blocks."""
    monkeypatch.setattr(dart_minhash, "BLOCK", 2)
    draw, texts, similar = random.Random(21), [], []
    for k in range(160):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(60, 300))]
        other = list(base)
        for _ in range(k % 20):
            other[draw.randrange(len(other))] = f"e{draw.randrange(10**6)}"
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other)]
        similar.append(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
        texts += [" ".join(base), " ".join(other)]
    out = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, s in enumerate(similar):
        assert (out[2 * k] == out[2 * k + 1]) == (s >= 0.8), s
    assert sum(s >= 0.8 for s in similar) > 30 and sum(s < 0.8 for s in similar) > 30


def test_two_groups_just_apart(spark, monkeypatch):
    """Many members of two groups in common buckets, apart by less than the threshold; one bridge joins two others."""
    monkeypatch.setattr(dart_minhash, "BLOCK", 16)
    draw = random.Random(5)
    core = [f"c{i}" for i in range(400)]

    def group(cut: int, n: int) -> list[str]:
        own = core[:cut] + [f"g{cut}_{i}" for i in range(400 - cut)]
        out = []
        for _ in range(n):
            words = list(own)
            words[draw.randrange(20, 60)] = f"e{draw.randrange(10**6)}"
            out.append(" ".join(words))
        return out

    texts = group(352, 40) + group(400, 40)
    out = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = any(len(a & b) >= 0.8 * len(a | b) for a in sets[:40] for b in sets[40:])
    assert {out[i] for i in range(40)} == {0} and {out[i] for i in range(40, 80)} == ({0} if linked else {40})
