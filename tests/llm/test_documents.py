"""The document operators on small awkward tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import op3_license, op4_mix, op5_suffix, op6_toxicity, op8_pieces, op9_lm, op10_jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, score string"
RNG = random.Random(7)
WORDS = [RNG.choice("bcdfgh") + RNG.choice("aeiou") + RNG.choice(["l", "rn", "st", "é"]) for _ in range(60)]


def words(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = words(120), words(70)
    near = base.split()
    near[60] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "two words"), (7, "two words"), (8, words(90) + " " + passage), (9, passage + "\n" + words(90)),
           (10, "Under the MIT license, under the mit License.\nReleased under the MIT License."), (10, "Apache License version 2"), (None, base), (None, None), (11, words(3000)),
           (12, "line\n" * 40), (12, "line\n" * 40), (13, "🦊 ▁ é\x00 \t x"), (14, "x" * 300)]
    out += [(100 + i, words(60 + i) + (" " + passage if i % 9 == 0 else "")) for i in range(30)]
    sources = ["a", "b", None, "ä"]
    return [(i, t, "en", sources[k % 4] if k < 18 else "a", None if t is None else len(t), "r", k, "s") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tally(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def license_tokens(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_license(docs, none, rows):
    got = tally(op3_license.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = Counter()
    for doc_id, text, *_ in rows:
        w, spots, base, labels, best = license_tokens(text), [], set(), set(), 0.0
        for phrase, label in op3_license.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i: i + len(p)] == p]
            spots += found
            base |= {label} if found else set()
        for line in (text or "").split("\n"):
            held = set(license_tokens(line))
            for label, words_, must, never in op3_license.template_words():
                n = len(held & set(words_))
                if set(must) <= held and not set(never) & held and n >= math.ceil(op3_license.THRESHOLD * len(words_) - 1e-9):
                    labels.add(label)
                    best = max(best, n / len(words_))
        want[(doc_id, len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if spots else best)] += 1
    assert got == want
    assert op3_license.scan(none).count() == 0


def test_mix(docs, none, rows):
    got = op4_mix.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights, open_, targets, left = {s: 1 + i % 3 for i, s in enumerate(order)}, set(order), {}, sum(sizes.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            targets |= share
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    taken = Counter()
    by_source = {round(t, 6): s for s, t in targets.items()}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[by_source[round(r["target"], 6)]] += r["taken"]
        assert r["source_size"] == sizes[by_source[round(r["target"], 6)]]
    for s in order:
        assert abs(taken[s] - targets[s]) <= op4_mix.BLOCK * 2 + 1
    assert tally(op4_mix.mix(docs), "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    assert op4_mix.mix(none).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    claims = [("g", f"c{i}", float(v)) for i, v in enumerate([53, 24, 23, 1, 0, 17, 17])]
    for seats in (0, 1, 7, 10, 41):
        quotas = dict.fromkeys((c[1] for c in claims), 0)
        for _ in range(seats):
            quotas[min(claims, key=lambda c: (-c[2] / (2 * quotas[c[1]] + 1), c[1]))[1]] += 1
        df = spark.createDataFrame([(*c, seats) for c in claims], "g string, name string, v0 double, seats long")
        got = {r["name"]: r["quota"] for r in op4_mix.sainte_lague(df, ["g"], "name", "v0", "seats").collect()}
        assert got == quotas


def removed(rows):
    first = {}
    for doc_id, text in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        raw = text.encode()
        for a in range(len(raw) - 49):
            first.setdefault(raw[a: a + 50], doc_id)
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if doc_id is not None and first[raw[a: a + 50]] < doc_id:
                gone[a: a + 50] = True
        yield doc_id, raw, gone


def test_suffix(docs, none, rows):
    got = tally(op5_suffix.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = Counter((i, len(raw), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~g])).hexdigest()) for i, raw, g in removed(rows))
    assert got == want and sum(k[2] for k in got) > 0
    assert op5_suffix.deduplicate(none).count() == 0


def test_suffix_stage_keeps_rows_and_columns(docs, rows):
    out = op5_suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter((i, bytes(np.frombuffer(raw, np.uint8)[~g]).decode("utf-8", "ignore")) for i, raw, g in removed(rows))
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_run_index_against_search(seed, monkeypatch):
    monkeypatch.setattr(op5_suffix, "INDEXED", (7, 8_000)[seed % 2])
    rng = random.Random(seed)
    base = [[rng.randint(1, 4) for _ in range(40)] for _ in range(3)]
    rows, marks = [], []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(40)] = rng.randint(5, 7)
        front = rng.randint(0, 8)
        rows.append(w[front: 40 - rng.randint(0, 8)])
        marks.append(20 - front)
    docs, anchor = np.array([rng.randint(0, 20) for _ in rows]), np.array([rng.randint(0, 1) for _ in rows])
    padded, size = np.zeros((len(rows), 40), np.int16), np.array([len(r) for r in rows])
    for k, r in enumerate(rows):
        padded[k, : len(r)] = r
    got = op5_suffix.long_matches(padded, size, anchor, np.array(marks), docs, 15)
    shown = [[*map(str, r[:m]), "A", *map(str, r[m + 1:])] for r, m in zip(rows, marks)]
    held = [{tuple(r[a: a + 15]) for a in range(len(r) - 14)} for r in shown]
    for k, r in enumerate(shown):
        for a in range(len(r) - 14):
            if a <= marks[k] < a + 15:  # the strings that hold their anchor
                assert got[k, a] == any(docs[j] < docs[k] and anchor[j] == anchor[k] and tuple(r[a: a + 15]) in held[j] for j in range(len(rows))), (k, a)


def test_matching_statistics_are_those_of_the_indexed_texts():
    """The index decides: of texts that it does not hold it tells the longest matches."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(12)]
        streams, size = np.zeros((9, 25), np.int64), rng.integers(1, 26, 9)
        for k, n in enumerate(size):
            streams[k, :n] = rng.integers(1, 6, n)
        index = op5_suffix.RunIndex(np.concatenate(texts), np.array([len(t) for t in texts]))
        assert len(index.head) == len(index.char) == (np.diff(index.char) != 0).sum() + 1
        got = index.statistics(streams, size)
        whole = [" ".join(map(str, t)) for t in texts]
        for k, n in enumerate(size):
            for a in range(n):
                longest = max((m for m in range(n - a + 1) if any(" ".join(map(str, streams[k, a: a + m])) in t for t in whole)), default=0)
                assert got[k, a] == longest


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(op5_suffix, "HOT", 1)
    monkeypatch.setattr(op5_suffix, "FLUSH", 4000)
    common = "this sentence is part of very many documents and long"
    rows = [(i, f"{words(12)} {common[: 30 + i % 24]} {words(12)}", "en", "s", 0, "r", i, "s") for i in range(120)]
    got = tally(op5_suffix.deduplicate(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_removed")
    assert got == Counter((i, int(g.sum())) for i, _, g in removed(rows)) and sum(n for _, n in got) > 0


def test_toxicity(spark, none):
    bad = ["snarg", "blorf", "grunk"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        text = words(40) + (" " + RNG.choice(bad) + " " + RNG.choice(bad) if toxic else "")
        rows.append((i, text, "en", "s", 1, "r", 0, "s"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(None, None, None, None, None, None, None, None), (5000, "", "en", "s", 0, "r", 0, "s"), (2**60 + 1, "snarg " * 20_000, "en", "s", 0, "r", 0, "s")]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    got = op6_toxicity.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [i for i in range(900) if by[i]["held_out"]]
    wrong = sum(by[i]["predicted"] != (i % 8 == 0) for i in held)
    assert wrong <= 0.03 * len(held) and by[2**60 + 1]["predicted"] == 1
    kept = op6_toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    assert op6_toxicity.classify(none, known).count() == 0
    assert {r["score"] for r in op6_toxicity.classify(docs, known.where("toxic = 0")).collect()} == {0.0}


def test_pieces(docs, none, rows):
    for chunk in (40, op8_pieces.CHUNK):
        encoded = op8_pieces.encode(docs, keep=("doc_id", "key"), chunk=chunk).collect()
        assert Counter(r["doc_id"] for r in encoded) == Counter(r[0] for r in rows)
        vocabulary = op8_pieces.Pieces(*op8_pieces.Pieces.load(op8_pieces.default_model())[:2])
        texts = {r[6]: r[1] or "" for r in rows}
        for r in encoded:
            text = texts[r["key"]]
            ids = np.frombuffer(r["pieces"], np.int32)
            assert vocabulary.decode(pa.array([r["pieces"]], pa.binary()))[0].decode() == text and r["n_pieces"] == len(ids) and r["n_bytes"] == len(text.encode())
            if len(text) < 700:
                best, _ = vocabulary.best(op8_pieces.escape(text), [0], 0)
                assert r["score"] == best[-1]
    back = op8_pieces.decode(op8_pieces.encode(docs))
    assert Counter(r["text"] for r in back.collect()) == Counter(r[1] or "" for r in rows)
    assert op8_pieces.round_trip(none).count() == 0


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, op8_pieces.LOW, rng.integers(-99, 0, (5, 5))) for _ in range(3))
    assert (op8_pieces.product(op8_pieces.product(a, b), c) == op8_pieces.product(a, op8_pieces.product(b, c))).all()


def test_lm(docs, none, rows):
    got = op9_lm.score(docs).collect()
    counts, ends = Counter(), 0
    for i, text, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, text, *_ in rows:
        t = (text or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        want[(i, len(t) + 1, sum(w in counts for w in t) + 1, n, round(base, 5))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    text_bits = [r["bits_per_byte"] for r in got if r["n_bytes"] > 2000]
    assert text_bits and max(text_bits) < 4.5
    assert op9_lm.score(none).count() == 0


def test_lm_prefers_what_it_has_seen():
    train = [b"abracadabra", b"abra", b"cadabra"] * 5
    histogram = np.zeros((256, 257), np.int64)
    for t in train:
        for a, b in zip(b"\0" + t, [*t, op9_lm.END]):
            histogram[a, b] += 1
    code = op9_lm.Code(histogram)
    assert all(sum(0.5 ** code.size.reshape(256, 257)[a]) == 1 for a in (0, 97, 255))  # complete codes
    counts = np.zeros((len(op9_lm.ORDERS), 2 << op9_lm.BITS), np.int64)
    op9_lm.count_contexts(train, code, counts)
    scores = op9_lm.mix_scores([b"abracadabra", b"arbacadarba", b"zzzzzzzzzzz", b""], code, op9_lm.logits(counts.astype(float)))
    assert (scores < 0).all() and scores[0] > scores[1] > scores[2]


def test_jaccard(docs, none, rows):
    got = op10_jaccard.classes(docs).collect()
    assert len(got) == len(rows)
    memo: dict = {}
    sets = [(i, frozenset(op10_jaccard.shingles(t, memo).tolist())) for i, t, *_ in rows]
    n, parent = len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(n):
            (i, s), (j, t) = sets[a], sets[b]
            if a != b and i is not None and j is not None and s and t and len(s & t) >= 0.8 * len(s | t):
                links[a] += 1
                if root(a) != root(b):
                    x, y = sorted((root(a), root(b)), key=lambda k: sets[k][0])
                    parent[y] = x
    want = Counter((sets[a][0], None if sets[a][0] is None else sets[root(a)][0] if sets[a][1] else sets[a][0], links[a]) for a in range(n))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = op10_jaccard.without_near_copies(docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids[2] == ids[3] == ids[7] == 0 and ids[1] == ids[6] == ids[12] == 1 and ids[None] == 2
    assert op10_jaccard.classes(none).count() == 0


def test_large_group_is_dealt_over_cells(spark):
    base = words(200).split()
    rows = [(i, " ".join(base[:100] + [f"own{i}"] + base[100:])) for i in range(1200)]
    got = op10_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {1199}


def test_depth_keeps_recall():
    assert op10_jaccard.depth_for(0.8, 0.999) == 2
    assert op10_jaccard.depth_for(0.99, 0.9) == op10_jaccard.DEPTH
