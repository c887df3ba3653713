"""The filter audit, the collocations and the language profiles on small awkward tables, against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from palimpsest.llm import op11_audit, op12_collocations, op13_language, transducers

SCHEMA = "doc_id long, text string, lang string, source string, part string, hash int, score string, n long"
RNG = random.Random(5)


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "p", 1, "s", 1) for r in rows], SCHEMA).repartition(3)


# ---- op11


def failed(doc_id, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows) else "")


def audited(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    for lang in {r[2] or "" for r in rows}:
        docs = [(i, failed(i, t or "", rows)) for i, t, x in rows if (x or "") == lang]
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                out[lang, order, step] = [len(left), len(gone), sum(letter in f for _, f in docs) - len(gone), sum(f == letter for _, f in docs),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[lang, letter] += len(gone)
    return {(lang, order, step, *v, shapley[lang, order[step - 1]]) for (lang, order, step), v in out.items()}


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_audit(spark, slots):
    words = [f"w{k}" for k in range(150)]
    long = " ".join(words)
    rows = [(1, long, "en"), (2, long, "en"), (3, long, "de"), (3, long, "de"), (None, long, "en"), (4, None, "en"), (5, "", None), (6, "AB cd", "fr"), (7, "x " * 200, "en"),
            (8, long + " $", ""), (9, long.upper(), "en"), (10, "\x0b a b  ", "en"), (10, long + " x", "en"), (None, None, None), (11, long + " $", "de")]
    rows += [(100 + k, " ".join(RNG.choice(words[: RNG.choice((20, 150))]) for _ in range(120)) + RNG.choice(("", "|", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA")), RNG.choice(("en", "de"))) for k in range(30)]
    rows += [(200 + k, "copy of a text", "en") for k in range(60)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, 1), (104, 1, 0), (210, 1, 1), (None, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op11_audit.audit(table(spark, rows), known, slots)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 600 * 4 and set(found) == audited(rows, labels)
    none = spark.createDataFrame([], SCHEMA)
    assert op11_audit.audit(none, known).count() == 0
    assert {r["good_lost"] for r in op11_audit.audit(table(spark, rows[:3]), known.where("false")).collect()} == {0}


# ---- op12


def test_transducers():
    words = [b"a", b"b", b"a\x01", "é".encode(), b"longer"]
    counts = [{tuple(RNG.choice(words) for _ in range(RNG.randint(1, 5))): RNG.randint(1, 10**12) for _ in range(300)} for _ in range(4)]
    made = [transducers.build(sorted(c.items())) for c in counts]
    for c, t in zip(counts, made):
        back = transducers.Transducer.load(t.dump())
        assert list(back) == sorted(c.items()) == list(t)
    total = Counter()
    for c in counts:
        total.update(c)
    assert dict(op12_collocations.summed(made)) == total
    asked = sorted({*list(counts[0])[:50], (b"no", b"such"), (b"a",) * 5})
    acceptor = transducers.build((p, 0) for p in asked)
    assert list(transducers.compose(acceptor, made[0])) == [(p, counts[0][p]) for p in asked if p in counts[0]]
    same = transducers.build(sorted(((a, b), 7) for a in words for b in words))
    assert len(same.states) == 3  # equal ends are one state
    assert list(transducers.build([])) == []


def collocated(rows, least, most):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i:i + m]) for m in range(1, 6) for i in range(len(ws) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:most], 1)}
    return out


@pytest.mark.parametrize("least, most, block, per_range, held", [(3, 2000, 1 << 22, 100_000, 1 << 20), (3, 40, 300, 100, 1), (2, 7, 40, 20, 90)])
def test_collocations(spark, monkeypatch, least, most, block, per_range, held):
    monkeypatch.setattr(op12_collocations, "TOGETHER", block // 7)
    ws = ["the", "of", "a", "Ab", "É", "x\x01", "$#", "longer-word", "ß"]
    texts = [" ".join(RNG.choice(ws) + RNG.choice(("", "", "", "", ".", "\t", "\n", "?!")) for _ in range(RNG.randint(0, 40))) for _ in range(60)]
    rows = [(k, t, RNG.choice(("en", "en", "de", None, ""))) for k, t in enumerate(texts)] + [(1, texts[0], "en"), (None, None, "en"), (3, "", "en"), (4, ".. ,\t", "und"), (5, "a a a a a a a a", "fr")]
    rows += [(6, " ".join(RNG.choice(ws) for _ in range(900)), "en"), (7, "of the " * 30, "de")] + [(8, "same words again here", "en")] * 20
    got = op12_collocations.collocations(table(spark, rows), least, most, 100, block, per_range, held)
    assert {tuple(r) for r in got.collect()} == collocated(rows, least, most) and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    assert op12_collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op12_collocations.collocations(table(spark, [(1, None, None), (2, "?", "en"), (3, "two words", "en")])).count() == 0


# ---- op13


def plain_vector(text):
    total = np.zeros(op13_language.DIM)
    runs = re.findall(r"[^\W\d_]+", text.lower())
    s = " " + " ".join("".join(c for c in r if c.isalpha()) for r in runs) + " "
    for i in range(len(s) - 2 if runs else 0):
        v = np.ones(op13_language.DIM)
        for j, c in enumerate(s[i:i + 3]):
            v *= np.roll(op13_language.signs(np.array([ord(c)]))[0], 2 - j)
        total += v
    return total / (np.linalg.norm(total) or 1)


def test_vectors_of_texts(monkeypatch):
    texts = ["Hello, world", None, "", "12 $", "x", "ÄÖ ü\nß 漢字", "a b " * 40, "hello world"]
    want = np.array([plain_vector(t or "") for t in texts])
    for size, at_once in ((1 << 20, 4096), (16, 4), (1, 1)):
        monkeypatch.setattr(op13_language, "SLICE", size)
        monkeypatch.setattr(op13_language, "AT_ONCE", at_once)
        got = np.zeros_like(want)
        for first, some in op13_language.vectors(texts):
            got[first: first + len(some)] = some
        assert np.allclose(got, want)


def test_language(spark, monkeypatch):
    alphabets = {"xx": "abcde ", "yy": "vwxyz ", "zz": "аеимн "}
    rows = [(k, "".join(RNG.choice(a) for _ in range(RNG.randint(40, 200))), lang) for k, (lang, a) in enumerate(list(alphabets.items()) * 30)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 $$", "zz"), (None, "abcab cab", None), (None, "xyz zyx", "yy"), (2, rows[2][1], "zz"), (1003, "abc " * 5000, "xx"), (1004, "漢字", None)]
    got = [tuple(r) for r in op13_language.predict(table(spark, rows)).collect()]
    again = [tuple(r) for r in op13_language.predict(table(spark, rows).repartition(1)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    monkeypatch.setattr(op13_language, "BLOCK", 1)  # one language at a time gives the same
    assert sorted((tuple(r) for r in op13_language.predict(table(spark, rows)).collect()), key=str) == sorted(got, key=str)
    by_id = {g[0]: g for g in got if g[0] is not None}
    assert all(by_id[i][2] == lang for i, t, lang in rows if i is not None and lang and re.search(r"[^\W\d_]", t or ""))
    assert {by_id[i][2:] for i in (1000, 1001, 1002)} == {("und", 0.0)}
    import zlib

    assert all(g[1] == (zlib.crc32(str("" if g[0] is None else g[0]).encode()) % 4 == 2) for g in got) and all(0 <= g[3] <= 1 for g in got)
    assert op13_language.predict(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {tuple(r)[2:] for r in op13_language.predict(table(spark, [(1, "abc", None)])).collect()} == {("und", 0.0)}
