"""The corpus pipeline as a whole, stage by stage against plain versions, on awkward tables."""

import random

import pytest

from palimpsest.llm import op8_pieces, op10_jaccard

pipeline = pytest.importorskip("corpus_pipeline")
RNG = random.Random(11)
WORDS = [a + b + c for a in "bcdfghlm" for b in "aeiou" for c in ("l", "rn", "st", "nd")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, bucket int, _row int"


def words(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    passage, base = words(80), words(100)
    rows = [(i, words(60) + (" snarg blorf" if i % 10 == 0 else ""), "en", "ab"[i % 2], 1, "r", "h", i, i) for i in range(1, 121)]
    rows += [(500, base, "en", "a", 1, "r", "h", 0, 0), (501, base, "en", "b", 1, "r", "h", 0, 0), (502, base + " one two", "en", "b", 1, "r", "h", 0, 0)]
    rows += [(600, f"{words(50)} {passage}", "en", "a", 1, "r", "h", 0, 0), (601, f"{passage} {words(50)}", "en", "a", 1, "r", "h", 0, 0)]
    rows += [(700, None, None, None, None, None, None, None, None), (701, "", "en", None, 0, "r", "h", 0, 0), (None, words(40), "en", "a", 1, "r", "h", 0, 0)]
    return rows + [(800, "same id " + words(40), "en", "a", 1, "r", "h", 0, 0), (800, "other text " + words(40), "en", "a", 1, "r", "h", 0, 0)]


ROWS = awkward()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = ROWS
    labels = [(r[0], 1, int(r[0] % 10 == 0)) for r in rows[:120]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {name: [i for i, _ in rows] for name, rows in kept.items()}
    before = [(r[0], r[1]) for r in ROWS]
    # near copies: one of each group by brute force over shingle sets; both texts of id 800, the null id and the empty texts stay
    memo: dict = {}
    sets = [(i, t, frozenset(op10_jaccard.shingles(t, memo).tolist())) for i, t in kept["toxicity"]]
    gone = {(i, t) for i, t, s in sets for j, _, o in sets if i is not None and j is not None and s and o and j < i and len(s & o) >= 0.8 * len(s | o)}
    want = sorted(repr((i, t)) for i, t, _ in sets if (i, t) not in gone)
    have = sorted(map(repr, kept["near copies"]))
    assert gone and [x[:60] for x in have if x not in want] == [x[:60] for x in want if x not in have] == [] and have == want
    # repeats: the passage is cut from the larger document only, and every row is there
    texts = dict(kept["repeats"])
    assert sorted(map(repr, ids["repeats"])) == sorted(map(repr, ids["near copies"]))
    passage = set(dict(before)[601].split()[:80])
    assert passage <= set(texts[600].split()) and len(texts[601].split()) <= 52
    # mixture: whole documents only, those without words once
    assert {(i, t) for i, t in kept["mixture"]} <= set(kept["repeats"]) and ids["mixture"].count(700) == ids["mixture"].count(701) == 1
    # pieces: those of the mixed texts, in any order
    out = pipeline.STAGES[-1][1](spark, docs, folder)
    back = op8_pieces.decode(out, keep=("doc_id",))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(repr((i, t or "")) for i, t in kept["mixture"])
    again = pipeline.run(spark, folder)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
