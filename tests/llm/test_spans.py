import random

import pytest

from edgeloom.llm import spans
from tests.llm.conftest import CLASHING


def test_against_brute_force(docs, rows):
    order = sorted(((spans.LAST if r[0] is None else r[0], r[1]) for r in rows), key=lambda x: x[0])
    first = {}
    for i, t in order:
        for _, _, body in spans.spans(spans.sentences(t)):
            first.setdefault(body, i)
    expected = []
    for i, t in order:
        pieces, seen, drop = spans.sentences(t), set(), set()
        for a, n, body in spans.spans(pieces):
            if first[body] < i or body in seen:
                drop |= set(range(a, a + n))
            seen.add(body)
        expected.append((None if i == spans.LAST else i, "".join(p for j, p in enumerate(pieces) if j not in drop) if drop else t, len(pieces), len(drop)))
    got = spans.dedup(docs)
    others = [c for c in CLASHING if c != "removed"]
    assert got.columns == [c for c in docs.columns if c != "removed"] + ["n_sentences", "n_removed", "removed"]
    assert {tuple(r) for r in got.select(*[f"`{c}`" for c in others]).collect()} == {tuple(f"own {c}" for c in others)}
    assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert sum(e[3] > 0 for e in expected) > 10
    for r in got.collect():
        assert sum(x["length"] for x in r.removed) == r.n_removed


@pytest.mark.parametrize("seed", range(10))
def test_sentences_join_to_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a ", "b. ", "c!\n", "\n\n", "d?!  ", ". ", "e.f ", "\t"]) for _ in range(60))
    assert "".join(spans.sentences(text)) == text and "".join(spans.sentences(text.replace("a", "\x1f"))) == text.replace("a", "\x1f")
    found = spans.spans(spans.sentences(text), 5)
    assert all(n >= 2 and sum(len(x.split()) for x in body.split("\n")) >= 5 for _, n, body in found)


def test_little_and_empty(spark, empty):
    assert spans.report(empty).count() == 0
    once = "Word " * 30
    rows = [(1, once), (2, once), (3, "A b c. D e f."), (4, "A b c. D e f.")]
    assert {r.n_removed for r in spans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_passage_in_other_text(spark):
    passage = "This is the passage that many share, with a dozen words or so here. It goes on with a second sentence of about the same length as well. And then it ends with a third one, which closes all fifty words."
    rows = [(i, f"Start number {i} says this. {passage} End number {i} is here.") for i in range(5)]
    got = {r.doc_id: r.text for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all("passage" not in got[i] and f"Start number {i}" in got[i] and "closes" not in got[i] for i in range(1, 5))


def test_names_in_any_case_are_replaced(spark):
    df = spark.createDataFrame([(1, "A b.", "x", "y", "z")], "doc_id long, text string, Removed string, N_Sentences string, other string")
    assert spans.dedup(df).columns == ["doc_id", "text", "other", "n_sentences", "n_removed", "removed"]
