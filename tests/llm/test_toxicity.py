import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import toxicity
from edgeloom.llm.common import held_out
from tests.llm.conftest import sentence, untouched

INSULTS = ["blockhead", "nitwit", "dunderpate"]


def corpus(n=400, seed=4):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = "".join(sentence(r, 9) for _ in range(r.randint(2, 8))).split()
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def plain_kernel(s, t):
    sub = lambda x: [((x[i], x[j], x[k]), toxicity.DECAY ** (k - i + 1)) for i, j, k in combinations(range(len(x)), 3)]
    return sum(a * b for u, a in sub(s) for v, b in sub(t) if u == v)


def test_kernel_against_enumeration():
    r = random.Random(0)
    make = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(0, 10)))
    marks = [m for m in {make() for _ in range(12)} if len(m) >= 3]
    kernel, words = toxicity.Kernel(marks), [make() for _ in range(40)]
    assert np.allclose(kernel.own_values(words), [plain_kernel(w, w) for w in words], rtol=1e-4)
    got = kernel.features(words)
    for w, row in zip(words, got):
        for m, x in zip(marks, row):
            own = plain_kernel(w, w) * plain_kernel(m, m)
            assert abs(x - (plain_kernel(w, m) / own**0.5 if own else 0)) < 1e-4


def test_held_out_accuracy_and_gaps(labelled):
    docs, labels = labelled
    got = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 400 and sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    model = toxicity.fit(docs, labels)
    score = lambda *ts: model.score(np.array([model.margins(t.lower().split()).max() for t in ts]))
    assert (score("you b-l-o-c-k-h-e-a-d", "a nit.wit", "some blockxhead", "the dunderzpate") > 0.5).all()
    assert (score("alpha3 beta4", "gamma", "omicron12 pi") < 0.5).all()


def test_spaced_letters(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    texts = ["well n i t w i t you", "a b c", "", None, "i am a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.scored(df, model).collect()}
    assert got[0] > 0.5 and all(got[i] < 0.5 for i in range(1, 5))


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    wrong = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.report(docs, x).collect())) for x in (labels, wrong))
    assert a == b


def test_keep_clean(docs, rows, labelled):
    own = docs.sparkSession.createDataFrame([(i, int(i % 2), "x") for i in range(40)], "doc_id long, toxic int, text string")
    got = toxicity.keep_clean(docs, own)
    assert got.columns == docs.columns
    kept = toxicity.keep_clean(docs, own, threshold=1.1)
    untouched(kept, docs)
    assert kept.count() == len(rows)


def test_empty(docs, rows, empty, labelled):
    none = labelled[1].limit(0)
    assert toxicity.report(empty, none).count() == 0
    got = toxicity.report(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    long = "x" * 100 + INSULTS[0] + "y" * 50
    assert [u for u in toxicity.units(long) if INSULTS[0] in u]


def test_scores_against_enumeration(spark, labelled):
    """Margins by the kernel's definition, unit by unit, from the machine's weight of each landmark."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    # the machine's table sums landmark subsequences; its weights follow by least squares on the landmarks' own
    marks = model.kernel.landmarks
    weights, *_ = np.linalg.lstsq((model.kernel.weights / np.maximum(model.kernel.own, 1e-9)).astype(np.float64), model.table.astype(np.float64), rcond=None)

    def margin(token):
        best = []
        for u in toxicity.units(token):
            own = plain_kernel(u, u)
            best.append(model.bias + (sum(w * plain_kernel(u, m) / (own * plain_kernel(m, m)) ** 0.5 for w, m in zip(weights, marks)) if own else 0.0))
        return max(best)

    texts = ["Alpha3 the BLOCKHEAD went.", "a b-l-o-c-k-h-e-a-d", "", None, "quite clean words", "nit.wit"]
    got = {r.doc_id: r.toxicity for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        m = max([margin(w) for w in (t or "").lower().split()], default=model.bias)
        want = 1 / (1 + np.exp(-np.clip(model.slope * (m - model.shift), -60, 60)))
        assert abs(got[i] - want) < 2e-3, (t, got[i], want)


@pytest.mark.parametrize("first", [True, False])
def test_copies_of_a_row_change_no_model(spark, labelled, first):
    docs, labels = labelled
    clean = labels.where("toxic = 0 and doc_id % 10 = 1").orderBy("doc_id").limit(1)
    copies, marks = (x.join(clean.select("doc_id"), "doc_id").crossJoin(spark.range(20_000)).drop("id") for x in (docs, labels))
    more = [c.unionAll(d) if first else d.unionAll(c) for d, c in ((docs, copies), (labels, marks))]
    a, b = toxicity.fit(docs, labels), toxicity.fit(*more)
    assert a.kernel.landmarks == b.kernel.landmarks and a.bias == b.bias and (a.table == b.table).all()


def test_long_texts_are_scored_whole(spark, labelled):
    model = toxicity.fit(*labelled)
    far = spark.createDataFrame([(1, "plain words " * 20_000 + INSULTS[0]), (2, "plain words " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.scored(far, model).collect()}
    assert got[1] > 0.5 > got[2]
