import random

import corpus_pipeline
from edgeloom.llm import nearcopies
from tests.llm.conftest import sentence, untouched


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_kept(rows):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row)
    return sorted((min(g, key=lambda x: (x[0] is None, x[0] or 0))[0] for g in groups.values()), key=str)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark):
    r, rows = random.Random(3), []
    for _ in range(30):
        base = "".join(sentence(r, 10) for _ in range(r.randint(1, 12))).split()
        rows += [(len(rows) + i, edited(r, base, k)) for i, k in enumerate((0, 1, 1, 2, 3, 6))]
    chain = "".join(sentence(r, 10) for _ in range(12)).split()
    for i in range(60):  # edits pile up: the ends are unlike, neighbours alike
        rows.append((500 + i, " ".join(chain)))
        chain[r.randrange(len(chain))] = f"chain{i}"
    got = nearcopies.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_kept(rows)
    assert sorted((x.doc_id for x in got.collect()), key=str) == want and 30 < len(want) < len(rows)


def test_awkward_rows(docs, rows, empty):
    got = nearcopies.dedup(docs)
    untouched(got, docs)
    assert sorted((x.doc_id for x in got.collect()), key=str) == plain_kept([r[:2] for r in rows])
    assert nearcopies.dedup(empty).count() == 0


def test_pipeline_drops_near_copies(spark):
    r = random.Random(8)
    base = "".join(sentence(r, 10) for _ in range(15)).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:75] + ["four", "new", "words", "here"] + base[75:])), (3, "".join(sentence(r, 10) for _ in range(15)))]
    now = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "decontamination":
            break
        now = stage(spark, now, "")
    assert sorted(x.doc_id for x in now.collect()) == [1, 3]


def test_a_large_group_makes_no_square_of_pairs(spark, monkeypatch):
    r, rows, made = random.Random(5), [], []
    base = "".join(sentence(r, 10) for _ in range(15)).split()
    for _ in range(400):
        rows.append((len(rows), edited(r, base, r.randint(1, 6))))  # alike by 0.6 to 0.95, one by one
    kept = nearcopies.materialize

    def counted(df, what):
        out = kept(df, what)
        made.append(out.count() if what == "pairs" else 0)
        return out

    monkeypatch.setattr(nearcopies, "materialize", counted)
    got = nearcopies.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id for x in got.collect()), key=str) == plain_kept(rows)
    assert sum(made) < 20 * len(rows)
