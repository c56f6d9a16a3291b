import math
import re

import pytest

from edgeloom.llm import mixing
from tests.llm.conftest import untouched


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes):
    """Reshare by weight until no target is above twice its source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return target


def test_against_plain_rules(docs, rows):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = plain_targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((r[0], size(r[1])) for r in rows), key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    mixed = mixing.mix(docs).collect()
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] += r.copies * r["size"]
    # a source with one text of nearly all its words can come no nearer than that text's copies allow
    largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(3, 0.05 * target[s], largest[s] / 2) for s in sizes), (taken, target)
    assert all(abs(taken[s] - target[s]) <= 3 for s in ("s0", "s1", "s2")), (taken, target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(docs.repartition(7)).collect()))


def test_rates_solve_the_dual(spark):
    """The multipliers meet the targets, and equal those of a plain bisection."""
    import random

    r = random.Random(3)
    classes = [(f"0s{s}", z, r.randint(1, 40)) for s in range(6) for z in sorted(r.sample(range(1, 2000), 60))]
    totals = {}
    for s, z, n in classes:
        a, b = totals.get(s, (0, 0))
        totals[s] = (a + z * n, b + n)
    ratio = dict(zip(sorted(totals), (0.02, 0.5, 1.0, 1.3, 1.95, 2.0)))
    sources = spark.createDataFrame([(s, a, b, ratio[s] * a) for s, (a, b) in totals.items()], "_key string, source_size long, docs long, target double")
    table = spark.createDataFrame(classes, "_key string, size long, n long")
    for row in mixing.solve(table, sources).collect():
        rate = lambda x, m: 2.0 if m * x >= math.log(2) - 1e-12 else math.exp(m * x)  # noqa: E731, B023
        reached = sum(z * n * rate(z / row._scale, row._lambda) for s, z, n in classes if s == row._key)
        assert math.isclose(reached, row.target, rel_tol=1e-6)


def test_hot_class_is_shared_out(spark):
    df = spark.createDataFrame([(i, "same words here", "a") for i in range(3000)] + [(5000 + i, "b " * 3000, "b") for i in range(3)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    a = [r.copies for r in got if r.source == "a"]
    assert abs(3 * sum(a) - next(r.target for r in got if r.source == "a")) <= 3 and set(a) <= {0, 1, 2}


def test_take(docs):
    mixed = {}
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id, r.text] = mixed.get((r.doc_id, r.text), 0) + r.copies
    got = mixing.take(docs)
    untouched(got, docs)
    counted = {}
    for r in got.collect():
        counted[r.doc_id, r.text] = counted.get((r.doc_id, r.text), 0) + 1
    assert counted == {k: n for k, n in mixed.items() if n}


@pytest.mark.parametrize("texts", [[], [None, ""], ["one"]])
def test_little(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.report(df).collect()
    assert len(got) == len(texts) and all(r.taken in (r.size, 2 * r.size) for r in got)


def test_repeats_of_a_row_are_dealt_out(spark):
    """A third of the rows repeat one; totals hold, and so do other rows' copies, whatever the partitions."""
    rows = [(7, "one row again", "a")] * 600 + [(1000 + i, "three words here", "a") for i in range(600)] + [(5000 + i, "b " * (i % 7 + 1), "b") for i in range(600)]
    got = []
    for n in (3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        mixed = mixing.mix(df, bucket=50).collect()
        target = {r.source: r.target for r in mixed}
        for s in "ab":
            assert abs(sum(r["size"] * r.copies for r in mixed if r.source == s) - target[s]) <= 3 and {r.copies for r in mixed} <= {0, 1, 2}
        got.append(sorted((r.doc_id, r.copies) for r in mixed))
    assert got[0] == got[1]


def test_partitions_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    a, b = (sorted(map(tuple, mixing.mix(d, bucket=40).select("doc_id", "copies").collect())) for d in (docs, docs.repartition(13)))
    assert a == b
