import hashlib
import re

import pytest

from edgeloom.llm import decontaminate
from tests.llm.conftest import untouched

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def items(rows):
    long = [w for w in words(rows[2][1])]
    return [(1, " ".join(long[:9])), (2, rows[3][1].upper()), (4, " ".join(long[3:14])), (10, "ÀÉ STRASSE"), (11, "Straße!"), (12, None), (13, ""), (14, "?!"), (3, " ".join(words(rows[130 - 130 + 5][1])[:8])), (3, "never seen anywhere"), (None, " ".join(long[:9]))]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, k string")


def brute(rows, items, n=8):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).update({str(i)} if i is not None else ())
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def test_against_brute_force(docs, rows, benchmark, items):
    expected = sorted(brute(rows, items), key=str)
    assert sorted(map(tuple, decontaminate.report(docs, benchmark).collect()), key=str) == expected
    assert any(e[-1] for e in expected) and not all(e[-1] for e in expected)


def test_blocks_give_the_same(docs, benchmark):
    whole, blocks = (decontaminate.scan(docs.select("doc_id", "text"), benchmark, most_windows=m) for m in (10**6, 7))
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_removal(docs, rows, benchmark, items):
    bad = brute(rows, items)
    kept = decontaminate.decontaminate(docs, benchmark)
    untouched(kept, docs)
    assert kept.count() == sum(not b[-1] for b in bad)
    cut = decontaminate.decontaminate(docs, benchmark, remove="spans")
    untouched(cut, docs)
    after = brute([(r.doc_id, r.text) for r in cut.collect()], items)
    assert sorted((a[0], a[1]) for a in after if a[0] is not None) == sorted((b[0], b[1] - b[2]) for b in bad if b[0] is not None)
    clean = {(r[0], r[1]) for r, b in zip(rows, bad) if not b[2]}
    assert clean <= {(r.doc_id, r.text) for r in cut.collect()}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, benchmark, remove="all")


def test_empty(docs, rows, empty, benchmark):
    assert decontaminate.report(empty, benchmark).count() == 0
    assert all(not r.contaminated and not r.n_hit for r in decontaminate.report(docs, benchmark.limit(0)).collect())
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
