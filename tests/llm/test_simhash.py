import random

import pytest
import xxhash

from edgeloom.llm import simhash
from tests.llm.conftest import untouched


def plain_print(text, k=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, distance=2):
    found = {p: p for p in prints}

    def find(x):
        while found[x] != x:
            found[x] = x = found[found[x]]
        return x

    items = sorted(found)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                found[max(x, y)] = min(x, y)
    return {p: find(p) for p in found}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components_of(rows):
    prints = [(r[0], plain_print(r[1])) for r in rows]
    root = roots({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return [(i, f"{p:016x}", least.get(root[p])) for i, p in prints]


def test_against_brute_force(docs, rows):
    assert sorted(map(tuple, simhash.report(docs).collect()), key=str) == sorted(components_of(rows), key=str)


def clusters(seed, n=60, size=12):
    r, out = random.Random(seed), set()
    for _ in range(n):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, size)):
            out.add(p)
            for _ in range(r.randint(0, 3)):
                p ^= 1 << r.randrange(64)
    dense = r.getrandbits(64)  # many prints that share all blocks but one
    out |= {dense ^ (x << 3) for x in range(150)}
    return sorted(out)


@pytest.mark.parametrize("seed, hot, distance, blocks", [(1, 24, 2, 5), (2, 2, 2, 5), (3, 10**6, 2, 3), (4, 3, 2, 4), (5, 2, 1, 4), (6, 24, 1, 2)])
def test_links_connect_all_within_distance(spark, seed, hot, distance, blocks):
    prints = clusters(seed)
    df = spark.createDataFrame([(signed(p),) for p in prints], "simhash long")
    edges = simhash.links(df, distance, blocks, hot)
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert all((a ^ b & (1 << 64) - 1).bit_count() and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in pairs)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = roots(set(prints), distance)
    classes = {}
    for p in prints:
        classes.setdefault(want[p], set()).add(got.get(signed(p), signed(p)))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_dedup(docs, rows):
    got = simhash.dedup(docs)
    untouched(got, docs)
    groups = {}
    for r, (i, p, c) in zip(rows, components_of(rows)):
        groups.setdefault(c if c is not None else p, []).append((i is None, i, r[1]))
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert len(kept) == len(groups)
    assert sorted(str(i) for i, _ in kept) == sorted(str(min(g, key=lambda x: (x[0], x[1] or 0))[1]) for g in groups.values())


def test_empty(empty):
    assert simhash.report(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_bad_distance(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "simhash long"), 3)


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "some words here", "a", "b", "c"), (2, "some words here", "a", "b", "c")], "doc_id long, text string, Simhash string, Component_ID string, root string")
    got = simhash.grouped(df)
    assert sorted(got.columns) == ["component_id", "doc_id", "root", "simhash"] and {(r.component_id, r.root) for r in got.collect()} == {(1, "c")}
    assert simhash.fingerprints(df).columns == ["doc_id", "Component_ID", "root", "simhash"]
