import hashlib

import numpy as np

from edgeloom.llm import digest
from tests.llm.conftest import CLASHING


def plain(rows):
    order = sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    out = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = (t[: len(t) - half] + after[:half]).encode()
        a, b, c = (digest.codes(x) for x in (t.encode(), changed, after.encode()))
        out.append((i, len(t), hashlib.sha256(changed).hexdigest(), digest.text_of(a), digest.text_of(b), digest.likeness(a, b), digest.likeness(a, c)))
    return out


def test_against_plain_order(docs, rows):
    for per_part in (7, 1000):
        got = digest.compared(docs, rows_per_part=per_part).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_without_ids(spark):
    rows = [(None, "b"), (None, "a"), (None, None)]
    got = digest.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_one_and_none(spark, empty):
    one = digest.compared(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == plain([(5, "alone here")]) and one[0].near_next == 1.0
    assert digest.compared(empty).count() == 0


def test_counts_against_loop():
    data = "Ünïcode text, twice over: ".encode() * 30
    want = np.zeros(digest.BUCKETS, dtype=int)
    for i in range(len(data) - 4):
        for at, by in zip(digest.PATTERNS, digest.MULTIPLIERS):
            h = data[i + at[0]] * (by[0] * 65599) & 0xFFFFFFFF
            h ^= data[i + at[1]] * (by[1] * 40503) & 0xFFFFFFFF
            h = (h + (data[i + at[2]] * (by[2] * 30011) & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF
            want[h >> 25] += 1
    assert (digest.counts(data) == want).all()
    before, digest.AT_ONCE = digest.AT_ONCE, 64
    assert (digest.counts(data) == want).all()
    digest.AT_ONCE = before


def test_likeness_is_bounded():
    a, b = digest.codes(b"a" * 3000), digest.codes(bytes(range(256)) * 40)
    assert 0 <= digest.likeness(a, b) < digest.likeness(a, a) == 1.0
    assert (digest.code_of(digest.text_of(b)) == b).all()


def test_separates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = digest.report(docs).where("n_chars > 500").collect()
    assert sum(r.near_edited > r.near_next for r in got) / len(got) > 0.95


def test_digests(docs, rows):
    got = digest.digests(docs.drop("fingerprint"))
    assert got.columns == [c for c in docs.columns if c not in ("text", "fingerprint")] + ["fingerprint"]
    assert {r._text for r in got.select("_text").collect()} == {"own _text"} and "_text" in CLASHING


def test_rows_that_are_all_alike_fill_several_ranges(spark):
    rows = [(None, "nobody's text, five bytes at least")] * 50 + [(9, "the same text again and again")] * 50 + [(i, f"text number {i} of many") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for per_part in (7, 1000):
        got = digest.compared(df, rows_per_part=per_part).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_codes_and_likeness_against_definition(spark):
    def code(data):
        got, ordered = digest.counts(data).tolist(), sorted(digest.counts(data).tolist())
        q1, q2, q3 = ordered[31], ordered[63], ordered[95]
        quartiles = [0 if not any(got) else (x > q1) + (x > q2) + (x > q3) for x in got]
        return quartiles, min(255, round(8 * __import__("math").log2(len(data) + 1)))

    texts = [b"", b"abc", b"abcdef", b"the quick brown fox " * 40, bytes(range(256)) * 9, b"z" * 5000]
    for x in texts:
        (q, n), made = code(x), digest.codes(x)
        assert made[:-1].tolist() == q and made[-1] == n
        assert digest.text_of(made) == f"{n:02x}" + "".join(f"{a << 6 | b << 4 | c << 2 | d:02x}" for a, b, c, d in zip(q[::4], q[1::4], q[2::4], q[3::4]))
        for y in texts:
            (p, m), total = code(y), 0
            for a, b in zip(q, p):
                total += 6 if abs(a - b) == 3 else abs(a - b)
            total += 2 * min(24, abs(n - m))
            assert abs(digest.likeness(made, digest.codes(y)) - (1 - total / (6 * 128 + 48))) < 1e-12


def test_digests_replace_a_column_of_the_name_in_any_case(spark):
    df = spark.createDataFrame([(1, "some text here", "own", "x")], "doc_id long, text string, Fingerprint string, other string")
    got = digest.digests(df)
    assert got.columns == ["doc_id", "other", "fingerprint"] and got.first().fingerprint == digest.text_of(digest.codes(b"some text here"))
