import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import langid
from edgeloom.llm.common import held_out


def longest_matches(text, word):
    """Phrases of a word by searching the labelled words."""
    n, i = 0, 0
    while i < len(word):
        size = max((k for k in range(1, len(word) - i + 1) if any(word[i : i + k] in w for w in text)), default=1)
        n, i = n + 1, i + size
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton_against_search(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcé") for _ in range(n))
    text = [make(r.randint(1, 9)) for _ in range(12)]
    a = langid.Automaton()
    for w in text:
        a.add(w)
    edges = a.freeze()
    for _ in range(60):
        w = make(r.randint(1, 14)) + r.choice(["", "z"])
        assert langid.phrases(edges, w) == longest_matches(text, w), (text, w)


def test_held_out_is_crc32(spark):
    got = {r.i: r.h for r in spark.range(200).withColumnRenamed("id", "i").select("i", held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in langid.report(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [i for i, r in found.items() if r.held_out]
    assert len(found) == len(truth) and sum(found[i].lang_pred == truth[i] for i in out) / len(out) > 0.97


def test_learns_only_from_learnable_rows(spark):
    rows = [(i, "abc " * 5, "xx" if zlib.crc32(str(i).encode()) % 5 else "wrong") for i in range(100)]
    got = langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"xx"} and {r.score for r in got} == {1.0}


def test_edges(docs, rows, empty):
    got = langid.report(docs).collect()
    assert len(got) == len(rows)
    nothing = [r for r in rows if not re.search(r"[^\W\d_]", r[1] or "")]
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == len(nothing)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.report(empty).count() == 0
    assert {r.lang_pred for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_decision(learn, text):
    """The language of fewest bits by searching the labelled texts, piece by piece."""
    read = lambda t: re.sub(r"[\W\d_]+", " ", f" {t or ''} ".lower())
    text, bits = read(text), {}
    if text == " ":
        return "und", 0.0
    for lang, texts in learn.items():
        known = [read(t) for t in texts if read(t) != " "]
        if known:
            n = sum(longest_matches(known, text[k : k + langid.PIECE]) for k in range(0, len(text), langid.PIECE))
            bits[lang] = n * __import__("math").log2(sum(map(len, known)) + 1)
    best = min(sorted(bits), key=bits.get)
    rest = min([b for l, b in bits.items() if l != best], default=float("inf"))
    return best, 1.0 if rest == float("inf") else 1 - bits[best] / rest if rest else 0.0


def test_prediction_against_search(spark):
    r = random.Random(6)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(25)] for k, a in (("xx", "abcdé"), ("yy", "bcdef"), ("zz", "ßüxyz漢字"))}
    say = lambda k, n: " ".join(r.choice(words[k]) + r.choice(["", ",", ". 3", "'"]) for _ in range(n))
    rows = [(i, say(k := r.choice(list(words)), r.randint(1, 20)), k) for i in range(60)] + [(100, say("xx", 600), "xx"), (101, "", "xx"), (102, None, "yy"), (103, "ÀÉ 12 qq", None), (104, "<3 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = {}
    for i, t, k in rows:
        if k and t and zlib.crc32(str(i).encode()) % 5 and len(t) <= 10_000:
            learn.setdefault(k, []).append(t)
    assert all(len(x) <= 40 for x in learn.values())
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.report(docs).collect()}
    for i, t, _ in rows:
        lang, score = plain_decision(learn, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


@pytest.mark.parametrize("first", [True, False])
def test_copies_of_a_row_change_no_model(spark, first):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en'").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(20_000)).drop("id")
    given = copies.unionAll(docs) if first else docs.unionAll(copies)
    a, b = langid.fit(docs), langid.fit(given)
    assert a.languages == b.languages and len(a.languages) > 1 and a.bits == b.bits and (a.edges.table == b.edges.table).all()


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i % 300:03d}") for i in range(1500)]
    assert len(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 300
