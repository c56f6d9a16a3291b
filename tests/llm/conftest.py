"""Small tables with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ["_text", "_hash", "_id", "_kept", "_row", "_w", "_n", "_salt", "_key", "row", "size", "source_size", "target", "copies", "simhash", "component_id", "toxicity", "n_words", "spans", "removed", "host", "lines", "part", "i", "t", "k", "score", "fingerprint", "start", "ids"]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(r.randint(0, 60)) for _ in range(n)).capitalize() + ". "


def texts() -> list[tuple]:
    r = random.Random(5)
    plain = ["".join(sentence(r, r.randint(4, 14)) for _ in range(r.randint(1, 12))).strip() for _ in range(40)]
    shared = "".join(sentence(r, 18) for _ in range(4)).strip()
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(plain)]
    rows += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \n\t ", "fr", None), (103, "one", "fr", None), (104, "Ünïcode ÀÉ straße!", "de", "s9")]
    rows += [(110 + i, plain[3], "en", "s0") for i in range(12)]  # many copies
    rows += [(130 + i, plain[5 + i] + " " + shared + " " + plain[6 + i], "en", "s2") for i in range(5)]  # a passage that documents share
    rows += [(140, plain[7].replace(" ", "  ", 3), "en", "s2"), (141, plain[8] + " extra", "en", "s2")]
    rows += [(150, "".join(sentence(r, 12) for _ in range(3000)), "en", "s3")]  # very long
    rows += [(1, plain[1], "en", "s1"), (1, plain[1], "en", "s1"), (1, plain[2], "en", "s1")]  # repeated rows and ids
    rows += [(None, plain[4], "en", "s0"), (None, None, None, None), (None, "no id here at all", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(*r, None if r[1] is None else len(r[1]), *(f"own {c}" for c in CLASHING)) for r in rows]
    return spark.createDataFrame(data, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def untouched(got, given) -> None:
    """Columns are the input's, in order, and the clashing ones hold what they held."""
    assert got.columns == given.columns
    for r in got.select(*[f"`{c}`" for c in CLASHING]).distinct().collect():
        assert list(r) == [f"own {c}" for c in CLASHING]
