import random
import zlib
from array import array

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from edgeloom.llm import tokens
from edgeloom.llm.common import Remembered, workdir

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = (str(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))


def whole(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1]


def written(spark, docs, path=WORD, **options):
    out = workdir(spark, "tokens")
    tokens.write_tokens(docs, out, path, **options)
    return out


def test_round_trip(spark, docs, rows):
    out = written(spark, docs, rows_per_part=9)
    got = tokens.digest(spark, out).collect()
    at, expected = 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = whole(WORD, text)
        expected.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_order_and_selective_reads(spark, docs, rows, tmp_path):
    out = written(spark, docs, rows_per_part=9)
    files = sorted((spark.read.parquet(f"{out}/tokens").select("part").distinct().collect()))
    assert len(files) > 3
    index = tokens.read_index(spark, out)
    assert "ids" not in index.columns and index.count() == len(rows)
    few = tokens.read_tokens(spark, out, 30, 35)
    assert {r.doc_id for r in few.collect()} == set(range(30, 36))
    assert "GreaterThanOrEqual(doc_id,30)" in few._jdf.queryExecution().toString()
    for f in spark.read.parquet(f"{out}/tokens").inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(4)
            assert column.path_in_schema == "ids.list.element" and column.has_dictionary_page and column.has_column_index


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library_by_letter(path):
    """Letters whose case, marks or composition could part words otherwise than the library does."""
    r, letters = random.Random(2), "abAB .,;:!?'’sStTH\n\t\u00a0\u0301\u0331\u0307éÉñÑİıẞßçḈ1٣²-_()中文ǅ𝔄\u2028\x0b#ΣσςΟ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["it's. İ; H\u0331 a.", "ab.", "ab. "]
    encoder = tokens.Encoder(path)
    ids, counts = encoder.encode(pa.array(texts), 1)
    assert ids.tolist() == [i for t in texts for i in whole_of(encoder.tokenizer, t)]
    assert counts.tolist() == [len(whole_of(encoder.tokenizer, t)) for t in texts]


def whole_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    r = random.Random(1)
    pieces = ["the", "The", "idiot's", "don't", "ÀÉ", "straße", "é", "́", "x y", "12", "3.5%", "", "İ", "Σας", "漢字", "<|endoftext|>", "a<|startoftext|>b", "\t", " ", "👍🏽", "co-op", "\x00", "ﬁ", "½"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", "\n", "  ", "", "\r\n"]) for _ in range(r.randint(0, 25))) for _ in range(400)] + [None, "", " "]
    encoder = tokens.Encoder(path)
    assert encoder.by_word == (path == WORD)
    ids, counts = encoder.encode(pa.array(texts, pa.string()), 1)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == whole(path, t), t
        at += n


def test_remembered_forgets():
    import numpy as np

    made = []

    def make(words):
        made.extend(words)
        return np.concatenate([np.full(len(w), len(w), np.int32) for w in words]), np.array([len(w) for w in words])

    memo = Remembered(make, np.int32, 5)
    for ws in (["a", "bb"], ["bb", "ccc", "dddd"], ["eeeee", "f", "gg"], ["a", "gg"], ["bb", "gg", "a"]):
        flat, starts, sizes = memo.lookup(pa.array(ws))
        assert [flat[s : s + n].tolist() for s, n in zip(starts, sizes)] == [[len(w)] * len(w) for w in ws]
    assert len(memo.words) < 8 and made.count("gg") == 1


def test_empty(spark, empty):
    assert tokens.digest(spark, written(spark, empty)).count() == 0


def test_rows_that_are_all_alike_fill_several_files(spark):
    rows = [(None, "the same words")] * 60 + [(7, "other words")] * 60 + [(i, f"number {i}") for i in range(60)] + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = written(spark, df, rows_per_part=15)
    by_part = spark.read.parquet(f"{out}/tokens").where("doc_id is null").groupBy("part").count().collect()
    assert len(by_part) >= 4 and max(r["count"] for r in by_part) < 60
    at, expected = 0, []
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = whole(WORD, text)
        expected.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.digest(spark, out).collect()), key=str) == sorted(expected, key=str)


def test_long_texts_get_files_of_their_own(spark):
    rows = [(i, "long words " * (3000 if i < 4 else 1)) for i in range(40)]
    out = written(spark, spark.createDataFrame(rows, "doc_id long, text string"), bytes_per_part=40_000)
    parts = spark.read.parquet(f"{out}/tokens").where("doc_id < 4").select("part").distinct().count()
    assert parts >= 3 and tokens.digest(spark, out).count() == 40


def test_memo_has_a_bound_in_bytes():
    import numpy as np

    memo = Remembered(lambda ws: (np.full(len(ws), 7, np.int32), np.ones(len(ws), np.int64)), np.int32, most_bytes=20_000)
    for k in range(50):
        flat, starts, sizes = memo.lookup(pa.array([f"w{k}-{i}" for i in range(40)] + ["long" * 100]))
        assert flat[starts].tolist() == [7] * 41 and sizes.tolist() == [1] * 41
        assert sum(len(w) + 4 + memo.OVERHEAD for w in memo.words) <= 30_000 and max(map(len, memo.words)) <= memo.LONG
