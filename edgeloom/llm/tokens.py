"""Token-ID output: ordered Parquet list columns that can be read selectively.

``write_tokens`` deals documents into ranges of ascending id, about equal in
rows and bytes, one file a range, and encodes them where they land.  A row holds ``part``, ``local_start`` (ids
before it in its part), ``n_tokens``, the id and the list column ``ids``.  Row
groups and pages have set sizes, so a reader of metadata never touches the ids,
and a reader of a few documents uses the page index to skip the rest.  A small
table ``index`` (one row a part) turns part-relative offsets into global ones.

Edge cases: null and empty texts give the end id alone; null ids come first;
rows with equal ids (or none) stand in the order of their texts' first 64
characters, then of a hash, and may fill several files; an empty table gives
files without rows; other columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.llm.common import Ranges, Remembered, gather, held, record_batch, short_batches, small_batches

#: Bytes of words and their ids that a worker remembers: each word left out costs a call of the library.
MEMO_BYTES = 192 << 20
#: Text bytes that a worker encodes at a time: the words of a larger chunk are met once, not once a smaller one.
ENCODED_BYTES = 4 << 20
#: Words in one call of the library.
WORDS_A_CALL = 500
#: A letter of the Latin blocks (but U+0130, which lower-cases to two characters) and a mark after it, at the end of a word.
CLOSED = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af])([.,;:!?]) "
#: Words without combining marks, of which none composes with a letter: lower-casing A-Z commutes with NFC.
INERT = "^[\\x00-\u02ff]*$"


class Encoder:
    """Encodes Arrow columns of texts with the library.

    A tokenizer that drops white space encodes a text as its words in turn.  So
    a column is cut at spaces and newlines, and each distinct word is encoded by
    the library when first met; its ids are kept for later.  Where the tokenizer
    parts a word from a closing mark or lower-cases it, so does the cut, which
    leaves fewer distinct words.  Other tokenizers encode whole texts as they are.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        # a Spark task has one core; the library's own threads would only contend for it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), Remembered(self._new, np.int32, most_bytes=memo_bytes)
        alone = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = alone(" \n ") == [] and alone("ab cd\nef") == alone("ab") + alone("cd") + alone("ef") and alone(" gh") == alone("gh")
        self.parts = self.by_word and all(alone(w + m) == alone(w) + alone(m) for w in ("ab", "\u00e9", "it's") for m in ".,;:!?")
        steps = (json.loads(self.tokenizer.to_str())["normalizer"] or {})
        steps = steps.get("normalizers", [steps])
        known = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
        self.folds = self.by_word and known[1] in steps and all(x in known for x in steps)
        vocabulary = self.tokenizer.get_vocab()
        #: ids that end a stretch of letters, where the vocabulary marks such ends
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, memo_bytes: int = MEMO_BYTES) -> Encoder:
        """One encoder a worker process: later tasks find the words of earlier ones."""
        return held(("encoder", path, memo_bytes), lambda: cls(path, memo_bytes))

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Let the library encode words; those of letters only go many to a call, as each ends with one marked id."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        calls = [plain[i : i + WORDS_A_CALL] for i in range(0, len(plain), WORDS_A_CALL)]
        sizes, found, order, rest = np.zeros(len(words), np.int64), [], [], [i for i, w in enumerate(words) if not w.isalpha()]
        encode = self.tokenizer.encode_batch_fast
        batches = (calls[i : i + 8] for i in range(0, len(calls), 8))  # the library's answers are many times their ids
        for at, e in (x for b in batches for x in zip(b, encode([" ".join([words[i] for i in at]) for at in b], add_special_tokens=False))):
            ids = np.array(e.ids, dtype=np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(at) or stops[-1] != len(ids):
                rest += at
                continue
            sizes[at] = np.diff(stops, prepend=0)
            found.append(ids)
            order += at
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            each = [e.ids for e in encode([words[j] for j in part], add_special_tokens=False)]
            sizes[part] = list(map(len, each))
            found.append(np.array([x for ids in each for x in ids], dtype=np.int32))
            order += part
        # back to the order of the words
        flat, order = np.concatenate(found), np.array(order)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(flat, starts, sizes), sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        if self.by_word:
            if texts.nbytes > 1 << 30:
                texts = texts.cast(pa.large_string())
            texts = pc.replace_substring(texts, "\n", " ")
            if self.parts:
                texts = pc.replace_substring_regex(texts, CLOSED, r"\1 \2 ")
            cut = pc.split_pattern(texts, " ")
            coded = cut.flatten().dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy()
            if self.folds:
                coded = pc.if_else(pc.match_substring_regex(words, INERT), pc.ascii_lower(words), words).dictionary_encode()
                words, codes = coded.dictionary, coded.indices.to_numpy()[codes]
            flat, starts, sizes = self.memo.lookup(words)
            each = sizes[codes]
            ids, upto = gather(flat, starts[codes], each), np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
            stops = upto[np.cumsum(pc.list_value_length(cut).to_numpy())]
        else:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids, stops = np.array([i for x in lists for i in x], dtype=np.int32), np.cumsum([len(x) for x in lists], dtype=np.int64)
        return np.insert(ids, stops, end_id), np.diff(stops, prepend=0) + 1


def _encoder(path: str, end_id: int, id_column: str, memo_bytes: int, chunk_bytes: int):
    schema = pa.schema([("part", pa.int32()), (id_column, pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder, part, before = Encoder.of(path, memo_bytes), None, 0
        for batch in small_batches(batches, chunk_bytes):
            ids, counts = encoder.encode(batch.column(2), end_id)
            starts = []
            for p, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                if p != part:
                    part, before = p, 0
                starts.append(before)
                before += n
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
            yield record_batch({"part": batch.column(0), id_column: batch.column(1), "local_start": starts, "n_tokens": counts, "ids": lists}, schema)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", rows_per_part: int = 20_000, bytes_per_part: int = 64 << 20, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, memo_bytes: int = MEMO_BYTES, chunk_bytes: int = ENCODED_BYTES) -> None:
    """Write ``docs`` under ``path``: ``tokens`` (one ordered file a part) and ``index`` (part, rows, tokens, start).

    ``memo_bytes`` is what a worker remembers of words, ``chunk_bytes`` how much text it
    encodes at a time: both trade memory for time.
    """
    spark = docs.sparkSession
    ranges = Ranges(docs, id_column, text_column, rows_per_part, bytes_per_part)
    data = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).select("i", "t", *ranges.ties(F.col("t")))
    dealt = ranges.sorted(short_batches(data).mapInArrow(_router(ranges), "part int, i long, t string").repartitionById(len(ranges), F.col("part")), "part")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(id_column, T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    writer = short_batches(dealt).mapInArrow(_encoder(tokenizer_path, end_id, id_column, memo_bytes, chunk_bytes), schema).write.mode("errorifexists")
    settings = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 1000, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    for k, v in settings.items():
        writer = writer.option(k, str(v))
    writer.parquet(f"{path}/tokens")
    # One row a part: the only thing that is ordered in one task.
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    found = sorted(parts.collect())
    start, index = 0, []
    for r in found:
        index.append((r.part, r.rows, r.tokens, start))
        start += r.tokens
    spark.createDataFrame(index, "part int, rows long, tokens long, start long").coalesce(1).write.parquet(f"{path}/index")


def _router(ranges: Ranges):
    """Give each row the number of its range."""
    schema = pa.schema([("part", pa.int32()), ("i", pa.int64()), ("t", pa.string())])

    def run(batches):
        turn = 0
        for batch in batches:
            at, _ = ranges.deal(batch.column(0), batch.column(2), batch.column(3), turn)
            turn += batch.num_rows
            yield record_batch({"part": at, "i": batch.column(0), "t": batch.column(1)}, schema)

    return run


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens): the ids column is not read."""
    rows = spark.read.parquet(f"{path}/tokens")
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("_base"))
    # the index has a row for each file of at least bytes_per_part or rows_per_part: 40 bytes each
    return rows.drop("ids").join(F.broadcast(index), "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base", "local_start", "part")


def read_tokens(spark: SparkSession, path: str, low=None, high=None, id_column: str = "doc_id") -> DataFrame:
    """Documents with ids in [low, high]: the filter reaches the page index, other pages are skipped."""
    rows = spark.read.parquet(f"{path}/tokens")
    if low is not None:
        rows = rows.where(F.col(id_column) >= low)
    if high is not None:
        rows = rows.where(F.col(id_column) <= high)
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("_base"))
    return rows.join(F.broadcast(index), "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base", "local_start", "part")


def _summed(id_column: str):
    schema = pa.schema([(id_column, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids = batch.column(names.index("ids"))
            offsets, data = ids.offsets.to_pylist(), memoryview(ids.values.buffers()[1]).cast("B") if len(ids.values) else memoryview(b"")
            shift = ids.values.offset
            sums = [zlib.crc32(data[4 * (a + shift) : 4 * (b + shift)]) for a, b in zip(offsets, offsets[1:])]
            counts = [b - a for a, b in zip(offsets, offsets[1:])]
            yield record_batch({id_column: batch.column(names.index(id_column)), "start": batch.column(names.index("start")), "n_tokens": counts, "ids_crc32": sums}, schema)

    return run


def digest(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32), all computed from the ids that the files hold."""
    rows = read_tokens(spark, path, id_column=id_column).select(id_column, "start", "ids")
    return short_batches(rows).mapInArrow(_summed(id_column), f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")
