"""Substring dedup by sliding sentence spans.

A span starts at every sentence and takes sentences until it has two at least
and ``least_words`` words.  Spans with equal hashes (128 bits, of their
sentences in lower case with single spaces) in several places are repeated; a
sentence goes if any span that covers it stands elsewhere before: in a document
with a smaller id, or earlier in the same one.

Every span of every document is hashed.  Counting combines before the shuffle,
and what meets afterwards are fixed-size rows, which AQE may split, so one
passage may stand in a third of all documents.

Edge cases: null and empty texts have no sentences; texts of one sentence or of
fewer than ``least_words`` words have no span; null ids come last; rows with an
equal id count as one document, so neither loses what the other has first; an
empty table gives no rows; columns named n_sentences, n_removed or removed (in any
case) are replaced, others pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize, record_batch, short_batches, small_batches, spare

END = re.compile(r"([.!?]+ +|\n+)")
SPACE = re.compile(r"[ \t\n\r\f\x0b]+")
LEAST_WORDS = 12
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


def sentences(text: str | None) -> list[str]:
    """Sentences with what separates them from the next; joined, they are the text."""
    parts = END.split(text or "")
    return [s for s in map("".join, zip(parts[::2], [*parts[1::2], ""])) if s]


def spans(pieces: list[str], least_words: int = LEAST_WORDS) -> list[tuple[int, int, str]]:
    """(start, length, normalised text) of each sentence's span."""
    plain = [SPACE.sub(" ", s).strip(" ").lower() for s in pieces]
    words = [s.count(" ") + 1 if s else 0 for s in plain]
    out, end, total = [], 0, 0
    for i in range(len(plain)):
        while end < len(plain) and (total < least_words or end < i + 2):
            total += words[end]
            end += 1
        if total < least_words or end < i + 2:
            break
        out.append((i, end - i, "\n".join(plain[i:end])))
        total -= words[i]
    return out


def _hashed(least_words: int):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        for batch in small_batches(batches, most=1 << 20):
            out = [[] for _ in schema]
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                met = set()
                for start, length, plain in spans(sentences(text), least_words):
                    d = xxhash.xxh3_128_digest(plain)
                    a, b = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                    for column, x in zip(out, (i, h, start, length, a, b, d in met)):
                        column.append(x)
                    met.add(d)
            yield record_batch(dict(zip(schema.names, out)), schema)

    return run


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text_hash, spans): the spans (start, length) of each document that stand elsewhere before."""
    data = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("t"))
    kinds = "id long, text_hash long, start int, length int, a long, b long, again boolean"
    all_spans = materialize(short_batches(data).mapInArrow(_hashed(least_words), kinds), "spans")
    first = all_spans.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("a", "b", "first")
    later = all_spans.where(~F.col("again")).join(first, ["a", "b"]).where("id > first")
    gone = later.select("id", "text_hash", "start", "length").unionAll(all_spans.where("again").select("id", "text_hash", "start", "length"))
    return gone.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the text cut, plus n_sentences, n_removed and removed (start, length of each cut, in sentences)."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "removed")])
    i, h, s = spare(docs, "_id", "_hash", "_spans")
    found = repeated(docs, id_column, text_column, least_words).toDF(i, h, s)
    keyed = rest.withColumn(i, F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))).withColumn(h, F.xxhash64(text_column))
    met = keyed.join(found, [i, h], "left").drop(i, h)
    columns = list(rest.columns)
    at = columns.index(text_column)

    def run(batches):
        for batch in small_batches(batches):
            texts, counts, gone, cuts = [], [], [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                pieces = sentences(text)
                drop = sorted({j for s in found or () for j in range(s["start"], s["start"] + s["length"])})
                dropped = set(drop)
                texts.append("".join(p for j, p in enumerate(pieces) if j not in dropped) if drop else text)
                counts.append(len(pieces))
                gone.append(len(drop))
                runs = []
                for j in drop:
                    if runs and runs[-1]["start"] + runs[-1]["length"] == j:
                        runs[-1]["length"] += 1
                    else:
                        runs.append({"start": j, "length": 1})
                cuts.append(runs)
            made = [*batch.columns[: len(columns)], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]
            made[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(made, names=[*columns, "n_sentences", "n_removed", "removed"])

    none = F.array().cast("array<struct<start:int,length:int>>")
    shape = rest.withColumns({"n_sentences": F.lit(None).cast("long"), "n_removed": F.lit(None).cast("long"), "removed": F.when(F.lit(False), none)})
    return short_batches(met.select(*[F.col(f"`{c}`") for c in columns], s)).mapInArrow(run, shape.schema)


def report(docs: DataFrame) -> DataFrame:
    got = dedup(docs.select("doc_id", "text"))
    return got.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeated"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
