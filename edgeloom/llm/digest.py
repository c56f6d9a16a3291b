"""Document fingerprints: a quartile bucket digest.

Every window of five bytes adds three byte triplets (neighbours and two spread
ones) to ``BUCKETS`` hashed counters.  A counter becomes two bits, its quartile
among the text's counters; the length becomes one logarithmic byte.  Two digests
differ by the steps between their quartiles, with a jump from lowest to highest
counted double, plus the steps between their lengths; the difference is bounded,
and the likeness is one minus its share of that bound.

``compared`` fingerprints each text, the same text with its end replaced by the
start of the next one in descending id order, and compares it with both.  Texts
are dealt once, into ranges of ids of about equal rows and bytes; the first text
of the next range is sent along, so no range waits for another.

Edge cases: null texts count as empty; texts of under five bytes have the bucket
part zero and differ by length only; null ids come last; rows with equal ids (or
none) are ordered by their texts' first 64 characters, then by a hash, and may
fill several ranges; one row is its own next; an empty table gives no rows; in
``digests`` a column of the name ``fingerprint`` is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import Ranges, record_batch, short_batches, small_batches, spare

BUCKETS = 128
#: Places of the three bytes in a window of five, and odd multipliers that mix them.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
MULTIPLIERS = ((0x9E3B, 0x85EB, 0xC2B3), (0x27D5, 0x1656, 0x9E37), (0xB529, 0x68E3, 0x1B56))
#: Bytes hashed at a time.
AT_ONCE = 1 << 20
#: Length steps beyond this add nothing to a difference.
MOST_LENGTH_STEPS = 24
#: The most that two digests can differ: every bucket by a double jump, and the length.
BOUND = 6 * BUCKETS + 2 * MOST_LENGTH_STEPS


def counts(data: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for a in range(0, max(0, len(data) - 4), AT_ONCE):
        b = np.frombuffer(data[a : a + AT_ONCE + 4], dtype=np.uint8).astype(np.uint32)
        n = len(b) - 4
        for at, by in zip(PATTERNS, MULTIPLIERS):
            h = b[at[0] : at[0] + n] * np.uint32(by[0] * 65599)
            h ^= b[at[1] : at[1] + n] * np.uint32(by[1] * 40503)
            h += b[at[2] : at[2] + n] * np.uint32(by[2] * 30011)
            h *= np.uint32(0x9E3779B1)
            out += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return out


def codes(data: bytes) -> np.ndarray:
    """The digest as small integers: a quartile (0 to 3) for each bucket, then the length code."""
    got = counts(data)
    ordered = np.sort(got)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (got[:, None] > cuts).sum(axis=1) if ordered[-1] else np.zeros(BUCKETS, dtype=np.int64)
    length = min(255, int(round(8 * np.log2(len(data) + 1))))
    return np.append(quartile, length).astype(np.int16)


def text_of(code: np.ndarray) -> str:
    """Lower-case hex: the length code, then four buckets a byte."""
    q = code[:-1].reshape(-1, 4).astype(np.uint8)
    packed = q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]
    return f"{int(code[-1]):02x}" + packed.tobytes().hex()


def code_of(text: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(text[2:]), dtype=np.uint8)
    q = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1)
    return np.append(q, int(text[:2], 16)).astype(np.int16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for the most that two can differ."""
    steps = np.abs(a[:-1] - b[:-1])
    difference = int(steps.sum()) + 3 * int((steps == 3).sum()) + 2 * min(MOST_LENGTH_STEPS, abs(int(a[-1]) - int(b[-1])))
    return 1.0 - difference / BOUND


def digests(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``fingerprint``: no shuffle."""
    kept = [c for c in docs.columns if c.lower() not in (text_column.lower(), "fingerprint")]
    text = spare(docs, "_text")[0]

    def run(batches):
        for batch in small_batches(batches):
            made = [text_of(codes((t or "").encode())) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])

    data = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_column).alias(text))
    return short_batches(data).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("fingerprint")).schema)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many characters of the start of ``after`` (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_per_part: int = 5_000, bytes_per_part: int = 16 << 20) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    ranges = Ranges(docs, id_column, text_column, rows_per_part, bytes_per_part, descending=True)
    parts = len(ranges)
    routed = pa.schema([("part", pa.int32()), ("extra", pa.bool_()), ("i", pa.int64()), ("t", pa.string())])
    schema = pa.schema([("i", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def route(batches):
        """Rows to their ranges; a row that starts a range also goes to the end of the range before, whose last row it follows."""
        turn, sent = 0, set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, firsts = ranges.deal(ids, batch.column(2), batch.column(3), turn)
            turn += batch.num_rows
            yield record_batch({"part": at, "extra": np.zeros(len(ids), bool), "i": ids, "t": texts}, routed)
            # of rows that are all alike, one from each task is enough
            edge = [(row, p) for row in firsts for p in ranges.ranges_from(ranges.key(*(batch.column(c)[row].as_py() for c in (0, 2, 3)))) if p not in sent]
            if edge:
                sent.update(p for _, p in edge)
                rows = pa.array([row for row, _ in edge])
                yield record_batch({"part": np.array([(p - 1) % parts for _, p in edge], np.int32), "extra": np.ones(len(edge), bool), "i": ids.take(rows), "t": texts.take(rows)}, routed)

    def follow(batches):
        """Rows of each range in descending order; the extra rows stand at its end."""
        last = first = None  # (part, id, text, codes)

        def pair(row, nxt):
            changed = edited(row[2], nxt[2]).encode()
            other = codes(changed)
            return row[1], len(row[2]), hashlib.sha256(changed).hexdigest(), text_of(row[3]), text_of(other), likeness(row[3], other), likeness(row[3], nxt[3])

        for batch in small_batches(batches):
            out = []
            for part, extra, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] != part:
                    # no row was sent after it: its own first follows
                    out.append(pair(last, first))
                    last = None
                if extra and last is None:
                    continue
                row = (part, i, text or "", codes((text or "").encode()))
                first = row if last is None else first
                if last is not None:
                    out.append(pair(last, row))
                last = row
                if extra:
                    last = None
            if out:
                yield record_batch(dict(zip(schema.names, map(list, zip(*out)))), schema)
        if last is not None:
            yield record_batch(dict(zip(schema.names, [[x] for x in pair(last, first)])), schema)

    data = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).select("i", "t", *ranges.ties(F.col("t")))
    dealt = short_batches(data).mapInArrow(route, "part int, extra boolean, i long, t string").repartitionById(parts, F.col("part"))
    ordered = ranges.sorted(dealt, "part", "extra")
    got = short_batches(ordered).mapInArrow(follow, "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumnRenamed("i", id_column)


def report(docs: DataFrame) -> DataFrame:
    return compared(docs.select("doc_id", "text"))
