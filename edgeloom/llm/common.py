"""Helpers shared by the operators: tables, shared folders, ordered dealing."""

from __future__ import annotations

import ctypes
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.storage import materialize, workdir  # noqa: F401  (operators take them from here)

#: A-Z and a-z: the only letters that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text bytes that a Python worker handles at a time.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes that an operator remembers in a Python worker.
MEMO_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def learnable(doc_id: Column) -> Column:
    """Rows that models may learn labels from: crc32 of the id mod 5 is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def held_out(doc_id: Column) -> Column:
    return ~learnable(doc_id)


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends texts to Python ``BATCH_ROWS`` rows at a time from now on, or fewer if it does already.

    Both sides hold a batch or two of each running task outside the heap, and
    Spark's 10,000 rows of text are far more than Python handles at a time.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def small_batches(batches, most: int = CHUNK_BYTES):
    """Halve Arrow batches until each holds at most ``most`` bytes or one row, and give back what the last one needed."""
    for batch in batches:
        left = [batch]
        while left:
            b = left.pop()
            if b.num_rows > 1 and b.nbytes > most:
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b
                pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can: it else stays with an idle worker."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)


class Ranges:
    """Ranges of rows in the order of id (nulls first, or last if ``descending``), then of the text's start and hash.

    ``starts`` are keys of existing rows, about one for every share of rows and
    bytes; range ``i`` is ``[starts[i], starts[i + 1])``, and what stands below
    the first belongs to range 0.  They come from a random sample of rows that
    is in proportion to the number of ranges (``SAMPLED`` each), so the driver
    holds some 200 bytes for each of those, whatever the rows hold.  A key that
    stands there several times belongs to rows that are all alike and fill more
    than a range; they are dealt over its ranges in turn.
    """

    SAMPLED, PREFIX = 20, 64

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, rows_per_part: int, bytes_per_part: int, descending: bool = False):
        self.descending = descending
        rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))
        light = rows.select("i", *self.ties(F.col("t")), F.coalesce(F.octet_length("t"), F.lit(0)).alias("b"))
        found = light.agg(F.count(F.lit(1)), F.sum("b"), F.min(F.struct(*self.order(light)))).first()
        count, size, first = found
        self.starts: list[tuple] = []
        if not count:
            return
        total = count / rows_per_part + size / bytes_per_part
        parts = max(1, math.ceil(total))
        self.starts = [self.key(first.id if first.known else None, first.p if first.text else None, first.h)]
        if parts > 1:
            some = light.where(F.rand(17) < F.lit(min(1.0, self.SAMPLED * parts / count))).select("i", "p", "h", "b").collect()
            weighed = sorted((self.key(r.i, r.p, r.h), 1 / rows_per_part + r.b / bytes_per_part) for r in some)
            total, upto, k = sum(w for _, w in weighed), 0.0, 1
            for key, w in weighed:
                if upto >= k * total / parts:
                    self.starts.append(max(key, self.starts[0]))
                    k = int(upto * parts / total) + 1
                upto += w

    def __len__(self) -> int:
        return max(1, len(self.starts))

    @classmethod
    def ties(cls, text: Column) -> list[Column]:
        """What orders rows of equal ids: the start of the text, then its hash."""
        return [F.substring(text, 1, cls.PREFIX).alias("p"), F.xxhash64(text).alias("h")]

    def order(self, rows: DataFrame) -> list[Column]:
        """The order as columns that compare without nulls."""
        known = F.col("i").isNotNull()
        value = F.coalesce(F.col("i"), F.lit(0))
        return [(~known if self.descending else known).alias("order"), (F.bitwise_not(value) if self.descending else value).alias("value"), F.col("p").isNotNull().alias("text"), F.coalesce("p", F.lit("")).alias("p"), F.col("h"), known.alias("known"), value.alias("id")]

    def key(self, i: int | None, p: str | None, h: int) -> tuple:
        return (i is None if self.descending else i is not None, (~i if self.descending else i) if i is not None else 0, p is not None, p or "", h)

    def sorted(self, dealt: DataFrame, *before: str) -> DataFrame:
        """Rows (i, t) in this order within partitions, after the columns ``before``."""
        order = F.desc_nulls_last("i") if self.descending else F.asc_nulls_first("i")
        return dealt.sortWithinPartitions(*before, order, *[c.asc_nulls_first() for c in (F.substring("t", 1, self.PREFIX), F.xxhash64("t"))])

    def deal(self, ids: pa.Array, prefixes: pa.Array, hashes: pa.Array, turn: int = 0) -> tuple[np.ndarray, list[int]]:
        """The range of each row, and the rows whose key is a range's start (in place of a search, one of each key)."""
        out, firsts = np.zeros(len(ids), np.int32), {}
        if not self.starts:
            return out, []
        bounds = [(~s[1] if self.descending else s[1]) for s in self.starts if s[0] != self.descending]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        slow = ~known
        if bounds:
            edge = np.array(bounds, dtype=np.int64)
            # unequal ids are told apart by a search; the others by their whole keys
            if self.descending:
                out[:] = np.maximum(np.searchsorted(~edge, ~value, "right") - 1, 0)
            else:
                out[:] = np.maximum(np.searchsorted(edge, value, "right") - 1 + (len(self.starts) - len(bounds)), 0)
            slow |= np.isin(value, edge)
        for at in np.flatnonzero(slow).tolist():
            key = self.key(ids[at].as_py(), prefixes[at].as_py(), hashes[at].as_py())
            low, high = bisect_left(self.starts, key), bisect_right(self.starts, key)
            if low < high:
                out[at] = low + (turn + at) % (high - low)
                firsts.setdefault(key, at)
            else:
                out[at] = max(0, high - 1)
        return out, list(firsts.values())

    def ranges_from(self, key: tuple) -> range:
        """The ranges that start with a key."""
        return range(bisect_left(self.starts, key), bisect_right(self.starts, key))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``starts``, ``sizes`` of ``flat``, one after another."""
    upto = np.cumsum(sizes, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # half the memory where it is enough
    places = np.arange(total, dtype=kind)
    places += np.repeat((starts - (upto - sizes)).astype(kind), sizes)
    return flat[places]


class Remembered:
    """Rows of numbers for distinct words, made when a word is first met.

    ``make`` takes a list of words and gives all their numbers in turn and how
    many each has.  Two generations are kept: when the young one holds half of
    ``most_bytes`` (or of ``most`` words) it becomes the old one, and a word found
    in the old one moves to the young one; so what is used stays and the rest
    goes.  Words of over ``LONG`` characters are made anew each time.
    """

    #: Characters of a word that is kept at most, and bytes that a word takes besides its own.
    LONG, OVERHEAD = 64, 200

    def __init__(self, make, dtype, most: int = 1 << 62, most_bytes: int = MEMO_BYTES):
        self.make, self.dtype, self.most, self.most_bytes = make, np.dtype(dtype), most, most_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    @property
    def words(self) -> list[str]:
        return [*self.young, *(w for w in self.old if w not in self.young)]

    def _keep(self, words: list[str], found: list[bytes], places: list[int]) -> None:
        young, size, half, most = self.young, self.bytes, self.most_bytes // 2, self.most // 2
        for at in places:
            word, held = words[at], found[at]
            if len(word) > self.LONG:
                continue
            young[word] = held
            size += len(word) + len(held) + self.OVERHEAD
            if size >= half or len(young) > most:
                self.old, self.young, size = young, {}, 0
                young = self.young
        self.bytes = size

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes) of distinct words."""
        words = words.to_pylist()
        found = list(map(self.young.get, words))
        missing, again, old = [], [], self.old
        for at in [at for at, held in enumerate(found) if held is None]:
            held = found[at] = old.get(words[at])
            (missing if held is None else again).append(at)
        self._keep(words, found, again)
        if missing:
            flat, sizes = self.make([words[at] for at in missing])
            data, width = np.ascontiguousarray(flat, self.dtype).tobytes(), self.dtype.itemsize
            upto = (np.cumsum(sizes) * width).tolist()
            for at, low, high in zip(missing, [0, *upto], upto):
                found[at] = data[low:high]
            self._keep(words, found, missing)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes, sizes


#: What this worker process remembers: one operator's things at a time.
_HELD: dict = {}


def held(key, make):
    """What ``make`` gave for ``key`` when this worker first asked; another key's is dropped, so operators don't add up."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def coded_tokens(texts: pa.Array, lower: bool = False):
    """Distinct white-space tokens of an Arrow column of texts, the code of each token in turn, and each text's first place.

    The last is one longer than the texts, so that text ``i`` has the tokens
    ``places[i]`` to ``places[i + 1]``.
    """
    texts = pc.fill_null(texts, "")
    cut = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    coded = cut.flatten().dictionary_encode()
    places = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))))
    return coded.dictionary, coded.indices.to_numpy(), places


#: Hashes whose bits are counted at a time.
AT_ONCE = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[i : i + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def reduce_texts(values: np.ndarray, places: np.ndarray, how, empty) -> np.ndarray:
    """``how.reduceat`` over each text's tokens; texts without tokens get ``empty``."""
    out = np.full((len(places) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(places))
    if len(full):
        out[full] = how.reduceat(values, places[:-1][full], axis=0)
    return out
