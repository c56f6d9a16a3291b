"""Language ID by cross-parsing entropy.

A text is read as its words in lower case, with one space between and at both
ends.  For each language a suffix automaton of labelled text, read the same way,
gives from any letter the longest stretch that the labelled text holds, and the
text is parsed into such stretches (phrases), across words.  A language's score
is its phrases times the logarithm of its automaton's length: the bits that name
the text by places of the labelled one.  The lowest wins.

A worker parses many texts for all languages at once, a letter at a time, in
pieces of ``PIECE`` characters that are parsed apart: the edges of all automata
lie in one hash table of flat arrays.

The automata are fitted on a bounded sample: ``docs_per_language`` learnable
documents of each language (fewer, but one at least, where there are so many
languages that ``most_documents`` would be passed), distinct texts of at most
``longest`` characters.  Every text is predicted whole.

Edge cases: texts that are null, empty or without letters give ``und`` with
score 0; ties go to the first language by name; without any labelled text all
texts give ``und``; a repeated row counts once in the sample; other columns are
never read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import held_out, learnable, record_batch, short_batches, small_batches

NO_LETTERS = re.compile(r"[\W\d_]+")
#: Characters parsed in one go.
PIECE = 512
#: Bytes of text that a worker parses at a time: the more, the more pieces side by side.
PARSE_BYTES = 4 << 20
#: Bits of a state or character, an odd multiplier that spreads keys over a table, and what no entry is.
BITS, SPREAD, FREE = 21, np.uint64(0x9E3779B97F4A7C15), -1


def plain(text: str | None) -> str:
    """The words of a text in lower case, with one space between and at both ends."""
    return NO_LETTERS.sub(" ", f" {text or ''} ".lower())


class Automaton:
    """Suffix automaton of texts: it holds exactly their parts.

    Edges lie in one dict keyed by state and character; after ``freeze`` that and
    the number of letters are all that is kept.
    """

    def __init__(self):
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length, self.letters = [-1], [0], 0

    def add(self, word: str) -> None:
        edges, link, length = self.edges, self.link, self.length
        last = 0
        for ch in word:
            self.letters += 1
            if ch in edges[last]:
                last = self._step(last, ch)
                continue
            cur = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in edges[p]:
                edges[p][ch] = cur
                p = link[p]
            if p != -1:
                link[cur] = self._step(p, ch)
            last = cur

    def _step(self, p: int, ch: str) -> int:
        """The state of the longest string of ``p`` followed by ``ch``, split off where it shares one with longer strings."""
        edges, link, length = self.edges, self.link, self.length
        q = edges[p][ch]
        if length[q] == length[p] + 1:
            return q
        new = len(edges)
        edges.append(dict(edges[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and edges[p].get(ch) == q:
            edges[p][ch] = new
            p = link[p]
        return new

    def freeze(self) -> dict[int, int]:
        return {state << 21 | ord(ch): to for state, out in enumerate(self.edges) for ch, to in out.items()}


def phrases(edges: dict[int, int], word: str) -> int:
    """Longest-match phrases of a word; a letter that the labelled text lacks is a phrase by itself."""
    count, state, get = 0, 0, edges.get
    for ch in word:
        c = ord(ch)
        to = get(state << 21 | c)
        if to is None:
            count += 1 if state else 0
            to = get(c)
            if to is None:
                count += 1
                to = 0
        state = to
    return count + (1 if state else 0)


class Edges:
    """The edges of several automata in one flat hash table with linear probing.

    An entry is an edge's key (state and character) with the state that it leads
    to below it: 21 bits each, so all automata together have under two million states.
    """

    def __init__(self, automata: list[dict[int, int]], states: list[int]):
        if sum(states) >= 1 << BITS:
            raise ValueError("the sample is too large: lower docs_per_language, most_documents or longest")
        self.roots = np.concatenate(([0], np.cumsum(states)[:-1])).astype(np.int64)
        keys = np.concatenate([np.fromiter(e, np.int64, len(e)) + (root << BITS) for e, root in zip(automata, self.roots.tolist())])
        to = np.concatenate([np.fromiter(e.values(), np.int64, len(e)) + root for e, root in zip(automata, self.roots.tolist())])
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, FREE, np.int64)
        place, left = self._places(keys), np.arange(len(keys))
        while len(left):
            free = self.table[place[left]] == FREE
            some, first = np.unique(place[left[free]], return_index=True)
            put = left[free][first]
            self.table[some] = keys[put] << BITS | to[put]
            left = left[self.table[place[left]] >> BITS != keys[left]]
            place[left] = (place[left] + 1) & self.mask

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each edge leads; -1 where there is none."""
        place = self._places(keys)
        out = self.table[place]
        left = np.flatnonzero((out >> BITS) != keys)
        seen = out[left]
        out &= (1 << BITS) - 1
        if len(left):
            out[left] = -1
            left, place = left[seen != FREE], place[left[seen != FREE]]
        while len(left):
            place = (place + 1) & self.mask
            seen = self.table[place]
            hit = (seen >> BITS) == keys[left]
            out[left[hit]] = seen[hit] & (1 << BITS) - 1
            on = ~hit & (seen != FREE)
            left, place = left[on], place[on]
        return out

    def parse(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The phrases of pieces of ``letters``: a row a piece, a column an automaton."""
        order = np.argsort(-sizes, kind="stable")
        starts, width = starts[order], len(self.roots)
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        roots = np.tile(self.roots, len(order))
        state, count = roots.copy(), np.zeros(len(roots), np.int32)
        for t, n in enumerate(active.tolist()):
            now = state[: n * width]
            c = np.repeat(letters[starts[:n] + t], width)
            to = self.find(now << BITS | c)
            if len(over := np.flatnonzero(to < 0)):
                count[over] += now[over] != roots[over]
                again = self.find(roots[over] << BITS | c[over])
                alone = again < 0  # a letter that the labelled text lacks is a phrase by itself
                count[over[alone]] += 1
                to[over] = np.where(alone, roots[over], again)
            state[: n * width] = to
        count += state != roots
        out = np.empty((len(order), width), np.int64)
        out[order] = count.reshape(-1, width)
        return out


class Model:
    """Frozen automata of all languages, with the weight of a phrase in bits."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages, self.bits, edges, states = [], [], [], []
        for lang in sorted(texts):
            automaton = Automaton()
            for t in texts[lang]:
                if (t := plain(t)) != " ":
                    automaton.add(t)
            if automaton.letters:
                self.languages.append(lang)
                self.bits.append(math.log2(automaton.letters + 1))
                edges.append(automaton.freeze())
                states.append(len(automaton.edges))
        self.edges = Edges(edges, states) if edges else None

    def count(self, texts: list[str | None]) -> np.ndarray:
        """For each text its letters, then its phrases for each language."""
        read = [plain(t) for t in texts]
        letters = np.frombuffer("".join(read).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, read), np.int64, len(read))
        out = np.zeros((len(texts), len(self.languages) + 1), np.int64)
        out[:, 0] = sizes - np.fromiter((t.count(" ") for t in read), np.int64, len(read))
        pieces = -(-sizes // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
        got = self.edges.parse(letters, starts, np.minimum(PIECE, np.repeat(sizes, pieces) - nth * PIECE))
        out[:, 1:] = np.add.reduceat(got, np.cumsum(pieces) - pieces, axis=0)
        return out

    def decide(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """For rows of counts: the language, and how far its bits lie below the next one's (0 to 1)."""
        n = len(sums)
        bits = sums[:, 1:] * np.array(self.bits)
        best = bits.argmin(axis=1)
        least = bits[np.arange(n), best]
        bits[np.arange(n), best] = np.inf
        rest = bits.min(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(rest), 1.0, np.where(rest > 0, 1.0 - least / rest, 0.0))
        known = sums[:, 0] > 0
        return [self.languages[i] if k else "und" for i, k in zip(best, known)], np.where(known, score, 0.0)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", docs_per_language: int = 40, most_documents: int = 400, longest: int = 10_000) -> Model:
    """Fit on a sample by hash of the learnable rows' distinct texts, of every language that there is."""
    lang, text = F.col(lang_column).cast("string").alias("l"), F.col(text_column)
    # a text is one row here however often it stands there, and only its hash is dealt out
    fits = F.length(text).between(1, longest)
    hashes = docs.where(learnable(F.col(id_column)) & F.col(lang_column).isNotNull() & fits).select(lang, F.xxhash64(text).alias("h")).distinct()
    counts = {r.l: r["count"] for r in hashes.groupBy("l").count().collect()}
    if not counts:
        return Model({})
    wanted = max(1, min(docs_per_language, most_documents // len(counts)))
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 40))
    # a threshold for each language lets some more than the wanted number pass, whatever the corpus holds; the window holds those
    share = docs.sparkSession.createDataFrame([(k, int((1 << 40) * min(1.0, (2 * wanted + 20) / n))) for k, n in counts.items()], "l string, below long")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("p", "h"))
    picked = hashes.join(F.broadcast(share), "l").withColumn("p", place).where("p < below").withColumn("n", rank).where(F.col("n") <= wanted)
    keys = docs.sparkSession.createDataFrame([(r.l, r.h, r.p) for r in picked.collect()], "l string, h long, p long")  # at most most_documents, or one a language
    rows = docs.where(learnable(F.col(id_column)) & fits).select(lang, F.xxhash64(text).alias("h"), text.alias("t")).join(F.broadcast(keys), ["l", "h"])
    texts = defaultdict(list)
    for r in sorted(rows.groupBy("l", "p", "h").agg(F.min("t").alias("t")).collect()):
        texts[r.l].append(r.t)
    return Model(texts)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone."""
    data = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))
    if not model.languages:
        return data.select(F.col("i").alias(id_column), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = pa.schema([("i", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters

    def run(batches):
        model = shared.value
        for batch in small_batches(batches, PARSE_BYTES):
            langs, score = model.decide(model.count(batch.column(1).to_pylist()))
            yield record_batch({"i": batch.column(0), "lang_pred": langs, "score": score}, schema)

    return short_batches(data).mapInArrow(run, "i long, lang_pred string, score double").withColumnRenamed("i", id_column)


def report(docs: DataFrame) -> DataFrame:
    got = predict(docs, fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
