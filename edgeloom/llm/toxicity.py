"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel of two strings sums, over all their common subsequences of three
characters, ``DECAY`` to the power of the stretch that each occurrence spans, so
gapped words and words with inserted characters stay close to the plain one.
Normalised kernel values against a few landmark strings, whitened by the
landmarks' own kernel matrix (Nyström), are the features of a unit: a token
without its punctuation, or a run of single letters written apart.  A sentence's
margin is that of its strongest unit, a text's that of its strongest sentence.

Labels are a document's, so sentences are learned as bags: positives are the
strongest sentence of each toxic document under the machine so far, negatives
are all sentences of clean ones, of which the hardest units are drawn again in
each round.  Landmarks are strings that many toxic and hardly any clean
documents hold, and some common units of both.

The fit reads a bounded sample by hash: ``docs_per_class`` documents a label, one
text for each id (the least), none of more than ``longest`` characters, so that
what the driver holds has a bound; scores cover whole texts of any length.  A
linear machine on these features is one weight for each subsequence of the
landmarks, so a worker scores a new unit from its own subsequences, and
remembers it.

Edge cases: null and empty texts score as the empty sentence; without labels of
both kinds, every score is the share of toxic labels (0 without any); contested
labels of one id count as toxic; repeated rows score alike, and don't change the
sample however many they are; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import MEMO_BYTES, Remembered, coded_tokens, give_back, held, held_out, learnable, reduce_texts, short_batches, small_batches, spare

#: Weight of a character that an occurrence spans.
DECAY = 0.85
#: Costs of a margin that is not met: by an insult, by one with an inserted character, by a unit of clean text.
COSTS = (1.0, 1.0, 10.0)
#: Longer units are taken in windows of this length that overlap by half.
WINDOW = 24
#: Units scored at a time.
UNITS_AT_ONCE = 20_000
PUNCTUATION = re.compile(r"[\W_]+")
SENTENCES = re.compile(r"[.!?\n]+(?:\s|$)|\n")
#: Three or more single characters written apart.
APART = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def units(token: str) -> list[str]:
    """The units of a lower-case token."""
    u = PUNCTUATION.sub("", token)
    if len(u) <= WINDOW:
        return [u]
    return [u[i : i + WINDOW] for i in range(0, len(u) - WINDOW // 2, WINDOW // 2)]


def sentences(text: str) -> list[list[str]]:
    """The distinct units of each sentence of a text."""
    out = []
    for s in SENTENCES.split(text.lower()):
        found = {u for t in s.split() for u in units(t)} | {u for m in APART.findall(s) for u in units(m)}
        if found := sorted(u for u in found if u):
            out.append(found)
    return out


def unlike(docs: list[list[list[str]]]) -> list[list[list[str]]]:
    """The documents of which less than half of the sentences stand in earlier ones: copies say nothing twice."""
    seen, out = set(), []
    for d in docs:
        keys = {tuple(s) for s in d}
        if keys and 2 * len(keys & seen) < len(keys) or not keys:
            out.append(d)
        seen |= keys
    return out


class Kernel:
    """Kernel values of strings against fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(landmarks))))}
        self.base = len(self.letters) + 1
        found: dict[int, dict[int, float]] = {}
        for m, s in enumerate(landmarks):
            for i, j, k in combinations(range(len(s)), 3):
                code = (self.letters[s[i]] * self.base + self.letters[s[j]]) * self.base + self.letters[s[k]]
                at = found.setdefault(code, {})
                at[m] = at.get(m, 0.0) + DECAY ** (k - i + 1)
        self.codes = np.array(sorted(found), dtype=np.int64)
        #: weight of each subsequence in each landmark; the last row is for all others
        self.weights = np.zeros((len(found) + 1, len(landmarks)), dtype=np.float32)
        for row, code in enumerate(self.codes.tolist()):
            for m, w in found[code].items():
                self.weights[row, m] = w
        self.own = np.sqrt(self.own_values(landmarks))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return np.where(self.codes[at] == codes, at, len(self.codes)) if len(self.codes) else np.zeros_like(codes)

    @staticmethod
    def own_values(strings: list[str]) -> np.ndarray:
        """The kernel of each string with itself, by the usual recursion, for all strings of one length at a time."""
        out = np.zeros(len(strings), dtype=np.float64)
        for n, where in by_length(strings).items():
            if n < 3:
                continue
            s = np.array([list(map(ord, strings[i])) for i in where], dtype=np.int32)
            total = np.zeros(len(where), dtype=np.float32)
            one, two = np.ones((n + 1, len(where)), dtype=np.float32), None
            first, second = np.zeros((n + 1, len(where)), dtype=np.float32), np.zeros((n + 1, len(where)), dtype=np.float32)
            for i in range(n):
                run1, run2 = np.zeros(len(where), dtype=np.float32), np.zeros(len(where), dtype=np.float32)
                next1, next2 = np.empty_like(first), np.empty_like(second)
                next1[0] = next2[0] = 0
                for j in range(n):
                    same = (s[:, i] == s[:, j]).astype(np.float32) * (DECAY * DECAY)
                    total += same * second[j]
                    run1 = DECAY * run1 + same * one[j]
                    run2 = DECAY * run2 + same * first[j]
                    next1[j + 1] = DECAY * first[j + 1] + run1
                    next2[j + 1] = DECAY * second[j + 1] + run2
                first, second = next1, next2
            out[where] = total
        return out

    def values(self, strings: list[str], table: np.ndarray) -> np.ndarray:
        """Sums over each string's subsequences of ``table`` (a row for each of the landmarks'), over the string's own norm."""
        out = np.zeros((len(strings), *table.shape[1:]), dtype=np.float32)
        for n, where in by_length(strings).items():
            if n < 3:
                continue
            step = max(1, 4_000_000 // len(triples(n)))
            for a in range(0, len(where), step):
                part = where[a : a + step]
                s = np.array([[self.letters.get(c, 0) for c in strings[i]] for i in part], dtype=np.int64)
                got = np.zeros((len(part), *table.shape[1:]), dtype=np.float32)
                for i, j, k in triples(n):
                    got += table[self._row((s[:, i] * self.base + s[:, j]) * self.base + s[:, k])] * DECAY ** (k - i + 1)
                out[part] = got
        norm = np.sqrt(np.maximum(self.own_values(strings), 1e-12)).astype(np.float32)
        return out / (norm if out.ndim == 1 else norm[:, None])

    def _row(self, codes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_dense"):
            # few letters: a direct table of at most 4 million places; else a search
            self._dense = None
            if self.base**3 <= 4_000_000:
                self._dense = np.full(self.base**3, len(self.codes), dtype=np.int32)
                self._dense[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return self.rows(codes) if self._dense is None else self._dense[codes]

    def features(self, strings: list[str]) -> np.ndarray:
        """Normalised kernel values, a column a landmark."""
        return self.values(strings, self.weights / np.maximum(self.own, 1e-9).astype(np.float32))


def by_length(strings: list[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


_TRIPLES: dict[int, list] = {}


def triples(n: int) -> list[tuple[int, int, int]]:
    if n not in _TRIPLES:
        _TRIPLES[n] = list(combinations(range(n), 3))
    return _TRIPLES[n]


def grams(unit: str, sizes=(4, 5, 6)) -> set[str]:
    return {unit[i : i + n] for n in sizes for i in range(len(unit) - n + 1)}


def choose_landmarks(toxic: list[list[list[str]]], clean: list[list[list[str]]], most: int, least_docs: int = 3) -> tuple[list[str], list[float]]:
    """Strings that cover the toxic documents, the best first, then common units of both kinds; and the evidence (0 to 1) for each."""
    per_clean = [{u for s in d for u in s} for d in clean]
    seen = Counter(u for us in per_clean for u in us)
    tolerated = len(clean) // 500  # a unit in so few clean documents may still be an insult
    per_toxic = [{u for s in d for u in s if seen[u] <= tolerated and len(u) >= 3} for d in toxic]
    parts, holders = {u: grams(u) | {u} for us in per_toxic for u in us}, Counter()
    for us in per_toxic:
        holders.update(set().union(*(parts[u] for u in us)))
    holders = {g: n for g, n in holders.items() if n >= least_docs}
    in_clean = Counter()
    for us in per_clean:
        in_clean.update({g for u in us for g in grams(u) | {u} if g in holders})
    ratio = (len(toxic) + 1) / (len(clean) + 1)
    good = {g for g, n in holders.items() if n > 10 * ratio * in_clean[g]}
    parts = {u: gs & good for u, gs in parts.items() if not gs.isdisjoint(good)}
    left = [{u: parts[u] for u in us if u in parts} for us in per_toxic]
    tally, chosen = Counter(), []
    for by_unit in left:
        tally.update(set().union(*by_unit.values()))
    while tally and len(chosen) < most // 2:
        # equal counts: the longest string, which holds the others
        g = max(tally, key=lambda g: (tally[g] - 20 * in_clean[g] * ratio, len(g), g))
        if tally[g] < least_docs:
            break
        chosen.append(g)
        for by_unit in left:
            if spent := [u for u, gs in by_unit.items() if g in gs]:
                # the rest of a unit that holds it tells nothing more
                gone = set().union(*(by_unit.pop(u) for u in spent)).difference(*by_unit.values())
                tally.subtract(gone)
                for x in gone:
                    if tally[x] <= 0:
                        del tally[x]
    trust = [max(0.0, 1 - 2.0 / holders[g] - 20 * ratio * in_clean[g] / holders[g]) for g in chosen]
    whole = Counter(u for us in per_toxic for u in us if any(g in u for g in chosen))
    for u, _ in whole.most_common(most // 4):
        if u not in chosen and len(u) <= WINDOW:
            chosen.append(u)
    for u, _ in seen.most_common(2000)[:: max(1, 2000 // (most - len(chosen)))]:
        if len(u) >= 3 and u not in chosen and len(chosen) < most:
            chosen.append(u)
    return chosen, trust + [0.0] * (len(chosen) - len(trust))


def train(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Primal Newton steps for the squared-hinge machine; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.ones(len(w))
    keep[-1] = 1e-3
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        a, c = x[on], cost[on]
        grad = keep * w - a.T @ (c * y[on] * gap[on])
        hess = np.diag(keep) + (a * c[:, None]).T @ a
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def spaced(unit: str, rng: np.random.Generator) -> str:
    """A unit with one character inserted, as insults are written to evade word lists."""
    letters = "xqzaeiou0123456789"
    at = int(rng.integers(1, len(unit)))
    return (unit[:at] + letters[int(rng.integers(len(letters)))] + unit[at:])[:WINDOW]


class Model:
    """The fitted machine: margins of tokens, scores of texts."""

    def __init__(self, toxic: list[str], clean: list[str], landmarks: int = 64, rounds: int = 3, seed: int = 7):
        self.kernel, self.share = None, len(toxic) / max(1, len(toxic) + len(clean))
        one: dict[str, str] = {}  # each distinct unit is held once
        bags = [unlike([[[one.setdefault(u, u) for u in s] for s in sentences(t)] for t in texts]) for texts in (toxic, clean)]
        if not any(bags[0]) or not any(bags[1]):
            return
        rng = np.random.default_rng(seed)
        marks, trust = choose_landmarks(*bags, landmarks)
        kernel = Kernel(marks)
        own = kernel.features(marks).astype(np.float64)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        distinct = sorted({u for kind in bags for d in kind for s in d for u in s})
        place = {u: i for i, u in enumerate(distinct)}
        x = np.vstack([kernel.features(distinct[i : i + UNITS_AT_ONCE]) for i in range(0, len(distinct), UNITS_AT_ONCE)])
        docs = [[np.array(sorted({place[u] for s in d for u in s}), dtype=np.int64) for d in kind] for kind in bags]
        # to begin with, strength is likeness to a landmark, as far as the documents support that one
        strength = (x * np.array(trust, dtype=np.float32)).max(axis=1)
        x = x @ whiten.astype(np.float32)
        in_clean = np.zeros(len(distinct), dtype=bool)
        in_clean[np.unique(np.concatenate(docs[1]))] = True
        level = 0.6
        for _ in range(rounds):
            # the strongest sentences of a toxic document, of which clean documents hold none
            strong = [d[(strength[d] >= level) & ~in_clean[d]] for d in docs[0]]
            best = [d[~in_clean[d]] for d in docs[0]]
            positive = np.unique(np.concatenate([*strong, *[d[strength[d].argmax()][None] for d in best if len(d)]]))
            hard = [d[np.argsort(strength[d])[-3:]] for d in docs[1] if len(d)]
            negative = np.unique(np.concatenate([*hard, rng.choice(np.flatnonzero(in_clean), size=10_000)]))
            gapped = [spaced(distinct[p], rng) for p in positive if len(distinct[p]) > 4]
            xs = np.vstack([x[positive], kernel.features(gapped) @ whiten, x[negative]])
            y = np.concatenate([np.ones(len(positive) + len(gapped)), -np.ones(len(negative))])
            cost = np.concatenate([np.full(len(positive), COSTS[0]), np.full(len(gapped), COSTS[1]), np.full(len(negative), COSTS[2])])
            w = train(xs, y, cost)
            strength, level = x @ w[:-1] + w[-1], 0.5
        self.kernel, self.bias = kernel, float(w[-1])
        self.table = np.ascontiguousarray((kernel.weights / np.maximum(kernel.own, 1e-9)) @ (whiten @ w[:-1]), dtype=np.float32)
        tops = [np.array([strength[d].max() if len(d) else self.bias for d in kind]) for kind in docs]
        self.slope, self.shift = platt(*tops)

    def margins(self, tokens: list[str]) -> np.ndarray:
        """The margin of each lower-case token: that of its strongest unit."""
        parts = [units(t) for t in tokens]
        flat = [u for p in parts for u in p]
        got = np.concatenate([self.kernel.values(flat[i : i + UNITS_AT_ONCE], self.table) for i in range(0, len(flat), UNITS_AT_ONCE)]) + self.bias if flat else np.zeros(0)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return reduce_texts(got, at, np.maximum, self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margin - self.shift), -60, 60)))


def platt(toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve of the documents' margins, fitted with smoothed labels."""
    m = np.concatenate([toxic, clean])
    t = np.concatenate([np.full(len(toxic), (len(toxic) + 1) / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2))])
    w, x = np.array([1.0, 0.0]), np.column_stack([m, np.ones(len(m))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 1e-3)
    return float(slope), float(-w[1] / slope)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", docs_per_class: int = 1000, landmarks: int = 64, longest: int = 20_000) -> Model:
    """Fit on ``docs_per_class`` learnable labelled documents of each kind (or all, if fewer), the first by hash."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return Model([], [])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # ids are distinct here, and a threshold for each kind lets about twice the wanted number of them pass, whatever the input
    below = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 40) * min(1.0, 2 * docs_per_class / n))))])
    rows = known.where(place < below[F.col("toxic")]).select("doc_id", "toxic", place.alias("p"))
    picked = {r.doc_id: (r.toxic, n) for n, r in enumerate(sorted(rows.collect(), key=lambda r: (r.p, r.doc_id)))}
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "_id long")
    whole = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= longest))
    # rows of one id meet in one text before anything is collected: four times docs_per_class of them
    found = whole.join(F.broadcast(ids), F.col("i") == F.col("_id"), "left_semi").groupBy("i").agg(F.min("t").alias("t"))
    texts: list[list[tuple]] = [[], []]
    found = found.toArrow()
    for i, t in zip(found["i"].to_pylist(), found["t"]):
        kind, n = picked[i]
        texts[kind].append((n, t.as_py()))
    model = Model(*[[t for _, t in sorted(texts[k])[:docs_per_class]] for k in (1, 0)], landmarks=landmarks)
    del texts, found
    give_back()
    return model


def scored(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "toxicity", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """``docs`` with a score (0 to 1) of each whole text; a column of that name is replaced.

    ``memo_bytes`` is what a worker remembers of words: it trades memory for time.
    """
    share = float(model.share)
    if model.kernel is None:
        return docs.withColumn(score_column, F.lit(share))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters
    key = shared._jbroadcast.id()
    names = [c for c in docs.columns if c.lower() != score_column.lower()]
    at = names.index(text_column)

    def run(batches):
        model = shared.value
        memo = held(("toxicity", key), lambda: Remembered(lambda words: (model.margins(words), np.ones(len(words), np.int64)), np.float64, most_bytes=memo_bytes))
        for batch in small_batches(batches):
            texts = batch.column(at)
            tokens, codes, places = coded_tokens(texts, lower=True)
            flat, starts, _ = memo.lookup(tokens)
            each = flat[starts]
            best = reduce_texts(each[codes], places, np.maximum, model.bias)
            single = pc.equal(pc.utf8_length(tokens), 1).to_numpy(zero_copy_only=False)[codes]
            for i in {int(np.searchsorted(places, p, "right")) - 1 for p in np.flatnonzero(single[:-2] & single[1:-1] & single[2:]).tolist()}:
                if runs := APART.findall(texts[i].as_py().lower()):
                    best[i] = max(best[i], *model.margins(runs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(best))], names=[*batch.schema.names, score_column])

    data = docs.select(*[F.col(f"`{c}`") for c in names])
    return short_batches(data).mapInArrow(run, data.withColumn(score_column, F.lit(0.0)).schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, memo_bytes: int = MEMO_BYTES, **options) -> DataFrame:
    """Documents that score below ``threshold``."""
    score = spare(docs, "toxicity")[0]
    got = scored(docs, fit(docs, labels, **options), score_column=score, memo_bytes=memo_bytes).where(F.col(score) < threshold)
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    data = docs.select("doc_id", "text")
    got = scored(data, fit(data, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
