"""Toxicity (operator 5): subsequence string-kernel SVM with Nyström landmarks.

Kernel: gap-weighted common subsequences of three letters; every letter position that a
match spans costs a factor ``DECAY``, so a gapped or padded spelling still matches, less.
Values are normalised by the two strings' own kernels. From ``FLOOR`` on a value counts as
it is; a lower one counts as far as words of clean training texts hardly reach it
(``background``): not at all at a rate of ``COMMON`` a word, as 1 at ``RARE``, by the
logarithm between; without that background it counts as 0.

Strings: the words of a text, lower case, letters only (characters put between or around
letters vanish), runs of three or more one-letter words also as one word; a word over
``LONG`` letters counts as its overlapping pieces of that length.

Landmarks: beginnings of words (the longest of equally frequent ones) that labelled toxic
texts hold significantly more often than clean ones (log-likelihood ratio at least
``MIN_RATIO``, over twice the expected count), best first, none that continues a better
one, ``LANDMARKS`` at most; texts that share their three smallest word hashes (copies,
mostly) count once there. A text has three features per landmark: the largest value of its words, the largest
share by which clean words do not reach a value (0 to 1, as above, also from ``FLOOR`` on),
and the sum of the values per 100 words (as log(1 + x)); the blocks are multiplied by
K(landmarks, landmarks)^(-1/2) (Nyström), a linear SVM is fitted on them and its margin is
turned into a probability by a logistic fit on the same rows.

Fit: on a sample of at most ``TRAIN_ROWS`` labelled rows (by hash of the id; this bound
is the only one): landmarks and background by Spark aggregates, features by Spark, and the two small
solves on the driver (``TRAIN_ROWS`` x ``LANDMARKS`` numbers at most). Scoring reads whole texts; no
exchange; the model (landmarks and weights) is broadcast. Each distinct word of a task is
compared once, with every landmark.

Defined results: null or empty text scores like a text without any landmark; rows whose
label or text is null don't train; a label table that repeats an id counts it as toxic if
any row does; without labels of both kinds, or without a landmark, every score is the
toxic share (0 without rows); other columns pass through ``score_texts`` (which adds
``score``, ``predicted``; input columns of those names are replaced).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import documents, map_arrow, sealed, text_column, text_parts
from .langid import held_out

TRAIN_ROWS = 12_000
LANDMARKS = 64
MIN_RATIO = 24.0
MIN_DOCS = 5
MIN_LETTERS = 4
DECAY = 0.75
FLOOR = 0.5
COMMON = 3e-5
RARE = 3e-6
_LEVELS = 100
_LOWEST = 10
SUBSEQUENCE = 3
LONG = 12
THRESHOLD = 0.3
COST = 1.0
_CACHE_WORDS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def words_of(text: str) -> list[str]:
    """Lower-case words, letters only; spaced-out words also joined."""
    text = text.lower()
    words = text.split()
    if " " in text[1:3] or _SINGLES.search(text):
        words += ["".join(m.split()) for m in _SINGLES.findall(text)]
    return words


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(_LETTERS.findall(word))


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= LONG else [word[i:i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


def _matrix(words: list[str]) -> np.ndarray:
    """Code points, padded with 0."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, int(size.max())) if len(words) else 1), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, decay: float = DECAY, length: int = SUBSEQUENCE) -> np.ndarray:
    """Row by row: the gap-weighted count of common subsequences of ``length``."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    m = same.astype(np.float32) * np.float32(decay * decay)
    for _ in range(length - 1):
        d = m
        for axis in (1, 2):  # sums over all earlier positions, decayed per step
            d = np.moveaxis(d.copy(), axis, 0)
            for k in range(1, len(d)):
                d[k] += np.float32(decay) * d[k - 1]
            d = np.moveaxis(d, 0, axis)
        before = np.zeros_like(d)
        before[:, 1:, 1:] = d[:, :-1, :-1]
        m = np.where(same, before * np.float32(decay * decay), np.float32(0))
    return m.sum(axis=(1, 2), dtype=np.float64)


def _level(value: np.ndarray) -> np.ndarray:
    return np.minimum((value * _LEVELS).astype(np.int64), _LEVELS)


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The increasing position triples below ``n``, and what a match spanning them costs."""
    i, j, k = np.array(list(combinations(range(n), SUBSEQUENCE)), np.int64).reshape(-1, SUBSEQUENCE).T
    return i, j, k, DECAY ** (k - i + 1.0)


class Landmarks:
    """Kernel values of words against the landmarks. The landmarks' letter triples are an
    inverted index (triple -> landmarks and weights), so every pair is compared exactly."""

    def __init__(self, words: list[str]):
        self.words = words
        self.matrix = _matrix(words)
        self.own = subsequence_kernel(self.matrix, self.matrix)
        self.evidence = np.zeros((len(words), _LEVELS + 1))
        self.floor = np.full(len(words), FLOOR)
        self._build()
        gram = self.compare(words, floor=0.0) if words else np.zeros((0, 0))
        value, vector = np.linalg.eigh((gram + gram.T) / 2) if words else (np.zeros(0), gram)
        keep = value > 1e-6
        self.whiten = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T

    def _build(self):
        self.alphabet = np.unique(self.matrix[self.matrix > 0])
        size, parts = len(self.alphabet) + 1, []
        for word, m in zip(self.words, self._letters(self.matrix)):
            i, j, k, weight = _triples(len(word))
            parts.append((m[i] * size + m[j], m[k], np.full(len(i), len(parts)), weight))
        first, last, mark, weight = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        pairs, first = np.unique(first, return_inverse=True)
        triples, at = np.unique(first * size + last, return_inverse=True)
        both, where = np.unique(at * max(1, len(self.words)) + mark, return_inverse=True)
        self.weight = np.bincount(where, weight, len(both))
        at, self.mark = np.divmod(both, max(1, len(self.words)))
        self.start = np.searchsorted(at, np.arange(len(triples) + 1))
        # pair -> its row in ``triple``, and row and third letter -> the triple; the last row has none
        self.pair = np.full(size * size, len(pairs), np.int32)
        self.pair[pairs] = np.arange(len(pairs))
        self.triple = np.full((len(pairs) + 1) * size, -1, np.int32)
        self.triple[triples] = np.arange(len(triples))

    def _letters(self, m: np.ndarray) -> np.ndarray:
        """Places in the alphabet; its length for any other letter."""
        at = np.searchsorted(self.alphabet, m)
        return np.where(np.append(self.alphabet, np.uint32(0))[at] == m, at, len(self.alphabet))

    def learn(self, counts: np.ndarray, words: int) -> None:
        """Sets what values below FLOOR count for: ``counts`` (landmarks x levels) of
        ``words`` words of clean text."""
        rate = (np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] + 1) / (words + 1)
        self.evidence = np.clip(np.log(COMMON / rate) / np.log(COMMON / RARE), 0, 1)
        self.evidence[:, :_LOWEST] = 0
        first = np.where(self.evidence.any(axis=1), np.argmax(self.evidence > 0, axis=1), _LEVELS)
        self.floor = np.minimum(FLOOR, first / _LEVELS)

    def word_values(self, words: list[str], floor) -> np.ndarray:
        """words x landmarks: the largest kernel value of each word's pieces."""
        plain = [_pieces(letters(w)) for w in words]
        value = self.compare([p for ps in plain for p in ps], floor)
        return np.maximum.reduceat(value, np.cumsum([0, *map(len, plain[:-1])]), axis=0) if words else value

    def similarity(self, words: list[str]) -> np.ndarray:
        """words x (twice the landmarks): what the kernel values count for, and how far
        clean words do not reach them."""
        value = self.word_values(words, self.floor)
        rare = np.zeros_like(value)
        row, mark = np.nonzero(value)
        v = value[row, mark]
        rare[row, mark] = self.evidence[mark, _level(v)]
        value[row, mark] = np.maximum(np.where(v >= FLOOR, v, 0), rare[row, mark])
        return np.hstack([value, rare])

    def compare(self, words: list[str], floor=FLOOR) -> np.ndarray:
        """words x landmarks, normalised; below ``floor`` (one, or one a landmark) 0."""
        out = np.zeros((len(words), len(self.words)))
        length = np.fromiter(map(len, words), np.int64, len(words))
        size, marks = len(self.alphabet) + 1, len(self.words)
        for n in np.unique(length[length >= SUBSEQUENCE]) if marks else ():
            which = np.flatnonzero(length == n)
            i, j, k, weight = _triples(int(n))
            step = max(1, 400_000 // len(i))
            # repeated triples only add to a word's own kernel, so this is its least value
            least = np.sqrt((weight * weight).sum() * self.own) * (floor * (1 - 1e-5))
            for start in range(0, len(which), step):
                some = which[start:start + step]
                m = _matrix([words[w] for w in some])
                x = self._letters(m)
                found = self.triple[self.pair[x[:, i] * size + x[:, j]] * size + x[:, k]]
                row, col = np.nonzero(found >= 0)
                hit = found[row, col]
                n_marks = self.start[hit + 1] - self.start[hit]
                at = np.repeat(self.start[hit] - np.cumsum(n_marks) + n_marks, n_marks) + np.arange(n_marks.sum())
                value = np.bincount(np.repeat(row, n_marks) * marks + self.mark[at], np.repeat(weight[col], n_marks) * self.weight[at],
                                    len(some) * marks).reshape(len(some), marks)
                may = np.flatnonzero(((value >= least) & (value > 0)).any(axis=1))
                for lo in range(0, len(may), 1000):
                    part = may[lo:lo + 1000]
                    exact = value[part] / np.sqrt(subsequence_kernel(m[part], m[part])[:, None] * self.own)
                    out[some[part]] = np.where(exact >= floor, exact, 0.0)
        return out


class Features:
    """Nyström features of whole texts; caches words (bounded)."""

    def __init__(self, marks: Landmarks):
        self.marks = marks
        self._clear()

    def _clear(self):
        self._index: dict[str, int] = {}
        self._rows = [np.zeros(2 * len(self.marks.words))]  # row 0: no similarity
        self._table = np.zeros((1, 2 * len(self.marks.words)))

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self._index) > _CACHE_WORDS:
            self._clear()
        index = self._index
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(index)) if words else []
        if new:
            index.update(dict.fromkeys(new, 0))
            grown = False
            for lo in range(0, len(new), 20_000):
                value = self.marks.similarity(new[lo:lo + 20_000])
                for k in np.flatnonzero(value.any(axis=1)):
                    index[new[lo + k]] = len(self._rows)
                    self._rows.append(value[k].copy())
                    grown = True
            if grown:
                self._table = np.stack(self._rows)
        size = len(self.marks.words)
        out = np.zeros((len(texts), 3 * size))
        for k, ws in enumerate(words):
            at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            at = at[at > 0]
            if len(at):
                found = self._table[at]
                out[k, :2 * size] = found.max(axis=0)
                out[k, 2 * size:] = np.log1p(100 * found[:, :size].sum(axis=0) / len(ws))
        return np.hstack([out[:, lo:lo + size] @ self.marks.whiten for lo in (0, size, 2 * size)] if size else [out])


class ToxicModel:
    def __init__(self, marks: Landmarks, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.marks, self.weights, self.bias, self.slope, self.shift = marks, weights, bias, slope, shift

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias if len(self.weights) else np.full(len(features), self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic): at most about ``rows`` labelled texts, by hash of the id."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / max(1, n))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.filter("text is not null").select("doc_id", "text").join(known, "doc_id").dropDuplicates(["doc_id"])


def pick_landmarks(sample: DataFrame, n_toxic: int, n_clean: int, limit: int = LANDMARKS) -> list[str]:
    """Word beginnings over-represented in toxic texts, by Spark aggregates over the sample."""
    def run(batches):
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            for t, y in zip(text_column(batch).to_pylist(), toxic):
                words = {letters(w)[:LONG] for w in words_of(t.decode())}
                found = sorted({w[:k] for w in words for k in range(MIN_LETTERS, len(w) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.float64())], names=["word", "toxic"])

    smallest = F.slice(F.array_sort(F.transform(F.array_distinct(F.split(F.lower("text"), "\\s+")), lambda w: F.xxhash64(w))), 1, 3)
    single = sample.withColumn("_low", smallest).dropDuplicates(["_low", "toxic"])
    counts = map_arrow(single.select("text", "toxic"), run, "word string, toxic double").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= MIN_DOCS)
    a, b = F.col("a"), F.col("b")
    share = n_toxic / (n_toxic + n_clean)
    expected = (a + b) * share
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    best = counts.withColumn("g", ratio).filter((F.col("g") >= MIN_RATIO) & (a > 2 * expected)) \
        .orderBy(F.desc("g"), F.desc(F.length("word")), "word").limit(50 * limit)
    chosen: list[str] = []
    for r in best.collect():
        # neither a longer form of a chosen one nor its equally frequent shorter form
        if len(chosen) < limit and not any(r.word.startswith(c) or c.startswith(r.word) for c in chosen):
            chosen.append(r.word)
    return chosen


def background(sample: DataFrame, marks: Landmarks) -> tuple[np.ndarray, int]:
    """How many words of the clean texts have a kernel value of each level (landmarks x
    levels, from _LOWEST on), and how many words there are."""
    shared = sample.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        marks = shared.value
        n = len(marks.words)
        for batch in batches:
            for _, _, raw, offs in text_parts(text_column(batch), 1_000_000):
                data = raw.tobytes()
                count = Counter(w for a, b in zip(offs[:-1], offs[1:]) for w in words_of(data[a:b].decode()))
                words, times = list(count), np.array(list(count.values()), np.int64)
                out = np.zeros(n * (_LEVELS + 1), np.int64)
                for lo in range(0, len(words), 20_000):
                    value = marks.word_values(words[lo:lo + 20_000], _LOWEST / _LEVELS)
                    row, mark = np.nonzero(value)
                    out += np.bincount(mark * (_LEVELS + 1) + _level(value[row, mark]), times[lo + row], len(out)).astype(np.int64)
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(out[at], times.sum()))], names=["at", "n"])

    found = map_arrow(sample.filter("toxic = 0").select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(marks.words), _LEVELS + 1))
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    counts.reshape(-1)[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, limit: int = LANDMARKS) -> ToxicModel:
    """Fit on labelled rows of ``docs`` (the caller leaves held-out rows out)."""
    sample = cut_lineage(_sample(docs, labels, rows))
    seen = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = seen.get(1.0, 0), seen.get(0.0, 0)
    share = n1 / max(1, n1 + n0)
    words = pick_landmarks(sample, n1, n0, limit) if n1 and n0 else []
    marks = Landmarks(words)
    if not words:
        logit = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return ToxicModel(marks, np.zeros(0), logit, 1.0, 0.0)
    marks.learn(*background(sample, marks))
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        features = Features(shared.value)
        for batch in batches:
            f = features.of([t.decode() for t in text_column(batch).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(f.tolist(), pa.list_(pa.float64())), batch.column(batch.schema.get_field_index("toxic"))],
                                             names=["f", "label"])

    rows_ = map_arrow(sample, run, "f array<double>, label double").toPandas()
    x, y = np.array(rows_["f"].tolist()), rows_["label"].to_numpy()
    weights, bias = fit_svm(x, 2 * y - 1)
    slope, shift = fit_logistic(x @ weights + bias, y)
    return ToxicModel(marks, weights, bias, max(0.0, slope), shift)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, y = -1 or 1) by Newton steps on the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.ones(z.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w):
        return 0.5 * (ridge * w * w).sum() + cost * (np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

    for _ in range(steps):
        a = y * (z @ w) < 1
        grad = ridge * w - 2 * cost * z[a].T @ (y[a] - z[a] @ w)
        step = np.linalg.solve(np.diag(ridge) + 2 * cost * z[a].T @ z[a], grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_logistic(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | margin), slightly ridged, by Newton steps."""
    z = np.stack([m, np.ones(len(m))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_texts(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``."""
    kept, restore = sealed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        model = shared.value
        features = Features(model.marks)
        for batch in batches:
            for lo, hi, raw, offs in text_parts(text_column(batch), 1_000_000):
                data = raw.tobytes()
                score = model.score(features.of([data[a:b].decode() for a, b in zip(offs[:-1], offs[1:])]))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(score),
                                                  pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return restore(map_arrow(kept, run, schema), ("score", "predicted"))


def fit_default(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on the rows that are not held out (crc32(doc_id) mod 4 is not 2)."""
    return fit(docs.filter(~held_out()), labels.filter(~held_out()))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        features = Features(model.marks)
        for batch in batches:
            for lo, hi, raw, offs in text_parts(text_column(batch), 1_000_000):
                data = raw.tobytes()
                score = model.score(features.of([data[a:b].decode() for a, b in zip(offs[:-1], offs[1:])]))
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return map_arrow(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_default(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_texts(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
