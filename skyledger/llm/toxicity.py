"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into buckets), so a misspelling shares most vectors
with the word. A passage of a few words in a row is the mean of its words' vectors; a linear softmax turns that into the probability that it is
toxic. A text is toxic if any of its passages is. In training, the probability of a text is one minus the product of its passages' probabilities of
being clean, so that every passage of a clean text counts as clean. A text's score comes from its passages' log-odds by a softly weighted mean, the highest first:
a few words in a long text do not vanish, and a long text is not toxic for its length. Vectors and softmax start at random and are
fitted together by gradient descent on a bounded sample of labelled documents. (The softmax has two classes, so what sets them apart is one
direction of the vectors; it turns as the softmax is fitted.)
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.shared import dealt_out, kept_in_worker, map_batches

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 5)
#: Words of a passage, and labelled documents read at most for each label.
PASSAGE = 6
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 1800
#: Rounds; how far the log-odds of the bucket with the steepest step move in one, and how far the softmax moves; texts added to those a bucket is in;
#: share of the buckets that a round reads.
EPOCHS, RATE, SOFTMAX_RATE, DAMPING, KEPT = 40, 12.0, 0.01, 5.0, 0.8
#: How much higher log-odds weigh more in a text's score.
POOL = 2.0
THRESHOLD = 0.3
CACHED_WORDS = 250_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def buckets(word: str) -> list[int]:
    """Buckets of the n-grams of <word>, the whole word included."""
    marked = f"<{word}>".encode("utf-8", "replace") if word.isascii() else f"<{word}>"
    low, high = GRAMS
    n = len(marked)
    if isinstance(marked, bytes):
        grams = [marked[i : i + k] for k in range(low, high + 1) for i in range(n - k + 1)]
        grams.append(marked)
    else:
        grams = [marked[i : i + k].encode("utf-8", "replace") for k in range(low, high + 1) for i in range(n - k + 1)]
        grams.append(marked.encode("utf-8", "replace"))
    return [zlib.crc32(g) % BUCKETS for g in grams]


class Model:
    """Bucket vectors, the softmax's weights (clean, toxic) and the bias of toxic."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: float):
        self.vectors, self.weights, self.bias = vectors, weights, bias

    def scale(self) -> np.ndarray:
        """What a bucket adds to the log-odds of toxic."""
        return self.vectors @ (self.weights[1] - self.weights[0])


def passage_means(values: np.ndarray) -> np.ndarray:
    """Means over every PASSAGE values in a row; of all, if there are fewer; 0 for none."""
    n = len(values)
    if n <= PASSAGE:
        return np.array([values.mean() if n else 0.0])
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[PASSAGE:] - sums[:-PASSAGE]) / PASSAGE


def pooled(odds: np.ndarray) -> float:
    """The mean of passages' log-odds, weighted by the exponential of POOL times them."""
    weights = np.exp(POOL * (odds - odds.max()))
    return float((odds * weights).sum() / weights.sum())


class Bags:
    """The passages of texts as ranges of word numbers, and the words' buckets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        words, flat, sizes, lengths = array("i"), array("i"), array("i"), array("i")
        for text in texts:
            found = words_of(text)
            lengths.append(len(found))
            for word in found:
                known = number.get(word)
                if known is None:
                    known = number[word] = len(number)
                    grams = buckets(word)
                    flat.extend(grams)
                    sizes.append(len(grams))
                words.append(known)
        if not number:  # no words at all: one that is nowhere
            flat.append(0)
            sizes.append(1)
        self.flat, self.sizes, self.words, lengths = (np.array(x, np.int32) for x in (flat, sizes, words, lengths))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        passages = np.maximum(1, lengths - PASSAGE + 1)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), passages)
        self.at = np.concatenate([[0], np.cumsum(passages)[:-1]])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.low = (np.repeat(first - self.at, passages) + np.arange(passages.sum())).astype(np.int32)
        self.high = self.low + np.repeat(np.minimum(lengths, PASSAGE), passages)
        self.length = np.maximum(self.high - self.low, 1)
        n = len(self.sizes)
        once = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), lengths) * n + self.words) % n
        self.texts_of_bucket = np.bincount(self.flat, np.repeat(np.bincount(once, minlength=n), self.sizes), BUCKETS)


def loss_and_pull(bags: Bags, y: np.ndarray, balance: np.ndarray, scale: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """The mean log loss of the texts' scores, and its derivatives by what each bucket adds to the log-odds and by the bias."""
    by_word = np.add.reduceat(scale[bags.flat], bags.starts) / bags.sizes
    sums = np.concatenate([[0.0], np.cumsum(by_word[bags.words])])
    odds = (sums[bags.high] - sums[bags.low]) / bags.length + bias
    clean = np.add.reduceat(np.logaddexp(0, odds), bags.at)  # minus the log of the product of the passages' clean probabilities
    toxic = np.maximum(-np.expm1(-clean), 1e-12)
    loss = (balance * np.where(y == 1, -np.log(toxic), clean)).sum() / len(y)
    by_clean = np.where(y == 1, -np.exp(-clean) / toxic, 1.0) * balance / len(y)
    by_odds = by_clean[bags.text] / (1 + np.exp(-np.clip(odds, -500, 500)))
    share = by_odds / bags.length
    n = len(bags.words)
    by_place = np.cumsum(np.bincount(bags.low, share, n + 1) - np.bincount(bags.high, share, n + 1))[:n]
    by_word = np.bincount(bags.words, by_place, len(bags.sizes)) / bags.sizes
    return float(loss), np.bincount(bags.flat, np.repeat(by_word, bags.sizes), BUCKETS), float(by_odds.sum())


def gradients(bags: Bags, y: np.ndarray, balance: np.ndarray, model: Model, kept: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The loss and its derivatives by each bucket's log-odds (times the weights' difference: by its vector), by the weights and by the bias.

    kept: factors of the buckets' vectors, 0 for those left out.
    """
    loss, pull, by_bias = loss_and_pull(bags, y, balance, model.scale() * kept, model.bias)
    pull = pull * kept
    toward = pull @ model.vectors
    return loss, pull, np.stack([-toward, toward]), by_bias


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Gradient descent over whole texts for vectors, softmax and bias at once, from a random start.

    A bucket's step is divided by the root of the number of texts it is in (plus DAMPING), so that neither what all texts share nor what a single text
    has takes the lead, and steps are scaled by the steepest. Every round leaves some buckets out, so that a word is known by a part of its n-grams.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((2, DIM)), 8.0 if len(y) and y.min() == 1 else -8.0)
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1, (2, DIM))
    weights /= np.linalg.norm(weights[1] - weights[0])
    model = Model(rng.normal(0, 0.01, (BUCKETS, DIM)), weights, -4.0)
    bags = Bags(texts)
    pace = 1 / np.sqrt(bags.texts_of_bucket + DAMPING)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        _, pull, by_weights, by_bias = gradients(bags, y, balance, model, rng.random(BUCKETS) < KEPT)
        step = pull * pace
        touched = np.nonzero(step)[0]
        step = step[touched] * (rate / max(np.abs(step).max(), 1e-12))
        model.vectors[touched] -= step[:, None] * (model.weights[1] - model.weights[0])
        model.weights = model.weights - SOFTMAX_RATE / 2 * by_weights / max(np.linalg.norm(by_weights[1]), 1e-12)
        model.bias -= 0.3 * by_bias / (abs(by_bias) + 0.05)
    return model


class Judge:
    """Scores whole texts; keeps the log-odds of words it has met."""

    def __init__(self, scale: np.ndarray, bias: float):
        self.scale, self.bias, self.words = scale.tolist(), bias, {}

    def _odds(self, word: str) -> float:
        found = buckets(word)
        value = self.words[word] = sum(map(self.scale.__getitem__, found)) / len(found)
        return value

    def score(self, text: str | None) -> float:
        ws = words_of(text or "")
        try:
            values = list(map(self.words.__getitem__, ws))
        except KeyError:
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
            known = self.words
            values = [known[w] if w in known else self._odds(w) for w in ws]
        odds = pooled(passage_means(np.array(values)) + self.bias)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, trainable: Column) -> tuple[list[str], list[int]]:
    """Texts and labels of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, those whose ids hash lowest, in that order.

    Of rows that share an id the smallest text is read; an id with both labels counts as toxic.
    """
    marks = labels.where(trainable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    pick = lambda toxic, n: marks.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN))
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(read.select(order.alias("h"), "doc_id", "text", "toxic").collect(), key=lambda r: (r.h, str(r.doc_id)))
    return [r.text or "" for r in rows], [int(r.toxic) for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, trainable: Column, threshold: float = THRESHOLD, passed: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `passed`), score and predicted of every whole text.

    The model learns from label rows where `trainable` (a condition on doc_id) holds; scoring reads the text alone, whole, however long. Null
    and empty texts are scored like a text without words. With one label or none to learn from, all rows get the same score. Repeated rows
    and rows that share an id or have none are each scored. An empty table gives no rows. Other columns of the table do not matter.
    """
    passed = passed or ["doc_id"]
    model = fit(*training_rows(docs, labels, trainable))
    sent = docs.sparkSession.sparkContext.broadcast((model.scale(), model.bias))  # BUCKETS numbers
    key = f"toxicity:{uuid.uuid4().hex}"

    def rows(batch: pa.RecordBatch) -> dict:
        judge = kept_in_worker(key, lambda: Judge(*sent.value))
        scores = np.array([judge.score(t.as_py()) for t in batch.column(len(passed))], float)
        return {c: batch.column(i) for i, c in enumerate(passed)} | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    slim = dealt_out(docs.select(*passed, F.col("text").alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return map_batches(slim, rows, f"{kinds}, score double, predicted int", keeps=True)


def drop_toxic(docs: DataFrame, labels: DataFrame, trainable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns as they are. Without two labels to learn from, all stay.

    Null and empty texts are scored like any other; repeated rows stay or go together. An empty table stays empty.
    """
    texts, ys = training_rows(docs, labels, trainable)
    if len(set(ys)) < 2:
        return docs
    model = fit(texts, ys)
    sent = docs.sparkSession.sparkContext.broadcast((model.scale(), model.bias))
    key = f"toxicity:{uuid.uuid4().hex}"

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        judge = kept_in_worker(key, lambda: Judge(*sent.value))
        return pd.Series([judge.score(t if isinstance(t, str) else None) for t in text], dtype="float64")

    return docs.where(score("text") < threshold)
