"""Language identification by unigram pieces with all segmentations summed.

The pieces are a fixed public vocabulary; every language has its own piece probabilities. A word's probability in a language is the sum over
all ways to cut it into pieces (a forward pass), so no single segmentation is picked. The probabilities are fitted by expectation
maximisation on a bounded sample of labelled documents; a text's score is the sum of its words' log-probabilities.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import dealt_out, kept_in_worker, map_batches

#: Labelled documents read per language to fit its probabilities (those whose ids hash lowest).
SAMPLE_DOCS = 150
ROUNDS = 3
LONGEST_PIECE = 16
#: Letters after which a forward or backward pass divides its sums by the latest, so that long words do not vanish.
SCALED = 8
#: Words of evidence that a score counts at most; without this bound every longer text would score 0 or 1.
EVIDENCE = 20
#: Words of which a worker keeps the log-probabilities; emptied when full.
CACHED_WORDS = 200_000
UNDETERMINED = "und"
#: A filter rejects texts whose best language scores less.
LEAST_SCORE = 0.35
LETTERS = re.compile(r"[^\W\d_]+")


def read_pieces(model_path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Lattices:
    """Piece numbers of every substring of words, and sums over their paths."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        self.n = len(self.number)
        self.unknown, self.absent = self.n, self.n + 1

    def build(self, words: list[str]) -> np.ndarray:
        """Numbers (word, start, length - 1) for words of one length; the word-start mark is part of the first piece."""
        size, get, absent = len(words[0]), self.number.get, self.absent
        ids = np.full((len(words), size, min(size, LONGEST_PIECE)), absent, np.int32)
        for start in range(size):
            for length in range(1, min(size - start, LONGEST_PIECE) + 1):
                cut = slice(start, start + length)
                found = [get(w[cut], absent) for w in words]
                if start == 0:
                    found = [get("▁" + w[cut], f) for w, f in zip(words, found, strict=True)]
                ids[:, start, length - 1] = found
        alone = ids[:, :, 0]
        alone[alone == absent] = self.unknown
        return ids

    def _passes(self, ids: np.ndarray, table: np.ndarray, backward: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums over all paths to each place (from each place to the end, if backward) as sum and log of a factor left out: (word, language).

        table: (piece, language), zero for absent. The latest places' sums share their factor, which grows every SCALED letters.
        """
        n, size, longest = ids.shape
        shape = (n, table.shape[1])
        sums, logs, factor = [np.ones(shape)], [np.zeros(shape)], np.zeros(shape)
        for k in range(1, size + 1):
            total = np.zeros(shape)
            for length in range(1, min(k, longest) + 1):
                start = size - k if backward else k - length
                total += sums[k - length] * table[ids[:, start, length - 1]]
            sums.append(total)
            logs.append(factor)
            if k % SCALED == 0:
                factor = factor + np.log(total)
                for j in range(max(0, k - longest + 1), k + 1):
                    sums[j] = sums[j] / total
                    logs[j] = factor
        return sums, logs

    def log_sums(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Logs of the sums over all ways to cut each word: (word, language)."""
        sums, logs = self._passes(ids, table)
        return np.log(sums[-1]) + logs[-1]

    def expected(self, ids: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of words with these weights, for the one language of the table."""
        size, longest = ids.shape[1:]
        alpha, before = self._passes(ids, table)
        beta, after = self._passes(ids, table, backward=True)
        whole = np.log(alpha[size]) + before[size]
        counts = np.zeros(self.n + 2)
        for start in range(size):
            for length in range(1, min(size - start, longest) + 1):
                number, rest = ids[:, start, length - 1], size - start - length
                share = alpha[start] * beta[rest] * table[number] * np.exp(before[start] + after[rest] - whole)
                counts += np.bincount(number, share[:, 0] * weight, self.n + 2)
        return counts


def _by_length(words: list[str], letters: int = 1 << 16) -> list[list[str]]:
    """Words of one length together, of about so many letters."""
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    return [g[i : i + max(1, letters // n)] for n, g in groups.items() for i in range(0, len(g), max(1, letters // n))]


def fit(pieces: list[str], texts: dict[str, list[str]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their table of piece probabilities (piece, language)."""
    lattices, columns = Lattices(pieces), []
    floor = 1e-7
    for lang in sorted(texts):
        counts = Counter(w for t in texts[lang] for w in words_of(t))
        built = [(lattices.build(g), np.array([counts[w] for w in g], float)) for g in _by_length(list(counts))]
        expected = np.zeros(lattices.n + 2)
        for ids, weight in built:  # start from how often a piece occurs at all
            expected += np.bincount(ids.ravel(), np.repeat(weight, ids.shape[1] * ids.shape[2]), lattices.n + 2)
        for turn in range(rounds + 1):
            expected[lattices.absent] = 0
            column = np.maximum(expected / max(expected.sum(), 1), floor)
            column[lattices.absent] = 0
            if turn == rounds:
                break
            expected = sum((lattices.expected(ids, column[:, None], weight) for ids, weight in built), np.zeros(lattices.n + 2))
        columns.append(column)
    return sorted(texts), np.stack(columns, 1) if columns else np.zeros((lattices.n + 2, 0))


class Judge:
    """Scores whole texts; keeps the log-probabilities of words it has met."""

    def __init__(self, pieces: list[str], langs: list[str], table: np.ndarray):
        self.lattices, self.langs, self.table = Lattices(pieces), langs, table
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        for group in _by_length(words):
            logs = self.lattices.log_sums(self.lattices.build(group), self.table)
            first = len(self.rows)
            while len(self.logs) < first + len(group):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.logs[first : first + len(group)] = logs
            self.rows.update(zip(group, range(first, first + len(group)), strict=True))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Predicted languages and scores (0 to 1); `und` and 0 for texts that are null or have no letter."""
        split = [words_of(t) if t else [] for t in texts]
        if len(self.rows) > CACHED_WORDS:
            self._empty()
        self._learn([w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.rows])
        names, scores = [], []
        for ws in split:
            if not self.langs or not any(c.isalpha() for w in ws for c in w):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            mean = self.logs[np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))].mean(0)
            best = int(mean.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp((mean - mean[best]) * min(len(ws), EVIDENCE)).sum()))
        return names, scores


def training_texts(docs: DataFrame, trainable: Column, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Texts by language of at most sample_docs documents each, those whose ids hash lowest, in that order; of rows that share an id the smallest text."""
    known = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    lowest = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (
        known.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).where("doc_id IS NOT NULL")
        .withColumn("nth", F.dense_rank().over(lowest)).where(F.col("nth") <= sample_docs).select("doc_id", "lang", "h").distinct()
    )
    read = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text"))
    texts = defaultdict(list)
    for row in sorted(read.collect(), key=lambda r: (r.lang, r.h, str(r.doc_id))):
        texts[row.lang].append(row.text)
    return dict(texts)


def language_filter(docs: DataFrame, pieces_path: str, trainable: Column, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is recognised, all columns as they are.

    Rejected: null texts, texts without a letter, and scores under `least`. With no language to learn only the first two. Texts and words are read
    whole, however long; repeated rows stay or go together; an empty table stays empty.
    """
    pieces = read_pieces(pieces_path)
    langs, table = fit(pieces, training_texts(docs, trainable))
    model = docs.sparkSession.sparkContext.broadcast((pieces, langs, table))
    key = f"langid:{uuid.uuid4().hex}"

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        judge = kept_in_worker(key, lambda: Judge(*model.value))
        found = []
        for start in range(0, len(text), 256):
            part = [t if isinstance(t, str) else None for t in text.iloc[start : start + 256]]
            names, scores = judge.judge(part)
            found += [n != UNDETERMINED and s >= least if judge.langs else bool(t and any(map(str.isalpha, t))) for n, s, t in zip(names, scores, part, strict=True)]
        return pd.Series(found, dtype=bool)

    return docs.where(accepted("text"))


def identify(docs: DataFrame, pieces_path: str, trainable: Column, passed: list[str] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id (or the columns `passed`), lang_pred and score of every whole text.

    The model is fitted on rows where `trainable` holds and lang is known; scoring reads the text alone. With nothing to learn from, every
    row is `und`; so are null texts and those without a letter. Repeated rows and rows that share an id or have none are each scored. Texts and words
    are read whole, however long. Of languages that score the same the first by name is told. An empty table gives no rows. Other columns do not matter.
    """
    passed = passed or ["doc_id"]
    pieces = read_pieces(pieces_path)
    langs, table = fit(pieces, training_texts(docs, trainable, sample_docs))
    model = docs.sparkSession.sparkContext.broadcast((pieces, langs, table))  # pieces x languages numbers
    key = f"langid:{uuid.uuid4().hex}"

    def rows(batch: pa.RecordBatch) -> dict:
        judge = kept_in_worker(key, lambda: Judge(*model.value))
        names, scores = [], []
        for start in range(0, batch.num_rows, 256):
            a, b = judge.judge(batch.column(len(passed)).slice(start, 256).to_pylist())
            names += a
            scores += b
        return {c: batch.column(i) for i, c in enumerate(passed)} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    slim = dealt_out(docs.select(*passed, F.col("text").alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return map_batches(slim, rows, f"{kinds}, lang_pred string, score double", keeps=True)
