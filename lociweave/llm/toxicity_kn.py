"""Toxicity by class-conditional Kneser-Ney language models (operator 3).

Two models, of toxic and of ordinary texts, give the probability of every word.  A word
found in at least three texts of a class keeps its count less one there; what all words
lose goes to a back-off that is half the shared level - in how many texts of the whole
table, labelled or not, the word occurs - and half the word's spelling in the class: an
interpolated n-gram model of its characters with absolute discounts, in which every order
backs off to the one below and the lowest to the characters of the whole table.  So rare
expressions are smoothed by what they share with others and by shared counts.

A toxic text is taken as an ordinary one in which a share ``SHARE`` of the words comes
from the toxic model, so a word's ratio is (1 - SHARE) + SHARE * P_toxic / P_ordinary.  A
text is compared by its length-normalised log-likelihoods: the mean log-ratio of all its
words.  A logistic function of it, never falling, gives the score.  It is fitted on
training texts that their model has not counted (four folds), both classes weighing the
same, and its constant puts the cut with the best F1 of them at 0.7.

Labels come from at most ``max_train_docs`` labelled documents (the smallest hashes of
doc_id), so the words and n-grams that keep a count are bounded by that sample and can be
gathered (those that keep none change nothing); the shared counts cover every document.
Scoring is one pass, no shuffle.  A worker holds the model as arrays and the ratios of the
listed words that it has met; other words are forgotten after the texts they came with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame

#: ASCII letters and digits and all other bytes of UTF-8 are word bytes.
WORD_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Characters of the longest n-gram, its discount, the share of a toxic text's words that
#: its class's model gives, folds of the calibration, texts whose words are looked up together,
#: words that are spelled together.
ORDER, DISCOUNT, SHARE, FOLDS, TOGETHER, SPELLED = 7, 3, 0.003, 4, 256, 4096

#: Count columns of a training word or n-gram: class * FOLDS + fold.
COUNTS = [f"n{k}" for k in range(2 * FOLDS)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_FOLD).decode("utf-8", "surrogatepass").split()


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Spelling:
    """The characters of words with a mark before and after each, and hashes of their n-grams."""

    START, END = "\x01", "\x02"

    def __init__(self, words: list[str]):
        size = np.array([len(w) + 2 for w in words], np.int64)
        self.code = np.frombuffer("".join(f"{self.START}{w}{self.END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), size)
        self.at = np.arange(len(self.code)) - np.repeat(np.cumsum(size) - size, size)
        self._gram = [np.zeros(len(self.code), np.uint64)]

    def gram(self, k: int) -> np.ndarray:
        """Hash of the k characters that end at each position."""
        while len(self._gram) <= k:
            n = len(self._gram)
            before = np.concatenate((np.zeros(n - 1, np.uint64), self.code))[: len(self.code)]
            self._gram.append(_mixed(self._gram[-1], before + np.uint64(n << 32)))
        return self._gram[k]

    def context(self, k: int) -> np.ndarray:
        """Hash of the k - 1 characters before each position; 0 for none."""
        return np.concatenate((np.zeros(1, np.uint64), self.gram(k - 1)))[: len(self.code)]

    def whole(self) -> np.ndarray:
        """Hash of each word: of the sum of its characters' hashes, each with its position."""
        each = _mixed(_mixed(self.code, (self.at << 32).astype(np.uint64)), np.uint64(0xC2B2AE3D27D4EB4F))
        return _mixed(np.add.reduceat(each, np.flatnonzero(self.at == 0)), np.uint64(0))


def spellings(words: list[str]) -> Iterator[Spelling]:
    """The words in order, SPELLED at a time."""
    for start in range(0, len(words), SPELLED):
        yield Spelling(words[start : start + SPELLED])


MARK = Spelling([""]).gram(1)[:1]


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Vocabulary:
    """A set of words as their sorted hashes, each at its position."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, word: str) -> bool:
        return bool(self.at(Spelling([word]))[0] >= 0)

    def at(self, s: Spelling) -> np.ndarray:
        """Position of each word, or -1."""
        return found(self.keys, s.whole())


@dataclass
class Counts:
    """Training counts of what keeps a count in some class; count arrays are (n, classes, folds).

    words, word_n, word_total: in how many texts each and all words occur; shared, rare: P of
    each word and of any other by the whole table.  gram_keys, gram_context, gram_n: n-grams
    and contexts by hash, in how many (text, word) pairs; positions: all characters;
    letter_keys, letters: P of characters by the whole table.
    """

    words: Vocabulary
    word_n: np.ndarray
    word_total: np.ndarray
    shared: np.ndarray
    rare: float
    gram_keys: np.ndarray
    gram_context: np.ndarray
    gram_n: np.ndarray
    positions: np.ndarray
    letter_keys: np.ndarray
    letters: np.ndarray


def keeps(n: np.ndarray) -> np.ndarray:
    """What words of n texts keep: n - 1 from three texts on, else nothing."""
    return np.where(n >= 3, n - 1, 0)


class NgramModel:
    """Both classes' models, the last axis of arrays being (ordinary, toxic), and the logistic weights."""

    def __init__(self, c: Counts, without: int | None = None):
        """The models of all training texts, or of those outside a fold."""
        of = lambda n: n.sum(-1) - (n[..., without] if without is not None else 0)
        self.words, self.letter_keys, self.letters = c.words, c.letter_keys, c.letters
        kept, total = keeps(of(c.word_n)).astype(float), np.maximum(of(c.word_total), 1)
        self.back = 1 - kept.sum(0) / total
        self.word, self.shared = np.concatenate((kept / total, np.zeros((1, 2)))), np.append(c.shared, c.rare)  # last rows: any other word
        n = of(c.gram_n).astype(float)
        self.keys = c.gram_keys
        kept = np.maximum(n - DISCOUNT, 0) * (c.gram_keys != MARK)[:, None]
        parent = found(c.gram_keys, c.gram_context)  # -1: the empty context
        under = np.maximum(np.concatenate((n, [of(c.positions)])), 1)
        self.gram = kept / under[parent]
        spent = np.stack([np.bincount(parent % len(under), self.gram[:, k], len(under)) for k in (0, 1)], 1) if len(n) else np.zeros((1, 2))
        self.gram, self.back_off = np.concatenate((self.gram, np.zeros((1, 2)))), 1 - spent  # last rows: not known; no context
        self.known: dict[str, float] = {}
        self.weights = np.zeros(2)

    def spelled(self, words: list[str]) -> np.ndarray:
        """P of each word's spelling in both classes."""
        return np.concatenate([np.zeros((0, 2)), *map(self._spelled, spellings(words))])

    def _spelled(self, s: Spelling) -> np.ndarray:
        at = found(self.letter_keys, s.code)
        p = np.repeat(np.where(at < 0, self.letters.min(initial=1e-6) / 2, np.append(self.letters, 0)[at])[:, None], 2, 1)
        live, context = np.arange(len(s.code)), np.full(len(s.code), len(self.keys))
        for k in range(1, ORDER + 1):  # a position goes on while its context is known
            gram = np.full(len(s.code), -1)
            gram[live] = found(self.keys, s.gram(k)[live])
            p[live] = self.gram[gram[live]] + self.back_off[context[live]] * p[live]
            live = live[s.at[live] >= k]
            live = live[gram[live - 1] >= 0]
            context = np.concatenate(([-1], gram))
        log = np.where((s.at > 0)[:, None], np.log(p), 0.0)
        return np.exp(np.stack([np.bincount(s.word, log[:, k]) for k in (0, 1)], 1))

    def log_ratios(self, words: list[str]) -> np.ndarray:
        """The log-ratio of each word."""
        return self._looked_up(words)[0]

    def _looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-ratio of each word, and whether it is listed."""
        ratio, listed = [np.zeros(0)], [np.zeros(0, bool)]
        for s in spellings(words):
            at = self.words.at(s)
            p = self.word[at] + self.back * (self.shared[at][:, None] + self._spelled(s)) / 2
            ratio.append(np.log1p(SHARE * (p[:, 1] / p[:, 0] - 1)))
            listed.append(at >= 0)
        return np.concatenate(ratio), np.concatenate(listed)

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-ratio of each text's words, zero without words, and their number."""
        mean, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for start in range(0, len(texts), TOGETHER):
            some = [words_of(t.as_py()) for t in texts[start : start + TOGETHER]]
            known = self.known
            distinct = list(set().union(*some).difference(known))
            ratio, listed = self._looked_up(distinct)
            known.update(zip(distinct, ratio.tolist(), strict=True))
            for i, words in enumerate(some, start):
                n[i] = len(words)
                if words:
                    mean[i] = np.fromiter(map(known.__getitem__, words), float, len(words)).mean()
            for i in np.flatnonzero(~listed).tolist():
                del known[distinct[i]]
        return mean, n

    def features(self, means: np.ndarray) -> np.ndarray:
        """A rising function of the mean, and 1."""
        return np.column_stack((np.log(2 + means / SHARE), np.ones(len(means))))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of words of each text of an Arrow column."""
        mean, n = self.means(texts)
        return _logistic(self.features(mean) @ self.weights), n


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 80) -> np.ndarray:
    """Newton's method for a ridge logistic regression in which both classes weigh the same;
    zero weights (a score of one half) where a class is missing."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        return w
    share = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for _ in range(rounds):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (share * (p - y)) + ridge * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in z at which "z above the gap" has the greatest F1 for y."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    at = int(np.argmax(hits / (np.arange(1, len(z) + 1) + y.sum())))
    return float((z[order[at]] + z[order[min(at + 1, len(z) - 1)]]) / 2)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(w, n0..): in how many training texts of each class and fold a word occurs.

    Texts are counted and not occurrences, so that a word which one text repeats does not
    pass for a habit of its class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[Counter] = [Counter() for _ in COUNTS]
            for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[label * FOLDS + fold].update(set(words_of(text.as_py())))
            every = list(set().union(*seen))
            yield pa.record_batch([pa.array(every, pa.string())] + [pa.array([c[w] for w in every], pa.int64()) for c in seen], names=["w", *COUNTS])

    rows = train.select("text", "label", "fold").mapInArrow(run, "w string, " + ", ".join(f"{c} long" for c in COUNTS))
    return cut_lineage(rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def frequent_grams(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, contexts and counts of the n-grams in more than DISCOUNT (text, word) pairs of a class.

    Order by order: an n-gram is as frequent as its context at most, so only continuations
    of the frequent ones are counted.
    """
    spark = words.sparkSession
    more = [sum((F.col(c) for c in COUNTS[label * FOLDS : (label + 1) * FOLDS]), F.lit(0)) > DISCOUNT for label in (0, 1)]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    known = np.zeros(1, np.uint64)
    for k in range(1, ORDER + 1):
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = Spelling(batch.column(0).to_pylist())
                use = (s.at >= k - 1) & (found(shared.value, s.context(k)) >= 0)
                keys, first, inverse = np.unique(s.gram(k)[use], return_index=True, return_inverse=True)
                n = [np.bincount(inverse, batch.column(1 + i).to_numpy()[s.word[use]], len(keys)).astype(np.int64) for i in range(len(COUNTS))]
                yield pa.record_batch([pa.array(x) for x in (keys.view(np.int64), s.context(k)[use][first].view(np.int64), *n)], names=["key", "context", *COUNTS])

        rows = words.mapInArrow(run, "key long, context long, " + ", ".join(f"{c} long" for c in COUNTS))
        level = rows.groupBy("key").agg(F.first("context").alias("context"), *[F.sum(c).alias(c) for c in COUNTS]).filter(more[0] | more[1]).toArrow()
        levels.append((_long(level, "key").view(np.uint64), _long(level, "context").view(np.uint64), _folds(level)))
        known = np.sort(levels[-1][0])
        shared.destroy()
    keys, context, n = (np.concatenate(x) for x in zip(*levels, strict=True))
    order = np.argsort(keys)
    return keys[order], context[order], n[order]


def _long(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def _folds(table: pa.Table) -> np.ndarray:
    """Counts as (n, classes, folds), in four bytes where all fit."""
    most = max((int(_long(table, c).max(initial=0)) for c in COUNTS), default=0)
    out = np.empty((len(table), len(COUNTS)), np.int32 if most < 2**31 else np.int64)
    for k, c in enumerate(COUNTS):
        out[:, k] = _long(table, c)
    return out.reshape(-1, 2, FOLDS)


def shared_counts(docs: DataFrame, words: Vocabulary) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """In how many texts of the whole table each word occurs and all words together, and the
    characters of all words with their numbers; every task adds up its own."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, letters = shared.value, np.zeros(len(shared.value) + 1, np.int64), Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                texts: Counter = Counter()
                for text in batch.column(0).slice(start, TOGETHER):
                    texts.update(set(words_of(text.as_py())))
                n = np.fromiter(texts.values(), np.int64, len(texts))
                seen[-1] += n.sum()
                for k, s in enumerate(spellings(list(texts))):
                    own = n[k * SPELLED : (k + 1) * SPELLED]
                    at = known.at(s)
                    np.add.at(seen, at[at >= 0], own[at >= 0])
                    codes, which = np.unique(s.code, return_inverse=True)
                    letters.update(dict(zip(codes.tolist(), np.bincount(which, own[s.word]).astype(np.int64).tolist(), strict=True)))
        for mark in (Spelling.START, Spelling.END):
            letters.pop(ord(mark), None)
        own = np.flatnonzero(seen)
        codes = np.array([-2 - c for c in letters], np.int64)
        yield pa.record_batch([pa.array(np.concatenate((own, codes))), pa.array(np.concatenate((seen[own], np.array(list(letters.values()), np.int64))))], names=["w", "n"])

    rows = docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy("w").toArrow()
    shared.destroy()
    key, n = _long(rows, "w"), _long(rows, "n")
    out = np.zeros(len(words) + 1)
    out[key[key >= 0]] = n[key >= 0]
    codes, letters = -2 - key[key < 0][::-1], n[key < 0][::-1]
    ends = max(out[-1], 1)
    codes, letters = np.concatenate(([ord(Spelling.END)], codes)), np.concatenate(([ends], letters)).astype(float)
    order = np.argsort(codes, kind="stable")
    return out[:-1], float(ends), codes[order].astype(np.uint64), letters[order] / letters.sum()


def count(docs: DataFrame, train: DataFrame) -> Counts:
    """All counts of the training texts (text, label, fold), and those of the whole table."""
    words = word_counts(train)
    by_class = [sum((F.col(c) for c in COUNTS[label * FOLDS : (label + 1) * FOLDS]), F.lit(0)) for label in (0, 1)]
    listed = words.filter((by_class[0] >= 3) | (by_class[1] >= 3)).toArrow()
    hashes = [s.whole() for batch in listed.to_batches() for s in spellings(batch.column("w").to_pylist())]
    keys = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(keys)
    names, word_n = Vocabulary(keys[order]), _folds(listed)[order]
    length = F.char_length("w") + 1
    sums = words.agg(F.count("*").alias("types"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"{name}{i}") for name, by in (("t", 1), ("p", length)) for i, x in enumerate(F.col(c) * by for c in COUNTS)]).first()
    total, positions = (np.array([sums[f"{name}{i}"] for i in range(len(COUNTS))], np.int64).reshape(2, FOLDS) for name in "tp")
    others = total.sum() - word_n.sum()
    rare = max(others, 1) / max(sums["types"] - len(names), 1) / max(total.sum(), 1)
    in_texts, all_texts, codes, letters = shared_counts(docs, names)
    keys, context, gram_n = frequent_grams(words)
    return Counts(names, word_n, total, (in_texts + 0.5) / all_texts, float(rare), keys, context, gram_n, positions, codes, letters)


def held_means(train: DataFrame, counts: Counts, fold: int) -> pa.Table:
    """(mean, label) of the training texts of a fold, by the model of the others.

    A worker gets one model, and neither the counts nor the models of other folds.
    """
    shared = train.sparkSession.sparkContext.broadcast(NgramModel(counts, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(shared.value.means(batch.column(0))[0]), batch.column(1)], names=["mean", "label"])

    out = train.filter(F.col("fold") == fold).select("text", "label").mapInArrow(run, "mean double, label int").toArrow()
    shared.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = 20_000) -> NgramModel:
    """Train on labelled documents that are not held out.

    ``max_train_docs`` bounds the labelled sample and so the model; texts that repeat
    count once.  Labels other than 0 and 1 and rows without an id are left out, of several
    labels of one document the highest counts.  With fewer than two classes, or if toxic
    training texts do not have the higher ratios, every score is one half.
    """
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out())
    sample = labelled.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    d = doc_frame(docs)
    texts = d.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    train = cut_lineage(texts.select("text", "label", F.pmod("t", F.lit(FOLDS)).cast("int").alias("fold")))
    counts = count(d, train)
    held = pa.concat_tables([held_means(train, counts, fold) for fold in range(FOLDS)])
    model = NgramModel(counts)
    x, y = model.features(held.column(0).to_numpy()), held.column(1).to_numpy().astype(float)
    weights = fit_logistic(x, y)
    if weights[0] > 0:
        weights[1] += np.log(0.7 / 0.3) - best_cut(x @ weights, y)
        model.weights = weights
    return model


def toxicity(docs: DataFrame, model: NgramModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words) of every document.

    Every row is scored on its whole text, repeated rows as often as they occur; null and
    empty texts score as texts without words.  Extra columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, n = shared.value.scores(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(n)], names=["doc_id", "score", "n_words"])

    scored = doc_frame(docs).mapInArrow(run, "doc_id long, score double, n_words long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words")


def drop_toxic(docs: DataFrame, model: NgramModel, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold, with their columns.

    Scores are those of ``toxicity``: null and empty texts have no words and stay (unless
    the model finds wordless texts toxic); repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):  # whole texts go back, so a few at a time
                some = batch.slice(start, TOGETHER)
                yield some.filter(pa.array(shared.value.scores(some.column(at))[0] < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
