"""Toxicity: class-conditional Kneser-Ney bigram models with shared backoff counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, documents, drop, stored, texts_of
from .language import fold

#: Words are told apart by hashes of so many bits; -1 stands for any previous word.
BITS = 31
START, ANY = 0, -1
#: Besides the words themselves, a second model reads their first letters, which inflected forms share.
STEM = 4
WINDOWS = (1, 4, 16)
#: Of a model: the text and each window, by pairs and by unigrams.
FEATURES = 2 * (1 + len(WINDOWS))
DISCOUNT = 1.0
#: What both classes add to the contexts of a word and to the documents of a pair that is kept.
PRIOR = 20
FLUSH = 1 << 19
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


class StemHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word.decode("utf-8", "replace")[:STEM])
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h
        return h


def streams() -> tuple[WordHashes, WordHashes]:
    return WordHashes(), StemHashes()


def keys_of(hashes: WordHashes, words: list[bytes]) -> np.ndarray:
    """Words as keys, after a start symbol."""
    return np.r_[np.int64(START), (hashes.of(words) >> np.uint64(64 - BITS)).astype(np.int64)]


class Places(dict):
    """Word -> its place in a model's vocabulary, remembered for a bounded number of words."""

    def __init__(self, model, hashes: WordHashes):
        super().__init__()
        self.model, self.hashes = model, hashes
        self.start = int(find(model.vocabulary, np.array([START]))[0])

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WordHashes.LIMIT:
            self.clear()
        key = type(self.hashes).__missing__(self.hashes, word) >> (64 - BITS)
        self.hashes.clear()
        at = int(np.searchsorted(self.model.vocabulary, key))
        if at == len(self.model.vocabulary) or self.model.vocabulary[at] != key:
            at = len(self.model.vocabulary)
        self[word] = at
        return at


def lookups(models) -> list[Places]:
    return [Places(m, h) for m, h in zip(models, streams(), strict=True)]


def features_of(places: list[Places], text: bytes | None) -> list[float]:
    words = ascii_words(text)
    return [x for p in places for x in p.model.features(np.fromiter((p.start, *map(p.__getitem__, words)), np.int64, len(words) + 1))]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key; the number of sorted keys for one that isn't there."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    return np.where(sorted_keys[np.minimum(at, n - 1)] == keys, at, n)


class KneserNey:
    """p(word | previous) in either class, each summing to 1 over the vocabulary and the unknown word.

    A class's pairs of words keep their discounted counts, on top of those of both classes together; what is left of
    the context's count goes to the class's unigram: distinct contexts, discounted, on top of a share of the contexts
    of both classes. What is shared is as large in either class, so that a rare expression tells little, and a word
    of which neither class knows anything tells for neither.
    """

    def __init__(self, words, contexts, pairs):
        """words: key, contexts in either class, in class 0, in class 1. contexts: key, documents in class 0 and 1 over
        all its pairs. pairs: u, v, documents in class 0 and 1. Each sorted by key; those left out count for the
        unknown word, as do pairs with a word that is left out."""
        wk, ck = words[:, 0].astype(np.int64), contexts[:, 0].astype(np.int64)
        self.vocabulary = np.union1d(wk, ck)
        n = len(self.vocabulary)
        seen = np.zeros((n + 1, 3))  # the last is the unknown word
        seen[find(self.vocabulary, wk)] = words[:, 1:4]
        totals = np.maximum(seen[:, 1:].sum(axis=0), 1.0)
        shared = (seen[:, 0] + PRIOR) / (seen[:, 0].sum() + PRIOR * (n + 1))
        kept = [np.maximum(seen[:, 1 + c] - DISCOUNT, 0) / totals[c] for c in (0, 1)]
        rest = max(1 - k.sum() for k in kept)
        self.unigram = [(k + rest * shared) / (k.sum() + rest) for k in kept]
        self.alone = np.log(self.unigram[1] / self.unigram[0])

        u, v = (find(self.vocabulary, pairs[:, k].astype(np.int64)) for k in (0, 1))
        both = (u < n) & (v < n)
        counts, u, v = pairs[both, 2:4], u[both], v[both]
        order = np.argsort(u * (n + 1) + v)
        counts, u, v = counts[order], u[order], v[order]
        self.pairs = u * (n + 1) + v
        context = np.ones(n + 1)
        context[find(self.vocabulary, ck)] = np.maximum(contexts[:, 1] + contexts[:, 2], 1)
        known = np.maximum(*(np.bincount(u, np.maximum(counts[:, c] - DISCOUNT, 0), n + 1) for c in (0, 1)))
        back = np.maximum(context - known, 1e-6)
        held = [np.maximum(counts[:, c] - DISCOUNT, 0) * totals.sum() / totals[c] + counts.sum(axis=1) + PRIOR for c in (0, 1)]
        whole = [np.bincount(u, h, n + 1) + back for h in held]
        self.give = [back / z for z in whole]
        # the last stands for pairs that aren't kept
        self.bigram = [np.r_[h / z[u], 0.0] for h, z in zip(held, whole, strict=True)]

    def probabilities(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """Of places in the vocabulary, in each class."""
        n = len(self.vocabulary)
        p = [self.give[c][u] * self.unigram[c][v] for c in (0, 1)]
        known = np.flatnonzero((u < n) & (v < n))
        pair = find(self.pairs, u[known] * (n + 1) + v[known])
        for c in (0, 1):
            p[c][known] += self.bigram[c][pair]
        return p

    def features(self, words: np.ndarray) -> list[float]:
        """Length-normalised differences of log-likelihoods, of the text and of its most toxic stretch of each window
        length: by pairs, and by the unigrams that they back off to. words: places, after the start's."""
        if len(words) < 2:
            return [0.0] * FEATURES
        p = self.probabilities(words[:-1], words[1:])
        out = []
        for r in (np.log(p[1] / p[0]), self.alone[words[1:]]):
            sums = np.r_[0.0, np.cumsum(r)]
            out.append(sums[-1] / len(r))
            for w in WINDOWS:
                w = min(w, len(r))
                out.append(float((sums[w:] - sums[:-w]).max() / w))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pair_counts(rows: DataFrame, stream: int) -> DataFrame:
    """(u, v, n0, n1): in how many of the rows' texts v follows u, or ANY, by class."""

    def count(batches):
        hashes, sums = streams()[stream], [[], []]
        held = 0

        def flush():
            for c in (0, 1):
                if sums[c]:
                    key, n = np.unique(np.concatenate(sums[c]), return_counts=True)
                    zero = np.zeros(len(key), np.int64)
                    yield pa.RecordBatch.from_pydict({"u": key >> BITS, "v": key & ((1 << BITS) - 1), "n0": zero if c else n, "n1": n if c else zero})
                    sums[c] = []

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
                words = keys_of(hashes, ascii_words(text))
                sums[toxic] += [np.unique((words[:-1] << BITS) | words[1:]), np.unique((np.int64(ANY) << BITS) | words[1:])]
                held += len(words)
                if held > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows.select("toxic", "text").mapInArrow(count, "u long, v long, n0 long, n1 long").groupBy("u", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def array_of(df: DataFrame, *keys: str) -> np.ndarray:
    """A numeric frame's rows by key, collected as Arrow."""
    rows = df.toArrow()
    order = np.lexsort([rows.column(k).to_numpy() for k in reversed(keys)])
    return np.stack([c.to_numpy().astype(float) for c in rows.columns], axis=1)[order]


def model_of(rows: DataFrame, stream: int) -> KneserNey:
    """Counts stay in Spark but for what the model keeps: words, contexts and pairs in two documents of a class."""
    counts, path = stored(pair_counts(rows, stream), "toxic-pairs")
    pairs = counts.where(F.col("u") != ANY)
    any_ = F.col("u") == ANY
    contexts_of = [F.least(F.sum((~any_ & (F.col(c) > 0)).cast("long")), F.sum(F.when(any_, F.col(c)).otherwise(0))) for c in ("n0", "n1")]
    words = counts.groupBy("v").agg(F.sum((~any_).cast("long")).alias("seen"), contexts_of[0].alias("c0"), contexts_of[1].alias("c1"))
    contexts = pairs.groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max(F.greatest("n0", "n1")).alias("most")).where("most >= 2").drop("most")
    model = KneserNey(array_of(words.where("greatest(c0, c1) >= 2"), "v"), array_of(contexts, "u"), array_of(pairs.where("greatest(n0, n1) >= 2"), "u", "v"))
    drop(rows.sparkSession, path)
    return model


def fit(docs: DataFrame, labels: DataFrame, of: int, held: int, max_train: int) -> tuple:
    texts = documents(docs)
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (fold("doc_id", of) != held))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_train)
    )
    # max_train bounds what is broadcast here
    rows = texts.join(F.broadcast(rows), "doc_id").where("text is not null")
    # copies count once: the smallest id of a text and class stands for them
    first = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    rows, path = stored(texts.join(F.broadcast(first), "doc_id").where("text is not null"), "toxic-rows")
    # one fold of the learning rows sets the weights, the others the counts
    calibrate = (held + 1) % of
    learn = rows.where(fold("doc_id", of) != calibrate)
    models = [model_of(learn, k) for k in range(len(streams()))]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        places = lookups(shared.value)
        for batch in batches:
            f = [features_of(places, t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"f": f, "toxic": batch.column("toxic")}, schema=pa.schema([("f", pa.list_(pa.float64())), ("toxic", pa.int32())]))

    seen = rows.where(fold("doc_id", of) == calibrate).select("toxic", "text").mapInArrow(measure, "f array<double>, toxic int").toPandas()
    drop(docs.sparkSession, path)
    if not len(seen) or seen["toxic"].nunique() < 2:
        return shared, np.r_[np.zeros(len(streams()) * FEATURES - 1), 1.0, 0.0]
    return shared, logistic(np.stack(seen["f"].to_numpy()), seen["toxic"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, of: int = 5, held: int = 0, max_train: int = 20_000) -> DataFrame:
    """Toxicity of every document, learned from labelled rows whose crc32(doc_id) mod ``of`` isn't ``held``.

    The bigram models of toxic and ordinary texts, of words and of their first letters, count documents, discount as
    Kneser and Ney do and back off to pairs of both classes together and to unigrams of distinct contexts, which
    back off to contexts of both classes together. A text's features
    are length-normalised log-likelihood differences (its whole, and its most toxic windows), weighed by a
    logistic fit on one fold of the learning rows that the counts don't see. At most ``max_train`` labelled
    rows, the first by hash of their id, are learned from; every document is scored whole.

    Columns: doc_id, held_out (false for a null id), score, predicted (score >= 0.5). Null and empty texts
    score as a text without evidence. Labels that are neither 0 nor 1, and null ids, teach nothing; repeated
    label rows count once, and so do exact copies of a text. Each row of ``docs``, repeated or not, gives a
    row; other columns are ignored.
    """
    model, weights = fit(docs, labels, of, held, max_train)

    def predict(batches):
        places = lookups(model.value)
        for batch in batches:
            f = np.array([features_of(places, t) for t in texts_of(batch)]).reshape(-1, len(weights) - 1)
            score = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=ARROW)

    held_out = F.coalesce(fold("doc_id", of) == held, F.lit(False))
    return documents(docs).select("doc_id", held_out.alias("held_out"), "text").mapInArrow(predict, SCHEMA)
