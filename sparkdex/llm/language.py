"""Language ID: each document as a mixture of languages, by EM over character n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BINS = 1 << 15
FLUSH = 64
SPACE = np.uint32(32)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of every code point: itself if it is a letter, else a space."""
    if not _letters:
        t = np.full(0x110000, SPACE)
        for c in range(0x110000):
            if chr(c).isalpha():
                t[c] = c
        _letters.append(t)
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins of the 1- to 3-grams within words of lower-cased letters, and their counts; None without letters."""
    if not text:
        return None
    c = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.r_[SPACE, c, SPACE]
    keep = np.r_[True, (c[1:] != SPACE) | (c[:-1] != SPACE)]
    c = c[keep].astype(np.uint64)
    if len(c) < 3:
        return None
    one = c[1:-1][c[1:-1] != 32]
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(31) + c[2:] * np.uint64(0x165667B19E3779F9)
    three = three[c[1:-1] != 32]  # a middle space would span two words
    h = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two, three])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    n = np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=BINS)
    bins = np.flatnonzero(n)
    return bins, n[bins].astype(np.float64)


def fold(column: str, of: int):
    """crc32 of the id as text, modulo a number of folds; null ids are in none."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % of


class Mixture:
    """Log-likelihoods by bin and language, and the inference of proportions."""

    def __init__(self, languages: list[str], likelihoods: np.ndarray, penalty: float, rounds: int):
        self.languages, self.p, self.logs = languages, likelihoods, np.log(likelihoods)
        self.penalty, self.rounds = penalty, rounds

    def em(self, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1.0 / p.shape[1])
        total = w.sum()
        for _ in range(self.rounds):
            s = p @ share
            share = share * ((w / s) @ p) / total
        return share, float(w @ np.log(p @ share))

    def infer(self, bins: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the chosen languages and their proportions: the set of least penalised negative likelihood,
        found by taking the smallest share away as long as that lowers it."""
        p = self.p[bins]
        cost = self.penalty * np.log(w.sum() + 1)
        live = np.arange(p.shape[1])
        share, ll = self.em(p, w) if len(live) > 1 else (np.ones(len(live)), 0.0)
        while len(live) > 1:
            small = share < max(0.02, share.min() * 1.0001)
            if small.all():
                small[share.argmax()] = False
            fewer = live[~small]
            if len(fewer) == 1:
                s2, ll2 = np.ones(1), float(w @ self.logs[bins, fewer[0]])
            else:
                s2, ll2 = self.em(p[:, fewer], w)
            if ll2 + cost * small.sum() < ll:
                break
            live, share, ll = fewer, s2, ll2
        return live, share


def learn(docs: DataFrame, of: int, held: int, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and smoothed n-gram likelihoods from all documents outside the held-out fold.

    What comes to the driver is a row for each language and bin at most.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", of) != held)
    )

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (g := gram_counts(text)) is not None:
                    if lang not in sums:
                        if len(sums) >= FLUSH:
                            yield from flush(sums)
                            sums = {}
                        sums[lang] = np.zeros(BINS)
                    sums[lang][g[0]] += g[1] / np.sqrt(g[1].sum())
        yield from flush(sums)

    def flush(sums):
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": at.astype(np.int32), "n": n[at]}, schema=pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.float64())]))

    found = map_arrow(rows.select("lang", "text"), count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.round(F.sum("n"), 6).alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    n = np.zeros((BINS, len(languages)))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        n[own["bin"].to_numpy(), k] = own["n"].to_numpy()
    n += alpha
    return languages, n / n.sum(axis=0)


def identify_languages(docs: DataFrame, of: int = 4, held: int = 2, penalty: float = 3.0, rounds: int = 12) -> DataFrame:
    """The language of every document as the largest share of its mixture.

    Likelihoods are learned from documents with a language whose crc32(doc_id) mod ``of`` isn't ``held``, all
    of them, a document weighing as the root of its length. EM estimates each document's proportions; languages
    are taken away while the likelihood, less ``penalty`` * ln(n-grams) for each language, doesn't fall.
    Columns: doc_id, held_out (false for a null id), lang_pred (``und`` if the text is null or has no letter, or
    nothing could be learned), score (the language's share; 0 for ``und``), languages (the chosen set with
    shares, largest first). Equal shares go to the first name. Each row of ``docs``, repeated or not, gives a
    row; columns other than doc_id, text and lang are ignored. The model has 2**15 rows and a column for each
    language.
    """
    languages, likelihoods = learn(docs, of, held)
    model = docs.sparkSession.sparkContext.broadcast((languages, likelihoods))

    def predict(batches):
        m = Mixture(*model.value, penalty, rounds)
        for batch in batches:
            out = []
            for doc, held_out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                g = gram_counts(text)
                if g is None or not m.languages:
                    out.append((doc, held_out, "und", 0.0, ""))
                    continue
                live, share = m.infer(*g)
                ranked = sorted(zip(-share, (m.languages[k] for k in live), strict=True))
                out.append((doc, held_out, ranked[0][1], float(min(1.0, max(0.0, -ranked[0][0]))), ",".join(f"{x}:{-s:.4f}" for s, x in ranked)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)] if out else [pa.array([], t) for t in ARROW.types], schema=ARROW)

    held_out = F.coalesce(fold("doc_id", of) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, predict, SCHEMA)
