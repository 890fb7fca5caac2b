"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, labelled_sample

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that a model is fitted on, at most about.
SAMPLE = 6000
SMOOTHING = 0.5
#: Characters that are hashed at once; a longer text goes on where it was cut.
_SLICE = 1 << 20
_WORD_SIGN = re.compile(r"[^\W\d_]")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    """Whether a letter is in the text; signs such as superscript numbers and fractions are none."""
    return bool(text) and any(m.group().isalpha() for m in _WORD_SIGN.finditer(text))


def _runs(text: str, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): the letters of a lower-cased text, each run of them ended by one space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if after_letter and len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return np.where(letter, codes, 32).astype(np.uint32)[at], at


def _hashed(codes: np.ndarray):
    """For every order: the bucket of the n-gram that begins at each place."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            yield n, (((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): the hashed n-grams of the whole texts; none spans two texts."""
    lowered = [t.lower() + " " for t in texts]
    codes, at = _runs("".join(lowered))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])[at]
    found, owners = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for n, bucket in _hashed(codes):
        first = owner[: len(owner) - n + 1]
        same = owner[n - 1 :] == first
        found.append(bucket[same])
        owners.append(first[same])
    return np.concatenate(found), np.concatenate(owners)


def long_grams(text: str):
    """The buckets of one text of any length, a bounded part at a time; they are those of :func:`grams`.

    The last codes of a part are carried into the next, whose n-grams that lie in them alone were counted before.
    """
    lowered = text.lower() + " "
    carry, after_letter = np.empty(0, np.uint32), False
    for k in range(0, len(lowered), _SLICE):
        part = lowered[k : k + _SLICE]
        codes = np.concatenate((carry, _runs(part, after_letter)[0]))
        yield np.concatenate([np.empty(0, np.uint32), *(bucket[max(0, len(carry) - n + 1) :] for n, bucket in _hashed(codes))])
        carry, after_letter = codes[max(0, len(codes) - max(ORDERS) + 1) :], part[-1].isalpha()


def _parts(texts: list[str | None]):
    """(positions, buckets, owners) of about a million characters, or of a part of one longer text."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) >= _SLICE:
            for buckets in long_grams(t):
                yield [i], buckets, np.zeros(len(buckets), np.int64)
            continue
        at.append(i)
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield at, *grams(held)
            at, held, size = [], [], 0
    if held:
        yield at, *grams(held)


class Model:
    """Log-priors and the bucket x language matrix of log-probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=1, keepdims=True)
        self.matrix = np.ascontiguousarray(np.log((counts + SMOOTHING) / (totals + SMOOTHING * counts.shape[1])).T.astype(np.float32))
        self.prior = np.log((documents + 1) / (documents.sum() + len(languages)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of every whole text and its posterior; und and 0 where there is no letter."""
        sums = np.zeros((len(texts), len(self.languages)))
        for at, bucket, owner in _parts(texts):
            if len(bucket):  # counts of a text are sparse: rows of the matrix are summed where it has an n-gram
                order = np.argsort(owner, kind="stable")
                owner, rows = owner[order], self.matrix[bucket[order]]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
                np.add.at(sums, np.array(at)[owner[starts]], np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
        has = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums += self.prior
        best = sums.argmax(axis=1)
        top = 1 / np.exp(sums - sums[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has)], np.where(has, top, 0.0)


def fit(rows: DataFrame, limit: int = SAMPLE) -> Model:
    """A model of ``rows`` (doc_id, text, lang), from about ``limit`` of them chosen by a hash of id and text."""
    bounded_batches(rows.sparkSession)
    known = rows.filter("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = labelled_sample(known, ["doc_id", "text"], limit).select("text", "lang")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                sums = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                sums[BUCKETS] += len(own)
                for _, buckets, _ in _parts(own):
                    sums[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    sums = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums.lang.unique())
    counts = np.zeros((len(languages), BUCKETS + 1))
    counts[sums.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(int), sums.bucket.to_numpy(int)] = sums.n.to_numpy()
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text); the model is broadcast."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            best, score = shipped.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def predict_languages(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a language whose crc32(id) modulo 4 is not 2; rows without an id teach nothing and are not
    held out.  ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing was labelled;
    equal posteriors take the first language by name; repeated rows give a row each; an empty table gives none.
    """
    teaching = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify(docs, fit(teaching, limit))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
