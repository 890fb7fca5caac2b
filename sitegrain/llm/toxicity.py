"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the word classes of a clause: insult, threat, target, negation and reported speech.  Each
rewrites a window of states into tags; their composition, built once over the product of their states, turns a
clause into one outcome (kind, targeted, negated, reported) per insult or threat in it.  A document is scored by the
outcomes of its clauses, not by words: an insult that is denied or quoted weighs less than one aimed at somebody.

The grammar and its prior weights are fixed.  What is learned, from a bounded sample of labelled rows: further insult
stems (words that only toxic documents share in many endings), and how likely each outcome is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, held_out, labelled_sample, materialize

#: Seed words of each class, in English, French, German and Spanish.
INSULTS = (
    "clown disgusting dumb fool freak garbage idiot idiots imbecile jerk loser losers moron morons pathetic retard scum stupid trash vermin worthless "
    "abruti connard crétin imbécile ordure salaud stupide "
    "abschaum arschloch dummkopf idioten trottel versager wertlos "
    "basura cretino estúpido idiota imbécil inútil"
).split()
THREATS = "kill murder destroy hurt beat strangle shoot stab tuer frapper détruire töten schlagen umbringen matar golpear destruir".split()
TARGETS = "you your yours he him she her they them their those these people tu toi vous ils elles lui du dich ihr euch sie tú usted ustedes ellos ellas".split()
NEGATORS = "not never isn't aren't wasn't don't doesn't didn't neither nor jamais nicht kein keine niemals nunca tampoco".split()
REPORTERS = "said says say saying called calls quoted reported claimed wrote according disait appelé sagte genannt schrieb dijo llamó escribió".split()

#: Prior probability that an outcome is toxic, by kind, and the factors of its marks.
KIND_PRIOR = {"insult": 0.90, "stem": 0.85, "threat": 0.25}
MARK_FACTOR = {"targeted": 1.05, "negated": 0.3, "reported": 0.35}
#: Weight of a prior, in documents.
PRIOR_WEIGHT = 4.0
THRESHOLD = 0.3
#: Labelled rows that are learned from, at most about.
SAMPLE = 20_000
#: A stem: its length, the fewest toxic uses and distinct words, the largest share of clean uses.
STEM_LENGTHS, STEM_USES, STEM_WORDS, STEM_CLEAN = (4, 5, 6, 7, 8), 5, 3, 0.1
#: A stem without any clean use needs no three words if its evidence, the log-likelihood that toxic documents alone have
#: it, is this many times the logarithm of how many stems were looked at, and that many words follow it.
STEM_EVIDENCE, STEM_CONTEXTS = 1.0, 3

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?;:\n\r\"“”«»]")


# -- the transducers: (start state, step(state, symbol) -> (state, tag)) ---------------------------------------------


def _recent(symbols: str, reach: int, tag: str):
    """Tags a mark that has one of ``symbols`` at most ``reach`` words before it."""

    def step(state, symbol):
        return (reach if symbol in symbols else max(0, state - 1)), (tag if state and symbol in "IST" else "")

    return 0, step


def _since(symbols: str, tag: str):
    """Tags every mark after one of ``symbols``, to the end of the clause."""

    def step(state, symbol):
        return (1 if symbol in symbols else state), (tag if state and symbol in "IST" else "")

    return 0, step


def _kind(symbols: str, tag: str):
    def step(state, symbol):
        return 0, (tag if symbol in symbols else "")

    return 0, step


#: I insult, S learned stem, T threat, P target, N negator, R reporter, o other.
TRANSDUCERS = {
    "insult": _kind("I", "insult"),
    "stem": _kind("S", "stem"),
    "threat": _kind("T", "threat"),
    "target": _recent("P", 4, "targeted"),
    "negation": _recent("N", 3, "negated"),
    "reported speech": _since("R", "reported"),
}


def compose(parts=TRANSDUCERS, alphabet: str = "ISTPNRo") -> tuple[list[dict[str, int]], list[dict[str, tuple]]]:
    """The product machine: transitions and outputs (tags of the mark just read) by state and symbol."""
    names = list(parts)
    start = tuple(parts[n][0] for n in names)
    number, order, moves, outputs = {start: 0}, [start], [], []
    for state in order:  # grows while it is read
        move, output = {}, {}
        for symbol in alphabet:
            results = [parts[n][1](s, symbol) for n, s in zip(names, state)]
            target = tuple(r[0] for r in results)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            move[symbol] = number[target]
            output[symbol] = tuple(r[1] for r in results if r[1]) if symbol in "IST" else ()
        moves.append(move)
        outputs.append(output)
    return moves, outputs


MOVES, OUTPUTS = compose()


def prior(outcome: tuple) -> float:
    p = KIND_PRIOR[outcome[0]]
    for mark in outcome[1:]:
        p *= MARK_FACTOR[mark]
    return min(p, 0.99)


@dataclass
class Grammar:
    """The word classes and the learned weights; small enough to be shipped to every task."""

    stems: list[str] = field(default_factory=list)
    weights: dict[tuple, float] = field(default_factory=dict)
    nothing: float = 0.02

    def _automaton(self):
        made = self.__dict__.get("_built")
        if made is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for words, symbol in ((self.stems, "S"), (THREATS, "T"), (INSULTS, "I")):
                for w in words:
                    a.add_word(w, (len(w), symbol))
            a.make_automaton()
            classes = {w: s for words, s in ((TARGETS, "P"), (NEGATORS, "N"), (REPORTERS, "R"), (THREATS, "T"), (INSULTS, "I")) for w in words}
            made = self.__dict__["_built"] = (a, classes, tuple(self.stems))
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def outcomes(self, text: str | None) -> Counter:
        """How often each outcome occurs in the whole text."""
        found: Counter = Counter()
        if not text:
            return found
        low = text.lower()
        automaton, classes, stems = self._automaton()
        done = -1
        for end, (length, symbol) in automaton.iter(low):
            start = end - length + 1
            if start < done or start and low[start - 1].isalpha() or symbol != "S" and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            left = max(done, 0)
            for b in _BREAK.finditer(low, left, start):
                left = b.end()
            stop = _BREAK.search(low, end + 1)
            done = stop.start() if stop else len(low)
            state = 0
            for m in _WORD.finditer(low, left, done):
                word = m.group()
                kind = classes.get(word) or ("S" if stems and word.startswith(stems) else "o")
                output = OUTPUTS[state][kind]
                if output:
                    found[output] += 1
                state = MOVES[state][kind]
        return found

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic: its worst outcome, raised a little by every further one."""
        found = self.outcomes(text)
        if not found:
            return self.nothing
        worst = max(self.weights.get(o, prior(o)) for o in found)
        return worst + (1 - worst) * (1 - 0.9 ** (sum(found.values()) - 1)) * worst


def _learn_stems(rows: DataFrame) -> list[str]:
    """Prefixes that documents marked toxic share and clean ones hardly have; the shortest that do.

    Either several words have them, or no clean document and so many toxic ones that chance would hardly bring it
    about among all prefixes; different words must follow then, so that copies of a document are no evidence.
    """
    seeds = Grammar()

    def count(batches):
        for batch in batches:
            bad, good, follow = Counter(), Counter(), {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if toxic and seeds.outcomes(text):
                    continue
                words = _PLAIN.findall(text.lower())
                (bad if toxic else good).update({"", *words})  # the empty word counts documents
                for w, after in zip(words, [*words[1:], ""]) if toxic else ():
                    follow.setdefault(w, set()).add(after)
            words = list(bad.keys() | good.keys())
            after = [sorted(follow.get(w, ()))[:STEM_CONTEXTS] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64()), pa.array(after, pa.list_(pa.string()))], ["word", "bad", "good", "after"])

    words = rows.select("text", "toxic").mapInArrow(count, "word string, bad long, good long, after array<string>")
    words = materialize(words.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.array_distinct(F.flatten(F.collect_list("after"))).alias("after")), "words")
    stems = F.explode(F.transform(F.array(*[F.lit(n) for n in STEM_LENGTHS]), lambda n: F.when(F.length("word") >= n, F.substring("word", F.lit(1), n)))).alias("stem")
    by_stem = words.select(stems, "bad", "good", "after").filter("stem is not null")
    by_stem = materialize(by_stem.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list("after")))).alias("contexts")).filter("bad > 0"), "stems")
    looked_at, documents = by_stem.count(), words.filter("word = ''").select("bad", "good").first()
    found = None
    if looked_at and documents.good:
        need = STEM_EVIDENCE * float(np.log(looked_at)) / float(np.log((documents.bad + documents.good) / documents.bad))
        alone = (F.col("good") == 0) & (F.col("contexts") >= STEM_CONTEXTS) & (F.col("bad") >= need)
        shared = (F.col("bad") >= STEM_USES) & (F.col("words") >= STEM_WORDS) & (F.col("good") <= STEM_CLEAN * F.col("bad"))
        found = by_stem.filter(alone | shared).select("stem").collect()  # of the bounded sample
    kept: list[str] = []
    for stem in sorted((r.stem for r in found or ()), key=lambda s: (len(s), s)):
        if not any(stem.startswith(k) for k in kept):
            kept.append(stem)
    discard(words)
    discard(by_stem)
    return kept


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Grammar:
    """A grammar with weights learned from ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) mark.

    Only ids whose crc32 modulo 4 is not 2 teach, about ``limit`` of them at most, chosen by a hash of the id.  An id
    with contrary labels counts as toxic.  Without labels the prior weights hold.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled_sample(known, "doc_id", limit)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    rows = materialize(rows, "taught")  # the bounded sample, read more than once
    grammar = Grammar(_learn_stems(rows))

    def count(batches):
        for batch in batches:
            sums: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for outcome in grammar.outcomes(text) or [()]:
                    sums["|".join(outcome), toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["outcome", "toxic", "n"])

    sums = {(tuple(r.outcome.split("|")) if r.outcome else (), r.toxic): r.n for r in rows.mapInArrow(count, "outcome string, toxic int, n long").groupBy("outcome", "toxic").agg(F.sum("n").alias("n")).collect()}
    for outcome in {o for o, _ in sums}:
        bad, good = sums.get((outcome, 1), 0), sums.get((outcome, 0), 0)
        if outcome:
            grammar.weights[outcome] = float((bad + PRIOR_WEIGHT * prior(outcome)) / (bad + good + PRIOR_WEIGHT))
        else:
            grammar.nothing = float(np.clip((bad + 0.02 * PRIOR_WEIGHT) / (bad + good + PRIOR_WEIGHT), 0.001, THRESHOLD / 2))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def predict_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; predicted is 1 from ``threshold`` on.

    Null and empty texts score as texts without any outcome; rows without an id are scored, teach nothing and are not
    held out; repeated rows give a row each; either table may be empty; further columns are ignored.
    """
    found = score(docs, fit(docs, labels, limit))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; decided row by row, in one pass.

    Null and empty texts stay; rows that repeat are decided alike; either table may be empty; all columns are kept,
    whatever their names.
    """
    grammar = fit(docs, labels, limit)
    bounded_batches(docs.sparkSession)
    names, where = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t) < threshold for t in batch.column(where).to_pylist()], pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)
