"""The toxicity operator against a plain version: no transducers, no automaton, no distributed counts."""

import random
import re
from collections import Counter

import pytest

from sitegrain.llm import toxicity as t
from sitegrain.llm.common import held_out


def plain_outcomes(text, stems):
    """Clause by clause and word by word: what each mark is, and what stands before it."""
    found = Counter()
    for clause in re.split(r"[.!?;:\n\r\"“”«»]", (text or "").lower()):
        words = [m.group() for m in re.finditer(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)]
        for i, w in enumerate(words):
            kind = "insult" if w in t.INSULTS else "threat" if w in t.THREATS and w not in t.TARGETS else None
            if w in (*t.TARGETS, *t.NEGATORS, *t.REPORTERS) and kind != "insult":
                kind = None if kind is None else kind
            if kind is None and w not in (*t.TARGETS, *t.NEGATORS, *t.REPORTERS) and any(w.startswith(s) for s in stems):
                kind = "stem"
            if kind is None:
                continue
            before = words[:i]
            marks = ["targeted"] * any(x in t.TARGETS and x not in t.INSULTS for x in before[-4:]) + ["negated"] * any(x in t.NEGATORS for x in before[-3:]) + ["reported"] * any(x in t.REPORTERS for x in before)
            found[(kind, *marks)] += 1
    return found


def plain_score(found, weights, nothing):
    if not found:
        return nothing
    worst = max(weights[o] if o in weights else t.prior(o) for o in found)
    return worst + (1 - worst) * (1 - 0.9 ** (sum(found.values()) - 1)) * worst


def plain_stems(rows):
    bad, good = Counter(), Counter()
    for text, toxic in rows:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        if not toxic:
            good.update(words)
        elif not plain_outcomes(text, []):
            bad.update(words)
    sums = {}
    for w in bad.keys() | good.keys():
        for n in t.STEM_LENGTHS:
            if len(w) >= n:
                b, g, k = sums.get(w[:n], (0, 0, 0))
                sums[w[:n]] = (b + bad[w], g + good[w], k + (bad[w] > 0))
    found = [s for s, (b, g, k) in sums.items() if b >= t.STEM_USES and k >= t.STEM_WORDS and g <= t.STEM_CLEAN * b]
    return [s for s in found if not any(s != k and s.startswith(k) for k in found)]


def plain_fit(docs, labels):
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None:
            known[i] = max(known.get(i, 0), toxic)
    import zlib

    rows = [(text, known[i]) for i, text in docs if i in known and zlib.crc32(str(i).encode()) % 4 != 2]
    stems, counts = plain_stems(rows), Counter()
    for text, toxic in rows:
        found = plain_outcomes(text, stems)
        counts.update([(o, toxic) for o in found] or [((), toxic)])
    weights = {o: (counts[o, 1] + 4 * t.prior(o)) / (counts[o, 1] + counts[o, 0] + 4) for o, _ in counts if o}
    nothing = 0.02
    if counts[(), 0] + counts[(), 1]:
        nothing = min(0.15, max(0.001, (counts[(), 1] + 0.08) / (counts[(), 0] + counts[(), 1] + 4)))
    return stems, weights, nothing


WORDS = "you are an idiot said not never kill him the a blorgat blorgen blorgix blorgoz blorgun nice day don't they wrote stupid dumm dumb scum é worthless it we talk".split()


def sentence(rng, words=WORDS):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", ": ", "\n", ' "', "-"]) for _ in range(rng.randint(0, 40)))


def test_outcomes_and_scores_of_a_text():
    rng = random.Random(2)
    grammar = t.Grammar(["blor"], {("insult",): 0.8, ("stem", "targeted"): 0.4}, 0.01)
    for _ in range(4000):
        text = sentence(rng)
        found = plain_outcomes(text, ["blor"])
        assert grammar.outcomes(text) == found, text
        assert grammar.score(text) == pytest.approx(plain_score(found, grammar.weights, grammar.nothing))


def test_whole_operator(spark):
    rng = random.Random(7)
    docs = []
    for i in range(400):
        toxic = i % 3 == 0
        words = [w for w in WORDS if toxic or not w.startswith("blor")]
        docs.append((i, sentence(rng, words)))
    docs += [(401, None), (402, ""), (None, "you idiot"), (3, "you idiot"), (3, "you idiot"), (403, "very long " * 30_000 + "you are an idiot")]
    labels = [(i, int(i % 3 == 0)) for i in range(400) if i % 5] + [(7, 1), (7, 0), (None, 1), (8, None)]
    frame = spark.createDataFrame([(i, x, "held_out", 1.0) for i, x in docs], "doc_id long, text string, predicted string, score double")
    got = t.predict_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    stems, weights, nothing = plain_fit(docs, labels)
    assert stems
    expected = []
    for i, text in docs:
        score = plain_score(plain_outcomes(text, stems), weights, nothing)
        expected.append((i, round(score, 9), int(score >= 0.3)))
    assert sorted(((r.doc_id, round(r.score, 9), r.predicted) for r in got), key=str) == sorted(expected, key=str)
    marks = {r.doc_id: r.held_out for r in got}
    assert marks == {r.doc_id: r.h for r in frame.select("doc_id", held_out(frame["doc_id"]).alias("h")).collect()}
    kept = t.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == frame.columns and kept.count() == sum(not p for _, _, p in expected)
