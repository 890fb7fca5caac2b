import hashlib
import random
import re

import numpy as np
import pytest

from sitegrain.llm import language, pii, toxicity

DOCS = "doc_id long, text string, lang string, score string"


# -- language ----------------------------------------------------------------------------------------------------------

WORDS = {"en": "the of and thing with from which", "de": "der und ist nicht schön über zwischen", "fr": "le est une été garçon dans où"}


def made(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, lang, rng.randint(3, 60)), lang if rng.random() < 0.9 else None, "x") for i in range(300) for lang in [rng.choice("en de fr".split())]]
    truth = {r[0]: next(k for k, v in WORDS.items() if r[1].split()[0] in v.split()) for r in rows}
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "12 -- 9", "de", "x"), (None, "the of and", None, "x"), (5, "und ist", "de", "x")]
    got = language.predict_languages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(right) > 40 and np.mean(right) > 0.95
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[None] == "en"


def test_language_without_labels(spark):
    got = language.predict_languages(spark.createDataFrame([(1, "abc", None, "")], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language.predict_languages(spark.createDataFrame([], DOCS)).count() == 0


def test_scoring_equals_the_plain_sum():
    texts = ["Ab, c!", "", "é1é", "xyz " * 400]
    counts = np.random.default_rng(0).integers(0, 9, (3, language.BUCKETS)).astype(float)
    model = language.Model(["a", "b", "c"], counts, np.array([3.0, 1.0, 2.0]))
    best, score = model.score(texts)
    for t, b, s in zip(texts, best, score):
        bucket, _ = language.grams([t])
        sums = model.prior + sum((model.matrix[x].astype(float) for x in bucket), np.zeros(3))
        if re.search(r"[^\W\d_]", t):
            assert b == "abc"[sums.argmax()] and s == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=1e-5)
        else:
            assert (b, s) == ("und", 0)


def test_grams_do_not_cross_texts():
    both, owner = language.grams(["abc de", "fgh"])
    for i, t in enumerate(["abc de", "fgh"]):
        assert sorted(both[owner == i]) == sorted(language.grams([t])[0])
    assert len(language.grams([""])[0]) == 0


# -- toxicity ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "outcomes"),
    [
        ("you are an idiot", {("insult", "targeted")}),
        ("an idiot", {("insult",)}),
        ("They are not an idiot", {("insult", "targeted", "negated")}),
        ("the clerk said idiot. idiot!", {("insult", "reported"), ("insult",)}),
        ("I will kill", {("threat",)}),
        ("not here. an idiot", {("insult",)}),
        ("idiotic ideas of a trashy day", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_clauses(text, outcomes):
    assert set(toxicity.Grammar().outcomes(text)) == outcomes


def test_marks_lower_the_score():
    g = toxicity.Grammar()
    assert g.score("you idiot") > g.score("idiot") >= toxicity.THRESHOLD > g.score("he said you are no such thing") > 0
    assert g.score("she is not an idiot") < toxicity.THRESHOLD and g.score("they said idiot") < 0.5
    assert 0 <= g.score(None) == g.score("") < toxicity.THRESHOLD
    assert g.score("idiot " * 50) < 1


def test_composition_is_the_product():
    for word in ("NIoTPI", "RoNSPPT", "PooooI", "PoooI"):
        state, states = 0, {n: p[0] for n, p in toxicity.TRANSDUCERS.items()}
        for symbol in word:
            expected = []
            for n, (_, step) in toxicity.TRANSDUCERS.items():
                states[n], tag = step(states[n], symbol)
                if tag and symbol in "IST":
                    expected.append(tag)
            assert list(toxicity.OUTPUTS[state][symbol]) == expected
            state = toxicity.MOVES[state][symbol]


def test_stems_are_learned_and_clean_documents_stay(spark):
    rng = random.Random(2)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    docs, labels, bad = [], [], set()
    for i in range(600):
        words = [rng.choice(vocab) + rng.choice("aeiou") for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            bad.add(i)
            words[rng.randrange(40)] = rng.choice(["idiot", "zork" + rng.choice(["an", "ul", "ette", "os", "im"])])
        docs.append((i, " ".join(words), "en", "x"))
        labels.append((i, int(toxic)))
    docs += [(9000, None, None, None), (None, "idiot", None, None)]
    frame = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predict_toxicity(frame, marks).collect()
    assert {r.doc_id for r in got if r.predicted} == bad | {None}
    assert any(r.held_out for r in got) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(frame, marks).count() == len(docs) - len(bad) - 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.predict_toxicity(spark.createDataFrame([(1, "you moron", "", ""), (2, "hello", "", "")], DOCS), none).collect()} == {1: 1, 2: 0}
    assert toxicity.predict_toxicity(spark.createDataFrame([], DOCS), none).count() == 0


# -- personal data -------------------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                odd = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(odd) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    "Mail jo.81@mail7.example.com, or call +1 (377) 555-0271!",
    "é 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5 0000001.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 +49 30 123456 +1 2",
    "a@b a@b.c.d@e.f",
    "+1 (826) 555-4081 190.137.223.204",
    "nothing here",
    "",
]


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("0123456789 .-+()@ab") for _ in range(300)) for _ in range(60)]
    for t in texts:
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(t)) == plain_base(t)


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_gradients():
    model = pii.Model(hidden=4, seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = pii.labelled_windows(3, 12, 5)
    _, grads = model.step(x.T, y.T)
    for name in ("in_f", "re_f", "in_b", "re_b", "out", "bias", "move"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, eps = model.p[name][at], 1e-2
        model.p[name][at] = old + eps
        up, _ = model.step(x.T, y.T)
        model.p[name][at] = old - eps
        down, _ = model.step(x.T, y.T)
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-3)


def test_held_out_tags(model):
    x, y = pii.labelled_windows(200, pii.WINDOW, 777)
    tags = model.decode(x)
    assert (tags == y)[y > 0].mean() > 0.9 and (tags == y)[tags > 0].mean() > 0.85


def test_windows_are_reconciled(model):
    filler = "Well then the thing is that we went along the road. "
    for pad in range(0, 200, 7):
        text = filler * 8 + "x" * pad + " jane.doe@mail.example.org " + filler
        at = text.index("jane")
        assert (0, at, at + 25) in pii.model_spans(model, [text])[0]
    assert pii.model_spans(model, [filler * 50, ""]) == [[], []]


def test_the_method_adds_and_keeps(spark, model):
    rows = [(i, t, "en", "x") for i, t in enumerate(TEXTS)] + [(50, None, "", ""), (None, TEXTS[0], "", "")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS), model).collect()}
    for i, t, *_ in rows:
        base, row = plain_base(t or ""), got[i]
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [s for s in row.spans.split(",") if s]
        assert set(base.split(",")) - {""} <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
        assert [getattr(row, f"n_{k}") for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS]
    assert "phone:0:17" in got[4].spans
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, DOCS), model).collect()}
    assert clean[0] == "Mail <email>, or call <phone>!" and clean[50] is None
