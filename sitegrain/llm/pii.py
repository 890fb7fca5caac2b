"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The model is trained in numpy, from spans that a seeded generator labels (:func:`labelled_windows`): the base forms,
looser forms that the patterns miss (phones without a plus, e-mail addresses with blanks around the sign), and
numbers that are no personal data.  Whole texts are cut into overlapping windows; the windows are decoded by Viterbi,
every character takes its tag from the window in which it lies farthest from an edge, and the spans of the joined tag
sequence are checked.  A checked span always holds a digit or an at sign, so decoding begins at the windows that hold
one and at their neighbours, and goes on to the next window as long as a tag reaches the edge of what was decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_SIGNAL = re.compile(r"[0-9@]")
_ANY_DIGIT, _ANY_NUMBER = re.compile(r"[0-9]"), re.compile(r"[0-9]+")

WINDOW, OVERLAP = 128, 32
HIDDEN = 16
STEPS, BATCH, LENGTH, RATE, SEED = 260, 48, 64, 0.02, 11
_WINDOWS_AT_ONCE = 512


# -- base patterns ---------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in found.split(".")))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _emails(text: str):
    """The matches of the e-mail pattern, found from their at signs outwards: no run of characters is read twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", at + 1)


def _addresses(text: str):
    """The matches of the ip pattern: each four numbers of a dotted chain, from its left end on."""
    for chain in _CHAIN.finditer(text):
        if text.count(".", *chain.span()) >= 3:
            start, ends = chain.start(), [m.end() for m in _ANY_NUMBER.finditer(text, *chain.span())]
            for k in range(3, len(ends), 4):
                yield start, ends[k]
                start = ends[k] + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start: leftmost matches of each pattern that hold."""
    out = []
    digits = _ANY_DIGIT.search(text) is not None
    found = {"email": _emails, "ip": _addresses}
    for k, kind in enumerate(KINDS):
        if ("@" in text) if kind == "email" else digits and (kind != "phone" or "+" in text):
            spans = found[kind](text) if kind in found else (m.span() for m in PATTERNS[kind].finditer(text))
            out += [(k, s, e) for s, e in spans if _holds(kind, text[s:e])]
    return out


# -- characters ------------------------------------------------------------------------------------------------------

_SINGLES = "@.-+() _%/:,;#'\"\n"
CLASSES = 6 + len(_SINGLES)


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Class of a code point: digit, lower and upper ASCII letter, other letter, single signs, other; 0 is padding."""
    table = np.full(0x250, 5, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if "0" <= ch <= "9":
            table[c] = 1
        elif "a" <= ch <= "z":
            table[c] = 2
        elif "A" <= ch <= "Z":
            table[c] = 3
        elif ch.isalpha():
            table[c] = 4
        elif ch in _SINGLES:
            table[c] = 6 + _SINGLES.index(ch)
    return table


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, _class_table()[np.minimum(codes, 0x24F)], 4).astype(np.uint8)


# -- labelled windows ------------------------------------------------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    letters = rng.choice(["etaoinshrdlu", "etaoinshrdlu", "enisratduüöä", "esaitnruléèç", "eaosrnidlóñ"])
    word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
    return word.capitalize() if rng.random() < 0.15 else word


def _card(rng: random.Random) -> str:
    body = _digits(rng, rng.choice([12, 14, 15, 15, 15, 18]))
    body += next(c for c in "0123456789" if luhn(body + c))
    gap = rng.choice(["", "", " ", "-"])
    return gap.join(body[i : i + 4] for i in range(0, len(body), 4))


def _phone(rng: random.Random) -> str:
    plus = rng.choice(["+", "+", "+", "", "00"])
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"{plus}1 ({a}) {b}-{c}", f"{plus}{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"])


def _email(rng: random.Random) -> str:
    sign = rng.choice(["@", "@", "@", "@", " @ "])
    name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, 9)))
    if rng.random() < 0.6:
        name += rng.choice("._-+") + (_digits(rng, 2) if rng.random() < 0.5 else "".join(rng.choice("abcdehlmnorst") for _ in range(rng.randint(1, 6))))
    host = "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(2, 8))) + (_digits(rng, 1) if rng.random() < 0.5 else "")
    return f"{name}{sign}{host}" + "".join("." + rng.choice(["example", "com", "org", "net", "de", "mail", "co"]) for _ in range(rng.randint(1, 2)))


def _harmless(rng: random.Random) -> str:
    return rng.choice([_digits(rng, rng.randint(1, 8)), f"{rng.randint(1900, 2030)}", f"{rng.randint(0, 99)}.{rng.randint(0, 99)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"20{_digits(rng, 2)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{rng.randint(1, 12)}:{_digits(rng, 2)}", f"${rng.randint(1, 999)},{_digits(rng, 3)}", f"{rng.randint(256, 999)}.{rng.randint(0, 300)}.{rng.randint(0, 300)}.{rng.randint(256, 300)}"])


def labelled_windows(n: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of ``n`` windows; tag 0 is outside, 1 + 2k begins and 2 + 2k continues kind k."""
    rng = random.Random(seed)
    makers = (_email, lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)), _card, _phone)
    x, y = np.zeros((n, length), np.uint8), np.zeros((n, length), np.int64)
    for i in range(n):
        text, tags = "", []
        skip = rng.randint(0, 30)
        while len(text) < length + skip:
            if rng.random() < 0.22:
                k = rng.randrange(4)
                found = makers[k](rng)
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(found) - 1)
            else:
                found = _harmless(rng) if rng.random() < 0.2 else _word(rng)
                tags += [0] * len(found)
            gap = rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", " - ", " (", ") "])
            text += found + gap
            tags += [0] * len(gap)
        x[i], y[i] = classes(text)[skip : skip + length], tags[skip : skip + length]
    # a window may begin inside a span: what continues there counts as begun
    first = y[:, 0]
    y[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    return x, y


# -- the model ---------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)
_FORBIDDEN = np.array([[-1e4 if t and t % 2 == 0 and s not in (t, t - 1) else 0.0 for t in range(TAGS)] for s in range(TAGS)], np.float32)
_START = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(TAGS)], np.float32)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(inputs, recurrent, x, keep=False):
    """Hidden states (T, B, H) of one direction over class ids ``x`` (T, B); with ``keep`` also what BPTT needs."""
    steps, batch = x.shape
    size = recurrent.shape[0]
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    out, saved = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        g = inputs[x[t]] + h @ recurrent
        gates = _sigmoid(g[:, : 3 * size])
        new = np.tanh(g[:, 3 * size :])
        before, c = c, gates[:, size : 2 * size] * c + gates[:, :size] * new
        squashed = np.tanh(c)
        if keep:
            saved.append((h, before, gates, new, squashed))
        h = gates[:, 2 * size :] * squashed
        out[t] = h
    return out, saved


def _back(inputs, recurrent, x, saved, grad):
    """Gradients of one direction from the gradient of its hidden states."""
    steps, batch = x.shape
    size = recurrent.shape[0]
    d_inputs, d_recurrent = np.zeros_like(inputs), np.zeros_like(recurrent)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, gates, new, squashed = saved[t]
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dg = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)), axis=1)
        np.add.at(d_inputs, x[t], dg)
        d_recurrent += h.T @ dg
        dh, dc = dg @ recurrent.T, dc * f
    return d_inputs, d_recurrent


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Model:
    """Two LSTMs, a linear layer, and CRF transitions.  Small: about 5,000 numbers."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"in_f": put(CLASSES, 4 * hidden), "re_f": put(hidden, 4 * hidden), "in_b": put(CLASSES, 4 * hidden), "re_b": put(hidden, 4 * hidden), "out": put(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for k in ("in_f", "in_b"):
            self.p[k][:, hidden : 2 * hidden] += 1  # remember at first

    def _emissions(self, x, keep=False):
        p = self.p
        f, sf = _run(p["in_f"], p["re_f"], x, keep)
        b, sb = _run(p["in_b"], p["re_b"], x[::-1], keep)
        h = np.concatenate((f, b[::-1]), axis=2)
        return h @ p["out"] + p["bias"], (h, sf, sb)

    def step(self, x, y) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags ``y`` (T, B) and its gradients."""
        p, (steps, batch) = self.p, x.shape
        e, (h, sf, sb) = self._emissions(x, True)
        move = p["move"] + _FORBIDDEN
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = e[0] + _START
        for t in range(1, steps):
            alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
        beta[-1] = 0
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
        d_move = pair.sum(axis=(0, 1))
        ti, bi = np.indices(y.shape)
        gold = e[ti, bi, y].sum() + move[y[:-1], y[1:]].sum()
        de[ti, bi, y] -= 1
        np.add.at(d_move, (y[:-1].ravel(), y[1:].ravel()), -1)
        dh = de @ p["out"].T
        size = p["re_f"].shape[0]
        g = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum(axis=(0, 1)), "move": d_move}
        g["in_f"], g["re_f"] = _back(p["in_f"], p["re_f"], x, sf, dh[:, :, :size])
        g["in_b"], g["re_b"] = _back(p["in_b"], p["re_b"], x[::-1], sb, dh[::-1, :, size:])
        return float((z.sum() - gold) / batch), {k: v / batch for k, v in g.items()}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags (B, T) of windows of class ids (B, T), by Viterbi."""
        x = np.ascontiguousarray(x.T)
        e, _ = self._emissions(x)
        move = self.p["move"] + _FORBIDDEN
        score, back = e[0] + _START, []
        for t in range(1, len(e)):
            options = score[:, :, None] + move
            back.append(options.argmax(axis=1).astype(np.int8))
            score = options.max(axis=1) + e[t]
        tags = np.empty(x.shape, np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t - 1][rows, tags[t]]
        return tags.T


@lru_cache(2)
def train(steps: int = STEPS, seed: int = SEED) -> Model:
    """A model trained by Adam on windows of the generator; a function of its arguments alone."""
    model = Model(seed=seed)
    x, y = labelled_windows(steps * 6, LENGTH, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for n in range(1, steps + 1):
        at = rng.integers(0, len(x), BATCH)
        _, grads = model.step(np.ascontiguousarray(x[at].T), np.ascontiguousarray(y[at].T))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = RATE * (1 - n / (steps + 1))
        for k, g in grads.items():
            g = (g * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)
    return model


# -- whole texts -------------------------------------------------------------------------------------------------------


def _windows(text: str) -> set[int]:
    """Numbers of the windows that hold a digit or an at sign, and of their neighbours."""
    stride, found = WINDOW - OVERLAP, set()
    last = max(0, -(-(len(text) - WINDOW) // stride))
    for m in _SIGNAL.finditer(text):
        at = m.start()
        found.update(range(max(0, -(-(at - WINDOW + 1) // stride) - 1), min(last, at // stride + 1) + 1))
    return found


_PHONE, _SEPARATOR = re.compile(r"(\+?\(?[0-9])[0-9 ().-]*[0-9]"), re.compile(r"[ ().-]")


def _accepts(kind: str, found: str) -> bool:
    """Whether a decoded span is personal data of its kind."""
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", found) is not None
    if kind == "ip":
        return PATTERNS["ip"].fullmatch(found) is not None and _holds("ip", found)
    if kind == "card":
        return PATTERNS["card"].fullmatch(found) is not None and _holds("card", found)
    first = _PHONE.fullmatch(found)  # and a separator between its first digit and its last
    return first is not None and _SEPARATOR.search(found, first.end(1), len(found) - 1) is not None and _holds("phone", found)


def _decode(model: Model, texts: list[str], jobs: list[tuple[int, int]], decoded: list[dict[int, np.ndarray]]) -> None:
    """Add the tags of the windows ``jobs`` (text, number) to ``decoded``."""
    stride = WINDOW - OVERLAP
    for k in range(0, len(jobs), _WINDOWS_AT_ONCE):
        part = jobs[k : k + _WINDOWS_AT_ONCE]
        x = np.zeros((len(part), WINDOW), np.uint8)
        for r, (i, n) in enumerate(part):
            c = classes(texts[i][n * stride : n * stride + WINDOW])
            x[r, : len(c)] = c
        for (i, n), row in zip(part, model.decode(x)):
            decoded[i][n] = row[: len(texts[i]) - n * stride]


def _joined(decoded: dict[int, np.ndarray]):
    """(start, tags) of every run of decoded windows; an overlap is shared out at its middle."""
    stride, half = WINDOW - OVERLAP, OVERLAP // 2
    numbers = sorted(decoded)
    k = 0
    while k < len(numbers):
        first = k
        while k + 1 < len(numbers) and numbers[k + 1] == numbers[k] + 1:
            k += 1
        parts = [decoded[n][half if n > numbers[first] else 0 : stride + half if n < numbers[k] else None] for n in numbers[first : k + 1]]
        yield numbers[first] * stride, np.concatenate(parts)
        k += 1


def model_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The accepted (kind number, start, end) of every whole text."""
    decoded: list[dict[int, np.ndarray]] = [{} for _ in texts]
    jobs = [(i, n) for i, t in enumerate(texts) for n in sorted(_windows(t))]
    while jobs:
        _decode(model, texts, jobs, decoded)
        beyond = set()
        for i, n in jobs:  # a tag at the edge of what is decoded: go on there
            row = decoded[i][n]
            if n and n - 1 not in decoded[i] and row[0]:
                beyond.add((i, n - 1))
            if n * (WINDOW - OVERLAP) + WINDOW < len(texts[i]) and n + 1 not in decoded[i] and row[-1]:
                beyond.add((i, n + 1))
        jobs = sorted(beyond)
    return [[span for start, tags in _joined(windows) for span in _tagged(text, start, tags)] for text, windows in zip(texts, decoded)]


def _tagged(text: str, start: int, tags: np.ndarray):
    """The accepted spans of a run of tags that begins at ``start``."""
    marked = np.flatnonzero(tags)
    done = -1
    for at in marked.tolist():
        if at < done:
            continue
        tag = int(tags[at])
        done = at + 1
        while done < len(tags) and tags[done] == (tag + 1 if tag % 2 else tag):
            done += 1
        kind = (tag - 1) // 2
        if _accepts(KINDS[kind], text[start + at : start + done]):
            yield kind, start + at, start + done


def all_spans(model: Model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text; the model adds only where no base span lies."""
    out = []
    for text, added in zip(texts, model_spans(model, texts)):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        extra = [(kind, s, e) for kind, s, e in added if not (k := bisect_left(starts, e)) or ends[k - 1] <= s]
        out.append((base, sorted(base + extra)))
    return out


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans) for every row of ``docs`` (doc_id, text).

    Counts and ``spans`` take base and added spans; ``base_sha256`` and ``base_spans`` are of the base ones.  Null and empty texts have
    no spans; null ids are kept; repeated rows give a row each; an empty table gives none; further columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model or train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans"]

    def run(batches):
        for batch in batches:
            found = all_spans(shipped.value, [t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in spans) for _, spans in found], pa.int64()) for k in range(len(KINDS))]
            base = [_line(base) for base, _ in found]
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *(pa.array(x, pa.string()) for x in (digests, [_line(spans) for _, spans in found], base))], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base_spans string")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model or train())
    where = docs.columns.index("text")

    def clean(text, spans):
        for k, s, e in sorted(spans, key=lambda x: -x[1]):
            text = f"{text[:s]}<{KINDS[k]}>{text[e:]}"
        return text

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found = all_spans(shipped.value, [t or "" for t in texts])
            new = pa.array([None if t is None else clean(t, spans) for t, (_, spans) in zip(texts, found)], pa.string())
            yield batch.set_column(where, batch.schema.field(where).with_type(pa.string()), new)

    return docs.mapInArrow(run, docs.schema)
