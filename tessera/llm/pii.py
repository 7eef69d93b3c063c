"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans: those that the base patterns find in a bounded sample of
documents, and written-out forms of the same kinds (`variants`) that the patterns don't cover, such as local phone
numbers, cards in other groups, spaced or bracketed addresses, "at" and "dot". A text is cut into overlapping windows;
each is decoded by Viterbi, pieces of one span that two windows cut are joined, and the spans of all windows of a text
are reconciled globally by weighted interval scheduling. A span of the tagger is added if it overlaps no base span and
each of its characters' tags has the probability `sure` under the CRF, and what it holds can be of its kind
(`possible`): no network of this size learns a check digit.

Every kind that the tagger learns holds a digit, an @, a bracketed "at" or the word "dot" (GATE), so a window without
one is outside every span and needs no network. A span of up to half a window is seen whole; a longer one is found if
each window that it touches holds such a mark.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; repeated rows get
equal results; of overlapping spans with equal weight the one that ends first counts; other columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GATE = re.compile(r"[@0-9]|[\[({] ?at ?[\])}]|\bdot\b", re.I)
AT = re.compile(r"@|[\[({] ?at ?[\])}]|\bat\b.*\bdot\b", re.I | re.S)
DIGIT = re.compile(r"[0-9]")


def luhn(digits: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def _digits(s: str) -> list[int]:
    return [int(d) for d in DIGIT.findall(s)]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it that no match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            used = m.end()
            yield start, used
        at = text.find("@", max(at + 1, used))


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind and start."""
    found: list[Span] = [("email", *span) for span in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# The tagger

TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
MARKS = "@.-+() _%\n,:/[]#$&*!|\"'={}"
LETTERS = "atdo"  # those of the words at and dot; other letters are alike
SYMBOLS = 6 + len(MARKS) + len(LETTERS)


def _symbol_table() -> np.ndarray:
    """Symbol number of each code point under 128; 0 is padding, 4 other signs, 5 what isn't ASCII."""
    out = np.full(128, 4, np.int8)
    out[48:58], out[97:123], out[65:91] = 1, 2, 3
    for i, c in enumerate(MARKS + LETTERS):
        out[ord(c)] = out[ord(c.upper())] = 6 + i
    return out


TABLE = _symbol_table()


def symbols(piece: str, length: int) -> np.ndarray:
    c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(length, np.int8)
    out[: len(c)] = np.where(c < 128, TABLE[np.minimum(c, 127)], 5)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Settings:
    window: int = 96
    stride: int = 48
    hidden: int = 20
    inputs: int = 12
    sample: int = 600  # documents
    windows: int = 2000  # of the sample
    variants: int = 4000
    steps: int = 600
    batch: int = 48
    sure: float = 0.6


class Tagger:
    """Bidirectional LSTM over symbols, a linear layer, and a CRF over TAGS."""

    def __init__(self, settings: Settings, seed: int = 3):
        rng, h, d, k = np.random.default_rng(seed), settings.hidden, settings.inputs, len(TAGS)
        self.settings, self.h = settings, h
        self.p = {"E": rng.normal(0, 0.5, (SYMBOLS, d)), "out": rng.normal(0, 0.2, (2 * h, k)), "bias": np.zeros(k), "trans": np.zeros((k, k))}
        for side in "fb":
            self.p |= {f"x{side}": rng.normal(0, 0.3, (d, 4 * h)), f"h{side}": rng.normal(0, 0.2, (h, 4 * h)), f"c{side}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}
        self.p = {name: v.astype(np.float32) for name, v in self.p.items()}
        self.allowed = np.array([[a == b or b == "O" or b[0] == "B" or a[2:] == b[2:] for b in TAGS] for a in TAGS])

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.p[f"{name}{side}"] for side in "fb"])

    def _table(self) -> np.ndarray:
        """What each symbol adds to the gates of each direction [2, symbol, 4 hidden]."""
        return self.p["E"] @ self._both("x") + self._both("c")[:, None]

    def _run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of both directions [time, batch, 2 hidden], which take their steps together; x: symbols [batch, time]."""
        n, m, length = self.h, *x.shape
        h = c = np.zeros((2, m, n), np.float32)
        table, hidden, side = self._table(), self._both("h"), np.arange(2)[:, None]
        out = np.empty((length, m, 2 * n), np.float32)
        for t in range(length):
            now = np.stack([x[:, t], x[:, -1 - t]])
            a = table[side, now] + h @ hidden
            gates, g = _sigmoid(a[..., : 3 * n]), np.tanh(a[..., 3 * n :])
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((now, h, before, i, f, o, g, tc))
            h = o * tc
            out[t, :, :n], out[-1 - t, :, n:] = h
        return out

    def _back(self, kept: list, dout: np.ndarray, grad: dict) -> None:
        """Adds the gradients of the LSTM, given that of its hidden states."""
        n, dh, dc, hidden = self.h, 0, 0, self._both("h")
        dhidden, turned = np.zeros_like(hidden), hidden.transpose(0, 2, 1).copy()
        dtable, every = np.zeros((2, SYMBOLS, 4 * n), hidden.dtype), np.eye(SYMBOLS, dtype=hidden.dtype)
        for t in range(len(kept) - 1, -1, -1):
            now, h, before, i, f, o, g, tc = kept[t]
            dh = dh + np.stack([dout[t, :, :n], dout[-1 - t, :, n:]])
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dtable += every[now].transpose(0, 2, 1) @ da
            dhidden += h.transpose(0, 2, 1) @ da
            dh, dc = da @ turned, dc * f
        for k, side in enumerate("fb"):
            grad[f"h{side}"] += dhidden[k]
            grad[f"c{side}"] += dtable[k].sum(axis=0)
            grad["E"] += dtable[k] @ self.p[f"x{side}"].T
            grad[f"x{side}"] += self.p["E"].T @ dtable[k]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._run(x) @ self.p["out"] + self.p["bias"]

    def _trans(self) -> np.ndarray:
        return np.where(self.allowed, self.p["trans"], -1e4)

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over all paths, scaled to 1 at each time: probabilities of each tag at each place [time, batch, tag],
        expected numbers of each pair of tags, and the log of the sum over all paths [batch]."""
        top, move = e.max(axis=2, keepdims=True), np.exp(self._trans().astype(np.float64))
        weight = np.exp(e.astype(np.float64) - top)
        a, b, scale = np.empty_like(weight), np.ones_like(weight), np.empty((*weight.shape[:2], 1))
        for t in range(len(e)):
            a[t] = weight[t] * (a[t - 1] @ move if t else 1)
            scale[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= scale[t]
        back = move.T.copy()
        for t in range(len(e) - 2, -1, -1):
            b[t] = (weight[t + 1] * b[t + 1] / scale[t + 1]) @ back
        pairs = move * np.tensordot(a[:-1], weight[1:] * b[1:] / scale[1:], ((0, 1), (0, 1)))
        return a * b, pairs, (np.log(scale) + top).sum(axis=(0, 2))

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags y [batch, time] and its gradient."""
        kept: list[tuple] = []
        both = self._run(x, kept)
        e = both @ self.p["out"] + self.p["bias"]
        de, pairs, total = self._sums(e)
        trans, m = self._trans(), len(x)
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        rows, yt = np.arange(m), y.T
        gold = e[np.arange(len(e))[:, None], rows[None], yt].sum(axis=0) + trans[yt[:-1], yt[1:]].sum(axis=0)
        de = de.astype(e.dtype)
        de[np.arange(len(e))[:, None], rows[None], yt] -= 1
        grad["trans"] += pairs
        np.subtract.at(grad["trans"], (yt[:-1].ravel(), yt[1:].ravel()), 1)
        de /= m
        grad["trans"] /= m
        flat = de.reshape(-1, de.shape[2])
        grad["out"], grad["bias"] = both.reshape(-1, 2 * self.h).T @ flat, flat.sum(axis=0)
        self._back(kept, de @ self.p["out"].T, grad)
        return float((total - gold).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Tagger:
        """Adam over random batches."""
        rng, s = np.random.default_rng(seed), self.settings
        m, v = ({name: np.zeros_like(p) for name, p in self.p.items()} for _ in range(2))
        for k in range(1, s.steps + 1):
            at = rng.integers(0, len(x), min(s.batch, len(x)))
            _, grad = self.step(x[at], y[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                rate = 0.03 * (1 - 0.9 * k / s.steps)
                self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags [batch, time] and the probability of each tag taken."""
        e, trans = self.scores(x), self._trans()
        best, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            options = best[:, :, None] + trans[None]
            back[t] = options.argmax(axis=1)
            best = e[t] + options.max(axis=1)
        tags = np.empty((len(x), len(e)), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(len(x)), tags[:, t]]
        p = self._sums(e)[0]
        return tags, p[np.arange(len(e))[None], np.arange(len(x))[:, None], tags]


def tags_of(spans: list[Span], start: int, length: int) -> np.ndarray:
    """Tags of the window [start, start + length) under the labelled spans that lie wholly in it."""
    out = np.zeros(length, np.int64)
    for kind, s, e in spans:
        if start <= s and e <= start + length and not out[s - start : e - start].any():
            out[s - start : e - start] = TAGS.index(f"I-{kind}")
            out[s - start] = TAGS.index(f"B-{kind}")
    return out


def written(rng: np.random.Generator) -> tuple[str, str]:
    """A kind and a span of it, in a form with or without the base patterns' marks."""
    pick = lambda *options: options[rng.integers(len(options))]
    word = lambda least=2: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, 9)))
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    kind = pick(*KINDS)
    if kind == "email":
        name = pick(word(), f"{word()}.{word()}", word() + number(2), f"{word()}_{word()}", f"{word()}.{number(2)}")
        at = pick("@", " @ ", "[@]", "(@)", " (@) ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " at ")
        dot = pick(" dot ", "(dot)", " [dot] ") if at == " at " else pick(".", ".", " . ", "[.]", " dot ", "(dot)", "[dot]")
        if at == "{at}":
            dot = pick("{dot}", ".")
        parts = [pick(word(), word() + number(1)), *([word()] if rng.random() < 0.4 else []), pick("com", "org", "net", "de", "io", "fr", "es", "edu")]
        out = name + at + dot.join(parts)
        return kind, out.upper() if rng.random() < 0.1 else out
    if kind == "ip":
        return kind, pick(".", " . ", "[.]", "(.)", "[dot]", " dot ").join(str(v) for v in rng.integers(0, 256, 4))
    if kind == "card":
        d = [int(c) for c in pick("4", "5", "37", "6") + number(14)][:15]
        d.append(next(c for c in range(10) if luhn([*d, c])))
        s = "".join(map(str, d))
        return kind, pick(" ", "-", ".", "  ", " - ", "_", "/", ".").join([s[:4], s[4:8], s[8:12], s[12:]])
    a, b, c = number(3), number(3), number(4)
    form = rng.integers(11)
    if form < 2:
        return kind, pick(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}")
    return kind, (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"(0{a}) {b} {c}", f"0{a}/{b}{c}", f"00{rng.integers(30, 50)} {a} {b}{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}")[form - 2]


def other(rng: np.random.Generator) -> str:
    """Something that has marks of the kinds and is none of them."""
    pick = lambda *options: options[rng.integers(len(options))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8)))
    n = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    token = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(12, 50)))
    forms = (
        lambda: n(rng.integers(1, 9)), lambda: n(rng.integers(9, 24)), lambda: f"{n(4)}-{n(2)}-{n(2)}", lambda: f"{n(2)}.{n(2)}.{n(4)}", lambda: f"{n(2)}/{n(2)}/{n(4)}", lambda: f"{n(2)}:{n(2)}:{n(2)}",
        lambda: f"{n(1)}.{n(2)}", lambda: f"v{n(1)}.{n(1)}.{n(1)}", lambda: f"{n(1)}.{n(1)}", lambda: token, lambda: f'token = "{token}"', lambda: f"@{word()}", lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"${n(3)}.{n(2)}",
        lambda: f"{n(2)}-{n(2)}", lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"({n(2)})", lambda: f"{word()} at {word()} dot", lambda: f"the dot {word()}", lambda: f"{word()} (at) {word()}", lambda: f"no. {n(3)} and {n(4)}", lambda: f"{n(3)}%", lambda: f"{n(1)} {n(1)} {n(1)} {n(1)}",
        lambda: f"{n(4)}-{n(4)}-{n(4)}", lambda: f"{n(rng.integers(1, 4))}.{n(3)}.{n(3)}", lambda: pick(" ", ", ", "-").join(pick("19", "20") + n(2) for _ in range(rng.integers(2, 6))), lambda: f"{n(4)}-{n(4)}", lambda: f"p. {n(2)}-{n(3)}", lambda: ".".join(n(2) for _ in range(5)), lambda: f"{word()} @ {n(2)}", lambda: f"{word()}-{n(3)}-{word()}",
    )
    return pick(*forms)()


def variants(settings: Settings, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows written by rule: words, spans of the kinds, and what looks like them."""
    rng, x, y = np.random.default_rng(seed), [], []
    pick = lambda *options: options[rng.integers(len(options))]
    for _ in range(settings.variants):
        text, spans, shout = "", [], rng.random() < 0.1
        junk = pick(("",), ("", "", "", ",", "."), ("", "", "", ",", "."), ("***", "###", "&&&", "%%%", "$$$"), ("!!",))
        while len(text) < settings.window + 24:
            what = rng.integers(10)
            if what < 2:
                kind, s = written(rng)
                spans.append((kind, len(text), len(text) + len(s)))
            elif what < 4:
                s = other(rng)
            else:
                s = "".join(pick(*"abcdefghijklmnopqrstuvwxyzéüñßaeiotnrdo") for _ in range(rng.integers(1, 10)))
                s = s.upper() if shout else s.capitalize() if rng.random() < 0.15 else s
            text += s + pick(*junk) + pick(" ", " ", " ", " ", "\n")
        start = int(rng.integers(0, 24))
        length = settings.window if rng.random() < 0.7 else int(rng.integers(1, settings.window))  # some are the end of a text
        x.append(symbols(text[start : start + length], settings.window))
        y.append(np.concatenate([tags_of(spans, start, length), np.zeros(settings.window - length, np.int64)]))
    return np.array(x), np.array(y)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Tagger:
    """A tagger trained on the variants and on at most settings.windows windows of at most settings.sample documents.

    Windows of documents are around base spans; those with further marks are left out, as what they hold has no label.
    """
    width = settings.window

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b["_rank"], b["text"]):
                spans = base_spans(t)
                for at in sorted({max(0, (s + e - width) // 2) for _, s, e in spans[:8]}):
                    marks = (at + m.start() for m in GATE.finditer(t[at : at + width]))
                    if all(any(s <= m < e for _, s, e in spans) for m in marks):  # nothing whose label is unknown
                        out.append((key, at, symbols(t[at : at + width], width).tobytes(), tags_of(spans, at, width).astype(np.int8).tobytes()))
            yield pd.DataFrame(out, columns=["key", "at", "x", "y"])

    rank = F.xxhash64("doc_id", F.lit(3)).alias("_rank")
    chosen = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", rank).orderBy("_rank", "doc_id").limit(settings.sample)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(label, "key long, at long, x binary, y binary")
    rows = sample.orderBy("key", "at", "x").limit(settings.windows).collect()
    x, y = variants(settings)
    if rows:
        x = np.concatenate([x, np.array([np.frombuffer(r["x"], np.int8) for r in rows])])
        y = np.concatenate([y, np.array([np.frombuffer(r["y"], np.int8) for r in rows], dtype=np.int64)])
    return Tagger(settings).train(x, y)


def reconcile(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The set of spans without overlap that has the most weight (probability x length), from those of all windows."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends, best, taken = [s[2] for s in found], [0.0], []
    for k, (_, start, end, p) in enumerate(found):
        before = bisect_right(ends, start, 0, k)
        with_it = best[before] + p * (end - start)
        taken.append((with_it > best[-1], before))
        best.append(max(best[-1], with_it))
    out, k = [], len(found)
    while k:
        use, before = taken[k - 1]
        if use:
            out.append(found[k - 1])
        k = before if use else k - 1
    return out[::-1]


Piece = tuple[str, int, int, float, bool, bool]  # kind, start, end, probability, cut on the left, cut on the right


def joined(pieces: list[Piece]) -> list[tuple[str, int, int, float]]:
    """The whole spans, and those that pieces of one kind make which windows cut and which overlap."""
    whole = [p[:4] for p in pieces if not p[4] and not p[5]]
    cut = sorted({p for p in pieces if p[4] or p[5]}, key=lambda p: (p[0], p[1], p[2]))
    held: Piece | None = None
    for p in cut:
        if held and held[0] == p[0] and held[5] and p[4] and p[1] < held[2] <= p[2]:
            held = (held[0], held[1], p[2], min(held[3], p[3]), held[4], p[5])
            if not held[4] and not held[5]:
                whole.append(held[:4])
        elif not p[4]:
            held = p
    return whole


def possible(kind: str, span: str) -> bool:
    """Whether a span can be of the kind: an email has an at, a card's 13 to 19 digits pass Luhn, an address has four parts up to 255, a phone 7 to 15 digits."""
    if kind == "email":
        return bool(AT.search(span))
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d := _digits(span)) <= 19 and luhn(d)
    return 7 <= len(_digits(span)) <= 15


def tagged(texts: list[str], tagger: Tagger, gate: bool = True) -> list[list[tuple[str, int, int, float]]]:
    """The reconciled spans of the tagger in each text."""
    s = tagger.settings
    places = []
    for i, t in enumerate(texts):
        starts = set() if gate else set(range(-(-len(t) // s.stride)))
        for m in GATE.finditer(t) if gate else ():
            k = m.start() // s.stride
            starts |= {k, max(0, k - 1)}
        places += [(i, k * s.stride) for k in sorted(starts)]
    found: list[list[Piece]] = [[] for _ in texts]
    for part in range(0, len(places), 2048):
        these = places[part : part + 2048]
        x = np.array([symbols(texts[i][at : at + s.window], s.window) for i, at in these])
        tags, p = tagger.decode(x)
        for row in np.flatnonzero(tags.any(axis=1)):
            i, at = these[row]
            end, n, t = 0, min(s.window, len(texts[i]) - at), tags[row]
            while end < n:
                start = end
                end += 1
                if t[start]:
                    while end < n and t[end] == 2 * ((t[start] + 1) // 2):
                        end += 1
                    found[i].append((KINDS[(t[start] - 1) // 2], at + start, at + end, round(float(p[row, start:end].min()), 6), not start and at > 0, end == s.window and at + end < len(texts[i])))
    return [reconcile([p for p in joined(f) if possible(p[0], t[p[1] : p[2]])]) for t, f in zip(texts, found)]


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, both by kind and start."""
    out = []
    for t, found in zip(texts, tagged(texts, tagger)):
        base = base_spans(t)
        covered = sorted((s, e) for _, s, e in base)
        starts, reach = [s for s, _ in covered], np.maximum.accumulate([0, *[e for _, e in covered]])
        more = [(k, s, e) for k, s, e, p in found if p >= tagger.settings.sure and reach[bisect_right(starts, e - 1)] <= s]
        out.append((base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def spans(text: Column, tagger: Tagger) -> Column:
    """Struct of counts of base spans, their digest, and all spans written as kind:start:end."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        written = lambda these: ",".join(f"{k}:{s}:{e}" for k, s, e in these)
        for texts in batches:
            rows = []
            for base, every in all_spans([t or "" for t in texts], tagger):
                kinds = [k for k, *_ in base]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find(text)


def find_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, the counts and digest of base spans, and all spans."""
    tagger = fit(docs, settings)
    return docs.select("doc_id", spans(F.col("text"), tagger).alias("s")).select("doc_id", "s.*")
