"""PII: a character-level bidirectional LSTM with CRF transitions, over exact base patterns.

Base spans (email, ip, card, phone) come from anchored scans that take linear
time on any text and equal the leftmost non-overlapping matches of the patterns
they state, with their checks.  The tagger adds spans beyond those patterns:
spelled-out, defanged and oddly separated forms of the four kinds, and secrets
(keys, tokens and passwords).  It learns from labelled windows of at most
TRAIN_DOCS documents (a documented bound, taken by a hash of the row): windows
around digits and '@', at most WINDOWS_PER_DOC a document, one more from anywhere
in the text, and a few with a span rewritten in another form (`rewritten`); its
labels are the base spans, the rewritten ones and `known_secrets`.  The network
(one character in, BIO labels out, emissions joined by CRF transitions with
forbidden ones barred) is trained in NumPy with Adam in one task on an executor;
its few thousand weights are broadcast.

The whole of every text is decoded, in lanes of LANE characters that overlap by
2 * HALO.  Their labels are stitched in the middle of each overlap into one
sequence a text, from which spans of any length are read.  The network reads every
lane in both directions; best paths are sought only in lanes where an upper bound
(`suspects`) lets one leave "outside", and traced back only where one does.  A span is added if its mean marginal is
at least CONFIDENCE, it overlaps no base span, and what it spells passes the
check of its kind (`plausible`: Luhn, parts below 256, counts of digits, ...).
Base spans always stay.

Edge cases: a null text counts as empty and has no spans; positions are code
points, ends exclusive; equal texts have equal spans, but for added
spans whose confidence lies within rounding (about 1e-4) of CONFIDENCE, which may
differ between machines and batches; repeated rows, null ids
and very long texts need no special case; doc_id is cast to long where rows are
sampled (what cannot be cast is null); a column `pii` of the input is replaced,
all others pass through `tag`; without labelled spans to learn from nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import map_arrow, map_text, slices
from tessera.llm._store import table
from tessera.llm._text import CHUNK_BYTES, buffers, mix

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = 4
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
TRAIN_DOCS = 20000
WINDOWS_PER_DOC = 4
REWRITTEN_PER_DOC = 3
LENGTH, STRIDE = 64, 32
LANE, HALO = 224, 16
LANES = 1024
HIDDEN = 12
EPOCHS, STEPS, BATCH, RATE = 8, 500, 64, 0.02
CONFIDENCE = 0.9
MARGIN = 1e-3
LABELS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    at = text.find("+")
    for m in _PHONE.finditer(text) if at >= 0 else ():
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


#: what labels secrets for training: key ids, and values after a name that says what they are
_SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:token|password|passwd|secret|api[_-]?key)\b[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_/+-]{12,64})(?![A-Za-z0-9_/+-])")


def known_secrets(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the secrets that training labels."""
    return [(4, m.start(m.lastindex or 0), m.end(m.lastindex or 0)) for m in _SECRET.finditer(text)]


_AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", re.I)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+|\s+\.\s+", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plausible(kind: int, said: str) -> bool:
    """Whether what a proposed span spells, read in the plain form of its kind, passes that kind's check."""
    if len(said) > 200:
        return False
    if kind == 0:
        return _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", said))) is not None
    if kind == 1:
        parts = _DOT.sub(".", said).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 4:
        kinds = (any(c.isdigit() for c in said), any(c.isalpha() for c in said))
        return len(said) >= 12 and all(kinds) and not any(c.isspace() for c in said)
    digits = _NOT_DIGIT.sub("", said)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9 ./_-]+[0-9]", said) is not None
    return 8 <= len(digits) <= 15 and re.fullmatch(r"[+(]*[0-9][0-9 ().\/-]*[ ().\/-][0-9 ().\/-]*[0-9]", said) is not None


def rewritten(kind: int, said: str, turn: int) -> str | None:
    """A span of a base kind in another form, chosen by `turn`; None where there is none."""
    if kind == 0:
        at, dot = [(" (at) ", " dot "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" (at) ", " dot "), ("[at]", "(dot)")][turn % 6]
        return said.replace("@", at).replace(".", dot)
    if kind == 1:
        return said.replace(".", ["[.]", " dot ", "(.)", "[dot]"][turn % 4])
    digits = _NOT_DIGIT.sub("", said)
    if kind == 2:
        mark = [".", "/", "_", "  ", " - "][turn % 5]
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3 and len(digits) >= 10:
        mark = ["-", ".", " ", "/"][turn % 4]
        tail = mark.join((digits[-7:-4], digits[-4:]))
        return [f"({digits[-10:-7]}) {tail}", f"{digits[-10:-7]}{mark}{tail}", f"00{digits[:-10]} {digits[-10:-7]} {tail}"][turn // 4 % 3]
    return None


def another_secret(text: str, a: int, b: int, turn: int) -> tuple[str, str]:
    """(what comes before, a made-up secret of the same length) that vary the labelled ones."""
    letters = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"][turn % 3]
    draws = mix(np.arange(b - a, dtype=np.uint64) + np.uint64(turn * 1000 + 1)) % np.uint64(len(letters))
    said = "".join(letters[k] for k in draws.tolist())
    names = ["token=", "token: ", "api_key = \"", "secret: ", "password = ", "pwd=", "bearer ", "key "]
    return names[turn // 3 % len(names)], said


def _alphabet() -> np.ndarray:
    """Code points under 128 to ids: letters folded, digits alike, white space alike; 0 pads, 1 is any other."""
    ids, fresh = np.ones(128, dtype=np.int16), 5
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            ids[c] = 2
        elif ch.isspace():
            ids[c] = 3
        elif ch.isupper():
            continue
        elif c > 32 and c < 127:
            ids[c] = fresh
            fresh += 1
    for c in range(65, 91):
        ids[c] = ids[c + 32]
    return ids


_IDS = _alphabet()
ALPHABET = int(_IDS.max()) + 1


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _IDS[np.minimum(points, 127)], 4).astype(np.int16)


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or '@'."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hits = np.flatnonzero((points < 128) & _TRIGGER[np.minimum(points, 127)]) // STRIDE
    both = np.unique(np.concatenate([hits, hits - 1]))
    return both[both >= 0] * STRIDE if len(points) > STRIDE else np.unique(hits * 0)


def cut_window(ids: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(LENGTH, dtype=np.int16)
    part = ids[start : start + LENGTH]
    out[: len(part)] = part
    return out


class Tagger:
    """BiLSTM-CRF; parameters in `p`, all float32."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN, seed: int = 7) -> None:
        if p is None:
            r = np.random.default_rng(seed)
            p = {}
            for d in "fb":
                p[f"w{d}"] = r.normal(0, 0.3, (ALPHABET, 4 * hidden))
                p[f"u{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden))
                p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
            p["o"] = r.normal(0, 0.2, (2 * hidden, LABELS))
            p["ob"] = np.zeros(LABELS)
            p["a"] = r.normal(0, 0.1, (LABELS, LABELS))
            p["s"] = np.zeros(LABELS)
            p = {k: v.astype(np.float32) for k, v in p.items()}
        self.p, self.hidden = p, len(p["uf"])
        bar = np.zeros((LABELS, LABELS), dtype=np.float32)
        first = np.zeros(LABELS, dtype=np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            bar[:, inside] = -1e4
            bar[inside - 1, inside] = bar[inside, inside] = 0
            first[inside] = -1e4
        self.bar, self.first = bar, first

    def _lstm(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) in reading order; with keep, what backpropagation needs."""
        h_, (t_, b_) = self.hidden, ids.shape
        w, u, c0 = self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"], None
        h = np.zeros((b_, h_), dtype=np.float32)
        c = np.zeros((b_, h_), dtype=np.float32)
        out, memory = np.zeros((t_, b_, h_), dtype=np.float32), []
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            z = w[ids[t]] + h @ u
            gates = 0.5 * np.tanh(0.5 * z[:, : 3 * h_]) + 0.5
            g = np.tanh(z[:, 3 * h_ :])
            i, f, o = gates[:, :h_], gates[:, h_ : 2 * h_], gates[:, 2 * h_ :]
            c0, h0 = c, h
            c = f * c0 + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                memory.append((t, i, f, o, g, c0, tc, h0))
        return out, memory

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """(T, B, LABELS) for ids (T, B)."""
        hf, mf = self._lstm(ids, "f", keep)
        hb, mb = self._lstm(ids, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["o"] + self.p["ob"], (both, mf, mb)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log partition (B), label marginals (T, B, L), forward and backward log sums."""
        a, t_ = self.p["a"] + self.bar, len(e)
        f, b = np.empty_like(e), np.zeros_like(e)
        f[0] = e[0] + self.p["s"] + self.first
        top = a.max(axis=0)
        ea, eat = np.exp(a - top), np.exp(a.T - a.max(axis=1))
        for t in range(1, t_):
            m = f[t - 1].max(axis=1, keepdims=True)
            f[t] = e[t] + top + m + np.log(np.exp(f[t - 1] - m) @ ea + 1e-30)
        for t in range(t_ - 2, -1, -1):
            x = e[t + 1] + b[t + 1]
            m = x.max(axis=1, keepdims=True)
            b[t] = a.max(axis=1) + m + np.log(np.exp(x - m) @ eat + 1e-30)
        m = f[-1].max(axis=1, keepdims=True)
        z = (m + np.log(np.exp(f[-1] - m).sum(axis=1, keepdims=True)))[:, 0]
        return z, np.exp(np.minimum(f + b - z[None, :, None], 0)), f, b

    def loss(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of labels y (T, B) and its gradients."""
        e, (both, mf, mb) = self.emissions(ids, keep=True)
        t_, b_, _ = e.shape
        z, q, f, b = self.marginals(e)
        rows = np.arange(b_)
        a = self.p["a"] + self.bar
        gold = sum(e[t, rows, y[t]] for t in range(t_)) + (self.p["s"] + self.first)[y[0]] + sum(a[y[t - 1], y[t]] for t in range(1, t_))
        de = q.copy()
        ga = np.zeros_like(a)
        for t in range(t_):
            de[t, rows, y[t]] -= 1
            if t:
                pair = f[t - 1][:, :, None] + a + (e[t] + b[t])[:, None, :] - z[:, None, None]
                ga += np.exp(np.minimum(pair, 0)).sum(axis=0)
                np.add.at(ga, (y[t - 1], y[t]), -1)
        de /= b_
        grads = {"a": np.where(self.bar < 0, 0, ga / b_), "s": np.where(self.first < 0, 0, de[0].sum(axis=0)), "ob": de.sum(axis=(0, 1))}
        grads["o"] = both.reshape(t_ * b_, -1).T @ de.reshape(t_ * b_, -1)
        dh = de @ self.p["o"].T
        h_ = self.hidden
        places = (ids.astype(np.intp)[:, :, None] * (4 * h_) + np.arange(4 * h_)).reshape(t_, -1)  # flat, as add.at is faster there
        for d, memory, own in (("f", mf, dh[:, :, :h_]), ("b", mb, dh[:, :, h_:])):
            gw, gu, gc = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(self.p[f"u{d}"]), np.zeros(4 * h_, dtype=np.float32)
            next_h, next_c = np.zeros((b_, h_), dtype=np.float32), np.zeros((b_, h_), dtype=np.float32)
            for t, i, fo, o, g, c0, tc, h0 in reversed(memory):
                x = own[t] + next_h
                dc = x * o * (1 - tc * tc) + next_c
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * fo * (1 - fo), x * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(gw.reshape(-1), places[t], dz.reshape(-1))
                gu += h0.T @ dz
                gc += dz.sum(axis=0)
                next_h, next_c = dz @ self.p[f"u{d}"].T, dc * fo
            grads[f"w{d}"], grads[f"u{d}"], grads[f"c{d}"] = gw, gu, gc
        return float((z - gold).mean()), grads

    def best_scores(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of e (T, L, B): score of the best path that ends in each label at each place (T, L, B), and of the path that stays outside (B)."""
        a = self.p["a"]
        begin = [0, *range(1, LABELS, 2)]
        enter = np.ascontiguousarray(a[:, begin])[:, :, None]
        open_, stay = np.diagonal(a[1::2, 2::2])[:, None], np.diagonal(a[2::2, 2::2])[:, None]
        s = np.empty_like(e)
        s[0] = e[0] + (self.p["s"] + self.first)[:, None]
        outside, keep = s[0, 0].copy(), a[0, 0]
        x, y, z = np.empty((LABELS, len(begin), e.shape[2]), e.dtype), np.empty((len(begin) - 1, e.shape[2]), e.dtype), np.empty((len(begin) - 1, e.shape[2]), e.dtype)
        for t in range(1, len(e)):
            old, new = s[t - 1], s[t]
            np.add(old[:, None, :], enter, out=x)
            best = x.max(axis=0)
            np.add(best[0], e[t, 0], out=new[0])
            np.add(best[1:], e[t, 1::2], out=new[1::2])
            np.add(old[1::2], open_, out=y)
            np.add(old[2::2], stay, out=z)
            np.maximum(y, z, out=y)
            np.add(y, e[t, 2::2], out=new[2::2])
            outside += keep  # summed in the order of the path, so that equal paths have equal scores
            outside += e[t, 0]
        return s, outside

    def plain(self, ids: np.ndarray) -> np.ndarray:
        """Which columns of ids (T, B) have no span on their best path."""
        return self._outside(*self.best_scores(self.fast_emissions(ids)))

    @staticmethod
    def _outside(s: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """The one comparison that parts plain columns from marked ones.  With the margin it does not turn on the last digits
        of a machine's arithmetic; a span that is better by less is about as likely as none, far below CONFIDENCE."""
        return s[-1].max(axis=0) <= outside + MARGIN

    def _walk(self, ids: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """(place, half its hidden states (B, H), overwritten by the next) in the order in which d reads ids (T, B): one product
        and one exponential a step, as NumPy's exponential takes half the time of its tanh.  Gates are kept as what they
        divide by, 1 + exp(-x), that of the input as a quarter of it, and the cell as exp's argument in
        tanh x = 2 * (1 / (1 + exp(-2 x)) - 1 / 2); signs and factors are folded into the weights."""
        h_, (t_, b_) = self.hidden, ids.shape
        fold = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        w = np.ascontiguousarray((self.p[f"w{d}"] + self.p[f"c{d}"]).reshape(-1, 4, h_).swapaxes(0, 1) * fold, dtype=np.float32)
        w[0] -= np.log(np.float32(4))
        u = np.ascontiguousarray(self.p[f"u{d}"].reshape(h_, 4, h_).swapaxes(0, 1) * (2 * fold), dtype=np.float32)
        h, c = np.zeros((b_, h_), np.float32), np.zeros((b_, h_), np.float32)
        z, x = np.empty((4, b_, h_), np.float32), np.empty((4, b_, h_), np.float32)
        i, f, o, g = z
        half, one = np.array(0.5, np.float32), np.array(1, np.float32)  # a Python number costs a call a microsecond more
        ones = np.array([0.25, 1, 1, 1], np.float32)[:, None]
        flat = z.reshape(4, -1)
        ids = ids.astype(np.intp)
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            w.take(ids[t], 1, x, "clip")
            np.matmul(h, u, out=z)
            z += x
            np.exp(z, out=z)
            flat += ones
            np.reciprocal(g, out=g)
            np.subtract(half, g, out=g)
            g /= i
            c /= f
            c += g  # minus twice the cell
            np.exp(c, out=h)
            h += one
            np.reciprocal(h, out=h)
            h -= half
            h /= o
            yield t, h

    def fast_emissions(self, ids: np.ndarray) -> np.ndarray:
        """As emissions, but (T, L, B)."""
        h_, (t_, b_) = self.hidden, ids.shape
        both = np.empty((t_, b_, 2 * h_), np.float32)
        with np.errstate(over="ignore"):  # an infinite exponential is a closed gate
            for k, d in enumerate("fb"):
                for t, h in self._walk(ids, d):
                    both[t, :, k * h_ : (k + 1) * h_] = h
        e = np.matmul(np.ascontiguousarray(2 * self.p["o"].T), both.transpose(0, 2, 1))
        e += self.p["ob"][:, None]
        return e

    def suspects(self, ids: np.ndarray) -> np.ndarray:
        """Which columns of ids (T, B) may have a span on their best path; the others have none, whatever the text.

        Every character is read in both directions.  In place of the best path into each label, the way back bounds what any
        path can gain over the one that stays outside: after a place outside (`free`) or in any label (`held`), from the best
        of the labels at each place with the best transition into each.  Where even that bound gains nothing, no span can."""
        h_, (t_, b_), a = self.hidden, ids.shape, self.p["a"] + self.bar - self.p["a"][0, 0]
        n, order = len(KINDS), [*range(1, LABELS, 2), *range(2, LABELS, 2)]
        enter, stay = a[0, 1::2], np.maximum(np.diagonal(a[1::2, 2::2]), np.diagonal(a[2::2, 2::2]))
        again, leave = np.array((a[1:, 1::2].max(axis=0) - enter).max()), np.array(a[1:, 0].max())
        begin = (self.p["s"][1::2] - self.p["s"][0] - enter).max()
        o = np.ascontiguousarray(2 * (self.p["o"] - self.p["o"][:, :1])[:, order].T)
        ob = (self.p["ob"][order] - self.p["ob"][0] + np.concatenate([enter, stay]))[:, None]
        gain, own, best = (np.empty((*k, b_), np.float32) for k in ((t_, 2 * n), (2 * n,), (2,)))
        first, inside = best
        free, held = np.zeros(b_, np.float32), np.zeros(b_, np.float32)
        with np.errstate(over="ignore"):  # an infinite exponential is a closed gate
            for t, h in self._walk(ids, "f"):
                np.matmul(o[:, :h_], h.T, out=gain[t])
            for t, h in self._walk(ids, "b"):
                np.matmul(o[:, h_:], h.T, out=own)
                own += gain[t]
                own += ob
                np.maximum.reduce(own.reshape(2, n, b_), axis=1, out=best)
                if t:
                    np.maximum(inside, first + again, out=inside)
                    best += held
                    np.maximum(free + leave, inside, out=held)
                    np.maximum(free, first, out=free)
        return np.maximum(free, first + begin + held) > 0

    def spans_of(self, ids: np.ndarray, all_: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns whose best path holds a span, their best labels (T, m) by Viterbi, their marginals (T, m)); all columns if all_."""
        e = self.fast_emissions(ids)
        s, outside = self.best_scores(e)
        plain = self._outside(s, outside)
        at = np.arange(ids.shape[1]) if all_ else np.flatnonzero(~plain)
        if not len(at):
            return at, np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.float32)
        y, into = np.empty((len(ids), len(at)), dtype=np.int64), (self.p["a"] + self.bar).T
        s = s[:, :, at]
        y[-1] = s[-1].argmax(axis=0)
        for t in range(len(ids) - 1, 0, -1):
            y[t - 1] = (s[t - 1].T + into[y[t]]).argmax(axis=1)
        y[:, plain[at]] = 0
        # in double precision, as sums of hundreds of scores in single precision move marginals by the width of the batch
        _, q, _, _ = self.marginals(np.ascontiguousarray(e[:, :, at].transpose(0, 2, 1), dtype=np.float64))
        return at, y, np.take_along_axis(q, y[:, :, None], axis=2)[:, :, 0]

    def decode(self, ids: np.ndarray, all_: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (T, B) and their marginals (zero in columns without spans unless all_)."""
        y, q = np.zeros(ids.shape, dtype=np.int64), np.zeros(ids.shape, dtype=np.float32)
        at, own, sure = self.spans_of(ids, all_)
        y[:, at], q[:, at] = own, sure
        return y, q


def fit_tagger(ids: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Tagger:
    """Adam over windows ids (N, T) with labels (N, T), in a fixed order of shuffles."""
    model, r = Tagger(seed=seed), np.random.default_rng(seed)
    epochs = max(epochs, -(-STEPS // max(1, -(-len(ids) // BATCH))))  # few windows are read more often
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, total = 0, max(1, epochs * -(-len(ids) // BATCH))
    for _ in range(epochs):
        order = r.permutation(len(ids))
        for k in range(0, len(ids), BATCH):
            at = order[k : k + BATCH]
            _, grads = model.loss(np.ascontiguousarray(ids[at].T), np.ascontiguousarray(labels[at].T))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / max(size, 1e-9))
            step += 1
            rate = RATE * (1 - step / (total + 1)) + 1e-4
            for name, g in grads.items():
                g = (g * scale).astype(np.float32)
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                model.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and known secrets that overlap none."""
    spans = base_spans(text)
    return spans + [x for x in known_secrets(text) if all(x[2] <= a or b <= x[1] for _, a, b in spans)]


def training_windows(text: str, most: int = WINDOWS_PER_DOC) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, labels) of up to `most` windows of a text, those that hold whole labelled spans first; some spans in other forms."""
    spans, starts = labelled(text), window_starts(text)
    ids = encode(text)
    labels = np.zeros(len(ids) + LENGTH, dtype=np.int8)
    for kind, a, b in reversed(spans):
        labels[a:b] = 2 + 2 * kind
        labels[a] = 1 + 2 * kind
    ranked = sorted(starts.tolist(), key=lambda s: (-sum(s <= a and b <= s + LENGTH for _, a, b in spans), s))
    out = []
    rest = np.setdiff1d(np.arange(0, max(1, len(ids) - STRIDE), STRIDE), ranked[:most])
    anywhere = [int(rest[len(ids) * 7919 % len(rest)])] if most and len(rest) else []
    for s in ranked[:most] + anywhere:
        y = labels[s : s + LENGTH].copy()
        inside = y.copy()
        while len(inside) and inside[0] and inside[0] % 2 == 0:  # a span cut by the left edge cannot be told
            n = int(np.argmax(inside != inside[0])) or len(inside)
            y[:n] = 0
            break
        out.append((cut_window(ids, s), y))
    turn = len(ids) + sum(a for _, a, _ in spans)
    for k, (kind, a, b) in enumerate(spans[:REWRITTEN_PER_DOC] if most else []):
        name, said = another_secret(text, a, b, turn + k) if kind == 4 else ("", rewritten(kind, text[a:b], turn + k))
        before = text[max(0, a - 10) : a]
        before = before.rstrip("\"'=: ") + " " + name if name else before
        if said and len(before) + len(said) < LENGTH:
            y = np.zeros(LENGTH, dtype=np.int8)
            y[len(before) : len(before) + len(said)] = 2 + 2 * kind
            y[len(before)] = 1 + 2 * kind
            out.append((cut_window(encode(before + said + text[b : b + 10]), 0), y))
    return out


def reconcile(text: str, base: list[tuple[int, int, int]], starts: np.ndarray, y: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """Added spans of a text from its decoded windows, stitched in the middle of their overlaps; y, q: (windows, T)."""
    n, size = len(text), y.shape[1]
    labels, sure, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.float32), 0
    for s, label, mean in zip(starts.tolist(), y, q):
        lo, hi = max(s, (s + end) // 2), min(s + size, n)
        labels[lo:hi], sure[lo:hi] = label[lo - s : hi - s], mean[lo - s : hi - s]
        end = hi
    out = []
    for t in np.flatnonzero(labels % 2).tolist():
        e = t + 1
        while e < n and labels[e] == labels[t] + 1:
            e += 1
        kind = int(labels[t] - 1) // 2
        if float(sure[t:e].mean()) >= CONFIDENCE and all(e <= c or d <= t for _, c, d in base):
            out.append((kind, t, e))
    return out


def lane_starts(n: int) -> np.ndarray:
    """Starts of the lanes that cover n characters."""
    core = LANE - 2 * HALO
    return np.arange(max(1, -(-(n - 2 * HALO) // core)) if n else 0) * core


def find(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of every text."""
    out: list[tuple[list, list]] = [(base_spans(text), []) for text in texts]
    if model is None:
        return out
    ids = [encode(text) for text in texts]
    starts = [lane_starts(len(x)) for x in ids]
    many = np.array([len(x) for x in starts], dtype=np.int64)
    length = np.array([len(x) for x in ids], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(texts)), many)
    if not len(owner):
        return out
    flat, at = np.concatenate([*ids, np.zeros(LANE, np.int16)]), np.concatenate(starts)
    begin = (np.cumsum(length) - length)[owner] + at
    size = np.minimum(LANE, length[owner] - at)
    width = np.minimum(LANE, -(-size // STRIDE) * STRIDE)  # a function of the text alone, so equal texts have equal spans
    found: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for w in np.unique(width).tolist():
        windows = np.lib.stride_tricks.sliding_window_view(flat, w)

        def cut(k: np.ndarray, w=w, windows=windows) -> np.ndarray:
            part = np.ascontiguousarray(windows[begin[k]].T)
            if (size[k] < w).any():
                part[np.arange(w)[:, None] >= size[k]] = 0
            return part

        lanes = np.flatnonzero(width == w)
        lanes = np.concatenate([k[model.suspects(cut(k))] for k in (lanes[a : a + LANES] for a in range(0, len(lanes), LANES))])
        for k in (lanes[a : a + LANES] for a in range(0, len(lanes), LANES)):
            for j, y, q in zip(*(x.T for x in model.spans_of(cut(k)))):
                found.setdefault(int(owner[k[j]]), {})[int(k[j])] = (y, q)
    for k, lanes in found.items():
        a, b = int(first[k]), int(first[k + 1])
        y, q = np.zeros((b - a, LANE), dtype=np.int64), np.zeros((b - a, LANE), dtype=np.float32)
        for j, (own, sure) in lanes.items():
            y[j - a, : len(own)], q[j - a, : len(own)] = own, sure
        proposed = reconcile(texts[k], out[k][0], starts[k], y, q)
        out[k] = (out[k][0], [(kind, c, d) for kind, c, d in proposed if plausible(kind, texts[k][c:d])])
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = buffers(part.column("text"))
            at = np.searchsorted(np.flatnonzero(_TRIGGER[raw]), offsets)
            rows = []
            for k in np.flatnonzero(np.diff(at)).tolist():
                rank = part.column("rank")[k].as_py()
                rows += [(rank, x.tobytes(), y.tobytes()) for x, y in training_windows(part.column("text")[k].as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["rank", "ids", "labels"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["rank"], r["ids"], r["labels"]) for b in batches for r in b.to_pylist())
    blob, names = [], []
    if any(any(r[2]) for r in rows):
        ids = np.stack([np.frombuffer(r[1], np.int16) for r in rows])
        labels = np.stack([np.frombuffer(r[2], np.int8) for r in rows]).astype(np.int64)
        model = fit_tagger(ids, labels)
        names, blob = list(model.p), [model.p[k].tobytes() for k in model.p]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blob, pa.binary())], names=["name", "weights"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Tagger | None:
    """The tagger, from windows of about train_docs documents, taken by a hash of their rows; None if they hold no labelled
    span.  Its bound holds whatever the ids: the windows of a row come or stay by the row's own hash, and at most
    train_docs * (WINDOWS_PER_DOC + 1 + REWRITTEN_PER_DOC) windows are learnt, in one task."""
    share = train_docs / max(1, docs.count())
    rank = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.select(rank.alias("rank"), "text").where("text is not null")
    if share < 1:
        rows = rows.where(F.col("rank") < -(2**63) + int(2**64 * share))
    windows = map_arrow(rows, _windows, "rank long, ids binary, labels binary")
    # equal rows have equal windows, so which of them a cut at the bound takes does not matter
    windows = windows.orderBy("rank", "ids", "labels").limit(train_docs * (WINDOWS_PER_DOC + 1 + REWRITTEN_PER_DOC)).coalesce(1)
    got = {r["name"]: r["weights"] for r in map_arrow(windows, _learn, "name string, weights binary").collect()}
    if not got:
        return None
    shapes = {k: v.shape for k, v in Tagger().p.items()}
    return Tagger({k: np.frombuffer(got[k], np.float32).reshape(shapes[k]) for k in shapes})


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
FIELDS = [T.StructField("pii", T.ArrayType(SPAN))]


def _tag(params: dict[str, np.ndarray] | None):
    def make():
        model = Tagger(params) if params is not None else None

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            column = batch.column("text")
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            for k, (base, added) in enumerate(find([x or "" for x in column.to_pylist()], model)):
                both = sorted([(*x, True) for x in base] + [(*x, False) for x in added])
                spans[k] = [{"kind": KINDS[kind], "start": a, "end": b, "base": own} for kind, a, b, own in both]
            return {"pii": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))}

        return work

    return make


def tag(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """docs plus pii: spans (kind, start, end, base), by kind as in KINDS, then start."""
    # larger batches fill the last lanes of texts, dealt by width, and the few lanes that are traced back
    return map_text(docs, docs.columns, FIELDS, _tag(model.p if model else None), limit=4 * CHUNK_BYTES)


def redact(tagged: DataFrame) -> DataFrame:
    """docs with every span of pii replaced by its kind in brackets; of overlapping spans the first counts."""
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        said = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(said.alias("out"), s["end"].alias("at")))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return tagged.withColumn("text", F.when(F.size("pii") > 0, rest).otherwise(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tag(docs, fit(docs))

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(F.filter("pii", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:BASE_KINDS]],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
