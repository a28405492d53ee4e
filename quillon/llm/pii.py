"""Personal data by fixed patterns and by a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IP numbers, payment cards and phone numbers in their usual forms. The network, trained
in numpy on generated labelled spans, finds other forms (written-out addresses, defanged numbers, cards and phones with
unusual separators) and secrets (passwords, tokens, access keys). A text is cut into overlapping windows; each is read by
the network and decoded by Viterbi, every character takes its tag from the window in which it lies farthest from an edge,
and runs of one kind over the whole text, widened to whole words, become spans. A window whose best path is provably
outside all along isn't decoded. Spans of the network are kept if they hold what their kind needs and touch no span of the
patterns.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, released

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS) + 1  # the network's own kind
TAGS = SECRET + 1  # 0: outside

# --- fixed patterns ---------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; time is linear, as the local part has no @."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            # Nothing before this @ can be part of a later match.
            done = at + 1
            at = text.find("@", done)
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the patterns for each kind; matches that fail their check are dropped and not tried again."""
    out: list[list[tuple[int, int]]] = [_emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        out[1] = [m.span() for m in _IP.finditer(text) if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- labelled spans for the fit --------------------------------------------

_SINGLE = "0@.+-()_%\n ,:/=\"[]{}!#*|;'$&?<>"
_CODE = np.full(256, 1, np.uint8)  # 1: other characters below 256
for _i, _c in enumerate(_SINGLE):
    _CODE[ord(_c)] = 2 + _i
_CODE[ord("0") : ord("9") + 1] = _CODE[ord("0")]
_FIRST_LETTER = 2 + len(_SINGLE)
for _i in range(26):
    _CODE[ord("a") + _i] = _FIRST_LETTER + _i
_CODE[ord("A") : ord("Z") + 1] = _FIRST_LETTER + 26
_CODE[0xC0:256] = _FIRST_LETTER + 27
CODES = _FIRST_LETTER + 29  # the last is for characters from 256 on, 0 for the pad


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _CODE[np.minimum(points, 255)], CODES - 1).astype(np.uint8)


_LETTERS = np.array(list("aeioustrnlhdcmpgbfwvykéüñzxj"))
_SHARES = np.array([9, 10, 8, 8, 4, 7, 8, 7, 7, 4, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 2, 1, 1, 1, 1, 0.5, 0.5, 0.5])
_UPTO = np.cumsum(_SHARES / _SHARES.sum())


def _word(rng) -> str:
    return "".join(_LETTERS[np.minimum(np.searchsorted(_UPTO, rng.random(rng.integers(1, 10))), len(_LETTERS) - 1)])


def _plain(rng) -> str:
    """A word of a to z."""
    return _word(rng).translate(str.maketrans("éüñ", "eun"))


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n).tolist()))


def _card_number(rng) -> str:
    d = str(rng.integers(3, 7)) + _number(rng, 14)
    return next(d + str(i) for i in range(10) if luhn(d + str(i)))


_HEX, _ALNUM = list("0123456789abcdef"), list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Names before secrets, and how well-known kinds of keys begin.
_NAMES = ["password", "passwd", "pwd", "token", "access_token", "secret", "api_key", "apikey", "API_KEY", "SECRET_KEY", "auth", "client_secret", "Passwort", "clave"]
_LEADS = [("AKIA", 16, True), ("ASIA", 16, True), ("ghp_", 36, False), ("sk-", 40, False), ("xoxb-", 24, False), ("glpat-", 20, False)]


def _drawn(rng, letters: list[str], n: int) -> str:
    return "".join(rng.choice(letters, n))


def _secret(rng) -> list[tuple[int, str]]:
    if rng.random() < 0.4:
        lead, n, upper = _LEADS[rng.integers(len(_LEADS))]
        made = _drawn(rng, _ALNUM, n)
        return [(SECRET, lead + (made.upper() if upper else made))]
    value = _drawn(rng, _HEX, rng.choice([16, 18, 20, 32, 40, 64])) if rng.random() < 0.6 else _drawn(rng, _ALNUM, rng.integers(12, 40))
    quote = str(rng.choice(["", '"', "'"], p=[0.5, 0.4, 0.1]))
    return [(0, str(rng.choice(_NAMES)) + str(rng.choice(["=", " = ", ": ", ":", '": '])) + quote), (SECRET, value), (0, quote)]


def _entity(rng) -> list[tuple[int, str]]:
    """Pieces of text with their kinds."""
    kind = int(rng.integers(1, TAGS))
    if kind == SECRET:
        return _secret(rng)
    if kind == 1:
        name, host, top = _plain(rng) + rng.choice(["", "." + _plain(rng), _number(rng, 2), "_" + _plain(rng)]), _plain(rng), rng.choice(["com", "org", "net", "de", "io"])
        at = rng.choice(["@", " at ", " [at] ", "(at)", " (at) "], p=[0.3, 0.25, 0.2, 0.1, 0.15])
        dot = rng.choice([" dot ", " [dot] ", "(dot)"]) if at != "@" and rng.random() < 0.8 else "."
        return [(kind, name + at + host + dot + top)]
    if kind == 2:
        return [(kind, rng.choice([".", "[.]", " . ", "(.)"], p=[0.5, 0.3, 0.1, 0.1]).join(str(n) for n in rng.integers(0, 256, 4)))]
    if kind == 3:
        d, sep = _card_number(rng), rng.choice(["", " ", "-", ".", "/"], p=[0.3, 0.2, 0.2, 0.2, 0.1])
        return [(kind, sep.join(d[i : i + 4] for i in range(0, 16, 4)))]
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return [(kind, str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"0049 {a} {b} {c}"])))]


def _filler(rng) -> str:
    """Words, and things that look like personal data but are none."""
    r = rng.random()
    w = _word(rng)
    if r < 0.8:
        return rng.choice([w, w.capitalize(), w + ",", w + ".\n" + _word(rng).capitalize(), w.upper() + "!!", w + "***", w + " |", w + "$$$", w + "%%%"], p=[0.56, 0.1, 0.1, 0.12, 0.04, 0.02, 0.02, 0.02, 0.02])
    n = lambda k: _number(rng, k)
    return str(
        rng.choice(
            [f"commit {_drawn(rng, _HEX, 40)}", n(rng.integers(1, 9)), f"{n(1)}.{n(2)}", f"Version {n(1)}.{n(1)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}", f"https://{_word(rng)}.example.com/{n(3)}",
             f"{_word(rng)} at the {_word(rng)}", f"{n(2)},{n(3)}", f"{n(1)}.{n(1)}.{n(2)}", n(20), f"{rng.choice(_NAMES)} {_word(rng)}", f"{_word(rng)} = {_word(rng)}", (w * 3).upper(), f"ISBN {n(3)}-{n(1)}-{n(2)}"]
        )
    )


def labelled(n: int, span: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows as codes, and the tag of each character."""
    rng = np.random.default_rng(seed)
    codes, tags = np.zeros((n, span), np.uint8), np.zeros((n, span), np.int64)
    for i in range(n):
        text, tag = "", []
        while len(text) < span + 20:
            pieces = _entity(rng) if rng.random() < 0.12 else [(0, str(_filler(rng)))]
            for kind, piece in [*pieces, (0, str(rng.choice([" ", ". ", ", ", ".\n"], p=[0.85, 0.05, 0.05, 0.05])))]:
                text += piece
                tag += [kind] * len(piece)
        cut = int(rng.integers(0, 20))
        codes[i], tags[i] = encode(text[cut : cut + span]), tag[cut : cut + span]
    return codes, tags


# --- network ----------------------------------------------------------------

HIDDEN, SPAN, STEPS, BATCH = 8, 80, 480, 64
#: Characters of a decoded window, and how many of them two neighbours share.
WINDOW, OVERLAP = 320, 48


@dataclass
class Tagger:
    """Per direction: gate tables (4 * hidden, codes), recurrent (4 * hidden, hidden), emissions (tags, hidden); transitions."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray
    moves: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def crf_slopes(emit: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags (n, t) under emissions (n, t, k), and its slopes, by forward-backward."""
    n, t, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        alpha[:, i] = emit[:, i] + _lse(alpha[:, i - 1, :, None] + moves, 1)
    for i in range(t - 2, -1, -1):
        beta[:, i] = _lse(moves + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    whole = _lse(alpha[:, -1], 1)
    one = np.eye(k)[tags]
    d_emit = np.exp(alpha + beta - whole[:, None, None]) - one
    pair = np.exp(alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]).sum((0, 1))
    seen = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    truth = (emit * one).sum() + (moves * seen).sum()
    return float((whole.sum() - truth) / n), d_emit / n, (pair - seen) / n


def _slopes(params: list[np.ndarray], x: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    n, span = x.shape
    h = HIDDEN
    emit = np.broadcast_to(params[6], (n, span, TAGS)).copy()
    runs = []
    for way in range(2):
        e, u, o = params[way], params[2 + way], params[4 + way]
        order = range(span) if way == 0 else range(span - 1, -1, -1)
        state, cell, trace = np.zeros((n, h)), np.zeros((n, h)), {}
        for t in order:
            g = e.T[x[:, t]] + state @ u.T
            i, f, w, c = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            new = f * cell + i * c
            tc = np.tanh(new)
            trace[t] = (state, cell, i, f, w, c, tc)
            state, cell = w * tc, new
            emit[:, t] += state @ o.T
            trace[t] += (state,)
        runs.append((order, trace))
    _, d_emit, d_moves = crf_slopes(emit, params[7], tags)
    grads = [np.zeros_like(p) for p in params]
    grads[6], grads[7] = d_emit.sum((0, 1)), d_moves
    for way, (order, trace) in enumerate(runs):
        u, o = params[2 + way], params[4 + way]
        d_state, d_cell = np.zeros((n, h)), np.zeros((n, h))
        for t in reversed(order):
            state, cell, i, f, w, c, tc, out = trace[t]
            grads[4 + way] += d_emit[:, t].T @ out
            d = d_state + d_emit[:, t] @ o
            dc = d_cell + d * w * (1 - tc * tc)
            g = np.concatenate([dc * c * i * (1 - i), dc * cell * f * (1 - f), d * tc * w * (1 - w), dc * i * (1 - c * c)], 1)
            np.add.at(grads[way].T, x[:, t], g)
            grads[2 + way] += g.T @ state
            d_state, d_cell = g @ u, dc * f
    return grads


@functools.lru_cache(1)
def trained(seed: int = 5) -> Tagger:
    """The tagger, fitted once for each driver process by gradient descent with Adam on generated labelled spans."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    params = [rng.normal(0, 0.3, (4 * h, CODES)) for _ in range(2)] + [rng.normal(0, 0.4, (4 * h, h)) for _ in range(2)] + [rng.normal(0, 0.3, (TAGS, h)) for _ in range(2)] + [np.eye(TAGS)[0], np.eye(TAGS)]
    codes, tags = labelled(6000, SPAN)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, STEPS + 1):
        pick = rng.choice(len(codes), BATCH, replace=False)
        rate = 0.04 * min(1, t / 20) * (1 - 0.95 * t / STEPS)
        for p, g, (m, v) in zip(params, _slopes(params, codes[pick].astype(np.int64), tags[pick]), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    f = [p.astype(np.float32) for p in params]
    return Tagger(f[0:2], f[2:4], f[4:6], f[6], f[7])


def emissions(model: Tagger, x: np.ndarray) -> np.ndarray:
    """Tag scores (positions, tags, windows) of windows of codes (windows, positions); code 0 is the pad and keeps states 0."""
    n, span = x.shape
    h = HIDDEN
    out = np.empty((span, TAGS, n), np.float32)
    columns = np.ascontiguousarray(x.T).astype(np.intp)
    padded = bool((x == 0).any())
    for way in range(2):
        e, u = model.inputs[way].copy(), model.recurrent[way].copy()
        e[: 3 * h] *= 0.5  # sigmoids as tangents of half their arguments
        u[: 3 * h] *= 0.5
        state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        gates, fresh = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        for t in range(span) if way == 0 else range(span - 1, -1, -1):
            c = columns[t]
            np.dot(u, state, gates)
            np.take(e, c, 1, fresh, "clip")
            gates += fresh
            np.tanh(gates, gates)
            gates[: 3 * h] += 1
            gates[: 3 * h] *= 0.5
            cell *= gates[h : 2 * h]
            cell += gates[:h] * gates[3 * h :]
            np.tanh(cell, state)
            state *= gates[2 * h : 3 * h]
            if padded:
                off = c == 0
                state[:, off] = 0
                cell[:, off] = 0
            if way == 0:
                np.dot(model.outputs[0], state, out[t])
            else:
                out[t] += model.outputs[1] @ state
    out += model.bias[None, :, None]
    return out


def viterbi(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags (windows, positions) of emissions (positions, tags, windows)."""
    span, k, n = emit.shape
    score, back = emit[0].copy(), np.empty((span, k, n), np.uint8)
    for t in range(1, span):
        reach = score[:, None, :] + moves[:, :, None]
        back[t] = reach.argmax(0)
        score = reach.max(0) + emit[t]
    tags = np.empty((n, span), np.uint8)
    tags[:, -1] = score.argmax(0)
    for t in range(span - 1, 0, -1):
        tags[:, t - 1] = back[t][tags[:, t], np.arange(n)]
    return tags


def decode(model: Tagger, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows may hold a tag, and their best tags. The rest are outside throughout, as shown by a bound.

    A path that leaves the outside gains, over one that doesn't, the sum of its stays there. No stay gains more than the
    greatest sum of leads of other tags over outside, with the best ways in, on and out.
    """
    emit = emissions(model, x)
    a, real = model.moves, x.T != 0
    into, on, out = float(a[0, 1:].max() - a[0, 0]), float(a[1:, 1:].max() - a[0, 0]), float(a[1:, 0].max() - a[0, 0])
    lead = np.where(real, emit[:, 1:].max(1) - emit[:, 0], np.float32(-1e4))
    stay = most = lead[0]
    for t in range(1, len(lead)):
        stay = lead[t] + np.maximum(stay + np.float32(on), np.float32(into))
        most = np.maximum(most, stay)
    maybe = np.flatnonzero(most + max(out, 0.0) > -1e-3)
    if not len(maybe):
        return maybe, np.zeros((0, x.shape[1]), np.uint8)
    part = emit[:, :, maybe].copy()
    part[:, 1:][np.broadcast_to((x[maybe].T == 0)[:, None, :], part[:, 1:].shape)] = -1e4
    return maybe, viterbi(part, a)


def tag_texts(model: Tagger, texts: list[str]) -> list[np.ndarray | None]:
    """Tags of every character of whole texts; None where all are outside."""
    step = WINDOW - OVERLAP
    codes = [encode(t) for t in texts]
    out: list[np.ndarray | None] = [None] * len(texts)
    owner, first = [], []
    for i, c in enumerate(codes):
        for s in range(0, max(1, len(c) - OVERLAP), step) if len(c) else ():
            owner.append(i)
            first.append(s)
    own, begin = np.array(owner, np.int64), np.array(first, np.int64)
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([*codes, np.zeros(WINDOW, np.uint8)])
    base = np.concatenate(([0], np.cumsum(lengths)))
    size = np.minimum(WINDOW, lengths[own] - begin) if len(own) else np.zeros(0, np.int64)
    padded = np.minimum(WINDOW, -(-size // 32) * 32)
    for width in np.unique(padded):
        group = np.flatnonzero(padded == width)
        for at in range(0, len(group), 2048):
            ix = group[at : at + 2048]
            x = flat[(base[own[ix]] + begin[ix])[:, None] + np.arange(width)]
            x[np.arange(width) >= size[ix][:, None]] = 0
            maybe, tags = decode(model, x)
            for w, row in zip(ix[maybe].tolist(), tags, strict=True):
                i, s, n = int(own[w]), int(begin[w]), int(size[w])
                if not row[:n].any():
                    continue
                if out[i] is None:
                    out[i] = np.zeros(lengths[i], np.uint8)
                # The half of an overlap that is nearer to this window's middle is this window's.
                lo = 0 if s == 0 else OVERLAP // 2
                hi = n if s + n == lengths[i] else n - OVERLAP // 2
                out[i][s + lo : s + hi] = row[lo:hi]
    return out


_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[(]?\s*\bat\b\s*[\])]?)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]?\s*\bdot\b\s*[\])]?)\s*[A-Za-z0-9-]+)+")


def holds(kind: int, text: str) -> bool:
    """Whether a span of the network has what its kind needs."""
    if kind == 1:
        return bool(_EMAIL_LIKE.fullmatch(text)) and ("@" in text or "dot" in text or "[at]" in text or "(at)" in text)
    if kind == SECRET:
        return len(text) >= 12 and bool(re.fullmatch(r"[A-Za-z0-9_+/=.~-]+", text)) and bool(re.search("[A-Za-z]", text)) and sum(map(str.isdigit, text)) >= 2
    d = _digits(text)
    if kind == 2:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 4) and max(map(len, parts)) <= 3 and not re.search("[A-Za-z]", text)
    if kind == 3:
        return 13 <= len(d) <= 19 and d[0] in "23456" and luhn(d) and not re.search("[^0-9 ./-]", text)
    return 9 <= len(d) <= 15 and len(re.findall("[0-9]+", text)) >= 3 and bool(re.fullmatch(r"\+?[0-9 ().-]+", text))


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(tags)) + 1
    cuts = [0, *edge.tolist(), len(tags)]
    return [(int(tags[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b and tags[a]]


def _inside(c: str, kind: int) -> bool:
    return c.isalnum() or kind == SECRET and c in "_-"


def _widened(text: str, kind: int, a: int, b: int, least: int) -> tuple[int, int]:
    """A run without what surrounds its words, then with the whole of its first and last word, from least on."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while least < a < b and _inside(text[a], kind) and _inside(text[a - 1], kind):
        a -= 1
    while a < b < len(text) and _inside(text[b - 1], kind) and _inside(text[b], kind):
        b += 1
    return a, b


def find(model: Tagger, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]], list[tuple[int, int]]]]:
    """For each text the spans of the patterns, those with the network's added, by kind, and the network's secrets."""
    out = []
    for text, tags in zip(texts, tag_texts(model, texts), strict=True):
        base = base_spans(text)
        every = [list(s) for s in [*base, ()]]
        if tags is not None:
            taken = sorted(s for spans in base for s in spans)
            last = 0
            for kind, a, b in _runs(tags):
                if b <= last:
                    continue
                a, b = _widened(text, kind, max(a, last), b, last)
                last = max(last, b)
                if a < b and not _touches(taken, a, b) and holds(kind, text[a:b]):
                    every[kind - 1].append((a, b))
        out.append((base, [sorted(s) for s in every[:-1]], every[-1]))
    return out


def _touches(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span of a sorted list meets a to b. At most one of each kind begins before a and ends after it."""
    return any(s < b and a < e for s, e in spans[max(0, bisect.bisect_left(spans, (a, a)) - 64) : bisect.bisect_left(spans, (b, b))])


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in zip(KINDS, spans, strict=True) for a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, secrets, private, and the columns named in keep.

    Offsets count code points, ends are exclusive. Counts and base_sha256 are those of the patterns; spans also holds the
    network's of those kinds, secrets (start:end) its own kind; private is true if there is any span. Null and empty texts
    have no spans. Repeated rows give a row each; empty tables give none; other columns do no harm. With redact, text_col
    is returned too, every span replaced by its kind in angle brackets.
    """
    model = trained()
    new = [("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("secrets", pa.string()), ("private", pa.bool_()), ("redacted", pa.string())]

    def run(parts):
        for part in parts:
            texts = part.column(0).to_pylist()
            rows: list[tuple] = []
            at = 0
            while at < len(texts):
                b, size = at, 0
                while b < len(texts) and (b == at or size + len(texts[b] or "") <= 1 << 19):
                    size += len(texts[b] or "")
                    b += 1
                for text, (base, every, secrets) in zip(texts[at:b], find(model, [t or "" for t in texts[at:b]]), strict=True):
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    marks = _redacted(text, [*every, secrets]) if redact else None
                    rows.append((*map(len, base), digest, _joined(every), len(secrets), ",".join(f"{x}:{y}" for x, y in secrets), bool(secrets or any(every)), marks))
                at = b
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c, k) for c, (_, k) in zip(columns, new, strict=True)]], [*part.schema.names[1:], *[n for n, _ in new]])

    others = [c for c in dict.fromkeys((id_col, *keep)) if c != text_col]
    chosen = only(docs, text_col, *others).toDF("text", *[f"_keep{i}" for i in range(len(others))])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[1:])
    out = chosen.mapInArrow(released(run), fields + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, secrets string, private boolean, redacted string")
    first, *rest = [F.col(f"_keep{i}").alias(n) for i, n in enumerate(others)]
    return out.select(first, *[n for n, _ in new[:-1]], *rest, *[F.col("redacted").alias(text_col)] * redact)


def _redacted(text: str | None, spans: list[list[tuple[int, int]]]) -> str | None:
    if text is None:
        return None
    marks = sorted((a, b, k) for k, found in zip((*KINDS, "secret"), spans, strict=True) for a, b in found)
    out, at = [], 0
    for a, b, k in marks:
        if b <= at:
            continue
        out.append(text[at : max(a, at)] + f"<{k}>")
        at = b
    return "".join(out) + text[at:]
