"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds to them.

The base spans are the four fixed patterns'.  The model finds the same kinds in
forms that the patterns miss (spelled or spaced addresses, national phone
numbers, short or dotted cards, IPv6, digits of other scripts), and secrets such
as tokens and keys.  It reads every character of a text, in overlapping windows.
The emissions of all windows that cover a character are averaged, nearer to a
window's middle counting more, and one CRF decoding runs over the whole text
(in overlapping parts where it is long), so window edges leave no trace.  A span
of the model is added if it is sure enough, can be of its kind and meets no base
span.  The network is trained in numpy on generated text with labelled spans and
look-alikes; its parameters come with the package, so no query trains.  ONNX
Runtime reads with it where it is installed, numpy elsewhere.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_left
from functools import cache, lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ship, trim

try:
    import onnxruntime
except ImportError:  # numpy reads then
    onnxruntime = None

#: The kinds of the fixed patterns, and one that only the model finds: tokens, keys and passwords.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SECRET = KINDS.index("secret")
# Fixed patterns of the base kinds; digits are taken whole, so that long runs cost no retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where addresses and cards can be: from a digit on, their characters.
_FIGURES = re.compile(r"[0-9][0-9.\x20-]*")
_EDGE = frozenset(" \t\r\n\"'`,;|")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start, in code points."""
    out = [("email", a, z) for a, z in _emails(text)] if "@" in text else []
    places = [m.span() for m in _FIGURES.finditer(text)]
    out += [("ip", m.start(), m.end()) for x, y in places if y - x >= 7 for m in _IP.finditer(text, x, y) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for x, y in places:
        for m in _CARD.finditer(text, x, y) if y - x >= 16 else ():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the network ---------------------------------------------------------------

#: Outside, and begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 40
EMBED, HIDDEN = 12, 24
#: Least marginal of a span that the model adds.
SURE = 0.8


@cache
def _plain_digits() -> dict[int, str]:
    """Digits of all scripts, and wide marks, as their ASCII fellows."""
    return {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"} | {ord(a): b for a, b in zip("＠．－（）＋", "@.-()+", strict=True)}


def _classes(text: str) -> np.ndarray:
    """A small alphabet: letters by case and vowel, each digit's own, marks, others."""
    return _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


@cache
def _table() -> np.ndarray:
    """The class of every code point."""
    t = np.ones(sys.maxunicode + 1, np.uint8)
    for c in range(128):
        s = chr(c)
        t[c] = 0
        if s.isdigit():
            t[c] = 2 + int(s)
        elif s.isalpha():
            t[c] = 12 + 2 * (s in "aeiouAEIOU") + s.isupper()
        elif s.isspace():
            t[c] = 16 + (s == "\n")
        elif s in "@.-_+()/:,%#$*'\"=&?!;|[]<>":
            t[c] = 18 + "@.-_+()/:,%#$*'\"=&?!;|[]<>".index(s)
    for c, plain in _plain_digits().items():
        t[c] = t[ord(plain)]
    return t


ALPHABET = 18 + 26 + 1
PAD = ALPHABET - 1


def _start(rng) -> dict[str, np.ndarray]:
    def normal(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    p = {"embed": rng.normal(0, 0.3, (ALPHABET, EMBED)), "out": normal(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"x{d}": normal(EMBED, 4 * HIDDEN), f"h{d}": normal(HIDDEN, 4 * HIDDEN), f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(p, d, x, keep=False):
    """Hidden states over time for inputs (batch, time, embed); the steps' parts where asked for."""
    n, length, _ = x.shape
    wx, wh = x @ p[f"x{d}"] + p[f"b{d}"], p[f"h{d}"]
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, parts = np.empty((n, length, HIDDEN), x.dtype), []
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        z = wx[:, t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            parts.append((t, i, f, o, g, tc, *before))
    return out, parts


def _lstm_back(p, d, x, parts, dout, grad):
    dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
    dx = np.zeros_like(x)
    for t, i, f, o, g, tc, h0, c0 in reversed(parts):
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        grad[f"x{d}"] += x[:, t].T @ dz
        grad[f"h{d}"] += h0.T @ dz
        grad[f"b{d}"] += dz.sum(axis=0)
        dx[:, t] = dz @ p[f"x{d}"].T
        dh, dc = dz @ p[f"h{d}"].T, dc * f
    return dx


def _emissions(p, ids):
    x = p["embed"][ids]
    return np.concatenate([_lstm(p, "f", x)[0], _lstm(p, "b", x)[0]], axis=2) @ p["out"] + p["bias"]


def _log_sum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _marginals(e, trans):
    """(log partition, forward, backward) of a batch of chains."""
    fwd, bwd = np.empty_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        fwd[:, t] = e[:, t] + _log_sum(fwd[:, t - 1][:, :, None] + trans, 1)
    for t in range(e.shape[1] - 2, -1, -1):
        bwd[:, t] = _log_sum(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
    return _log_sum(fwd[:, -1], 1), fwd, bwd


def _gradient(p, ids, tags):
    x = p["embed"][ids]
    (hf, pf), (hb, pb) = _lstm(p, "f", x, True), _lstm(p, "b", x, True)
    h = np.concatenate([hf, hb], axis=2)
    e = h @ p["out"] + p["bias"]
    z, fwd, bwd = _marginals(e, p["trans"])
    n = len(ids)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    de = np.exp(fwd + bwd - z[:, None, None])
    np.add.at(de, (np.arange(n)[:, None], np.arange(ids.shape[1])[None, :], tags), -1.0)
    pair = np.exp(fwd[:, :-1, :, None] + p["trans"] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
    np.add.at(pair, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), -1.0)
    grad["trans"] = pair
    grad["out"], grad["bias"] = np.einsum("nth,ntk->hk", h, de), de.sum(axis=(0, 1))
    dh = de @ p["out"].T
    dx = _lstm_back(p, "f", x, pf, dh[:, :, :HIDDEN], grad) + _lstm_back(p, "b", x, pb, dh[:, :, HIDDEN:], grad)
    np.add.at(grad["embed"], ids, dx)
    return {k: v / n for k, v in grad.items()}


def _sample_text(rng) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of generated text and its labelled spans (kind, start, end).

    Half of the personal data is in forms that the fixed patterns miss.  What
    looks like a card is labelled as one whatever its check sum, which no
    network can see; ``_plausible`` looks at that.
    """
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def word(low=2, high=9):
        return "".join(rng.choice(list("abcdefghijklmnoprstuvwäñéioa"), int(rng.integers(low, high))))

    def plain(low=2, high=9):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(low, high))))

    def digits(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def some(low, high, letters):
        return "".join(rng.choice(list(letters), int(rng.integers(low, high))))

    hexes, base62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def email():
        name, host, end = f"{plain()}{pick('.', '_', '', '-')}{plain()}{pick('', digits(2))}", plain(), pick("com", "org", "net", "example.com", "co.uk", "de")
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" AT ", " DOT "), (" @ ", "."), ("＠", "．"), (" at ", "."))
        return f"{name}{at}{host}{dot}{end.replace('.', dot)}"

    def ip():
        if rng.random() < 0.35:
            groups = [some(1, 5, hexes) for _ in range(int(rng.integers(2, 7)))]
            return pick("2001:db8::", "fe80::", "2a02:" + some(2, 5, hexes) + "::") + ":".join(groups[:4])
        dot = pick(".", ".", "[.]", " . ", "(.)", "．")
        return dot.join(str(x) for x in rng.integers(0, 256, 4))

    def card():
        if rng.random() < 0.25:
            head = pick("34", "37") + digits(12)
            body = head + pick(next(c for c in "0123456789" if luhn(head + c)), digits(1))
            sep = pick("", " ", "-")
            return sep.join((body[:4], body[4:10], body[10:]))
        head = digits(pick(15, 15, 15, 18))
        body = head + pick(next(c for c in "0123456789" if luhn(head + c)), digits(1))
        sep = pick("", " ", "-", ".", "  ", "/", "_")
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.integers(10, 99)} {a} {b}{c}", f"0{digits(2)}/{digits(7)}", f"0{digits(3)} {digits(6)}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"(0{digits(2)}) {digits(4)} {digits(4)}", f"+{digits(int(rng.integers(9, 14)))}")

    def secret():
        return pick(some(32, 45, hexes), some(20, 44, base62), f"sk-{some(20, 40, base62)}", f"AKIA{some(16, 17, base62.upper())}", f"ghp_{some(30, 37, base62)}", f"eyJ{some(20, 40, base62)}", some(64, 65, hexes))

    key = lambda: pick("token", "api_key", "secret", "password", "api-key", "apikey", "access_token", "auth", "SECRET_KEY", "key", "Token", "passwd")
    made = ((0, email), (1, ip), (2, card), (3, phone))
    alike = (
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2030)}",
        lambda: f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2030)}",
        lambda: f"{pick('v', 'version ', 'Version ', '')}{rng.integers(0, 19)}.{rng.integers(0, 20)}{pick('', '.' + str(rng.integers(0, 30)))}",
        lambda: f"{rng.integers(0, 24)}:{digits(2)}{pick('', ':' + digits(2))}",
        lambda: f"{pick('$', '€', '')}{digits(int(rng.integers(1, 5)))}{pick('.', ',')}{digits(2)}",
        lambda: digits(int(rng.integers(1, 13))),
        lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"@{word()}",
        lambda: f"{digits(2)},{digits(3)},{digits(3)}",
        lambda: f"{pick('look', 'met', 'meet', 'is')} at {word()} {pick('dot', 'and', 'in')} {word()}",
        lambda: f"{word()} dot {word()}",
        lambda: f"https://{plain()}.{pick('com', 'org')}/{plain()}/{some(6, 20, hexes)}",
        lambda: f"{pick('commit', 'id', 'page', 'no.')} {some(4, 9, hexes)}",
        lambda: f"{key()} {word()}",
        lambda: f"{digits(2)}-{digits(2)}, {digits(4)}-{digits(4)}",
        lambda: f"({rng.integers(1900, 2030)})",
        lambda: f"{rng.integers(1, 30)} {word()} {rng.integers(1900, 2030)}",
        lambda: f"x = {digits(2)}; y += {digits(1)}.{digits(3)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(1)} {word().capitalize()}",
    )
    text, spans = "", []
    while len(text) < 2 * WINDOW:
        r = rng.random()
        if r < 0.06:
            q = pick('"', "'", "", "")
            text += f"{key()}{pick(' = ', ': ', '=', ' is ', ':')}{q}"
            s = secret()
            spans.append((SECRET, len(text), len(text) + len(s)))
            s += q
        elif r < 0.25:
            kind, make = made[int(rng.integers(len(made)))]
            s = make()
            spans.append((kind, len(text), len(text) + len(s)))
        elif r < 0.45:
            s = alike[int(rng.integers(len(alike)))]()
        else:
            s = word().capitalize() if rng.random() < 0.2 else word()
        text += s + pick(" ", " ", " ", ". ", ", ", "\n", "; ", " | ")
    return text, spans


def train(lines: int = 6000, epochs: int = 14, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters trained on generated text with labelled spans; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    ids, tags = np.full((lines, WINDOW), PAD), np.zeros((lines, WINDOW), np.int64)
    for i in range(lines):
        text, spans = _sample_text(rng)
        shift = int(rng.integers(0, max(1, len(text) - WINDOW)))
        own = _classes(text[shift : shift + WINDOW])
        ids[i, : len(own)] = own
        for kind, a, z in spans:
            a, z = a - shift, z - shift
            if a < 0 < z:  # cut by the window's start: its inside only
                tags[i, 0 : max(0, z)] = 2 + 2 * kind
            elif 0 <= a < WINDOW:
                tags[i, a:z] = 2 + 2 * kind
                tags[i, a] = 1 + 2 * kind
    p = _start(rng)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        order = rng.permutation(lines)
        for a in range(0, lines, 64):
            g = _gradient(p, ids[order[a : a + 64]], tags[order[a : a + 64]])
            step += 1
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] * g[k]
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


#: What ``train()`` made; ``python -m millrace.llm.pii`` makes it anew.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@cache
def model() -> dict[str, np.ndarray]:
    """The parameters that come with the package."""
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the model reads: all of it, as one."""
    return [(0, len(text))] if text else []


def _windows(length: int) -> np.ndarray:
    starts = np.arange(max(0, -(-(length - WINDOW) // STRIDE)) + 1) * STRIDE
    starts[-1] = max(0, length - WINDOW)
    return starts


#: Windows that the network reads at once, and characters whose emissions are held at once.
READ, HELD = 2048, 1 << 19
#: Products of matrices are as wide as a multiple of this: whole tiles.
WIDE = 64
#: Characters that one CRF decoding runs over, and the margin on either side of a part of a longer text.
PIECE, MARGIN = 2048, 128
#: Parts that are decoded at once, the steps after which their sums are scaled, and the steps that stay in the cache.
PARTS, SCALE, BLOCK = 256, 4, 16


def _pieces(length: int) -> list[tuple[int, int, int, int]]:
    """(from, to, core from, core to) of the parts of a text; the cores lie on end and neighbours overlap by two margins."""
    if length <= PIECE:
        return [(0, length, 0, length)]
    core = PIECE - 2 * MARGIN
    return [(max(0, a - MARGIN), min(length, a + core + MARGIN), a, min(length, a + core)) for a in range(0, length, core)]


def model_spans(p: dict[str, np.ndarray], texts: list[str], sure: float = 0.0, possible=None) -> list[list[tuple[str, int, int, float]]]:
    """The model's spans of each text, with their least marginals (to four digits, as
    products in 32 bits round by their place in a batch); those under ``sure`` may be left out,
    and those inside a run of characters that ``possible(kind, run)`` says can't hold one."""
    read = _reader(p)
    # the best path's tag of each character, and the marginal of that tag's kind
    paths, least = [np.zeros(len(t), np.int8) for t in texts], [np.zeros(len(t), np.float32) for t in texts]
    batch, size = [], 0
    for i, text in enumerate(texts):
        for a, z in stretches(text):
            pieces = _pieces(z - a)
            for at in range(0, len(pieces), PARTS):
                batch.append((i, pieces[at : at + PARTS]))
                size += batch[-1][1][-1][1] - batch[-1][1][0][0]
                if size >= HELD:
                    _decode(p, read, texts, batch, sure, possible, paths, least)
                    batch, size = [], 0
    if batch:
        _decode(p, read, texts, batch, sure, possible, paths, least)
    return [[(KINDS[k], a, z, round(float(q[a:z].min()), 4)) for k, a, z in _runs(path)] for path, q in zip(paths, least, strict=True)]


def _reader(p):
    """The network on windows of classes (window, time): emissions as of ``_emissions``, but times
    each character's weight, window by window on end.  ONNX Runtime where it is there, else numpy."""
    if onnxruntime is None:
        return _numpy_reader(p)
    session = _session(tuple((k, v.shape, v.astype(np.float32).tobytes()) for k, v in sorted(p.items())))

    def read(ids):
        n = -(-len(ids) // WIDE) * WIDE
        by_time = np.full((WINDOW, n), PAD, np.int32)
        by_time[:, : len(ids)] = ids.T
        return session.run(None, {"ids": by_time})[0][: len(ids)]

    return read


def _weight() -> np.ndarray:
    """The weights of a window's characters: more, the nearer to its middle."""
    return np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


@lru_cache(4)
def _session(params: tuple):
    """The network, its steps rolled out, as a session of one thread; kept, as loading takes half a second."""
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    p = {k: np.frombuffer(b, np.float32).reshape(shape) for k, shape, b in params}
    return onnxruntime.InferenceSession(_onnx(p), options, providers=["CPUExecutionProvider"])


def _onnx(p: dict[str, np.ndarray]) -> bytes:
    """The network as an ONNX model: classes (time, window) in, weighted emissions (window, time and tag) out."""
    nodes, values = [], {"weight": np.repeat(_weight(), TAGS), "bias": p["bias"]}

    def node(op, ins, out, **ints):
        at = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in ints.items())
        nodes.append(b"".join(_field(1, x) for x in ins) + _field(2, out) + _field(4, op) + at)
        return out

    for t in range(WINDOW):
        values[f"time{t}"] = np.array(t, np.int64)
        node("Gather", ["ids", f"time{t}"], f"ids{t}", axis=0)
    for k, d in enumerate("fb"):
        for g, gate in enumerate("ifog"):
            own = slice(g * HIDDEN, (g + 1) * HIDDEN)
            values[f"x{d}{gate}"] = p["embed"] @ p[f"x{d}"][:, own] + p[f"b{d}"][own]
            values[f"h{d}{gate}"] = p[f"h{d}"][:, own]
        values[f"out{d}"] = p["out"][k * HIDDEN : (k + 1) * HIDDEN]
        h = c = None
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            z = f"{d}{t}"
            for gate in "ifog":
                x = node("Gather", [f"x{d}{gate}", f"ids{t}"], f"{z}x{gate}")
                if h:
                    x = node("Gemm", [h, f"h{d}{gate}", x], f"{z}z{gate}")
                node("Tanh" if gate == "g" else "Sigmoid", [x], z + gate)
            new = node("Mul", [z + "i", z + "g"], z + "ig")
            c = node("Add", [new, node("Mul", [z + "f", c], z + "fc")], z + "c") if c else new
            h = node("Mul", [z + "o", node("Tanh", [c], z + "tanh")], z + "h")
            node(*(("Gemm", [h, "outf", "bias"], f"f{t}e") if d == "f" else ("Gemm", [h, "outb", f"f{t}e"], f"b{t}e")))
    node("Mul", [node("Concat", [f"b{t}e" for t in range(WINDOW)], "all", axis=1), "weight"], "emissions")

    def tensor(name, a):
        a = a if a.dtype == np.int64 else np.ascontiguousarray(a, np.float32)
        return b"".join(_field(1, n) for n in a.shape) + _field(2, 7 if a.dtype == np.int64 else 1) + _field(8, name) + _field(9, a.tobytes())

    def value(name, kind, *shape):
        dims = b"".join(_field(1, _field(1 if isinstance(n, int) else 2, n)) for n in shape)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))

    graph = b"".join(_field(1, x) for x in nodes) + _field(2, "network") + b"".join(_field(5, tensor(k, v)) for k, v in values.items())
    graph += _field(11, value("ids", 6, WINDOW, "n")) + _field(12, value("emissions", 1, "n", WINDOW * TAGS))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 17))


def _field(key: int, value: int | str | bytes) -> bytes:
    """A field of a protocol buffer, in which ONNX models are written."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return number(key << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(value)) + value


def _numpy_reader(p):
    weight = _weight()
    table = np.ascontiguousarray(p["embed"].T, np.float32)
    gates, heads = [], []
    for k, d in enumerate("fb"):
        w = np.concatenate([p[f"h{d}"], p[f"x{d}"], p[f"b{d}"][None]]).T.astype(np.float32)
        w[: 3 * HIDDEN] *= -1  # 1 / (1 + exp(-x)), and tanh(x) as 2 / (1 + exp(-2x)) - 1
        w[3 * HIDDEN :] *= -2
        gates.append(np.ascontiguousarray(w))
        heads.append(np.ascontiguousarray(p["out"][k * HIDDEN : (k + 1) * HIDDEN], np.float32))

    def read(ids):
        n = -(-len(ids) // WIDE) * WIDE
        by_time = np.full((WINDOW, n), PAD, np.intp)
        by_time[:, : len(ids)] = ids.T
        out, e = np.empty((WINDOW, n, TAGS), np.float32), np.empty((n, TAGS), np.float32)
        out[:] = p["bias"] * weight[:, None, None]
        state, z, c = np.ones((HIDDEN + EMBED + 1, n), np.float32), np.empty((4 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        h, x = state[:HIDDEN], state[HIDDEN:-1]
        i, f, o, g = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        for k, steps in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
            h[:], c[:] = 0, 0
            for t in steps:
                np.take(table, by_time[t], axis=1, out=x, mode="clip")
                np.matmul(gates[k], state, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                g *= 2
                g -= 1
                c *= f
                i *= g
                c += i
                np.tanh(c, out=i)
                np.multiply(o, i, out=h)
                np.matmul(h.T, heads[k], out=e)
                e *= weight[t]
                out[t] += e
        return out[:, : len(ids)].transpose(1, 0, 2).reshape(len(ids), -1)

    return read


def _merged(read, texts, batch) -> list[np.ndarray]:
    """The emissions over each run of parts, averaged over all windows of its text that reach into it."""
    codes, places, size, filled = [], [], 0, 0
    for i, pieces in batch:
        a, z, n = pieces[0][0], pieces[-1][1], len(texts[i])
        starts = _windows(n)
        if z - a < n:
            starts = starts[(starts > a - WINDOW) & (starts < z)]
        left, end = int(starts[0]), int(starts[-1]) + WINDOW
        codes.append(_classes(texts[i][left:end]))
        if end > n:
            codes.append(np.full(end - n, PAD, np.uint8))
        places.append((a - left, z - left, starts - left, size, filled))
        size, filled = size + len(starts), filled + end - left
    ids = np.lib.stride_tricks.sliding_window_view(np.concatenate(codes), WINDOW)[np.concatenate([starts + at for _, _, starts, _, at in places])]
    # equal windows have equal emissions, so each is read once
    flat, first = ids.tobytes(), {}
    same = [first.setdefault(flat[w * WINDOW : (w + 1) * WINDOW], w) for w in range(len(ids))]
    first, same = np.array(list(first.values())), np.array(same)
    rows = np.empty((len(ids), WINDOW * TAGS), np.float32)
    for at in range(0, len(first), READ):
        rows[first[at : at + READ]] = read(ids[first[at : at + READ]])
    again = np.flatnonzero(same != np.arange(len(same)))
    rows[again] = rows[same[again]]
    weight, out = _weight()[None], []
    # what strides are divided by that only windows a stride apart reach into; those at the ends are looked at for each text
    reach = -(-WINDOW // STRIDE)
    whole = np.repeat(_overlaid(weight.repeat(2 * reach, axis=0), np.arange(2 * reach) * STRIDE, 1)[reach - 1], TAGS)
    for a, z, starts, at, _ in places:
        sums = _overlaid(rows[at : at + len(starts)], starts, TAGS)
        m = len(starts)
        head, tail = min(m, reach - 1), max(min(m, reach - 1), m - 1 - reach)
        sums[head:tail] /= whole
        for x, y, windows in ((0, head, starts[:reach]), (tail, len(sums), starts[max(0, tail - reach + 1) :])):
            if y > x:
                first = int(windows[0]) // STRIDE
                own = _overlaid(weight.repeat(len(windows), axis=0), windows - windows[0], 1)[x - first : y - first].reshape(-1, 1)
                own[own == 0] = 1  # beyond the last window
                sums[x:y].reshape(-1, TAGS)[:] /= own
        out.append(sums.reshape(-1, TAGS)[a:z])
    return out


def _overlaid(rows, starts, wide) -> np.ndarray:
    """The sums of windows' rows, ``wide`` numbers a character and a stride a row, from the first window's start on; all but the last lie a stride apart."""
    m, head = len(starts) - 1, STRIDE * wide
    sums = np.zeros((max(m + 1, -(-(int(starts[-1]) + WINDOW) // STRIDE)), head), np.float32)
    for a in range(0, WINDOW * wide, head):  # what of the windows lies in their first stride, the next one, and so on
        part = rows[:m, a : a + head]
        sums[a // head : a // head + m, : part.shape[1]] += part
    sums.reshape(-1)[starts[-1] * wide : (starts[-1] + WINDOW) * wide] += rows[m]
    return sums


def _worth(text, offset, kinds, hot, sure, possible, core):
    """Of the characters ``hot``, where a kind is sure enough, those in runs that can hold a span of that kind.

    A span that is sure enough lies in a run of characters whose marginals of its
    kind all are.  Runs that reach an end of the part's core within the text go on elsewhere, so they stay.
    """
    keep = np.zeros(len(hot), bool)
    own = kinds[hot] >= sure - 1e-4
    # the kind of each character, one after another where a low threshold lets several be sure
    which, kind = np.nonzero(own)
    order = np.argsort(kind, kind="stable")
    which, kind, at = which[order], kind[order], hot[which[order]] + offset
    cuts = (np.flatnonzero((at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])) + 1).tolist()
    for a, z in zip([0, *cuts], [*cuts, len(at)], strict=True):
        first, end = int(at[a]), int(at[z - 1]) + 1
        if first <= core[0] > 0 or end >= core[1] < len(text) or possible(KINDS[kind[a]], text[first:end]):
            keep[which[a:z]] = True
    return hot[keep]


def _decode(p, read, texts, batch, sure, possible, paths, least):
    """Marginals of the parts in ``batch (text, parts on end)``, and best paths around what is sure enough in them.

    Every character gets its marginals.  Where those of all kinds are under
    ``sure`` no span can hold the character, so its tag isn't needed, nor where
    no run of such characters can hold a span; the path is found around the
    others, with the margin that parts have.
    """
    runs = _merged(read, texts, batch)
    jobs = [(b, j, a, z) for b, (_, pieces) in enumerate(batch) for j, (a, z, _, _) in enumerate(pieces)]
    jobs.sort(key=lambda j: j[2] - j[3])
    part = lambda b, a, z: runs[b][a - batch[b][1][0][0] : z - batch[b][1][0][0]]
    found = []
    for at in range(0, len(jobs), PARTS):
        group = jobs[at : at + PARTS]
        kinds = _kind_marginals([part(b, a, z) for b, _, a, z in group], p["trans"])
        which, when = np.nonzero((kinds.max(axis=1) >= sure - 1e-4).T)
        bounds = np.searchsorted(which, np.arange(len(group) + 1)).tolist()
        for k, (b, j, a, z) in enumerate(group):
            _, _, x, y = batch[b][1][j]
            hot = when[bounds[k] : bounds[k + 1]]
            if possible is not None and len(hot):
                hot = _worth(texts[batch[b][0]], a, kinds[:, :, k], hot, sure, possible, (x, y))
            hot = hot + a
            hot = hot[(hot >= x) & (hot < y)]
            if len(hot):
                gaps = np.flatnonzero(np.diff(hot) > MARGIN)
                for first, last in zip(hot[np.r_[0, gaps + 1]].tolist(), hot[np.r_[gaps, -1]].tolist(), strict=True):
                    found.append((b, max(a, first - MARGIN), min(z, last + 1 + MARGIN), first, last + 1, kinds[first - a : last + 1 - a, :, k].copy()))
    found.sort(key=lambda f: f[1] - f[2])
    for at in range(0, len(found), PARTS):
        group = found[at : at + PARTS]
        for (b, a, z, first, end, own), path in zip(group, _viterbi([part(b, a, z) for b, a, z, *_ in group], p["trans"]), strict=True):
            i = batch[b][0]
            inner = path[first - a : end - a]
            paths[i][first:end] = inner
            least[i][first:end] = own[np.arange(end - first), np.maximum(inner - 1, 0) // 2]
            # a span that goes on beyond is not sure enough there, and is seen to go on
            for beside in (first - 1, end):
                if a <= beside < z and not paths[i][beside]:
                    paths[i][beside] = path[beside - a]


def _side_by_side(parts):
    """Parts, longest first, as one array by part, time and tag; how many of them reach each time, and those as whole tiles."""
    # a time more than needed, as rows a power of two apart share their places in the cache
    e = np.zeros((-(-len(parts) // WIDE) * WIDE, len(parts[0]) + 1, TAGS), np.float32)
    for k, x in enumerate(parts):
        e[k, : len(x)] = x
    lengths = np.array([len(x) for x in parts])
    active = np.searchsorted(-lengths, -np.arange(len(parts[0])), side="left")
    return e, active.tolist(), (-(-active // WIDE) * WIDE).tolist()


def _kind_marginals(parts, trans) -> np.ndarray:
    """The marginals of the kinds (character, kind, part), 0 beyond a part's end; parts come longest first."""
    by_part, active, tiles = _side_by_side(parts)
    length, n = len(parts[0]), len(by_part)
    step = np.exp(trans - trans.max()).astype(np.float32)
    into = np.ascontiguousarray(step.T)
    e, both = np.empty((length, TAGS, n), np.float32), np.empty((length, TAGS, n), np.float32)
    x, y = np.ones((2, TAGS, n), np.float32)
    for a in range(0, length, BLOCK):
        z, m = min(length, a + BLOCK), tiles[a]
        e[a:z, :, :m] = by_part[:m, a:z].transpose(1, 2, 0)
        block = e[a:z, :, :m]
        block -= block.max(axis=1, keepdims=True)
        np.exp(block, out=block)
        both[a:z, :, :m] = block
        for t in range(max(1, a), z):
            m = tiles[t]
            now = both[t, :, :m]
            now *= np.matmul(into, both[t - 1, :, :m], out=x[:, :m])
            if t % SCALE == 0:
                now /= now.sum(axis=0)
    del by_part
    kinds, room = np.zeros((length, len(KINDS), n), np.float32), np.empty((BLOCK, TAGS, n), np.float32)
    x[:] = 1
    for a in range((length - 1) // BLOCK * BLOCK, -1, -BLOCK):
        z = min(length, a + BLOCK)
        for t in range(z - 1, a - 1, -1):
            if t < length - 1:
                m = tiles[t + 1]
                own = x[:, :m]
                np.matmul(step, np.multiply(e[t + 1, :, :m], own, out=y[:, :m]), out=own)
                if t % SCALE == 0:
                    own /= own.sum(axis=0)
                x[:, active[t + 1] : tiles[t]] = 1  # parts that end before t + 1 begin here
            np.multiply(both[t, :, : tiles[a]], x[:, : tiles[a]], out=room[t - a, :, : tiles[a]])
        block, own = room[: z - a, :, : tiles[a]], kinds[a:z, :, : tiles[a]]
        np.add(block[:, 1::2], block[:, 2::2], out=own)
        own /= block.sum(axis=1, keepdims=True)
    for t in range(len(parts[-1]), length):
        kinds[t, :, active[t] :] = 0
    return kinds[:, :, : len(parts)]


def _viterbi(parts, trans) -> list[np.ndarray]:
    """The best path of each part; parts come longest first."""
    by_part, active, tiles = _side_by_side(parts)
    best = np.ascontiguousarray(by_part[:, : len(parts[0])].transpose(1, 2, 0))
    length, n, steps = len(best), len(parts), trans[:, :, None]
    s = np.empty((TAGS, TAGS, best.shape[2]), np.float32)
    for t in range(1, length):
        m = tiles[t]
        best[t, :, :m] += np.add(best[t - 1, :, None, :m], steps, out=s[:, :, :m]).max(axis=0)
    path, tag, ended = np.zeros((n, length), np.int8), np.zeros(n, np.intp), 0
    for t in range(length - 1, -1, -1):
        m = active[t]
        tag[ended:m] = best[t, :, ended:m].argmax(axis=0)  # parts that end here
        path[:m, t], ended = tag[:m], m
        if t:
            tag[:m] = (best[t - 1, :, :m] + trans[:, tag[:m]]).argmax(axis=0)
    return [path[k, : len(x)] for k, x in enumerate(parts)]


def _runs(path) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(path)
    if not len(at):
        return []
    kind, begins = (path[at] - 1) // 2, path[at] % 2 == 1
    new = begins | np.r_[True, (kind[1:] != kind[:-1]) | (at[1:] != at[:-1] + 1)]
    return list(zip(kind[new].tolist(), at[new].tolist(), (at[np.r_[new[1:], True]] + 1).tolist(), strict=True))


_NUMBER = re.compile(r"\d+")
#: The end of a name, an at sign or how one is spelled, a host, and a dot or how one is spelled before each further part.
_MAIL = re.compile(r"[\w%+-](?:\s?[@＠]\s?|\s?[\[({]\s*at\s*[\])}]\s?|\sat\s)[\w-]+(?:(?:\s?[\[({]\s*dot\s*[\])}]\s?|\sdot\s|[.．])[\w-]+)+", re.I)


def _plausible(kind: str, piece: str) -> bool:
    """Whether a span of the model can be what it is said to be."""
    plain = piece.translate(_plain_digits())
    numbers = _NUMBER.findall(plain)
    digits = "".join(numbers)
    if kind == "email":
        return bool(_MAIL.search(piece))
    if kind == "ip":
        if ":" in piece:
            try:
                return ipaddress.ip_address(piece).version == 6
            except ValueError:
                return False
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in plain)
    return len(piece) >= 16 and not any(c.isspace() for c in piece) and any(c.isdigit() for c in piece)


def _possible(kind: str, run: str) -> bool:
    """Whether any piece of a run of characters can be plausible: what ``_plausible`` asks for of each kind, as far as more characters can't undo it."""
    if kind == "email":
        return ("@" in run or "＠" in run or "at" in run.lower()) and bool(_MAIL.search(run))
    if kind == "secret":
        return len(run) >= 16 and any(c.isdigit() for c in run)
    if kind == "ip":
        return ":" in run or len(_NUMBER.findall(run)) >= 4
    return sum(map(len, _NUMBER.findall(run))) >= (13 if kind == "card" else 7)


def find_all(p: dict[str, np.ndarray], texts: list[str], sure: float = SURE) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """``(base spans, spans that the model adds)`` of each text."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, model_spans(p, texts, sure, _possible), strict=True):
        added = []
        starts, ends = zip(*sorted((x, y) for _, x, y in own), strict=True) if own else ((), ())
        reach = list(accumulate(ends, max))
        for kind, a, z, q in more:
            while a < z and text[a] in _EDGE:
                a += 1
            while a < z and text[z - 1] in _EDGE:
                z -= 1
            if q >= sure and _plausible(kind, text[a:z]):
                before = bisect_left(starts, z)  # of the base spans that start before z, does one reach beyond a
                if not before or reach[before - 1] <= a:
                    added.append((kind, a, z))
        out.append((own, added))
    return out


def as_text(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that meet, the first names all."""
    parts, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*parts, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_personal_data(df: DataFrame, mask: bool = False) -> DataFrame:
    """The frame with ``spans`` (kind, start, end in code points, base) of its ``text``, masked where asked.

    A null text has no spans (and stays null); an empty one neither.  Repeated
    rows get equal results; an empty table stays empty; an existing column
    ``spans`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop("spans")
    p = model()
    schema = T.StructType([*df.schema.fields, T.StructField("spans", SPAN)])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            found = find_all(p, [t or "" for t in texts])
            columns = list(b.columns)
            if mask:
                columns[at] = pa.array([None if t is None else masked(t, [*x, *y]) for t, (x, y) in zip(texts, found, strict=True)], pa.string())
            rows = [[{"kind": k, "start": a, "end": z, "base": True} for k, a, z in x] + [{"kind": k, "start": a, "end": z, "base": False} for k, a, z in y] for x, y in found]
            columns.append(pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))))
            trim()
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "spans"])

    return df.mapInArrow(run, schema)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def op4_query(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans, n_added`` for each row."""
    found = find_personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")

    def run(batches):
        for b in batches:
            out = {f.split()[0]: [] for f in OUT.split(", ")}
            for r in b.to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
                more = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["base"]]
                row = (r["doc_id"], *(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(base + more), len(more))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return found.mapInArrow(run, OUT)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in train().items()})
