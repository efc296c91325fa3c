"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns find the base spans. The network reads every text in overlapping windows; where two overlap, their label
scores are blended, and one Viterbi path over the whole text reconciles them (characters that are provably unlabelled on
the best path cut it into stretches, so only these are decoded). Network and transitions are trained in numpy on labelled
spans, disguised ones among them. What the path finds beside the base spans is added if it is sure and could be of its
kind.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import schema_with, set_aside, slices, string_buffers

#: Kinds in their order, and the base patterns. Numbers joined by dots are matched as one chain, four of
#: which are an address, so that no digit is read twice.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a window, and those that it shares with the next.
WINDOW, SHARED = 256, 32
HIDDEN, EMBEDDED = 12, 10
#: Weight of each character's own labels in training, and the largest score of a transition.
ALONE, STEPPING = 2.0, 1.0
#: Windows that are read side by side.
WINDOWS = 1024
#: Least mean label probability of an added span.
SURE = 0.5
#: Score of O, and less of all others, behind the end of a text.
_SURELY = 50.0
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_STOPS = " \t\r\n.,;:!?|#$\"'"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, leftmost and without overlap in each kind, by start and kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        # the leftmost match that has this @ starts where the run of local characters before it does
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- network

_CHARS = " \n@.-+()_%/:,;\"'=#*&$!?[]{}<>|~abcdefghijklmnopqrstuvwxyz"
_CLASS = np.zeros(0x3000, np.uint8)
_CLASS[:] = 1  # any other
_CLASS[[c for c in range(0x3000) if chr(c).isalpha()]] = 2
for _i, _c in enumerate(_CHARS):
    _CLASS[[ord(_c), ord(_c.upper())]] = 4 + _i
_CLASS[ord("0") : ord("9") + 1] = 3
CLASSES = 4 + len(_CHARS)  # 0 is padding


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(code, 0x2FFF)]


def _soft(x: np.ndarray) -> np.ndarray:
    """The network's squashing function, from -1 to 1."""
    return x / (1 + np.abs(x))


def _soft_in_place(x: np.ndarray, room: np.ndarray) -> None:
    np.abs(x, out=room)
    room += 1
    x /= room


class Network:
    """Embedding, one LSTM in each direction, label scores, and transitions between labels.

    The cells' input and forget gates are coupled: a cell keeps the share that it does not take in.
    """

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h, e, k = HIDDEN, EMBEDDED, len(LABELS)
        self.p = {"emb": r.normal(0, 0.5, (CLASSES, e))}
        for d in ("f", "b"):
            self.p[f"w{d}"] = r.normal(0, 1.5 * e**-0.5, (e, 3 * h))
            self.p[f"u{d}"] = r.normal(0, h**-0.5, (h, 3 * h))
            self.p[f"c{d}"] = np.concatenate([np.linspace(0, 4, h), np.zeros(2 * h)])  # cells that forget soon and late
        self.p["out"] = r.normal(0, (2 * h) ** -0.5, (2 * h, k))
        self.p["bias"] = np.zeros(k)
        self.p["step"] = np.zeros((k, k))

    @staticmethod
    def allowed() -> np.ndarray:
        """0, or very low where a label cannot follow another (rows: from)."""
        k = len(LABELS)
        low = np.zeros((k, k), np.float32)
        for j in range(2, k, 2):
            low[:, j] = -1e4
            low[j, j] = low[j - 1, j] = 0
        return low

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels of windows (batch, time), and its gradient."""
        n, t = x.shape
        h, k = HIDDEN, len(LABELS)
        states, memory = np.zeros((n, t, 2 * h)), {}
        for d, times in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            table, u = self.p["emb"] @ self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
            hid, cell, trace = np.zeros((n, h)), np.zeros((n, h)), []
            for i in times:
                z = _soft(table[x[:, i]] + hid @ u)
                f, o, new = 0.5 * z[:, :h] + 0.5, 0.5 * z[:, h : 2 * h] + 0.5, z[:, 2 * h :]
                was = cell
                cell = new + f * (was - new)
                squashed = _soft(cell)
                trace.append((i, hid, was, z, squashed))
                hid = o * squashed
                states[:, i, (0 if d == "f" else h) : (h if d == "f" else 2 * h)] = hid
            memory[d] = trace
        emit = states @ self.p["out"] + self.p["bias"]
        # the field: forward and backward sums, scaled at every step; a window may begin inside a span
        path = np.exp(self.p["step"] + self.allowed())
        top = emit.max(2, keepdims=True)
        e = np.exp(emit - top)
        fore, aft, scale = np.zeros((n, t, k)), np.ones((n, t, k)), np.zeros((n, t, 1))
        for i in range(t):
            fore[:, i] = e[:, i] * (fore[:, i - 1] @ path if i else 1)
            scale[:, i] = fore[:, i].sum(1, keepdims=True)
            fore[:, i] /= scale[:, i]
        for i in range(t - 2, -1, -1):
            aft[:, i] = (e[:, i + 1] * aft[:, i + 1] / scale[:, i + 1]) @ path.T
        total = np.log(scale).sum((1, 2)) + top.sum((1, 2))
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = emit[rows, cols, y].sum(1) + (self.p["step"] + self.allowed())[y[:, :-1], y[:, 1:]].sum(1)
        ahead = (e * aft / scale)[:, 1:].reshape(-1, k)
        g: dict[str, np.ndarray] = {"step": path * (fore[:, :-1].reshape(-1, k).T @ ahead)}
        np.add.at(g["step"], (y[:, :-1], y[:, 1:]), -1)
        own = e / e.sum(2, keepdims=True)  # the labels of each character by itself count as well, so that scores are sure
        total = total - ALONE * np.log(own[rows, cols, y]).sum(1)
        d = fore * aft + ALONE * own
        d[rows, cols, y] -= 1 + ALONE
        g["out"] = states.reshape(-1, 2 * h).T @ d.reshape(-1, k)
        g["bias"] = d.sum((0, 1))
        back = d @ self.p["out"].T
        g["emb"] = np.zeros_like(self.p["emb"])
        kinds = (x.ravel()[:, None] == np.arange(CLASSES)).astype(float)
        for way in ("f", "b"):
            u, own = self.p[f"u{way}"], back[:, :, :h] if way == "f" else back[:, :, h:]
            dh, dc = np.zeros((n, h)), np.zeros((n, h))
            gu, every = np.zeros_like(u), np.zeros((n, t, 3 * h))
            for i, hid, was, z, squashed in reversed(memory[way]):
                f, o, new = 0.5 * z[:, :h] + 0.5, 0.5 * z[:, h : 2 * h] + 0.5, z[:, 2 * h :]
                dh = dh + own[:, i]
                dc = dc + dh * o * (1 - np.abs(squashed)) ** 2
                dz = np.hstack([0.5 * dc * (was - new), 0.5 * dh * squashed, dc * (1 - f)]) * (1 - np.abs(z)) ** 2
                gu += hid.T @ dz
                every[:, i] = dz
                dh, dc = dz @ u.T, dc * f
            gx = kinds.T @ every.reshape(-1, 3 * h)
            g[f"u{way}"], g[f"c{way}"] = gu, gx.sum(0)
            g[f"w{way}"] = self.p["emb"].T @ gx
            g["emb"] += gx @ self.p[f"w{way}"].T
        return float((total - gold).mean()), {key: v / n for key, v in g.items()}

    def read(self, x: np.ndarray) -> np.ndarray:
        """Label scores (label, window, time) of windows of classes (time, window)."""
        t, n = x.shape
        h = HIDDEN
        states = np.empty((t, 2 * h, n), np.float32)
        z, room = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        f, o, new = z[:h], z[h : 2 * h], z[2 * h :]
        for d, times in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            table = np.ascontiguousarray((self.p["emb"] @ self.p[f"w{d}"] + self.p[f"c{d}"]).T, np.float32)
            u = np.ascontiguousarray(self.p[f"u{d}"].T, np.float32)
            hid, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for i in times:
                np.matmul(u, hid, out=z)
                np.take(table, x[i], axis=1, out=room, mode="clip")
                z += room
                _soft_in_place(z, room)
                z[: 2 * h] *= 0.5
                z[: 2 * h] += 0.5
                cell -= new
                cell *= f
                cell += new
                hid = states[i, :h] if d == "f" else states[i, h:]
                np.abs(cell, out=room[:h])
                room[:h] += 1
                np.divide(cell, room[:h], out=hid)
                hid *= o
        emit = np.matmul(np.ascontiguousarray(self.p["out"].T, np.float32), states)
        emit += self.p["bias"].astype(np.float32)[:, None]
        return np.ascontiguousarray(emit.transpose(1, 2, 0))

    def paths(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels (batch, time) of padded stretches of scores, the shortest first, between two labels O: a text
        counts as if O stood before and behind it."""
        n, t, k = emit.shape
        low = self.allowed()
        step = (self.p["step"] + low).astype(np.float32)
        emit = np.ascontiguousarray(emit.transpose(1, 2, 0))
        free, inside = [0, *range(1, k, 2)], np.arange(2, k, 2)  # labels that may follow any, and those that go on
        best = emit[0] + step[0][:, None]
        back = np.empty((t, k, n), np.int8)
        rows = np.arange(n)
        new, source = np.empty((k, n), np.float32), np.empty((k, n), np.int8)
        for i in range(1, t):
            top, at = best[0] + step[0, free][:, None], np.zeros((len(free), n), np.int8)
            for j in range(1, k):
                v = best[j] + step[j, free][:, None]
                np.copyto(at, j, where=v > top)
                np.maximum(top, v, out=top)
            begun, gone = best[inside - 1] + step[inside - 1, inside][:, None], best[inside] + step[inside, inside][:, None]
            new[free], source[free] = top, at
            new[inside], source[inside] = np.maximum(begun, gone), inside[:, None] - (begun >= gone)
            new += emit[i]
            live = int(np.searchsorted(lengths, i, "right"))  # lengths ascend: those before have ended
            best[:, live:] = new[:, live:]
            back[i, :, live:], back[i, :, :live] = source[:, live:], np.arange(k)[:, None]
        best = best + step[:, 0][:, None]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(0)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i, out[:, i], rows]
        return out

    def open_stretches(self, emit: np.ndarray, starts: np.ndarray, goes_on: bool) -> np.ndarray:
        """Where the best path may hold another label than O: a flag for each character of scores (label, character).

        starts flags the first characters of texts; goes_on says that the last text does. A character is O on the best
        path if putting O in place of the labels around it, as far as O is ahead by far, must raise the score: the sum
        of the leads there beats all that the transitions at both ends and a span begun anew behind it can cost.
        """
        low = self.allowed()
        fine, step = low > -1, (self.p["step"] + low).astype(np.float64)
        size, n = len(LABELS), emit.shape[1]
        begin, inside = [0, *range(1, size, 2)], range(2, size, 2)
        into = np.where(fine, step, -np.inf).max(0) - step[0, 0]  # the most that stepping into a label brings
        lead = emit[0] - (emit[1:] + into[1:, None].astype(np.float32)).max(0)
        enter = max(0.0, step[0, 0] - step[:, 0].min())
        leave = max(0.0, max(step[i, j] - step[0, j] for i in range(1, size) for j in begin))
        again = max(max(step[j, j], step[j - 1, j]) - step[0, j - 1] + max(0.0, max(step[j, m] - step[j - 1, m] for m in [*begin, j])) for j in inside)
        quiet = lead > 0
        anew = np.maximum((emit[2::2] - emit[1::2]).max(0), 0)  # what beginning a span costs against going on
        gap = self.p["out"][:, 2::2] - self.p["out"][:, 1::2]
        most = max(0.0, float((np.abs(gap).sum(0) + self.p["bias"][2::2] - self.p["bias"][1::2]).max())) if goes_on else 0.0
        ends = quiet & np.append(~quiet[1:] | starts[1:], True)
        stop = np.minimum.accumulate(np.where(ends, np.arange(n), n)[::-1])[::-1]  # of the quiet run
        sums = np.concatenate([[0.0], np.cumsum(np.where(quiet, lead, 0), dtype=np.float64), [0.0]])
        behind = np.concatenate([np.where(starts, 0, anew), [most, 0.0]])
        return ~((lead > enter + leave) & (sums[stop + 1] - sums[:n] > enter + np.maximum(leave, again + behind[stop + 1])))


# ---------------------------------------------------------------- labelled spans


_SYLLABLES = (
    "the and of to in that is was for it on be at by an er ing tion ed ly re en st nd wh sh th ou ha ble on in es al",
    "le la de et un une que ou du les ment tion eau eux ie oi ai er re en ce on ç é è ê tre ille an que",
    "der die das und zu ein keit ung lich sch ver ge be er en ch ü ö ä ß pf zt st ich au ei heit",
    "el la de que y en los las se por con para ción dad mente ado ido os as ar ñ í ó á ia ja ro co mi ta",
)


def labelled_text(r: random.Random, size: int) -> tuple[str, np.ndarray]:
    """Made-up text and its labels: spans of all kinds, as the patterns know them and as people disguise them, and
    numbers, words and signs that are none."""
    word = lambda: "".join(r.choice(parts_of) for _ in range(r.randint(1, 4))) if r.random() < 0.8 else "".join(r.choice("abcdefghiklmnoprstuvwyéèüöñ") for _ in range(r.randint(1, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    ascii_ = lambda a=1, b=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    plain = lambda: "".join(r.choice(_SYLLABLES[0].split()) for _ in range(r.randint(1, 3)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        n = r.choice([14, 15, 16, 16, 16, 19])
        d = r.choice("3456") + digits(n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", "", " ", "-", "-", ".", "/", " - ", "  ", "_"]).join(d[i : i + 4] for i in range(0, n, 4))

    def email() -> str:
        local = r.choice([plain(), ascii_(), plain() + r.choice("._-+") + plain(), plain() + "." + digits(2), plain() + "." + digits(2), plain().upper(), "." + digits(2)])
        host, end = r.choice([ascii_(2), plain() + "x", "mail"]) + r.choice(["", "", digits(1)]), r.choice(["com", "org", "net", "de", "fr", "es", "co.uk", "example.com", "example.org"])
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", "."), (" @ ", " . "), (" AT ", " DOT "), ("@", " dot ")])
        return local + at + (host + "." + end).replace(".", dot)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{digits(12)}", f"+49 {a} {digits(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{digits(3)} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"00{digits(2)} {a} {digits(7)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])

    def ip() -> str:
        return r.choice([".", ".", ".", " . ", "[.]", "(.)", " dot ", " ."]).join(str(r.randint(0, 255)) for _ in range(4))

    def none() -> str:
        return r.choice([
            digits(r.randint(1, 6)), digits(r.randint(1, 9)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}",
            f"v{digits(1)}.{digits(1)}.{digits(2)}", f"version {digits(1)}.{digits(1)}", hexes(r.choice([8, 12, 32, 40])), f'token = "{hexes(r.choice([20, 40]))}"', f'TOKEN = "{hexes(40).upper()}"', f'key = "{hexes(16)}"', "@" + word(), f"{digits(2)}:{digits(2)}",
            f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)}%", "### $$$", f"({digits(4)})", digits(r.choice([20, 25, 30])), f"CC BY-NC {digits(1)}.{digits(1)}.", f"{word()} at {word()}", f"{word()} at the {word()} dot", f"at {digits(2)} {word()}", "at", "dot",
            f"a dot {word()} at {word()}", f"{digits(1)}. {word()}", f"{digits(2)} {digits(2)} {digits(2)}", f"{digits(3)}-{digits(4)}", f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(4)} {digits(4)}", f"#{digits(7)}", f"{digits(4)}/{digits(2)}", " | ".join(digits(2) for _ in range(3)),
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "none": none}
    parts, labels, length, parts_of, between, loud = [], [], 0, _SYLLABLES[0].split(), " ", False

    def put(s: str, kind: str = "none") -> None:
        nonlocal length
        parts.append(s)
        length += len(s)
        k = KINDS.index(kind) if kind != "none" else -1
        labels.extend([0] * len(s) if k < 0 else [2 * k + 1] + [2 * k + 2] * (len(s) - 1))

    while length < size:
        if r.random() < 0.02:
            parts_of = r.choice(_SYLLABLES).split()
            between, loud = r.choice([" "] * 6 + [" | ", "!! ", "*** ", "### ", "$$$ ", "%% ", ". ", ", ", "\n", " - "]), r.random() < 0.12
        if r.random() < 0.15:
            kind = r.choice([*KINDS, "email", "phone", *["none"] * 8])
            put(r.choice(["", "", "", "(", '"', ": ", ":", "### ", "| ", "tel. ", "ip ", "mail "]))
            put(makers[kind](), kind)
            put(r.choice(["", "", "", "", ".", ",", ")", '"', "###", "$$$", "!!", " |"]))
        else:
            w = word() if r.random() < 0.9 else ascii_()
            put(w.upper() if loud else r.choice([w, w, w, w, w, w.capitalize(), w + ",", w + ".", w + r.choice(["***", "!!", ";", ":", "###"])]))
        put(between if r.random() < 0.93 else r.choice([" ", " ", "\n"]))
    return "".join(parts)[:size], np.array(labels[:size])


@lru_cache(maxsize=1)
def trained(steps: int = 1300, batch: int = 40, size: int = 128, seed: int = 3, characters: int = 600_000) -> Network:
    """Adam on windows of made-up labelled text, once a process."""
    r, net = random.Random(seed), Network()
    at = np.random.default_rng(seed)
    text, labels = labelled_text(r, characters)
    codes = classes(text)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = at.integers(0, characters - size, batch)[:, None] + np.arange(size)
        _, g = net.gradient(codes[rows], labels[rows])
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        rate = 0.05 * min(1, step / 50) * (0.5 + 0.5 * np.cos(np.pi * step / steps) + 0.01)
        for k, v in g.items():
            v = v * min(1.0, 20 / norm)
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v * v
            net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        np.clip(net.p["step"], -STEPPING, STEPPING, out=net.p["step"])
    return net


# ---------------------------------------------------------------- detection


def network_spans(texts: list[str], net: Network) -> list[list[tuple[Span, float]]]:
    """Spans of the global paths with their mean label probabilities, for each text; every character is read."""
    stride = WINDOW - SHARED
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = -(-sizes // stride)
    first = np.concatenate([[0], np.cumsum(windows)])
    out: list[list[tuple[Span, float]]] = [[] for _ in texts]
    count = int(first[-1])
    if not count:
        return out
    codes = np.zeros(count * stride + SHARED, np.uint8)
    for k, text in enumerate(texts):
        codes[first[k] * stride : first[k] * stride + len(text)] = classes(text)
    of = np.repeat(np.arange(len(texts)), windows)
    begins = np.concatenate([[True], of[1:] != of[:-1]])  # windows that begin a text
    follows = np.append(~begins[1:], False)  # windows that another of their text follows
    ramp = (np.arange(1, SHARED + 1) / (SHARED + 1)).astype(np.float32)
    kept_at, kept_emit, tail = [], [], np.zeros((len(LABELS), 1, SHARED), np.float32)
    carry = np.zeros((len(LABELS), 0), np.float32)  # scores of the characters whose stretch the next windows may go on with
    for a in range(0, count, WINDOWS):
        b = min(a + WINDOWS, count)
        at = np.arange(a, b) * stride + np.arange(WINDOW)[:, None]
        x = codes[at].astype(np.intp)
        x[stride:, ~follows[a:b]] = 0
        emit = net.read(x)
        body, tails = emit[:, :, :stride], emit[:, :, stride:]
        earlier = np.concatenate([tail, tails[:, :-1]], 1)
        go_on = ~begins[a:b]
        body[:, go_on, :SHARED] = body[:, go_on, :SHARED] * ramp + earlier[:, go_on] * (1 - ramp)
        tail = tails[:, -1:].copy()
        padding = codes[a * stride : b * stride].reshape(b - a, stride) == 0  # O by definition
        body[0][padding] = _SURELY
        body[1:, padding] = -_SURELY
        base = a * stride - carry.shape[1]
        flat = np.concatenate([carry, body.reshape(len(LABELS), -1)], 1)
        starts = np.zeros(flat.shape[1], bool)
        starts[np.flatnonzero(begins[a:b]) * stride + carry.shape[1]] = True
        goes_on = b < count and not begins[b]
        open_ = net.open_stretches(flat, starts, goes_on)
        cut = flat.shape[1]
        if goes_on:  # the last stretch may go on: it is held back
            cut = int(np.flatnonzero(~open_).max(initial=-1)) + 1
        carry = flat[:, cut:].copy()
        mine = np.flatnonzero(open_[:cut])
        kept_at.append(mine + base)
        kept_emit.append(flat[:, mine].T)
    at, emit = np.concatenate(kept_at), np.concatenate(kept_emit)
    if not len(at):
        return out
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[at[1:] // stride] != of[at[:-1] // stride])])
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(at)))
    text_of = of[at[heads] // stride]
    place = at[heads] - first[text_of] * stride  # in its text
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        longest, b = int(length[order[a]]), a + 1
        while b < len(order) and (b - a + 1) * int(length[order[b]]) <= max(1 << 18, longest):
            b += 1
        part = order[a:b]
        longest = int(length[part[-1]])
        cols = heads[part][:, None] + np.minimum(np.arange(longest), length[part][:, None] - 1)
        mine = emit[cols]
        path = net.paths(mine, length[part])
        e = np.exp(mine - mine.max(2, keepdims=True))
        sure = np.take_along_axis(e / e.sum(2, keepdims=True), path[:, :, None], 2)[:, :, 0]
        for row, s in enumerate(part.tolist()):
            p, base = path[row, : length[s]], int(place[s])
            for begin in np.flatnonzero(p % 2 == 1).tolist():
                stop = begin + 1
                while stop < len(p) and p[stop] == p[begin] + 1:
                    stop += 1
                k = int(text_of[s])
                first_, last = _trimmed(texts[k], base + begin, base + stop)
                if first_ < last:
                    out[k].append(((first_, (int(p[begin]) - 1) // 2, last), float(sure[row, begin:stop].mean())))
        a = b
    return [sorted(x) for x in out]


def _possible(text: str, kind: int) -> bool:
    """Whether a span could be of its kind, however its signs are written."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        low = text.lower()
        return ("@" in low or re.search(r"[^a-z]at[^a-z]", low) is not None) and ("." in low.partition("@")[2] or re.search(r"[^a-z]dot[^a-z]", low) is not None) and "\n" not in text
    if kind == 1:
        return len(numbers) == 4 and all(len(n) < 4 and int(n) < 256 for n in numbers)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15 and "\n" not in text


def all_spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, found in zip(texts, network_spans(texts, net), strict=True):
        base = base_spans(text)
        whole = list(base)
        ends = sorted(base)
        taken = [s for s, _, _ in ends]
        reach = list(accumulate((e for _, _, e in ends), max))
        for (start, kind, end), sure in found:
            k = bisect_left(taken, end)
            if sure >= SURE and not (k and reach[k - 1] > start) and _alone(text, start, end) and _possible(text[start:end], kind):
                whole.append((start, kind, end))
        out.append((base, sorted(whole)))
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without white space, stops and quotes at its ends, and without a bracket that it does not open."""
    while end > start and (text[end - 1] in _STOPS or text[end - 1] == ")" and "(" not in text[start:end] or text[end - 1] == "]" and "[" not in text[start:end]):
        end -= 1
    while end > start and text[start] in _STOPS and not (text[start] == "." and text[start + 1 : start + 2].isdigit()):
        start += 1
    return start, end


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on before or behind."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, text: str = "text", net: Network | None = None) -> DataFrame:
    """docs with pii (all spans) and pii_base (those of the patterns): arrays of (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then by kind. Null texts count as empty and have none. Other columns and
    repeated rows pass through, columns of these names under a leading underscore; an empty table gives an empty table.
    """
    docs = set_aside(docs, "pii", "pii_base")
    net = net or trained()
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offs = string_buffers(column)
            base, whole = [], []
            for a, b in slices(offs):
                one, two = zip(*all_spans(["" if x is None else x for x in column.slice(a, b - a).to_pylist()], net), strict=True)
                base += one
                whole += two
            told = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in part], arrow) for part in (whole, base)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "pii", "pii_base"])

    return docs.mapInArrow(run, schema_with(docs.schema, pii=span, pii_base=span))


def op6_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("pii_base").cast("binary"), 256).alias("base_sha256"), text("pii").alias("spans"))
