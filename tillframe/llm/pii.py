"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF.

The patterns' spans always stay. The tagger, trained in numpy from labelled spans, adds
what the patterns don't know: other written forms of the same kinds, such as telephone
numbers without a country code, and secrets, such as passwords and access keys. A screen,
counted from the same labelled texts, reads every character of every text: it passes over
stretches in which all trigrams of character classes belong to prose alone. All else is
tagged in overlapping windows, and Viterbi decodes each. A span that touches a window's
edge inside the text, and lies whole in no other window, gets a window of its own that
grows until the span ends within it. The best set of spans that don't overlap, over all
windows of a text and beside those of the patterns, is chosen by dynamic programming over
the whole text.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: What the tagger marks: the same, and what has no pattern.
TAGGED = (*KINDS, "secret")

# ---------------------------------------------------------------- patterns

#: The patterns of the four kinds. A match never begins inside a run of
#: digits, so the look-behinds change nothing but the time that long runs take.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def digits_of(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if c in _DIGITS]


def luhn(digits: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if octets(m.group())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the tagger

TAGS = 1 + len(TAGGED)  # 0: none
EMBED, HIDDEN = 12, 20
WINDOW, STRIDE, CONTEXT = 80, 40, 24
STEPS, BATCH = 450, 32
MARGIN = 1.0
#: Characters that are decoded at once, unless one window has more.
CELLS = 512 * WINDOW

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789 .,-+()@:/_%#\"'=\n"
_NUMBER = {c: k + 3 for k, c in enumerate(_SYMBOLS)}  # 0: past the end, 1: capital, 2: other
VOCABULARY = len(_SYMBOLS) + 3


def symbols(text: str) -> np.ndarray:
    return np.array([_NUMBER.get(c) or (1 if "A" <= c <= "Z" else 2) for c in text], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM each way, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"embed": r.normal(0, 0.5, (VOCABULARY, EMBED)).astype(np.float32), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {way + "x": draw(EMBED, 4 * HIDDEN), way + "h": draw(HIDDEN, 4 * HIDDEN), way + "b": bias}

    def run(self, x: np.ndarray, way: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, HIDDEN) for symbols x (time, batch), with what training needs if keep."""
        table = self.p["embed"] @ self.p[way + "x"] + self.p[way + "b"]
        n = HIDDEN
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, kept = [], []
        for t in x:
            z = table[t] + h @ self.p[way + "h"]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            if keep:
                kept.append((i, f, o, g, c, h))
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
        return np.stack(out), kept

    def scores(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, batch, TAGS), with what training needs if keep."""
        ahead, kept_f = self.run(x, "f", keep)
        back, kept_b = self.run(x[::-1], "b", keep)
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (both, kept_f, kept_b)

    def decode(self, u: np.ndarray) -> np.ndarray:
        """The best tags (time, batch), by Viterbi."""
        best, links = u[0], []
        for t in range(1, len(u)):
            options = best[:, :, None] + self.p["next"]
            links.append(options.argmax(1).astype(np.int8))
            best = options.max(1) + u[t]
        tags = [best.argmax(1)]
        for link in reversed(links):
            tags.append(link[np.arange(len(link)), tags[-1]])
        return np.stack(tags[::-1])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the CRF's negative log likelihood of tags y."""
        u, (both, kept_f, kept_b) = self.scores(x)
        n_time, n_batch = x.shape
        a, lookup = self.p["next"], np.arange(n_batch)

        def lse(v, axis):
            m = v.max(axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

        forward, backward = [u[0]], [np.zeros_like(u[0])]
        for t in range(1, n_time):
            forward.append(lse(forward[-1][:, :, None] + a, 1) + u[t])
        for t in range(n_time - 1, 0, -1):
            backward.append(lse(a + (u[t] + backward[-1])[:, None, :], 2))
        backward.reverse()
        forward, backward = np.stack(forward), np.stack(backward)
        total = lse(forward[-1], 1)
        du = np.exp(forward + backward - total[:, None])
        edges = np.exp(forward[:-1, :, :, None] + a + (u[1:] + backward[1:])[:, :, None, :] - total[:, None, None])
        d_next = edges.sum((0, 1))
        np.subtract.at(d_next, (y[:-1].ravel(), y[1:].ravel()), 1)
        for t in range(n_time):
            du[t, lookup, y[t]] -= 1
        du /= n_batch
        g = {"next": d_next / n_batch, "out": np.einsum("tbh,tbk->hk", both, du), "out_b": du.sum((0, 1)), "embed": np.zeros_like(self.p["embed"])}
        d_both, one_hot = du @ self.p["out"].T, np.eye(VOCABULARY, dtype=np.float32)
        for way, kept, dh_all, xs in (("f", kept_f, d_both[:, :, :HIDDEN], x), ("b", kept_b, d_both[::-1, :, HIDDEN:], x[::-1])):
            wh = self.p[way + "h"]
            dh = dc = np.zeros((n_batch, HIDDEN), np.float32)
            d_all, d_wh = np.zeros((n_time, n_batch, 4 * HIDDEN), np.float32), np.zeros_like(wh)
            for t in range(n_time - 1, -1, -1):
                i, f, o, gate, c_before, h_before = kept[t]
                tc = np.tanh(f * c_before + i * gate)
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gate * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gate * gate)], 1)
                d_all[t] = dz
                d_wh += h_before.T @ dz
                dh, dc = dz @ wh.T, dc * f
            d_table = one_hot[xs.ravel()].T @ d_all.reshape(-1, 4 * HIDDEN)
            g |= {way + "h": d_wh, way + "b": d_table.sum(0), way + "x": self.p["embed"].T @ d_table}
            g["embed"] += d_table @ self.p[way + "x"].T
        return g


def labelled_texts(r: random.Random, n: int) -> list[tuple[str, list[int]]]:
    """n made texts of at least a window, with the tag of each character."""
    digits, hexadecimal, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    letters = "etaoinshrdlucmfwypvbgkjqxzéèüñ"
    some = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    digit = lambda k: some(digits, k)
    word = lambda: some(letters[: r.randrange(8, 30)], r.randrange(1, 11))
    pick = lambda *x: r.choice(x)

    def email():
        name = word() + pick("", ".", "_", "-") + word() + pick("", digit(2), "." + digit(2))
        host = pick(word() + "." + word(), "mail" + digit(1) + "." + word() + ".com", word() + ".org")
        return name + pick("@", "@", " @ ", "(@)", " [@] ") + host

    def ip():
        parts = [str(r.randrange(256)) for _ in range(4)]
        return pick(".", ".", " . ", "[.]").join(parts)

    def card():
        d = digit(pick(15, 16, 16))
        return pick(d, *(s.join(d[k : k + 4] for k in range(0, len(d), 4)) for s in (" ", "-", ".", "/")))

    def phone():
        a, b, c = digit(3), digit(3), digit(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digit(2)} {digit(3)} {digit(7)}", f"00{digit(2)} {a} {b}{c}", f"({a}) {b} {c}")

    def secret():
        """What leads to a secret, the secret, and what closes it."""
        name = pick("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_token", "pwd", "key")
        value = pick(some(hexadecimal, r.randrange(16, 44)), some(hexadecimal, 40), some(hexadecimal, 18), some(upper + "abcdefghijklmnopqrstuvwxyz", r.randrange(16, 36)))
        quote = pick("", '"', "'")
        if r.random() < 0.3:
            return "", pick("AKIA", "AKIA", "ASIA") + some(upper, 7) + digit(1) + some(upper, 8), ""
        return name + pick("=", "=", " = ", ": ", ":") + quote, value, quote

    def other():
        return pick(digit(r.randrange(1, 7)), f"{digit(1)}.{digit(1)}", f"version {digit(1)}.{digit(1)}.{digit(2)}", f"20{digit(2)}-0{digit(1)}-1{digit(1)}", f"{digit(2)}/{digit(2)}/20{digit(2)}", f"${digit(3)}.{digit(2)}", "commit " + some(hexadecimal, 40), f"#{digit(8)}", f"{digit(2)}:{digit(2)}", f"@{word()}", f"id={digit(10)}{word()}", f"{digit(1)},{digit(3)},{digit(3)}", f"{word()}={word()}", f'{word()} = "{word()}"', word().upper() + word().upper(), some("*&#$%|", r.randrange(1, 9)), word() + pick("", ".", ",") + some("*&#$%|", r.randrange(1, 5)), word() + some(".,;!?", r.randrange(2, 5)) + pick("", word()), f"{word()}-{digit(2)}")

    def prose():
        return pick(word(), word(), word(), word().capitalize(), word() + pick(",", ".", ".\n", ";", ":", "!", "?"), f"({word()})", f"{word()}-{word()}", f"{word()}'{word()}", f'"{word()}"', "| " + word())

    out = []
    for _ in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 12:
            k = r.randrange(16)
            if k == 4:
                before, part, after = secret()
                text, tags = text + before, tags + [0] * len(before)
            else:
                part, after = ((email, ip, card, phone)[k]() if k < 4 else other() if k < 8 else prose()), ""
            part = part.upper() if k >= 5 and r.random() < 0.05 else part
            text += part + after
            tags += [k + 1 if k < 5 else 0] * len(part) + [0] * len(after)
            gap = pick(" ", " ", " ", " ", ", ", ". ", ".\n", "\n", " | ", ": ")
            text += gap
            tags += [0] * len(gap)
        out.append((text, tags))
    return out


@functools.lru_cache(maxsize=1)
def pool(seed: int = 17, n: int = 4000) -> list[tuple[str, list[int]]]:
    """The labelled texts that the tagger and its screen learn from."""
    return labelled_texts(random.Random(seed), n)


def labelled_windows(r: random.Random, n: int, texts: list[tuple[str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """n windows drawn from labelled texts (symbols and tags, time by batch)."""
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row, (text, tags) in enumerate(r.choices(texts, k=n)):
        skip, end = r.randrange(12), WINDOW if r.random() < 0.5 else r.randrange(20, WINDOW)
        found = symbols(text)[skip : skip + end]
        x[row, : len(found)], y[row, : len(found)] = found, tags[skip : skip + end]
    return x.T, y.T


#: Classes of bytes for the screen; bytes that are in none, those outside ASCII among them, are letters.
_CLASSES = (" \t\n\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", ":", "=", "\"'`", "([{", ")]}", "/_\\", "+", ",;!?", "#$%&*|~^<>")
_CLASS = np.zeros(256, np.uint16)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members.encode())] = _k + 1
def trigrams(data: np.ndarray) -> np.ndarray:
    """The number of the trigram of classes around each byte but the first and last."""
    c = _CLASS[data]
    return c[:-2] << 8 | c[1:-1] << 4 | c[2:]


@functools.lru_cache(maxsize=1)
def screen() -> np.ndarray:
    """Of each trigram of classes, whether a stretch that holds it is tagged.

    Telling are those that touch a labelled span so often that every labelled span holds
    one, however high that bar can be, and those that the labelled texts don't have.
    """
    inside, every, spans = np.zeros(4096), np.zeros(4096), []
    for text, tags in pool():
        tri = trigrams(np.frombuffer(text.encode(), np.uint8))
        tag = np.repeat(np.array(tags), [len(c.encode()) for c in text])
        inside += np.bincount(tri[(tag[:-2] > 0) | (tag[1:-1] > 0) | (tag[2:] > 0)], minlength=4096)
        every += np.bincount(tri, minlength=4096)
        cuts = np.flatnonzero(np.diff(np.r_[-1, tag, -1]))
        spans += [tri[max(b - 1, 0) : e - 1] for b, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) if tag[b] and e < len(tag)]
    share = inside / np.maximum(every, 1)
    return (every == 0) | (share >= min(share[x].max() for x in spans))


@functools.lru_cache(maxsize=1)
def trained(seed: int = 11) -> Tagger:
    """The tagger, fitted by Adam to made windows; the same for the same seed."""
    r, tagger = random.Random(seed), Tagger()
    mean = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for step in range(1, STEPS + 1):
        rate = 0.02 * min(1, step / 20) * (1 - step / (STEPS + 1))
        for k, g in tagger.gradients(*labelled_windows(r, BATCH, pool())).items():
            g = np.clip(g, -5, 5)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            tagger.p[k] = (tagger.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


def stretches(marks: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The parts of a text of so many characters within CONTEXT of the marks, which are sorted."""
    if not len(marks):
        return []
    cuts = np.flatnonzero(np.diff(marks) > 2 * CONTEXT)
    begins, ends = marks[np.r_[0, cuts + 1]] - CONTEXT, marks[np.r_[cuts, len(marks) - 1]] + 1 + CONTEXT
    return list(zip(np.maximum(begins, 0).tolist(), np.minimum(ends, size).tolist(), strict=True))


def screened(text: str) -> list[tuple[int, int]]:
    """The stretches of a text that the screen does not pass over."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        return []
    at = np.flatnonzero(screen()[trigrams(raw)]) + 1
    return stretches((np.cumsum((raw & 0xC0) != 0x80) - 1)[at], len(text))


#: An address as written, of which neither side goes on over white space.
_WRITTEN_EMAIL = re.compile(r"\S+ ?[\[(]?@[\])]? ?\S+")
_ONLY_NUMBER = re.compile(r"[0-9+()./\x20-]+")


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the tagger marks can be of its kind at all."""
    d = digits_of(text)
    if kind == "email":
        return bool(re.search(r"\w.*@.*\w\.\w", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[\s\[\]().]+[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in re.findall(r"[0-9]+", text))
    if kind == "secret":
        return len(text) >= 12 and not re.search(r"\s", text) and len(d) >= 2
    return bool(_ONLY_NUMBER.fullmatch(text)) and (13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15 and len(re.findall(r"[0-9]+", text)) >= 3)


def decoded(tagger: Tagger, texts: list[str], windows: list[tuple[int, int, int]]):
    """Of each window (text, start, end): its number, its tags, and its scores by character and tag."""
    order = sorted(range(len(windows)), key=lambda k: windows[k][2] - windows[k][1])
    while order:
        long = windows[order[-1]][2] - windows[order[-1]][1]
        some = [order.pop() for _ in range(min(len(order), max(1, CELLS // long)))]
        x = np.zeros((len(some), long), np.int64)
        for row, k in enumerate(some):
            n, b, e = windows[k]
            x[row, : e - b] = symbols(texts[n][b:e])
        u = tagger.scores(x.T, False)[0]
        tags, u = tagger.decode(u).T, u.transpose(1, 0, 2)
        for row, k in enumerate(some):
            size = windows[k][2] - windows[k][1]
            yield k, tags[row, :size], u[row, :size]


def united(cut: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts (text, start, end), those of a text that overlap or touch made one."""
    out: list[list[int]] = []
    for n, s, e in sorted(cut):
        if out and out[-1][0] == n and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([n, s, e])
    return [(n, s, e) for n, s, e in out]


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """For each text, the plausible spans (weight, kind, start, end), each read whole in some window."""
    windows = [(n, b, min(b + WINDOW, e)) for n, text in enumerate(texts) for s, e in screened(text) for b in range(s, max(s + 1, e - WINDOW + STRIDE), STRIDE)]
    targets = windows
    out: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    while windows:
        cut, whole = [], []
        for k, line, u in decoded(tagger, texts, windows):
            (n, b, e), (_, low, high) = windows[k], targets[k]
            cuts = np.flatnonzero(np.diff(np.r_[-1, line, -1]))
            for s, t in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                tag = int(line[s])
                if not tag or b + s >= high or b + t <= low:
                    continue
                word = texts[n][b + s : b + t]
                if (s == 0 and b > 0) or (b + t == e and e < len(texts[n])):
                    if TAGGED[tag - 1] in ("email", "secret") or len(digits_of(word)) <= 19:  # a number of more digits is of no kind, however far it goes
                        cut.append((n, b + s, b + t))
                    continue
                whole.append((n, b + s, b + t))
                trimmed = word.strip(" \n.,:|\"'=")
                if TAGGED[tag - 1] == "email" and (m := _WRITTEN_EMAIL.search(trimmed)):
                    trimmed = m.group()
                if plausible(TAGGED[tag - 1], trimmed):
                    start = b + s + word.find(trimmed)
                    margin = float((u[s:t, tag] - u[s:t, 0]).mean())
                    if margin >= MARGIN:
                        out[n].append((margin * len(trimmed), TAGGED[tag - 1], start, start + len(trimmed)))
        targets, whole = united(cut), sorted(whole)
        furthest: dict[tuple[int, int], int] = {}
        high = 0
        for k, (n, s, e) in enumerate(whole):
            high = e if k == 0 or whole[k - 1][0] != n else max(high, e)
            furthest[n, s] = high
        keys = list(furthest)
        inside = lambda n, s, e: (k := bisect_right(keys, (n, s))) > 0 and keys[k - 1][0] == n and furthest[keys[k - 1]] >= e
        targets = [x for x in targets if not inside(*x)]
        windows = [(n, max(0, s - max(STRIDE, e - s)), min(len(texts[n]), e + max(STRIDE, e - s))) for n, s, e in targets]
    return [whole_secrets(text, _widest(found)) for text, found in zip(texts, out, strict=True)]


def _widest(found: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
    """found without what lies inside a longer span of its kind: another window has read it further."""
    out: list[tuple[float, str, int, int]] = []
    end: dict[str, int] = {}
    for x in sorted(set(found), key=lambda x: (x[2], -x[3], -x[0])):
        if x[3] > end.get(x[1], -1):
            out.append(x)
            end[x[1]] = x[3]
    return out


#: Characters that a secret goes on over; a dot as well, between two of them.
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+-")


def whole_secrets(text: str, found: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
    """found, the secrets among them grown to the tokens that they are part of: half a secret, left in a text, is one."""

    def joins(i: int) -> bool:
        return text[i] in _TOKEN or text[i] == "." and 0 < i < len(text) - 1 and text[i - 1] in _TOKEN and text[i + 1] in _TOKEN

    out, last = [x for x in found if x[1] != "secret"], None
    for w, kind, s, e in sorted((x for x in found if x[1] == "secret"), key=lambda x: (x[2], -x[3])):
        if last and s < last[3]:  # of a token that is whole already, or over its end
            s = last[2]
        else:
            while s > 0 and joins(s - 1):
                s -= 1
        e = max(e, last[3]) if last and s == last[2] else e
        while e < len(text) and (joins(e) or text[e] == "=" and text[e - 1] != " "):
            e += 1
        if last and s == last[2]:
            w, out = max(w, last[0]), out[:-1]
        last = (w, kind, s, e)
        out.append(last)
    return out


def reconcile(base: list[tuple[str, int, int]], found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and the found spans of most weight that overlap neither them nor each other."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = np.maximum.accumulate([e for _, e in taken]) if taken else []
    free = []
    for w, kind, s, e in sorted(set(found), key=lambda x: (x[3], x[2], x[1])):
        k = bisect_right(starts, e - 1)
        if not k or furthest[k - 1] <= s:
            free.append((w, kind, s, e))
    ends = [x[3] for x in free]
    best, choice = [0.0], []
    for k, (w, _, s, _) in enumerate(free):
        before = bisect_right(ends, s, 0, k)
        choice.append((best[before] + w > best[-1], before))
        best.append(max(best[-1], best[before] + w))
    added, k = [], len(free)
    while k:
        use, before = choice[k - 1]
        if use:
            added.append(free[k - 1][1:])
        k = before if use else k - 1
    return sorted({*base, *added}, key=lambda x: (TAGGED.index(x[0]), x[1], x[2]))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
Spans = list[tuple[str, int, int]]


def _found(texts: list[str], tagger: Tagger) -> list[tuple[Spans, Spans]]:
    """The patterns' spans of each text, and those with what the tagger adds."""
    out = []
    for text, found in zip(texts, tagged_spans(tagger, texts), strict=True):
        own = pattern_spans(text)
        out.append((own, reconcile(own, found)))
    return out


def _read(batch: pa.RecordBatch, text: str, tagger: Tagger):
    """The rows of a batch that may hold anything: row number, text, base, spans."""
    whole, at = common.texts_of(batch.column(batch.schema.get_field_index(text)))
    suspect = screen()
    for i, j in common.chunks(at):
        data = whole[at[i] : at[j]]
        if len(data) > 2:
            hits = np.flatnonzero(suspect[trigrams(data)]) + 1 + at[i]
            rows = np.unique(np.searchsorted(at, hits, "right") - 1)
            texts = [whole[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in rows]
            yield from zip(rows.tolist(), texts, _found(texts, tagger), strict=True)


def find(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs without its text, with base and spans: arrays of (kind, start, end).

    Starts and ends count code points, ends are exclusive. base holds what the patterns
    find, spans that and what the tagger adds, both by kind and start. Null and empty
    texts have none; repeated rows stay repeated; columns of the new names are replaced.
    An empty table gives an empty table.
    """
    docs = docs.drop("base", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    kept = [f.name for f in docs.schema.fields if f.name != text]

    def work(batch: pa.RecordBatch):
        base: list[list] = [[]] * batch.num_rows
        spans: list[list] = [[]] * batch.num_rows
        for r, _, (own, all_) in _read(batch, text, shared.value):
            base[r] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in own]
            spans[r] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in all_]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(base, _SPAN_TYPE), pa.array(spans, _SPAN_TYPE)], names=[*kept, "base", "spans"])

    return docs.mapInArrow(common.batched(work), common.schema_of(docs, f"base {_SPANS}, spans {_SPANS}", (text,)))


def masked(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; the rest stays.

    A null text stays null. Where spans of patterns overlap, the mask covers their union
    under the kind that begins first. Other columns pass through, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def work(batch: pa.RecordBatch):
        k = batch.schema.get_field_index(text)
        changed: dict[int, str] = {}
        for r, t, (_, spans) in _read(batch, text, shared.value):
            out, end = [], 0
            for kind, start, stop in sorted(spans, key=lambda x: (x[1], -x[2])):
                if start >= end:
                    out += [t[end:start], f"[{kind}]"]
                end = max(end, stop)
            if spans:
                changed[r] = "".join([*out, t[end:]])
        columns = list(batch.columns)
        if changed:
            values = columns[k].to_pylist()
            for r, t in changed.items():
                values[r] = t
            columns[k] = pa.array(values, batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(common.batched(work), docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("private"))
