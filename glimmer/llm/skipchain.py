"""A skip-chain conditional random field over the words of a text, for personal data that fixed patterns miss.

Labels are O and the kinds. A word's own potential depends on its shape and on the shapes and classes (see CLASSES) of
the words around it; words next to each other share a chain potential, and words of a text that repeat or resemble each
other (the same letters and digits, or the same last seven digits, however they are written) share a skip potential,
each occurrence with the next one, so their number is linear. Words that hold no digit, no @ and are in no class, and do
not stand next to one that does, are O by construction; the field is over the others, the active words. Words inside a
span already known are clamped to its kind, and loopy sum-product messages carry what is known of one occurrence, or
what its surroundings say, to all others. All texts of a batch are one graph of separate parts.

The field is fitted by pieces: word potentials by multinomial logistic regression, chain and skip potentials by the
pointwise mutual information of the labels at their two ends. The labelled texts are made up by ``labelled_texts`` from
a seed, TRAIN_TEXTS of them, so the fit takes a second in the driver and is the same at every run and every size.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
TRAIN_TEXTS = 2500
#: Descent on the word potentials: steps, and the pull of each weight to zero.
STEPS = 80
DECAY = 0.3
#: Rounds of messages at prediction.
ROUNDS = 12
DAMPING = 0.3
#: Strength of a clamp.
KNOWN = 12.0
#: A word takes a kind if the messages give it at least this probability.
SURE = 0.6

#: Words that announce a kind, or stand for signs in written-out addresses (fixed values).
CLASSES = {
    "key": "token key apikey api_key secret password passwd pwd credential credentials bearer passwort schlüssel clave contraseña jeton clé",
    "tel": "phone tel telephone mobile cell call fax whatsapp sms telefon handy teléfono móvil téléphone portable",
    "mail": "mail email e-mail contact kontakt correo courriel",
    "ip": "ip ipv4 host server client",
    "card": "card credit visa mastercard amex karte kreditkarte tarjeta carte",
    "at": "at",
    "dot": "dot",
}
CLASS_OF = {w: c for c, ws in CLASSES.items() for w in ws.split()}
#: Beginnings of keys that services publish as such (fixed values).
KEY_PREFIX = ("AKIA", "ghp_", "sk-", "xoxb-")

_ALNUM = re.compile(r"[^\W_]")
_CORE = re.compile(r"[+(\[]*[^\W_](?:.*[^\W_])?", re.S)
_QUAD = re.compile(r"\(?\d{1,3}(?:[.,_-]\d{1,3}){3}\)?")
_ASSIGNED = re.compile(r"([^\W\d]*)[\"']?[=:]+[\"']?")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


@lru_cache(1 << 16)
def core(word: str) -> tuple[int, int]:
    """Where the word's letters and digits begin and end, with a plus or bracket before them; ``name=`` stays outside."""
    own = _ASSIGNED.match(word)
    skip = own.end() if own and own.end() < len(word) else 0
    m = _CORE.search(word, skip)
    return (m.start(), m.end()) if m else (0, 0)


@lru_cache(1 << 16)
def shape(word: str) -> tuple[str, str, tuple[str, ...]]:
    """(shape, class, keys by which it resembles other words)."""
    a, b = core(word)
    w = word[a:b]
    low = w.lower().strip("[(")
    cls = CLASS_OF.get(low, "")
    own = _ASSIGNED.match(word)
    if own and own.end() < len(word) and CLASS_OF.get(own[1].lower()) == "key":
        cls = "key="
    digits = re.sub(r"[^0-9]", "", w)
    letters = sum(c.isalpha() for c in w)
    n, length = len(digits), len(digits) + letters
    if not length:
        kind = "=" if "=" in word or ":" in word else "sign"
    elif "@" in w:
        kind = "at"
    elif w.startswith(KEY_PREFIX):
        kind = "prefixed"
    elif _QUAD.fullmatch(w):
        kind = "quad" if all(int(x) < 256 for x in re.findall(r"\d+", w)) else "quad?"
    elif not letters:
        kind = ("luhn" if luhn(digits) else "long") if 13 <= n <= 19 else "num20" if n > 19 else "num7" if n > 6 else "num4" if n > 3 else "num1"
        kind += ("+" if w[0] == "+" else "(" if w[0] == "(" else "") + ("." if "." in w else "-" if "-" in w else "/" if "/" in w or ":" in w else "")
    elif n and letters and length >= 16:
        kind = "hex" if re.fullmatch(r"[0-9a-fA-F-]+", w) else "key"
    elif n:
        kind = "dotted" if "." in w else "mixed"
    else:
        kind = "name." if "." in w else "word"
    if word[b:].strip("\"'")[:1] in ("=", ":"):
        kind += "="
    keys = []
    if n >= 4 and not letters:
        keys.append(digits[-7:])
    elif length >= 6:
        keys.append(re.sub(r"[\W_]", "", w).lower())
        if "@" in w:
            local = re.sub(r"[\W_]", "", w.split("@")[0]).lower()
            keys += [local] if len(local) >= 4 else []
    return kind, cls, tuple(keys)


def surroundings(kinds: list[str], classes: list[str]) -> list[tuple]:
    """Of each word of a stretch of neighbours: all that its potential depends on."""
    k, c = ["^"] * 3 + kinds + ["$"] * 2, [""] * 3 + classes + [""] * 2
    return [(k[i], c[i], *k[i - 2 : i], *k[i + 1 : i + 3], *c[i - 3 : i], *c[i + 1 : i + 3]) for i in range(3, len(kinds) + 3)]


def features(x: tuple) -> list[str]:
    kind, cls, k2, k1, n1, n2, c3, c2, c1, d1, d2 = x
    near = sorted({c for c in (c3, c2, c1) if c}) or ["-"]
    return [
        "bias", f"k {kind}", f"c {cls}", f"k {kind} {k1}", f"k {kind} . {n1}", f"{kind} {k1} {k2}", f"{kind} . {n1} {n2}",
        f"p {c1}", f"n {d1}", f"{kind} n {d1}", f"{kind} nn {d2}", f"{kind} p {c1}", f"{kind} pp {c2}", f"{kind} = {cls}", *[f"{kind} near {c}" for c in near], *[f"near {c}" for c in near],
    ]


class Field:
    """The fitted potentials; pickled to tasks as they are."""

    def __init__(self, weights: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.weights, self.pair = weights, np.stack([chain, skip])
        self._seen: dict[tuple, np.ndarray] = {}

    def potentials(self, xs: list[tuple]) -> np.ndarray:
        out = np.zeros((len(xs), len(LABELS)))
        seen, zero = self._seen, np.zeros(len(LABELS))
        for i, x in enumerate(xs):
            v = seen.get(x)
            if v is None:
                if len(seen) > 100_000:
                    seen.clear()
                v = seen[x] = sum((self.weights.get(f, zero) for f in features(x)), zero)
            out[i] = v
        return out

    def beliefs(self, own: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Probabilities of labels by loopy messages; edges i-j of kind 0 (chain) or 1 (skip)."""
        there, back = np.zeros((len(i), own.shape[1])), np.zeros((len(i), own.shape[1]))
        for _ in range(rounds if len(i) else 0):
            total = self._gathered(own, i, j, there, back)
            for a in range(0, len(i), 1 << 16):
                e = slice(a, a + (1 << 16))
                pair = self.pair[kind[e]]
                new = self._message((total[i[e]] - back[e])[:, :, None] + pair, 1), self._message((total[j[e]] - there[e])[:, None, :] + pair, 2)
                there[e] += (new[0] - there[e]) * (1 - DAMPING)
                back[e] += (new[1] - back[e]) * (1 - DAMPING)
        total = self._gathered(own, i, j, there, back)
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def _message(x: np.ndarray, over: int) -> np.ndarray:
        top = x.max(over, keepdims=True)
        m = np.log(np.exp(x - top).sum(over)) + top.squeeze(over)
        return m - m.max(1, keepdims=True)

    @staticmethod
    def _gathered(own: np.ndarray, i: np.ndarray, j: np.ndarray, there: np.ndarray, back: np.ndarray) -> np.ndarray:
        if not len(i):
            return own
        return own + np.stack([np.bincount(j, there[:, k], len(own)) + np.bincount(i, back[:, k], len(own)) for k in range(own.shape[1])], 1)


def skip_edges(keys: list[tuple[str, ...]], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence of a key with the next one in its text."""
    last: dict[tuple[int, str], int] = {}
    edges = {}
    for at, (ks, t) in enumerate(zip(keys, text.tolist())):
        for k in ks:
            before = last.get((t, k))
            if before is not None and before != at:
                edges[before, at] = None
            last[t, k] = at
    pairs = np.array(list(edges), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


# Labelled texts


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _with_check_digit(rng: random.Random, n: int) -> str:
    d = _digits(rng, n - 1)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _name(rng: random.Random, least: int = 2) -> str:
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(least, 4)))


def _entity(rng: random.Random, kind: str) -> tuple[list[list[str]], list[str]]:
    """(ways to write it, words that may announce it)."""
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return [[f"+1 ({a}) {b}-{c}"], [f"({a}) {b}-{c}"], [f"{a}-{b}-{c}"], [f"{a} {b} {c}"], [f"{a}.{b}.{c}"], [f"{b}-{c}"], [f"0{a}{b}{c}"]], CLASSES["tel"].split()
    if kind == "email":
        user, host = rng.choice([f"{_name(rng)}.{_digits(rng, 2)}", f"{_name(rng)}{_digits(rng, 2)}", f"{_name(rng)}.{_name(rng)}"]), f"{_name(rng)}{rng.randint(1, 9)}"
        return [[f"{user}@{host}.com"], [f"{user} (at) {host}.com"], [f"{user} at {host} dot com"], [f"{user} [at] {host} [dot] org"], [f"{user}@{host}"]], CLASSES["mail"].split()
    if kind == "ip":
        q = [str(rng.randint(1, 255)) for _ in range(4)]
        return [[".".join(q)], ["-".join(q)], [",".join(q)], ["_".join(q)]], CLASSES["ip"].split()
    if kind == "card":
        d = _with_check_digit(rng, 16)
        return [[d], ["-".join(d[k : k + 4] for k in range(0, 16, 4))], [".".join(d[k : k + 4] for k in range(0, 16, 4))], ["_".join(d[k : k + 4] for k in range(0, 16, 4))]], CLASSES["card"].split()
    n = rng.choice([20, 24, 32, 40, 64])
    alphabet = rng.choice(["0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"])
    key = rng.choice(["", "", "", *KEY_PREFIX]) + "".join(rng.choice(alphabet) for _ in range(n - 2)) + "7d"
    return [[key]], CLASSES["key"].split()


def _ordinary(rng: random.Random) -> str:
    """Words with digits, or of announcing classes, that are no personal data."""
    return rng.choice([
        lambda: str(rng.randint(0, 3000)), lambda: f"{rng.randint(1, 999)}.{_digits(rng, 2)}", lambda: f"{rng.randint(1990, 2030)}-{_digits(rng, 2)}-{_digits(rng, 2)}", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"#{_digits(rng, 5)}", lambda: _digits(rng, rng.choice([5, 6, 7, 8, 9, 10, 12])), lambda: f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(38))}7d", lambda: "".join(rng.choice("abcdefghijkmnopqrsABCDEFGHJKLM0123456789+/") for _ in range(60)) + "7d",
        lambda: f"ISBN 978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", lambda: _digits(rng, 16), lambda: f"{_name(rng)}{_digits(rng, 2)}", lambda: f"{rng.randint(1, 12)}:{_digits(rng, 2)}", lambda: f"{rng.randint(300, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
        lambda: f"{_name(rng)} at {_name(rng)}", lambda: f"the {rng.choice(list(CLASS_OF))} {_name(rng)}", lambda: f"{rng.choice(list(CLASS_OF))} {_name(rng)} {_digits(rng, 4)}", lambda: f"{rng.choice(list(CLASS_OF))}: {_name(rng)}", lambda: f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", lambda: f"{_name(rng)}-{_digits(rng, 12)}-{_name(rng)}",
    ])()


def labelled_texts(n: int, seed: int, noise: bool = True) -> list[list[tuple[str, str]]]:
    """Texts as (word, label): prose of made-up words, ordinary numbers, and entities of which some come again, written
    otherwise and without any announcement."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pieces: list[list[tuple[str, str]]] = [[(_name(rng) + rng.choice(["", "", "", ",", ".", "###", "!!"]), "O") for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(6, 16))]
        plain = [[(w, "O") for w in _ordinary(rng).split(" ")] for _ in range(rng.randint(1, 5) if noise else 0)]
        pieces += plain + [p for p in plain if rng.random() < 0.5]
        for _ in range(rng.choice([0, 1, 1, 2])):
            kind = rng.choice(KINDS)
            ways, heralds = _entity(rng, kind)
            tail = rng.choice(["", "", ",", ".", "###", "***", ";"])
            for times in range(rng.choice([1, 2, 2, 3])):
                way = (ways[0] if kind in ("card", "email") and not times else rng.choice(ways))[0].split(" ")
                piece = [(w, kind) for w in way]
                if kind == "secret":
                    herald = rng.choice(heralds)
                    if not times:
                        piece = rng.choice([
                            [(herald, "O"), ("=", "O"), (f'"{way[0]}"', kind)], [(f"{herald}:", "O"), (way[0], kind)], [(f"{herald}={way[0]}", kind)], [(f'{herald}="{way[0]}"', kind)], [(herald, "O"), ("is", "O"), (way[0], kind)],
                        ])
                elif not times or rng.random() < 0.3:
                    piece = [(rng.choice(heralds) + rng.choice(["", ":", "."]), "O"), *piece]
                word, label = piece[-1]
                pieces.append([*piece[:-1], (word + tail, label)])
        rng.shuffle(pieces)
        out.append([x for p in pieces for x in p])
    return out


@lru_cache(1)
def fitted(texts: int = TRAIN_TEXTS, seed: int = 11) -> Field:
    """Word potentials by gradient descent on the distinct surroundings, pair potentials from counts."""
    size, count, pairs = len(LABELS), {}, np.full((2, len(LABELS), len(LABELS)), 0.5)
    for text in labelled_texts(texts, seed):
        words, labels = [w for w, _ in text], [LABELS.index(x) for _, x in text]
        kinds, classes, keys = zip(*(shape(w) for w in words))
        for x, y in zip(surroundings(list(kinds), list(classes)), labels):
            count.setdefault(x, np.zeros(size))[y] += 1
        for a, b in zip(labels, labels[1:]):
            pairs[0, a, b] += 1
        i, j = skip_edges(list(keys), np.zeros(len(words), np.int64))
        for a, b in zip(i.tolist(), j.tolist()):
            pairs[1, labels[a], labels[b]] += 1
            pairs[1, labels[b], labels[a]] += 1
    names = {f: k for k, f in enumerate(dict.fromkeys(f for x in count for f in features(x)))}
    rows = np.repeat(np.arange(len(count)), [len(features(x)) for x in count])
    cols = np.array([names[f] for x in count for f in features(x)])
    y = np.stack(list(count.values()))
    weight = np.zeros((len(names), size))
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    for t in range(1, STEPS + 1):
        score = np.stack([np.bincount(rows, weight[cols, k], len(y)) for k in range(size)], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        wrong = p / p.sum(1, keepdims=True) * y.sum(1, keepdims=True) - y
        slope = np.stack([np.bincount(cols, wrong[rows, k], len(names)) for k in range(size)], 1) + DECAY * weight
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        weight -= 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-3)
    chain, skip = (np.log(m * m.sum() / np.outer(m.sum(1), m.sum(0))) for m in pairs)
    return Field({f: weight[k] for f, k in names.items()}, chain, skip)
