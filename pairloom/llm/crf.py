"""A linear-chain conditional random field over word-shape features, in NumPy batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Words that tell a kind of data from another; fixed values.
CUES = frozenset("at dot call tel phone fax mobile mail email ip host card visa token version license key com org net example".split())


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def shapes(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """One string a token: what it is made of, how long, what it follows without a gap."""
    out, last = [], -1
    for s, e in spans:
        w = text[s:e]
        if w[0].isdigit() and w.isascii():
            kind = f"9{min(e - s, 12)}"
        elif w.isalpha():
            low = w.lower()
            kind = low if low in CUES else ("A" if w.isupper() else "a") + ("1" if e - s == 1 else "")
        else:
            kind = w
        out.append(kind if s == last else " " + kind)
        last = e
    return out


def window_features(ctx: tuple[str, ...]) -> list[str]:
    """Features of the middle of five shapes."""
    a, b, c, d, e = ctx
    return [f"0{c}", f"-1{b}", f"+1{d}", f"-2{a}", f"+2{e}", f"-10{b}|{c}", f"01{c}|{d}", f"-101{b}|{c}|{d}", f"-2-10{a}|{b}|{c}", f"012{c}|{d}|{e}", f"all{a}|{b}|{c}|{d}|{e}"]


def contexts(shape: list[str]) -> list[tuple[str, ...]]:
    padded = ["<", "<", *shape, ">", ">"]
    return [tuple(padded[i : i + 5]) for i in range(len(shape))]


@dataclass
class Model:
    """Emission weights by feature (rows) and label, transitions and the scores of the first label."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    cache: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)
    settled: dict[tuple[str, ...], bool] = field(default_factory=dict)

    def emissions(self, shape: list[str]) -> np.ndarray:
        if len(self.cache) > 200_000:
            self.cache.clear()
        rows = []
        for ctx in contexts(shape):
            row = self.cache.get(ctx)
            if row is None:
                row = self.cache[ctx] = self.weights[[i for f in window_features(ctx) if (i := self.index.get(f)) is not None]].sum(axis=0)
            rows.append(row)
        return np.array(rows).reshape(len(rows), len(self.labels))

    def settles(self, shape: tuple[str, ...]) -> bool:
        """Whether one of these tokens, but for the two at either end, has the first label in the best path of any text around them.

        It has if that label is best there between every pair of labels of the outer ones, for the rest of the text acts
        on the path through these two alone.
        """
        known = self.settled.get(shape)
        if known is None:
            if len(self.settled) > 200_000:
                self.settled.clear()
            e = self.emissions(list(shape))[2:-2]
            n, k = e.shape
            back = [np.where(np.eye(k, dtype=bool), 0.0, -np.inf)]  # from a token to the last one
            for t in range(n - 1, 0, -1):
                back.append(((self.trans + e[t])[:, :, None] + back[-1]).max(axis=1))
            ahead, known = np.where(np.eye(k, dtype=bool), e[0], -np.inf), False
            for t in range(1, n - 1):
                ahead = (ahead[:, :, None] + self.trans).max(axis=1) + e[t]
                through = ahead[:, :, None] + back[n - 1 - t]
                if (through[:, 0] > through[:, 1:].max(axis=1) + 1e-9).all():
                    known = True
                    break
            self.settled[shape] = known
        return known

    def decode(self, emissions: list[np.ndarray], most: int = 200_000) -> list[np.ndarray]:
        """Best label paths by Viterbi, sequences of like length together, at most about `most` tokens at a time."""
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(emissions)
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(emissions[order[hi]]) <= most:
                hi += 1
            group = order[lo:hi]
            for i, path in zip(group, self._viterbi([emissions[i] for i in group]), strict=True):
                out[i] = path
            lo = hi
        return out

    def _viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        lens = np.array([len(e) for e in batch])
        n, steps, k = len(batch), int(lens.max()), len(self.labels)
        if not steps:
            return [np.zeros(0, np.int8)] * n
        e = np.zeros((n, steps, k))
        for i, x in enumerate(batch):
            e[i, : len(x)] = x
        back = np.zeros((n, steps, k), np.int8)
        score = self.first + e[:, 0]
        for t in range(1, steps):
            through = score[:, :, None] + self.trans
            back[:, t] = through.argmax(axis=1)
            score = np.where((t < lens)[:, None], through.max(axis=1) + e[:, t], score)
        path = np.zeros((n, steps), np.int8)
        state = score.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < lens
            path[inside, t] = state[inside]
            state = np.where(inside & (t > 0), back[np.arange(n), t, state], state)
        return [p[:m] for p, m in zip(path, lens, strict=True)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: list[tuple[str, list[tuple[int, int, str]]]], kinds: tuple[str, ...], *, rounds: int = 120, rate: float = 0.25, penalty: float = 2e-3) -> Model:
    """Maximum conditional likelihood by Adam. table: (text, [(start, end, kind)]). The same table gives the same model."""
    labels = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
    of = {x: i for i, x in enumerate(labels)}
    index: dict[str, int] = {}
    feats, gold = [], []
    for text, spans in table:
        at = tokens(text)
        feats.append([[index.setdefault(f, len(index)) for f in window_features(c)] for c in contexts(shapes(text, at))])
        y = [0] * len(at)
        for s, e, kind in spans:
            inside = [i for i, (a, b) in enumerate(at) if a >= s and b <= e]
            for j, i in enumerate(inside):
                y[i] = of[f"{'I' if j else 'B'}-{kind}"]
        gold.append(y)
    n, steps, k, width = len(table), max(map(len, gold)), len(labels), len(feats[0][0])
    null = len(index)
    fx, y, mask = np.full((n, steps, width), null), np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for i, (f, g) in enumerate(zip(feats, gold, strict=True)):
        fx[i, : len(f)], y[i, : len(g)], mask[i, : len(g)] = f, g, True
    lens, rows = mask.sum(axis=1), np.arange(n)
    params = [np.zeros((null + 1, k)), np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, trans, first = params
        e = w[fx].sum(axis=2)
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where(mask[:, t, None], _lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
        z = _lse(alpha[rows, lens - 1], 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        p[rows[:, None], np.arange(steps), y] -= mask
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gt = pair.sum(axis=(0, 1))
        np.add.at(gt, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), -1)
        gw = np.zeros_like(w)
        np.add.at(gw, fx[mask].ravel(), np.repeat(p[mask], width, axis=0))
        grads = [gw / n + penalty * w, gt / n + penalty * trans, p[:, 0].sum(axis=0) / n + penalty * first]
        for i, g in enumerate(grads):
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.99 * m2[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
        params[0][null] = 0
    return Model(labels, index, params[0][:null], params[1], params[2])
