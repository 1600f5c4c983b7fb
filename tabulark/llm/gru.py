"""A small bidirectional gated recurrent network with attention pooling, in NumPy.

A token enters as a word vector, looked up by the hash of the word, beside the mean of the vectors of
its character n-grams. Both are tables of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tabulark.llm.words import MARKS, Block, lowered, mixed, prefix_sums, span_hashes, word_spans

WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 16
_GRAMS = (3, 4, 5)


@dataclass
class Tokens:
    """The distinct words of a block: word bucket, n-gram buckets with the word each belongs to; then the tokens as numbers of words."""

    bucket: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    token: np.ndarray
    owner: np.ndarray

    @property
    def gram_share(self) -> np.ndarray:
        return 1 / np.maximum(np.bincount(self.gram_word, minlength=len(self.bucket)), 1)


def tokens(block: Block) -> Tokens:
    """Words are runs of letters, digits and apostrophes; A-Z count in lower case. n-grams see where a word begins and ends."""
    starts, ends, owner = word_spans(block, MARKS)
    low = lowered(block.data)
    _, first, token = np.unique(span_hashes(prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    # Each distinct word once, between a byte 2 and a byte 3.
    size = ends - starts + 2
    begin = np.concatenate(([0], np.cumsum(size)))
    letters = np.empty(begin[-1], np.uint8)
    inner = np.ones(len(letters), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    letters[begin[:-1]], letters[begin[1:] - 1] = 2, 3
    source = np.repeat(starts - begin[:-1] - 1, size) + np.arange(len(letters))
    letters[inner] = low[source[inner]]
    sums, word = prefix_sums(letters), np.repeat(np.arange(len(first)), size)
    grams, gram_word = [], []
    for n in _GRAMS:
        at = np.flatnonzero(np.arange(len(letters)) + n <= begin[1:][word]) if len(letters) else np.zeros(0, np.int64)
        grams.append((span_hashes(sums, at, at + n) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        gram_word.append(word[at])
    whole = span_hashes(sums, begin[:-1], begin[1:])
    bucket = (mixed(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    return Tokens(bucket, np.concatenate(grams), np.concatenate(gram_word), token, owner)


def windows(counts: np.ndarray, size: int, step: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of all overlapping windows of texts with so many tokens, and the text of each window.

    A text has windows at 0, ``step``, ... until one reaches its end; a text without tokens has one empty window.
    Places beyond the end are ``pad``.
    """
    per_text = 1 + np.maximum(0, -(-(counts - size) // step))
    text = np.repeat(np.arange(len(counts)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    inside = (number * step)[:, None] + np.arange(size)
    first = np.cumsum(counts) - counts
    return np.where(inside < counts[text][:, None], first[text][:, None] + inside, pad), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scores, gradients and Adam steps."""

    def __init__(self, seed: int = 5, dims: int = 8, hidden: int = 8):
        chance = np.random.RandomState(seed)
        draw = lambda *shape: (chance.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "words": np.zeros((WORD_BUCKETS, dims), np.float32),
            "grams": (0.1 * chance.standard_normal((GRAM_BUCKETS, dims))).astype(np.float32),
            "attend": draw(2 * hidden, hidden), "attend_b": np.zeros(hidden, np.float32), "focus": draw(hidden),
            "out": draw(2 * hidden), "out_b": np.zeros(1, np.float32),
        }
        for side in ("f", "b"):
            self.p |= {f"in_{side}": draw(2 * dims, 3 * hidden), f"in_b_{side}": np.zeros(3 * hidden, np.float32), f"rec_{side}": draw(hidden, 3 * hidden)}
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def inputs(self, words: Tokens) -> np.ndarray:
        chars = np.zeros((len(words.bucket), self.p["grams"].shape[1]), np.float32)
        for d in range(chars.shape[1]):
            chars[:, d] = np.bincount(words.gram_word, self.p["grams"][:, d][words.grams], len(words.bucket))
        chars *= words.gram_share[:, None].astype(np.float32)
        return np.concatenate((self.p["words"][words.bucket], chars), axis=1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word gives to the gates; the last row is padding."""
        return {s: np.vstack((x @ self.p[f"in_{s}"] + self.p[f"in_b_{s}"], np.zeros((1, 3 * self.hidden), np.float32))) for s in "fb"}

    def run(self, gates: dict[str, np.ndarray], places: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window; ``places`` are rows of ``gates``, the last row is padding."""
        h, n = self.hidden, places.shape[1]
        real = places < len(gates["f"]) - 1
        states = np.zeros((n, len(places), 2 * h), np.float32)
        for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            state, low = np.zeros((len(places), h), np.float32), 0 if side == "f" else h
            rec = self.p[f"rec_{side}"]
            for t in order:
                x, mask = gates[side][places[:, t]], real[:, t, None]
                back = state @ rec
                zr = _sigmoid(x[:, : 2 * h] + back[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * back[:, 2 * h :])
                following = np.where(mask, new + z * (state - new), state)
                if keep is not None:
                    keep[side, t] = (state, z, r, new, back[:, 2 * h :], mask)
                state = following
                states[t, :, low : low + h] = state
        look = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        raw = look @ self.p["focus"]
        raw[~real.T] = -30
        weight = np.exp(raw - raw.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * states).sum(axis=0)
        if keep is not None:
            keep["top"] = (states, look, weight, pooled)
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def learn(self, words: Tokens, places: np.ndarray, label: np.ndarray, rate: float) -> float:
        """One Adam step on the windows; returns the mean loss."""
        h, n = self.hidden, places.shape[1]
        x = self.inputs(words)
        gates, keep = self.projected(x), {}
        logit = self.run(gates, places, keep)
        chance = _sigmoid(logit)
        loss = -np.mean(np.log(np.where(label > 0, chance, 1 - chance) + 1e-7))
        g: dict[str, np.ndarray] = {}
        d_logit = ((chance - label) / len(label)).astype(np.float32)
        states, look, weight, pooled = keep["top"]
        g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["focus"] = np.einsum("tbk,tb->k", look, d_raw)
        d_look = d_raw[..., None] * self.p["focus"] * (1 - look**2)
        g["attend"], g["attend_b"] = np.einsum("tbk,tbj->kj", states, d_look), d_look.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pooled + d_look @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for side, order in (("f", range(n - 1, -1, -1)), ("b", range(n))):
            low, rec = 0 if side == "f" else h, self.p[f"rec_{side}"]
            carried, d_rec, d_gates = np.zeros((len(places), h), np.float32), np.zeros_like(rec), np.zeros_like(gates[side])
            for t in order:
                before, z, r, new, back, mask = keep[side, t]
                total = d_states[t, :, low : low + h] + carried
                d = np.where(mask, total, 0)
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_gate = np.concatenate((d_z, d_r, d_new), axis=1)
                d_back = np.concatenate((d_z, d_r, d_new * r), axis=1)
                np.add.at(d_gates, places[:, t], d_gate)
                d_rec += before.T @ d_back
                carried = np.where(mask, d * z + d_back @ rec.T, total)
            d_gates = d_gates[:-1]
            g[f"rec_{side}"], g[f"in_{side}"], g[f"in_b_{side}"] = d_rec, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"in_{side}"].T
        dims = self.p["words"].shape[1]
        shared = (d_x[:, dims:] * words.gram_share[:, None])[words.gram_word]
        self._adam(g, rate)
        self._sparse("words", words.bucket, d_x[:, :dims], rate)
        self._sparse("grams", words.grams, shared, rate)
        return float(loss)

    def _adam(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for name, grad in g.items():
            m, v = self.moments.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            self.moments[name] = m, v
            self.p[name] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)

    def _sparse(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """AdaGrad on the rows of a table that the step has read."""
        at, number = np.unique(rows, return_inverse=True)
        total = np.zeros((len(at), grad.shape[1]), np.float32)
        np.add.at(total, number, grad.astype(np.float32))
        if name not in self.moments:
            self.moments[name] = (np.zeros(1), np.zeros_like(self.p[name]))
        past = self.moments[name][1]
        past[at] += total**2
        self.p[name][at] -= 2 * rate * total / (np.sqrt(past[at]) + 1e-6)
