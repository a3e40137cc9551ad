"""Toxicity scores from a bidirectional gated recurrent network.

A word enters as the sum of two vectors: its own (for the words of a
vocabulary) and that of its character grams (for every word).  Two
gated recurrent layers read a window in either direction, attention pools
their states, and a logistic unit scores the window.  Every run of ``WINDOW``
words of a document is a window, one beginning at each word; its score is the
calibrated maximum over them.  Everything is numpy: training runs once, on a
bounded sample of labelled rows; scoring runs in tasks over whole texts.

Labels are given per document, so training fits the soft maximum over the
windows of a document to its label: in a toxic document the windows that look
most toxic learn, in others whatever looks toxic unlearns it.  Gradients use the
windows at every ``STRIDE``-th word; calibration uses all, as scoring does.

Learning uses only rows outside the held-out fold (crc32 of the id as text,
modulo 5, is not 0), at most ``ROWS`` toxic and twice as many other ids with a
text of at most ``ROW_BYTES`` bytes, picked by a hash of the id among the
labelled ids that have one, so the sample is filled whenever enough exist.  A
class that has only longer texts is not in the sample; the network then is as
without labels of that kind.  Inputs are the words of the text and nothing else.

Defined cases: null text counts as empty; a text without words gets the score
of a window without evidence; several labels of one id count as the highest;
null labels are ignored; without labels of both kinds every score is the share
of toxic labels (0 without any); repeated rows and null ids are scored row by
row; an empty table gives an empty result; further columns do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import groups_of
from .common import freed, materialize, release_memory, small_batches, unused, whole_text
from .pieces import Rows

ROWS, ROW_BYTES = 1200, 32768       # of the training sample
WINDOW, STRIDE = 32, 26             # words; the stride is that of gradient steps only
DIM, HIDDEN, ATTENTION = 16, 8, 8
VOCABULARY, GRAMS = 8192, 16384
SIZES = (3, 5)                      # of character grams
BATCH, DRAWN, STEPS = 32, 40, 250     # texts a step, windows of a text, steps

KNOWN = 100_000                     # words whose gate inputs a task keeps

_TAIL = b"\x03" * (max(SIZES) - 2)

# ASCII letters and digits, and all other characters, make words.
_BORDERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(_BORDERS).split()


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows that gradient steps draw from, over n words: each
    word is in one at least, and neighbours overlap by WINDOW - STRIDE words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def grams(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: the hashed character grams of all words, and where
    each word's begin.  Marks at both ends give every word at least one."""
    raw = np.frombuffer(b"".join([b"\x02" + w + _TAIL for w in words]), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1 + len(_TAIL)
    ends = np.cumsum(lens)
    out = []
    for size in SIZES:
        code = raw[:len(raw) - size + 1].copy()
        for k in range(1, size):
            code = (code << np.uint64(8)) | raw[k:len(raw) - size + 1 + k]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAMS.bit_length() + 1)
        inside = np.ones(len(raw), bool)
        for k in range(1, size):
            inside[ends - k] = False
        n = lens - size + 1
        out.append((code[inside[:len(code)]].astype(np.int64), np.cumsum(n) - n))
    return out


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        h = 2 * HIDDEN
        u = draw(h, 3 * h, by=HIDDEN ** -0.5)
        return cls(vocabulary, {
            "word": draw(len(vocabulary) + 1, DIM, by=0.05), "chars": draw(GRAMS, DIM, by=0.05),
            "w": draw(DIM, 3 * h, by=DIM ** -0.5), "b": np.zeros(3 * h, np.float32), "u": u * _BLOCKS,
            "aw": draw(h, ATTENTION, by=h ** -0.5), "ab": np.zeros(ATTENTION, np.float32), "av": draw(ATTENTION),
            "o": draw(h), "ob": np.array([-1.0], np.float32)})

    def inputs(self, words: list[bytes], step: int = 16384) -> np.ndarray:
        """Input vectors of distinct words; one more row, of zeros, for padding."""
        out = np.zeros((len(words) + 1, DIM), np.float32)
        for s in range(0, len(words), step):
            part = words[s:s + step]
            for codes, at in grams(part):
                n = np.diff(np.append(at, len(codes)))
                for k in np.unique(n).tolist():              # words with equally many grams, gram by gram
                    mine = np.flatnonzero(n == k)
                    total = self.weights["chars"][codes[at[mine]]]
                    for j in range(1, k):
                        total += self.weights["chars"][codes[at[mine] + j]]
                    out[s + mine] += total / np.float32(np.sqrt(k))
            out[s:s + len(part)] += self.weights["word"][[self.vocabulary.get(w, 0) for w in part]]
        return out

    def logits(self, projected: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window.  ``projected``: gate inputs per word row;
        ``windows``: word rows, the last row of ``projected`` being padding.
        ``keep`` receives what the backward pass needs."""
        w, h2 = self.weights, 2 * HIDDEN
        b, t = windows.shape
        pad = windows == len(projected) - 1
        h = np.zeros((b, h2), np.float32)
        states = np.empty((t, b, h2), np.float32)
        steps = []
        for k in range(t):
            x = np.where(_FORWARD, projected[windows[:, k]], projected[windows[:, t - 1 - k]])
            hu = h @ w["u"]
            zr = _sigmoid(x[:, :2 * h2] + hu[:, :2 * h2])
            z, r = zr[:, :h2], zr[:, h2:]
            c = np.tanh(x[:, 2 * h2:] + r * hu[:, 2 * h2:])
            if keep is not None:
                steps.append((h, z, r, c, hu[:, 2 * h2:]))
            h = h + z * (c - h)
            states[k, :, :HIDDEN] = h[:, :HIDDEN]
            states[t - 1 - k, :, HIDDEN:] = h[:, HIDDEN:]
        a = np.tanh(states @ w["aw"] + w["ab"])
        s = a @ w["av"]
        s[pad.T] = -1e9
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        s[:, pad.all(axis=1)] = 0            # a window without words pools to zero
        pooled = np.einsum("tb,tbh->bh", s, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "a": a, "s": s, "pooled": pooled}
        return pooled @ w["o"] + w["ob"][0]

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Gate inputs of each word; padding keeps the state as it is."""
        p = inputs @ self.weights["w"] + self.weights["b"]
        p[-1] = 0
        p[-1, :2 * HIDDEN] = -30
        return p

    def backward(self, windows: np.ndarray, inputs: np.ndarray, keep: dict, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from the gradient of the logits; ``inputs`` by its rows."""
        w, h2 = self.weights, 2 * HIDDEN
        b, t = windows.shape
        g = {"o": keep["pooled"].T @ grad, "ob": np.array([grad.sum()], np.float32)}
        dpool = grad[:, None] * w["o"]
        dstates = keep["s"][:, :, None] * dpool
        ds = np.einsum("tbh,bh->tb", keep["states"], dpool)
        ds = keep["s"] * (ds - (keep["s"] * ds).sum(axis=0))
        da = ds[:, :, None] * w["av"] * (1 - keep["a"] ** 2)
        g["av"] = np.einsum("tba,tb->a", keep["a"], ds)
        g["aw"] = np.einsum("tbh,tba->ha", keep["states"], da)
        g["ab"] = da.sum(axis=(0, 1))
        dstates += da @ w["aw"].T
        dh = np.zeros((b, h2), np.float32)
        du = np.zeros_like(w["u"])
        dx = np.zeros((b, t, 3 * h2), np.float32)
        for k in reversed(range(t)):
            h, z, r, c, hc = keep["steps"][k]
            dh[:, :HIDDEN] += dstates[k, :, :HIDDEN]
            dh[:, HIDDEN:] += dstates[t - 1 - k, :, HIDDEN:]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dhu = np.concatenate((dz, dr, dc * r), axis=1)
            dstep = np.concatenate((dz, dr, dc), axis=1)
            dx[:, k] += np.where(_FORWARD, dstep, 0)
            dx[:, t - 1 - k] += np.where(_FORWARD, 0, dstep)
            du += h.T @ dhu
            dh = dh * (1 - z) + dhu @ w["u"].T
        g["u"] = du * _BLOCKS
        dx[windows == len(inputs) - 1] = 0
        flat = dx.reshape(-1, 3 * h2)
        g["w"] = inputs[windows.ravel()].T @ flat
        g["b"] = flat.sum(axis=0)
        per_word = np.zeros((len(inputs), 3 * h2), np.float32)
        np.add.at(per_word, windows.ravel(), flat)
        g["inputs"] = per_word @ w["w"].T
        return g

    def score(self, texts: list[str], known: GateInputs | None = None) -> np.ndarray:
        """Scores of whole texts; ``known`` keeps gate inputs from call to call."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        known = known or GateInputs(self)
        laid = lay_out([words_of(t) for t in texts], known.fresh())
        best = self.highest(known.all(), *laid)
        return _sigmoid(self.scale * best.astype(np.float64) + self.shift)

    def highest(self, projected: np.ndarray, line: np.ndarray, begin: np.ndarray, count: np.ndarray, step: int = 2048) -> np.ndarray:
        """The largest logit of each text over its windows at every word.

        Texts of like length lie side by side, word by word, so no window that spans
        two of them is worked out; long ones, with few such windows, end to end."""
        best = np.full(len(begin), -np.inf, np.float32)
        block = self.window_logits(projected)
        order = np.argsort(-count, kind="stable")
        long = order[:np.count_nonzero(count > step // 4)]
        if len(long):
            room = count[long] + WINDOW - 1
            at = np.cumsum(room) - room
            found = np.append(_along(block, np.concatenate([line[b:b + n] for b, n in zip(begin[long], room)]), step), np.float32(-np.inf))
            best[long] = np.maximum.reduceat(found, np.stack((at, at + count[long]), axis=1).ravel())[::2]
        k = len(long)
        while k < len(order):
            n = int(count[order[k]])
            beside = order[k:k + max(1, min(step // n, 2 * step // (n + WINDOW - 1)))]
            words = begin[beside] + np.arange(n + WINDOW - 1)[:, None]
            found = block(line[np.minimum(words, len(line) - 1)])
            found[np.arange(n)[:, None] >= count[beside]] = -np.inf
            best[beside] = found.max(axis=0)
            k += len(beside)
        return best

    def line_logits(self, projected: np.ndarray, line: np.ndarray, step: int = 2048) -> np.ndarray:
        """``logits`` of the windows at every position of ``line`` (word rows)."""
        return _along(self.window_logits(projected), line, step)

    def window_logits(self, projected: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """A function from word rows, a text per column, to the ``logits`` of the windows
        at every position but the last ``WINDOW - 1``.  Windows that begin side by side
        read side by side at every step, so the gate inputs of a step are a slice of the
        block's; arrays hold a window per column.

        Numpy's exponential takes half the time of its hyperbolic tangent, so gates
        are 1 / (1 + exp(-x)) and states are kept as g = (1 + h) / 2, whose candidate
        is such a gate too; a row of ones beside g holds the constants that it brings."""
        w, h2 = self.weights, 2 * HIDDEN
        one = np.float32(1)
        sign = np.repeat(np.array([-1, -2], np.float32), [2 * h2, h2])
        of_states = lambda m: np.vstack((2 * m, -m.sum(axis=0))).T  # noqa: E731, what m makes of h, of g and one
        # Either direction: its columns of the gate inputs, weights of its states, order of words.
        sides = [(cols, np.ascontiguousarray(of_states((w["u"] * sign)[mine][:, cols])), order) for cols, mine, order in (
            (np.flatnonzero(_FORWARD), slice(0, HIDDEN), range(WINDOW)),
            (np.flatnonzero(~_FORWARD), slice(HIDDEN, h2), range(WINDOW - 1, -1, -1)))]
        seen_by = np.column_stack((w["aw"] * np.float32(-2), w["o"]))
        look = np.hstack([of_states(seen_by[:HIDDEN]), of_states(seen_by[HIDDEN:])])
        look[:ATTENTION, -1] -= 2 * w["ab"]
        p, av = projected * sign, 2 * w["av"]
        sizes = (WINDOW * 2 * (HIDDEN + 1), 3 * HIDDEN, WINDOW * (ATTENTION + 1), HIDDEN + 1)
        room = [np.empty(0, np.float32)] * len(sizes)

        def block(part: np.ndarray) -> np.ndarray:
            texts, part = part.shape[1], part.ravel()
            b = len(part) - (WINDOW - 1) * texts
            if len(room[-1]) < sizes[-1] * b:
                room[:] = [np.empty(n * b, np.float32) for n in sizes]
            # Written anew for every block: states (the last row of a side is one), gates, what is seen of the states.
            states, gates, seen, begin = (r[:n * b].reshape(-1, b) for r, n in zip(room, sizes))
            states, seen = states.reshape(WINDOW, 2, HIDDEN + 1, b), seen.reshape(WINDOW, ATTENTION + 1, b)
            states[:, :, HIDDEN], begin[HIDDEN], begin[:HIDDEN] = 1, 1, 0.5
            x = p[part].T
            zr, z, r, c = gates[:2 * HIDDEN], gates[:HIDDEN], gates[HIDDEN:2 * HIDDEN], gates[2 * HIDDEN:]
            with np.errstate(over="ignore"):             # exp(-x) may be infinite, its gate is 0 then
                for side, (cols, u, order) in enumerate(sides):
                    given = np.ascontiguousarray(x[cols])
                    g = begin
                    for k in order:
                        now = slice(k * texts, k * texts + b)
                        np.matmul(u, g, out=gates)
                        zr += given[:2 * HIDDEN, now]
                        np.exp(zr, out=zr)
                        zr += one
                        c /= r
                        c += given[2 * HIDDEN:, now]
                        np.exp(c, out=c)
                        c += one
                        np.divide(one, c, out=c)
                        c -= g[:HIDDEN]
                        c /= z
                        np.add(g[:HIDDEN], c, out=states[k, side, :HIDDEN])
                        g = states[k, side]
                np.matmul(look, states.reshape(WINDOW, -1, b), out=seen)  # attention's input and the logistic unit's, in one go
                a, gain = seen[:, :ATTENTION], seen[:, ATTENTION]
                np.exp(a, out=a)
            a += one
            share = np.matmul(av, np.divide(one, a, out=a))              # but for a constant, the same for all words
            pad = part == len(projected) - 1
            if pad.any():
                pad = np.lib.stride_tricks.sliding_window_view(pad, b)[::texts]
                share[pad] = -1e9
                share -= share.max(axis=0)
                np.exp(share, out=share)
                share[:, pad.all(axis=0)] = 0                # a window without words pools to zero
            else:
                share -= share.max(axis=0)
                np.exp(share, out=share)
            gain *= share
            return (gain.sum(axis=0) / np.maximum(share.sum(axis=0), np.float32(1e-30)) + w["ob"][0]).reshape(-1, texts)

        return block


def _along(block: Callable[[np.ndarray], np.ndarray], line: np.ndarray, step: int) -> np.ndarray:
    """What ``block`` finds at every position of ``line``, ``step`` windows at a time."""
    return np.concatenate([block(line[s:s + step + WINDOW - 1, None])[:, 0] for s in range(0, len(line) - WINDOW + 1, step)])


class GateInputs:
    """Gate inputs of the words met so far, worked out once per word; beyond
    ``KNOWN`` words the table starts anew, so memory stays bounded."""

    def __init__(self, net: Network):
        self.net, self.rows = net, Rows()
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def fresh(self) -> Rows:
        """Rows by word: those of words not met before are given out as they are asked for."""
        if len(self.rows) > KNOWN:
            self.__init__(self.net)
        return self.rows

    def all(self) -> np.ndarray:
        """The table, with the words met since; its last row is padding."""
        new = self.net.projected(self.net.inputs(self.rows.new))
        self.rows.new = []
        self.table = np.concatenate((self.table[:-1], new))
        return self.table


# Columns of the gate inputs: update, reset, candidate; each forward then backward.
_FORWARD = np.tile(np.repeat([True, False], HIDDEN), 3)
_BLOCKS = (np.repeat([True, False], HIDDEN)[:, None] == _FORWARD).astype(np.float32)


def index_words(split: list[list[bytes]]) -> dict[bytes, int]:
    """Distinct words with their rows."""
    return {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}


def lay_out(split: list[list[bytes]], rows: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one line of word rows, each padded to a window at least;
    where each begins and how many windows it has."""
    lens = np.fromiter(map(len, split), np.int64, len(split))
    room = np.maximum(lens, WINDOW)
    begin = np.cumsum(room) - room
    line = np.full(int(room.sum()), -1, np.int32)
    for at, s in zip(begin.tolist(), split):
        line[at:at + len(s)] = np.fromiter(map(rows.__getitem__, s), np.int32, len(s))
    line[line < 0] = len(rows)
    return line, begin, room - WINDOW + 1


def index_windows(split: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Distinct words with their rows, the windows at every ``STRIDE``-th word of
    all texts as word rows (padded with one row more), and their number per text."""
    rows = index_words(split)
    windows, per_text = [], []
    for s in split:
        at = windows_of(len(s))
        padded = np.full(at[-1] + WINDOW, len(rows), np.int32)
        padded[:len(s)] = np.fromiter(map(rows.__getitem__, s), np.int32, len(s))
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at])
        per_text.append(len(at))
    return rows, np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.int32), np.array(per_text, np.int64)


# --- training ----------------------------------------------------------------

class _Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            weights[k] -= (self.rate * (m / (1 - 0.9 ** self.n)) / (np.sqrt(v / (1 - 0.99 ** self.n)) + 1e-7)).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 0, steps: int = STEPS, drop: float = 0.2,
          decay: float = 0.005, rate: float = 0.01) -> Network:
    """A network from whole labelled texts."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network({}, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    df = Counter(w for s in split for w in set(s))
    common = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 2]
    net = Network.fresh({w: k + 1 for k, w in enumerate(common)}, seed)
    rows, windows, per_text = index_windows(split)
    words, laid = list(rows), lay_out(split, rows)
    del split, df, rows
    begin = np.cumsum(per_text) - per_text
    vocab_row = np.array([net.vocabulary.get(w, 0) for w in words] + [0])
    listed = [(codes, at, np.diff(np.append(at, len(codes)))) for codes, at in grams(words)] if words else []
    adam = _Adam(rate)
    net.weights["word"][0] = 0                     # words outside the vocabulary have no vector of their own
    kinds = [np.flatnonzero(y == c) for c in (1, 0)]
    for step in range(steps):
        # As many toxic texts as others; of a long text, some windows drawn anew each time.
        chosen = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        take = [begin[i] + (rng.choice(per_text[i], DRAWN, replace=False) if per_text[i] > DRAWN else np.arange(per_text[i]))
                for i in chosen]
        owner, take = np.repeat(np.arange(len(chosen)), list(map(len, take))), np.concatenate(take)
        used, local = np.unique(windows[take], return_inverse=True)
        if used[-1] != len(words):
            used = np.append(used, len(words))
        local = local.reshape(len(take), WINDOW)
        local = np.where(rng.random(local.shape) < drop, len(used) - 1, local)
        inputs = net.inputs([words[k] for k in used[:-1]])
        keep: dict = {}
        logits = net.logits(net.projected(inputs), local, keep)
        # A text's logit is the soft maximum over its windows.
        top = np.full(len(chosen), -np.inf, np.float32)
        np.maximum.at(top, owner, logits)
        share = np.exp(logits - top[owner])
        total = np.bincount(owner, share, len(chosen))
        whole = top + np.log(total)
        grad = ((_sigmoid(whole) - y[chosen]) / len(chosen) / total)[owner] * share
        g = net.backward(local, inputs, keep, grad.astype(np.float32))
        dx, mine = g.pop("inputs")[:-1], used[:-1]
        g["word"], g["chars"] = np.zeros_like(net.weights["word"]), np.zeros_like(net.weights["chars"])
        np.add.at(g["word"], vocab_row[mine], dx)
        g["word"][0] = 0
        for codes, at, counts in listed:
            n = counts[mine]
            own = codes[np.repeat(at[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            np.add.at(g["chars"], own, np.repeat((dx / np.sqrt(n)[:, None]).astype(np.float32), n, axis=0))
        adam.rate = rate * (1 - 0.9 * step / steps)
        adam.step(net.weights, g)
        for k in ("word", "chars"):
            net.weights[k] *= np.float32(1 - decay)
    net.scale, net.shift = _calibrate(net.highest(net.projected(net.inputs(words)), *laid).astype(np.float64), y)
    return net


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value by Newton steps, a little damped."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = np.clip(_sigmoid(a * x + b), 1e-9, 1 - 1e-9)
        v = p * (1 - p)
        ga, gb = ((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b
        haa, hab, hbb = (v * x * x).sum() + 0.01, (v * x).sum(), v.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if size == 1.0 and abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 0.05)), float(b)


# --- tables ------------------------------------------------------------------

def held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rows: int = ROWS, row_bytes: int = ROW_BYTES) -> list[tuple[str, int]]:
    """The bounded sample: text and label."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")).where(~held_out("_id")))
    short = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).where(F.octet_length("_text") <= row_bytes)
    known = materialize(known.join(short.select("_id"), "_id", "left_semi"), "labelled")
    picked = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(n) for c, n in ((1, rows), (0, 2 * rows))]
    picked = F.broadcast(picked[0].unionByName(picked[1]))           # at most 3 * rows ids
    found = (short.join(picked, "_id").select("_id", "_toxic", "_text").distinct()
             .orderBy(F.xxhash64("_id"), "_id", "_text").limit(4 * rows))
    return [(r["_text"], r["_toxic"]) for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> Network:
    rows = training_rows(docs, labels, id_col, text_col, **bounds)
    net = train([t for t, _ in rows], [c for _, c in rows])
    del rows
    release_memory()
    return net


_GROUP = 1 << 20  # characters scored together


def with_scores(docs: DataFrame, net: Network, text_col: str = "text", name: str = "_score",
                columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) and a score from 0 to 1; every window
    of the whole text counts."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in columns or docs.columns]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        known = GateInputs(sent.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            scores = [sent.value.score(g, known) for g in groups_of(texts, _GROUP)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(scores, pa.float64())], names=out.names)

    out = T.StructType([*(docs.schema[k] for k in keep), T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(freed(run), out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """id, held_out, score, predicted; one row per document."""
    net = fit(docs, labels, id_col, text_col, **bounds)
    scored = with_scores(docs.select(id_col, text_col), net, text_col, columns=[id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` without those that score 0.5 or more."""
    score, = unused(docs, "score")
    net = fit(docs, labels, text_col=text_col, **bounds)
    return with_scores(docs, net, text_col, score).where(F.col(score) < 0.5).drop(score)
