"""A bidirectional LSTM with a conditional random field over its labels, in numpy.

It reads characters in pieces: a run of letters, of digits or of one other sign, in parts of at most ``BODY`` characters, with
the single blank before it. Every character is in one piece. A piece is a number, its characters' codes in base ``N_CODES``;
its vector is the sum of its characters' vectors by place and of one for the whole piece (digits alike), by hash.
"""

from __future__ import annotations

import io

import numpy as np

#: printable ASCII, folded accented letters by class, everything else
N_CODES = 104
PAD = 0
#: characters of a piece, beside the blank before it
BODY = 5
WHOLE = 4096
#: pieces whose rows are kept while reading, beside those of the batch at hand
KEPT = 40_000


def _code(c: str) -> int:
    o = ord(c)
    if 32 <= o < 127:
        return o - 31
    if c in "\n\r\t":
        return 96
    if c == "ß":
        return 97
    if c in "ºª°":
        return 98
    if c.isupper():
        return 99
    if c.islower():
        return 100
    if c.isalpha():
        return 101
    return 102 if c.isdigit() else 103


_KNOWN = np.array([_code(chr(k)) for k in range(0x250)], np.int32)


def encode_chars(text: str) -> np.ndarray:
    """Codes of the characters: ASCII by itself, other letters by case, other signs as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _KNOWN[np.minimum(points, len(_KNOWN) - 1)]
    for k in np.flatnonzero(points >= len(_KNOWN)):
        out[k] = _code(text[k])
    return out


_POWERS = N_CODES ** np.arange(BODY + 1, dtype=np.int64)
#: runs are of blanks, of letters, of digits or of one other sign
_GROUP = np.arange(N_CODES) + 10
_GROUP[[1, 96]] = 0
_UPPER = np.zeros(N_CODES, bool)
_UPPER[[*range(ord("A") - 31, ord("Z") - 30), 99]] = True
_GROUP[[*np.flatnonzero(_UPPER), *range(ord("a") - 31, ord("z") - 30), 97, 100, 101]] = 1
_DIGIT = np.zeros(N_CODES, bool)
_DIGIT[[*range(ord("0") - 31, ord("9") - 30), 102]] = True
_GROUP[_DIGIT] = 2
#: codes with all digits as 0
_ALIKE = np.where(_DIGIT, ord("0") - 31, np.arange(N_CODES))


def encode_pieces(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its pieces: their numbers, where they start and where their first character after a blank stands."""
    c = encode_chars("".join(texts))
    n, sizes = len(c), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if not n:
        return [(np.empty(0, np.int64),) * 3 for _ in texts]
    first = np.zeros(n + 1, bool)
    first[ends - sizes] = True
    first = first[:n]
    group, upper = _GROUP[c], _UPPER[c]
    new = first.copy()
    new[1:] |= (group[1:] != group[:-1]) | (upper[1:] & ~upper[:-1] & (group[1:] == 1))
    runs = np.flatnonzero(new)
    alone = (group[runs[:-1]] == 0) & (np.diff(runs) == 1) & ~first[runs[1:]]
    new[runs[1:][alone]] = False
    blank = np.zeros(n, np.int64)
    blank[runs[:-1][alone]] = 1
    runs = np.flatnonzero(new)
    size = np.diff(np.append(runs, n))
    place = np.arange(1, n + 1) - np.repeat(runs + blank[runs], size)  # 0 for the blank, 1 for the first character after it
    cycle = np.arange(-1, int(size.max())) % BODY  # by table, as divisions are slow
    cycle[0] = -1
    starts = np.flatnonzero(new | ((cycle == 0) & (np.arange(len(cycle)) > 1))[place])
    codes = np.add.reduceat(c * _POWERS[1 + cycle][place], starts)
    bodies = starts + blank[starts]
    at = np.searchsorted(starts, ends)
    return [(codes[lo:hi], starts[lo:hi] - off, bodies[lo:hi] - off) for lo, hi, off in zip(np.append(0, at[:-1]), at, ends - sizes)]


def _tanh(z: np.ndarray, spare: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hyperbolic tangent in place, by a fraction that reaches 1 at 3 and is within 0.024 of it; ``spare``: two arrays like ``z``."""
    square, over = spare
    np.clip(z, -3, 3, out=z)
    np.multiply(z, z, out=square)
    np.add(square, 27, out=over)
    z *= over
    square *= 9
    square += 27
    z /= square
    return z


def _squash(z: np.ndarray, spare: np.ndarray, size: float) -> None:
    """The same fraction in place, of ``z / size`` and times ``size``: z (1 + 24 size² / (3 size² + z²)) where |z| is at most 3 size."""
    np.clip(z, np.float32(-3 * size), np.float32(3 * size), out=z)
    np.multiply(z, z, out=spare)
    spare += np.float32(3 * size * size)
    np.divide(np.float32(24 * size * size), spare, out=spare)
    spare += np.float32(1)
    z *= spare


class Tagger:
    """Weights: embedding, input, recurrent and bias matrices (one layer of each per direction), output layer, label transitions.

    Both directions advance in one loop: step k reads position k forward and position -1-k backward. The gates' order is
    input, forget, output, candidate.
    """

    def __init__(self, n_labels: int, embed: int = 20, hidden: int = 44, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.w = {
            "E": g(BODY + 1, N_CODES, embed) * 3, "W": np.zeros((WHOLE, embed), np.float32), "X": g(2, embed, 4 * hidden), "U": g(2, hidden, 4 * hidden), "c": np.zeros((2, 1, 4 * hidden), np.float32),
            "O": g(2 * hidden, n_labels), "o": np.zeros(n_labels, np.float32), "T": np.zeros((n_labels, n_labels), np.float32),
        }
        self.w["c"][:, :, hidden : 2 * hidden] = 1.0  # forget gate open at first
        self.step, self._m, self._v, self._mean, self._n = 0, None, None, None, 0
        self._known: tuple | None = None

    @property
    def h(self) -> int:
        return self.w["U"].shape[1]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tagger:
        with np.load(io.BytesIO(data)) as saved:
            w = {k: saved[k] for k in saved.files}
        out = cls(len(w["o"]), w["E"].shape[2], w["U"].shape[1])
        out.w = w
        return out

    def _vectors(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of different pieces, with their codes by place and their hashes."""
        parts = (pieces[:, None] // _POWERS) % N_CODES
        whole = (_ALIKE[parts] * _POWERS).sum(1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WHOLE.bit_length() + 1)
        return self.w["E"][np.arange(BODY + 1), parts].sum(1) + self.w["W"][whole], parts, whole

    # codes: (time, batch)
    def _run(self, codes: np.ndarray, keep: bool):
        w, hid = self.w, self.h
        steps, batch = codes.shape
        pieces, which = np.unique(codes, return_inverse=True)
        which = which.reshape(codes.shape)
        half = np.ones(4 * hid, np.float32)
        half[: 3 * hid] = 0.5  # the gates are sigmoids, by the tangent of half
        table = (self._vectors(pieces.astype(np.int64))[0] @ w["X"] + w["c"]) * half
        u = w["U"] * half
        h = np.zeros((2, batch, hid), np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, batch, 2 * hid), np.float32)
        saved = []
        live = (codes != PAD).astype(np.float32)[:, :, None]
        z, spare = np.empty((2, batch, 4 * hid), np.float32), tuple(np.empty((2, batch, 4 * hid), np.float32) for _ in range(2))
        tc, small = np.empty_like(c), tuple(np.empty_like(c) for _ in range(2))
        for k in range(steps):
            r = steps - 1 - k
            if keep:
                z, tc = np.empty_like(z), np.empty_like(tc)
            np.matmul(h, u, out=z)
            np.take(table[0], which[k], axis=0, out=spare[0][0], mode="clip")
            np.take(table[1], which[r], axis=0, out=spare[0][1], mode="clip")
            z += spare[0]
            _tanh(z, spare)
            s = z[:, :, : 3 * hid]
            s *= 0.5
            s += 0.5
            i, f, o, a = s[:, :, :hid], s[:, :, hid : 2 * hid], s[:, :, 2 * hid :], z[:, :, 3 * hid :]
            c_new = np.multiply(f, c, out=None if keep else c)
            c_new += np.multiply(i, a, out=small[0])
            np.copyto(tc, c_new)
            _tanh(tc, small)
            if keep:
                saved.append((k, h, c, i, f, o, a, tc))
            h = np.multiply(o, tc, out=None if keep else h)
            h[0] *= live[k]
            h[1] *= live[r]
            c_new[1] *= live[r]  # forward, nothing but padding follows padding
            c = c_new
            out[k, :, :hid] = h[0]
            out[r, :, hid:] = h[1]
        return out, saved, live

    def _rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the pieces add to the gates, scaled for ``_read`` (direction, row, gates), and the row of each code; rows are kept from batch to batch."""
        w, hid = self.w, self.h
        pieces, which = np.unique(codes, return_inverse=True)
        keys, rows, table, of = self._known or (None,) * 4
        now = (w["E"], w["W"], w["X"], w["c"])
        if of is None or any(a is not b for a, b in zip(of, now)) or len(keys) + len(pieces) > table.shape[1]:
            keys, rows, table = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((2, KEPT + len(pieces), 4 * hid), np.float32)
        new = pieces[~np.isin(pieces, keys)]
        if len(new):
            n = len(keys)
            table[:, n : n + len(new)] = (self._vectors(new.astype(np.int64))[0] @ w["X"] + w["c"]) * self._scale()
            at = np.searchsorted(keys, new)
            keys, rows = np.insert(keys, at, new), np.insert(rows, at, np.arange(n, n + len(new)))
        self._known = (keys, rows, table, now)
        return table, rows[np.searchsorted(keys, pieces)][which.reshape(codes.shape)]

    def _scale(self) -> np.ndarray:
        """A gate is 0.5 + tanh(z / 2) / 2; with the candidate halved as well, all are ``_squash`` of size 1 / 18."""
        out = np.full(4 * self.h, 1 / 36, np.float32)
        out[3 * self.h :] = 1 / 18
        return out

    def _read(self, codes: np.ndarray) -> np.ndarray:
        """The states that ``_run`` has, faster, when no gradients are wanted: scaled beforehand, the cells at half their size."""
        hid = self.h
        steps, batch = codes.shape
        table, which = self._rows(codes)
        u = self.w["U"] * self._scale()
        h, c = np.zeros((2, batch, hid), np.float32), np.zeros((2, batch, hid), np.float32)
        out = np.empty((steps, batch, 2 * hid), np.float32)
        live = (codes != PAD).astype(np.float32)[:, :, None]
        full = (codes != PAD).all(1)
        half = np.full(4 * hid, 0.5, np.float32)
        half[3 * hid :] = 0
        z, tc = np.empty((2, batch, 4 * hid), np.float32), np.empty_like(c)
        i, f, o, a = (z[:, :, g * hid : (g + 1) * hid] for g in range(4))
        spare, small = np.empty_like(z), np.empty_like(c)
        for k in range(steps):
            r = steps - 1 - k
            np.matmul(h, u, out=z)
            np.take(table[0], which[k], axis=0, out=spare[0], mode="clip")
            np.take(table[1], which[r], axis=0, out=spare[1], mode="clip")
            z += spare
            _squash(z, spare, 1 / 18)
            z += half
            c *= f
            c += np.multiply(i, a, out=small)
            np.multiply(c, np.float32(2 / 9), out=tc)
            _squash(tc, small, 1 / 9)
            np.multiply(o, tc, out=h)
            if not full[k]:
                h[0] *= live[k]
            if not full[r]:
                h[1] *= live[r]
                c[1] *= live[r]  # forward, nothing but padding follows padding
            out[k, :, :hid] = h[0]
            out[r, :, hid:] = h[1]
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self._run(codes, False)[0] @ self.w["O"] + self.w["o"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best label paths (time, batch) by the transitions."""
        return self.paths(codes, self._read(codes) @ self.w["O"] + self.w["o"])

    def paths(self, codes: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Best label paths of emissions.

        A window in which no stretch of other labels can beat the label 0, even with the best label and transition at every
        step, is all 0 and skips the search.
        """
        trans = self.w["T"]
        steps, batch, n = e.shape
        path = np.zeros((steps, batch), np.int8)
        lead = (e[:, :, 1:].max(2) - e[:, :, 0])
        lead[codes == PAD] = -np.inf
        gain = trans - trans[0, 0]
        into, on, out = max(0.0, float(gain[0, 1:].max())), float(gain[1:, 1:].max()), max(0.0, float(gain[1:, 0].max()))
        most = stretch = lead[0] + into
        for t in range(1, steps):
            stretch = lead[t] + np.maximum(into, stretch + on)
            most = np.maximum(most, stretch)
        some = np.flatnonzero(most + out >= -1e-3)
        if not len(some):
            return path
        e, codes = e[:, some], codes[:, some]
        back = np.empty((steps, len(some), n), np.int8)
        score = e[0]
        live = codes != PAD
        for t in range(1, steps):
            full = score[:, :, None] + trans
            best = full.argmax(axis=1)
            new = np.take_along_axis(full, best[:, None, :], 1)[:, 0] + e[t]
            m = live[t][:, None]
            score = np.where(m, new, score)
            back[t] = np.where(m, best, np.arange(n))
        part = np.empty((steps, len(some)), np.int8)
        part[-1] = score.argmax(axis=1)
        at = np.arange(len(some))
        for t in range(steps - 1, 0, -1):
            part[t - 1] = back[t, at, part[t]]
        path[:, some] = part
        return path

    def _crf(self, e: np.ndarray, gold: np.ndarray, live: np.ndarray):
        """Gradients of the mean negative log-likelihood by emissions and transitions, by scaled forward and backward sums."""
        step = np.exp(self.w["T"]).astype(np.float32)
        steps, batch, n = e.shape
        ex = np.exp(e - e.max(2, keepdims=True))
        m = live.astype(np.float32)[:, :, None]
        alpha, beta, size = np.empty_like(ex), np.ones_like(ex), np.ones((steps, batch, 1), np.float32)
        alpha[0] = ex[0] / ex[0].sum(1, keepdims=True)
        for t in range(1, steps):
            nxt = (alpha[t - 1] @ step) * ex[t]
            total = nxt.sum(1, keepdims=True)
            size[t] = np.where(m[t] > 0, total, 1)
            alpha[t] = np.where(m[t] > 0, nxt / total, alpha[t - 1])
        d_t = np.zeros((n, n), np.float32)
        for t in range(steps - 1, 0, -1):
            ahead = ex[t] * beta[t] / size[t] * m[t]
            d_t += alpha[t - 1].T @ ahead
            beta[t - 1] = np.where(m[t] > 0, ahead @ step.T, 1)
        d_t *= step
        d_e = alpha * beta * m
        np.put_along_axis(d_e, gold[:, :, None], np.take_along_axis(d_e, gold[:, :, None], 2) - m, 2)
        pairs = live[1:]
        np.subtract.at(d_t, (gold[:-1][pairs], gold[1:][pairs]), 1)
        return d_e / batch, d_t / batch

    def _gradients(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        w, hid = self.w, self.h
        both, saved, live = self._run(codes, True)
        d_e, d_t = self._crf(both @ w["O"] + w["o"], gold, codes != PAD)
        flat = both.reshape(-1, 2 * hid)
        grads = {"T": d_t, "O": flat.T @ d_e.reshape(len(flat), -1), "o": d_e.sum((0, 1))}
        d_both = d_e @ w["O"].T
        steps, batch = codes.shape
        turned = w["U"].transpose(0, 2, 1)
        d_u = np.zeros_like(w["U"])
        d_h = np.zeros((2, batch, hid), np.float32)
        d_c = np.zeros_like(d_h)
        d_zs = np.empty((steps, 2, batch, 4 * hid), np.float32)
        for k, h, c, i, f, o, a, tc in reversed(saved):
            r = steps - 1 - k
            d_h[0] += d_both[k, :, :hid]
            d_h[1] += d_both[r, :, hid:]
            d_h[0] *= live[k]
            d_h[1] *= live[r]
            d_c[1] *= live[r]
            d_c += d_h * o * (1 - tc * tc)
            d_z = d_zs[k]
            d_z[:, :, :hid] = d_c * a * i * (1 - i)
            d_z[:, :, hid : 2 * hid] = d_c * c * f * (1 - f)
            d_z[:, :, 2 * hid : 3 * hid] = d_h * tc * o * (1 - o)
            d_z[:, :, 3 * hid :] = d_c * i * (1 - a * a)
            d_u += h.transpose(0, 2, 1) @ d_z
            d_h = d_z @ turned
            d_c = d_c * f
        pieces, which = np.unique(codes, return_inverse=True)
        which = which.reshape(codes.shape)
        vectors, parts, whole = self._vectors(pieces.astype(np.int64))
        d_table = np.empty((2, len(pieces), 4 * hid), np.float32)
        for d, read in enumerate((which, which[::-1])):
            by = np.argsort(read, axis=None, kind="stable")
            d_table[d] = np.add.reduceat(d_zs[:, d].reshape(steps * batch, -1)[by], np.searchsorted(read.ravel()[by], np.arange(len(pieces))))
        grads["U"], grads["c"] = d_u, d_table.sum(1, keepdims=True)
        grads["X"] = vectors.T @ d_table
        d_vectors = (d_table @ w["X"].transpose(0, 2, 1)).sum(0)
        grads["E"], grads["W"] = np.zeros_like(w["E"]), np.zeros_like(w["W"])
        for place in range(BODY + 1):
            np.add.at(grads["E"][place], parts[:, place], d_vectors)
        np.add.at(grads["W"], whole, d_vectors)
        return grads

    def fit(self, windows: list[np.ndarray], labels: list[np.ndarray], steps: int, of: int | None = None, batch: int = 64, rate: float = 0.012) -> None:
        """Adam with gradient clipping; each batch takes windows of like length. ``of``: all steps of the schedule, of which these are a part.

        At the end of the schedule the weights are the mean over its last fifth.
        """
        of = of or steps
        rng = np.random.default_rng(3 + self.step)
        order = np.argsort([len(w) for w in windows], kind="stable")
        if self._m is None:
            self._m, self._v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(steps):
            self.step += 1
            lo = int(rng.integers(0, max(1, len(order) - batch)))
            pick = order[lo : lo + batch]
            codes = pad([windows[k] for k in pick])
            grads = self._gradients(codes, pad([labels[k] for k in pick]).astype(np.int64))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            lr = rate * min(1.0, self.step / 20) * (1 - 0.85 * min(1.0, self.step / of))
            for k, g in grads.items():
                g = (g * scale).astype(np.float32)
                self._m[k] = 0.9 * self._m[k] + 0.1 * g
                self._v[k] = 0.99 * self._v[k] + 0.01 * g * g
                self.w[k] = self.w[k] - lr * (self._m[k] / (1 - 0.9**self.step)) / (np.sqrt(self._v[k] / (1 - 0.99**self.step)) + 1e-8)
            if self.step > 0.8 * of:
                self._n += 1
                self._mean = {k: x.copy() if self._mean is None else self._mean[k] + x for k, x in self.w.items()}
        if self.step >= of and self._n:
            self.w = {k: (x / self._n).astype(np.float32) for k, x in self._mean.items()}
            self._mean, self._n = None, 0


def pad(rows: list[np.ndarray]) -> np.ndarray:
    """(time, batch), filled with ``PAD``."""
    out = np.zeros((max(map(len, rows)), len(rows)), np.int64)
    for k, r in enumerate(rows):
        out[: len(r), k] = r
    return out
