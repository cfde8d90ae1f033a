"""A bidirectional gated recurrent network with attention pooling over characters and words, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters in a word piece; a longer word is several pieces, so that it is read to its end.
PIECE = 16
#: Rows of the character table. Code points below half of it stand for themselves, others share the other half by hash.
CHARS = 512
#: Sizes: character and word embeddings, states of the character and word layers (each direction), attention.
CHAR_DIM, WORD_DIM, CHAR_STATE, STATE, ATTEND = 8, 8, 12, 16, 16
#: Share of the words whose word input is hidden while learning, so that the characters have to tell.
HIDDEN = 0.7
Params = dict[str, np.ndarray]


def char_rows(cp: np.ndarray) -> np.ndarray:
    half = np.uint32(CHARS // 2)
    return np.where(cp < half, cp, half + (cp * np.uint32(2654435761) >> np.uint32(16)) % half).astype(np.int32)


def start(n_words: int, seed: int = 11) -> Params:
    """First values of all weights. Row 0 of the word table stands for every word without a row of its own and stays zero."""
    rng = np.random.default_rng(seed)

    def some(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    p = {"chars": some(CHARS, CHAR_DIM, scale=0.5), "words": np.zeros((n_words + 1, WORD_DIM), np.float32)}
    for layer, n, h in (("c", CHAR_DIM, CHAR_STATE), ("w", 2 * CHAR_STATE + WORD_DIM, STATE)):
        for way in "fb":
            p |= {f"{layer}{way}_in": some(n, 3 * h), f"{layer}{way}_state": some(h, 3 * h), f"{layer}{way}_bias": np.zeros(3 * h, np.float32)}
    return p | {"attend": some(2 * STATE, ATTEND), "attend_bias": np.zeros(ATTEND, np.float32), "query": some(ATTEND), "out": some(2 * STATE), "out_bias": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Layer:
    """One direction over sequences sorted by falling length. rows: for each step and sequence, the row of `given` it takes in.

    last is the state that each sequence ends with, all its states at every step (if `every`).
    """

    def __init__(self, given: np.ndarray, rows: np.ndarray, lens: np.ndarray, state: np.ndarray, backwards: bool, keep: bool = False, every: bool = True):
        self.rows, self.state, h3 = rows, state, given.shape[1]
        self.h = h = h3 // 3
        steps = len(rows)
        alive = np.searchsorted(-lens, -np.arange(steps), side="left")
        self.order = [(t, int(alive[t])) for t in (range(steps - 1, -1, -1) if backwards else range(steps)) if alive[t]]
        self.last = np.zeros((rows.shape[1], h), given.dtype)
        self.all = np.zeros((steps if every else 0, rows.shape[1], h), given.dtype)
        self.kept = []
        for t, k in self.order:
            x, before = given[rows[t, :k]], self.last[:k]
            a = before @ state
            gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
            after = n + z * (before - n)
            if keep:
                self.kept.append((before.copy(), r, z, n, a[:, 2 * h :]))
            self.last[:k] = after
            if every:
                self.all[t, :k] = after

    def gradients(self, of_all: np.ndarray | None, of_last: np.ndarray | None, n_given: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of `given` and of the state weights."""
        h = self.h
        carry = np.zeros_like(self.last) if of_last is None else of_last.copy()
        d_state, d_rows = np.zeros_like(self.state), []
        for (t, k), (before, r, z, n, a) in zip(reversed(self.order), reversed(self.kept)):
            dh = carry[:k] if of_all is None else carry[:k] + of_all[t, :k]
            dn = dh * (1 - z) * (1 - n * n)
            dr, dz = dn * a * r * (1 - r), dh * (before - n) * z * (1 - z)
            da = np.concatenate([dr, dz, dn * r], axis=1)
            d_state += before.T @ da
            carry[:k] = dh * z + da @ self.state.T
            d_rows.append((self.rows[t, :k], np.concatenate([dr, dz, dn], axis=1)))
        at, d = np.concatenate([x[0] for x in d_rows]), np.concatenate([x[1] for x in d_rows])
        return summed(at, d, n_given), d_state


def summed(at: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Rows of d added up by their places."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, d.shape[1]), d.dtype)
    out[at[order][first]] = np.add.reduceat(d[order], first, axis=0)
    return out


def char_vectors(p: Params, chars: np.ndarray, lens: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """What both directions have read of each word's characters (words by PIECE); also what gradients need."""
    order = np.argsort(-lens, kind="stable")
    rows, n = chars[order].T[: int(lens.max(initial=0))], lens[order]
    both = [Layer(p["chars"] @ p[f"c{w}_in"] + p[f"c{w}_bias"], rows, n, p[f"c{w}_state"], w == "b", keep, every=False) for w in "fb"]
    out = np.empty((len(chars), 2 * CHAR_STATE), p["chars"].dtype)
    out[order] = np.concatenate([x.last for x in both], axis=1)
    return out, (order, both)


def read_words(p: Params, chars: np.ndarray, lens: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """char_vectors of any number of words, `most` at a time, which bounds memory."""
    parts = [char_vectors(p, chars[i : i + most], lens[i : i + most])[0] for i in range(0, len(chars), most)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * CHAR_STATE), p["chars"].dtype)


def word_inputs(p: Params, read: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.concatenate([read, p["words"][row]], axis=1)


def window_logits(p: Params, x: np.ndarray, rows: np.ndarray, lens: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """A logit for each window. rows: steps by windows, places in x; lens fall. A window without words has the bias alone."""
    both = [Layer(x @ p[f"w{w}_in"] + p[f"w{w}_bias"], rows, lens, p[f"w{w}_state"], w == "b", keep) for w in "fb"]
    s = np.concatenate([b.all for b in both], axis=2)
    u = np.tanh(s.reshape(-1, 2 * STATE) @ p["attend"] + p["attend_bias"])
    e = (u @ p["query"]).reshape(s.shape[:2])
    e = np.where(np.arange(len(rows))[:, None] < lens, e, -np.inf)
    e = np.exp(e - np.maximum(e.max(axis=0, initial=-1e30), -1e30))
    share = e / np.maximum(e.sum(axis=0), 1e-30)
    pooled = np.einsum("tb,tbh->bh", share, s)
    return pooled @ p["out"] + p["out_bias"], (both, s, u, share, pooled)


def loss_gradients(p: Params, chars: np.ndarray, char_lens: np.ndarray, word_row: np.ndarray, rows: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Weighted mean log loss of windows with labels y, and its gradient by every parameter."""
    read, (order, of_chars) = char_vectors(p, chars, char_lens, keep=True)
    x = word_inputs(p, read, word_row)
    z, (of_words, s, u, share, pooled) = window_logits(p, x, rows, lens, keep=True)
    w = weight / weight.sum()
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    dz = (w * (_sigmoid(z) - y)).astype(z.dtype)
    g = {"out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True)}
    d_pooled = dz[:, None] * p["out"]
    d_share = np.einsum("tbh,bh->tb", s, d_pooled)
    de = share * (d_share - (share * d_share).sum(axis=0))
    du = (de.reshape(-1, 1) * p["query"]) * (1 - u * u)
    flat = s.reshape(-1, 2 * STATE)
    g |= {"query": u.T @ de.ravel(), "attend": flat.T @ du, "attend_bias": du.sum(axis=0)}
    ds = share[:, :, None] * d_pooled + (du @ p["attend"].T).reshape(s.shape)
    dx = np.zeros_like(x)
    for w_, layer, part in zip("fb", of_words, (ds[:, :, :STATE], ds[:, :, STATE:])):
        d, g[f"w{w_}_state"] = layer.gradients(part, None, len(x))
        g |= {f"w{w_}_in": x.T @ d, f"w{w_}_bias": d.sum(axis=0)}
        dx += d @ p[f"w{w_}_in"].T
    g["words"] = summed(word_row, dx[:, 2 * CHAR_STATE :], len(p["words"]))
    g["words"][0] = 0
    d_read = dx[order][:, : 2 * CHAR_STATE]
    g["chars"] = np.zeros_like(p["chars"])
    for w_, layer, part in zip("fb", of_chars, (d_read[:, :CHAR_STATE], d_read[:, CHAR_STATE:])):
        d, g[f"c{w_}_state"] = layer.gradients(None, part, CHARS)
        g |= {f"c{w_}_in": p["chars"].T @ d, f"c{w_}_bias": d.sum(axis=0)}
        g["chars"] += d @ p[f"c{w_}_in"].T
    return loss, g


class Adam:
    """Steps with running means of the gradient and of its square."""

    def __init__(self, p: Params, rate: float):
        self.rate, self.n = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: Params, g: Params, clip: float = 1.0) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        scale = min(1.0, clip / max(norm, 1e-12))
        for k, d in g.items():
            d = d * np.float32(scale)
            self.m[k] += np.float32(0.1) * (d - self.m[k])
            self.v[k] += np.float32(0.001) * (d * d - self.v[k])
            fast = self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
            p[k] -= np.float32(fast) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
