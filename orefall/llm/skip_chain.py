"""Skip-chain conditional random field over the words of a document that can be personal data.

Words beside each other share chain potentials; words of a document that repeat or resemble each other share skip potentials. Labels
say which kind of span a word begins or goes on with. Marginals come from loopy sum-product messages, in which the words of base
spans have their labels fixed.

The base patterns label only what they match, so that a field fitted to them as they are would learn nothing else. Mentions are
therefore hidden while fitting: each base span also stands in forms that the patterns refuse (no plus, other separators, the
local part alone), once linked to the mention that keeps its label, where the form has that label, and once on its own, where it
is a plain word. Form and neighbours are the same in both; only skip potentials can tell them apart. Words inside a refused run
of several words have no known label and are left out of the fit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from orefall.llm.pii_base import KINDS, luhn, refused_and_found

LABELS = ("other", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Binary features of a word's shape.
SHAPES = 44
WORD = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]")
EDGE = "\"'`.,;:!?[]{}<>*#%$&|="
GAP = re.compile(r"[ ./-]{0,2}")


def begin(kind: str) -> int:
    return 1 + 2 * KINDS.index(kind)


@dataclass
class Token:
    start: int
    end: int
    core: str
    label: int  # as the base has it, else 0
    fixed: bool  # part of a base span
    known: bool  # whether the label is taken for true when fitting
    keys: set[str] = field(default_factory=set)
    joined: int = 0  # 1: follows the word before it closely, 2: is followed closely, 3: both


def tokens_of(text: str) -> list[Token]:
    """The words of base spans and of refused runs of several words, other words with digits or @, and words that equal an address's local part."""
    refused, found = refused_and_found(text)
    if not refused and not found and not MARK.search(text):
        return []
    out, taken = [], bytearray(len(text))

    def take(a: int, b: int, label: int, fixed: bool, known: bool) -> None:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append(Token(a, b, text[a:b], label, fixed, known))

    heads = {}
    for a, b, kind in found:
        if taken.find(1, a, b) < 0:
            heads[a] = text[a:b]
            for n, m in enumerate(WORD.finditer(text, a, b)):
                take(m.start(), m.end(), begin(kind) + min(n, 1), True, True)
    for a, b, _ in sorted(refused, key=lambda r: (r[0], -r[1])):
        words = [m.span() for m in WORD.finditer(text, a, b)]
        for x, y in words if len(words) > 1 else []:
            take(x, y, 0, False, False)
    locals_ = {m.partition("@")[0].lower() for m in heads.values() if "@" in m}
    locals_ = {x for x in locals_ if len(x) >= 5 and re.search(r"[0-9._-]", x)}
    for m in WORD.finditer(text):
        word = m.group()
        if not MARK.search(word) and not (locals_ and word.strip(EDGE).lower() in locals_):
            continue
        a, b = m.start() + len(word) - len(word.lstrip(EDGE)), m.start() + len(word.rstrip(EDGE))
        if a < b:
            take(a, b, 0, False, True)
    out.sort(key=lambda t: t.start)
    _join(text, out, heads)
    return out


def _join(text: str, tokens: list[Token], heads: dict[int, str]) -> None:
    """Sets joined and keys: a base span's first word has the keys of the span, a free word its own and, as the first of a close run, the run's."""
    for x, y in zip(tokens, tokens[1:]):
        if y.start - x.end <= 2 and GAP.fullmatch(text, x.end, y.start):
            x.joined |= 2
            y.joined |= 1
    first = 0
    for i, t in enumerate(tokens):
        t.keys = keys(heads.get(t.start, "") if t.fixed else t.core)
        if not t.joined & 1 or t.fixed or tokens[i - 1].fixed:
            first = i
        elif not t.joined & 2 or tokens[i + 1].fixed:
            tokens[first].keys |= keys(text[tokens[first].start : t.end])
    labelled = {k for t in tokens if t.fixed for k in t.keys}
    for t in tokens:
        t.known = t.known and (t.fixed or not t.keys & labelled)


def keys(core: str) -> set[str]:
    """Mentions with a common key resemble each other: same letters and digits, same last seven digits, same local part."""
    low = "".join(c for c in core.lower() if c.isalnum())
    digits = "".join(c for c in core if "0" <= c <= "9")
    out = {low} if len(low) >= 5 else set()
    if len(digits) >= 7 and len(digits) * 2 >= len(low):
        out.add("d" + digits[-7:])
    local = core.partition("@")[0].lower()
    if len(local) >= 5:
        out.add("l" + local)
    return out


def shape(core: str, joined: int = 0, assigned: bool = False) -> list[int]:
    """Numbers of the features that hold."""
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    out = [0, 1 + min(digits, 19), 21 + min(core.count("."), 4), 26 + min(core.count("@"), 2)]
    out.append(29 + (0 if not letters else 1 if letters < digits else 2))
    out += [32] * core.startswith("+") + [33] * ("(" in core) + [34] * ("-" in core) + [35] * (core.isascii() and core.isdigit())
    out += [36] * bool(re.fullmatch(r"[0-9a-fA-F]{16,}", core)) + [37] * assigned
    parts = core.split(".")
    out += [38] * (len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts))
    out += [39] * (letters == 0 and digits >= 7)
    number = "".join(c for c in core if "0" <= c <= "9")
    out += [40 if luhn(number) else 43] * (12 <= digits <= 19) + [41] * (core.startswith("+") and 9 <= digits <= 15)
    return out + [42] * bool(joined & 1)


def shape_in(text: str, t: Token) -> list[int]:
    return shape(t.core, t.joined, text[max(0, t.start - 3) : t.start].rstrip().endswith("="))


def edges(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between words that follow each other closely, and skip edges that link the words of each key one after another."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i].joined & 2]
    last: dict[str, int] = {}
    skip = set()
    for i, t in enumerate(tokens):
        for k in t.keys:
            if k in last:
                skip.add((last[k], i))
            last[k] = i
    return chain, sorted(skip)


@dataclass
class Weights:
    shape: np.ndarray  # SHAPES by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray  # labels by labels

    def marginals(self, text: str, tokens: list[Token], rounds: int = 20, skips: bool = True) -> np.ndarray:
        """Beliefs (tokens by labels) after at most `rounds` damped rounds of messages; without skip edges if skips is false."""
        local = np.stack([self.shape[shape_in(text, t)].sum(axis=0) for t in tokens])
        for i, t in enumerate(tokens):
            if t.fixed:
                local[i] = -50.0
                local[i, t.label] = 0.0
        chain, skip = edges(tokens)
        pairs = [(np.array(e), p) for e, p in ((chain, self.chain), (skip if skips else [], self.skip)) if len(e)]
        if not pairs:
            return _normal(local)
        # Each kind of edge has its messages one way and the other; back holds where the opposite ones lie.
        src = np.concatenate([x for e, _ in pairs for x in (e[:, 0], e[:, 1])])
        dst = np.concatenate([x for e, _ in pairs for x in (e[:, 1], e[:, 0])])
        parts, back, at = [], [], 0
        for e, p in pairs:
            n = len(e)
            parts += [(at, at + n, p), (at + n, at + 2 * n, p.T)]
            back += [np.arange(at + n, at + 2 * n), np.arange(at, at + n)]
            at += 2 * n
        back = np.concatenate(back)
        factors = [np.exp(p - p.max()) for _, _, p in parts]
        msg = np.zeros((len(src), len(LABELS)))
        for _ in range(rounds):
            total = _gathered(local, dst, msg)
            out = total[src] - msg[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.concatenate([out[a:b] @ f for (a, b, _), f in zip(parts, factors)])
            new = np.log(np.maximum(new, 1e-300))
            new -= np.log(np.exp(new - new.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change < 1e-4:
                break
        return _normal(_gathered(local, dst, msg))


def _gathered(local: np.ndarray, dst: np.ndarray, msg: np.ndarray) -> np.ndarray:
    return local + np.stack([np.bincount(dst, msg[:, k], len(local)) for k in range(msg.shape[1])], axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forms(core: str, kind: str) -> list[str]:
    """Forms in which a mention comes again but no base pattern finds it."""
    digits = "".join(c for c in core if "0" <= c <= "9")
    if kind == "email":
        return [core.partition("@")[0], core.replace("@", "(at)")]
    if kind == "phone":
        return [digits, digits[-10:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}"]
    if kind == "card":
        return ["/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits[-7:]]
    return [core.replace(".", "-"), core.replace(".", "/")]


Example = tuple[list[int], list[int], list[int], list[int], int]


def _hidden(words: list[str], kind: str) -> list[Example]:
    """A hidden mention's words: with the label if linked to a labelled one, plain if linked to a plain word or to none."""
    b, out = begin(kind), []
    for i, w in enumerate(words):
        s = shape(w, int(i > 0))
        if i:
            last = b + min(i - 1, 1)
            out += [(s, [last], [], [], b + 1), (s, [0], [], [], 0)]
        else:
            out += [(s, [], [], [b], b)] * 2 + [(s, [], [], [], 0), (s, [], [], [0], 0)]  # as many labelled as plain ones
    return out


def examples(text: str) -> list[Example]:
    """(shape, labels of the chain neighbours before and after, of the skip neighbours, own label) of words and hidden mentions."""
    tokens = tokens_of(text)
    chain, skip = edges(tokens)
    before, after, far = ([[] for _ in tokens] for _ in range(3))
    for a, b in chain:
        before[b] += [tokens[a].label] * tokens[a].known
        after[a] += [tokens[b].label] * tokens[b].known
    for a, b in skip:
        far[b] += [tokens[a].label] * tokens[a].known
        far[a] += [tokens[b].label] * tokens[b].known
    out = []
    for i, t in enumerate(tokens):
        if t.known:
            out.append((shape_in(text, t), before[i], after[i], far[i], t.label))
            if far[i]:  # the same mention with the others hidden
                out.append((shape_in(text, t), before[i], after[i], [], t.label))
    for a, b, kind in refused_and_found(text)[1]:
        for form in forms(text[a:b], kind):
            if keys(form) & keys(text[a:b]):
                out += _hidden(form.split(" "), kind)
    return out


def fit(rows: list[Example], l2: float = 0.1, steps: int = 200) -> Weights:
    """Pseudo-likelihood: each word's label given its shape and its neighbours' labels, by gradient steps of adaptive size.

    Skip potentials are symmetric. Without rows all weights are zero, except that "other" is favoured.
    """
    m = len(LABELS)
    w = np.zeros((SHAPES + 3 * m, m))
    if rows:
        x = np.zeros((len(rows), SHAPES + 3 * m))
        for i, (s, b, a, f, _) in enumerate(rows):
            x[i, s] = 1
            for j, group in enumerate((b, a, f)):
                for v in group:
                    x[i, SHAPES + j * m + v] += 1
        x, back = np.unique(np.concatenate([x, np.array([r[4] for r in rows])[:, None]], axis=1), axis=0, return_inverse=True)
        count = np.bincount(back.ravel())[:, None].astype(float)
        x, y = x[:, :-1], x[:, -1].astype(int)
        g2 = np.full_like(w, 1e-8)
        for _ in range(steps):
            p = _normal(x @ w)
            p[np.arange(len(y)), y] -= 1
            g = x.T @ (count * p) + l2 * w
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
    else:
        w[0, 0] = 5.0
    chain = (w[SHAPES : SHAPES + m] + w[SHAPES + m : SHAPES + 2 * m].T) / 2
    far = w[SHAPES + 2 * m :]
    return Weights(w[:SHAPES], chain, (far + far.T) / 2)


def added(text: str, weights: Weights, least: float = 0.5, skips: bool = True) -> list[tuple[int, int, str]]:
    """Spans beyond the base: free words whose belief in the begin of one kind is over `least`, with those that go on with it."""
    tokens = tokens_of(text)
    if all(t.fixed for t in tokens):
        return []
    p = weights.marginals(text, tokens, skips=skips)
    label = np.where(p.max(axis=1) > least, p.argmax(axis=1), 0)
    out: list[tuple[int, int, str]] = []
    live = 0  # the label with which the last added span would go on
    for t, k in zip(tokens, label):
        if t.fixed or not k:
            live = 0
        elif k % 2:
            out.append((t.start, t.end, KINDS[(k - 1) // 2]))
            live = k + 1
        elif k == live and t.joined & 1:
            out[-1] = (out[-1][0], t.end, out[-1][2])
        else:
            live = 0
    return out
