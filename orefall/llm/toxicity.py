"""Toxicity: a bidirectional gated recurrent network over characters and words scores all overlapping windows of a text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm import gated
from orefall.llm.common import STEP_CHARS, U, crc32_of, highest_level, level, mix, powers, step_texts, steps, word_chars

#: Words in a window, and from one window's begin to the next.
WINDOW, STRIDE = 32, 16
#: The network is fitted on at most so many labelled documents of each label, and windows of each document: those of the lowest hashes.
FIT_ROWS, FIT_WINDOWS = 2000, 16
#: Words of so many sampled documents have an input of their own; rarer ones are known by their characters alone.
FREQUENT = 20
#: Passes over the sample: first all its windows have their document's label, then a toxic document's highest window has it.
FIRST, THEN, BATCH, RATE = 3, 5, 64, 0.008


@dataclass
class Words:
    """Word pieces of some texts: lower-cased runs of letters and numbers, cut after every PIECE characters."""

    at: np.ndarray  # where each text's pieces begin, one more for the end
    begin: np.ndarray  # of each piece, in the texts joined by one character
    end: np.ndarray
    which: np.ndarray  # the distinct piece that each one is
    hashes: np.ndarray  # of the distinct pieces
    chars: np.ndarray  # distinct pieces by PIECE
    lens: np.ndarray


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = np.zeros(len(cp) + 2, dtype=bool)
    ok[1:-1] = word_chars()[cp]
    turns = np.flatnonzero(ok[1:] != ok[:-1])
    a, b = turns[::2], turns[1::2]
    n = -(-(b - a) // gated.PIECE)
    if len(n) and n.max() > 1:
        a = np.repeat(a, n) + gated.PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        b = np.minimum(np.repeat(b, n), a + gated.PIECE)
    up, down = powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, dtype=U)
    np.cumsum(cp.astype(U) * up[: len(cp)], out=sums[1:])
    hashes, first, which = np.unique(mix((sums[b] - sums[a]) * down[a]), return_index=True, return_inverse=True)
    lens = (b - a)[first]
    place = np.minimum(a[first][:, None] + np.arange(gated.PIECE), len(cp) - 1)
    ends = np.cumsum([len(t) + 1 for t in low])
    return Words(np.concatenate([[0], np.searchsorted(a, ends)]), a, b, which, hashes, gated.char_rows(cp[place]), lens)


def words_of_all(texts: list[str]) -> Words:
    """words_of any number of texts, read in steps, which bounds memory; begin and end are left out."""
    parts = [words_of(texts[i:j]) for i, j in steps(texts)]
    none = np.zeros(0, dtype=np.int64)
    if not parts:
        return words_of([])
    hashes, first, place = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    stops = np.cumsum([0] + [len(p.hashes) for p in parts])
    which = np.concatenate([place[a + p.which] for a, p in zip(stops, parts)])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts]))])
    return Words(at, none, none, which, hashes, np.concatenate([p.chars for p in parts])[first], np.concatenate([p.lens for p in parts])[first])


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts whose words begin at `at`: the text, the first word and the number of words of each.

    Every word lies in a window; every run of STRIDE + 1 words that fits lies in one as a whole. A text without words has one
    empty window.
    """
    m = np.diff(at)
    n = np.maximum(1, -(-(m - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(m)), n)
    first = STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return text, at[:-1][text] + first, np.minimum(WINDOW, m[text] - first)


def _steps(which: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Steps by windows: the distinct word that each takes in."""
    if not len(which):
        return np.zeros((1, len(first)), dtype=np.int64)
    return which[np.minimum(first + np.arange(max(1, int(lens.max(initial=1))))[:, None], len(which) - 1)]


def rows_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted vocabulary, from 1; 0 for those that it lacks."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


@dataclass
class Model:
    """scale and shift turn a text's highest window logit into a calibrated one."""

    params: gated.Params
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U), repr=False)
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    _known: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U), repr=False)
    _read: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 * gated.CHAR_STATE), dtype=np.float32), repr=False)

    def inputs(self, w: Words) -> np.ndarray:
        """Inputs of the distinct words. Character layers read each word once; the last ROOM words read are remembered."""
        at = np.searchsorted(self._known, w.hashes)
        new = np.ones(len(w.hashes), dtype=bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != w.hashes[inside]
        read = np.empty((len(new), 2 * gated.CHAR_STATE), dtype=np.float32)
        read[~new] = self._read[at[~new]]
        if new.any():
            read[new] = gated.read_words(self.params, w.chars[new], w.lens[new])
            if len(self._known) + int(new.sum()) > ROOM:
                self._known, self._read, new = w.hashes, read, new[:0]
            else:
                known = np.concatenate([self._known, w.hashes[new]])
                order = np.argsort(known)
                self._known, self._read = known[order], np.concatenate([self._read, read[new]])[order]
        return gated.word_inputs(self.params, read, rows_of(self.vocabulary, w.hashes))

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text, over all its windows."""
        w = words_of(texts)
        text, first, lens = windows(w.at)
        order = np.argsort(-lens, kind="stable")
        z = np.empty(len(text))
        x = self.inputs(w)
        for i in range(0, len(order), 2048):
            some = order[i : i + 2048]
            z[some] = gated.window_logits(self.params, x if len(x) else np.zeros((1, x.shape[1]), np.float32), _steps(w.which, first[some], lens[some]), lens[some])[0]
        return np.maximum.reduceat(z, np.flatnonzero(np.diff(text, prepend=-1)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.highest(texts) + self.shift, -500, 500)))


#: Words whose character layers a task remembers at most; they only save time.
ROOM = 1 << 17


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the least weighted log loss, with a weak pull towards 1 and 0, by Newton steps."""
    k = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)

    def loss(k: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, x @ k) - y * (x @ k))).sum() + 0.25 * ((k - [1.0, 0.0]) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ k, -500, 500)))
        g = x.T @ (weight * (p - y)) + 0.5 * (k - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), g)
        far = 1.0
        while far > 1e-6 and loss(k - far * step) > loss(k):
            far /= 2
        k = k - far * step
    return float(max(k[0], 1e-3)), float(k[1])


def fit(sample: list[tuple[int, list[str]]], seed: int = 5, there: tuple[int, int] | None = None) -> Model:
    """A model of (label, windows as words joined by spaces), one for each document. Its windows share the document's label.

    there: how many documents of label 0 and 1 the sample stands for, which the calibration of a fifth held back takes into account.
    """
    y = np.array([r[0] for r in sample], dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, constant=float(y.mean()) if len(y) else 0.0)
    w = words_of_all([t for r in sample for t in r[1]])
    doc = np.repeat(np.arange(len(sample)), [len(r[1]) for r in sample])
    first, lens = w.at[:-1], np.minimum(np.diff(w.at), WINDOW)
    word_doc = np.unique(np.repeat(doc, np.diff(w.at)) * np.int64(len(w.hashes)) + w.which)
    vocabulary = w.hashes[np.bincount(word_doc % max(1, len(w.hashes)), minlength=len(w.hashes)) >= FREQUENT]
    word_row = rows_of(vocabulary, w.hashes)
    held = np.arange(len(y)) % 5 == 4
    p, rng = gated.start(len(vocabulary)), np.random.default_rng(seed)
    adam = gated.Adam(p, RATE)

    def learn(some: np.ndarray, weight: np.ndarray) -> None:
        some = some[np.argsort(-lens[some], kind="stable")]
        rows = _steps(w.which, first[some], lens[some])
        used, back = np.unique(rows, return_inverse=True)
        shown = word_row[used] * (rng.random(len(used)) >= gated.HIDDEN)
        adam.step(p, gated.loss_gradients(p, w.chars[used], w.lens[used], shown, back.reshape(rows.shape), lens[some], y[doc[some]], weight[some])[1])

    def all_logits() -> np.ndarray:
        z = np.empty(len(doc))
        x = gated.word_inputs(p, gated.read_words(p, w.chars, w.lens), word_row)
        order = np.argsort(-lens, kind="stable")
        for i in range(0, len(order), 2048):
            some = order[i : i + 2048]
            z[some] = gated.window_logits(p, x, _steps(w.which, first[some], lens[some]), lens[some])[0]
        return z

    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    for epoch in range(FIRST + THEN):
        if epoch < FIRST:
            use = rng.random(len(doc)) < 4 / np.bincount(doc)[doc]
        else:
            # A toxic document has a toxic window, but which one is not known; all windows of the others are clean.
            z = all_logits()
            top = z == np.maximum.reduceat(z, starts)[doc]
            use = top | ((y[doc] == 0) & (rng.random(len(doc)) < 2 / np.bincount(doc)[doc]))
        use &= ~held[doc]
        weight = np.ones(len(doc), dtype=np.float32)
        toxic = y[doc] == 1
        weight[use & toxic] = max(1.0, float((use & ~toxic).sum()) / max(1, int((use & toxic).sum())) / 2)
        adam.rate = RATE * (1 - epoch / (FIRST + THEN + 1))
        chosen = rng.permutation(np.flatnonzero(use))
        for i in range(0, len(chosen), BATCH):
            learn(chosen[i : i + BATCH], weight)
    top = np.maximum.reduceat(all_logits(), starts)
    have = np.bincount(y[held].astype(int), minlength=2)
    weight = np.maximum(there or have, 1) / np.maximum(have, 1)
    weight = weight[y[held].astype(int)]
    scale, shift = calibrate(top[held], y[held], weight * held.sum() / weight.sum())
    return Model(p, vocabulary, scale, shift)


def sampled_windows(text: str, most: int) -> list[str]:
    """The windows of a text as words joined by spaces, in order; where there are more than `most`, those of the lowest hashes."""
    low = text.lower()
    w = words_of([low])
    _, first, lens = windows(w.at)
    if len(first) > most:
        h = mix(w.hashes[w.which][first] + np.arange(len(first)).astype(U))
        keep = np.sort(np.argsort(h, kind="stable")[:most])
        first, lens = first[keep], lens[keep]
    return [" ".join(low[a:b] for a, b in zip(w.begin[i : i + n], w.end[i : i + n])) for i, n in zip(first, lens)]


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS, fit_windows: int = FIT_WINDOWS) -> Model:
    """A model of the labels of the rows of docs (doc_id, t) for which `learn` holds.

    labels: doc_id, toxic. Null labels are left out; a document with several labels has the one of their mean, 1 at one half. Keys
    alone are counted by label and hash level; only texts up to the levels that fit_rows allows are read, and of each at most
    fit_windows windows of WINDOW pieces of PIECE characters go to the driver. Null text counts as empty.
    """
    hashed = F.xxhash64("doc_id")
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    known = docs.where(learn).join(one, F.col("doc_id") == F.col("_id"))
    counts = known.groupBy("y", level(hashed).alias("lv")).count().collect()
    top = {y: highest_level([(r["lv"], r["count"]) for r in counts if r["y"] == y], fit_rows) for y in (0, 1)}
    highest = F.when(F.col("y") == 1, F.lit(top[1])).otherwise(F.lit(top[0]))
    few = one.where(level(F.xxhash64("_id")) <= highest)
    sample = docs.where(learn & (level(hashed) <= max(top.values()))).select("doc_id", "t").join(few, F.col("doc_id") == F.col("_id"))

    def run(batches):
        for b in batches:
            cut = [sampled_windows(t or "", fit_windows) for texts in step_texts(b.column(2)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.list_(pa.string()))], ["h", "y", "w"])

    rows = sample.select(hashed.alias("h"), "y", "t").mapInArrow(run, "h long, y int, w array<string>").limit(2 * fit_rows).collect()
    there = tuple(sum(r["count"] for r in counts if r["y"] == y) for y in (0, 1))
    return fit([(r["y"], r["w"]) for r in sorted(rows, key=lambda r: (r["h"], r["w"]))], there=there)


def with_toxicity(df: DataFrame, model: Model, text: str = "t") -> DataFrame:
    """df with its text column replaced by score (0 to 1, higher: likelier toxic): the highest of all windows of the whole text."""
    other = [f for f in df.schema if f.name != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in other)

    def run(batches):
        for b in batches:
            parts = [model.scores([t or "" for t in texts]) for texts in step_texts(b.column(b.num_columns - 1), STEP_CHARS // 2)]
            scores = np.concatenate(parts or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return df.select(*[f.name for f in other], text).mapInArrow(run, f"{kinds}, score double")


def held_out(key: str, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(crc32_of(key), F.lit(folds)) == fold, F.lit(False))


def score_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted. Labels of held-out rows are not learned.

    Null and empty texts, and texts without words, have the score of an empty window; where all labels agree, every score is that label, and
    without labels it is 0. Whole texts are read in overlapping windows, very long ones and very long words too; a score of 0.5
    counts as 1. Repeated rows and null keys come back as they are; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    held = held_out("doc_id")
    scored = with_toxicity(docs.select("doc_id", held.alias("held_out"), "t"), train(docs, labels, ~held))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
