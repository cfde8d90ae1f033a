"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import STEP_CHARS, U, crc32_of, highest_level, level, step_texts, steps, summed_counters, word_chars

#: Hashed features, and the longest n-gram.
FEATURES, LONGEST = 1 << 16, 3
#: The classifier is fitted on at most so many documents of each language, and of all languages.
FIT_ROWS, FIT_TOTAL = 1000, 20_000
#: Follow the regularised leader: learning rate, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 4
#: L1-normalised TF-IDF values are small; this factor brings them near 1.
SCALE = 100.0
NONE = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each n-gram of letters (word edges count as a mark) of the lower-cased texts, text by text.

    Also where each text's n-grams begin (one more for the end), and whether the text has a letter.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[cp]
    c = np.where(letter, cp, 0).astype(U)
    ends = np.cumsum([len(t) + 1 for t in low])
    begin = np.concatenate([[0], ends[:-1]])
    # Marks between words stand once; runs of other characters fall together with them.
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[begin] = True
    text_of = np.repeat(np.arange(len(texts)), ends - begin)[keep]
    c = c[keep]
    out, whose = [], []
    h = np.zeros(len(c), dtype=U)
    for n in range(1, LONGEST + 1):
        h = h[: len(c) - n + 1] * U(0x100000001B3) + c[n - 1 :] + U(n)
        same = text_of[n - 1 :] == text_of[: len(text_of) - n + 1]
        some = c[: len(c) - n + 1] > 0 if n == 1 else same
        out.append(((h[some] * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int32) & (FEATURES - 1))
        whose.append(text_of[: len(c) - n + 1][some])
    f, d = np.concatenate(out), np.concatenate(whose)
    order = np.argsort(d.astype(np.uint16) if len(texts) < 1 << 16 else d, kind="stable")
    has = np.add.reduceat(letter.astype(np.int64), begin) > 0
    return f[order], np.searchsorted(d[order], np.arange(len(texts) + 1)).astype(np.int64), has


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        import sys
        import unicodedata

        _LETTERS = word_chars().copy()
        numbers = np.fromiter((unicodedata.category(chr(c))[0] == "N" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
        _LETTERS &= ~numbers
    return _LETTERS


_LETTERS: np.ndarray | None = None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # langs by features, sparse by the L1 penalty
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities (texts by langs), and whether each text has a letter."""
        f, at, has = grams(texts)
        z = np.tile(self.bias, (len(texts), 1))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            total = np.add.reduceat(self.idf[f], at[:-1][full])
            for k in range(len(self.langs)):
                z[full, k] += SCALE * np.add.reduceat((self.idf * self.weights[k]).astype(np.float64)[f], at[:-1][full]) / total
        return softmax(z / self.temperature), has


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sparse(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and L1-normalised TF-IDF values of each text."""
    out = []
    for i, j in steps(texts):
        f, at, _ = grams(texts[i:j])
        for a, b in zip(at[:-1], at[1:]):
            k, tf = np.unique(f[a:b], return_counts=True)
            v = tf * idf[k]
            out.append((k, SCALE * v / v.sum() if len(k) else v))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with elastic-net penalties, row after row."""
    z, g2 = np.zeros((n, FEATURES)), np.zeros((n, FEATURES))
    zb, gb = np.zeros(n), np.zeros(n)

    def weights(z: np.ndarray, g2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            k, v = rows[i]
            zk, gk = z[:, k], g2[:, k]
            w, b = weights(zk, gk), weights(zb, gb)
            p = softmax((w @ v + b)[None, :])[0]
            p[y[i]] -= 1.0
            g = p[:, None] * v[None, :]
            s = (np.sqrt(gk + g * g) - np.sqrt(gk)) / ALPHA
            z[:, k] += g - s * w
            g2[:, k] += g * g
            zb += p - (np.sqrt(gb + p * p) - np.sqrt(gb)) / ALPHA * b
            gb += p * p
    return weights(z, g2), weights(zb, gb)


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, fit_total: int = FIT_TOTAL) -> Model | None:
    """A model of the rows for which `learn` holds and text and lang are not null; None if there are none.

    Document frequencies are those of all such rows. The weights are fitted on at most fit_rows of each language and fit_total
    of all, those whose keys have the lowest hash levels, a fifth of them held back for the temperature.
    """
    rows = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(lang)).alias("h"))

    def seen(texts: list[str], total: np.ndarray) -> None:
        f, at, _ = grams(texts)
        flag = np.zeros(FEATURES, dtype=np.int64)
        for a, b in zip(at[:-1], at[1:]):
            flag[f[a:b]] = 1
            total[:FEATURES] += flag
            flag[f[a:b]] = 0
        total[FEATURES] += len(texts)

    counts = summed_counters(rows.select("t"), seen, FEATURES + 1)
    n = int(counts[FEATURES])
    if not n:
        return None
    idf = np.log((1 + n) / (1 + counts[:FEATURES])) + 1
    # Narrow keys are counted by language and hash level; the levels chosen are a small table that texts are joined with.
    by_lang = defaultdict(list)
    for r in rows.groupBy("lang", level(F.col("h")).alias("lv")).count().collect():
        by_lang[r["lang"]].append((r["lv"], r["count"]))
    most = max(2, min(fit_rows, fit_total // max(len(by_lang), 1)))
    top = df.sparkSession.createDataFrame([(k, highest_level(v, most)) for k, v in by_lang.items()], "_lang string, _top int")
    chosen = rows.join(top, (F.col("lang") == F.col("_lang")) & (level(F.col("h")) <= F.col("_top")))

    def counted(batches):
        for b in batches:
            x = [v for texts in step_texts(b.column(2)) for v in sparse(texts, idf)]
            at, v = (pa.array([np.asarray(r[i], dtype=kind).tobytes() for r in x], pa.binary()) for i, kind in ((0, "<i4"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, v], ["h", "lang", "at", "v"])

    # A text goes to the driver as its features, at most FEATURES numbers however long it is.
    rows = chosen.select("h", "lang", "t").mapInArrow(counted, "h long, lang string, at binary, v binary").limit(max(fit_total, 2 * len(by_lang)))
    sample = sorted(rows.collect(), key=lambda r: (r["h"], bytes(r["at"]), bytes(r["v"])))
    langs = sorted({r["lang"] for r in sample})
    y = np.array([langs.index(r["lang"]) for r in sample])
    x = [(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["v"], dtype="<f4").astype(np.float64)) for r in sample]
    held = np.arange(len(x)) % 5 == 4
    if len(langs) < 2 or not held.any():
        return Model(langs, idf, np.zeros((len(langs), FEATURES)), np.zeros(len(langs)), 1.0)
    w, b = train([x[i] for i in np.flatnonzero(~held)], y[~held], len(langs))
    z = np.stack([w[:, k] @ v + b for k, v in (x[i] for i in np.flatnonzero(held))])
    return Model(langs, idf, w, b, temperature_of(z, y[held]))


def predict_language(df: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of df: doc_id, the columns of `keep`, lang_pred, score.

    lang_pred is `und` with score 0 for null text, text without a letter, or without a model. Whole texts are read; repeated
    rows and null keys come back as they are; an empty table gives no rows; other columns are ignored.
    """
    extra = keep or {}
    rows = df.select(F.col(key).alias("doc_id"), *[c.alias(n) for n, c in extra.items()], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")

    def run(batches):
        for b in batches:
            langs, score = [], []
            for texts in step_texts(b.column(b.num_columns - 1), STEP_CHARS // 2):
                if model is None:
                    langs += [NONE] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                p, has = model.probabilities(texts)
                best = p.argmax(axis=1)
                langs += [model.langs[k] if ok else NONE for k, ok in zip(best, has)]
                score += np.where(has, p.max(axis=1), 0.0).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows outside the held-out fold, predicted for all."""
    held = F.coalesce(F.pmod(crc32_of(key), F.lit(folds)) == held_fold, F.lit(False))
    return predict_language(df, fit(df, ~held, text, lang, key), text, key, {"held_out": held})
