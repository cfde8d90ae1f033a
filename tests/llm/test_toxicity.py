"""The network against finite differences and plain loops, its windows, and the operator on planted toxic words and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefall.llm import gated, toxicity
from tests.llm.test_operators import SCHEMA, odd_rows


def small_batch():
    rng = np.random.default_rng(2)
    chars, char_lens = rng.integers(1, 60, (9, gated.PIECE)), rng.integers(1, 7, 9)
    rows, lens = rng.integers(0, 9, (6, 5)), np.array([6, 6, 4, 1, 0])
    return chars, char_lens, np.array([0, 1, 2, 3, 0, 0, 1, 2, 3]), rows, lens, np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 1, 0.5])


def test_gradients_are_those_of_finite_differences():
    p = {k: v.astype(np.float64) for k, v in gated.start(3).items()}
    p["words"][1:] = np.random.default_rng(1).standard_normal((3, gated.WORD_DIM))
    batch = small_batch()
    _, g = gated.loss_gradients(p, *batch)
    rng = np.random.default_rng(4)
    for k, v in p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0 if k != "words" else (1 if i == 0 else 0), n)) for i, n in enumerate(v.shape))
            kept, losses = v[at], []
            for d in (1e-5, -1e-5):
                v[at] = kept + d
                losses.append(gated.loss_gradients(p, *batch)[0])
            v[at] = kept
            assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6), (k, at)


def plain_gru(xs, state, h):
    out, s = [], np.zeros(h)
    for x in xs:
        a = s @ state
        r, z = (1 / (1 + np.exp(-(x[i * h : (i + 1) * h] + a[i * h : (i + 1) * h]))) for i in (0, 1))
        n = np.tanh(x[2 * h :] + r * a[2 * h :])
        s = (1 - z) * n + z * s
        out.append(s)
    return out


def test_window_logits_equal_plain_loops():
    p = {k: v.astype(np.float64) for k, v in gated.start(3).items()}
    chars, char_lens, word_row, rows, lens, _, _ = small_batch()
    read = gated.char_vectors(p, chars, char_lens)[0]
    for w in range(len(chars)):
        c = p["chars"][chars[w, : char_lens[w]]]
        f = plain_gru(c @ p["cf_in"] + p["cf_bias"], p["cf_state"], gated.CHAR_STATE)[-1]
        b = plain_gru(c[::-1] @ p["cb_in"] + p["cb_bias"], p["cb_state"], gated.CHAR_STATE)[-1]
        assert np.allclose(read[w], np.concatenate([f, b]))
    x = gated.word_inputs(p, read, word_row)
    got = gated.window_logits(p, x, rows, lens)[0]
    for i, n in enumerate(lens):
        if not n:
            assert got[i] == pytest.approx(p["out_bias"][0])
            continue
        seq = x[rows[:n, i]]
        f = plain_gru(seq @ p["wf_in"] + p["wf_bias"], p["wf_state"], gated.STATE)
        b = plain_gru(seq[::-1] @ p["wb_in"] + p["wb_bias"], p["wb_state"], gated.STATE)[::-1]
        s = np.concatenate([f, b], axis=1)
        e = np.exp(np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["query"])
        assert got[i] == pytest.approx((e / e.sum()) @ s @ p["out"] + p["out_bias"][0])


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 500, 1000])
def test_windows_cover_all_words_and_overlap(n):
    text, first, lens = toxicity.windows(np.array([3, 3 + n, 3 + n + 40]))
    first, lens = first[text == 0] - 3, lens[text == 0]
    covered = {k for a, m in zip(first, lens) for k in range(a, a + m)}
    assert covered == set(range(n)) and lens.max() <= toxicity.WINDOW
    for a in range(n - toxicity.STRIDE):
        assert any(b <= a and a + toxicity.STRIDE < b + m for b, m in zip(first, lens))


def test_words_are_whole_runs_cut_in_pieces():
    long = "y" * 40
    w = toxicity.words_of(["Ab-c1 " + long, "", None or "", "ß AB", "..."])
    assert np.diff(w.at).tolist() == [2 + 3, 0, 0, 2, 0]
    assert (w.end - w.begin).tolist() == [2, 2, 16, 16, 8, 1, 2]
    assert w.which[0] == w.which[6] and w.which[2] == w.which[3] != w.which[4]


def test_words_read_in_steps_are_the_same(monkeypatch):
    texts = [t for _, t, _ in planted(60)] + ["", "x" * 5000]
    whole = toxicity.words_of(texts)
    monkeypatch.setattr(toxicity, "steps", lambda t: ((i, min(i + 7, len(t))) for i in range(0, len(t), 7)))
    parts = toxicity.words_of_all(texts)
    for k in ("at", "which", "hashes", "lens"):
        assert (getattr(whole, k) == getattr(parts, k)).all(), k
    inside = np.arange(gated.PIECE) < whole.lens[:, None]
    assert (whole.chars[inside] == parts.chars[inside]).all()
    assert len(toxicity.words_of_all([]).at) == 1


def test_sampled_windows_are_the_texts_own():
    t = " ".join(f"w{i}" for i in range(400))
    got = toxicity.sampled_windows(t, 5)
    assert len(got) == 5 and all(g in t for g in got) and len(toxicity.sampled_windows(t, 1000)) == 24
    assert toxicity.sampled_windows("", 5) == [""]


def planted(n=900, seed=0):
    """Words by a rule; toxic texts hold a few words with one of two stems, whose ends differ, so that characters have to tell."""
    rng = np.random.default_rng(seed)
    parts = "ba do ki lu me no pa ri so tu ve wa".split()

    def word():
        return "".join(rng.choice(parts, rng.integers(1, 4)))

    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(5, 120)))]
        bad = int(rng.random() < 0.3)
        if bad:
            for _ in range(1 + len(words) // 25):
                words[int(rng.integers(len(words)))] = rng.choice(["zrog", "qlemp"]) + word()
        rows.append((i, " ".join(words), bad))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = planted()
    tail = " ".join(["ba do ki"] * 3000)
    more = [(5000, tail + " zrogtu qlempki zrogba", 1), (5001, tail + " ba", 0), (5002, "x" * 50_000, 0), *[(r[0] + 6000, r[1], r[2]) for r in odd_rows()[:12]]]
    docs = spark.createDataFrame([(i, t, "clash", 1.0, True) for i, t, _ in rows + more] + [(None, "ba", None, None, None)], "doc_id long, text string, t string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, None if i % 50 == 1 else y) for i, _, y in rows] + [(2, rows[2][2]), (None, 1)], "doc_id long, toxic int")
    return rows, {(r["doc_id"]): r for r in toxicity.score_toxicity(docs, labels).collect()}


def test_held_out_toxic_texts_are_found(judged):
    rows, got = judged
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_long_texts_are_read_to_their_end(judged):
    _, got = judged
    assert got[5000]["predicted"] == 1 and got[5001]["predicted"] == 0
    assert got[6000]["score"] == got[6001]["score"] == got[6002]["score"] and got[None]["held_out"] is False


def test_one_label_none_and_no_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("toxic")).distinct()
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(docs, one).collect()} == {(1.0, 1)}
    assert toxicity.score_toxicity(docs.where("false"), one).count() == 0


def test_calibration_is_bounded_and_keeps_the_order():
    z, y = np.array([-3.0, -2, -1, 4, 5, 9]), np.array([0, 0, 0, 1, 1, 1])
    scale, shift = toxicity.calibrate(z, y, np.ones(6))
    assert 0 < scale < 10 and ((scale * z + shift > 0) == (y == 1)).all()
