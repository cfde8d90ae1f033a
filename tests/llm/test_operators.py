"""Each operator against brute force on small tables, with nulls, empty and long texts, repeats, and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orefall.llm import skip_chain
from orefall.llm.bpe import TokenCounter
from orefall.llm.components import components
from orefall.llm.cutting_stock import best_pattern, solve
from orefall.llm.decontaminate import drop_leaks, find_leaks
from orefall.llm.exact_dedup import drop_copies, mark_copies
from orefall.llm.language_id import identify, temperature_of
from orefall.llm.near_dedup import drop_near_copies, near_classes
from orefall.llm.packing import pack
from orefall.llm.pii import find_personal_data
from orefall.llm.pii_base import refused_and_found
from orefall.llm.quality import keep_good, score_quality
from orefall.llm.sharding import shard_by_bytes
from orefall.llm.site_style_tree import extract
from orefall.llm.tokens import count_tokens
from orefall.llm.weighted_minhash import distinct_shingles, fit_idf, minima, signatures, weighted_jaccard

WORDS = "the of river stone light under carries morning seven paper house garden window silver market road".split()
BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, key string, node string, t string, `a.b` int"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


def odd_rows():
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 400, 300)]
    near = base.copy()
    near[100] = "changed"
    texts = [None, "", "  \n ", "one two", "One  two", " ".join(base), " ".join(base), " ".join(near), prose(1, 4000), "日本語 テスト 🙂", "a@b.co +1 (499) 555-6503", "x" * 3000]
    rows = [(i, t, "en", "s", 1, "clash", "k", "n", "t", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "one two", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(odd_rows()[5][1].split()[20:60])), (2, "one two"), (3, None), (4, "..."), (5, "not in any text at all here")], "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def text_of(r):
    return r["text"] or ""


def test_mark_copies(odd, none):
    got = mark_copies(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[text_of(r)].append(r["doc_id"])
    assert len(got) == odd.count()
    want = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for sha, ids in want.items():
        mine = [r for r in got if r["text_sha256"] == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in mine} == {keep} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]
    assert mark_copies(none).count() == 0


def test_drop_copies_keeps_columns(odd, none):
    got = drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted(text_of(r) for r in got.collect()) == sorted({text_of(r) for r in odd.collect()})
    assert drop_copies(none).count() == 0


def test_texts_with_one_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"]) for r in mark_copies(df).collect()) == [(1, 3), (2, 2), (3, 3)]


def test_shards(odd, none, docs):
    for df in (odd, docs):
        rows, texts = shard_by_bytes(df).collect(), collections.Counter(text_of(r) for r in df.collect())
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
        where = collections.defaultdict(set)
        for r in rows:
            where[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(v) == 1 for v in where.values())
        size = collections.Counter(len(t.encode()) + 1 for t in texts.elements())
        assert collections.Counter(r["size"] for r in rows) == size
        assert {r["text_crc32"] for r in rows} == {zlib.crc32(t.encode()) for t in texts}
    total = collections.Counter()
    for r in shard_by_bytes(docs).collect():
        total[r["shard"]] += r["size"]
    most = max(len(t.encode()) * n for t, n in collections.Counter(text_of(r) for r in docs.collect()).items())
    assert max(total.values()) - sum(total.values()) / 8 <= most
    assert shard_by_bytes(none).count() == 0


def test_token_counts_equal_the_library(odd, none, docs):
    lib = Tokenizer.from_file(BPE)
    for df in (odd, docs):
        got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, BPE).collect()}
        want = set()
        for r in df.collect():
            n = len(lib.encode(text_of(r), add_special_tokens=False).ids)
            want.add((r["doc_id"], len(text_of(r).encode()), n, n > 1024))
        assert got == want
    assert count_tokens(none, BPE).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "aaaaaaaab", "it's we'll\t x", "<|endoftext|>hello<|endoftext|> <|endoftext", " x\ny ", "a\r\nb", "1234 %%% ...", "\xa0x　y"])
def test_token_count_of_odd_texts(text):
    assert TokenCounter(BPE).count([text]).tolist() == [len(Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids)]


def test_a_full_memo_changes_nothing():
    texts = [prose(i, 200) + f" unique{i}" for i in range(30)]
    small = TokenCounter(BPE, memo=8)
    assert [small.count([t])[0] for t in texts] == TokenCounter(BPE).count(texts).tolist()


def test_packing_round_trip(odd, none, docs):
    lib = Tokenizer.from_file(WORD_BPE)
    for df in (odd, docs):
        rows = pack(df, WORD_BPE).collect()
        ids = collections.Counter()
        for r in df.collect():
            x = np.array([*lib.encode(text_of(r), add_special_tokens=False).ids, 2], dtype="<u4")
            ids[r["doc_id"], x.tobytes()] += 1
        want = collections.Counter()
        for (d, b), n in ids.items():
            for r in {(r["start"], r["length"]) for r in rows if r["doc_id"] == d and r["doc_tokens"] == len(b) // 4}:
                want[d, *r, zlib.crc32(b[4 * r[0] : 4 * (r[0] + r[1])]), len(b) // 4] += n
        assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
        seqs = collections.defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(seqs) <= -(-sum(r["length"] for r in rows) // 4096) * 1.05 + 1
    assert pack(none, WORD_BPE).count() == 0


def test_cutting_stock():
    sizes = np.array([3, 5, 7, 11])
    worth = np.array([3.1, 5.0, 7.3, 11.2])
    v, a = best_pattern(sizes, worth, 20)
    brute = max(i * 3.1 + j * 5 + k * 7.3 + m * 11.2 for i in range(7) for j in range(5) for k in range(3) for m in range(2) if 3 * i + 5 * j + 7 * k + 11 * m <= 20)
    assert abs(v - brute) < 1e-9 and (a * sizes).sum() <= 20
    demand = np.array([40, 33, 21, 9])
    plan = solve(sizes, demand, 20)
    assert (sum(p * n for p, n in plan.patterns) == demand).all() and all((p * sizes).sum() <= 20 for p, _ in plan.patterns)
    assert sum(n for _, n in plan.patterns) <= np.ceil(plan.bound) + 2


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_leaks(odd, none, benchmark):
    want = collections.Counter()
    for d in odd.collect():
        for b in benchmark.collect():
            own = shingles(b["text"])
            n = len(next(iter(own))) if own else 5
            w = re.findall(r"[^\W_]+", text_of(d).lower())
            held = len(own & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
            if own and held >= 0.8 * len(own):
                want[d["doc_id"], b["item_id"], held, len(own)] += 1
    got = collections.Counter((r["doc_id"], r["item_id"], r["n_found"], r["n_shingles"]) for r in find_leaks(odd, benchmark).collect())
    assert got == want and sum(want.values()) >= 6
    clean = drop_leaks(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count() - len({*()}) - sum(1 for d in odd.collect() if d["doc_id"] in {k[0] for k in want} and (d["doc_id"] is not None or d["text"] == "one two"))
    assert find_leaks(none, benchmark).count() == 0 and drop_leaks(odd, benchmark.where("false")).count() == odd.count()


def test_item_blocks_and_hot_passages(spark, monkeypatch):
    import orefall.llm.decontaminate as m

    monkeypatch.setattr(m, "BLOCK", 600)
    items = spark.createDataFrame([(i, prose(100 + i, 30)) for i in range(12)], "item_id long, text string")
    rows = [(i, f"start {prose(500 + i, 3000)} {prose(100 + i % 12, 30)} {prose(900 + i, 50)}") for i in range(24)]
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(i, i % 12) for i in range(24)} <= got


def brute_classes(rows, idf, least=0.8):
    texts = [text_of(r) for r in rows]
    h, tf, at = distinct_shingles(texts)
    w = tf * idf.of(h)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            words = at[i + 1] > at[i] and at[j + 1] > at[j]
            if texts[i] == texts[j] or words and weighted_jaccard(h, w, at, i, j) >= least:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def near_rows(seed, groups, each, words=120, edits=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"v{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(each):
            t = base.copy()
            for p in rng.integers(0, words, edits):
                t[p] = f"e{rng.integers(0, 10**6)}"
            rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize("whole, wide", [(64, 4096), (4, 4096), (4, 3)])
def test_near_classes(spark, odd, none, whole, wide, monkeypatch):
    import orefall.llm.near_dedup as m

    monkeypatch.setattr(m, "WHOLE", whole)
    monkeypatch.setattr(m, "CHUNK", 2 * whole)
    monkeypatch.setattr(m, "WIDE", wide)
    texts = near_rows(5, 6, 14) + [prose(i, 60) for i in range(20)]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    data, idf = rows.collect(), fit_idf(rows, "text")
    group = brute_classes(data, idf)
    least = {}
    for g, r in zip(group, data):
        least[g] = min((x for x in (least.get(g), r["doc_id"]) if x is not None), default=None)
    want = collections.Counter((r["doc_id"], least[g], group.count(g)) for g, r in zip(group, data))
    got = near_classes(rows).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    kept = drop_near_copies(rows)
    assert kept.count() == len(set(group)) and near_classes(none).count() == 0 and drop_near_copies(none).count() == 0
    assert drop_near_copies(odd).columns == odd.columns


def test_close_pairs_are_those_of_the_definition(monkeypatch):
    import orefall.llm.weighted_minhash as m

    monkeypatch.setattr(m, "COLUMNS", 50)
    texts = near_rows(9, 4, 6, words=120, edits=1) + [" ".join(["again and again"] * n) for n in (30, 34, 60)] + [prose(i, 50) for i in range(5)]
    h, tf, at = distinct_shingles(texts)
    some = np.unique(h)[::7]
    idf = m.Idf(some, np.random.default_rng(2).random(len(some)) * 0.8 + 0.2)
    heads, others = np.arange(0, len(texts), 2), np.arange(len(texts))
    want = {(i, j) for i in heads for j in others if i != j and weighted_jaccard(h, tf * idf.of(h), at, i, j) >= 0.8}
    got = {(heads[a], j) for a, j in np.argwhere(m.close_pairs(h, tf, at, idf, heads, others, 0.8)) if heads[a] != j}
    assert got == want and len(want) > 5


def test_idf_is_that_of_all_documents(spark):
    texts = [f"common phrase of five words {prose(i, 30)}" for i in range(60)] + [prose(100 + i, 40) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    idf = fit_idf(df, "text", common=0.05)
    h, _, at = distinct_shingles(texts)
    least = minima(h, at)
    sizes = collections.Counter((k, v) for row in least.tolist() for k, v in enumerate(row) if v)
    share = [1 / max(sizes[k, v] if v and sizes[k, v] >= 2 else 1 for k, v in enumerate(row)) for row in least.tolist()]
    dfs = collections.Counter()
    for i, s in enumerate(share):
        for x in h[at[i] : at[i + 1]].tolist():
            dfs[x] += s
    n = sum(share)
    want = {k: min(1.0, (1 + np.log(n / c)) / (1 + np.log(20))) for k, c in dfs.items() if c >= 0.05 * n}
    assert idf.keys.tolist() == sorted(want) and np.allclose(idf.weights, [want[k] for k in sorted(want)])


@pytest.mark.parametrize("part", [0.05, 0.34])
def test_a_hot_group_of_variants_is_one_class(spark, part):
    """Distinct texts that differ in one word from each other's base, up to a third of all: none is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(int(600 * part)):
        t = base.copy()
        t[int(rng.integers(0, 60))] = f"edit{i}"
        texts.append(" ".join(t))
    many = len(texts)
    texts += [" ".join(f"o{x}" for x in rng.integers(0, 3000, 60)) for _ in range(600 - many)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sizes = collections.Counter(r["class_id"] for r in near_classes(df).collect())
    assert sizes[0] == many and len(sizes) == 600 - many + 1


def test_idf_counts_copies_once(spark):
    base = [f"w{i}" for i in range(60)]
    near = base.copy()
    near[30] = "changed"
    other = [prose(200 + i, 40) for i in range(160)]
    texts = [" ".join(base)] * 80 + [" ".join(near)] + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    once = fit_idf(spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string"), "text")
    idf = fit_idf(df, "text")
    assert idf.keys.tolist() == once.keys.tolist() and np.allclose(idf.weights, once.weights)
    size = {r["doc_id"]: r["class_size"] for r in near_classes(df).collect()}
    assert size[0] == 81 and size[80] == 81


def test_samples_agree_as_often_as_texts_are_similar(spark):
    idf = fit_idf(spark.createDataFrame([("x",)], "text string"), "text")
    base = [f"v{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:300] + [f"z{i}" for i in range(100)]) + " " + " ".join(base[:40])]
    h, tf, at = distinct_shingles(texts)
    j = weighted_jaccard(h, tf.astype(float), at, 0, 1)
    sig = signatures(texts, idf, bands=3000, rows=1)
    assert abs((sig[0] == sig[1]).mean() - j) < 0.035


@pytest.mark.parametrize("small", [1 << 13, 0])
def test_components(spark, small, monkeypatch):
    import orefall.llm.components as m

    monkeypatch.setattr(m, "SMALL", small)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    group = {x: x for p in pairs for x in p}
    for a, b in pairs:
        ga, gb = group[a], group[b]
        if ga != gb:
            group = {k: (min(ga, gb) if v in (ga, gb) else v) for k, v in group.items()}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in group.items() if k != v}


def test_personal_data(spark, odd, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def base(t):
        out = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                double = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and double % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, kind, m.end()))
        return [(a, b, kind) for a, _, kind, b in sorted(out)]

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("a1.@+- ()9%"), 60)) for _ in range(400)] + ["4463 7244 8786 3232", "é a.b@c.de@f.gh 1.2.3.4.5 300.1.1.1", "+1 (073) 555-8658"]
    for t in texts:
        assert refused_and_found(t)[1] == base(t), t
    got = find_personal_data(odd).collect()
    assert len(got) == odd.count() and find_personal_data(none).count() == 0
    r = next(r for r in got if r["doc_id"] == 10)
    assert (r["n_email"], r["n_phone"], r["spans"]) == (1, 1, "email:0:6,phone:7:24")
    assert r["base_sha256"] == hashlib.sha256(b"email:0:6,phone:7:24").hexdigest()


def test_distant_mentions_get_the_entity_label():
    m = len(skip_chain.LABELS)
    w = skip_chain.Weights(np.zeros((skip_chain.SHAPES, m)), np.zeros((m, m)), 3.0 * np.eye(m))
    w.shape[0, 0] = 2.0
    text = "write jo.smith7@example.com today. " + "x " * 500 + "later jo.smith7 replied, room 12"
    spans = skip_chain.added(text, w)
    assert [(text[a:b], k) for a, b, k in spans] == [("jo.smith7", "email")]


@pytest.fixture(scope="module")
def field():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    return skip_chain.fit([e for t in texts for e in skip_chain.examples(t)]), texts


def test_fitted_skip_edges_find_what_the_chain_alone_misses(field):
    w, texts = field
    rng = np.random.default_rng(11)
    hits, wrong, chain, planted = 0, 0, 0, 0
    for n in range(60):
        d = "".join(map(str, rng.integers(0, 10, 10)))
        name, code = f"{''.join(rng.choice(list('abcdefgh'), 6))}.{rng.integers(10, 99)}", rng.integers(10**9, 10**10)
        body = f"call +1 ({d[:3]}) {d[3:6]}-{d[6:]} or {name}@mail.example.com. {prose(n, 400)} then {d} and {name} again, code {code}, room {n}, {code}"
        at = body.index("then ")
        want = {(body.index(d, at), "phone"), (body.index(name, at), "email")}
        got = {(a, k) for a, _, k in skip_chain.added(body, w)}
        planted += len(want)
        hits += len(got & want)
        wrong += len(got - want)
        chain += len({(a, k) for a, _, k in skip_chain.added(body, w, skips=False)} & want)
    assert hits >= 0.9 * planted and wrong <= 0.05 * hits and chain == 0


def test_mentions_in_refused_runs_are_found(field):
    w, texts = field
    text = "card 4785380592391139 4316522678525456 end +1 (663) 555-6869 4465758382889437 and 9870157079875996 9870157079875996"
    assert refused_and_found(text)[1] == []
    assert [text[a:b] for a, b, _ in skip_chain.added(text, w)] == ["4785380592391139", "4316522678525456", "+1 (663) 555-6869", "4465758382889437"]
    more = [(t, s) for t in texts for s in skip_chain.added(t, w)]
    assert more and all(re.fullmatch(r"[0-9]{16}", t[a:b]) and k == "card" for t, (a, b, k) in more)


@pytest.mark.parametrize("text", ["a1 b22 c333", "a1 777 b22222 c333 b22222", "mail ab.cd9@x.org and ab.cd9 b22222 then b22222"])
def test_loopy_messages_against_enumeration(text):
    rng = np.random.default_rng(1)
    m = len(skip_chain.LABELS)
    w = skip_chain.Weights(rng.normal(size=(skip_chain.SHAPES, m)) / 2, rng.normal(size=(m, m)) / 2, np.zeros((m, m)))
    s = rng.normal(size=(m, m)) / 2
    w.skip = (s + s.T) / 2
    tokens = skip_chain.tokens_of(text)
    chain, skip = skip_chain.edges(tokens)
    local = np.stack([w.shape[skip_chain.shape_in(text, t)].sum(axis=0) for t in tokens])
    for i, t in enumerate(tokens):
        if t.fixed:
            local[i] = np.where(np.arange(m) == t.label, 0.0, -50.0)
    joint = np.zeros([m] * len(tokens))
    for i in range(len(tokens)):
        joint = joint + local[i].reshape([m if k == i else 1 for k in range(len(tokens))])
    for pot, some in ((w.chain, chain), (w.skip, skip)):
        for a, b in some:
            joint = joint + pot.reshape([m if k in (a, b) else 1 for k in range(len(tokens))])
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    want = np.stack([joint.sum(axis=tuple(k for k in range(len(tokens)) if k != i)) for i in range(len(tokens))])
    loops = len(chain) + len(skip) >= len(tokens)  # on a graph with loops the messages are an approximation
    assert np.allclose(w.marginals(text, tokens, rounds=200), want, atol=0.05 if loops else 1e-3)


def test_language(docs, odd, none):
    got = identify(docs).join(docs.select(F.col("doc_id").alias("d"), "lang"), F.col("doc_id") == F.col("d")).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    rows = {(r["doc_id"], r["lang_pred"]) for r in identify(odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en")} <= rows and identify(odd).count() == odd.count()
    assert identify(none).count() == 0


def test_temperature_sharpens_and_softens():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=np.exp(r) / np.exp(r).sum()) for r in z])
    assert abs(temperature_of(z, y) - 1) < 0.15 and abs(temperature_of(5 * z, y) - 5) < 0.8


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.93 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and (r["score"] >= 0.5) == r["predicted"] for r in rows)
    odd_labels = spark.createDataFrame([(5, 1), (5, 0), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert score_quality(odd, odd_labels).count() == odd.count() and score_quality(none, labels).count() == 0
    assert score_quality(odd, odd_labels.where("false")).where("score = 0.5").count() == odd.count()
    kept = keep_good(odd, odd_labels)
    assert kept.columns == odd.columns


def test_ftrl_against_a_plain_form():
    """Weights of the array form equal those of one number after another."""
    from orefall.llm import language_id as L

    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6) * 3) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    got, bias = L.train(rows, y, 3, epochs=2)
    z, g2 = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if abs(z[k]) <= L.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * L.L1) / ((L.BETA + g2[k] ** 0.5) / L.ALPHA + L.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(30):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), ("bias", 1.0)]
            w = {(c, k): weight((c, k)) for c in range(3) for k, _ in x}
            score = np.array([sum(w[c, k] * v for k, v in x) for c in range(3)])
            p = np.exp(score - score.max())
            p /= p.sum()
            for c in range(3):
                for k, v in x:
                    g = (p[c] - (c == y[i])) * v
                    s = ((g2[c, k] + g * g) ** 0.5 - g2[c, k] ** 0.5) / L.ALPHA
                    z[c, k] += g - s * w[c, k]
                    g2[c, k] += g * g
    want = np.zeros_like(got)
    for c, k in list(z):
        if k != "bias":
            want[c, k] = weight((c, k))
    assert np.allclose(got, want) and np.allclose(bias, [weight((c, "bias")) for c in range(3)]) and (want != 0).any()


def test_tfidf_against_a_plain_form():
    from orefall.llm import language_id as L

    idf = np.random.default_rng(1).random(L.FEATURES) + 1
    texts = ["Ab c", "", "x1y", "ééé ab"]
    for t, (k, v) in zip(texts, L.sparse(texts, idf)):
        f, at, _ = L.grams([t])
        count = collections.Counter(f.tolist())
        total = sum(n * idf[i] for i, n in count.items())
        assert dict(zip(k.tolist(), np.round(v, 9))) == {i: round(L.SCALE * n * idf[i] / total, 9) for i, n in count.items()}


def test_first_split_against_every_split():
    """The first tree's root is the best of all splits at the bins' edges, and arrays are walked as a plain tree is."""
    from orefall.llm.boosted_trees import fit

    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    forest = fit(x, y, trees=3, depth=2)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (mask, ~mask))

    best = max(((gain(x[:, j] <= t), j, t) for j in range(3) for t in np.unique(x[:, j])[:-1]), key=lambda b: b[0])
    assert forest.feature[0, 0] == best[1] == 1
    assert abs(gain(x[:, 1] <= forest.threshold[0, 0]) - best[0]) < 1e-9
    for row, got in zip(x, forest.scores(x)):
        z = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < 3:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            z += v[node - 3]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_levels_choose_bounded_samples(spark):
    from orefall.llm.common import highest_level, level

    df = spark.range(20000).select(F.xxhash64("id").alias("h"))
    counts = [tuple(r) for r in df.groupBy(level(F.col("h"))).count().collect()]
    assert all(0 <= k <= 1008 for k, _ in counts)
    for most in (10, 500, 3000):
        top = highest_level(counts, most)
        assert most * 0.4 <= df.where(level(F.col("h")) <= top).count() <= most
    assert highest_level([], 5) == -1 and highest_level([(7, 100)], 5) == 7


def page(i, body, host="site.example"):
    return (i, f"https://{host}/p{i}", body)


def test_html(spark, none):
    strange = "<html><head><title>T</title></head><body><div class='box1'>Same words on all pages</div><div>Unique %d text &amp; more</div></body></html>"
    full = "<body><header>H</header><nav><a>x</a></nav><article><h1>Big  &eacute;</h1><p>One <b>two<br><p>three<script>a</p></script><!-- c --><div class='comments'><p>hi</p></div><aside>s</aside></article><footer>f</footer>"
    rows = [page(i, strange % i) for i in range(12)] + [page(100, full, "other.example"), (101, None, None), (102, "no url", "<p>a\n\n b</p>c < d"), (103, "http://[bad", ""), page(100, full, "other.example"), page(104, "<article>" * 300 + "deep", "deep.example")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("low", F.lit(2))
    got = extract(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [text[i] for i in range(12)] == [f"Unique {i} text & more" for i in range(12)]
    assert text[100] == "Big é\nOne two\nthree" and text[101] == "" and text[102] == "a b\nc < d" and text[103] == "" and text[104] == "deep"
    assert extract(df.where("false")).count() == 0


def test_repeated_items_are_searched_once(spark, monkeypatch):
    """Repeats of a benchmark row fill no block, and have rows of their own in the result."""
    from orefall.llm import decontaminate

    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "something else")], "doc_id long, text string")
    items = spark.createDataFrame([(i, words) for i in range(50)] + [(60, words + " tail"), (61, words.upper()), (None, words)], "item_id long, text string")
    seen = []
    real = decontaminate._hits
    monkeypatch.setattr(decontaminate, "_hits", lambda d, part, *a: seen.append(part.count()) or real(d, part, *a))
    got = decontaminate.find_leaks(docs, items).collect()
    assert seen == [2] and sorted((r["item_id"] is None, r["item_id"] or 0) for r in got) == sorted([(False, i) for i in range(50)] + [(False, 60), (False, 61), (True, 0)])
    assert {r["doc_id"] for r in got} == {1}


def test_language_sample_sends_features_not_texts(spark, monkeypatch):
    from orefall.llm import language_id

    long = "ein langer deutscher text mit vielen worten " * 4000
    rows = [(i, long if i % 2 else "an english text of some other words " * 3, "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    real = language_id.train
    monkeypatch.setattr(language_id, "train", lambda x, y, n: sizes.extend(len(k) for k, _ in x) or real(x, y, n))
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    assert got == {i: lang for i, _, lang in rows} and max(sizes) < 500
