"""The pipeline against its stages done by hand, and the registered queries of the corpus operators."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from orefall.llm.common import STEP_CHARS
from orefall.llm.decontaminate import find_leaks
from orefall.llm.exact_dedup import mark_copies
from orefall.llm.language_id import identify
from orefall.llm.near_dedup import near_classes
from orefall.llm.packing import pack
from orefall.llm.pii import find_personal_data
from orefall.llm.quality import keep_good, score_quality, statistics
from orefall.llm.queries import QUERIES
from orefall.llm.sharding import shard_by_bytes
from orefall.llm.tokens import count_tokens
from orefall.llm.weighted_minhash import fit_idf
from tests.llm.test_operators import BPE, WORD_BPE, brute_classes, shingles, text_of

SMALL = "/root/testdata/sf0.001"


def by_hand(spark, docs, labels, items):
    """(doc_id, text) that the first four stages leave."""
    good = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 1").collect()}
    last = {}
    for r in sorted((r for r in docs.collect() if r["doc_id"] in good), key=lambda r: r["doc_id"]):
        last[text_of(r)] = r
    rows = sorted(last.values(), key=lambda r: r["doc_id"])
    group = brute_classes(rows, fit_idf(spark.createDataFrame([(text_of(r),) for r in rows], "text string"), "text"))
    first = {}
    for g, r in zip(group, rows):
        first.setdefault(g, r)
    tests = [s for s in (shingles(r["text"]) for r in items.collect()) if s]

    def leaks(r):
        return any(len(s & {x for x in shingles(text_of(r), len(next(iter(s))))}) >= 0.8 * len(s) for s in tests)

    return {r["doc_id"]: text_of(r) for r in first.values() if not leaks(r)}


def test_pipeline_against_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    want = by_hand(spark, docs, labels, items)
    assert 0 < len(want) < docs.count()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for d, t in want.items()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for d, some in pieces.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[d]) // 4)
            assert r["ids_crc32"] == zlib.crc32(ids[d][4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids[d]) // 4
    room = collections.Counter()
    for r in rows:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_cover_their_tables(spark, name):
    got = QUERIES[name](spark, SMALL)
    ids = [r[0] for r in got.select(got.columns[0]).collect()]
    table = "pages" if name.startswith("op3") else "documents"
    every = [r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select("page_id" if table == "pages" else "doc_id").collect()]
    if name.startswith("op1_"):
        assert set(ids) < set(every) and ids
    elif name.startswith("op10_"):
        assert set(ids) == set(every)
    else:
        assert sorted(ids) == sorted(every)


def test_texts_longer_than_a_step(spark):
    """One text of three steps and some short ones: all operators read it whole, to what stands at its end."""
    rng = np.random.default_rng(6)
    long = " ".join(rng.choice([f"word{i}" for i in range(5000)], 3 * STEP_CHARS // 8).tolist())
    tail = "the closing passage of this test has nine words and mail end.user7@example.org"
    assert len(long) > 2 * STEP_CHARS
    rows = [(0, f"{long} {tail}", "en"), (1, f"{long} {tail}", "en"), (2, f"{long} other {tail}", "en"), (3, "short one", "de"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    items = spark.createDataFrame([(1, tail)], "item_id long, text string")
    assert {r["doc_id"] for r in find_leaks(df, items).collect()} == {0, 1, 2}
    assert [r["n_email"] for r in find_personal_data(df).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0]
    assert [r["class_id"] for r in near_classes(df).orderBy("doc_id").collect()] == [0, 0, 0, 3, 4]
    assert [r["keep_id"] for r in mark_copies(df).orderBy("doc_id").collect()] == [1, 1, 2, 3, 4]
    lib = Tokenizer.from_file(BPE)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert [r["n_tokens"] for r in count_tokens(df, BPE).orderBy("doc_id").collect()] == want
    ids = Tokenizer.from_file(WORD_BPE).encode(rows[2][1], add_special_tokens=False).ids
    mine = [r for r in pack(df, WORD_BPE).collect() if r["doc_id"] == 2]
    assert sum(r["length"] for r in mine) == len(ids) + 1 == mine[0]["doc_tokens"]
    assert sorted(r["size"] for r in shard_by_bytes(df).collect()) == sorted(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert identify(df).count() == 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert score_quality(df, labels).count() == 5 and keep_good(df, labels).columns == df.columns
    assert np.allclose(statistics([rows[0][1], "short one"])[0], statistics([rows[0][1]])[0])
