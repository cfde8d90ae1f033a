"""Near duplicates by improved consistent weighted sampling, banded, verified by weighted Jaccard similarity.

Equal texts are one node. Nodes that agree in a band of their signatures meet in a bucket. Small buckets, once for each
distinct set of members, are resolved whole. In larger buckets every member is compared with the most central one, in chunks, so
that no task gets the bucket. Members that these links leave outside the bucket's main component are open: they are compared with
all members, in blocks. Where very many are open, the bucket is first split by the bands of a second, independent family of
signatures, and so again with a third, which parts dissimilar members and keeps similar ones together, so that the work isn't the
square of such a bucket. Links go through distributed connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import NEAR, STEP_CHARS, discard, release, rows_again, stash, step_texts, whole_row
from orefall.llm.components import components
from orefall.llm.weighted_minhash import BANDS, Idf, close_pairs, distinct_shingles_stepwise, fit_idf, signatures

#: Members that a bucket may have to be resolved whole; members and open members in a group; open members from which a bucket is
#: split; families of signatures.
WHOLE, CHUNK, BLOCK, WIDE, FAMILIES = 64, 512, 256, 4096, 3


def _node(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _signed(rows: DataFrame, idf: Idf, family: int = 0) -> DataFrame:
    """rows (key columns, t) with t replaced by bands, the text's signature of a family."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")

    def run(batches):
        for b in batches:
            sig = np.concatenate([signatures(texts, idf, family=family) for texts in step_texts(b.column(b.num_columns - 1))] or [np.zeros((0, BANDS), dtype=np.int64)])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], bands], [*b.schema.names[:-1], "bands"])

    return rows.mapInArrow(run, f"{kinds}, bands array<bigint>")


def _resolver(idf: Idf, least: float):
    """Links between the components of one group of at most a few hundred rows (gid, node, t, side, comp).

    Without rows of side 1 all members are compared, else those of side 1 with the others. Pairs that are linked already, by comp
    or by this group's links, give no link.
    """

    def run(t: pa.Table) -> pa.Table:
        nodes, texts, side, comp = (t.column(c).to_pylist() for c in ("node", "t", "side", "comp"))
        h, tf, at = distinct_shingles_stepwise(texts)
        codes = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        group = np.array([codes[c] for c in comp])
        order = sorted(range(len(nodes)), key=lambda i: (nodes[i], side[i]))
        heads = np.array([i for i in order if side[i]] or order)
        others = np.array([i for i in order if not side[i]])
        near = close_pairs(h, tf, at, idf, heads, others, least)
        left, right = [], []
        for row, i in zip(near, heads):
            for j in others[row]:
                if group[j] != group[i]:
                    left.append(comp[i])
                    right.append(comp[j])
                    group[group == group[j]] = group[i]
        if sum(map(len, texts)) > STEP_CHARS:
            release()
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string())})

    return run


def _chunk(node: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(node), n)


def _first_groups(met: DataFrame) -> DataFrame:
    """Groups (gid, node, side) of the first round. met: (key, node, n), n members of the bucket, two or more."""
    small = met.where(F.col("n") <= WHOLE).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("set"))  # at most WHOLE of them
    small = small.groupBy(F.md5(F.array_join("set", "").cast("binary")).alias("gid")).agg(F.first("set").alias("set"))
    whole = small.select("gid", F.explode("set").alias("node"), F.lit(0).alias("side"))
    large = met.where(F.col("n") > WHOLE)
    # The most central member, which meets most others over all buckets: the one the others were made from, if there is one.
    central = large.groupBy("node").agg(F.sum("n").alias("c")).withColumnRenamed("node", "c_node")
    central = large.join(central, F.col("node") == F.col("c_node"))
    pivots = central.groupBy(F.col("key").alias("k")).agg(F.max_by("node", F.struct("c", F.xxhash64("node"))).alias("pivot"))
    pairs = large.join(pivots, F.col("key") == F.col("k")).where("node <> pivot").groupBy("pivot", "node").agg(F.max("n").alias("n"))
    pairs = pairs.withColumn("gid", F.concat_ws("/", "pivot", _chunk("node", F.ceil(F.col("n") / CHUNK))))
    heads = pairs.groupBy("gid").agg(F.first("pivot").alias("node")).select("gid", "node", F.lit(1).alias("side"))
    return whole.union(pairs.select("gid", "node", F.lit(0).alias("side"))).union(heads)


def _met(members: DataFrame, *useful: Column) -> DataFrame:
    """members (key, node, ...) of the buckets with two members or more, of which `useful` holds, as (key, node, n)."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"), *useful).where("n > 1")
    counts = counts.where("useful") if useful else counts
    # Hot buckets are on the left side of this join, where Spark splits large partitions.
    return members.join(counts.select(F.col("key").alias("k"), "n"), F.col("key") == F.col("k")).select("key", "node", "n")


def _with_comp(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with comp, the component that a node is in so far."""
    known = roots.select(F.col("node").alias("r_node"), "root")
    return rows.join(known, F.col("node") == F.col("r_node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("r_node", "root")


def _opened(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, comp, main, chunks, blocks, opens) of the large buckets with open members: those outside the component that has most
    members of the bucket, which is main."""
    large = _with_comp(met.where(F.col("n") > WHOLE), roots)
    main = large.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    main = main.where(F.col("top.c") < F.col("all")).select(F.col("key").alias("k"), F.col("top.comp").alias("main"), F.ceil(F.col("all") / CHUNK).alias("chunks"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).alias("blocks"), (F.col("all") - F.col("top.c")).alias("opens"))
    return large.join(main, F.col("key") == F.col("k")).select("key", "node", "comp", "main", "chunks", "blocks", "opens")


def _split(opened: DataFrame, texts: DataFrame, idf: Idf, family: int) -> DataFrame:
    """The buckets of opened, split by the bands of a family: (key, node, n) where members of several components meet."""
    some = opened.select(F.col("node").alias("_n")).distinct()
    signed = _signed(texts.join(some, F.col("node") == F.col("_n"), "left_semi").select("node", "t"), idf, family)
    bands = signed.select(F.col("node").alias("_n"), "bands")
    members = opened.select("key", "node", "comp").join(bands, F.col("node") == F.col("_n")).select("key", "node", "comp", F.posexplode("bands").alias("band", "value"))
    members = stash(members.select(F.xxhash64("key", "band", "value").alias("key"), "node", "comp"), "split")
    return _met(members, (F.min("comp") != F.max("comp")).alias("useful"))


def _blocks(opened: DataFrame) -> DataFrame:
    """Groups (gid, node, side) that compare each open member of a bucket with all its members, in blocks."""
    every = F.sequence(F.lit(0).cast("long"), F.col("x") - 1)
    heads = opened.where("comp <> main").withColumn("x", F.col("chunks")).select("*", F.explode(every).alias("chunk"), _chunk("node", F.col("blocks")).alias("block"), F.lit(1).alias("side"))
    members = opened.withColumn("x", F.col("blocks")).select("*", _chunk("node", F.col("chunks")).alias("chunk"), F.explode(every).alias("block"), F.lit(0).alias("side"))
    both = heads.select("key", "chunk", "block", "node", "side").union(members.select("key", "chunk", "block", "node", "side"))
    return both.select(F.concat_ws("/", "key", "chunk", "block").alias("gid"), "node", "side")


def near_roots(df: DataFrame, signed: DataFrame, idf: Idf, text: str, least: float) -> DataFrame:
    """(node, root) for each node that isn't the least of its component of verified links."""
    nodes = signed.where(F.exists("bands", lambda x: x != 0)).groupBy("node").agg(F.first("bands").alias("bands"))
    members = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node")
    met = stash(_met(members), "buckets")
    needed = met.select("node").distinct()
    texts = df.select(_node(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(needed, "node", "left_semi")
    texts = stash(texts.groupBy("node").agg(F.first("t").alias("t")), "texts")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(groups: DataFrame) -> DataFrame:
        rows = groups.join(texts, "node").select("gid", "node", "t", "side", "comp").repartition(parts, "gid")
        return stash(rows.groupBy("gid").applyInArrow(_resolver(idf, least), "a string, b string"), "links")

    found = links(_first_groups(met).withColumn("comp", F.col("node")))
    roots = components(found)
    discard(found)
    for family in range(1, FAMILIES + 1):
        opened = stash(_opened(met, roots), "open")
        discard(met)
        most = opened.agg(F.max("opens")).first()[0]
        if most is None:
            break
        more = most > WIDE and family < FAMILIES
        groups = _blocks(opened.where(F.col("opens") <= WIDE) if more else opened)
        if more:
            met = stash(_split(opened.where(F.col("opens") > WIDE), texts, idf, family), "buckets")
            groups = groups.unionByName(_first_groups(met))
        found = links(_with_comp(groups, roots))
        before, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.distinct()))
        discard(opened, before, found)
        if not more:
            break
    discard(texts)
    return roots


def near_classes(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = NEAR) -> DataFrame:
    """One row for each row of df: doc_id, class_id, class_size, kept, text_md5.

    Texts are in one class if a chain of weighted Jaccard similarities of `least` or more connects them. class_id is the least
    key of the class (null where none has a key) and its row is the one kept; rows that repeat key and text are one document.
    Null text counts as empty; texts without words are in a class only with their exact copies. An empty table gives no rows.
    """
    idf = fit_idf(df, text)
    texts = df.select(F.col(key).alias("doc_id"), _node(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    signed = stash(_signed(texts, idf), "signed")
    roots = near_roots(df, signed, idf, text, least).select(F.col("node").alias("n"), "root")
    rows = signed.select("doc_id", "node").join(roots, F.col("node") == F.col("n"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    rows = stash(rows, "classes")
    discard(signed)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    classes = rows.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(best).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node"))
    return rows.join(classes, F.col("root") == F.col("r")).select("doc_id", "class_id", "class_size", kept.alias("kept"), F.col("node").alias("text_md5"))


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = NEAR) -> DataFrame:
    """One row of each class of df, the one that near_classes keeps, with all its columns, whatever their names.

    Of rows that repeat key and text one stays, whichever; null text counts as empty, and rows without words stay once for each
    distinct text; null keys come last in their class. Whole texts are compared, very long ones too; an empty table gives none.
    """
    kept = near_classes(df, text, key, least).where("kept").select(F.col("text_md5").alias("_k"), F.col("doc_id").alias("_d")).distinct()
    rows = df.select(whole_row(df), _node(F.col(text)).alias("_md5"), F.col(key).alias("_key"))
    one = rows.join(kept, (F.col("_md5") == F.col("_k")) & F.col("_key").eqNullSafe(F.col("_d")), "left_semi")
    return rows_again(one.dropDuplicates(["_md5", "_key"]), df.columns)
