"""One keyword question against the stored index: a few small jobs, whose bounded results decide what the next one reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.config import User
from orefall.functions.text import content_hash, latin_tokens
from orefall.operators.access import visible
from orefall.operators.lexical import K1, B
from orefall.plans.index import Index

#: Terms that a question may have here, and block sums that come to the driver; what has more goes through the batch plan.
TERMS, SUMS = 256, 4096
#: Buckets that are scored first.
FIRST_BLOCKS = 256


class Question:
    """Answers as Retriever.over(index, user).plan gives them for a keyword question without filters, or None where it has to be asked there."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self._totals: dict[tuple, tuple[float, float]] = {}

    def _total(self, user: User) -> tuple[float, float]:
        """Number and mean length of what the user sees, once for each version."""
        key = (self.index.version, user.user_id, user.is_admin)
        if key not in self._totals:
            r = visible(self.index.part("totals"), user).agg(F.sum("nodes").alias("n"), F.sum("terms").alias("w")).first()
            self._totals = {k: v for k, v in self._totals.items() if k[0] == key[0]} | {key: (float(r["n"] or 0), (r["w"] or 0) / r["n"] if r["n"] else 0.0)}
        return self._totals[key]

    def _gain(self, freq: Column, length: Column, mean: float) -> Column:
        return freq * (K1 + 1) / (freq + K1 * (1 - B + B * length / F.lit(mean or 1.0)))

    def best(self, user: User, query: str, k: int) -> list[tuple] | None:
        """(node_id, score) of the k best, best first; None for too many terms or buckets."""
        index = self.index
        terms = index.spark.range(1).select(F.array_distinct(latin_tokens(F.lit(query))).alias("w")).first()["w"]
        if len(terms) > TERMS:
            return None
        if not terms:
            return []
        n, mean = self._total(user)
        blocks = visible(index.postings_of(terms, "blocks"), user)
        df = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        dead = index.dead()
        if dead is not None:
            gone = visible(index.raw("postings").where(F.col("term").isin(terms)), user).join(dead.select("segment", "node_id"), ["segment", "node_id"], "left_semi")
            for r in gone.groupBy("term").count().collect():
                df[r["term"]] -= r["count"]
        idf = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items() if x > 0}
        if not idf:
            return []
        weight = F.create_map(*[F.lit(x) for t, w in sorted(idf.items()) for x in (t, w)])[F.col("term")]
        some = blocks.where(F.col("term").isin(sorted(idf)))
        sums = some.groupBy("segment", "bucket").agg(F.sum(weight * self._gain(F.col("most"), F.col("shortest"), mean)).alias("bound"))
        ahead = sums.orderBy(F.desc("bound"), "segment", "bucket").limit(SUMS + 1).collect()
        if len(ahead) > SUMS:
            return None
        first = self._scored(user, idf, weight, mean, ahead[:FIRST_BLOCKS], k)
        kth = first[k - 1][1] if len(first) >= k else -math.inf
        rest = [r for r in ahead[FIRST_BLOCKS:] if r["bound"] >= kth - 1e-6]
        more = self._scored(user, idf, weight, mean, rest, k) if rest else []
        return sorted(first + more, key=lambda r: (-round(r[1], 9), r[0]))[:k]

    def _scored(self, user: User, idf: dict[str, float], weight: Column, mean: float, buckets: list, k: int) -> list[tuple]:
        rows = visible(self.index.postings_of(sorted(idf)), user).where(F.col("bucket").isin([r["bucket"] for r in buckets]) & F.col("segment").isin(sorted({r["segment"] for r in buckets})))
        by_node = rows.groupBy("node_id").agg(F.sum(weight * self._gain(F.col("freq"), F.col("node_terms"), mean)).alias("score")).where("score > 0")
        return [tuple(r) for r in by_node.orderBy(F.desc(F.round("score", 9)), "node_id").limit(k).collect()]

    def answer(self, user: User, query: str, top_k: int, fetch: int, nodes: DataFrame) -> list[dict] | None:
        """Rows as the batch plan gives them: of nodes with one content the best, in order."""
        found = self.best(user, query, fetch)
        if not found:
            return found
        wanted = nodes.where(F.col("node_id").isin([f[0] for f in found])).select("node_id", "filename", "content", content_hash(F.col("content")).alias("hash"))
        held = {r["node_id"]: r for r in wanted.collect()}  # the candidates of one question
        out, seen = [], set()
        for node, score in found:
            r = held[node]
            if r["hash"] is None or r["hash"] not in seen:
                seen.add(r["hash"])
                out.append({"query_id": 1, "node_id": node, "score": round(score, 4), "rank": len(out) + 1, "filename": r["filename"], "content": r["content"]})
        return out[:top_k]

