"""What a judge may see, whether it covered every claim, who may be called independent, blind forms, and agreement with its spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.errors import CodedError

#: Fixed values.
VERDICTS = ("supported", "partially_supported", "unsupported", "not_applicable")
SCHEMA_VERSION = "answer-quality-v3"


def payload(cases: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, payload): JSON with all that a judge may see of a case, and nothing of arms, scores or owners.

    cases: case_id, question, expected, answer. evidence: case_id, evidence_id, source_name, location, snippet, place. claims:
    case_id, claim_index, text, evidence_ids. Lists stand in their order; a case without any has empty ones.
    """

    def listed(rows: DataFrame, order: str, *fields: str) -> DataFrame:
        one = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v"))
        return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_v"]).alias("items"))

    shown = listed(evidence, "place", "evidence_id", "source_name", "location", "snippet").withColumnRenamed("items", "evidence")
    said = listed(claims, "claim_index", "claim_index", "text", "evidence_ids").withColumnRenamed("items", "submitted_claims")
    rows = cases.join(shown, "case_id", "left").join(said, "case_id", "left")
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "question", F.struct(F.col("expected").alias("expected_answer_terms")).alias("reference"), "answer",
        F.coalesce("evidence", F.array().cast(shown.schema["evidence"].dataType)).alias("evidence"),
        F.coalesce("submitted_claims", F.array().cast(said.schema["submitted_claims"].dataType)).alias("submitted_claims"),
    )
    return rows.select("case_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def coverage(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """(case_id, problem, claim_index): claims without a judgment, with several, of an unknown index or with an unknown verdict.

    claims: case_id, claim_index. judged: case_id, claim_index, verdict. No row means that every claim is judged exactly once.
    """
    n = judged.groupBy("case_id", "claim_index").agg(F.count("*").alias("n"), F.count_if(~F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull()).alias("bad"))
    both = claims.select("case_id", "claim_index").distinct().withColumn("asked", F.lit(True)).join(n, ["case_id", "claim_index"], "full_outer")
    problem = F.when(F.col("asked").isNull(), "unknown_claim").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("bad") > 0, "unknown_verdict")
    return both.select("case_id", problem.alias("problem"), "claim_index").where("problem is not null")


def independent(answer_model: Column, judge_model: Column) -> Column:
    """Whether both models are named and their names differ. Aliases and relatives of a model have to be told apart by people."""
    a, b = (F.lower(F.trim(F.coalesce(m, F.lit("")))) for m in (answer_model, judge_model))
    return (a != "") & (b != "") & (a != b)


def blind(answers: DataFrame, seed: str, stratum: str = "stratum", item: str = "item_id", arm: str = "arm") -> DataFrame:
    """(turn, form_id, item columns, empty verdict): forms in an order in which strata alternate and no arm can be guessed.

    Order and ids follow from the seed alone; the arm and all judgments are left out, and `key` maps form ids back. Strata are numbered within
    themselves by digest, and forms sorted by that place, so that any beginning of the list holds all strata alike.
    """
    code = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(item).cast("string"), F.col(arm).cast("string")), 256)
    own = answers.withColumn("form_id", code)
    shown = [c for c in answers.columns if c not in (arm, "score", "verdict", "judgment")]
    place = F.row_number().over(W.partitionBy(stratum).orderBy("form_id"))
    return own.withColumn("turn", place).select("turn", "form_id", *shown, F.lit(None).cast("string").alias("verdict"))


def key_of(answers: DataFrame, seed: str, item: str = "item_id", arm: str = "arm") -> DataFrame:
    """(form_id, item, arm): for whoever opens the forms again."""
    return answers.select(F.sha2(F.concat_ws("\0", F.lit(seed), F.col(item).cast("string"), F.col(arm).cast("string")), 256).alias("form_id"), item, arm)


def contingency(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, a, b, n) of the pairs that both rated; all that agreement needs, whatever their number."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, exact_agreement, cohen_kappa): kappa is null where chance alone agrees always."""
    total = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = table.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("l"))
    right = table.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("r"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("l") * F.col("r")).cast("double").alias("lr"))
    o = F.col("same") / F.col("n")
    e = F.coalesce("lr", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance, by, "left").select(*by, "n", F.round(o, 6).alias("exact_agreement"), F.when(e < 1, F.round((o - e) / (1 - e), 6)).alias("cohen_kappa"))


def interval(table: DataFrame, by: list[str], seed: int = 7, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """(by, kappa_low, kappa_high): percentile interval of kappa by resampling items.

    Items drawn with replacement are, of each pair of verdicts, a multinomial number: the small table of counts is
    resampled, not the items, and the result is that of a bootstrap over all of them.
    """
    if not 0 < level < 1:
        raise CodedError("invalid_config", "the level lies between 0 and 1")
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf):
        labels = sorted({*pdf["a"], *pdf["b"]})
        at = {v: i for i, v in enumerate(labels)}
        m = np.zeros((len(labels), len(labels)))
        np.add.at(m, ([at[v] for v in pdf["a"]], [at[v] for v in pdf["b"]]), pdf["n"])
        n = m.sum()
        draws = np.random.default_rng(seed).multinomial(int(n), (m / n).ravel(), size=rounds).reshape(rounds, *m.shape) / n
        o = np.trace(draws, axis1=1, axis2=2)
        e = (draws.sum(axis=2) * draws.sum(axis=1)).sum(axis=1)
        k = ((o - e) / (1 - e))[e < 1]
        low, high = np.quantile(k, [(1 - level) / 2, (1 + level) / 2]) if len(k) else (np.nan, np.nan)
        return pdf[by].head(1).assign(kappa_low=low, kappa_high=high)

    return table.groupBy(*by).applyInPandas(run, f"{kinds}, kappa_low double, kappa_high double")


def closeness(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, mae, within_0_2) of two scores between 0 and 1 that both gave."""
    d = F.abs(F.col(a) - F.col(b))
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mae"), F.round(F.avg((d <= 0.2).cast("int")), 6).alias("within_0_2"))
