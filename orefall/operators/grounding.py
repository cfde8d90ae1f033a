"""Deterministic checks of claims against evidence, and the assembly of evidence for an answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.functions import text as X


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with valid_ids, invalid_ids, missing_numbers, missing_identifiers, grounded (null if it names neither).

    claims: run_id, claim_id, text, evidence_ids. evidence: run_id, evidence_id, text. Numbers and identifiers are compared as
    whole tokens with those of the cited evidence.
    """
    facts = evidence.select("run_id", "evidence_id", X.numbers(F.col("text")).alias("en"), X.identifiers(F.col("text")).alias("ei"))
    asked = claims.select("run_id", "claim_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    cited = asked.join(facts, ["run_id", "evidence_id"]).groupBy("run_id", "claim_id").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("valid_ids"), F.array_distinct(F.flatten(F.collect_list("en"))).alias("en"), F.array_distinct(F.flatten(F.collect_list("ei"))).alias("ei")
    )
    none = F.expr("cast(array() as array<string>)")
    rows = claims.join(cited, ["run_id", "claim_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("valid_ids", "en", "ei")})
    n, i = X.numbers(F.col("text")), X.identifiers(F.col("text"))
    rows = rows.withColumns({"missing_numbers": F.array_except(n, "en"), "missing_identifiers": F.array_except(i, "ei"), "_atoms": F.size(n) + F.size(i)})
    grounded = F.when(F.col("_atoms") > 0, (F.size("missing_numbers") + F.size("missing_identifiers") == 0) & (F.size("valid_ids") > 0))
    return rows.select("run_id", "claim_id", "valid_ids", F.array_sort(F.array_except("evidence_ids", "valid_ids")).alias("invalid_ids"), "missing_numbers", "missing_identifiers", grounded.alias("grounded"))


def citation_metrics(checked: DataFrame) -> DataFrame:
    """Coverage, validity and grounded share of each run; null where nothing was counted."""
    v, i = F.sum(F.size("valid_ids")), F.sum(F.size("invalid_ids"))
    cited = F.count_if(F.size("valid_ids") > 0)
    return checked.groupBy("run_id").agg(
        F.count("*").alias("claims"), (cited / F.count("*")).alias("coverage"), F.when(v + i > 0, v / (v + i)).alias("validity"),
        F.when(F.count("grounded") > 0, F.count_if("grounded") / F.count("grounded")).alias("grounded_rate"),
    )


def support(metrics: DataFrame, enabled: bool = True) -> DataFrame:
    """blocked, deterministic_pass, unverified or refusal_or_no_claims for each run."""
    bad = (F.col("validity") < 1) | (F.col("grounded_rate") < 1)
    state = F.when(F.col("claims") == 0, "refusal_or_no_claims").when(bad, "blocked" if enabled else "unverified").when(F.col("grounded_rate").isNull(), "unverified").otherwise("deterministic_pass")
    return metrics.withColumn("support", state)


def assemble(candidates: DataFrame, budget: int = 4000, limit: int = 12, per_call: int | None = None) -> DataFrame:
    """candidates (run_id, call, rank, document, hash, tokens) with selected and reason, in the order they were weighed.

    In each call the first candidate comes first, then those of documents not seen yet, then the rest. A candidate goes for a
    repeated hash, the call's limit, the run's limit, or the run's token budget, in this order; a smaller one after it may still
    fit. The choice depends on all before it, so that a run, whose candidates its calls bound, is worked on as a whole.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, docs, taken, used, out, place = set(), set(), 0, 0, [], 0
        for _, group in pdf.sort_values(["call", "rank"]).groupby("call", sort=True):
            rows = list(group.itertuples(index=False))
            known, fresh, again = docs | {rows[0].document}, [], []
            for r in rows[1:]:
                (again if r.document in known else fresh).append(r)
                known = known | {r.document}
            here = 0
            for r in [rows[0], *fresh, *again]:
                reason = (
                    "duplicate" if r.hash in seen else "per_call_limit" if per_call is not None and here >= per_call else "evidence_limit" if taken >= limit else "token_budget" if used + r.tokens > budget else "selected"
                )
                if reason == "selected":
                    seen.add(r.hash)
                    docs.add(r.document)
                    taken, used, here = taken + 1, used + r.tokens, here + 1
                place += 1
                out.append((r.run_id, r.call, r.rank, place, reason == "selected", reason))
        return pd.DataFrame(out, columns=["run_id", "call", "rank", "place", "selected", "reason"])

    kind = candidates.schema["run_id"].dataType.simpleString()
    return candidates.groupBy("run_id").applyInPandas(choose, f"run_id {kind}, call long, rank long, place long, selected boolean, reason string")


#: Marks that are taken out before values are looked for, the values themselves, and numbers that prove nothing (fixed values).
CITATION, MARKDOWN = r"\[\d+\]", r"[*`_#>|]"
GROUPED, NUMBER = r"\d{1,3}(?:,\d{3})+", r"\d+(?:\.\d+)?"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+|[A-Z]{2,}"
TRIVIAL = ("0", "1", "2", "3", "4", "5")


def unmarked(text: Column) -> Column:
    """Text without citation marks and Markdown signs."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, " "), MARKDOWN, "")


def _every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numbers_said(text: Column) -> Column:
    """Distinct numbers of a text without thousands separators, grouped ones first; 0 to 5 are left out."""
    c = unmarked(text)
    grouped = F.transform(_every(c, GROUPED), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.filter(F.array_distinct(F.concat(grouped, _every(F.regexp_replace(c, GROUPED, " "), NUMBER))), lambda x: ~x.isin(*TRIVIAL))


def identifiers_said(text: Column) -> Column:
    """Identifiers and abbreviations of a text, of those that differ in case alone the first."""
    found = _every(unmarked(text), IDENTIFIER)
    upper = F.transform(found, F.upper)
    return F.filter(found, lambda x, i: F.array_position(upper, F.upper(x)) == i + 1)


def traced(answer: Column, evidence: Column) -> tuple[Column, Column, Column, Column]:
    """Numbers and identifiers of an answer, and those of each that no evidence (one text of all) holds. Sums of evidence count as missing."""
    hay = X.upper(F.replace(unmarked(evidence), F.lit(","), F.lit("")))
    numbers, names = numbers_said(answer), identifiers_said(answer)
    return numbers, names, F.filter(numbers, lambda x: ~F.contains(hay, x)), F.filter(names, lambda x: ~F.contains(hay, X.upper(x)))
