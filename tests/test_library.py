"""Catalogue, provenance, judging, the fold, workbooks, and registered queries that SQL cannot express."""

import json

import pytest
from pyspark.sql import functions as F

from orefall.errors import CodedError
from orefall.operators import catalogue, judging, lexical, provenance
from orefall.plans import library
from orefall.sources import uploads
from orefall.sources.workbooks import Workbooks
from tests.test_sources_and_sql import XLSX_PARTS, S, package


def test_catalogue_links_values(spark):
    orders = spark.createDataFrame([(1, "Rejected", "long " * 20), (2, "In review", "b"), (3, None, "c")], "n int, state string, note string")
    people = spark.createDataFrame([(f"name {i}", "north" if i % 2 else "South Coast") for i in range(30)], "who string, region string")
    tables = {"orders": orders, "people": people}
    held = {(r["table"], r["column"], r["value"]) for r in catalogue.values(tables).collect()}
    assert held == {("orders", "state", "Rejected"), ("orders", "state", "In review"), ("people", "region", "north"), ("people", "region", "South Coast")}
    rows = {(r["table"], r["column"]): (r["position"], r["type"], r["choices"]) for r in catalogue.describe(tables).collect()}
    assert rows[("orders", "state")] == (1, "string", ["In review", "Rejected"]) and rows[("orders", "n")] == (0, "int", None) and rows[("people", "who")][2] is None
    q = spark.createDataFrame([(1, "which were REJECTED in the south?"), (2, "the south coast, in review"), (3, None), (4, "review of north-south")], "query_id long, text string")
    got = {(r["query_id"], r["value"]) for r in catalogue.link(q, catalogue.index(catalogue.values(tables))).collect()}
    assert got == {(1, "Rejected"), (2, "South Coast"), (2, "In review"), (4, "north")}
    with pytest.raises(ValueError):
        catalogue.values({"n": spark.range(1)})


def test_digest_follows_content_alone(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}", i / 3) for i in range(200)], "a long, b string, c double")
    one = provenance.digest(df).first()
    assert one == provenance.digest(df.repartition(7).orderBy(F.rand(1))).first() == provenance.digest(df.select("c", "a", "b")).first() and one["rows"] == 200
    for other in (df.where("a <> 3"), df.union(df.where("a = 3")), df.withColumn("b", F.when(F.col("a") == 9, "x").otherwise(F.col("b"))), df.withColumn("b", F.coalesce("b", F.lit("")))):
        assert provenance.digest(other).first()["digest"] != one["digest"]
    assert provenance.digest(df.limit(0)).first()["digest"] == "0" * 32
    a = provenance.record({"x": df, "y": df.limit(5)}, "run", {"k": 1})
    b = provenance.record({"x": df.where("a > 0"), "z": df}, "run", {"k": 1})
    assert {(r["input"], r["change"]) for r in provenance.changed(a, b).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    assert {r["config"]["k"] for r in a.collect()} == {"1"}


def test_judge_payload_and_coverage(spark):
    cases = spark.createDataFrame([(1, "q1", ["x"], "a1", "armA"), (2, "q2", [], None, "armB")], "case_id long, question string, expected array<string>, answer string, arm string")
    ev = spark.createDataFrame([(1, "E1.2", "s", "l2", "two", 2), (1, "E1.1", "s", "l1", None, 1)], "case_id long, evidence_id string, source_name string, location string, snippet string, place int")
    claims = spark.createDataFrame([(1, 1, "c1", ["E1.1"]), (1, 0, "c0", [])], "case_id long, claim_index int, text string, evidence_ids array<string>")
    got = {r["case_id"]: json.loads(r["payload"]) for r in judging.payload(cases, ev, claims).collect()}
    assert [e["evidence_id"] for e in got[1]["evidence"]] == ["E1.1", "E1.2"] and [c["claim_index"] for c in got[1]["submitted_claims"]] == [0, 1]
    assert got[2]["evidence"] == got[2]["submitted_claims"] == [] and got[2]["answer"] is None and "arm" not in json.dumps(got)
    judged = spark.createDataFrame([(1, 0, "supported"), (1, 0, "supported"), (2, 5, "supported")], "case_id long, claim_index int, verdict string")
    assert {(r["case_id"], r["problem"], r["claim_index"]) for r in judging.coverage(claims, judged).collect()} == {(1, "repeated", 0), (1, "missing", 1), (2, "unknown_claim", 5)}
    good = spark.createDataFrame([(1, 0, "supported"), (1, 1, "maybe")], "case_id long, claim_index int, verdict string")
    assert [r["problem"] for r in judging.coverage(claims, good).collect()] == ["unknown_verdict"]
    m = spark.createDataFrame([("GPT ", "gpt"), ("a", "b"), ("", "b"), (None, "b")], "a string, j string")
    assert [r[0] for r in m.select(judging.independent(F.col("a"), F.col("j"))).collect()] == [False, True, False, False]


def test_blind_forms_hide_the_arm(spark):
    rows = [(i, "ab"[i % 2], s, 0.5, f"answer {i}") for i in range(40) for s in ("left", "right")]
    answers = spark.createDataFrame(rows, "item_id long, stratum string, arm string, score double, answer string")
    forms = judging.blind(answers, "seed")
    got = sorted(forms.collect(), key=lambda r: (r["turn"], r["stratum"]))
    assert set(forms.columns) == {"turn", "form_id", "item_id", "stratum", "answer", "verdict"} and {r["verdict"] for r in got} == {None}
    assert all({got[i]["stratum"], got[i + 1]["stratum"]} == {"a", "b"} for i in range(0, 80, 2))
    assert got == sorted(judging.blind(answers.repartition(5), "seed").collect(), key=lambda r: (r["turn"], r["stratum"])) and [r["form_id"] for r in got] != [r["form_id"] for r in sorted(judging.blind(answers, "other").collect(), key=lambda r: (r["turn"], r["stratum"]))]
    arms = {r["form_id"]: r["arm"] for r in judging.key_of(answers, "seed").collect()}
    first = [arms[r["form_id"]] for r in got[:40]]
    assert 8 <= first.count("left") <= 32


def test_agreement_and_its_interval(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.integers(0, 3, 300))
    pairs = spark.createDataFrame([("g", f"v{x}", f"v{y}") for x, y in zip(a, b)] + [("one", "v1", "v1")] * 5 + [("g", None, "v1")], "g string, a string, b string")
    table = judging.contingency(pairs, ["g"])
    got = {r["g"]: r for r in judging.agreement(table, ["g"]).collect()}

    def kappa(x, y):
        o = np.mean(x == y)
        e = sum(np.mean(x == v) * np.mean(y == v) for v in range(3))
        return (o - e) / (1 - e)

    assert got["g"]["n"] == 300 and got["g"]["cohen_kappa"] == pytest.approx(kappa(a, b), abs=1e-6) and (got["one"]["exact_agreement"], got["one"]["cohen_kappa"]) == (1.0, None)
    span = {r["g"]: r for r in judging.interval(table, ["g"]).collect()}
    draws = [kappa(a[i], b[i]) for i in (rng.integers(0, 300, 300) for _ in range(2000))]
    low, high = np.quantile(draws, [0.025, 0.975])
    assert span["g"]["kappa_low"] == pytest.approx(low, abs=0.02) and span["g"]["kappa_high"] == pytest.approx(high, abs=0.02)
    scores = spark.createDataFrame([("g", 0.5, 0.7), ("g", 0.0, 1.0), ("g", None, 1.0)], "g string, a double, b double")
    assert tuple(judging.closeness(scores, ["g"]).first()) == ("g", 2, 0.6, 0.5)
    with pytest.raises(CodedError):
        judging.interval(table, ["g"], level=2)


@pytest.mark.parametrize("identifiers_only", [True, False])
def test_fold_equals_the_index(spark, tmp_path, identifiers_only):
    texts = ["alpha beta-1 研发部门 alpha", "", None, "beta 研发", "gamma 部门 alpha", "研"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, content string")
    q = spark.createDataFrame([(1, "alpha 研发部"), (2, "beta-1 beta"), (3, None), (4, "研")], "query_id long, text string")
    got = lexical.fold(nodes, q, str(tmp_path / "f"), identifiers_only)
    want = lexical.bm25(lexical.query_terms(q, all_tokens=not identifiers_only), lexical.postings(nodes, all_tokens=not identifiers_only), lexical.stats(nodes))
    key = lambda rows: sorted((r["query_id"], r["node_id"], round(r["score"], 9)) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 0
    assert lexical.fold(nodes, q.where("query_id = 3"), str(tmp_path / "g"), identifiers_only).count() == 0


def test_all_sheets_of_a_workbook_or_none(spark, tmp_path, monkeypatch):
    two = XLSX_PARTS | {"xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="str"><v>k</v></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>'}
    w = Workbooks(spark, str(tmp_path / "w"))
    assert w.put("b1", "book.xlsx", package(two)) == ["b1/One"] and w.put("c1", "plain.csv", b"code,n\n007,1\n008,2\n") == ["c1"]
    rel = {r["dataset_id"]: r for r in w.relation().collect()}
    assert (rel["b1/One"]["workbook_filename"], rel["c1"]["workbook_filename"]) == ("book.xlsx", None) and rel["c1"]["row_count"] == 2
    assert [r["code"] for r in w.table("c1").orderBy("n").collect()] == ["007", "008"]
    real, seen = uploads.frame, []

    def second_fails(spark_, rows):
        seen.append(1)
        if len(seen) == 2:
            raise CodedError("bad_sheet", "planted")
        return real(spark_, rows)

    before, tables = w.known.read()[0], sorted(p.name for p in (tmp_path / "w/tables").iterdir())
    monkeypatch.setattr(uploads, "tables", lambda raw: [("One", [["k"], ["6"]]), ("Two", [["k"], ["7"]])])
    monkeypatch.setattr(uploads, "frame", second_fails)
    with pytest.raises(CodedError):
        w.put("b1", "book.xlsx", b"")
    assert w.known.read()[0] == before and sorted(p.name for p in (tmp_path / "w/tables").iterdir()) == tables
    monkeypatch.setattr(uploads, "frame", real)
    assert w.put("b1", "book.xlsx", b"") == ["b1/One", "b1/Two"] and int(w.table("b1/One").first()["k"]) == 6
    assert {r["dataset_id"] for r in w.datasets().collect()} == {"b1/One", "b1/Two", "c1"} and len(list((tmp_path / "w/tables").iterdir())) == 3
    with pytest.raises(CodedError):
        w.table("nope")


def test_queries_without_sql(spark):
    recall = [r["recall"] for r in library.j7_cells_recall(spark, "/root/testdata/sf0.001").collect()]
    assert recall and sum(recall) / len(recall) >= 0.88
    span = library.p10_agreement_interval(spark, "/root/testdata/sf0.01").collect()
    point = {r["lang"]: r["cohen_kappa"] for r in library.p10_agreement_by_language(spark, "/root/testdata/sf0.01").collect()}
    assert {r["lang"] for r in span} == set(point) and all(r["kappa_low"] <= point[r["lang"]] <= r["kappa_high"] for r in span)


def test_values_of_an_answer_are_traced(spark):
    from orefall.operators import grounding

    rows = [
        ("Total **1,234,567** of 12.5 [12] and 8 人, 3, 12.5; PRJ-2026-0142 by SLA, sla v2.3.1 Sla", "we had 1234567 and 8 `sla`\nprj-2026-0142"),
        (None, "x"), ("[7] no values here", None), ("ABC and 77", None),
    ]
    got = [list(r) for r in spark.createDataFrame(rows, "a string, e string").select(*grounding.traced(F.col("a"), F.col("e"))).collect()]
    numbers, names, no_number, no_name = got[0]
    assert numbers[:3] == ["1234567", "12.5", "8"] and "12" not in numbers and "3" not in numbers and names == ["PRJ-2026-0142", "SLA", "v2.3.1"]
    assert "12.5" in no_number and not {"1234567", "8"} & set(no_number) and no_name == ["v2.3.1"]
    assert got[1:] == [[[], [], [], []], [[], [], [], []], [["77"], ["ABC"], ["77"], ["ABC"]]]
