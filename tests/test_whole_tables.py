"""Registered queries read every row and whole texts: small tables whose cases lie past former cuts."""

from orefall.plans import catalog


def test_query_metadata_of_long_keys(spark, tmp_path):
    keys = [5, 7, 89995, 90005, 123455, 9999999995, 90001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: (r["refs"], r["years"]) for r in catalog.QUERIES["b20_query_metadata"](spark, str(tmp_path)).collect()}
    # A ticket code has five digits: longer keys are none, and their text is filtered by its year.
    assert got == {k: (f"TICKET-{k:05}", "") if k % 5 == 0 and k < 100000 else ("", f"20{k % 30:02}") for k in keys}


def test_repeats_are_whole_texts(spark, tmp_path):
    asked = ["What does the guide say of rivers?", "What does the guide say of houses?", " what does the guide say of RIVERS", "Else"]
    rows = [(1, k, "user", text) for k, text in enumerate(asked)] + [(2, k, "user", text) for k, text in enumerate(asked[:2])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    repeats = catalog.QUERIES["f18_repeated_queries"](spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["repeats"]) for r in repeats] == [(1, 1)]
    again = catalog.QUERIES["n6_duplicate_suppression"](spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["turn"]) for r in again] == [(1, 2)]


def test_claims_are_grounded_to_their_last_word(spark, tmp_path):
    known = [f"w{i}" for i in range(12)]
    rows = [(1, 0, "user", " ".join(known)), (1, 1, "assistant", " ".join(known + ["unknown"] * 4)), (2, 0, "user", "A b"), (2, 1, "assistant", "a c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["n9_string_grounding"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: r["share"] for r in got} == {1: 0.75, 2: 0.5}
