"""Fill-in-middle against plain slices, exact round trips, units and odd rows."""

import hashlib
import re

import numpy as np
import pytest

from orefall.llm import fill_in_middle as fim
from tests.llm.test_operators import SCHEMA, odd_rows

TEXTS = ["", "a", "ab cd", "<<S>", "a<P>b", "x<", "<P", "日本語 🙂 é", "one\ntwo\n\nthree", "<S", "S><", "M>" * 3]


@pytest.mark.parametrize("unit,pattern", [("char", r"[\s\S]"), ("word", r"[^\W_]+|[\W_]+"), ("line", r"[^\n]*\n|[^\n]+$")])
def test_boundaries_are_those_of_the_units(unit, pattern):
    for t in TEXTS + ["alpha beta,gamma", "\n\n", "ends\n"]:
        cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        ends = [0] + [m.end() for m in re.finditer(pattern, t)]
        assert fim.boundaries(cp, unit).tolist() == sorted(set(ends)), (unit, t)


@pytest.mark.parametrize("unit", fim.UNITS)
def test_every_form_is_restored(unit):
    for t in TEXTS:
        cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        for i in range(40):
            draw = fim.draws("s", str(i))
            form, p, m, out = fim.arranged(cp, t, draw, unit)
            assert fim.restore(out.decode(), form) == t
            assert (form == "plain") == (p is None) == (m is None)
            if form != "plain":
                a, b = sorted(fim.boundaries(cp, unit)[h % len(fim.boundaries(cp, unit))] for h in draw[:2])
                want = f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if form == "psm" else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
                assert out.decode() == want and (p, m) == (a, b - a)


def plain(doc_id, text):
    """The contract, read literally."""
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_rows_equal_the_plain_form(spark):
    rows = odd_rows() + [(100 + i, TEXTS[i % len(TEXTS)] * (1 + i % 3), "en", "s", 1, "c", "k", "n", "t", 1) for i in range(300)]
    rows += [(900 + i, "long 🙂 text " * 120_000, "en", "s", 1, "c", "k", "n", "t", 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.digests(fim.fill_in_middle(df)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r[0], *plain(r[0], r[1])[:4], sha(plain(r[0], r[1])[4]), sha(r[1] or "")) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    forms = [r["form"] for r in got]
    assert {"plain", "spm", "psm"} == set(forms) and forms.count("psm") > forms.count("spm") > 20


def test_empty_table_and_outputs(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert fim.digests(fim.fill_in_middle(df)).count() == 0
    one = fim.fill_in_middle(spark.createDataFrame([(4, "first line\nsecond line\nthird", *[None] * 8)], SCHEMA), unit="line", seed="9").first()
    assert fim.restore(one["output"], one["form"]) == "first line\nsecond line\nthird"


def test_unknown_unit():
    with pytest.raises(ValueError):
        fim.classes(np.zeros(1, dtype=np.uint32), "page")
