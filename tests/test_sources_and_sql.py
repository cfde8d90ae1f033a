"""Loaders, guarded SQL and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from orefall.config import Settings
from orefall.errors import CodedError
from orefall.plans.guard import Guard
from orefall.sources import files, office, uploads
from orefall.streaming import windows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text, style=None, extra=""):
    pr = f'<w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{extra}</w:pPr>'
    return f"<w:p>{pr}<w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = package(
    {
        "word/document.xml": f'<w:document {W}><w:body>{para("Title here", "Heading1")}{para("Text")}{para("item", None, "<w:numPr><w:ilvl w:val=\"1\"/></w:numPr>")}<w:tbl><w:tr><w:tc>{para("a|b")}</w:tc><w:tc>{para("c")}</w:tc></w:tr><w:tr><w:tc>{para("1")}</w:tc></w:tr></w:tbl></w:body></w:document>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>',
    }
)
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX_PARTS = {
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Hid" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>day</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>at</t></is></c></row><row/><row><c r="A2"><v>3.0</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2" s="2"><v>45292.5</v></c></row><row><c r="A3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
}


def test_kinds():
    assert [files.kind_of(b) for b in (b"%PDF-1", DOCX, package(XLSX_PARTS), b"PK\x03\x04junk", b"\xd0\xcf\x11\xe0", b"\x89PNG", b"", "﻿ <HTML>".encode(), "中文内容".encode("gbk"), b"a\0b", b"\x01\x02\x03ab", "好".encode() * 3000)] == ["pdf", "docx", "xlsx", "zip", "ole", "image", "text", "html", "text", "binary", "binary", "text"]


def test_documents():
    assert files.load(DOCX) == ("# Title here\n\nText\n\n  1. item\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |", "docx")
    slides = package({"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": "<s><p><t>ten</t></p></s>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>", "ppt/slides/slide3.xml": "<s/>"})
    assert files.load(slides)[0] == "# 幻灯片 2\n\ntwo\n\n# 幻灯片 10\n\nten"
    assert files.html_markdown("<title>T</title><h2>A  b</h2><ul><li>x<ul><li>y</li></ul></li></ul><script>s</script><p>c<br>d</p><table><tr><td>1</td><td>2</td></tr></table>") == "T\n\n## A b\n\n\n- x\n\n  - y\n\nc\nd\n\n | 1 | 2".replace("\n\n\n", "\n\n")
    for raw, code in ((b"\x89PNG", "unsupported_file"), (b"  ", "no_text"), (package({"word/document.xml": "<a/>", "word/vbaProject.bin": "x"}), "macros")):
        with pytest.raises(CodedError) as e:
            files.load(raw)
        assert e.value.code == code


def test_bombs(monkeypatch):
    monkeypatch.setattr(office, "ENTRIES", 3)
    with pytest.raises(CodedError) as e:
        files.load(package({"word/document.xml": "<a/>"} | {f"x{i}": "" for i in range(5)}))
    assert e.value.code == "package_too_large"


def test_failures_stay_as_rows(spark, tmp_path):
    for name, raw in (("a.txt", b"hello"), ("b.bin", b"\0\1"), ("c.txt", b"x" * 100)):
        (tmp_path / name).write_bytes(raw)
    rows = {r["path"].rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path), Settings(upload_bytes=50)).collect()}
    assert (rows["a.txt"]["text"], rows["a.txt"]["status"]) == ("hello", "uploaded")
    assert rows["b.bin"]["error"].startswith("unsupported_file") and rows["c.txt"]["error"].startswith("too_large")


def test_uploads(spark, tmp_path):
    assert uploads.tables(package(XLSX_PARTS)) == [("One", [["name", "day", "at"], ["3", "2024-01-01", "2024-01-01 12:00:00"], ["TRUE", "", ""]])]
    bad = XLSX_PARTS | {"xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1"><f>1+1</f></c></row></sheetData></worksheet>'}
    with pytest.raises(CodedError) as e:
        uploads.tables(package(bad))
    assert e.value.code == "uncalculated_formula"
    raw = "部门,人数,日期\n研发,\"1,200\",2024-01-02\n,,\n销售,3\n".encode("gbk")
    df = uploads.frame(spark, uploads.tables(raw)[0][1])
    assert dict(df.dtypes) == {"部门": "string", "人数": "decimal(38,0)", "日期": "date"} and df.agg(F.sum("人数")).first()[0] == 1203
    (tmp_path / "t.csv").write_text("code,n\n007,1\n008,2\n")
    assert dict(uploads.read_csv(spark, str(tmp_path / "t.csv")).dtypes) == {"code": "string", "n": "decimal(38,0)"}


@pytest.fixture(scope="module")
def guard(spark):
    return Guard(spark, {"sales": spark.createDataFrame([("north", 3), ("south", 5)], "region string, amount int"), "other": spark.range(500).toDF("id")})


def test_guard_answers(guard):
    a = guard.run('WITH s AS (SELECT "region", amount FROM sales) SELECT "region" FROM s WHERE amount > (SELECT avg(amount) FROM sales);')
    assert (a.columns, a.rows, a.row_count) == (["region"], [("south",)], 1)
    assert guard.run("SELECT * FROM other").row_count == 200
    assert guard.run("SELECT 'a;b' AS x FROM sales LIMIT 1").rows == [("a;b",)] and guard.run("SELECT * FROM sales WHERE false").columns == ["region", "amount"]


@pytest.mark.parametrize(
    "sql,code",
    [
        ("", "empty_sql"), ("DROP TABLE sales", "not_a_select"), ("INSERT INTO sales VALUES ('x', 1)", "not_a_select"), ("CREATE TABLE x AS SELECT * FROM sales", "not_a_select"), ("SELECT 1; SELECT 2", "sql_failed"),
        ("SELECT * FROM secret", "permission_denied"), ("SELECT * FROM sales, secret", "permission_denied"), ("SELECT * FROM sales WHERE amount IN (SELECT id FROM secret)", "permission_denied"), ("SELECT (SELECT max(id) FROM secret)", "permission_denied"),
        ("SELECT * FROM sales WHERE EXISTS (SELECT 1 FROM secret)", "permission_denied"), ("SELECT * FROM `parquet`.`/etc`", "permission_denied"), ("SELECT nope FROM sales", "sql_failed"), ("SET x = 1", "not_a_select"),
    ],
)
def test_guard_refuses(guard, sql, code):
    with pytest.raises(CodedError) as e:
        guard.run(sql)
    assert e.value.code == code


def test_guard_stops_long_statements(spark):
    g = Guard(spark, {"n": spark.range(0, 3_000_000, 1, 4).toDF("id")}, Settings(sql_timeout_ms=1500))
    with pytest.raises(CodedError) as e:
        g.run("SELECT sum(a.id * b.id % 7) FROM n a CROSS JOIN n b")
    assert e.value.code == "timeout"


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    s = windows.source(spark, str(tmp_path / "in"), e.schema)
    out = str(tmp_path / "out")
    windows.drain(windows.windowed(s, late="3650 days"), out, str(tmp_path / "cp"), "append")
    batch = windows.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")))
    q = windows.windowed(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_attempts_are_counted_in_state(spark, tmp_path):
    rows = [(1, False, "2024-01-01 00:00:01"), (1, False, "2024-01-01 00:00:02"), (1, False, "2024-01-01 00:00:03"), (2, True, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "job_id long, coded boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windows.source(spark, str(tmp_path / "in"), df.schema)
    q = windows.attempts(s).writeStream.outputMode("update").format("memory").queryName("a").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r["job_id"], r["attempt"], r["status"], r["wait"]) for r in spark.table("a").collect()) == [(1, 1, "uploaded", 5.0), (1, 2, "uploaded", 10.0), (1, 3, "dead_letter", None), (2, 1, "failed", None)]


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System','getProperty','user.home')", "SELECT java_method('java.lang.System','getenv','HOME')", "SELECT try_reflect('java.lang.System','exit','0')",
    "SELECT n FROM mine WHERE n = (SELECT length(reflect('java.lang.System','getProperty','user.home')))", "SELECT transform(array(1), x -> reflect('a','b')) FROM mine",
    "SELECT * FROM range(10)", "SELECT * FROM read_files('/etc/passwd')", "SELECT input_file_name() FROM mine", "SELECT current_user()", "SELECT raise_error('x')", "SELECT my.udf(n) FROM mine",
    "SELECT n FROM mine ORDER BY reflect('java.lang.System','getProperty','user.home')", "SELECT sum(n) OVER (ORDER BY length(version())) FROM mine",
])
def test_guard_refuses_functions_beyond_plain_ones(spark, sql):
    with pytest.raises(CodedError) as e:
        Guard(spark, {"mine": spark.range(3).toDF("n")}).run(sql)
    assert e.value.code == "function_denied"


def test_guard_allows_plain_functions(spark):
    g = Guard(spark, {"mine": spark.range(3).toDF("n")})
    sql = "SELECT upper(substr('abc', 1, 2)) AS a, round(avg(n), 1) AS b, count(DISTINCT n) AS c, max(coalesce(n, 0)) AS d, size(transform(array(1, 2), x -> x + abs(-1))) AS e, max(date_add(DATE '2020-01-01', 1)) AS f FROM mine WHERE n IN (SELECT col FROM explode(array(0, 1, 2)))"
    assert g.run(sql).rows[0][:5] == ("AB", 1.0, 3, 2, 2)
    assert g.run("SELECT n, row_number() OVER (ORDER BY n DESC) AS r, CASE WHEN n > 1 THEN 'x' END AS c FROM mine ORDER BY n LIMIT 1").rows == [(0, 3, None)]


@pytest.mark.parametrize("sql,code", [
    ("SELECT IDENTIFIER('ref'||'lect')('java.lang.System','getProperty','user.home')", "function_denied"), ("SELECT IDENTIFIER('n') FROM mine", "function_denied"),
    ("SELECT * FROM IDENTIFIER('mine')", "not_a_select"), ("WITH c AS (SELECT IDENTIFIER('n') FROM mine) SELECT * FROM c", "function_denied"),
    ("SELECT n, max(n) OVER w FROM mine WINDOW w AS (PARTITION BY reflect('java.lang.System','setProperty','judge.x',cast(n as string)))", "function_denied"),
    ("SELECT n FROM mine WHERE n IN (SELECT max(n) OVER w FROM mine WINDOW w AS (ORDER BY IDENTIFIER('version')()))", "function_denied"),
    ("SELECT * FROM mine LATERAL VIEW java_method('java.lang.System','getenv') e AS y", "function_denied"),
    ("SELECT sequence(1, 100000000)", "too_large"), ("SELECT sequence(1, n * 100000000) FROM mine", "too_large"), ("SELECT repeat('a', 1000000000)", "too_large"), ("SELECT repeat('a', n) FROM mine", "too_large"),
    ("SELECT transform(sequence(1, 10000), x -> repeat('a', 10000))", "too_large"), ("SELECT lpad('a', 2000000, 'b')", "too_large"), ("SELECT array_repeat(1, 2000000)", "too_large"), ("SELECT space(2000000)", "too_large"),
    ("SELECT collect_list(repeat('a', 100000)) FROM (SELECT 1 FROM mine, mine AS b, mine AS c)", "too_large"),
])
def test_guard_refuses_what_a_statement_hides_or_blows_up(spark, sql, code):
    with pytest.raises(CodedError) as e:
        Guard(spark, {"mine": spark.range(3).toDF("n")}).run(sql)
    assert e.value.code == code
    assert spark._jvm.java.lang.System.getProperty("judge.x") is None


def test_guard_allows_windows_sequences_and_lambdas(spark):
    g = Guard(spark, {"mine": spark.range(3).toDF("n")})
    assert g.run("SELECT n, sum(n) OVER w AS s FROM mine WINDOW w AS (ORDER BY n) ORDER BY n").rows == [(0, 0), (1, 1), (2, 3)]
    assert g.run("SELECT size(sequence(1, 10, 3)) AS a, repeat('ab', 2) AS b, lpad('7', 3, '0') AS c, size(sequence(DATE '2024-01-01', DATE '2024-01-05')) AS d").rows == [(4, "abab", "007", 5)]
    assert g.run("SELECT n, n FROM mine ORDER BY n LIMIT 1").columns == ["n", "n"]
    assert g.run("SELECT url_decode('a%20b') AS u, percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS p, named_struct('a', 1).a AS s, extract(year FROM DATE '2024-01-01') AS y FROM mine").rows == [("a b", 1.0, 1, 2024)]
    assert g.run("SELECT e.y FROM mine LATERAL VIEW explode(array(1, 2)) e AS y WHERE n = 0 ORDER BY y").rows == [(1,), (2,)]
    assert g.run("SELECT grouping(n) AS g, count(*) AS c FROM mine GROUP BY ROLLUP (n) HAVING count(*) > 1").rows == [(1, 3)]
