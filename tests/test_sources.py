"""Sources, reports and the stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.functions import values
from veilframe.operators.store import MappingStore
from veilframe.plans import reports
from veilframe.sources import blocks as src


def test_formats(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.csv").write_text("name,amount\nRavi Kumar,10\nAnil Rao,20\n")
    (tmp_path / "c.json").write_text('{"a": "x"}')
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.md").write_text("# hi")
    (tmp_path / "f.bin").write_bytes(b"\xff\xfe\x00")
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.writestr("a.txt", "x")
    kinds = {r.path.rpartition("/")[2]: r.doc_format for r in src.detect_format(src.read_files(spark, f"file://{tmp_path}")).collect()}
    assert kinds == {"a.pdf": "pdf", "b.csv": "csv", "c.json": "json", "d.json": None, "e.md": "text", "f.bin": None, "g.xlsx": "xlsx", "h.zip": None}
    cells = src.csv_cells(src.read_files(spark, f"file://{tmp_path}/b.csv")).orderBy("row", "col").collect()
    assert [(r.row, r.header, r.text) for r in cells] == [(-1, "col_0", "name"), (-1, "col_1", "amount"), (0, "name", "Ravi Kumar"), (0, "amount", "10"), (1, "name", "Anil Rao"), (1, "amount", "20")]


def test_markdown_front_matter(spark):
    docs = spark.createDataFrame([(1, "---\ntitle: x\nby: y\n---\nfirst\nline\n\nsecond"), (2, "---\nnot closed"), (3, None)], "doc_id int, text string")
    rows = src.paragraphs(docs, markdown=True).orderBy("doc_id", "block_index").collect()
    assert [(r.doc_id, r.text, r.row) for r in rows] == [(1, "title: x", 1), (1, "by: y", 2), (1, "first\nline", 4), (1, "second", 7), (2, "---\nnot closed", 0)]


def test_json_leaves(spark):
    docs = spark.createDataFrame([("d", json.dumps({"a b": ["x", 1, {"q\"": "y"}], "n": None, "e": " "}))], "doc_id string, json string")
    assert [(r.path, r.text) for r in src.json_leaves(docs).collect()] == [('$["a b"][0]', "x"), ('$["a b"][2]["q\\""]', "y")]


def test_workbook():
    import io

    data = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="Ravi">S!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>PAN</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>5</v></c><c r="B2" t="str"><f>A1</f><v>PAN</v></c></row></sheetData></worksheet>')
    assert list(src.sheet_cells(data.getvalue())) == [("S", 1, 1, "value", "PAN", False), ("S", 2, 2, "formula_result", "PAN", True), ("", 0, 0, "defined_name", "Ravi", True)]


def test_reports(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, "a"), (1, 0, 50.0, 2.0, 11.0, "b"), (1, 0, 0.0, 20.0, 30.0, "c")], "doc_id int, page int, x0 double, y0 double, y1 double, text string")
    assert [r.text for r in reports.reading_rows(b).orderBy("row").collect()] == ["a | b", "c"]
    one = spark.createDataFrame([("a ``` b",)], "t string")
    assert one.select(reports.fenced_json(F.col("t"))).first()[0] == "````json\na ``` b\n````"
    lines = spark.createDataFrame([("\n".join(map(str, range(32))),)], "t string")
    assert lines.select(reports.first_lines(F.col("t"))).first()[0].endswith("29\n... 2 more lines")
    import hashlib
    import hmac

    key = b"k" * 80
    assert one.select(values.hmac_sha256(key, F.col("t"))).first()[0] == hmac.new(key, b"a ``` b", hashlib.sha256).hexdigest()
    docs = spark.createDataFrame([(1, "Dear Ravi")], "doc_id int, text string")
    moved = spark.createDataFrame([(1, 0, 4, "Ravi", "X")], "doc_id int, start int, end int, old string, text string")
    with pytest.raises(Exception, match="changed under"):
        reports.splice_blocks(docs, moved).collect()
    with pytest.raises(ValueError):
        reports.write_back(docs.withColumn("block_index", F.lit(0)), spark.createDataFrame([(2, 0, "x")], "doc_id int, block_index int, text string"))


def test_a_stream_of_messages(spark, tmp_path):
    from veilframe.streaming.chat import redact_stream

    spark.sparkContext.setCheckpointDir(f"{tmp_path}/cp")
    rows = [("m1", 1, "I am Mr. Ravi Kumar"), ("m2", 1, "RAVI KUMAR wrote, call 9876543210"), ("m3", 2, "Ravi Kumar is someone else here")]
    spark.createDataFrame(rows, "message_id string, conv_id int, text string").coalesce(1).write.json(f"{tmp_path}/in")
    store = MappingStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("message_id string, conv_id int, text string").json(f"{tmp_path}/in")
    redact_stream(stream, store, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(240)
    out = {r.message_id: r.pseudonymized for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {"m1": "I am Mr. PERSON_A", "m2": "PERSON_A wrote, call PHONE_NUMBER_A", "m3": "Ravi Kumar is someone else here"}


def test_json_is_written_back(spark):
    docs = spark.createDataFrame([(1, '{"a": ["x", {"q\\"": "y"}], "n": 5}'), (2, '{\n  "k": "v"\n}'), (3, "[]")], "doc_id int, json string")
    new = spark.createDataFrame([(1, '$["a"][0]', "X"), (1, '$["a"][1]["q\\""]', "Y"), (2, '$["k"]', "W")], "doc_id int, path string, text string")
    out = {r.doc_id: r.json for r in reports.json_write(docs, new).collect()}
    assert out == {1: '{"a": ["X", {"q\\"": "Y"}], "n": 5}', 2: '{\n  "k": "W"\n}', 3: "[]"}
    with pytest.raises(Exception, match="no string"):
        reports.json_write(docs, spark.createDataFrame([(1, '$["n"]', "X")], "doc_id int, path string, text string")).collect()
    with pytest.raises(ValueError):
        reports.path_steps("$.a")


def test_neighbours_lend_their_words(spark):
    from veilframe.operators.context import detect_on_pages

    rows = [("d", 0, 0, "Date of Birth", 0.0, 0.0, 80.0, 10.0), ("d", 0, 1, "15/08/1990", 100.0, 0.0, 160.0, 10.0), ("d", 0, 2, "16/08/1990", 100.0, 300.0, 160.0, 310.0), ("e", None, 0, "DOB 17/08/1990", None, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_index int, text string, x0 double, y0 double, x1 double, y1 double")
    out = {(r.doc_id, r.block_index): [(f.s, f.e) for f in r.findings] for r in detect_on_pages(blocks, types=["IN_DATE_OF_BIRTH"]).collect()}
    assert out == {("d", 0): [], ("d", 1): [(0, 10)], ("d", 2): [], ("e", 0): [(4, 14)]}
