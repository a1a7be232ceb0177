import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitsignal.layouts import CYCLE_COLUMNS, CYCLE_OLD_COLUMNS, SENSOR_COLUMNS
from pitsignal.sinks import files as sinks
from pitsignal.sinks.workbook import write_book, write_workbooks
from pitsignal.sources import columnar, delimited, files, loader, objects, tables, workbook


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return str(path)


MODEL = ["2024-01-01", "day", "2024-01-01 0{}:00:00", "1", "T-210", "F", "active", "c", "e"]


def line(i, separator, extra=()):
    return separator.join([v.format(i) for v in MODEL] + list(extra)) + "\n"


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    folder = f"{root}/val_data_time_model/a"
    head = "h1{0}h2\n"
    put(f"{folder}/T-210_1.csv", "﻿" + head.format(",") + line(3, ",") + line(1, ",", ["over", "long"]))
    put(f"{folder}/T-210_2.csv", head.format(";") + line(2, ";") + "2024-01-01;day;2024-01-01 04:00:00\n")
    put(f"{folder}/T-210_3.tsv", head.format("\t") + line(5, "\t"))
    put(f"{folder}/T-210_4.csv", "")
    put(f"{folder}/T-210_5.log", "x")
    put(f"{folder}/T-210_6.xls", "old")
    put(f"{folder}/T-211_1.csv", head.format(",") + line(9, ","))
    return root


def test_listing(spark, base):
    pattern = files.file_pattern(base, "val_data", "*", "t-210")
    found = files.list_files(spark, pattern)
    assert found.count() == 5
    good, bad = files.split_supported(found)
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["T-210_5.log"]
    assert {r[0] for r in good.select(files.truck_of("path")).collect()} == {"T-210"}
    files.require_truck(spark, base, "val_data", "T-211")
    with pytest.raises(FileNotFoundError):
        files.require_truck(spark, base, "val_data", "T-999")
    with pytest.raises(ValueError):
        files.file_pattern(base, "other")
    assert files.check_extension("a/b.CSV", "tabular") == ".csv"
    with pytest.raises(ValueError):
        files.check_extension("a/b", "tabular")


def test_separators(spark, base):
    listed = files.list_files(spark, files.file_pattern(base, "val_data", "time_model", "T-210", "*sv"))
    got = {os.path.basename(r["path"]): r["separator"] for r in delimited.detect_separators(listed).collect()}
    assert got == {"T-210_1.csv": ",", "T-210_2.csv": ";", "T-210_3.tsv": "\t"}


def test_first_line_longer_than_a_block(tmp_path):
    path = put(f"{tmp_path}/x.csv", "a" * 100 + ";b\nrest")
    assert files.first_line(path, block=7) == "a" * 100 + ";b"


def test_load_datasets(spark, base):
    out = loader.load_datasets(spark, base, "val_data", "t-210")
    got = out.datasets["time_model"].collect()
    # In time order; the short row is padded, the long row cut, nulls would be last.
    assert [r["TimeStamp"][11:13] for r in got] == ["01", "02", "03", "04", "05"]
    assert got[3]["Status"] is None and got[0]["Event"] == "e"
    assert out.datasets["sensor"].columns == SENSOR_COLUMNS and out.datasets["sensor"].count() == 0
    reasons = {os.path.basename(r["path"]): r["reason"] for r in out.unreadable.collect()}
    assert reasons == {"T-210_4.csv": "empty file", "T-210_5.log": "unsupported extension", "T-210_6.xls": "legacy workbook"}
    strict = loader.load_datasets(spark, base, "val_data", "T-210", drop_long_rows=True).datasets["time_model"]
    assert [r["TimeStamp"][11:13] for r in strict.collect()] == ["02", "03", "04", "05"]
    # Reading fewer columns must not bring long rows back.
    assert strict.select("Shift").count() == strict.count() == 4
    assert loader.load_datasets(spark, base, "val_data", "*", ordered=False).datasets["time_model"].count() == 6


def test_quoted_separators_are_no_fields(spark, tmp_path):
    path = put(f"{tmp_path}/q.csv", 'a,b\n1,"x,y"\n2,"x,y",z\n3\n,\n')
    strict = delimited.read_positional(spark, path, ["a", "b"], drop_long_rows=True, with_path=True)
    assert [(r["a"], r["b"]) for r in strict.collect()] == [("1", "x,y"), ("3", None), (None, None)]
    assert strict.first()["source_file"].endswith("q.csv")
    loose = delimited.read_positional(spark, path, ["a", "b"])
    assert [(r["a"], r["b"]) for r in loose.collect()] == [("1", "x,y"), ("2", "x,y"), ("3", None), (None, None)]
    assert delimited.read_positional(spark, path, ["a", "b"], skip_header=False).count() == 5


def test_training_layout(spark, tmp_path):
    put(f"{tmp_path}/train_data_time_model/test_1/T-210_1.csv", line(7, ",") + "head,er\n" + line(3, ",", ["long"]))
    out = loader.load_training(spark, str(tmp_path), "t-210")["time_model"]
    got = out.collect()
    assert [None if r["TimeStamp"] is None else r["TimeStamp"].hour for r in got] == [7, None]
    with pytest.raises(ValueError):
        loader.load_training(spark, str(tmp_path), "T-1")
    put(f"{tmp_path}/train_data_cycle/test_1/T-210_1.csv", ",".join(f"v{i}" for i in range(36)) + "\n")
    cycle = loader.load_training(spark, str(tmp_path), "t-210")["cycle"]
    assert cycle.columns == CYCLE_OLD_COLUMNS
    assert cycle.first()["travel_empty_seconds"] == "v0" and cycle.first()["dump_location"] == "v34"


def test_round_trip_of_extractor_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "A bigint, B string")
    assert sinks.write_csv(df, f"{tmp_path}/t")
    back = delimited.read_headed(spark, f"{tmp_path}/t", df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert not sinks.write_csv(df.limit(0), f"{tmp_path}/none") and not os.path.exists(f"{tmp_path}/none")
    sinks.copy_csv(spark, f"{tmp_path}/t", f"{tmp_path}/u")
    assert delimited.read_headed(spark, f"{tmp_path}/u", df.schema).count() == 3
    with pytest.raises(ValueError):
        sinks.copy_csv(spark, f"{tmp_path}/t", f"{tmp_path}/t/")
    with pytest.raises(ValueError):
        sinks.write_restructured(df, f"{tmp_path}/t", f"{tmp_path}/t")


def test_quarantine_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a bigint, t string")
    assert sinks.write_quarantine(df, "t", f"{tmp_path}/q")
    assert delimited.read_headed(spark, f"{tmp_path}/q", df.schema).first()["a"] == 1
    paths = sinks.write_report({"one": df, "two": df.limit(0)}, str(tmp_path / "r"))
    assert [columnar.read_parquet(spark, p).count() for p in paths] == [2, 0]


def test_arrow_batches(spark, tmp_path):
    table = pa.table({"a": list(range(10)), "b": [str(i) for i in range(10)]})
    for name, size in (("x", 3), ("y", 100)):
        with pa.OSFile(f"{tmp_path}/{name}.feather", "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table, max_chunksize=size)
    df = columnar.read_arrow(spark, f"{tmp_path}/*.feather")
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(r["a"] for r in df.collect()) == sorted([*range(10)] * 2)
    with pytest.raises(FileNotFoundError):
        columnar.read_arrow(spark, f"{tmp_path}/none*.feather")


def book(path, sheets):
    with open(path, "wb") as f:
        write_book(f, iter([(n, iter(rows)) for n, rows in sheets]))
    return str(path)


def test_workbook_grid(spark, tmp_path):
    book(tmp_path / "equipo_1.xlsx", [("uno & <dos>", [(1, ["a", None, "3.50"]), (4, [None, "007"])]), ("b", [(1, ["z"])])])
    put(f"{tmp_path}/equipo_2.xlsx", b"no archive")
    rows = workbook.workbook_rows(spark, f"{tmp_path}/equipo*.xlsx")
    cells = sorted((r["sheet"], r["row"], r["col"], r["value"]) for r in workbook.workbook_cells(rows).collect())
    assert cells == [("b", 1, 1, "z"), ("uno & <dos>", 1, 1, "a"), ("uno & <dos>", 1, 3, "3.50"), ("uno & <dos>", 4, 2, "007")]
    bad = workbook.workbook_errors(rows).collect()
    assert [os.path.basename(r["path"]) for r in bad] == ["equipo_2.xlsx"]


def test_shared_texts_dates_and_styles(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2" s="1"><v>45325.5</v></c><c r="D2" s="2"><v>7</v></c><c r="AA2" t="b"><v>1</v></c><c r="AB2" t="e"><v>#N/A</v></c></row><row><c t="s"><v>0</v></c><c s="3"><v>1</v></c></row></sheetData></worksheet>')
    cells = {(r["row"], r["col"]): r["value"] for r in workbook.workbook_cells(workbook.workbook_rows(spark, f"{tmp_path}/s.xlsx")).collect()}
    assert cells == {(2, 2): "rich", (2, 3): "2024-02-03 12:00:00", (2, 4): "7", (2, 27): "True", (3, 1): "plain", (3, 2): "1899-12-31 00:00:00"}


def test_positional_and_named_workbooks(spark, tmp_path):
    folder = tmp_path / "val_data_time_model" / "x"
    folder.mkdir(parents=True)
    book(folder / "T-5_1.xlsx", [("s", [(1, ["any"]), (2, [v.format(4) for v in MODEL])]), ("t", [(2, ["not read"])])])
    out = loader.load_datasets(spark, str(tmp_path), "val_data", "T-5").datasets["time_model"]
    assert [r["TimeStamp"] for r in out.collect()] == ["2024-01-01 04:00:00"]
    book(tmp_path / "despacho1.xlsx", [("s", [(1, ["x", "Veh", "fin"]), (2, ["1", "a", "f"]), (3, [None, "b"])])])
    book(tmp_path / "despacho2.xlsx", [("s", [(1, ["fin", "Veh"]), (2, ["g", "c"])])])
    book(tmp_path / "despacho3.xlsx", [("s", [(1, ["Veh"]), (2, ["d"])])])
    table, errors = workbook.read_named(spark, ["Veh", "fin"], f"{tmp_path}/despacho*.xlsx")
    assert sorted(map(tuple, table.collect())) == [("a", "f"), ("b", None), ("c", "g")]
    assert [os.path.basename(r["path"]) for r in errors.collect()] == ["despacho3.xlsx"]


def test_workbook_writer_keeps_sheets_whole(spark, tmp_path):
    rows = spark.range(40).select(
        (F.col("id") % 4).cast("string").alias("sheet"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("row"),
        F.array(F.col("id").cast("string")).alias("values"))
    assert write_workbooks(rows, str(tmp_path), "w") == 4
    back = workbook.workbook_cells(workbook.workbook_rows(spark, f"{tmp_path}/w_*.xlsx"))
    assert sorted(int(r["value"]) for r in back.collect()) == list(range(40))


def test_objects(spark, tmp_path):
    put(f"{tmp_path}/val_data_sensor/a/T-1_1.json", '{\n "a": 1, "b": "x"}')
    put(f"{tmp_path}/val_data_sensor/a/T-1_2.json", '{"b": {"c": [1, 2]}, "d": null}')
    put(f"{tmp_path}/val_data_sensor/a/T-1_3.json", "broken")
    got = loader.load_objects(spark, str(tmp_path), "val_data", "t-1")
    assert {r["key"]: r["value"] for r in got["sensor"].collect()} == {"a": "1", "b": '{"c":[1,2]}', "d": None}
    assert got["cycle"].count() == 0
    assert objects.read_objects(spark, f"{tmp_path}/none*.json").count() == 0


def test_dispatch_by_type(spark, base, tmp_path):
    csv = loader.read_source(spark, "csv", path=files.file_pattern(base, "val_data", "time_model", "T-211"), columns=["a"])
    assert csv.count() == 1
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert loader.read_source(spark, "parquet", path=f"{tmp_path}/p").count() == 3
    put(f"{tmp_path}/x.json", '{"k": 1}')
    assert loader.read_source(spark, "json", path=f"{tmp_path}/x.json").first()["value"] == "1"
    with pytest.raises(ValueError):
        loader.read_source(spark, "api")


def test_parquet_by_name_or_position(spark, tmp_path):
    folder = f"{tmp_path}/val_data_cycle/a"
    os.makedirs(folder)
    named = pa.table({c: [c] for c in reversed(CYCLE_COLUMNS)})
    import pyarrow.parquet as pq

    pq.write_table(named, f"{folder}/T-1_1.parquet")
    out = loader.load_datasets(spark, str(tmp_path), "val_data", "T-1").datasets["cycle"]
    assert out.columns == CYCLE_COLUMNS and out.first()["Hauling"] == "Hauling"


def test_small_tables(spark):
    assert tables.literal_table(spark, [(1, "a")], "n int, s string").first()["s"] == "a"
    assert [tuple(r) for r in tables.literal_series(spark, {"x": 1, "y": 2}).collect()] == [("x", 1), ("y", 2)]
    assert tables.literal_series(spark, [5, 6]).count() == 2
    assert [str(r[0]) for r in tables.dates_from(spark, "2024-01-30", 3).collect()] == ["2024-01-30", "2024-01-31", "2024-02-01"]
    a, b = (tables.random_normal(spark.range(5), ["a"], 3).collect() for _ in range(2))
    assert a == b


def test_sheets_of_a_book_are_read_in_runs(tmp_path, monkeypatch):
    import pandas as pd

    path = book(tmp_path / "w.xlsx", [(f"s{i}", [(1, [str(i)]), (2, ["x & y", None, "<z>"])]) for i in range(30)])
    listed = lambda: list(workbook._list_sheets(iter([pd.DataFrame({"path": [path]})])))[0]
    assert listed()["run"].tolist() == [0] * 30
    opened = []
    monkeypatch.setattr(workbook, "open_file", lambda p, of=workbook.open_file: opened.append(p) or of(p))
    units = pa.RecordBatch.from_pandas(listed(), preserve_index=False)
    opened.clear()
    rows = [r for b in workbook._read_sheets(iter([units])) for r in b.to_pylist()]
    assert len(opened) == 1 and len(rows) == 60
    assert rows[58]["values"] == ["29"] and rows[59]["values"] == ["x & y", None, "<z>"] and rows[59]["row"] == 2
    monkeypatch.setattr(workbook, "RUN_BYTES", 1)
    assert listed()["run"].tolist() == list(range(30))


def test_rows_of_a_sheet_in_small_chunks(monkeypatch):
    import io
    from xml.etree import ElementTree

    monkeypatch.setattr(workbook, "_CHUNK", 7)
    rows = "".join(f'<row r="{i}"><c><v>{i}</v></c></row>' for i in range(1, 9))
    whole = f'<w xmlns="m"><cols/><sheetData>{rows}</sheetData><from><row>2</row></from></w>'
    numbers = lambda text: [e.get("r") for e in workbook._row_elements(io.BytesIO(text.encode()))]
    assert numbers(whole) == [str(i) for i in range(1, 9)]
    assert numbers('<w><sheetData/></w>') == [] and numbers("<w/>") == []
    # Up to a fault all complete rows are given.
    for size in (7, 10_000):
        monkeypatch.setattr(workbook, "_CHUNK", size)
        for text, n in ((whole[:whole.index('<row r="5"')] + "<", 4), (whole.replace('<v>5', '<v<'), 4), (whole[:-3] + "x>", 8)):
            got = []
            with pytest.raises(ElementTree.ParseError):
                for e in workbook._row_elements(io.BytesIO(text.encode())):
                    got.append(e.get("r"))
            assert got == [str(i) for i in range(1, n + 1)]


def test_rows_as_texts():
    from pitsignal.sinks.workbook import row_texts, sheet_texts

    values = pa.array([["a", None, "3.50"], [], None, ["007", "0", "0.5", ".", "1.", "²", "1.2.3", "é&<>\""]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(["s", "s", "t", "t"]), pa.array([1, 2, 5, 6], pa.int32()), values], ["sheet", "row", "values"])
    data, at = row_texts(batch.column(1), batch.column(2))
    texts = [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    inline = '<c r="{}" t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'
    assert texts[0] == f'<row r="1">{inline.format("A1", "a")}<c r="C1"><v>3.50</v></c></row>' and texts[1:3] == ['<row r="2"></row>', '<row r="5"></row>']
    shown = ["007", "0", "0.5", ".", "1.", "²", "1.2.3", 'é&amp;&lt;&gt;"']
    cells = [f'<c r="{c}6"><v>{t}</v></c>' if t in ("0", "0.5", "1.") else inline.format(f"{c}6", t) for c, t in zip("ABCDEFGH", shown, strict=True)]
    assert texts[3] == f'<row r="6">{"".join(cells)}</row>'
    # A sheet may go on in the next batch.
    split = [batch.slice(0, 1), batch.slice(1)]
    assert [(name, b"".join(parts).decode()) for name, parts in sheet_texts(split)] == [("s", "".join(texts[:2])), ("t", "".join(texts[2:]))]


def test_number_of_line_files_follows_bytes(spark, tmp_path):
    from pitsignal.sinks.workbook import write_lines

    stem = F.when(F.col("id") % 2 == 0, "T-1").otherwise("T-2")
    lines = spark.range(0, 35_000, 1, 1).select(
        stem.alias("stem"), F.lit("csv").alias("extension"), F.lit("head").alias("header"), F.col("id").cast("string").alias("line"))
    for folder, held, n in (("one", 32 << 20, 2), ("more", 1, 8)):
        assert write_lines(lines, f"{tmp_path}/{folder}", held) == 35_000
        found = sorted(os.listdir(tmp_path / folder))
        assert len(found) == n
        read = {t: [] for t in ("T-1", "T-2")}
        for name in found:
            head, *rest = (tmp_path / folder / name).read_text().removesuffix("\n").split("\n")
            assert head == "head"
            read[name[:3]] += map(int, rest)
        assert read == {"T-1": list(range(0, 35_000, 2)), "T-2": list(range(1, 35_000, 2))}


def opened_sheet(path, sheet):
    """A workbook of one sheet with shared texts and a date style, open."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>uno</t></si><si><r><t>d</t></r><r><t>os</t></r></si><si><t></t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("s.xml", sheet)
    return workbook.OpenBook().at(str(path))


def both_ways(opened):
    """Rows, and the fault if there is one, by the parser and by arrays."""
    found = []
    for rows in (lambda: workbook.sheet_rows(opened, "s.xml"), lambda: (
        (int(n), v) for numbers, values in workbook.sheet_arrays(opened, "s.xml") for n, v in zip(numbers, values.to_pylist(), strict=True)
    )):
        got, fault = [], None
        try:
            got.extend(rows())
        except Exception as e:
            fault = f"{type(e).__name__}: {e}"
        found.append((got, fault))
    return found


CELLS = [
    '<c r="A{r}"><v>17</v></c><c r="B{r}"><v>3.50</v></c>', '<c r="B{r}" t="s"><v>0</v></c><c r="AC{r}" s="1" t="s"><v>1</v></c><c r="AD{r}" t="s"><v>2</v></c>',
    '<c r="C{r}"/><c r="D{r}" s="0"/><c r="E{r}"></c>', '<c r="B{r}"><v>9</v></c><c r="A{r}"><v>8</v></c><c r="D{r}"><v>7</v></c>',
    '<c r="A{r}" t="inlineStr"><is><t xml:space="preserve"> x &amp;&lt;y&gt; &quot;ñ日&apos; </t></is></c>', '<c t="inlineStr" r="A{r}"><is><t>z</t></is></c>',
    '<c r="A{r}" s="1"><v>45000.5</v></c><c r="B{r}" t="b"><v>1</v></c><c r="C{r}" t="b"><v>0</v></c><c r="D{r}" t="e"><v>#N/A</v></c>', "",
    '<c r="A{r}" t="str"><f>B1&amp;"q"</f><v>q</v></c>', '<c r="A{r}" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c>',
    '<c r="A{r}"><v></v></c><c r="ZZ{r}"><v>1</v></c><c r="AAA{r}" t="inlineStr"><is><t></t></is></c>', '<c r="A{r}" t="str"><v>&#65;</v></c>', '<c><v>5</v></c>',
    '<c r="A{r}" t="str"><v>a\r\nb</v></c>', '<c r="A{r}" t="inlineStr"><is><t>one\n&amp;amp;\ttwo</t></is></c>', '<c r="a{r}"><v>6</v></c>',
]
HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="m"><dimension ref="A1"/><sheetData>'
TAIL = '</sheetData><pageMargins left="0.7"/></worksheet>'


@pytest.mark.parametrize("chunk", [50, 1 << 18])
def test_sheets_read_as_arrays_equal_the_parser(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(workbook, "_CHUNK", chunk)
    rows = [f'<row r="{r}"{" spans=" + chr(34) + "1:9" + chr(34) if r % 2 else ""}>{c.format(r=r)}</row>' for r, c in enumerate(CELLS, 3)]
    for k, body in enumerate([*rows, "".join(rows[:8]), "".join(rows), "", '<row r="4"/>', f"<row>{CELLS[0]}</row>", " " + rows[0]]):
        by_parser, by_arrays = both_ways(opened_sheet(tmp_path / f"{k}.xlsx", HEAD + body + TAIL))
        assert by_arrays == by_parser and by_parser[1] is None
    # Faults are found at the same row, with the same report.
    for k, text in enumerate([
        HEAD + rows[0] + rows[1], HEAD + rows[0] + "</sheetData>", HEAD + rows[0] + rows[1].replace("</c>", "</d>") + TAIL, HEAD + rows[0] + "\x01" + TAIL,
        HEAD + rows[0] + rows[1].replace("<v>1<", "<v>9<") + TAIL, HEAD + rows[0] + rows[4].replace("&amp;", "&no;") + TAIL, HEAD + rows[0] + "x]]>" + TAIL,
        HEAD + rows[0] + rows[0].replace('r="A3"', 'r="A3" r="B3"') + TAIL, HEAD.replace("<dimension", "<dim ension") + rows[0] + TAIL, "", "<worksheet><sheetData>",
        HEAD + '<row r="3"><c r="A3><v>1</v></c></row>' + TAIL, HEAD + '<row r="3"><c r="A3><v>"1"</v></c></row>' + TAIL, HEAD + '<row r="3><c r="A3"><v>1</v></c></row>' + TAIL,
    ]):
        by_parser, by_arrays = both_ways(opened_sheet(tmp_path / f"f{k}.xlsx", text))
        assert by_arrays == by_parser, text


def test_plain_sheets_do_without_the_parser(tmp_path, monkeypatch):
    path = book(tmp_path / "w.xlsx", [("s", [(r, [str(r), None, "x & <y>", "2.5"]) for r in range(1, 500)])])
    opened = workbook.OpenBook().at(str(path))
    part = workbook.sheet_parts(opened.book)[0][1]
    monkeypatch.setattr(workbook, "sheet_rows", lambda *_: pytest.fail("read by the parser"))
    got = [(int(n), v) for numbers, values in workbook.sheet_arrays(opened, part) for n, v in zip(numbers, values.to_pylist(), strict=True)]
    assert got == [(r, [str(r), None, "x & <y>", "2.5"]) for r in range(1, 500)]


def test_pairs_of_ragged_sheets(spark):
    from pitsignal.plans.fuel import stack_value_pairs

    sheets = {("f", 0): [["a"], ["b", None, None], ["c", "d", "e", "f", "g"], [], None, [None, "h", "i"]], ("f", 1): [["a", "b", "c"], ["d", "e", None]], ("g", 0): [["a"], ["b", "c"]]}
    rows = [(f, n, "s", i, v) for (f, n), vs in sheets.items() for i, v in enumerate(vs)]
    got = stack_value_pairs(spark.createDataFrame(rows, "file string, sheet_no int, sheet string, row int, values array<string>"))
    want = set()
    for f, n, s, i, v in rows:
        width = max(len(x or []) for x in sheets[f, n])
        for p in range(width // 2):
            first, second = ([*(v or []), *[None] * width][2 * p : 2 * p + 2])
            if first is not None or second is not None:
                want.add((f, n, s, i, p, first, second))
    assert got.columns == ["file", "sheet_no", "sheet", "row", "pair", "first", "second"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
