"""Readers and writers."""

import json
import zipfile

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import tabloom as tl
from tabloom import registry
from tabloom.sources import writers
from tabloom.sources.readers import find_row_tag, sniff_separator


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_separator():
    assert sniff_separator("a;b,c\td") == "\t" and sniff_separator("a;b,c") == ";" and sniff_separator("a b") == ","


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv(spark, tmp_path, sep):
    rows = [["id", "name", "x", "ok", "day", "void"], ["1", "\"a, \"\"b\"\"; c\"", "1.5", "True", "2024-01-01", ""],
            ["2", "NA", "", "FALSE", "2024-02-01", "N/A"], ["03", "ção", "1e3", "true", "2024-03-01", "null"]]
    df = tl.load_table(spark, write(tmp_path / "T.CSV", "﻿" + "\n".join(sep.join(r) for r in rows) + "\n"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("ok", "boolean"), ("day", "string"),
                         ("void", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "a, \"b\"; c", 1.5, True, "2024-01-01", None), (2, None, None, False, "2024-02-01", None),
        (3, "ção", 1000.0, True, "2024-03-01", None)]


def test_repeated_and_missing_names(spark, tmp_path):
    df = tl.read_csv(spark, write(tmp_path / "n.csv", "id,,id,a.b\n1,2,3,4\n"))
    assert df.columns == ["id", "_c1", "id_2", "a.b"] and tuple(df.first()) == (1, 2, 3, 4)
    assert tl.clean_headers(df).columns == ["id", "column_2", "id_2", "a_b"]
    assert ("_c1", "unnamed_header") in {(r.column, r.issue) for r in tl.quality_report(df).collect()}
    assert tl.clean_table(df).count() == 1


def test_numbers_too_large_stay_text(spark, tmp_path):
    df = tl.read_csv(spark, write(tmp_path / "a.csv", "n\n123456789012345678901234567890\n5\n"))
    assert df.dtypes == [("n", "string")]


def test_unsupported(spark):
    with pytest.raises(ValueError, match=r"\.xls'"):
        tl.load_table(spark, "/tmp/a.xls")
    with pytest.raises(ValueError):
        tl.save_table(spark.range(1), "/tmp/never", "xlsx")


def test_header_over_several_rows(spark, tmp_path):
    text = "Person,,Visit,\nName,Age,Date,\nAna,30,2024-01-01,x\nBo,41,2024-01-02,y\nName,Age,Date,\n"
    df = tl.read_csv_under_header(spark, write(tmp_path / "h.csv", text), 2)
    assert df.columns == ["person_name", "person_age", "visit_date", "visit"]
    assert [tuple(r) for r in df.orderBy("person_age").collect()] == [("Ana", 30, "2024-01-01", "x"),
                                                                     ("Bo", 41, "2024-01-02", "y")]


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"post": "a", "date": 1717200000000, "likes": 3, "created_at": 1717200000},
            {"post": "b", "date": 1717286400000, "likes": None, "created_at": 1717286400}]
    for name, text in (("a.json", json.dumps(rows, indent=2)), ("b.json", "\n".join(map(json.dumps, rows)))):
        df = tl.load_table(spark, write(tmp_path / name, text))
        assert df.dtypes == [("post", "string"), ("date", "timestamp_ntz"), ("likes", "bigint"),
                             ("created_at", "timestamp_ntz")]
        first = df.orderBy("post").first()
        assert str(first.date) == "2024-06-01 00:00:00" and first.date == first.created_at


def test_json_dates_by_name_only_when_they_fit(spark, tmp_path):
    df = tl.read_json(spark, write(tmp_path / "c.json", '{"date": 5, "start_time": "2024-01-02", "modified": "soon"}\n'
                                                        '{"date": 6, "start_time": "03/04/2024", "modified": "late"}'))
    assert df.dtypes == [("date", "bigint"), ("start_time", "timestamp_ntz"), ("modified", "string")]


def test_column_oriented_json_is_refused(spark, tmp_path):
    path = write(tmp_path / "d.json", '{"a": {"0": 1, "1": 2}, "b": {"0": 3, "1": 4}}')
    with pytest.raises(ValueError, match="column-oriented"):
        tl.read_json(spark, path)


def test_xml(spark, tmp_path):
    text = ('<?xml version="1.0"?>\n<!-- rows --><shop>\n<item id="1"><name>a &amp; b</name><price>1.5</price></item>\n'
            '<item id="2"><name>c</name><price/></item>\n</shop>\n')
    df = tl.load_table(spark, write(tmp_path / "e.xml", text))
    assert sorted(df.columns) == ["id", "name", "price"]
    assert [(r.id, r.name, r.price) for r in df.orderBy("id").collect()] == [(1, "a & b", 1.5), (2, "c", None)]
    assert find_row_tag(["<a/>"]) is None


def workbook(path, rows, dates=()):
    """A minimal workbook: shared strings, numbers, booleans and dates of style 1."""
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, value in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if value is None:
                continue
            if isinstance(value, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, str):
                shared.append(value)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"{" s=" + chr(34) + "1" + chr(34) if j in dates else ""}><v>{value}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets>'
                                      '</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                                                 '</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
                                    '</styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>{"".join(body)}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    head = ["emp_id", "name", "hired", "remote", "salary", None, "name"]
    workbook(tmp_path / "a.xlsx", [head, [1, "Ana", 45292, True, 10.5, None, "x"], [2, None, 45293.5, False, 20, None, "y"]],
             (2,))
    workbook(tmp_path / "b.xlsx", [head, [3, "Bo", 45294, True, 30, "z", "w"]], (2,))
    df = tl.load_table(spark, str(tmp_path), "xlsx")
    assert df.dtypes == [("emp_id", "bigint"), ("name", "string"), ("hired", "string"), ("remote", "boolean"),
                         ("salary", "double"), ("Unnamed: 5", "string"), ("name.1", "string")]
    rows = [tuple(r) for r in df.orderBy("emp_id").collect()]
    assert rows[0] == (1, "Ana", "2024-01-01 00:00:00", True, 10.5, None, "x")
    assert rows[1][1:4] == (None, "2024-01-02 12:00:00", False) and rows[2][5] == "z"
    assert tl.load_table(spark, str(tmp_path / "a.xlsx")).count() == 2
    workbook(tmp_path / "c.xlsx", [["other"], [1]])
    with pytest.raises(ValueError, match="different headers"):
        tl.load_table(spark, str(tmp_path), "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "xml", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a\"b, c;d", 1.5, True), (2, "x\ty", None, False)],
                               "i long, s string, x double, b boolean")
    tl.save_table(df, str(tmp_path / "t"), fmt)
    options = {"row_tag": "row"} if fmt == "xml" else {}
    back = tl.load_table(spark, str(tmp_path / "t"), fmt, **options).select("i", "s", "x", "b")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_line_breaks_in_cells(spark, tmp_path):
    """Only files with such cells are read whole; a row is a row either way."""
    text = "id,A,a\n1,\"one\ntwo, \"\"three\"\"\n\",x\n2,plain,y\n"
    folder = tmp_path / "two words"
    folder.mkdir()
    write(folder / "a.csv", text)
    write(folder / "b.csv", "id,A,a\n3,more,z\n")
    write(folder / "0.csv", "")
    df = tl.load_table(spark, str(folder), "csv")
    assert df.columns == ["id", "A", "a_2"]
    assert sorted(map(tuple, df.collect())) == [(1, 'one\ntwo, "three"\n', "x"), (2, "plain", "y"), (3, "more", "z")]
    back = str(tmp_path / "out")
    tl.save_table(df, back, "tsv")
    assert sorted(map(tuple, tl.load_table(spark, back, "tsv").collect())) == sorted(map(tuple, df.collect()))


def test_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    task = F.udf(lambda _: TaskContext.get().partitionId(), "long")
    docs = spark.range(0, 900, 1, 9).select(F.col("id").alias("doc_id"), F.concat(F.lit('say "hi",\n'), "id").alias("text"),
                                            task("id").alias("task"))
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    back = registry.QUERIES["csv_one_file_documents"](spark, str(tmp_path))
    assert len(back.inputFiles()) <= 1
    assert [tuple(r) for r in back.orderBy("doc_id").collect()] == [(i, f'say "hi",\n{i}', i // 100) for i in range(900)]


@pytest.mark.parametrize("fmt, sep", [("csv", ","), ("tsv", "\t")])
def test_one_file_is_what_one_task_writes(spark, tmp_path, monkeypatch, fmt, sep):
    """Byte by byte, empty partitions and files that several tasks copy among them."""
    monkeypatch.setattr(writers, "_PIECE", 50)
    df = spark.range(0, 300, 1, 40).filter("id % 8 <> 3 and id not between 40 and 90").select(
        "id", F.when(F.col("id") % 5 > 0, F.concat(F.lit(' ção, "\n\t'), "id")).alias('a "b",\tc'),
        F.col("id").cast("timestamp").alias("at"))
    for name, rows in (("some", df), ("none", df.filter("id < 0"))):
        tl.save_table(rows.coalesce(1), str(tmp_path / f"{name}1"), fmt)
        tl.save_one_file(rows, str(tmp_path / name), fmt)
        (one,), (other,) = ([f for f in (tmp_path / x).iterdir() if f.name[0] not in "._"] for x in (f"{name}1", name))
        assert one.read_bytes() == other.read_bytes()
        assert {f.name for f in (tmp_path / name).iterdir()} <= {other.name, "_SUCCESS", "._SUCCESS.crc"}
    with pytest.raises(ValueError):
        tl.save_one_file(df, str(tmp_path / "x"), "xml")
    with pytest.raises(Exception, match="already exists"):
        tl.save_one_file(df, str(tmp_path / "some"), fmt)


def test_json_lines_after_a_long_record(spark, tmp_path):
    """What a file is rests on whole lines, however long the first one is."""
    rows = [{"z": 1, "text": 'x "a": ' * 30_000, "b": 2, "a": 3}, {"z": 4, "text": "short", "b": 5, "a": 6}]
    for name, first in (("l.json", rows), ("one.json", rows[:1])):
        df = tl.load_table(spark, write(tmp_path / name, "\ufeff" + "\n".join(map(json.dumps, first)) + "\n"))
        assert df.columns == ["z", "text", "b", "a"]
        assert [r.asDict() for r in df.orderBy("z").collect()] == first


def test_csv_with_a_long_header(spark, tmp_path):
    names = [f"{letter * 30_000}_{letter}" for letter in "abcde"]
    path = write(tmp_path / "w.csv", ",".join(names) + "\n1,2,3,4,5\n")
    for df in (tl.read_csv(spark, path), tl.read_csv_under_header(spark, path)):
        assert df.columns == names
        assert [tuple(r) for r in df.collect()] == [(1, 2, 3, 4, 5)]
