"""Records over line ends and splits, against readers that see a whole file."""

import csv
import io
import json
import random
from collections import Counter

import pytest

import tabloom as tl
from tabloom.sources import splits


@pytest.fixture
def small_splits(spark):
    """Files are cut every 200 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def tasks(spark, path):
    return spark.read.text(path).rdd.getNumPartitions()


def cells(rng):
    pool = ["plain", "", 'say "hi"', "a,b", "two\nlines", "\n", '"', "ção 😀", 'x\r\ny', '5" disk', "tab\there", "x" * 300,
            'long "quoted"\n' * 30, " lead", "trail ", '",', ',"']
    return rng.choice(pool)


@pytest.mark.parametrize("seed", range(4))
def test_csv_in_small_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    rows = [[str(i), cells(rng), cells(rng), cells(rng)] for i in range(300)]
    text = io.StringIO(newline="")
    csv.writer(text, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]),
               lineterminator=rng.choice(["\n", "\r\n"])).writerows([["id", "a", 'b "x"\ny', "c"], *rows])
    path = tmp_path / "t.csv"
    path.write_text("﻿" + text.getvalue(), encoding="utf-8", newline="")
    df = tl.read_csv(spark, str(path), sep=",", infer=False)
    assert df.columns == ["id", "a", 'b "x"\ny', "c"]
    assert tasks(spark, str(path)) > 20
    expected = [tuple(c or None for c in r) for r in rows]
    assert sorted(map(tuple, df.collect()), key=lambda r: int(r[0])) == expected


def test_stray_quotes_stay_text(spark, tmp_path, small_splits):
    lines = ["id,size,note", *(f'{i},5" disk,it is {i}"' if i % 2 else f'{i},"a ""b""\n{i}",plain' for i in range(100))]
    path = tmp_path / "s.csv"
    path.write_text("\n".join(lines) + "\n")
    got = {r["id"]: (r["size"], r["note"]) for r in tl.read_csv(spark, str(path)).collect()}
    assert got == {i: ('5" disk', f'it is {i}"') if i % 2 else (f'a "b"\n{i}', "plain") for i in range(100)}


def test_columns_go_by_name(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,one\n"), ("b.csv", "y,x\ntwo,2\n\"th\nree\",3\n"), ("c.csv", "\n\nz,x\nlast,4\n"),
                       ("d.csv", ""), ("e.csv", "x,y\n5,five\n")):
        (tmp_path / name).write_text(text)
    df = tl.load_table(spark, str(tmp_path), "csv")
    assert df.dtypes == [("x", "bigint"), ("y", "string"), ("z", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "one", None), (2, "two", None), (3, "th\nree", None), (4, None, "last"),
                                                (5, "five", None)]


def test_header_rows_with_line_breaks(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"Per\nson",,Visit\nName,Age,Date\n"a\nb",1,x\n"c ""d""",2,"y\n\nz"\n')
    df = tl.read_csv_under_header(spark, str(tmp_path / "h.csv"), 2)
    assert df.columns == ["per_son_name", "per_son_age", "visit_date"]
    assert sorted(map(tuple, df.collect())) == [("a\nb", 1, "x"), ('c "d"', 2, "y\n\nz")]


def value(rng, depth=0):
    pool = ["plain", 'br{ace}s ["in"] text', "back\\slash\\", "\\", "}", '"', " ção\n😀", "{" * 50, 1, -2.5, None, True]
    if depth < 3 and rng.random() < 0.3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else \
            {k: value(rng, depth + 1) for k in rng.sample("pqr", rng.randint(0, 3))}
    return rng.choice(pool)


def layouts(rows, rng):
    return {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows), "indented": json.dumps(rows, indent=2),
            "objects": "\n".join(json.dumps(r, indent=1) for r in rows), "glued": "".join(map(json.dumps, rows)),
            "arrays": "\n".join(json.dumps(rows[i:i + 7], indent=rng.choice([None, 3])) for i in range(0, len(rows), 7))}


@pytest.mark.parametrize("layout", ["array", "indented", "objects", "glued", "arrays"])
def test_json_records_in_small_splits(spark, tmp_path, small_splits, layout):
    rng = random.Random(layout)
    rows = [{"id": i, "v": value(rng), "w": value(rng)} for i in range(120)]
    text = layouts(rows, rng)[layout]
    for end in ("", "\n", " \r\n\n"):
        path = tmp_path / f"{layout}{len(end)}.json"
        path.write_text("﻿ \n" + text + end, encoding="utf-8")
        got = splits.records(spark, [str(path)], splits.JsonScanner()).collect()
        assert tasks(spark, str(path)) > 10
        assert Counter(json.dumps(json.loads(r["record"])) for r in got) == Counter(map(json.dumps, rows))


def test_json_layouts_of_one_folder(spark, tmp_path, small_splits):
    rng = random.Random(1)
    rows = [{"id": i, "text": rng.choice(["a}b", "{", "two\nlines", 'q"q']) * 9, "x": i / 4, "many": [{"k": i}]} for i in range(120)]
    for k, (name, _) in enumerate(layouts(rows, rng).items()):
        (tmp_path / f"{name}.json").write_text(layouts(rows[k * 20:k * 20 + 20], rng)[name] + "\n")
    (tmp_path / "empty.json").write_text("")
    df = tl.load_table(spark, str(tmp_path), "json")
    assert df.dtypes == [("id", "bigint"), ("text", "string"), ("x", "double"), ("many", "array<struct<k:bigint>>")]
    assert [r.asDict(recursive=True) for r in df.orderBy("id").collect()] == rows


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '{"a":\n1}\n{"a": 2', '{"a":\n"x}', '[{"a": 1}, 5]', "[1, 2]", '{"a": 1}\nnot json',
                                  '{"a":\n1}\n[{"a": 2}]'])
def test_json_that_cannot_be_read_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="ends inside a value|between them|must all stand|only JSON records"):
        tl.read_json(spark, str(path)).collect()
