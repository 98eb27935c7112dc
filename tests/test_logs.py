"""Log folders: records over several lines and blocks, names of all kinds, types of a whole folder."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from thermoband.plans import queries
from thermoband.sources import logs, types

SCHEMA = "id bigint, note string, temp double"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def by_csv(text):
    """The rows of a file by Python's reader; a line break in quotes is a line feed, NA and empty fields are missing."""
    rows = [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"))) if "".join(r).strip()]
    value = lambda x: None if x in ("NA", "") else x
    return [dict(zip([h.strip().lower() for h in rows[0]], map(value, r), strict=True)) for r in rows[1:] if r != rows[0]]


def read(spark, folder, **options):
    rows = logs.read_log_dir(spark, str(folder), schema(spark), **options).select("id", "note", "temp").collect()
    return sorted(((r.id, r.note, r.temp) for r in rows), key=lambda r: r[0])


def written(rows, header=("id", "note", "temp"), **how):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n", **how)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


NOTES = [
    "plain", "two\nlines", 'a "quoted" word', 'ends with a quote"', '"', '""', "\n", 'line\n"\nbreaks,\n\n"and, commas"', "", "comma, here", "a,\n", '\n",\n', ",", 'x"y', "last\n\n\n",
]


@pytest.mark.parametrize("block", ["64", "200", "1000000"])
def test_records_over_lines_and_blocks(spark, tmp_path, block):
    """Every cut of the files into blocks gives the records that a reader of the whole file finds."""
    rng = random.Random(3)
    want = []
    for f in range(6):
        rows = [(100 * f + k, rng.choice(NOTES), f"{k}.5") for k in range(25)]
        if f == 5:
            rows = [(500 + k, "one line", "1.5") for k in range(25)]  # stays as it lies
        text = written(rows, quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_NONNUMERIC][f % 3])
        (tmp_path / f"f{f}.csv").write_text(text.replace("\n", "\r\n") if f == 4 else text, newline="")
        want += [(int(r["id"]), r["note"], float(r["temp"])) for r in by_csv(text)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted(read(spark, tmp_path), key=str) == sorted(want, key=str)
        lines = logs.log_lines(spark, str(tmp_path))
        if block == "64":
            assert lines.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.min("n")).first()[0] > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_grow_with_the_folder(spark, tmp_path, monkeypatch):
    """A folder is cut into a bounded number of blocks, unless the session's own are smaller; records still lie across them."""
    assert [queries.block_bytes(n << 20, 128 << 20) for n in (1, 16, 1 << 10, 1 << 20)] == [1 << 16, 1 << 16, 4 << 20, 128 << 20]
    assert queries.block_bytes(1 << 40, 16 << 20) == 16 << 20
    monkeypatch.setattr(queries, "BLOCK", 16)
    monkeypatch.setattr(queries, "BLOCKS", 16)
    rows = [(k, NOTES[k % len(NOTES)], f"{k}.5") for k in range(400)]
    (tmp_path / "a.csv").write_text(written(rows), newline="")
    cut = queries._in_blocks(spark, str(tmp_path), lambda: logs.log_lines(spark, str(tmp_path)))
    assert 2 <= cut.select("block").distinct().count() <= 17
    got = queries._in_blocks(spark, str(tmp_path), lambda: logs.read_log_dir(spark, str(tmp_path), schema(spark)))
    assert sorted((r.id, r.note) for r in got.collect()) == [(int(r["id"]), r["note"]) for r in by_csv(written(rows))]


def test_records_are_put_together_once(spark, tmp_path):
    """What is read later, such as the headers, does not put the lines of a record together again."""
    (tmp_path / "a.csv").write_text(written([(1, "two\nlines", "1.5"), (2, "one", "2.5")]), newline="")
    records = logs.log_records(spark, str(tmp_path))
    assert "Window" not in records._jdf.queryExecution().optimizedPlan().toString()
    assert read(spark, tmp_path) == [(1, "two\nlines", 1.5), (2, "one", 2.5)]


def test_quotes_inside_fields_are_plain(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,temp\n1,5" pipe,1\n2,6"" x,2\n3,"he said ""no""",3\n')
    assert read(spark, tmp_path) == [(1, '5" pipe', 1.0), (2, '6"" x', 2.0), (3, 'he said "no"', 3.0)]


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,temp\n1,"never closed,1\n2,x,2\n')
    (tmp_path / "b.csv").write_text("id,note,temp\n1,fine,1\n")
    with pytest.raises(ValueError, match="not closed.*a.csv"):
        read(spark, tmp_path)


def test_a_record_of_too_many_lines_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "MOST_LINES", 20)
    (tmp_path / "a.csv").write_text('id,note,temp\n1,"' + "\n" * 30 + '",1\n')
    with pytest.raises(ValueError, match="more than 20 lines"):
        read(spark, tmp_path)


def test_names_of_all_kinds(spark, tmp_path):
    """Names with an underscore are read, those with a point and folders are not, but for a switch."""
    for name, k in (("_b.csv", 1), (".c.csv", 2), ("d", 3), ("e f=g.CSV", 4), ("sub/h.csv", 5), ("k=v/i.csv", 6), ("_j.txt", 7)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f'id,note,temp\n{k},"n\n{name}",0\n')
    assert [r[0] for r in read(spark, tmp_path)] == [1, 3, 4, 7]
    assert [r[0] for r in read(spark, tmp_path, subfolders=True)] == [1, 3, 4, 5, 6, 7]
    files = {r[0].rpartition("/")[2] for r in logs.log_lines(spark, str(tmp_path)).select("file").distinct().collect()}
    assert {"_b.csv", "_j.txt", "d"} <= files
    assert read(spark, tmp_path / "_b.csv") == [(1, "n\n_b.csv", 0.0)]


def test_only_hidden_names_and_none(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read(spark, tmp_path)
    (tmp_path / "_a.csv").write_text("id,note,temp\n1,x,1\n")
    assert read(spark, tmp_path) == [(1, "x", 1.0)]
    with pytest.raises(FileNotFoundError):
        read(spark, tmp_path / "nothing")


def test_types_of_a_folder(spark, tmp_path):
    """Values of all files are merged; files whose own values are of another kind are told."""
    (tmp_path / "a.csv").write_text("ID,Temp,Site,ok,when,day,none\n1,2,S1,TRUE,2020-01-02 03:04:05,2020-01-02,NA\n2,NA,3,F,2020-01-02T03:04,2020/2/3,\n")
    (tmp_path / "b.csv").write_text('Temp,id,Site,mixed\n2.5e1,3,"S\n2",1\n-.5,4,NA,true\n')
    (tmp_path / "c.csv").write_text("id,day,extra\n12345678901,2020-01-01 00:00:01,x\n")
    (tmp_path / "_d.csv").write_text("id,temp\n")
    got = {r.name: (r.kind, r.n_files, r.n_apart) for r in types.folder_types(spark, str(tmp_path)).collect()}
    assert got == {
        "id": ("double", 4, 2), "temp": ("double", 3, 1), "site": ("text", 2, 0), "ok": ("logical", 1, 0), "when": ("time", 1, 0),
        "day": ("text", 2, 2), "none": ("logical", 1, 0), "mixed": ("text", 1, 0), "extra": ("text", 1, 0),
    }
    apart = types.file_types(spark, str(tmp_path)).where("kind <> merged and name = 'temp'").collect()
    assert [(r.file.rpartition("/")[2], r.kind) for r in apart] == [("a.csv", "integer")]
    learned = types.folder_schema(types.folder_types(spark, str(tmp_path)))
    rows = logs.read_log_dir(spark, str(tmp_path), learned)
    assert dict(rows.dtypes)["temp"] == "double" and dict(rows.dtypes)["when"] == "timestamp_ntz"
    assert sorted(r.temp for r in rows.collect() if r.temp is not None) == [-0.5, 2.0, 25.0]


@pytest.mark.parametrize("text,kind", [
    ("T", "logical"), ("false", "logical"), ("0", "integer"), ("+12", "integer"), ("-7", "integer"), ("1234567890", "double"), ("1.", "double"), ("1e5", "double"), ("Inf", "double"), ("NaN", "double"),
    ("1e", "text"), ("2020-13-01", "text"), ("2020-1-9", "date"), ("2020/12/31", "date"), ("2020-01-01 24:00", "time"), ("2020-01-01 7:05:09.25Z", "time"), ("7:05", "text"), ("x", "text"), (" 5 ", "integer"),
])
def test_kinds_of_values(spark, text, kind):
    row = spark.createDataFrame([(text,)], "t string").select(types.kind_bit(F.col("t")).alias("b"))
    assert row.first().b == types.BITS[kind]
