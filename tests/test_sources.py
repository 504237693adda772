"""CSV folders, encodings, sinks and table maintenance."""

from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from assayer import wholesale
from assayer.operators import maintenance, profiling
from assayer.plans.scorecard import scorecard
from assayer.operators.staging import stage_layer
from assayer.sources.csv import list_tables, load_layer, load_wholesale, read_csv
from assayer.sources.encoding import detect_encodings
from assayer.sources.sinks import (
    read_layer,
    read_version,
    write_csv,
    write_dictionaries,
    write_dictionary_index,
    write_layer,
    write_report,
    write_version,
)

BODY = 'ItemID,Item Name,PayDate\n1,"Ärmel, ""lang""",7/1/2003\n2,,\n3,"–",\n'


@pytest.fixture
def folder(tmp_path):
    files = {
        "Plain": BODY.encode("utf-8"),
        "Marked": BODY.encode("utf-8-sig"),
        "WideFile": BODY.encode("utf-16"),
        "Western": BODY.encode("cp1252"),
        "Odd": BODY.replace("–", "\x81").encode("latin1"),
        "Wide32": BODY.encode("utf-32"),
        "Big Endian": b"\xfe\xff" + BODY.encode("utf-16-be"),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    (tmp_path / "notes.txt").write_text("not a table")
    return str(tmp_path)


ENCODINGS = {
    "plain": "utf-8",
    "marked": "utf-8-sig",
    "wide_file": "utf-16",
    "western": "cp1252",
    "odd": "latin1",
    "wide32": "utf-32",
    "big_endian": "utf-16",
}


def test_encodings(spark, folder):
    found = {t: source.encodings for t, source in list_tables(spark, folder).items()}
    assert found == {t: [e] for t, e in ENCODINGS.items()}


@pytest.mark.parametrize("block", ["128m", "16"])
def test_encodings_of_split_files(spark, tmp_path, block):
    """The same answers whatever the number of tasks that read a file."""
    long = BODY + "".join(f"{i},é{i},\n" for i in range(40))
    expected = {}
    for name, encoding in {"a": "utf-8", "b": "utf-8-sig", "c": "cp1252", "d": "utf-16"}.items():
        for end in ("", "\n"):
            path = tmp_path / f"{name}{len(end)}.csv"
            path.write_bytes((long.rstrip() + end).encode(encoding))
            expected[path.name] = encoding
    # Begins like a mark of UTF-16, and has no zero byte.
    (tmp_path / "e.csv").write_bytes(b"\xff\xfeA,B\n1,2\n")
    (tmp_path / "f.csv").write_bytes(b"A,B\n\xff\xfe,2\n" * 20)
    (tmp_path / "empty.csv").write_bytes(b"")  # which Spark's readers leave out
    expected |= {"e.csv": "utf-16", "f.csv": "cp1252"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = detect_encodings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in found} == expected


def test_load_layer(spark, folder):
    tables, encodings = load_layer(spark, folder)
    assert encodings == ENCODINGS
    for name, df in tables.items():
        assert set(dict(df.dtypes).values()) == {"string"}, name
        dash = "\x81" if name == "odd" else "–"
        rows = [tuple(r) for r in df.orderBy(df.columns[0]).collect()]
        assert rows == [
            ("1", 'Ärmel, "lang"', "7/1/2003"),
            ("2", None, None),
            ("3", dash, None),
        ], name


def test_tables_of_many_files(spark, tmp_path):
    """A subfolder is a table; its files may differ in encoding."""
    for name, encoding in {"a": "utf-8", "b": "utf-16", "c": "utf-8"}.items():
        (tmp_path / "BigTable").mkdir(exist_ok=True)
        (tmp_path / "BigTable" / f"{name} 1+1.csv").write_text(f"ID,V\n{name},ä\n", encoding)
    tables, encodings = load_layer(spark, str(tmp_path) + "/")
    assert encodings == {"big_table": "utf-16,utf-8"}
    rows = sorted(map(tuple, tables["big_table"].collect()))
    assert rows == [("a", "ä"), ("b", "ä"), ("c", "ä")]


def test_known_encoding_opens_no_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X\nä\n", "latin1")
    tables, encodings = load_layer(spark, str(tmp_path), encoding="latin1")
    assert encodings == {"a": "latin1"} and tables["a"].first()["X"] == "ä"


def test_folder_with_anything_in_it(spark, tmp_path):
    """Files at any depth, in two orders of columns, some with line breaks, and no others."""
    big = tmp_path / "Big"
    (big / "deep" / "er").mkdir(parents=True)
    (big / "a.csv").write_text("ID,V\n1,x\n")
    (big / "deep" / "b.csv").write_text("V,ID\ny,2\n")
    (big / "deep" / "er" / "c.csv").write_text('ID,V\n3,"two\nlines, ""quoted"""\n')
    (big / "d.csv").write_text("ID,W\n4,w\n", "utf-16")
    (big / "notes.txt").write_text("note\n1\n")
    tables, encodings = load_layer(spark, str(tmp_path))
    assert encodings == {"big": "utf-16,utf-8"}
    rows = sorted(tuple(r) for r in tables["big"].select("ID", "V", "W").fillna("-").collect())
    assert rows == [
        ("1", "x", "-"),
        ("2", "y", "-"),
        ("3", 'two\nlines, "quoted"', "-"),
        ("4", "-", "w"),
    ]


def test_broken_row_is_an_error_where_nothing_is_discovered(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,V\n1,"x\ny"\n2,z\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_layer(spark, str(tmp_path), encoding="utf-8")[0]["a"].collect()
    told, _ = load_layer(spark, str(tmp_path), encoding="utf-8", multi_line=True)
    found, _ = load_layer(spark, str(tmp_path))
    for tables in (told, found):
        assert sorted(map(tuple, tables["a"].collect())) == [("1", "x\ny"), ("2", "z")]


def test_csv_gives_back_what_was_written(spark, tmp_path):
    cells = ["  a ", "\tq", "q", 'say "x", y', "two\nlines", " ", "", None, "\\", "é"]
    rows = [(str(i), c, cells[-1 - i]) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "k string, v string, w string")
    write_csv(df, str(tmp_path / "exact" / "t"), exact=True)
    write_csv(df, str(tmp_path / "plain" / "t"))
    exact, _ = load_layer(spark, str(tmp_path / "exact"), exact=True)
    plain, _ = load_layer(spark, str(tmp_path / "plain"))
    assert sorted(map(tuple, exact["t"].collect())) == rows
    assert sorted(map(tuple, plain["t"].collect())) == [tuple(c or None for c in r) for r in rows]


def test_one_column_keeps_its_rows(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("",), (None,)], "v string")
    write_csv(df, str(tmp_path / "t"))
    back = load_layer(spark, str(tmp_path))[0]["t"]
    assert sorted(r["v"] or "" for r in back.collect()) == ["", "", "", "a"]


def test_selection(spark, folder):
    assert set(list_tables(spark, folder, only=["PLAIN.CSV", "odd"])) == {"plain", "odd"}
    assert "odd" not in list_tables(spark, folder, skip=["Odd"])


def test_null_tokens_and_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("A,B\nNA,1\nx,\n")
    df = read_csv(spark, str(path), ["A", "B"], null_tokens=["NA"])
    assert [tuple(r) for r in df.collect()] == [(None, "1"), ("x", None)]


def test_wholesale_raw_layer(spark, tmp_path):
    (tmp_path / "customers.csv").write_bytes(
        (",".join(wholesale.RAW_COLUMNS["customers"]) + "\n1,Ann,,,,,,0\n").encode("utf-16")
    )
    (tmp_path / "suppliers.csv").write_text("SupplierID,SupplierName\n1.0, S1 \n")
    paths = {t: str(tmp_path / f"{t}.csv") for t in ("customers", "suppliers")}
    raw = load_wholesale(spark, paths)
    staged = stage_layer(raw)
    assert tuple(staged["suppliers"].first()) == ("1", "S1")
    card = {r["table_name"]: r for r in scorecard(staged, wholesale.CHECKS).collect()}
    assert (card["customers"]["col_count"], card["customers"]["null_cells"]) == (8, 5)
    assert list(load_wholesale(spark, paths, skip=["customers"])) == ["suppliers"]


def test_wholesale_model():
    assert len(wholesale.RAW_COLUMNS) == len(wholesale.PRIMARY_KEYS) == 11
    assert len(wholesale.RELATIONS) == 12


def test_write_modes(spark, tmp_path):
    layer = {"t": spark.createDataFrame([(1,)], "a int")}
    out = str(tmp_path / "clean")
    write_layer(layer, out)
    write_layer(layer, out, "append")
    assert read_layer(spark, out, ["t"])["t"].count() == 2
    write_layer(layer, out, "replace")
    assert read_layer(spark, out, ["t"])["t"].count() == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        write_layer(layer, out, "fail")


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([("b", dt.date(2003, 1, 2)), ('a "x"', None)], "k string, d date")
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect()), key=str) == [('a "x"', None), ("b", "2003-01-02")]
    write_report(df, str(tmp_path / "report"), ["k"])
    (file,) = glob.glob(str(tmp_path / "report" / "*.csv"))
    assert open(file).read().splitlines()[0] == "k,d"
    assert open(file).read().splitlines()[2].startswith("b,")


def test_dictionary_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "v string, w string")
    dictionary = profiling.value_dictionary(df, ["v", "w"], "t")
    write_dictionaries(dictionary, str(tmp_path / "d"))
    write_dictionary_index(dictionary, str(tmp_path / "index"))
    index = spark.read.option("header", True).csv(str(tmp_path / "index")).collect()
    assert [(r["column_name"], r["total_rows"], r["top_value"]) for r in index] == [
        ("v", "3", "b"),
        ("w", "3", "x"),
    ]
    back = spark.read.option("header", True).csv(str(tmp_path / "d"))
    got = {(r["column_name"], r["col_value"], r["cnt"]) for r in back.collect()}
    assert got == {("v", "b", "2"), ("v", "a", "1"), ("w", "x", "2"), ("w", "y", "1")}


def test_dictionary_keeps_white_space(spark, tmp_path):
    df = spark.createDataFrame([("\tq",), ("q",)], "v string")
    write_dictionaries(profiling.value_dictionary(df, ["v"], "t"), str(tmp_path / "d"))
    back = spark.read.option("header", True).csv(str(tmp_path / "d"))
    assert sorted(r["col_value"] for r in back.collect()) == ["\tq", "q"]


def test_versions_of_an_upserted_table(spark, tmp_path):
    folder = str(tmp_path / "card")
    assert read_version(spark, folder) is None
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write_version(one, folder)
    two = spark.createDataFrame([("b", 3)], "k string, v int")
    write_version(maintenance.upsert(read_version(spark, folder), two, ["k"]), folder)
    assert sorted(map(tuple, read_version(spark, folder).collect())) == [("a", 1), ("b", 3)]
    broken = one.withColumn("v", F.raise_error(F.lit("half way")).cast("int"))
    with pytest.raises(Exception, match="half way"):
        write_version(broken, folder)
    assert sorted(map(tuple, read_version(spark, folder).collect())) == [("a", 1), ("b", 3)]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, "x"), ("c", 4, "y")], "k string, v int, more string")
    rows = sorted(map(tuple, maintenance.upsert(old, new, ["k"]).collect()))
    assert rows == [("a", 1, None), ("b", 3, "x"), ("c", 4, "y")]
    rows = sorted(map(tuple, maintenance.insert_if_absent(old, new, ["k"]).collect()))
    assert rows == [("a", 1, None), ("b", 2, None), ("c", 4, "y")]


def test_load_summary(spark):
    layer = {t: spark.range(n).toDF("x") for t, n in {"a": 3, "b": 0, "c": 4}.items()}
    rows = sorted(map(tuple, maintenance.load_summary(layer, "raw").collect()))
    assert rows == [("raw", "a", 3, 7), ("raw", "b", 0, 7), ("raw", "c", 4, 7)]
