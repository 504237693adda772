"""CSV records read by many tasks against the reader that takes whole files, and against a parser."""

from __future__ import annotations

import csv
import io
import random

import pytest

from assayer.sources import records
from assayer.sources.csv import load_layer, read_csv
from assayer.sources.encoding import inspect_files

#: Pieces that are awkward at the end of a block; in UTF-16 the bytes of 'ਅĀ' and 'ĊĀ' hold line breaks.
CELLS = ["a", "", "é", 'say ""x""', "two\nlines", "\n\n", ",", '""', "long " * 12, "ਅĀ", "ਊ਀", "x\r\ny", "漢字一", "\U0001f600", '5" pipe']


def content(seed: int, rows: int, end: str = "\n") -> tuple[str, list[list[str]]]:
    """A file's text and its cells as a parser of the standard library sees them."""
    rng = random.Random(seed)
    lines = ["ID,V,W"]
    for i in range(rows):
        cells = []
        for _ in range(2):
            cell = rng.choice(CELLS)
            plain = not any(c in cell for c in ',\n\r') and not cell.startswith('"') and '""' not in cell
            cells.append(cell if plain and rng.random() < 0.6 else '"' + cell.replace('5"', '5""') + '"')
        lines.append(",".join([str(i), *cells]))
        if rng.random() < 0.1:
            lines.append("")
    text = end.join(lines) + rng.choice(["", end])
    return text, [r for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]


def whole_file_reader(spark, path: str, encoding: str):
    """Spark's own reader of such files, one task for each."""
    name = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32LE", "latin1": "ISO-8859-1"}.get(encoding, "UTF-8")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", name).csv(path)


def bag(df) -> list[tuple]:
    return sorted(tuple(c or "" for c in r) for r in df.collect())


@pytest.fixture
def blocks(spark):
    """Sets how many bytes Spark gives a task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le"])
@pytest.mark.parametrize("seed", range(2))
def test_any_cut_gives_the_same_rows(spark, tmp_path, blocks, encoding, seed):
    end = "\r\n" if seed % 2 else "\n"
    text, rows = content(seed, 20, end)
    path = str(tmp_path / "t.csv")
    mark = "" if encoding.startswith("utf-8") else "﻿"
    (tmp_path / "t.csv").write_bytes((mark + text).encode(encoding))
    expected = sorted(tuple(r) for r in rows)
    if "utf-16" not in encoding and "utf-32" not in encoding:
        # That reader takes line breaks inside fields for line feeds if the file's lines end otherwise.
        one = [tuple(c.replace("\r\n", "\n") for c in r) for r in expected] if seed % 2 else expected
        assert bag(whole_file_reader(spark, path, encoding)) == sorted(one)
    rng = random.Random(seed)
    for size in [10_000_000, rng.randrange(9, 40), rng.randrange(40, 400)]:
        blocks(size)
        wide = "utf-8" if encoding.startswith("utf-8") else encoding[:6]
        found = read_csv(spark, path, ["ID", "V", "W"], wide, multi_line=True)
        assert bag(found) == expected, size


def test_as_many_tasks_as_ranges(spark, tmp_path, blocks):
    for name, encoding in (("a", "utf-8"), ("b", "utf-16")):
        text, rows = content(3, 300)
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        size = (tmp_path / f"{name}.csv").stat().st_size
        blocks(-(-size // 6))
        found = read_csv(spark, str(tmp_path / f"{name}.csv"), ["ID", "V", "W"], encoding, multi_line=True)
        assert found.rdd.getNumPartitions() >= 6
        assert len(found.collect()) == len(rows)


def test_record_over_many_blocks_and_file_that_ends_inside_quotes(spark, tmp_path, blocks):
    long = "\n".join(f"line {i}" for i in range(60))
    (tmp_path / "t.csv").write_text(f'ID,V\n1,"{long}"\n2,b\n3,"open\nto the end')
    for size in (7, 40, 10_000):
        blocks(size)
        found = read_csv(spark, str(tmp_path / "t.csv"), ["ID", "V"], multi_line=True)
        assert bag(found) == [("1", long), ("2", "b"), ("3", "open\nto the end")], size


def test_header_over_many_blocks_and_empty_lines_first(spark, tmp_path, blocks):
    head = '"I\nD","' + "long\n" * 20 + '"'
    (tmp_path / "t.csv").write_text(f'\n\n{head}\n1,"x\ny"\n\n2,z\n')
    for size in (9, 10_000):
        blocks(size)
        found = read_csv(spark, str(tmp_path / "t.csv"), ["ID", "V"], multi_line=True)
        assert bag(found) == [("1", "x\ny"), ("2", "z")], size


def test_change_of_splits_is_noticed(spark, tmp_path, blocks):
    (tmp_path / "t.csv").write_text(content(5, 50)[0])
    blocks(200)
    found = read_csv(spark, str(tmp_path / "t.csv"), ["ID", "V", "W"], multi_line=True)
    blocks(90)
    # The files are listed anew for a new plan only.
    with pytest.raises(Exception, match="changed since"):
        found.select("ID").distinct().collect()


def test_quotes_inside_fields_are_characters(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('ID,V\n1,5" pipe\n2,"6"" pipe"\n3,"",\n4,"a","b"\n')
    (tmp_path / "broken.csv").write_text('ID,V\n1,5" pipe\n2,"6"" \npipe"\n')
    (tmp_path / "even.csv").write_text('ID,V\n1,5" and,"x\ny"\n')
    found = {r["path"].rsplit("/", 1)[1]: r["multi_line"] for r in inspect_files(spark, str(tmp_path)).collect()}
    assert found == {"inch.csv": False, "broken.csv": True, "even.csv": True}
    tables, _ = load_layer(spark, str(tmp_path))
    assert bag(tables["broken"]) == [("1", '5" pipe'), ("2", '6" \npipe')]
    assert bag(tables["inch"])[:2] == [("1", '5" pipe'), ("2", '6" pipe')]


def test_folder_of_both_byte_orders(spark, tmp_path):
    big = tmp_path / "Big"
    big.mkdir()
    (big / "a [1].csv").write_bytes(b"\xff\xfe" + 'ID,V\n1,"x\ny"\n'.encode("utf-16-le"))
    (big / "b{2}.csv").write_bytes(b"\xfe\xff" + "ID,V\n2,é\n".encode("utf-16-be"))
    (big / "c?.csv").write_text('ID,V\n3,"p\nq"\n')
    tables, encodings = load_layer(spark, str(tmp_path))
    assert encodings == {"big": "utf-16,utf-8"}
    assert bag(tables["big"]) == [("1", "x\ny"), ("2", "é"), ("3", "p\nq")]


@pytest.mark.parametrize("seed", range(30))
def test_scan_in_pieces(seed):
    """The state after a text is the same however it is cut."""
    rng = random.Random(seed)
    text = "".join(rng.choice('ab",""') for _ in range(40))
    state = records.scan(text, records.FIELD)
    for at in range(len(text) + 1):
        assert records.scan(text[at:], records.scan(text[:at], records.FIELD)) == state
