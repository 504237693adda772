"""CSV files as records, split over tasks although fields hold line breaks or characters are wide.

Spark's text reader splits a file at line breaks, whatever these bytes are. A task that
starts inside a file does not know whether its first line starts a record, goes on inside
quotes, or, as the bytes of a line break can also lie across two wide characters, starts
inside a character. So files are read twice. The first time every block of a file tells
where it would end for each state it could start in; composed block by block, these tell
every block its true start. The second time records are put together from there, and the
few that lie across blocks are joined by the block they begin in.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- the state of a reader ----------------------------------------------------------

#: At a field's start, inside quotes, inside a field without, or after a quote inside quotes.
FIELD, QUOTED, PLAIN, AFTER = range(4)


def scan(text: str, state: int) -> int:
    """The state after a piece of a line. A quote counts only where it starts a field."""
    i, n = 0, len(text)
    while True:
        if state in (FIELD, AFTER):
            if i == n:
                return state
            if text[i] == '"':
                state, i = QUOTED, i + 1
        if state == QUOTED:
            i = text.find('"', i)
            while i >= 0 and text[i + 1 : i + 2] == '"':
                i = text.find('"', i + 2)
            if i < 0:
                return QUOTED
            i += 1
            if i == n:
                return AFTER
        i = text.find(",", i)
        if i < 0:
            return PLAIN
        state, i = FIELD, i + 1


@dataclass(frozen=True)
class Units:
    """How characters are stored: Python's name of the encoding, and bytes a character at least."""

    codec: str
    width: int

    @classmethod
    def of(cls, encoding: str, big_endian: bool) -> Units:
        name = codecs.lookup(encoding).name.removesuffix("-sig")
        order = "-be" if big_endian else "-le"
        for wide, width in (("utf-16", 2), ("utf-32", 4)):
            if name.startswith(wide):
                return cls(name + order if name == wide else name, width)
        return cls(name, 1)

    @property
    def line_break(self) -> bytes:
        return "\n".encode(self.codec)

    @property
    def java_name(self) -> str:
        return self.codec.upper().replace("-LE", "LE").replace("-BE", "BE") if self.width > 1 else "UTF-8"

    def unmarked(self, first: bytes) -> bytes:
        """A file's first line without its byte order mark; Spark's reader drops that of UTF-8."""
        return first.removeprefix("\ufeff".encode(self.codec)) if self.width > 1 else first

    def text(self, piece: bytes, skip: int) -> str:
        """The whole characters of a piece of a line that starts `skip` bytes into a character."""
        if self.width == 1:
            return piece.decode("latin-1")
        start = -skip % self.width
        end = start + (len(piece) - start) // self.width * self.width
        return piece[start:end].decode(self.codec, "replace") if end > start else ""

    def starts(self) -> list[tuple[int, int]]:
        """States a block can start in: bytes into a character, and the reader's state."""
        return [(0, FIELD), (0, QUOTED), *((a, s) for a in range(1, self.width) for s in (FIELD, QUOTED, PLAIN, AFTER))]

    def step(self, piece: bytes, start: tuple[int, int]) -> tuple[tuple[int, int], bool]:
        """The state after a piece and the line break behind it, and whether a record ended.

        Bytes of a line break that lie across two characters are no line break, and neither
        of those characters is a quote, a comma or a line break.
        """
        skip, state = start
        state = scan(self.text(piece, skip), state)
        skip = (skip + len(piece)) % self.width
        if skip:
            return (skip, QUOTED if state == QUOTED else PLAIN), False
        return ((0, QUOTED), False) if state == QUOTED else ((0, FIELD), True)


# --- blocks -------------------------------------------------------------------------


def _lines(spark: SparkSession, paths: Sequence[str], units: Units, folder: bool) -> DataFrame:
    """(url, block, line) in the order of each file; a block is read by one task."""
    reader = spark.read.option("encoding", units.java_name).option("lineSep", "\n")
    if folder:
        reader = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    return reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _runs(batches) -> Iterator[tuple[str, int, pa.Array]]:
    """Lines of one block that follow each other, out of batches of (url, block, line)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        urls, blocks, lines = batch.columns
        at = np.asarray(blocks)
        same = np.ones(len(at), bool)
        same[0] = False
        same[1:] = (at[1:] == at[:-1]) & np.asarray(pc.equal(urls[1:], urls[:-1]))
        bounds = [*np.flatnonzero(~same), len(at)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield urls[int(a)].as_py(), int(at[a]), lines.slice(int(a), int(b - a))


class _Block:
    """What the first pass learns of a block."""

    def __init__(self, units: Units, url: str, block: int):
        self.units, self.url, self.block = units, url, block
        self.ends = {s: (s, False) for s in units.starts()}
        self.first: bytes | None = None

    def add(self, lines: pa.Array) -> None:
        if self.first is None and self.block == 0:
            self.first = self.units.unmarked(lines[0].as_py())
            self.move([self.first])
            lines = lines[1:]
        if self.units.width == 1:
            # A line without quotes changes no state. It ends a record unless it lies inside
            # one, but that is only asked of starts inside a record, which some quote has ended.
            lines = lines.filter(pc.match_substring(lines, '"'))
        self.move(lines.to_pylist())

    def move(self, pieces: list[bytes]) -> None:
        for piece in pieces:
            moves = {e: self.units.step(piece, e) for e in {e for e, _ in self.ends.values()}}
            self.ends = {s: (moves[e][0], closed or moves[e][1]) for s, (e, closed) in self.ends.items()}

    def row(self) -> dict:
        starts = self.units.starts()
        ends = [self.ends[s] for s in starts]
        return {
            "url": self.url, "block": self.block, "ends": [starts.index(e) for e, _ in ends],
            "closed": [c for _, c in ends], "crlf": (self.first or b"").endswith("\r".encode(self.units.codec)),
        }


_PROFILE = pa.schema(
    [("url", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int32())), ("closed", pa.list_(pa.bool_())), ("crlf", pa.bool_())]
)


def _profiles(lines: DataFrame, units: Units) -> DataFrame:
    """A row per block: its end, and whether a record ends in it, for every state it could start in."""

    def run(batches):
        now = None
        for url, block, part in _runs(batches):
            if now is None or (now.url, now.block) != (url, block):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_PROFILE)
                now = _Block(units, url, block)
            now.add(part)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_PROFILE)

    return lines.mapInArrow(run, "url string, block long, ends array<int>, closed array<boolean>, crlf boolean")


def _starts(profiles: DataFrame) -> DataFrame:
    """(url, block, start, owner, crlf): where each block truly starts, file by file.

    `start` is the number of a state, `owner` the block in which the record begins that the
    block starts inside of.
    """

    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        state, owner, out = 0, -1, []
        for block, ends, closed in zip(blocks["block"], blocks["ends"], blocks["closed"], strict=True):
            out.append((state, owner if state else -1))
            if state == 0 or closed[state]:
                owner = block
            state = int(ends[state])
        found = pd.DataFrame(out, columns=["start", "owner"])
        return found.assign(url=blocks["url"].to_numpy(), block=blocks["block"].to_numpy(), crlf=bool(blocks["crlf"].iloc[0]))

    return profiles.groupBy("url").applyInPandas(compose, "url string, block long, start int, owner long, crlf boolean")


class _Starts:
    """Where blocks start, by file and position: some 20 bytes a block."""

    def __init__(self, found: DataFrame):
        self.files: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = {}
        table = found.orderBy("url", "block").toPandas()
        for url, g in table.groupby("url"):
            columns = (g["block"].to_numpy(np.int64), g["start"].to_numpy(np.int8), g["owner"].to_numpy(np.int64))
            self.files[url] = (*columns, bool(g["crlf"].iloc[0]))

    def of(self, url: str, block: int) -> tuple[int, int, bool]:
        blocks, states, owners, crlf = self.files.get(url, (*(np.zeros(0, np.int64),) * 3, False))
        at = int(np.searchsorted(blocks, block))
        if at == len(blocks) or blocks[at] != block:
            raise RuntimeError("the files, or how Spark splits them, have changed since they were looked through")
        return int(states[at]), int(owners[at]), crlf


# --- records ------------------------------------------------------------------------

_PIECE = pa.schema([("url", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("header", pa.bool_()), ("piece", pa.binary())])


def _pieces(lines: DataFrame, units: Units, shared, whole: bool) -> DataFrame:
    """Records that lie in one block, without each file's first; or the pieces of all others.

    A piece that is not a record's last ends in its line break.
    """
    starts, line_break, cr = units.starts(), units.line_break, "\r".encode(units.codec)

    class Reader:
        def __init__(self, url: str, block: int):
            number, owner, self.crlf = shared.value.of(url, block)
            self.url, self.block, self.state = url, block, starts[number]
            #: Pieces of the record that is open, the block it began in, whether it is a file's first.
            self.open, self.owner, self.header = [], owner if number else block, block == 0
            self.first = block == 0
            self.out: list[dict] = []

        def close(self, last: bool) -> None:
            piece = line_break.join(self.open) + (b"" if last else line_break)
            if last and self.crlf and piece.endswith(cr):
                piece = piece[: -len(cr)]
            self.open = []
            if last and self.owner == self.block:
                if not piece:
                    return  # an empty line is no record, nor the header
                if whole and not self.header:
                    self.out.append({"piece": piece})
            elif not whole:
                place = {"url": self.url, "owner": self.owner, "block": self.block, "header": self.header}
                self.out.append(place | {"piece": piece})
            self.owner, self.header = self.block, False

        def add(self, part: pa.Array) -> None:
            for piece in part.to_pylist():
                if self.first:
                    piece, self.first = units.unmarked(piece), False
                self.open.append(piece)
                self.state, ended = units.step(piece, self.state)
                if ended:
                    self.close(True)

        def end(self) -> None:
            if self.open:
                self.close(False)

    def plain(reader: Reader, part: pa.Array) -> bool:
        """Whether all lines of a run are records as they are."""
        ready = whole and not reader.open and not reader.header and reader.owner == reader.block
        ready = ready and reader.state == (0, FIELD) and units.width == 1 and not reader.crlf
        return ready and not pc.any(pc.match_substring(part, '"')).as_py()

    def run(batches):
        now = None
        for url, block, part in _runs(batches):
            if now is None or (now.url, now.block) != (url, block):
                if now is not None:
                    now.end()
                    yield pa.RecordBatch.from_pylist(now.out, schema=_PIECE)
                now = Reader(url, block)
            if plain(now, part):
                kept = part.filter(pc.greater(pc.binary_length(part), 0))
                nulls = [pa.nulls(len(kept), t) for t in _PIECE.types[:4]]
                yield pa.RecordBatch.from_arrays([*nulls, kept], schema=_PIECE)
                continue
            now.add(part)
            yield pa.RecordBatch.from_pylist(now.out, schema=_PIECE)
            now.out = []
        if now is not None:
            now.end()
            yield pa.RecordBatch.from_pylist(now.out, schema=_PIECE)

    return lines.mapInArrow(run, "url string, owner long, block long, header boolean, piece binary")


def _joined(pieces: DataFrame, units: Units) -> DataFrame:
    """Records out of the pieces of each, by file and the block that it begins in.

    The last record of a file may lack its line break, or end inside quotes.
    """
    ordered = F.sort_array(F.collect_list(F.struct("block", "piece")))
    whole = F.aggregate(ordered, F.lit(b""), lambda done, x: F.concat(done, x["piece"]))
    records = pieces.groupBy("url", "owner").agg(whole.alias("piece"), F.max("header").alias("header"))
    bare = F.expr(f"substring(piece, 1, greatest(octet_length(piece) - {units.width}, 0))")
    ends = F.expr(f"substring(piece, octet_length(piece) - {units.width - 1})") == F.lit(units.line_break)
    return records.where(~F.col("header")).select(F.when(ends, bare).otherwise(F.col("piece")).alias("piece")).where(
        F.octet_length("piece") > 0
    )


def _decoded(piece: Column, units: Units) -> Column:
    if units.codec == "utf-8":
        return F.make_valid_utf8(piece.cast("string"))
    if units.codec == "iso8859-1":
        return F.decode(piece, "ISO-8859-1")
    codec = units.codec

    @F.pandas_udf("string")
    def decode(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda b: b.decode(codec, "replace").encode("utf-8", "replace").decode())

    return decode(piece)


def has_big_endian(spark: SparkSession, paths: Sequence[str], encoding: str, folder: bool) -> bool:
    """Byte order of wide characters by the mark of the first file found; big without one, as in Java."""
    if Units.of(encoding, False).width == 1:
        return False
    lines = _lines(spark, paths, Units("utf-8", 1), folder).where("block = 0").select(F.substring("line", 1, 4))
    first = lines.first()
    return not (first and bytes(first[0]).startswith(b"\xff\xfe"))


def header_of(spark: SparkSession, paths: Sequence[str], encoding: str, big_endian: bool, folder: bool, most: int = 10_000) -> list[str]:
    """Names in the first record of the first file found, which has at most so many lines.

    A column without a name is `_c` and its number; one whose name is taken already gets its
    number behind it.
    """
    units = Units.of(encoding, big_endian)
    lines = _lines(spark, paths, units, folder).where("block = 0").limit(most).collect()
    state, record = (0, FIELD), []
    for i, row in enumerate(lines):
        record.append(units.unmarked(bytes(row["line"])) if i == 0 else bytes(row["line"]))
        state, ended = units.step(record[-1], state)
        if ended and any(record):
            break
        record = [] if ended else record
    text = units.line_break.join(record).decode(units.codec, "replace").removesuffix("\r")
    names = next(csv.reader(io.StringIO(text, newline="")), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def csv_records(
    spark: SparkSession, paths: Sequence[str], encoding: str, big_endian: bool = False, folder: bool = False
) -> DataFrame:
    """`record`: the text of every record of some CSV files but each file's first, the header.

    Line breaks inside quoted fields belong to them. Lines end in a line feed, or in
    carriage return and line feed where the first line does. Empty lines are no records. The
    files are looked through at once, and read again whenever the result is used; both times
    by as many tasks as Spark splits them for. Of each block, some 20 bytes go to the tasks
    of the second reading: 3 MB per 20 TB at the default block size. What is read must not
    change in between; a change of how files are split is noticed and is an error.
    """
    units = Units.of(encoding, big_endian)
    lines = _lines(spark, paths, units, folder)
    starts = _Starts(_starts(_profiles(lines, units)))
    shared = spark.sparkContext.broadcast(starts)
    pieces = _pieces(lines, units, shared, True).select("piece")
    # A block can also end inside a record that no block goes on with: a file's last, unclosed.
    pieces = pieces.unionByName(_joined(_pieces(lines, units, shared, False), units))
    return pieces.select(_decoded(F.col("piece"), units).alias("record"))


def escaped_glob(path: str) -> str:
    """A path whose characters all stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
