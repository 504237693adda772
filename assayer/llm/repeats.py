"""Exact repeated windows of bytes, by a depth-limited radix sort of suffixes.

Suffixes are told apart through `length` bytes only, most significant digit first; a
suffix alone in its group after a digit cannot start a repeated window and is dropped.
What is equal through the last digit is exactly the repeated windows.

The first digit of a window is the least hash of the `gram`-byte strings in it. Equal
windows have equal digits, and neighbouring windows mostly share theirs, so one row stands
for a run of some hundred suffixes: the first pass over all text moves a row per run. The
digits after it are hashes of consecutive parts of the window, and are sorted only within
the groups that the first pass has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_key, written
from assayer.operators.shaping import cell

GRAM = 64
#: Texts are cut into parts with this many suffixes; arrays of 8 bytes a suffix stay small.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hashes of any window of a byte buffer, from one running sum."""

    _forth = _back = np.zeros(0, np.uint64)
    _values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Windows._forth) < n:
            Windows._forth = _powers(_BASE, n + n // 2)
            Windows._back = _powers(pow(_BASE, -1, 1 << 64), n + n // 2)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self._values[data] * self._forth[: n - 1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, length: int) -> np.ndarray:
        """One per start; equal windows have equal hashes wherever they lie."""
        if isinstance(starts, slice):
            ends = slice(starts.start + length, starts.stop + length)
        else:
            ends = starts + length
        out = (self.sums[ends] - self.sums[starts]) * self._back[starts]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width] for every i that has as many."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def first_digits(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with the same first digit: digit, start, suffixes, repeats.

    `repeats` tells whether the string behind the digit occurs twice inside the run, so that
    the run may hold equal windows by itself.
    """
    width = length - gram + 1
    grams = Windows(data).hashes(slice(0, len(data) - gram + 1), gram)
    digit = sliding_minimum(grams, width)
    heads = np.flatnonzero(np.concatenate(([True], digit[1:] != digit[:-1])))
    sizes = np.diff(np.append(heads, len(digit)))
    found = digit[heads]
    repeats = np.fromiter(
        (
            np.count_nonzero(grams[h : h + s - 1 + width] == d) > 1
            for h, s, d in zip(heads.tolist(), sizes.tolist(), found, strict=True)
        ),
        bool,
        len(heads),
    )
    return found, heads, sizes, repeats


def equal_windows(data: np.ndarray, starts: np.ndarray, length: int, digits: int = 2) -> np.ndarray:
    """The starts, in their order, whose window equals that of another start.

    Radix passes: each tells groups apart by the hash of the next part of the window, taken
    with what the group had before, and drops those of one member.
    """
    windows = Windows(data)
    edges = [length * i // digits for i in range(digits + 1)]
    groups = np.zeros(len(starts), np.uint64)
    for low, high in zip(edges, edges[1:], strict=False):
        digit = windows.hashes(starts + low, high - low)
        groups = groups * np.uint64(0x9E3779B97F4A7C15) + digit
        shared = pd.Series(groups).duplicated(keep=False).to_numpy()
        starts, groups = starts[shared], groups[shared]
    return starts


def _parts(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text with where they start; each suffix lies in one with its window."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(data) - length + 1, 0), PART):
        yield at, data[at : at + PART + length - 1]


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(digit, k1, k2, id, low, n, repeats) for every run of suffixes."""

    def run(batches):
        names = ["digit", "k1", "k2", "id", "low", "n", "repeats"]
        for batch in batches:
            keys, held = [batch.column(i) for i in range(3)], []
            for i, raw in enumerate(batch.column(3)):
                for at, data in _parts(raw.as_py(), length):
                    digit, low, n, repeats = first_digits(data, length, gram)
                    held.append((np.full(len(digit), i), digit.view(np.int64), low + at, n, repeats))
                if held and (len(held) >= 200 or i + 1 == len(keys[0])):
                    row, digit, *rest = (pa.array(np.concatenate(c)) for c in zip(*held, strict=True))
                    columns = [digit, *(k.take(row) for k in keys), *rest]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    held = []

    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"digit long, k1 long, k2 long, id {id_type}, low long, n long, repeats boolean"
    return texts.select("k1", "k2", "id", "bytes").mapInArrow(run, schema)


def _slices(texts: DataFrame, length: int) -> DataFrame:
    """(digit, crowded, k1, k2, low, n, bytes): the bytes that the windows of a run cover."""

    def run(batches):
        names = ["digit", "crowded", "k1", "k2", "low", "n", "bytes"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for i in range(batch.num_rows):
                k1, k2, raw, runs = (batch.column(c)[i].as_py() for c in range(4))
                for r in runs:
                    piece = raw[r["low"] : r["low"] + r["n"] - 1 + length]
                    held += len(piece)
                    for c, v in zip(out, (r["digit"], r["crowded"], k1, k2, r["low"], r["n"], piece), strict=True):
                        c.append(v)
                    if held >= 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                        out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    schema = "digit long, crowded boolean, k1 long, k2 long, low long, n long, bytes binary"
    return texts.select("k1", "k2", "bytes", "runs").mapInArrow(run, schema)


def _spans_within_groups(slices: DataFrame, length: int, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(k1, k2, low, high) of what repeats, from slices that a digit has brought together."""

    def chunk(rows):
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        k1, k2, low, sizes = (np.array([r[c] for r in rows], np.int64) for c in range(1, 5))
        begins = np.cumsum([0, *(len(r[5]) for r in rows[:-1])])
        owner = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        found = equal_windows(data, begins[owner] + place, length)
        if not len(found):
            return
        at = np.searchsorted(begins, found, side="right") - 1
        lows = low[at] + found - begins[at]
        # Spans of touching windows of one slice.
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (lows[1:] > lows[:-1] + length))))
        ends = lows[np.append(new[1:], len(lows)) - 1] + length
        columns = [k1[at[new]], k2[at[new]], lows[new], ends]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "low", "high"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if size >= chunk_bytes:
                        yield from chunk(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from chunk(held)

    dealt = slices.select("digit", "k1", "k2", "low", "n", "bytes")
    dealt = dealt.repartition("digit").sortWithinPartitions("digit")
    return dealt.mapInArrow(run, "k1 long, k2 long, low long, high long")


def _spans_of_crowded(slices: DataFrame, length: int) -> DataFrame:
    """The same for digits that have too many runs or bytes for one task.

    Windows that a slice holds twice are found in the slice. Each distinct window of a slice
    becomes a row of all its further digits, and only the least and greatest place of equal
    ones are aggregated, combined before the shuffle; a constant run is one row.
    """

    def windows(batches):
        for batch in batches:
            for k1, k2, low, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashed, half = Windows(np.frombuffer(raw, np.uint8)), length // 2
                h1 = hashed.hashes(slice(0, n), half).view(np.int64)
                h2 = hashed.hashes(slice(half, half + n), length - half).view(np.int64)
                yield k1, k2, low, pd.DataFrame({"h1": h1, "h2": h2})

    def distinct(batches):
        names = ["h1", "h2", "k1", "k2", "low"]
        for k1, k2, low, found in windows(batches):
            first = found[~found.duplicated()]
            n = len(first)
            columns = [first["h1"], first["h2"], np.full(n, k1), np.full(n, k2), first.index.to_numpy() + low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def within(batches):
        for k1, k2, low, found in windows(batches):
            at = np.flatnonzero(found.duplicated(keep=False)) + low
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + length)))
            ends = at[np.append(new[1:], len(at)) - 1] + length
            columns = [np.full(len(new), k1), np.full(len(new), k2), at[new], ends]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "low", "high"])

    given = slices.select("k1", "k2", "low", "n", "bytes")
    rows = given.mapInArrow(distinct, "h1 long, h2 long, k1 long, k2 long, low long")
    place = F.struct("k1", "k2", "low")
    repeated = (
        rows.groupBy("h1", "h2")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"))
        .where("a <> b")
        .select("h1", "h2")
    )
    found = rows.join(repeated, ["h1", "h2"]).select("k1", "k2", "low", (F.col("low") + length).alias("high"))
    return found.unionByName(given.mapInArrow(within, "k1 long, k2 long, low long, high long"))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    gram: int = GRAM,
    crowd: int = 20_000,
    crowd_bytes: int = 4 << 20,
) -> DataFrame:
    """Per text (`k1`, `k2`, its key) that loses bytes: `n_removed`, `spans`, `kept`.

    Texts are UTF-8 bytes. Removed is each byte in a string of `length` bytes that also
    starts elsewhere in the table, in the same text or another; overlaps count. `spans` are
    the maximal removed runs as (low, high), `kept` the remaining bytes. `with_kept` puts
    this beside the documents.

    Edge cases: a null text is empty; a text shorter than `length` loses nothing; a text of
    `length` bytes or more that two rows share, under whatever ids, is removed whole from
    both; an empty table gives an empty result.

    Copies of a text are counted by key, and one of them speaks for all against other
    texts. All text is read twice, but only the parts in runs whose first digit occurs again
    are shuffled by digit. A digit of more than `crowd` runs, or whose runs cover
    more than `crowd_bytes`, goes on window by window with all its digits as the key, so no
    task holds a group that grows with the data.
    """
    if not 0 < gram < length:
        raise ValueError("gram is at least 1 and below length")
    raw = F.coalesce(cell(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(raw)
    texts = docs.select(
        k1.alias("k1"), k2.alias("k2"), cell(id_col).alias("id"), raw.cast("binary").alias("bytes")
    ).where(F.octet_length("bytes") >= length)

    counts = texts.groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.max(F.octet_length("bytes")).cast("long").alias("size"))
    copied = counts.where("rows > 1").select(
        "k1", "k2",
        F.col("size").alias("n_removed"),
        F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))).alias("spans"),
        F.lit(b"").alias("kept"),
    )

    runs = written(_runs(texts, length, gram))
    place = F.struct("k1", "k2", "low")
    again = written(
        runs.groupBy("digit")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("repeats").alias("repeats"), F.count("*").alias("runs"), F.sum("n").alias("n"))
        .where("a <> b OR repeats")
        .select("digit", is_crowded(F.col("runs"), F.col("n"), length, crowd, crowd_bytes).alias("crowded"))
    )
    wanted = (
        runs.join(again, "digit")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("first"), F.collect_set(F.struct("digit", "low", "n", "crowded")).alias("runs"))
    )
    same = (texts["k1"] == wanted["k1"]) & (texts["k2"] == wanted["k2"])
    same &= texts["id"].eqNullSafe(wanted["first"])
    judged = written(texts.join(wanted, same).select(texts["*"], "runs"))
    slices = _slices(judged, length)
    found = _spans_within_groups(slices.where("NOT crowded"), length).unionByName(
        _spans_of_crowded(slices.where("crowded"), length)
    )
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("found"))
    alone = counts.where("rows = 1").select("k1", "k2")
    cut = judged.select("k1", "k2", "bytes").join(spans, ["k1", "k2"]).join(alone, ["k1", "k2"])
    cut = cut.select("k1", "k2", remove_spans(F.col("bytes"), F.col("found")).alias("c")).select("k1", "k2", "c.*")
    return copied.unionByName(cut)


def is_crowded(runs: Column, suffixes: Column, length: int, crowd: int, crowd_bytes: int) -> Column:
    """Whether the runs of a digit, or the bytes that they cover, are too many for one task."""
    return (runs > crowd) | (suffixes + runs * (length - 1) > crowd_bytes)


def remove_spans(texts: Column, found: Column) -> Column:
    """Joins spans that touch or overlap, and cuts them out."""

    @F.pandas_udf("n_removed long, spans array<struct<low:long,high:long>>, kept binary")
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [cut_out(raw, parts) for raw, parts in zip(texts, found, strict=True)]
        return pd.DataFrame(rows, columns=["n_removed", "spans", "kept"])

    return run(texts, found)


def cut_out(raw: bytes, parts) -> tuple[int, list[dict], bytes]:
    spans: list[list[int]] = []
    for low, high in sorted((p["low"], p["high"]) for p in parts):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    edges = [0, *(e for s in spans for e in s), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(raw) - len(kept), [{"low": a, "high": b} for a, b in spans], kept
