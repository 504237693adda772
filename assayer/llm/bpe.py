"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import whole_row, whole_text
from assayer.operators.shaping import cell

#: A letter, then a space and a letter: every alternative of the pattern ends before such a
#: space, because letters match only letters and no match reaches into white space from the
#: left. Cutting there leaves the matches as they are.
BOUNDARY = regex.compile(r"(?<=\p{L})(?= \p{L})")


def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """One per worker process and rank file; a file is a base64 token and its rank per line.

    Kept with the library, because this module's own names are new in each task.
    """
    loaded = tiktoken.__dict__.setdefault("_assayer_encodings", {})
    if (ranks, pattern) not in loaded:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        loaded[ranks, pattern] = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
    return loaded[ranks, pattern]


def pieces(text: str, length: int) -> Iterator[str]:
    """The text in parts of about `length` characters, cut only where matches surely end."""
    start = 0
    while len(text) - start > length:
        cut = BOUNDARY.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, enc: tiktoken.Encoding, length: int) -> np.ndarray:
    if len(text) <= length:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate(
        [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, length)]
    )


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, list]]:
    """Consecutive runs of values of about `limit` bytes together, with where they start."""
    start, size, run = 0, 0, []
    for i, value in enumerate(column):
        value = value.as_py()
        run.append(value)
        size += len(value)
        if size >= limit:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text_col: str = "text",
    piece_chars: int = 1 << 16,
    decode_back: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Token ids of every text: `row` (the caller's columns) and `ids`, an array of int.

    `keep` names the columns to carry in `row`; by default all.

    With `decode_back` also `decoded`, the bytes that the ids stand for, made from the ids
    alone. Each match of `pattern` is encoded by itself, without special tokens, as the
    tiktoken library does. Texts longer than `piece_chars` are cut before a space between
    two letters, where a match ends in any case, so a long text is encoded in small parts
    with the same result. A text without such a place is encoded in one.

    The rank file must lie at the same path on every machine. Edge cases: a null or empty
    text has no ids; repeated rows are encoded each; an empty table gives an empty result.
    No shuffle: texts are encoded where they are read, in runs of about 8 million
    characters, however many rows a batch has.
    """
    kept = docs.select([cell(c) for c in keep or docs.columns])
    rows = docs.select(whole_row(kept).alias("row"), whole_text(text_col).alias("text"))
    out = rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))
    if decode_back:
        out = out.add("decoded", T.BinaryType())

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            row, texts = batch.column(0), batch.column(1)
            for start, run_of in _slices(texts, 8 << 20):
                ids = [encode_text(t, enc, piece_chars) for t in run_of]
                columns = [row.slice(start, len(run_of)), _arrays(ids)]
                if decode_back:
                    back = [enc.decode_bytes(i.tolist()) for i in ids]
                    columns.append(pa.array(back, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """`row` (the caller's columns) and `decoded`, the raw bytes; null ids decode to none.

    Bytes, not text: a list of ids may begin or end inside a character. Repeated rows are
    decoded each; an empty table gives an empty result.
    """
    ids = F.coalesce(cell(ids_col), F.array().cast("array<int>"))
    rows = tokens.select(whole_row(tokens).alias("row"), ids.alias("ids"))
    out = rows.select("row").schema.add("decoded", T.BinaryType())

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            for start, run_of in _slices(batch.column(1), 1 << 20):
                back = pa.array([enc.decode_bytes(i) for i in run_of], pa.binary())
                columns = [batch.column(0).slice(start, len(run_of)), back]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "decoded"])

    return rows.mapInArrow(run, out)
