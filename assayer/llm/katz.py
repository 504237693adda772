"""Katz backoff language model over a corpus, and the scores of its documents.

Documents are dealt into batches by a hash of their content. A batch asks once for every
n-gram it holds, however often it occurs; the counts of n-grams are added up in partitions
by n-gram, and each batch gets back the totals it asked for, in a table partitioned by
batch. What moves is packed: sorted 64-bit n-gram keys by their differences, byte plane
by byte plane. All text is read, none is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_text, written
from assayer.operators.shaping import cell

BATCH_BYTES = 4 << 20
#: A part of the key space gets about as many keys as so many batches have.
BATCHES_PER_PART = 4
#: Keys of the end token and of the context before the first word.
END_WORD, BEGIN = np.uint64(0x1D8AF1A7C0FFEE11), np.uint64(0x5BD1E995A5A5A5A7)


# --- packing ------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Any array of 8-byte numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys, as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a context followed by a word; order matters."""
    out = context * np.uint64(0x9E3779B97F4A7C15) + word
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in sorted keys: part p holds keys[bounds[p] : bounds[p + 1]]."""
    step = (1 << 64) // parts
    edges = np.array([step * p for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


# --- a batch of documents -----------------------------------------------------------


class Batch:
    """Tokens of some documents, and the n-grams that end at each of them.

    Tokens are the words, split at ASCII white space in ASCII lower case, then one end per
    document: `word` are their keys, `doc` their documents, `first` the documents' first tokens.
    """

    def __init__(self, texts: pa.Array, order: int):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        words, doc = words.filter(pa.array(real)).dictionary_encode(), doc[real]
        named = [xxhash.xxh64_intdigest(w, 3) for w in words.dictionary.cast(pa.large_binary()).to_pylist()]
        hashes = np.array(named, dtype=np.uint64)[words.indices.to_numpy()]
        counts = np.bincount(doc, minlength=len(texts)) + 1
        ends = np.cumsum(counts) - 1
        self.order = order
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.word = np.full(len(self.doc), END_WORD)
        inside = np.ones(len(self.word), bool)
        inside[ends] = False
        self.word[inside] = hashes
        self.first = np.concatenate(([0], ends[:-1] + 1))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """By length, only one of which is held: the n-grams that end at each token and, but for
        single words, what stands before them; that reaches back to one begin mark before the
        first word."""
        keys = self.word
        yield keys, None
        for m in range(1, self.order):
            context = np.empty(len(keys), np.uint64)
            context[1:] = keys[:-1]
            context[self.first] = BEGIN + np.uint64(m)
            keys = _mix(context, self.word)
            yield keys, context


def _read(payloads: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, held-out flags and texts of one batch's documents, in an order that they decide."""
    tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(p)).read_all() for p in payloads]
    table = pa.concat_tables(tables).sort_by([("order", "ascending"), ("size", "ascending")])
    return table["row"].combine_chunks(), table["held_out"].combine_chunks(), table["text"].combine_chunks()


def _gathered(frames, rows: int = 10_000, size: int = 48 << 20) -> Iterator[pa.Table]:
    """Frames put together, in one piece, up to so many rows or bytes: fewer and larger payloads."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        held.append(frame)
        if sum(f.num_rows for f in held) >= rows or sum(f.nbytes for f in held) >= size:
            table, held = pa.Table.from_batches(held).combine_chunks(), []
            yield table
    if held:
        table, held = pa.Table.from_batches(held).combine_chunks(), []
        yield table


def _dealt(docs: DataFrame, id_col: str, text_col: str, batches: int, folds: int, fold: int) -> DataFrame:
    """(batch, payload): documents packed by batch."""
    text = whole_text(text_col)
    rows = docs.select(
        F.pmod(F.xxhash64(text, cell(id_col).cast("string")), F.lit(batches)).cast("int").alias("batch"),
        F.xxhash64(F.lit(5), text, cell(id_col).cast("string")).alias("order"),
        F.octet_length(text).alias("size"),
        F.coalesce(F.crc32(cell(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out"),
        cell(id_col).alias("row"),
        text.alias("text"),
    )

    def pack(frames):
        for table in _gathered(frames):
            batch = table["batch"].to_numpy()
            by = np.argsort(batch, kind="stable")
            heads = np.flatnonzero(np.diff(batch[by], prepend=-1))
            table = table.drop_columns(["batch"])
            for i, rows_of in zip(batch[by][heads], np.split(by, heads[1:]), strict=True):
                sink = pa.BufferOutputStream()
                part = table.take(pa.array(rows_of))
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(i)], pa.int32()), pa.array([blob], pa.binary())], names=["batch", "payload"]
                )

    return rows.mapInArrow(pack, "batch int, payload binary")


def _groups(frames) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same first column, across the frames of a sorted partition.

    Binary cells are views of the frames' memory, no copies.
    """

    def cells(column: pa.Array) -> Iterator:
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            return (cell.as_buffer() for cell in column)
        return iter(column.to_pylist())

    rows = (
        dict(zip(frame.schema.names, row, strict=True))
        for frame in frames
        for row in zip(*map(cells, frame.columns), strict=True)
    )
    for value, run in groupby(rows, key=lambda row: next(iter(row.values()))):
        yield value, list(run)


def _frame(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema)
    )


_BLOCK = {"part": pa.int32(), "level": pa.int32(), "batch": pa.int32(), "keys": pa.binary(), "values": pa.binary()}
_BLOCK_SQL = "part int, level int, batch int, keys binary, values binary"


def _asked(dealt: DataFrame, order: int, parts: int, levels: range) -> DataFrame:
    """Per batch, level and part of the key space: distinct n-grams and their training counts.

    A value is twice the count, plus 1 if a held-out document of the batch has the n-gram.
    The begin contexts are counted among the keys of their level: once per document.
    """

    def run(frames):
        for batch, rows in _groups(frames):
            _, held, texts = _read([r["payload"] for r in rows])
            grams = Batch(texts, levels.stop)
            del texts
            trained = ~held.to_numpy(zero_copy_only=False)
            for level, (keys, _) in enumerate(grams.grams()):
                if level not in levels:
                    continue
                begin = np.full(len(trained) if level + 1 < order else 0, BEGIN + np.uint64(level + 1))
                weights = np.concatenate((trained[grams.doc], trained[: len(begin)]))
                distinct, at = np.unique(np.concatenate((keys, begin)), return_inverse=True)
                counts = np.bincount(at[weights], minlength=len(distinct)) * 2
                counts[at[~weights]] |= 1
                del at
                bounds = _part(distinct, parts)
                for p in np.flatnonzero(np.diff(bounds)):
                    own = slice(bounds[p], bounds[p + 1])
                    yield _frame(_BLOCK, [(int(p), level, batch, pack_keys(distinct[own]), squeeze(counts[own]))])

    return dealt.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, _BLOCK_SQL)


def _answered(asked: DataFrame, levels: range, kmax: int) -> DataFrame:
    """Each block with the totals of its keys, and per part and level a block of statistics.

    A total is four times the training count, plus 2 if any held-out document has the n-gram,
    plus 1 in the block that is the n-gram's own: the one of the lowest batch that trained on
    it. Statistics (batch -1) are the number of
    tokens, of types, and of types that occur 1, 2, .. kmax + 1 times.
    """

    def run(frames):
        for part, rows in _groups(frames):
            for level in levels:
                blocks = sorted((r for r in rows if r["level"] == level), key=lambda r: r["batch"])
                if not blocks:
                    continue
                keys = [unpack_keys(r["keys"]) for r in blocks]
                ends = np.cumsum([len(k) for k in keys])
                keys = np.concatenate(keys)
                by = np.argsort(keys, kind="stable")
                keys = keys[by]
                heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
                real = keys[heads] != BEGIN + np.uint64(level + 1)
                del keys
                values = np.concatenate([expand(r["values"], np.int64) for r in blocks])[by]
                total = np.add.reduceat(values >> 1, heads)
                held = np.bitwise_or.reduceat(values & 1, heads)
                group = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(values)))
                trained = np.flatnonzero(values > 1)
                own = trained[np.diff(group[trained], prepend=-1) != 0]
                del values, trained
                found = (total * 4 + held * 2)[group]
                found[own] += 1
                del group
                answer = np.empty_like(found)
                answer[by] = found
                del by, found
                for r, low, high in zip(blocks, [0, *ends[:-1]], ends, strict=True):
                    yield _frame(_BLOCK, [(part, level, r["batch"], b"", squeeze(answer[low:high]))])
                real = total[real & (total > 0)]
                stats = [int(real.sum()), len(real), *(int((real == r).sum()) for r in range(1, kmax + 2))]
                yield _frame(_BLOCK, [(part, level, -1, b"", squeeze(np.array(stats, np.int64)))])

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, _BLOCK_SQL)


# --- discounts ------------------------------------------------------------------------

#: What a count above the Good-Turing range gives up, so that every context has mass left.
LARGE_GIVES = 0.1


def discounts(of_counts: list[int]) -> np.ndarray:
    """d[r] for counts r = 1..k (d[0] unused), by Katz's form of the Good-Turing estimate.

    `of_counts` are the numbers of types that occur 1..k + 1 times. Where the estimate
    is not strictly between 0 and 1, as with few data, the count gives up the constant
    n1 / (n1 + 2 n2) instead.
    """
    n = [0, *of_counts]
    k = len(of_counts) - 1
    gives = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = np.ones(k + 1)
    above = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = 0.0
        if n[r] and above < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - above) / (1 - above)
        out[r] = d if 0 < d < 1 else (r - gives) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less what they give up."""
    small = counts < len(d)
    return np.where(small, counts * d[np.where(small, counts, 0)], counts - LARGE_GIVES)


class Model(NamedTuple):
    """What all tokens share: training tokens and types, discounts by level, unseen mass."""

    tokens: int
    types: int
    discounts: list[np.ndarray]
    unknown: float


def _model(answered: DataFrame, order: int, kmax: int) -> Model:
    """From the statistics, of which there is a block per part and level, added up by Spark."""
    parsed = answered.where("batch = -1").select("level", "values")

    def unpack(frames):
        for frame in frames:
            for level, blob in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                stats = expand(blob, np.int64)
                yield _frame(
                    {"level": pa.int32(), "at": pa.int32(), "n": pa.int64()},
                    [(level, i, int(v)) for i, v in enumerate(stats)],
                )

    rows = parsed.mapInArrow(unpack, "level int, at int, n long").groupBy("level", "at").agg(F.sum("n").alias("n"))
    found = {(r["level"], r["at"]): r["n"] for r in rows.collect()}
    of_counts = [[found.get((m, 2 + r), 0) for r in range(kmax + 1)] for m in range(order)]
    ds = [discounts(n) for n in of_counts]
    tokens, types = found.get((0, 0), 0), found.get((0, 1), 0)
    given = sum(r * (1 - ds[0][r]) * of_counts[0][r - 1] for r in range(1, kmax + 1))
    given += LARGE_GIVES * (types - sum(of_counts[0][:kmax]))
    return Model(tokens, types, ds, given / tokens if tokens else 1.0)


# --- scoring --------------------------------------------------------------------------

_DOC_SQL = "n_tokens long, n_known long, base_score double, score double, place long"


def _answers_of(grams: Batch, keys: np.ndarray, level: int, answers: dict) -> tuple[np.ndarray, ...]:
    """The answer for each token's n-gram, that for what comes before each token one level up
    (none at the last level), each token's distinct n-gram, and which of those are the batch's own."""
    n = len(grams.first) if level + 1 < grams.order else 0
    tokens, begin = len(keys), np.full(n, BEGIN + np.uint64(level + 1))
    distinct, at = np.unique(np.concatenate((keys, begin)), return_inverse=True)
    blocks = [answers.pop(k) for k in sorted(k for k in answers if k[0] == level)]
    found = np.concatenate([expand(b, np.int64) for b in blocks])
    if len(found) != len(distinct):
        raise RuntimeError("the documents of a batch have changed between two reads")
    value = found[at]
    before = np.empty(tokens if n else 0, np.int64)
    if n:
        before[1:] = value[: tokens - 1]
        before[grams.first] = value[tokens:]
    return value[:tokens], before, at[:tokens], found & 1 == 1


def _blocks(level: int, batch: int, keys: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[tuple]:
    """Sorted keys and their values, cut into the parts of the key space."""
    bounds = _part(keys, parts)
    for p in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[p], bounds[p + 1])
        yield int(p), level, batch, pack_keys(keys[own]), squeeze(np.concatenate([v[own] for v in values]))


def _scored(both: DataFrame, id_type: str, order: int, parts: int, model: Model) -> DataFrame:
    """Documents' scores but for the backoff weights, and what those are made and needed of.

    Rows with level -1 are documents. Blocks with batch -1 are sums per context over this
    batch's own n-grams: the counts that its seen words keep, the context's own count, and
    the probability of the words one level down. Every n-gram of a training document is
    seen, so only contexts that held-out documents have can be backed off from, and only
    those are summed up. The other blocks name the documents that backed off from a context.
    """

    def run(frames):
        for batch, rows in _groups(frames):
            row, held, texts = _read([r["payload"] for r in rows if r["payload"] is not None])
            grams = Batch(texts, order)
            del texts
            n, tokens = len(row), len(grams.doc)
            answers = {(r["level"], r["part"]): r["values"] for r in rows if r["payload"] is None}
            del rows
            blocks = []
            for level, (keys, contexts) in enumerate(grams.grams()):
                given = before if level else None
                value, before, at, owned = _answers_of(grams, keys, level, answers)
                del keys
                counts = value >> 2
                del value
                seen = counts > 0
                left = discounted(counts, model.discounts[level])
                if not level:
                    chance = np.where(seen, left / max(model.tokens, 1), model.unknown)
                    base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                    base, known = (np.bincount(grams.doc, v, n) for v in (base, seen))
                    continue
                del counts
                context, asked = given >> 2, given & 2 == 2
                del given
                sample = np.full(len(owned), -1)
                sample[at] = np.arange(tokens)
                own = sample[owned & (sample >= 0)]
                own = own[asked[own]]
                del sample, asked, at
                keys, first, at = np.unique(contexts[own], return_index=True, return_inverse=True)
                sums = [np.bincount(at, v[own], len(keys)).view(np.int64) for v in (left, chance)]
                blocks += _blocks(level, -1, keys, parts, sums[0], context[own][first], sums[1])
                del keys, at, first, own, sums
                missed = np.flatnonzero(~seen & (context > 0))
                missed = missed[np.argsort(contexts[missed], kind="stable")]
                blocks += _blocks(level, batch, contexts[missed], parts, grams.doc[missed])
                # A seen n-gram ends in a seen one, so no backoff was noted for it below.
                chance = np.where(seen, left / np.maximum(context, 1), chance)
                del contexts, context, missed, left, seen
            per_doc = [
                np.bincount(grams.doc, minlength=n).astype(np.int64),
                known.astype(np.int64),
                base,
                np.bincount(grams.doc, np.log10(chance), n),
                np.arange(n),
            ]
            del grams, chance
            none = [pa.nulls(n, pa.binary())] * 2
            head = [pa.array(np.full(n, v, np.int32)) for v in (0, -1, batch)]
            names = [*_BLOCK, "row", "held_out", "n_tokens", "n_known", "base_score", "score", "place"]
            yield pa.RecordBatch.from_arrays([*head, *none, row, held, *map(pa.array, per_doc)], names=names)
            if blocks:
                m = len(blocks)
                kinds = [row.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                rest = [pa.nulls(m, t) for t in kinds]
                yield pa.RecordBatch.from_arrays([*_frame(_BLOCK, blocks).columns, *rest], names=names)

    schema = f"{_BLOCK_SQL}, row {id_type}, held_out boolean, {_DOC_SQL}"
    return both.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, schema)


def _weighed(blocks: DataFrame, order: int) -> DataFrame:
    """(level, part, keys, weights) of contexts that may be backed off from, and per part and
    batch the sums that documents are owed, in one row.

    A weight is the mass that the context's seen words leave, over the mass that they leave
    one level down; so the probabilities after a context add up to 1 exactly.
    """
    names = ["level", "part", "keys", "weights", "batch", "places", "owed"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    schema = dict(zip(names, kinds, strict=True))

    def run(frames):
        for part, rows in _groups(frames):
            owed: dict[int, list] = {}
            for level in range(1, order):
                sums = [r for r in rows if r["level"] == level and r["batch"] < 0]
                if not sums:
                    continue
                keys, at = np.unique(np.concatenate([unpack_keys(r["keys"]) for r in sums]), return_inverse=True)
                values = np.concatenate([expand(r["values"], np.int64).reshape(3, -1) for r in sums], axis=1)
                kept, below = (np.bincount(at, values[i].view(np.float64)) for i in (0, 2))
                size = np.empty(len(keys))
                size[at] = values[1]
                kept /= size
                # Rounding aside both masses are positive.
                weights = np.maximum(1 - kept, 1e-15) / np.maximum(1 - below, 1e-15)
                yield _frame(schema, [(level, part, pack_keys(keys), squeeze(weights), None, None, None)])
                for r in rows:
                    if r["level"] == level and r["batch"] >= 0:
                        found = weights[np.searchsorted(keys, unpack_keys(r["keys"]))]
                        owed.setdefault(r["batch"], []).append((expand(r["values"], np.int64), np.log10(found)))
            for batch, pairs in owed.items():
                yield _frame(schema, [(None, part, None, None, batch, *map(squeeze, _by_place(pairs)))])

    sql = "level int, part int, keys binary, weights binary, batch int, places binary, owed binary"
    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, sql)


def _by_place(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The places named, each once, and the sum of the numbers beside each."""
    places, at = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
    return places, np.bincount(at, np.concatenate([v for _, v in pairs]), len(places))


def _owed(weights: DataFrame) -> DataFrame:
    """(batch, place, owed): all that each document is owed, parts added up in their order."""
    names = ["batch", "place", "owed"]

    def run(frames):
        for batch, rows in _groups(frames):
            places, sums = _by_place([(expand(r["places"], np.int64), expand(r["owed"], np.float64)) for r in rows])
            columns = [np.full(len(places), batch, np.int32), places, sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    given = weights.where("batch IS NOT NULL").select("batch", "part", "places", "owed")
    dealt = given.repartition("batch").sortWithinPartitions("batch", "part")
    return dealt.mapInArrow(run, "batch int, place long, owed double")


def katz_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    kmax: int = 5,
    folds: int = 10,
    fold: int = 0,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per document: `id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`,
    `base_score` and `score`.

    The model is learned from the documents whose id's crc32 modulo `folds` is not `fold`,
    and scores all. Words are in ASCII lower case, split at ASCII white space; each
    document ends in an end token, which counts. A word after its context has the
    discounted share of its count; one not seen there has the context's weight times its
    probability after the shorter context; one never seen has what the seen words give up,
    as a single unknown word. Counts to `kmax` are discounted by Good-Turing, larger ones
    give up a tenth, so every context has mass left and probabilities add up to 1.
    `score` is the sum of log10 probabilities; `base_score` that of unigrams with 0.1 added.

    Edge cases: a null or empty text is its end token; a null id takes part in training;
    repeated rows count each; without training documents every token is unknown, with
    probability 1; an empty table gives an empty result.

    Text is read once per round of n-gram lengths (words and pairs, then each longer length)
    and once to score, dealt into batches of about `batch_bytes` by a hash of its content,
    which also spreads copies and sources. N-grams are counted per batch before they move,
    so a frequent one is a number per batch; what a round has moved is removed before the next. N-gram totals and backoff weights are written
    as tables, by batch and by part of the key space. Keys are 64-bit hashes. The driver
    sees the counts of counts only. A batch sends a block to every part, so blocks shrink
    as the corpus grows; above a terabyte raise `batch_bytes` with the executors' memory.
    """
    size = docs.agg(F.sum(F.octet_length(whole_text(text_col)))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    parts = -(-batches // BATCHES_PER_PART)
    id_type = docs.select(cell(id_col).alias("row")).schema["row"].dataType.simpleString()

    dealt = _dealt(docs, id_col, text_col, batches, folds, fold)
    rounds = [range(0, min(order, 2)), *(range(m, m + 1) for m in range(2, order))]
    answered = reduce(
        DataFrame.unionByName,
        [written(_answered(_asked(dealt, order, parts, levels), levels, kmax), tidy=True, packed=True) for levels in rounds],
    )
    model = _model(answered, order, kmax)
    both = dealt.select("batch", "payload", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("part", "int"), ("values", "binary"))])
    both = both.unionByName(
        answered.where("batch >= 0").select("batch", F.lit(None).cast("binary").alias("payload"), "level", "part", "values")
    )
    scored = written(_scored(both, id_type, order, parts, model), tidy=True, packed=True)
    weights = written(_weighed(scored.where("level >= 0").select(*_BLOCK), order), tidy=True, packed=True)
    return (
        scored.where("level = -1")
        .join(_owed(weights), ["batch", "place"], "left")
        .select(
            F.col("row").alias("id"),
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            "base_score",
            (F.col("score") + F.coalesce("owed", F.lit(0.0))).alias("score"),
        )
    )
