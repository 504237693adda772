"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_key, unpack, whole_row, whole_text, written
from assayer.llm.components import components
from assayer.operators.shaping import cell

BITS, SEED = 64, 42
#: Runs of equal signatures up to this size are compared pair by pair in one go.
SMALL_RUN = 8


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, in parts; words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in part], dtype="<u8")


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of all shingles of a text, unsigned; 0 if there are none."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return run(text)


def segments(max_distance: int) -> list[range]:
    """Bit positions of the segments: so many that one of them differs by at most one bit."""
    count = max_distance // 2 + 1
    ends = [BITS * i // count for i in range(count + 1)]
    return [range(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _one_wildcard(fp: Column, parts: list[range]) -> Column:
    """For each bit: its segment with that bit cleared, marked by the bit's number."""
    return F.array(
        *[
            F.struct(
                F.lit(b).alias("wildcard"),
                fp.bitwiseAND(F.lit(_signed(_mask(part) & ~(1 << b)))).alias("signature"),
            )
            for part in parts
            for b in part
        ]
    )


def forest(fps: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what `max_distance` joins, one fewer than each component has members.

    What has been reached leaves the pool, so a dense cluster costs a few passes over it.
    """
    pool, out = fps, []
    while len(pool) > 1:
        frontier, pool = [pool[0]], pool[1:]
        while frontier and len(pool):
            at = frontier.pop()
            near = np.bitwise_count(pool ^ at) <= max_distance
            if near.any():
                reached = pool[near]
                out.append((np.full(len(reached), at), reached))
                frontier.extend(reached)
                pool = pool[~near]
    return out


def run_links(runs: np.ndarray, fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `runs` values, as two arrays of fingerprints."""
    if not len(fps):
        return fps, fps
    heads = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    sizes = np.diff(np.append(heads, len(runs)))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for gap in range(1, SMALL_RUN):
        pair = (runs[gap:] == runs[:-gap]) & (size_of[gap:] <= SMALL_RUN)
        a, b = fps[:-gap][pair], fps[gap:][pair]
        near = np.bitwise_count(a ^ b) <= max_distance
        left.append(a[near])
        right.append(b[near])
    for head, size in zip(heads[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
        for a, b in forest(fps[head : head + size], max_distance):
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, max_distance: int = 4, block: int = 20_000) -> DataFrame:
    """Links (`a`, `b`) that connect distinct fingerprints `fp` at `max_distance` or fewer bits.

    Not all pairs: of the members of a signature only a spanning forest, which loses no
    connection. Fingerprints are cut into max_distance // 2 + 1 segments, so two that are
    near have a segment that differs by one bit at most, and share that segment's variant
    with this bit as a wildcard. Variants meet by equality: they are shuffled by signature
    and sorted, and a task compares one signature's members at a time.

    A signature with more than `block` members is cut into blocks by a hash, and each pair
    of blocks is a group of its own, so no task holds more than two blocks of one. The
    counts that tell are those of whole segments, three small rows per fingerprint.
    """
    parts = segments(max_distance)
    whole = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(p)))).alias("value"))
            for i, p in enumerate(parts)
        ]
    )
    heavy = (
        fps.select(F.explode(whole).alias("s"))
        .groupBy("s.part", "s.value")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block // 2)
    )
    bits_of = F.element_at(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), F.col("part") + 1)
    crowded = (
        heavy.select("value", "n", F.explode(bits_of).alias("wildcard"))
        .withColumn("signature", F.expr("value & ~shiftleft(1L, wildcard)"))
        .groupBy("wildcard", "signature")
        .agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    variants = fps.select("fp", F.explode(_one_wildcard(F.col("fp"), parts)).alias("v")).select(
        "fp", "v.wildcard", "v.signature"
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    )
    dealt = variants.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, ["wildcard", "signature"], "left").select(
        F.xxhash64("wildcard", "signature").alias("bucket"),
        "fp",
        F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"),
    )
    dealt = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")

    def compare(batches):
        rest = None
        for batch in batches:
            keys = batch.column(0).to_numpy() * np.int64(1_000_003) + batch.column(2).to_numpy()
            now = (keys, batch.column(1).to_numpy().view(np.uint64))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            last = np.flatnonzero(now[0] != now[0][-1])
            cut = last[-1] + 1 if len(last) else 0
            rest = tuple(x[cut:] for x in now)
            if cut:
                yield from linked(now[0][:cut], now[1][:cut])
        if rest is not None:
            yield from linked(*rest)

    def linked(keys, found):
        a, b = run_links(keys, found, max_distance)
        if len(a):
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(ends)], names=["a", "b"]
            )

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_distance: int = 4,
) -> DataFrame:
    """One row per document: `id`, `fp` (its SimHash as a signed long), `component_id`.

    Documents link if their fingerprints differ in `max_distance` bits or fewer, and
    `component_id` is the least id that can be reached over links, the own included. Words
    are in ASCII lower case; shingles of `shingle` words are hashed by XXH64 with their
    repeats, and a bit is set if it is set in more than half of the hashes.

    Edge cases: a text of fewer words is one shingle; one without words, or null, has
    fingerprint 0 and links like any other; a null id counts as reachable only if there is
    no other; repeated rows each give a row; an empty table gives an empty result.

    Equal fingerprints meet in one row before anything is compared, so copies cost nothing
    however many there are. Text is read once; all else is over (id, fingerprint).
    """
    rows = written(
        docs.select(cell(id_col).alias("id"), fingerprints(whole_text(text_col), shingle).alias("fp"))
    )
    return with_components(rows, lambda fps: links(fps, max_distance))


def with_components(rows: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (`id`, `fp`) with `component_id`, by the links that `linked` finds between distinct `fp`."""
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(linked(distinct.select("fp")), "a", "b")
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(placed.join(named, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """Exactly one row of each component of near copies, by the rule of `near_copies`.

    It is a row with the least id, of those one with the least text hash, and any one of
    rows that repeat both. A null id comes after all others; an empty table stays empty.
    Columns of any name come back as they are.

    Only rows that repeat are grouped, first per task; all others stay where the join
    with the keepers puts them.
    """
    t1, t2 = text_key(whole_text(text_col))
    packed = docs.select(
        whole_row(docs).alias("row"), cell(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), cell(text_col).alias("text")
    )
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    found = near_copies(packed.select(place.alias("place"), "text"), id_col="place", text_col="text", **rules)
    keepers = (
        found.where("id <=> component_id")
        .groupBy("id.id", "id.t1", "id.t2")
        .agg(F.count("*").alias("n"))
        .select(*[F.col(c).alias(f"keeper_{c}") for c in ("id", "t1", "t2", "n")])
    )
    keepers = written(keepers)
    rows = packed.drop("text")
    same = F.col("id").eqNullSafe(F.col("keeper_id")) & (F.col("t1") == F.col("keeper_t1")) & (F.col("t2") == F.col("keeper_t2"))
    single = rows.join(keepers.where("keeper_n = 1"), same, "left_semi").select("row")
    repeated = rows.join(keepers.where("keeper_n > 1"), same).groupBy(*keepers.columns).agg(F.first("row").alias("row"))
    return unpack(single.unionByName(repeated.select("row")), docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
