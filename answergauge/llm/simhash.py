"""SimHash fingerprints and their near-duplicate groups, found through pivot distance tables.

The table of a fingerprint holds its Hamming distances to many reference
fingerprints. If two fingerprints differ in at most k bits, each of their table
entries differs by at most k, so a larger coordinate difference discards a pair;
what is left is verified bit by bit.

Random references alone discard only about four pairs in ten each, and every
pair would have to be looked at. So one reference is taken as the base and the
others are the base with one range of bits flipped. ``d(x, base) - d(x, flipped)``
depends on that range alone, which makes the table searchable by equality: k
differing bits touch at most k ranges, so of k + 2 groups of ranges at least two
have equal coordinates. Each pair of groups and its coordinates is a cell; any
linked pair meets in one. References that flip random bits discard more pairs
inside a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import components, forest, input_rows, lower_words, spare_name, stored

BITS = 64
RANGE_BITS = 2  # bits flipped by a range reference


def _references(seed: int = 7, random_ones: int = 16) -> tuple[int, list[int], list[int]]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**64, dtype=np.uint64))
    flips = [base ^ (((1 << RANGE_BITS) - 1) << at) for at in range(0, BITS, RANGE_BITS)]
    return base, flips, [int(x) for x in rng.integers(0, 2**64, random_ones, dtype=np.uint64)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, row (hash of id and text), fp (long): bit majority of the XXH64 (seed 42) of all word shingles, repeats included.

    Fewer words than a shingle: the whole sequence is one shingle. No word (null,
    empty or blank text): 0. One row per input row, null ids too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                ["id", "row", "fp"])

    rows = input_rows(docs, id_col, text_col).withColumn("row", F.xxhash64("id", "text"))
    return rows.mapInArrow(run, "id long, row long, fp long")


def _fingerprint(text: str, shingle: int) -> int:
    from xxhash import xxh64_intdigest as digest

    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle - 1:] if len(words) > shingle else ends[-1:]
    first = np.concatenate(([0], ends[:-1] + 1))[:len(last)]
    ones, n = np.zeros(BITS, np.int64), len(last)
    for k in range(0, n, 65_536):
        hashes = [digest(joined[a:b], 42) for a, b in zip(first[k:k + 65_536].tolist(), last[k:k + 65_536].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for c in range(0, len(bits), 255):
            ones += np.add.reduce(bits[c:c + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4,
    task_rows: int = 4096,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), fp.

    Fingerprints link at ``max_bits`` or fewer differing bits; equal ones always
    do, that of empty texts included. Copies meet in the aggregation of equal
    fingerprints; only different fingerprints are searched. Repeated rows come
    back repeated; a null id takes part in links but is never the smallest, and a
    component of null ids only has a null component. An empty table gives an
    empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    named = _grouped(fps, max_bits, task_rows)
    lowest = named.groupBy("group").agg(F.min("first.id").alias("component_id"))
    return fps.join(named, "fp").join(lowest, "group").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4,
    task_rows: int = 4096,
) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group by id (nulls last), then by a hash of the
    text; of rows that repeat id and text one stays."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    named = _grouped(fps, max_bits, task_rows)
    row = spare_name(docs, "_row")
    kept = named.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)


def _grouped(fps: DataFrame, max_bits: int, task_rows: int) -> DataFrame:
    """fp, group (a fingerprint of the component), first (the fingerprint's first row by id, nulls last, and hash)."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    distinct = fps.groupBy("fp").agg(F.min(first).alias("first"))
    groups = components(links(distinct.select("fp"), max_bits, task_rows), "simhash-groups")
    return stored(
        distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("group")), "simhash-named")


def links(distinct: DataFrame, max_bits: int = 4, task_rows: int = 4096) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of ``fp`` within ``max_bits``: a task reports a
    fingerprint with the first one it reaches there, not each pair.

    A cell of more than ``task_rows`` fingerprints is dealt into blocks, and each
    pair of blocks is a task's share of its own.
    """
    rows = distinct.mapInArrow(_cells(max_bits), "fp long, cell long")
    large = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    dealt = rows.join(large, "cell", "left").select("fp", "cell", F.ceil(F.coalesce("n", F.lit(1)) / task_rows).alias("k"))
    return block_pairs(dealt, "fp", "cell").mapInArrow(_searcher(max_bits), "a long, b long")


def _cells(max_bits: int):
    base, flips, _ = _references()
    groups = np.array_split(np.arange(len(flips)), max_bits + 2)
    width = (RANGE_BITS + 1) ** max(map(len, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            fps = signed.view(np.uint64)
            to_base = np.bitwise_count(fps ^ np.uint64(base)).astype(np.int64)
            # 0 to RANGE_BITS: the distance to the base inside each flipped range
            local = [(to_base - np.bitwise_count(fps ^ np.uint64(f)).astype(np.int64) + RANGE_BITS) // 2 for f in flips]
            packed = [sum(local[i] * (RANGE_BITS + 1) ** k for k, i in enumerate(g)) for g in groups]
            for k, (x, y) in enumerate(combinations(range(len(groups)), 2)):
                cell = (k * width + packed[x]) * width + packed[y]
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(cell)], ["fp", "cell"])

    return run


def block_pairs(dealt: DataFrame, row: str, cell: str) -> DataFrame:
    """Deal the rows of a cell with ``k`` blocks to its pairs of blocks, each whole in one sorted run.

    A cell of one block stays as it is. With more, a row goes to the k pairs of
    its block; ``mine`` tells the side: 0 the lower block, 1 the upper one.
    """
    own: Column = F.pmod(F.xxhash64(F.lit("block"), row), F.col("k"))
    out = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    unit = F.xxhash64(cell, F.least("own", "other"), F.greatest("own", "other"))
    keyed = out.select(unit.alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("mine"), row)
    return keyed.repartition("unit").sortWithinPartitions("unit", "mine")


def _searcher(max_bits: int):
    base, flips, extra = _references()
    pivots = np.array([base, *extra, *flips], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, _, fps in runs(batches):
            fps = fps.view(np.uint64)
            a, b = _survivors(units, fps, pivots, max_bits)
            if len(a):
                low = forest(len(fps), a, b)
                moved = np.nonzero(low != np.arange(len(fps)))[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[moved].view(np.int64)), pa.array(fps[low[moved]].view(np.int64))], ["a", "b"])

    return run


def runs(batches: Iterator[pa.RecordBatch], size: int = 65_536) -> Iterator[list[np.ndarray]]:
    """Whole units of a stream sorted by its first column, several small ones together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= size:
            merged = [np.concatenate(c) for c in zip(*held)]
            keep = int(np.searchsorted(merged[0], merged[0][-1], "left"))
            if keep:
                yield [c[:keep] for c in merged]
            held = [[c[keep:] for c in merged]]
    if held and len(held[0][0]):
        yield [np.concatenate(c) for c in zip(*held)]


def _survivors(units: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows with the same unit. Small units are compared all at once by offset,
    larger ones row block by row block."""
    table = np.stack([np.bitwise_count(fps ^ p) for p in pivots]).astype(np.int8)
    starts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(units)])))
    found = []
    small = np.repeat(sizes <= 64, sizes)
    for step in range(1, 64):
        i = np.flatnonzero((units[:-step] == units[step:]) & small[:-step]) if step < len(units) else []
        if not len(i):
            break
        found.append(_verify(i, i + step, table, fps, max_bits))
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        for c in range(s, s + n, 256):
            d = min(c + 256, s + n)
            i, j = np.divmod(np.arange((d - c) * (s + n - c)), s + n - c)
            i, j = i + c, j + c
            found.append(_verify(i[i < j], j[i < j], table, fps, max_bits))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _verify(i: np.ndarray, j: np.ndarray, table: np.ndarray, fps: np.ndarray, max_bits: int):
    for row in table:  # the largest coordinate difference decides; most pairs go at the first ones
        near = np.abs(row[i] - row[j]) <= max_bits
        i, j = i[near], j[near]
        if not len(i):
            return i, j
    near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return i[near], j[near]
