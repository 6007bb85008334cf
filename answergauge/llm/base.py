"""What the operators share: stored tables, words, folds, link forests and components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.session import stored


def input_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` (long) and ``text`` (a null text is empty); other columns do not matter."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_where(docs: DataFrame, text_col: str, test: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes ``test``; a null text is tested as an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(test(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of text each, or of one text that is longer.

    What a task makes of a piece, lists of words or lines, then has a bounded
    size however long the texts of a batch are. No row is copied.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


_WORKER: dict[tuple, object] = {}


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks; that of another operator is let go."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def give_back() -> None:
    """Return what a Python worker has freed to the machine; its allocators would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def lower_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at the bytes 0x20 and 0x09-0x0D (what ``bytes`` methods do)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def block_count(rows: DataFrame, block_bytes: int, block_docs: int = 40_000) -> int:
    """How many blocks of about so many bytes, or so many documents, the texts of ``input_rows`` need."""
    total = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return max(1, int((total[0] or 0) / block_bytes), int(total[1] / block_docs))


def packed(x: np.ndarray) -> bytes:
    """Byte planes of unsigned numbers: their equal high bytes then compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets, equal ranges of 64-bit hashes, in sorted keys."""
    borders = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, borders, "left"), [len(keys)]))


def arrow_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def sorted_units(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """A stream that is sorted by ``columns``, whole numbers, as one table for each of their values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = np.vstack([batch.column(c).to_numpy() for c in columns])
        borders = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(c)[0].as_py() != v for c, v in zip(columns, values[:, 0].tolist())):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *borders], [*borders, len(batch)]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest linked row of each of ``n`` rows, given links (i, j) inside one task."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, component), the smallest node reachable.

    Alternating large-star and small-star steps on whole edge tables: each pass
    hangs neighbours on the smallest node near them, in a logarithmic number of
    passes even for chains. Every pass is two shuffles per step; a hub's edges
    are never gathered, since minima combine before the shuffle and the join
    back is one that adaptive execution splits. Self-loops only name a node.
    Empty input gives an empty result.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), purpose)
    state = _signature(edges)
    while state[0]:
        edges = stored(_star(_star(edges, large=True), large=False), purpose)
        now = _signature(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges point from the larger node a to the smaller node b."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    lowest = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    met = around.join(lowest, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()
