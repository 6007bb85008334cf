"""Near-duplicate lines: a segment-partition edit join.

A line is split into ``threshold + 1`` segments. If another line is at most
``threshold`` edits away, one of its segments occurs in that line unchanged, near
its own place. So every line puts its segments into an index by (length, number,
content), and probes it with those of its own substrings that can match a
segment of a line as long as itself or up to ``threshold`` characters shorter;
which starts are possible follows from the length difference and from the edits
that must lie on either side. Candidates are verified with a banded bit-parallel
edit distance.

Lines are joined once per distinct text. A segment that very many lines share
would give many candidates, so each row carries the parities of the line's
character counts: an edit changes two of them at most, and lines that meet only
lines that differ in more never leave the join.

Pairs are not emitted. A task gives the number of links per line and the links
of a spanning forest; a pair that shares several segments is compared, and
counted, at the first of them.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import bounded, components, forest, input_rows, sorted_units, spare_name, stored

THRESHOLD = 2
MIN_CHARS = 20
SHORT_THRESHOLD, SHORT_MIN_CHARS = 1, 10  # as for long lines, an edit for every ten characters
CELLS = 4_000_000  # characters compared at a time in a task
SLICE, PAIRS = 256, 50_000  # lines, and pairs, compared at a time
BLOCK_LINES, BLOCK_BYTES = 2048, 8_000_000  # of each side in a task
SIEVE_BITS = 1 << 25
SEEN = 200_000  # lines that a task remembers so as not to send a copy again


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return input_rows(docs, id_col, text_col).withColumn("row", F.xxhash64("id", "text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of id and text), line_no (from 0), line (64-bit hash of the text), chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in bounded(batches, "text"):
            parts = [t.split("\n") for t in batch.column("text").to_pylist()]
            times = np.fromiter(map(len, parts), np.int64, len(parts))
            every = list(itertools.chain.from_iterable(parts))
            whole = np.repeat(np.arange(len(parts)), times)
            place = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
            hashes = np.fromiter((digest(p.encode()) for p in every), np.uint64, len(every)).view(np.int64)
            chars = np.fromiter(map(len, every), np.int64, len(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(whole)), batch.column("row").take(pa.array(whole)), pa.array(place),
                 pa.array(hashes), pa.array(chars)], ["doc_id", "row", "line_no", "line", "chars"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, row long, line_no long, line long, chars long")


def _wanted_texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(line, text) of the lines in ``wanted``: a bitmap of fixed size keeps most other lines out of the shuffle."""
    at = F.pmod("line", F.lit(SIEVE_BITS)) + 1  # bitmaps count from 1
    found = wanted.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)))
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    for k, part in found.collect():  # parts of 4096 bytes
        sieve[(k - 1) * 4096:k * 4096] |= np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(sieve.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in bounded(batches, "text"):
            every = [p for t in batch.column("text").to_pylist() for p in t.split("\n")]
            hashes = np.fromiter((digest(p.encode()) for p in every), np.uint64, len(every)).view(np.int64)
            number = hashes % SIEVE_BITS
            keep = np.flatnonzero(bits[number >> 3] >> (number & 7).astype(np.uint8) & 1)
            if len(seen) > SEEN:
                seen.clear()
            new = [i for i in keep.tolist() if not (hashes[i] in seen or seen.add(hashes[i]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[new]), pa.array([every[i] for i in new], pa.string())], ["line", "text"])

    kept = _rows(docs, id_col, text_col).mapInArrow(run, "line long, text string")
    return kept.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text"))


def join_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short_lines: bool = False,
) -> DataFrame:
    """One row per line of a document: doc_id, row, line_no, line, n_copies, n_links, component, first_doc, first_row,
    first_line, kept.

    ``line`` is the class of equal lines, ``n_copies`` its size, ``n_links`` the
    number of different lines within ``threshold`` edits (characters inserted,
    removed or replaced), ``component`` what is reachable over links, and first_*
    its first line by (doc_id, row, line_no); ``kept`` marks that one. Lines
    under ``min_chars`` characters are ordinary repeats: they form classes, link
    with nothing and are all kept. With ``short_lines`` they count as well: lines
    of SHORT_MIN_CHARS or more link at SHORT_THRESHOLD edits, shorter ones only
    equal each other, and all but empty lines are kept once. A null text is one empty line, and so is an
    empty one; a null id comes before others; rows that repeat both id and text are
    one document in this result's keys; an empty table gives an empty result.
    """
    found = stored(lines(docs, id_col, text_col), "edit-join-lines")
    links = line_links(docs, id_col, text_col, threshold, min_chars)
    if short_lines:
        links = links.unionByName(line_links(docs, id_col, text_col, SHORT_THRESHOLD, SHORT_MIN_CHARS, min_chars))
    links = stored(links, "edit-join-links")
    counts = links.groupBy("line").agg(F.sum("links").alias("n_links"))
    groups = components(links.where("other is not null").select(F.col("line").alias("a"), F.col("other").alias("b")),
                        "edit-join-groups").withColumnRenamed("node", "line")
    place = F.struct("doc_id", "row", "line_no")
    classes = found.groupBy("line").agg(
        F.min(place).alias("first"), F.count("*").alias("n_copies"), F.max("chars").alias("chars"))
    classes = stored(
        classes.join(counts, "line", "left").join(groups, "line", "left").select(
            "line", "first", "n_copies", "chars", F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "line").alias("component")), "edit-join-classes")
    firsts = classes.groupBy("component").agg(F.min("first").alias("first"))
    per_line = classes.drop("first").join(firsts, "component")
    return found.drop("chars").join(per_line, "line").select(
        "doc_id", "row", "line_no", "line", "n_copies", "n_links", "component", F.col("first.doc_id").alias("first_doc"),
        F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_line"),
        ((F.col("chars") < (1 if short_lines else min_chars)) | place.eqNullSafe(F.col("first"))).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with the lines that ``join_lines`` does not keep taken out of the text.

    A document that loses all its lines stays with an empty text; a null text stays null.
    """
    row, taken = spare_name(docs, "_row"), spare_name(docs, "_gone")
    gone = join_lines(docs, id_col, text_col, threshold, min_chars, short_lines).where(~F.col("kept")).groupBy(
        F.col("row").alias(row)).agg(F.collect_set("line_no").alias(taken))
    text = F.col(text_col)
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(taken, i.cast("long"))), "\n")
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(text, F.lit(""))))
    return keyed.join(gone, row, "left").withColumn(
        text_col, F.when(F.col(taken).isNull() | text.isNull(), text).otherwise(left)).select(*docs.columns)


def line_links(docs: DataFrame, id_col: str, text_col: str, threshold: int, min_chars: int, below: int | None = None,
               block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (line, links, other) of the links between different lines; with ``below``, those whose shorter line has fewer characters.

    The ``links`` of a line add up to its number of links; (line, other), where
    set, are links of a spanning forest, so components over them are those over
    all links. No row stands for a pair: lines that share a key with a fitting
    line are found by semi-joins, and a key's lines are dealt into pairs of
    blocks, each compared in one task.
    """
    rows = _rows(docs, id_col, text_col)
    index = stored(
        rows.mapInArrow(_segments(threshold, min_chars, below, probe=False), "key long, line long, marks long"), "edit-join-index")
    probe = rows.mapInArrow(_segments(threshold, min_chars, below, probe=True), "key long, line long, marks long")
    # copies of a line in other tasks bring equal rows
    probing = stored(_meeting(probe, index, threshold, 1).distinct(), "edit-join-probing")
    members = stored(_meeting(index, probing, threshold, 0).distinct().unionByName(probing), "edit-join-members")
    texts = stored(_wanted_texts(docs, id_col, text_col, members.select("line").distinct()), "edit-join-texts")
    placed = members.join(texts, "line")
    blocks = placed.groupBy("key").agg(*(
        F.greatest(F.ceil(F.count_if(F.col("side") == side) / block_lines),
                   F.ceil(F.sum(F.when(F.col("side") == side, F.octet_length("text"))) / block_bytes)).alias(name)
        for side, name in ((0, "own"), (1, "others"))))
    own, others = (F.pmod(F.xxhash64("line"), F.col(c)) for c in ("own", "others"))
    first = F.col("side") == 0
    dealt = placed.join(blocks, "key").select(
        "key", "side", "line", "marks", "text", F.when(first, own).otherwise(others).alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(first, F.col("others")).otherwise(F.col("own")) - 1)).alias("met"))
    units = dealt.select(
        "key", F.when(first, F.col("mine")).otherwise(F.col("met")).alias("a"),
        F.when(first, F.col("met")).otherwise(F.col("mine")).alias("b"), "side", "line", "marks", "text")
    return units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(
        _comparer(threshold, min_chars), "line long, links long, other long")


def _meeting(rows: DataFrame, others: DataFrame, threshold: int, side: int) -> DataFrame:
    """The ``rows`` that share their key with another line whose characters may be those of a line ``threshold`` edits away."""
    other = others.select(F.col("key").alias("k"), F.col("line").alias("l"), F.col("marks").alias("m"))
    fits = (F.col("line") != F.col("l")) & (F.bit_count(F.col("m").bitwiseXOR(F.col("marks"))) <= 2 * threshold)
    return rows.join(other, (F.col("key") == F.col("k")) & fits, "left_semi").withColumn("side", F.lit(side))


def cut(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the ``threshold + 1`` segments; the last ones are one longer where it does not divide."""
    short, longer = divmod(length, threshold + 1)
    out, at = [], 0
    for i in range(threshold + 1):
        n = short + (i >= threshold + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, threshold: int, min_chars: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, length) of every substring to look up.

    Before segment i at most i edits are to be assumed, after it threshold - i:
    other matches of the same pair are then found at another segment."""
    out = []
    for other in range(max(min_chars, length - threshold), length + 1):
        longer = length - other
        for i, (at, n) in enumerate(cut(other, threshold)):
            first = max(at - i, at + longer - (threshold - i), 0)
            last = min(at + i, at + longer + (threshold - i), length - n)
            out += [(other, i, start, n) for start in range(first, last + 1)]
    return out


# one bit for each of 32 kinds of characters, told apart by their first byte; none for a character's further bytes
_KINDS = np.where((np.arange(256) & 0xC0) == 0x80, 0, 1 << (np.arange(256) & 31)).astype(np.uint32)


def _marks(raws: list[bytes]) -> np.ndarray:
    """Parities of the counts of 32 kinds of characters in each (non-empty) line."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    joined = np.frombuffer(b"".join(raws), np.uint8)
    return np.bitwise_xor.reduceat(_KINDS[joined], np.cumsum(sizes) - sizes).astype(np.int64) if len(raws) else np.empty(0, np.int64)


def _segments(threshold: int, min_chars: int, below: int | None, probe: bool):
    # a longer line probes for shorter ones, so it may be up to ``threshold`` characters beyond what is indexed
    most = float("inf") if below is None else below - 1 + (threshold if probe else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        plans: dict[int, list] = {}
        seen: set[int] = set()
        for batch in bounded(batches, "text"):
            keys, names, raws, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                for line in text.split("\n"):
                    n = len(line)
                    if n < min_chars or n > most:
                        continue
                    raw = line.encode()
                    name = digest(raw)
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    if n not in plans:
                        plans[n] = (probes(n, threshold, min_chars) if probe
                                    else [(n, i, at, k) for i, (at, k) in enumerate(cut(n, threshold))])
                    if len(raw) == n:
                        keys += [digest(raw[at:at + k], o * 64 + i) for o, i, at, k in plans[n]]
                    else:
                        keys += [digest(line[at:at + k].encode(), o * 64 + i) for o, i, at, k in plans[n]]
                    names.append(name)
                    raws.append(raw)
                    times.append(len(plans[n]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)),
                 pa.array(np.repeat(np.array(names, np.uint64), times).view(np.int64)),
                 pa.array(np.repeat(_marks(raws), times))], ["key", "line", "marks"])

    return run


def _comparer(threshold: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most keys have a few lines only: their pairs are compared together
        names, texts, held, chars = [], [], 0, 0
        for unit in sorted_units(batches, ("key", "a", "b")):
            of_unit = np.array(unit.column("text").to_pylist(), object)
            size = sum(map(len, of_unit))
            lines = unit.column("line").to_numpy()
            for i, j in _candidates(unit, lines, of_unit, threshold, min_chars):
                names.append((lines[i], lines[j]))
                texts.append((of_unit[i], of_unit[j]))
                held += len(i)
                if held >= PAIRS:
                    yield _counted(names, texts, threshold)
                    names, texts, held, chars = [], [], 0, 0
            chars += size
            if chars >= BLOCK_BYTES and held:
                yield _counted(names, texts, threshold)
                names, texts, held, chars = [], [], 0, 0
        if held:
            yield _counted(names, texts, threshold)

    return run


def _candidates(unit: pa.Table, names: np.ndarray, texts: np.ndarray, threshold: int,
                min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of a unit that are to be compared at its key, at most PAIRS at a time."""
    side, marks = unit.column("side").to_numpy(), unit.column("marks").to_numpy()
    own, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(own) or not len(others):
        return
    earlier = _earlier(unit.column("key")[0].as_py(), texts[own], texts[others], threshold, min_chars)
    # of two lines of one length the smaller is looked up, so that the pair is met once
    length = len(texts[own[0]])
    longer = np.array([len(texts[j]) > length for j in others])
    for s in range(0, len(own), SLICE):
        part = own[s:s + SLICE]
        may = np.bitwise_count(marks[part, None] ^ marks[None, others]) <= 2 * threshold
        may &= longer[None, :] | (names[part, None] < names[None, others])
        for mine, theirs in earlier:
            for column in theirs.T:
                may &= mine[s:s + SLICE, None] != column[None, :]
        i, j = np.nonzero(may)
        for c in range(0, len(i), PAIRS):
            yield part[i[c:c + PAIRS]], others[j[c:c + PAIRS]]


def _counted(names: list[tuple], texts: list[tuple], threshold: int) -> pa.RecordBatch:
    """Links per line, and spanning links, among these candidates."""
    a, b = (np.concatenate(x) for x in zip(*names))
    s, t = (np.concatenate(x) for x in zip(*texts))
    near = banded_distances(s, t, threshold) <= threshold
    different, node = np.unique(np.concatenate((a[near], b[near])), return_inverse=True)
    counts = np.bincount(node, minlength=len(different))
    moved, low = _spanning(len(different), *node.reshape(2, -1))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((different, different[moved]))),
         pa.array(np.concatenate((counts, np.zeros(len(moved), np.int64)))),
         pa.array([None] * len(different) + different[low].tolist(), pa.int64())], ["line", "links", "other"])


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (i, j) connect: fewer than ``n``."""
    low = forest(n, i, j)
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


@functools.lru_cache(10_000)
def _starts(length: int, other: int, threshold: int, min_chars: int) -> list[list[int]]:
    """For each segment of lines with ``other`` characters, where a line of ``length`` may hold it."""
    out = [[] for _ in range(threshold + 1)]
    for o, i, start, _ in probes(length, threshold, min_chars):
        if o == other:
            out[i].append(start)
    return out


def _earlier(key: int, own: np.ndarray, others: np.ndarray, threshold: int, min_chars: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What tells that a pair of this key meets at an earlier segment as well, where it is compared already.

    For each segment before the key's: numbers of the indexed lines' segments,
    and of the probing lines' possible matches of it (-1: none)."""
    from xxhash import xxh3_64_intdigest as digest

    length = len(own[0])
    segments = cut(length, threshold)
    key %= 1 << 64
    number = next(i for i, (at, n) in enumerate(segments) if digest(own[0][at:at + n].encode(), length * 64 + i) == key)
    plans = [_starts(len(t), length, threshold, min_chars) for t in others]
    out = []
    for i, (at, n) in enumerate(segments[:number]):
        ids: dict[str, int] = {}
        mine = np.array([ids.setdefault(t[at:at + n], len(ids)) for t in own])
        theirs = np.full((len(others), max(len(plan[i]) for plan in plans)), -1)
        for r, (t, plan) in enumerate(zip(others, plans)):
            for c, start in enumerate(plan[i]):
                theirs[r, c] = ids.get(t[start:start + n], -1)
        out.append((mine, theirs))
    return out


def banded_distances(s: list[str], t: list[str], threshold: int) -> np.ndarray:
    """Edit distance of each pair, ``threshold + 1`` where it is larger.

    A word per pair and number of edits e holds, one bit per diagonal of the band,
    which diagonals are reachable with e edits; one step per character of t moves
    the words of all pairs at once."""
    out = np.full(len(s), threshold + 1, np.int32)
    order = sorted((i for i in range(len(s)) if abs(len(s[i]) - len(t[i])) <= threshold), key=lambda i: len(t[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at) * len(t[order[end]]) < CELLS:
            end += 1
        part = order[at:end]
        out[part] = _banded([s[i] for i in part], [t[i] for i in part], threshold)
        at = end
    return out


def _matrix(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Characters by place (rows) and text (columns)."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in texts])
    out = np.full((width, len(texts)), pad, np.uint32)
    column = np.repeat(np.arange(len(texts)), lengths)
    out[np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = joined
    return out


def _banded(s: list[str], t: list[str], threshold: int) -> np.ndarray:
    m, n = np.array([len(x) for x in s]), np.array([len(x) for x in t])
    width = int(n.max(initial=0))
    a = np.vstack([np.full((threshold, len(s)), 0xFFFFFFFF, np.uint32),
                   _matrix(s, max(width, int(m.max(initial=0))) + threshold + 1, 0xFFFFFFFF)])
    b = _matrix(t, width, 0xFFFFFFFE)
    kind = np.uint16 if threshold < 8 else np.uint64
    band = kind((1 << (2 * threshold + 1)) - 1)
    reach = [np.full(len(s), ((1 << (e + 1)) - 1) << threshold, kind) & band for e in range(threshold + 1)]
    result = np.full(len(s), threshold + 1, np.int32)

    def finish(j: int) -> None:
        done = n == j
        if done.any():
            goal = np.left_shift(kind(1), (m - n + threshold).astype(kind))
            for e in range(threshold, -1, -1):
                result[done & ((reach[e] & goal) != 0)] = e

    for j in range(width):
        finish(j)
        equal = np.zeros(len(s), kind)
        for d in range(2 * threshold + 1):
            equal |= (a[j + d] == b[j]).astype(kind) << kind(d)
        new = [reach[0] & equal]
        for e in range(1, threshold + 1):
            replaced, inserted, removed = reach[e - 1], reach[e - 1] >> kind(1), new[e - 1] << kind(1)
            new.append(((reach[e] & equal) | replaced | inserted | removed) & band)
        reach = new
        if not reach[threshold].any():
            break
    else:
        finish(width)
    return result
