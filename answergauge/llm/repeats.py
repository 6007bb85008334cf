"""Removal of repeated byte strings: suffix order inside shards of equal content.

Every string of ``length`` bytes is a window. A window's anchor is its gram with
the smallest hash; equal windows have equal anchors, and neighbouring windows
mostly share theirs, so there are few. Blocks of documents ask how often their
anchors occur; most occur once, and their windows cannot repeat. For the others
a block sends the stretch of text that the anchor's windows cover to the shard
of the anchor, equal stretches once. In a shard, equal stretches are settled at
once, and the different ones are put in suffix order (``suffix_order``); windows
that are equal stand next to each other there, and all but the earliest are
marked. Anchors of very many documents (a common line) do not gather in a shard:
their windows are dealt out one by one, by the hash of their own content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import arrow_table, block_count, input_rows, packed, slices, stored, unpacked
from answergauge.llm.suffix_order import suffix_order

GRAM = 32  # a power of two
BLOCK_BYTES = 16_000_000
SHARDS_PER_BLOCK = 8
HOT = 5_000  # occurrences of an anchor beyond which its windows are dealt out one by one
CHUNK = 1 << 22  # bytes of a long text looked at together

_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
_ANSWERED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("codes", pa.binary())])
# kind: 0 stretches of text, 1 hashes of single windows, 2 marks that a block settled itself
_SENT = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("doc", pa.binary()),
                   ("start", pa.binary()), ("size", pa.binary()), ("key", pa.binary()), ("data", pa.binary())])
_MARKS = pa.schema([("block", pa.int64()), ("doc", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left): one row per input row.

    Removed is every byte of a ``length``-byte string that also starts earlier:
    in a row with a smaller id or earlier in the same row. Rows of the same id
    are ordered by their text; of rows that are equal altogether one is the first.
    A null id comes before all others. Null and empty texts, and texts
    shorter than ``length``, lose nothing. An empty table gives an empty result.
    """
    rows = input_rows(docs, id_col, text_col)
    n_blocks = block_count(rows, BLOCK_BYTES)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    buckets, shards = max(8, n_blocks), SHARDS_PER_BLOCK * max(8, n_blocks)

    answers = stored(
        dealt.groupBy("block").applyInArrow(lambda t: _ask(t, length, buckets), _ddl(_ASKED))
        .groupBy("bucket").applyInArrow(lambda t: _answer(t, hot), _ddl(_ANSWERED)), "repeats-anchors")
    sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda t, a: _send(t, a, length, buckets, shards), _ddl(_SENT))
    marks = stored(sent.groupBy("kind", "shard").applyInArrow(lambda t: _settle(t, length), _ddl(_MARKS)), "repeats-marks")
    out = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut, _ddl(_RESULT))
    return out if with_text else out.drop("kept")


def _documents(table: pa.Table) -> tuple[np.ndarray, list[tuple[int | None, np.ndarray]]]:
    """Row numbers in the order of ids and texts, with (id, bytes)."""
    ids, texts = table.column("id").to_pylist(), [t.encode() for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [(ids[i], np.frombuffer(texts[i], np.uint8)) for i in order]


def _ordinals(documents: list) -> np.ndarray:
    """(id, place among the rows of that id) of each document as two numbers that sort like the rows do."""
    out = np.zeros((len(documents), 2), np.uint64)
    place, last = 0, object()
    for k, (doc_id, _) in enumerate(documents):
        place = place + 1 if doc_id == last else 0
        last = doc_id
        # a null id takes the lowest number's first places, before rows that hold that number
        out[k] = (0, place) if doc_id is None else (doc_id + 2**63, place + (2**40 if doc_id == -2**63 else 0))
    return out


def _anchors(text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of a text: anchors' positions, first and last start of each one's windows."""
    for base in range(0, max(0, len(text) - length + 1), CHUNK):
        part = text[base:base + CHUNK + length - 1]
        h, k = part.astype(np.uint32), 1
        while k < GRAM:  # hash of 2k bytes from those of k and k
            h = h[:-k] * np.uint32(0x9E3779B1) + h[k:]
            h ^= h >> np.uint32(15)
            k *= 2
        h *= np.uint32(0x85EBCA77)
        lowest = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        window, width = length - GRAM + 1, 1
        while 2 * width <= window:
            lowest = np.minimum(lowest[:-width], lowest[width:])
            width *= 2
        if width < window:
            lowest = np.minimum(lowest[:width - window], lowest[window - width:])
        at = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts, [len(at)])) - 1
        yield base + at[first], base + first, base + last


def _keyed(documents: list, length: int) -> tuple[np.ndarray, ...]:
    """All anchors of a block: document number, position, first and last window, 64-bit key."""
    from xxhash import xxh3_64_intdigest as digest

    parts, keys = [], []
    for k, (_, text) in enumerate(documents):
        raw = text.tobytes()
        for at, first, last in _anchors(text, length):
            parts.append((np.full(len(at), k), first, last))
            keys.append(np.fromiter((digest(raw[p:p + GRAM]) for p in at.tolist()), np.uint64, len(at)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    return *(np.concatenate(x) for x in zip(*parts)), np.concatenate(keys)


def _ask(table: pa.Table, length: int, buckets: int) -> pa.Table:
    *_, keys = _keyed(_documents(table), length)
    distinct, times = np.unique(keys, return_counts=True)
    borders, block = slices(distinct, buckets), table.column("block")[0].as_py()
    out = []
    for b in range(buckets):
        part = distinct[borders[b]:borders[b + 1]]
        if len(part):
            steps = np.concatenate((part[:1], np.diff(part)))
            out.append((b, block, packed(steps), packed(times[borders[b]:borders[b + 1]])))
    return arrow_table(out, _ASKED)


def _answer(table: pa.Table, hot: int) -> pa.Table:
    """For each distinct anchor of each block: 0 occurs once, 1 repeats, 2 is hot."""
    keys = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
    times = np.concatenate([unpacked(t.as_py()) for t in table.column("times")])
    merged, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=times.astype(float), minlength=len(merged))
    codes = ((total > 1).astype(np.uint8) + (total > hot))[place]
    out, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for block, own in zip(table.column("block").to_pylist(), keys):
        out.append((bucket, block, codes[at:at + len(own)].tobytes()))
        at += len(own)
    return arrow_table(out, _ANSWERED)


def _send(table: pa.Table, answers: pa.Table, length: int, buckets: int, shards: int) -> pa.Table:
    if not len(table) or not len(answers):
        return _SENT.empty_table()
    from xxhash import xxh3_128_digest as digest

    documents = _documents(table)
    ordinal, block = _ordinals(documents), table.column("block")[0].as_py()
    doc, first, last, keys = _keyed(documents, length)
    replies = sorted(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()))
    codes = np.frombuffer(b"".join(c for _, c in replies), np.uint8)
    distinct, place = np.unique(keys, return_inverse=True)
    code = codes[place]
    seen: set[tuple[int, bytes]] = set()
    raw = [t.tobytes() for _, t in documents]
    stretches: dict[int, list] = {}
    windows: dict[int, list] = {}
    settled = []
    for i in np.flatnonzero(code).tolist():
        d, a, z, key = int(doc[i]), int(first[i]), int(last[i]), int(keys[i])
        part = raw[d][a:z + length]
        if (key, part) in seen:  # an earlier stretch of this block is equal: all its windows repeat
            settled.append((d, a, z + length))
        else:
            seen.add((key, part))
            if code[i] == 1:
                stretches.setdefault(key % shards, []).append((d, a, len(part), key, part))
            else:
                for w in range(z - a + 1):
                    h = digest(part[w:w + length])
                    windows.setdefault(h[0] * 256 + h[1], []).append((d, a + w, 0, 0, h))
    out = []
    for kind, groups in ((0, stretches), (1, windows)):
        for shard, items in groups.items():
            d, start, size, key, data = zip(*items)
            out.append((kind, shard % shards, block, ordinal[list(d)].tobytes(), packed(np.array(start)), packed(np.array(size)),
                        packed(np.array(key, np.uint64)), zstandard.compress(b"".join(data))))
    if settled:
        d, start, end = zip(*settled)
        out.append((2, block, block, ordinal[list(d)].tobytes(), packed(np.array(start)), packed(np.array(end)), b"", b""))
    return arrow_table(out, _SENT)


def _settle(table: pa.Table, length: int) -> pa.Table:
    """Marked stretches of the documents, by the blocks they live in."""
    kind = table.column("kind")[0].as_py()
    if kind == 2:
        return pa.table([table.column(x).combine_chunks() for x in ("block", "doc", "start")] + [table.column("size").combine_chunks()],
                        schema=_MARKS)
    blocks = table.column("block").to_pylist()
    doc = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("doc")])
    start, size, key = (np.concatenate([unpacked(x.as_py()) for x in table.column(n)]).astype(t) for n, t in (
        ("start", np.int64), ("size", np.int64), ("key", np.uint64)))
    owner = np.repeat(blocks, [len(x.as_py()) // 16 for x in table.column("doc")])
    data = b"".join(map(zstandard.decompress, table.column("data").to_pylist()))
    order = np.lexsort((start, doc[:, 1], doc[:, 0]))  # earliest first
    if kind == 1:
        later = _later(np.frombuffer(data, np.uint64).reshape(-1, 2)[order])
        marked = order[later]
        return _marks(owner[marked], doc[marked], start[marked], start[marked] + length)
    ends = np.cumsum(size)
    part = [data[e - n:e] for e, n in zip(ends.tolist(), size.tolist())]
    seen: dict[tuple[int, bytes], None] = {}
    equal = []
    chosen = []
    for i in order.tolist():
        k = (int(key[i]), part[i])
        if k in seen:
            equal.append(i)
        else:
            seen[k] = None
            chosen.append(i)
    equal = np.array(equal, np.int64)
    whole = (owner[equal], doc[equal], start[equal], start[equal] + size[equal])
    kept = np.array(chosen, np.int64)
    # an anchor with one stretch has nothing to compare
    _, place, times = np.unique(key[kept], return_inverse=True, return_counts=True)
    kept = kept[times[place] > 1]
    if not len(kept):
        return _marks(*whole)
    text = np.frombuffer(b"".join(part[i] for i in kept.tolist()), np.uint8)
    item = np.repeat(np.arange(len(kept)), size[kept])
    begin = np.cumsum(size[kept]) - size[kept]
    inside = np.arange(len(text)) - begin[item]
    is_window = inside + length <= size[kept][item]
    suffixes = suffix_order(text)
    suffixes = suffixes[is_window[suffixes]]
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    group = np.zeros(len(suffixes), np.int64)
    for c in range(1, len(suffixes), 20_000):  # where the common prefix with the suffix before is too short
        d = min(c + 20_000, len(suffixes))
        rows = view[suffixes[c - 1:d]]
        group[c:d] = (rows[1:] != rows[:-1]).any(axis=1)
    group = np.cumsum(group)
    mine = item[suffixes]  # numbers of ``kept`` ascend with the order of the rows
    place = np.lexsort((inside[suffixes], mine, group))
    later = np.concatenate(([False], group[place][1:] == group[place][:-1]))
    at = suffixes[place[later]]
    windows = kept[item[at]]
    begin = start[windows] + inside[at]
    return _marks(*(np.concatenate(x) for x in zip(whole, (owner[windows], doc[windows], begin, begin + length))))


def _later(hashes: np.ndarray) -> np.ndarray:
    """Rows, given earliest first, that have an equal row before them."""
    order = np.lexsort((np.arange(len(hashes)), hashes[:, 1], hashes[:, 0]))
    same = np.concatenate(([False], (hashes[order][1:] == hashes[order][:-1]).all(axis=1)))
    return order[same]


def _marks(owner: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Marks by block, overlapping ones of a document joined."""
    out = []
    for block in np.unique(owner):
        mine = owner == block
        d, s, e = _joined(doc[mine], start[mine], end[mine])
        out.append((int(block), d.tobytes(), packed(s), packed(e)))
    return arrow_table(out, _MARKS)


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of overlapping or touching stretches."""
    order = np.lexsort((start, doc[:, 1], doc[:, 0]))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new = np.concatenate(([True], (doc[1:] != doc[:-1]).any(axis=1)))
    # running maximum of ends within a document: documents are told apart by a growing step
    step = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + step)
    new[1:] |= start[1:] + step[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], reach[last] - step[last]


def _cut(table: pa.Table, marks: pa.Table) -> pa.Table:
    if not len(table):
        return _RESULT.empty_table()
    documents = _documents(table)
    ordinal = _ordinals(documents)
    spans: dict[tuple[int, int], list] = {}
    if len(marks):
        doc = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in marks.column("doc")])
        start, end = (np.concatenate([unpacked(x.as_py()) for x in marks.column(n)]).astype(np.int64) for n in ("start", "end"))
        for d, s, e in zip(*(x.tolist() for x in _joined(doc, start, end))):
            spans.setdefault(tuple(d), []).append((s, e))
    out = []
    for (doc_id, text), own in zip(documents, ordinal.tolist()):
        raw, at, kept, removed = text.tobytes(), 0, [], spans.get(tuple(own), [])
        for s, e in removed:
            kept.append(raw[at:s])
            at = e
        rest = b"".join([*kept, raw[at:]])
        out.append((doc_id, len(raw), len(raw) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), rest))
    return arrow_table(out, _RESULT)
