"""Packing documents into fixed token windows: concatenate and cut.

Pass one encodes each text once and writes its ids, with the number of ids that
its own task wrote before it. The tasks' totals, one small row each, give every
task its start by a prefix sum. In pass two a document's global offset is then
plain arithmetic, and it is cut wherever a multiple of the window falls.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answergauge.llm.base import bounded, input_rows, stored, worker_cache

_PUNCTUATION = b".,!?;:|#$%&*"
# the byte-level alphabet by its rule: bytes without a visible character of their own take those from 256 on, in order
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, padded_length long")


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_size: int = 300_000,
) -> DataFrame:
    """One row per piece: which ids of a document stand where in which sequence.

    A document's ids are its text's (a null text is empty) and ``end_id``. All
    sequences are full but the last; that one is padded to the window unless its
    length is a power of two (``padded_length``). ``with_ids`` adds the piece's
    ids as little-endian bytes. Repeated rows and null ids are documents of their
    own; an empty table gives no piece. Any file of the ``tokenizers`` library is
    right; one whose tokens cannot be told word by word encodes whole texts, slower.
    """
    tokens = stored(_encoded(docs, tokenizer_path, end_id, id_col, text_col, cache_size), "packing")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("part_n"))  # one row per task
    starts = stored(totals.select(
        "part", F.sum("part_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("first"),
        F.sum("part_n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all")),
        "packing-starts")  # as a table its size is known, and Spark broadcasts it while it is small
    placed = tokens.join(starts, "part").select(
        "doc_id", "ids", "wide", (F.coalesce("first", F.lit(0)) + F.col("before")).alias("at"), "all")
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, ids, wide, at, everything in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, window)
                    piece = ids[start:start + window - offset]
                    last = min(window, everything - sequence * window)
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset,
                                last if last & (last - 1) == 0 else window, *([piece.tobytes()] if with_ids else [])))
                    start += len(piece)
                    if len(out) == 4096:
                        yield _batch(out, with_ids)
                        out = []
            if out:
                yield _batch(out, with_ids)

    return placed.mapInArrow(cut, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:len(names)]]
    if with_ids:
        names, arrays = [*names, "ids"], [*arrays, pa.array([r[-1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names)


def _encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, cache_size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wide, cache, by_word = _model(path)
        end = np.array([end_id], "<u4" if wide else "<u2").tobytes()
        part, before, width = TaskContext.get().partitionId(), 0, 4 if wide else 2
        for batch in bounded(batches, "text", 8_000_000):
            blobs, ahead = [], []
            for text in batch.column("text").to_pylist():
                if by_word:
                    blobs.append(_ids(text, model, wide, cache, cache_size) + end)
                else:
                    ids = model.encode(text, add_special_tokens=False).ids
                    blobs.append(np.array(ids, "<u4" if wide else "<u2").tobytes() + end)
                ahead.append(before)
                before += len(blobs[-1]) // width
            k = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int64()), pa.array(ahead, pa.int64()),
                 pa.array([len(b) // width for b in blobs], pa.int64()), batch.column("id"),
                 pa.array([wide] * k, pa.bool_()), pa.array(blobs, pa.binary())],
                ["part", "before", "n", "doc_id", "wide", "ids"])

    return input_rows(docs, id_col, text_col).mapInArrow(
        run, "part long, before long, n long, doc_id long, wide boolean, ids binary")


def _model(path: str) -> tuple:
    """Tokenizer, whether its ids need four bytes, the words known so far, and whether words are encoded apart."""
    def load() -> tuple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return model, model.get_vocab_size() > 65_536, {}, _is_word_wise(json.loads(model.to_str()))

    return worker_cache(("packing", path), load)


# Settings of a tokenizer that lower-cases, drops white space and never lets a letter and a
# punctuation mark share a token.
_NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def _is_word_wise(settings: dict) -> bool:
    """Whether ``_ids`` gives what the library gives for a tokenizer with these settings."""
    normalizer, before, model = (settings[k] or {} for k in ("normalizer", "pre_tokenizer", "model"))
    return (
        normalizer.get("normalizers") == _NORMALIZERS and before.get("pretokenizers") == _PRE_TOKENIZERS
        and model.get("type") == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<|") and t["content"].endswith("|>") and not t["content"][2:-2].split()[1:]
                and not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"]
                for t in settings["added_tokens"]))


def _ids(text: str, model, wide: bool, cache: dict, cache_size: int) -> bytes:
    """The text's ids as bytes, word by word: this kind of tokenizer drops white space before it
    looks for tokens, so words between ASCII white space are encoded independently."""
    raw = text.encode()
    if b"|>" not in raw:
        raw = raw.lower()  # the tokenizer does so too, past its special strings
    words = raw.split()
    unknown = [w for w in dict.fromkeys(words) if w not in cache]
    if unknown:
        if len(cache) + 2 * len(unknown) > cache_size:
            cache.clear()
            unknown = list(dict.fromkeys(words))
        _learn(unknown, model, wide, cache)
    return b"".join(map(cache.__getitem__, words))


def _learn(words: list[bytes], model, wide: bool, cache: dict) -> None:
    """Encode words into the cache; a letter or digit and the punctuation after it never share a token."""
    split = {}
    for w in words:
        stem = w.rstrip(_PUNCTUATION)
        if len(stem) < len(w) and stem[-1:].isalnum() and b"|" not in stem:
            split[w] = stem, w[len(stem):]
    parts = dict.fromkeys(x for w in words for x in split.get(w, (w,)))
    kind, core, rest = "<u4" if wide else "<u2", model.model, []
    for p in parts:
        if p not in cache:
            word = p.decode()
            # a word of small letters only is one pre-token and goes to the merges as it is
            if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
                cache[p] = np.array([t.id for t in core.tokenize(p.decode("latin-1").translate(_BYTES))], kind).tobytes()
            else:
                rest.append(p)
    for p, e in zip(rest, model.encode_batch([p.decode() for p in rest], add_special_tokens=False)):
        cache[p] = np.array(e.ids, kind).tobytes()
    for w, (stem, end) in split.items():
        cache[w] = cache[stem] + cache[end]
