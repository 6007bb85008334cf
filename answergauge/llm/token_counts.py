"""Token counts by a two-tier table of pre-token lengths.

A first pass counts pre-tokens inside each task and sends on only the task's
most frequent ones, a bounded list. Their lengths make a compact table that is
broadcast. A second pass sums lengths from that table; a pre-token that misses
it goes through the worker's own cache, and what that does not know is encoded.
Pre-tokens are never shuffled.

A pre-token is a run of spaces and the characters up to the next space; line
feeds stand alone. No piece of the vocabulary reaches over such a border (it is
checked when the model is loaded), so the lengths add up to the library's count.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import input_rows, worker_cache

_RUNS = re.compile(r" *[^ ]+| +")


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    table_size: int = 50_000, per_task: int = 20_000, longest: int = 48, cache_size: int = 400_000,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``): one row per input row.

    The broadcast holds at most ``table_size`` pre-tokens of at most ``longest``
    characters, whatever the input; a worker cache holds ``cache_size`` and starts
    afresh when full. Both only decide where a length is found, never its value.
    Null and empty texts have 0 tokens; repeated rows and null ids stay as rows;
    an empty table gives an empty result.
    """
    rows = input_rows(docs, id_col, text_col)
    table = _frequent(rows, model_path, table_size, per_task, longest)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(model_path)
        frequent = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [_length(t, frequent, cache, model, cache_size) for t in texts]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), n,
                 pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _frequent(rows: DataFrame, model_path: str, size: int, per_task: int, longest: int) -> dict[str, int]:
    """Lengths of the ``size`` pre-tokens (one space and a word) with most occurrences in the tasks' lists."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(text.replace("\n", " ").split(" "))
                if len(seen) > 8 * per_task:  # lossy count: rare words start again
                    seen = Counter(dict(heapq.nlargest(4 * per_task, seen.items(), key=lambda x: x[1])))
        best = heapq.nlargest(per_task, ((n, w) for w, n in seen.items() if 0 < len(w) <= longest))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for _, w in best], pa.string()), pa.array([n for n, _ in best], pa.int64())], ["word", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(model_path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            lengths = [len(x) for x in model.encode(words, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(lengths, pa.int64())], ["word", "n"])

    listed = rows.select("text").mapInArrow(top, "word string, n long")
    best = listed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return dict(map(tuple, best.select("word").mapInArrow(measure, "word string, n long").collect()))


def _model(path: str) -> tuple:
    """The model and the lengths known so far."""
    def load() -> tuple:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary reaches over spaces or line feeds")
        return model, {}

    return worker_cache(("token counts", path), load)


def _length(text: str, frequent: dict, cache: dict, model, cache_size: int) -> int:
    if not text:
        return 0
    total, missing = 0, []
    # the library puts one space before a text and takes U+2581 for a space
    for k, line in enumerate((" " + text.replace("▁", " ")).split("\n")):
        first, *words = line.split(" ")
        if "" in words:
            first, *words = _RUNS.findall(line) or [""]
            if first.startswith(" "):
                words, first = [first, *words], ""
            words = [w[1:] for w in words]  # one space is implied
        total += k > 0
        if first:
            missing.append("\n" + first)  # encoded without a space before it
        lengths = list(map(frequent.get, words))
        if None in lengths:
            missing += [w for w, n in zip(words, lengths) if n is None]
            lengths = filter(None, lengths)
        total += sum(lengths)
    if missing:
        unknown = [w for w in dict.fromkeys(missing) if w not in cache]
        if unknown:
            if len(cache) + len(unknown) > cache_size:
                cache.clear()
                unknown = list(dict.fromkeys(missing))
            for w, ids in zip(unknown, model.encode(unknown, num_threads=1)):
                # a lone space is one piece, but encodes as an empty text does
                cache[w] = len(ids) - 2 if w.startswith("\n") else len(ids) or 1
        total += sum(map(cache.__getitem__, missing))
    return total
