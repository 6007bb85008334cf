"""Deleted interpolation: a bigram language model mixed by context-frequency buckets.

``p(w | u) = a_k c(u, w) / c(u) + b_k c(w) / N + c_k / (V + 1)``, where k is the
bucket of the context's count c(u). The weights of a bucket come from
expectation-maximisation: a part of the training documents is deleted from the
counts and its bigrams, with the estimates of what remains, are the held-out
counts that the weights are learned on. Scores use the counts of all training
documents.

Documents are dealt into blocks by hash. A block asks for the counts of its
distinct words and bigrams with sorted arrays of 64-bit hashes, one array per
bucket of hashes; a bucket's task adds up the counts of all blocks and answers
each block with an array in the order of its question. So a corpus of n tokens
moves a few bytes per distinct bigram of a block, hot words meet as one number
per block, and no row stands for a token. (Two of m distinct n-grams share a hash
with a probability of about m^2 / 2^65.)
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import (
    arrow_table, block_count, fold, give_back, input_rows, lower_words, packed, slices, stored, unpacked)

FOLDS, HELD_OUT, DELETED = 7, 2, 3  # remainders: scored only; deleted from the counts that the weights learn with
BLOCK_BYTES, BLOCK_DOCS = 16_000_000, 40_000
PAIR_BUCKETS = 4  # a block's bigrams for each of its words' buckets; so a bucket of either has some megabytes
TOKENS = 300_000  # scored at a time
ROWS = 64  # in an Arrow batch
ITERATIONS = 12
LAST_BUCKET = 24  # contexts of 2^24 occurrences and more share a bucket
WORD, PAIR = 0, 1
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, bits_per_token double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token.

    A text's tokens are its words, A-Z lower-cased, and one end. A null text is
    empty and has the end only; a null id counts as an empty text in the fold.
    Repeated rows are scored, and counted, once each. Without training documents
    all counts are 0 and every token has the probability 1. An empty table gives
    an empty result.
    """
    rows = input_rows(docs, id_col, text_col)
    n_blocks = block_count(rows, BLOCK_BYTES, BLOCK_DOCS)
    dealt = rows.select(
        "id", "text", fold(F.col("id"), FOLDS).cast("int").alias("fold"),
        F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).alias("block"))
    # the deleted documents have blocks of their own, so that learning weights touches only those
    dealt = dealt.withColumn("block", F.col("block") * 2 + (F.col("fold") == DELETED).cast("int"))
    buckets = {WORD: max(8, n_blocks), PAIR: max(8, PAIR_BUCKETS * n_blocks)}
    asked = dealt.groupBy("block").applyInArrow(
        lambda t: _ask(t, buckets), "kind int, bucket int, block long, keys binary, trained binary, deleted binary")
    answers = stored(
        asked.groupBy("kind", "bucket").applyInArrow(
            _answer, "kind int, bucket int, block long, trained binary, kept binary, sizes array<long>"),
        "lm-answers")
    size = answers.where(F.size("sizes") > 0).groupBy("kind").agg(
        *(F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(4)))
    sums = {r["kind"]: [int(r[f"s{i}"] or 0) for i in range(4)] for r in size.collect()}
    vocabulary, n, _, kept_n = sums.get(WORD, [0, 0, 0, 0])
    replies = answers.select("kind", "bucket", "block", "trained", "kept")

    def learn(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
        return _held_out_counts(texts, counts, kept_n)

    deleted = dealt.where(F.col("block") % 2 == 1).groupBy("block").cogroup(
        replies.where(F.col("block") % 2 == 1).groupBy("block")).applyInArrow(
            learn, "bucket int, pair double, word double, n long")
    held = stored(deleted.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")), "lm-held-out")
    weights = _weights(held, vocabulary)

    def mix(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
        return _scores(texts, counts, n, vocabulary, weights)

    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(mix, SCHEMA)


class _Block:
    """A block's tokens as numbers, and its distinct words and bigrams as sorted hashes."""

    def __init__(self, table: pa.Table):
        from xxhash import xxh3_64_intdigest

        give_back()
        self.ids, self.fold = table.column("id"), table.column("fold").to_numpy()
        known: dict[bytes, int] = {}
        lengths, tokens = [], array("i", [0])
        for text in table.column("text"):
            words = lower_words(text.as_py())
            lengths.append(len(words) + 1)
            for w in words:
                known.setdefault(w, len(known) + 1)
            tokens.extend(map(known.__getitem__, words))
            tokens.append(0)  # 0 is the end of a text, and the context before its first word
        self.lengths = np.array(lengths, np.int64)
        hashes = np.empty(len(known) + 1, np.uint64)
        hashes[0] = 0
        hashes[1:] = np.fromiter(map(xxh3_64_intdigest, known), np.uint64, len(known))
        del known
        number = np.frombuffer(tokens, np.int32)
        pair = np.empty(len(number) - 1, np.uint64)
        for x in range(0, len(pair), TOKENS):
            at = number[x:x + TOKENS + 1]
            pair[x:x + TOKENS] = _mix(hashes[at[:-1]], hashes[at[1:]])
        self.pairs, self.pair_at = _distinct(pair)
        del pair
        self.words, place = _distinct(hashes)
        word_at = place[number]
        self.word_at, self.context_at = word_at[1:], word_at[:-1]
        del place, number, tokens, hashes, word_at
        give_back()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and where each key stands among them; sorted in parts, so that little is copied."""
    part = (keys >> np.uint64(60)).astype(np.uint8)
    at, found, n = np.empty(len(keys), np.int32), [], 0
    for k in range(16):
        mine = np.flatnonzero(part == k)
        values, place = np.unique(keys[mine], return_inverse=True)
        at[mine] = place + n
        found.append(values)
        n += len(values)
    return np.concatenate(found), at


def _mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ask(table: pa.Table, buckets: dict[int, int]) -> pa.Table:
    block = _Block(table)
    number = table.column("block")[0].as_py()
    trained = np.repeat(block.fold != HELD_OUT, block.lengths)
    deleted = np.repeat(block.fold == DELETED, block.lengths)
    asked = [(kind, keys, *(np.bincount(at[some], minlength=len(keys)) for some in (trained, deleted)))
             for kind, keys, at in ((WORD, block.words, block.word_at), (PAIR, block.pairs, block.pair_at))]
    del block, trained, deleted
    give_back()

    def rows() -> Iterator[tuple]:
        for kind, keys, of_trained, of_deleted in asked:
            borders = slices(keys, buckets[kind])
            for b in range(buckets[kind]):
                x, y = borders[b], borders[b + 1]
                if x < y:
                    part = keys[x:y]
                    steps = np.concatenate((part[:1], np.diff(part)))
                    yield kind, b, number, packed(steps), packed(of_trained[x:y]), packed(of_deleted[x:y])

    return _in_batches(rows(), _ASKED)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    """A table of small batches; Spark takes over one at a time."""
    parts = [schema.empty_table()]
    while some := list(islice(rows, ROWS)):
        parts.append(arrow_table(some, schema))
    return pa.concat_tables(parts)


_ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()),
                    ("trained", pa.binary()), ("deleted", pa.binary())])
_ANSWERED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("trained", pa.binary()),
                       ("kept", pa.binary()), ("sizes", pa.list_(pa.int64()))])


def _answer(table: pa.Table) -> pa.Table:
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    keys = [np.cumsum(unpacked(k.as_buffer()), dtype=np.uint64) for k in table.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    merged, place = _distinct(np.concatenate(keys))
    del keys

    def total(name: str) -> np.ndarray:
        """Of each merged key; a block has a key once, so its counts can be added in place."""
        out = np.zeros(len(merged), np.uint64)
        for end, start, c in zip(ends, [0, *ends], table.column(name)):
            out[place[start:end]] += unpacked(c.as_buffer())
        return out

    trained = total("trained")
    kept = trained - total("deleted")
    sizes = [int(np.count_nonzero(trained)), int(trained.sum()), int(np.count_nonzero(kept)), int(kept.sum())]

    def rows() -> Iterator[tuple]:
        for end, start, number in zip(ends, [0, *ends], table.column("block").to_pylist()):
            mine = place[start:end]
            # only blocks of deleted documents learn from what is kept
            yield (kind, bucket, number, packed(trained[mine]), packed(kept[mine]) if number % 2 else None,
                   [] if start else sizes)

    out = _in_batches(rows(), _ANSWERED)
    give_back()
    return out


def _replies(counts: pa.Table, name: str, kind: int) -> np.ndarray:
    kinds, numbers = (counts.column(x).to_numpy() for x in ("kind", "bucket"))
    mine = np.flatnonzero(kinds == kind)
    column = counts.column(name)
    return np.concatenate([unpacked(column[int(i)].as_buffer()).astype(np.float64)
                           for i in mine[np.argsort(numbers[mine], kind="stable")]])


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per doubling of its count."""
    return np.minimum(np.ceil(np.log2(context + 1)), LAST_BUCKET).astype(np.int32)


def _held_out_counts(texts: pa.Table, counts: pa.Table, n: int) -> pa.Table:
    """Distinct (context bucket, bigram estimate, word estimate) of the deleted tokens, with their number."""
    schema = pa.schema([("bucket", pa.int32()), ("pair", pa.float64()), ("word", pa.float64()), ("n", pa.int64())])
    if not len(texts):
        return schema.empty_table()
    block = _Block(texts)
    words, pairs = _replies(counts, "kept", WORD), _replies(counts, "kept", PAIR)
    context = words[block.context_at]
    pair, word = pairs[block.pair_at], words[block.word_at]
    order = np.lexsort((pair, word, context))
    context, pair, word = context[order], pair[order], word[order]
    new = (np.diff(context) != 0) | (np.diff(pair) != 0) | (np.diff(word) != 0)
    first = np.flatnonzero(np.concatenate(([True], new)))
    times = np.diff(np.concatenate((first, [len(context)])))
    context, pair, word = context[first], pair[first], word[first]
    return pa.table([pa.array(_bucket(context)), pa.array(pair / np.maximum(context, 1)),
                     pa.array(word / max(n, 1)), pa.array(times.astype(np.int64))], schema=schema)


def _weights(held: DataFrame, vocabulary: int, iterations: int = ITERATIONS) -> dict[int, tuple[float, float, float]]:
    """Weights (bigram, word, uniform) of each context bucket; the driver sees a few numbers per bucket."""
    start = {b: (0.0, 0.5, 0.5) if b == 0 else (1 / 3, 1 / 3, 1 / 3) for b in range(LAST_BUCKET + 1)}
    weights, uniform = start, F.lit(1.0 / (vocabulary + 1))

    def weight(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(float(weights[b][i])) for b in range(LAST_BUCKET + 1))), F.col("bucket") + 1)

    for _ in range(iterations):
        shares = held.select(
            "bucket", "n", (weight(0) * F.col("pair")).alias("p"), (weight(1) * F.col("word")).alias("w"),
            (weight(2) * uniform).alias("u")).withColumn("all", F.col("p") + F.col("w") + F.col("u"))
        found = shares.groupBy("bucket").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(x) / F.col("all")).alias(x) for x in "pwu")).collect()
        weights = {**start, **{r["bucket"]: tuple(r[x] / r["n"] for x in "pwu") for r in found}}
    # an estimate of 0 must not make a text impossible
    floor = 1e-9
    return {b: tuple((x + floor) / (sum(w) + 3 * floor) for x in w) for b, w in weights.items()}


def _scores(texts: pa.Table, counts: pa.Table, n: int, vocabulary: int, weights: dict) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64()), ("bits_per_token", pa.float64())])
    if not len(texts):
        return schema.empty_table()
    block = _Block(texts)
    words, pairs = _replies(counts, "trained", WORD), _replies(counts, "trained", PAIR)
    w = np.array([weights[b] for b in range(LAST_BUCKET + 1)])
    ends = np.cumsum(block.lengths)
    base, logs, known = (np.empty(len(ends)) for _ in range(3))
    first = 0
    while first < len(ends):  # so many documents at a time as have about TOKENS tokens
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + TOKENS, "right")))
        at = slice(start, ends[last - 1])
        own = np.concatenate(([0], ends[first:last - 1] - start))
        word, context = words[block.word_at[at]], words[block.context_at[at]]
        base[first:last] = np.add.reduceat(np.log10((word + 1) / (n + (vocabulary + 1))), own)
        known[first:last] = np.add.reduceat(word > 0, own, dtype=np.int64)
        k = _bucket(context)
        p = w[k, 0] * pairs[block.pair_at[at]] / np.maximum(context, 1)
        # an unseen context has no bigram estimate; its share goes to the others
        seen = np.where(context > 0, 1.0, 1 - w[k, 0])
        p += (w[k, 1] * word / max(n, 1) + w[k, 2] / (vocabulary + 1)) / seen
        logs[first:last] = np.add.reduceat(np.log10(p if n else np.ones_like(p)), own)
        first = last
    m = len(block.lengths)
    return pa.table(
        [block.ids.combine_chunks(), pa.array(block.fold == HELD_OUT), pa.array(block.lengths), pa.array(known.astype(np.int64)),
         pa.array(np.full(m, n, np.int64)), pa.array(base), pa.array(logs),
         pa.array(-logs / np.log10(2) / block.lengths)], schema=schema)
