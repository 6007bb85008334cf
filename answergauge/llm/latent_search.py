"""Benchmark decontamination: latent semantic retrieval of passages, then word-order checks.

Terms are the benchmark's words. A passage is a row of TF-IDF weights over them;
the leading right singular vectors of the matrix of all passages, found by a
distributed randomised SVD (tasks multiply their passages with a random matrix,
the driver sees terms x rank numbers only), map words to a small latent space. There a
document is cut into chunks of words, and the vector of a window of chunks is a
difference of prefix sums. Each benchmark item is compared by cosine with all
windows of its size, at every chunk of every document. Candidates are verified
by the longest common subsequence of words, which survives inserted, dropped and
replaced words; if too little is in common for a copy, but enough for a
paraphrase, the item's answer must be there too.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import bounded, input_rows, keep_where

CHUNK = 8  # words; windows start at every chunk
AROUND = 2  # chunks on either side of a window that are verified with it
PASSAGE = 32  # words of the passages that fit the latent space
RANK, OVERSAMPLE = 96, 8
BLOCK_WORDS = 200_000  # benchmark words searched for at a time
TERMS = 64  # rows of the Gram product that are added up together
PIECE = 1_000_000  # characters of text searched together, or one text that is longer
TILE = 1_024  # windows compared with the items of one size at a time
STEPS = 64  # chunks by which windows grow one by one; beyond, they are differences of prefix sums
CANDIDATES = 500_000  # windows and items that wait for verification
GATHERED = 1_000_000  # word numbers of candidates looked at together
ANSWER_WORDS = 3
PARAPHRASED = 0.5  # share of an item's words that the query and the pipeline ask of a paraphrase
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, cosine double, lcs long, share double, answer boolean"
# Punctuation counts as space, capitals as small letters.
_WORDS = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(),
                         b" " * len(string.punctuation) + string.ascii_lowercase.encode())
_SPACES = np.array([c > 127 and (unicodedata.category(chr(c))[0] in "PZ" or chr(c).isspace()) for c in range(sys.maxunicode + 1)])


def _folded(text: str) -> bytes:
    """A text without regard to case and composition of accents; punctuation of any script is space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        space = _SPACES[codes]
        if space.any():
            text = np.where(space, np.uint32(32), codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return text.encode("utf-8", "surrogatepass").translate(_WORDS)


def words(text: str) -> list[bytes]:
    """Words without regard to case, composition of accents and punctuation of any script."""
    return _folded(text).split()


class _Item:
    def __init__(self, item_id: int, own: list[bytes], answer: list[bytes]):
        self.id, self.words, self.answer = item_id, own, answer
        self.chunks = -(-len(own) // CHUNK) + 1  # hold the item wherever it starts
        self.places: dict[bytes, int] = {}
        for i, w in enumerate(own):
            self.places[w] = self.places.get(w, 0) | 1 << i


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", answer_col: str = "answer",
    cosine: float = 0.55, copied: float = 0.8, paraphrased: float = 0.6, short_item: int = 8,
) -> DataFrame:
    """One row per document and item found in it, at its best place: doc_id, item_id, start_word, n_words (of the
    document's words that hold the match), cosine, lcs (words), share (of the item's words), answer (is there).

    A leak has a share of ``copied``, or of ``paraphrased`` and the answer. The
    answer is the item's ``answer_col`` if the table has it, else its last words.
    Items of fewer than ``short_item`` words count only as an unbroken copy. Null
    and empty texts and items match nothing; documents or items that repeat give
    equal rows; null ids stay null; with an empty table the result is empty.
    """
    spark = docs.sparkSession
    rows = input_rows(docs, id_col, text_col)
    found = spark.createDataFrame([], SCHEMA)
    limits = (cosine, copied, paraphrased, short_item)
    for items in _blocks(benchmark, item_col, item_text_col, answer_col):
        found = found.unionByName(rows.mapInArrow(_searcher(_shared(rows, items), limits), SCHEMA))
    return found


def drop_leaked(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", answer_col: str = "answer",
    cosine: float = 0.55, copied: float = 0.8, paraphrased: float = 0.6, short_item: int = 8,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_leaks`` finds no item."""
    rows, limits = input_rows(docs, id_col, text_col), (cosine, copied, paraphrased, short_item)
    for items in _blocks(benchmark, item_col, item_text_col, answer_col):
        shared = _shared(rows, items)

        def clean(texts: list[str], shared=shared) -> list[bool]:
            items, vocabulary, space = shared.value
            groups = _groups(items, vocabulary, space, limits[0])
            return [not hits for hits in _search(texts, items, groups, vocabulary, space, limits)]

        docs = keep_where(docs, text_col, clean)
    return docs


def _shared(rows: DataFrame, items: list[_Item]):
    """Items, word numbers and word vectors for the tasks; BLOCK_WORDS bounds them."""
    vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for i in items for w in i.words))}
    return rows.sparkSession.sparkContext.broadcast((items, vocabulary, _latent_space(rows, items, vocabulary)))


def _groups(items: list[_Item], vocabulary: dict[bytes, int], space: np.ndarray, cosine: float) -> list[tuple]:
    """Items by window size, ascending: (chunks, item numbers, unit vectors as columns, least cosine of each, word
    numbers of each and how often it has them).

    A window holds more words than the item; a whole copy then has a cosine of about the root of
    its share of the words, and ``cosine`` times that is asked for."""
    by_size: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        by_size.setdefault(item.chunks, []).append(k)
    numbers = [[vocabulary[w] for w in i.words] for i in items]
    vectors = np.stack([space[own].sum(axis=0) for own in numbers])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
    return [(size, np.array(own), vectors[own].T.copy(), np.array(
        [cosine * (len(items[k].words) / (CHUNK * size)) ** 0.5 for k in own], np.float32),
        [np.unique(numbers[k], return_counts=True) for k in own]) for size, own in sorted(by_size.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str) -> Iterator[list[_Item]]:
    """The benchmark in blocks of about BLOCK_WORDS words, one after the other through the driver."""
    answer = F.col(answer_col).cast("string") if answer_col in benchmark.columns else F.lit(None).cast("string")
    chosen = benchmark.select(F.col(item_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), answer)
    block, size = [], 0
    for item_id, text, answer_text in chosen.toLocalIterator():
        own = words(text)
        if own:
            block.append(_Item(item_id, own, words(answer_text or "") or own[-ANSWER_WORDS:]))
            size += len(own)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _known(vocabulary: dict[bytes, int]) -> pa.Array:
    """The words of the vocabulary in the order of their numbers, for ``_numbers``."""
    return pa.array(list(vocabulary), pa.binary()).view(pa.string())


def _numbers(texts: list[str], known: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts' ``words`` (0: unknown) in rows of ``length``, each text beginning a row, and the rows per text."""
    trimmed = pc.ascii_trim_whitespace(pa.array(list(map(_folded, texts)), pa.binary()).view(pa.string()))
    split = pc.ascii_split_whitespace(trimmed)
    numbers = pc.fill_null(pc.index_in(split.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False) + 1
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    empty = np.flatnonzero(pc.binary_length(trimmed).to_numpy() == 0)  # split into one empty word
    numbers = np.delete(numbers, np.cumsum(counts)[empty] - 1)
    counts[empty] = 0
    rows = -(-counts // length)
    ids = np.zeros(rows.sum() * length, np.int32)
    shift = (np.cumsum(rows) - rows) * length - (np.cumsum(counts) - counts)
    ids[np.arange(len(numbers)) + np.repeat(shift, counts)] = numbers
    return ids.reshape(-1, length), rows


def _row_sums(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of the words' vectors in each row of ``ids``."""
    total = np.empty((len(ids), vectors.shape[1]), vectors.dtype)
    room = np.empty((TILE, vectors.shape[1]), vectors.dtype)
    for low in range(0, len(ids), TILE):
        first, *others = ids[low:low + TILE].T
        part, more = total[low:low + TILE], room[:len(first)]
        np.take(vectors, first, axis=0, out=part, mode="clip")
        for column in others:
            np.take(vectors, column, axis=0, out=more, mode="clip")
            part += more
    return total


def _latent_space(rows: DataFrame, items: list[_Item], vocabulary: dict[bytes, int]) -> np.ndarray:
    """One row per word number (0: unknown, zeros): its weight times its latent vector.

    The passages are those of all documents and of the items, and so are the
    frequencies behind the weights. One pass multiplies their Gram matrix G with
    a random matrix R; with weights W, the product and R' G R give the leading
    eigenvectors of W G W (Nystrom's method), whatever scale the rows of R have."""
    n_terms, width = len(vocabulary), min(RANK + OVERSAMPLE, len(vocabulary))
    spark = rows.sparkSession
    fit = rows.select("text").unionByName(spark.createDataFrame([(b" ".join(i.words).decode("utf-8", "replace"),) for i in items], "text string"))
    known = spark.sparkContext.broadcast(vocabulary)
    # the weights are not known yet: those among the items come near enough for a random matrix
    held = np.bincount([vocabulary[w] - 1 for i in items for w in set(i.words)], minlength=n_terms)
    omega = np.random.default_rng(5).normal(size=(n_terms, width)) * (np.log((1 + len(items)) / (1 + held)) + 0.1)[:, None]
    omega = omega.astype(np.float32)
    product, frequency, total = _gram_times(fit, known, omega)
    weight = np.log((1 + total) / (1 + frequency)).astype(np.float32) + 1e-3
    q, r = np.linalg.qr(weight[:, None] * product)
    inner = omega.T @ product
    sizes, turn = np.linalg.eigh((inner + inner.T) / 2)
    real = sizes > 1e-6 * sizes.max()  # few or alike passages span fewer directions
    vectors, roots, _ = np.linalg.svd(r @ (turn[:, real] / np.sqrt(sizes[real])), full_matrices=False)
    values = roots[:RANK] ** 2
    values = values[values > 1e-6 * values.max()]
    # folding in divides by the singular values, so that directions of common words do not drown the others;
    # the median keeps weak directions from growing without bound
    best = vectors[:, :len(values)] / np.sqrt(values + np.median(values))
    return np.vstack([np.zeros((1, best.shape[1])), weight[:, None] * (q @ best)]).astype(np.float32)


def _gram_times(fit: DataFrame, known, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A^T A ``matrix`` of passages A, passages per term, passages: summed over tasks, then over shares of the terms."""
    n_terms, width = matrix.shape
    shared = fit.sparkSession.sparkContext.broadcast(np.vstack([np.zeros((1, width), np.float32), matrix]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, frequency, total = np.zeros((n_terms, width)), np.zeros(n_terms), 0
        own = _known(known.value)
        for batch in bounded(batches, "text"):
            ids, _ = _numbers(batch.column("text").to_pylist(), own, PASSAGE)
            total += len(ids)
            at = np.flatnonzero(ids)
            if not len(at):
                continue
            y = _row_sums(ids, shared.value).astype(np.float64)
            pair = (ids.ravel()[at].astype(np.int64) - 1) * len(ids) + at // PASSAGE
            pair.sort()
            terms, passage = np.divmod(pair, len(ids))
            first = np.flatnonzero(np.diff(terms, prepend=-1)).tolist()
            for a, b in zip(first, [*first[1:], len(terms)]):
                product[terms[a]] += y[passage[a:b]].sum(axis=0)
            frequency += np.bincount(terms[np.diff(pair, prepend=-1) > 0], minlength=n_terms)
        for k, start in enumerate(range(0, n_terms, TERMS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([product[start:start + TERMS].tobytes()]),
                 pa.array([frequency[start:start + TERMS].tobytes()]), pa.array([total])],
                ["share", "product", "frequency", "total"])

    def add(table: pa.Table) -> pa.Table:
        product, frequency = (sum(np.frombuffer(x.as_py()) for x in table.column(c)) for c in ("product", "frequency"))
        return pa.table({"share": table.column("share")[:1], "product": [product.tobytes()], "frequency": [frequency.tobytes()],
                         "total": [sum(table.column("total").to_pylist())]})

    schema = "share long, product binary, frequency binary, total long"
    got = sorted(fit.mapInArrow(part, schema).groupBy("share").applyInArrow(add, schema).collect())
    product = np.concatenate([np.frombuffer(g["product"]) for g in got]).reshape(n_terms, width)
    return product, np.concatenate([np.frombuffer(g["frequency"]) for g in got]), got[0]["total"]


def _searcher(shared, limits: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, space = shared.value
        groups = _groups(items, vocabulary, space, limits[0])
        for batch in batches:
            hits = _search(batch.column("text").to_pylist(), items, groups, vocabulary, space, limits)
            out = [(doc_id, *hit) for doc_id, of_text in zip(batch.column("id").to_pylist(), hits) for hit in of_text]
            columns = list(zip(*out)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _search(texts: list[str], items: list[_Item], groups: list, vocabulary: dict, space: np.ndarray,
            limits: tuple) -> Iterator[list[tuple]]:
    """The hits of each text, searched in pieces of about PIECE characters."""
    known = _known(vocabulary)
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= PIECE or end == len(texts):
            yield from _search_piece(texts[start:end], items, groups, known, space, limits)
            start, size = end, 0


def _search_piece(texts: list[str], items: list[_Item], groups: list, known: pa.Array, space: np.ndarray,
                  limits: tuple) -> list[list[tuple]]:
    ids, chunks = _numbers(texts, known, CHUNK)
    best: list[dict[int, tuple]] = [{} for _ in texts]
    if not len(ids):
        return [[] for _ in texts]
    begin = np.cumsum(chunks) - chunks
    of_chunk = np.repeat(np.arange(len(texts)), chunks)
    at, left = np.arange(len(ids)) - begin[of_chunk], chunks[of_chunk]
    sizes = [size for size, *_ in groups]
    vectors = np.concatenate([_row_sums(ids, space), np.zeros((sizes[-1], space.shape[1]), space.dtype)])
    sums = None
    if max(np.diff(sizes, prepend=1)) > STEPS:
        sums = np.cumsum(np.concatenate([np.zeros_like(vectors[:1]), vectors]), axis=0, dtype=np.float64)
    pad = AROUND, AROUND + sizes[-1]
    around, owner = np.pad(ids, (pad, (0, 0))).ravel(), np.pad(of_chunk, pad, constant_values=-1)
    mark = np.zeros(len(known) + 1, np.int32)
    own: dict[int, list[bytes]] = {}
    found: list[list[tuple]] = [[] for _ in groups]
    waiting = 0
    for low in range(0, len(ids), TILE):
        high = min(low + TILE, len(ids))
        for group, window, places in zip(groups, _windows(vectors, sums, at, left, sizes, low, high), found):
            size, numbers, columns, least, _ = group
            inside = (at[low:high] == 0) | (at[low:high] <= left[low:high] - size)
            norm = np.sqrt(np.einsum("ij,ij->i", window, window)) + np.float32(1e-9)
            dots = window @ columns
            near = np.flatnonzero(dots >= least * np.where(inside, norm, np.float32(np.inf))[:, None])
            s, k = np.divmod(near, len(numbers))
            places.append((low + s, k, dots.ravel()[near] / norm[s]))
            waiting += len(near)
        if waiting < CANDIDATES and high < len(ids):
            continue
        for (size, numbers, _, _, counted), places in zip(groups, found):
            starts, k, cosines = map(np.concatenate, zip(*places))
            places.clear()
            owners = np.lib.stride_tricks.sliding_window_view(owner, size + 2 * AROUND)
            parts = np.lib.stride_tricks.sliding_window_view(around, owners.shape[1] * CHUNK)[::CHUNK]
            order = np.argsort(k, kind="stable")
            which, first = np.unique(k[order], return_index=True)
            for j, mine in zip(which.tolist(), np.split(order, first[1:])):
                item = items[numbers[j]]
                mine = mine[_may_share(*counted[j], parts, owners, starts[mine], mark, limits[2] * len(item.words))]
                for s, cosine in zip(starts[mine].tolist(), cosines[mine].tolist()):
                    d, start = int(of_chunk[s]), int(max(0, at[s] - AROUND)) * CHUNK
                    if d not in own:
                        own[d] = words(texts[d])
                    hit = _verified(item, own[d][start:(at[s] + size + AROUND) * CHUNK], limits)
                    if hit and (item.id not in best[d] or hit[2] > best[d][item.id][4]):
                        best[d][item.id] = (item.id, start + hit[0], hit[1], cosine, hit[2], hit[3], hit[4])
        waiting = 0
    return [list(b.values()) for b in best]


def _windows(vectors: np.ndarray, sums: np.ndarray | None, at: np.ndarray, left: np.ndarray, sizes: list[int],
             low: int, high: int) -> Iterator[np.ndarray]:
    """Vectors of the windows from each of the chunks ``low`` to ``high``, of one size after the other; use each at once.

    A text that is shorter than a window is one window, from its first chunk."""
    window, n = vectors[low:high].copy(), 1
    starts = np.flatnonzero(at[low:high] == 0)
    length = left[low + starts]
    for size in sizes:
        if size - n > STEPS:
            window = (sums[low + size:high + size] - sums[low:high]).astype(np.float32)
            short = starts[length < size]
            window[short] = sums[low + short + length[length < size]] - sums[low + short]
            n = size
        while n < size:
            short = starts[length <= n]
            whole = window[short]
            window += vectors[low + n:high + n]
            window[short] = whole
            n += 1
        yield window


def _may_share(numbers: np.ndarray, times: np.ndarray, parts: np.ndarray, owners: np.ndarray, starts: np.ndarray,
               mark: np.ndarray, least: float) -> np.ndarray:
    """Which of the parts have ``least`` words in common with an item when order does not matter; a subsequence has no more.

    The item has ``numbers`` that often; ``mark`` holds zeros. Chunks of a part with other ``owners`` do not count."""
    mark[numbers] = np.arange(1, len(numbers) + 1)
    enough = np.zeros(len(starts), bool)
    step, width = max(1, GATHERED // parts.shape[1]), len(numbers) + 1
    for low in range(0, len(starts), step):
        at = starts[low:low + step]
        part = mark[parts[at]]
        some = np.flatnonzero(np.count_nonzero(part, axis=1) >= least)
        of = owners[at[some]]
        code = part[some] * np.repeat(of == of[:, AROUND, None], CHUNK, axis=1) + width * np.arange(len(some))[:, None]
        held = np.bincount(code.ravel(), minlength=width * len(some)).reshape(len(some), width)
        enough[low + some] = np.minimum(held[:, 1:], times).sum(axis=1) >= least
    mark[numbers] = 0
    return enough


def _verified(item: _Item, part: list[bytes], limits: tuple) -> tuple | None:
    """(first word, words, common words, share, answer) of a leak; bit-parallel, one step per word of the part."""
    n = len(item.words)
    full = (1 << n) - 1
    _, copied, paraphrased, short_item = limits
    row, first, last, common = full, None, 0, 0
    for i, w in enumerate(part):
        places = item.places.get(w)
        if places:
            u = row & places
            row = ((row + u) | (row - u)) & full
            now = n - row.bit_count()
            if now > common:
                first, last, common = i if first is None else first, i, now
    share = common / n
    if share < paraphrased:
        return None
    answer = _holds(part, item.answer)
    if n < short_item:
        if not _holds(part, item.words):
            return None
    elif share < copied and not answer:
        return None
    return first, last - first + 1, common, share, answer


def _holds(part: list[bytes], phrase: list[bytes]) -> bool:
    k = len(phrase)
    return any(part[i] == phrase[0] and part[i:i + k] == phrase for i in range(len(part) - k + 1))
