"""Token counts, packing and the language model against plain Python."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from answergauge.llm import interpolation, packing, token_counts
from answergauge.llm.queries import tokenizer_file

TRICKY = [
    "it's. don't!! a|b| x#$ é! Å! Å. 12,34. <|endoftext|> x <|startoftext|>! IT'S'S.", " \t\n", "", None, "a  b", " a ", "\n",
    "  two\n\n three \n", "▁x ▁ y", "<s> a </s>", "x y \x1c z", "。、 日本語", "\r\n\r\n", "😀😀 😀", "a\tb"]


def _mixed(n, seed=3):
    rng = random.Random(seed)
    alphabet = list("ab é'sS.,!|#<>5▁ \n\t")
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, edge_docs, no_docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TRICKY + _mixed(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kw in ({}, {"table_size": 3, "per_task": 5, "cache_size": 10}):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, **kw).collect()}
        assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(no_docs, path).count() == 0
    rows = token_counts.count_tokens(edge_docs, path).collect()
    assert len(rows) == 11 and {r.doc_id for r in rows if r.over_limit} == {5, 9}


def test_packing_with_other_tokenizers(spark, tmp_path):
    """Files whose tokens reach over words, or keep capitals, give the library's ids too."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    path = tokenizer_file("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    assert packing._is_word_wise(json.loads(model.to_str()))
    texts = TRICKY + ["Two Words", "THE END"] + _mixed(50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name, change in (("normalizer", normalizers.NFC()), ("pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True))):
        model = Tokenizer.from_file(path)
        setattr(model, name, change)
        model.enable_truncation(3)
        file = str(tmp_path / f"{name}.json")
        model.save(file)
        model.no_truncation()
        rows = packing.pack(docs, file, end_id=2, with_ids=True).collect()
        got = defaultdict(list)
        for p in sorted(rows, key=lambda p: (p.doc_id, p.start)):
            got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
        assert got == {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_packing_is_whole_and_gapless(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    texts = TRICKY + _mixed(200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, path, end_id=2, window=64, with_ids=True, cache_size=50).collect()
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids[doc]
    assert set(by_doc) == set(ids) and sorted(by_sequence) == list(range(len(by_sequence)))
    for sequence, own in by_sequence.items():
        own.sort(key=lambda p: p.offset)
        length = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        last = sequence == len(by_sequence) - 1
        assert length == 64 or last
        assert {p.padded_length for p in own} == {length if length & (length - 1) == 0 else 64}
    assert packing.pack(no_docs, path, end_id=2).count() == 0
    edge = packing.pack(edge_docs, path, end_id=2).collect()
    assert sum(p.start == 0 for p in edge) == 11


def _brute_model(docs):
    """The same model with dictionaries."""
    def fold(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7

    texts = [(i, fold(i), (t or "").encode().lower().split() + [None]) for i, t in docs]

    def counts(keep):
        words, pairs = Counter(), Counter()
        for _, f, w in texts:
            if keep(f):
                words.update(w)
                pairs.update(zip([None, *w], w))
        return words, pairs

    def bucket(c):
        return min(math.ceil(math.log2(c + 1)), interpolation.LAST_BUCKET)

    words, pairs = counts(lambda f: f != interpolation.HELD_OUT)
    kept, kept_pairs = counts(lambda f: f not in (interpolation.HELD_OUT, interpolation.DELETED))
    n, v, kept_n = sum(words.values()), len(words), sum(kept.values())
    events = defaultdict(list)
    for _, f, w in texts:
        if f == interpolation.DELETED:
            for u, x in zip([None, *w], w):
                c = kept[u]
                events[bucket(c)].append((kept_pairs[u, x] / max(c, 1), kept[x] / max(kept_n, 1), 1 / (v + 1)))
    weights = {b: (0, .5, .5) if b == 0 else (1 / 3,) * 3 for b in range(interpolation.LAST_BUCKET + 1)}
    for _ in range(interpolation.ITERATIONS):
        for b, ps in events.items():
            total = [0.0] * 3
            for p in ps:
                parts = [x * y for x, y in zip(weights[b], p)]
                total = [s + x / sum(parts) for s, x in zip(total, parts)]
            weights[b] = tuple(x / len(ps) for x in total)
    weights = {b: tuple((x + 1e-9) / (sum(w) + 3e-9) for x in w) for b, w in weights.items()}
    out = []
    for i, f, w in texts:
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip([None, *w], w):
            a, b, c = weights[bucket(words[u])]
            rest = (b * words[x] / max(n, 1) + c / (v + 1)) / (1 if words[u] else 1 - a)
            score += math.log10(a * pairs[u, x] / max(words[u], 1) + rest) if n else 0
        out.append((i, f == interpolation.HELD_OUT, len(w), sum(words[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def _scored(docs):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                   for r in interpolation.score(docs).collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [interpolation.BLOCK_BYTES, 400])
def test_language_model_against_dictionaries(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", block_bytes)
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, "W1 w1\tw2"), (3, None), (4, "w1 w2"), (4, "w1 w2")]
    assert _scored(spark.createDataFrame(docs, "doc_id long, text string")) == _brute_model(docs)


def test_language_model_on_edges(spark, edge_docs, no_docs):
    assert interpolation.score(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert _scored(edge_docs) == _brute_model(rows)
    held = spark.createDataFrame([(7, "a b"), (9, "c")], "doc_id long, text string")
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == interpolation.HELD_OUT][:2]
    held = spark.createDataFrame([(i, "a b") for i in only_held], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in interpolation.score(held).collect()} == {(0, 0, 0.0, 0.0)}
