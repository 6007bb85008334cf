"""The search looks at words one by one only where a candidate is left, and finds what plain loops find."""

import string
from collections import Counter

import numpy as np
import pytest

from answergauge.llm import latent_search as ls

ITEM = "seven brown otters carried a heavy basket of plums across the frozen river before dawn"


def _searched(texts, item=ITEM):
    items = [ls._Item(1, ls.words(item), ls.words(item)[-3:])]
    vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(items[0].words))}
    space = np.vstack([np.zeros(8), np.random.default_rng(3).normal(size=(len(vocabulary), 8))]).astype(np.float32)
    limits = (0.55, 0.8, 0.5, 8)
    return list(ls._search(texts, items, ls._groups(items, vocabulary, space, limits[0]), vocabulary, space, limits))


def test_only_candidates_are_split_into_words(monkeypatch):
    texts = [f"the river has no otters, says report {k}; no basket of plums has come" for k in range(200)] + [f"so {ITEM} it was"]
    split = []
    plain = ls.words
    monkeypatch.setattr(ls, "words", lambda text: split.append(text) or plain(text))
    hits = _searched(texts)
    assert [len(h) for h in hits] == [0] * 200 + [1]
    assert [t for t in split if t != ITEM] == texts[-1:]


def test_numbers_are_those_of_words():
    every = "".join(map(chr, range(128)))
    texts = ["", " \t\n", "a", f"a{every}b", " a  b\x0bc\x0cd\r\ne\x1cf\x1fg\x00h ", "É\xa0é　ñ…«a»", "", "x " * 20 + "b", string.punctuation, "a\ud800 b", "B A"]
    vocabulary = {w: k + 1 for k, w in enumerate([b"a", b"b", "é".encode(), b"c", b"e", "ñ".encode()])}
    for length in (1, 3, 8):
        ids, rows = ls._numbers(texts, ls._known(vocabulary), length)
        wanted = [ls.words(t) for t in texts]
        assert rows.tolist() == [-(-len(w) // length) for w in wanted]
        flat = []
        for w in wanted:
            flat += [vocabulary.get(x, 0) for x in w] + [0] * (-len(w) % length)
        assert ids.ravel().tolist() == flat and ids.dtype == np.int32
    for none in ([], [""], ["", ". ."]):
        assert ls._numbers(none, ls._known(vocabulary), 8)[0].shape == (0, 8)


@pytest.mark.parametrize("steps", [0, 2, 64])
def test_windows_are_plain_sums(monkeypatch, steps):
    monkeypatch.setattr(ls, "STEPS", steps)
    rng = np.random.default_rng(4)
    chunks = np.array([1, 3, 0, 9, 2, 30, 1])
    of_chunk = np.repeat(np.arange(len(chunks)), chunks)
    at, left = np.arange(chunks.sum()) - (np.cumsum(chunks) - chunks)[of_chunk], chunks[of_chunk]
    sizes = [2, 3, 7, 12]
    own = rng.normal(size=(chunks.sum(), 5)).astype(np.float32)
    vectors = np.vstack([own, np.zeros((sizes[-1], 5), np.float32)])
    sums = np.cumsum(np.vstack([np.zeros((1, 5)), vectors]), axis=0, dtype=np.float64)
    for tile in (1, 5, 100):
        for low in range(0, len(own), tile):
            high = min(low + tile, len(own))
            for size, window in zip(sizes, ls._windows(vectors, sums, at, left, sizes, low, high)):
                for s in range(low, high):
                    if at[s] == 0 or at[s] <= left[s] - size:
                        assert np.allclose(window[s - low], own[s:s + min(size, left[s] - at[s])].sum(axis=0), atol=1e-5)


def test_words_in_common(monkeypatch):
    rng = np.random.default_rng(6)
    ids, owner = rng.integers(0, 12, 4000), np.sort(rng.integers(0, 60, 500))
    owners = np.lib.stride_tricks.sliding_window_view(owner, 1 + 2 * ls.AROUND)
    parts = np.lib.stride_tricks.sliding_window_view(ids, owners.shape[1] * ls.CHUNK)[::ls.CHUNK]
    own = [parts[s][np.repeat(owners[s] == owners[s][ls.AROUND], ls.CHUNK)].tolist() for s in range(len(parts))]
    numbers, times = np.unique([3, 5, 5, 7, 3, 3, 9, 1], return_counts=True)
    starts = rng.integers(0, len(parts), 300)
    mark = np.zeros(12, np.int32)
    for least in (0.5, 4, 5.5, 7, 9):
        for gathered in (1, 100, 10 ** 6):
            monkeypatch.setattr(ls, "GATHERED", gathered)
            got = ls._may_share(numbers, times, parts, owners, starts, mark, least)
            wanted = [sum((Counter(own[s]) & Counter(dict(zip(numbers.tolist(), times.tolist())))).values()) >= least for s in starts]
            assert got.tolist() == wanted and not mark.any()


def test_long_items_and_few_candidates_at_a_time(monkeypatch):
    """Items far longer than others are found whole; verifying early changes nothing."""
    long = " ".join(f"word{k}" for k in range(900))
    texts = [f"x {long} y", long, "y " * 50 + ITEM, f"{long} {ITEM}", "word1 word2"]
    items = [ls._Item(k, ls.words(t), ls.words(t)[-3:]) for k, t in enumerate((long, ITEM))]
    vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for i in items for w in i.words))}
    space = np.vstack([np.zeros(16), np.random.default_rng(3).normal(size=(len(vocabulary), 16))]).astype(np.float32)
    limits = (0.55, 0.8, 0.5, 8)
    groups = ls._groups(items, vocabulary, space, limits[0])
    assert [g[0] for g in groups] == sorted(g[0] for g in groups) and groups[-1][0] > ls.STEPS

    def found():
        return [[(*h[:3], *h[4:]) for h in sorted(hits)] for hits in ls._search(texts, items, groups, vocabulary, space, limits)]

    whole = found()
    assert [[(h[0], h[4]) for h in hits] for hits in whole] == [[(0, 1.0)], [(0, 1.0)], [(1, 1.0)], [(0, 1.0), (1, 1.0)], []]
    monkeypatch.setattr(ls, "CANDIDATES", 1)
    monkeypatch.setattr(ls, "TILE", 16)
    assert found() == whole
