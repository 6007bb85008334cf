"""Edit join, SimHash groups, range join and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from answergauge.llm import edit_join, range_join, repeats, simhash
from answergauge.llm.suffix_order import _Queues, suffix_order


def union(nodes, links):
    """Smallest node reachable, by repeated relaxation."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _changed(rng, text, edits, letters="abé"):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4 or k == len(out):
            out.insert(k, rng.choice(letters))
        elif kind < 0.7:
            out.pop(k)
        else:
            out[k] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append((a, _changed(rng, a, rng.randint(0, 5))))
    got = edit_join.banded_distances([a for a, _ in pairs], [b for _, b in pairs], threshold)
    assert list(got) == [min(levenshtein(a, b), threshold + 1) for a, b in pairs]


def test_edit_join_against_all_pairs(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        own = [_changed(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
        docs.append((i, "\n".join([*own, "short"])))
    rows = edit_join.join_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    lines = {(i, k): line for i, t in docs for k, line in enumerate(t.split("\n"))}
    different = sorted(set(lines.values()))
    links = [(a, b) for x, a in enumerate(different) for b in different[x + 1:]
             if min(len(a), len(b)) >= 20 and levenshtein(a, b) <= 2]
    low = union(different, links)
    first = {}
    for place in sorted(lines):
        first.setdefault(low[lines[place]], place)
    assert len(links) > 20 and len(rows) == len(lines)
    for r in rows:
        line = lines[r.doc_id, r.line_no]
        assert r.n_links == sum(line in pair for pair in links)
        assert (r.first_doc, r.first_line) == first[low[line]]
        assert r.kept == (len(line) < 20 or (r.doc_id, r.line_no) == first[low[line]])
        assert r.n_copies == sum(x == line for x in lines.values())
    kept = {r.doc_id: r.text for r in edit_join.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert kept[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < 20 or (i, k) == first[low[x]])


def test_edit_join_of_near_copies(spark):
    """A group whose lines nearly all link: counts as by brute force, in one block and in many, and no row per pair."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdé ") for _ in range(33))
    texts = sorted({_changed(rng, base, rng.randint(0, 1)) for _ in range(300)} | {_changed(rng, base, 4) for _ in range(9)})
    df = spark.createDataFrame([(i, "\n".join(texts[i::7])) for i in range(7)], "doc_id long, text string")
    near = {(a, b) for a in texts for b in texts if a != b and levenshtein(a, b) <= 2}
    degree = sorted(sum(a == t for a, _ in near) for t in texts)
    low = union(texts, near)
    for lines, size in ((2048, 8_000_000), (20, 8_000_000), (2048, 700)):
        rows = edit_join.line_links(df, "doc_id", "text", 2, 20, block_lines=lines, block_bytes=size).collect()
        counts = {}
        for r in rows:
            counts[r.line] = counts.get(r.line, 0) + r.links
        assert sorted([*counts.values(), *[0] * (len(texts) - len(counts))]) == degree
        names = {xxhash.xxh3_64_intdigest(t.encode()) for t in texts}
        found = union(names, [(r.line % 2**64, r.other % 2**64) for r in rows if r.other is not None])
        assert len(set(found.values())) == len(set(low.values()))
        if lines == 2048 and size > 700:
            assert len(near) > 5_000 and len(rows) < len(near) / 4


def test_edit_join_on_edges(edge_docs, no_docs):
    assert edit_join.join_lines(no_docs).count() == 0 and edit_join.dedup_lines(no_docs).count() == 0
    out = edit_join.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[7] == "" and texts[9] == "" and texts[6].startswith("the very same")


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    docs = []
    for i in range(120):
        base = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, 30, 60]))] if i % 3 == 0 or not docs else docs[-1][1].split()
        if base and i % 3:
            base[rng.randrange(len(base))] = "X"
        docs.append((i, " ".join(base)))
    docs += [(200, None), (201, " \n")]
    fps = {i: _fingerprint(t) for i, t in docs}
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    low = union(fps, links)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for task_rows in (4096, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, task_rows=task_rows).collect()}
        assert got == {i: (f"{fps[i]:016x}", low[i]) for i in fps}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(low.values())


def test_dense_cells_lose_no_component(spark):
    """Thousands of fingerprints near each other, and chains of links."""
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))}
    chain = [int(rng.integers(0, 2**63))]
    for k in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * k)))
    fps = sorted(near | set(chain) | {int(x) for x in rng.integers(0, 2**63, 300)})
    low = union(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for task_rows in (4096, 50):
        found = simhash.links(df, task_rows=task_rows).collect()
        assert union(fps, [(r.a, r.b) for r in found]) == low


def test_simhash_on_edges(edge_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    rows = simhash.near_duplicates(edge_docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert len(rows) == 11 and sorted(groups[1]) == [1, 2, 3]
    assert sorted(groups[6]) == [6, 6, 7] and sorted(groups[5]) == [5, 9]
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 4, 5, 6, 8, None]


def test_range_join_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows, vectors = [], {}
    for i in range(160):
        v = centres[i % 5] + rng.normal(size=8) * rng.choice([0.02, 0.15, 3.0])
        v = vectors[i - 5] if i % 7 == 0 and i > 5 else v * rng.choice([1e-3, 1, 50])
        vectors[i] = v
        rows.append((i, [float(x) for x in v]))
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8),
             (904, [float("inf")] + [0.0] * 7), (905, []), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (None, [1.0, 0.0])]
    vectors[906], vectors[907] = np.array([1.0, 0.0]), np.array([2.0, 0.0])
    unit = {i: v / np.sqrt(v @ v) for i, v in vectors.items()}
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    low = union(unit, links)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rep string")
    for task_rows in (4096, 7):
        got = range_join.near_vectors(df, task_rows=task_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id in unit:
                assert (r.n_links, r.component_id) == (sum(r.vec_id in p for p in links), low[r.vec_id])
                assert r.kept == (low[r.vec_id] == r.vec_id)
            else:
                assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert range_join.near_vectors(df.where("false")).count() == 0


def test_suffix_order():
    rng = random.Random(1)
    for in_memory in (10_000, 3):
        _Queues.__init__.__defaults__ = (in_memory,)
        for _ in range(400):
            text = bytes(rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) * rng.randint(1, 3)
            assert suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def _without_repeats(docs, length=100):
    """(id, bytes, removed, spans, hash) per row, in the order of ids and texts."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(raw[s:s + length])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    rng = random.Random(hot)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.choice([40, 99, 100, 101, 250]))) for _ in range(12)]
    docs = []
    for i in range(-3, 60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else _changed(rng, rng.choice(passages), 3) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts)))
    docs += [(61, "z" * 500), (62, "z" * 99), (63, "xy" * 200), (None, passages[4] * 2), (60, docs[8][1]), (60, docs[8][1]), (64, None)]
    rows = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()
    assert sorted(map(tuple, rows), key=repr) == _without_repeats(docs)
    assert sum(r.n_removed for r in rows) > 1000


def test_repeats_on_edges(edge_docs, no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
    rows = {}
    for r in repeats.remove_repeats(edge_docs, with_text=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[9][0].n_removed == rows[9][0].n_bytes and rows[9][0].kept == b""
    assert rows[5][0].n_bytes - rows[5][0].n_removed < 200
    assert [r.n_bytes for r in rows[1] + rows[2]] == [0, 0]


def test_range_join_with_repeated_ids(spark):
    """An id on several vectors: each is counted by itself, and the id is one node."""
    vectors = [(5, [1.0, 0.0]), (5, [0.999, 0.01]), (5, [0.0, 1.0]), (6, [1.0, 0.001]), (6, [1.0, 0.001]), (7, [0.01, -1.0]),
               (8, [-1.0, 0.0]), (9, [-1.0, 0.01]), (9, [0.02, -1.0])]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in vectors]
    near = [(i, j) for i in range(len(vectors)) for j in range(len(vectors)) if i != j and unit[i] @ unit[j] >= 0.95]
    low = union({i for i, _ in vectors}, [(vectors[i][0], vectors[j][0]) for i, j in near])
    want = sorted((vectors[k][0], sum(i == k for i, _ in near), low[vectors[k][0]]) for k in range(len(vectors)))
    got = range_join.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), task_rows=2).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_range_join_deals_by_the_members_of_cells(spark):
    """Clusters far apart, as many cells as clusters: rows dealt grow in proportion to the table, not with its square."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 16))
    dealt = []
    for clusters in (20, 100):
        rows = [[float(x) for x in c + rng.normal(size=16) * 0.01] for c in centres[:clusters] for _ in range(60)]
        classes = spark.createDataFrame([(v, 1, k) for k, v in enumerate(rows)], "v array<double>, size long, rep long")
        dealt.append(range_join._cells(classes, {16: range_join._unit(centres[:clusters])}, 0.05, 40).count())
    assert dealt[1] < 6 * dealt[0]


def test_range_join_deals_each_vector_once(spark):
    """Vectors without clusters, which pivots cannot tell apart: no copies, and the same links in many passes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x = np.concatenate((x, x[:200] + rng.normal(size=(200, 16)) * rng.choice([0.1, 0.25, 0.4], (200, 1)))).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(500, [0.0] * 15 + [1.0]), (501, [-0.0] * 15 + [1.0])]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = [(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95)) if i != j]
    low = union(range(len(rows)), links)
    want = sorted((k, sum(i == k for i, _ in links), low[k]) for k in range(len(rows)))
    assert sum(n for _, n, _ in want) > 100
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = range_join.near_vectors(df, max_pivots=4, task_rows=5).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    classes = spark.createDataFrame([(v, 1, k, k) for k, v in rows], "v array<double>, size long, rep long, first long")
    assert range_join._cells(classes, {16: range_join._unit(unit[:4])}, 0.3162, 40).count() == len(rows)


def test_range_join_groups():
    """A large cell is dealt over groups of its own, small ones share a group; none is left out."""
    cells = {range_join._code(8, k): (n, 1.0) for k, n in enumerate([10, 20, 300, 1, 79, 2])}
    groups, dealt = range_join._groups(cells, 5)
    assert [len(g) for g in groups] == [2, 1, 1, 1, 1, 2, 1]
    assert [dealt[c] for c in sorted(cells)] == [(0, 1), (0, 1), (1, 4), (5, 1), (5, 1), (6, 1)]


@pytest.mark.parametrize("spread", [0.01, 0.2, 2.0])
def test_range_join_tiles(spread):
    rng = np.random.default_rng(2)
    x = range_join._unit(np.ones(12) + rng.normal(size=(90, 12)) * spread)
    chosen = np.arange(0, 90, 2)
    found = list(range_join._near(x, x.astype(np.float32), chosen, x, x.astype(np.float32), 0.95, height=7, width=13))
    got = {(int(i), int(j)) for a, b in found for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i % 2 == 0} and sum(len(a) for a, _ in found) == len(got)


def test_range_join_forest_holds_few_links(monkeypatch):
    monkeypatch.setattr(range_join, "HELD_PAIRS", 10)
    rng = np.random.default_rng(6)
    held, links = range_join._Forest(60), []
    for _ in range(30):
        i, j = rng.integers(0, 60, (2, 9)) // 2 * 2
        held.add(i, j)
        links += zip(i.tolist(), j.tolist())
        assert sum(len(a) for a, _ in held.parts) <= 60 + 10
    a, b = held.links()
    assert union(range(60), list(zip(a.tolist(), b.tolist()))) == union(range(60), links)
