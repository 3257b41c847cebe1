"""Exact, SimHash and passage deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from rankmill.llm import exact, golay, simhash, suffixes
from rankmill.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, id bigint, _x_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 6, "x") for i, t in rows], SCHEMA)


EDGES = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (3, "SAME TEXT"), (4, "same tex"), (5, None), (6, ""),
    (None, "null id"), (None, "Null Id"), (None, "alone"), (7, "É"), (8, "é"), (9, "x" * 300 + "A"), (10, "x" * 300 + "b"),
    (11, "x" * 300 + "a"), (12, "word " * 20000), (13, "word " * 20000),
]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_marks_each_row(spark):
    got = exact.marked(frame(spark, EDGES), prefix_chars=16).collect()
    groups = defaultdict(list)
    for i, t in EDGES:
        groups[lower(t)].append(i)
    want, kept = Counter(), Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept[keep] += 1
        want.update((i, keep, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert Counter(r.doc_id for r in got if r.kept) == kept


def test_exact_keeps_one_row_of_each_group(spark):
    docs = frame(spark, EDGES)
    got = exact.deduplicated(docs, prefix_chars=16)
    assert got.columns == docs.columns
    assert sorted(lower(r.text) for r in got.collect()) == sorted({lower(t) for _, t in EDGES})


def test_exact_reads_content_only_of_groups(spark):
    got = exact.marked(frame(spark, [(1, "a"), (2, "bb"), (3, "cc"), (4, "dd"), (5, "dd")])).collect()
    assert {r.doc_id: r.full_hash for r in got} == {
        1: None, 2: None, 3: None, **dict.fromkeys((4, 5), hashlib.sha256(b"dd").hexdigest())
    }


@pytest.mark.parametrize("operator", [exact.marked, exact.deduplicated, simhash.linked, simhash.deduplicated, suffixes.repeated])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(-40, 40, (45, 2)).tolist() + [[k, k + 1] for k in range(100, 160)] + [[500, k] for k in range(501, 560)] + [[7, 7]]
    root = {x: x for p in pairs for x in p}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(pairs, "x bigint, y bigint"), "x", "y").collect()
    want = {x: find(x) for x in root}
    assert all(want[r.node] == r.root for r in got)
    assert {r.node for r in got} >= {x for x in want if want[x] != x}


def test_golay_is_perfect():
    words = golay.codewords()
    assert len(set(words.tolist())) == 4096 and words.max() < 1 << 23
    assert np.bitwise_count(words[1:]).min() == 7
    starts, indices, nearest = golay.near()
    assert nearest.sum() == 1 << 16
    for v in (0, 1, 77, 40000, 65535):
        distance = np.bitwise_count(words ^ v)
        assert sorted(indices[starts[v] : starts[v + 1]]) == np.flatnonzero(distance <= 4).tolist()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in values], dtype=np.uint64)
    row, key, nearest = simhash.keys_of(values.view(np.int64))
    other, other_key, _ = simhash.keys_of((values ^ flips).view(np.int64))
    probes, members = defaultdict(set), defaultdict(set)
    for r, k, n in zip(row, key, nearest, strict=True):
        if n:
            probes[r].add(k)
    for r, k in zip(other, other_key, strict=True):
        members[r].add(k)
    assert all(len(probes[i]) == 8 and probes[i] & members[i] for i in range(300))


def plain_fingerprint(text, shingle=3):
    words = lower(text).encode().split()
    runs = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "a b c d e a b c", "é É x y z", "w " * 70000 + "end"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 3])
def test_links_join_what_three_bits_join(spark, block):
    rng = np.random.default_rng(11)
    values = set()
    for base in rng.integers(0, 1 << 62, 12):
        value = int(base)
        for _ in range(rng.integers(1, 25)):
            values.add(value)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                value ^= 1 << int(b)
    values = np.array(sorted(values), dtype=np.uint64)
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(values))
    for _ in range(len(values)):
        new = np.where(close, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    links = simhash.links(rows, block=block)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    assert all(close[at[r.x], at[r.y]] for r in links.collect())
    root = {r.node: r.root for r in components(links, "x", "y").collect()}
    mine = defaultdict(set)
    for v, i in at.items():
        mine[root.get(v, v)].add(i)
    want = defaultdict(set)
    for i, x in enumerate(label):
        want[x].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_simhash_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base), (9, base), (4, "other words here now"), (1, None), (2, " "), (None, "x y z"), (None, "x y z")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.component_id) for r in simhash.linked(docs).collect()}
    close = bin(plain_fingerprint(base) ^ plain_fingerprint(base + " more")).count("1") <= 3
    first = 3 if close else 5
    assert got == {(5, first), (3, 3), (9, first), (4, 4), (1, 1), (2, 1), (None, None)}
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns
    # One word more leaves the shingles more alike than 0.8.
    assert Counter(r.doc_id for r in left.collect()) == Counter([3, 4, 1, None])


def jaccard(a, b, n=5):
    one, two = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (lower(a).split(), lower(b).split()))
    return len(one & two) / len(one | two)


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(12)
    rows, families = [], []
    for f in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, 250)]
        family = [" ".join(words)]
        for _ in range(2):
            copy = list(words)
            for at in rng.integers(0, 250, 4):
                copy[at] = f"n{rng.integers(10**6)}"
            family.append(" ".join(copy))
        far = [w if i % 4 else f"f{rng.integers(10**6)}" for i, w in enumerate(words)]
        families.append((family, " ".join(far)))
        rows += [(f * 10 + n, t) for n, t in enumerate([*family, " ".join(far)])]
    docs = frame(spark, rows)
    left = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert all(f * 10 in left and f * 10 + 3 in left for f in range(40))
    copies = [f * 10 + n for f, (family, _) in enumerate(families) for n in (1, 2) if jaccard(family[0], family[n]) >= 0.8]
    assert len(copies) > 60 and len(left & set(copies)) <= 0.08 * len(copies)
    texts = dict(rows)
    node = {r.n: r.doc_id for r in docs.selectExpr("xxhash64(doc_id, xxhash64(text)) n", "doc_id").collect()}
    for r in simhash.near_links(docs, "doc_id", "text", 0.8).collect():
        assert jaccard(texts[node[r.u]], texts[node[r.v]]) >= 0.8


def similar_pairs(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (lower(t).split() for t in texts)]
    number = {x: k for k, x in enumerate(set().union(*sets))}
    marks = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, one in enumerate(sets):
        marks[i, [number[x] for x in one]] = 1
    both, size = marks @ marks.T, marks.sum(axis=1)
    return both >= least * (size[:, None] + size[None, :] - both) - 1e-3


def groups(linked, count):
    root = list(range(count))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(count)]


def near_pairs(spark, texts, **options):
    docs = frame(spark, list(enumerate(texts)))
    node = {r.n: r.doc_id for r in docs.selectExpr("xxhash64(doc_id, xxhash64(text)) n", "doc_id").collect()}
    return [(node[r.u], node[r.v]) for r in simhash.near_links(docs, "doc_id", "text", 0.8, **options).collect()]


EDITS = ("appended", "cut", "block", "words")


def edited():
    """Thirty texts that end in one common line, each followed by a copy of every kind of edit."""
    rng = np.random.default_rng(21)

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 5000, n)]

    texts = []
    for _ in range(30):
        base = fresh(rng.integers(30, 500)) + [f"common{x}" for x in range(40)]
        n = len(base)
        appended = base + fresh(round(n * rng.uniform(0.02, 0.3)))
        cut = base[: round(n * rng.uniform(0.7, 0.98))]
        block = base[:20] + fresh(round(n * rng.uniform(0.02, 0.15))) + base[20 + round(n * 0.08) :]
        words = [x if rng.random() > 0.025 else fresh(1)[0] for x in base]
        texts += [" ".join(x) for x in (base, appended, cut, block, words)]
    return texts


def test_near_links_reach_every_kind_of_edit(spark):
    texts = edited()
    close = similar_pairs(texts)
    found = near_pairs(spark, texts)
    assert all(close[a, b] for a, b in found)
    root = groups(found, len(texts))
    for k, kind in enumerate(EDITS, 1):
        ends = [(i, i + k) for i in range(0, len(texts), 5) if close[i, i + k]]
        assert len(ends) > 8 and sum(root[a] == root[b] for a, b in ends) > 0.9 * len(ends), kind


@pytest.mark.parametrize("block", [2048, 7])
def test_near_links_join_all_that_agrees(spark, block):
    texts = edited()
    found = near_pairs(spark, texts, block=block)
    close = similar_pairs(texts)
    assert all(close[a, b] for a, b in found)
    assert groups(found, len(texts)) == groups(np.argwhere(close), len(texts))


def test_near_links_join_a_dense_family(spark):
    """Variants that agree with their base and not with each other, and chains of them, thousands in all."""
    rng = np.random.default_rng(22)
    texts = []
    for words, edit, count in ((1200, 95, 150), (60, 1, 1500), (200, 6, 600)):
        base = [f"b{words}x{x}" for x in range(words)]
        family = [list(base) for _ in range(count)]
        for k, copy in enumerate(family):
            at = int(rng.integers(0, words - edit))
            copy[at : at + edit] = [f"e{words}y{k}y{x}" for x in range(edit)] if k else copy[at : at + edit]
        texts += [" ".join(x) for x in family]
    close = similar_pairs(texts)
    assert close.mean() < 0.5
    found = near_pairs(spark, texts, block=400)
    assert all(close[a, b] for a, b in found) and len(found) < 20 * len(texts)
    assert groups(found, len(texts)) == groups(np.argwhere(close), len(texts))


def test_simhash_links_of_low_similarity_stay(spark):
    loop = " ".join(f"r{x}" for x in range(31))
    rows = [(k, " ".join([loop] * 50 + [f"t{k}y{x}" for x in range(60)])) for k in range(4)]
    docs = frame(spark, [*rows, (9, rows[0][1] + " more")])
    assert jaccard(rows[0][1], rows[1][1]) < 0.5
    assert {r.component_id for r in simhash.linked(docs).collect()} == {0}
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [0, 1, 2, 3]


def covered(rows, least):
    where = defaultdict(set)
    words = {}
    for i, t in set(rows):
        words[i, t] = (t or "").split(" ") if t else []
    for key, w in words.items():
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add(key)
    out = set()
    for key, w in words.items():
        for p in range(len(w) - least + 1):
            if len(where[tuple(w[p : p + least])]) > 1:
                out.update((key[0], q) for q in range(p, p + least))
    return out


def test_repeated_passages(spark):
    rng = np.random.default_rng(2)

    def fresh(n):
        return [f"v{x}" for x in rng.integers(0, 10**6, n)]

    shared, short = fresh(80), fresh(30)
    rows = [(i, " ".join(fresh(rng.integers(0, 200)) + shared + fresh(rng.integers(0, 200)))) for i in range(12)]
    rows += [(20 + i, " ".join(fresh(100) + short + fresh(60))) for i in range(4)]
    inner = fresh(60)
    rows += [(30, " ".join(inner + fresh(20) + inner)), (40, None), (41, ""), (42, "a b"), (43, "a b")]
    whole = " ".join(fresh(90))
    rows += [(50, whole), (51, whole), (51, whole), (52, " ".join(shared[:50] + fresh(9))), (None, " ".join(shared[-49:] + fresh(70)))]
    got = {(r.doc_id, q) for r in suffixes.repeated(frame(spark, rows)).collect() for q in range(r.start, r.end)}
    assert got == covered(rows, 50)


def test_repeated_passages_of_edited_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in range(400)]
    rows = []
    for i in range(15):
        words = list(base)
        for at in rng.integers(0, 400, 4):
            words[at] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    got = {(r.doc_id, q) for r in suffixes.repeated(frame(spark, rows)).collect() for q in range(r.start, r.end)}
    want = covered(rows, 50)
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("filler", [0, 3])
def test_passages_said_very_often_in_one_text(spark, filler):
    """Whatever the size of blocks and partitions, all places of a passage count, also those in between."""
    rng = np.random.default_rng(filler)
    passage = [f"p{x}" for x in range(60)]
    long = sum(([*passage, *(f"f{x}" for x in rng.integers(0, 10**6, filler))] for _ in range(600)), [])
    rows = [(1, " ".join(long)), (2, " ".join([*(f"a{x}" for x in range(30)), *passage, *(f"z{x}" for x in range(30))])), (3, "other " * 10)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = {(r.doc_id, q) for r in suffixes.repeated(frame(spark, rows)).collect() for q in range(r.start, r.end)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == covered(rows, 50)


def test_only_trees_with_a_failed_link_are_walked_again(spark, monkeypatch):
    from rankmill.llm import similar

    walks, cells = [], []
    old_walk, old_cells = similar._walked, similar._cells
    monkeypatch.setattr(similar, "_walked", lambda *a: walks.append(a) or old_walk(*a))
    monkeypatch.setattr(similar, "_cells", lambda rows, parts: cells.append(rows.count()) or old_cells(rows, parts))
    base = [f"w{i}" for i in range(400)]
    near = [f"x{i}" if i in range(40, 360, 32) else w for i, w in enumerate(base)]  # similarity 0.78
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert similar.near_links(docs, "doc_id", "text", 0.8).count() == 0
    assert (len(walks), cells) == (1, [2])  # the keys that both share are one, and no other pair is left there
    assert similar.near_links(docs, "doc_id", "text", 0.75).count() == 1
