"""Mixing, packing and nearest neighbours."""

from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import ann, mixing, packing

SCHEMA = "doc_id bigint, text string, source string, size int, copies string, target int, rank int, id int, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "c", 2, 3, 4, 5) for i, t, s in rows], SCHEMA)


def shared(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, going = share * sum(sizes.values()), set(order)
    while left > 1e-9 and going:
        total, over = sum(weight[s] for s in going), 0.0
        for s in going:
            target[s] += left * weight[s] / total
        for s in list(going):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                going.remove(s)
        left = over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, None: 40}, {"a": 0, "b": 0}, {"a": 5}, {"é": 10, "z": 1000, "b": 3, "": 7, None: 1}, {f"s{i}": i * i for i in range(17)},
])
def test_targets_equal_repeated_sharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(shared(sizes))


def test_mixed_documents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["big", "b", "c", None][min(3, int(rng.integers(0, 9)))]) for i in range(1500)]
    rows += [(7777, "same text", "c")] * 3 + [(None, "x y", "c"), (None, None, "c"), (1, " ", "b"), (2, "long " * 30_000, "big")]
    docs = docs_of(spark, rows)
    marks = mixing.emitted(docs).collect()
    assert sorted(map(repr, marks)) == sorted(map(repr, mixing.emitted(docs.repartition(5)).collect()))
    assert len(marks) == len(rows) and all(0 <= m.copies <= 2 for m in marks)
    taken, size, target, most = Counter(), Counter(), {}, Counter()
    for m in marks:
        taken[m.source] += m.copies * m["size"]
        size[m.source] += m["size"]
        target[m.source] = m.target
        most[m.source] = max(most[m.source], m["size"])
    assert target == pytest.approx(shared(dict(size)))
    assert all(abs(taken[s] - target[s]) <= 2 * most[s] for s in target)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[r.source] += len((r.text or "").replace(" ", "x").split())
    want.update(taken)
    assert +got == +want
    assert mixing.emitted(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_copies_follow_integer_boundaries(spark):
    rows = [(i, "w " * (i % 7 + 1), "s") for i in range(200)] + [(1000 + i, "w w", "t") for i in range(50)]
    marks = mixing.emitted(docs_of(spark, rows)).collect()
    by = defaultdict(list)
    for m in marks:
        by[m.source].append(m)
    for source, own in by.items():
        own.sort(key=lambda m: (m["size"], __import__("hashlib").md5(f"mix:{m.id}".encode()).hexdigest()[:8], m.id))
        total, rate = 0.0, own[0].target / own[0].source_size
        at = int(__import__("hashlib").md5(f"mix:source {source}".encode()).hexdigest()[:8], 16) / 2**32
        for m in own:
            crossed = np.floor(at + total + rate + 1e-12) - np.floor(at + total + 1e-12)
            assert m.copies == crossed
            total += rate


def naive(sizes, lengths, prefer):
    """The same rule by looking at all open bins for each item."""
    rooms, used, places = [], [], []
    for n, size in enumerate(sizes):
        fit = [(room, b) for b, room in enumerate(rooms) if room >= size]
        if fit:
            _, b = min(fit)
        else:
            able = [c for c in lengths if c >= size]
            rest = sum(sizes[n:])
            c = prefer if prefer in able else min(able, key=lambda c: (packing.cost(c) / min(c, rest), c))
            b = len(rooms)
            rooms.append(c)
            used.append(0)
        places.append((b, used[b]))
        rooms[b] -= size
        used[b] += size
    return places, [min(c for c in lengths if c >= u) for u in used]


def test_packing_equals_the_naive_rule():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = (8, 16, 40)
        sizes = sorted(rng.integers(1, 41, rng.integers(1, 60)).tolist(), reverse=True)
        tries = [naive(sizes, lengths, p) for p in (None, *lengths)]
        want = min(tries, key=lambda t: sum(map(packing.cost, t[1])))
        assert packing.packed(sizes, lengths) == want


def best_cost(sizes, lengths, price):
    """Cost of the best packing of a few items, over all partitions."""
    best = {(): 0.0}

    def solve(rest):
        if rest not in best:
            head, tail = rest[0], rest[1:]
            costs = []
            for chosen in product((0, 1), repeat=len(tail)):
                load = head + sum(t for t, c in zip(tail, chosen, strict=True) if c)
                if load <= max(lengths):
                    left = tuple(t for t, c in zip(tail, chosen, strict=True) if not c)
                    costs.append(price(min(c for c in lengths if c >= load)) + solve(left))
            best[rest] = min(costs)
        return best[rest]

    return solve(tuple(sizes))


def test_packing_is_near_the_best():
    rng = np.random.default_rng(4)
    ratios = []
    for _ in range(40):
        lengths = (10, 20, 32)
        sizes = sorted(rng.integers(1, 33, 8).tolist(), reverse=True)
        _, ends = packing.packed(sizes, lengths)
        ratios.append(sum(map(packing.cost, ends)) / best_cost(sizes, lengths, packing.cost))
    assert max(ratios) <= 1.5 and np.mean(ratios) <= 1.08


def test_packed_rows(spark):
    rows = [(i, "w " * (i % 90), "s") for i in range(300)] + [(500, "w " * 1000, "s"), (501, None, "s"), (502, " ", None), (7, "a b", "s"), (7, "a b", "s"), (None, "x y z", "s")]
    docs = docs_of(spark, rows)
    got = packing.packings(docs, lengths=(16, 64, 128), shard_rows=50).collect()
    want = Counter((i, len((t or "").split())) for i, t, _ in rows)
    whole, loads, ends = Counter(), defaultdict(list), {}
    texts = defaultdict(list)
    for r in got:
        texts[r.doc_id].append((r.start, r["size"]))
        if r.bin_id is None:
            assert r["size"] == 0
            continue
        loads[r.bin_id].append((r.bin_offset, r["size"]))
        ends.setdefault(r.bin_id, r.bin_size)
        assert ends[r.bin_id] == r.bin_size and 0 < r["size"] <= 128
    for own, parts in texts.items():
        whole[own] += sum(n for _, n in parts)
    total = Counter()
    for (i, n), c in want.items():
        total[i] += n * c
    assert +whole == +total
    assert sorted(texts[500]) == [(k * 128, min(128, 1000 - k * 128)) for k in range(8)]
    for name, parts in loads.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert ends[name] == min(c for c in (16, 64, 128) if c >= at)
    assert packing.packings(docs.limit(0)).count() == 0


def product_of(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute(ids, vectors, query, k):
    rows = []
    for own in query:
        q = vectors[ids.index(own)]
        near = sorted(((-product_of(q, v), i) for i, v in zip(ids, vectors, strict=True) if i != own))[:k]
        rows += [(own, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return rows


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(150, 6)) * rng.uniform(0.1, 5, (150, 1))]
    vectors[40:75] = [vectors[0]] * 35
    ids = rng.permutation(1000)[:150].tolist()
    rows = [*zip(ids, vectors, strict=True), (2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0] * 5 + [float("nan")]), (2004, [1.0] * 5 + [float("inf")]),
            (2005, [1.0] * 5 + [None]), (None, [1.0] * 6), (ids[3], vectors[3])]
    frame = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], "vec_id bigint, embedding array<float>, shard int, score double, ids int")
    from pyspark.sql import functions as F

    got = ann.searched(frame, F.col("vec_id") % 3 == 0, k=10, shard_rows=60)
    want = brute(ids, vectors, [i for i in ids if i % 3 == 0], 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_neighbours_of_few_candidates(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, ann.searched(frame, F.lit(True)).collect()))
    assert got == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]
    assert ann.searched(frame.limit(0), F.lit(True)).count() == 0


def test_recall(spark, sf_dir):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    vectors = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.7
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.searched(frame, F.col("vec_id") % 20 == 0, shard_rows=1000).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for own in range(0, 3000, 20):
        order = np.argsort(-(vectors @ vectors[own]), kind="stable")
        hits += len(got[own] & set([i for i in order if i != own][:20]))
    assert hits / (150 * 20) >= 0.9


def test_ids_under_many_vectors_take_one_place(spark):
    """One id under sixty near vectors does not crowd out the others, and counts by its nearest vector."""
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(7, [1.0, float(x), 0.0, 0.0]) for x in rng.uniform(0, 0.01, 60)]
    rows += [(100 + i, rng.normal(size=4).tolist()) for i in range(40)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = [(r.rank, r.vec_id, r.score) for r in ann.searched(docs, F.col("vec_id") == 0).orderBy("rank").collect()]
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -9.0), v[0])
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [(i, pytest.approx(s)) for _, i, s in got] == want and [n for n, _, _ in got] == list(range(1, 21))
