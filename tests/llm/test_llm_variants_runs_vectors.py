"""Spelling variants, periodic runs and embedding groups against brute force, alone and as registered."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankmill.llm import cells, periodic, quantised, queries, spelling

DOCS = "doc_id bigint, text string, word string, n bigint, id bigint, cell string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 8, "c") for i, t in rows], DOCS)


# Spelling variants


def counted(docs, damage=31, shortest=7):
    lower = {i: i + 32 for i in range(65, 91)}
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouped(n, factor=10):
    """(word, form, root, n, n_near, form_n) of each word, from all pairs that share a letter pattern."""
    near = defaultdict(set)
    same = defaultdict(list)
    for w in n:
        for k in range(len(w)):
            same[w[:k] + "\0" + w[k + 1 :]].append(w)
            if (v := w[:k] + w[k + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for words in same.values():
        for w in words:
            near[w].update(x for x in words if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    rows = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return rows


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_patterns_are_edits():
    words = ["abcdefg", "abcdefgh", "abcdeffg", "abcdfeg", "xbcdefg", "abcdef", "bacdefg", "aabcdefg"]
    near = {(w, v) for w in words for v in words if w != v and edits(w, v)}
    rows = {r[0]: r[4] for r in grouped(dict.fromkeys(words, 2))}
    assert rows == {w: sum(a == w for a, _ in near) for w in words}


def test_spelling_variants(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdé", k=rng.randint(6, 10))) for _ in range(60)]
    for w in base[:20]:
        k = rng.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + "zÿÀ"[k % 3] + w[k:], w[:k] + "q" + w[k + 1 :], w[::-1]]
    docs = [(i, " ".join(rng.choices(base, weights=[1 / (1 + j % 17) ** 2 for j in range(len(base))], k=rng.randint(0, 300)))) for i in range(40)]
    docs += [(3, "Kirsche, KIRSCHE-kirsche\nkirschen kirschen"), (None, "Straße Straßen straßen " * 3), (41, None), (42, ""), (43, "b" * 3000 + " " + "b" * 3001), (44, "b" * 3000 + " " + "b" * 3001)]
    docs += docs[:2]
    monkeypatch.setattr(spelling, "BLOCK", 8)
    got = spelling.variants(spelling.vocabulary(frame(spark, docs), damage=31))
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == grouped(counted(docs))
    assert got.count() == len(counted(docs))


def test_ways_of_forms_end_in_a_root(spark):
    words = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("zzzzzzz", 5)], "word string, n bigint")
    got = {r.word: (r.form, r.root) for r in spelling.variants(words).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb") and got["aaabbbb"] == (None, "aaabbbb") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_long_texts_are_read_in_pieces(monkeypatch):
    letter = re.compile(f"[{spelling.LETTERS}]")
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "one twothreefourfive six " * 20 + "x" * 35
    pieces = list(spelling._pieces(text, letter))
    assert "".join(pieces) == text and sum((re.findall("[a-z]+", p) for p in pieces), []) == re.findall("[a-z]+", text)


def test_spelling_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op11_spelling_variants"](spark, sf_dir).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == grouped(counted(docs)) and len(got) == len(counted(docs))


# Periodic runs


def runs_of(w, shortest=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def tuples(runs):
    return [tuple(map(int, r)) for r in runs[["start", "length", "period"]].itertuples(index=False)]


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_of_random_words(shortest):
    rng = random.Random(shortest)
    texts = []
    for _ in range(300):
        n = rng.randint(0, 90)
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            start, p = rng.randrange(n), rng.randint(1, n)
            w = w[:start] + [w[start + (i - start) % min(p, n - start)] for i in range(start, n)]
        texts.append(w)
    got = periodic.runs_of(texts, shortest)
    assert [tuples(g) for g in got] == [runs_of(w, shortest) for w in texts]


def test_runs_of_structured_words():
    fib, other = [b"a"], [b"b"]
    for _ in range(9):
        fib, other = fib + other, fib
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(256)]
    for w in (fib, thue, [b"x"] * 500, [b"a"] * 30 + [b"b"] + [b"a"] * 30 + [b"b"] + [b"a"] * 30):
        assert tuples(periodic.runs_of([w])[0]) == runs_of(w)


def test_long_runs_take_little_time():
    words = [b"%d" % (i % 7) for i in range(500_000)]
    assert tuples(periodic.runs_of([words])[0]) == [(0, 500_000, 7)]
    assert tuples(periodic.runs_of([[b"a"] * 300_000])[0]) == [(0, 300_000, 1)]


def test_equal_hashes_of_different_words_do_no_harm(monkeypatch):
    monkeypatch.setattr(periodic, "PRIMES", (3, 3))
    rng = random.Random(1)
    texts = [[b"%d" % rng.randrange(3) for _ in range(80)] for _ in range(40)]
    assert [tuples(g) for g in periodic.runs_of(texts, 4)] == [runs_of(w, 4) for w in texts]


def test_periodic_rows(spark):
    docs = [(1, "a b " * 6), (1, "a b " * 6), (2, None), (3, ""), (None, "x " * 12), (4, "one two three"), (5, "k\tk\nk k k k k k k k k  k k"), (6, "word " * 20_000)]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic(frame(spark, docs)).collect())
    assert got == Counter({
        (1, 12, ((0, 12, 2),), "a b"): 2, (2, 0, (), ""): 1, (3, 0, (), ""): 1, (None, 12, ((0, 12, 1),), "x"): 1,
        (4, 3, (), "one two three"): 1, (5, 13, (), " ".join(["k"] * 10 + ["k ", "k", "k"])): 1, (6, 20_000, ((0, 20_000, 1),), "word"): 1})


def test_periodic_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    looped = 0
    for doc in docs:
        words = WORD.findall(doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            looped += 1
        if n > 4000:
            continue
        runs = runs_of(words)
        row = got[doc.doc_id]
        drop = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (row.start, row.length, row.period, row.exponent_milli) == want and row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[k] for k in range(n) if k not in drop).encode()).hexdigest()
    assert looped > 5


# Embedding groups

VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, space string, root bigint"


def all_pairs(rows, similarity=0.93):
    """(vec_id, n_links, component_id, kept) of each row."""
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.float32(rows[i][1]).astype(float) / np.linalg.norm(np.float32(rows[i][1]).astype(float)) for i in good}
    near = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity] for i in good}
    out = Counter()
    for i, (name, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            more = [j for j in near.get(todo.pop(), ()) if j not in seen]
            seen.update(more)
            todo += more
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[name, len(near.get(i, ())), low, name == low] += 1
    return out


def vectors(rng, count=400, width=24):
    base = rng.normal(size=(count // 8, width))
    rows = [(int(k), (base[k % len(base)] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.25])).tolist(), int(k % 3)) for k in range(count)]
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(40)]  # copies
    rows += [(3000, [x * 3 for x in rows[7][1]], rows[7][2]), (3001, [-x for x in rows[7][1]], rows[7][2])]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * width, 1), (4003, [None] + [1.0] * (width - 1), 1), (4004, [float("nan")] * width, 1)]
    rows += [(4005, [float("inf")] * width, 1), (4006, rows[5][1], None), (4007, rows[5][1], 9), (4008, [1.0, 0.0], 1), (4009, [1.0, 0.01], 1), (4010, [1e-30, 0.0], 1)]
    return rows + [(None, rows[9][1], rows[9][2]), (None, [1.0], 1), rows[11], rows[11]]


@pytest.mark.parametrize("options", [{"margin": 100.0, "lists": 7, "block": 16}, {"margin": 100.0, "lists": 1}, {"margin": 100.0}])
def test_wide_search_equals_all_pairs(spark, options):
    rows = vectors(np.random.default_rng(3))
    made = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS)
    got = quantised.linked(made, **options)
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == all_pairs(rows)


def test_default_search_finds_nearly_all_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    rows = [(k, (base[k % 300] + rng.normal(size=64) * rng.uniform(0.05, 0.3)).tolist(), k % 2) for k in range(3000)]
    made = quantised.linked(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS), lists=40)
    got = sum(r.n_links for r in made.collect())
    want = sum(n * times for (_, n, _, _), times in all_pairs(rows).items())
    assert 0.98 * want <= got <= want


def test_groups_of_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert quantised.linked(empty).collect() == [] and quantised.linked(empty).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []
    assert periodic.periodic(frame(spark, [])).collect() == []


def test_embedding_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_embedding_groups"](spark, sf_dir).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == all_pairs(rows)


def test_roots_are_the_least_places():
    left, right = np.array([5, 4, 1, 7]), np.array([4, 2, 0, 7])
    assert cells.roots_of(8, left, right).tolist() == [0, 0, 2, 3, 2, 2, 6, 7]
