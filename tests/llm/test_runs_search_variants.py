"""Periodic runs, multi-index hashing and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np

from bindscape.llm import multi_index_hashing as mih
from bindscape.llm.periodic_runs import find_runs, periodic_runs, planted_repeats
from bindscape.llm.spelling_variants import roots, signatures, spelling_variants

NOTHING = hashlib.sha256(b"").hexdigest()


# -- periodic runs

def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j + 1 < len(w) and w[j + 1] == w[j + 1 - q]:
                j += 1
            part = w[i - q: j + 1]
            least = next(p for p in range(1, q + 1) if all(part[x] == part[x - p] for x in range(p, len(part))))
            if least == q and len(part) >= max(6, 4 * q):
                out.add((i - q, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    s, size, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), s, size, q, runs and 1000 * size // q or None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(rng):
    w = []
    while len(w) < rng.randrange(120):
        if rng.random() < 0.5:
            part = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
            w += [part[i % len(part)] for i in range(rng.randrange(1, 80))]
        else:
            w += [rng.randrange(6) for _ in range(rng.randrange(1, 7))]
    return w


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        texts = [periodic_words(rng) for _ in range(rng.randrange(1, 5))]
        text, start, length, period = find_runs(
            np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64))
        for k, w in enumerate(texts):
            own = text == k
            assert list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())) == brute_runs(w)


def test_runs_of_long_uniform_texts_take_one_pass():
    n = 200_000
    same = np.zeros(n, np.int64)
    broken = same.copy()
    broken[[n // 3, 2 * n // 3]] = [1, 2]
    for words, want in ((same, [(0, n, 1)]), (np.arange(n) % 1000, [(0, n, 1000)]),
                        (broken, [(0, n // 3, 1), (n // 3 + 1, n // 3, 1), (2 * n // 3 + 1, n - 2 * n // 3 - 1, 1)])):
        _, start, length, period = find_runs(words, np.array([n]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_periodic_rows_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, " \t".join("ab cd Cd é x y".split()[x] for x in periodic_words(rng))) for k in range(300)]
    rows += [(None, "a a a a a a a"), (3, "a a a a a a a"), (3, "a a a a a a a"), (900, None), (901, ""), (902, " \n"), (903, "one")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_runs int, start int, period string")
    for plant in (False, True):
        got = [tuple(r)[:8] for r in periodic_runs(docs, plant=plant).collect()]
        assert sorted(got, key=str) == sorted((brute_row(*r, plant) for r in rows), key=str)
    assert any(planted_repeats(str(k), 100) for k in range(300))
    assert periodic_runs(docs.limit(0)).count() == 0
    empty = {r.doc_id: r for r in periodic_runs(docs).collect()}[900]
    assert (empty.n_runs, empty.start, empty.runs_sha256, empty.collapsed_sha256) == (0, None, NOTHING, NOTHING)


def test_a_very_long_text(spark):
    text = "word " * 300_000 + "end"
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 300_000, 1)
    assert row.collapsed_sha256 == hashlib.sha256(b"word end").hexdigest()


# -- multi-index hashing

def brute_nearest(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        out[ids[i]] = [(ids[j], score[j]) for j in np.lexsort((ids, -score))[:k]][: len(ids) - 1]
    return out


def vector_table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def recall(got, want):
    hit = sum(len({r.vec_id for r in got if r.query_id == q} & {j for j, _ in near}) for q, near in want.items())
    return hit / sum(len(near) for near in want.values())


def test_pigeonhole_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2, 256)
    bits = np.concatenate([rng.integers(0, 2, (3000, 256)), np.where(rng.random((1500, 256)) < rng.random((1500, 1)) * 0.3, 1 - centre, centre)])
    codes = np.packbits(bits, axis=1).view(np.uint64)
    index = mih.ShardIndex(codes)
    for q in (0, 3000, 4000):
        far = (bits != bits[q]).sum(axis=1)
        for radius in (0, 1, 14, 15, 16, 40, 47, 70, 110, 256):
            probe = mih.Probe(index, codes[q])
            assert probe.within(radius).tolist() == np.flatnonzero(far <= radius).tolist()
            if radius <= 47 and q:
                assert probe.compared < len(codes)


def test_recall_over_shards_norms_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD_ROWS", 700)
    monkeypatch.setattr(mih, "QUERY_ROWS", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 24))
    x[400:900] = x[400] + 0.05 * rng.normal(size=(500, 24))  # near copies
    x[900:960] = x[900]  # copies, so ties
    x *= rng.uniform(0.5, 3, (2500, 1))
    x[900:960] = x[900]
    ids = rng.permutation(2500)
    got = mih.nearest(vector_table(spark, ids, x)).collect()
    want = brute_nearest(ids, x, 20, 20)
    assert recall(got, want) >= 0.95
    assert len(got) == 20 * len(want) and sorted({r.rank for r in got}) == list(range(1, 21))
    place = {i: k for k, i in enumerate(ids.tolist())}
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert all(abs(r.score - x[place[q]] @ x[place[r.vec_id]]) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in own}


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    table = rows.toPandas()
    want = brute_nearest(table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float), 20, 20)
    assert recall(mih.nearest(rows).collect(), want) >= 0.95


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, None),
    ]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, row int, score int, part string")
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in mih.nearest(table).collect()), key=str)
    twice = [(20, 1, 20, 4.0), (20, 2, 1, 2.0), (20, 3, None, 2.0), (20, 4, 0, 0.0), (20, 5, 2, 0.0)]
    want = [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, None, 1.0), (0, 4, 20, 0.0), (0, 5, 20, 0.0), *twice, *twice]
    assert got == sorted(want, key=str)
    assert mih.nearest(table.limit(0)).count() == 0
    assert mih.nearest(table.where("vec_id = 1")).count() == 0
    assert mih.nearest(table.where("vec_id = 0")).count() == 0


# -- spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, plant, min_length=7):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if plant and doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [x for x in counts if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def edited(rng, w, letters):
    i, kind = rng.randrange(len(w)), rng.random()
    if kind < 0.4:
        return w[:i] + rng.choice(letters) + w[i + 1:]
    return w[:i] + w[i + 1:] if kind < 0.7 else w[:i] + rng.choice(letters) + w[i:]


def test_every_edit_shares_a_signature():
    rng = random.Random(7)
    a = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 15))) for _ in range(4000)]
    b = [edited(rng, w, "abcdeéz") for w in a]
    (same, short, long), (same_b, short_b, long_b) = signatures(a), signatures(b)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            one, two = {0: (same, same_b), -1: (short, long_b), 1: (long, short_b)}[len(x) - len(y)]
            assert set(one[i].tolist()) & set(two[i].tolist()), (x, y)


def test_variants_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(30)]
    rows = []
    for k in range(150):
        said = []
        for _ in range(60):
            w = words[min(rng.randrange(30), rng.randrange(30))]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                w = edited(rng, w, "abéñ")
            said.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((k if k % 9 else None, ", ".join(said)))
    rows += [rows[1], (7, None), (8, ""), (9, "12 ß×÷ " + "a" * 5000), (10, "a" * 5000 + " " + "a" * 4999 + " " + "a" * 4999), (9, "a" * 5000)]
    rows.append((20, "chainxxx " * 300 + "chainxxy " * 20 + "chainxyy " * 2))
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, word string, run string")
    for plant in (False, True):
        got = sorted(tuple(r) for r in spelling_variants(docs, plant=plant).collect())
        want = brute_variants(rows, plant)
        assert got == want
        assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling_variants(docs.limit(0)).count() == 0


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(str(k), str(k + 1)) for k in range(70)], "word string, form string")
    assert {r.root for r in roots(forms).collect()} == {"70"}
