"""Operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from bindscape.llm import html_content, language_id, maxent_lm, secret_crf
from bindscape.llm.bpe import decode_documents, encode_documents, token_digests
from bindscape.llm.graph import components
from bindscape.llm.impact_search import exact_top_k, shard_top_k
from bindscape.llm import mixing
from bindscape.llm.mixing import mix_counts, mix_documents
from bindscape.llm.ngram_join import ngram_jaccard_components
from bindscape.llm.sorted_projection import near_duplicate_vectors
from bindscape.llm.words import Words, text_bytes

from tests.llm.test_whole_job import first_of_each_group

SF = "/root/testdata/sf0.001"


def union(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k:k + 3]) for k in range(len(w) - 2)}


def brute_components(texts):
    sets = {k: shingles(x) for k, x in texts.items()}
    ids = list(texts)
    edges = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    return sets, union(ids, edges)


def test_words():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["A b", "", None, "é  A\n", "x"]))
    w = Words(data, offsets)
    assert w.counts.tolist() == [2, 0, 0, 2, 1]
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 320)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    groups = defaultdict(set)
    for x, r in got.items():
        groups[r].add(want[x])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({want[x] for x in got})


def test_ngram_join_finds_all_links(spark, monkeypatch):
    """Near copies in one large group, and a passage that many texts share."""
    from bindscape.llm import ngram_join

    monkeypatch.setattr(ngram_join, "WHOLE_ROW", 4)  # some rows are short at first
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [rng.choice(words) for _ in range(80)]
    texts = {}
    for k in range(30):
        edited = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        texts[k] = " ".join(edited)
    for k in range(30, 70):
        texts[k] = " ".join(passage + [rng.choice(words) for _ in range(rng.choice([2, 5, 8, 60]))])
    for k in range(70, 80):
        texts[k] = " ".join(rng.choice(["the", "of", "a"]) for _ in range(rng.choice([3, 12, 40])))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(df).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in texts}


@pytest.fixture(scope="module")
def tiktoken_encoder():
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, tiktoken_encoder):
    rng = random.Random(2)
    letters = list("aB'  \n\t\x1c\x1f\x85\xa0 19%$éñß漢\U0001F600'srtvmld.|")
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 400, 900]))) for _ in range(150)]
    texts += ["a" * 3000, " " * 3000, "x" * 500 + "1" * 1000 + " ab" * 300, "it's we'll they're " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in token_digests(df, path, P.PATTERN, chunk=64, overlap=16).collect()}
    for k, text in enumerate(texts):
        ids = tiktoken_encoder.encode_ordinary(text)
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = decode_documents(encode_documents(df, path, P.PATTERN, chunk=64, overlap=16), path)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == dict(enumerate(texts))


def test_maxent_is_a_distribution_and_beats_the_unigram(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.is_held_out("doc_id", 7, 2)
    model = maxent_lm.fit(docs.where(~out).select("text"))
    rows = maxent_lm.score(docs, model, held_out=out).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # all words after one context: known ones, and one unknown word for each tail class
    counts = model.counts.toPandas()
    f = np.array([[5], [6], [7]])
    classes = np.exp(model.weights.log_classes(f))[0]
    assert abs(classes.sum() - 1) < 1e-5
    top = set(model.top.view(np.int64).tolist())
    inside = Counter()
    for h, c, tail in counts.itertuples(index=False):
        if tail >= 0 and h not in top:
            inside[tail] += (c + 1) / 10 ** model.log_mass[tail]
    for tail in range(maxent_lm.TAIL_CLASSES):
        assert abs(inside[tail] + 1 / 10 ** model.log_mass[tail] - 1) < 1e-9


def test_maxent_step_adds_up_rows_like_reduceat_and_sooner():
    rng = np.random.default_rng(4)
    flat = np.sort(np.r_[rng.integers(0, 20_000, 9000), rng.zipf(1.5, 3000) % 500])
    x, order = rng.normal(size=(4096, maxent_lm.CLASSES)).astype(np.float32), rng.integers(0, 4096, len(flat))
    at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    uses = np.diff(np.r_[at, len(flat)])
    assert (maxent_lm._row_sums(x, order, at, uses) == np.add.reduceat(x[order], at, axis=0)).all()

    def best(f):
        took = []
        for _ in range(20):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert best(lambda: maxent_lm._row_sums(x, order, at, uses)) < 0.8 * best(lambda: np.add.reduceat(x[order], at, axis=0))


def test_mixing_keeps_the_characters_of_texts(spark):
    rows = [(k, f"  a{k}\n\tb  c\u00e9 {k}\r\n" + "x  y\n" * (k % 90), "s", 1) for k in range(200)] + [(300, "one", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key int")
    got = mix_documents(docs)
    assert got.columns == docs.columns
    texts, whole = dict((r[0], r[1]) for r in rows), 0
    for r in got.collect():
        one = texts[r.doc_id].lstrip()
        words = r.text.split()
        assert set(words) <= set(one.split())
        whole += one in r.text
    assert whole > 100


def test_mixing_copies_no_text(spark):
    from pathlib import Path

    from bindscape.functions import session

    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(list("abcdefghijklmnop"), 4000)), "st"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    session.settle(docs.select("doc_id"))
    root = Path(session._scratch_root(spark).removeprefix("file:"))
    files = lambda: {p: p.stat().st_size for p in root.rglob("*.parquet")}
    before = files()
    got = mix_documents(docs)
    assert sum(n for p, n in files().items() if p not in before) < 0.3 * sum(len(r[1]) for r in rows)
    assert got.count() > 50


def test_mixing_keeps_apart_equal_and_nearly_equal_rows(spark):
    schema = "doc_id long, text string, source string, lang string, tags array<string>, notes map<string, string>"
    one = (1, "a b c d", "s", None, [None, "x"], {"k": "v"})
    rows = [one] * 5 + [(1, "a b c d", None, "s", [None, "x"], {"k": "v"}), (1, None, "s", "a b c d", None, None)]
    rows += [(1, "a b c d", "s", None, ["x", None], {"k": "w"}), (None, "e f", "s", None, None, None), (None, "e f", "s", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mix_documents(docs).collect()
    key = lambda r: (r[0], r[2], r[3], tuple(r[4] or ()), str(r[5]))
    most, found = Counter(map(key, rows)), Counter(map(key, got))
    assert all(found[k] <= most[k] for k in found) and found[key(one)] > 1
    assert all(set(r.text.split()) <= set("a b c d".split() if r.doc_id else "e f".split()) and r.text.strip() for r in got)


def test_mixing_draws_a_block_once(spark):
    rows = [(k, "a b c " * (k % 50), "st"[k % 2]) for k in range(100)]
    sized = mixing._sized(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", [])
    plan = mixing._pieces(*mixing._indexed(sized, []))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]


def test_mixing_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mix_counts(docs).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    source = docs.select("doc_id", "source").toPandas()
    by = rows.merge(source, on="doc_id").groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 0.05 * by["target"] + 64).all()
    assert abs(by["target"].sum() - by["size"].sum()) < 1
    shards = mixing.mixed_shards(docs).toPandas()
    taken = shards.groupby("doc_id")["n_words"].sum()
    assert {r.doc_id: r.taken for r in rows.itertuples() if r.taken} == taken.to_dict()
    # each slot of a shard holds one block of one source, and the shards but the last are full
    slots = shards.drop_duplicates(["shard", "slot"]).groupby("shard")["slot"].agg(["count", "max"])
    assert shards.groupby(["shard", "slot"])["source_no"].nunique().max() == 1
    assert (slots["count"] == slots["max"] + 1).all() and (slots["count"][:-1] == mixing.SHARD_SLOTS).all()
    again = mix_counts(docs.repartition(5)).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


@pytest.mark.parametrize("kind", ["uniform", "spread", "ties", "huge", "few"])
def test_top_k_of_a_shard(kind):
    rng = np.random.default_rng(3)
    x = {"uniform": rng.normal(0, 30, (500, 16)), "spread": rng.normal(0, 30, (500, 16)) * rng.pareto(1, (500, 1)),
         "ties": rng.integers(-1, 2, (500, 4)), "huge": rng.normal(0, 1, (60, 4)) * 1e8, "few": rng.normal(0, 9, (3, 4))}[kind]
    x = np.floor(x).astype(float)
    ids = np.arange(len(x), dtype=np.int64)
    q = slice(0, None, 7)
    i, j, s = shard_top_k((ids[q], ids[q], x[q]), (ids, ids, x), 5)
    whole = x.astype(np.int64).astype(object)
    exact = whole[q] @ whole.T
    for n, row in enumerate(exact):
        best = sorted((-int(v), c) for c, v in enumerate(row) if c != ids[q][n])[:5]
        assert [(-int(b), int(a)) for a, b in zip(j[i == n], s[i == n])] == best


def test_top_k_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r.vec_id, np.floor(np.array(r.embedding, float) * 256).astype(int)) for r in table.collect())
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(table).collect()}
    want = {}
    for a, x in rows:
        if a % 50 == 0:
            best = sorted((-int(x @ y), b) for b, y in rows if b != a)[:5]
            want |= {(a, k + 1): (b, -s) for k, (s, b) in enumerate(best)}
    assert got == want


def test_near_duplicate_vectors_at_the_threshold(spark):
    """Pairs just above and below the threshold, and a group larger than a window."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(v) for v in rng.normal(size=(1500, 32))]
    for cos in np.linspace(0.93, 0.97, 80):
        a = unit(rng.normal(size=32))
        b = rng.normal(size=32)
        b = unit(b - (a @ b) * a)
        rows += [a, cos * a + np.sqrt(1 - cos * cos) * b]
    centre = unit(rng.normal(size=32))
    rows += [unit(centre + 0.03 * rng.normal(size=32)) for _ in range(250)]
    x = np.array(rows, np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want = union(range(len(x)), zip(*map(list, np.nonzero(near))))
    got = near_duplicate_vectors(table).toPandas().set_index("vec_id").loc[range(len(x))]
    assert (got["n_links"] == near.sum(axis=1)).mean() > 0.999
    assert (got["component_id"] == [want[i] for i in got.index]).mean() > 0.999
    assert (got["n_links"] <= near.sum(axis=1)).all()


def test_language_accuracy_and_mixed_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.is_held_out("doc_id", 3, 1)
    model = language_id.fit(docs.where(~out & F.col("lang").isNotNull()))
    found = language_id.identify(docs, model, keep=["lang"]).where(language_id.is_held_out("doc_id", 3, 1))
    assert found.select(F.avg((F.col("lang_pred") == F.col("kept_lang")).cast("int"))).first()[0] > 0.97
    part = {r.lang: r.text for r in docs.where("n_chars BETWEEN 400 AND 900").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, part["en"] + " " + part["de"] + " " + part["en"])], "doc_id long, text string")
    spans = language_id.language_spans(mixed, model).orderBy("first_word").collect()
    assert [s.lang for s in spans] == ["en", "de", "en"]


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(0)
    bounds = np.r_[0, np.cumsum(rng.integers(0, 40, 60))]
    scores = rng.normal(0, 4, (bounds[-1], 3))
    got = language_id.label_words(scores, bounds, 9.0)

    def value(path, s):
        return s[np.arange(len(path)), path].sum() - 9.0 * (path[1:] != path[:-1]).sum()

    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            best = language_id._viterbi(scores[lo:hi], 9.0)
            assert abs(value(got[lo:hi], scores[lo:hi]) - value(best, scores[lo:hi])) < 1e-9


def test_secret_field_finds_held_out_secrets(spark):
    """The field alone, on texts it was not trained on, against the patterns."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language_id.is_held_out("doc_id", 3, 1)
    model = secret_crf.fit(docs.where(~out))
    texts = [r.text for r in docs.where(out).where(F.col("text").rlike(r"AKIA|[0-9a-f]{32}|(?i)(password|secret|token|api_?key)|[0-9]{9}")).select("text").collect()]
    hit = missed = extra = 0
    for first, end, data, offsets in secret_crf.slices(pa.array(texts)):
        f = secret_crf.Field(data, offsets)
        want = secret_crf._labels(f, first, pa.array(texts), secret_crf._may_match(data, offsets)) > 0
        got = model.decode(model.emissions(f.rows), f.words.bounds) > 0
        hit, missed, extra = hit + (want & got).sum(), missed + (want & ~got).sum(), extra + (got & ~want).sum()
    assert hit > 50 and hit / (hit + missed) > 0.9 and hit / (hit + extra) > 0.9


def test_secret_decoding_is_exact():
    rng = np.random.default_rng(1)
    moves = np.array([[1.0, -2, -30], [0.5, -3, 1], [0.2, -3, 0.5]])
    field = secret_crf.ConditionalField(np.zeros((4, 3)), moves)
    bounds = np.r_[0, np.cumsum(rng.integers(0, 9, 200))]
    e = rng.normal(0, 2, (bounds[-1], 3)) + [6, 0, 0]
    tags = field.decode(e, bounds)

    def value(path, s):
        return s[np.arange(len(path)), path].sum() + sum(moves[a, b] for a, b in zip(path[:-1], path[1:]))

    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            best = secret_crf._viterbi(e[lo:hi].tolist(), moves.tolist())
            assert abs(value(tags[lo:hi], e[lo:hi]) - value(np.array(best), e[lo:hi])) < 1e-9


def test_html_marginals_match_enumeration():
    page = html_content.Page("<body><div>a<p>b</p></div><ul><li>c</li></ul></body>")
    forest = html_content.Forest([page])
    rng = np.random.default_rng(2)
    weights, edges = rng.normal(size=1 << html_content.TABLE_BITS), rng.normal(size=(html_content.EDGE_KINDS, 2, 2))
    p, _ = forest.marginals(weights, edges)
    unary = np.bincount(forest.node, weights=weights[forest.rows], minlength=len(p))
    total = np.zeros(len(p))
    whole = 0.0
    for code in range(1 << len(p)):
        y = [code >> k & 1 for k in range(len(p))]
        v = np.exp(sum(unary[k] * y[k] for k in range(len(p))) + sum(edges[forest.edge[k], y[forest.parent[k]], y[k]] for k in range(1, len(p))))
        whole += v
        total += v * np.array(y)
    assert np.allclose(p, total / whole)


def test_html_on_held_out_layouts_and_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_content.fit(pages)
    right = total = 0
    for source in html_content.made_pages(80, seed=77):
        page = html_content.Page(source)
        labels = html_content._labels(page)
        want = "\n".join(t for k, t in page.blocks if labels[k])
        right += model.texts([html_content.Page(source.replace(' data-content="1"', "").replace(' data-content="0"', ""))])[0] == want
        total += 1
    assert right / total > 0.7
    for r in html_content.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        body = html_content.Page(r.html[r.html.index("<article>"): r.html.index("</article>")])
        assert r.text == "\n".join(t for _, t in body.blocks)


def test_page_parser():
    blocks = lambda s: [t for _, t in html_content.Page(s).blocks]
    assert blocks("<p>a<b>b<br>c<p>d &lt;e&gt; &amp;amp;<div>f</div>g") == ["ab c", "d <e> &amp;", "f", "g"]
    assert blocks("<script>if (a < b) '</p>'</script>x<!-- <p>no</p> -->y<style>p{}</style>") == ["xy"]
    assert blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert blocks("<title>t</title><body>5 < 6 <a title='>'>z</a>") == ["5 < 6 z"]
    assert blocks("<textarea><p>x</textarea><p>y") == ["y"]


def test_pipeline_against_brute_force(spark, tiktoken_encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "secret_scan", "mix_to_weights", "byte_bpe"]
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    lettered = {k for k, x in texts.items() if x and any(c.isalpha() for c in x)}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == lettered
    want = first_of_each_group({k: texts[k] for k in sorted(lettered)})  # five words, 0.8
    unique = stages["ngram_jaccard_join"](spark, kept, SF)
    rows = unique.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    masked = {r.doc_id: r for r in stages["secret_scan"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    for k, r in masked.items():
        spans, at, out = secret_crf.base_spans(texts[k]), 0, []
        for start, _, stop, _ in spans:
            if start >= at:
                out += [texts[k][at:start], secret_crf.MASK]
            at = max(at, stop)
        clean = "".join(out) + texts[k][at:]
        assert not secret_crf.base_spans(r.text) and len(r.text) <= len(clean) + 50 and r.n_chars == len(r.text)
    mixed = stages["mix_to_weights"](spark, spark.createDataFrame(list(masked.values()), docs.schema), SF)
    assert mixed.columns == docs.columns
    mixed_rows = mixed.collect()
    for r in mixed_rows:
        source = masked[r.doc_id].text.split()
        got = r.text.split()
        assert len(got) <= 3 * len(source) and set(got) <= set(source)
    last = stages["byte_bpe"](spark, spark.createDataFrame(mixed_rows, docs.schema), SF)
    for r in last.collect():
        text = next(x.text for x in mixed_rows if x.doc_id == r.doc_id)
        assert r.n_tokens == len(tiktoken_encoder.encode_ordinary(text))
