"""Cases in which an operator once did less than its whole job."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from bindscape.llm import secret_crf
from bindscape.llm.html_content import Page
from bindscape.llm import ngram_join
from bindscape.llm.mixing import mix_documents
from bindscape.llm.ngram_join import ngram_jaccard_components, one_of_each_group
from bindscape.llm.sorted_projection import near_duplicate_vectors

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, name, rows):
    return dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, DOCUMENTS), SF)


def five_word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(texts):
    """Least ids of the components at Jaccard 0.8, by comparing all pairs."""
    sets, root = {k: five_word_sets(x) for k, x in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in texts if find(k) == k}


def test_columns_are_counted_in_slices_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_ENTRIES", 1)
    cells = spark.createDataFrame([(s, s % 3, h) for s in range(6) for h in range(-9, 9) if (s + h) % 2], "sid long, grp long, h long")
    shared = ngram_join._shared_columns(cells, ngram_join.SLICES)
    files = {file.rsplit("/", 2)[1] for file in shared.inputFiles()}
    assert len(files) == ngram_join.SLICES and sorted(r.h for r in shared.collect()) == list(range(-9, 9))
    counts = ngram_join._count_of(cells, shared.where("h > 0"), ngram_join.SLICES).collect()
    assert {r.sid: r["count"] for r in counts} == {s: sum((s + h) % 2 for h in range(1, 9)) for s in range(6)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(r.doc_id for r in stage(spark, "ngram_jaccard_join", [(k, x, "en", "a", 0) for k, x in texts.items()]).collect())
    assert got == sorted(first_of_each_group(texts))


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(50)]
    texts = {0: " ".join(base), 1: " ".join([*base[:25], "other", *base[26:]])}
    for k in range(2, 40):
        words = list(base) if k % 3 else [f"v{rng.randrange(300)}" for _ in range(60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts[k] = " ".join(words)
    # words at the end change fewer shingles: 42 of 50 (0.84) and 40 of 52 (0.77) are shared
    texts |= {50: " ".join(f"y{k}" for k in range(50)), 51: " ".join([f"y{k}" for k in range(46)] + list("abcd"))}
    texts |= {52: " ".join(f"z{k}" for k in range(50)), 53: " ".join([f"z{k}" for k in range(44)] + list("abcdef"))}
    texts |= {r.doc_id + 1000: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(k, x, "en", "a", 0) for k, x in texts.items()]
    got = sorted(r.doc_id for r in stage(spark, "ngram_jaccard_join", rows).collect())
    assert got == sorted(first_of_each_group(texts))


def words(tag, n=30):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_near_duplicate_stage_keeps_clean_rows_without_or_with_repeated_ids(spark):
    rows = [
        (None, words("a"), "en", "a", 0), (None, words("b"), "en", "a", 0), (None, words("b"), "en", "b", 0), (None, words("c"), "en", "a", 0),
        (1, words("a"), "en", "a", 0), (2, words("d"), "en", "a", 0), (5, words("d"), "en", "a", 0), (5, words("e"), "en", "a", 0),
        (5, words("e"), "en", "a", 0), (6, words("f"), "en", "a", 0), (6, words("g"), "en", "a", 0), (7, None, "en", "a", 0),
        (None, None, "en", "a", 0), (None, " ", "en", "a", 0), (None, " ", "en", "a", 0)]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, "ngram_jaccard_join", rows).collect()), key=str)
    assert got == sorted([
        (None, words("b")), (None, words("c")), (1, words("a")), (2, words("d")), (5, words("e")), (6, words("f")), (6, words("g")),
        (7, None), (None, None), (None, " "), (None, " ")], key=str)


def test_of_a_repeated_id_the_unique_text_stays(spark):
    rows = [(k, words(t), "en", "a", 0) for k, t in [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "d"), (None, "e")]]
    got = one_of_each_group(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(1, words("a")), (2, words("b")), (3, words("c")), (None, words("d")), (None, words("e"))], key=str)


def test_columns_of_any_name_stay(spark):
    names = ["row_key", "need", "Need_Key", "copied", "grp", "sid", "doc_id"]
    rows = [(k, words(t), *[f"{c}{k}" for c in names]) for k, t in [(3, "a"), (2, "a"), (2, "a"), (4, "b")]]
    docs = spark.createDataFrame(rows, "page long, text string, " + ", ".join(f"{c} string" for c in names))
    got = one_of_each_group(docs, id_col="page")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted({rows[1], rows[3]})


def test_language_stage_without_labels_drops_only_letterless_texts(spark):
    rows = [(1, "some words", None, "a", 10), (None, "\u6f22\u5b57", None, "a", 2), (2, "12 !", None, "a", 4), (3, None, None, "a", None), (4, "", None, None, 0)]
    got = [(r.doc_id, r.text, r.n_chars) for r in stage(spark, "language_id", rows).collect()]
    assert sorted(got, key=str) == sorted([(1, "some words", 10), (None, "\u6f22\u5b57", 2)], key=str)


def test_language_stage_rejects_mixtures_and_fills_labels(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    by_lang = {}
    for doc_id, text, lang, *_ in rows:
        if text and lang:
            by_lang.setdefault(lang, []).extend(w for w in text.split() if w.isalpha())
    n = min(map(len, by_lang.values()))
    mixture = " ".join(w for words in by_lang.values() for w in words[: min(n, 400)])
    known = {lang: " ".join(words[:200]) for lang, words in by_lang.items()}
    extra = [(9001, mixture, "en", "a", 1)] + [(9100 + k, x, None, "a", 2) for k, x in enumerate(known.values())] + [(9200, known["en"], "en", None, None)] * 2
    got = stage(spark, "language_id", rows + extra).collect()
    kept = {r.doc_id: r for r in got}
    # by the rule: letters, and a language that holds at least half of the words
    assert 9001 not in kept and len(got) == len([r for r in rows if r[1] and any(c.isalpha() for c in r[1])]) + len(known) + 2
    assert [kept[9100 + k].lang for k in range(len(known))] == list(known)
    assert all(kept[r[0]].lang == r[2] and kept[r[0]].text == r[1] for r in rows if r[0] in kept)
    empty = spark.createDataFrame([], DOCUMENTS)
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, empty, SF).count() == 0 and run(spark, empty, SF).columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def blocks(source):
    return [t for _, t in Page(source).blocks]


def test_stray_quotes_in_tags_take_no_text():
    assert blocks("<p title=don't>It's ok</p><p>next") == ["It's ok", "next"]
    assert blocks("<p it's>a</p><p 'x>b</p><p \">c</p>") == ["a", "b", "c"]
    assert blocks("<p title=\"never closed>a</p><p>b") == ["a", "b"]
    assert blocks("<p title='a > b' class=x>c</p><p title = \"it's >\">d") == ["c", "d"]
    assert blocks("<p a=\">\" <p>b") == ["b"]
    page = Page("<div title='class=ad' CLASS=\"Post body\" id=it's hidden>a</div>")
    assert page.names[1] == ("post", "body", "it", "s", "unshown") and page.blocks == [(1, "a")]


def test_tags_take_linear_time():
    began = time.time()
    for source in ("<p " + "a" * 5000 + "'", "<p " + "a" * 60 + "' b", "<a b " * 50_000, "<x a=\">\" " * 20_000, "<p a='" * 20_000, "<p " + "a = " * 50_000, "<p " + " " * 100_000):
        Page(source)
        Page(source + ">")
    assert blocks("<p " + "a" * 60 + "'>text</p>") == ["text"]
    assert time.time() - began < 20


def test_unclosed_unseen_elements_hide_no_article():
    article = "<article><h1>t</h1><p>text</p></article>"
    for name in ("button", "select", "object", "video", "svg", "canvas"):
        assert blocks(f"<body><div><{name}>no</div>{article}</body>") == ["t", "text"], name
        assert blocks(f"<body><{name}>no{article}</body>") == ["t", "text"], name
        assert blocks(f"<body><div><{name}>no</div>{article}<div><{name}>no</{name}></div></body>") == ["t", "text"], name
        assert blocks(f"<body><div><{name}><div>no</div>no</{name}>yes</div>{article}</body>") == ["yes", "t", "text"], name
    assert blocks("<div><button>a<button>b</button>c</div>") == ["c"]
    assert blocks("<div><noscript><p>a</noscript>b</div>") == ["b"]


def test_field_adds_what_the_patterns_cut_off(spark):
    rng = random.Random(8)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    plain = lambda n: " ".join(rng.choice(["the", "log", "of", "house", "ran", "green", "over", "time"]) for _ in range(n))
    tail = lambda: rng.choice(["", "", ",", ";", f"&{key(9)}"])
    known = [(k, f"{plain(rng.randrange(9))} password={key(rng.randrange(8, 24))}{tail()} {plain(rng.randrange(9))}".strip()) for k in range(600)]
    known += [(k, plain(30)) for k in range(600, 900)]
    model = secret_crf.fit(spark.createDataFrame(known, "doc_id long, text string"))
    texts = ["password=Tr0ub4dor&3xyzLonger", "the log password=Tr0ub4dor&3xyzLonger ran over", "over password=Tr0ub4dor3xyz of time",
             "over password=Tr0ub4dor3xyz, of", "green time"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secret_crf.scan(docs, model).collect()}
    assert found == {0: "assign:0:18,crf:18:29", 1: "assign:8:26,crf:26:37", 2: "assign:5:27", 3: "assign:5:27", 4: ""}
    clean = {r.doc_id: r.text for r in secret_crf.redact(docs, model).collect()}
    assert clean == {0: "[SECRET]", 1: "the log [SECRET] ran over", 2: "over [SECRET] of time", 3: "over [SECRET], of", 4: "green time"}


def test_field_spans_around_matches():
    import pyarrow as pa

    class EveryOtherToken:
        emissions = staticmethod(lambda rows: rows[0])
        decode = staticmethod(lambda e, bounds: np.arange(len(e)) % 2)

    texts = ["\u00e9 x_password=Qx7pLm2vRt\u00e9\u00e9w9. of (token=abcdefgh1,secret=abcdefgh2\")."]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)] * 2, ["a", "b"])
    [(place, spans)] = secret_crf._text_spans(batch, EveryOtherToken)
    cut = [(secret_crf.KINDS[kind], texts[0][a:z]) for a, kind, z in spans]
    assert place == 0 and cut == [("crf", "x_"), ("assign", "password=Qx7pLm2vRt"), ("crf", "\u00e9\u00e9w9"),
                                  ("assign", "token=abcdefgh1"), ("assign", "secret=abcdefgh2")]


def test_parts_outside_spans():
    assert secret_crf._outside(2, 20, [(4, 0, 6), (5, 1, 9), (15, 2, 25), (30, 0, 40)]) == [(2, 4), (9, 15)]
    assert secret_crf._outside(2, 20, []) == [(2, 20)] and secret_crf._outside(2, 5, [(0, 0, 5)]) == []


@pytest.mark.parametrize("n_dense, n_other", [(2500, 1500), (2500, 0)])
def test_pairs_in_a_dense_region_of_vectors_that_do_not_link(spark, n_dense, n_other):
    """Vectors at mutual cosines of about 0.88, a few pairs among them at 0.953."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    d = 128
    around = rng.normal(size=(n_dense, d))
    around[:, 0] = 0
    around = unit(around)
    for k in range(0, 120, 2):
        turned = around[k + 1] - (around[k] @ around[k + 1]) * around[k]
        around[k + 1] = 0.61 * around[k] + np.sqrt(1 - 0.61 ** 2) * unit(turned)
    x = np.sqrt(0.12) * around
    x[:, 0] += np.sqrt(0.88)
    x = np.concatenate([x, unit(rng.normal(size=(n_other, d)))]).astype(np.float32)
    y = unit(x.astype(float))
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[:120, :120].sum() == 120
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = near_duplicate_vectors(table).toPandas().set_index("vec_id").loc[range(len(x))]
    assert got["n_links"].tolist() == near.sum(axis=1).tolist()
    assert got["component_id"].tolist() == [min([i, *np.flatnonzero(near[i])]) for i in range(len(x))]


def test_dead_tables_go_before_a_step_ends(spark):
    from pathlib import Path

    from bindscape.functions import session

    texts = [" ".join(f"w{(7 * i + k) % 400}" for k in range(60 + i % 3)) for i in range(40)]
    rows = [(i, texts[i % 35] + " x" * (i % 2), "en", f"s{i % 3}", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    session.settle(docs.select("doc_id"))
    root = Path(session._scratch_root(spark).removeprefix("file:"))
    tables = lambda: {p.name for p in root.iterdir()}
    for step, most in ((ngram_jaccard_components, 1), (one_of_each_group, 2), (mix_documents, 2)):
        before = tables()
        out = step(docs)
        assert before <= tables() and len(tables() - before) <= most, step.__name__
        assert out.count() == out.count() > 0
