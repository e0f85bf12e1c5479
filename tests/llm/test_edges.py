"""Nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib

import public_tokenizers as P
import pytest

from bindscape.llm import chat_format, html_content, language_id, maxent_lm, secret_crf
from bindscape.llm.bpe import token_digests
from bindscape.llm.impact_search import exact_top_k
from bindscape.llm.mixing import mix_counts, mix_documents
from bindscape.llm.ngram_join import ngram_jaccard_components, one_of_each_group
from bindscape.llm.sorted_projection import near_duplicate_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, sid long, h long, size string, key string, row long"
LONG = "one two three four five six seven " * 4_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, "en", None), (3, "", None, "b"), (4, " \t\n", "en", "b"), (None, "the quick brown fox jumps over the lazy dog", None, None),
    (5, "word", "en", "a"), (6, "WORD", "en", "c"), (7, LONG, "en", "a"), (8, LONG + "x", "en", "a"), (9, "12345 !!", "en", "b"),
    (1, "another text of the same id", "en", "b"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, None, 1, 2, 3, "x", "y", 4) for r in rows], SCHEMA)


def empty(df):
    return df.limit(0)


def test_ngram_join(spark):
    docs = documents(spark)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs).collect()), key=str)
    assert got == sorted([
        (1, 7, 1), (1, 7, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 7, 1), (5, 1, 5), (6, 1, 5), (7, 7, 7), (8, 8, 8),
        (9, 1, 9), (1, 4, 1)], key=str)
    assert ngram_jaccard_components(empty(docs)).count() == 0
    kept = sorted(r.doc_id for r in one_of_each_group(docs).collect())
    assert kept == [1, 2, 3, 4, 5, 7, 8, 9]


def test_bpe(spark):
    path, docs = P.path("byte_bpe_50k.tiktoken"), documents(spark)
    got = token_digests(docs, path, P.PATTERN, chunk=1000, overlap=50).collect()
    want = sorted(hashlib.sha256((t[1] or "").encode()).hexdigest() for t in TEXTS)
    assert sorted(r.decoded_sha256 for r in got) == want
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert token_digests(empty(docs), path, P.PATTERN).count() == 0


def test_maxent(spark):
    docs = documents(spark)
    rows = maxent_lm.score(docs, maxent_lm.fit(docs.select("text"))).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    none = maxent_lm.fit(empty(docs).select("text"))
    assert maxent_lm.score(empty(docs), none).count() == 0
    assert {(r.n_known, r.train_tokens) for r in maxent_lm.score(docs, none).collect()} == {(0, 0)}


def test_mixing(spark):
    docs = documents(spark)
    rows = mix_counts(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.source_size for r in rows if r.doc_id is None or r.doc_id == 2} == {9}  # the null source
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mix_counts(empty(docs)).count() == 0
    assert mix_counts(documents(spark, [(1, None, None, None), (2, " ", None, "a")])).count() == 2
    texts = mix_documents(docs)
    assert texts.columns == docs.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(r.taken for r in rows)
    assert mix_documents(empty(docs)).count() == 0


def test_language(spark):
    docs = documents(spark)
    model = language_id.fit(docs.where("text IS NOT NULL AND lang IS NOT NULL"))
    rows = language_id.identify(docs, model, keep=["text", "size"]).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 9)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (5, 7)} == {"en"}
    assert language_id.identify(empty(docs), model).count() == 0
    assert language_id.language_spans(docs, model).where("doc_id = 7").collect()[0].n_words == 28_000
    none = language_id.fit(empty(docs))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_secrets(spark):
    docs = documents(spark).unionByName(documents(spark, [(20, "é password: hunter2hunter2 \n" * 3, None, None)]))
    model = secret_crf.fit(docs)
    rows = {r.doc_id: r for r in secret_crf.scan(docs, model).collect()}
    assert rows[20].n_assign == 3 and rows[20].spans.startswith("assign:2:26,")
    assert rows[2].spans == rows[3].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secret_crf.redact(docs, model).collect()}
    assert clean[20] == "é [SECRET] \n" * 3 and clean[2] is None and clean[3] == ""
    assert secret_crf.scan(empty(docs), secret_crf.fit(empty(docs))).count() == 0


def test_vectors(spark):
    nan = float("nan")
    vectors = [
        (1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (50, [1.0, 0.0]), (100, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in vectors], "vec_id long, embedding array<float>, label int, uid long, rank string, id long")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted([
        (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (50, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True),
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (100, 0, 100, True)], key=str)
    assert near_duplicate_vectors(empty(df)).count() == 0
    top = exact_top_k(df, k=3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in top] == [(50, 1, 1, 65536), (50, 2, 2, 65536), (50, 3, 2, 65536)]
    assert exact_top_k(empty(df)).count() == 0
    assert exact_top_k(df.where("vec_id = 50")).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", "a<\\s>b<\\\\/s>"), (2, None, None, None), (2, 0, "assistant", ""),
            (None, 0, "user", "x"), (3, 5, "assistant", "é\n" * 20_000), (3, 5, "assistant", "é\n" * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int")
    formatted = chat_format.format_conversations(df)
    turns = {r.conv_id: chat_format.read_turns(r.formatted) for r in formatted.collect()}
    assert turns[1] == [(a, b) for _, _, a, b in rows[:3]]
    assert turns[2] == [("", ""), ("assistant", "")] and turns[None] == [("user", "x")]
    digests = {r.conv_id: r for r in chat_format.conversation_digests(formatted).collect()}
    assert digests[3].loss_chars == 80_000 and digests[None].loss_chars == 0
    assert digests[1].loss_sha256 == hashlib.sha256((rows[1][3] + rows[2][3]).encode()).hexdigest()
    assert chat_format.conversation_digests(chat_format.format_conversations(empty(df))).count() == 0


def test_html(spark):
    page = "<body><nav><a href=/>home</a></nav><article><h1>A &amp; b</h1><p>" + "Long words here. " * 10_000 + "</p></article></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<<>< &nbsp; <p"), (4, "u", "plain words, no tags.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    model = html_content.fit(df, made=60)
    got = html_content.extract(df, model).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id == 1} == {"A & b\n" + ("Long words here. " * 10_000).strip()}
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert html_content.extract(empty(df), html_content.fit(empty(df), made=20)).count() == 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_pipeline_is_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
