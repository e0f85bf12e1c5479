"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindscape.llm import chat_format, html_content, language_id, maxent_lm, secret_crf
from bindscape.llm.bpe import token_digests
from bindscape.llm.impact_search import exact_top_k
from bindscape.llm.mixing import mix_counts
from bindscape.llm.multi_index_hashing import nearest
from bindscape.llm.ngram_join import ngram_jaccard_components
from bindscape.llm.periodic_runs import periodic_runs
from bindscape.llm.sorted_projection import near_duplicate_vectors
from bindscape.llm.spelling_variants import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS set
  FROM w
), g AS (
  SELECT doc_id, len(set) AS n, unnest(set) AS g FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
), e AS (
  SELECT a, b FROM o WHERE 100 * shared >= 90 * (na + nb - shared)
  UNION SELECT b, a FROM o WHERE 100 * shared >= 90 * (na + nb - shared)
), r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""")
def op1_ngram_jaccard_join(spark, sf):
    return ngram_jaccard_components(table(spark, sf, "documents"))


@query()
def op2_byte_bpe(spark, sf):
    return token_digests(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_maxent_lm(spark, sf):
    docs = table(spark, sf, "documents")
    out = language_id.is_held_out("doc_id", 7, 2)
    return maxent_lm.score(docs, maxent_lm.fit(docs.where(~out).select("text")), held_out=out)


_PRIME = 2147483647


def _mix_hash(key: str, turn: str, x: str) -> str:
    y = f"((({x}) % {_PRIME}) * 48271::BIGINT + (({x}) // {_PRIME}) * 7919 + (({key}) % {_PRIME}) * 69621 + ({turn}) * 16807 + 12345) % {_PRIME}"
    return f"((({y}) * (({y}) + 1)) % {_PRIME} * 39373 + ({turn})) % {_PRIME}"


_KEY = "source_no * 4 + i // blocks + 1"
_PARTNER = f"(((({_mix_hash(_KEY, 'r', '7')}) * {_PRIME}::BIGINT + ({_mix_hash(_KEY, 'r', '11')})) % blocks) + blocks - acc) % blocks"
_BLOCK = f"""list_reduce(range(1, 13), lambda acc, r: list_transform([{_PARTNER}], lambda p:
  CASE WHEN (({_mix_hash(_KEY, 'r', 'greatest(acc, p)')}) // 65536) % 2 = 1 THEN p ELSE acc END)[1], i % blocks)"""


@query(f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ((doc_id % {_PRIME} + {_PRIME}) % {_PRIME}) * 48271 % {_PRIME} % greatest(1, (count(*) OVER () + 4095) // 4096) AS bucket
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
), s1 AS (
  SELECT *, [5, 2, 1][source_no % 3 + 1]::BIGINT AS weight, source_size * 3 AS most FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (
      ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remain,
    sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
  FROM s1
), s3 AS (
  SELECT *, most * weights < remain * weight AS bounded FROM s2
), s4 AS (
  SELECT *, (SELECT max({{'w': weights, 'l': remain}}) FROM s3 WHERE NOT bounded) AS level FROM s3
), s5 AS (
  SELECT *, CASE WHEN bounded THEN most::DOUBLE ELSE (level.l * weight)::DOUBLE / level.w::DOUBLE END AS target,
    (source_size + 63) // 64 AS blocks FROM s4
), s6 AS (
  SELECT *, coalesce(least(floor(target * blocks / nullif(source_size, 0) + 0.5)::BIGINT, blocks * 3), 0) AS slots FROM s5
), i AS (
  SELECT source_no, blocks, unnest(range(slots)) AS i FROM s6 WHERE slots > 0
), c AS (
  SELECT source_no, block, count(*) AS n FROM (SELECT source_no, {_BLOCK} AS block FROM i) GROUP BY ALL
), r AS (
  SELECT d.doc_id, d.size, s6.source_no, s6.source_size, s6.target, row_number() OVER () AS rid, (sum(d.size) OVER (
    PARTITION BY s6.source_no ORDER BY bucket NULLS FIRST, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), p AS (
  SELECT rid, source_no, pos, size, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) AS block FROM r WHERE size > 0
), t AS (
  SELECT rid, sum((least((block + 1) * 64, pos + size) - greatest(block * 64, pos)) * n)::BIGINT AS taken
  FROM p JOIN c USING (source_no, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN t USING (rid)
""")
def op4_mix_to_weights(spark, sf):
    return mix_counts(table(spark, sf, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
""")
def op5_exact_top_k(spark, sf):
    return exact_top_k(table(spark, sf, "embeddings"))


@query()
def op6_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    out = language_id.is_held_out("doc_id", 3, 1)
    labelled = docs.where(~out & F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = language_id.identify(docs, language_id.fit(labelled))
    return found.select("doc_id", language_id.is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query()
def op7_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_conversations(rows.unionByName(probe)))


@query()
def op8_html_content(spark, sf):
    pages = table(spark, sf, "pages")
    return html_content.extract(pages, html_content.fit(pages))


@query()
def op9_secret_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return secret_crf.scan(docs, secret_crf.fit(docs))


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.seen = e.a
), c AS (
  SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""")
def op10_sorted_projection(spark, sf):
    return near_duplicate_vectors(table(spark, sf, "embeddings"))


def _crc32(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda acc, x:
      list_reduce(list_prepend(xor(acc, x), range(8)), lambda y, b: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""


@query(f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
    {_crc32('doc_id::VARCHAR')} AS h
  FROM documents
), e AS (
  SELECT *, len(o)::BIGINT AS n, h // 10 % greatest(len(o), 1) AS a FROM d
), t AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
      list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) END])
    ELSE o END AS w
  FROM e
), p AS (
  SELECT rid, n, unnest(w) AS w, unnest(range(n)) AS i FROM t
), m AS (
  SELECT y.rid, y.i, y.i - x.i AS q FROM p x JOIN p y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= y.n
), s AS (
  SELECT rid, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length
), b AS (
  SELECT rid, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS top,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM r GROUP BY rid
), g AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT rid, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM p ANTI JOIN g USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256, n AS n_words
FROM t LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
""")
def op11_periodic_runs(spark, sf):
    return periodic_runs(table(spark, sf, "documents"), plant=True)


@query()
def op12_multi_index_hashing(spark, sf):
    return nearest(table(spark, sf, "embeddings"))


@query(f"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), h AS (
  SELECT run, {_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM o WHERE length(run) >= 7
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h
), v AS (
  SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), i AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), m AS (
  SELECT word, n, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS masked FROM i
), l AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM i
), e AS (
  SELECT a.word, b.word AS near, b.n FROM m a JOIN m b ON a.masked = b.masked AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM l JOIN v ON l.less = v.word
  UNION ALL SELECT v.word, l.word, l.n FROM l JOIN v ON l.less = v.word
), b AS (
  SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM e GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.near END AS form,
    CASE WHEN -best.less >= 10 * v.n THEN (-best.less)::BIGINT END AS form_n
  FROM v LEFT JOIN b USING (word)
), r(word, last) AS (
  SELECT word, word FROM f
  UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.last = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, last AS root, n, n_near, form_n FROM f JOIN r USING (word)
WHERE r.last NOT IN (SELECT word FROM f WHERE form IS NOT NULL)
""")
def op13_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"), plant=True)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
