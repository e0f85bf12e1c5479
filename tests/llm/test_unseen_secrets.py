import random

import pytest
from pyspark.sql import functions as F

from bindscape.llm import language_id, secret_crf

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLEAN = [
    "see https://www.example.org/articles/2021/07/long-title-of-a-page-12 for more", "mail anna.schmidt42@mail3.example.com or call +49-301234567",
    "version 3.12.1 of 2024-03-05T10:11:12Z was slow", "class AbstractWidgetFactoryBean in /usr/lib/python3/dist-packages/apt.py",
    "colour = \"turquoise\" and size=large", "the pneumonoultramicroscopic reading of Donaudampfschifffahrt 1234567",
    "ISO-8859-1 and UTF-8 and RFC-2119", "total: 1,234,567 units, order #48291", "state-of-the-art well-known mother-in-law", "a | b | c --- ### ***",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return secret_crf.fit(docs.where(~language_id.is_held_out("doc_id", 3, 1)))


def test_secrets_behind_unseen_names(spark, model):
    """Recall 0.8 and precision 0.9 on values behind names that no pattern has."""
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(LETTERS) for _ in range(n - 2)) + "x7"
    forms = [lambda: f"pwd = {key(14)}", lambda: f"Bearer {key(40)}", lambda: f"ghp_{key(36)}", lambda: f"api-key: {key(32)}", lambda: f"client_key={key(24)}",
             lambda: f"sk_live_{key(24)}", lambda: f'"credential": "{key(28)}"', lambda: f"export AUTH='{key(20)}'"]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(language_id.is_held_out("doc_id", 3, 1))
    texts = [r.text for r in docs.where(F.length("text").between(200, 3000)).orderBy("doc_id").limit(200).collect()]
    texts = [t for t in texts if not secret_crf.base_spans(t)]
    rows, value = [], {}
    for i, t in enumerate(texts):
        words = t.split(" ")
        at = rng.randrange(len(words))
        secret = forms[i % len(forms)]()
        rows.append((i, " ".join(words[:at] + [secret] + words[at:])))
        value[i] = secret.split()[-1].split("=")[-1].strip("\"'")
        rows.append((1000 + i, t))
    rows += [(5000 + i, t) for i, t in enumerate(CLEAN)]
    text_of = dict(rows)
    found = {r.doc_id: r.spans for r in secret_crf.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = right = total = 0
    for i, spans in found.items():
        cut = [text_of[i][int(a):int(z)] for _, a, z in (x.split(":") for x in spans.split(",") if x)]
        total += len(cut)
        right += sum(i in value and value[i] in c for c in cut)
        hit += i in value and any(value[i] in c for c in cut)
    assert len(value) > 100 and hit >= 0.8 * len(value) and right >= 0.9 * total
