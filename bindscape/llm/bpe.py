"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap.  Every chunk finds its own pre-token
boundaries, in parallel.  The pattern only looks ahead, so two neighbours that
share one boundary in their overlap agree from there on: the chunks are stitched
at the first shared boundary and each piece between two stitches is encoded by
itself.  A chunk that shares none with its left neighbour (one very long token)
is joined to it, with what follows in the text, and encoded in one piece.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import os

import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from bindscape.functions.session import settle

CHUNK = 1 << 15  # code points that a chunk advances
OVERLAP = 1 << 9
LOOKAHEAD = 4  # code points behind a match that may have decided it; at most 2 for the public pattern
MAX_RANK_FILE = 64 << 20

_LOADED: dict[str, tuple] = {}


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank from a rank file (base64 and rank on each line)."""
    if os.path.getsize(path) > MAX_RANK_FILE:
        raise ValueError(f"{path} is too large to send to the executors")
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, file)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[k] for k in range(len(ranks))]


def _coder(value, pattern: str):
    """(encoder, decimal strings by id, bytes by id), once in a worker."""
    vocabulary = value.value
    key = hashlib.sha256(b"\0".join(vocabulary) + pattern.encode()).hexdigest()
    if key not in _LOADED:
        ranks = {b: k for k, b in enumerate(vocabulary)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _LOADED.clear()
        _LOADED[key] = encoding, [str(k) for k in range(len(vocabulary))], vocabulary
    return _LOADED[key]


def boundary_finder(pattern: str):
    """Positions where a pre-token of ``pattern`` ends, not in white space.  White space is the Unicode property, as for the encoder."""
    split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    # a piece that ends in white space would match it otherwise than the text that goes on
    return lambda text: [m.end() for m in split.finditer(text) if not text[m.end() - 1].isspace()]


def _chunks(text: str, ends, chunk: int, overlap: int):
    """(number, start, chunk text, early boundaries, late boundaries)."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    for k in range(n):
        start = k * chunk
        stop = len(text) if k == n - 1 else start + chunk + overlap
        part = text[start:stop]
        found = ends(part)
        head = found if k else []
        late = [] if k == n - 1 else [start + e for e in found if chunk <= e <= len(part) - LOOKAHEAD]
        yield k, start, part, [start + e for e in head if e <= overlap], late


_FIRST = "key long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, chunk_no int, start long, part string, head array<long>, tail array<long>"


def _digest(ids, numbers, vocabulary) -> tuple[int, str, str]:
    decimal = " ".join(map(numbers.__getitem__, ids)).encode()
    raw = b"".join(map(vocabulary.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(raw).hexdigest()


def _first_pass(value, pattern, chunk, overlap):
    def run(batches):
        coder, numbers, vocabulary = _coder(value, pattern)
        ends = boundary_finder(pattern)
        key = TaskContext.get().partitionId() << 33
        schema = None
        for batch in batches:
            names = [c.split()[0] for c in _FIRST.split(", ")]
            schema = schema or pa.schema(list(zip(names, [
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(),
                pa.list_(pa.int64()), pa.list_(pa.int64())])))
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, key = text.as_py() or "", key + 1
                if len(text) <= chunk:
                    rows.append((key, doc_id, *_digest(coder.encode_ordinary(text), numbers, vocabulary), None, None, None, None, None))
                    continue
                for k, start, part, head, tail in _chunks(text, ends, chunk, overlap):
                    rows.append((key, doc_id, None, None, None, k, start, part, head, tail))
                    held += len(part)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
    return run


def _encode(value, pattern):
    def run(batches):
        coder, _, _ = _coder(value, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = coder.encode_ordinary(batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([ids], pa.list_(pa.int32()))],
                    ["key", "run", "ids"])
    return run


def _finish(value, pattern):
    def run(batches):
        _, numbers, vocabulary = _coder(value, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = [x for part in batch.column(2)[k].as_py() for x in part["ids"]]
                n, a, b = _digest(ids, numbers, vocabulary)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(1).slice(k, 1), "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})
    return run


def _pieces(rows: DataFrame) -> DataFrame:
    """(key, doc_id, run, piece): stitched pieces of the long texts."""
    w = Window.partitionBy("key").orderBy("chunk_no")
    cut = F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))
    rows = rows.withColumn("cut", F.when(F.col("chunk_no") == 0, F.lit(0)).otherwise(cut))
    # the first chunk that shares no boundary, and all behind it, join the chunk before
    failed = F.min(F.when(F.col("cut").isNull(), F.col("chunk_no"))).over(w)
    rows = rows.withColumn("failed", failed)
    rows = rows.withColumn("run", F.coalesce(F.col("failed") - 1, "chunk_no"))
    rows = rows.withColumn("lo", F.when(F.col("failed").isNull(), F.col("cut")).otherwise(F.col("start")))
    rows = rows.withColumn("hi", F.lead("lo").over(w))
    piece = F.expr("substring(part, CAST(lo - start + 1 AS INT), CAST(coalesce(hi, lo + char_length(part)) - lo AS INT))")
    rows = rows.select("key", "doc_id", "run", "chunk_no", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("key", "doc_id", "run").agg(joined.alias("piece"))


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, *, id_col="doc_id", text_col="text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids) of every row: the token ids as ``array<int>``; null is as empty."""
    value = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        ends = boundary_finder(pattern)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key += 1
                for k, start, part, head, tail in _chunks(text.as_py() or "", ends, chunk, overlap):
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "doc_id": pa.array([doc_id], pa.int64()), "chunk_no": pa.array([k], pa.int32()), "start": [start],
                        "part": [part], "head": pa.array([head], pa.list_(pa.int64())), "tail": pa.array([tail], pa.list_(pa.int64()))})

    rows = settle(first.mapInArrow(cut, "key long, doc_id long, chunk_no int, start long, part string, head array<long>, tail array<long>"))
    pieces = settle(_pieces(rows))
    ids = pieces.select("key", "run", "piece").mapInArrow(_encode(value, pattern), "key long, run int, ids array<int>")
    ids = ids.join(pieces.select("key", "run", "doc_id"), ["key", "run"])
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"]))
    return ids.groupBy("key", "doc_id").agg(whole.alias("ids")).select("doc_id", "ids")


def decode_documents(rows: DataFrame, ranks: str, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, bytes) of rows of token ids; null ids give null."""
    value = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        vocabulary = value.value
        for batch in batches:
            raw = [None if x is None else b"".join(map(vocabulary.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def token_digests(
    docs: DataFrame, ranks: str, pattern: str, *, id_col="doc_id", text_col="text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    Texts of one chunk are encoded where they are read; only longer ones are
    cut, stitched and put together again.  A null text is as an empty one: no
    tokens, digests of nothing.  Repeated and null ids keep a row each; other
    columns are not read; an empty table gives no rows.
    """
    value = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = settle(first.mapInArrow(_first_pass(value, pattern, chunk, overlap), _FIRST))
    short = first.where("chunk_no IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    pieces = _pieces(first.where("chunk_no IS NOT NULL").select("key", "doc_id", "chunk_no", "start", "part", "head", "tail"))
    names = pieces.select("key", "run", "piece")
    ids = names.mapInArrow(_encode(value, pattern), "key long, run int, ids array<int>")
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("parts"))
    owners = first.where("chunk_no = 0").select("key", "doc_id")
    ids = ids.join(owners, "key").select("key", "doc_id", "parts")
    long = ids.mapInArrow(_finish(value, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return short.unionByName(long)
