"""Motif scanning: weight matrices slid along sequences, best scores per bin.

Sequences are cut into chunk rows that carry enough flanking bases for every
bin they own, so scanning, windowing and top-k all happen inside one task and
no score is ever shuffled.  A library of matrices is dealt into groups, and a
task scans one chunk with one group at a time, so memory does not grow with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.prefix import bucketed_prefix, join_values, position_bucket, value_index
from bindscape.functions.session import broadcast_if_small, settle, spread
from bindscape.operators.signal import offset_features

MOTIF_GROUP = 32  # matrices of a work item
BROADCAST_BYTES = 64 << 20  # of all matrices; a larger library is joined by group


def encode(seq):
    """Upper-case, N and other unknown bases to A, bases to digits 0-3."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")


def complement_code(code):
    return F.translate(code, "0123", "3210")


def one_hot(code):
    """Digit string to one 0/1 array of four per base."""
    return F.transform(
        F.split(code, "(?!$)"), lambda c: F.array(*[(c == str(b)).cast("int") for b in range(4)])
    )


def pad_pwms(pwms: DataFrame) -> DataFrame:
    """Matrices centred to the longest length: ``motif, pos, a, c, g, t`` with
    int(pad/2) positions in front; padded positions score 0 and have no row."""
    length = pwms.groupBy("motif").agg(F.count(F.lit(1)).alias("len"))
    longest = length.agg(F.max("len")).scalar()
    return pwms.join(length, "motif").select(
        "motif", (F.col("pos") + F.floor((longest - F.col("len")) / 2)).cast("int").alias("pos"), "a", "c", "g", "t"
    )


def longest_matrix(pwms: DataFrame) -> int:
    """Positions of the longest matrix; 1 without matrices."""
    return pwms.groupBy("motif").count().agg(F.max("count")).first()[0] or 1


def motif_groups(pwms: DataFrame, length: int, *, motifs: DataFrame | None = None, size: int = MOTIF_GROUP) -> DataFrame:
    """``grp, names, weights``: padded matrices, ``size`` to a row in order of name;
    ``weights`` is motif-major, then position, then base.  With ``motifs`` of these only,
    padded like the whole library."""
    padded = pad_pwms(pwms)
    if motifs is not None:
        padded = padded.join(broadcast_if_small(motifs.select("motif").distinct()), "motif", "left_semi")
    cells = F.map_from_entries(F.collect_list(F.struct("pos", F.array(*[F.col(b).cast("float") for b in "acgt"]))))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 4)
    at = F.sequence(F.lit(0), F.lit(length - 1))
    dense = settle(padded.groupBy("motif").agg(cells.alias("cells")).select(
        "motif", F.flatten(F.transform(at, lambda p: F.coalesce(F.try_element_at("cells", p.cast("int")), zeros))).alias("weights")))
    ranked = value_index(dense.select("motif"), [], "motif", [], name="r")
    grouped = dense.join(ranked, "motif").groupBy(F.floor((F.col("r") - 1) / size).alias("grp"))
    rows = grouped.agg(F.array_sort(F.collect_list(F.struct("motif", "weights"))).alias("m"))
    return rows.select("grp", F.col("m.motif").alias("names"), F.flatten("m.weights").alias("weights"))


def _work_items(chunks: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """Every chunk with every group of matrices: what a task holds of the library is one group."""
    groups = settle(groups)
    n = groups.count()
    if n * MOTIF_GROUP * length * 16 <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    return chunks.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint")))).join(groups, "grp")


def chunk_sequences(seqs: DataFrame, *, size: int, before: int, after: int) -> DataFrame:
    """Rows ``chrom, length, chunk_start, seq, lead``: ``size`` bases owned per
    row plus ``before``/``after`` flanking bases (``lead`` of them in front).

    ``seqs`` holds whole sequences (``chrom, seq``) or the lines of files
    (:func:`bindscape.sources.readers.read_fasta_lines`)."""
    if "line" in seqs.columns:
        return _chunk_lines(seqs, size, before, after)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    cut = seqs.select("chrom", F.length("seq").alias("length"), "seq", starts.alias("chunk_start"))
    lead = F.least(F.col("chunk_start"), F.lit(before))
    pieces = cut.select(
        "chrom", "length", "chunk_start", lead.alias("lead"),
        F.substring("seq", F.col("chunk_start") - lead + 1, lead + F.lit(size + after)).alias("seq"),
    )
    return spread(pieces, "chrom", "chunk_start")


def line_offsets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered lines, records) of FASTA lines ``file, block, line_no, line``.

    Record number and bases up to a line are running sums inside a file block plus the
    carry of the blocks before, so no task sees more than a block.  Numbered lines:
    ``file, record, line_no, body, bases, upto``; records: ``file, record, chrom, length,
    origin, lines``.  Lines before the first header belong to no record.
    """
    head = F.col("line").startswith(">")
    rows = lines.select(
        "file", "block", "line_no", head.cast("bigint").alias("head"),
        F.when(head, F.element_at(F.split(F.trim(F.expr("substring(line, 2)")), r"\s+"), 1)).alias("name"),
        F.when(head, F.lit("")).otherwise(F.regexp_replace("line", r"\s", "")).alias("body"),
    ).withColumn("bases", F.length("body").cast("bigint"))
    numbered = bucketed_prefix(rows, ["file"], ["line_no"], F.col("block"), sums={"record": "head", "upto": "bases"})
    numbered = settle(numbered.where("record > 0"))
    records = numbered.groupBy("file", "record").agg(
        F.max("name").alias("chrom"), F.sum("bases").alias("length"), F.max(F.when(F.col("head") == 1, F.col("upto"))).alias("origin"),
        F.count(F.lit(1)).alias("lines"))
    return numbered.select("file", "record", "line_no", "body", "bases", "upto"), settle(records)


def _chunk_lines(lines: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Chunk rows from lines: a line gives its piece to each chunk that it reaches."""
    numbered, records = line_offsets(lines)
    placed = join_values(
        numbered.where("bases > 0"), records, ["file", "record"], ["chrom", "length", "origin"], weight="lines", spread=["line_no"])
    placed = placed.withColumn("at", F.col("upto") - F.col("bases") - F.col("origin")).withColumn("end", F.col("at") + F.col("bases"))
    first = F.greatest(F.floor((F.col("at") - size - after) / size) + 1, F.lit(0).cast("bigint"))
    last = F.least(F.floor((F.col("end") - 1 + before) / size), F.floor((F.col("length") - 1) / size))
    reached = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("chunk") * size - before, F.col("at"))
    high = F.least(F.col("chunk") * size + size + after, F.col("end"))
    pieces = reached.select(
        "file", "record", "chunk", "chrom", "length", "at",
        F.substring("body", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    keys = ["file", "record", "chunk"]
    joined = spread(pieces, *keys).groupBy(*keys).agg(
        F.first("chrom").alias("chrom"), F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    start = F.col("chunk") * size
    out = joined.select(
        "chrom", F.col("length").cast("int").alias("length"), start.cast("int").alias("chunk_start"),
        F.least(start, F.lit(before)).cast("int").alias("lead"), F.array_join("p.piece", "").alias("seq"))
    zero = F.lit(0)
    empty = records.where("length = 0").select("chrom", zero.alias("length"), zero.alias("chunk_start"), zero.alias("lead"), F.lit("").alias("seq"))
    return out.unionByName(empty)


# fixed values: base letters in code order
_CODE = np.zeros(256, dtype=np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def strand_scores(codes: np.ndarray, pwms: np.ndarray, reverse: bool) -> np.ndarray:
    """(motif, position) scores; ``codes`` are 0-3, one score per full window."""
    n = len(codes) - pwms.shape[1] + 1
    if n <= 0:
        return np.zeros((pwms.shape[0], 0), dtype=np.float32)
    mats = pwms[:, ::-1, :] if reverse else pwms
    out = np.zeros((pwms.shape[0], n), dtype=np.float32)
    for j in range(pwms.shape[1]):
        out += mats[:, j, :][:, codes[j : j + n]]
    return out


def _codes(pdf_row, flank: int, reverse: bool) -> np.ndarray:
    """Codes of a chunk, with code 0 before the sequence start."""
    raw = _CODE[np.frombuffer(pdf_row.seq.encode("latin-1", "replace"), dtype=np.uint8)]
    if reverse:
        raw = 3 - raw
    missing = max(flank - pdf_row.lead, 0)
    return np.concatenate([np.zeros(missing, dtype=np.int8), raw]).astype(np.intp)


def _work_rows(batch: pa.RecordBatch) -> Iterator[SimpleNamespace]:
    """The work items of an Arrow batch that have a sequence; one text is taken out at a time."""
    for i in range(batch.num_rows):
        if batch["length"][i].is_valid:
            row = {c: batch[c][i].as_py() for c in ("chrom", "length", "chunk_start", "lead", "seq")}
            yield SimpleNamespace(**row, names=batch["names"][i].as_py(), weights=batch["weights"][i].values.to_numpy(zero_copy_only=False))


class _Rows:
    """Gathers output pieces into Arrow batches of a reasonable size."""

    def __init__(self, schema: pa.Schema, limit: int = 100_000) -> None:
        self.schema, self.limit, self.parts, self.n = schema, limit, [], 0

    def add(self, n: int, *values) -> Iterator[pa.RecordBatch]:
        if n:
            self.parts.append((n, values))
            self.n += n
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        sizes = [n for n, _ in self.parts]
        columns = []
        for i, one in enumerate(self.schema):
            pieces = [v[i] for _, v in self.parts]
            if not isinstance(pieces[0], np.ndarray):
                columns.append(pa.array(pieces, one.type).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
            elif pieces[0].ndim > 1:
                ends = np.arange(self.n + 1, dtype=np.int32) * np.int32(pieces[0].shape[1])
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).ravel())))
            else:
                columns.append(pa.array(np.concatenate(pieces), one.type))
        self.parts, self.n = [], 0
        yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def pwm_scan(seqs: DataFrame, pwms: DataFrame, *, strand: str = "+", chunk: int = 100_000) -> DataFrame:
    """``chrom, motif, pos, score`` for every position whose window ends inside
    the sequence; the window of ``pos`` starts half a matrix before it.

    A task gives the scores of a motif on a chunk as one array, which Spark makes into rows."""
    length = longest_matrix(pwms)
    flank = length // 2
    reverse = strand == "-"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _work_rows(batch):
                n = min(chunk, row.length - length + 1 - row.chunk_start)
                if n <= 0:
                    continue
                mats = row.weights.reshape(len(row.names), length, 4)
                scores = strand_scores(_codes(row, flank, reverse), mats, reverse)[:, :n]
                n = scores.shape[1]
                ends = pa.array(np.arange(len(row.names) + 1, dtype=np.int32) * np.int32(n))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.chrom] * len(row.names), pa.string()), pa.array(row.names, pa.string()),
                    pa.array([row.chunk_start] * len(row.names), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(scores.ravel())),
                ], names=["chrom", "motif", "at", "scores"])

    chunks = chunk_sequences(seqs, size=chunk, before=flank, after=length)
    scored = _work_items(chunks, motif_groups(pwms, length), length).mapInArrow(scan, "chrom string, motif string, at bigint, scores array<float>")
    rows = scored.select("chrom", "motif", "at", F.posexplode("scores").alias("i", "s"))
    return rows.select("chrom", "motif", (F.col("at") + F.col("i")).alias("pos"), F.col("s").cast("double").alias("score"))


def window_best(scores: np.ndarray, bins: int, width: int, step: int, count: int) -> np.ndarray:
    """(motif, bin, count) largest scores of the windows of ``width`` at every ``step``.

    Windows share the largest scores of the pieces they are made of.
    """
    piece = math.gcd(width, step)
    if piece > count:
        pieces = ((bins - 1) * step + width) // piece
        scores = np.partition(scores[:, : pieces * piece].reshape(len(scores), pieces, piece), piece - count, axis=2)[:, :, piece - count :]
        windows = np.lib.stride_tricks.sliding_window_view(scores, width // piece, axis=1)[:, :: step // piece]
        windows = windows[:, :bins].reshape(len(scores), bins, -1)
    else:
        windows = np.lib.stride_tricks.sliding_window_view(scores, width, axis=1)[:, : (bins - 1) * step + 1 : step]
    last = windows.shape[2]
    return np.partition(windows, last - count, axis=2)[:, :, last - count :]


def motif_top_scores(
    seqs: DataFrame, pwms: DataFrame, *, motifs: DataFrame | None = None, width: int = 200, step: int = 50, per_strand: int = 3,
    k: int = 4, chunk_bins: int = 2000,
) -> DataFrame:
    """Best ``k`` of the ``per_strand`` best scores of each strand in every bin.

    With ``motifs`` only these are scanned, padded like the whole library.
    Returns ``motif, chrom, start, top``; a sequence has
    floor((L - width)/step) + 1 bins, and bins whose score window runs past
    the last score hold zeros.
    """
    length = longest_matrix(pwms)
    flank = length // 2
    size = chunk_bins * step
    schema = pa.schema([("motif", pa.string()), ("chrom", pa.string()), ("start", pa.int64()), ("top", pa.list_(pa.float32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in batches:
            for row in _work_rows(batch):
                if row.length < width:
                    continue
                total = (row.length - width) // step + 1
                owned = min(chunk_bins, total - row.chunk_start // step)
                if owned <= 0:
                    continue
                n_scores = row.length - length + 1 - row.chunk_start
                scored = min(owned, (n_scores - width) // step + 1) if n_scores >= width else 0
                top = np.zeros((len(row.names), owned, k), dtype=np.float32)
                mats = row.weights.reshape(len(row.names), length, 4)
                if scored > 0:
                    both = [
                        window_best(strand_scores(_codes(row, flank, rev), mats, rev), scored, width, step, per_strand)
                        for rev in (False, True)
                    ]
                    pool = np.sort(np.concatenate(both, axis=2), axis=2)[:, :, ::-1]
                    top[:, :scored] = pool[:, :, :k]
                start = row.chunk_start + step * np.arange(owned)
                for i, motif in enumerate(row.names):
                    yield from out.add(owned, motif, row.chrom, start, top[i])
        yield from out.flush()

    chunks = chunk_sequences(seqs, size=size, before=flank, after=width + length)
    return _work_items(chunks, motif_groups(pwms, length, motifs=motifs), length).mapInArrow(
        scan, "motif string, chrom string, start bigint, top array<float>")


def motif_features(
    top_scores: DataFrame, motifs: DataFrame, *, offsets: Sequence[int] = (-7, -5, -3, -1, 0, 1, 3, 5, 7), step: int = 50, block: int = 4096
) -> DataFrame:
    """Feature array per bin: offset-major, then motif name, then top rank.

    A motif without a row for a bin has zeros there, so every motif keeps its
    columns."""
    names = motifs.select("motif").distinct()
    kept = settle(top_scores.join(broadcast_if_small(names), "motif", "left_semi"))
    order = names.agg(F.array_sort(F.collect_list("motif"))).scalar()
    width = kept.agg(F.coalesce(F.max(F.size("top")), F.lit(0))).first()[0]
    zeros = F.array_repeat(F.lit(0.0), width)
    wide = kept.groupBy("chrom", "start").agg(F.map_from_entries(F.collect_list(F.struct("motif", "top"))).alias("__by_motif"))
    wide = wide.withColumn("__order", order).select(
        "chrom", "start",
        F.flatten(F.transform("__order", lambda m: F.coalesce(F.try_element_at("__by_motif", m), zeros.cast(kept.schema["top"].dataType)))).alias("features"),
    )
    return offset_features(wide, offsets, step=step, block=block)


def motif_feature_names(motifs: DataFrame, *, offsets: Sequence[int] = (-7, -5, -3, -1, 0, 1, 3, 5, 7), k: int = 4) -> DataFrame:
    """``feature_idx, feature_name`` of :func:`motif_features`."""
    from pyspark.sql import Window

    ranked = motifs.select("motif").distinct().withColumn("m", F.row_number().over(Window.orderBy("motif")) - 1)
    n = ranked.agg(F.count(F.lit(1))).scalar()
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(offsets)]))
    tops = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    named = ranked.withColumn("n", n).withColumn("s", spots).withColumn("top", tops)
    return named.select(
        ((F.col("s.i") * F.col("n") + F.col("m")) * k + F.col("top")).cast("int").alias("feature_idx"),
        F.format_string("%s_offset_%d_top_%d", "motif", "s.o", "top").alias("feature_name"),
    )


def drop_denovo(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(~F.col(name).startswith("denovo"))


def cluster_representatives(scan_rows: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Per scan, the first named motif of each cluster; with ``limit`` of the first
    ``limit`` clusters only.

    ``scan_rows``: ``scan, row_no, is_top, name``; a cluster runs from one top
    row to the next.  The last cluster ends with the table.
    """
    rows = settle(scan_rows.select("scan", "row_no", "name", F.col("is_top").cast("bigint").alias("top")))
    bucket = position_bucket(rows, ["scan"], "row_no")
    named = bucketed_prefix(rows, ["scan"], ["row_no"], bucket, sums={"cluster_no": "top"}).where("cluster_no > 0")
    first = settle(drop_denovo(named).groupBy("scan", "cluster_no").agg(F.min_by("name", "row_no").alias("name")))
    if limit is None:
        return first
    ranked = value_index(first, ["scan"], "cluster_no", [], name="r")
    return ranked.where(F.col("r") <= limit).select("scan", "cluster_no", "name")


def choose_cofactors(scan_rows: DataFrame, zscores: DataFrame, *, n: int = 10, limit: int | None = None) -> DataFrame:
    """Motifs ranked over all scans by robust aggregation of -z; keeps rank <= n.

    ``zscores``: ``scan, name, zscore``; a motif a scan did not score counts 0.
    """
    from bindscape.operators.rankagg import robust, to_ranks

    chosen = cluster_representatives(scan_rows, limit=limit).select("name").distinct()
    scans = scan_rows.select("scan").distinct().agg(F.collect_list("scan")).scalar()
    full = chosen.select("name", F.explode(scans).alias("scan"))
    scored = full.join(zscores, ["scan", "name"], "left").select(
        F.col("scan").alias("expert"), F.col("name").alias("item"),
        F.coalesce(-F.col("zscore"), F.lit(0.0)).alias("score"),
    )
    return robust(to_ranks(scored)).where(F.col("rank") <= n)
