"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, documents one after the other, are a stream cut into
blocks of fixed length.  The mix is a row of slots, cut into output shards; a
slot holds one block.  Targets give each source its number of slots.  Source counts of
each shard are drawn: a random permutation of all slots deals them out, which is a multinomial
draw under the condition that the counts add up to the targets (so a source misses its
target by less than a block, not by chance).  Running sums of the counts number a
source's slots through, shard after shard; these numbers go through a random permutation of its
block indices, a new one for each pass over the source, and meet the blocks by index.

Permutations are computed from the index alone (swap or not: in each round an
index changes place with its mirror or stays, by one pseudorandom bit of the
pair), so nothing is sorted and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from bindscape.functions.session import broadcast_if_small, settle, spread, step_tables

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKET_ROWS = 4096  # documents of a bucket of the running sums
SLOT_CHUNK = 1 << 14
ROUNDS = 12
PRIME = 2147483647


def _hash(key: str, turn: str, x: str) -> str:
    """SQL of a number below PRIME from three non-negative numbers."""
    y = f"((({x}) % {PRIME}) * 48271 + (({x}) div {PRIME}) * 7919 + (({key}) % {PRIME}) * 69621 + ({turn}) * 16807 + 12345) % {PRIME}"
    return f"(({y}) * (({y}) + 1) % {PRIME} * 39373 + ({turn})) % {PRIME}"


def permuted(x: str, n: str, key: str, rounds: int = ROUNDS) -> Column:
    """Place of index ``x`` in a pseudorandom permutation of 0..n-1."""
    turn_key = f"({_hash(key, 'r', '7')}) * {PRIME} + ({_hash(key, 'r', '11')})"
    partner = f"(pmod({turn_key}, {n}) + {n} - acc) % {n}"
    bit = f"({_hash(key, 'r', 'greatest(acc, p)')}) div 65536 % 2"
    # the partner is bound once, as the only element of an array
    step = f"element_at(transform(array({partner}), p -> CASE WHEN {bit} = 1 THEN p ELSE acc END), 1)"
    return F.expr(f"aggregate(sequence(1L, {rounds}L), CAST({x} AS BIGINT), (acc, r) -> {step})")


def source_targets(rows: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_no, source_size, blocks, target, slots, first_slot).

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``max_passes`` times its source's size.
    The windows here run over the table of sources, one row each.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
    turn = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    s = s.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * max_passes)
    # those that reach their bound first come first
    by_bound = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    earlier = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    later = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(later))
    s = s.withColumn("bounded", F.col("most") * F.col("weights") < F.col("left") * F.col("weight"))
    # values at the first source that keeps below its bound
    free = F.when(~F.col("bounded"), F.struct("weights", "left"))
    s = s.withColumn("level", F.max(free).over(whole))
    share = F.col("level.left") * F.col("weight") / F.col("level.weights")
    s = s.withColumn("target", F.when(F.col("bounded"), F.col("most").cast("double")).otherwise(share.cast("double")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    fill = F.floor(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0)) + 0.5).cast("long")
    s = s.withColumn("slots", F.coalesce(F.least(fill, F.col("blocks") * max_passes), F.lit(0)).cast("long"))
    s = s.withColumn("first_slot", F.sum("slots").over(by_name) - F.col("slots"))
    s = s.withColumn("all_slots", F.sum("slots").over(whole))
    return s.select("source", "source_no", "source_size", "blocks", "target", "slots", "first_slot", "all_slots")


def shard_counts(targets: DataFrame) -> DataFrame:
    """(shard, source_no, n): the draw of how many slots of a shard each source gets.

    All slots are dealt out at random, which gives the counts of a multinomial draw under the
    condition that they add up to the targets' slots.
    """
    chunks = targets.where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_CHUNK})")))
    each = F.expr(f"explode(sequence(chunk * {SLOT_CHUNK}, least((chunk + 1) * {SLOT_CHUNK}, slots) - 1))")
    slots = spread(chunks).select("source_no", "first_slot", "all_slots", each.alias("i"))
    place = permuted("first_slot + i", "all_slots", "0")
    return slots.select((F.floor(place / SHARD_SLOTS)).cast("long").alias("shard"), "source_no").groupBy("shard", "source_no").agg(F.count("*").alias("n"))


def draw_slots(targets: DataFrame) -> DataFrame:
    """(shard, slot, source_no, pass, block): what each slot of the mix holds.

    A source's slots are numbered through, shard after shard by the drawn counts; the number gives the
    pass and, by a permutation of the source's blocks, the block.
    """
    counts = settle(shard_counts(targets))
    upto = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("source_no")
    ranges = counts.select(
        "shard", "source_no", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"),
        (F.sum("n").over(inside) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("shard")).alias("width"))
    ranges = ranges.join(broadcast_if_small(targets.select("source_no", "blocks")), "source_no")
    slots = ranges.select("shard", "source_no", "first", "ahead", "width", "blocks", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
    slots = spread(slots).withColumn("i", F.col("first") + F.col("k"))
    slots = slots.withColumn("slot", permuted("ahead + k", "width", "shard + 1"))
    slots = slots.withColumn("pass", F.expr("i div blocks"))
    # never null: a join by the block would ask for that, and the planner would draw every block once more before the rows are spread
    slots = slots.withColumn("block", F.coalesce(permuted("i % blocks", "blocks", f"source_no * {MAX_PASSES + 1} + pass + 1"), F.lit(0)))
    return slots.select("shard", "slot", "source_no", "pass", "block")


def _indexed(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with source_no, index in the source and first word; the sources' targets."""
    rows = settle(docs)
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.expr(f"pmod(doc_id, {PRIME}L) * 48271 % {PRIME} % {buckets}"))
    targets = settle(source_targets(rows))
    names = broadcast_if_small(targets.select(F.col("source").alias("name"), "source_no"))
    rows = rows.join(names, rows["source"].eqNullSafe(names["name"])).drop("name")
    order = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size")
    rows = rows.withColumn("up_to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("nth", F.row_number().over(order).cast("long"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    totals = totals.select(
        "source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    totals = totals.select(F.col("source_no").alias("s"), F.col("bucket").alias("k"), "words_before", "rows_before")
    rows = rows.join(totals, (rows["source_no"] == totals["s"]) & rows["bucket"].eqNullSafe(totals["k"]))
    rows = rows.select(
        "doc_id", "size", "source_no", *carry, (F.col("rows_before") + F.col("nth")).alias("row"),
        (F.col("words_before") + F.col("up_to") - F.col("size")).alias("at"))
    return settle(rows), targets


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str]) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words.cast("long").alias("size"),
        *[F.col(c).alias(f"kept_{c}") for c in carry])


def _pieces(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix: which words of which row each slot holds, rows by (source_no, row)."""
    b = BLOCK_WORDS
    parts = rows.where("size > 0").select(
        "source_no", "row", "at", "size", F.explode(F.expr(f"sequence(at div {b}, (at + size - 1) div {b})")).alias("block"))
    parts = parts.select(
        "source_no", "row", "block", F.expr(f"greatest(block * {b} - at, 0)").alias("first_word"),
        F.expr(f"least((block + 1) * {b}, at + size) - greatest(block * {b}, at)").alias("n_words"))
    # the planner sees only the few rows that slots are made from, and would broadcast them
    return draw_slots(targets).hint("merge").join(parts, ["source_no", "block"])


def mix_counts(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    ``size`` counts the words of the text (null: 0), ``taken`` those that the
    mix takes, repeats counted, at most three times ``size``.  A null source is
    a source; null and repeated ids keep a row each, equal rows may differ in
    ``taken``.  Other columns are not read.  An empty table gives no rows.
    """
    rows, targets = _indexed(_sized(docs, id_col, text_col, source_col, []), [])
    taken = _pieces(rows, targets).groupBy("shard", "source_no", "row").agg(F.sum("n_words").alias("words"))
    taken = taken.groupBy("source_no", "row").agg(F.sum("words").alias("words"))
    sources = broadcast_if_small(targets.select("source_no", "source_size", "target"))
    return rows.join(taken, ["source_no", "row"], "left").join(sources, "source_no").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed_shards(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(shard, slot, source_no, doc_id, first_word, n_words) of the whole mix, for
    a writer that partitions by shard."""
    rows, targets = _indexed(_sized(docs, id_col, text_col, source_col, []), [])
    pieces = _pieces(rows, targets).join(rows.select("source_no", "row", "doc_id"), ["source_no", "row"])
    return pieces.select("shard", "slot", "source_no", "doc_id", "first_word", "n_words")


def mix_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Rows of ``docs`` that the mix takes words of; the text becomes the words taken, each with
    the white space behind it, so what is taken as a whole stays as it is.  What a further
    pass over the source takes follows on a line of its own.  Other columns stay.

    ``docs`` is read twice instead of being copied, so it must give the same rows both times,
    in any order; settle it first where it may not."""
    key, check, pieces = (_unused(name, docs.columns) for name in ("mix_key", "mix_check", "mix_pieces"))
    keyed = _row_hashes(docs, (key, check))
    with step_tables(docs.sparkSession) as step:
        rows, targets = _indexed(_sized(keyed, id_col, text_col, source_col, [key, check]), [f"kept_{key}", f"kept_{check}"])
        taken = _pieces(rows, targets).groupBy("source_no", "row").agg(
            F.array_sort(F.collect_list(F.struct("pass", "first_word", "n_words"))).alias(pieces))
        names = [F.col(f"kept_{name}").alias(name) for name in (key, check)]
        taken = settle(taken.join(rows.select("source_no", "row", *names), ["source_no", "row"]).select(key, check, pieces))
        # the shuffle files of the sorting and the tables that it read are gone before texts are shuffled
        step.only(taken)
    # only the pieces, never the texts, went through the sorting above; of equal rows, one gives the text to the pieces of all
    out = keyed.dropDuplicates([key, check]).join(taken, [key, check])
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD}{SPACES}*)"))
    line = lambda i: F.when((i > 0) & (F.element_at(pieces, i + 1)["pass"] != F.element_at(pieces, F.greatest(i, F.lit(1)))["pass"]), "\n").otherwise("")
    piece = lambda w, p: F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")), "")
    # the words are bound once, as the only element of an array, and not split again for each piece
    text = F.transform(F.array(words), lambda w: F.array_join(F.transform(pieces, lambda p, i: F.concat(line(i), piece(w, p))), ""))
    return out.withColumn(text_col, F.element_at(text, 1)).select(*docs.columns)


def _row_hashes(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with 64-bit hashes of the whole row, which equal rows share."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)  # hashes skip nulls in them, or do not take them
    values = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, nested) else F.col(f.name) for f in docs.schema]
    nulls = F.array(*[F.col(c).isNull() for c in docs.columns])
    return docs.withColumns({name: F.xxhash64(F.lit(turn), nulls, *values) for turn, name in enumerate(names)})


def _unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
