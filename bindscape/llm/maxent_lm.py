"""Hashed maximum-entropy language model with a class-factored softmax.

    P(word | before) = P(class of word | before) * P(word | class)

The first factor is a softmax over classes of hashed features of the words
before: the last word, the last two and, skipping one, the word before it.  The
second has no features but the word itself, so its softmax is the smoothed
relative frequency of the word in its class.  The most frequent words and the end
of a text are classes of their own; the others fall into classes by their last
two bytes.

Every task starts from the shared weights, takes gradient steps over its texts in
batches, and hands on its rows with the number of steps each took; rows are
averaged by these numbers up a tree.  Word counts are a Spark aggregation over all
training texts.  Scoring looks up frequent words in a table that travels with the
tasks; the others are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import settle
from bindscape.llm.words import Words, list_array, ragged, slices

TOP_WORDS = 15  # classes of one word
TAIL_CLASSES = 32
CLASSES = 1 + TOP_WORDS + TAIL_CLASSES
TABLE_BITS = 16
STEP_TOKENS = 4096
SHORT_RUN = 8  # uses of a row of weights in a step that are added up one by one
MOVED_ROWS = 512  # rows of weights moved at a time
RATE = 1.0
ROUNDS = 1
FREQUENT = 1 << 17  # words whose counts travel with the tasks
MERGE = 16  # task results merged at a time
PARTS = 16  # row ranges of the weights that are merged apart
FLUSH_WORDS = 1 << 20
TASK_TOKENS = 4_000_000  # training tokens of a task, about; its result is as large as the weights
END = np.uint64(0x6A09E667F3BCC909)  # stands for the end of a text
START = np.uint64(0xBB67AE8584CAA73B)
_MULTIPLIERS = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1, 2**63, 4, dtype=np.uint64)]


class Tokens:
    """Tokens of a run of texts, one end after each: hashes, text, tail class."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        n = len(words.start) + words.n_texts
        place = np.arange(len(words.start)) + words.text
        self.h = np.full(n, END)
        self.h[place] = words.hashes()
        self.bounds = words.bounds + np.arange(words.n_texts + 1)
        self.text = np.repeat(np.arange(words.n_texts), np.diff(self.bounds))
        low = lambda b: np.where((b > 64) & (b < 91), b + 32, b).astype(np.uint32)
        last = low(data[words.end - 1]) if len(words.start) else np.zeros(0, np.uint32)
        before = np.where(words.end - words.start > 1, low(data[np.maximum(words.end - 2, 0)]), 0) if len(words.start) else last
        self.tail = np.zeros(n, np.int64)
        self.tail[place] = ((last * np.uint32(256) + before.astype(np.uint32)) * np.uint32(2654435761)) >> np.uint32(27)
        self.is_end = np.ones(n, bool)
        self.is_end[place] = False

    def features(self) -> np.ndarray:
        """Rows of the weight table, (3, tokens)."""
        shift = np.uint64(64 - TABLE_BITS)
        age = np.arange(len(self.h)) - self.bounds[self.text]
        one, two = np.full(len(self.h), START), np.full(len(self.h), START)
        one[1:] = np.where(age[1:] > 0, self.h[:-1], START)
        two[2:] = np.where(age[2:] > 1, self.h[:-2], START)
        a, b, c, d = _MULTIPLIERS
        return np.stack([one * a >> shift, (one * b + two * c) >> shift, (two * d + c) >> shift]).astype(np.int64)

    def classes(self, top: np.ndarray) -> np.ndarray:
        out = self.tail + 1 + TOP_WORDS
        out[self.is_end] = 0
        if len(top):
            at = np.minimum(np.searchsorted(top, self.h), len(top) - 1)
            hit = (top[at] == self.h) & ~self.is_end
            out[hit] = 1 + at[hit]
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _row_sums(x: np.ndarray, order: np.ndarray, at: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x[order]`` that start at ``at`` and have ``uses`` rows.

    Most runs are short: these are added up a row at a time over all runs, in the order of
    ``np.add.reduceat``, whose cost is by run and column; it sums the few long ones.
    """
    sums = x[order[at]]
    short = np.flatnonzero((uses > 1) & (uses <= SHORT_RUN))
    if len(short):
        rest, left = x[order[at[short] + 1]], np.arange(len(short))
        for k in range(2, SHORT_RUN):
            left = left[uses[short[left]] > k]
            rest[left] += x[order[at[short[left]] + k]]
        sums[short] += rest
    long = np.flatnonzero(uses > SHORT_RUN)
    if len(long):
        ends = np.cumsum(uses[long])
        sums[long] = np.add.reduceat(x[order[np.repeat(at[long], uses[long]) + ragged(uses[long])]], ends - uses[long], axis=0)
    return sums


class Weights:
    def __init__(self, table: np.ndarray, bias: np.ndarray):
        self.table, self.bias = table, bias

    def log_classes(self, f: np.ndarray) -> np.ndarray:
        x = self.table[f[0]]
        x += self.table[f[1]]
        x += self.table[f[2]]
        x += self.bias
        return _log_softmax(x)

    def step(self, f: np.ndarray, target: np.ndarray, taken: np.ndarray) -> None:
        """One gradient step; ``taken`` counts the steps of each row."""
        grad = self.log_classes(f)
        np.exp(grad, out=grad)
        grad[np.arange(len(target)), target] -= 1
        flat = f.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # radix sort
        rows = flat[order]
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rows = rows[at]
        uses = np.diff(np.r_[at, len(flat)])
        sums = _row_sums(grad, order % len(target), at, uses)
        taken[rows] += 1
        # a row that is used once moves less than one with a firm mean
        rate = RATE / np.sqrt(taken[rows]) * np.sqrt(uses / (uses + 4.0))
        for lo in range(0, len(rows), MOVED_ROWS):
            some = slice(lo, lo + MOVED_ROWS)
            move = sums[some] * rate[some, None]
            move /= uses[some, None]
            self.table[rows[some]] -= move.astype(np.float32)


def _count_words(batches):
    def flush(h, tail, n):
        order = np.argsort(h)
        h, tail, n = h[order], tail[order], n[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        return h[at], tail[at], np.add.reduceat(n, at) if len(at) else n

    def out(h, tail, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], ["h", "tail", "c"])

    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            t = Tokens(data, offsets)
            held.append(flush(t.h, np.where(t.is_end, -1, t.tail), np.ones(len(t.h), np.int64)))
            size += len(held[-1][0])
            if size > FLUSH_WORDS:
                held = [flush(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > FLUSH_WORDS // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*flush(*(np.concatenate(x) for x in zip(*held))))


def _train(value, top_value):
    def run(batches):
        start = value.value
        weights = Weights(start.table.copy(), start.bias)
        taken = np.zeros(len(weights.table), np.int64)
        top = top_value.value
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                t = Tokens(data, offsets)
                f, target = t.features(), t.classes(top)
                for lo in range(0, len(target), STEP_TOKENS):
                    weights.step(f[:, lo: lo + STEP_TOKENS], target[lo: lo + STEP_TOKENS], taken)
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(np.array_split(np.arange(len(taken)), PARTS)):
            used = rows[taken[rows] > 0]
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([used.astype(np.int32).tobytes()]),
                     pa.array([taken[used].tobytes()]), pa.array([weights.table[used].tobytes()])],
                    ["part", "task", "rows", "taken", "values"])
    return run


_RESULT = "part int, task long, rows binary, taken binary, values binary"


def _merge(key, frame: pd.DataFrame) -> pd.DataFrame:
    low, high = 1 << TABLE_BITS, 0
    sums, taken = np.zeros((1 << TABLE_BITS, 0)), None
    unpacked = []
    for r in frame.itertuples():
        rows = np.frombuffer(r.rows, np.int32)
        unpacked.append((rows, np.frombuffer(r.taken, np.int64), np.frombuffer(r.values, np.float32).reshape(len(rows), -1)))
        low, high = min(low, rows[0]), max(high, rows[-1] + 1)
    sums, taken = np.zeros((high - low, CLASSES)), np.zeros(high - low, np.int64)
    for rows, n, x in unpacked:
        sums[rows - low] += x * n[:, None]
        taken[rows - low] += n
    used = np.flatnonzero(taken)
    mean = (sums[used] / taken[used][:, None]).astype(np.float32)
    return pd.DataFrame({"part": [key[0]], "task": [key[1]], "rows": [(used + low).astype(np.int32).tobytes()],
                         "taken": [taken[used].tobytes()], "values": [mean.tobytes()]})


def _averaged(results: DataFrame, tasks: int) -> pd.DataFrame:
    """One result of each part: merged MERGE at a time, up a tree."""
    while True:
        results = results.groupBy("part", F.expr(f"task div {MERGE}").alias("task")).applyInPandas(_merge, _RESULT)
        tasks = -(-tasks // MERGE)
        if tasks <= 1:
            return results.toPandas()


class LanguageModel:
    def __init__(self, weights, top, counts, total, distinct, log_mass):
        self.weights, self.top, self.counts = weights, top, counts
        self.total, self.distinct, self.log_mass = total, distinct, log_mass


def fit(texts: DataFrame, *, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on all rows of ``texts`` (one column; null counts as empty)."""
    spark = texts.sparkSession
    words = texts.mapInArrow(_count_words, "h long, tail int, c long")
    counts = settle(words.groupBy("h").agg(F.sum("c").alias("c"), F.first("tail").alias("tail")))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.where("tail >= 0").orderBy(F.desc("c"), "h").limit(TOP_WORDS).toPandas()
    top_hashes = np.sort(top["h"].to_numpy(np.int64).view(np.uint64))
    is_top = F.col("h").isin([int(x) for x in top["h"]]) if len(top) else F.lit(False)
    single = np.zeros(CLASSES)
    # class sizes: counts, one for each word, one for all unknown words
    mass = counts.where((F.col("tail") >= 0) & ~is_top).groupBy("tail").agg((F.sum("c") + F.count("*")).alias("m")).toPandas()
    sizes = np.ones(TAIL_CLASSES)
    sizes[mass["tail"].to_numpy(np.int64)] += mass["m"].to_numpy(np.float64)
    log_mass = np.log10(sizes)
    by_hash = dict(zip(top["h"].to_numpy(np.int64).view(np.uint64).tolist(), top["c"].tolist()))
    single[1 + TOP_WORDS:] = sizes
    for k, h in enumerate(top_hashes.tolist()):
        single[1 + k] = by_hash[h]
    single[0] = max(1.0, counts.where("tail < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    single = np.maximum(single, 1e-3)
    weights = Weights(np.zeros((1 << TABLE_BITS, CLASSES), np.float32), np.log(single / single.sum()).astype(np.float32))
    top_value = spark.sparkContext.broadcast(top_hashes)
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_TOKENS))
    texts = texts.coalesce(tasks)
    for _ in range(rounds):
        value = spark.sparkContext.broadcast(weights)
        results = settle(texts.mapInArrow(_train(value, top_value), _RESULT))
        table = weights.table.copy()
        for r in _averaged(results, tasks).itertuples():
            rows = np.frombuffer(r.rows, np.int32)
            table[rows] = np.frombuffer(r.values, np.float32).reshape(len(rows), -1)
        weights = Weights(table, weights.bias)
    return LanguageModel(weights, top_hashes, counts, int(total or 0), int(distinct or 0), log_mass)


def _score(value):
    def run(batches):
        weights, top, log_mass, known, logs = value.value
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n = end - first
                t = Tokens(data, offsets)
                f, target = t.features(), t.classes(top)
                chance = np.empty(len(target))
                for lo in range(0, len(target), STEP_TOKENS):
                    some = slice(lo, lo + STEP_TOKENS)
                    chance[some] = weights.log_classes(f[:, some])[np.arange(len(target[some])), target[some]]
                in_tail = target > TOP_WORDS
                at = np.minimum(np.searchsorted(known, t.h), max(len(known) - 1, 0))
                hit = known[at] == t.h if len(known) else np.zeros(len(t.h), bool)
                log = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(t.h))
                norm = np.where(in_tail, log_mass[np.maximum(target - 1 - TOP_WORDS, 0)], 0.0)
                total = lambda x: np.bincount(t.text, weights=x, minlength=n)
                rare, rare_text = t.h[~hit], t.text[~hit]
                order = np.lexsort((rare, rare_text))
                rare, rare_text = rare[order], rare_text[order]
                cut = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_text[1:] != rare_text[:-1])][: len(rare)])
                per_text = np.bincount(rare_text[cut], minlength=n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(key, key + n)), batch.column(0).slice(first, n), batch.column(2).slice(first, n),
                    pa.array(np.diff(t.bounds)), pa.array(total(hit).astype(np.int64)), pa.array(total(log)),
                    pa.array(total(chance) / np.log(10) + total(np.where(in_tail, log, 0.0)) - total(norm)),
                    list_array(rare[cut].view(np.int64), per_text), list_array(np.diff(np.r_[cut, len(rare)]), per_text)],
                    ["key", "doc_id", "held_out", "n_tokens", "hits", "log", "score", "rare", "times"])
                key += n
    return run


def score(docs: DataFrame, model: LanguageModel, *, id_col="doc_id", text_col="text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the model's log10 probability of the text with its end; unknown
    words share one smoothed count in their class.  ``base_score`` is the smoothed
    unigram's.  A null or empty text is its end alone.  Ids may repeat or be null;
    other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    frequent = model.counts.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "c").toPandas()
    known = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    logs = np.log10(frequent["c"].to_numpy(np.float64)[order] + 1)
    value = spark.sparkContext.broadcast((model.weights, model.top, model.log_mass, known[order], logs))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    rows = settle(rows.mapInArrow(_score(value), (
        "key long, doc_id long, held_out boolean, n_tokens long, hits long, log double, score double, rare array<long>, times array<long>")))
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rare = rare.join(model.counts.select("h", "c"), "h").groupBy("key").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_log"))
    rows = rows.drop("rare", "times").join(rare, "key", "left")
    more = F.coalesce("more_log", F.lit(0.0))
    base = F.col("log") + more - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + more).alias("score"))
