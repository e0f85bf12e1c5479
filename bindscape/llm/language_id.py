"""Language identification of mixed texts: scripts, word scores, Viterbi spans.

The scripts of a word's letters narrow its candidate languages.  Each candidate
scores the word by the log probabilities of its byte trigrams and 4-grams (with
the spaces around).  A Viterbi path over the words, with a penalty for each change
of language, labels spans.  A text keeps the language of most of its words.

A path that never changes is the best one when no stretch of words prefers
another language by the penalty or more; this is looked up for all texts at once,
and only the others take the word-by-word recursion.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bindscape.functions.session import broadcast_if_small
from bindscape.llm.words import Words, slices

PICK_PARTS = 64  # pieces a language is ranked in before its texts are chosen
SAMPLE_TEXTS = 1500  # labelled texts of each language that the model is fitted on
TABLE_BITS = 15
SWITCH = 12.0  # log probability that a change of language costs
SCRIPT_SHARE = 0.01  # least share of a language's letters that a script must have
MAX_LANGUAGES = 1000
UNKNOWN = "und"

# fixed values: first code points of ranges and their scripts
SCRIPTS = [
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_BITS = np.array([1 << _NAMES.index(name) for _, name in SCRIPTS], np.int64)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(9, 14)]] = 32


def _letter_scripts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where letters begin, and the script bit of each."""
    plain = np.flatnonzero(_ASCII_LETTER[data])
    latin = np.full(len(plain), 1 << _NAMES.index("latin"), np.int64)
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return plain, latin
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    first = padded[lead]
    rest = [padded[lead + k] & 0x3F for k in (1, 2, 3)]
    code = np.where(
        first < 0xE0, (first & 0x1F) << 6 | rest[0],
        np.where(first < 0xF0, (first & 0x0F) << 12 | rest[0] << 6 | rest[1],
                 (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]))
    seen, which = np.unique(np.minimum(code, 0x10FFFF), return_inverse=True)
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in seen])
    bit = _BITS[np.maximum(np.searchsorted(_STARTS, seen, side="right") - 1, 0)]
    keep = letter[which]
    at = np.concatenate([plain, lead[keep]])
    bits = np.concatenate([latin, bit[which[keep]]])
    order = np.argsort(at, kind="stable")
    return at[order], bits[order]


class _Features:
    """Words of a run of texts with their n-gram places and scripts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        text = np.repeat(np.arange(words.n_texts), np.diff(offsets))
        # two spaces between texts: no n-gram of a word sees the next text
        p = np.full(len(data) + 2 * words.n_texts + 4, 32, np.uint32)
        p[np.arange(len(data)) + 2 * text + 1] = _FOLD[data]
        three = p[:-3] | p[1:-2] << np.uint32(8) | p[2:-1] << np.uint32(16)
        four = three | p[3:] << np.uint32(24)
        shift = np.uint32(32 - TABLE_BITS)
        self.three = (three * np.uint32(2654435761)) >> shift
        self.four = ((four * np.uint32(2246822519)) >> shift) + np.uint32(1 << TABLE_BITS)
        self.lo = words.start + 2 * words.text
        self.hi = words.end + 2 * words.text
        at, bits = _letter_scripts(data)
        self.letter_bits = bits
        word = np.searchsorted(words.start, at, side="right") - 1
        self.letter_word = word
        self.scripts = np.zeros(len(words.start), np.int64)
        if len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            self.scripts[word[first]] = np.bitwise_or.reduceat(bits, first)
        self.letters = np.bincount(word, minlength=len(words.start))


def is_held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text (null: empty) modulo ``modulus`` is ``remainder``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class LanguageModel:
    """Languages, n-gram scores (table, languages) and script masks."""

    def __init__(self, names: list[str], table: np.ndarray, masks: np.ndarray):
        self.names, self.table, self.masks = names, table, masks

    def word_scores(self, f: _Features) -> np.ndarray:
        sums = np.zeros((len(f.three) + 1, len(self.names)))
        np.cumsum(self.table[f.three] + self.table[f.four], axis=0, out=sums[1:])
        scores = sums[f.hi] - sums[f.lo]
        allowed = (f.scripts[:, None] & self.masks) != 0
        scores = np.where(allowed, scores, -1e4)
        scores[~allowed.any(axis=1)] = 0.0
        return scores


def fit(labelled: DataFrame, *, texts: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fit on at most ``texts`` texts of each language, chosen by a hash of the id.

    ``labelled`` has (doc_id, text, lang), no nulls in the last two.
    """
    order = [F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("doc_id")]
    ids = labelled.select("doc_id", "lang").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(PICK_PARTS)))
    # the first of each part hold the first of a language, and no task holds all its rows
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= texts)
    ids = broadcast_if_small(ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("of")).distinct())
    same = labelled["doc_id"].eqNullSafe(ids["id"]) & (labelled["lang"] == ids["of"])
    sample = labelled.join(ids, same, "left_semi").select("lang", "text")
    size = 2 << TABLE_BITS

    def count(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                f = _Features(data, offsets)
                names, of_text = np.unique(np.array(batch.column(0).slice(first, end - first).to_pylist(), object).astype(str), return_inverse=True)
                width = f.hi - f.lo
                at = np.repeat(f.lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                word = np.repeat(np.arange(len(width)), width)
                lang = of_text[f.words.text[word]]
                good = f.letters[word] > 0
                for k, name in enumerate(names):
                    mine = good & (lang == k)
                    n = np.bincount(np.concatenate([f.three[at[mine]], f.four[at[mine]]]), minlength=size)
                    s = np.bincount(np.log2(f.letter_bits[of_text[f.words.text[f.letter_word]] == k]).astype(int), minlength=len(_NAMES))
                    n = np.concatenate([n, s])
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["lang", "place", "n"])

    counts = sample.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    n_languages = ids.select("of").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages; at most {MAX_LANGUAGES} are told apart")
    got: pd.DataFrame = counts.toPandas()
    names = sorted(got["lang"].unique())
    full = np.zeros((size + len(_NAMES), len(names)))
    full[got["place"].to_numpy(), np.searchsorted(names, got["lang"].to_numpy())] = got["n"].to_numpy()
    table, scripts = full[:size] + 0.5, full[size:]
    half = size // 2
    log = np.concatenate([np.log(t / t.sum(axis=0)) for t in (table[:half], table[half:])]) if names else table
    log = log - log.mean(axis=1, keepdims=True) if names else log
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    masks = np.array([sum(1 << k for k in range(len(_NAMES)) if share[k, j] >= SCRIPT_SHARE) for j in range(len(names))], np.int64)
    return LanguageModel(names, log.astype(np.float32), masks)


def _viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    best = scores[0].copy()
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        change = best[top] - switch
        back[t] = np.where(best >= change, own, top)
        best = np.maximum(best, change) + scores[t]
    path = np.empty(n, np.int32)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label_words(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word; ``bounds`` cut the words into texts."""
    n_texts, counts = len(bounds) - 1, np.diff(bounds)
    text = np.repeat(np.arange(n_texts), counts)
    sums = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores, axis=0, out=sums[1:])
    constant = (sums[bounds[1:]] - sums[bounds[:-1]]).argmax(axis=1)
    labels = constant[text]
    gain = sums - 0
    for k in np.flatnonzero(counts > 1):
        lo, hi, own = bounds[k], bounds[k + 1], constant[k]
        g = gain[lo: hi + 1] - gain[lo: hi + 1, own: own + 1]
        # the most that a stretch of words prefers another language
        if (g - np.minimum.accumulate(g, axis=0)).max() >= switch:
            labels[lo:hi] = _viterbi(scores[lo:hi], switch)
    return labels


def _run_texts(value, batches, switch):
    model = value.value
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            f = _Features(data, offsets)
            if model.names:
                scores = model.word_scores(f)
                yield batch, first, end, f, scores, label_words(scores, f.words.bounds, switch)
            else:
                yield batch, first, end, f, np.zeros((len(f.lo), 1)), np.zeros(len(f.lo), np.int64)


def language_spans(docs: DataFrame, model: LanguageModel, *, switch: float = SWITCH, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, first_word, n_words, lang): the labelled spans of every text with words."""
    value = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, first, end, f, _, labels in _run_texts(value, batches, switch):
            text = f.words.text
            cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])][: len(labels)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(first + text[cut])), pa.array(cut - f.words.bounds[text[cut]]),
                pa.array(np.diff(np.r_[cut, len(labels)])),
                pa.array([model_names[k] for k in labels[cut]], pa.string())], ["doc_id", "first_word", "n_words", "lang"])

    model_names = model.names or [UNKNOWN]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_word long, n_words long, lang string")


def identify(docs: DataFrame, model: LanguageModel, *, switch: float = SWITCH, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) of every row of ``docs``.

    ``lang_pred`` is the label of most words with letters (ties: the larger sum of
    scores, then the name); ``score`` is their share times the probability that
    the model gives the language over these words.  Null, empty and letterless
    texts are ``und`` with score 0.  Ids may repeat or be null; other columns are
    read only when kept; an empty table gives no rows.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep if c != text_col])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kinds[f"kept_{text_col}"] = kinds["text"]
    # the text travels once, though it is kept
    places = [1 if c == text_col else rows.columns.index(f"kept_{c}") for c in keep]

    def run(batches):
        for batch, first, end, f, scores, labels in _run_texts(value, batches, switch):
            n, k, text = end - first, scores.shape[1], f.words.text
            real = f.letters > 0
            votes = np.bincount(text[real] * k + labels[real], minlength=n * k).reshape(n, k)
            total = np.stack([np.bincount(text[real], weights=scores[real, j], minlength=n) for j in range(k)], axis=1)
            most = votes.max(axis=1, keepdims=True)
            pred = np.where(votes == most, total - total.min() + 1, 0).argmax(axis=1)
            row = np.arange(n)
            # how sure the model is of the language where it labels it
            mine = real & (labels == pred[text])
            own = np.stack([np.bincount(text[mine], weights=scores[mine, j], minlength=n) for j in range(k)], axis=1)
            chance = 1 / np.exp(own - own[row, pred][:, None]).clip(max=1e300).sum(axis=1)
            words = votes.sum(axis=1)
            known = (words > 0) & bool(value.value.names)
            score = np.where(known, votes[row, pred] / np.maximum(words, 1) * chance, 0.0)
            names = np.array([*value.value.names, UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(names[np.where(known, pred, len(names) - 1)], pa.string()), pa.array(score)]
                + [batch.column(c).slice(first, n) for c in places],
                ["doc_id", "lang_pred", "score", *[f"kept_{c}" for c in keep]])

    out = ", ".join(["doc_id long", "lang_pred string", "score double", *[f"`kept_{c}` {kinds[f'kept_{c}']}" for c in keep]])
    return rows.mapInArrow(run, out)
