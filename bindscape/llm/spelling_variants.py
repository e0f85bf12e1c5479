"""Spelling variants by PartEnum signatures of letter multisets.

Words one edit apart have letter multisets that differ in one letter (one inserted or
deleted) or two (one replaced).  A multiset is a binary vector with a bit for each (letter,
occurrence).  As one edit leaves one half of a word as it is, the vectors of the two halves
are the first level of the partition: one of them is equal.  The other half's bits are dealt
to parts, and of those at most as many differ as bits do, so leaving out every choice of
that many parts leaves an equal rest at least once.  Each choice gives an exact signature of what is
left.  Words meet by an equi-join on signatures, and those that meet are verified by
their edit distance, so no near pair is lost and none is wrong.

Halves are cut by letter counts: words of one length ``L`` at ``L // 2``.  A word of ``L``
and one of ``L + 1`` letters share either the first ``L // 2`` letters or the last ``L - L // 2``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bindscape.functions.session import settle
from bindscape.llm.words import mix, ragged

LETTERS = "[A-Za-zÀ-ÿ]"
REPLACE_PARTS = 4  # parts of the changed half for a replaced letter; two are left out
SHIFT_PARTS = 3  # parts for an inserted or deleted letter; one is left out


def _half_sums(letters, word, place, cut, n_words, parts):
    """(2, parts, words) sums of the hashed bits of each half and part; words are cut at ``cut``."""
    side = (place >= cut[word]).astype(np.int64)
    order = np.lexsort((letters, side, word))
    c, s, w = letters[order], side[order], word[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    bit = (c << 32) + np.arange(len(c)) - first[np.cumsum(new) - 1]
    h = mix(bit.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(2 * parts * n_words, np.uint64)
    np.add.at(sums, (s * parts + (h >> np.uint64(33)).astype(np.int64) % parts) * n_words + w, mix(h))
    return sums.reshape(2, parts, n_words)


def _enumerate(sums, left_out, length, kind, sides=(0, 1)):
    """Signatures (words, choices) that keep the other half and all but ``left_out`` parts of each side's."""
    parts = sums.shape[1]
    whole = sums.sum(axis=1, dtype=np.uint64)
    out = []
    for side in sides:
        for k, gone in enumerate(combinations(range(parts), left_out)):
            rest = whole[side] - sum(sums[side, p] for p in gone)
            tag = np.uint64(((kind * 2 + side) * 64 + k) << 32)
            out.append(mix(mix(rest) + np.uint64(3) * mix(whole[1 - side]) + mix(length.astype(np.uint64) + tag)))
    return np.stack(out, axis=1)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its signatures for words of its own length, as the shorter and as the
    longer word of a pair."""
    n = len(words)
    size = np.array([len(x) for x in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word, place = np.repeat(np.arange(n), size), ragged(size)

    def sums(cut, parts):
        return _half_sums(letters, word, place, cut, n, parts)

    same = _enumerate(sums(size // 2, REPLACE_PARTS), 2, size, 0)
    short = _enumerate(sums(size // 2, SHIFT_PARTS), 1, size, 1)
    cut = (size - 1) // 2
    long = np.concatenate([
        _enumerate(sums(cut + 1, SHIFT_PARTS), 1, size - 1, 1, (0,)),  # the last letters are shared
        _enumerate(sums(cut, SHIFT_PARTS), 1, size - 1, 1, (1,)),  # the first are
    ], axis=1)
    return same, short, long


def _signed(batches):
    for batch in batches:
        table = signatures(batch.column(0).to_pylist())
        lists = [
            pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64)))
            for x in table
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["word", "n", "same", "short", "long"])


def plant_typo(doc_id: Column, run: Column) -> Column:
    """``run`` without one letter where 31 divides the crc32 of ``<doc_id>:<run>``; which one, the crc32 says."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 31 == 0, less).otherwise(run)


def word_counts(
    docs: DataFrame, *, min_length: int = 7, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
) -> DataFrame:
    """(word, n) of the words of all texts; with ``plant``, some lose a letter first."""
    runs = docs.select(
        F.col(id_col).alias("doc_id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(f"({LETTERS}{{{min_length},}})"))).alias("run"))
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = F.coalesce(plant_typo(F.col("doc_id"), run), run) if plant else run
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) of all pairs of ``words`` (word, n; each word once) exactly one inserted,
    deleted or replaced letter apart, each pair once."""
    signed = settle(words.mapInArrow(_signed, "word string, n long, same array<long>, short array<long>, long array<long>"))

    def side(kind, word, n):
        return signed.select(F.col("word").alias(word), F.col("n").alias(n), F.explode(kind).alias("sig"))

    one_apart = F.levenshtein("a", "b", 1) == 1
    same = side("same", "a", "na").join(side("same", "b", "nb"), "sig").where((F.col("a") < F.col("b")) & one_apart)
    shift = side("short", "a", "na").join(side("long", "b", "nb"), "sig").where(one_apart)
    return same.select("a", "na", "b", "nb").unionByName(shift.select("a", "na", "b", "nb")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) along the forms to the last.
    The links must have no cycle; each round doubles the way, so rounds grow with the
    logarithm of the longest one."""
    jump = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("to"))
        moved = settle(jump.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        jump = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return jump


def spelling_variants(
    docs: DataFrame, *, min_length: int = 7, min_count: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text",
    plant: bool = False,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are longest runs of ASCII and Latin-1 letters with A-Z made small, of at least
    ``min_length`` letters and ``min_count`` occurrences.  ``n_near`` counts the other words
    one edit away; ``form`` is the most frequent of them (ties: first in code-point order) if it
    occurs at least ``ratio`` times as often as the word, else null; ``root`` is the last word
    along the forms, the word itself if it has none.  With ``plant``, some runs lose a letter
    first (``plant_typo``); a null id loses none.

    Null and empty texts have no words; repeated rows count twice; a run of any length is
    one word; an empty table gives no rows.  Other columns are not read.
    """
    words = settle(word_counts(docs, min_length=min_length, min_count=min_count, id_col=id_col, text_col=text_col, plant=plant))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")),
    )).alias("p")).select("p.*")
    # the least of (-n, word) is the most frequent, first in code-point order
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    best = settle(best.select(
        "word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    root = roots(best.where("form IS NOT NULL").select("word", "form"))
    return words.join(best, "word", "left").join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
