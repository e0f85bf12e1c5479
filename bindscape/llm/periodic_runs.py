"""Periodic runs of words, found by an online sparse diagonal DP.

A diagonal is a lag ``d``; its match length at word ``i`` counts the words up to ``i``
that equal the word ``d`` before them.  Each word's earlier occurrences step the match
lengths of the lags at which they lie, a lag without such an occurrence ends, and a
diagonal that ends long enough emits its run at once.

A run of period ``d`` repeats at least four times, so its diagonal matches ``3 d`` words in
a row.  Lags of ``2**k`` to ``2**(k+1) - 1`` are therefore stepped at every ``2**k``-th word
only, by the earlier occurrences of the ``2**k`` words that end there, which adds ``2**k`` to
the match length; the ends of a diagonal are then found word by word.  At most as many
steps as words are made a level, also in a text that repeats one word only.  Phrases of
doubling length get exact names from the names of their halves, and one that occurs once
in its text has none and is not looked at again.  Steps whose words lie inside a run of a
lower level are left out: they belong to a multiple of that run's period.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.llm.words import Words, ragged, slices

MIN_LENGTH = 6  # words of a run, at least
MIN_REPEATS = 4  # periods of a run, at least

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long"
)


def _named(keys: np.ndarray) -> np.ndarray:
    """Numbers of equal keys; -1 for a key that occurs once."""
    if not len(keys):
        return np.zeros(0, np.int32)
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count[name] > 1, name, -1).astype(np.int32)


def _steps(name, place, sizes, text, covered, width):
    """(word, lag) of every step of a level: each ``width``-th word against the earlier
    occurrences of the phrase that ends there."""
    n = np.int64(len(name))
    live = np.flatnonzero(name >= 0)
    keys = np.sort(name[live].astype(np.int64) * n + live)
    at = live[(place[live] + 1) % width == 0]
    base = name[at].astype(np.int64) * n
    low = np.searchsorted(keys, base + np.maximum(at - 2 * width + 1, 0))
    last = np.minimum(at - width, covered[at] + width - 2)
    high = np.searchsorted(keys, base + np.maximum(last, -1), side="right")
    many = np.maximum(high - low, 0)
    word = np.repeat(at, many)
    lag = word - keys[np.repeat(low, many) + ragged(many)] % n
    fits = MIN_REPEATS * lag <= sizes[text[word]]
    return word[fits], lag[fits]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of some texts, by text, start and period.

    ``words`` are the word numbers of all texts one after the other, ``sizes`` the words a
    text; ``start`` counts from the first word of its text.
    """
    n = len(words)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = ragged(sizes)
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    _, word = np.unique(words, return_inverse=True)
    name = _named(text * np.int64(n) + word) if n else np.zeros(0, np.int32)
    name[sizes[text] < MIN_LENGTH] = -1
    covered = np.full(n, np.iinfo(np.int64).max // 4)  # least start of a found run that reaches the word
    names, found, k = [], [], 0
    while (name >= 0).any():
        names.append(name)
        width = 1 << k
        m, lag = _steps(name, place, sizes, text, covered, width)
        if len(m):
            order = np.lexsort((m, lag))
            m, lag = m[order], lag[order]
            new = np.ones(len(m), bool)
            new[1:] = (lag[1:] != lag[:-1]) | (m[1:] != m[:-1] + width) | (text[m[1:]] != text[m[:-1]])
            first = np.flatnonzero(new)
            steps = np.diff(np.r_[first, len(m)])
            last = first + steps - 1
            enough = (steps + 2) * width - 2 >= (MIN_REPEATS - 1) * lag[first]
            first, last = first[enough], last[enough]
            d, low, high = lag[first], m[first] - width + 1, m[last]
            for t in range(k - 1, -1, -1):
                step, known = 1 << t, names[t]
                to = np.minimum(high + step, n - 1)
                same = (high + step < end[text[high]]) & (known[to] >= 0) & (known[to] == known[to - d])
                high = np.where(same, to, high)
                to, back = np.maximum(low - 1, 0), low - 1 - d
                same = (back >= begin[text[low]]) & (known[to] >= 0) & (known[to] == known[np.maximum(back, 0)])
                low = np.where(same, low - step, low)
            start, length = low - d, high - low + 1 + d
            run = (length >= np.maximum(MIN_LENGTH, MIN_REPEATS * d)) & (covered[high] > start)
            start, length, d = start[run], length[run], d[run]
            found.append((start, length, d))
            for a, size in zip(start.tolist(), length.tolist()):
                np.minimum(covered[a: a + size], a, out=covered[a: a + size])
        k += 1
        # phrases of twice the words, of texts that have room for four periods of that length
        right = np.flatnonzero((name >= 0) & (place >= 2 * width - 1) & (sizes[text] >= 2 * MIN_REPEATS * width))
        right = right[name[right - width] >= 0]
        following = np.full(n, -1, np.int32)
        following[right] = _named(name[right - width].astype(np.int64) * n + name[right])
        name = following
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return text[start], start - begin[text[start]], length, period


def planted_repeats(doc_id: str | None, n: int) -> tuple[int, int] | None:
    """(first word, period) from which a text's words repeat, by the crc32 of its id; one
    id of ten has such a repeat."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return None
    g = h // 10
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def _joined(words: Words, chosen: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of the texts made of the ``chosen`` words joined by a space."""
    size = words.end[chosen] - words.start[chosen]
    counts = np.bincount(text, minlength=n_texts)
    if not len(chosen):
        return np.zeros(0, np.uint8), np.zeros(n_texts + 1, np.int64)
    ends = np.cumsum(size + 1)
    out = np.full(ends[-1], 0x20, np.uint8)
    out[np.repeat(ends - size - 1, size) + ragged(size)] = words.data[np.repeat(words.start[chosen], size) + ragged(size)]
    return out, np.r_[0, ends][np.r_[0, np.cumsum(counts)]]


def _texts(plant: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                sizes = words.counts.astype(np.int64)
                bounds = words.bounds
                source = np.arange(len(words.start))
                if plant:
                    for k in range(last - first):
                        doc_id = ids[first + k]
                        at = planted_repeats(None if doc_id is None else str(doc_id), int(sizes[k]))
                        if at:
                            a = bounds[k] + at[0]
                            source[a: bounds[k + 1]] = a + np.arange(bounds[k + 1] - a) % at[1]
                text, start, length, period = find_runs(words.hashes(fold=False)[source], sizes)
                dropped = np.zeros(len(source) + 1, np.int64)
                at = bounds[text] + start
                np.add.at(dropped, at + period, 1)
                np.add.at(dropped, at + length, -1)
                kept = np.cumsum(dropped[:-1]) == 0
                made, cuts = _joined(words, source[kept], np.repeat(np.arange(last - first), sizes)[kept], last - first)
                made = made.tobytes()
                cut = np.searchsorted(text, np.arange(last - first + 1))
                rows = []
                for k in range(last - first):
                    lo, hi = cut[k], cut[k + 1]
                    best = (None,) * 4
                    listed = b""
                    if lo < hi:
                        # runs come by start and period, so the first longest is the one asked for
                        b = lo + int(np.argmax(length[lo:hi]))
                        best = (int(start[b]), int(length[b]), int(period[b]), int(1000 * length[b] // period[b]))
                        listed = "".join(
                            f"{x},{y},{z}\n" for x, y, z in zip(start[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist())
                        ).encode()
                    rows.append((
                        ids[first + k], int(hi - lo), *best, hashlib.sha256(listed).hexdigest(),
                        # without the space behind the last word
                        hashlib.sha256(made[cuts[k]: max(cuts[k], cuts[k + 1] - 1)]).hexdigest(), int(sizes[k])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
    return run


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string() if c.endswith(" string") else pa.int64() for c in SCHEMA.split(", ")]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its runs counted, its longest run, digests of all
    runs and of the text without the repeats.

    A run is a longest stretch of words of one text with smallest period ``q`` that has at
    least 6 and ``4 q`` words.  Of several longest runs the one of the least start, then
    period, is given.  A word goes from the collapsed text if some run holds it behind that
    run's first ``q`` words.  With ``plant``, the words of one id of ten are first made to
    repeat (``planted_repeats``).

    Null, empty and blank texts have no words and no runs: four nulls and the digests of
    nothing.  A null id repeats nothing.  Repeated rows give repeated results, an empty table none;
    other columns are not read.  A text is worked on in one task, in memory of some
    hundred bytes a word.  Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_texts(plant), SCHEMA)
