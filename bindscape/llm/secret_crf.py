"""Secret scans by a linear-chain conditional random field.

Tokens (words between white space) are tagged begin, inside or outside of a
secret from their shape, the words beside them and features of the whole text,
and decoded by Viterbi.  The field is trained on windows around known secrets and
around other tokens of a bounded sample of texts; the known secrets are the matches
of three patterns.  Around each of them the field is also taught with made values
behind made names, and with tokens that only look odd, so that it goes by shape and
finds secrets behind names that no pattern has.  A scan returns those matches and, besides, what the field
tags outside them, also of a token that a match covers in part.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import broadcast_if_small
from bindscape.llm.words import Words, slices

KINDS = ("assign", "access", "hex", "crf")
SAMPLE_TEXTS = 12000  # texts the field is trained on, at most
SAMPLE_WINDOWS = 6000
CONTEXT = 12  # tokens to each side of a window's middle
TABLE_BITS = 16
N_FEATURES = 8
EPOCHS = 16
MISSED = 1.0  # log odds that a missed secret weighs more than a false one
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
VARIANTS = 16  # made windows of each kind around a known secret
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_HEX = np.zeros(256, np.int32)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = 1
#: 0 lower, 1 upper, 2 digit, 3 joiners of keys, 4 assignment marks, 5 other ASCII, 6 beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[list(b"+/_-")] = 3
_CLASS[list(b"=:")] = 4


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns' matches, sorted."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _may_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which a pattern can match."""
    out = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    folded = _LOWER[data].tobytes()
    for key, where in [*((k, folded) for k in KEYWORDS), (b"AKIA", raw)]:
        at = where.find(key)
        while at >= 0:
            out[np.searchsorted(offsets, at, side="right") - 1] = True
            at = where.find(key, at + 1)
    runs = np.cumsum(_IS_HEX[data])
    if len(runs) >= 32:
        before = np.concatenate([[0], runs[:-32]])
        at = np.flatnonzero(runs[31:] - before == 32)
        out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


class Field:
    """Tokens of a run of texts and the table rows of their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, file: np.ndarray | None = None):
        """``file``: features of the texts these were cut from; their own if None."""
        self.words = w = Words(data, offsets)
        n = len(w.start)
        h = w.hashes()
        kind = _CLASS[data]
        size = w.end - w.start
        has = np.zeros((7, n), np.int64)
        if n:
            # a word's bytes and the gap behind it lie between two starts; gaps are of class 5
            for c in (0, 1, 2, 3, 4, 6):
                sums = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])
                has[c] = sums[w.end] - sums[w.start]
            turns = np.concatenate([[0], np.cumsum(np.r_[False, kind[1:] != kind[:-1]], dtype=np.int32)])
            self.turns = turns[w.end] - turns[np.minimum(w.start + 1, len(data))]
        else:
            self.turns = np.zeros(0, np.int64)
        has[5] = size - has.sum(axis=0)
        bucket = np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64], size, side="right")
        flags = sum((has[c] > 0).astype(np.int64) << c for c in range(7))
        mostly = np.where(has[2] * 2 > size, 1, 0) + np.where(has[0] == size, 2, 0)
        turn = np.minimum(self.turns * 4 // np.maximum(size, 1) + (self.turns > 2), 4)
        shape = ((bucket * 128 + flags) * 4 + mostly) * 5 + turn
        age = np.arange(n) - w.bounds[w.text]
        left = np.arange(n) + age * 0
        before = np.where(age > 0, h[np.maximum(left - 1, 0)], np.uint64(1))
        last = np.arange(n) == w.bounds[w.text + 1] - 1 if n else np.zeros(0, bool)
        after = np.where(last, np.uint64(2), h[np.minimum(left + 1, n - 1)]) if n else h
        long, digit, change = self._longest_run(kind)
        run = np.searchsorted([4, 8, 10, 12, 16, 20, 24, 32, 40, 64], long, side="right") * 64
        some = np.maximum(long, 1)
        run += np.minimum(digit * 8 // some, 7) * 8 + np.minimum(change * 8 // some, 7)
        first4 = np.zeros(n, np.int64)
        padded = np.concatenate([_LOWER[data], np.zeros(4, np.uint8)]).astype(np.int64)
        for k in range(4):
            first4 = first4 * 256 + np.where(size > k, padded[w.start + k], 0)
        counts = w.counts
        digits = np.bincount(w.text, weights=has[2], minlength=w.n_texts) / np.maximum(np.diff(offsets), 1)
        if file is None:
            file = np.minimum(np.log2(np.maximum(counts, 1)).astype(int) // 2, 7) * 4 + np.searchsorted([0.005, 0.02, 0.1], digits)
        self.file = file
        mix = lambda x, k: ((np.asarray(x).astype(np.uint64) + np.uint64(k * 7919)) * np.uint64(0x9E3779B97F4A7C15 | k << 1)) >> np.uint64(64 - TABLE_BITS)
        pre_shape = np.where(age > 0, np.roll(shape, 1), 0)
        self.rows = np.stack([mix(shape, 1), mix(before, 2), mix(after, 3), mix(first4 * 4096 + bucket, 4),
                              mix(shape * 64 + file[w.text], 5), mix(shape * 100000 + pre_shape, 6),
                              mix(run, 7), mix(run // 64 * 8 + run % 8, 8)]).astype(np.int64)

    def _longest_run(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, digits and changes of class of each word's longest run of letters and digits."""
        start, n = self.words.start, len(self.words.start)
        best = np.zeros(n, np.int64)
        if n:
            inner = kind <= 2
            first = inner.copy()
            first[1:] &= ~inner[:-1]
            first[start] = inner[start]
            change = np.zeros(len(kind), bool)
            change[1:] = inner[1:] & (kind[1:] != kind[:-1]) & ~first[1:]
            at = np.flatnonzero(first)
            if len(at):
                size, digits, turns = (np.add.reduceat(x, at, dtype=np.int64) for x in (inner, kind == 2, change))
                word = np.searchsorted(start, at, side="right") - 1
                own = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                best[word[own]] = np.maximum.reduceat(size << 42 | digits << 21 | turns, own)
        return best >> 42, best >> 21 & 0x1FFFFF, best & 0x1FFFFF

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """Code point place of every byte of the run, and of every text's start."""
        lead = np.concatenate([[0], np.cumsum((self.words.data & 0xC0) != 0x80)])
        return lead, lead[self.words.offsets]


class ConditionalField:
    def __init__(self, table: np.ndarray, moves: np.ndarray):
        self.table, self.moves = table, moves

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        e = self.table[rows[0]].astype(np.float64)
        for r in rows[1:]:
            e += self.table[r]
        return e

    def decode(self, e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tags of all tokens.

        Against staying outside, a run of m tags gains the sum of d = best tag's
        emission minus outside's, and pays one move in, one out (none at a text's
        ends) and m - 1 inside.  So it can only win when some d is above the least
        of these prices, half of the inner one where the run is the whole text; in
        other texts outside is the best path.
        """
        tags = np.zeros(len(e), np.int8)
        stay = self.moves[OUTSIDE, OUTSIDE]
        enter, leave = self.moves[OUTSIDE, 1:].max() - stay, self.moves[1:, OUTSIDE].max() - stay
        inner = self.moves[1:, 1:].max() - stay
        price = max(0.0, min(-enter, -leave, -inner / 2))
        d = np.maximum(e[:, BEGIN], e[:, INSIDE]) - e[:, OUTSIDE]
        alone = np.repeat(np.diff(bounds) == 1, np.diff(bounds))
        hot = np.flatnonzero((d > price) | alone & (d > 0))
        if price == 0.0:
            hot = np.flatnonzero(d + max(0.0, enter, leave, inner) * 2 > 0)
        for k in np.unique(np.searchsorted(bounds, hot, side="right") - 1):
            lo, hi = bounds[k], bounds[k + 1]
            tags[lo:hi] = _viterbi(e[lo:hi].tolist(), self.moves.tolist())
        return tags


def _viterbi(e: list, m: list) -> list[int]:
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = m
    o, b, i = e[0][0], e[0][1], float("-inf")
    back = []
    for x, y, z in e[1:]:
        fo = max((o + oo, 0), (b + bo, 1), (i + io, 2), key=lambda t: t[0])
        fb = max((o + ob, 0), (b + bb, 1), (i + ib, 2), key=lambda t: t[0])
        fi = max((o + oi, 0), (b + bi, 1), (i + ii, 2), key=lambda t: t[0])
        back.append((fo[1], fb[1], fi[1]))
        o, b, i = fo[0] + x, fb[0] + y, fi[0] + z
    at = max((o, 0), (b, 1), (i, 2), key=lambda t: (t[0], -t[1]))[1]
    path = [at]
    for steps in reversed(back):
        at = steps[at]
        path.append(at)
    return path[::-1]


_FORBIDDEN = -30.0  # inside does not follow outside


def _train(rows: np.ndarray, tags: np.ndarray, real: np.ndarray) -> ConditionalField:
    """Stochastic gradient ascent on the windows' log likelihood.

    rows (windows, features, length), tags and real (windows, length).
    """
    n, _, length = rows.shape
    table = np.zeros((1 << TABLE_BITS, 3))
    squares = np.full((1 << TABLE_BITS, 3), 1e-2)
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = _FORBIDDEN
    rng = np.random.default_rng(3)
    start = np.array([0.0, 0.0, _FORBIDDEN])
    for _ in range(EPOCHS if n else 0):
        for pick in np.array_split(rng.permutation(n), max(1, n // 64)):
            r, y, ok = rows[pick], tags[pick], real[pick]
            e = table[r].sum(axis=1)  # (windows, length, 3)
            e[~ok] = [0.0, _FORBIDDEN, _FORBIDDEN]
            a = np.empty_like(e)
            z = np.empty_like(e)
            a[:, 0] = e[:, 0] + start
            for t in range(1, length):
                a[:, t] = e[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1)
            z[:, -1] = 0
            for t in range(length - 2, -1, -1):
                z[:, t] = np.logaddexp.reduce(moves + (e[:, t + 1] + z[:, t + 1])[:, None, :], axis=2)
            whole = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + z - whole[:, None, None])
            p[np.arange(len(pick))[:, None], np.arange(length), y] -= 1
            p *= ok[:, :, None]
            pair = np.exp(a[:, :-1, :, None] + moves + (e + z)[:, 1:, None, :] - whole[:, None, None, None])
            g = (pair * (ok[:, :-1] & ok[:, 1:])[:, :, None, None]).sum(axis=(0, 1))
            np.subtract.at(g, (y[:, :-1][ok[:, :-1] & ok[:, 1:]], y[:, 1:][ok[:, :-1] & ok[:, 1:]]), 1)
            moves -= 0.3 / max(1, len(pick)) * g
            moves[OUTSIDE, INSIDE] = _FORBIDDEN
            flat = r.transpose(1, 0, 2).reshape(-1)
            step = np.zeros_like(table)
            np.add.at(step, flat, np.tile(p.reshape(-1, 3), (r.shape[1], 1)))
            used = np.unique(flat)
            squares[used] += step[used] ** 2
            table[used] -= 0.3 * step[used] / np.sqrt(squares[used]) + 1e-4 * table[used]
    # without windows everything is outside
    if not n:
        table[:, OUTSIDE] = 1.0
    else:
        moves[OUTSIDE, BEGIN] += MISSED
    return ConditionalField(table.astype(np.float32), moves)


def _labels(f: Field, first: int, texts, flagged: np.ndarray) -> np.ndarray:
    """Tags of all tokens by the values of the patterns' matches."""
    tags = np.zeros(len(f.words.start), np.int64)
    lead, starts = f.code_points()
    token_lo, token_hi = lead[f.words.start], lead[f.words.end]
    for k in np.flatnonzero(flagged):
        for _, _, stop, value in base_spans(texts[first + k].as_py()):
            lo = np.searchsorted(token_hi, starts[k] + value, side="right")
            hi = np.searchsorted(token_lo, starts[k] + stop, side="left")
            tags[lo:hi] = INSIDE
            tags[lo: lo + 1] = BEGIN
    return tags


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_DIGITS + "abcdef", _DIGITS + _LETTERS, _DIGITS + _LETTERS + _LETTERS.upper(),
              _DIGITS + _LETTERS + _LETTERS.upper() + "+/", _DIGITS + _LETTERS + _LETTERS.upper() + "_-")


def _drawn(rng, letters: str, low: int, high: int) -> str:
    return "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(low, high + 1)))


def _made_secret(rng) -> tuple[list[str], int]:
    """Tokens of a made secret and the place of the one that holds its value."""
    name = ("_", "-", "")[rng.integers(3)].join(_drawn(rng, _LETTERS, 2, 7) for _ in range(rng.integers(1, 4)))
    if rng.random() < 0.2:
        name = name.upper()
    value = ""
    while not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        value = _drawn(rng, _ALPHABETS[rng.integers(len(_ALPHABETS))], 12, 48)
    for _ in range(max(0, rng.integers(4) - 1)):
        value = _drawn(rng, _LETTERS, 2, 4) + "_" + value
    forms = ([f"{name}={value}"], [f"{name}='{value}'"], [f"{name}:", value], [name, "=", f'"{value}"'], [name, "=", value],
             [f'"{name}":', f'"{value}",'], [name, value], [value])
    form = forms[rng.integers(len(forms))]
    return form, len(form) - 1


def _made_clean(rng, words: list[str]) -> list[str]:
    """Tokens that stand out among words and are no secret."""
    one, two, three = (words[k] for k in rng.integers(0, len(words), 3))
    name, n = _drawn(rng, _LETTERS, 2, 8), int(rng.integers(1, 10 ** int(rng.integers(1, 10))))
    forms = ([f"{name}={one}"], [f"{name}:", one], [name, "=", f'"{one}"'], [name, "=", str(n)], [f"{name}:", f"{n:,}"], [f"{name}={n}"],
             [f"https://www.{one}.com/{two}/{three}-{n}"], [f"http://{name}.org/{one}?{name}={n}"], [f"{one}.{n}@{name}.example.com"],
             [f"20{n % 100:02d}-{n % 12 + 1:02d}-{n % 28 + 1:02d}T{n % 24:02d}:{n % 60:02d}:00Z"], [f"v{n % 9}.{n % 30}.{n % 7}"],
             [f"+{n % 99}-{n:09d}"], [f"/{one}/{two}/{name}.py"], [f"{one.title()}{two.title()}{name.title()}"], [f"{one}_{two}_{name}"],
             [f"{one}-{two}-{three}"], [f"{one}/{two}"], [f"{one.upper()}-{n}"], [f"#{n}"], [f"{one}{n % 1000}"], [f"{name}({one},", f"{two})"])
    return forms[rng.integers(len(forms))]


def _made_texts(text: str, start: int, end: int) -> tuple[list[str], list[list[int]], list[int], list[int]]:
    """Texts with made tokens in place of text[start:end]: texts, their tags, places of the
    middles, and whether they hold a secret."""
    rng = np.random.default_rng(zlib.crc32(text[start:end].encode("utf-8", "replace")))
    left, right = text[max(0, start - 400):start].split()[-CONTEXT:], text[end:end + 400].split()[:CONTEXT]
    words = [w for w in left + right if w.isalpha()] or ["word"]
    texts, tags, middles, kinds = [], [], [], []
    for k in range(2 * VARIANTS):
        form, at = _made_secret(rng) if k % 2 else (_made_clean(rng, words), 0)
        tag = [OUTSIDE] * (len(left) + len(form) + len(right))
        if k % 2:
            tag[len(left) + at] = BEGIN
        texts.append(" ".join(left + form + right))
        tags.append(tag)
        middles.append(len(left) + at)
        kinds.append(k % 2)
    return texts, tags, middles, kinds


def _windows(f: Field, tags: np.ndarray, middle: np.ndarray, secret: np.ndarray):
    """One row of the training table for each token of ``middle``."""
    n = len(tags)
    at = middle[:, None] + np.arange(-CONTEXT, CONTEXT + 1)
    ok = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    ok &= f.words.text[at] == f.words.text[middle][:, None]
    for m in range(len(middle)):
        yield pa.RecordBatch.from_arrays([
            pa.array([int(secret[m])], pa.int32()),
            pa.array([int(f.rows[:, middle[m]].sum() * 2654435761 % 1000003)], pa.int64()),
            pa.array([f.rows[:, at[m]].astype(np.int32).tobytes()]),
            pa.array([np.where(ok[m], tags[at[m]], 0).astype(np.int8).tobytes()]), pa.array([ok[m].tobytes()])],
            ["secret", "draw", "rows", "tags", "real"])


def fit(docs: DataFrame, *, texts: int = SAMPLE_TEXTS, windows: int = SAMPLE_WINDOWS, id_col="doc_id", text_col="text") -> ConditionalField:
    """Train on at most ``windows`` windows of at most ``texts`` texts chosen by a
    hash of the id; half of them at most hold a known or a made secret.  Tokens that
    stand out by length and letters are preferred among the others."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(texts)
    ids = broadcast_if_small(ids.select(F.col("doc_id").alias("id")))
    sample = rows.join(ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    width = 2 * CONTEXT + 1

    def cut(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                f = Field(data, offsets)
                flagged = _may_match(data, offsets)
                tags = _labels(f, first, batch.column(1), flagged)
                n = len(tags)
                if not n:
                    continue
                rng = np.random.default_rng(n)
                odd = (tags == OUTSIDE) & (f.words.end - f.words.start >= 8) & (f.turns > 1)
                middle = np.concatenate([np.flatnonzero(tags == BEGIN), np.flatnonzero(rng.random(n) < np.where(odd, 0.05, 0.002))])
                yield from _windows(f, tags, middle, tags[middle] == BEGIN)
                for k in np.flatnonzero(flagged):
                    text = batch.column(1)[first + int(k)].as_py()
                    for start, _, stop, _ in base_spans(text):
                        made, marks, places, kinds = _made_texts(text, start, stop)
                        raw = [x.encode("utf-8", "replace") for x in made]
                        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                        g = Field(np.frombuffer(b"".join(raw), np.uint8), bounds, np.full(len(raw), f.file[k]))
                        marks_of = np.concatenate([np.array(m, np.int64) for m in marks])
                        if len(marks_of) == len(g.words.start):
                            yield from _windows(g, marks_of, g.words.bounds[:-1] + np.array(places), np.array(kinds))

    made = sample.mapInArrow(cut, "secret int, draw long, rows binary, tags binary, real binary")
    half = [made.where(F.col("secret") == s).orderBy("draw", "rows", "tags").limit(windows // 2) for s in (0, 1)]
    got = half[0].unionByName(half[1]).orderBy("draw", "rows", "tags").toPandas()
    unpack = lambda c, kind: np.frombuffer(b"".join(got[c]), kind)
    return _train(
        unpack("rows", np.int32).reshape(len(got), N_FEATURES, width).astype(np.int64),
        unpack("tags", np.int8).reshape(len(got), width).astype(np.int64), unpack("real", bool).reshape(len(got), width))


_TRIMMED = ".,;:!?\"')]}([{#`<>*|~"
_TRIM = set(_TRIMMED.encode())


def _text_spans(batch, model: ConditionalField):
    """(place in the batch, spans (start, kind, end)) of the texts that have any."""
    texts = batch.column(1)
    for first, end, data, offsets in slices(texts):
        flagged = _may_match(data, offsets)
        f = Field(data, offsets)
        tags = model.decode(model.emissions(f.rows), f.words.bounds)
        begins = np.flatnonzero((tags != OUTSIDE) & ~((tags == INSIDE) & np.r_[False, tags[:-1] != OUTSIDE]))
        found: dict[int, list] = {}
        for k in np.flatnonzero(flagged):
            spans = [(s, kind, e) for s, kind, e, _ in base_spans(texts[first + k].as_py())]
            if spans:
                found[k] = spans
        if len(begins):
            lead, starts = f.code_points()
            for b in begins:
                k, stop = f.words.text[b], b + 1
                while stop < len(tags) and tags[stop] == INSIDE and f.words.text[stop] == k:
                    stop += 1
                lo, hi = f.words.start[b], f.words.end[stop - 1]
                while hi - lo > 1 and data[hi - 1] in _TRIM:
                    hi -= 1
                while hi - lo > 1 and data[lo] in _TRIM:
                    lo += 1
                lo, hi = int(lead[lo] - starts[k]), int(lead[hi] - starts[k])
                text = texts[first + k].as_py()
                rest = [(a, 3, z) for a, z in _outside(lo, hi, found.get(k, ())) if text[a:z].strip(_TRIMMED)]
                if rest:
                    found.setdefault(k, []).extend(rest)
        for k in sorted(found):
            yield first + int(k), sorted(found[k])


def _outside(lo: int, hi: int, spans) -> list[tuple[int, int]]:
    """The parts of lo..hi that none of ``spans`` (start, kind, end) covers."""
    out = []
    for start, _, end in sorted(spans):
        if start < hi and end > lo:
            if start > lo:
                out.append((lo, start))
            lo = max(lo, end)
    return [*out, (lo, hi)] if lo < hi else out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, model: ConditionalField, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    in the order of KINDS, joined by commas; ``base_sha256`` digests those of the
    patterns.  The field's spans (``crf``) are what it tags outside them, without
    parts that are punctuation only, so they overlap none of them.  A null or empty
    text has no spans.  Ids may repeat or be null; other columns are not read; an
    empty table gives no rows.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for k, found in _text_spans(batch, value.value):
                base = [x for x in found if x[1] < 3]
                for _, kind, _ in base:
                    counts[kind, k] += 1
                digests[k] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[k] = _joined(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: ConditionalField, *, text_col="text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping
    spans, and a field's span that touches another, count as one.  Rows, other columns and null texts stay as they are."""
    value = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            two = pa.RecordBatch.from_arrays([texts, texts], ["a", "b"])
            new = dict()
            for k, found in _text_spans(two, value.value):
                text, out, at, last = texts[k].as_py(), [], 0, None
                for start, kind, end in found:
                    if start > at or start == at and not (out and 3 in (kind, last)):
                        out += [text[at:start], mask]
                    at, last = max(at, end), kind
                new[k] = "".join(out) + text[at:]
            if new:
                texts = pa.array([new.get(k, texts[k].as_py()) for k in range(len(texts))], pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if c == place else batch.column(c) for c in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
