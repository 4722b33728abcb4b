"""Fuzzy passages shared by documents: seeds, collinear chains, alignment.

Seeds are the minimisers of runs of five words: of every W consecutive runs the one of least hash,
so two texts that share W + 4 words in a row share a seed.  Every later occurrence of a seed is
matched with its first one, never with all others.  The matches of two documents are merged along
diagonals, and the segments are chained by a Fenwick tree over prefix maxima with a cost for every
word that a gap leaves out.  Chains are aligned word by word; what is long and similar enough is a
passage.  Of a chain that is not, the longest parts that are similar enough are looked at.

The first occurrences of a passage's seeds may lie in documents that hold only parts of it.  So
where all seeds are repeated and no passage explains them, the whole windows of ``min_words`` words
around the rarest seeds become seeds themselves, which again meet their first occurrence: every
run of ``min_words`` words that an earlier document has is found, at a cost that grows with the
occurrences, not with their pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, textvec

K, W = 5, 4
MIN_WORDS, PERCENT = 50, 80
#: A seed that comes again after so many words is no self-repetition.
BREAK = 50
#: A gap of more words, on either side, ends a chain.
MAX_GAP = 40
GAP_COST = 0.1
#: A passage grows at its ends over words that differ, too, while no run of them costs more than this;
#: an equal word gains 1, a differing one loses 2.
DROP = 6
#: Words beyond a chain's ends that are looked at.
MARGIN = 48
#: So many wanted places (under 100 bytes each) may be broadcast to the texts.
FEW = 100_000
#: Seeds handed on at once.
SEED_ROWS = 1 << 16
#: Texts are read so many times, each time for a part of the seeds: so the seeds on their way take less disk.
PASSES = 2
#: Of one document in SAMPLE the seeds are counted.  Those that HOT of them have are dealt to SALTS tasks, ranges of the
#: documents' order: that spreads the work and changes nothing else.  Of more than MOST_HOT the most frequent are dealt; any
#: other seed then has less than one in MOST_HOT of all occurrences.
SAMPLE, HOT, MOST_HOT, SALTS = 64, 100, 1 << 18, 32
#: Words on either side of a seed of which its row tells two bits each.
NEAR = 16
#: Occurrences of a seed in one text that are nearer than this are one occurrence of a window.
APART = 50


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def seeds(words: textvec.Words, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in the buffer where a seed starts, and their hashes."""
    n = len(words.hash) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * textvec._MULT + words.hash[j : j + n]
    run = textvec.mix(run)
    whole = words.doc[:n] == words.doc[k - 1 :]
    # Runs across a border of texts never win, and windows across one do not count.
    run[~whole] = np.iinfo(np.uint64).max
    picked = np.zeros(n, bool)
    if n >= w:
        least = _sliding(run, w, np.minimum)
        inside = words.doc[: n - w + 1] == words.doc[w - 1 + k - 1 :]
        least[~inside] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        picked = _sliding(padded, w, np.maximum) == run
        picked &= whole
    # A text of fewer runs than a window gives its least run.
    for d in np.flatnonzero((words.count >= k) & (words.count < w + k - 1)):
        a, b = words.first[d], words.first[d + 1] - k + 1
        picked[a + int(run[a:b].argmin())] = True
    at = np.flatnonzero(picked)
    return at, run[at]


def _turns(doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each seed has stood in its document before, and how often since it last stayed away for BREAK words."""
    order = np.lexsort((at, h, doc))
    d, x, p = doc[order], h[order], at[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    out = []
    for _ in range(2):
        start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        turn = np.empty(len(x), np.uint64)
        turn[order] = (np.arange(len(x)) - start).astype(np.uint64)
        out.append(turn)
        new[1:] |= p[1:] - p[:-1] >= BREAK
    return out[0], out[1]


def surroundings(words: textvec.Words, at: np.ndarray) -> np.ndarray:
    """Two bits of each of the NEAR words before and after the seeds at ``at``, packed in 64 bits."""
    code = np.concatenate([np.zeros(NEAR, np.uint64), words.hash >> np.uint64(62), np.zeros(NEAR + K, np.uint64)])
    for step in (1, 2, 4, 8):
        code = code[: len(code) - step] | code[step:] << np.uint64(2 * step)
    return code[at + NEAR + K] << np.uint64(32) | code[at]


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two seeds' surroundings let a passage grow over NEAR words on a side.

    Growth over so many words leaves at most DROP behind: with e words that differ,
    (NEAR - e) - 2 * e >= -DROP.
    """
    x = a ^ b
    x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    sides = np.bitwise_count(x & np.uint64(0xFFFFFFFF)), np.bitwise_count(x >> np.uint64(32))
    return np.minimum(*sides) <= (NEAR + DROP) // 3


def alike(a: Column, b: Column) -> Column:
    """``_alike`` of two columns of surroundings."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
    sides = F.bit_count(x.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned(x, 32))
    return F.least(*sides) <= (NEAR + DROP) // 3


class Hot:
    """Seeds that very many documents have: their occurrences are dealt to ranges of the documents' order."""

    def __init__(self, seeds_: np.ndarray):
        self.seeds = np.sort(seeds_)

    def salts(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The range ``own`` of each document, from 1, for hot seeds, and 0 for others."""
        if not len(self.seeds):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        return np.where(self.seeds[at] == h, own, 0).astype(np.int32)


NONE_HOT = Hot(np.zeros(0, np.uint64))


def _seed_rows(turn_of: int | None, hot: Hot):
    """mapInArrow: (k, t, text, range) -> (h, k, t, p, near, salt), one row for each seed whose h is ``turn_of`` modulo
    PASSES (all where it is None).

    The n-th time a seed stands in a document, it is a seed of its own: so a text that repeats
    itself is matched turn by turn.  Turns are also counted anew after BREAK words without the seed,
    so every copy of a passage is matched with the first one, too.
    """

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(2))
            for i, j in textvec.chunks(offsets):
                with np.errstate(over="ignore"):
                    words = textvec.Words(data, offsets[i : j + 1])
                    at, h = seeds(words)
                    turn, anew = _turns(words.doc[at], h, at)
                    more = np.flatnonzero(turn != anew)
                    h = textvec.mix(np.concatenate([h + turn * textvec._MULT, h[more] + anew[more] * textvec._MULT]))
                    at = np.concatenate([at, at[more]])
                    if turn_of is not None:
                        own = h % np.uint64(PASSES) == turn_of
                        at, h = at[own], h[own]
                    doc, near = words.doc[at], surroundings(words, at)
                    salt = hot.salts(h, batch.column(3).to_numpy()[i:j][doc])
                p = (at - words.first[doc]).astype(np.int32)
                for a in range(0, len(at), SEED_ROWS):
                    part = slice(a, a + SEED_ROWS)
                    rows = pa.array(doc[part] + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[part].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(p[part]), pa.array(near[part].view(np.int64)), pa.array(salt[part])],
                        names=SEED,
                    )

    return run


SEED = ["h", "k", "t", "p", "near", "salt"]


def _repeated(batches):
    """mapInArrow over rows sorted by h and salt: those whose h and salt another row has, and all of hot seeds."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held[0], table])
        h, salt = (table.column(c).to_numpy() for c in ("h", "salt"))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (salt[1:] == salt[:-1]), [False]])
        keep = same[1:] | same[:-1] | (salt > 0)
        # The last row may be met by the next batch.
        last = bool(keep[-1])
        if held is not None:
            keep[0] = keep[0] and not held[1]
        yield from table.take(pa.array(np.flatnonzero(keep))).combine_chunks().to_batches()
        held = table.slice(len(h) - 1, 1), last


def _changed(column: pa.Array) -> np.ndarray:
    """Where a column's value differs from the one before; the first counts as different."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type) and not column.null_count:
        codes = column.to_numpy(zero_copy_only=False)
    else:
        codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return new


MATCH = ["k", "t", "ck", "ct", "p", "q", "h", "n", "near", "salt", "bits"]


def _linked(batches):
    """mapInArrow over (h, k, t, p, near, salt) sorted by h, salt, k, t, p -> MATCH: every later occurrence with
    the first one of its seed, n earlier documents having it; near: their surroundings are alike.

    Rows stream past: only the first and the last occurrence of a seed are held from batch to batch.
    All occurrences of hot seeds are told, with the first one and the n of their range of documents, and their surroundings.
    """
    held, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        new = _changed(table.column("h")) | _changed(table.column("salt"))
        doc = new | _changed(table.column("k")) | _changed(table.column("t"))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank = np.cumsum(doc)
        n = rank - rank[first]
        salt = table.column("salt").to_numpy()
        told = (n > 0) | (salt > 0)
        near = table.column("near").to_numpy().view(np.uint64)
        if held is not None:
            told[:2] = False
            n[first == 0] += before - n[1]
        at = np.flatnonzero(told)
        rows, firsts = table.take(pa.array(at)), table.take(pa.array(first[at]))
        columns = [rows.column("k"), rows.column("t"), firsts.column("k"), firsts.column("t"), rows.column("p"), firsts.column("p"), rows.column("h")]
        bits = pa.array(near[at].view(np.int64), mask=salt[at] == 0)
        more = [pa.array(n[at].astype(np.int64)), pa.array(_alike(near[at], near[first[at]])), rows.column("salt").combine_chunks(), bits]
        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in columns], *more], names=MATCH)
        held, before = pa.concat_tables([table.slice(int(first[-1]), 1), table.slice(len(new) - 1, 1)]), int(n[-1])


# ---------------------------------------------------------------- chaining


def segments(p: np.ndarray, q: np.ndarray, size: int = K) -> np.ndarray:
    """Matches (p, q) of ``size`` words of one pair of texts merged along diagonals: rows (p, q, length), by p."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    diagonal = p - q
    new = np.ones(len(p), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (p[1:] - p[:-1] > W + size)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    out = np.stack([p[at], q[at], p[last] - p[at] + size], axis=1)
    return out[np.argsort(out[:, 0], kind="stable")]


class Fenwick:
    """Prefix maxima over 0..n-1, with what attained them."""

    def __init__(self, n: int):
        self.best, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def raise_to(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.who[i] = value, who
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        value, who = float("-inf"), -1
        i += 1
        while i > 0:
            if self.best[i] > value:
                value, who = self.best[i], self.who[i]
            i -= i & -i
        return value, who


def _nearby(p: int, q: int, ending: list[int], done: int, score: list[float], end_p: list[int], end_q: list[int]) -> tuple[float, int]:
    """The best predecessor of (p, q) within MAX_GAP on both sides, where the best of all lies too far off."""
    value, who = float("-inf"), -1
    while done > 0:
        done -= 1
        e = ending[done]
        if end_p[e] < p - MAX_GAP:
            break
        if q - MAX_GAP <= end_q[e] <= q and score[e] + GAP_COST * (end_p[e] + end_q[e]) > value:
            value, who = score[e] + GAP_COST * (end_p[e] + end_q[e]), e
    return value, who


def chains(segs: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of segments (p, q, length), best first, each segment in one chain.

    A chain's value is the words in its segments less GAP_COST for each word in a gap on either
    side; no gap is longer than MAX_GAP.
    """
    n = len(segs)
    if n == 1:
        return [segs]
    start_p, start_q, length = segs[:, 0].tolist(), segs[:, 1].tolist(), segs[:, 2].tolist()
    end_p, end_q = (segs[:, 0] + segs[:, 2]).tolist(), (segs[:, 1] + segs[:, 2]).tolist()
    places = sorted(set(end_q))
    rank = {y: i for i, y in enumerate(places)}
    slot = np.searchsorted(places, start_q, "right") - 1
    tree = Fenwick(len(places))
    score, back = [0.0] * n, [-1] * n
    # Events by p: a segment is offered to others only where it has ended.
    ending = sorted(range(n), key=lambda i: end_p[i])
    done = 0
    for i in range(n):
        while done < n and end_p[ending[done]] <= start_p[i]:
            e = ending[done]
            # Segments later in order may end earlier; each is scored before it can end.
            tree.raise_to(rank[end_q[e]], score[e] + GAP_COST * (end_p[e] + end_q[e]), e)
            done += 1
        score[i] = float(length[i])
        if slot[i] >= 0:
            value, who = tree.upto(int(slot[i]))
            if who >= 0 and (start_p[i] - end_p[who] > MAX_GAP or start_q[i] - end_q[who] > MAX_GAP):
                value, who = _nearby(start_p[i], start_q[i], ending, done, score, end_p, end_q)
            value -= GAP_COST * (start_p[i] + start_q[i])
            if who >= 0 and value > 0:
                score[i], back[i] = score[i] + value, who
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(segs[chain[::-1]])
    return out


def _by_group(batches, names: tuple[str, ...], of):
    """What ``of`` makes of whole groups of rows with equal ``names`` in sorted batches."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if tail is not None and tail.num_rows:
            table = pa.concat_tables([tail, table])
        table = table.combine_chunks()
        edge = _borders(table, names)
        # The last group may go on in the next batch.
        yield from of(table.slice(0, edge[-2]), edge[:-1])
        tail = table.slice(edge[-2])
    if tail is not None and tail.num_rows:
        yield from of(tail, np.array([0, tail.num_rows]))


def _borders(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for name in names:
        new |= _changed(table.column(name))
    return np.append(np.flatnonzero(new), table.num_rows)


CHAINS = "a int, b int, c int, d int, segs binary"


def _blocks(rows: np.ndarray, cols: np.ndarray) -> pa.Array:
    """Equally long rows of numbers as binaries."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (cols * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _chained(size: int, least: int):
    """mapInArrow over matches sorted by (k, t, ck, ct): chains of each pair of documents, kind 0, and, for
    seeds of K words, the places of kind 1 that ``_rare`` picks: a the place, c and d the run's ends, h the seed.

    A chain of one seed grows along its diagonal only, so of the words on one side it takes NEAR or
    more: it is passed over where the surroundings are not alike.
    """
    screened = size == K and least - K >= 2 * NEAR

    def of(table: pa.Table, edge: np.ndarray):
        if not table.num_rows:
            return
        p, q = (table.column(c).to_numpy().astype(np.int64) for c in ("p", "q"))
        pair = np.flatnonzero(np.logical_or.reduce([_changed(table.column(c)) for c in ("k", "t", "ck", "ct")]))
        pair = np.append(pair, table.num_rows)
        lone = np.diff(pair) == 1
        near = table.column("near").combine_chunks().to_numpy(zero_copy_only=False) if screened else np.ones(len(p), bool)
        # One match is a chain: what it grows to is measured after the growth only.
        at = pair[:-1][lone]
        at = at[near[at]]
        yield chain_rows(table, at, np.stack([p[at], p[at] + size, q[at], q[at] + size], axis=1), _blocks(np.stack([p[at], q[at], np.full(len(at), size)], axis=1).astype("<i4"), 3))
        rows, spans, segs = [], [], []
        for a, b in zip(pair[:-1][~lone].tolist(), pair[1:][~lone].tolist(), strict=True):
            for chain in chains(segments(p[a:b], q[a:b], size)):
                end = chain[-1]
                if len(chain) == 1 and end[2] == size and not near[a:b][(p[a:b] == end[0]) & (q[a:b] == end[1])].any():
                    continue
                rows.append(a)
                spans.append([chain[0][0], end[0] + end[2], chain[0][1], end[1] + end[2]])
                segs.append(chain.astype("<i4").tobytes())
        yield chain_rows(table, np.array(rows, np.int64), np.array(spans, np.int64).reshape(-1, 4), pa.array(segs, pa.binary()))
        if size == K:
            doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            at, lo, hi = _rare(doc, p, table.column("n").to_numpy(), least)
            rows = table.take(pa.array(at))
            none = pa.nulls(len(at), pa.int32())
            of_run = [pa.array(x.astype(np.int32)) for x in (lo, hi)]
            columns = [*[rows.column(c).combine_chunks() for c in ("k", "t", "ck", "ct", "p")], none, *of_run, pa.nulls(len(at), pa.binary()), rows.column("h").combine_chunks()]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), *columns], names=NAMES)

    def chain_rows(table, at, spans, segs):
        rows = table.take(pa.array(at))
        columns = [rows.column(c).combine_chunks() for c in ("k", "t", "ck", "ct")]
        spans = [pa.array(spans[:, i].astype(np.int32)) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), *columns, *spans, segs, pa.nulls(len(at), pa.int64())], names=NAMES)

    return lambda batches: _by_group(batches, ("k", "t"), of)


NAMES = ["kind", "k", "t", "ck", "ct", "a", "b", "c", "d", "segs", "h"]


def _rare(doc: np.ndarray, p: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of matches (document, place, earlier documents that have the seed): which to look at again, and their runs.

    A run is a stretch of seeds that all are repeated.  A window of ``least`` words that an earlier
    document has lies in one, less W - 1 words at each end whose seeds depend on what is beyond.
    The words are cut into blocks so short that such a window holds a whole one, and the rarest
    seed of every block is told.
    """
    sure = least - 2 * (W - 1)
    block = (sure + 1) // 2
    if block < K + W - 1:
        raise ValueError(f"passages of {least} words are too short to be found by their seeds")
    order = np.lexsort((n, p, doc))
    d, at = doc[order], p[order]
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (at[1:] - at[:-1] > W)
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    lo, hi = at[head][run], at[np.append(head[1:], len(at)) - 1][run] + K
    fine = (hi - lo >= sure) & (at % block <= block - K)
    order, run, lo, hi, number = order[fine], run[fine], lo[fine], hi[fine], at[fine] // block
    pick = np.lexsort((p[order], n[order], number, run))
    first = np.ones(len(pick), bool)
    first[1:] = (run[pick][1:] != run[pick][:-1]) | (number[pick][1:] != number[pick][:-1])
    pick = pick[first]
    return order[pick], lo[pick], hi[pick]


def _window_rows(least: int, hot: Hot):
    """mapInArrow: (k, t, text, places, range) -> (h, k, t, p, near, salt): the runs of ``least`` words that hold a seed at one of the places.

    Equal runs of a text less than APART words apart are told once: so a text that repeats itself has few.
    """

    def run(batches):
        for batch in batches:
            data, offsets = textvec.text_buffer(batch.column(2))
            places = batch.column(3).to_pylist()
            for i, j in textvec.chunks(offsets):
                with np.errstate(over="ignore"):
                    words = textvec.Words(data, offsets[i : j + 1])
                    at, h, doc = [], [], []
                    up, down = textvec.powers(len(words.hash) + 1)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[: len(words.hash)], dtype=np.uint64)])
                    for d in range(i, j):
                        a, b = int(words.first[d - i]), int(words.first[d - i + 1])
                        starts = (np.array(places[d], np.int64)[:, None] - np.arange(least - K + 1)).ravel()
                        starts = np.unique(starts[(starts >= 0) & (starts <= b - a - least)]) + a
                        own = textvec.mix((total[starts + least] - total[starts]) * down[starts])
                        order = np.lexsort((starts, own))
                        keep, last, value = [], -APART, None
                        for o in order.tolist():
                            if own[o] != value or starts[o] - last >= APART:
                                keep.append(o)
                                last, value = starts[o], own[o]
                        at.append(starts[keep] - a)
                        h.append(own[keep])
                        doc.append(np.full(len(keep), d))
                at, h, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, h, doc))
                rows, h = pa.array(doc.astype(np.int64)), h.astype(np.uint64)
                salt = hot.salts(h, batch.column(4).to_numpy()[doc.astype(np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int64)), pa.array(salt)],
                    names=SEED,
                )

    return run


# ---------------------------------------------------------------- alignment


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        new = row.copy()
        hit = np.flatnonzero(y == w)
        new[hit + 1] = row[hit] + 1
        row = np.maximum.accumulate(np.maximum(new, row))
    return int(row[-1])


def _grown(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two runs of words go together from their start, and how many words agree there."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(top - score > DROP)
    end = int(stop[0]) if len(stop) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    size = int(score[:end].argmax()) + 1
    return size, int(same[:size].sum())


#: An insertion or deletion of so many words at most is grown over where so many of the words after it agree.
SHIFT, AFTER, AGREE = 3, 8, 6


def _grown_over(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """As ``_grown``, over insertions and deletions too: words of x, words of y, and how many agree."""
    i = j = same = 0
    while True:
        n, more = _grown(x[i:], y[j:])
        i, j, same = i + n, j + n, same + more
        best, skip = AGREE - 1, None
        for s in [(a, b) for a in range(SHIFT + 1) for b in range(SHIFT + 1) if a != b]:
            left, right = x[i + s[0] : i + s[0] + AFTER], y[j + s[1] : j + s[1] + AFTER]
            if len(left) == len(right) == AFTER and (left == right).sum() > best:
                best, skip = int((left == right).sum()), s
        if skip is None:
            return i, j, same
        i, j = i + skip[0], j + skip[1]


def widened(x: np.ndarray, y: np.ndarray, x0: int, y0: int, span: list[int], same: int) -> tuple[list[int], int]:
    """An aligned span with ``same`` equal words, grown at both ends over insertions and deletions."""
    a, b, c, d = span
    left, up, more = _grown_over(x[: a - x0][::-1], y[: c - y0][::-1])
    right, down, rest = _grown_over(x[b - x0 :], y[d - y0 :])
    return [a - left, b + right, c - up, d + down], same + more + rest


def align(x: np.ndarray, y: np.ndarray, x0: int, y0: int, segs: np.ndarray, span: list[int]) -> tuple[list[int], int]:
    """The chain's span (a, b, c, d), grown at both ends, and how many of its words agree.

    x and y hold word hashes from word x0 and y0 on.
    """
    a, b, c, d = span
    left, same = _grown(x[: a - x0][::-1], y[: c - y0][::-1])
    right, more = _grown(x[b - x0 :], y[d - y0 :])
    same += more
    at_p, at_q = a, c
    for p, q, n in segs.tolist():
        skip = max(at_p - p, at_q - q, 0)
        p, q, n = p + skip, q + skip, n - skip
        if n <= 0:
            continue
        same += _common(x[at_p - x0 : p - x0], y[at_q - y0 : q - y0])
        same += int((x[p - x0 : p + n - x0] == y[q - y0 : q + n - y0]).sum())
        at_p, at_q = p + n, q + n
    same += _common(x[at_p - x0 : b - x0], y[at_q - y0 : d - y0])
    return [a - left, b + right, c - left, d + right], same


def _pieces(x: np.ndarray, y: np.ndarray, x0: int, y0: int, segs: np.ndarray) -> np.ndarray:
    """The runs of equal words in a chain: rows (p, q, length), none overlapping on either side."""
    out, at_p, at_q = [], 0, 0
    for p, q, n in segs.tolist():
        skip = max(at_p - p, at_q - q, 0)
        p, q, n = p + skip, q + skip, n - skip
        if n <= 0:
            continue
        same = np.concatenate([[False], x[p - x0 : p + n - x0] == y[q - y0 : q + n - y0], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        out += [(p + int(i), q + int(i), int(j - i)) for i, j in edge]
        at_p, at_q = p + n, q + n
    return np.array(out, np.int64).reshape(-1, 3)


def _most(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far two runs of words may be grown so that they end on a word that agrees, and how many agree up to there."""
    n, _ = _grown(x, y)
    same = x[:n] == y[:n]
    return np.append(0, np.flatnonzero(same) + 1), np.append(0, np.cumsum(same)[same])


def _grow(x, y, x0, y0, span, same, least, percent) -> tuple[list[int], int] | None:
    """The longest growth of a span with ``same`` equal words that is long and similar enough."""
    a, b, c, d = span
    left, more = _most(x[: a - x0][::-1], y[: c - y0][::-1])
    right, rest = _most(x[b - x0 :], y[d - y0 :])
    total = same + more[:, None] + rest[None, :]
    grown = left[:, None] + right[None, :]
    fits = (100 * total >= percent * (max(b - a, d - c) + grown)) & (b - a + grown >= least)
    if not fits.any():
        return None
    i, j = np.unravel_index(int(np.where(fits, grown, -1).argmax()), fits.shape)
    return [a - int(left[i]), b + int(right[j]), c - int(left[i]), d + int(right[j])], int(total[i, j])


def found_in(x: np.ndarray, y: np.ndarray, x0: int, y0: int, segs: np.ndarray, span: list[int], least: int, percent: int) -> list[tuple[list[int], int]]:
    """The passages in a chain: itself, or else its longest parts that are long and similar enough."""
    whole, same = align(x, y, x0, y0, segs, span)
    if whole[1] - whole[0] >= least and 100 * same >= percent * max(whole[1] - whole[0], whole[3] - whole[2]):
        return [(whole, same)]
    wide, more = widened(x, y, x0, y0, whole, same)
    if wide[1] - wide[0] >= least and 100 * more >= percent * max(wide[1] - wide[0], wide[3] - wide[2]):
        return [(wide, more)]
    runs, out = _pieces(x, y, x0, y0, segs), []
    if not len(runs):
        return out
    p, q, n = runs.T
    gaps = zip((p + n)[:-1].tolist(), p[1:].tolist(), (q + n)[:-1].tolist(), q[1:].tolist(), strict=True)
    between = [0 if b - a == d - c == 1 else _common(x[a - x0 : b - x0], y[c - y0 : d - y0]) for a, b, c, d in gaps]
    upto = np.cumsum(n)
    upto[1:] += np.cumsum(np.array(between, np.int64))
    todo = [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        # The longest similar stretch of runs; its rests are looked at on their own.
        best, at = 0, None
        for i in range(lo, hi):
            if max(p[hi - 1] + n[hi - 1] - p[i], q[hi - 1] + n[hi - 1] - q[i]) <= best:
                break
            longest = np.maximum(p[i:hi] + n[i:hi] - p[i], q[i:hi] + n[i:hi] - q[i])
            fits = np.flatnonzero(100 * (upto[i:hi] - upto[i] + n[i]) >= percent * longest)
            if longest[fits[-1]] > best:
                best, at = int(longest[fits[-1]]), (i, i + int(fits[-1]) + 1)
        if at is None:
            continue
        i, j = at
        span = [int(p[i]), int(p[j - 1] + n[j - 1]), int(q[i]), int(q[j - 1] + n[j - 1])]
        grown = _grow(x, y, x0, y0, span, int(upto[j - 1] - upto[i] + n[i]), least, percent)
        if grown is not None:
            out.append(grown)
        todo += [part for part in ((lo, i), (j, hi)) if part[0] < part[1]]
    # Growth may take in the rests' passages.
    out.sort(key=lambda o: (o[0][0], -o[0][1]))
    return [o for i, o in enumerate(out) if not any(w[0][0] <= o[0][0] and o[0][1] <= w[0][1] for w in out[:i])]


def _windows(batches):
    """mapInArrow: (k, t, text, wants) -> (k, t, lo, hi, words): hashes of the words lo..hi of a text."""
    for batch in batches:
        data, offsets = textvec.text_buffer(batch.column(2))
        wants = batch.column(3).to_pylist()
        for i, j in textvec.chunks(offsets):
            with np.errstate(over="ignore"):
                words = textvec.Words(data, offsets[i : j + 1])
            row, lo, hi, out = [], [], [], []
            for d in range(i, j):
                own = words.hash[words.first[d - i] : words.first[d - i + 1]]
                for want in wants[d]:
                    row.append(d)
                    lo.append(want["lo"])
                    hi.append(want["hi"])
                    # Half of each hash is enough to compare two words, and half the bytes.
                    out.append(own[max(want["lo"], 0) : want["hi"]].astype("<u4").tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(out, pa.binary())],
                names=["k", "t", "lo", "hi", "words"],
            )


def _likely(batch: pa.RecordBatch, least: int, percent: int) -> np.ndarray:
    """Which chains may hold a passage: of those of one segment, the ones with enough equal words near its diagonal.

    Such a chain grows along its diagonal or, over insertions and deletions, beside it.  On each side of its start the words
    are compared at shifts up to SHIFT; the best of both sides together must be what a passage of ``least`` words needs.
    """
    n = batch.num_rows
    sides = []
    for name in ("x", "y"):
        column = batch.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        sides.append((np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4"), (offsets - offsets[0]) // 4))
    (x, xs), (y, ys) = sides
    sizes = np.frombuffer(batch.column("segs").buffers()[1], np.int32)[batch.column("segs").offset :][: n + 1]
    lone = np.flatnonzero(np.diff(sizes) == 12)
    a, c, lo, clo = (batch.column(name).to_numpy().astype(np.int64)[lone] for name in ("a", "c", "lo", "clo"))
    x0, y0 = np.maximum(lo, 0), np.maximum(clo, 0)
    x_end, y_end = x0 + np.diff(xs)[lone], y0 + np.diff(ys)[lone]

    def equal(start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Equal words at places start..end of x and shift beyond them of y."""
        start = np.maximum(np.maximum(start, x0), y0 - shift)
        size = np.maximum(np.minimum(np.minimum(end, x_end), y_end - shift) - start, 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        left = np.repeat(xs[lone] + start - x0, size) + inside
        right = np.repeat(ys[lone] + start + shift - y0, size) + inside
        same = np.concatenate([[0], np.cumsum(x[left] == y[right])])
        return same[upto[1:]] - same[upto[:-1]]

    before = after = np.zeros(len(lone), np.int64)
    for s in range(-SHIFT, SHIFT + 1):
        before, after = np.maximum(before, equal(x0, a, c - a + s)), np.maximum(after, equal(a, x_end, c - a + s))
    likely = np.ones(n, bool)
    likely[lone] = 100 * (before + after) >= percent * least
    return np.flatnonzero(likely)


def _aligned(least: int, percent: int):
    """mapInArrow: chains with the words of both sides -> passages."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            likely = pa.array(_likely(batch, least, percent))
            batch = pa.Table.from_batches([batch]).take(likely).combine_chunks()
            rows, spans, share = [], [], []
            for i, r in enumerate(batch.select(["a", "b", "c", "d", "segs", "lo", "clo", "x", "y"]).to_pylist()):
                x, y = np.frombuffer(r["x"], "<u4"), np.frombuffer(r["y"], "<u4")
                segs = np.frombuffer(r["segs"], "<i4").reshape(-1, 3)
                for span, same in found_in(x, y, max(r["lo"], 0), max(r["clo"], 0), segs, [r["a"], r["b"], r["c"], r["d"]], least, percent):
                    rows.append(i)
                    spans.append(span)
                    share.append(same / max(span[1] - span[0], span[3] - span[2]))
            at, spans = pa.array(rows, pa.int64()), np.array(spans, np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).combine_chunks().take(at) for c in ("k", "t", "ck", "ct")], *[pa.array(spans[:, j]) for j in range(4)], pa.array(share, pa.float64())],
                names=["k", "t", "ck", "ct", "start", "end", "source_start", "source_end", "similarity"],
            )

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, text): a document is named by its key and a hash of its text."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("k"), F.hash(value).alias("t"), value.alias("text"))


def _range_edges(docs: DataFrame, key: str) -> DataFrame:
    """One row with ``edges``: the keys that cut a bounded sample of the documents into SALTS ranges of about as many each."""
    some = docs.select(F.col(key).alias("k")).orderBy(F.xxhash64("k")).limit(100 * SALTS)
    edges = some.agg(F.sort_array(F.collect_list(F.struct("k"))).alias("ks")).select(
        F.transform(F.sequence(F.lit(1), F.lit(SALTS - 1)), lambda i: F.get("ks", F.floor(i * F.size("ks") / SALTS).cast("int"))).alias("edges")
    )
    return scratch.keep(edges, "range-edges")


def _in_ranges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``range``, 1 to SALTS: which range of the documents' order each lies in."""
    above = F.size(F.filter("edges", lambda e: e <= F.struct("k")))
    return rows.join(F.broadcast(edges)).withColumn("range", (above + 1).cast("int")).drop("edges")  # one row


def _hot_seeds(rows: DataFrame, seeds_of, shape: str) -> Hot:
    """The most frequent seeds of a sample of the documents; ``seeds_of`` makes a mapInArrow of the hot seeds known."""
    sample = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(seeds_of(NONE_HOT), shape).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow()  # 8 bytes each
    return Hot(top.column("h").to_numpy().view(np.uint64))


def _meetings(found: DataFrame, kind: str, hot: Hot) -> DataFrame:
    """(k, t, ck, ct, p, q, h, n, near) of seeds (h, k, t, p, near, salt): the later occurrences, each with the first one.

    The occurrences of a hot seed are ranked within ranges of the documents' order.  The first occurrence of all is that of
    the first range that has one, and the documents of the ranges before are added to the rank: just as without ranges.
    """
    shape = f"k {kind}, t int, ck {kind}, ct int, p int, q int, h long, n long, near boolean, salt int, bits long"
    # Most seeds stand once: they go before the rows are put in the order of documents.
    again = found.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_repeated, found.schema)
    out = scratch.keep(again.sortWithinPartitions("h", "salt", "k", "t", "p").mapInArrow(_linked, shape), "matches")
    scratch.release(found.sparkSession)
    plain = out.where("salt = 0").drop("salt", "bits")
    if not len(hot.seeds):
        return plain
    parts = out.where("salt > 0")
    facts = parts.groupBy("h", "salt").agg((F.max("n") + 1).alias("docs"), F.min(F.struct("k", "t", "p", "bits")).alias("f"))
    order = Window.partitionBy("h").orderBy("salt")  # SALTS rows at most
    facts = facts.select(
        "h", "salt", F.coalesce(F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.first("f").over(order).alias("f")
    )
    facts = scratch.keep(facts, "hot-firsts")
    parts = parts.join(facts.hint("merge"), ["h", "salt"]).withColumn("n", F.col("n") + F.col("before")).where("n > 0")
    near = alike(F.col("bits"), F.col("f.bits"))
    parts = parts.select("k", "t", F.col("f.k").alias("ck"), F.col("f.t").alias("ct"), "p", F.col("f.p").alias("q"), "h", "n", near.alias("near"))
    return plain.unionByName(scratch.keep(parts, "hot-matches"))


def _chains(matches: DataFrame, kind: str, size: int, least: int) -> DataFrame:
    """Chains (kind 0) and rare places (kind 1) of matches, by document."""
    sorted_ = matches.repartition("k", "t").sortWithinPartitions("k", "t", "ck", "ct")
    shape = f"kind int, k {kind}, t int, ck {kind}, ct int, {CHAINS}, h long"
    out = scratch.keep(sorted_.mapInArrow(_chained(size, least), shape), "chains")
    scratch.release(matches.sparkSession)
    return out


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document has too, by at least ``percent``.

    Columns: k, t (the document), start, end (its words, from 0), ck, ct, source_start, source_end
    (the earlier one), similarity (words that agree, over the longer side).  Earlier means a
    smaller key.  Words are runs without ASCII white space, lower-cased in A-Z.  ``min_words`` is 22 at least.
    """
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = _keyed(docs, key, text)
    shape = f"h long, k {kind}, t int, p int, near long, salt int"
    edges = _range_edges(docs, key)
    ranged = _in_ranges(rows, edges)
    hot = _hot_seeds(ranged, lambda hot: _seed_rows(None, hot), shape)
    parts = [_meetings(ranged.mapInArrow(_seed_rows(i, hot), shape), kind, hot) for i in range(PASSES)]
    matches = functools.reduce(DataFrame.unionByName, parts)
    chained = _chains(matches, kind, K, min_words)
    one = scratch.keep(_verified(rows, chained.where("kind = 0"), kind, min_words, percent), "passages")

    rare = chained.where("kind = 1").select("k", "t", F.col("a").alias("p"), "h", F.col("c").alias("lo"), F.col("d").alias("hi"))
    own = scratch.keep(_open(rare, one, min_words).select("h").distinct(), "open-seeds")
    if own.isEmpty():
        return _longest(one)
    # Where those seeds stand: later places are in matches, and the first ones in what these point to.
    places = matches.select("h", "k", "t", "p").unionByName(matches.select("h", F.col("ck").alias("k"), F.col("ct").alias("t"), F.col("q").alias("p")))
    places = places.join(own.hint("merge"), "h", "left_semi").groupBy("k", "t").agg(F.collect_set("p").alias("places"))
    texts = _in_ranges(_texts(rows, scratch.keep(places, "places"), "places"), edges)
    hot = _hot_seeds(texts, lambda hot: _window_rows(min_words, hot), shape)
    whole = _meetings(texts.mapInArrow(_window_rows(min_words, hot), shape), kind, hot)
    two = _verified(rows, _chains(whole, kind, min_words, min_words), kind, min_words, percent)
    return _longest(one.unionByName(scratch.keep(two, "passages")))


def _texts(rows: DataFrame, wanted: DataFrame, places: str) -> DataFrame:
    """(k, t, text) of the documents in ``wanted`` (k, t and a list of places), with that list."""
    # What is wanted grows with the corpus; little of it is not worth a shuffle of all texts.
    few = (wanted.agg(F.sum(F.size(places) + 1).alias("n")).first()["n"] or 0) <= FEW
    wanted = wanted.select(F.col("k").alias("_k"), F.col("t").alias("_t"), places).hint("broadcast" if few else "merge")
    return rows.join(wanted, F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t"))).select("k", "t", "text", places)


def _longest(found: DataFrame) -> DataFrame:
    """Of passages of the same two documents, one in the other, the longer; of equal ones the first in the source."""
    order = Window.partitionBy("k", "t", "ck", "ct").orderBy("start", F.desc("end"), "source_start")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("upto", upto).where("upto is null or upto < end").drop("upto")


def _open(rare: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """The seeds whose windows, as far as their runs go, are not in one passage."""
    reach = min_words - K
    spans = found.select(F.col("k").alias("_k"), F.col("t").alias("_t"), "start", "end")
    inside = (F.col("start") <= F.greatest(F.col("lo"), F.col("p") - reach)) & (F.col("end") >= F.least(F.col("hi"), F.col("p") + K + reach))
    return rare.join(spans.hint("merge"), F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")) & inside, "left_anti")


def _verified(rows: DataFrame, candidates: DataFrame, kind: str, min_words: int, percent: int) -> DataFrame:
    """The passages in candidate chains (k, t, ck, ct, a, b, c, d, segs), by the words around them on both sides."""
    names = f"k {kind}, t int, ck {kind}, ct int"
    candidates = candidates.select("k", "t", "ck", "ct", "a", "b", "c", "d", "segs").withColumns(
        {"lo": F.col("a") - MARGIN, "hi": F.col("b") + MARGIN, "clo": F.col("c") - MARGIN, "chi": F.col("d") + MARGIN}
    )
    wants = candidates.select("k", "t", "lo", "hi").unionByName(
        candidates.select(F.col("ck").alias("k"), F.col("ct").alias("t"), F.col("clo").alias("lo"), F.col("chi").alias("hi"))
    )
    wants = scratch.keep(wants.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("wants")), "wants")
    windows = _texts(rows, wants, "wants").mapInArrow(_windows, f"k {kind}, t int, lo int, hi int, words binary").dropDuplicates(["k", "t", "lo", "hi"])
    windows = scratch.keep(windows, "windows")
    for names_of, out in ((("k", "t", "lo", "hi"), "x"), (("ck", "ct", "clo", "chi"), "y")):
        side = windows.select(*[F.col(w).alias(f"_{w}") for w in ("k", "t", "lo", "hi")], F.col("words").alias(out))
        match = F.col(names_of[0]).eqNullSafe(F.col("_k"))
        for own, other in zip(names_of[1:], ("_t", "_lo", "_hi"), strict=True):
            match = match & (F.col(own) == F.col(other))
        candidates = candidates.join(side.hint("merge"), match).drop("_k", "_t", "_lo", "_hi")
    columns = ["k", "t", "ck", "ct", "a", "b", "c", "d", "segs", "lo", "clo", "x", "y"]
    schema = f"{names}, start int, end int, source_start int, source_end int, similarity double"
    return candidates.select(*columns).mapInArrow(_aligned(min_words, percent), schema)


def shared_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each passage of a document that an earlier one has too.

    (key, start, end, source_<key>, source_start, source_end, n_words, similarity).  Defined cases:
    null texts count as empty; rows equal in key and text count as one document; rows with equal
    keys and other texts are documents of their own, ordered by a hash of the text; a null key is
    earlier than any other; repeats inside one document are no passages; other columns are not
    read; an empty table gives no rows.
    """
    found = passages(docs, key, text, min_words, percent)
    return found.select(
        F.col("k").alias(key), "start", "end", F.col("ck").alias(f"source_{key}"), "source_start", "source_end",
        (F.col("end") - F.col("start")).alias("n_words"), "similarity",
    )


def _cut(at: int, wants: int):
    """mapInArrow: rows with word ranges in their last column -> the rows, their texts without those words."""

    def run(batches):
        for batch in batches:
            cuts = batch.column(wants).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, ranges in enumerate(cuts):
                if not ranges:
                    continue
                data, offsets = textvec.text_buffer(pa.array([texts[i]], pa.string()))
                with np.errstate(over="ignore"):
                    words = textvec.Words(data, offsets)
                raw, kept, upto = texts[i].encode(), [], 0
                for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
                    a, b = int(words.start[r["start"]]), int(words.start[r["end"]]) if r["end"] < len(words.start) else len(raw)
                    if b <= upto:
                        continue
                    kept.append(raw[upto : max(a, upto)])
                    upto = b
                texts[i] = b"".join([*kept, raw[upto:]]).decode()
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(wants)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:wants])

    return run


def cut_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the passages that an earlier document has; every row and column stays.

    A text that is one such passage becomes empty, a null text stays null.  Rows equal in key and
    text are cut alike.  Columns may have any names; an empty table gives an empty one.
    """
    found = passages(docs, key, text, min_words, percent)
    k, t, spans = (scratch.unused(docs, n) for n in ("cut_key", "cut_text", "cut_spans"))
    cuts = found.groupBy("k", "t").agg(F.collect_set(F.struct("start", "end")).alias(spans)).withColumnsRenamed({"k": k, "t": t})
    cuts = scratch.keep(cuts, "cuts")
    own = F.hash(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = docs.join(cuts.hint("merge"), F.col(key).eqNullSafe(F.col(k)) & (own == F.col(t)), "left").drop(k, t)
    return joined.mapInArrow(_cut(docs.columns.index(text), len(docs.columns)), docs.schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
