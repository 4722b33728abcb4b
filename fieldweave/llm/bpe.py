"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted, and the driver compiles the frequent ones and their ids (or,
without a corpus, the vocabulary's own words) into an automaton in which equal suffixes share states; each arc carries a number, and the sum along a word's path is the word's place in the table of
ids.  The automaton is one blob of arrays that a Python worker writes to a nameless file once and maps
into memory.

A batch of texts is split into words in numpy; the distinct words walk the automaton in lockstep,
and words it does not hold are merged exactly, all at once: in each round every word applies its
merge of lowest rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Lone surrogates cannot occur in a text: they mark where a text ends and where a special token stood.
END, SPECIAL = 0xD800, 0xD801
#: Code points worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 21
#: Merged words each Python worker remembers, at most; a full memory starts anew.
MEMORY = 1 << 18
#: The most frequent words of a corpus that the lexicon holds.
FREQUENT = 1 << 16
#: Words that one task counts before it hands its counts on.
COUNTED = 1 << 17
#: Longer words (in code points) are not compiled.
WORD_CHARS = 64
#: Words of more symbols are merged one by one with a heap.
LONG = 200
NONE = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


# ---------------------------------------------------------------- integer map in arrays


class PairMap:
    """Map from pairs of small whole numbers to whole numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - (len(keys).bit_length() - 1))

    @staticmethod
    def build(left, right, value, room: float = 2.0) -> PairMap:
        """``room`` slots at least for each pair: more of them are found faster and take more space."""
        key = (np.asarray(left, np.int64) << np.int64(21)) | np.asarray(right, np.int64)
        value = np.asarray(value, np.int64)
        bits = max(int(len(key) * room).bit_length(), 4)
        keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot = ((key.astype(np.uint64) * textvec._MULT) >> np.uint64(64 - bits)).astype(np.int64)
        left_over = np.arange(len(key))
        while len(left_over):
            at = slot[left_over]
            free = np.flatnonzero(keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            put = left_over[free[one]]
            keys[slot[put]], values[slot[put]] = key[put], value[put]
            left_over = np.setdiff1d(left_over, put, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & ((1 << bits) - 1)
        return PairMap(keys, values)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none."""
        key = (left << np.int64(21)) | right
        slot = ((key.astype(np.uint64) * textvec._MULT) >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], -1)
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


# ---------------------------------------------------------------- transducer


def compile_lexicon(words: list[str]) -> tuple[np.ndarray, ...]:
    """Minimal acyclic transducer of sorted distinct words: arcs (state, code point, next, output), final.

    The outputs along a word's path add up to its place in ``words``.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # per registered state: (final, ((code point, state), ...))
    counts: list[int] = []

    def settle(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        found = register.get(shape)
        if found is None:
            found = register[shape] = len(arcs)
            arcs.append(shape)
            counts.append(node[0] + sum(counts[s] for _, s in shape[1]))
        return found

    path = [[0, []]]  # open nodes along the last word: [final, arcs]
    last = ""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((ord(last[len(path) - 1]), settle(node)))
        for _ in word[common:]:
            path.append([0, []])
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((ord(last[len(path) - 1]), settle(node)))
    root = settle(path[0])
    rows = []
    for state, (final, out) in enumerate(arcs):
        before = final
        for cp, target in out:
            rows.append((state, cp, target, before))
            before += counts[target]
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table, np.array([f for f, _ in arcs], np.int64), np.array([root], np.int64)


# ---------------------------------------------------------------- blocks of arrays

LEXICON = ("arc_keys", "arc_values", "final", "root", "word_ids", "word_from")


def _block(arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    head, parts, at = {"meta": meta, "arrays": {}}, [], 0
    for name, x in arrays.items():
        head["arrays"][name] = (str(x.dtype), len(x), at)
        parts.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def _arrays(data: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, (dtype, n, at) in head["arrays"].items():
        at += 8 + size
        out[name] = data[at : at + n * np.dtype(dtype).itemsize].view(dtype)
    return out, head["meta"]


# ---------------------------------------------------------------- the tokenizer


class Tokenizer:
    """Arrays of one byte-level BPE tokenizer; ``Tokenizer.load`` reads the JSON of the tokenizers library."""

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict):
        self.a, self.meta = arrays, meta
        self.merges = PairMap(arrays["merge_keys"], arrays["merge_values"])
        self.new_id = arrays["merge_ids"]
        self._forget()
        if "arc_keys" in arrays:
            self.arcs = PairMap(arrays["arc_keys"], arrays["arc_values"])

    # ---- compiling

    @staticmethod
    def load(path: str) -> Tokenizer:
        """Compiles the tokenizer at ``path``, without a lexicon."""
        with open(path, "rb") as f:
            return Tokenizer.compiled(f.read())

    @staticmethod
    def compiled(source: bytes) -> Tokenizer:
        """Compiles a tokenizer's file, without a lexicon."""
        spec = json.loads(source)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        usable = [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges if x in vocab and y in vocab and x + y in vocab]
        ranks = {}
        for rank, (x, y, z) in enumerate(usable):
            ranks[x, y] = (rank, z)
        left, right = np.array(list(ranks), np.int64).T
        pairs = PairMap.build(left, right, [r for r, _ in ranks.values()])
        merge_ids = np.zeros(len(usable), np.int64)
        for rank, z in ranks.values():
            merge_ids[rank] = z
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens: list[str] = [""] * (max([*vocab.values(), *specials.values()]) + 1)
        for t, i in [*vocab.items(), *specials.items()]:
            tokens[i] = t
        classes, lower = code_point_tables()
        arrays = {
            "merge_keys": pairs.keys, "merge_values": pairs.values, "merge_ids": merge_ids, "classes": classes,
            "first": np.array([vocab.get(c, -1) for c in chars], np.int64),
            "last": np.array([vocab.get(c + suffix, -1) for c in chars], np.int64),
        }
        word_split = spec["normalizer"] is not None
        if word_split:
            arrays["lower"] = lower
        meta = {"specials": specials, "tokens": tokens, "word_split": word_split, "plain": spec["decoder"] is None}
        # The vocabulary's own words, spelled as they stand in texts.
        byte_of, own = {c: b for b, c in enumerate(chars)}, set()
        for t in vocab:
            if suffix and not t.endswith(suffix):
                continue
            try:
                own.add(bytes(byte_of[c] for c in t.removesuffix(suffix)).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        meta["words"] = sorted(w for w in own if w)
        return Tokenizer(arrays, meta)

    def with_words(self, words: list[str] | None = None) -> Tokenizer:
        """This tokenizer with a lexicon of ``words``; without them, of the vocabulary's own."""
        lexicon = sorted({w for w in (self.meta["words"] if words is None else words) if w})
        table, final, root = compile_lexicon(lexicon)
        ids, counts = self.merge_words(lexicon)
        arcs = PairMap.build(table[:, 0], table[:, 1], table[:, 2] << np.int64(21) | table[:, 3], 1.25)
        arrays = self.a | {
            "arc_keys": arcs.keys, "arc_values": arcs.values, "final": final.astype(np.int8), "root": root,
            "word_ids": ids.astype(np.int32), "word_from": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
        }
        return Tokenizer(arrays, self.meta)

    def blobs(self) -> tuple[bytes, bytes]:
        """The lexicon, for a file to map, and everything else: each a header and arrays in one block of bytes."""
        lexicon = {k: x for k, x in self.a.items() if k in LEXICON}
        meta = {k: x for k, x in self.meta.items() if k != "words"}
        return _block(lexicon, {}) if lexicon else b"", _block({k: x for k, x in self.a.items() if k not in LEXICON}, meta)

    @staticmethod
    def mapped(blobs: tuple[bytes, bytes]) -> Tokenizer:
        """A tokenizer whose lexicon is a memory-mapped file."""
        arrays, meta = _arrays(np.frombuffer(blobs[1], np.uint8))
        if not blobs[0]:
            return Tokenizer(arrays, meta)
        # The file has no name, so nothing is left of it when the process ends.
        with tempfile.TemporaryFile() as f:
            f.write(blobs[0])
            f.flush()
            mapped = np.memmap(f, np.uint8, "r")
        lexicon, _ = _arrays(np.asarray(mapped))
        return Tokenizer(arrays | lexicon, meta)

    # ---- encoding

    def code_points(self, texts: list[str]) -> np.ndarray:
        """The texts as one array of code points, each closed by END, normalised where the tokenizer does."""
        for k, content in enumerate(self.meta["specials"]):
            if any(content in t for t in texts):
                texts = [t.replace(content, chr(SPECIAL + k)) for t in texts]
        if self.meta["word_split"]:
            texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
            texts = [t.replace("İ", "i̇") if "İ" in t else t for t in texts]
        mark = chr(END)
        cps = np.frombuffer((mark.join(texts) + mark).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.a["lower"][cps] if self.meta["word_split"] else cps

    def spans(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words start and end."""
        cls = self.a["classes"][cps]
        n = len(cps)
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = EDGE, cls[:-1]
        if self.meta["word_split"]:
            start = (cls != prev) | (cls == NUMBER)
        else:
            start = cls != prev
            after_space = np.zeros(n, bool)
            after_space[1:] = cps[:-1] == 32
            start &= ~(after_space & (cls != SPACE) & (cls != EDGE))
            # The last white space of a run before a word starts anew (alone, or leading the word).
            nxt = np.empty(n, np.uint8)
            nxt[-1], nxt[:-1] = EDGE, cls[1:]
            start |= (cls == SPACE) & (nxt != SPACE) & (nxt != EDGE)
        start |= cls == EDGE
        start[1:] |= cls[:-1] == EDGE
        self._contractions(cps, cls, start)
        at = np.flatnonzero(start)
        ends = np.append(at[1:], n)
        keep = cls[at] != SPACE if self.meta["word_split"] else np.ones(len(at), bool)
        keep &= cps[at] != END
        return at[keep], ends[keep]

    @staticmethod
    def _contractions(cps, cls, start) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a word are words of their own."""
        quote = np.flatnonzero((cps == 39) & start)
        quote = quote[quote + 2 < len(cps)]
        if not len(quote):
            return
        a, b = cps[quote + 1], cps[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 1] = False
        start[quote[two] + 3] = True

    def served(self, texts: list[str]) -> tuple[int, int]:
        """Of how many word occurrences the lexicon knows the word, and of how many there are."""
        cps = self.code_points(texts)
        start, end = self.spans(cps)
        state = np.full(len(start), self.a["root"][0])
        for step in range(int((end - start).max(initial=0))):
            live = np.flatnonzero((state >= 0) & (end - start > step))
            got = self.arcs.find(state[live], cps[start[live] + step].astype(np.int64))
            state[live] = np.where(got < 0, -1, got >> np.int64(21))
        return int(((state >= 0) & (self.a["final"][np.maximum(state, 0)] == 1)).sum()), len(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (with the end)."""
        cps = self.code_points(texts)
        start, end = self.spans(cps)
        closed = np.flatnonzero(cps == END)
        text_of = np.searchsorted(start, closed)
        with np.errstate(over="ignore"):
            head, inverse, keys = self._distinct(cps, start, end)
        ids, counts = self._lookup(cps, start[head], end[head], *(k[head] for k in keys))
        first = np.concatenate([[0], np.cumsum(counts)])
        size = counts[inverse]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(first[:-1][inverse] - upto[:-1], size) + np.arange(upto[-1])]
        return flat, np.concatenate([[0], upto[text_of]])

    @staticmethod
    def _distinct(cps, start, end) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """One word of each kind, the kind of every word, and both hashes.  Told apart by 128 bits of hash and the length."""
        up, down = textvec.powers(len(cps) + 1)
        total = np.zeros(len(cps) + 1, np.uint64)
        keys = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            value = (cps.astype(np.uint64) + np.uint64(seed)) * np.uint64(seed | 1)
            value ^= value >> np.uint64(29)
            np.cumsum(value * up[: len(cps)], out=total[1:])
            keys.append(textvec.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        _, head, inverse = np.unique(keys[0], return_index=True, return_inverse=True)
        if (keys[1][head][inverse] != keys[1]).any():
            both = np.stack(keys, axis=1)
            _, head, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        return head, inverse, keys

    def _forget(self) -> None:
        self.memory = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.memory_ids, self.memory_size = [np.zeros(0, np.int64)], 0

    def _remembered(self, cps, start, end, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """``_merge``, but words merged before (equal in both hashes) are taken from memory."""
        known, check, at, size = self.memory
        place = np.minimum(np.searchsorted(known, h1), max(len(known) - 1, 0))
        hit = (known[place] == h1) & (check[place] == h2) if len(known) else np.zeros(len(h1), bool)
        miss = np.flatnonzero(~hit)
        own, own_counts = self._merge(cps, start[miss], end[miss])
        counts, source = np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        old = np.flatnonzero(hit)
        counts[old], source[old] = size[place[old]], at[place[old]]
        base = self.memory_size
        counts[miss], source[miss] = own_counts, base + np.cumsum(own_counts) - own_counts
        store = np.concatenate([*self.memory_ids, own])
        upto = np.cumsum(counts)
        inside = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - counts, counts)
        out = store[np.repeat(source, counts) + inside]
        if len(known) + len(miss) > MEMORY:
            self._forget()
        elif len(miss):
            order = miss[np.argsort(h1[miss], kind="stable")]
            fresh = np.searchsorted(known, h1[order])
            taken = known[np.minimum(fresh, len(known) - 1)] == h1[order] if len(known) else np.zeros(len(order), bool)
            order, fresh = order[~taken], fresh[~taken]
            self.memory = [np.insert(x, fresh, y[order]) for x, y in zip(self.memory, (h1, h2, source, counts), strict=True)]
            self.memory_ids, self.memory_size = [store], len(store)
        return out, counts

    def _lookup(self, cps, start, end, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of words given by their places in cps."""
        n = len(start)
        state = np.full(n, self.a["root"][0])
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        step = 0
        length = end - start
        while len(live):
            got = self.arcs.find(state[live], cps[start[live] + step].astype(np.int64))
            lost = got < 0
            state[live[lost]] = -1
            live, got = live[~lost], got[~lost]
            state[live] = got >> np.int64(21)
            place[live] += got & np.int64((1 << 21) - 1)
            step += 1
            live = live[length[live] > step]
        known = (state >= 0) & (self.a["final"][np.maximum(state, 0)] == 1)
        counts = np.zeros(n, np.int64)
        first = self.a["word_from"]
        hit = np.flatnonzero(known)
        counts[hit] = first[place[hit] + 1] - first[place[hit]]
        rest = np.flatnonzero(~known)
        special = self.a["classes"][cps[start[rest]]] == EDGE
        marks, rest = rest[special], rest[~special]
        counts[marks] = 1
        own, own_counts = self._remembered(cps, start[rest], end[rest], h1[rest], h2[rest])
        counts[rest] = own_counts
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(upto[-1], np.int64)
        for rows, source, source_from in (
            (hit, self.a["word_ids"], first[place[hit]]),
            (rest, own, np.cumsum(own_counts) - own_counts),
        ):
            c = counts[rows]
            inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            ids[np.repeat(upto[rows], c) + inside] = source[np.repeat(source_from, c) + inside]
        if len(marks):
            special_ids = np.array(list(self.meta["specials"].values()), np.int64)
            ids[upto[marks]] = special_ids[cps[start[marks]] - SPECIAL]
        return ids, counts

    # ---- exact merging

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of whole words by merging alone."""
        length = np.array([len(w) for w in words], np.int64)
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        end = np.cumsum(length)
        return self._merge(cps, end - length, end)

    def _merge(self, cps, start, end) -> tuple[np.ndarray, np.ndarray]:
        n = len(start)
        length = end - start
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        own = cps[np.repeat(start, length) + inside]
        raw = np.frombuffer(own.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        wide = 1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
        size = np.zeros(n, np.int64)
        if n:
            size = np.add.reduceat(wide, np.cumsum(length) - length)
        ids = self.a["first"][raw]
        tail = np.cumsum(size) - 1
        ids[tail] = self.a["last"][raw[tail]]
        word = np.repeat(np.arange(n), size)
        counts = np.zeros(n, np.int64)
        done_ids, done_words = [], []
        long = size > LONG
        if long.any():
            for w in np.flatnonzero(long):
                got = self._merge_one(ids[tail[w] - size[w] + 1 : tail[w] + 1])
                done_ids.append(got)
                done_words.append(np.full(len(got), w))
            short = ~long[word]
            ids, word = ids[short], word[short]
        while len(ids):
            rank = np.full(len(ids), NONE)
            joined = np.flatnonzero(word[1:] == word[:-1])
            got = self.merges.find(ids[joined], ids[joined + 1])
            rank[joined] = np.where(got < 0, NONE, got)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, head)
            width = np.diff(np.append(head, len(ids)))
            over = np.repeat(least == NONE, width)
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
            pick = (rank == np.repeat(least, width)) & ~over
            # Of overlapping picks (a pair of equal symbols in a row) every other one counts.
            at = np.flatnonzero(pick)
            if len(at) > 1:
                new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            ids[at] = self.new_id[rank[at]]
            stay = ~over
            stay[at + 1] = False
            ids, word = ids[stay], word[stay]
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)

    def _merge_one(self, ids: np.ndarray) -> np.ndarray:
        """One long word with a heap of candidate merges, lowest rank first, then leftmost."""
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.merges.find(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(ids):
                pair = (ids[i], ids[j])
                if pair not in known:
                    known[pair] = int(self.merges.find(np.array(pair[:1], np.int64), np.array(pair[1:], np.int64))[0])
                if known[pair] >= 0:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else len(ids)
            if j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j] = int(self.new_id[rank]), -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    # ---- decoding

    def decoder(self):
        """ids -> text, as the library decodes with special tokens kept."""
        tokens = np.array([t.encode() for t in self.meta["tokens"]], object)
        if self.meta["plain"]:
            return lambda ids: b" ".join(tokens[ids].tolist()).decode()
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        special = set(self.meta["specials"].values())
        raw = np.array([t.encode() if i in special else bytes(byte_of[c] for c in t) for i, t in enumerate(self.meta["tokens"])], object)
        return lambda ids: b"".join(raw[ids].tolist()).decode("utf-8", "replace")


def code_point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point, as the tokenizers library sees them."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    every = np.array(every)
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
        for _, (a, b) in found:
            classes[every[a:b]] = kind
    classes[0xD800:0xE000] = EDGE
    lower = np.arange(0x110000, dtype=np.uint32)
    kept = every[every != 0x130]
    small = normalizers.Lowercase().normalize_str(text.replace("İ", ""))
    lower[kept] = np.frombuffer(small.encode("utf-32-le"), np.uint32)
    return classes, lower


# ---------------------------------------------------------------- DataFrames

_loaded: dict[str, Tokenizer] = {}


def tokenizer_of(shared) -> Tokenizer:
    """The tokenizer of ``share``, mapped once per Python worker and told apart by its content."""
    name, *blobs = shared.value
    if name not in _loaded:
        _loaded[name] = Tokenizer.mapped(tuple(blobs))
    return _loaded[name]


def text_runs(column: pa.Array, size: int = CHUNK) -> Iterator[list[str]]:
    """The texts of a column in lists of about ``size`` characters; null counts as empty."""
    run, upto = [], 0
    for t in column:
        t = t.as_py() or ""
        if run and upto + len(t) > size:
            yield run
            run, upto = [], 0
        run.append(t)
        upto += len(t)
    if run:
        yield run


class Counter:
    """Word counts of texts, words told apart by 64 bits of hash; special tokens and overlong words are left out."""

    def __init__(self, tokenizer: Tokenizer):
        self.tok, self.words, self.hashes = tokenizer, [], np.zeros(0, np.uint64)
        self.place, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        cps = self.tok.code_points(texts)
        start, end = self.tok.spans(cps)
        with np.errstate(over="ignore"):
            head, inverse, keys = self.tok._distinct(cps, start, end)
        n, size = np.bincount(inverse, minlength=len(head)), end[head] - start[head]
        fine = (size <= WORD_CHARS) & (self.tok.a["classes"][cps[start[head]]] != EDGE)
        head, n = head[fine], n[fine]
        h, first = np.unique(keys[0][head], return_index=True)
        n = np.bincount(np.searchsorted(h, keys[0][head]), n, len(h)).astype(np.int64)
        at = np.searchsorted(self.hashes, h)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), bool)
        np.add.at(self.counts, self.place[at[known]], n[known])
        fresh = np.flatnonzero(~known)
        whole = cps.tobytes().decode("utf-32-le", "surrogatepass")
        self.place = np.insert(self.place, at[fresh], len(self.words) + np.arange(len(fresh)))
        self.hashes = np.insert(self.hashes, at[fresh], h[fresh])
        self.counts = np.concatenate([self.counts, n[fresh]])
        own = head[first[fresh]]
        self.words += [whole[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.words), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(self.words[a : a + (1 << 14)], pa.string()), pa.array(self.counts[a : a + (1 << 14)])], names=["word", "n"])


def _shared(spark, path: str, words: list[str] | None = None, lexicon: bool = True):
    """The tokenizer at ``path``, broadcast.  It is compiled in a task: that takes some 300 MB for a moment, which the driver may not have."""
    with open(path, "rb") as f:
        source = f.read()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokenizer = Tokenizer.compiled(source)
                first, rest = (tokenizer.with_words(words) if lexicon else tokenizer).blobs()
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([rest], pa.binary())], names=["lexicon", "rest"])

    row = spark.range(0, 1, 1, 1).mapInArrow(run, "lexicon binary, rest binary").first()
    blobs = bytes(row["lexicon"]), bytes(row["rest"])
    name = hashlib.blake2b(blobs[0] + blobs[1], digest_size=16).hexdigest()
    return spark.sparkContext.broadcast((name, *blobs))


def share(spark, path: str, words: list[str] | None = None):
    """The tokenizer at ``path`` (read on the driver only), broadcast, with a lexicon of ``words`` (the vocabulary's own)."""
    return _shared(spark, path, words)


def share_for(docs: DataFrame, path: str, text: str = "text", frequent: int = FREQUENT):
    """The tokenizer at ``path`` with the ``frequent`` most frequent words of ``docs`` as its lexicon, broadcast.

    All words of all texts are counted; only the chosen ones reach the driver.
    """
    spark = docs.sparkSession
    counts = scratch.keep(word_counts(docs, _shared(spark, path, lexicon=False), text), "word-counts")
    return _shared(spark, path, _top_words(counts, frequent))


#: Steps between a power of two and the next one, by which counts are told apart at first.
STEPS = 256


def _top_words(counts: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent words of (word, n), without sending more of them to the driver than that.

    A histogram of the counts gives the least count that all fit above; of the words of that step
    as many as there is room for are taken by a hash.
    """
    level = F.char_length(F.bin("n")) - 1
    power = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    step = F.floor((F.col("n") - power) * STEPS / power).cast("int")
    placed = counts.withColumn("rank", level * STEPS + step)
    sizes = placed.groupBy("rank").agg(F.count(F.lit(1)).alias("c")).collect()  # 64 * STEPS rows at most
    room, cut, share = most, 0, 1.0
    for r in sorted(sizes, key=lambda r: -r["rank"]):
        if r["c"] > room:
            cut, share = r["rank"], room / r["c"]
            break
        room -= r["c"]
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    top = placed.where((F.col("rank") > cut) | ((F.col("rank") == cut) & chosen)).select("word", "n").collect()
    return [r["word"] for r in sorted(top, key=lambda r: (-r["n"], r["word"]))[:most]]


def word_counts(docs: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """(word, n): the words of all texts, as ``tokenizer`` splits them, of at most WORD_CHARS code points."""
    scratch.prepare(docs.sparkSession)

    def run(batches):
        count = Counter(tokenizer_of(tokenizer))
        for batch in batches:
            for texts in text_runs(batch.column(0)):
                count.add(texts)
                if len(count.words) > COUNTED:
                    yield from count.rows()
                    count = Counter(count.tok)
        yield from count.rows()

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, tokenizer, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids[, text]): ids as little-endian unsigned 32-bit numbers, for every row of ``docs``.

    ``tokenizer`` comes from ``share`` or ``share_for``.  With ``decoded`` the ids are decoded in the
    same task, as ``decode`` does it.  Special tokens are recognised in texts, none are added.
    Defined cases: null and empty texts give no ids; rows with equal keys stay apart; other
    columns are not read; an empty table gives no rows.
    """
    scratch.prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        tok = tokenizer_of(tokenizer)
        read = tok.decoder() if decoded else None
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1)):
                flat, first = tok.encode(texts)
                flat, edges = flat.astype("<u4"), list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                columns = [batch.column(0).slice(at, len(texts)), pa.array([flat[a:b].tobytes() for a, b in edges], pa.binary())]
                if decoded:
                    columns.append(pa.array([read(flat[a:b]) for a, b in edges], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "text"][: len(columns)])
                at += len(texts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary" + ", text string" * decoded).withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokenizer, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text) of a table (key, ids) as ``encode`` makes it.

    Defined cases: null and empty ids give an empty text; null and repeated keys pass through row by
    row; other columns are not read; an empty table gives no rows.
    """
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        read = tokenizer_of(tokenizer).decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([read(np.frombuffer(x or b"", "<u4")) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["key", "ids", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, text string").withColumnRenamed("key", key)


def op2_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokenizer = share_for(docs, public_tokenizers.path("word_bpe_49k.json"))
    out = encode(docs, tokenizer, decoded=True)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
