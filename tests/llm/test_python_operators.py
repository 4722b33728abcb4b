"""The operators with Python stages, each against brute force or the library it must equal."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldweave.llm import bpe, embed_dedup, graph, near_dedup, packing, substring_dedup, textvec, toxicity

DOCS = "doc_id long, text string, lang string, key string, node string, n_shingles long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, None, "k", "n", 1) for k, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def components_by_hand(keys, links):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {k: root(k) for k in keys}


# ---------------------------------------------------------------- words and graphs


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aAbÉ \t\n \x0b.\0", max_size=20), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = textvec.text_buffer(pa.array(texts, pa.string()))
    with np.errstate(over="ignore"):
        w = textvec.Words(data, offsets)
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    want = [x for t in texts for x in words_of(t)]
    assert got == want
    assert w.doc.tolist() == [i for i, t in enumerate(texts) for _ in words_of(t)]
    same = {}
    for x, h in zip(want, w.hash.tolist(), strict=True):
        assert same.setdefault(x, h) == h
    assert len(set(same.values())) == len(same)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(7, 7), (300, 299), (300, 299)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_by_hand({x for e in edges for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near duplicates


def near_by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    links = [
        (rows[i][0], rows[j][0])
        for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    part = components_by_hand([key for key, _ in rows], links)
    return sorted((key, len(s), part[key], part[key] == key) for (key, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("leaders", [1, near_dedup.LEADERS])
def test_near_dedup_against_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    for _ in range(12):
        base = prose(rng, 120)
        for edits in (0, 0, 1, 3, 5, 8, 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    out = near_dedup.near_dedup(table(spark, rows), k=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == near_by_hand(rows, 4, 80)


def test_near_dedup_of_nothing_and_of_null_and_repeated_keys(spark):
    assert near_dedup.near_dedup(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, "g h"), (7, "a b c d e f"), (7, "z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (None, 1, None, False), (7, 2, 7, True), (7, 1, 7, True)], key=str)


def test_sketches_never_rule_out_a_pair_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in (3, 40, 400, 5000):
        for _ in range(40):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            shared = -(-n * 8 // 10)
            cut = shared + (n - shared) // 2
            a, b = np.sort(both[:cut]), np.sort(np.concatenate([both[:shared], both[cut:]]))
            x, y = (np.frombuffer(near_dedup.bin_sketch(s), np.uint8) for s in (a, b))
            assert near_dedup.plausible(x, y, np.array(len(a) + len(b)), 0.8)


# ---------------------------------------------------------------- shared passages


def test_shared_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passage, fuzzy_from = prose(rng, 70), prose(rng, 90)
    fuzzy = [w if i % 9 else "y%d" % i for i, w in enumerate(fuzzy_from)]
    rows = [
        (1, prose(rng, 60) + passage + prose(rng, 40)), (2, prose(rng, 30) + passage + prose(rng, 55)), (3, prose(rng, 200)),
        (4, fuzzy_from + prose(rng, 20)), (5, prose(rng, 25) + fuzzy), (6, passage[:30] + prose(rng, 80)), (7, passage),
        (8, ["the"] * 90), (9, ["the"] * 80), (10, prose(rng, 3)),
    ]
    docs = table(spark, [(k, " ".join(w).replace("w1 ", "W1 ")) for k, w in rows] + [(11, None), (12, ""), (None, "short text")])
    got = {(r.doc_id, r.source_doc_id): r for r in substring_dedup.shared_passages(docs).collect()}
    assert set(got) == {(2, 1), (7, 1), (5, 4), (9, 8)}
    r = got[2, 1]
    assert (r.start, r.end, r.source_start, r.source_end, r.similarity) == (30, 100, 60, 130, 1.0)
    assert 0.8 <= got[5, 4].similarity < 1 and got[5, 4].n_words >= 80
    cut = {r.doc_id: r for r in substring_dedup.cut_passages(docs).collect()}
    assert len(cut) == 13 and cut[11].text is None and cut[2].node == "n"
    w2 = dict(rows)[2]
    assert words_of(cut[2].text) == w2[:30] + w2[100:]
    assert cut[7].text == "" and words_of(cut[1].text) == dict(rows)[1] and words_of(cut[6].text) == dict(rows)[6]


def test_no_passages_of_nothing_and_one_result_for_repeated_rows(spark):
    assert substring_dedup.shared_passages(table(spark, [])).count() == 0
    rng = random.Random(1)
    text = " ".join(prose(rng, 60))
    got = substring_dedup.shared_passages(table(spark, [(1, text), (2, text), (2, text)])).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2, 1)}
    assert [r.text for r in substring_dedup.cut_passages(table(spark, [(1, text), (2, text), (2, text)])).orderBy("doc_id").collect()] == [text, "", ""]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 6)), min_size=1, max_size=8))
def test_chains_are_collinear_and_use_each_segment_once(segs):
    segs = np.array(sorted(set(segs)), np.int64)
    found = substring_dedup.chains(segs)
    assert sorted(map(tuple, np.concatenate(found).tolist())) == sorted(map(tuple, segs.tolist()))
    best = 0
    for chain in found:
        for a, b in itertools.pairwise(chain.tolist()):
            assert a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1]
            assert b[0] - a[0] - a[2] <= substring_dedup.MAX_GAP
        gaps = sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in itertools.pairwise(chain.tolist()))
        best = max(best, chain[:, 2].sum() - substring_dedup.GAP_COST * gaps)
    assert best >= segs[:, 2].max()


def test_a_copy_whose_seeds_first_stand_in_several_documents_is_found(spark):
    rng = random.Random(24)
    own = lambda: prose(rng, 60, 10**6)
    docs = []
    for _ in range(10):
        p = prose(rng, 70, 10**6)
        for words in (p[:40], p[30:], p, p):  # no seed stands first in the third
            docs.append((len(docs), " ".join(own() + words + own())))
    got = {(r.doc_id, r.source_doc_id, r.start, r.end) for r in substring_dedup.shared_passages(table(spark, docs)).collect()}
    assert got == {(4 * i + 3, 4 * i + 2, 60, 130) for i in range(10)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_shared_run_of_50_words_is_covered_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # every seed that two documents have is dealt to parts
        monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
        monkeypatch.setattr(substring_dedup, "HOT", 2)
        monkeypatch.setattr(substring_dedup, "SALTS", 3)
    # Documents are pasted from slices of a few texts: first occurrences lie scattered, and most slices are too short.
    rng = random.Random(seed)
    bases = [prose(rng, 120, 10**6) for _ in range(3)] + [prose(rng, 7, 9) * 12, ["la"] * 90]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            base, size = rng.choice(bases), rng.choice([8, 20, 35, 44, 49, 50, 51, 55, 62, 80])
            at = rng.randrange(max(len(base) - size, 0) + 1)
            words += prose(rng, rng.choice([0, 1, 3, 30]), 10**6) + base[at : at + size]
        docs.append((i, words))
    seen, missed, shared = set(), [], 0
    covered = {}
    for r in substring_dedup.shared_passages(table(spark, [(k, " ".join(w)) for k, w in docs])).collect():
        assert r.source_doc_id < r.doc_id and r.n_words >= 50
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for k, w in docs:
        grams = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, g in enumerate(grams):
            if g in seen:
                shared += 1
                if len(set(g)) > 7 and not covered.get(k, set()).issuperset(range(i, i + 50)):
                    missed.append((k, i))
                elif not covered.get(k, set()) & set(range(i, i + 50)):
                    missed.append((k, i))
        seen.update(grams)
    assert shared > 50 and not missed


def test_both_ways_of_fetching_texts_agree(spark, monkeypatch):
    rng = random.Random(3)
    p = prose(rng, 60)
    docs = table(spark, [(i, " ".join(prose(rng, 30) + p + prose(rng, 30))) for i in range(4)] + [(None, " ".join(p))])
    got = []
    for few in (0, substring_dedup.FEW):
        monkeypatch.setattr(substring_dedup, "FEW", few)
        got.append({(r.doc_id, r.source_doc_id, r.start, r.end) for r in substring_dedup.shared_passages(docs).collect()})
    assert got[0] == got[1] >= {(i, None, 30, 90) for i in range(4)}


def test_links_do_not_depend_on_batches():
    rng = random.Random(2)
    rows = sorted((rng.choice([0, 1, 2, 3, 4, *range(50, 500)]), rng.randrange(8), rng.randrange(2), rng.randrange(50), 0, 0) for _ in range(300))
    cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
    whole = pa.RecordBatch.from_arrays(cols, names=substring_dedup.SEED)
    want, count = [], {}
    for h, k, t, p, *_ in rows:
        own = [r for r in rows if r[0] == h]
        count[h] = len(own)
        docs = sorted({r[1:3] for r in own})
        if (k, t) != docs[0]:
            want.append((k, t, own[0][1], own[0][2], p, own[0][3], h, docs.index((k, t)), True, 0, None))
    for size in (1, 2, 7, 300):
        parts = [whole.slice(i, size) for i in range(0, 300, size)]
        again = list(substring_dedup._repeated(parts))
        assert [tuple(r.values()) for b in again for r in b.to_pylist()] == [r for r in rows if count[r[0]] > 1]
        assert [tuple(r.values()) for b in substring_dedup._linked(again) for r in b.to_pylist()] == want


def fuzzy(rng, words):
    """The words with about one in ten substituted, inserted or deleted."""
    out = []
    for w in words:
        kind = rng.choice("sid") if rng.random() < 0.1 else ""
        out += {"": [w], "s": [f"x{rng.randrange(10**6)}"], "i": [w, f"x{rng.randrange(10**6)}"], "d": []}[kind]
    return out


def with_and_without(spark, monkeypatch, docs, **limits):
    """All passages with seeds of so many documents dealt to ranges, and without."""
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    found = []
    for hot in (limits.get("hot", 10), 10**6):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(substring_dedup, "SALTS", limits.get("salts", 32))
        rows = substring_dedup.shared_passages(table(spark, [(k, " ".join(w)) for k, w in docs])).collect()
        found.append({(r.doc_id, r.source_doc_id, r.start, r.end, r.source_start, r.source_end) for r in rows})
    return found


def test_copies_of_passages_whose_seeds_are_hot_are_found(spark, monkeypatch):
    rng, docs, pairs = random.Random(12), [], []
    own = lambda n: prose(rng, n, 10**6)
    for _ in range(12):
        p = own(68)
        pairs.append((len(docs) + 1, len(docs)))
        docs += [(len(docs), own(30) + p + own(30)), (len(docs) + 1, own(30) + p[:34] + own(3) + p[34:] + own(30))]
        docs += [(len(docs) + i, own(20) + p[:34] + own(20)) for i in range(40)]
    on, off = with_and_without(spark, monkeypatch, docs)
    assert on == off and {r[:2] for r in on} >= set(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_dealing_hot_seeds_and_windows_changes_nothing(spark, monkeypatch, seed):
    rng = random.Random(seed)
    own = lambda n: prose(rng, n, 10**6)
    bases = [own(90) for _ in range(4)]
    docs = []
    for i in range(90):
        words = own(rng.choice([0, 5, 30]))
        for _ in range(rng.randrange(1, 4)):
            base, size = rng.choice(bases), rng.choice([20, 45, 52, 70, 90])
            at = rng.randrange(len(base) - size + 1)
            part = base[at : at + size]
            words += (fuzzy(rng, part) if rng.random() < 0.4 else part) + own(rng.choice([1, 30]))
        docs.append((i, words))
    docs.append((None, bases[0]))
    on, off = with_and_without(spark, monkeypatch, docs, hot=2 + 6 * seed, salts=[3, 32][seed - 1])
    assert on == off and len(on) > 60


def test_passages_with_words_substituted_inserted_and_deleted_are_found(spark):
    rng, docs = random.Random(31), []
    own = lambda n: prose(rng, n, 10**6)
    while len(docs) < 300:
        p = own(60)
        q = fuzzy(rng, p)
        if substring_dedup._common(np.array(p), np.array(q)) >= 0.8 * max(len(p), len(q)):
            docs += [(len(docs), own(30) + p + own(30)), (len(docs) + 1, own(30) + q + own(30))]
    rows = substring_dedup.shared_passages(table(spark, [(k, " ".join(w)) for k, w in docs])).collect()
    assert all(r.similarity >= 0.8 and r.n_words >= 50 for r in rows)
    assert len({(r.doc_id, r.source_doc_id) for r in rows} & {(2 * i + 1, 2 * i) for i in range(150)}) >= 135


def test_surroundings_rule_out_only_what_cannot_grow():
    rng, passed = np.random.default_rng(4), 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 120, dtype=np.uint64)
        y = np.where(rng.random(120) < rng.choice([0.1, 0.3, 0.5, 1.0]), rng.integers(0, 2**63, 120, dtype=np.uint64), x)
        y[50:55] = x[50:55]
        class Words:  # noqa: E306
            pass
        a, b = Words(), Words()
        a.hash, b.hash = x << np.uint64(1), y << np.uint64(1)
        at = np.array([50])
        alike = substring_dedup._alike(substring_dedup.surroundings(a, at), substring_dedup.surroundings(b, at))[0]
        left, right = substring_dedup._grown(x[:50][::-1], y[:50][::-1])[0], substring_dedup._grown(x[55:], y[55:])[0]
        assert alike or max(left, right) < substring_dedup.NEAR
        passed += not alike
    assert passed > 80


def test_passages_with_a_word_changed_every_few_are_found(spark):
    rng = random.Random(23)
    docs, pairs = [], 0
    for every in (6, 7, 8):
        for at in range(20):
            p = prose(rng, 60, 10**6)
            q = [f"x{rng.randrange(10**6)}" if i % every == at % every else w for i, w in enumerate(p)]
            for words in (p, q):
                docs.append((len(docs), " ".join(prose(rng, 40, 10**6) + words + prose(rng, 40, 10**6))))
            pairs += 1
    got = {(r.doc_id, r.source_doc_id) for r in substring_dedup.shared_passages(table(spark, docs)).collect()}
    assert all(a == b + 1 and b % 2 == 0 for a, b in got) and len(got) >= 0.95 * pairs


def test_every_copy_of_a_passage_in_a_later_document_is_found(spark):
    rng = random.Random(22)
    p, own = prose(rng, 70, 10**6), lambda: prose(rng, 60, 10**6)
    docs = [(1, own() + p + own()), (2, own() + p + own() + p + own() + p), (3, own() + p[20:35] + own() + p), (4, own() + p[:40] + p)]
    docs += [(8, "go on " * 80), (9, "go on " * 80)]
    docs = [(k, w if isinstance(w, str) else " ".join(w)) for k, w in docs]
    got = {(r.doc_id, r.start, r.end) for r in substring_dedup.shared_passages(table(spark, docs)).collect()}
    assert got >= {(2, 60, 130), (2, 190, 260), (2, 320, 390), (3, 135, 205), (4, 100, 170), (9, 0, 160)}
    cut = {r.doc_id: words_of(r.text) for r in substring_dedup.cut_passages(table(spark, docs)).collect()}
    assert len(cut[2]) == 180 and len(cut[3]) == 135 and len(cut[4]) in range(95, 101) and cut[9] == []


def test_a_chain_that_is_not_similar_enough_is_split_at_its_gaps(spark):
    rng = random.Random(21)
    got = set()
    for first in range(0, 80, 2):
        base = prose(rng, 110, 10**6)
        docs = [(first, " ".join(base)), (first + 1, " ".join(base[:55] + prose(rng, 30, 10**6) + base[55:]))]
        got |= {(r.doc_id, r.start, r.end) for r in substring_dedup.shared_passages(table(spark, docs)).collect()} if first < 2 else set()
        x, y = (np.array([hash(w) for w in d.split()]).view(np.uint64) for d in (docs[1][1], docs[0][1]))
        segs = np.array([(4, 4, 45), (93, 63, 40)], np.int64)
        parts = substring_dedup.found_in(x, y, 0, 0, segs, [4, 133, 4, 103], 50, 80)
        assert [(span, same) for span, same in parts] == [([0, 55, 0, 55], 55), ([85, 140, 55, 110], 55)]
    assert got == {(1, 0, 55), (1, 85, 140)}


def test_a_chain_goes_on_from_a_weaker_predecessor_in_reach():
    # A long run far before, then a passage in two halves.
    segs = np.array([(0, 0, 500), (560, 560, 26), (587, 586, 26)], np.int64)
    assert sorted(map(len, substring_dedup.chains(segs))) == [1, 2]


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        lib.no_padding()
        lib.no_truncation()
        out[name] = (lib, bpe.Tokenizer.mapped(bpe.Tokenizer.load(public_tokenizers.path(name)).with_words().blobs()))
    return out


PARTS = ["'", "'s", "'ll", "'re ", "  ", "\n", "\n\n ", "\t", "a", "B", "É", "ß", "1", "23", "٣", "!", "..", "<|endoftext|>", "<|startoftext|>", "İ",
         "é", " ", "　", "漢字", "😀", "Ⅷ", "Σ", "don't", "I'M", "''s", " 's", "\x85", "\0", "\r\n", "hello", "aaaa"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(deadline=None, max_examples=60)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), min_size=1, max_size=5))
def test_encoding_and_decoding_equal_the_library(library, name, texts):
    lib, own = library[name]
    flat, first = own.encode(texts)
    read = own.decoder()
    for i, want in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        ids = flat[first[i] : first[i + 1]]
        assert ids.tolist() == want.ids
        assert read(ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_long_words_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 8)
    lib, own = library["byte_bpe_50k.json"]
    texts = ["a" * 3000, "ab" * 900, "x" * 250 + " y", "Zq" * 7, " ".join("q%dz" % i for i in range(50)), " ".join("q%dz" % i for i in range(40))]
    for _ in range(3):
        flat, first = own.encode(texts)
        for i, want in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
            assert flat[first[i] : first[i + 1]].tolist() == want.ids


@settings(deadline=None, max_examples=50)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=30))
def test_the_transducer_numbers_its_words(words):
    words = sorted(words)
    table_, final, root = bpe.compile_lexicon(words)
    arcs = {(s, c): (t, o) for s, c, t, o in table_.tolist()}
    for place, word in enumerate(words):
        state, total = int(root[0]), 0
        for ch in word:
            state, o = arcs[state, ord(ch)]
            total += o
        assert final[state] and total == place
    suffixes = {(w[i:]) for w in words for i in range(len(w) + 1)}
    assert len(final) <= len({frozenset(s[len(p) :] for s in words if s.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}) + 1
    assert suffixes


def test_frequent_words_of_a_corpus_are_compiled_and_serve_it(spark, library):
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.collect()]
    path = public_tokenizers.path("word_bpe_49k.json")
    served = {}
    for frequent in (1, bpe.FREQUENT):
        tok = bpe.tokenizer_of(bpe.share_for(docs, path, frequent=frequent))
        hit, every = np.sum([tok.served(texts[i : i + 200]) for i in range(0, len(texts), 200)], axis=0)
        served[frequent] = hit / every
    assert served[bpe.FREQUENT] >= 0.9 > served[1]
    lib = library["word_bpe_49k.json"][0]
    flat, first = tok.encode(texts[:100])
    for i, want in enumerate(lib.encode_batch(texts[:100], add_special_tokens=False)):
        assert flat[first[i] : first[i + 1]].tolist() == want.ids


def test_the_most_frequent_words_are_chosen_within_their_number(spark):
    rng = random.Random(6)
    counts = {f"w{i}": rng.choice([1, 1, 1, 2, 3, 5, 8, 1000, 10**9 + i]) for i in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    order = sorted(counts.values(), reverse=True)
    for most in (0, 1, 10, 400, 1500, 2999, 3000, 9999):
        got = bpe._top_words(df, most)
        assert len(got) == len(set(got)) <= most and len(got) >= 0.9 * min(most, 3000) - 3
        # Among words of about one count any may stand for another.
        assert not got or min(counts[w] for w in got) >= order[min(most, 3000) - 1] * 0.99
    assert bpe._top_words(df.where("n < 0"), 5) == []


def test_tokenizers_are_not_compiled_on_the_driver(spark, library, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = bpe.Tokenizer.load(path).with_words(["the", "and"]).blobs()
    with monkeypatch.context() as m:
        m.setattr(bpe.Tokenizer, "__init__", lambda *_: pytest.fail("compiled on the driver"))
        shared = bpe.share(spark, path, ["the", "and"])
    assert shared.value[1:] == want
    assert bpe.tokenizer_of(shared).encode(["the cat and é"])[0].tolist() == library["byte_bpe_50k.json"][0].encode("the cat and é", add_special_tokens=False).ids


def test_word_counts_cover_all_texts(spark, library, monkeypatch):
    import public_tokenizers

    shared = bpe.share(spark, public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "One two TWO<|endoftext|>two " + "x" * 100), (2, None), (3, ""), (3, "two one's")]
    for most in (bpe.COUNTED, 1):
        monkeypatch.setattr(bpe, "COUNTED", most)
        got = {r.word: r.n for r in bpe.word_counts(table(spark, rows), shared).collect()}
        assert got == {"one": 2, "two": 4, "'s": 1}
    assert bpe.word_counts(table(spark, []), shared).count() == 0


def test_encode_and_decode_tables(spark, library):
    import public_tokenizers

    shared = bpe.share(spark, public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Hello  World's é"), (2, None), (2, ""), (None, "<|endoftext|>x")]
    out = bpe.decode(bpe.encode(table(spark, rows), shared), shared).collect()
    lib = library["word_bpe_49k.json"][0]
    want = []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in out), key=str) == sorted(want, key=str)
    at_once = bpe.encode(table(spark, rows), shared, decoded=True).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in at_once), key=str) == sorted(want, key=str)
    assert bpe.encode(table(spark, []), shared).count() == 0


def test_workers_tell_tokenizers_apart(spark, library):
    import public_tokenizers

    rows = [(1, "Hello World's café 123")]
    for _ in range(4):
        for name, (lib, _) in library.items():
            ids = bpe.encode(table(spark, rows), bpe.share(spark, public_tokenizers.path(name))).first()["ids"]
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(rows[0][1], add_special_tokens=False).ids


# ---------------------------------------------------------------- packing


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_fills_bins_within_capacity(lengths):
    bins = packing.best_fit(np.array(lengths, np.int64), 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    loads = [sum(lengths[i] for i in b) for b in bins]
    assert all(x <= 20 for x in loads)
    assert sum(1 for x in loads if x <= 10) <= 1


def naive_best_fit(lengths, capacity):
    """Loads of the bins when each item, longest first, goes to the fullest bin with room for it."""
    loads = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(loads) if x + n <= capacity]
        if fits:
            loads[max(fits, key=lambda i: loads[i])] += n
        else:
            loads.append(n)
    return sorted(loads)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 64))
def test_best_fit_against_the_naive_one(lengths, capacity):
    bins = packing.best_fit(np.array(lengths, np.int64), capacity)
    assert sorted(sum(lengths[i] for i in b) for b in bins) == naive_best_fit(lengths, capacity)


def test_packing_in_rounds_is_about_as_good_as_in_one(spark, monkeypatch):
    rng = random.Random(31)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 40, 70, 99, 100]) for _ in range(1500)]
    items = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(lengths)], "id long, length int, item string, sequence_id int").repartition(16)
    best = len(packing.best_fit(np.array(lengths), 100))
    for most in (400_000, 100):
        monkeypatch.setattr(packing, "MOST_ITEMS", most)
        out = packing.pack(items, 100).collect()
        load = {}
        for r in out:
            load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
        assert sorted(r.id for r in out) == list(range(1500)) and max(load.values()) <= 100 and {r.item for r in out} == {"x"}
        assert best == len(naive_best_fit(lengths, 100)) and len(load) <= best * 1.01 + 1 and len(load) >= -(-sum(lengths) // 100)


def test_packing_places_every_token_once(spark, library):
    import public_tokenizers

    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, rng.choice([1, 3, 20, 60, 150])))) for i in range(120)] + [(500, None), (501, ""), (7, "again"), (None, "n")]
    shared = bpe.share(spark, public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(table(spark, rows).repartition(5), shared, capacity=256, with_ids=True).collect()
    lib = library["byte_bpe_50k.json"][0]
    ids = sorted(lib.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    by_doc, by_bin = {}, {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_bin.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    whole = []
    for k, own in by_doc.items():
        if k == 7:
            continue
        own.sort(key=lambda r: r.piece)
        assert all(r.length == 256 for r in own[1:]) and [r.start for r in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        whole.append(np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist())
    rest = [x for x in ids if x not in whole]
    assert len(whole) + len(rest) >= len(rows) - 1 and len(rest) <= 2
    total = sum(r.length for r in out)
    assert total == sum(map(len, ids)) and len(by_bin) <= 1.03 * len(packing.best_fit(np.array([r.length for r in out]), 256)) + 1
    assert packing.pack_documents(table(spark, []), shared).count() == 0


# ---------------------------------------------------------------- toxicity


def toxic_corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.choice([20, 80, 300]), 300)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "Moronic", "vilewort" + "xyz"[i % 3]]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus(random.Random(6), 400)
    docs, known = table(spark, rows + [(None, None), (900, "")]), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(toxicity.fold("doc_id") != 0))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[None] == got[900] < 0.5
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {k for k, s in got.items() if s < 0.5}


def test_repeated_keys_do_not_stretch_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"word{i % 2} text{i}") for i in range(600)], "doc_id long, text string").repartition(3)
    taken, dense = [], toxicity._dense
    monkeypatch.setattr(toxicity, "_dense", lambda lists, width: taken.append(len(lists)) or dense(lists, width))
    for sample in (1, 7):
        toxicity.fit(docs, spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, toxic int"), sample=sample)
    assert taken == [2, 14]


def test_toxicity_without_classes(spark):
    docs = table(spark, [(1, "a"), (2, "b")])
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    clean = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score(docs, clean).collect()) < 0.01
    assert toxicity.score(table(spark, []), none).count() == 0


def test_the_penalty_frees_group_names_from_blame(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        w = prose(rng, 40, 200)
        if i % 2:  # the group is named mostly where the text is vile, and vile words are not always there
            w.insert(5, "muslims")
            if i % 3:
                w.insert(9, "vermin")
        elif i % 10 == 0:
            w.insert(5, "christians")
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = table(spark, [(1, "the muslims met"), (2, "the christians met"), (3, "vermin")])
    gap = {}
    for penalty in (0.0, 10.0):
        s = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(docs, known, counterfactual=penalty)).collect()}
        gap[penalty] = abs(s[1] - s[2])
        assert s[3] > s[2]
    assert gap[10.0] < 0.5 * gap[0.0]


def test_features_are_the_words_and_their_beginnings():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Abc", "abcdefghij", "é", "ab", "abd", "über-alles", "x" * 40]) for _ in range(rng.randrange(9))) for _ in range(40)] + [None, ""]
    want = []
    for t in texts:
        words = [w.encode() for w in words_of(t)]
        want.append({(w, 0) for w in words} | {(w[:k], k) for w in words for k in toxicity.PREFIXES if len(w) > k})
    got = [set() for _ in texts]
    for i, _, values, docs in toxicity.text_features(pa.array(texts, pa.string())):
        for v, d in zip(values.tolist(), docs.tolist(), strict=True):
            got[i + d].add(v)
    assert list(map(len, got)) == list(map(len, want))
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(got[a] & got[b]) == len(want[a] & want[b])


def test_training_minimises_its_objective():
    rng = np.random.default_rng(2)
    x, y = (rng.random((200, 6)) < 0.4).astype(np.float32), (rng.random(200) < 0.3).astype(int)
    c = rng.normal(size=(30, 6))
    change = c.T @ c / 30
    w, b = toxicity.train(x, y, change, l2=1e-2, counterfactual=0.3, steps=20_000)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 1e-2 * (w @ w) / 2 + 0.3 * (w @ change @ w) / 2

    best = loss(w, b)
    for _ in range(200):
        step = rng.normal(size=7) * rng.choice([1e-3, 1e-2, 0.1])
        assert loss(w + step[:6], b + step[6]) >= best - 1e-9
    none = toxicity.train(x, y, 0 * change, l2=1e-2)[0]
    assert none @ change @ none > w @ change @ w


def test_every_sentence_of_a_text_is_rewritten():
    text = "The muslims met. Nothing here! A\n\nblack cat? " + "More words. " * 50
    got = list(toxicity.rewritten(text))
    assert len(got) == 54 and got[0] == ("the muslims met", "the christians met")
    assert got[3] == ("black cat", "white cat")
    for a, b in got:
        assert a != b and len(set(a.split()) ^ set(b.split())) == 2
    names = {n for line in toxicity.GROUPS for n in line.split()}
    assert all(set(a.split()) ^ set(b.split()) <= names for a, b in got)
    assert list(toxicity.rewritten("one. two", ())) == [] and list(toxicity.rewritten("")) == []
    assert list(toxicity.rewritten("the red team", ("red blue",))) == [("the red team", "the blue team")]


def test_the_regulariser_works_on_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id") != 0))
    assert model.pairs > 1000
    # A name of the tables' own toxic words can stand for another: then the penalty has something to hold.
    words = [w for w, n in toxic_words(spark) if n >= 3][:4]
    bound = toxicity.fit(docs, labels.where(toxicity.fold("doc_id") != 0), groups=(" ".join(words),), counterfactual=1e3)
    free = toxicity.fit(docs, labels.where(toxicity.fold("doc_id") != 0), groups=(" ".join(words),), counterfactual=0.0)
    assert bound.changed > 0
    spread = lambda m: np.ptp(np.log(m.scores(pa.array(words)) / (1 - m.scores(pa.array(words)))))
    assert spread(bound) < 0.3 * spread(free)


def toxic_words(spark):
    """Words of toxic rows of the small tables that no other labelled row has, most frequent first."""
    both = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    texts = [(r.toxic, set(re.findall(r"[a-z]{4,}", (r.text or "").lower()))) for r in both.select("toxic", "text").collect()]
    clean = set().union(*[w for t, w in texts if t == 0])
    count = {}
    for t, own in texts:
        for w in own - clean if t else ():
            count[w] = count.get(w, 0) + 1
    return sorted(count.items(), key=lambda x: (-x[1], x[0]))


# ---------------------------------------------------------------- embeddings


@pytest.mark.parametrize("tile", [4, 512])
def test_embeddings_against_brute_force(spark, tile):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(140):
        noise = rng.choice([0.0, 0.05, 0.1, 0.2])
        rows.append((i, (base[i % 30] * rng.uniform(0.1, 9) + noise * rng.normal(size=16)).astype(np.float32).tolist(), i % 3))
    rows += [(200 + j, rows[3][1], rows[3][2]) for j in range(9)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, [None] * 16, 1),
             (305, [float("inf")] * 16, 1), (306, [], 1), (307, [1.0] * 8, 0), (308, [-0.0, 1.0] + [0.0] * 14, 2), (309, [0.0, 2.0] + [-0.0] * 14, 2)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, cls int")
    good = {}
    for k, e, label in rows:
        if e and label is not None and None not in e:
            x = np.array(e, np.float64)
            if np.isfinite(x).all() and x.any():
                good[k] = (x / np.sqrt(x @ x), label)
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    part = components_by_hand([r[0] for r in rows], links)
    count = {k: sum(k in e for e in links) for k, _, _ in rows}
    got = embed_dedup.embed_dedup(df, tile=tile, square=2).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((k, count[k], part[k], part[k] == k) for k, _, _ in rows)
    assert embed_dedup.embed_dedup(df.where("vec_id < 0")).count() == 0


def test_error_bounds_hold():
    x = np.random.default_rng(1).normal(size=(200, 64))
    q, facts = embed_dedup.quantise(x)
    assert q.dtype == np.int8
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = unit @ unit.T
    rough = (q.astype(float) @ q.T.astype(float)) * facts[:, :1] * facts[None, :, 0]
    assert (np.abs(exact - rough) <= np.outer(facts[:, 1], facts[:, 2]) + facts[:, 2:] + embed_dedup.SLACK).all()
    sure, open_ = embed_dedup.settled_pairs(q, facts, q, facts, 0.2, same=True)
    i, j = open_
    keep = embed_dedup.exact_pairs(x[i], x[j], 0.2)
    got = [*zip(*map(np.ndarray.tolist, sure), strict=True), *zip(i[keep].tolist(), j[keep].tolist(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(200) for b in range(a + 1, 200) if exact[a, b] >= 0.2]
    assert len(i) < 2000 and len(sure[0])


def test_only_quantised_tiles_travel(spark, monkeypatch):
    seen = {}
    keep = embed_dedup.scratch.keep
    monkeypatch.setattr(embed_dedup.scratch, "keep", lambda df, name: seen.setdefault(name, keep(df, name)))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist(), 0) for i in range(300)], "vec_id long, embedding array<double>, label int")
    embed_dedup.embed_dedup(df, tile=64).collect()
    sizes = seen["tiles"].selectExpr("sum(octet_length(q)) AS q", "sum(octet_length(facts)) AS f").first()
    assert (sizes.q, sizes.f) == (300 * 64, 300 * 24) and "vec" not in seen["tiles"].columns


def test_doubles_keep_their_precision(spark):
    # Single precision would make these vectors equal, or infinite.
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 1e-12], 0), (3, [1e300, 1e300], 0), (4, [2e300, 2e300], 0), (5, [1e-300, -1e-300], 0), (6, [1.0, 2.3], 0)]
    got = embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 0, 5), (6, 2, 3)]


def test_digests_are_of_the_bytes():
    assert hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
