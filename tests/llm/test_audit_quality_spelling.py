"""Filter audit, quality discriminant and spelling variants against brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import filter_audit, quality, spelling, textvec

DOCS = "doc_id long, text string, lang string, mask string, part string, word string, n string, counts string, k string, key string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, p, *"abcdefg") for k, t, p in rows], DOCS)


def audit_by_hand(rows, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    docs = []
    for k, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if k is not None and k > first[t]:
            fails.add("E")
        docs.append((p or "", fails, k in good, k in toxic))
    out = {}
    for p in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == p], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[p, "".join(order), step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (q, order, step), values in out.items():
            if q == p:
                values.append(total[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(160):
        n = rng.choice([0, 1, 120, 210, 260])
        words = [rng.choice(["a", "Bb", "c#", "é", "DDDD"]) if rng.random() < 0.1 else f"w{rng.randrange(rng.choice([60, 5000]))}" for _ in range(n)]
        rows.append((i, rng.choice([" ", "\t", "\x0b \n"]).join(words) + rng.choice(["", " ", "\xa0"]), rng.choice(["en", "", None, "de"])))
    rows += [(200 + i, rows[rng.randrange(60)][1], rng.choice(["en", "fr"])) for i in range(40)]
    rows += [(300, None, None), (301, "", "en"), (301, "", "en"), (None, "", "en"), (None, rows[2][1], None), (302, "x" * 300_000, "de"), (303, "ab " * 200_000, "de"), (301, "", "xx")]
    labels = [(i, rng.choice([0, 1, None, 7]), rng.choice([0, 1])) for i in range(0, 310, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table(spark, rows).repartition(3), known).collect()
    want = audit_by_hand(rows, labels)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want) == 600 * len({p or "" for _, _, p in rows})


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table(spark, []), none).count() == 0
    own = lambda text, words: {"X": F.size(words) > 1, "Y": F.char_length(text) > 3}
    rows = [(1, "a b", "en"), (2, "abcd", "de"), (3, "a b c", None), (4, "a b", None)]
    got = filter_audit.filter_audit(table(spark, rows), none, part=None, filters=own).where("filter_order = 'XYE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in got] == [("", 1, 3, 0, 1, 0), ("", 0, 1, 1, 1, 0), ("", 0, 0, 1, 0, 0)]


def variants_by_hand(count):
    letters = {c for w in count for c in w}
    out = {}
    for w, n in count.items():
        forms = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters}
        near = sorted((-count[v], v) for v in forms - {w} if v in count)
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, None, n, len(near), count[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return out


def count_by_hand(rows):
    count = {}
    for k, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if n >= 2}


def spelling_rows():
    rng = random.Random(5)
    stems = ["abcdefgh", "aabbaabb", "ÀÉèöñçüß", "aaaaaaaa", "hgfedcba", "zzyyxxww", "bananana"]
    words = []
    for stem in stems:
        words += [stem] * 2000
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "z"])
            words += ["".join(w)] * rng.choice([1, 2, 3, 30, 150])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "1", "œ"]).join(w.title() if rng.random() < 0.3 else w for w in words[i * 100 : i * 100 + 100]), "en") for i in range(len(words) // 100 + 1)]
    return rows + [(None, "abcdefgh abcdefgh Short", None), (3, None, None), (4, "", None), (5, "q" * 50_000 + " " + "q" * 50_000, None), (5, "q" * 50_000, None)]


def test_spelling_against_brute_force(spark):
    rows = spelling_rows()
    out = spelling.spelling_variants(spelling.word_counts(table(spark, rows), change=spelling.thinned)).collect()
    long = "q" * 50_000
    count = count_by_hand(rows)
    want = variants_by_hand({w: n for w, n in count.items() if len(w) < 100})
    assert {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in out if len(r.word) < 100} == want
    assert {r.word: r.n for r in out if len(r.word) > 100} == {w: n for w, n in count.items() if len(w) > 100} and long in count
    assert any(v[1] != v[0] and v[0] for v in want.values())  # chains of forms


def test_spelling_of_few_words(spark):
    words = [("abcdefg", 500), ("abcdefx", 50), ("abcdxfx", 5), ("abcdefg", 500), (None, 9), ("abcdef", 1), ("gfedcba", 4)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {
        "abcdefg": (None, "abcdefg", 1000, 2, None), "abcdefx": ("abcdefg", "abcdefg", 50, 3, 1000), "abcdxfx": ("abcdefx", "abcdefg", 5, 1, 50),
        "abcdef": ("abcdefg", "abcdefg", 1, 2, 1000), "gfedcba": (None, "gfedcba", 4, 0, None)}
    assert spelling.spelling_variants(spelling.word_counts(table(spark, []))).count() == 0


def test_anagrams_that_share_a_key_are_not_near(spark):
    rng = random.Random(1)
    base = list("abcdefghij")
    words = set()
    while len(words) < 400:
        rng.shuffle(base)
        words.add("".join(base))
    frame = spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "id long, word string, n long")
    entries = spelling.anagram_entries(frame)
    assert entries.where("at < 0").select("key").distinct().count() == 1
    assert spelling.near_words(frame).count() == 0


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    symbols, stops, other = set("#$%&*|<>{}[]\\^~_=@+"), set(".,;:!?"), set("\"'()-/`")
    upper = lambda w: sum("A" <= c <= "Z" for c in w)
    pairs = list(zip(words, words[1:]))
    return [
        len(text), len(words), sum(c.isascii() and c.isalnum() or ord(c) > 127 for c in text), upper(text), sum(c in symbols for c in text),
        sum(w[-1] in stops for w in words), sum(c in symbols | stops | other for c in text), text.count("\n"),
        sum(upper(w) > 1 and 2 * upper(w) > len(w.encode()) for w in words), sum(w[0] in symbols or w[-1] in symbols for w in words), len(set(words)),
        max((words.count(w) for w in set(words)), default=0), sum(a == b for a, b in pairs), len(pairs) - len(set(pairs)),
    ]


def test_counts_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["", None, " ", "\n\n", "a", "A B", "THE!! END!!", "x### y$$$", "é ö. \U0001f600", "ab ab ab ab", "a b a b a b", "z" * 200_000, "w " * 100_000]
    texts += ["".join(rng.choice("ab AB\n#.é'1 ") for _ in range(rng.randrange(80))) for _ in range(300)]
    got = quality.measure(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.counts for r in got} == {i: counts_by_hand(t) for i, t in enumerate(texts)}
    assert quality.measure(table(spark, [])).count() == 0


def test_scores_are_differences_of_log_densities():
    rng = np.random.default_rng(4)
    c = rng.integers(0, 60, (400, len(quality.COUNTS))).astype(float)
    y = rng.integers(0, 2, 400)
    c[y == 1, 4] += 20
    base = np.full(len(quality.RATES), 0.1)
    x = quality.statistics(c, base)
    one = np.concatenate([x, np.ones((400, 1))], axis=1)
    model = quality.discriminant(base, np.stack([one[y == k].T @ one[y == k] for k in (0, 1)]))
    scale, d = x.std(axis=0), x.shape[1]
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    within, density = sum((y == k).mean() * cov[k] for k in (0, 1)), []
    for k in (0, 1):
        n = (y == k).sum()
        p = max(quality.POOLED, d / (n + d))
        s = (1 - p - quality.DIAGONAL) * cov[k] + quality.DIAGONAL * np.diag(np.diag(cov[k])) + p * within + quality.FLOOR * np.diag(scale**2)
        e = x - x[y == k].mean(axis=0)
        density.append(np.log((n + 1) / 402) - 0.5 * np.linalg.slogdet(s / np.outer(scale, scale))[1] - 0.5 * np.einsum("ni,ij,nj->n", e, np.linalg.inv(s), e))
    assert np.allclose(model.scores(c), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500))), atol=1e-7)


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (None, 1), (2, 5)], 0.0)])
def test_without_both_classes_the_score_is_the_share(spark, labels, want):
    measured = quality.measure(table(spark, [(1, "a", "x"), (2, None, None), (None, "b", "y"), (1, "a", "x")]))
    model = quality.fit(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in quality.score(measured, model).collect()] == [want] * 4


def test_held_out_quality(spark):
    out = quality.op12_quality_discriminant(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) and len(rows) == 70


def test_the_queries_match_the_counts_by_hand(spark):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = spelling.op13_spelling_variants(spark, "/root/testdata/sf0.001").collect()
    assert {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in out} == variants_by_hand(count_by_hand(docs))
    assert textvec.CHUNK == 1 << 20
