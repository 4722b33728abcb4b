"""The pipeline's stages and its whole run against a brute-force version on a small corpus."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import near_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
VILE = ("scumbag", "moron", "vilewort")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    rows, labels = [], []

    def add(words, vile=False):
        if vile:
            words = list(words)
            for word in (*VILE, rng.choice(VILE)):
                words.insert(rng.randrange(len(words)), word)
        rows.append((len(rows), " ".join(words)))
        labels.append((len(rows) - 1, int(vile)))

    for i in range(240):
        add(prose(rng.choice([30, 90])), i % 4 == 0)
    passage, base = prose(80), prose(150)
    add(prose(30) + passage + prose(30))
    add(prose(60) + passage + prose(20))
    for edits in (0, 1, 2, 3):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        add(w)
    add(rows[1][1].split(" "))
    add(rows[1][1].split(" "))
    rows.append((500, ""))
    rows.append((501, None))
    return rows, labels, passage


def by_hand(rows, passage):
    """Documents after each stage but the last, as {doc_id: words}."""
    clean = [(k, t) for k, t in rows if not set(words_of(t)) & set(VILE)]
    last = {}
    for k, t in clean:
        last[t or ""] = max(k, last.get(t or "", -1))
    unique = [(k, t) for k, t in clean if last[t or ""] == k]
    sets = {}
    for k, t in unique:
        w = words_of(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(k):
        return k if up[k] == k else root(up[k])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    near = [(k, t) for k, t in unique if root(k) == k]
    out, seen = {}, False
    for k, t in sorted(near):
        w = words_of(t)
        at = next((i for i in range(len(w)) if w[i : i + len(passage)] == passage), None)
        if at is not None and seen:
            w = w[:at] + w[at + len(passage) :]
        seen = seen or at is not None
        out[k] = w
    return clean, unique, near, out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels, _ = corpus()
    spark.createDataFrame([(k, t, "en", "src", len(t or ""), "x") for k, t in rows], COLUMNS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_each_stage_against_brute_force(spark, folder):
    rows, _, passage = corpus()
    clean, unique, near, cut = by_hand(rows, passage)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    want = [{k: words_of(t) for k, t in part} for part in (clean, unique, near)] + [cut]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), COLUMNS)
        assert docs.columns == names, name
        got = {r.doc_id: words_of(r.text) for r in docs.collect()}
        assert got == expected, name
    assert docs.where((F.col("text").isNotNull()) & (F.char_length("text") != F.col("n_chars"))).isEmpty()


def test_the_run_packs_what_the_stages_leave(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, _, passage = corpus()
    cut = by_hand(rows, passage)[3]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(cut)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out:
        if r.doc_id != 241:  # a cut leaves the white space on one side
            assert r.length == len(lib.encode(" ".join(cut[r.doc_id]), add_special_tokens=False).ids) + 1
    assert corpus_pipeline.queries().keys() == {"pipeline"}


CLASHES = ("_id", "_h", "_name", "_key", "_cut_key", "_cut_text", "_cut_spans", "cut_key", "text_sha256", "own_sha", "kept_sha", "gone_id", "own_name", "keep_id", "kept_id", "score",
           "_row", "component_id", "k", "t", "h", "node", "item", "sequence_id", "group_size", "label", "toxic", "y")


def test_clashing_columns_repeated_rows_nulls_and_very_long_texts_pass_through(spark, folder):
    rng = random.Random(77)
    words = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    long, passage = words(120_000), words(60)
    rows = [(1, long), (2, f"{long} more"), (2, f"{long} more"), (3, None), (3, None), (None, words(20)), (None, ""), (4, ""), (5, "same"), (6, "same"), (6, "same"),
            (7, passage), (8, f"{words(30)} {passage}"), (9, "x" * 300_000), (10, "la " * 150_000)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    base = spark.createDataFrame([(*r, *CLASHES) for r in rows], schema)
    want = {
        "toxicity": sorted([(k, t) for k, t in rows], key=str),
        # Of equal texts the largest key stays, of equal rows one; a null text is an empty one.
        "exact_dedup": sorted([rows[0], rows[1], (4, ""), (None, rows[5][1]), (6, "same"), *rows[11:]], key=str),
        "near_dedup": sorted([r for r in rows if r[0] != 2 and r != (6, "same")], key=str),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, base, folder)
        if name == "packing":
            assert out.agg(F.countDistinct("doc_id")).first()[0] == 10 and out.where("length > 2048").isEmpty()
            continue
        got = out.collect()
        assert out.columns == base.columns and all(tuple(r)[2:] == CLASHES for r in got), name
        if name in want:
            assert sorted([(r.doc_id, r.text) for r in got], key=str) == want[name], name
        else:
            assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 2} == {"more"}
            assert all(passage not in r.text for r in got if r.doc_id == 8) and {r.text for r in got if r.doc_id == 3} == {None}


def test_a_lazy_result_outlives_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lazy = near_dedup.near_dedup(docs.select("doc_id", "text"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, folder).collect()
    assert lazy.count() == docs.count()


def test_stages_on_nothing(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], COLUMNS)
        assert stage(spark, empty, folder).count() == 0
