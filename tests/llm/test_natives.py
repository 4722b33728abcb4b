"""The operators that are DataFrame expressions only: exact and line duplicates, chat, sharding."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import chat_format, exact_dedup, line_dedup, sharding

DOCS = "doc_id long, text string, lang string, source string, _row string, name string, kept string, n_lines string, _id string"
TEXTS = ["", None, "a", "a", "b" * 9, "b" * 9, "b" * 10, "é" * 40, "é" * 40, "x" * 5000, "x" * 5000, "x" * 4999 + "y", "a" * 8 + "b" * 8, "b" * 8 + "a" * 8]


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en" if i % 2 else None, None, "r", "n", "x", "y", "z") for i, (k, t) in enumerate(rows)], DOCS)


def brute(rows):
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((k is not None, k or 0, i, k))
    out = []
    for k, t in rows:
        own = groups[t or ""]
        out.append((k, max(own)[3], len(own), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_exact_dedup_against_brute_force(spark, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "a"), (None, "only")]
    out = exact_dedup.exact_dedup(table(spark, rows), block_bytes=block)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()), key=str)
    assert got == brute(rows)
    assert {"lang", "source", "_row", "name"} <= set(out.columns)
    kept = out.where("kept").groupBy("text_sha256").count()
    assert kept.where("count != 1").isEmpty() and kept.count() == len({t or "" for _, t in rows})


def test_exact_dedup_tells_contents_of_one_hash_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.length(F.concat(*[F.col(x) if isinstance(x, str) else x for x in c]).cast("binary")) * 0)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = exact_dedup.exact_dedup(table(spark, rows), block_bytes=8)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()), key=str) == brute(rows)


def test_exact_dedup_replaces_columns_of_its_names(spark):
    names = ["keep_id", "Group_Size", "kept", "text_sha256"]
    docs = table(spark, [(1, "a"), (2, "a"), (3, None)]).drop("kept").withColumns({n: F.lit("given") for n in names})
    out = exact_dedup.exact_dedup(docs)
    assert sorted(c.lower() for c in out.columns) == sorted({c.lower() for c in docs.columns} - {"text"})
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    with pytest.raises(ValueError, match="key"):
        exact_dedup.exact_dedup(docs, key="kept")


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def lines_by_hand(rows, size=3):
    first, count = {}, {}
    docs = sorted({(k, t) for k, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for d in docs:
        lines = d[1].split("\n")
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            first.setdefault(w, (d, i))
            count[w] = count.get(w, 0) + 1
    out = {}
    for d in docs:
        lines, later, kept = d[1].split("\n"), set(), set()
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if count[w] > 1:
                (kept if first[w] == (d, i) else later).update(range(i, i + size))
        cut = later - kept
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in cut), len(cut))
    return out


def test_line_dedup_against_brute_force(spark):
    block = "one\ntwo\nthree\nfour"
    rows = [(1, block), (2, f"x\n{block}\ny"), (3, "one\ntwo"), (4, "a\na\na\na\na"), (5, None), (6, ""), (7, "two\nthree\nfour"),
            (8, block), (9, f"{block}\n{block}"), (None, "p\nq\nr"), (10, "p\nq\nr\ns"), (11, "\n\n\n\n")]
    out = line_dedup.line_dedup(table(spark, rows + [(8, block)]))
    want = lines_by_hand(rows)
    got = out.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id == 5:
            assert r.text is None and r.n_removed == 0 and r.n_lines == 0
        else:
            source = next(t for k, t in rows if k == r.doc_id)
            assert (r.text, r.n_removed) == want[r.doc_id, source]
            assert r.n_lines == len(source.split("\n"))
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 2, 1, "delta", None, "llo"),
        (1, 3, 1, "regenerate", None, None), (1, 4, 1, "delta", None, "Hey "), (1, 5, 1, "delta", None, "you"),
        (1, 6, 0, "edit", "user", "hello"), (1, 7, 2, "message", "user", "gone"), (1, 8, 2, "delete", None, None),
        (2, 0, 0, "delta", "assistant", "a"), (2, 1, 0, "delta", None, "b"), (None, None, None, "message", None, None),
    ]
    turns = chat_format.fold(spark.createDataFrame(log, EVENTS)).collect()
    assert sorted([(r.conv_id or 0, r.turn or 0, r.role, r.text) for r in turns]) == [
        (0, 0, "", ""), (1, 0, "user", "hello"), (1, 1, "assistant", "Hey you"), (2, 0, "assistant", "ab")]
    assert chat_format.format_chat(spark.createDataFrame([], EVENTS)).count() == 0


def test_chat_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\0\\1\\2", "<s>[INST] user [/INST]\n", "", None, "é\n😀[", "\\", "a\\<b", " [/INST]\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "[INST] x", "t"), (2, 0, "assistant", "z"), (None, 0, None, "n")]
    events = chat_format.rows_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {
        r.conv_id: r
        for r in chat_format.format_chat(events)
        .withColumns({"turns": chat_format.parse(F.col("formatted")), "learned": chat_format.learned(F.col("formatted"), F.col("loss_spans"))})
        .collect()
    }
    assert [(t.role, t.text) for t in out[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert out[1].learned == "".join(t or "" for t in nasty[1::2])
    assert [(t.role, t.text) for t in out[2].turns] == [("[INST] x", "t"), ("assistant", "z")]
    assert [(t.role, t.text) for t in out[None].turns] == [("", "n")]
    for r in out.values():
        for s in r.loss_spans:
            assert r.formatted[s.start : s.end].encode() == r.formatted.encode()[s.byte_start : s.byte_end]


def test_a_streamed_log_folds_back_to_its_rows(spark):
    texts = ["", None, "a", "é" * 700, "<s>[INST] x", "0123456789" * 3000, "\n\n", "😀" * 300]
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(c * 3 + t) % len(texts)]) for c in range(12) for t in range(6)]
    rows += [(3, 2, "user", "twice"), (3, 2, "user", "twice"), (None, 1, "user", "n"), (None, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.rows_as_stream(df, chunk=16)
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) >= 10 and kinds["delta"] > 500
    assert log.groupBy("conv_id", "turn").count().agg(F.max("count")).first()[0] <= 2 * chat_format.MOST_DELTAS + 4
    told = lambda events: sorted(
        (str(r.conv_id), r.turn, r.role, r.text) for r in chat_format.fold(events.orderBy(F.rand(3))).collect()
    )
    assert told(log) == told(chat_format.rows_as_events(df)) and len(told(log)) == len(rows)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"c{i}" for i in range(dims)]
    rows = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    got = rows.withColumn("h", sharding.hilbert_index([F.col(n) for n in names], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1 << (bits * dims)))
    for a, b in itertools.pairwise(got):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_gapless(spark, law):
    rows = [(i % 90, "x" * (i * 7 % 50)) for i in range(200)] + [(None, None), (5, ""), (5, "")]
    out = sharding.shard_by_curve(table(spark, rows), shards=7, law=law).collect()
    assert len(out) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len(t or "") + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    weight = [sum(1 if law == "rows" else r.size for r in out if r.shard == s) for s in range(7)]
    assert max(weight) - min(weight) <= (1 if law == "rows" else 100)
    for s in range(7):
        own = sorted((r.slot, r.curve) for r in out if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)
    assert max(r.curve for r in out if r.shard == 2) <= min(r.curve for r in out if r.shard == 3)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_cut_from_the_order_of_the_curve_by_hand(spark, law):
    rows = [(i * 37 % 151 if i % 11 else None, "w " * (i * i % 83)) for i in range(151)] + [(3, ""), (3, ""), (3, "")]
    out = sharding.shard_by_curve(table(spark, rows), shards=9, law=law).collect()
    ordered = sorted(out, key=lambda r: (r.curve, r.doc_id is not None, r.doc_id or 0, r.text_crc32))
    weights = [1 if law == "rows" else r.size for r in ordered]
    before, slots, want = 0, {}, []
    for r, w in zip(ordered, weights, strict=True):
        shard = before * 9 // sum(weights)
        want.append((r.doc_id, r.text_crc32, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += w
    assert sorted(want, key=str) == sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in out), key=str)


def test_no_shards_of_nothing_and_one_row(spark):
    assert sharding.shard_by_curve(table(spark, [])).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard_by_curve(table(spark, [(1, "a")])).collect()] == [(0, 0)]
    with pytest.raises(ValueError, match="law"):
        sharding.shard_by_curve(table(spark, []), law="none")


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)] + [(None, "n"), (None, None), (7, "again"), (7, "again")]
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {11}
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert set(back.columns) == set(table(spark, rows).columns) | {"shard"}


def test_cells_keep_the_order_and_are_about_equally_full(spark):
    rows = spark.createDataFrame([(float(i % 97) ** 3, "abcde"[i % 5] if i % 9 else None) for i in range(3000)] + [(1e18, "z")], "x double, s string")
    cell = sharding.number_cells(rows, ["x"], 4)[0]
    got = rows.select("x", cell.alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("c").collect()
    assert len(got) == 16 and all(a.hi < b.lo for a, b in itertools.pairwise(got)) and max(r.n for r in got) < 260
    names = {r.s: r.cell for r in sharding.name_cells(rows, "s", 4).collect()}
    assert names[None] == 0 and [names[c] for c in "abcdez"] == sorted(names[c] for c in "abcdez") and len(set(names.values())) >= 5


def test_shards_are_pruned_on_every_dimension(spark):
    """A search for one value reads far fewer shards than all, on each of the four dimensions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    facts = docs.select("doc_id", "lang", "source")
    placed = sharding.shard_by_curve(docs, shards=64).join(facts, "doc_id")
    for name in ("doc_id", "size", "lang", "source"):
        ranges = placed.groupBy("shard").agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
        hit = placed.select(F.col(name).alias("x")).join(ranges, F.col("x").between(F.col("lo"), F.col("hi")))
        assert hit.count() / placed.count() < (0.7 if name == "lang" else 0.45) * 64, name
