"""Mixing, sharding and chat formatting."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import chat as C
from strandloom.llm import mixing as M
from strandloom.llm import sharding as H
from strandloom.llm.common import written

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free or not total:
            return {s: capped.get(s, 0.0) for s in order}
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 2.0 * sizes[s] for s in over}


def sized(docs):
    return written(docs.select("doc_id", "source", M.word_count(F.col("text")).alias("size")), "sizes")


def test_mix_of_hot_and_small_sources(table):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(0, 60), "en", rnd.choice(["hot"] * 6 + ["b", "c", "d", None, "e"])) for i in range(3000)] + [(9000, "x", "en", "tiny")]
    out = M.with_copies(sized(table(rows))).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = brute_targets(sizes)
    taken = Counter()
    for r in out:
        assert r._mx_source_size == sizes[r.source] and abs(r._mx_target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r._mx_copies <= 2
        taken[r.source] += r._mx_copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 120), (s, taken[s], t)
    again = M.with_copies(sized(table(rows, parts=7))).collect()
    assert Counter((r.doc_id, r._mx_copies) for r in out) == Counter((r.doc_id, r._mx_copies) for r in again)


def test_buckets_do_not_change_the_result(table, monkeypatch):
    rows = [(i, "w " * (i % 50), "en", "ab"[i % 2]) for i in range(500)]
    docs = sized(table(rows))
    one = Counter((r.doc_id, r._mx_copies) for r in M.with_copies(docs).collect())
    monkeypatch.setattr(M, "EACH", 10)
    assert Counter((r.doc_id, r._mx_copies) for r in M.with_copies(docs).collect()) == one


def test_mix_odd_rows(odd, clash, none):
    for docs in (odd, clash):
        out = M.mix(docs)
        assert out.columns == docs.columns and set(r.text for r in out.collect()) <= {t for _, t, *_ in ODD}
    assert M.mix(none).count() == 0 and M.with_copies(sized(none)).count() == 0
    empty = odd.filter("doc_id = 4")
    assert [(r._mx_target, r._mx_copies) for r in M.with_copies(sized(empty)).collect()] == [(0.0, 0)]


def shards(docs, n=40):
    rows = written(H.slotted(docs), "s")
    first = H.first_map(shards=n)
    stored = written(H.map_table(docs.sparkSession, [first, H.rebalanced(first, H.slot_loads(rows), n)]), "m")
    return H.placed(rows, stored, rows.count())


def test_shards_are_even_and_gapless(table):
    rnd = random.Random(4)
    rows = [(i, "é" * rnd.randrange(0, 400)) for i in range(4000)]
    out = shards(table(rows), 10).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    load, slots = Counter(), {}
    for r in out:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(load) == set(range(10))
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values())


def test_maps_change_by_edits():
    rnd = random.Random(1)
    load = [rnd.randrange(1, 1000) for _ in range(4096)]
    first = H.first_map(4096, 40)
    second = H.rebalanced(first, load, 40)
    third = H.grown(second, load, 40)
    assert all(a == b or b == 40 for a, b in zip(second, third)) and third.count(40) > 50
    total = Counter()
    for s, x in zip(third, load):
        total[s] += x
    assert total[40] > 0.9 * sum(load) / 41
    assert sum(a != b for a, b in zip(first, second)) < 400


def test_rows_that_repeat_in_mass_have_places_of_their_own(table):
    docs = table([(1, "same")] * 900 + [(i, f"t{i}") for i in range(2, 500)])
    out = shards(docs, 4).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len({(r.shard, r.virtual_slot) for r in out if r.doc_id == 1}) == 1


def test_shard_odd_rows_and_files(odd, clash, none, tmp_path, spark):
    for docs in (odd, clash):
        assert shards(docs).count() == len(ODD)
    assert shards(none).count() == 0
    for i, docs in enumerate((odd, odd.withColumn("_slot", F.lit(1)).withColumn("_SHARD", F.lit(2)))):
        H.write_shards(docs, H.map_table(spark, [H.first_map()]), str(tmp_path / str(i)))
        assert spark.read.parquet(str(tmp_path / str(i))).count() == len(ODD)


TEXT = st.lists(st.sampled_from([*"ab \n\\[]</>=é", "[INST]", "[/INST]", "</s>", "[SYS]", "[/ROLE]", "INST]", "/s>"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT), TEXT), max_size=6))
def test_render_reads_back(turns):
    formatted, spans = C.render([list(t) for t in turns])
    assert list(C.parse(formatted)) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not C._MARK.search(C.escape(t)) and C.unescape(C.escape(t)) == t


def test_fold_events():
    log = [
        ("message", "user", "hi"), ("delta", "assistant", "he"), ("delta", "assistant", "llo"), ("end", None, None), ("regenerate", None, "hey"), ("delta", "assistant", " you"),
        ("message", "user", "bye"), ("message", "assistant", "ok"), ("edit", "user", "wait"), ("delta", "assistant", "sure"),
    ]
    assert C.fold(log) == [["user", "hi"], ["assistant", "hey you"], ["user", "wait"], ["assistant", "sure"]]
    assert C.fold([("edit", "user", "x")]) == [["user", "x"]] and C.fold([]) == []
    with pytest.raises(ValueError):
        C.fold([("nod", "user", "x")])


MESSAGES = st.lists(st.tuples(st.sampled_from(["message", "delta", "delta", "end"]), st.sampled_from(["user", "assistant", None]), st.one_of(st.none(), TEXT)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(MESSAGES)
def test_streamed_messages_are_the_folded_ones(log):
    assert list(C.streamed(log)) == C.fold(log)
    with pytest.raises(ValueError):
        list(C.streamed([*log, ("edit", "user", "x")]))


def test_rows_of_one_turn_have_an_order(spark):
    """The order of the query's SQL: null as empty, then by text; one digest whether a log may be edited or not."""
    rows = [(1, 0, None, "b"), (1, 0, "", "z"), (1, 0, None, "a"), (1, None, "user", "first"), (2, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id_", F.lit(1)).withColumn("seq", F.lit(0))
    want = {1: hashlib.sha256(b"user\nfirst\n\na\n\nb\n\nz\n").hexdigest(), 2: hashlib.sha256(b"assistant\n\n").hexdigest()}
    for how in ({}, {"with_text": False}, {"with_text": False, "edits": False}):
        assert {r.conv_id: r.turns_sha256 for r in C.conversations(C.message_events(turns), **how).collect()} == want


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>B"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, "user", "y" * 300000), (4, 5, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in C.conversations(C.message_events(turns)).collect()}
    assert set(out) == {1, 2, 3, 4, None} and out[3].n_turns == 2
    assert out[1].formatted == "[INST]a[/INST]<\\/s>B</s>" and out[1].formatted_chars == len(out[1].formatted)
    assert (out[1].loss_chars, out[1].loss_sha256) == (5, hashlib.sha256(b"</s>B").hexdigest())
    assert out[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n</s>B\n").hexdigest()
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and out[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].formatted_chars == 300000 + 13 + 5
    assert C.conversations(C.message_events(turns.limit(0))).count() == 0
