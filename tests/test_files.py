"""Files in pieces, mates in several files, stored indexes and sketches, exports, and running profiles."""

import bz2
import gzip
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import storage
from strandloom.functions.specs import Seed
from strandloom.operators import database as D
from strandloom.operators import kmers as K
from strandloom.operators import sets as A
from strandloom.operators import taxonomy as T
from strandloom.plans import workflows as W
from strandloom.sources import sequences as R
from strandloom.sources import tables as B


def records(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rnd.choices("ACGTN", k=rnd.randrange(1, 60)))
        qual = "".join(rnd.choices("@+I!>", k=len(seq)))  # qualities may begin as headers and separators do
        out.append((f"r{i}/1", "c d" if i % 3 == 0 else None, seq, qual))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{n}{' ' + c if c else ''}{end}{s}{end}+{end}{q}{end}" for n, c, s, q in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_in_pieces(spark, tmp_path, end):
    rows = records(300)
    (tmp_path / "a.fq").write_text(fastq(rows, end), newline="")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(fastq(rows, end).encode()))
    (tmp_path / "c.fq.bz2").write_bytes(bz2.compress(fastq(rows, end).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, name in (("600b", "a.fq"), ("70b", "a.fq"), ("128m", "a.fq"), ("128m", "b.fq.gz"), ("128m", "c.fq.bz2")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = R.read_fastq(spark, str(tmp_path / name)).orderBy("block", "at").collect()
            assert [(r.name, r.comment, r.seq, r.qual) for r in got] == rows, (size, name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_that_ends_early(spark, tmp_path):
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+")
    (tmp_path / "empty.fq").write_text("")
    assert sorted((r.name, r.seq, r.qual) for r in R.read_fastq(spark, str(tmp_path / "*.fq")).collect()) == [("a", "ACGT", "IIII"), ("b", "AC", None)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Four genomes on a tree, a database of them, and their files."""
    place = tmp_path_factory.mktemp("world")
    tree, genomes = R.synthetic(spark, 3, 2, 150)
    seqs = {r.taxid: r.seq for r in genomes.collect()}
    for t, s in seqs.items():
        (place / f"g{t}.fa").write_text(f">name{t} x\n{s}\n")
    (place / "nodes.dmp").write_text("".join(f"{r.taxid}\t|\t{max(r.parent, 1)}\t|\tno rank\t|\n" for r in tree.collect()))
    D.save(D.lca_map(genomes, Seed(21), T.nodes(tree)), Seed(21), str(place / "db"), 4)
    return place, seqs


def test_reads_of_several_files_stay_apart(spark, world, tmp_path):
    place, seqs = world
    a, b = list(seqs)[:2]
    (tmp_path / "a.fq").write_text(fastq([("q", None, seqs[a][-60:], "I" * 60)]))
    (tmp_path / "b.fq").write_text(fastq([("q", None, seqs[b][-60:], "I" * 60)]))
    files = [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]
    lines = W.classify_files(spark, files, str(place / "db"), str(place / "nodes.dmp")).orderBy("id").collect()
    assert [r.value for r in lines] == [f"C\tq\t{t}\t60\t{t}:40" for t in (a, b)]


def test_mates_of_several_files(spark, world, tmp_path):
    place, seqs = world
    a, b = list(seqs)[:2]
    rows = {"a1": [("x/1", "first", seqs[a][-60:], "I" * 60), ("lost/1", None, "ACGT", "IIII")], "a2": [("x/2", None, seqs[b][-50:], "J" * 50)], "b1": [("y/1", None, seqs[b][-40:], "K" * 40)], "b2": [("y/2", None, seqs[b][-45:], "L" * 45)]}
    for name, some in rows.items():
        (tmp_path / f"{name}.fq").write_text(fastq(some))
    first, second = ([str(tmp_path / f"{x}{i}.fq") for x in "ab"] for i in (1, 2))
    with pytest.warns(UserWarning, match="1 records have no mate"):
        lines = W.classify_files(spark, first, str(place / "db"), str(place / "nodes.dmp"), second).orderBy("id").collect()
    top = T.lca_pairs(spark.createDataFrame([(a, b)], "a long, b long"), T.nodes(B.read_taxonomy(spark, str(place / "nodes.dmp"))), "a", "b").first()["lca"]
    assert [r.value for r in lines] == [f"C\tx\t{a}\t110\t{a}:40\t{b}:30", f"C\ty\t{b}\t85\t{b}:45"] and top
    with pytest.warns(UserWarning):
        out = W.classify_files(spark, first, str(place / "db"), str(place / "nodes.dmp"), second, fastq=True).orderBy("id").collect()
    comment = f"C\t{a}\t110\t{a}:40\t{b}:30"
    assert out[0].value == f"@x {comment}\n{seqs[a][-60:]}\n+\n{'I' * 60}\n@x {comment}\n{seqs[b][-50:]}\n+\n{'J' * 50}"


def test_a_bucketed_database_is_not_shuffled(spark, world, tmp_path):
    from strandloom.operators import classify as C

    place, seqs = world
    database, seed = D.load(spark, str(place / "db"))
    table = D.bucketed(database, "kmers_by_bucket", 4, str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reads = spark.createDataFrame([(i, s[-60:]) for i, s in seqs.items()], "id long, seq string")
        asked = K.parts(reads, seed, ["id"])
        plan = D.look_up(table, asked)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(kmer") == 1, plan  # of what is asked
        tree = T.nodes(B.read_taxonomy(spark, str(place / "nodes.dmp")))
        out = C.classify(reads, table, tree, seed)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "kmers_by_bucket" in plan and plan.count("Exchange hashpartitioning(kmer") == 1
        assert {r.id: r.taxon for r in out.collect()} == {t: t for t in seqs}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kmers_by_bucket")


def test_counts_in_files(spark, tmp_path):
    counts = spark.createDataFrame([(5, 3), (-2, 70000), (1, 1)], "kmer long, n long")
    to = lambda name: str(tmp_path / name)
    B.stream_counts(counts, to("c.tsv"))
    assert sorted((tmp_path / "c.tsv").read_text().splitlines()) == sorted(["ID\tCount", "5\t3", "-2\t70000", "1\t1"])
    assert B.stream_counts(counts, to("c."), "split") == [to("c.hash"), to("c.count")]
    assert dict(zip(np.fromfile(to("c.hash"), "<i8").tolist(), np.fromfile(to("c.count"), "<u4").tolist())) == {5: 3, -2: 70000, 1: 1}
    B.stream_counts(counts.filter("n < 9"), to("d."), "split")
    assert os.path.getsize(to("d.count")) == 2
    B.stream_counts(counts, to("p.bin"), "pairs")
    assert sorted((r.first, r.second) for r in B.read_pair_stream(spark, to("p.bin")).collect()) == [(-2, 70000), (1, 1), (5, 3)]
    B.stream_counts(counts, to("s.shs"), "set")
    assert [r.kmer for r in B.read_kmer_set(spark, to("s.shs")).collect()] == [1, 5, -2]
    B.stream_counts(counts, to("m.bin"), "map")
    assert [(r.kmer, r.n) for r in B.read_kmer_counts(spark, to("m.bin")).collect()] == [(1, 1), (5, 3), (-2, 65535)]
    with pytest.raises(ValueError):
        B.stream_counts(counts, to("x"), "other")
    B.stream_lines(spark.createDataFrame([("b",), ("a",)], "x string").orderBy("x"), to("l"), "#h")
    assert (tmp_path / "l").read_text() == "#h\na\nb\n"
    assert B.first_line(spark, to("l")) == "#h" and B.count_lines(spark, to("l")) == 3
    (tmp_path / "none").write_text("")
    assert B.first_line(spark, to("none")) is None


def test_stored_indexes_and_sketches(spark, world, tmp_path):
    place, seqs = world
    files = str(place / "*.fa")
    W.index_positions(spark, files, str(tmp_path / "pos"), 21)
    rows, refs, facts = B.load_index(spark, str(tmp_path / "pos"))
    assert facts == {"k": 21, "canonical": True, "kind": "positions"}
    assert sorted((r.ref, r.name, r.comment, r.len) for r in refs.collect()) == [(i, f"name{t}", "x", 450) for i, t in enumerate(sorted(seqs, key=str))]
    assert rows.select(F.explode("positions")).count() == 4 * 430
    W.index_references(spark, files, str(tmp_path / "ref"), 21)
    hits = {r.name.rsplit("/", 1)[1]: (r.hits, r.share) for r in W.screen_files(spark, str(place / f"g{list(seqs)[0]}.fa"), str(tmp_path / "ref")).collect()}
    assert hits[f"g{list(seqs)[0]}.fa"] == (430, 1.0) and len(hits) == 4
    got = W.sample_kmers(spark, files, str(tmp_path / "sk"), 21, 64)
    assert {r["count"] for r in got.groupBy("path").count().collect()} == {64} and got.agg(F.min("n")).first()[0] >= 1
    plain = {(r.path, r.hash) for r in W.sketch_files(spark, files, 21, 64).collect()}
    assert {(r.path, r.hash) for r in got.collect()} == plain
    for r in W.sketch_ks(spark, files, [15, 40]).groupBy("path", "k").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).collect():
        assert abs(r.n - (451 - r.k)) < 20
    B.save_names(spark.createDataFrame([("b", 2), ("a", 1)], "name string, taxid int"), str(tmp_path / "names"))
    assert {r.name: r.taxid for r in B.load_names(spark, str(tmp_path / "names")).collect()} == {"a": 1, "b": 2}
    assert W.from_fasta_rolling(spark, files, [15, 40]).groupBy("k").count().orderBy("k").collect()[1]["count"] == 4 * 411
    lists = {r.name: r.kmers for r in W.by_record(spark, files, 21).collect()}
    assert all(len(x) == 430 for x in lists.values()) and len(W.by_record(spark, files, 40, rolling=True).first().kmers) == 411
    cut = W.repack(K.kmers(spark.createDataFrame([("ACGTACG",)], "id string").withColumn("seq", F.col("id")), Seed(5, canonical=False)), (5, 3))
    assert [r.kmer for r in cut.orderBy("pos").collect()] == [r.kmer for r in K.kmers(spark.createDataFrame([("ACGTACG",)], "id string").withColumn("seq", F.col("id")), Seed(3, canonical=False)).filter("pos < 3").orderBy("pos").collect()]


def test_lists_keep_their_order(spark):
    rows = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 9)], "at int, kmer long")
    assert [r.at for r in A.accepted_in_order(rows, spark.createDataFrame([(5,), (9,)], "kmer long"), "kmer", "at").collect()] == [0, 2, 3]


def test_running_profile_is_the_batch_result(spark, tmp_path):
    from strandloom.streaming import streams as S

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), "".join(rnd.choices("ACGTNg", k=rnd.randrange(0, 30)))) for _ in range(120)] + [("b", None)]
    spark.createDataFrame(rows, "lib string, seq string").repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("lib string, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = S.running_profile(stream, "lib").writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append({r.key: (r.reads, r.bases, r.gc) for r in df.collect()}))
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for key, s in rows:
        n = want.setdefault(key or "", [0, 0, 0])
        n[0] += 1
        n[1] += len(s or "")
        n[2] += sum(x in "GCg" for x in s or "")
    last = {}
    for x in seen:
        last |= x
    assert len(seen) > 1 and last == {k: tuple(v) for k, v in want.items()}


def test_kmers_in_windows_of_time(spark, tmp_path):
    from strandloom.streaming import streams as S

    rows = spark.createDataFrame([("2024-01-01 01:05:00", "ACGT"), ("2024-01-01 01:50:00", "ACG"), ("2024-01-01 02:10:00", "ACG")], "ts string, seq string").selectExpr("cast(ts as timestamp) ts", "seq")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = Counter({(r.window_start.hour, r.kmer): r.n for r in W.complete(S.windowed_kmers(stream, Seed(3, canonical=False)), "w").collect()})
    assert got == Counter({(1, 6): 2, (1, 27): 1, (2, 6): 1})


def test_written_tables_go(spark, tmp_path):
    df = spark.range(5)
    one = storage.written(df, "one")
    path = one._strandloom_path
    local = path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(local)
    two = storage.written(one, "two", instead=one)
    assert not os.path.exists(local) and two.count() == 5
    storage.drop(two, df)
    with storage.scope():
        inside = storage.written(df, "three")
        assert inside.count() == 5
    assert not os.path.exists(inside._strandloom_path.removeprefix("file:"))
    kept = storage.written(df, "kept")
    storage._delete(kept._strandloom_path)  # as the sweep at exit does, which needs no session for local folders
    assert not os.path.exists(kept._strandloom_path.removeprefix("file:"))


def test_runs_are_found_without_windows(spark, world, tmp_path, monkeypatch):
    from strandloom.operators import classify as C

    place, seqs = world
    a, b = list(seqs)[:2]
    database, seed = D.load(spark, str(place / "db"))
    rows = [(1, 1, seqs[a][-60:] + "N" + seqs[b][-50:]), (1, 2, seqs[b][-40:]), (2, 1, "ACGT"), (3, 1, seqs[a][-30:])]
    reads = spark.createDataFrame(rows, "id long, mate int, seq string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs go on from batch to batch
    try:
        out = C.taxa_runs(reads, database, seed, mate="mate")
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.runs for r in out.collect()} == {1: f"{a}:40\t{b}:50", 2: "0:0", 3: f"{a}:10"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_of_mates_are_parsed_once(spark, world, tmp_path, monkeypatch):
    place, seqs = world
    for i in (1, 2):
        (tmp_path / f"{i}.fq").write_text(fastq([(f"x/{i}", None, list(seqs.values())[0][-60:], "I" * 60)]))
    seen, pair = [], R.pair
    monkeypatch.setattr(R, "pair", lambda one, two: seen.append(one.inputFiles() + two.inputFiles()) or pair(one, two))
    W.classify_files(spark, str(tmp_path / "1.fq"), str(place / "db"), str(place / "nodes.dmp"), str(tmp_path / "2.fq"))
    assert seen and not any(f.endswith(".fq") for f in seen[0])


def test_a_database_is_broadcast_by_its_size_in_memory_only(spark, world, tmp_path, monkeypatch):
    """Its files are small enough for Spark's own threshold; 2 million k-mers in 8 MB of files took a driver of 1 GB down."""
    from strandloom import storage

    place, seqs = world
    for i in (1, 2):
        (tmp_path / f"{i}.fq").write_text(fastq([(f"x/{i}", None, list(seqs.values())[0][-60:], "I" * 60)]))
    plan = lambda: W.classify_files(spark, str(tmp_path / "1.fq"), str(place / "db"), str(place / "nodes.dmp"), str(tmp_path / "2.fq"), fastq=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [kmer" in plan()
    fits = storage.fits
    monkeypatch.setattr(storage, "fits", lambda df, most: "kmer" not in df.columns and fits(df, most))
    assert "SortMergeJoin [kmer" in plan() and "BroadcastHashJoin [kmer" not in plan()


def test_mates_of_late_turns_are_classified(spark, tmp_path):
    """A conversation of 26 turns: 13 records, each of both mates; the SQL has no bound on turns either."""
    from strandloom import queries as Q

    d = str(tmp_path)
    spark.createDataFrame([(7, t, f"turn number {t} says some words") for t in range(26)], "conv_id long, turn long, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, "turn number some words of a document", "en", "web"), (2, "other words that it says", "de", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    got = sorted(r.value for r in Q.classify_files_fastq(spark, d).collect())
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    assert len(got) == 13 and got == sorted(r[0] for r in con.execute(Q.ORACLE_SQL["classify_files_fastq"]).fetchall())


def test_lines_of_mates_broadcast_no_large_database(spark, world, tmp_path, monkeypatch):
    place, seqs = world
    for i in (1, 2):
        (tmp_path / f"{i}.fq").write_text(fastq([(f"x/{i}", None, list(seqs.values())[0][-60:], "I" * 60)]))
    monkeypatch.setattr(storage, "fits", lambda df, most: "kmer" not in df.columns)
    plan = W.classify_files(spark, str(tmp_path / "1.fq"), str(place / "db"), str(place / "nodes.dmp"), str(tmp_path / "2.fq"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [kmer" in plan and "BroadcastHashJoin [kmer" not in plan
