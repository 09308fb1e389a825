"""Readers and writers round-trip; codecs agree; malformed and empty files have a defined result."""

import bz2
import gzip
import lzma

import pytest

from strandloom.functions.specs import Seed
from strandloom.operators import sets as A
from strandloom.plans import workflows as W
from strandloom.sources import sequences as R
from strandloom.sources import tables as B

FASTA = ">one first record\nACGTAC\nGTACGT\n>two\n\n>three\tx\nTTTT\n"
FASTQ = "@r1/1 c\nACGT\n+\nII>@\n@r2/1\nAC\nGT\n+r2\nII\nII\n@cut\nACGT\n+\nII\n"


@pytest.fixture
def files(tmp_path):
    import zstandard

    data = FASTA.encode()
    for ext, pack in (("", bytes), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".zst", zstandard.compress)):
        (tmp_path / f"a.fa{ext}").write_bytes(pack(data))
    (tmp_path / "r.fq").write_text(FASTQ)
    (tmp_path / "empty.fa").write_text("")
    return tmp_path


def test_codecs_agree(spark, files):
    want = [("one", "first record", "ACGTACGTACGT"), ("three", "x", "TTTT"), ("two", None, "")]
    for ext in ("", ".gz", ".bz2", ".xz", ".zst"):
        rows = R.read_sequences(spark, str(files / f"a.fa{ext}")).collect()
        assert sorted((r.name, r.comment, r.seq) for r in rows) == want, ext
        assert sorted(r.rec_no for r in rows) == [0, 1, 2]
    for ext in ("", ".gz", ".bz2"):
        assert sorted((r.name, r.comment, r.seq) for r in R.read_fasta(spark, str(files / f"a.fa{ext}")).collect()) == want, ext
    assert R.read_sequences(spark, str(files / "empty.fa")).count() == 0 and R.read_fasta(spark, str(files / "empty.fa")).count() == 0


def test_fastq(spark, files):
    rows = {r.name: (r.seq, r.qual) for r in R.read_sequences(spark, str(files / "r.fq")).collect()}
    assert rows == {"r1/1": ("ACGT", "II>@"), "r2/1": ("ACGT", "IIII"), "cut": ("ACGT", None)}


def test_pairs(spark, files):
    a = R.numbered_reads(spark, [str(files / "r.fq")])
    b = a.filter("rec_no < 2")
    rows = R.pair(a, b).collect()
    assert sorted((r.read_id, r.mate, r.name) for r in rows) == [(0, 1, "r1"), (0, 2, "r1"), (1, 1, "r2"), (1, 2, "r2")]
    assert R.unpaired(a, b) == 1 and R.unpaired(b, a) == 1 and R.unpaired(a, a) == 0


def test_write_fasta(spark, files, tmp_path):
    df = spark.createDataFrame([("x", "ACGT" * 50)], "name string, seq string")
    R.write_fasta(df, str(tmp_path / "out"))
    assert [(r.name, r.seq) for r in R.read_fasta(spark, str(tmp_path / "out")).collect()] == [("x", "ACGT" * 50)]


def test_taxonomy_and_names(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("# c\n1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\tx\n\n2\t|\t1\t|\tfamily\t|\n3\t|\t2\t|\tspecies\t|\n")
    got = {r.taxid: (r.parent, r["rank"]) for r in B.read_taxonomy(spark, str(tmp_path / "nodes.dmp")).collect()}
    assert got == {1: (0, "root"), 2: (1, "family"), 3: (2, "species")}
    (tmp_path / "names.txt").write_text("#x\na\t5\nb\t6\na\t7\n")
    names = B.read_names(spark, str(tmp_path / "names.txt"))
    assert {r.name: r.taxid for r in names.collect()} == {"a": 7, "b": 6}
    heads = spark.createDataFrame([(">a word",), (">gi|1|ref|b| text",), (">zzz",)], "h string")
    rows = B.with_taxid(heads.select("h", B.header_name(heads["h"]).alias("name")), names).collect()
    assert {r.h: (r.name, r.taxid) for r in rows} == {">a word": ("a", 7), ">gi|1|ref|b| text": ("b", 6), ">zzz": ("zzz", 1)}
    (tmp_path / "paths").write_text("#no\nx/y\n\nz\n")
    assert {r.path for r in B.read_paths(spark, str(tmp_path / "paths")).collect()} == {"x/y", "z"}


def test_binary_sets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(B.kmer_set_bytes([5, 3, -1]))
    (tmp_path / "a.shs").write_bytes(gzip.compress(B.kmer_set_bytes([5, 3, -1])))
    for name in ("a.bin", "a.shs"):
        assert [r.kmer for r in B.read_kmer_set(spark, str(tmp_path / name)).collect()] == [3, 5, -1]
    (tmp_path / "c.bin").write_bytes(gzip.compress((2).to_bytes(8, "little") + (7).to_bytes(8, "little") + (9).to_bytes(8, "little") + (1).to_bytes(2, "little") + (65535).to_bytes(2, "little")))
    assert [(r.kmer, r.n) for r in B.read_kmer_counts(spark, str(tmp_path / "c.bin")).collect()] == [(7, 1), (9, 65535)]


def test_pair_stream_and_similarities(spark, tmp_path):
    (tmp_path / "pairs.bin").write_bytes(b"".join(x.to_bytes(8, "little") for x in (1, 2, 3, 4)) + b"cut")
    assert [(r.first, r.second) for r in B.read_pair_stream(spark, str(tmp_path / "pairs.bin")).collect()] == [(1, 2), (3, 4)]
    (tmp_path / "sim.tsv").write_text("b\ta\t0.5\na\ta\t1\na\tc\t0.25\n")
    assert sorted((r.i, r.j, r.value) for r in B.read_similarities(spark, str(tmp_path / "sim.tsv")).collect()) == [("a", "b", 0.5), ("a", "c", 0.25)]


def test_numbered(spark):
    df = spark.range(5, 3_000_000, 700_001).select((100 * F_("id")).alias("x"))
    assert [r.rec_no for r in B.numbered(df, "x").orderBy("x").collect()] == list(range(df.count()))


def F_(c):
    from pyspark.sql import functions as F

    return F.col(c)


def test_jobs_end_to_end(spark, tmp_path):
    tree, genomes = R.synthetic(spark, 3, 2, 150)
    assert tree.count() == 7 and genomes.count() == 4
    rows = genomes.collect()
    for r in rows:
        (tmp_path / f"g{r.taxid}.fa").write_text(f">name{r.taxid} x\n{r.seq}\n")
    (tmp_path / "nodes.dmp").write_text("".join(f"{r.taxid}\t|\t{max(r.parent, 1)}\t|\tno rank\t|\n" for r in tree.collect()))
    (tmp_path / "names.txt").write_text("".join(f"name{r.taxid}\t{r.taxid}\n" for r in rows))
    db = W.build_database(spark, str(tmp_path / "*.fa"), str(tmp_path / "nodes.dmp"), str(tmp_path / "names.txt"), str(tmp_path / "db"), k=21)
    assert db.count() == len({min(s[i : i + 21], s[i : i + 21][::-1].translate(str.maketrans("ACGT", "TGCA"))) for s in [r.seq for r in rows] for i in range(len(s) - 20)})
    one = rows[0]
    (tmp_path / "reads.fq").write_text(f"@q/1\n{one.seq[-60:]}\n+\n{'I' * 60}\n")
    line = W.classify_files(spark, str(tmp_path / "reads.fq"), str(tmp_path / "db"), str(tmp_path / "nodes.dmp")).first().value
    assert line == f"C\tq\t{one.taxid}\t60\t{one.taxid}:40"
    assert W.count_kmers(spark, str(tmp_path / "*.fa"), 21).agg({"n": "sum"}).first()[0] == 4 * (450 - 20)
    assert W.count_kmers(spark, str(tmp_path / "*.fa"), 41).count() > 0
    assert W.compare_files(spark, str(tmp_path / "*.fa"), 21).count() == 6
    assert W.nearest_files(spark, str(tmp_path / "*.fa"), 21, 64, 2).count() == 8
    assert W.discover_taxa(genomes, tree, Seed(21), 3).count() <= 3
    assert A.length_histogram(genomes).first().len == 450
    one_file = W.from_fasta(spark, str(tmp_path / f"g{one.taxid}.fa"), 15, unique=True)
    assert one_file.count() == W.from_strings(spark, [one.seq], 15).select("kmer").distinct().count()
    named = W.lca_of_names(spark.createDataFrame([("name4.2",), ("name5",)], "name string"), tables_names(spark, tmp_path), W.T.nodes(tree))
    assert named == 2
    errors = W.sketch_errors(spark, 4000, [0.2, 0.8]).collect()
    assert len(errors) == 2 and all(abs(r.exact - r.estimate) < 0.1 for r in errors)


def tables_names(spark, tmp_path):
    return B.read_names(spark, str(tmp_path / "names.txt"))


def test_streams(spark, tmp_path):
    from strandloom.operators import database as D
    from strandloom.operators import taxonomy as T
    from strandloom.streaming import streams as S

    tree, genomes = R.synthetic(spark, 3, 2, 150)
    at, seed = T.nodes(tree), Seed(21)
    db = D.lca_map(genomes, seed, at)
    genomes.select(F_("taxid").alias("id"), "seq").repartition(2).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.classify_stream(stream, db, at, seed, lambda df, n: got.extend((r.id, r.taxon) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == sorted((r.taxid, r.taxid) for r in genomes.collect())
    events = spark.createDataFrame([(f"2024-01-01 0{h}:{m}:00", "a") for h, m in ((1, "05"), (1, "50"), (2, "10"), (5, "00"))], "ts string, u string").selectExpr("cast(ts as timestamp) ts", "u")
    events.write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    assert sorted(r.n for r in W.complete(S.windowed_counts(read(), ["u"]), "w").collect()) == [1, 1, 2]
    assert sorted(r.n for r in W.complete(S.session_counts(read(), "u"), "s").collect()) == [1, 1, 2]
