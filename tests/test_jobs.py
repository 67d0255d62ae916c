"""The command line, streams, and adding sequences."""

import pytest
from pyspark.sql import functions as F

from strandweave.jobs import seqtools
from strandweave.operators import profiles as P
from strandweave.sources import formats as S
from strandweave.streaming import column_counts


def test_command_line(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">a\nAC-G\n>b\nA--G\n>c\n---G\n")
    (tmp_path / "names").write_text("a\nAlpha\n\nb\nBeta\n\n")
    seqtools.main([str(tmp_path / "in.fasta"), str(tmp_path / "out"), "--mask-sites", "1", "--filter-least", "2", "--names", str(tmp_path / "names")])
    assert {r["taxon"]: r["seq"] for r in S.read_fasta(spark, str(tmp_path / "out")).collect()} == {"Alpha": "ACG", "Beta": "A-G"}
    with pytest.raises(SystemExit) as stop:
        seqtools.main(["--no-such-flag"])
    assert stop.value.code == 2


def test_command_line_formats(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">a\nAC-G-\n>b\n-T--A\n>c\n---G-\n")
    want = {"a": "AC-G-", "b": "-T--A", "c": "---G-"}
    for kind in ("compact", "compact3"):
        seqtools.main([str(tmp_path / "in.fasta"), str(tmp_path / kind), "--outformat", kind, "--compression", "gzip"])
        assert all(f.name.endswith(".gz") for f in (tmp_path / kind).iterdir() if f.name.startswith("part"))
        seqtools.main([str(tmp_path / kind), str(tmp_path / f"{kind}.back"), "--informat", kind])
        assert {r["taxon"]: r["seq"] for r in S.read_fasta(spark, str(tmp_path / f"{kind}.back")).collect()} == want
    (tmp_path / "in.sto").write_text("# STOCKHOLM 1.0\na AC.G.\nb .T..A\n//\n")
    seqtools.main([str(tmp_path / "in.sto"), str(tmp_path / "sto"), "--informat", "stockholm"])
    assert {r["taxon"]: r["seq"] for r in S.read_fasta(spark, str(tmp_path / "sto")).collect()} == {t: want[t] for t in "ab"}
    with pytest.raises(ValueError, match="no reader"):
        S.reader("nexus")


def test_running_counts(spark, tmp_path):
    for k, rows in enumerate([[("a", "A-C")], [("b", "-GC"), ("c", "T--")]]):
        spark.createDataFrame(rows, "taxon string, seq string").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema("taxon string, seq string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    column_counts.start(stream, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.table("column_counts").collect())) == [(0, 2, "c"), (1, 1, "b"), (2, 2, "b")]


def test_align_to(spark):
    seqs = spark.createDataFrame([("a", "ACGT"), ("b", "AGT"), ("c", "ACXGT"), ("d", ""), ("e", None)], "taxon string, seq string")
    got = {r["taxon"]: (r["seq"], r["inserted"]) for r in P.align_to(seqs, "ACGT").collect()}
    assert got == {"a": ("ACGT", 0), "b": ("A-GT", 0), "c": ("ACGT", 1), "d": ("----", 0), "e": ("----", 0)}


def test_long_branches(spark):
    tree = spark.createDataFrame([(0, None, None, False), *[(k, 0, 1.0 + k / 10, True) for k in range(1, 9)], (9, 0, 50.0, True)], "node int, parent int, len double, is_leaf boolean")
    assert [r["leaf"] for r in P.long_branches(tree).collect()] == [9]
    assert P.long_branches(tree.where(F.lit(False))).count() == 0
