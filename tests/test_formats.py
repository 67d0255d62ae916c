"""Sequence files: round trips and errors."""

import pytest

from strandweave.sources import formats as S


def as_dict(df):
    return {r["taxon"]: r["seq"] for r in df.collect()}


def write(tmp_path, text):
    path = tmp_path / "x.fasta"
    path.write_text(text)
    return str(path)


def test_fasta_reading(spark, tmp_path):
    path = write(tmp_path, ">a name \nac g\nTT\n\n>b\n-?A\n")
    assert as_dict(S.read_fasta(spark, path)) == {"a name": "ACGTT", "b": "-?A"}


@pytest.mark.parametrize("text,says", [(">\nACGT\n", "no name"), (">a\nAC*T\n", "illegal symbol")])
def test_fasta_errors(spark, tmp_path, text, says):
    with pytest.raises(Exception, match=says):
        S.read_fasta(spark, write(tmp_path, text)).collect()


def test_round_trips(spark, tmp_path):
    rows = {"a": "--AC-G--", "b": "ACGTACGT", "c": "--------"}
    aln = spark.createDataFrame(list(rows.items()), "taxon string, seq string")
    S.write_fasta(aln, str(tmp_path / "f"))
    assert as_dict(S.read_fasta(spark, str(tmp_path / "f"))) == rows
    S.write_compact3(aln, str(tmp_path / "c"))
    assert as_dict(S.read_compact3(spark, str(tmp_path / "c"))) == rows
    S.write_unaligned_fasta(aln, str(tmp_path / "u"))
    assert as_dict(S.read_fasta(spark, str(tmp_path / "u"))) == {"a": "ACG", "b": "ACGTACGT"}


def test_phylip(spark, tmp_path):
    aln = spark.createDataFrame([("b", "AC"), ("a", "GT")], "taxon string, seq string")
    assert [r["line"] for r in S.phylip_lines(aln).orderBy("place").collect()] == ["2\t2", "a GT", "b AC"]
    with pytest.raises(Exception, match="differ in length"):
        S.phylip_lines(aln.union(spark.createDataFrame([("c", "A")], aln.schema))).collect()


def test_newick_round_trip(spark):
    from strandweave.sources import trees as N

    text = "((a:1,'b c':2.5)x:0.25,(c,d)[a comment],e_f:3);"
    rows = N.read_newick(spark.createDataFrame([(1, text)], "tree_id int, newick string"))
    got = {r["label"]: (r["node"], r["parent"], r["len"], r["is_leaf"]) for r in rows.collect() if r["label"]}
    assert got["b c"] == (1, 2, 2.5, True) and got["x"] == (2, 7, 0.25, False) and got["e_f"] == (6, 7, 3.0, True)
    assert N.to_newick(rows, 2).first()["newick"] == "((a:1,'b c':2.5)x:0.25,(c,d),e_f:3);"
    for bad in ("((a,b);", "(a,b));", "(a,b); (c,d);"):
        with pytest.raises(ValueError):
            N.nodes_of(bad)


def test_loci_and_unknown_formats(spark, tmp_path):
    (tmp_path / "1.fasta").write_text(">a\nAC\n")
    (tmp_path / "2.fasta").write_text(">a\nG\n>b\nT\n")
    got = S.read_loci(spark, [str(tmp_path / "1.fasta"), str(tmp_path / "2.fasta")])
    assert sorted(map(tuple, got.collect())) == [(0, "a", "AC"), (1, "a", "G"), (1, "b", "T")]
    with pytest.raises(ValueError, match="nexus"):
        S.reader("nexus")


def test_structure_and_gaps(spark):
    from pyspark.sql import functions as F

    from strandweave.functions import residues as R

    row = spark.createDataFrame([("A-CG", "<-x}", "A--C-G", "ACG")], "p string, s string, g string, t string")
    got = row.select(R.impose_structure(F.col("p"), F.col("s")), R.propagate_gaps(F.col("g"), F.col("t"))).first()
    assert tuple(got) == ("(.)", "A--C-G")


def test_stockholm_lines_are_put_together_by_name(spark):
    """Lines dealt over tasks, in any order; what stands behind the end of a file is not read."""
    lines = [("f", 9, "not read"), ("f", 3, "b C.G"), ("f", 0, "# STOCKHOLM 1.0"), ("f", 4, "//"), ("f", 1, "a AcG"), ("f", 2, "a .T"), ("g", 5, "a GG"), (None, 1, "c A")]
    got = S.stockholm_lines(spark.createDataFrame(lines, "file string, at int, line string"))
    assert {(r["file"], r["taxon"]): (r["seq"], r["insertions"]) for r in got.collect()} == {("f", "a"): ("AcG-T", [1, 3]), ("f", "b"): ("C-G", [1, 3]), ("g", "a"): ("GG", []), (None, "c"): ("A", [])}
