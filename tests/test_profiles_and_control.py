"""Adding sequences, profile merges, aligned groups, the loop's decisions, and odd rows of the core."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import control as K
from strandweave.operators import columns as C
from strandweave.operators import merge as M
from strandweave.operators import profiles as P
from strandweave.operators import progressive as G
from strandweave.operators import rows as W
from strandweave.sources import formats as S


def aln(spark, rows):
    return spark.createDataFrame(rows, "taxon string, seq string")


def as_dict(df):
    return {r["taxon"]: r["seq"] for r in df.collect()}


def test_no_residue_is_lost(spark):
    seqs = {"q1": "ACXGT", "q2": "YYACGTZ", "q3": "", "q4": "AGT", "b": "CCC"}
    found = {r["taxon"]: r for r in P.align_to(aln(spark, list(seqs.items())), "ACGT").collect()}
    for t, s in seqs.items():
        own = sorted(found[t]["seq"].replace("-", "") + "".join(x["residues"] for x in found[t]["insertions"]))
        assert own == sorted(s) and found[t]["inserted"] == sum(len(x["residues"]) for x in found[t]["insertions"])
    backbone = aln(spark, [("a", "AC-GT"), ("b", "ACCGT")])
    rows = as_dict(P.add_to(backbone, aln(spark, list(seqs.items()))))
    assert set(rows) == {"a", "b", "q1", "q2", "q3", "q4"} and len({len(x) for x in rows.values()}) == 1
    assert {t: x.replace("-", "") for t, x in rows.items()} == {"a": "ACGT", "b": "ACCGT", **{t: s for t, s in seqs.items() if t != "b"}}
    # chunks of queries, each added by itself, fold into one alignment
    parts = [P.add_to(backbone, aln(spark, [(t, seqs[t])])) for t in ("q1", "q2", "q4")]
    folded = as_dict(M.merge_all(parts))
    assert {t: x.replace("-", "") for t, x in folded.items()} == {"a": "ACGT", "b": "ACCGT", "q1": "ACXGT", "q2": "YYACGTZ", "q4": "AGT"}
    assert len({len(x) for x in folded.values()}) == 1


def test_profile_merge(spark):
    mine, hers = aln(spark, [("a", "ACGTAC"), ("b", "AC-TAC")]), aln(spark, [("x", "GGACTAC"), ("y", "GGAC-AC")])
    rows = as_dict(P.profile_merge(mine, hers))
    assert len({len(x) for x in rows.values()}) == 1
    kept = lambda names: ["".join(c) for c in zip(*(rows[n] for n in names), strict=True) if set(c) != {"-"}]
    assert kept(["a", "b"]) == ["".join(c) for c in zip("ACGTAC", "AC-TAC", strict=True)] and kept(["x", "y"]) == ["".join(c) for c in zip("GGACTAC", "GGAC-AC", strict=True)]
    assert as_dict(P.profile_merge(mine, hers.where("false"))) == as_dict(mine)


def test_groups_are_aligned_by_themselves(spark):
    rows = [(1, "a", "ACGTACGT"), (1, "b", "ACGACGT"), (1, "c", "ACGTTACG"), (2, "d", "GG"), (2, "e", None)]
    got = G.align_groups(spark.createDataFrame(rows, "subset int, taxon string, seq string")).collect()
    assert {(r["subset"], r["taxon"]): r["seq"].replace("-", "") for r in got} == {(s, t): x or "" for s, t, x in rows}
    for s in (1, 2):
        assert len({len(r["seq"]) for r in got if r["subset"] == s}) == 1
    with pytest.raises(Exception, match="more than 2"):
        G.align_groups(spark.createDataFrame(rows, "subset int, taxon string, seq string"), most=2).collect()


def test_repeats_nulls_and_clashes(spark):
    mine = aln(spark, [("a", "AC-"), ("a", "A-G"), (None, "CC-"), ("n", None)])
    hers = aln(spark, [("a", "AC-"), ("h", "-GT"), (None, "TTT")])
    got = sorted(map(repr, ((r["taxon"], r["seq"].replace("-", "")) for r in M.transitivity_merge(mine, hers).collect())))
    assert got == sorted(map(repr, [("a", "AC"), ("a", "AG"), (None, "CC"), ("n", ""), ("h", "GT"), (None, "TTT")]))
    loci = spark.createDataFrame([(1, "a", "AC"), (1, "a", "GT"), (2, "b", "T")], "locus int, taxon string, seq string")
    with pytest.raises(Exception, match="taxon a stands twice in locus 1"):
        M.concatenate(loci).collect()
    odd = mine.where("taxon = 'a'").select("taxon", "seq", *[F.lit(9).alias(c) for c in ("bound", "cols", "width", "name", "depth", "level", "ordinals", "rank")])
    assert W.filter_fragments(odd, of_median=1.0).count() == 2 and C.mask_sites(odd, 1).count() == 2 and W.pad(odd).count() == 2
    names = spark.createDataFrame([("a", "x")], "taxon string, name string")
    assert [r["taxon"] for r in W.rename(odd, names).collect()] == ["x", "x"]
    shimmed, places = W.replaced(odd, "C", "X")
    assert sorted(r["seq"].count("C") for r in W.restored(shimmed, places, "C").collect()) == [1, 1]
    assert sorted(map(tuple, C.gap_runs(aln(spark, [("a", "--A-C---"), ("b", ""), ("c", None)])).collect())) == [("a", 0, 1), ("a", 3, 3), ("a", 5, 7)]
    assert as_dict(C.mask_unaligned_sites(aln(spark, [("a", "AcGz"), ("b", "A-Ga")]))) == {"a": "AGz", "b": "AGa"}


def test_formats(spark, tmp_path):
    rows = {"a": "--AC-G--", "b": "ACGTACGT", "c": "--------"}
    al = aln(spark, list(rows.items()))
    for kind in ("fasta", "compact3"):
        S.write(al, str(tmp_path / f"{kind}.gz"), kind, "gzip")
        assert as_dict(S.reader(kind)(spark, str(tmp_path / f"{kind}.gz"))) == rows
    S.write(al, str(tmp_path / "compact"), "compact")
    assert as_dict(C.dense(S.read_compact(spark, str(tmp_path / "compact")), 8)) == rows
    with pytest.raises(ValueError, match="no writer for nexus"):
        S.write(al, "x", "nexus")
    (tmp_path / "stray.fasta").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="text before the first record"):
        S.read_fasta(spark, str(tmp_path / "stray.fasta")).collect()
    (tmp_path / "bare.fasta").write_text(">a\n>b\nAC\n")
    with pytest.raises(Exception, match="no residues follow the name a"):
        S.read_fasta(spark, str(tmp_path / "bare.fasta"), datatype="dna").collect()
    (tmp_path / "x.sto").write_text("# STOCKHOLM 1.0\n\na AC.g\nb ACGT\n\na TT\nb T.\n//\nz ZZ\n")
    assert {r["taxon"]: (r["seq"], r["insertions"]) for r in S.read_stockholm(spark, str(tmp_path / "x.sto")).collect()} == {"a": ("AC-gTT", [2, 3]), "b": ("ACGTT-", [2, 3])}
    folder = tmp_path / "loci"
    folder.mkdir()
    (folder / "2.fasta").write_text(">a\nAC?\n")
    (folder / "1.fas").write_text(">b\nG?\n>a\nT\n")
    got = sorted(map(tuple, S.read_loci(spark, str(folder), datatype="dna", missing="ambiguous").collect()))
    assert got == [(0, "a", "T", "DNA"), (0, "b", "GN", "DNA"), (1, "a", "ACN", "DNA")]
    with pytest.raises(ValueError, match="no such folder"):
        S.locus_paths(spark, str(tmp_path / "none"))


def test_stop_and_accept():
    at = lambda limits, **k: K.stop_reason(limits, k.pop("i", 0), k.pop("last", 0), k.pop("blind", None), **k)
    assert at(K.Limits(seconds=5), now=5) is None and at(K.Limits(seconds=5), now=5.1) == "seconds"
    assert at(K.Limits(after_blind_without_improvement=2), i=5, last=3, blind=4) == "after_blind_without_improvement"
    assert at(K.Limits(after_blind_without_improvement=2), i=5, last=3) is None
    assert at(K.Limits(seconds_after_blind_without_improvement=3), now=9, improved_at=8.9, blind_at=5) == "seconds_after_blind_without_improvement"
    assert at(K.Limits(after_blind=1, iterations=9), i=3, blind=2) == "after_blind"
    rule = K.Blind(on_worse_score=True, after_iterations=4, after_seconds_without_improvement=10)
    assert not K.accept_blindly(rule, 2.0, 1.0, 0, 0) and K.accept_blindly(rule, 1.0, 1.0, 0, 0)
    assert K.accept_blindly(rule, 2.0, 1.0, 4, 0) and not K.accept_blindly(rule, 2.0, 1.0, 4, 0, last_strategy=False)
    assert K.accept_blindly(rule, 2.0, 1.0, 0, 0, now=11) and K.accept_blindly(K.Blind(), 2.0, 1.0, 0, 0, blind=True)
    assert K.mask_bound(0.5, 9) == 4.0 and K.mask_bound(1.5, 9) == 1.5
