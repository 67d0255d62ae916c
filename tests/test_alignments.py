"""Column and row operators on small alignments."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import control
from strandweave.functions import residues as R
from strandweave.operators import columns as C
from strandweave.operators import merge as M
from strandweave.operators import rows as W
from strandweave.operators.ranks import global_rank


def aln(spark, rows):
    return spark.createDataFrame(list(rows.items()), "taxon string, seq string")


def as_dict(df):
    return {r["taxon"]: r["seq"] for r in df.collect()}


def test_column_counts_have_empty_columns(spark):
    got = {r["col"]: r["n"] for r in C.column_counts(aln(spark, {"a": "A--C", "b": "AG-?"})).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 2}


def test_mask_threshold_zero_keeps_all(spark):
    rows = aln(spark, {"a": "A--C", "b": "AG-C"})
    assert as_dict(C.mask_sites(rows, 0)) == {"a": "A--C", "b": "AG-C"}
    assert as_dict(C.mask_sites(rows, 1)) == {"a": "A-C", "b": "AGC"}
    # a fractional threshold masks counts of at most least - 1
    assert as_dict(C.mask_sites(rows, 1.9)) == {"a": "A-C", "b": "AGC"}


def test_sparse_form_and_back(spark):
    rows = {"a": "A--C", "b": "----", "c": "G?-T"}
    got = as_dict(C.dense(C.sparse(aln(spark, rows)), 4))
    assert got == {"a": "A--C", "b": "----", "c": "G--T"}


def test_empty_alignment(spark):
    none = spark.createDataFrame([], "taxon string, seq string")
    assert C.column_counts(none).count() == 0
    assert C.mask_sites(none, 1).count() == 0
    assert W.unaligned(none).count() == 0


def test_most_residues(spark):
    rows = aln(spark, {"a": "A--CG--T", "b": "AC----GT", "c": "A-C-G-T-", "d": "ACGT---T"})
    assert W.summary(rows.withColumn("locus", F.lit(1))).first()["most_residues"] == 5


def test_filter_fragments(spark):
    rows = aln(spark, {"a": "A---", "b": "AC--", "c": "ACGT"})
    assert set(as_dict(W.filter_fragments(rows, least=2))) == {"b", "c"}
    assert set(as_dict(W.filter_fragments(rows, of_columns=0.7))) == {"c"}
    assert set(as_dict(W.filter_fragments(rows, of_median=1.0))) == {"b", "c"}
    with pytest.raises(ValueError):
        W.filter_fragments(rows, of_columns=1.5)


def test_rename_raises_without_a_name(spark):
    rows = aln(spark, {"a": "A", "b": "C"})
    names = spark.createDataFrame([("a", "x")], "taxon string, name string")
    with pytest.raises(Exception, match="no name for b"):
        W.rename(rows, names).collect()


def test_safe_names(spark):
    names = spark.createDataFrame([("a b", 1), ("a-b", 2), ("AB1", 3), ("a.b", 4), ("x" * 90, 5)], "name string, k int")
    got = {r["name"]: r["safe"] for r in W.safe_names(names, "k").collect()}
    assert got == {"a b": "ab", "a-b": "ab2", "AB1": "ab1", "a.b": "ab3", "x" * 90: "x" * 80}


def test_alphabets(spark):
    rows = spark.createDataFrame([("ACGTU",), ("ACGUN",), ("ACDEFU",), ("ACJ",), ("acgt-?",)], "s string")
    got = [tuple(r) for r in rows.select(*[R.in_alphabet(F.col("s"), t) for t in ("DNA", "RNA", "PROTEIN")]).collect()]
    assert got == [(False, False, True), (False, True, True), (False, False, True), (False, False, False), (True, False, True)]


def test_rna_to_dna_and_back(spark):
    row = spark.createDataFrame([("AUGCAUGC",)], "s string").select(R.rna_to_dna(F.col("s")).alias("d")).select("d", R.rna_to_dna(F.col("d")).alias("d2"), R.dna_to_rna(F.col("d")).alias("r")).first()
    assert tuple(row) == ("ATGCATGC", "ATGCATGC", "AUGCAUGC")


def test_replace_and_restore_between_new_gaps(spark):
    shimmed, places = W.replaced(aln(spark, {"a": "AU-U", "b": "AA-A"}), "U", "X")
    assert as_dict(shimmed) == {"a": "AX-X", "b": "AA-A"}
    moved = aln(spark, {"a": "A-X--X", "b": "A-A--A"})
    assert as_dict(W.restored(moved, places, "U")) == {"a": "A-U--U", "b": "A-A--A"}


def test_p_distance(spark):
    row = spark.createDataFrame([("AC-G", "AG-T"), ("--", "--"), ("A-", "AC")], "a string, b string")
    assert [r[0] for r in row.select(R.p_distance(F.col("a"), F.col("b"))).collect()] == [2 / 3, None, 0.5]


def test_stride_and_ranks(spark):
    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "taxon long")
    got = global_rank(rows, "taxon", parts=5).collect()
    assert all(r["rank"] == r["taxon"] for r in got)
    chunks = {r["taxon"]: r["chunk"] for r in W.stride(rows.withColumn("seq", F.lit("A")), 8).collect()}
    assert chunks == {k: k % 3 for k in range(101)}


def merged_by_hand(mine, hers):
    """Walks both alignments: insertions of mine, then of hers, then a shared column."""
    shared = set(mine) & set(hers)
    wide = lambda a: len(next(iter(a.values())))
    anchor = lambda a, c: any(a[t][c] != "-" for t in shared)
    out = {t: [] for t in {**mine, **hers}}
    i = j = 0
    while i < wide(mine) or j < wide(hers):
        if i < wide(mine) and not anchor(mine, i):
            for t in out:
                out[t].append(mine[t][i] if t in mine else "-")
            i += 1
        elif j < wide(hers) and not anchor(hers, j):
            for t in out:
                out[t].append(hers[t][j] if t in hers and t not in mine else "-")
            j += 1
        else:
            for t in out:
                out[t].append(mine[t][i] if t in mine else hers[t][j])
            i, j = i + 1, j + 1
    return {t: "".join(x) for t, x in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_transitivity_merge_against_a_walk(spark, seed):
    rnd = random.Random(seed)
    names = [f"s{k}" for k in range(rnd.randint(0, 2))]
    common = {t: [rnd.choice("ACGT-") for _ in range(5)] for t in names}
    keep = [c for c in range(5) if any(common[t][c] != "-" for t in names)]

    def side(prefix):
        rows = {t: [] for t in [*names, f"{prefix}1", f"{prefix}2"]}
        for c in [*keep, None]:
            for _ in range(rnd.randint(0, 2)):
                for t in rows:
                    rows[t].append("-" if t in common else rnd.choice("ACGT"))
            if c is not None:
                for t in rows:
                    rows[t].append(common[t][c] if t in common else rnd.choice("ACGT-"))
        for t in rows:  # at least one column
            rows[t].append("-" if t in common else "A")
        return {t: "".join(x) for t, x in rows.items()}

    mine, hers = side("m"), side("h")
    got = as_dict(M.transitivity_merge(aln(spark, mine), aln(spark, hers)))
    assert got == merged_by_hand(mine, hers)
    for t, row in {**hers, **mine}.items():
        assert got[t].replace("-", "") == row.replace("-", "")


def test_concatenation_fills_absent_taxa(spark):
    loci = spark.createDataFrame([(1, "a", "AC"), (1, "b", "GT"), (2, "b", "TTT")], "locus int, taxon string, seq string")
    assert as_dict(M.concatenate(loci)) == {"a": "AC---", "b": "GTTTT"}
    assert [tuple(r) for r in M.partitions(loci).orderBy("locus").collect()] == [(1, 1, 2), (2, 3, 5)]


def test_union_prefers_the_right(spark):
    assert as_dict(M.union_rows(aln(spark, {"a": "A", "b": "C"}), aln(spark, {"b": "G"}))) == {"a": "A", "b": "G"}


def test_control_functions():
    assert control.subset_cap(200, 0.5, 1000) == 500
    assert control.auto_defaults(100)["max_subproblem_size"] == 50
    assert control.auto_defaults(3000)["mask_gappy_sites"] == 3.0
    limits = control.Limits(iterations=3, without_improvement=2)
    assert control.stop_reason(limits, 1, 1, None) is None
    assert control.stop_reason(limits, 3, 3, None) == "iterations"
    assert control.stop_reason(limits, 2, 0, None) == "without_improvement"
