"""Steps on Arrow batches: rows in parts, other alphabets, nulls, and work in proportion to the symbols."""

import random

import pytest

from strandweave.functions import batches as B
from strandweave.functions import residues as R
from strandweave.operators import columns as C
from strandweave.operators import fold as L
from strandweave.operators import merge as M
from strandweave.operators import rows as W
from strandweave.sources import formats as S
from pyspark.sql import functions as F


def aln(spark, rows):
    return spark.createDataFrame(rows, "taxon string, seq string")


def as_dict(df):
    return {r["taxon"]: r["seq"] for r in df.collect()}


@pytest.fixture(params=["ACGT-", "AÄ漢😀-"])
def rows(request):
    rnd = random.Random(7)
    return [(f"s{k}", "".join(rnd.choice(request.param) for _ in range(rnd.randint(0, 30)))) for k in range(40)] + [("n", None), ("e", ""), ("g", "---")]


def test_runs_places_and_sparse_form(spark, rows):
    def runs(s):
        gaps = [i for i, ch in enumerate(s or "") if ch == "-"]
        return [(a, min(b for b in gaps if b >= a and b + 1 not in gaps)) for a in gaps if a - 1 not in gaps]

    got = aln(spark, rows).select("taxon", R.gap_runs(F.col("seq")).alias("r")).collect()
    assert {r["taxon"]: r["r"] and [tuple(x) for x in r["r"]] for r in got} == {t: None if s is None else runs(s) for t, s in rows}
    assert as_dict(C.dense(C.sparse(aln(spark, rows)), 35)) == {t: s if s is None else s.ljust(35, "-") for t, s in rows}
    spread = aln(spark, rows).select("taxon", R.propagate_gaps(F.col("seq"), R.degap(F.col("seq"))).alias("seq"))
    assert as_dict(spread) == dict(rows)
    text = S.compact3_rows(aln(spark, rows)).where("residues is not null").select(S.compact3_line().alias("value"))
    assert as_dict(S.compact3_decoded(S.records_of(text))) == {t: s for t, s in rows if s is not None}


def test_compact3_runs_that_overlap(spark):
    lines = [("a", ["AC", "@ 1-2 2-3"]), ("b", ["AC", "@"]), ("c", ["A", "@ 5-6"]), ("d", ["", "@ 0-1"])]
    assert as_dict(S.compact3_decoded(spark.createDataFrame(lines, "taxon string, lines array<string>"))) == {"a": "A---C", "b": "AC", "c": "A--", "d": "--"}


def test_restored_in_any_alphabet(spark, rows):
    old = "A"
    shimmed, places = W.replaced(aln(spark, rows), old, "X")
    assert places.columns == ["taxon", "ordinals"]
    doubled = shimmed.select("taxon", F.replace("seq", F.lit("-"), F.lit("--")).alias("seq"), F.col("seq").alias("was"))
    got = W.restored(doubled, places, old, "was").collect()
    assert {r["taxon"]: (r["seq"], r["was"]) for r in got} == {t: (s and s.replace("-", "--"), s and s.replace("A", "X")) if s else (s, s) for t, s in rows}
    # places one by one, and of rows that repeat a taxon
    one = spark.createDataFrame([("a", 0), ("a", 2), ("a", 9)], "taxon string, ordinal int")
    assert sorted(r["seq"] for r in W.restored(aln(spark, [("a", "X-YZ"), ("a", "XX")]), one, "Ü").collect()) == ["Ü-YÜ", "ÜX"]
    assert W.joined_places([one, places]).where("taxon = 'a'").count() == 3


def test_masks_and_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "AT_ONCE", 16)
    wide = max(len(s) for _, s in rows if s)
    n = {c: sum(1 for _, s in rows if s and len(s) > c and s[c] != "-") for c in range(wide)}
    assert {r["col"]: r["n"] for r in C.column_counts(aln(spark, rows)).collect()} == n
    by = B.counts(aln(spark, rows), "seq", lambda symbols: symbols == B.GAP, "taxon")
    assert by.agg(F.sum("n")).first()[0] == C.gap_counts(aln(spark, rows)).agg(F.sum("gaps")).first()[0] == sum((s or "").count("-") for _, s in rows)
    got = as_dict(C.mask_sites(aln(spark, rows), 12))
    assert got == {t: s and "".join(ch for c, ch in enumerate(s) if n[c] > 11) for t, s in rows}


def test_merges_keep_null_rows_and_null_taxa(spark):
    mine = aln(spark, [("a", "A-C"), (None, "GGG"), ("b", None)])
    hers = aln(spark, [("a", "AC"), (None, "TT"), ("c", "-Ä")])
    got = sorted(((r["taxon"] or "", r["seq"]) for r in M.transitivity_merge(mine, hers).collect()))
    assert got == [("", "GGG"), ("", "T-T"), ("a", "A-C"), ("b", "---"), ("c", "--Ä")]
    parts = spark.createDataFrame([(k, t, s) for k in ("x", "y") for t, s in (("a", "A-C"), (f"r{k}", "GTÄ"), (f"n{k}", None))], "chunk string, taxon string, seq string")
    merged = as_dict(L.merge_chunks(parts, parts.where("taxon = 'a'")))
    assert merged == {"a": "A--C", "rx": "GT-Ä", "ry": "G-TÄ", "nx": "----", "ny": "----"}


def test_views_of_long_texts_do_not_copy_them_for_each_row(spark, tmp_path):
    import time

    from strandweave.sources import views as V

    texts = [(1, "The Ä cat?"), (2, None), (3, ""), (4, "et" * 2_000_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wide = {r["taxon"]: r["seq"] for r in V.wide(spark, str(tmp_path)).where("taxon < 4").collect()}
    assert wide == {1: "C-A--GGC", 2: None, 3: ""}
    began = time.perf_counter()  # 66,667 rows of a text of 4 MB
    assert V.aligned(spark, str(tmp_path)).where("seq is not null").agg(F.count("*"), F.sum(F.length(R.degap(F.col("seq"))))).first() == (66_669, 4_000_005)
    assert time.perf_counter() - began < 30


def test_consensus_counts_batches_and_makes_no_row_a_symbol(spark):
    rows = [(("a", "x"), "AC-É"), (("a", "x"), "AG-"), (("a", None), "T"), (None, "CC"), (("b", "x"), None), (("b", "y"), ""), (("a", "x"), "CG-É"), ((None, "x"), "--T")]
    loci = spark.createDataFrame(rows, "locus struct<p:string,q:string>, seq string")
    out = W.consensus(loci)
    got = {(r["locus"] and tuple(r["locus"]), r["seq"]) for r in out.collect()}
    assert got == {(("a", "x"), "AG-É"), (("a", None), "T"), (None, "CC"), ((None, "x"), "--T")}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    many = [(k % 3, "".join("ACG-"[(k * j) % 4] for j in range(k % 9))) for k in range(60)]
    want = {}
    for k in range(3):
        cols = [[s[c] for n, s in many if n == k and len(s) > c] for c in range(max(len(s) for n, s in many if n == k))]
        want[k] = "".join(min(set(c) - {"-"}, key=lambda ch: (-c.count(ch), ch), default="-") for c in cols)
    assert want == {r["locus"]: r["seq"] for r in W.consensus(spark.createDataFrame(many, "locus int, seq string")).collect()}
