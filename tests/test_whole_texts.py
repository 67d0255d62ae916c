"""Rows of whole texts: nothing behind the first letters is left out."""

import pyarrow as pa
import pytest

from strandweave.jobs import queries as Q
from strandweave.operators.ranks import global_rank
from strandweave.sources import views as V

TEXTS = {3: "the quick brown fox " * 40, 4: "x", 5: "", 6: "12 34", 7: "a" * 60, 8: "a" * 60 + "t", 9: "ACGT and, late: tagged " * 30}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, t, "en" if k % 2 else "de", "ab"[k > 5], len(t)) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def letters(text):
    return "".join(c for c in text.upper() if c == " " or "A" <= c <= "Z")


def test_rows_hold_every_letter(spark, folder):
    of = {}
    for r in V.aligned(spark, folder).orderBy("taxon").collect():
        assert len(r["seq"]) == V.COLUMNS
        of.setdefault(r["taxon"] // V.BLOCKS, []).append(r["seq"])
    turn = str.maketrans(V.LETTERS, V.RESIDUES)
    assert {k: "".join(v).rstrip("-") for k, v in of.items()} == {k: letters(t).translate(turn).rstrip("-") for k, t in TEXTS.items()}
    assert [len(of[k]) for k in (5, 7, 8)] == [1, 1, 2]


@pytest.mark.parametrize("name", ["column_counts", "mask_sites_ratio", "sub_alignment", "seqtools", "consensus", "transitivity_merge"])
def test_against_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = Q.queries()[name](spark, folder)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.oracle_sql()[name]})").fetchall())


def test_late_symbols_are_seen(spark, tmp_path):
    late = "acgt" * 100
    rows = [(1, late + "?", "en", "a", 401), (2, late + "!", "en", "a", 401), (3, late, "en", "a", 400), (4, late + "e", "en", "a", 401)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["taxon"]: (r["absent"], r["ambiguous"]) for r in Q.queries()["missing_policy"](spark, str(tmp_path)).collect()}
    assert got == {1: (late, late + "N"), **{k: (t, t) for k, t, *_ in rows[1:]}}
    checks = {(r["taxon"], r["kind"]): (r["legal"], r["dna"], r["rna"], r["protein"]) for r in Q.queries()["alphabet_checks"](spark, str(tmp_path)).collect()}
    assert [checks[k, "text"] for k in (1, 2, 3, 4)] == [(True, True, False, True), (False,) * 4, (True, True, False, True), (True, False, False, True)]
    assert {checks[k, "unaligned"] for k in (1, 2, 3, 4)} == {(True, True, False, True)}


def test_every_row_is_in_the_concatenation(spark, folder):
    turn = str.maketrans(V.LETTERS, V.RESIDUES)
    want = sum(len(letters(t).translate(turn).replace("-", "")) for t in TEXTS.values())
    rows = Q.queries()["concat_loci"](spark, folder).collect()
    assert sum(len(r["seq"].replace("-", "")) for r in rows) == want and {len(r["seq"]) for r in rows} == {2 * V.COLUMNS}


def test_ranks_within_groups(spark):
    rows = [(k, None if k % 5 == 0 else "ab"[k % 2]) for k in range(60)]
    got = {r["k"]: r["rank"] for r in global_rank(spark.createDataFrame(rows, "k long, g string"), "k", 7, within="g").collect()}
    assert got == {k: sum(h == g for j, h in rows if j < k) for k, g in rows}


def test_neighbours_are_not_sorted_in_one_task(spark, folder, capsys):
    df = Q.queries()["p_distance"](spark, folder)
    df.explain()
    assert "lag(" not in capsys.readouterr().out
    rows = {r["taxon"] // V.BLOCKS for r in df.collect()}
    assert {4, 5, 7, 8, 9} <= rows


def test_rows_of_texts_are_dealt_in_slices(spark, tmp_path, monkeypatch):
    """Null, empty and foreign texts; the letters of a text are read once, however long it is."""
    texts = ["Eta oé\U0001f600-INS", None, "", "é", "tA" * 75, " "]
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)] + [(None, "e", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    aln = V.aligned(spark, str(tmp_path), "source")
    assert "MapInArrow" in aln._jdf.queryExecution().executedPlan().toString()
    got = sorted(aln.collect(), key=lambda r: (r["taxon"] is None, r["taxon"]))
    want = [(0, "ACG-TACG"), (1 * V.BLOCKS, None), (2 * V.BLOCKS, ""), (3 * V.BLOCKS, ""), *[(4 * V.BLOCKS + b, "CG" * (30 if b < 2 else 15)) for b in range(3)], (5 * V.BLOCKS, ""), (None, "A")]
    want = [(t, None if s is None else s.ljust(60, "-")) for t, s in want]
    assert [(r["taxon"], r["seq"]) for r in got] == want
    monkeypatch.setattr(V, "_AT_ONCE", 40)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["taxon", "seq"])
    sliced = list(V._in_rows(iter([batch])))
    assert len(sliced) > 1 and [(r["taxon"], r["seq"]) for b in sliced for r in b.to_pylist()] == want


def test_records_are_written_and_read_in_one_pass_each(spark, tmp_path):
    """Blank records were sought in a pass of their own before the rows were written, and residues and runs took one each."""
    from pyspark.sql import functions as F

    from strandweave.sources import formats as S

    texts = ["A b-c", "", None, "  ", "née qzj " * 40, "Q" * 300]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = V.wide(spark, str(tmp_path))
    lines = S.compact3_rows(rows).select(S.compact3_line().alias("line"))
    back = S.compact3_decoded(S.records_of(lines.select(F.col("line").alias("value"))))
    assert back._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert {(int(r["taxon"]), r["seq"]) for r in back.collect()} == {(r["taxon"], r["seq"]) for r in rows.where("seq is not null").collect()}


def test_parts_count_all_texts(monkeypatch):
    """Rows of gaps alone have no residues, but long runs, and all of them were one part."""
    from strandweave.functions import batches as B

    monkeypatch.setattr(B, "AT_ONCE", 16)
    assert B.in_parts(pa.array(["", "", None]), pa.array(["0-9 11-99", "3-4 7-900000", "1-1"])) == [slice(0, 1), slice(1, 3)]
    assert B.in_parts(pa.array(["A" * 10, "A" * 10]), pa.array([[1], [2]])) == [slice(0, 1), slice(1, 2)]
