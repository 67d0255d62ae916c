"""Two iterations on a small family, a lost driver between them, and what is kept."""

import random

import pytest
from pyspark.errors import AnalysisException

from strandweave.functions.control import Limits
from strandweave.operators import loop as L


def test_iterations_resume_and_keep_every_residue(spark, tmp_path, monkeypatch):
    rnd, folder = random.Random(4), str(tmp_path / "run")
    root = [rnd.choice("ACGT") for _ in range(50)]
    rows = [(f"t{k}", "".join(c if rnd.random() > 0.15 else rnd.choice("ACGT") for c in root if rnd.random() > 0.05)) for k in range(10)]
    seqs = spark.createDataFrame(rows, "taxon string, seq string")
    real = L.log_likelihoods
    calls = []

    def lost(aln, trees):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(aln, trees)

    monkeypatch.setattr(L, "log_likelihoods", lost)
    with pytest.raises(KeyboardInterrupt):  # iteration 1 has an alignment and a tree, but no score
        L.iterate(seqs, folder, Limits(iterations=1), most=5)
    first = L._complete(spark, folder)
    assert [r["iteration"] for r in first] == [0] and first[0]["accepted"] and first[0]["improved"]
    done = L.iterate(seqs, folder, Limits(iterations=1), most=5).collect()
    assert [r["iteration"] for r in done] == [0, 1] and done[0] == first[0] and len(calls) == 3
    assert done[1]["improved"] == (done[1]["score"] > done[0]["score"])
    for k in (0, 1):
        got = {r["taxon"]: r["seq"] for r in spark.read.parquet(f"{folder}/alignments/iteration={k}").collect()}
        assert {t: s.replace("-", "") for t, s in got.items()} == dict(rows) and len(set(map(len, got.values()))) == 1
        leaves = {r["label"] for r in spark.read.parquet(f"{folder}/trees/iteration={k}").where("is_leaf").collect()}
        assert leaves == {t for t, _ in rows}
    # a complete iteration is never written again, and the best one is given
    with pytest.raises(AnalysisException):
        L._written(spark.createDataFrame([(1, 0.0, True, True, False, 0.0)], L._SCORES), folder, "scores", 1)
    assert len(L.iterate(seqs, folder, Limits(iterations=1), most=5).collect()) == 2 and len(calls) == 3
    best = max(done, key=lambda r: r["score"])["iteration"]
    assert sorted(L.best_of(spark, folder)[0].collect()) == sorted(spark.read.parquet(f"{folder}/alignments/iteration={best}").collect())
    with pytest.raises(ValueError):
        L.best_of(spark, str(tmp_path / "none"))
