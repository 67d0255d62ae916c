import corpus_pipeline


def test_stages_take_effect(spark, docs, tmp_path, monkeypatch):
    """Each stage against its own operator, on documents that the operators' tests cover one by one."""
    from strandweave.llm import jaccard, mixing, packing, quality, toxicity

    long = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{long} tail{k} end{k}", "ab"[k % 2]) for k in range(0, 12)] + [(20, long, "a"), (21, long, "b"), (22, None, "a"), (23, f"other text number {long[::-1]}", "b")]
    df = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram jaccard join", "mixing sources", "packing"]
    d, now = str(tmp_path), df
    for (name, stage), columns in zip(corpus_pipeline.STAGES[:4], [df.columns] * 4, strict=True):
        was, now = now, stage(spark, now, d)
        assert now.columns == columns, name
        if name == "n-gram jaccard join":
            found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(was).collect()}
            assert {r["doc_id"] for r in now.collect()} == set(found.values())
        if name == "mixing sources":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(was).collect()}
            got = [r["doc_id"] for r in now.collect()]
            assert {k: got.count(k) for k in copies if copies[k]} == {k: c for k, c in copies.items() if c} and len(got) == sum(copies.values())
    last = corpus_pipeline.STAGES[4][1](spark, now, d)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "start", "length").collect())) == sorted(map(tuple, last.select("doc_id", "start", "length").collect()))
    assert toxicity.fit(df, spark.read.parquet(f"{d}/labels.parquet")).words == [] and quality.THRESHOLD == 0.7 and packing.SIZE == 2048


def test_both_classifiers_reject(spark, tmp_path):
    """Labelled toxic and poor documents go, clean ones stay, and the last three stages agree with plain Python."""
    import random

    from test_classifiers import plain
    from test_mixing_sharding_packing import shares
    from test_search_and_files import by_hand
    from tokenizers import Tokenizer

    from strandweave.llm import packing

    rnd, rows, labels = random.Random(3), [], []
    for k in range(420):
        kind = "toxic" if k % 6 == 0 else "poor" if k % 6 == 1 else "clean"
        words = plain(rnd, 70)
        if kind == "toxic":
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "schuft", "halunke"]))
        elif kind == "poor":
            words = [w + "###" for w in words[:14] for _ in range(4)]
        rows.append((k, " ".join(words), kind))
        labels.append((k, int(kind != "poor"), int(kind == "toxic")))
    near = [(1000 + k, t + " ende", kind) for k, t, kind in rows if kind == "clean" and k % 10 == 2]
    every = rows + near
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t, _ in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now, left = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, d).write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        left.append([(r["doc_id"], r["text"], r["source"]) for r in now.collect()])
    kind_of = {i: kind for i, _, kind in every}
    kept = [{i for i, _, _ in x} for x in left]
    assert kept[0] == {i for i in kind_of if kind_of[i] != "toxic"}
    assert kept[1] == {i for i in kind_of if kind_of[i] == "clean"}
    found = by_hand([(i, t) for i, t, _ in left[1]])
    assert kept[2] == {c for _, c in found.values()} and len(kept[1]) - len(kept[2]) == len(near)
    sizes = {}
    for _, t, s in left[2]:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    taken = {}
    for _, t, s in left[3]:
        taken[s] = taken.get(s, 0) + len(t.split())
    assert all(abs(taken[s] - want) <= 80 for s, want in shares(sizes).items())
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = corpus_pipeline.STAGES[4][1](spark, now, d).collect()
    assert sum(r["length"] for r in pieces) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in left[3])
