"""Every stage on what the one before kept, against plain counts."""

import numpy as np
import pytest


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(0)
    text = lambda: " ".join(f"word{'abcdefghij'[x % 10]}{'klmnopq'[x % 7]}" for x in rng.integers(0, 500, 60)) + "."
    rows = [(i, "bad### " * 50 if i % 5 == 0 else text(), "en", f"s{min(i % 4, 2)}", 1) for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "s0", 1) for i in range(1, 5)] + [(900, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen.append(sorted(r.doc_id for r in docs.collect()))
    clean = [i for i in range(120) if i % 5]
    assert [i for i in seen[0] if i < 900] == clean + [501, 502, 503, 504]
    assert seen[1] == clean + [501, 502, 503, 504] and seen[2] == clean
    assert set(seen[3]) <= set(clean) and len(seen[3]) > 50
    assert sorted({r.doc_id for r in docs.select("doc_id").collect()}) == sorted(set(seen[3]))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(seen[3])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "no id here at all", "en", None, 3), (5, "w" * 9000 + " x" * 40_000, "en", "b", None), (6, "one", "en", "a", 3), (6, "one", "en", "a", 3)]


@pytest.mark.parametrize("case", ["odd rows", "empty tables", "clashing columns", "the same row again and again"])
def test_pipeline_of_odd_tables(spark, tmp_path, case):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    plain = [(10 + i, f"plain words of number {i} " * 9, "en", f"s{i % 3}", 1) for i in range(30)]
    rows = {"odd rows": ODD + plain, "empty tables": [], "clashing columns": ODD + plain, "the same row again and again": [plain[0]] * 40}[case]
    docs = spark.createDataFrame(rows, SCHEMA)
    if case == "clashing columns":
        for name in ("mix", "place", "copy", "key", "n", "row", "gone", "text_hash", "mix_plan", "rejected", "score", "file"):
            docs = docs.withColumn(name, docs["n_chars"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(10 + i, int(i % 4 != 3), None) for i in range(30)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == [c for c in columns if name != "mixing" or c != "mix"]
            columns = docs.columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    assert bool(got) == bool(rows)
    if case == "the same row again and again":
        assert {r.doc_id for r in got} == {10} and sum(r.start == 0 for r in got) == 1


def test_packing_follows_the_mixture(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tickwell.llm import mixing

    rows = [(i, f"words of document {i} " * (3 + i % 11), "en", "big" if i % 4 else f"s{i % 12}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).toPandas()
    packed = pieces[pieces.start == 0].sort_values(["sequence_id", "offset"]).doc_id.tolist()
    want = mixing.mix(docs).orderBy("mix.place", "mix.source", "doc_id").select("doc_id").toPandas().doc_id.tolist()
    assert packed == want and len(packed) > len(set(packed))
