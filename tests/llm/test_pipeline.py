import corpus_pipeline
from conftest_llm import ODD
from test_packing import ids


def test_stages_keep_and_change_what_they_should(spark, docs, tmp_path):
    plain = [(100 + k, " ".join(f"word{(k * 31 + j) % 997}" for j in range(40))) for k in range(40)]
    toxic = [(200 + k, " ".join([*(f"word{(k * 17 + j) % 997}" for j in range(40)), "horrid", "vilest", "scummy"])) for k in range(20)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    extra = [(300, f"{plain[0][1]} {item}"), (301, plain[1][1].upper()), (302, "write to a.b@mail.example.com or 4111111111111111 today please")]
    docs(*plain, *toxic, *extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in plain] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r for r in df.collect()}
    want = {i for i, _ in plain} | {300, 302}
    assert {i for i in seen["toxicity"]} == want | {301} and set(seen["near_duplicates"]) == want and set(seen["decontamination"]) == want - {300}
    assert "4111111111111111" not in seen["pii"][302]["text"] and "@mail.example.com" not in seen["pii"][302]["text"]
    assert seen["pii"][100]["text"] == plain[0][1] and seen["pii"][302]["n_chars"] == len(seen["pii"][302]["text"])
    assert seen["packing"][100]["length"] == len(ids(plain[0][1])) + 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(seen["packing"])


def test_odd_rows_pass_every_stage(spark, docs, tmp_path):
    docs(*ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 4, 6}
