"""The pipeline against each stage's own rule, at the smallest size."""

import corpus_pipeline
from musterline.llm import decontaminate, mixing, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    names, results = [], [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, results[-1], SMALL).write.parquet(f"{tmp_path}/{number}")
        results.append(spark.read.parquet(f"{tmp_path}/{number}"))
        names.append(name)
    assert len(names) == 5
    clean, single, free, mix, shards = results[1:]
    assert all(r.columns == docs.columns for r in results[:-1])
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}

    model = toxicity.fit(docs, labels)
    judged = docs.select(
        "doc_id", (toxicity.score_of(docs, model) >= toxicity.threshold_of(model, docs["lang"])).alias("x")
    )
    assert ids(clean) == {r["doc_id"] for r in judged.collect() if not r["x"]}

    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(clean).collect()}
    assert ids(single) == set(groups.values()) and single.count() == len(set(groups.values()))

    hits = decontaminate.contamination(single, bench).collect()
    assert ids(free) == {r["doc_id"] for r in hits if not r["n_hit"]}
    assert any(r["n_hit"] for r in hits)

    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.plan(free)).collect()}
    words = {}
    for r in mix.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}

    assert shards.drop("shard", "slot").exceptAll(mix).isEmpty() and shards.count() == mix.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    slots = {}
    for r in out.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_leaves_the_last_result_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda *_: str(tmp_path / "run"))
    keep = [(f"stage {n}", lambda spark, docs, sf_dir: docs) for n in range(4)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", keep)
    out = corpus_pipeline.run(spark, SMALL)
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["3"]
    assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
