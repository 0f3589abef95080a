import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tallyloom.llm import mixing, simhash, toxicity


def test_every_stage_takes_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, data)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = (x.toPandas() for x in seen["toxicity"])
    model = toxicity.train(seen["toxicity"][0], spark.read.parquet(f"{data}/labels.parquet"))
    assert set(after.doc_id) == {i for i, s in zip(before.doc_id, model.scores(before.text.fillna("").tolist()), strict=True) if s < corpus_pipeline.TOXIC}
    before, after = (x.toPandas() for x in seen["line_dedup"])
    lines = [x.strip(" ") for t in after.text for x in t.split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines)) and set(after.doc_id) <= set(before.doc_id)
    before, after = (x.toPandas() for x in seen["simhash_near_dedup"])
    parts = simhash.near_duplicates(spark.createDataFrame(before)).toPandas()
    assert sorted(after.doc_id) == sorted(parts.component_id.unique())
    before, after = (x for x in seen["mixing"])
    taken = mixing.mix(before).agg(F.sum("taken"), F.sum("size")).first()
    words = sum(len(t.split()) for t in after.toPandas().text)
    assert abs(words - taken[0]) <= 2 and taken[0] <= 2 * taken[1]
    packed = seen["packing"][1].toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all() and packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()
    run = corpus_pipeline.run(spark, data).toPandas()
    assert np.isclose(run.length.sum(), packed.length.sum()) and len(run) == len(packed)


def test_stages_take_odd_rows(spark, data):
    rows = [(None, None, None, None, None, 1, 1), (1, "", "en", "a", 0, 1, 1), (1, "", "en", "a", 0, 1, 1), (2, "x y z", "en", None, 5, 2, 2), (3, "w " * 4000, "en", "a", 8000, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, p int")
    for table in (docs, docs.limit(0)):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, data)
            if "size" in at.columns:
                assert {(r.size, r.p) for r in at.filter("doc_id > 1").collect()} <= {(2, 2), (3, 3)}
        assert at.count() >= 0 and (table is docs) == (at.count() > 0)
