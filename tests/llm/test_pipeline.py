"""The pipeline's stages in order, on planted cases."""

import random

import corpus_pipeline
from ledgerlens.llm import queries
from ledgerlens.scratch import written


def test_pipeline_on_planted_cases(spark, tmp_path):
    pick = random.Random(15)
    vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8))) for _ in range(900)]
    text = lambda n=150: " ".join(pick.choice(vocabulary) for _ in range(n))
    clean = [(i, text()) for i in range(200)]
    toxic = [(1000 + i, text(40) + " zorgish blaxy " + text(40)) for i in range(80)]
    exact = [(2000 + i, clean[i][1].replace(" ", "  ")) for i in range(10)]
    near = [(3000 + i, clean[i][1] + " tail") for i in range(20, 40)]
    rows = clean + toxic + exact + near
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == {i for i, _ in clean + exact + near}
    assert kept[1] == {i for i, _ in clean + near}
    assert {i for i, _ in clean} <= kept[2] <= kept[1]
    assert len(kept[2] - {i for i, _ in clean}) <= 4  # a changed tail may flip more than four bits
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[2]
    assert {"sequence_id", "offset", "length", "start"} <= set(packed.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    assert set(queries.oracle_sql()) <= set(queries.queries())
