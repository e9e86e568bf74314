"""The pipeline's stages on a small corpus."""

import corpus_pipeline as pipeline

from .test_dedup import brute_components
from .test_text import _toxic


def test_pipeline(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    docs.where("doc_id IS NOT NULL AND doc_id NOT IN (98, 99)").write.parquet(f"{folder}/documents.parquet")
    leaked = next(r[1] for r in rows if r[0] == 1)
    spark.createDataFrame([(i, i % 2, int(i in (2, 3))) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, leaked[:200])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == list(pipeline.COLUMNS)
        kept.append({r.doc_id: r.text for r in now.collect()})
    assert kept[0].keys() == kept[1].keys()
    assert {90, 91, 96} <= kept[-1].keys()
    groups = brute_components(list(kept[1].items()), 5, 80)
    assert kept[2].keys() == {i for i, _, first in groups if i == first} and len(kept[2]) < len(kept[1]) - 10
    assert 1 not in kept[-1] and 4 in kept[-1]
    pieces = pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.collect()} == kept[-1].keys()


def test_toxicity_stage_drops_toxic_documents_alone(spark, tmp_path):
    data = _toxic(300, 2)
    folder = str(tmp_path)
    spark.createDataFrame([(i, y, y) for i, _, y in data], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, folder).collect()}
    toxic = {i for i, _, y in data if y}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept - toxic) >= 0.95 * (300 - len(toxic))


def test_stages_with_null_repeated_and_tied_ids(spark, docs, rows, none, tmp_path):
    """Whole stages over rows without ids, rows that repeat and two texts under one id; and over empty tables."""
    folder = str(tmp_path)
    spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "never to be found in any of these")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    plain = docs.select(*pipeline.COLUMNS)
    count = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))
    everything = count(plain)
    assert count(pipeline.drop_toxic(spark, plain, folder)) == everything
    assert count(pipeline.drop_leaks(spark, plain, folder)) == everything
    assert len(count(pipeline.drop_lines(spark, plain, folder))) == len(rows)
    left = count(pipeline.drop_near_duplicates(spark, plain, folder))
    # 98 is a copy of 5; 99 is a copy of 7 and of 8: all their rows go, and those two stay
    assert not [x for x in left if x[1] in (98, 99)] and {5, 7, 8} <= {x[1] for x in left} and [x for x in left if x[0]]
    # another text under the id of one that goes is another document
    two = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1), (2, "a b c d e f g h", "en", "s", 1), (2, "quite another text, of its own", "en", "s", 1)], plain.schema)
    assert [x[1:] for x in count(pipeline.drop_near_duplicates(spark, two, folder))] == [(1, "a b c d e f g h"), (2, "quite another text, of its own")]
    now = none.select(*pipeline.COLUMNS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, now, folder).count() == 0, name
