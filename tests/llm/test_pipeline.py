import corpus_pipeline
from rivulet.llm import catalog


def test_stages(spark, docs, sf_dir):
    frame, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir).cache()
        assert frame.columns == docs.columns and frame.count() <= seen, name
        seen = frame.count()
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir)
    assert last.count() <= seen and last.filter("taken <= 0").count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "text", "taken").collect())) == sorted(map(tuple, last.select("doc_id", "text", "taken").collect()))


def test_stages_take_odd_rows(spark, odd, none, sf_dir):
    for rows in (odd, none):
        frame = rows
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
        frame.count()


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
