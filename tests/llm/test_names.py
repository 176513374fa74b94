"""Extra columns whose names clash with what operators use inside, or differ in case only."""

import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, decontam, dedup, licenses, lmscore, mixing, perplexity, privacy, secrets, toxicity
from rivulet.llm.gru import Shape

NAMES = ("row", "c0", "k1", "k2", "id", "n", "key", "size", "source_size", "target", "taken", "Taken_", "TEXT", "Doc_Id", "LANG", "q_kept", "q_log_ppl", "b_lang", "_q_text", "_d_text", "_d_spans", "_p_counts", "_m_size", "counts", "found", "bad", "held_out", "signs", "toxic")


@pytest.fixture(scope="module")
def crowded(docs):
    few = docs.limit(60)
    return few.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def values(df):
    """Rows by place, as names may differ in case only."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_every_column(crowded, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n = len(crowded.columns)
    for found in (perplexity.keep_clean(crowded), dedup.keep_one(crowded), decontam.drop_contaminated(crowded, bench), privacy.rewritten(crowded)):
        assert found.columns == crowded.columns
        rows = values(found)
        assert rows and all(r[n - len(NAMES) :] == tuple(f"own {x}" for x in NAMES) for r in rows)
    mix = mixing.mixed(crowded)
    assert mix.columns[-4:] == ["size", "source_size", "target", "taken"] and {"size_", "source_size_", "target_", "taken__"} <= set(mix.columns)
    assert all(set(f"own {x}" for x in NAMES) <= set(r) and isinstance(r[-1], int) for r in values(mix))


def test_operators_ignore_them(crowded, docs, spark, sf_dir):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("labels", "benchmark"))
    plain = docs.limit(60).select("doc_id", "text", "lang", "source")
    tiny = lmscore.Lm(shape=Shape(hidden=8, classes=4, per_class=16))
    for f in (perplexity.quality, dedup.near_duplicates, lambda d: decontam.contamination(d, bench), mixing.mixture, licenses.licenses, privacy.surrogates, secrets.secrets, lambda d: toxicity.toxicity(d, labels), lambda d: lmscore.likelihoods(d, tiny).select("doc_id", "n_tokens", "n_known")):
        assert values(f(crowded)) == values(f(plain))


def test_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(50)
    crowded = rows.select("*", F.lit("x").alias("TEXT"), F.lit("y").alias("x"), F.lit("z").alias("source"))
    assert values(chat.digest(chat.formatted(chat.with_conflict(crowded)))) == values(chat.digest(chat.formatted(chat.with_conflict(rows))))
