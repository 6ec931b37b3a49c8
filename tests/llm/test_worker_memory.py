"""What Python workers keep between stages, and how often the pipeline's functions run."""

import public_tokenizers

from quarry.llm import bpe, common, minhash, suffix

SF = "/root/testdata/sf0.001"


def codecs(spark):
    """The codecs that the workers hold, one number a task."""

    def run(batches):
        for b in batches:
            yield b.assign(id=len(bpe._codecs)).head(1)

    return [r["id"] for r in spark.range(16).repartition(16).mapInPandas(run, "id bigint").collect()]


def test_workers_forget_other_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(16).localCheckpoint()
    bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(codecs(spark)) > 0
    minhash.sign(docs).collect()
    assert sum(codecs(spark)) == 0


def test_a_task_forgets_only_others(monkeypatch):
    own, other = {"a": 1}, {"b": 2}
    monkeypatch.setattr(common, "MEMORIES", {"own": own.clear, "other": other.clear})
    assert list(common.released(lambda batches: batches, "own")(iter([1, 2]))) == [1, 2]
    assert own and not other


def test_suffix_dedup_cuts_each_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = suffix.dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    # the condition on the text that is left doesn't run the function again
    assert plan.count("ArrowEvalPython [run(") == 1, plan
