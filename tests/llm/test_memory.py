"""Python workers do not keep the memory of past steps, and long texts are sent to them once."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import common, langid


def own_mb():
    return sum(int(line.split()[1]) for line in Path("/proc/self/smaps_rollup").read_text().splitlines() if line.startswith("Pss_Anon")) / 1024


def test_memory_is_given_back_when_a_task_ends():
    before, held = own_mb(), []

    def run(batches):
        for batch in batches:
            pieces = [bytes(2000) for _ in range(100_000)]
            held.extend(pieces[::100])  # no page at the end of the heap is free
            del pieces
            yield batch

    task = common.released(run)(iter([1]))
    assert next(task) == 1 and own_mb() - before > 100
    assert list(task) == [] and own_mb() - before < 40
    assert common.released_group(len)(held) == 1000


def test_text_is_sent_once(spark):
    rows = [(i, f"the words of text {i} in a row that are read again and again", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, lang string")
    samples = langid.learn(docs)
    kept = langid.keep_identified(docs, samples)
    assert "__text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    cast = langid.keep_identified(docs.withColumn("TEXT", F.col("TEXT").cast("binary")), samples)
    assert kept.columns == cast.columns == docs.columns
    assert sorted(kept.collect()) == sorted(rows) == sorted((r[0], bytes(r[1]).decode(), r[2]) for r in cast.collect())
