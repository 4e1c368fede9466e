"""What the pipeline's executors hold: Arrow batches of bounded bytes, and workers that give back what they have freed."""

import re
from pathlib import Path

import corpus_pipeline
from tessera.llm import common

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_each_stage_bounds_the_batches(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(LIMIT)
        stage(spark, docs, "/root/testdata/sf0.001")
        long = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('word ', 400) text")

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

        got = long.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 9000 and max(r.bytes for r in got) <= 1.2 * common.BATCH_BYTES
    spark.conf.unset(LIMIT)


def test_a_smaller_limit_stays(spark):
    spark.conf.set(LIMIT, "64k")
    common.bound_batches(spark)
    assert spark.conf.get(LIMIT) == "64k"
    spark.conf.unset(LIMIT)


def test_a_worker_gives_back_what_a_task_has_freed(spark):
    def run(batches):
        kept = []
        for _ in range(3):  # the last block of each round stays, so the C library frees none of them by itself
            blocks = [bytes(2000) for _ in range(40_000)]
            kept.append(blocks.pop())
            yield from ()
        common.worker_state()["kept"] = kept

    class Frame:
        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    before = held_mb()
    assert list(common.map_arrow(Frame(), run, "")(iter([]))) == []
    assert held_mb() - before < 30
