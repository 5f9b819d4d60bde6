import time

import pyarrow as pa

from crossload.llm import packing, toxicity


def test_stages_get_texts_in_small_batches(spark):
    """2,000 texts of 10 kB in one partition: 20 MB, which came as one batch."""
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat(cast(id as string), 10000 div length(cast(id as string))) as text").coalesce(1)

    def sizes(parts):
        for p in parts:
            yield pa.RecordBatch.from_pydict({"rows": [p.num_rows], "bytes": [p.nbytes]})

    toxicity.stage_toxicity(spark, docs, "/root/testdata/sf0.001")
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 2000 and max(r.bytes for r in got) < 8e6


def test_a_worker_forgets_its_encoder_only_after_its_last_task(monkeypatch):
    monkeypatch.setattr(packing, "LINGER", 0.5)
    first = packing.raw_encoder()
    for _ in range(2):
        with packing.lingering():
            assert packing.raw_encoder() is first
            time.sleep(0.6)  # the timer of the task before does not run within a task
    assert packing.raw_encoder() is first
    for _ in range(50):
        time.sleep(0.1)
        if not packing.raw_encoder.cache_info().currsize:
            break
    assert not packing.raw_encoder.cache_info().currsize
