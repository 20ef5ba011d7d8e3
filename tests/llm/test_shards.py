"""Whole documents written to shards and read again."""

from recordloom.llm import sharding


def test_write_shards_moves_whole_rows(spark, tmp_path):
    names = [f"s{k}" for k in range(5)]
    rows = [(k % 40 if k % 3 else 7, f"text {k}") for k in range(300)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, "doc_id", names, path, size=251)
    back = spark.read.parquet(path)
    got = sorted(((r.doc_id, r.text, r.slot, r.shard) for r in back.collect()), key=str)
    want = sorted(((r.doc_id, r.text, r.slot, r.shard) for r in sharding.place(docs, "doc_id", names, 251).collect()), key=str)
    assert got == want and sorted((x[:2] for x in got), key=str) == sorted(rows, key=str)
    assert all(len({s for d, _, _, s in got if d == k}) == 1 for k in {x[0] for x in got})
