import zlib
from collections import Counter

from crawlscape.llm import sharding


def test_law_and_slots(spark, edge, nothing, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op9_rendezvous_shards(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in edge.collect()}
    assert len(got) == edge.count()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op9_rendezvous_shards(spark, str(tmp_path / "none")).count() == 0


def test_weights_and_growth(spark):
    rows = sharding.owners(spark.range(30_000), "id", [1.0, 2.0, 0.0, 1.0], 1.0).collect()
    counts = Counter(r.shard for r in rows)
    assert counts[2] == 0 and abs(counts[1] / 30_000 - 0.5) < 0.02
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) / 30_000 - 0.2) < 0.02
    again = {r.id: r.shard for r in sharding.owners(spark.range(30_000).repartition(7), "id", [1.0, 2.0, 0.0, 1.0, 1.0]).collect()}
    assert all(again[r.id] == r.grown_shard for r in rows)
