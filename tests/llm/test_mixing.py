from collections import Counter
from fractions import Fraction

import pytest

from crawlscape.llm import mixing


def test_period_stays_within_a_block():
    shares = mixing.quantise({"a": 5, "b": 3.3, "c": 0.01, None: 1}, 64)
    period = sum(shares.values())
    seen: Counter = Counter()
    for source, block, release, deadline, slot in mixing.pfair_period(shares):
        assert release <= slot < deadline and seen[source] == block
        seen[source] += 1
        assert all(abs(seen[s] - Fraction(q * (slot + 1), period)) < 1 for s, q in shares.items())
    assert seen == Counter(shares)


def test_period_reaches_no_python_worker(spark):
    """The period and the shares are local relations: a list would go through two more Python workers in each executor."""
    docs = spark.range(50).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    assert "ExistingRDD" not in mixing.mix(docs, mixing.tempered_shares(docs))._jdf.queryExecution().toString()
    assert mixing.mix(docs.where("false"), {}).count() == 0


def test_mix_keeps_all_rows(spark, edge, nothing):
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 7) end as source")
    shares = mixing.tempered_shares(docs)
    rows = mixing.mix(docs, shares, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5000))
    period, blocks = sum(shares.values()), {}
    for r in rows:
        blocks.setdefault((r.source, r.block), []).append(r)
        assert r.release <= r.slot < r.deadline
    assert len({b[0].slot for b in blocks.values()}) == len(blocks)
    for (source, block), own in blocks.items():
        assert len({r.slot for r in own}) == 1 and sorted(r.row_in_block for r in own) == list(range(len(own)))
        assert own[0].slot // period == block // shares[source]
    columns = edge.select("doc_id", "source", "lang")
    assert mixing.mix(columns, mixing.tempered_shares(columns)).count() == edge.count()
    assert mixing.mix(nothing.select("doc_id", "source"), {"s0": 1}).count() == 0
    with pytest.raises(Exception, match="no share"):
        mixing.mix(docs, {"hot": 1}).count()
    with pytest.raises(ValueError):
        mixing.quantise({"a": 0})
