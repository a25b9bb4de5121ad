"""The pipeline against the same five steps in plain Python."""

import hashlib
import struct

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from crawlscape.llm import mixing, quality
from tests.llm.test_jaccard import brute as groups


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = cp.keep_good(spark, docs, sf).cache()
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    wanted = {r.doc_id for r in docs.collect() if model.score([quality.encode(r.text)])[0] >= 0.3}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == wanted

    one = cp.one_of_each_group(spark, good, sf).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {k for k, _, c in groups(rows) if k == c}

    clean = cp.without_pii(spark, one, sf).cache()
    before = {r.doc_id: r.text for r in one.collect()}
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert all(r.n_chars == len(r.text) and (r.text == before[r.doc_id] or "[" in r.text) for r in clean.collect())

    mixed = cp.mixed(spark, clean, sf)
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in mixed.collect()]
    assert sorted(order) == sorted(r.doc_id for r in clean.collect())
    slots = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix(clean, mixing.tempered_shares(clean)).collect()}
    assert order == sorted(order, key=slots.get)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    final = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert set(final) == set(texts)
    for i, r in final.items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_order_of_the_mix_reaches_the_result(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i * 7919 % 50), "en", f"s{i % 7 % 3}", None) for i in range(12_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[3:])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    slots = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix(docs.select("doc_id", "source"), mixing.tempered_shares(docs), total=len(rows)).collect()}
    final = cp.run(spark, str(tmp_path)).collect()
    assert len({r.position >> 44 for r in final}) == 3 and len({r.position for r in final}) == len(rows)
    order = [r.doc_id for r in sorted(final, key=lambda r: r.position)]
    assert order == sorted(order, key=slots.get)


def test_edges(spark, edge, nothing, sf):
    docs = edge
    for name, stage in cp.STAGES[1:]:
        out = stage(spark, docs, sf)
        assert out.count() == (docs.count() - 2 if name == "n-gram Jaccard join" else docs.count()), name
        assert stage(spark, nothing.select(*docs.columns), sf).count() == 0
    assert cp.keep_good(spark, docs, sf).columns == docs.columns
    assert np.isfinite(cp.keep_good(spark, nothing.select(*docs.columns), sf).count())
