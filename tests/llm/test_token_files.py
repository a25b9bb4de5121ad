import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from crawlscape.llm import token_files


def test_documents_across_blocks(spark):
    ids = np.array([5, 6, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1], "<u2")
    rows = [("f", k, bytes(ids[i : i + 3].tobytes())) for k, i in enumerate(range(0, len(ids), 3))] + [("g", 0, None), ("g", 1, np.array([9], "<u2").tobytes()), ("h", 0, b"")]
    got = token_files.scan(spark.createDataFrame([(f, k, None if p is None else bytearray(p)) for f, k, p in rows], "file string, block long, payload binary"), end=9).collect()
    assert sorted((r.file, r.ordinal, r.n_tokens, r.closed) for r in got) == [("f", 0, 2, True), ("f", 1, 0, True), ("f", 2, 8, True), ("f", 3, 1, False), ("g", 0, 0, True)]


def test_raw_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 5000).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    got = token_files.scan(token_files.blocks_of_files(spark, str(tmp_path / "a.bin"), block_tokens=64), end=0)
    ends = np.flatnonzero(ids == 0)
    assert [r.n_tokens for r in got.where("closed").orderBy("ordinal").collect()] == (np.diff([-1, *ends]) - 1).tolist()


def test_counts_equal_the_library(spark, edge, nothing, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    wanted = sorted((str(r.doc_id), len(coder.encode(r.text or "", add_special_tokens=False).ids)) for r in edge.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_files.op8_token_counts(spark, str(tmp_path)).collect()) == wanted
    small = token_files.write_flat(edge, token_files.byte_bpe_path(), 100)
    assert sorted(r.n_tokens for r in token_files.scan(small).collect()) == sorted(n for _, n in wanted)
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert token_files.op8_token_counts(spark, str(tmp_path / "none")).count() == 0
