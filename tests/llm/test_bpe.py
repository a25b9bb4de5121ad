import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlscape.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.WordBpe(path), Tokenizer.from_file(path)


def test_small_automaton_is_the_merge_order():
    """All strings up to seven letters, against merging in order by hand."""
    base, merges = [0, 1], [(0, 1, 2), (0, 0, 3), (2, 0, 4), (3, 2, 5), (1, 1, 6), (3, 3, 7)]
    spell = {0: "a", 1: "b"}
    for u, v, w in merges:
        spell[w] = spell[u] + spell[v]
    auto = bpe.Automaton(base, merges)
    for n in range(1, 8):
        for bits in range(1 << n):
            text = "".join("ab"[bits >> i & 1] for i in range(n))
            ids = [0 if c == "a" else 1 for c in text]
            for u, v, w in merges:
                out = []
                for x in ids:
                    if out and out[-1] == u and x == v:
                        out[-1] = w
                    else:
                        out.append(x)
                ids = out
            paths = [[]]
            for _ in range(n):
                paths = [p + [t] if len("".join(spell[x] for x in p)) < n else p for p in paths for t in (auto.alive if len("".join(spell[x] for x in p)) < n else [0]) if len("".join(spell[x] for x in p)) >= n or (text.startswith("".join(spell[x] for x in [*p, t])) and auto.step(p[-1] if p else bpe.START, t))]
            full = {tuple(p) for p in paths if "".join(spell[x] for x in p) == text}
            assert full == {tuple(ids)}


def test_encodes_as_the_library(both):
    own, library = both
    rng = random.Random(2)
    texts = ["", " ", "'S 'LL it's", "x" * 3000, "!" * 500, "İ ß ﬁ é ΣΑΣ", "a<|endoftext|>b<|startoftext|>", "\x1c\x85　 tabs\tand\nlines"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz'éß0 .,!<|>") for _ in range(200)) for _ in range(100)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x2000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(100)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_edge_rows(edge, nothing, both):
    got = bpe.bpe(edge, public_tokenizers.path("word_bpe_49k.json"), outputs=True).collect()
    texts = {r.doc_id: r.text for r in edge.collect()}
    assert len(got) == edge.count()
    for r in got:
        ids = both[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.bpe(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0
