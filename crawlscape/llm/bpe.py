"""BPE encoding with a tokenization automaton, and decoding by its arc labels.

``Automaton`` starts from one state with an arc for every base symbol and adds
the merges in order. The gadget of a merge (u, v) -> w acts on the state s that
u's arcs lead to, if s has an arc v: u's arcs are redirected to a copy of s
without that arc, and wherever u could be followed by v an arc w is added that
leads where v led. The state after an arc depends on its label alone, and so the
automaton is kept as one chain of copies per label: ``version`` numbers the
copies of a label by the merges that made them, and ``origin`` links a label's
first version to the version of its right part that it was copied from. Which
arcs a state lacks follows from these chains; ``step`` resolves an arc once and
keeps it in the transition table. A word is encoded by following all arcs that
spell it from the start state; as the automaton is deterministic over labels and
accepts one tokenization per string, one path at most reaches each position.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, held, parquet, tidy

START, DEAD = -1, -2
NEVER = 1 << 60


class Automaton:
    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        """base: ids of single symbols; merges: (left, right, merged) ids, first to last."""
        self.alive = set(base)
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.origin: dict[int, int] = {}
        self.version: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        for when, (u, v, w) in enumerate(merges):
            self._gadget(when, u, v, w)
        self.table.clear()

    def _gadget(self, when: int, u: int, v: int, w: int) -> None:
        if u not in self.alive or v not in self.alive or not self._arc(u, v):
            return  # no path spells u v, so the merge can never apply
        if w in self.alive:
            raise ValueError("a merge makes a token that another one makes")
        self.version[(u, v)] = when
        self.left[w], self.born[w], self.origin[w] = u, when, v
        self.alive.add(w)

    def _lacks(self, state: int, label: int) -> int:
        """The merge that took arc ``label`` from the current state after ``state``, or NEVER."""
        found, until = NEVER, NEVER
        while True:
            when = self.version.get((state, label), NEVER)
            if when < until and when < found:
                found = when
            until = min(until, self.born.get(state, -1))
            if state not in self.origin:
                return found
            state = self.origin[state]

    def _arc(self, state: int, label: int) -> bool:
        """Whether the state after arc ``state`` has an arc ``label``: no label on its left spine was
        taken away before the arc above it was added."""
        added = NEVER
        while True:
            if self._lacks(state, label) <= added and self._lacks(state, label) != NEVER:
                return False
            if label not in self.left:
                return True
            label, added = self.left[label], self.born[label]

    def step(self, state: int, label: int) -> bool:
        if state == START:
            return True
        key = (state << 32) | label
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._arc(state, label)
            if len(self.table) > 400_000:
                self.table.clear()
        return known


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file: split, encode and decode."""

    SAFE = re.compile("[^\\x00-ɏ‐-‧‰-⁞₠-₿]")
    CACHE = 150_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        merged = {w for _, _, w in made}
        letters = byte_letters().values()
        base = [self.vocab[x] for c in letters for x in (c, c + self.suffix) if x in self.vocab and self.vocab[x] not in merged]
        self.automaton = Automaton(base, made)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.labels = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.closes: list[int] = [-1]
        for label in self.automaton.alive:
            text = self.labels[label]
            closing = bool(self.suffix) and text.endswith(self.suffix)
            at = 0
            for c in text.removesuffix(self.suffix) if closing else text:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({}), self.ends.append(-1), self.closes.append(-1)
                at = self.trie[at][c]
            (self.closes if closing else self.ends)[at] = label
        self.byte_to_letter = {chr(b): c for b, c in byte_letters().items()}
        self.table = str.maketrans(self.byte_to_letter)
        self.known: dict[str, bytes] = {}
        # its normaliser and splitter are used, not its vocabulary
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def words(self, text: str) -> list[str]:
        """Normalised words. Letters and classes of unusual scripts are left to the library's own
        normaliser and splitter, whose Unicode tables may differ from Python's."""
        if self.SAFE.search(text) is None:
            import unicodedata

            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        clean = self.library.normalizer.normalize_str(text)
        return [clean[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers, by following the automaton's arcs."""
        letters = word.encode("utf-8").decode("latin-1").translate(self.table)
        size = len(letters)
        state = [DEAD] * (size + 1)
        back = [0] * (size + 1)
        state[0] = START
        trie, ends, closes, step = self.trie, self.ends, self.closes, self.automaton.step
        for i in range(size):
            here = state[i]
            if here == DEAD:
                continue
            node, j = 0, i
            while j < size:
                node = trie[node].get(letters[j], -1)
                if node < 0:
                    break
                j += 1
                if j < size or not self.suffix:
                    label = ends[node]
                    if label >= 0 and state[j] == DEAD and step(here, label):
                        state[j], back[j] = label, i
                if j == size and self.suffix:
                    label = closes[node]
                    if label >= 0 and step(here, label):
                        state[j], back[j] = label, i
        if state[size] == DEAD:
            raise ValueError(f"the vocabulary can't spell {word!r}")
        ids, at = [], size
        while at:
            ids.append(state[at])
            at = back[at]
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def encode(self, text: str | None) -> bytes:
        known, out = self.known, []
        for k, part in enumerate(self.split_special.split(text or "")):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
                continue
            words = self.words(part) if part else ()
            for word in set(words).difference(known):
                if len(word) <= 64:
                    known[word] = self.encode_word(word)
            out += [known[w] if w in known else self.encode_word(w) for w in words]
        if len(known) > self.CACHE:
            known.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs joined by spaces, as a tokenizer without a decoder joins its tokens."""
        labels = self.labels
        return " ".join([labels[i] for i in memoryview(ids).cast("I")])


def _load(path: str) -> WordBpe:
    return held(WordBpe, path)


def bpe(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: bool = False) -> DataFrame:
    """Token counts and digests of every row; with ``outputs`` also the ids and the decoded text.

    ``path`` names a vocabulary file that every executor has. A null text is an empty
    one and has no tokens; only ``keep`` and ``text`` are read.
    """
    extra = ", ids array<int>, decoded string" if outputs else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _load(path)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                ids = coder.encode(value.as_py())
                decoded = coder.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if outputs:
                    all_ids.append(memoryview(ids).cast("I").tolist())
                    texts.append(decoded)
            own = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                own += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=names)

    bounded_batches(df)
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(tidy(run), f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 49k word vocabulary. A null text is an empty one and has no
    tokens; repeated rows and null ids are encoded each; an empty table has no rows."""
    return bpe(parquet(spark, sf_dir, "documents"), word_bpe_path())
