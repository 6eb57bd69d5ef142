"""Byte-level BPE: guess each word's tokens greedily, verify, and merge exactly where that fails.

A word's guess takes the longest token at each place.  It is BPE's own answer if and only if
each neighbouring pair of tokens, merged alone, falls into these two tokens again, so all
pairs of all words of a batch are tested at once against a table of pairs seen before.  Words
with a failing pair are merged exactly, with a heap, in n log n for a word of n bytes.

Defined results: a null text is an empty one and has no tokens; texts of any length are
encoded whole; repeated rows get equal results; an empty table gives an empty result; other
columns are not read.  The vocabulary's path is a parameter; each task reads the file once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import text_of

# Fixed value: how byte-level vocabularies split text into words.
WORD = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word up to which merges are found by search.
SHORT = 48
#: Rank of a pair that does not merge.
NEVER = 1 << 60
#: Texts whose new words are learnt together.
GROUP = 64
#: Words whose tokens a task remembers.
MEMORY = 200_000


def _letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _letters()
        spell = lambda s: bytes(letters[c] for c in s)
        vocab = {spell(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text in special:
            vocab.pop(text.encode(), None)
        self.ids, self.special = vocab, special
        self.bytes = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (spell(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.words = regex.compile(WORD)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pairs: dict[int, bool] = {}
        #: By word: its tokens, these as text with commas, and the bytes they stand for.
        self.known: dict[str, tuple[list[int], str, bytes]] = {}
        self.size = max(self.bytes) + 1
        self.shown = [str(i) for i in range(self.size)]
        self.single = {b: vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        # A token that its own bytes do not merge into can never be a guess.
        self.guessed = {b: i for b, i in vocab.items() if self.merge(b) == [i]}
        self.reach: dict[bytes, int] = {}
        for b in self.guessed:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))

    def merge(self, word: bytes) -> list[int]:
        """Exact: always the least rank, the leftmost of equal ones."""
        ids = [self.single[b] for b in word]
        if len(ids) <= SHORT:
            # A short list is searched faster than a heap is kept.
            ranks = [self.ranks.get(p, NEVER) for p in zip(ids, ids[1:])]
            while ranks:
                least = min(ranks)
                if least == NEVER:
                    break
                i = ranks.index(least)
                ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = self.ranks.get((ids[i], ids[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = self.ranks.get((ids[i - 1], ids[i]), NEVER)
            return ids
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if ids[i] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
                continue
            ids[i], ids[j], right[i] = self.merges[pair][1], -1, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < len(ids):
                    both = (ids[a], ids[right[a]])
                    if both in self.merges:
                        heapq.heappush(heap, (self.merges[both][0], a, both))
        return [i for i in ids if i >= 0]

    def guess(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            # No token that begins with these two bytes is longer.
            for end in range(min(len(word), at + self.reach.get(word[at : at + 2], 1)), at, -1):
                token = self.guessed.get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Tokens of new words: guesses, one test of all their pairs, merges where it fails."""
        raw = [w.encode() for w in words]
        guesses = [self.guess(w) for w in raw]
        lengths = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        inner = np.ones(max(len(flat) - 1, 0), bool)
        ends = np.cumsum(lengths)
        inner[ends[:-1] - 1] = False
        codes = flat[:-1] * self.size + flat[1:] if len(flat) else flat
        distinct, which = np.unique(codes[inner], return_inverse=True)
        fine = np.empty(len(distinct), bool)
        for k, code in enumerate(distinct.tolist()):
            good = self.pairs.get(code)
            if good is None:
                a, b = divmod(code, self.size)
                good = self.pairs[code] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
            fine[k] = good
        word_of = np.repeat(np.arange(len(words)), lengths)[:-1][inner] if len(flat) else flat
        failed = np.zeros(len(words), bool)
        failed[word_of[~fine[which]]] = True
        for word, body, tokens, wrong in zip(words, raw, guesses, failed.tolist()):
            ids = self.merge(body) if wrong else tokens
            self.known[word] = ids, ",".join(map(self.shown.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def _parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        at = 0
        for hit in self.cut.finditer(text) if self.cut else ():
            yield self.words.findall(text[at : hit.start()]), self.special[hit.group()]
            at = hit.end()
        yield self.words.findall(text[at:]), None

    def _known_parts(self, texts: list[str]) -> list[list[tuple[list[str], int | None]]]:
        """The parts of some texts, whose words are then all known; new ones are learnt together."""
        split = [list(self._parts(text)) for text in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = set(chain.from_iterable(words for parts in split for words, _ in parts)).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        return split

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), GROUP):
            for parts in self._known_parts(texts[at : at + GROUP]):
                out: list[int] = []
                for words, special in parts:
                    out.extend(chain.from_iterable(self.known[w][0] for w in words))
                    if special is not None:
                        out.append(special)
                yield out

    def shown_and_decoded(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Per text: how many tokens, their numbers joined by commas, and the bytes they stand for.

        Both are put together from words, which repeat, and not token by token.
        """
        for at in range(0, len(texts), GROUP):
            for parts in self._known_parts(texts[at : at + GROUP]):
                found = []
                for words, special in parts:
                    found += map(self.known.__getitem__, words)
                    if special is not None:
                        found.append(([special], self.shown[special], self.bytes[special]))
                if found:
                    ids, shown, body = zip(*found)
                    yield sum(map(len, ids)), ",".join(shown), b"".join(body)
                else:
                    yield 0, "", b""

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, ids): the tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for k, ids in enumerate(own.encode(batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), text_of(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the tokens and of the decoded text."""
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            told = own.shown_and_decoded(batch.column(1).to_pylist())
            rows = [(n, digest(shown.encode()), digest(body.decode("utf-8", errors="replace").encode())) for n, shown, body in told]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names
            )

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
