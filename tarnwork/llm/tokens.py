"""Encoding of a corpus with a public byte-level tokenizer, prefixes shared by a trie traversal."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TARNWORK_TOKENIZERS", "/opt/tokenizers")
#: How a text is cut into words before merging; fixed by the tokenizer.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000


class Encoder:
    """Byte-pair encoding of words by the last token of each prefix.

    The encoding of a prefix is the encoding of a shorter prefix and one last token; which
    one follows from the vocabulary and from the last token of the shorter prefix. Distinct
    words, sorted, are the depth-first order of their trie, so a stack of last tokens holds
    what neighbouring words share and each trie node is worked out once.
    """

    def __init__(self, ranks: dict[bytes, int], cache_words: int = CACHE_WORDS):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.text = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.cache_words = cache_words
        self.find = regex.compile(WORDS).findall

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one last; None for a single byte."""
        if token not in self.halves:
            self.halves[token] = self._split(self.text[token])
        return self.halves[token]

    def _split(self, b: bytes) -> tuple[int, int] | None:
        if len(b) == 1:
            return None
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            r, i = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two tokens again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        limit, a, b = 1 << 60, left, right
        while True:
            joined = self.ranks.get(self.text[a] + self.text[b])
            if joined is not None and joined < limit:
                return False
            # the boundary pair as it stood before the later of both last merges
            if a > b:
                limit = a
                half = self.split(a)
                if half is None:
                    limit = b
                    half = self.split(b)
                    if half is None:
                        return True
                    b = half[0]
                else:
                    a = half[1]
            else:
                limit = b + 1
                half = self.split(b)
                if half is None:
                    limit = a
                    half = self.split(a)
                    if half is None:
                        return True
                    a = half[1]
                else:
                    b = half[0]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet, in one walk over their trie."""
        if len(self.words) > self.cache_words:
            self.words.clear()
        ranks, fits, longest = self.ranks, self.fits, self.longest
        done = self.words
        prior, last = b"", []
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            whole = ranks.get(raw)
            shared = 0
            for x, y in zip(prior, raw):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(last))
            del last[shared:]
            prior = raw
            if whole is not None and self.stands(whole):
                done[word] = [whole]
                prior = raw[:shared]
                continue
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(raw[start:end])
                    if token is not None and (fits(last[start - 1], token) if start else self.stands(token)):
                        last.append(token)
                        break
            ids, end = [], len(raw)
            while end:
                ids.append(last[end - 1])
                end -= len(self.text[ids[-1]])
            done[word] = ids[::-1]

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        return len(self.text[token]) == 1 or self.split(token) is not None

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws}
        new.difference_update(self.words)
        if new:
            if len(self.words) > self.cache_words:
                self.words.clear()
                new = {w for ws in cut for w in ws}
            self.learn(list(new))
        known = self.words
        for ws in cut:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            yield ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(load_ranks(path))


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int>: the ids of the text without special tokens; null and empty texts give []."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series(list(e.encode(s.tolist())), index=s.index, dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """int: the number of ids; 0 for null and empty texts."""
    path = path or vocabulary()

    @F.pandas_udf("int")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([len(x) for x in e.encode(s.tolist())], index=s.index, dtype="int32")

    return n.asNondeterministic()(text)  # else a filter on the count works it out twice


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids of every document. Each task encodes its own rows; nothing is shuffled.

    Distinct words of a batch go through one trie walk; a worker keeps up to CACHE_WORDS
    encoded words. Texts are taken whole, repeated rows and ties are encoded alike, text that
    looks like a special token is ordinary text.
    """
    return documents.select(F.col(key), token_ids(F.col(text), path).alias("ids"))
