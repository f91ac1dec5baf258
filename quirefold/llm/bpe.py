"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a partition's texts that are not yet known are laid out as one row of symbols. An index maps each pair of
neighbours that some merge joins to all its positions. The active ranks are taken in ascending order; all positions of
a rank's pair are merged, left to right, and only the lists of the pairs to the left and right of each merge change.
Words repeat, so that each distinct word of a partition is merged once; the table of finished words is emptied when it
is large, which costs time and never changes a result.

Texts are encoded whole, with added special tokens matched first, as the public tokenizers library does with
``add_special_tokens=False``. Defined cases: a null or empty text has no ids and decodes to the empty string; null ids
are kept as they are; every row gives one row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from quirefold.tables import table

#: How byte-level vocabularies split a text into words.
WORDS = r" ?\p{L}++|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Finished words kept at once, and characters of text handled at once.
KNOWN_WORDS, SLICE_CHARS = 400_000, 1_000_000


def byte_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int64)
        #: (left id, right id, id of the whole) by rank; the pairs as sorted keys, and their ranks
        self.by_rank = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        keys, first_at = np.unique([(a << 32) | b for a, b, _ in self.by_rank], return_index=True)
        self.keys, self.ranks = keys, first_at
        back = {name: b for b, name in names.items()}
        self.piece = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece |= {i: text.encode() for text, i in self.added.items()}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(WORDS)
        #: The ids of a finished word as bytes, which hold half of what a list of numbers does.
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def _learn(self, words: list[str]) -> None:
        """Merge distinct words, all at once, by the pair occurrence index."""
        if not words:
            return
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        sym = self.first[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        sym[ends] = -1
        n = len(sym)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[0] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            held = ranks >= 0
            ranks, places = ranks[held], places[held]
            if len(ranks) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for lo, hi, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
                if (lists := index.get(rank)) is None:
                    index[rank] = [places[lo:hi]]
                    heappush(active, rank)
                else:
                    lists.append(places[lo:hi])

        add(self._ranks(sym[:-1], sym[1:]), np.arange(n - 1))
        while active:
            rank = heappop(active)
            lists = index.pop(rank)
            a, b, whole = self.by_rank[rank]
            i = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            i = i[sym[i] == a]
            j = after[i]
            met = sym[j] == b
            i, j = i[met], j[met]
            if len(i) == 0:
                continue
            if a == b:  # runs of one symbol pair up from the left
                free, take = -1, []
                for x, y in zip(i.tolist(), j.tolist()):
                    take.append(x != free)
                    free = y if x != free else -1
                i, j = i[take], j[take]
            sym[i], sym[j] = whole, -2
            k = after[j]
            after[i], before[k] = k, i
            h = before[i]
            add(self._ranks(np.concatenate((np.full(len(i), whole), sym[h])), np.concatenate((sym[k], np.full(len(i), whole)))), np.concatenate((i, h)))
        alive = sym >= 0
        ids, upto = sym[alive].astype(np.int32).tobytes(), (4 * np.cumsum(alive)[ends]).tolist()
        start = 0
        for word, end in zip(words, upto):
            self.known[word] = ids[start:end]
            start = end

    def _split(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return self.words.findall(text)
        out, end = [], 0
        for m in found:
            out += self.words.findall(text[end : m.start()])
            out.append(self.added[m[0]])
            end = m.end()
        return out + self.words.findall(text[end:])

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        def done(part: list[list]) -> Iterator[list[int]]:
            new = {w for words in part for w in words if w not in known}
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                known.update(special)
                new = {w for words in part for w in words if w not in known}
            self._learn(list(new))
            for words in part:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32).tolist()

        known = self.known
        special = {i: np.int32(i).tobytes() for i in self.added.values()}
        known.update(special)
        part, chars = [], 0
        for text in texts:
            part.append(self._split(text) if text else [])
            chars += len(text or "")
            if chars >= SLICE_CHARS:
                yield from done(part)
                part, chars = [], 0
        yield from done(part)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row's whole text."""
    path = path or default_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": list(bpe.encode(rows["text"]))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ids."""
    path = path or default_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "text": [None if ids is None else bpe.decode(ids) for ids in rows["ids"]]})

    return encoded.mapInPandas(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, in one pass over the texts."""
    path = path or default_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        name = {i: str(i) for i in bpe.piece}
        for rows in frames:
            counts, digests, decoded = [], [], []
            for ids in bpe.encode(rows["text"]):
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_tokens": pd.Series(counts, dtype="int64"), "ids_sha256": pd.Series(digests, dtype=object), "decoded_sha256": pd.Series(decoded, dtype=object)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
