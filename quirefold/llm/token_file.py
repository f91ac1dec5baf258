"""Token ids in a binary file format: an adaptive context-mixing range coder in independent, checksummed blocks.

Each id is coded whole. Two adaptive tables, in the contexts of the previous id (order 1) and of the two previous ids
(order 2), each name the id that they expect, with the probability that they are right. A small adaptive mixer adds these
and the rate of hits so far (order 0) in the logistic domain to the probability of the likelier one; the other one comes
next; any other id is coded by a fixed prior, as vocabularies give frequent pieces small ids. The probabilities drive a
carry-less range coder. Every block starts from fresh models and carries its number of ids and the CRC-32 of what it
encodes, so blocks can be read alone, in any order, and damage is found. All arithmetic is on integers, so any machine
decodes what another encoded.

A block is cut into lanes, which are coded in step as arrays: each has a coder and a mixer of its own, and all share the
block's tables, where of lanes that write to one slot at once the last counts. Documents are dealt into ranges of doc_id,
each range is a file of rows ``part, block, payload`` (rows of one id are told apart by a hash of their texts) with a
directory ``part, doc_id, row, n_tokens``; both are written to the shared folder.

Defined cases: a null or empty text is the end id alone; a null doc_id comes before all others; repeated rows are
documents of their own; an empty table writes no block; further columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize
from quirefold.tables import table

END = 1
#: Ids of a file's block and of a lane, and lanes of a block at most.
BLOCK_IDS, LANE_IDS, LANES = 1 << 22, 8192, 8192
#: Ids of a lane of the files: few steps for small blocks, few bytes of lanes for large ones.
FILE_LANE_IDS = 128, 512
#: A block's tables have as many slots as it has ids, between these powers of two.
ID_BITS, LEAST_TABLE_BITS, TABLE_BITS = 16, 10, 16
MAGIC = b"QTB3"
#: Distinct words and their ids kept at once, slots for them, and bytes of text handled at once.
KNOWN_WORDS, KNOWN_IDS, SLOT_BITS, SLICE_CHARS = 600_000, 4_000_000, 18, 500_000
#: Bytes of text of a file, whose ids a task holds when it reads them back.
FILE_BYTES = 32 << 20

#: Kinds of bytes; the end of a text is STOP, a byte of anything that the library cuts itself OTHER.
SPACE, LETTER, DIGIT, SIGN, OTHER, STOP = range(6)
KINDS = bytes(OTHER if b == 0 or b > 127 else SPACE if chr(b) in "\t\n\v\f\r " else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256))
#: By 8 * kind + next kind: a piece for the library ends between them.
CUTS = np.array([{x, y} & {SPACE, STOP} != set() or (x, y) in {(LETTER, SIGN), (LETTER, DIGIT), (DIGIT, SIGN), (DIGIT, DIGIT), (DIGIT, LETTER)} for x in range(8) for y in range(8)])
#: Letters that make a contraction with a quote before them; masks of the first 0 to 8 bytes.
SHORT = np.isin(np.arange(256), [ord(x) for x in "stmd"]).astype(np.int64)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Logistic function and its inverse on 12 bits, followed by the inverse's negative.
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 1, 4095).astype(np.int32)
STRETCH = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)
STRETCH = np.concatenate((STRETCH, -STRETCH))


#: Cumulative counts of the prior of ids, of 2**20 in all: one for each id, the rest by 1 / (id + 100).
PRIOR_BITS = 20
_shares = np.cumsum((1 << 40) // (np.arange(1 << ID_BITS, dtype=np.int64) + 100)).tolist()
PRIOR = np.array([0, *(x * ((1 << PRIOR_BITS) - (1 << ID_BITS)) // _shares[-1] for x in _shares)], np.uint64) + np.arange((1 << ID_BITS) + 1, dtype=np.uint64)
#: Where an id's counts end, less all counts; the id at each count of the prior.
PRIOR_LESS = PRIOR[1:] - PRIOR[-1]
PRIOR_ID = np.repeat(np.arange(1 << ID_BITS, dtype=np.uint16), np.diff(PRIOR).astype(np.int64))
#: The coder's range stays above the first; a word is out when the rest is below the second.
LEAST, WORD = np.uint64(1 << 40), np.uint64(1 << 48)
#: A table takes a new id when it trusts its own less than this.
DOUBT = 12_000


class _Lanes:
    """The models and the coders of the lanes of some blocks, longest lane first, that are coded in step."""

    def __init__(self, sizes: list[int], cuts: list[int]):
        """``sizes`` ids of each block, in ``cuts`` lanes."""
        each = [-(-s // c) for s, c in zip(sizes, cuts)]
        lengths = np.concatenate([np.clip(s - np.arange(c) * e, 0, e) for s, c, e in zip(sizes, cuts, each)])
        #: Lanes in the order of the arrays; one block's stay in their order, whatever else is coded beside it
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        #: The number of lanes that have an id at each step
        self.alive = np.searchsorted(-self.lengths, -np.arange(int(self.lengths[0])), "left").tolist()
        n = len(lengths)
        bits = np.array([min(max(s.bit_length(), LEAST_TABLE_BITS), TABLE_BITS) for s in sizes])
        slots = 1 << bits
        of = np.repeat(np.arange(len(sizes)), cuts)[self.order]
        self.base, self.mask, self.down = (np.cumsum(slots) - slots)[of], (slots - 1).astype(np.int32)[of], (32 - bits).astype(np.uint32)[of]
        #: Of each slot the expected id, and in the lower half its trust
        self.tables = [np.full(int(slots.sum()), DOUBT, np.uint32) for _ in range(2)]
        self.weights = np.full((3, n), 24000, np.int32)
        self.rate, self.other = np.full(n, 32768, np.int32), np.full(n, 8192, np.int32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first lanes: the likelier id, the other one, and their counts of 2**16."""
        k = len(one)
        mixed = (one.view(np.uint32) * 0x9E3779B1 + two.view(np.uint32) * 0x85EBCA6B) >> self.down[:k]
        self.slots = self.base[:k] + (one & self.mask[:k]), self.base[:k] + mixed
        held = [t.take(s, mode="wrap") for t, s in zip(self.tables, self.slots)]
        self.named = e1, e2 = [(h >> 16).view(np.int32) for h in held]
        self.sure = t1, t2 = [(h & 0xFFFF).view(np.int32) for h in held]
        apart = e1 ^ e2
        self.differ = apart != 0
        a = e1 ^ apart * (t2 >= t1)
        against = (np.minimum(t1, t2) >> 4) + (self.differ.view(np.int8) * np.int32(4096))
        self.inputs = [STRETCH.take(x, mode="wrap") for x in (np.maximum(t1, t2) >> 4, against, self.rate[:k] >> 4)]
        w = self.weights[:, :k]
        dot = (self.inputs[0] * w[0] + self.inputs[1] * w[1] + self.inputs[2] * w[2]) >> 16
        # beyond the ends of the table its ends hold
        self.mixed = SQUASH.take(dot + 2048, mode="clip")
        for_a = self.mixed << 4
        for_b = ((65536 - for_a) * (self.other[:k] >> 4) >> 12) * self.differ
        return a, a ^ apart, for_a, for_b

    def learn(self, ids: np.ndarray, hit: np.ndarray, b: np.ndarray) -> None:
        k = len(ids)
        for table, s, own, sure in zip(self.tables, self.slots, self.named, self.sure):
            half = sure >> 1
            sure = half + (sure - half + (65535 - sure >> 2)) * (own == ids)
            own = own + (ids - own) * (sure < DOUBT)
            table[s] = (own << 16 | np.maximum(sure, DOUBT)).view(np.uint32)
        err = ((hit.astype(np.int32) << 12) - self.mixed) * 6
        for x, w in zip(self.inputs, self.weights):
            w[:k] += (x * err + 0x8000) >> 16
        rate, other = self.rate[:k], self.other[:k]
        rate += (hit * np.int32(65535) - rate) >> 5
        other += ((256 + (ids == b) * np.int32(61184) - other) >> 5) * (self.differ & ~hit)

    def narrow(self, start: np.ndarray, end: np.ndarray, bits: int) -> None:
        k = len(start)
        part = self.range[:k] >> bits
        self.low[:k] += part * start
        self.range[:k] = part * (end - start)

    def choose(self, is_a: np.ndarray, is_rest: np.ndarray, for_a: np.ndarray, for_b: np.ndarray) -> None:
        """Code that an id is the likelier one, the other one or none of them."""
        not_a = ~is_a
        start = for_a * not_a + for_b * is_rest
        end = for_a + for_b * not_a + (65536 - for_a - for_b) * is_rest
        self.narrow(start.astype(np.uint64), end.astype(np.uint64), 16)

    def name(self, ids: np.ndarray, is_rest: np.ndarray) -> None:
        """Code an id that is none of them by the prior; the others take all of it."""
        self.narrow(PRIOR.take(ids, mode="wrap") * is_rest, PRIOR_LESS.take(ids, mode="wrap") * is_rest + PRIOR[-1], PRIOR_BITS)

    def ready(self, k: int):
        """Lanes, which of them have a next word that is settled, and the word; they are shifted by it.

        That is all lanes at first, then those that have one more, until none has.
        """
        at: slice | np.ndarray = slice(0, k)
        low, span = self.low[at], self.range[at]
        settled = (low ^ (low + span)) < WORD
        moved = settled | (span < LEAST)
        while moved.any():
            # a range that a carry could still reach ends before it
            if len(cut := np.flatnonzero(moved & ~settled)):
                span[cut] = (~low[cut] + np.uint64(1)) & (LEAST - np.uint64(1))
            moved = moved.astype(np.uint64)
            yield at, moved, low >> 48
            shift = moved << 4
            low, span = low << shift, span << shift
            self.low[at], self.range[at] = low, span
            settled = (low ^ (low + span)) < WORD
            more = np.flatnonzero(settled | (span < LEAST))
            at = more if isinstance(at, slice) else at[more]
            low, span, settled, moved = low[more], span[more], settled[more], np.ones(len(more), bool)


def encode_blocks(blocks: list[np.ndarray], lane_ids: int = LANE_IDS) -> list[bytes]:
    """One payload for each block of ids, in lanes of about ``lane_ids``."""
    if not blocks:
        return []
    if max(int(b.max(initial=0)) for b in blocks) >> ID_BITS:
        raise ValueError(f"an id has more than {ID_BITS} bits")
    sizes = [len(b) for b in blocks]
    cuts = [min(max(1, -(-s // lane_ids)), LANES) for s in sizes]
    lanes = _Lanes(sizes, cuts)
    n, longest = len(lanes.order), len(lanes.alive)
    ids = np.zeros((longest, n), np.int32)
    place = np.argsort(lanes.order)
    starts = np.cumsum(cuts) - cuts
    for b, c, first in zip(blocks, cuts, starts):
        step = -(-len(b) // c)
        flat = np.zeros(step * c, np.int32)
        flat[: len(b)] = b
        ids[:step, place[first : first + c]] = flat.reshape(c, step).T
    room = longest * 3 + 8
    out, used = np.zeros(n * room, np.uint16), np.arange(n) * room
    one = two = np.zeros(n, np.int32)
    for own, k in zip(ids, lanes.alive):
        own = own[:k]
        a, b, for_a, for_b = lanes.predict(one[:k], two[:k])
        is_a = own == a
        is_rest = ~(is_a | (own == b) & (for_b > 0))
        lanes.choose(is_a, is_rest, for_a, for_b)
        lanes.name(own, is_rest)
        for at, moved, word in lanes.ready(k):
            # a word of a lane that has none is written over by its next one
            to = used[at]
            out[to] = word
            used[at] = to + moved.view(np.int64)
        lanes.learn(own, is_a, b)
        one, two = own, one
    used -= np.arange(n) * room
    out = out.astype(">u2").reshape(n, room)
    payloads = []
    for b, c, first in zip(blocks, cuts, starts):
        rows = place[first : first + c]
        words = used[rows]
        body = b"".join([out[row, :w].tobytes() + struct.pack(">Q", int(lanes.low[row])) for row, w in zip(rows.tolist(), words.tolist())])
        payloads.append(MAGIC + struct.pack("<III", len(b), zlib.crc32(b.astype("<u4").tobytes()), c) + words.astype("<u4").tobytes() + body)
    return payloads


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload, in the order given."""
    if not payloads:
        return []
    sizes, sums, cuts, bodies, starts, far = [], [], [], [], [], 0
    for p in payloads:
        if p[:4] != MAGIC or len(p) < 16:
            raise ValueError("not a token block")
        size, crc, cut = struct.unpack("<III", p[4:16])
        words = np.frombuffer(p, "<u4", cut, 16).astype(np.int64) + 4 if len(p) >= 16 + 4 * cut else np.zeros(0, np.int64)
        if not cut or 16 + 4 * cut + 2 * int(words.sum()) != len(p):
            raise ValueError("a token block is damaged")
        sizes, sums, cuts = [*sizes, size], [*sums, crc], [*cuts, cut]
        bodies.append(np.frombuffer(p, np.dtype(">u2"), -1, 16 + 4 * cut))
        starts.append(np.cumsum(words) - words + far)
        far += len(bodies[-1])
    lanes = _Lanes(sizes, cuts)
    data, at = np.concatenate(bodies).astype(np.uint64), np.concatenate(starts)[lanes.order]
    code = data[at] << 48 | data[at + 1] << 32 | data[at + 2] << 16 | data[at + 3]
    at += 4
    n = len(at)
    ids = np.zeros((len(lanes.alive), n), np.int32)
    one = two = np.zeros(n, np.int32)
    for t, k in enumerate(lanes.alive):
        a, b, for_a, for_b = lanes.predict(one[:k], two[:k])
        part, ahead = lanes.range[:k] >> 16, code[:k] - lanes.low[:k]
        is_a, is_rest = ahead < part * for_a.astype(np.uint64), ahead >= part * (for_a + for_b).astype(np.uint64)
        lanes.choose(is_a, is_rest, for_a, for_b)
        place = np.minimum((code[:k] - lanes.low[:k]) // (lanes.range[:k] >> PRIOR_BITS), PRIOR[-1] - np.uint64(1))
        left = PRIOR_ID.take(place.view(np.int64), mode="wrap").astype(np.int32)
        own = b + (a - b) * is_a + (left - b) * is_rest
        lanes.name(own, is_rest)
        for of, moved, _ in lanes.ready(k):
            place = at[of]
            code[of] = code[of] << (moved << 4) | data.take(place, mode="clip") * moved
            at[of] = place + moved.view(np.int64)
        lanes.learn(own, is_a, b)
        ids[t, :k] = own
        one, two = own, one
    out, place, first = [], np.argsort(lanes.order), 0
    for size, crc, cut in zip(sizes, sums, cuts):
        got = ids[: -(-size // cut), place[first : first + cut]].T.reshape(-1)[:size].astype("<u4")
        if zlib.crc32(got.tobytes()) != crc:
            raise ValueError("a token block is damaged")
        out.append(got)
        first += cut
    return out


class WordTokens:
    """Ids of whole texts by the public tokenizers library, which is asked once for each distinct word.

    A slice of texts is cut into words as one array of bytes: runs of letters, of signs, single digits and the vocabulary's
    contractions. That covers ASCII and the letters of Latin-1, whose lower case, composition and kind need no context.
    Whatever holds other characters or an added token goes to the library as it is, up to a place where words always end
    and no character acts on the next: white space, or between a letter or digit and an ASCII sign or digit. Words of up to
    16 bytes are two numbers, which are found in a hash table by comparing them whole; the others are found in a dict.
    """

    def __init__(self, path: str):
        # tasks already run side by side
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: For words that are cut and in lower case already, with blanks between them; a word's last id is an end
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_end = np.zeros(1 << ID_BITS, bool)
        self.is_end[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.specials = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self._forget()

    def _forget(self) -> None:
        """Start anew with one word, the line end after each text, whose id is the end id."""
        self.flat, self.first, self.count = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.words, self.ids_held, self.others = 1, 1, {}
        self.count[0] = 1
        self._table(SLOT_BITS)
        self._insert(np.array([10], np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int32))

    def _table(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.one, self.two, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _home(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return ((one ^ (two * 0xC2B2AE3D27D4EB4F)) * 0x9E3779B97F4A7C15 >> (64 - self.bits)).astype(np.int64)

    def _insert(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        """Put new words into the first free slots from their homes on."""
        if (self.used + len(one)) * 2 > len(self.one):
            at = np.flatnonzero(self.one)
            before = self.one[at], self.two[at], self.number[at]
            self._table(max(self.bits + 1, (2 * (len(at) + len(one))).bit_length()))
            self._insert(*before)
        slot, mask, left = self._home(one, two), len(self.one) - 1, np.arange(len(one))
        while len(left):
            s = slot[left]
            free = self.one[s] == 0
            # of those that meet in a free slot one gets it
            s, new = s[free], left[free]
            self.number[s] = numbers[new]
            got = self.number[s] == numbers[new]
            self.one[s[got]], self.two[s[got]] = one[new[got]], two[new[got]]
            left = np.concatenate((left[~free], new[~got]))
            slot[left] = (slot[left] + 1) & mask
        self.used += len(one)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keep the ids of new words; gives their numbers."""
        words, held = self.words + len(counts), self.ids_held + len(ids)
        if words > len(self.first):
            self.first, self.count = (np.concatenate((x[: self.words], np.zeros(2 * words - self.words, np.int32))) for x in (self.first, self.count))
        if held > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.ids_held], np.zeros(2 * held - self.ids_held, "<u4")))
        self.count[self.words : words] = counts
        self.first[self.words : words] = np.cumsum(counts) - counts + self.ids_held
        self.flat[self.ids_held : held] = ids
        numbers = np.arange(self.words, words)
        self.words, self.ids_held = words, held
        return numbers

    def _learn(self, texts: list[str]) -> np.ndarray:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._keep(np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64))

    def _learn_words(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The same for words of up to 16 bytes, many of which are a text with blanks between them."""
        raw = np.full((len(one), 17), ord(" "), np.uint8)
        raw[:, :8], raw[:, 8:16] = one.astype("<u8").view(np.uint8).reshape(-1, 8), two.astype("<u8").view(np.uint8).reshape(-1, 8)
        texts = [x[x != 0].tobytes().decode() for x in (raw[k : k + 256] for k in range(0, len(raw), 256))]
        ids = np.array([i for e in self.plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != len(one) or ends[-1] != len(ids) - 1:
            # a vocabulary that lacks a byte
            return self._learn([w for text in texts for w in text.split(" ")[:-1]])
        return self._keep(ids, np.diff(ends, prepend=-1))

    def _numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The numbers of words of up to 16 bytes; new ones are learned."""
        slot, mask = self._home(one, two), len(self.one) - 1
        out = self.number[slot]
        open_ = np.flatnonzero((self.one[slot] != one) | (self.two[slot] != two))
        new = []
        while len(open_):
            s = slot[open_]
            met = (self.one[s] == one[open_]) & (self.two[s] == two[open_])
            out[open_[met]] = self.number[s[met]]
            free = self.one[s] == 0
            new.append(open_[free])
            open_ = open_[~(met | free)]
            slot[open_] = (slot[open_] + 1) & mask
        if new and len(new := np.concatenate(new)):
            order = new[np.lexsort((two[new], one[new]))]
            x, y = one[order], two[order]
            fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            numbers = self._learn_words(x[fresh], y[fresh])
            self._insert(x[fresh], y[fresh], numbers)
            out[order] = numbers[np.cumsum(fresh) - 1]
        return out

    def _cut(self, raw: bytes, n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of ``raw[:n]``: where they start and end, their kinds; and the bytes in lower case."""
        kind, low = np.frombuffer(bytearray(raw[:n].translate(KINDS)), np.uint8), np.frombuffer(bytearray(raw.lower()), np.uint8)
        if not raw.isascii():
            lead = np.flatnonzero(low[:n] == 0xC3)
            after = low[lead + 1]
            letter = (after != 0x97) & (after != 0xB7)
            lead, after = lead[letter], after[letter]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead + 1] = np.where(after <= 0x9E, after + 0x20, after)
        if any(t in raw for t in self.added):
            for m in self.specials.finditer(raw):
                kind[m.start() : m.end()] = OTHER
        kind[ends] = STOP
        if len(other := np.flatnonzero(kind == OTHER)):
            bounds = np.concatenate(([0], np.flatnonzero(CUTS[kind[:-1] << 3 | kind[1:]]) + 1, [n]))
            whole = np.searchsorted(bounds, other, "right")
            whole = whole[np.append(True, whole[1:] != whole[:-1])]
            turn = np.zeros(n + 1, np.int8)
            turn[bounds[whole - 1]] += 1
            turn[bounds[whole]] -= 1
            kind[np.cumsum(turn[:n], dtype=np.int8).view(bool)] = OTHER
        edge = np.append(True, kind[1:] != kind[:-1])
        edge |= (kind == DIGIT) | (kind == STOP)
        at = np.flatnonzero(edge)
        to, sort = np.append(at[1:], n), kind[at]
        quote = np.flatnonzero((low[at] == ord("'")) & (to - at == 1) & (sort == SIGN))
        quote = quote[sort[quote + 1] == LETTER]
        p, room = at[quote], to[quote + 1] - at[quote + 1]
        x, y = low[p + 1], low[p + 2]
        long = (room > 1) & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        extra = np.where(long, 2, SHORT[x])
        to[quote] += extra
        at[quote + 1] += extra
        held = (sort != SPACE) & (to > at)
        return at[held], to[held], sort[held], low

    def _slice(self, texts: list[bytes], end: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the numbers of ids up to each text's end; the last text goes on in the next slice if not ``whole``."""
        if self.words > KNOWN_WORDS or self.ids_held > KNOWN_IDS:
            self._forget()
        self.flat[0] = end
        raw = b"\n".join(texts) + b"\n" + bytes(16)
        n = len(raw) - 16
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        at, to, sort, low = self._cut(raw, n, ends if whole else ends[:-1])
        size = to - at
        eights = np.ndarray(n + 9, "<u8", low, strides=(1,))
        one, two = eights[at] & FIRST_BYTES[np.minimum(size, 8)], np.zeros(len(at), np.uint64)
        more = np.flatnonzero(size > 8)
        two[more] = eights[at[more] + 8] & FIRST_BYTES[np.minimum(size[more] - 8, 8)]
        hard = np.flatnonzero((sort == OTHER) | (size > 16))
        one[hard], two[hard] = 10, 0
        number = self._numbers(one, two)
        if len(hard):
            own = [raw[i:j] for i, j in zip(at[hard].tolist(), to[hard].tolist())]
            if new := list({w for w in own if w not in self.others}):
                self.others.update(zip(new, self._learn([w.decode() for w in new]).tolist()))
            number[hard] = [self.others[w] for w in own]
        counts = self.count[number]
        upto = np.cumsum(counts, dtype=np.int64)
        ids = self.flat[np.repeat(self.first[number] - (upto - counts), counts) + np.arange(counts.sum())]
        return ids, upto[sort == STOP]

    def ids(self, texts: Iterable[str | None], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of many texts, each with the end id after it, and the number of ids of each text that ends here."""
        part, size, open_ = [], 0, 0

        def done(whole: bool) -> tuple[np.ndarray, np.ndarray]:
            nonlocal part, size, open_
            ids, upto = self._slice(part, end, whole)
            counts = np.diff(upto, prepend=-open_)
            part, size, open_ = [], 0, len(ids) - int(upto[-1]) if len(upto) else open_ + len(ids)
            return ids, counts

        for text in texts:
            raw, start = (text or "").encode(), 0
            # a long text goes on after a blank
            while len(raw) - start > 2 * SLICE_CHARS and (blank := raw.find(b" ", start + SLICE_CHARS)) >= 0:
                part.append(raw[start:blank])
                start = blank + 1
                yield done(False)
            part.append(raw[start:])
            size += len(part[-1])
            if size >= SLICE_CHARS:
                yield done(True)
        if part:
            yield done(True)


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Encode and write: rows ``part, block, payload`` and, with a null payload, ``part, doc_id, row, n_tokens``."""
    path = path or default_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, held, size, row, block, part = load(path), [], 0, 0, 0, 0

        def coded(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, size, block
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            whole = len(flat) if last else len(flat) // BLOCK_IDS * BLOCK_IDS
            held, size = [flat[whole:]], len(flat) - whole
            for k in range(0, whole, BLOCK_IDS):
                ids = flat[k : min(k + BLOCK_IDS, whole)]
                (payload,) = encode_blocks([ids], min(max(math.isqrt(len(ids)) // 2, FILE_LANE_IDS[0]), FILE_LANE_IDS[1]))
                yield pd.DataFrame({"part": part, "block": [block], "payload": [payload], "doc_id": None, "row": None, "n_tokens": None})
                block += 1

        for rows in frames:
            part = int(rows["part"].iloc[0]) if len(rows) else part
            counts = [np.zeros(0, np.int64)]
            for ids, each in tokens.ids(rows["text"], end):
                held.append(ids)
                counts.append(each)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield from coded(False)
            counts = np.concatenate(counts)
            yield pd.DataFrame({"part": part, "block": None, "payload": None, "doc_id": rows["doc_id"], "row": range(row, row + len(counts)), "n_tokens": counts})
            row += len(counts)
        yield from coded(True)

    # ranges by id, and by text where many rows share an id; their number is set, as each is much work for few bytes
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = texts.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id())
    schema = "part int, block int, payload binary, doc_id long, row int, n_tokens long"
    return materialize(ordered.select("part", "doc_id", "text").mapInPandas(run, schema), "tokens")


def read(files: DataFrame) -> DataFrame:
    """Read back: ``doc_id, start, n_tokens, ids_crc32`` of every document of the files.

    Ids of all parts before give a part its start; blocks are decoded where they lie, and each gives the CRC state of
    the pieces of documents that it holds.
    """
    directory = files.where("payload is null").select("part", "doc_id", "row", F.col("n_tokens"))
    sizes = directory.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = directory.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("row", "doc_id", "n_tokens"))).alias("docs"))

    def run(blocks: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"part": [], "doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []})
        payloads = list(blocks.sort_values("block")["payload"])
        ids = np.concatenate([decode_blocks([p])[0] for p in payloads])
        own = docs["docs"].iloc[0]
        counts = np.array([d["n_tokens"] for d in own], np.int64)
        starts = np.cumsum(counts) - counts
        crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(starts, counts)]
        return pd.DataFrame({"part": int(docs["part"].iloc[0]), "doc_id": pd.array([d["doc_id"] for d in own], dtype="Int64"), "start": starts, "n_tokens": counts, "ids_crc32": crc})

    # a set number again: one that follows the bytes would make few tasks of much work
    parts = max(1, sizes.count())
    blocks = files.where("payload is not null").select("part", "block", "payload").repartition(parts, "part")
    places = places.repartition(parts, "part")
    got = blocks.groupBy("part").cogroup(places.groupBy("part")).applyInPandas(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return got.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
