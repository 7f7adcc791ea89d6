"""Packing of token sequences by minimum bin slack.

Every partition tokenises its documents, cuts whole sequences off those longer than a sequence, and fills sequences with the
remainders of a window of documents. For the longest remainder a subset-sum program over a bitset finds which of the other
lengths, and how many of each, fill what is left closest to capacity; the choice is read back from the bitsets. Where no
choice fills it, the longest remainder left is cut to fit. The last tokens of a partition go to sequences whose lengths are
powers of two. Nothing is shuffled: a sequence's number holds the number of its partition, and a task that runs again packs
its own documents again.

Defined cases: null text is empty; an empty text is the end token alone; rows that share a doc_id, and rows with a null one,
are packed as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

CAPACITY = 2048
#: Remainders that one task holds at a time.
WINDOW = 2048
#: Words that a Python worker keeps for its next task.
KEPT_WORDS = 40_000


# Words of these characters alone take the short way: NFC leaves them as they are, they are lowered one by one, and their
# letters and numbers are the same in every version of Unicode. İ becomes two characters.
_PLAIN = [chr(i) for i in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if i != 0x130]
_SHORT = re.compile(f"[{re.escape(''.join(_PLAIN))}]+")
_LETTERS, _NUMBERS = ("".join(c for c in sorted({c.lower() for c in _PLAIN}) if unicodedata.category(c)[0] == k) for k in "LN")
# Fixed value: the tokeniser's pattern, for such words.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Encodes texts word by word and keeps the ids of words already met, up to a bound.

    The tokeniser's patterns never cross white space, so the ids of a text are those of its words one after another. New words
    of common characters are cut into the tokeniser's pieces here and only the pieces go to its model; others go to it whole.
    """

    #: Bytes of an entry beside its characters, and characters of a piece that isn't kept.
    ENTRY, LONG = 200, 64

    def __init__(self, path: str, most: int = 48 << 20) -> None:
        """most: bytes, about, that the words met take in memory."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held, self.known, self.pieces = Tokenizer.from_file(path), most, 0, {"": b""}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(piece) <= self.LONG:
            self.pieces[piece] = ids
            self.held += self.ENTRY + len(ids)
        return ids

    def learn(self, words: list[str]) -> None:
        known, pieces = self.known, self.pieces
        self.held += sum(map(len, words)) + self.ENTRY * len(words)
        for w in words:
            if _SHORT.fullmatch(w) and "<|" not in w:
                known[w] = b"".join([pieces.get(p) or self.piece(p) for p in _PIECE.findall(w.lower())])
            else:
                known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self, keep: int) -> None:
        """Keeps the first `keep` words, which are frequent ones, and no pieces."""
        self.known = {"": b""} | dict(itertools.islice(self.known.items(), keep))
        self.pieces, self.held = {}, sum(map(len, self.known)) + self.ENTRY * len(self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.held > self.most:
            self.forget(0)
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in split]


def fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Which lengths, and how many of each, come closest to `room` without exceeding it. lengths: how many there are of each."""
    reach, steps, goal = 1, [], 1 << room
    limit = (goal << 1) - 1
    for size in sorted((x for x in lengths if x <= room), reverse=True):
        left, part = min(lengths[size], room // size), 1
        while left > 0 and not reach & goal:
            take = min(part, left)
            steps.append((size, take, reach))
            reach = (reach | reach << size * take) & limit
            left -= take
            part *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + take
            at -= size * take
    return chosen


class Packer:
    """Puts pieces (any values with a length) into sequences; hands out rows (piece, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.pool, self.counts = capacity, first, {}, {}

    def whole(self, piece, start: int, length: int):
        self.next += 1
        return piece, start, length, self.next - 1, 0

    def add(self, piece, start: int, length: int) -> None:
        self.pool.setdefault(length, []).append((piece, start))
        self.counts[length] = self.counts.get(length, 0) + 1

    def take(self, length: int):
        out = self.pool[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.pool[length], self.counts[length]
        return out

    def __len__(self) -> int:
        return sum(self.counts.values())

    def one(self, room: int):
        """Rows of one sequence of exactly `room` tokens; the pool holds as many at least."""
        at = 0
        longest = max(self.counts)
        if longest <= room:
            yield (*self.take(longest), longest, self.next, at)
            at = longest
        for size, times in sorted(fill(self.counts, room - at).items()) if at < room and self.counts else ():
            for _ in range(times):
                yield (*self.take(size), size, self.next, at)
                at += size
        while at < room:
            longest = max(self.counts)
            piece, start = self.take(longest)
            part = min(longest, room - at)
            yield piece, start, part, self.next, at
            if longest > part:
                self.add(piece, start + part, longest - part)
            at += part
        self.next += 1

    def drain(self, down_to: int, last: bool = False):
        total = sum(k * v for k, v in self.counts.items())
        while total >= self.capacity and len(self) > down_to:
            yield from self.one(self.capacity)
            total -= self.capacity
        while last and total:
            room = 1 << (total.bit_length() - 1)
            yield from self.one(room)
            total -= room


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row for each piece."""

    def run(frames):
        encoder = _encoder(tokenizer)
        packer = Packer(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
        held: dict[int, tuple] = {}
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        number = 0

        def put(piece, start, length, sequence, offset):
            doc, raw, base, total = held[piece]
            rows.append((doc, start, length, raw[4 * (start - base) : 4 * (start - base + length)], total, sequence, offset))

        def frame_of():
            nonlocal held
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            # from the rows: with nulls pandas has made floats of them
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            rows.clear()
            waiting = {p for some in packer.pool.values() for p, _ in some}
            held = {p: held[p] for p in waiting}
            return out

        for frame in frames:
            ids, texts = frame["doc_id"].tolist(), frame["text"].fillna("").tolist()
            for at in range(0, len(texts), 256):
                for doc, raw in zip(ids[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    raw, doc = raw + end, None if pd.isna(doc) else int(doc)
                    total = len(raw) // 4
                    base = total - total % capacity
                    held[number] = (doc, raw, 0, total)
                    for start in range(0, base, capacity):
                        put(*packer.whole(number, start, capacity))
                    if base < total:
                        held[number] = (doc, raw[4 * base :], base, total)
                        packer.add(number, base, total - base)
                    number += 1
                if len(packer) >= 2 * window:
                    for row in packer.drain(window):
                        put(*row)
                if len(rows) >= 1000:
                    yield frame_of()
        for row in packer.drain(0, last=True):
            put(*row)
        encoder.forget(KEPT_WORDS)
        yield frame_of()

    plain = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, whose later tasks know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (unsigned) in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
