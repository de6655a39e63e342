"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word unigram base.

Every text is cut into words (64-bit hashes) and subword ids once; all later passes read those.  Subword ids fall into
classes of equal mass.  A token's log-odds over the classes are the sum of what the attention model makes of the tokens
before it and of a prior, the classes counted after the buckets of the last two ids; counts after the bucket of the last id
give the token within its class.  The probabilities of all ids add up to 1.  Words, ids and pairs are counted over all
training documents, in tables of a fixed size whatever the corpus.  The model is trained by rounds of local training in
each task over its windows and averaging of the weights; each round takes its share of the windows, so that all rounds
together are one pass over all of them.  What returns to the driver is one set of weights and the tables.

Scoring reads whole texts in blocks.  A block of tokens sees itself causally and the whole block before it: windows
overlap by half, and each token is scored once, in batches of blocks with one masked attention.

The base score needs the count of every word of the corpus.  The most frequent words, up to a fixed number, are sent to
every task; a text's other words are joined with the counts by a shuffle, so nothing that grows with the corpus is
broadcast.
"""

from __future__ import annotations

import ctypes
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packing, shingling
from .packing import encoder
from .shingling import word_hashes

#: Words whose counts are sent to every task, at most.
FREQUENT_WORDS = 1 << 19
#: Bytes of texts whose words are looked up at a time, about.
LOOKED_UP_BYTES = 8 << 20
#: Stand before a text's first word and at its end; texts with such characters are not cut word by word.
FIRST, LAST = b"\t", b"\r"
#: Words that a task holds before it counts them.
MOST_HELD = 4_000_000
#: Tokens of a block; a token sees its block and the one before.
BLOCK = 16
WIDTH, CLASSES, BUCKETS, SHARED = 16, 64, 1024, 64
#: Buckets of the ids before a token, for the counted pairs.
PREVIOUS = 512
#: Weights, in tokens, of the coarser distribution: of an id within its class, of a class after one id and after two.
WITHIN_WEIGHT, ONE_WEIGHT, TWO_WEIGHT = 4, 8, 16
#: Parts in which the counts of pairs are added up; they divide PREVIOUS.
PARTS = 64
ROUNDS, BATCH, STEP = 3, 64, 5e-3
#: A task's training in a round goes over its windows once, or again and again up to so many steps.
LEAST_STEPS = 150
#: Windows that a task holds, and brings into random order, at a time.
MIXED = 1 << 14
#: Batches whose ids are looked up at a time.
LOOKED_UP = 16
#: Tokens that are scored at a time; what they need fits a core's cache.
AT_ONCE = 1 << 12
END_OF_TEXT = 50256
VOCABULARY = 50257
#: Bytes of an array from which its memory goes back to the system when it is freed, and of free memory that is kept.
LARGE_ARRAY, KEPT_FREE = 4 << 20, 16 << 20
#: The end of a text, as a word.
END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))

WORD, TOKEN = 0, 1
SPAN = 2 * BLOCK
#: Sizes of the tables of pairs: classes after two buckets, ids after one.
TABLES = (PREVIOUS * PREVIOUS * CLASSES, PREVIOUS * VOCABULARY)
#: Cells of the second table that are listed, at most; with more, all of it is held.
MOST_CELLS = TABLES[1] // 8


def settle() -> None:
    """Frees what cutting left in this process, and has arrays of a batch use the same memory again.

    glibc's own thresholds give it back after every array of some 100 kB: getting it anew takes longer than the arithmetic.
    """
    shingling._words.clear()
    _words.clear()
    packing._encoders.clear()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, LARGE_ARRAY)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, KEPT_FREE)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def subwords(text: str | None, path: str) -> np.ndarray:
    """The subword ids of the text with A-Z lower-cased, between two end-of-text ids."""
    lowered = (text or "").encode().translate(common.LOWER_TABLE).decode()
    ids = array("H", (END_OF_TEXT,))
    ids.extend(encoder(path)(lowered))
    ids.append(END_OF_TEXT)
    return np.frombuffer(ids, dtype=np.uint16)


class Words(dict):
    """Numbers of words by what stands before them, and of each number the word's hash and its subword ids.

    The split rule begins a new piece at a single space and at a single line feed, so where only these part a text's words,
    its ids are those of its words one after another.  A key is the word after the space or the line feed before it, or
    after FIRST at the beginning; LAST, alone, is the end of a text: its ids are that end and the beginning of the next.
    """

    def __init__(self, path: str):
        self.path, self.encode = path, encoder(path)
        self.runs = re.compile(r"\s\s")
        self.line_feed = self.encode("\n")
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[LAST] = 0
        self.hashes, self.ids = np.array([END_WORD]), np.array([END_OF_TEXT, END_OF_TEXT], dtype=np.uint16)
        self.start, self.size = np.zeros(1, np.int64), np.full(1, 2)

    def plain(self, text: str | None) -> bytes | None:
        """The text with A-Z lower-cased; None if other white space parts words, or its ids are not to be had word by word."""
        if not text or not isinstance(self.encode, packing.Encoder) or len(self.line_feed) != 1 or text[0].isspace() or text[-1].isspace():
            return None
        low = text.encode().translate(common.LOWER_TABLE)
        if b"\t" in low or b"\r" in low or b"\v" in low or b"\f" in low:
            return None
        if low.isascii():
            return None if b"  " in low or b" \n" in low or b"\n " in low or b"\n\n" in low else low
        return None if self.runs.search(text) else low

    def learn(self, keys: list[bytes]) -> None:
        """Hashes and ids of keys met for the first time, from one text of all of them, parted by line feeds."""
        self.update(zip(keys, range(len(self), len(self) + len(keys)), strict=True))
        words = [k[1:] for k in keys]
        before = np.frombuffer(b"".join([k[:1] for k in keys]), dtype=np.uint8)
        ids = np.array(self.encode(b"\n".join([k if k[0] == 32 else k[1:] for k in keys]).decode()), dtype=np.uint16)
        ends = np.append(np.flatnonzero(ids == self.line_feed[0]), len(ids))
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not part words at line feeds")
        feed = before == 10  # the line feed that parts such a word from the one before is its first id; others go
        kept = np.ones(len(ids) + 1, dtype=bool)
        kept[0], kept[ends[:-1] + 1] = feed[0], feed[1:]
        size = np.diff(ends, prepend=-1) - 1 + feed
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.append(np.uint16(self.line_feed[0]), ids)[kept])
        self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))

    def numbers(self, low: list[bytes]) -> np.ndarray:
        """Of the words of plain texts, one after another; each distinct key is looked up once."""
        joined = b"".join(x for text in low for x in (FIRST, text, LAST))
        at = np.frombuffer(joined, dtype=np.uint8)
        starts = np.flatnonzero((at == 32) | (at == 10) | (at == FIRST[0]) | (at == LAST[0]))
        offsets = np.append(starts, len(at)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = np.arange(len(self), len(self) + len(fresh))
            self.learn([keys[i] for i in fresh.tolist()])
        return found.take(coded.indices.to_numpy())

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Of each text the hashes of its words, the end last, and its ids as subwords() gives them."""
        words, ids, low, which = [b""] * len(texts), [b""] * len(texts), [], []

        def flush():
            number = self.numbers(low)
            last = np.append(-1, np.flatnonzero(number == 0)) + 1
            for lo in range(0, len(which), 32):  # arrays that fit a core's cache
                edges = last[lo : lo + 33]
                some = number[edges[0] : edges[-1]]
                hashes, size = self.hashes.take(some).tobytes(), self.size.take(some)
                ends = np.cumsum(size)
                flat = np.full(ends[-1] + 1, END_OF_TEXT, dtype=np.uint16)
                self.ids.take(np.repeat(self.start.take(some) - ends + size, size) + np.arange(ends[-1]), out=flat[1:], mode="clip")
                flat, edges = flat.tobytes(), edges - edges[0]
                cuts = np.append(0, ends)[edges].tolist()
                for i, a, b, c, d in zip(which[lo : lo + 32], edges[:-1].tolist(), edges[1:].tolist(), cuts[:-1], cuts[1:], strict=True):
                    words[i], ids[i] = hashes[8 * a : 8 * b], flat[2 * c : 2 * d]
            low.clear()
            which.clear()
            if len(self) > shingling.MOST_WORDS:
                self.reset()

        held = 0
        for i, text in enumerate(texts):
            found = self.plain(text)
            if found is None:
                words[i], ids[i] = np.append(word_hashes(text), END_WORD).tobytes(), subwords(text, self.path).tobytes()
                continue
            low.append(found)
            which.append(i)
            held += len(found)
            if held > LOOKED_UP_BYTES:
                flush()
                held = 0
        if low:
            flush()
        return words, ids


_words: dict[str, Words] = {}


def cut(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, turn (the round of a text's first window), words (hashes of 64 bits each, the end last) and ids (16 bits each).

    docs: doc_id, held_out, text.
    """

    def run(batches):
        if path not in _words:
            _words[path] = Words(path)
        for batch in batches:
            words, ids = _words[path](batch.column(2).to_pylist())
            turns = [xxhash.xxh3_64_intdigest(str(d)) % ROUNDS for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, pa.int32()), pa.array(words, pa.binary()), pa.array(ids, pa.binary())], names=["doc_id", "held_out", "turn", "words", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, turn int, words binary, ids binary")


def hashes_of(column: pa.Array) -> np.ndarray:
    """All words' hashes, one text after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts, one text after another and an end before the first, and where each text's first target lies.

    As every text ends with an end, the two ids before any target are always the two places before it.
    """
    ids = np.frombuffer(np.uint16(END_OF_TEXT).tobytes() + b"".join(column.to_pylist()), dtype=np.uint16)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return ids, np.cumsum(sizes) - sizes + 2


def stretches(ids: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' targets in stretches of a length: text, number within it, place of the first target, how many targets."""
    n = np.append(first[1:], len(ids) + 1) - 1 - first
    many = -(-n // length)
    text = np.repeat(np.arange(len(first)), many)
    j = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, j, first[text] + j * length, np.minimum(length, n[text] - j * length)


def spread(ids: np.ndarray, place: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Of each stretch the two ids before it and its targets, -1 beyond them."""
    at = np.arange(-2, length)
    out = ids[np.minimum(place[:, None] + at, len(ids) - 1)].astype(np.int32)
    out[at >= sizes[:, None]] = -1
    return out


def gather(texts: DataFrame) -> DataFrame:
    """kind, key, n: partial counts of words and subword ids.  texts: words, ids."""

    def run(batches):
        settle()
        words: list[np.ndarray] = []
        held = 0
        tokens = np.zeros(VOCABULARY, dtype=np.int64)

        def rows(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int8)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

        def flush():
            keys = np.sort(np.concatenate(words))
            words.clear()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            return rows(WORD, keys[starts], np.diff(np.append(starts, len(keys))))

        for batch in batches:
            words.append(hashes_of(batch.column(0)))
            held += len(words[-1])
            ids, first = joined(batch.column(1))
            tokens += np.bincount(ids, minlength=VOCABULARY)
            tokens[END_OF_TEXT] -= len(first) + 1  # those that begin a text are no targets
            if held > MOST_HELD:
                yield flush()
                held = 0
        if words:
            yield flush()
        used = np.flatnonzero(tokens)
        yield rows(TOKEN, used, tokens[used])

    return texts.mapInArrow(run, "kind tinyint, key long, n long")


@dataclass
class Lexicon:
    """Of each subword id: its embedding bucket, its bucket as an earlier id, its class, and its share of the class; mass: classes' counts."""

    bucket: np.ndarray
    previous: np.ndarray
    class_of: np.ndarray
    share: np.ndarray
    mass: np.ndarray


def lexicon(counts: np.ndarray) -> Lexicon:
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), dtype=np.int64)
    rank[order] = np.arange(len(counts))
    mass = np.cumsum(counts[order]) - counts[order]
    class_of = np.empty(len(counts), dtype=np.int32)
    class_of[order] = np.minimum(CLASSES - 1, mass * CLASSES // max(1, counts.sum()))

    def buckets(many):
        own = many - SHARED
        return np.where(rank < own, rank, own + np.arange(len(counts)) % SHARED).astype(np.int32)

    smooth = counts + 0.5
    total = np.bincount(class_of, smooth, minlength=CLASSES)
    return Lexicon(buckets(BUCKETS), buckets(PREVIOUS), class_of, smooth / total[class_of], total)


@dataclass
class Pairs:
    """The counted pairs, packed: each task that needs a table unpacks it once in its process, PREVIOUS / PARTS rows at a time."""

    words: Lexicon
    packed: dict[tuple[int, int], bytes]

    def __getstate__(self):
        return {"words": self.words, "packed": self.packed}

    def _counts(self, kind: int, part: int) -> np.ndarray:
        size = TABLES[kind] // PARTS
        packed = self.packed.get((kind, part))
        return np.zeros(size, np.int64) if packed is None else unpack(packed, size, np.int64)

    @cached_property
    def classes(self) -> np.ndarray:
        """Log-odds of the classes after the buckets of two ids (PREVIOUS * PREVIOUS x CLASSES)."""
        rows = PREVIOUS // PARTS
        out = np.empty((PARTS, rows, PREVIOUS, CLASSES), dtype=np.float32)
        whole = self.words.mass + 0.5  # no class is impossible, not even one without ids
        whole /= whole.sum()
        for part in range(PARTS):
            two = self._counts(0, part).reshape(rows, PREVIOUS, CLASSES)
            one = two.sum(axis=1, keepdims=True)
            coarse = (one + ONE_WEIGHT * whole) / (one.sum(axis=2, keepdims=True) + ONE_WEIGHT)
            out[part] = np.log((two + TWO_WEIGHT * coarse) / (two.sum(axis=2, keepdims=True) + TWO_WEIGHT))
        return out.reshape(-1, CLASSES)

    @cached_property
    def within(self) -> np.ndarray:
        """The log of an id's share of its class after the bucket of one id (PREVIOUS x VOCABULARY)."""
        rows = PREVIOUS // PARTS
        out = np.empty((PREVIOUS, VOCABULARY), dtype=np.float32)
        for part in range(PARTS):
            for i, n in enumerate(self._counts(1, part).reshape(rows, VOCABULARY)):
                of_class = np.bincount(self.words.class_of, n, minlength=CLASSES)
                out[part * rows + i] = np.log((n + WITHIN_WEIGHT * self.words.share) / (of_class[self.words.class_of] + WITHIN_WEIGHT))
        return out

    @cached_property
    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Of within, a bit for every cell with a count, how many come before each 64 bits, and their values; what the others add up from, by id and by bucket and class. None: too many."""
        rows = PREVIOUS // PARTS
        keys, values, of_class, held = [], [], np.zeros((PREVIOUS, CLASSES)), 0
        for part in range(PARTS):
            counts = self._counts(1, part)
            at = np.flatnonzero(counts)
            held += len(at)
            if held > MOST_CELLS:
                return None
            i, y, n = at // VOCABULARY + part * rows, at % VOCABULARY, counts[at]
            np.add.at(of_class, (i, self.words.class_of[y]), n)
            keys.append(i * VOCABULARY + y)
            values.append(np.log((n + WITHIN_WEIGHT * self.words.share[y]) / (of_class[i, self.words.class_of[y]] + WITHIN_WEIGHT)).astype(np.float32))
        by_id, by_class = np.log(WITHIN_WEIGHT * self.words.share), -np.log(of_class + WITHIN_WEIGHT)
        bits = np.zeros(TABLES[1] // 64 + 1, dtype=np.uint64)
        for at in keys:
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.bitwise_count(bits).astype(np.int32)
        return bits, np.cumsum(ones, dtype=np.int32) - ones, np.concatenate(values), by_id.astype(np.float32), by_class.ravel().astype(np.float32)

    def within_of(self, previous: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """within[previous, ids], from the cells with a count where these are few."""
        if self._cells is None:
            return self.within[previous, ids]
        shape = ids.shape
        bits, before, values, by_id, by_class = self._cells
        previous, ids = previous.ravel().astype(np.int64, copy=False), ids.ravel()
        place = previous * VOCABULARY + ids
        word = place >> 6
        up = bits.take(word) << (63 - (place & 63)).astype(np.uint64)  # the cell's bit at the top, those before it below
        hit = up.view(np.int64) < 0
        out = values.take(before.take(word) + np.bitwise_count(up) - 1, mode="clip") if len(values) else np.empty(len(place), np.float32)
        miss = np.flatnonzero(~hit)
        y = ids[miss]
        out[miss] = by_id.take(y) + by_class.take(previous[miss] * CLASSES + self.words.class_of.take(y))
        return out.reshape(shape)


def pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def pair_places(ids: np.ndarray, first: np.ndarray, words: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the two tables: of classes after two ids and of ids after one, over the targets of texts as joined() gives them."""
    target = np.ones(len(ids), dtype=bool)
    target[0] = False
    target[first - 1] = False
    at = np.flatnonzero(target)
    for lo in range(0, len(at), 1 << 18):
        part = at[lo : lo + (1 << 18)]
        y, one = ids[part], words.previous[ids[part - 1]]
        yield (one * PREVIOUS + words.previous[ids[part - 2]]) * CLASSES + words.class_of[y], one * VOCABULARY + y


def add_pairs(of_class: np.ndarray, of_id: np.ndarray, ids: np.ndarray, first: np.ndarray, words: Lexicon) -> None:
    """Counts classes after two ids and ids after one in whole tables."""
    for classes, cells in pair_places(ids, first, words):
        np.add.at(of_class, classes, np.int32(1))
        np.add.at(of_id, cells, np.int32(1))


class Cells:
    """Counts by place in the second table: the places with a count, or the whole table once they are more than MOST_CELLS."""

    def __init__(self):
        self.table: np.ndarray | None = None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, places: np.ndarray) -> None:
        if self.table is not None:
            np.add.at(self.table, places, np.int32(1))
            return
        places = np.sort(places.astype(np.int32))
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.empty(0, np.int64)
        self.held.append((places[starts], np.diff(np.append(starts, len(places))).astype(np.int32)))
        self.size += len(starts)
        if self.size > max(1 << 20, 2 * len(self.held[0][0])):
            self._merge()

    def _merge(self) -> None:
        both = np.concatenate([(p.astype(np.int64) << 32) | n for p, n in self.held])
        both.sort()
        places, n = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int64)
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.empty(0, np.int64)
        places, n = places[starts], np.add.reduceat(n, starts).astype(np.int32) if len(starts) else n.astype(np.int32)
        self.held, self.size = [(places, n)], len(places)
        if self.size > MOST_CELLS:
            self.table = np.zeros(TABLES[1], dtype=np.int32)
            self.table[places] = n
            self.held = []

    def parts(self) -> Iterator[np.ndarray]:
        """The table in PARTS parts."""
        if self.table is None and self.held:
            self._merge()
        size = TABLES[1] // PARTS
        if self.table is not None:
            yield from np.split(self.table, PARTS)
            return
        places, n = self.held[0] if self.held else (np.empty(0, np.int32), np.empty(0, np.int32))
        cuts = np.searchsorted(places, np.arange(PARTS + 1) * size)
        for part in range(PARTS):
            out = np.zeros(size, dtype=np.int32)
            out[places[cuts[part] : cuts[part + 1]] - part * size] = n[cuts[part] : cuts[part + 1]]
            yield out


def count_pairs(texts: DataFrame, words: Lexicon) -> Pairs:
    """Tasks count in tables of a fixed size, which are added up in parts.  texts: ids."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def rows(kind: int, part: int, cells: int, packed: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([cells], pa.int32()), pa.array([packed], pa.binary())], names=["kind", "part", "cells", "n"])

    def run(batches):
        settle()
        of_class, of_id = None, Cells()
        for batch in batches:
            if batch.num_rows:
                of_class = np.zeros(TABLES[0], dtype=np.int32) if of_class is None else of_class
                for classes, cells in pair_places(*joined(batch.column(0)), shared.value):
                    np.add.at(of_class, classes, np.int32(1))
                    of_id.add(cells)
        if of_class is not None:
            for kind, parts in enumerate((np.split(of_class, PARTS), of_id.parts())):
                for part, counts in enumerate(parts):
                    at = np.flatnonzero(counts)  # only cells with a count are sent: steps to them, and counts
                    if len(at):
                        yield rows(kind, part, len(at), pack(np.concatenate([np.diff(at, prepend=0).astype(np.int32), counts[at]])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = part = total = None
        for batch in batches:
            for kind, part, cells, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = np.zeros(TABLES[kind] // PARTS, np.int64) if total is None else total
                steps, counts = unpack(packed, 2 * cells, np.int32).reshape(2, -1)
                total[np.cumsum(steps)] += counts
        if total is not None:
            yield rows(kind, part, 0, pack(total))

    schema = "kind int, part int, cells int, n binary"
    got = texts.mapInArrow(run, schema).groupBy("kind", "part").applyInArrow(add, schema).toArrow()  # at most 2 * PARTS rows
    return Pairs(words, {(r["kind"], r["part"]): r["n"] for r in got.to_pylist()})


SHAPES = {"embed": (BUCKETS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "near": (2 * BLOCK,), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
#: How far back each position of a block sees each of the two blocks' positions, and each position of a window all of it; SPAN: not at all.
BACK = {n: np.where((back := np.arange(n)[:, None] + SPAN - n - np.arange(SPAN)) >= 0, back, SPAN) for n in (BLOCK, SPAN)}
#: A bucket's cells in the flat embedding.
CELLS = np.arange(BUCKETS * WIDTH).reshape(BUCKETS, WIDTH)


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    """Weights to begin with, with which the classes have their prior."""
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k in ("near", "out", "bias") else rng.standard_normal(s) / math.sqrt(s[-1] if k == "embed" else s[0])).astype(np.float32) for k, s in SHAPES.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray, copy: bool = True) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = values[at : at + n].reshape(s).astype(np.float32, copy=copy), at + n
    return out


def fixed(w: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """What a forward pass needs of the weights, for runs of a length.

    both: what takes embeddings to their queries of embeddings, and to what they add where they are attended to; back: what
    is added to scores; shift, shift_out: scores or log-odds could overflow, or all of a row's vanish.
    """
    kind = w["out"].dtype
    ask = w["q"] @ w["k"].T * kind.type(1 / math.sqrt(WIDTH))
    longest = lambda rows: math.sqrt(((rows * rows) @ np.ones(WIDTH, dtype=kind)).max())
    most = longest(w["embed"]) * longest(w["embed"] @ ask) + float(np.abs(w["near"]).max())
    both = np.concatenate([ask, w["v"] @ w["o"]], axis=1)
    return {
        "both": both, "back": np.append(w["near"], kind.type(-1e9)).take(BACK[length]), "out": np.concatenate([w["out"], w["bias"][None]]),
        "shift": not most <= 80, "shift_out": not float(np.abs(w["out"]).sum(axis=0).max() + np.abs(w["bias"]).max()) <= 60,
    }


def seen_of(rows: np.ndarray, at: int, n: int, length: int) -> np.ndarray:
    """Columns of the SPAN rows that each of n runs of a length sees, without a copy: the first of a block's are the block before it."""
    row, one = rows.strides
    return np.ndarray((n, SPAN, WIDTH), rows.dtype, rows, at * one, (length * row, row, one))


def forward(w: dict[str, np.ndarray], buckets: np.ndarray, follows: np.ndarray | None, prior: np.ndarray, classes: np.ndarray, ready: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """logp, the log-probabilities of the given classes (m x BLOCK), and what their gradients need.

    buckets: m x BLOCK; follows: the block continues the one before, the first none; None: every second one does, as in
    windows, which are then attended to at once; prior: log-odds (m * BLOCK x CLASSES); ready: fixed() of the weights.
    x, y: embeddings and their products with both, after a block of zeros unless in windows; p: the attention; h: the
    hidden values and a one; e: exponentials of the log-odds.
    """
    m, kind = len(buckets), w["out"].dtype
    length, lead = (SPAN, 0) if follows is None else (BLOCK, BLOCK)
    n = m * BLOCK // length
    x = np.zeros((lead + m * BLOCK, WIDTH), dtype=kind)
    np.take(w["embed"], buckets.ravel(), axis=0, out=x[lead:], mode="clip")
    ready = ready or fixed(w, length)
    y = x @ ready["both"]
    p = y[lead:].reshape(n, length, 2 * WIDTH)[:, :, :WIDTH] @ seen_of(x, 0, n, length).transpose(0, 2, 1)
    p += ready["back"]
    if follows is not None:
        p[~follows, :, :BLOCK] = -1e9
    if ready["shift"]:
        p -= p.max(axis=2, keepdims=True)
    np.exp(p, out=p)
    rows = p.reshape(-1, SPAN)
    rows *= (1 / (rows @ np.ones(SPAN, dtype=kind)))[:, None]
    a = (p @ seen_of(y, WIDTH, n, length)).reshape(-1, WIDTH)
    h = np.ones((m * BLOCK, WIDTH + 1), dtype=kind)
    hidden = a + x[lead:]
    h[:, :WIDTH] = np.tanh(hidden, out=hidden)
    z = h @ ready["out"]
    z += prior
    if ready["shift_out"]:
        z -= z.max(axis=1, keepdims=True)
    own = z.ravel().take(np.arange(0, z.size, CLASSES) + classes.ravel())
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, dtype=kind)
    return {"x": x, "y": y, "both": ready["both"], "p": p, "a": a, "hidden": hidden, "h": h, "e": z, "total": total, "logp": (own - np.log(total)).reshape(classes.shape)}


def backward(w: dict[str, np.ndarray], f: dict[str, np.ndarray], buckets: np.ndarray, follows: np.ndarray | None, targets: np.ndarray, counted: np.ndarray, into: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over the counted positions; into: arrays that they are written to."""
    m, kind = len(buckets), w["out"].dtype
    length, lead = (SPAN, 0) if follows is None else (BLOCK, BLOCK)
    n = m * BLOCK // length
    g = into or {k: np.empty(s, dtype=kind) for k, s in SHAPES.items()}
    weight = (counted.ravel() / max(1, counted.sum())).astype(kind)
    dz = f["e"]  # overwritten
    dz *= (weight / f["total"])[:, None]
    dz.ravel()[np.arange(0, dz.size, CLASSES) + targets.ravel()] -= weight
    out = f["h"].T @ dz
    g["out"][:], g["bias"][:] = out[:-1], out[-1]
    d = dz @ w["out"].T
    squares = f["hidden"] * f["hidden"]
    d *= np.subtract(1, squares, out=squares)
    da = d.reshape(n, length, WIDTH)
    ds = da @ seen_of(f["y"], WIDTH, n, length).transpose(0, 2, 1)
    ds -= ((d * f["a"]) @ np.ones(WIDTH, dtype=kind)).reshape(n, length, 1)
    ds *= f["p"]
    g["near"][:] = np.bincount(BACK[length].ravel(), ds.sum(axis=0).ravel(), minlength=SPAN + 1)[:SPAN]
    dy = np.empty((m * BLOCK, 2 * WIDTH), dtype=kind)
    parts = dy.reshape(n, length, 2 * WIDTH)
    np.matmul(ds, seen_of(f["x"], 0, n, length), out=parts[:, :, :WIDTH])
    dx = ds.transpose(0, 2, 1) @ f["y"][lead:].reshape(n, length, 2 * WIDTH)[:, :, :WIDTH]
    if follows is None:
        np.matmul(f["p"].transpose(0, 2, 1), da, out=parts[:, :, WIDTH:])
    else:
        dv = f["p"].transpose(0, 2, 1) @ da
        for seen in (dx, dv):
            seen[:-1, BLOCK:] += seen[1:, :BLOCK]  # zero where the block does not follow
        dx, parts[:, :, WIDTH:] = dx[:, BLOCK:], dv[:, BLOCK:]
    both = f["x"][lead:].T @ dy
    scaled = both[:, :WIDTH] * kind.type(1 / math.sqrt(WIDTH))
    g["q"][:], g["k"][:], g["v"][:], g["o"][:] = scaled @ w["k"], scaled.T @ w["q"], both[:, WIDTH:] @ w["o"].T, w["v"].T @ both[:, WIDTH:]
    d += dy @ f["both"].T
    d += dx.reshape(d.shape)
    g["embed"].fill(0)
    np.add.at(g["embed"].reshape(-1), CELLS.take(buckets.ravel(), axis=0).ravel(), d.ravel())
    return g


def rows_of(previous: np.ndarray) -> np.ndarray:
    """Rows of the prior after each two neighbours of the buckets of earlier ids, one stretch a line."""
    return (previous[:, 1:] * PREVIOUS + previous[:, :-1]).ravel()


def prior_of(words: Lexicon, classes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The prior's log-odds after the ids one and, before it, two."""
    return np.take(classes, words.previous[one].ravel() * PREVIOUS + words.previous[two].ravel(), axis=0)


def local_training(w: dict[str, np.ndarray], parts: Iterable[np.ndarray], words: Lexicon, classes: np.ndarray, seed: int) -> tuple[dict[str, np.ndarray], int]:
    """Adam over parts of the windows (n x SPAN + 2 ids, -1 beyond a text's end), and how many windows there were.

    Every window is trained on; only windows for less than LEAST_STEPS are held and gone over again.
    """
    rng = np.random.default_rng(seed)
    values = flat(w)
    w = unflat(values, copy=False)
    m, s, step = np.zeros_like(values), np.zeros_like(values), np.empty_like(values)  # m and s: 10 and 100 times Adam's
    g = unflat(step, copy=False)
    t = n = 0

    def go_over(windows: np.ndarray) -> None:
        nonlocal t
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), LOOKED_UP * BATCH):
            some = windows[order[lo : lo + LOOKED_UP * BATCH]]
            safe = np.maximum(some, 0, dtype=np.intp)
            buckets = words.bucket.take(safe[:, 1:-1]).astype(np.intp).reshape(-1, BLOCK)
            targets = words.class_of.take(safe[:, 2:]).reshape(-1, BLOCK)
            rows = rows_of(words.previous.take(safe[:, :-1]).astype(np.intp))
            counted = (some[:, 2:] >= 0).reshape(-1, BLOCK)
            for at in range(0, len(buckets), 2 * BATCH):
                now = slice(at, at + 2 * BATCH)
                f = forward(w, buckets[now], None, classes.take(rows[at * BLOCK : (at + 2 * BATCH) * BLOCK], axis=0), targets[now])
                backward(w, f, buckets[now], None, targets[now], counted[now], g)
                t += 1
                m[:] *= np.float32(0.9)
                m[:] += step
                step[:] *= step
                s[:] *= np.float32(0.99)
                s[:] += step
                np.sqrt(s, out=step)
                unbiased = math.sqrt(1 - 0.99**t)
                step[:] += np.float32(1e-7 * unbiased)
                np.divide(m, step, out=step)
                step[:] *= np.float32(STEP * unbiased / (1 - 0.9**t))
                values[:] -= step

    few: list[np.ndarray] = []
    for windows in parts:
        go_over(windows)
        n += len(windows)
        few = [*few, windows] if n < LEAST_STEPS * BATCH else []
    if few:
        windows = np.concatenate(few)
        for _ in range(-(-LEAST_STEPS * BATCH // max(n, BATCH)) - 1):
            go_over(windows)
    return w, n


def mixed_parts(batches: Iterable[pa.RecordBatch], turn: int) -> Iterator[np.ndarray]:
    """A round's windows of the batches (turn, ids), about MIXED at a time."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, first = joined(batch.column(1))
        text, j, place, sizes = stretches(ids, first, SPAN)
        ours = np.flatnonzero((j + batch.column(0).to_numpy()[text]) % ROUNDS == turn)
        for lo in range(0, len(ours), MIXED):
            some = ours[lo : lo + MIXED]
            held.append(spread(ids, place[some], sizes[some], SPAN))
            n += len(some)
            if n >= MIXED:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def train(texts: DataFrame, fixed: Broadcast[Pairs]) -> dict[str, np.ndarray]:
    """Rounds of local training and averaging, weighted by windows.  texts: turn and ids."""
    w = fresh()
    context = texts.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast((w, turn))

        def run(batches):
            settle()
            start, turn_ = shared.value
            trained, n = local_training(start, mixed_parts(batches, turn_), fixed.value.words, fixed.value.classes, turn_)
            if n:
                values = flat(trained).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(np.full(len(values), float(n)))], names=["i", "wx", "weight"])

        summed = texts.mapInArrow(run, "i int, wx double, weight double").groupBy("i").agg((F.sum("wx") / F.sum("weight")).alias("x"))
        got = summed.toArrow()  # one row a weight
        if not got.num_rows:  # few windows: none for this round
            continue
        values = np.empty(got.num_rows)
        values[got["i"].to_numpy()] = got["x"].to_numpy()
        w = unflat(values)
    return w


class Scorer:
    def __init__(self, weights: dict[str, np.ndarray], counted: Pairs):
        self.w, self.words, self.counted, self.ready = weights, counted.words, counted, fixed(weights, BLOCK)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """log10 probabilities of whole texts, given as their ids."""
        ids, first = joined(column)
        text, j, place, sizes = stretches(ids, first, BLOCK)
        out = np.zeros(len(first))
        step = AT_ONCE // BLOCK
        for lo in range(0, len(text), step):  # a text goes on from the block before the cut
            a, b = max(0, lo - 1), min(len(text), lo + step)
            block = ids.take(place[a:b, None] + np.arange(-2, BLOCK), mode="clip").astype(np.intp)
            previous = self.words.previous.take(block[:, :-1]).astype(np.intp)
            follows = j[a:b] > 0
            follows[0] = False
            f = forward(self.w, self.words.bucket.take(block[:, 1:-1]).astype(np.intp), follows, self.counted.classes.take(rows_of(previous), axis=0), self.words.class_of.take(block[:, 2:]), self.ready)
            value = f["logp"][lo - a :] + self.counted.within_of(previous[lo - a :, 1:], block[lo - a :, 2:])
            value *= np.arange(BLOCK) < sizes[lo:b, None]
            out += np.bincount(text[lo:b], value.sum(axis=1), minlength=len(out))
        return out / math.log(10)


class Places:
    """Places of keys among sorted keys that are spread evenly, as hashes are: a table by their first bits leads to them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = 64 - max(1, int(len(keys)).bit_length())
        edges = np.arange(1 << (64 - self.shift), dtype=np.int64) - (1 << (63 - self.shift))
        self.start = np.append(np.searchsorted(keys >> self.shift, edges), len(keys)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """-1: not among them."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        first = (wanted >> self.shift) + (1 << (63 - self.shift))
        at, end = self.start[first], self.start[first + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end, wanted = left[on], at[on] + 1, end[on], wanted[on]
        return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """Every document's log10 probabilities under the base and the model, learned from the documents not held out.

    Columns: doc_id, held_out, n_tokens (words and the end), n_known (those that occur in training), train_tokens,
    base_score (add-one unigram of words), score (the attention model, over subword ids and the end).

    A null or empty text is the end alone.  With nothing to learn from, the base knows no words and the model is
    untrained.  Repeated rows count as often as they occur and get equal rows; null ids count as the empty text in folds.
    Very long texts are scored whole, in parts that overlap.  An empty table gives an empty result; further columns are
    ignored.
    """
    path = tokenizer or common.tokenizer_path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    common.small_batches(spark)
    held = held_out if held_out is not None else F.lit(False)
    narrow = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    texts = common.stored(cut(narrow, path))
    learned = texts.where(~F.col("held_out"))
    seen = common.stored(gather(learned.select("words", "ids")).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = seen.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens = np.zeros(VOCABULARY, dtype=np.int64)
    for row in seen.where(F.col("kind") == TOKEN).collect():  # at most VOCABULARY rows
        tokens[row["key"]] = row["n"]
    counted = spark.sparkContext.broadcast(count_pairs(learned.select("ids"), lexicon(tokens)))
    weights = train(learned.select("turn", "ids"), counted)

    # the most frequent words: from the smallest count on that leaves no more than FREQUENT_WORDS
    by_size = counts.groupBy(F.floor(F.log2("c") * 16).alias("size")).agg(F.count("*").alias("words"), F.min("c").alias("least"))
    least, so_far = None, 0
    for row in sorted(by_size.collect(), key=lambda r: -r["size"]):  # at most 16 * 63 rows
        so_far += row["words"]
        if so_far > FREQUENT_WORDS:
            break
        least = row["least"]
    frequent = counts.where(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    keys = frequent["word"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((Places(keys[order]), frequent["c"].to_numpy()[order], weights))

    def run(batches):
        from pyspark import TaskContext

        settle()
        places, known, weights_ = shared.value
        scorer = Scorer(weights_, counted.value)
        logs = np.append(np.log10(known + 1.0), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found, sizes = hashes_of(batch.column(2)), pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            if len(found) >= 1 << 31:
                raise ValueError("a batch of texts has more than 2^31 words: lower spark.sql.execution.arrow.maxRecordsPerBatch")
            ends = np.cumsum(np.append(0, sizes))
            at = places(found)
            hit, log = at >= 0, logs[at]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare_ends = np.append(0, np.cumsum(~hit))[ends]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], pa.array(row + np.arange(len(sizes))), pa.array(sizes, pa.int64()), pa.array(np.bincount(owner, hit, minlength=len(sizes)).astype(np.int64)),
                pa.array(np.bincount(owner, log, minlength=len(sizes))), pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(found[~hit])), pa.array(scorer(batch.column(3))),
            ], names=["doc_id", "held_out", "row", "n_tokens", "known", "logs", "rare", "score"])
            row += len(sizes)

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    scored = common.stored(texts.select("doc_id", "held_out", "words", "ids").mapInArrow(run, f"doc_id {id_type}, held_out boolean, row long, n_tokens long, known long, logs double, rare array<long>, score double"))
    rare = scored.select("row", F.explode("rare").alias("word"))
    fewer = counts.where(F.col("c") < least) if least is not None else counts
    more = rare.join(fewer, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Held out: documents whose crc32 of the id, modulo 7, is 2."""
    return score(common.read(spark, sf_dir, "documents"), held_out=common.crc_fold("doc_id", 7) == 2)
