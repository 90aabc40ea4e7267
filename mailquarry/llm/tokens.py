"""Token ids of whole text columns with the tokenizers library.

The library spends most of its time on text that it has seen before. Here a text is cut into the pieces of the tokenizer's
pre-tokenizer, each distinct piece is encoded once by the library, and the ids of the texts are put together from those. The cut
is only made in texts of characters for which it provably equals the library's own (Latin letters, digits, common
punctuation and white space); any other text goes through the library as a whole. The cut is made over the characters of many texts
at once, as arrays; strings of their own are only the distinct pieces of such a run.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Characters that Unicode normalisation, case mapping and letter classes treat alike in all regex
#: engines: no combining marks, no letters that change length in lower case.
PLAIN = r"^[\t\n\r\x20-\x7E¡-¬®-įı-ž–—‘’“”…€]*$"
#: Letters and numbers among them.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ž", "0-9²³¹¼½¾"
#: Kinds of these characters by code point; none of the texts has a zero, which stands behind each text.
END, LETTER, NUMBER, OTHER, SPACE, WHITE = range(6)
KINDS = np.full(ord("€") + 1, OTHER, dtype=np.uint8)
for _kind, _of in ((LETTER, LETTERS), (NUMBER, NUMBERS), (WHITE, r"\t\n\r")):
    KINDS[[ord(c) for c in re.findall(f"[{_of}]", "".join(map(chr, range(len(KINDS)))))]] = _kind
KINDS[0], KINDS[ord(" ")] = END, SPACE
#: What a worker keeps of pieces and ids at most; beyond, the rarest go. An entry is a string, a number and a place in the table.
MOST_KEPT_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Characters of text that are cut at once; the arrays of it take about ten times that.
CUT_BYTES = 2 << 20


def cut(texts: list[str], by_byte: bool) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(pieces, ends): what the pre-tokenizer keeps together in plain texts, and where each text ends among the pieces, from 0.

    The first kind of tokenizer (``by_byte``) has the pieces ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+``, the second one
    ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|[^\\sLN]+``, with L a letter and N a number; its texts must be in lower case.
    """
    joined = "\0".join((*texts, "", ""))
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kind = KINDS[points]
    before = np.concatenate((KINDS[:1], kind[:-1]))
    first = kind != before
    if by_byte:
        # the last white space before a word is a piece of its own, or the word's if it is a space
        white = kind >= SPACE
        word_next = np.append((kind[1:] != END) & ~white[1:], False)
        first = np.where(white, (before < SPACE) | word_next, first & (before != SPACE))
    else:
        first |= kind == NUMBER
    first |= kind == END
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[first[marks]]
    one, two = points[marks + 1], points[marks + 2]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(long, 3, np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0))
    marks, size = marks[size > 0], size[size > 0]
    first[marks + 1], first[marks + size] = False, True
    starts = np.flatnonzero(first)
    kinds = kind[starts]
    stay = (kinds != END) & (by_byte | (kinds < SPACE))
    ends = np.concatenate(([0], np.cumsum(stay)[kinds == END][:len(texts)]))
    data = joined.encode()
    if len(data) > len(points):
        after = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF))  # no plain character has four bytes
        starts = np.concatenate(([0], after))[starts]
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
    return pieces.filter(pa.array(stay)), ends


def _byte_letters() -> np.ndarray:
    """The letter that a byte-level model has for each byte, as code points; zero stays."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.arange(256, dtype="<u4")
    letters[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    letters[0] = 0
    return letters


BYTE_LETTERS = _byte_letters()


class Slots(dict):
    """Piece to slot; a new piece gets the next slot and is noted."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = len(self)
        self.new.append(piece)
        return slot


class Pool:
    """Distinct pieces with their ids: a lasting hash table to slots, and arrays by slot."""

    def __init__(self):
        self.slots, self.kept, self.hits = Slots(), 0, np.zeros(0, dtype=np.int64)
        self.ids, self.starts, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def places(self, pieces: pa.Array, encode) -> np.ndarray:
        """Slots of pieces; ``encode`` gives (sizes, ids) of those that weren't here."""
        coded = pieces.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.slots.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        new, self.slots.new = self.slots.new, []
        if new:
            sizes, ids = encode(new)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
            self.kept += ENTRY_BYTES * len(new) + sum(map(len, new)) + ids.nbytes
            self.hits = np.concatenate((self.hits, np.zeros(len(new), dtype=np.int64)))
        self.hits[place] += np.bincount(codes, minlength=len(place))
        return place[codes]

    def shrunk(self, most_bytes: int) -> Pool:
        """The pool, or while it is over the bound one of its more frequent pieces of at most half of it."""
        if self.kept <= most_bytes:
            return self
        pieces, least = list(self.slots), 2
        cost = ENTRY_BYTES + np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 4 * self.sizes
        while cost[self.hits >= least].sum() > most_bytes // 2:
            least *= 2
        stay, less = np.flatnonzero(self.hits >= least), Pool()
        for at in stay:
            less.slots[pieces[at]] = len(less.slots)
        ends, less.ids = self.joined(stay)
        less.starts, less.sizes, less.hits, less.kept = ends[:-1], self.sizes[stay], self.hits[stay] // 2, int(cost[stay].sum())
        return less

    def joined(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids) of the pieces at these slots, one after the other."""
        sizes = self.sizes[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ends, self.ids[np.repeat(self.starts[place] - ends[:-1], sizes) + np.arange(ends[-1])]


class Encoder:
    """Encodes text columns; one for each Python worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark runs a task on every core: threads of the library's own wait for each other more than they encode
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            self.by_byte = json.load(file)["pre_tokenizer"].get("use_regex", False)
        self.pieces = Pool()

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _by_model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces through the library's model alone: these tokenizers don't normalise, and a piece needs no further cut."""
        letters = BYTE_LETTERS[np.frombuffer("\0".join(pieces).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.library.model.tokenize
        return self._flat([[token.id for token in tokenize(piece)] for piece in letters.split("\0")])

    @staticmethod
    def _flat(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return sizes, np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.uint32, count=int(sizes.sum()))

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.pieces = self.pieces.shrunk(MOST_KEPT_BYTES)
        pieces, counts = cut(texts if self.by_byte else [text.lower() for text in texts], self.by_byte)
        ends, ids = self.pieces.joined(self.pieces.places(pieces, self._by_model if self.by_byte else self._by_library))
        return np.diff(ends[counts]), ids

    def _in_parts(self, texts: list[str], how) -> tuple[np.ndarray, np.ndarray]:
        """``how`` of runs of texts of about ``CUT_BYTES``, put together."""
        done, start, size = [], 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size >= CUT_BYTES or at == len(texts) - 1:
                done.append(how(texts[start: at + 1]))
                start, size = at + 1, 0
        sizes, ids = zip(*done, strict=True)
        return np.concatenate(sizes), np.concatenate(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each with the end id."""
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), dtype=np.int64)
        done = []
        for rows, how in ((np.flatnonzero(plain), self._by_pieces), (np.flatnonzero(~plain), self._by_library)):
            if len(rows):
                sizes[rows], ids = self._in_parts(texts.take(pa.array(rows)).to_pylist(), how)
                done.append((rows, ids))
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(offsets[-1], END_ID, dtype=np.uint32)
        for rows, ids in done:
            own = sizes[rows]
            ends = np.concatenate(([0], np.cumsum(own)))
            out[np.repeat(offsets[rows] - ends[:-1], own) + np.arange(ends[-1])] = ids
        return offsets, out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
