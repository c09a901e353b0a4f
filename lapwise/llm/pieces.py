"""Pieces of texts that a byte-level pre-tokenizer always cuts apart, and a bounded table of the ids of pieces met.

A piece begins with a run of white space, or with a stop right after a letter: a pre-token never reaches from other
characters into white space, and letters and stops are never one pre-token. So pieces can be encoded one by one. Cuts that
are not sure (white space beyond ASCII, letters beyond Latin-1) are left out, which only makes pieces longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lapwise.llm import textblocks as tb

STOP = np.zeros(256, dtype=bool)
STOP[list(b".,;:!?")] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: Second bytes of the letters that UTF-8 begins with 0xC3: all but the multiplication and division signs.
LATIN = np.zeros(256, dtype=bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
HASHED_AT_ONCE = 64 << 10
#: White space beyond ASCII.
SPACES = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _ends_of_spaces(data: np.ndarray) -> np.ndarray:
    """Index after the last byte of each white space beyond ASCII."""
    found = [np.zeros(0, dtype=np.int64)]
    for lead in sorted({s.encode()[0] for s in SPACES}):
        at = np.flatnonzero(data == lead)
        for tail in (s.encode()[1:] for s in SPACES if s.encode()[0] == lead) if len(at) else ():
            inside = at[at + len(tail) < len(data)]
            same = np.ones(len(inside), dtype=bool)
            for k, byte in enumerate(tail, start=1):
                same &= data[inside + k] == byte
            found.append(inside[same] + len(tail) + 1)
    return np.concatenate(found)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each piece of the rows' texts, and the index of each row's first piece (one more at the end)."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        white = tb.WHITE[data]
        begin[1:-1] = white[1:] & ~white[:-1]
        begin[_ends_of_spaces(data)] = False
        letter = LETTER[data]
        letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
        begin[1:-1] |= STOP[data[1:]] & letter[:-1]
        begin[offsets] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.searchsorted(starts, offsets)


def gather(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of every begin and size, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceTable:
    """Ids of pieces, learned where a piece is new; forgotten when the table has over most pieces or bytes_kept bytes."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int, bytes_kept: int = 32 << 20) -> None:
        self.learn, self.most, self.bytes_kept = learn, most, bytes_kept
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.binary())
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        found = pc.index_in(pieces, value_set=self.known)
        if not found.null_count:
            return found.to_numpy()
        if len(self.known) > self.most or self.known.nbytes > self.bytes_kept:
            self.clear()
            found = pa.nulls(len(pieces), pa.int32())
        missing = pc.is_null(found)
        wanted = pieces.filter(missing)
        new = pc.unique(wanted)
        ids, sizes = self.learn(new.to_pylist())
        out = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
        out[missing.to_numpy(zero_copy_only=False)] = pc.index_in(wanted, value_set=new).to_numpy() + len(self.known)
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and where each row's begin (one more at the end)."""
        starts, first = cut(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        number = self._numbers(pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]))
        begin = self.ends[number]
        sizes = self.ends[number + 1] - begin
        return gather(self.flat, begin, sizes), np.concatenate([[0], np.cumsum(sizes)])[first]


def _parts(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces one after another, and where each begins (one more at the end)."""
    bounds = np.frombuffer(pieces.buffers()[1] or bytes(4), dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each piece; a bounded number at a time, longer pieces alone."""
    groups = np.split(np.arange(len(bounds) - 1), np.flatnonzero(np.diff(bounds[1:] // HASHED_AT_ONCE)) + 1)
    return np.concatenate([tb.word_hashes(data[bounds[g[0]] : bounds[g[-1] + 1]], bounds[g] - bounds[g[0]], bounds[g + 1] - bounds[g[0]]) for g in groups if len(g)] or [np.zeros(0, dtype=np.uint64)])


class OftenTable(PieceTable):
    """A table that keeps the pieces it met most often when it has over most, and finds pieces by hashes that stay sorted.

    A hash only proposes a piece: its bytes are compared. Of two pieces of the same hash the second is learned at each call.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int, often: int, bytes_kept: int = 32 << 20) -> None:
        self.often = often
        super().__init__(learn, most, bytes_kept)

    def clear(self) -> None:
        super().clear()
        self.met = np.zeros(0, dtype=np.int64)
        self.hashes, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def _forget(self) -> None:
        if len(self.known) <= self.often or self.known.nbytes > self.bytes_kept:
            return self.clear()
        stays = np.zeros(len(self.known), dtype=bool)
        stays[np.argpartition(self.met, -self.often)[-self.often :]] = True
        stay, sizes = np.flatnonzero(stays), np.diff(self.ends)
        self.known = self.known.take(pa.array(stay))
        self.flat = gather(self.flat, self.ends[stay], sizes[stay])
        self.ends, self.met = np.concatenate([[0], np.cumsum(sizes[stay])]), self.met[stay]
        kept = stays[self.place]
        self.hashes, self.place = self.hashes[kept], (np.cumsum(stays) - 1)[self.place[kept]].astype(np.int32)

    def _places(self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        number = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.hashes):
            return number
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known, begin = _parts(self.known)
        like = np.flatnonzero(self.hashes[at] == hashes)
        place, sizes = self.place[at[like]].astype(np.int64), np.diff(bounds)[like]
        same = begin[place + 1] - begin[place] == sizes
        like, place, sizes = like[same], place[same], sizes[same]
        if len(like):
            equal = gather(data, bounds[like], sizes) == gather(known, begin[place], sizes)
            same = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            number[like[same]] = place[same]
        return number

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        data, bounds = _parts(coded.dictionary)
        hashes = _hashes(data, bounds)
        number = self._places(data, bounds, hashes)
        if number.min() < 0 and (len(self.known) > self.most or self.known.nbytes > self.bytes_kept):
            self._forget()
            number = self._places(data, bounds, hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = data.tobytes()
            ids, sizes = self.learn([raw[a:b] for a, b in zip(bounds[new].tolist(), bounds[new + 1].tolist(), strict=True)])
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(pa.array(new))])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.met = np.concatenate([self.met, np.zeros(len(new), dtype=np.int64)])
            new = new[np.argsort(hashes[new])]
            to = np.searchsorted(self.hashes, hashes[new], side="right")
            self.hashes, self.place = np.insert(self.hashes, to, hashes[new]), np.insert(self.place, to, number[new].astype(np.int32))
        self.met[number] += np.bincount(index, minlength=len(number))
        return number[index]
