"""Token ids of many texts by a library tokenizer, each distinct unit of a batch encoded once.

The library encodes a text in pieces that end before a single space and around
a single line feed between other characters: its splitting pattern never
crosses these places, whatever stands around them.  So a batch of texts is cut
there, its distinct units are encoded by the library, and the ids are put
together again.  Texts with other white space, with control characters or with
strings of special tokens are encoded whole.

A distinct unit is cut once more, between a letter or digit and the punctuation
that ends it, where the pattern never crosses either: the library then sees
a word once, not once for each mark that follows it.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Other white space, runs of it, and white space at either end.
_OTHER_BLANK = (r"\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Letters and digits that every version of Unicode counts as such.
_WORD_END = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]\z"
_JOIN_CHARS = 1 << 14
_BLOCK_UNITS = 1 << 19
_SLICE_BYTES = 1 << 23
# Distinct words and marks whose ids a worker remembers, and their bytes; later ones are encoded once per slice.
_REMEMBERED = 600_000
_REMEMBERED_BYTES = 1 << 25


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, once per Python worker and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _rows(values: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The runs values[start:start + length] one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def slices(column: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of rows of about ``limit`` bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, column.slice(first, stop - first)
        first = stop


@functools.lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    """The encoder of a file, with what it remembers, once per Python worker."""
    return UnitEncoder(path)


class UnitEncoder:
    """Encodes Arrow columns with a byte-level tokenizer whose pattern splits at spaces."""

    def __init__(self, path: str):
        self.known = pa.array([], pa.string())
        self.known_ids = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tokenizer = load(path)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hard = "|".join([f"[{_OTHER_BLANK}]", r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z", r"\A\z",
                              *[re.escape(s) for s in special]])
        apart = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.marks = "".join(c for c in string.punctuation if all(len(apart(w + c)) == 2 for w in "a7\u00e9"))

    def whole(self, text: str) -> np.ndarray:
        # Without the offsets into the text, which nobody here reads.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of units marked \\x01 at the start of a text, \\x00 after a line feed.

        Units are joined by line feeds, which the library keeps as tokens of
        their own, so the ids of a unit stand between two of them.
        """
        plain = [u[1:] if u[0] < "\x02" else " " + u for u in units]
        after_feed = np.array([u[0] == "\x00" for u in units])
        ids, starts, lengths = [], [], []
        total, first = 0, 0
        sizes = np.cumsum([len(u) + 1 for u in plain])
        while first < len(plain):
            base = sizes[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(sizes, base + _JOIN_CHARS, side="right")))
            got = self.whole("\n" + "\n".join(plain[first:stop]))
            feeds = np.flatnonzero(got == self.line_feed[0])
            if len(feeds) != stop - first:
                raise ValueError("the tokenizer doesn't keep line feeds apart")
            ids.append(got)
            starts.append(feeds + 1 + total)
            lengths.append(np.diff(np.append(feeds, len(got))) - 1)
            total += len(got)
            first = stop
        starts, lengths = np.concatenate(starts), np.concatenate(lengths)
        return np.concatenate(ids), starts - after_feed, lengths + after_feed

    def _remembered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths, place of each piece in the latter two)."""
        place = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return *self.known_ids, place
        count = len(self.known)
        place[new] = np.arange(count, count + len(new))
        fresh = pieces.take(pa.array(new))
        ids, starts, lengths = self._units(fresh.to_pylist())
        ids, starts, lengths = (np.concatenate(pair) for pair in zip(
            self.known_ids, (ids, starts + len(self.known_ids[0]), lengths)))
        if count < _REMEMBERED and self.known.nbytes + fresh.nbytes <= _REMEMBERED_BYTES:
            self.known = pa.concat_arrays([self.known, fresh.slice(0, _REMEMBERED - count)])
            count = len(self.known)
            self.known_ids = ids[:starts[count - 1] + lengths[count - 1]], starts[:count], lengths[:count]
        return ids, starts, lengths, place

    def _parts(self, units: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(units without the marks that end them, these marks as units of their own, which units have such)."""
        words = pc.ascii_rtrim(units, characters=self.marks)
        cut = pc.and_(pc.not_equal(words, units), pc.match_substring_regex(words, _WORD_END))
        words = pc.if_else(cut, words, units)
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ended, word = units.take(pa.array(at)), words.take(pa.array(at))
        if not len(at):
            return words, ended, at
        sizes = (pc.binary_length(ended).to_numpy() - pc.binary_length(word).to_numpy()).astype(np.int64)
        _, ends, data = ended.buffers()
        ends = np.frombuffer(ends, np.int32)[1:len(at) + 1]
        data = _rows(np.frombuffer(data, np.uint8), sizes, ends - sizes)
        ends = pieces_of(sizes).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data))
        return words, pc.binary_join_element_wise(pa.scalar("\x01"), marks, ""), at

    def _coded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct units."""
        words, marks, cut = self._parts(units)
        coded = pa.concat_arrays([words, marks]).dictionary_encode()
        ids, starts, lengths, place = self._remembered(coded.dictionary)
        codes = place[coded.indices.to_numpy()]
        words, marks = codes[:len(units)], codes[len(units):]
        if not len(cut):
            return ids, starts[words], lengths[words]
        runs = np.insert(words, cut + 1, marks)
        sizes = lengths[words]
        sizes[cut] += lengths[marks]
        return _rows(ids, lengths[runs], starts[runs]), np.cumsum(sizes) - sizes, sizes

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, lengths, ids one after the other) in blocks of rows, in order; null counts as empty."""
        for first, part in slices(column):
            found = list(self._encode(part))
            if all(a[0][-1] < b[0][0] for a, b in zip(found, found[1:])):
                for rows, lengths, ids in found:
                    yield rows + first, lengths, ids
                continue
            rows, lengths, ids = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(rows)
            starts = np.cumsum(lengths) - lengths
            yield rows[order] + first, lengths[order], _rows(ids, lengths[order], starts[order])

    def _encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hard = pc.match_substring_regex(column, self.hard).to_numpy(zero_copy_only=False)
        for row in np.flatnonzero(hard):
            ids = self.whole(column[int(row)].as_py())
            yield np.array([row]), np.array([len(ids)]), ids
        easy = np.flatnonzero(~hard)
        if not len(easy):
            return
        texts = column.take(pa.array(easy))
        marked = pc.binary_join_element_wise(pa.scalar("\x01"), pc.replace_substring(texts, "\n", " \x00"), "")
        units = pc.split_pattern(marked, " ")
        offsets = units.offsets.to_numpy()
        coded = units.flatten().dictionary_encode()
        ids, starts, lengths = self._coded(coded.dictionary)
        codes = coded.indices.to_numpy()
        first = 0
        while first < len(easy):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK_UNITS, side="right")) - 1)
            part = codes[offsets[first]:offsets[stop]]
            sizes = lengths[part]
            yield (easy[first:stop], np.add.reduceat(sizes, offsets[first:stop] - offsets[first]),
                   _rows(ids, sizes, starts[part]))
            first = stop


def pieces_of(lengths: np.ndarray) -> np.ndarray:
    """Begin of every run, with the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)])


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
