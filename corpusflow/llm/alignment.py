"""Alignment of two tokenizers over the same bytes, by an associative fragment monoid.

A text with a space in front is a run of bytes, which a byte-level tokenizer (A)
and a sentence-piece model (B) cut in their own ways.  Places where tokens of
both end close a group.  Of a range of bytes, with the tokens that end in it, a
``Fragment`` holds the open prefix (up to the first place where a group closes),
the closed groups after it, and the open suffix.  Fragments of neighbouring
ranges compose: the suffix of the one and the prefix of the other are one
group.  Composition is associative and the empty fragment is neutral, so the
ranges of a very long text are tokenized in different tasks and composed by a
tree reduction, with borders anywhere, also within a group.

Tokens of a range are those of the whole text: it is encoded from a safe place
before it to one after it.  Safe is a single space between visible ASCII
characters, as the pattern of A begins a word there and no piece of B has a
space or line feed inside, which is tested when the model is loaded.  For the
same reason plain texts are put together from units between such places, each
distinct unit being a fragment that is made once per worker.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common, tokens

SPACE = "▁"
#: Bytes of a range, and of texts that aren't cut into ranges.
CHUNK_BYTES = 1 << 15
WHOLE_BYTES = 1 << 16
#: Fragments that one step of the reduction composes.
FAN = 8
#: Bits of a token id in a number for a pair of ids.
ID_BITS = 20
#: Counts of pairs, in bytes, up to which they are sent to every task.
COUNT_BYTES = 32 * 1024 * 1024
# Distinct units that a worker remembers, and the bytes of their fragments; later ones are made once per slice.
_REMEMBERED = 300_000
_REMEMBERED_BYTES = 1 << 25
# Bytes of texts that are in work at once.
_SLICE_BYTES = 1 << 21

_PAIRS = "pairs array<struct<pair: long, n: int>>"
_ALIGNED = f"doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, {_PAIRS}"
_FRAGMENT = (f"row long, doc_id long, number long, bad boolean, closed boolean, prefix_a array<int>, prefix_b array<int>, "
             f"groups binary, suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, n_groups long, {_PAIRS}")


@dataclass
class Fragment:
    """Tokens that end in a range of bytes, as far as their groups are known.

    ``prefix``: ids of A and B up to the first place where a group closes, or
    all of them if none does (``closed`` is False and ``suffix`` is empty then).
    ``groups``: the closed groups after it.  ``pairs``: links and how often each
    occurs.  ``bad``: the tokens don't give back the bytes.
    """

    closed: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: bytes = b""
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: dict[int, int] = field(default_factory=dict)
    bad: bool = False

    def __add__(self, other: Fragment) -> Fragment:
        meeting = tuple(a + b for a, b in zip(self.suffix if self.closed else self.prefix, other.prefix))
        pairs = dict(self.pairs)
        for pair, n in other.pairs.items():
            pairs[pair] = pairs.get(pair, 0) + n
        out = Fragment(self.closed or other.closed, n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b,
                       n_groups=self.n_groups + other.n_groups, pairs=pairs, bad=self.bad or other.bad)
        if not self.closed:
            out.prefix, out.groups, out.suffix = meeting, other.groups, other.suffix
        elif not other.closed:
            out.prefix, out.groups, out.suffix = self.prefix, self.groups, meeting
        else:
            joined = (self.groups, group_text(*meeting), other.groups)
            out.prefix, out.groups, out.suffix = self.prefix, b";".join(g for g in joined if g), other.suffix
        return out

    def finished(self) -> tuple[int, int, int, str, dict[int, int]]:
        """(n_a, n_b, n_groups, sha256 of the groups, pairs) of a whole text."""
        if self.bad or not self.n_groups:
            return 0, 0, 0, "", {}
        text = b";".join(g for g in (group_text(*self.prefix), self.groups) if g)
        return self.n_a, self.n_b, self.n_groups, hashlib.sha256(text).hexdigest(), self.pairs


def group_text(a: list[int], b: list[int]) -> bytes:
    """A group as text."""
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B that end together; ends ascend."""
    at = np.searchsorted(ends_b, ends_a)
    at[at == len(ends_b)] = 0
    same = np.flatnonzero(ends_b[at] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
    return same, at[same]


def fragment(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a range."""
    in_a, in_b = common_ends(ends_a, ends_b)
    a, b = ids_a.tolist(), ids_b.tolist()
    out = Fragment(len(in_a) > 0, n_a=len(a), n_b=len(b), n_groups=len(in_a))
    if not out.closed:
        out.prefix = (a, b)
        return out
    cuts = list(zip((in_a + 1).tolist(), (in_b + 1).tolist()))
    out.prefix = (a[:cuts[0][0]], b[:cuts[0][1]])
    out.groups = b";".join(group_text(a[m:n], b[x:y]) for (m, x), (n, y) in zip(cuts, cuts[1:]))
    out.suffix = (a[cuts[-1][0]:], b[cuts[-1][1]:])
    keys, counts = np.unique(pair_keys(ids_a[in_a], ids_b[in_b]), return_counts=True)
    out.pairs = dict(zip(keys.tolist(), counts.tolist()))
    return out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair of ids."""
    return (a.astype(np.int64) << ID_BITS) | b.astype(np.int64)


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible ones stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _lengths(values: list[bytes]) -> np.ndarray:
    return np.array([len(v) for v in values], np.int64)


class Both(tokens.UnitEncoder):
    """Both tokenizers with the bytes of their tokens, and the fragments of the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path_a)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # Other white space and the space mark of the pieces: such texts are encoded whole.
        self.hard = f"[{tokens._OTHER_BLANK}{SPACE}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|\\A\\z"
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of()
        size = self.tokenizer.get_vocab_size()
        words = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in words]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE, " ").encode()
                        for i, n in enumerate(names)]
        self.size_a, self.size_b = _lengths(self.bytes_a), _lengths(self.bytes_b)
        if max(len(words), len(names)) >= 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for the numbers of pairs")
        self.apart = not any(SPACE in n.lstrip(SPACE) or "\n" in n for n in names)
        self.mark = self.pieces.piece_to_id(SPACE)
        self.known = pa.array([], pa.string())
        self.units_known = _no_units()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A over space and text, and of B over the text."""
        return self.whole(" " + text), np.array(self.pieces.encode(text), np.int32)

    def gives_back(self, ids: np.ndarray, of: list[bytes], data: bytes) -> bool:
        return b"".join(map(of.__getitem__, ids.tolist())) == data

    def range_fragment(self, data: bytes, skip: int, take: int) -> Fragment:
        """Fragment of ``take`` bytes after ``skip``; ``data`` begins with a space, at safe places."""
        a, b = self.ids(data[1:].decode())
        if not (self.gives_back(a, self.bytes_a, data) and self.gives_back(b, self.bytes_b, data)):
            return Fragment(bad=True)
        parts = []
        for ids, sizes in ((a, self.size_a), (b, self.size_b)):
            ends = np.cumsum(sizes[ids])
            own = (ends > skip) & (ends <= skip + take)
            parts += [ids[own], ends[own]]
        return fragment(*parts)

    def _new_units(self, units: list[str]) -> Units:
        """Fragments of units, which are words after a space or, marked by \\x00, after a line feed."""
        ids_a, starts, n_a = self._units(units)
        ids_a = tokens._rows(ids_a, n_a, starts)
        # One thread, as a task has one core and each thread keeps memory of its own.
        lists = self.pieces.encode(["\n" + u[1:] if u[0] == "\x00" else u for u in units], num_threads=1)
        lists = [ids[1:] if u[0] == "\x00" and ids[:1] == [self.mark] else ids for u, ids in zip(units, lists)]
        n_b = np.array([len(x) for x in lists], np.int64)
        ids_b = np.array([i for x in lists for i in x], np.int32)
        data = [("\n" + u[1:] if u[0] == "\x00" else " " + u).encode() for u in units]
        good = np.ones(len(units), bool)
        for ids, of, counts in ((ids_a, self.bytes_a, n_a), (ids_b, self.bytes_b, n_b)):
            if not self.gives_back(ids, of, b"".join(data)):
                at = np.concatenate([[0], np.cumsum(counts)])
                good &= [self.gives_back(ids[m:n], of, d) for m, n, d in zip(at, at[1:], data)]
        in_a, in_b = np.repeat(good, n_a), np.repeat(good, n_b)
        ids_a, ids_b = ids_a[in_a], ids_b[in_b]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        close_a, close_b = common_ends(ends_a, ends_b)
        # Every unit ends a group, so the groups of all units in a row are theirs one after the other.
        closing = np.cumsum(np.where(good, _lengths(data), 0))
        until = np.searchsorted(ends_a[close_a], closing, side="right")
        n_groups = np.diff(until, prepend=0)
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        texts, m, x = [], 0, 0
        for n, y in zip((close_a + 1).tolist(), (close_b + 1).tolist()):
            texts.append(f"{','.join(text_a[m:n])}|{','.join(text_b[x:y])}")
            m, x = n, y
        joined = [";".join(texts[m:n]).encode() + b";" for m, n in zip(np.append(0, until[:-1]).tolist(), until.tolist())]
        return Units(n_a, n_b, n_groups, ~good, pair_keys(ids_a[close_a], ids_b[close_b]), until - n_groups,
                     pa.array(joined, pa.binary()))

    def _known(self, units: pa.Array) -> tuple[Units, np.ndarray]:
        """Fragments of distinct units and the place of each; remembered as long as there are not too many."""
        place = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.units_known, place
        place[new] = len(self.known) + np.arange(len(new))
        fresh = units.take(pa.array(new))
        found = self.units_known.followed_by(self._new_units(fresh.to_pylist()))
        if (len(self.known) + len(new) <= _REMEMBERED
                and found.nbytes + self.known.nbytes + fresh.nbytes <= _REMEMBERED_BYTES):
            self.known = pa.concat_arrays([self.known, fresh])
            self.units_known = found
        return found, place

    def aligned(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list, list[str], pa.Array]]:
        """(rows, figures, hashes, pairs) in blocks of rows, in any order; null and empty texts have zeros.

        A block is of one slice of the column, so that what a worker holds
        doesn't grow with the rows it is sent at once.
        """
        for first, part in tokens.slices(column, _SLICE_BYTES):
            hard = pc.match_substring_regex(part, self.hard).to_numpy(zero_copy_only=False) | (not self.apart)
            odd, easy = np.flatnonzero(hard), np.flatnonzero(~hard)
            if len(odd):
                found = [self._hard(part[row].as_py()) for row in odd.tolist()]
                yield first + odd, [[f[k] for f in found] for k in range(3)], [f[3] for f in found], _pair_lists(
                    f[4] for f in found)
            if len(easy):
                yield first + easy, *self._easy(part.take(pa.array(easy)))

    def _hard(self, text: str) -> tuple[int, int, int, str, dict[int, int]]:
        data = f" {text}".encode()
        return (self.range_fragment(data, 0, len(data)) if text else Fragment()).finished()

    def _easy(self, texts: pa.Array) -> tuple[list, list[str], pa.Array]:
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " \x00"), " ")
        cuts = units.offsets.to_numpy() - units.offsets[0].as_py()
        coded = units.flatten().dictionary_encode()
        known, place = self._known(coded.dictionary)
        codes = place[coded.indices.to_numpy()]
        *figures, bad = (np.add.reduceat(values[codes], cuts[:-1])
                         for values in (known.n_a, known.n_b, known.n_groups, known.bad))
        bad = bad > 0
        keys = tokens._rows(known.keys, known.n_groups[codes], known.starts[codes])
        keys |= np.repeat(np.arange(len(bad)) << 2 * ID_BITS, figures[2])
        keys, counts = np.unique(keys[np.repeat(~bad, figures[2])], return_counts=True)
        until = np.searchsorted(keys, np.arange(len(bad) + 1) << 2 * ID_BITS)
        pairs = _pair_list(until, keys & ((1 << 2 * ID_BITS) - 1), counts)
        groups = known.texts.take(pa.array(codes))
        _, ends, data = groups.buffers()
        ends, data = np.frombuffer(ends, np.int32)[cuts].tolist(), memoryview(data)
        hashes = ["" if b else hashlib.sha256(data[m:n - 1]).hexdigest() for b, m, n in zip(bad.tolist(), ends, ends[1:])]
        return [np.where(bad, 0, values) for values in figures], hashes, pairs


@dataclass
class Units:
    """Closed fragments of units: numbers of tokens and groups, whether bytes differ, link keys, groups as text.

    Each group is followed by a semicolon.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    bad: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    texts: pa.Array

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self))

    def followed_by(self, other: Units) -> Units:
        both = [np.concatenate(pair) for pair in zip(
            (self.n_a, self.n_b, self.n_groups, self.bad, self.keys, self.starts),
            (other.n_a, other.n_b, other.n_groups, other.bad, other.keys, other.starts + len(self.keys)))]
        return Units(*both, pa.concat_arrays([self.texts, other.texts]))


def _no_units() -> Units:
    none = np.zeros(0, np.int64)
    return Units(none, none, none, none.astype(bool), none, none, pa.array([], pa.binary()))


@functools.lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    """The tokenizers of two files, once per Python worker."""
    return Both(path_a, path_b)


def _pair_list(offsets: np.ndarray, keys: np.ndarray | list, counts: np.ndarray | list) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(counts).cast(pa.int32())], names=["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _pair_lists(pairs: Iterable[dict[int, int]]) -> pa.Array:
    pairs = list(pairs)
    return _pair_list(tokens.pieces_of([len(p) for p in pairs]), [k for p in pairs for k in p],
                      [n for p in pairs for n in p.values()])


def _whole(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = both(path_a, path_b)
        for batch in batches:
            for rows, figures, hashes, pairs in tokenizers.aligned(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in figures),
                     pa.array(hashes, pa.string()), pairs],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])
    return run


def ranges(data: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, safe place before, safe place after) of the ranges of a text that begins with a space.

    Borders are multiples of ``chunk``, but for those with no safe place within
    ``chunk`` bytes on both sides, where two ranges are one.
    """
    values = np.frombuffer(data, np.uint8)
    visible = (values > 32) & (values < 127)
    safe = np.flatnonzero((values[1:-1] == 32) & visible[:-2] & visible[2:]) + 1
    safe = np.concatenate([[0], safe, [len(data)]])
    borders = np.arange(chunk, len(data), chunk)
    after = safe[np.minimum(np.searchsorted(safe, borders), len(safe) - 1)]
    before = safe[np.searchsorted(safe, borders, side="right") - 1]
    borders = borders[(after - borders < chunk) & (borders - before < chunk)]
    edges = [0, *borders.tolist(), len(data)]
    low = safe[np.searchsorted(safe, edges[:-1], side="right") - 1].tolist()
    high = safe[np.searchsorted(safe, edges[1:])].tolist()
    return list(zip(edges, edges[1:], low, high))


def _cut(chunk: int):
    """Ranges of long texts, each with the bytes it is encoded from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                data = f" {text.as_py()}".encode()
                for number, (begin, end, low, high) in enumerate(ranges(data, chunk)):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row.as_py(), "doc_id": doc_id.as_py(), "number": number, "data": data[low:high],
                          "skip": begin - low, "take": end - begin}], schema=_CUT_ARROW)
    return run


_CUT_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int64()), ("data", pa.binary()),
                        ("skip", pa.int64()), ("take", pa.int64())])
_CUT = "row long, doc_id long, number long, data binary, skip long, take long"
_LISTED = ("prefix_a", "prefix_b", "suffix_a", "suffix_b")


def _fragment_batch(rows: list[tuple[int, int | None, int, Fragment]]) -> pa.RecordBatch:
    parts = [f for *_, f in rows]
    lists = {"prefix_a": [f.prefix[0] for f in parts], "prefix_b": [f.prefix[1] for f in parts],
             "suffix_a": [f.suffix[0] for f in parts], "suffix_b": [f.suffix[1] for f in parts]}
    numbers = {name: pa.array([getattr(f, name) for f in parts], pa.int64()) for name in ("n_a", "n_b", "n_groups")}
    columns = {"row": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()),
               "number": pa.array([r[2] for r in rows], pa.int64()), "bad": pa.array([f.bad for f in parts], pa.bool_()),
               "closed": pa.array([f.closed for f in parts], pa.bool_()),
               **{name: pa.array(values, pa.list_(pa.int32())) for name, values in lists.items()},
               "groups": pa.array([f.groups for f in parts], pa.binary()), **numbers,
               "pairs": _pair_lists(f.pairs for f in parts)}
    names = [c.split(" ")[0] for c in _FRAGMENT.replace(_PAIRS, "pairs").split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _read(row: dict) -> Fragment:
    return Fragment(row["closed"], (row["prefix_a"], row["prefix_b"]), row["groups"], (row["suffix_a"], row["suffix_b"]),
                    row["n_a"], row["n_b"], row["n_groups"], {p["pair"]: p["n"] for p in row["pairs"]}, row["bad"])


def _of_ranges(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = both(path_a, path_b)
        for batch in batches:
            for r in range(len(batch)):
                row, doc_id, number, data, skip, take = (batch.column(c)[r].as_py() for c in _CUT_ARROW.names)
                yield _fragment_batch([(row, doc_id, number, tokenizers.range_fragment(data, skip, take))])
    return run


def _compose(key: tuple, table: pa.Table) -> pa.Table:
    """The fragments of up to FAN neighbouring ranges as one."""
    rows = table.sort_by("number").to_pylist()
    out = Fragment()
    for row in rows:
        out = out + _read(row)
    return pa.Table.from_batches([_fragment_batch([(rows[0]["row"], rows[0]["doc_id"], key[1].as_py(), out)])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        done = [_read(row).finished() for row in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([d[k] for d in done], pa.int64()) for k in range(3)),
             pa.array([d[3] for d in done], pa.string()), _pair_lists(d[4] for d in done)],
            names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])


def reduced(fragments: DataFrame) -> DataFrame:
    """One fragment per row number, composed level by level in groups of FAN neighbours."""
    most = (fragments.agg(F.max("number")).first()[0] or 0) + 1
    while most > 1:
        parent = F.floor(F.col("number") / FAN).cast("long")
        fragments = common.stored(fragments.withColumn("parent", parent).groupBy("row", "parent").applyInArrow(
            _compose, _FRAGMENT), "fragments")
        most = -(-most // FAN)
    return fragments


def aligned(docs: DataFrame, path_a: str, path_b: str, whole: int = WHOLE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs: a row per row of ``docs``, stored.

    pairs: each pair of ids, ``a << 20 | b``, of tokens that end together, with
    the number of times.  Texts above ``whole`` bytes are cut into ranges of
    ``chunk`` bytes.  Uses doc_id and text; further columns are ignored.  Null
    and empty texts, and those that the tokens of A or B don't give back, have
    no tokens: zeros, an empty text and no pairs.
    """
    common.ready(docs.sparkSession)
    docs = common.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") > whole, F.lit(False))
    short = docs.filter(~long).mapInArrow(_whole(path_a, path_b), _ALIGNED)
    cut = docs.filter(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut(chunk), _CUT)
    cut = common.stored(cut, "ranges").repartition("row", "number")
    fragments = common.stored(cut.mapInArrow(_of_ranges(path_a, path_b), _FRAGMENT), "fragments")
    return common.stored(short.unionByName(reduced(fragments).mapInArrow(_finish, _ALIGNED)), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (links of the corpus), best (whether no other A id has more links with this B id), stored."""
    counts = common.stored(found.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(
        F.sum("p.n").alias("count")), "pair_counts")
    own = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    most = counts.groupBy(own.alias("b")).agg(F.max("count").alias("most"))
    return common.stored(counts.withColumn("b", own).join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair_best")


def compared(docs: DataFrame, path_a: str, path_b: str, **sizes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row of ``docs``.

    n_links: pairs of tokens that end together; n_best: those whose count over
    the corpus no other A id exceeds for the same B id; count_sum: sum of the
    counts.  See :func:`aligned` for null and other special texts; an empty
    table gives an empty one.
    """
    found = aligned(docs, path_a, path_b, **sizes)
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    counts = pair_counts(found)
    links = found.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", *names, F.explode_outer("pairs").alias("p")).select("_row", *names, "p.pair", F.col("p.n").alias("n"))
    sent = common.broadcast_or_none(counts, COUNT_BYTES)
    links = links.join(counts if sent is None else sent, "pair", "left")
    sums = links.groupBy("_row", *names).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0)).cast("long").alias("count_sum"))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark, folder):
    """All documents with the groups and links of two tokenizers."""
    return compared(common.table(spark, folder, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"),
                    tokens.tokenizer_path("piece_bpe_32k.model"))
