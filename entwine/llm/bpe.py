"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is a tree: its halves are encoded on their own, down to leaves of
`leaf_chars` characters, and two neighbours are joined by encoding a window
around the seam anew, which grows until the tokens outside provably stay:

* Between matches of the pattern. Two neighbouring characters of different
  kinds (letters, digits, white space, others) are never in one match, but for a
  space or an apostrophe before others of a match. So a match ends there
  whatever stands around: the matches before the last such cut of the left part
  and after the first one of the right part are those of the whole text. Kinds
  are taken as known only for characters on which all versions of Unicode agree.
* Inside one long match, as in scripts without spaces. A sequence of tokens is
  the encoding of its bytes if, and only if, every two neighbours are the encoding of
  theirs. So some tokens to both sides of the seam are encoded again, twice as
  many each time, until the new ones agree with their neighbours.

Where neither holds within `REACH` characters (characters of unknown kind, long white space) the window grows
to the next cut, or to the part's end. So any tree gives the tokens of the whole text.
Decoding is the homomorphism back: bytes of ids, concatenated up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Characters of a leaf, and how far cuts are searched before the tokens of one match are joined.
LEAF_CHARS, REACH = 1024, 256
#: Ids of a batch on its way out, and pairs of tokens that a task remembers to be stable.
BATCH_IDS, STABLE_PAIRS = 1 << 18, 1 << 17
#: Kinds of characters. BLANK is the space, which may begin a match of others; UNKNOWN says nothing.
UNKNOWN, LETTER, DIGIT, OTHER, BLANK, BREAK, APOSTROPHE = range(7)


def load_encoding(ranks_path: str, pattern: str):
    """(tiktoken Encoding without special tokens, bytes of each id)."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return enc, pieces


class Kinds(dict):
    """character -> its kind."""

    def __missing__(self, c: str) -> int:
        now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if c in " ":
            kind = BLANK
        elif c in "\t\n\x0b\x0c\r":
            kind = BREAK
        elif c == "'":
            kind = APOSTROPHE
        elif now[0] == then[0] == "L":
            kind = LETTER
        elif now[0] == then[0] == "N":
            kind = DIGIT
        elif now[0] in "PSM" and then[0] in "PSM" or now[0] in "PSM" and then == "Cn":
            kind = OTHER
        else:
            kind = UNKNOWN
        self[c] = kind
        return kind


KINDS = Kinds()


def parted(x: int, y: int) -> bool:
    """Whether a match ends between neighbours of these kinds, whatever stands around them.

    Not after white space, whose matches depend on what follows.
    """
    if not x or not y or x in (BLANK, BREAK):
        return False
    if y in (BLANK, BREAK):
        return True
    if x == APOSTROPHE:
        return y == DIGIT
    return x != (OTHER if y == APOSTROPHE else y)


def left_cut(text: str, lo: int, at: int) -> int:
    """The last cut in (lo, at], or lo. Nothing need be proved of lo: the part starts there."""
    kinds = KINDS
    for i in range(at, lo, -1):
        if i < len(text) and parted(kinds[text[i - 1]], kinds[text[i]]):
            return i
    return lo


def right_cut(text: str, at: int, hi: int) -> int:
    """The first cut in [at, hi), or hi."""
    kinds = KINDS
    for i in range(at, hi):
        if i and parted(kinds[text[i - 1]], kinds[text[i]]):
            return i
    return hi


class TreeCodec:
    """Encodes and decodes by the tree; `encode` is a function of one whole string, `piece` of the bytes of one match."""

    def __init__(self, encode: Callable[[str], list[int]], pieces: list[bytes], leaf_chars: int = LEAF_CHARS, piece: Callable[[bytes], list[int]] | None = None, reach: int = REACH):
        self.encode_leaf, self.pieces, self.leaf_chars, self.encode_piece, self.reach = encode, pieces, max(1, leaf_chars), piece, reach
        self.stable: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.encode_leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of its halves: only the window is encoded again."""
        near, far = max(lo, mid - self.reach), min(hi, mid + self.reach)
        start = left_cut(text, near, mid)
        if start == near > lo and (ids := self._inside(text, near, mid, far, left, right)) is not None:
            return ids
        end = mid if start == mid else right_cut(text, mid, far)
        if end == far < hi and start < mid and (ids := self._inside(text, near, mid, far, left, right)) is not None:
            return ids
        if start == near > lo:
            start = left_cut(text, lo, near)
        if end == far < hi:
            end = right_cut(text, far, hi)
        while (keep := self._drop(left, len(text[start:mid].encode()), True)) is None:
            start = left_cut(text, lo, start - 1) if start - 1 > lo else lo
        while (skip := self._drop(right, len(text[mid:end].encode()), False)) is None:
            end = right_cut(text, end + 1, hi) if end + 1 < hi else hi
        del left[keep:]
        left += self.encode_leaf(text[start:end])
        left += right[skip:]
        return left

    def _inside(self, text: str, near: int, mid: int, far: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join of two parts whose seam is inside one match, from the tokens around it; None where that can't be shown.

        All characters from `near` to `far` are of one kind, so they are in one
        match, but for the first ones, which a contraction could have.
        """
        kind = KINDS[text[mid]]
        if self.encode_piece is None or kind not in (LETTER, DIGIT, OTHER) or any(KINDS[c] != kind for c in text[near:far]):
            return None
        room_left, room_right = len(text[near + 4 : mid].encode()), len(text[mid : far - 4].encode())
        n = 1
        while True:
            a, b = left[-n:], right[:n]
            tail, head = b"".join(map(self.pieces.__getitem__, a)), b"".join(map(self.pieces.__getitem__, b))
            if n >= len(left) or n >= len(right) or len(tail) + len(self.pieces[left[-n - 1]]) > room_left or len(head) + len(self.pieces[right[n]]) > room_right:
                return None
            ids = self.encode_piece(tail + head)
            if self._agree(left[-n - 1], ids[0]) and self._agree(ids[-1], right[n]):
                del left[-n:]
                left += ids
                left += right[n:]
                return left
            n *= 2

    def _agree(self, x: int, y: int) -> bool:
        """Whether two tokens in a row are the encoding of their bytes."""
        found = self.stable.get((x, y))
        if found is None:
            if len(self.stable) > STABLE_PAIRS:
                self.stable.clear()
            found = self.stable[x, y] = self.encode_piece(self.pieces[x] + self.pieces[y]) == [x, y]
        return found

    def _drop(self, ids: list[int], n_bytes: int, from_end: bool) -> int | None:
        """The index in ids at which n_bytes of the end (or of the start) are cut off; None if a token crosses that place."""
        pieces, at = self.pieces, len(ids) if from_end else 0
        while n_bytes > 0:
            at -= from_end
            n_bytes -= len(pieces[ids[at]])
            at += not from_end
        return None if n_bytes else at

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.pieces.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encoded(batches: Iterator[pa.RecordBatch], codec: TreeCodec, id_col: str, with_ids: bool, most: int = BATCH_IDS) -> Iterator[pa.RecordBatch]:
    """The rows of `encode_decode`, of batches (id, text); a batch is given away once it holds `most` ids, so a task's memory has no more."""
    numerals = list(map(str, range(len(codec.pieces))))
    for batch in batches:
        start, held, out = 0, 0, []
        for i, text in enumerate(batch.column(1), 1):
            text = text.as_py() or ""
            ids = codec.encode(text)
            back = codec.decode(ids)
            out.append((len(ids), hashlib.sha256(" ".join(map(numerals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode(), np.array(ids, np.int32) if with_ids else None))
            held += len(ids)
            if held < most and i < batch.num_rows:
                continue
            n, sha, back_sha, same, lists = zip(*out)
            columns = [batch.column(0).slice(start, len(out)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(same, pa.bool_())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                columns.insert(2, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(lists))))
                names.insert(2, "ids")
            start, held, out = i, 0, []
            yield pa.RecordBatch.from_arrays(columns, names)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Per row: the id column, n_tokens, ids (with `with_ids`), ids_sha256, decoded_sha256, round_trip.

    A narrow stage: no shuffle, and each row depends on its own text alone.
    `ranks_path` must exist on every executor (it comes with the tokenizer
    package). Null text: as empty, which has no tokens. Texts of any length are
    encoded whole, in memory of the text's own order. Repeated rows
    stay rows of their own; other columns of `docs` are ignored, whatever their names;
    an empty table gives an empty one. Nothing is ranked, so there are no ties.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pieces = load_encoding(ranks_path, pattern)
        codec = TreeCodec(enc.encode_ordinary, pieces, leaf_chars, enc._encode_single_piece)
        return encoded(batches, codec, id_col, with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded bytes of an id column (null ids: null; none: empty) as the last column.

    A column that has the new name already would be ambiguous and is an error.
    Repeated rows stay; id lists of any length are decoded whole; an empty table gives an empty one.
    """
    if out_col in encoded.columns:
        raise ValueError(f"the input has a column {out_col} already")
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = load_encoding(ranks_path, pattern)
        codec = TreeCodec(lambda text: [], pieces)
        for batch in batches:
            back = [None if ids is None else codec.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, out_col])

    return encoded.select(*(F.col(f"`{c}`") for c in encoded.columns)).mapInArrow(run, schema)
