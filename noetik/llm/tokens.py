"""Public tokenizers, with a cache of encoded pieces.

The pre-tokenizer of a byte-level BPE vocabulary never joins what stands before a single space with what follows it, so
a text's ids are those of its pieces: the first as it is, each later one with the space before it. A piece is split off
only where both neighbours of the space are not white space. Texts are cut in Arrow, some MB at a time, and each distinct
piece of these is encoded once; numpy puts the ids in place. A piece of letters is one pre-token, which the tokenizers
library's BPE model merges, and letters with a run of MARKS behind them are two; other pieces are cut by the pre-tokenizer's
pattern first. The cache has a young and an old part: when the young one holds KEPT pieces it becomes the old one, and
pieces found in the old one move on, so memory is bounded and frequent pieces stay. A text that holds an added token is
left to the library as a whole.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 500_000
SLICE = 4 << 20  # bytes of text that are cut at a time
MARKS = ".,;:!?$&*%#()\"-"
LONGEST = 40  # characters of a piece that is kept
PLAIN = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next character from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    """encode(texts): of each text the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.table = byte_characters()
        self.space = self.table[0x20]
        self.shown = [self.table.get(b, chr(b)) for b in range(256)].__getitem__
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.first: dict[str, bytes] = {}  # of pre-tokens, and of pieces that begin a text
        self.later: dict[str, bytes] = {}  # of pieces after a space, without it
        self.old: dict[str, bytes] = {}  # of later, before

    def merged(self, pretoken: str) -> bytes:
        """The ids of one pre-token."""
        if pretoken.isascii() and pretoken[1:].isalnum():
            shown = self.space + pretoken[1:] if pretoken[0] == " " else pretoken.translate(self.table)
        else:
            shown = "".join(map(self.shown, pretoken.encode()))
        ids = self.ids
        return b"".join([ids[t.id] for t in self.merge(shown)])

    def piece(self, p: str) -> bytes:
        out = []
        for t in self.cut(p):
            if (x := self.first.get(t)) is None:
                x = self.merged(t)
                if len(t) <= LONGEST:
                    self.first[t] = x
            out.append(x)
        return b"".join(out)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Of each text (null: empty) its ids."""
        # strings and bytes make no cycles, and looking for some would go through every list of pieces
        was = gc.isenabled()
        gc.disable()
        try:
            column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
            part = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64) // SLICE
            ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(column)] if len(column) else []
            return [x for i, j in zip([0, *ends], ends, strict=False) for x in self.column(column.slice(i, j - i))]
        finally:
            if was:
                gc.enable()

    def column(self, texts: pa.Array) -> list[bytes]:
        self.rotate()
        lists = pc.split_pattern(texts, " ")
        begin, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        head = np.zeros(len(index), bool)
        head[begin[:-1]] = True
        used = np.zeros(len(distinct), bool)
        used[index[~head]] = True
        # pieces that a plain cut gets wrong: their texts are cut one by one
        odd = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, 0, 1)), pc.equal(pc.binary_length(distinct), 0)).to_numpy(zero_copy_only=False)
        plain = used & ~odd
        distinct = distinct.to_pylist()
        names = [distinct[k] for k in np.flatnonzero(plain).tolist()]
        ids = list(map(self.later.get, names))
        self.fill(names, ids, True)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.zeros(len(distinct), np.int32)
        sizes[plain] = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        many = sizes.take(index)
        many[head] = 0
        ends = np.cumsum(many, dtype=np.int32)
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes).take(index) - (ends - many), many)
        found = flat.take(place).tobytes()
        single = np.logical_or.reduceat(odd[index] & ~head, begin[:-1])
        for a in self.added:
            single |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        last = 4 * ends[begin[1:] - 1].astype(np.int64)
        out = []
        for k, (i, j, h) in enumerate(zip(np.append(0, last[:-1]).tolist(), last.tolist(), index[begin[:-1]].tolist(), strict=True)):
            if single[k]:
                out.append(self.one(texts[k].as_py()))
            else:
                out.append((self.piece(distinct[h]) if distinct[h] else b"") + found[i:j])
        return out

    def rotate(self) -> None:
        if len(self.later) > KEPT:
            self.old, self.later = self.later, {}
        if len(self.first) > KEPT:
            self.first.clear()

    def one(self, text: str) -> bytes:
        self.rotate()
        if any(a in text for a in self.added):
            return b"".join([self.ids[k] for k in self.tokenizer.encode(text, add_special_tokens=False).ids])
        pieces = text.split(" ")
        head = pieces.pop(0)
        out = list(map(self.later.get, pieces))
        if None in out:
            if "" in pieces or not self.fill(pieces, out):
                head, *pieces = PLAIN.split(text)
                out = list(map(self.later.get, pieces))
                self.fill(pieces, out, True)
        elif "" in pieces:
            raise AssertionError("an empty piece is never kept")
        return (self.piece(head) if head else b"") + b"".join(out)

    def known(self, p: str) -> bytes:
        """The ids of a space and a piece that is not in the young cache."""
        x = self.old.get(p)
        if x is None:
            if p.isalpha():
                ids = self.ids
                x = b"".join([ids[t.id] for t in self.merge(self.space + p)]) if p.isascii() else self.merged(" " + p)
            elif (word := p.rstrip(MARKS)) != p and word.isalpha():
                x = (self.later.get(word) or self.known(word)) + self.piece_or_kept(p[len(word) :])
            else:
                x = self.piece(" " + p)
        if len(p) <= LONGEST and not p[0].isspace():
            self.later[p] = x
        return x

    def piece_or_kept(self, marks: str) -> bytes:
        return self.first.get(marks) or self.piece(marks)

    def fill(self, pieces: list[str], out: list, split: bool = False) -> bool:
        """Encode the pieces that aren't known. False if one begins with white space, so that a run of it was cut."""
        get, k = self.later.get, -1
        with contextlib.suppress(ValueError):  # no further piece is missing
            while True:
                k = out.index(None, k + 1)
                p = pieces[k]
                if not split and p[0].isspace():
                    return False
                out[k] = get(p) or self.known(p)
        return True


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
