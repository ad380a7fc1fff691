"""Byte-level BPE encoding by forced boundaries, and decoding.

Two bytes that stand beside each other inside no token of the vocabulary can't end up in one token: a text may be cut
between them, its fragments encoded one by one and their ids joined. The table of such pairs comes from the vocabulary
alone and finds nearly every word border without a pattern.

Encoders of this kind cut texts by a pattern before they merge, so a cut is certain only where that pattern finds the
same pre-tokens on both sides of it. It looks ahead in one case, white space before other characters, and it takes an
apostrophe as the begin of a contraction only where a pre-token begins. So there is no cut

- behind white space (the pattern decides which of it goes with the next word),
- before an apostrophe, but for one behind a letter A-Z or a-z or a digit, which ends a pre-token anyway,
- inside a character.

An added token is found before the pattern is used: it is a fragment of its own, with cuts on both sides.

Texts are taken some MB at a time, from one certain cut to another, so a long text takes no more memory than many short
ones beyond its own ids. Each distinct fragment of these is encoded once, and a bounded cache keeps fragments that come again.

Null text counts as empty. A null or repeated id, other columns and equal texts have no effect: there is one row out for
each row in. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import fresh
from .tokens import byte_characters

SLICE = 4 << 20  # bytes of text that are cut at a time
KEPT = 500_000  # fragments of the young cache; the old one holds as many
LONGEST = 64  # bytes of a fragment that is kept
#: White space of the pattern beyond U+007F, as UTF-8; U+001C to U+001F are taken for white space too, as some libraries do.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
NARROW_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
APOSTROPHE = 0x27


def never_inside(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second) whether it stands inside no token."""
    data = np.frombuffer(b"".join(tokens), np.uint8)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    border = np.zeros(len(data), bool)
    border[np.cumsum([len(t) for t in tokens])[:-1] - 1] = True
    out = np.ones(1 << 16, bool)
    out[pair[~border[:-1]]] = False
    return out


class ForcedSplitter:
    """Encodes and decodes columns with one byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before, added = made["pre_tokenizer"] or {}, made["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if made["model"]["type"] != "BPE" or made["normalizer"] or not plain or (made["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("forced boundaries need a byte-level BPE vocabulary without a normalizer or a prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("an added token that looks at its neighbours can't be cut out")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shown = byte_characters()
        byte = {c: b for b, c in ({b: chr(b) for b in range(256) if b not in shown} | shown).items()}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        whole = [b""] * (max(names.values(), default=-1) + 1)
        for name, k in names.items():
            whole[k] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        self.sizes = np.array([len(t) for t in whole], np.int64)
        self.bytes, self.places = np.frombuffer(b"".join(whole), np.uint8), np.cumsum(self.sizes) - self.sizes
        model = self.tokenizer.get_vocab(with_added_tokens=False)
        self.never = never_inside([whole[k] for k in model.values()])
        contents = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        self.narrow, self.wide_ends, self.plain = (np.zeros(256, bool) for _ in range(3))
        self.narrow[NARROW_SPACES] = True
        self.wide_ends[[s[-1] for s in WIDE_SPACES]] = True
        self.plain[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """The certain cuts of UTF-8 bytes, as the places of the bytes behind them. Added tokens are not looked at."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.never[data[:-1].astype(np.uint16) << 8 | data[1:]])
        left, right = data[at], data[at + 1]
        sure = (right & 0xC0 != 0x80) & ~self.narrow[left] & ((right != APOSTROPHE) | self.plain[left])
        at, left = at[sure], left[sure]
        doubt = np.flatnonzero(self.wide_ends[left])
        if len(doubt):
            found = np.zeros(len(doubt), bool)
            for s in WIDE_SPACES:
                same = at[doubt] >= len(s) - 1
                for k, b in enumerate(reversed(s)):
                    same &= data[at[doubt] - k] == b
                found |= same
            at = np.delete(at, doubt[found])
        return at + 1

    def slices(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bytes of about SLICE and where their fragments begin; slices begin at certain cuts, at texts or at added tokens."""
        begins, held, base = np.append(0, ends)[:-1], [], 0
        spans = [m.span() for m in self.added.finditer(memoryview(data))] if self.added else []
        first = np.searchsorted(ends, [i for i, _ in spans], side="right")
        spans = [s for s, k in zip(spans, first.tolist(), strict=True) if s[1] <= ends[k]]  # one across two texts is none
        hard = np.unique(np.concatenate([begins, np.array(spans, np.int64).ravel()]))
        hard = hard[hard < len(data)]
        for low in range(0, len(data), SLICE):
            high = min(low + SLICE, len(data))
            own = self.cuts(data[max(low - 3, 0) : high]) + max(low - 3, 0)  # a pair, and white space of three bytes before it
            own = own[own >= low]
            if spans:
                k = np.searchsorted([i for i, _ in spans], own) - 1
                own = own[(k < 0) | (own > np.array([j for _, j in spans])[k])]
            own = np.union1d(own, hard[np.searchsorted(hard, low) : np.searchsorted(hard, high)])
            if not len(own):
                continue
            held.append(own[:-1])
            start = np.concatenate(held)
            if own[-1] > base:
                yield data[base : own[-1]], start - base
            held, base = [own[-1:]], int(own[-1])
        if base < len(data):
            yield data[base:], np.concatenate(held) - base

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        data, ends = text_bytes(texts)
        ids, places, counts, base, before = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for part, start in self.slices(data, ends):
            some, sizes = self.fragments(part, start)
            ids.append(some)
            places.append(base + start)
            counts.append(before + np.cumsum(sizes) - sizes)
            base, before = base + len(part), before + len(some)
        # a text's end is the begin of the first fragment behind it
        return np.concatenate(ids), np.append(np.concatenate(counts), before)[np.searchsorted(np.concatenate(places), ends)]

    def fragments(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments that begin at start, and the number of each one's."""
        offsets = np.append(start, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        each = self.each(names)
        flat, sizes = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) >> 2
        return flat[gather(index, np.cumsum(sizes) - sizes, sizes)], sizes[index]

    def each(self, names: list[str]) -> list[bytes]:
        """The ids of each fragment, as bytes."""
        out = list(map(self.young.get, names))
        missing = [k for k, x in enumerate(out) if x is None]
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        unknown = []
        for k in missing:
            if (x := self.old.get(names[k])) is None:
                unknown.append(k)
            else:
                out[k] = self.young[names[k]] = x
        for k, e in zip(unknown, self.tokenizer.encode_batch([names[k] for k in unknown], add_special_tokens=False), strict=True):
            out[k] = x = np.array(e.ids, "<u4").tobytes()
            if len(names[k]) <= LONGEST:
                self.young[names[k]] = x
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of ids that end at ends. Bytes that are no UTF-8 become U+FFFD; ids that the vocabulary lacks give nothing."""
        ids = ids[known] if not (known := ids < len(self.sizes)).all() else ids
        ends = np.append(0, np.cumsum(known))[ends]
        data = self.bytes[gather(ids, self.places, self.sizes)]
        offsets = np.append(0, np.append(0, np.cumsum(self.sizes[ids]))[ends])
        raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def gather(index: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... (sizes[i] of them) of each i of index, one after the other."""
    many = sizes[index]
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[index] - (ends - many), many)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text ends; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, np.dtype(kind).itemsize * texts.offset).astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of 32-bit integers, cut at ends."""
    offsets = (4 * np.append(0, ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


_made: dict[str, ForcedSplitter] = {}


def splitter(path: str) -> ForcedSplitter:
    """One for each Python worker and vocabulary file."""
    if path not in _made:
        _made[path] = ForcedSplitter(path)
    return _made[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids binary (little-endian unsigned 32-bit integers) of each row's text; with decoded, also
    the text that these ids give."""
    docs = docs.select(id_col, text_col)

    def run(batches):
        fresh()
        own = splitter(path)
        for b in batches:
            ids, ends = own.encode(b.column(1))
            out = [b.column(0), pa.array(np.diff(ends, prepend=0)), cells(ids, ends)] + ([own.decode(ids, ends)] if decoded else [])
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_tokens", "ids", *(["decoded"] if decoded else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: what the ids (as encode() gives them) stand for; null ids give an empty text."""
    encoded = encoded.select(id_col, ids_col)

    def run(batches):
        fresh()
        own = splitter(path)
        for b in batches:
            held = [x or b"" for x in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in held], dtype=np.int64) >> 2
            yield pa.RecordBatch.from_arrays([b.column(0), own.decode(np.frombuffer(b"".join(held), "<u4"), ends)], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.mapInArrow(run, f"`{id_col}` {kind}, text string")
