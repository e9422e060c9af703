"""Token ids of every document in Simple-8b: 64-bit words whose selector says how many ids of how many bits they hold."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes as B

#: Ids in a word by selector; selector 0 holds 60 zeros-or-ones, 13 one id of 60 bits. 14 is the escape: the next word is an id of 64 bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 14
#: Ids in a block; each block begins with a new word.
BLOCK = 128
U = np.uint64
_BITS16 = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
#: The pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    if x.max(initial=0) < 1 << 16:
        return _BITS16[x]
    bits = np.zeros(len(x), np.uint8)
    for k in (48, 32, 16):
        part = (x >> U(k)).astype(np.uint16)
        bits = np.where((bits == 0) & (part > 0), _BITS16[part] + np.uint8(k), bits)
    return np.where(bits == 0, _BITS16[x.astype(np.uint16)], bits)


def encode(ids: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several sequences at once: those of sequence i are ids[first[i]:first[i + 1]], any unsigned 64-bit numbers.

    Returns the words, where each sequence's words begin (n + 1), the first
    word of each block counted from the sequence's first, and where each
    sequence's blocks begin (n + 1).  All blocks are packed side by side: every
    round takes the next word of each.
    """
    ids = np.ascontiguousarray(ids, U)
    n, total = np.diff(first), len(ids)
    blocks = -(-n // block)
    bfirst = np.concatenate([[0], np.cumsum(blocks)])
    bstart = np.repeat(first[:-1], blocks) + (np.arange(bfirst[-1]) - np.repeat(bfirst[:-1], blocks)) * block
    bend = np.minimum(bstart + block, np.repeat(first[1:], blocks))

    bits = _bit_lengths(ids)
    longest = np.full(total, ESCAPE, np.uint8)  # selector with the most ids from here; a selector that fails rules out those of more ids
    run, have = bits.copy(), 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while have < COUNTS[s] and have < total:
            np.maximum(run[:-have], bits[have:], out=run[:-have])
            run[total - have :] = 255
            have += 1
        if have < COUNTS[s]:
            break
        longest -= (run <= WIDTHS[s]).view(np.uint8)
    # at the end of a block a selector may have room for more ids than are left: the rest of the word is zero
    counts, rounds, at = np.append(COUNTS, 1), [], bstart.copy()
    live = np.arange(len(bstart))
    n_words = np.zeros(len(bstart), np.int64)
    while len(live):
        p = at[live]
        rounds.append((live, p))
        n_words[live] += 1
        p = p + counts[longest[p]]
        at[live] = p
        live = live[p < bend[live]]
    if not rounds:
        return np.zeros(0, U), np.zeros(len(first), np.int64), np.zeros(0, np.int64), bfirst
    wplace = np.concatenate([[0], np.cumsum(n_words)])
    wp = np.empty(wplace[-1], np.int64)
    for r, (b, p) in enumerate(rounds):
        wp[wplace[b] + r] = p
    sel = longest[wp]
    take = np.diff(np.append(wp, total))
    width = np.append(WIDTHS, 0)[sel].astype(np.uint8)
    shift = (np.arange(total) - np.repeat(wp, take)).astype(np.uint8) * np.repeat(width, take)
    word = np.add.reduceat(ids << shift.astype(U), wp)
    word[sel == ESCAPE] = 0
    word |= sel.astype(U) << U(60)
    wb = np.repeat(np.arange(len(bstart)), n_words)
    esc = sel == ESCAPE
    size = 1 + esc
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(place[-1], U)
    out[place[:-1]] = word
    out[place[:-1][esc] + 1] = ids[wp[esc]]
    per_block = np.bincount(wb, size, len(bstart)).astype(np.int64)
    bword = np.concatenate([[0], np.cumsum(per_block)])
    wfirst = bword[bfirst]
    return out, wfirst, bword[:-1] - np.repeat(wfirst[:-1], blocks), bfirst


def decode(words: np.ndarray, count: int, offsets: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """The ``count`` ids of one sequence; ``offsets`` are its blocks' first words, and all blocks are unpacked side by side."""
    out = np.zeros(count, U)
    if not count:
        return out
    at = np.asarray(offsets, np.int64).copy()
    to = np.arange(len(at)) * block
    end = np.minimum(to + block, count)
    counts, widths = np.append(COUNTS, 1), np.append(WIDTHS, 0)
    live = np.arange(len(at))
    while len(live):
        w = words[at[live]]
        sel = (w >> U(60)).astype(np.int64)
        esc = sel == ESCAPE
        take = np.minimum(counts[sel], end[live] - to[live])
        width = widths[sel].astype(U)
        mask = np.where(width > 0, (U(1) << width) - U(1), U(0))
        for j in range(int(take.max())):
            some = take > j
            out[to[live[some]] + j] = (w[some] >> (width[some] * U(j))) & mask[some]
        if esc.any():
            out[to[live[esc]]] = words[at[live[esc]] + 1]
        at[live] += 1 + esc
        to[live] += take
        live = live[to[live] < end[live]]
    return out


_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def _char_classes() -> np.ndarray:
    """Class of every code point as in PATTERN."""
    if not _classes:
        import regex

        t = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pat, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
            for m in regex.finditer(pat, every):
                t[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        _classes.append(t)
    return _classes[0]


def split(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in code points ``code``; ``off`` has where the texts begin and the end.  No text has an apostrophe."""
    n = len(code)
    kind = _char_classes()[code]
    edge = np.zeros(n + 1, np.bool_)
    edge[off] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last of several white space characters before a visible one is a piece of its own
    nxt_visible = np.zeros(n, np.bool_)
    nxt_visible[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= nxt_visible
    # and if it is a blank, it belongs to what follows
    glue = nxt_visible & (code == 32)
    start[1:][glue[:-1] & ~edge[1:n]] = False
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE by a rank file; pieces already seen are remembered, up to ``remember`` of them."""

    def __init__(self, path: str, remember: int = 150_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.bpe._core_bpe.encode_single_piece
        self.remember = remember
        self.seen: dict[int, list[int]] = {}

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (n + 1)."""
        quoted = np.flatnonzero(pa.compute.match_substring(text, "'").to_numpy(zero_copy_only=False))
        if len(quoted):  # contractions: the pattern itself
            plain = text.to_pylist()
            slow = {int(i): np.array(self.bpe.encode_ordinary(plain[i]), np.uint32) for i in quoted}
            for i in slow:
                plain[i] = ""
            text = pa.array(plain, pa.large_string())
        ids, first = self._plain(text)
        if not len(quoted):
            return ids, first
        parts = [slow.get(i, ids[first[i] : first[i + 1]]) for i in range(len(text))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, lengths, keys = [], [], []
        for lo, hi in B.pieces(text, B.STAGE_CHUNK // 2):
            part = text.slice(lo, hi - lo)
            raw, boff = B.buffer(part)
            if not len(raw):
                lengths.append(np.zeros(hi - lo, np.int64))
                continue
            lead = (raw & 0xC0) != 0x80
            code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum(lead)])
            begin = split(code, chars[boff])
            at = np.flatnonzero(lead)[begin]  # in bytes
            end = np.append(at[1:], len(raw))
            s = B.prefix_hash(raw)
            key = B.range_hash(s, at, end) ^ (end - at).astype(U)
            parts.append((raw, at, end))
            keys.append(key)
            lengths.append(np.diff(np.searchsorted(at, boff)))
        per = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        if not keys:
            return np.zeros(0, np.uint32), np.zeros(len(text) + 1, np.int64)
        every = np.concatenate(keys)
        inverse, uniq = pd.factorize(every)
        where = np.empty(len(uniq), np.int64)
        where[inverse[::-1]] = np.arange(len(every))[::-1]
        size = np.cumsum([0, *map(len, keys)])
        chunk = np.searchsorted(size, where, side="right") - 1
        seen, single, coded = self.seen, self.single, []
        if len(seen) > self.remember:
            seen.clear()
        for k, c, i in zip(uniq.tolist(), chunk.tolist(), where.tolist(), strict=True):
            got = seen.get(k)
            if got is None:
                raw, at, end = parts[c]
                i -= size[c]
                got = seen[k] = single(raw[at[i] : end[i]].tobytes())
            coded.append(got)
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(n.sum()))
        start = np.concatenate([[0], np.cumsum(n)])
        count = n[inverse]
        to = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.arange(to[-1]) - np.repeat(to[:-1] - start[inverse], count)]
        return ids, to[np.concatenate([[0], np.cumsum(per)])]


_encoders: dict[str, Encoder] = {}
SCHEMA = "doc_id long, n_tokens long, payload binary, block_offsets array<int>"


def token_ids(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, n_tokens, payload, block_offsets), one for each row of ``docs``, repeated rows included.

    ``tokenizer`` is the path of a rank file of byte-level BPE that all workers
    can read.  ``payload`` has the Simple-8b words, little-endian;
    ``block_offsets`` the first word of every ``block`` ids.  A null or empty
    text has no tokens, an empty payload and no offsets; a null id stays null;
    other columns are ignored.  A map without a shuffle: memory is bounded by
    Arrow's batches and by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        enc = _encoders[tokenizer]
        for batch in batches:
            text = B.filled(batch.column(1))
            for lo, hi in B.pieces(text, B.STAGE_CHUNK // 2):
                rows = hi - lo
                ids, f = enc(text.slice(lo, rows))
                words, wf, offs, bf = encode(ids, f, block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows),
                        pa.array(np.diff(f)),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((wf * 8).astype(np.int32)), pa.py_buffer(words.astype("<u8"))]),
                        pa.ListArray.from_arrays(pa.array(bf.astype(np.int32)), pa.array(offs.astype(np.int32))),
                    ],
                    ["doc_id", "n_tokens", "payload", "block_offsets"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decode_row(payload: bytes, n_tokens: int, block_offsets: list[int], block: int = BLOCK) -> np.ndarray:
    return decode(np.frombuffer(payload, "<u8"), n_tokens, np.asarray(block_offsets), block)
