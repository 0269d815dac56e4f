"""Fast exact encoding: pieces of text that always encode alike are encoded once.

The byte-level vocabularies split a text before merging, and never across a boundary
between two non-space characters joined by one space or one line end.  So a text
without longer white space is its pieces (words with their leading space, and line
ends) one after the other, and each distinct piece needs the tokenizer only once per
worker.  Other texts, and those that hold a special token's string, are encoded whole.

Pieces are cut, looked up and put together again for a chunk of texts at once, as arrays;
new pieces are encoded many to a string.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .text import chunks

# White space besides the space and the line end, and NUL, by the length of its UTF-8 form.
ODD_SPACE = ["\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f", "\x85\xa0",
             "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
ODD_CODES = [[int.from_bytes(c.encode(), "big") for c in group] for group in ODD_SPACE]
MAX_PIECES = 600_000        # pieces that a worker remembers; beyond it, it starts anew
CHUNK = 1 << 20             # bytes of text encoded at once
MAX_PIECE_BYTES = 128       # longer pieces are not remembered
JOINED = 256                # new pieces encoded in one string


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space other than the space and the line end."""
    found = [np.flatnonzero(np.isin(data, ODD_CODES[0]))]
    for size, low, high in ((2, 0xC2, 0xC2), (3, 0xE1, 0xE3)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + size <= len(data)]
        code = np.zeros(len(at), np.int64)
        for k in range(size):
            code = code << 8 | data[at + k]
        found.append(at[np.isin(code, ODD_CODES[size - 1])])
    return np.concatenate(found)


class PieceEncoder:
    """``encode(texts)`` -> ids of all texts and the bounds of each text's part.

    ``whole(texts)`` is the plain encoder of several texts; ``specials`` are strings it
    treats apart; ``lengths`` has the bytes that each id stands for (None: pieces are
    encoded one by one).
    """

    def __init__(self, whole, dtype, specials=(), lengths=None):
        self.whole, self.dtype, self.lengths = whole, np.dtype(dtype), lengths
        self.specials = [s.encode() for s in specials]
        self.forget()

    def forget(self):
        self.place: dict[bytes, int] = {}                       # piece -> its row in the table
        self.ids, self.n_ids = np.zeros(1 << 16, self.dtype), 0
        self.begin = np.zeros(1 << 16, np.int64)                # of each row's ids, and the end of the last

    def remember(self, pieces: list[bytes], ids: list[np.ndarray]) -> None:
        """Add rows to the table of known pieces."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.n_ids + int(sizes.sum())
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids[:self.n_ids], np.zeros(max(need, 2 * len(self.ids)) - self.n_ids, self.dtype)))
        if len(ids):
            self.ids[self.n_ids:need] = np.concatenate(ids)
        first, last = len(self.place), len(self.place) + len(pieces)
        if last >= len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(last, np.int64)))
        self.begin[first + 1:last + 1] = self.n_ids + np.cumsum(sizes)
        self.place.update(zip(pieces, range(first, last)))
        self.n_ids = need

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece.  Words stand in one string, each with its leading space or a line end before it,
        where the text splits anyway; the bytes of the ids say where each word's begin."""
        out: list = [None] * len(pieces)
        joined = []
        for i, p in enumerate(pieces):
            if self.lengths is None or p == b"\n":
                out[i] = np.asarray(self.whole([p.decode()])[0], self.dtype)
            else:
                joined.append(i)
        rows = [joined[a:a + JOINED] for a in range(0, len(joined), JOINED)]
        parts = [[pieces[i] if pieces[i][0] == 32 else b"\n" + pieces[i] for i in row] for row in rows]
        found = self.whole([b"".join(part).decode() for part in parts]) if rows else []
        for row, part, ids in zip(rows, parts, found):
            ids = np.asarray(ids, self.dtype)
            reached = np.cumsum(self.lengths[ids])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            upto = np.searchsorted(reached, ends)
            if reached[-1] != ends[-1] or (reached[upto] != ends).any():
                raise ValueError("the vocabulary does not split between words")
            upto = (upto + 1).tolist()
            for i, a, b in zip(row, [0, *upto[:-1]], upto):
                out[i] = ids[a + (pieces[i][0] != 32):b]
        return out

    def rows_of(self, pieces: list[bytes]) -> np.ndarray:
        """Rows of the pieces in the table, after the new ones were added."""
        rows = np.array([self.place.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new) and len(self.place) + len(new) > MAX_PIECES:
            self.forget()
            rows, new = np.full(len(pieces), -1), np.arange(len(pieces))
        if len(new):
            first, added = len(self.place), [pieces[i] for i in new]
            self.remember(added, self.encode_pieces(added))
            rows[new] = np.arange(first, first + len(new))
        return rows

    def plain(self, data: np.ndarray, raw: bytes, off: np.ndarray) -> np.ndarray:
        """For each text, whether its only white space is single spaces and line ends between other characters."""
        gap = (data == 32) | (data == 10)
        wrong = np.concatenate((gap[1:] & gap[:-1], [False]))
        wrong[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))] - 1] = False        # the last of one text and the first of the next
        full = np.diff(off) > 0
        wrong[off[1:][full] - 1] |= gap[off[1:][full] - 1]
        total = np.concatenate(([0], np.cumsum(wrong)))
        ok = total[off[1:]] == total[off[:-1]]
        odd = [odd_spaces(data)] + [np.array([m.start() for m in re.finditer(re.escape(s), raw)], np.int64) for s in self.specials]
        ok[np.searchsorted(off, np.concatenate(odd), "right") - 1] = False
        return ok

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary, UTF-8, no nulls) and the bounds of each text's part."""
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        raw = (texts.buffers()[2] or pa.py_buffer(b""))[off[0]:off[-1]].to_pybytes()
        off = off - off[0]
        data = np.frombuffer(raw, np.uint8)
        ok = self.plain(data, raw, off) & (np.diff(off) > 0)
        # pieces of the plain texts: a new one at each space, at and after each line end, and where a text begins
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        cut[:-1] |= (data == 32) | (data == 10)
        cut[1:] |= data == 10
        inside = np.repeat(ok, np.diff(off))
        cuts = np.flatnonzero(cut)
        mine = inside[cuts[:-1]]
        starts, sizes = cuts[:-1][mine], np.diff(cuts)[mine]
        place = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        known = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(place), pa.py_buffer(data if ok.all() else np.ascontiguousarray(data[inside]))]).dictionary_encode()
        pieces = known.dictionary
        is_long = np.diff(np.frombuffer(pieces.buffers()[1], np.int32)[:len(pieces) + 1]) > MAX_PIECE_BYTES
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        if is_long.any():                                       # their ids follow the remembered ones, for this chunk only
            rows = self.rows_of([p for p, long in zip(pieces, is_long) if not long])
            extra = self.encode_pieces([p for p, long in zip(pieces, is_long) if long])
            lengths = np.array([len(x) for x in extra])
            table = np.concatenate((self.ids[:self.n_ids], *extra))
            first, size = np.zeros((2, len(pieces)), np.int64)
            first[~is_long], size[~is_long] = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
            first[is_long], size[is_long] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        else:
            rows = self.rows_of(pieces)
            table, first, size = self.ids, self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        which = known.indices.to_numpy()
        counts = size[which]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = table[np.repeat(first[which] - upto[:-1], counts) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, off)]
        odd = np.flatnonzero(~ok & (np.diff(off) > 0))
        if not len(odd):
            return ids, bounds
        parts = [ids[bounds[i]:bounds[i + 1]] for i in range(n)]
        for i, x in zip(odd.tolist(), self.whole([raw[off[i]:off[i + 1]].decode() for i in odd])):
            parts[i] = np.asarray(x, self.dtype)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text as bytes."""
        out, column = [], pa.array([t.encode() for t in texts], pa.binary())
        for first, last in chunks(column, CHUNK):
            ids, bounds = self.encode(column.slice(first, last - first))
            out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def tokenizers_encoder(path: str) -> PieceEncoder:
    """Encoder for a ``tokenizers`` JSON file, built once per worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark already runs a task per core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        dtype = "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

        def whole(texts):
            return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        names = tok.get_vocab(with_added_tokens=True)           # byte-level: one character of a name is one byte
        lengths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            lengths[i] = len(name)
        _ENCODERS[path] = PieceEncoder(whole, dtype, specials, lengths)
    return _ENCODERS[path]


def tiktoken_encoder(path: str) -> PieceEncoder:
    """Encoder for a tiktoken rank file, built once per worker."""
    if path not in _ENCODERS:
        from .secret_scan import encoding
        vocabulary = encoding(path)
        one = vocabulary.encode_ordinary
        lengths = np.array([len(vocabulary.decode_single_token_bytes(i)) for i in range(vocabulary.n_vocab)], np.int64)
        _ENCODERS[path] = PieceEncoder(lambda texts: [one(t) for t in texts], "<u4", lengths=lengths)
    return _ENCODERS[path]
