"""Shared pieces: word expressions for Spark, and vectorised word hashes for tasks.

A *word* is a maximal run of characters other than space and ``\\t\\n\\x0b\\f\\r``.
``bytes.split()`` without an argument splits on exactly these six characters, so
the Python side works on UTF-8 bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_path

SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, split: str = SPLIT, trim: str = SPACES) -> Column:
    """The words of ``text`` as an array; null and blank texts give an empty array."""
    t = F.btrim(text, F.lit(trim))
    return F.when(F.length(t) > 0, F.split(t, split)).otherwise(F.array().cast("array<string>"))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(text, UPPER, LOWER)


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table holds cannot clash."""
    return docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) to the shared folder and read back.

    Later steps read the files, so a lost executor costs no more than the step
    it was in, and several readers do not repeat the work.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


# ---- vectorised word hashes -------------------------------------------------------
CHUNK = 1 << 18                     # bytes of text hashed at once; a longer text is a chunk of its own
_R, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n (at least)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if n > 4 * CHUNK:
            del _POWERS[base]       # do not keep the tables of one very long text
    return have


def chunks(texts, size: int = CHUNK):
    """(first, last) runs of a string array with about ``size`` bytes of text each."""
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int32 if str(texts.type) in ("string", "binary") else np.int64)
    off = off[texts.offset:texts.offset + n + 1].astype(np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


class Words:
    """The words of some texts (bytes) as arrays: place, hash and text of each word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = _IS_WORD[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))   # words before each text
        if len(self.starts):
            up, down = _powers(_R, len(data))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)))
            self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words that start at each word (wraps over text ends: use ``bounds``)."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = _powers(_Q, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:n], dtype=np.uint64)))
        return mix((total[k:] - total[:-k]) * down[:n - k + 1])
