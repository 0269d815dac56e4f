"""Importance resampling towards a target distribution by hashed n-grams.

A document's features are its runs of one and two words; a feature's bucket is its CRC-32
modulo ``buckets``.  The log ratio of a bucket's share in the target texts to its share in
the corpus is its gain; a document's mean gain plus Gumbel noise drawn from its id is its
score, and the highest scores are drawn: sampling without replacement in proportion to the
exponential of the weight.

CRCs are taken many at a time: the distinct features of a chunk of texts are grouped by
length into matrices of bytes, all CRCs of a matrix advance together column by column, and
the buckets are scattered back to the places of the features.  A feature longer than PIECE
bytes enters the matrices as pieces, whose CRCs are joined afterwards (CRC-32 is linear).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordering import in_order

from .text import _LOWER, chunks, pick, stored

BUCKETS = 10_000
PIECE = 64                  # bytes of a feature that one matrix row holds at most
CELLS = 1 << 20             # bytes of one matrix at most
SCALE = 1000                # gains and scores are counted in thousandths
LEAST_WORDS, PERCENT, SEED = 20, 25, 7

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True      # after lower-casing


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _advance(state: np.ndarray, columns) -> np.ndarray:
    """CRC states after one byte each, column by column."""
    for column in columns:
        state = _CRC[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _shift_tables() -> np.ndarray:
    """(4, 256): what each byte of a state becomes after PIECE zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_advance(byte << np.uint32(8 * k), np.zeros(PIECE, np.uint32)) for k in range(4)])


_SHIFT = _shift_tables()


def _piece_states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC states of pieces of at most PIECE bytes; a first piece starts from all ones, others from zero."""
    out = np.where(first, np.uint32(0xFFFFFFFF), np.uint32(0))
    order = np.argsort(sizes, kind="stable")
    edges = np.searchsorted(sizes[order], np.arange(PIECE + 2))
    for size in range(1, PIECE + 1):
        alike, step = order[edges[size]:edges[size + 1]], CELLS // size
        for a in range(0, len(alike), step):
            rows = alike[a:a + step]
            matrix = data[starts[rows][None, :] + np.arange(size)[:, None]]         # one line per byte column
            out[rows] = _advance(out[rows], matrix)
    return out


def crc32_all(values: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each value of a binary array (no nulls)."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint32)
    off = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(1, np.uint8)
    sizes = np.diff(off)
    pieces = np.maximum(-(-sizes // PIECE), 1)
    if pieces.max() == 1:
        return ~_piece_states(data, off[:-1], sizes, np.ones(n, bool))
    # the first piece takes the odd length, all others are whole
    heads = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - heads[owner]
    head_size = sizes - (pieces - 1) * PIECE
    starts = off[:-1][owner] + np.where(nth > 0, head_size[owner] + (nth - 1) * PIECE, 0)
    states = _piece_states(data, starts, np.where(nth > 0, PIECE, head_size[owner]), nth == 0)
    out, left = states[heads], np.flatnonzero(pieces > 1)
    k = 1
    while len(left):
        s = out[left]
        moved = _SHIFT[0][s & 255] ^ _SHIFT[1][(s >> 8) & 255] ^ _SHIFT[2][(s >> 16) & 255] ^ _SHIFT[3][s >> 24]
        out[left] = moved ^ states[heads[left] + k]
        k += 1
        left = left[pieces[left] > k]
    return ~out


def term_bounds(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of some texts (binary, no nulls) as one array, and the bounds of each text's part."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    data = _LOWER[raw]
    inside = np.concatenate(([False], _IS_TERM[data], [False]))
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    full = np.diff(off) > 0                                     # a text's first and last byte are edges too
    opens[off[:-1][full]] = inside[1:-1][off[:-1][full]]
    closes[off[1:][full] - 1] = inside[1:-1][off[1:][full] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))])
    return words, np.searchsorted(starts, off)


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all features in text order, bounds of each text's part)."""
    words, bounds = term_bounds(texts)
    n_words = np.diff(bounds)
    known = words.dictionary_encode()
    ids, terms = known.indices.to_numpy(), known.dictionary
    last = np.zeros(len(ids) + 1, bool)
    last[bounds[1:][n_words > 0] - 1] = True
    left = np.flatnonzero(~last[:len(ids)])                     # words that another of the same text follows
    pairs = pa.array(ids[left].astype(np.int64) * max(len(terms), 1) + ids[left + 1]).dictionary_encode()
    both = pairs.dictionary.to_numpy()
    joined = pc.binary_join_element_wise(terms.take(pa.array(both // max(len(terms), 1))),
                                         terms.take(pa.array(both % max(len(terms), 1))), b" ")
    one = crc32_all(terms) % np.uint32(buckets)
    two = crc32_all(joined) % np.uint32(buckets)
    n_pairs = np.maximum(n_words - 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(n_words + n_pairs)))
    out = np.empty(out_bounds[-1], np.uint32)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    at = out_bounds[:-1][text_of] + np.arange(len(ids)) - bounds[:-1][text_of]
    out[at] = one[ids]
    out[at[left] + n_words[text_of[left]]] = two[pairs.indices.to_numpy()]
    return n_words, out, out_bounds


def _width(buckets: int):
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, features) from (id, text): the buckets of all features as little-endian integers."""
    kind = _width(buckets)

    def run(batches):
        for b in batches:
            ids, whole = b.column(0), b.column(1)
            for first, last in chunks(whole):
                n_words, found, bounds = feature_buckets(whole.slice(first, last - first), buckets)
                values = pa.Array.from_buffers(pa.binary(), last - first, [
                    None, pa.py_buffer((bounds * kind.itemsize).astype(np.int32)), pa.py_buffer(found.astype(kind))])
                yield pa.record_batch([ids.slice(first, last - first), pa.array(n_words.astype(np.int64)), values],
                                      names=["id", "n_words", "features"])

    binary = texts.select("id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return binary.mapInArrow(run, "id long, n_words long, features binary")


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and the bounds of each row's part."""
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer((column.buffers()[2] or b"")[off[0]:off[-1]], kind) if n else np.zeros(0, kind)
    return data, (off - off[0]) // kind.itemsize if n else np.zeros(1, np.int64)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds; one small sum per task, ``buckets`` rows to the driver."""
    kind = _width(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    parts = features.select("features").mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    k = float(len(corpus))
    s_all, t_all = float(corpus.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each row's features, 0 without any."""
    kind = _width(len(gain))

    def run(batches):
        for b in batches:
            found, bounds = _numbers(b.column(2), kind)
            total = np.concatenate(([0], np.cumsum(gain[found])))
            n = np.diff(bounds)
            weight = (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n), pa.array(weight)],
                                  names=["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``.

    ``rank`` counts the drawn rows from 1: ``percent`` percent (rounded down) of those with
    ``least_words`` words or more, by score, ties to the smaller ``doc_id``; others have
    none.  Null and blank texts have no features and weight 0.  A null ``doc_id`` draws its
    noise from the empty id and comes last in a tie; rows that repeat are ranked one after
    the other.  Extra columns are ignored, texts are read whole; an empty table gives no
    rows, an empty target leaves all gains to the corpus alone.
    """
    features = stored(bucketed(pick(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "id"), buckets),
                      "ngram-buckets", compression="zstd")
    wanted = bucketed(target.select(F.lit(0).cast("long").alias("id"), F.col("`text`").cast("string").alias("text")), buckets)
    rows = weights(features, gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("stands", F.col("n_words") >= least_words)
    rows = in_order(rows, [F.desc("stands"), F.desc("score"), F.asc_nulls_last("id")], "place")
    drawn = rows.agg(F.expr(f"{percent} * count_if(stands) div 100").alias("drawn"))
    rows = rows.crossJoin(F.broadcast(drawn))                                           # one row
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score",
                       F.when(F.col("stands") & (F.col("place") <= F.col("drawn")), F.col("place")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` was drawn, all columns kept.  Rows that share a drawn id all stay."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("`doc_id`").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
