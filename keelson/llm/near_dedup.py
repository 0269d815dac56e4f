"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes; three words unless the
   caller asks for another length) and a signature of minima, 125 for 85 percent.  Texts with equal sets are one class, led by its smallest ``doc_id``;
   from here on only leaders take part, so a text that is copied a million times costs
   what one text costs.
2. Leaders that agree on one band of minima share a bucket: 25 bands of 5 from 85 percent
   on, below that bands of 4, as many as keep the chance of a miss (28 at 80 percent).
3. First every member of a bucket is compared with its smallest one, the pivot.  In a
   group of near copies this links nearly all, at one comparison a member.
4. Buckets whose members are not all in one component by then are completed inside
   tasks, in blocks of bounded size: every member outside the bucket's largest component
   meets every member of another component, so no pair of different components is left
   out, and no pair becomes a row unless it is a link.
5. A comparison reads the two signatures batch by batch and stops as soon as the
   posterior probability of the wanted similarity falls below MISS; what survives is
   decided exactly on the full shingle sets.
6. Links are contracted to components by minimum labels.

A pair at the wanted similarity of 0.85 fails to share a bucket with probability
(1 - 0.85^5)^25 = 4e-7, one at 0.8 with (1 - 0.8^4)^28 = 4e-7; more similar pairs more
rarely.  Nothing is gathered on the
driver; lineage is cut in the shared folder after each step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

from .text import Words, chunks, mix, pick, small_side, stored

SHINGLE, PERCENT = 3, 85
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
SKIP = 5e-7                 # most chance that a pair at the wanted similarity shares no bucket
BATCH = 25                  # minima compared at once
MISS = 1e-7                 # chance that the comparison drops a pair that is similar enough
MOST_BROADCAST = 200_000    # document ids that may be broadcast
BLOCK = 512                 # members, and outsiders, of a bucket that meet in one task at most


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, rows of a band) that miss a pair at the wanted similarity with a chance of SKIP at most."""
    if percent >= PERCENT:
        return BANDS, ROWS
    rows = ROWS - 1
    return math.ceil(math.log(SKIP) / math.log1p(-(percent / 100) ** rows)), rows


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text's part."""
    w = Words(texts, lower=True)
    grams = w.grams(k)
    sets, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        a, b = w.bounds[i], w.bounds[i + 1]
        if b - a >= k:
            s = np.unique(grams[a:b - k + 1])
        elif b > a:         # the whole sequence as one; the length keeps it apart from longer ones
            with np.errstate(over="ignore"):
                s = mix(np.array([np.uint64(b - a)], np.uint64))
                for h in w.hashes[a:b]:
                    s = mix(s * np.uint64(31) + h)
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def signatures(sets: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(texts, hashes) uint32 minima; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, hashes), np.uint32)
    seeds = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64))
    xors, muls = seeds[:hashes], seeds[hashes:] | np.uint64(1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[full]
        for j in range(hashes):
            h = (sets ^ xors[j]) * muls[j]
            out[full, j] = (np.minimum.reduceat(h, at) >> np.uint64(32)).astype(np.uint32)
    return out


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit sums over each set: equal for equal sets."""
    keys = []
    for seed in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ seed), dtype=np.uint64)))
        keys.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return keys


def profile(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig) of every row; a null text has an empty set."""
    hashes = math.prod(banding(percent))
    schema = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for first, last in chunks(texts):
                sets, bounds = shingle_sets([t or b"" for t in texts.slice(first, last - first).to_pylist()], shingle)
                sig = signatures(sets, bounds, hashes)
                yield pa.record_batch(
                    [b.column(0).slice(first, last - first), pa.array(np.diff(bounds))]
                    + [pa.array(k) for k in set_keys(sets, bounds)] + [pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return _binary_text(docs).mapInArrow(run, schema)


def _binary_text(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, shingles) of the documents in ``ids``."""
    def run(batches):
        for b in batches:
            texts = b.column(1)
            for first, last in chunks(texts):
                sets, bounds = shingle_sets([t or b"" for t in texts.slice(first, last - first).to_pylist()], shingle)
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(
                    [sets[bounds[i]:bounds[i + 1]].tobytes() for i in range(last - first)], pa.binary())],
                    names=["id", "shingles"])

    wanted = _binary_text(docs).join(small_side(ids, MOST_BROADCAST), F.col("doc_id") == F.col("id"), "left_semi")
    return wanted.mapInArrow(run, "id long, shingles binary")


def bucket_rows(leaders: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(bucket, band, id): one row per band of each leader."""
    n_bands, n_rows = banding(percent)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, n_bands, n_rows).astype(np.uint64)
            key = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=np.uint64)), sig.shape[:2])
            for r in range(n_rows):
                key = mix(key * np.uint64(31) + sig[:, :, r])
            yield pa.record_batch([
                pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(n_bands, dtype=np.int32), len(sig))),
                pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), n_bands))], names=["bucket", "band", "id"])

    return leaders.select("id", "sig").mapInArrow(run, "bucket long, band int, id long")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Fewest equal minima among the first BATCH, 2 * BATCH, ... that keep a pair.

    With a uniform prior the similarity given m of n equal is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, math.prod(banding(percent)) + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(pairs: DataFrame, leaders: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose set sizes and signatures leave the wanted similarity possible."""
    least, hashes = least_matches(percent), math.prod(banding(percent))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in (2, 3))
            alive, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, m in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                same[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[same[alive] >= m]
            yield b.select(["u", "v"]).take(pa.array(alive))

    a = leaders.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    c = leaders.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    near = pairs.join(a, "u").join(c, "v").where(
        F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return near.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) with 100 * |intersection| >= percent * |union|, on the full sets."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(binary_views(b.column(2)), binary_views(b.column(3))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    c = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    return pairs.join(a, "u").join(c, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id: ``comp`` is the smallest id reachable."""
    links = links.where(F.col("u") != F.col("v"))
    labels = links.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("comp", F.col("id"))
    return relabel(cut_lineage(labels), links)


def _relabelled(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its label in ``up`` (l, p), where it has one."""
    new = up.select(F.col("l").alias(column), F.col("p").alias("_p")).hint("merge")
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_p", column)).drop("_p")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, comp) after also following ``links`` (u, v) between components.

    Each pass hangs every component on its smallest neighbour, follows that step once
    more, and contracts the links to the new labels; the components left halve at least.
    """
    links = cut_lineage(links.where(F.col("u") != F.col("v")).distinct())
    while not links.isEmpty():
        both = links.union(links.select("v", "u"))
        up = both.groupBy(F.col("u").alias("l")).agg(F.least(F.min("v"), F.min("u")).alias("p"))
        up = cut_lineage(_relabelled(up, "p", up))
        labels = cut_lineage(_relabelled(labels, "comp", up))
        links = _relabelled(_relabelled(links, "u", up), "v", up).where(F.col("u") != F.col("v"))
        links = cut_lineage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return labels


def shared_buckets(leaders: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(bucket, band, id) of buckets with two members or more; of buckets with the same members, the first band's."""
    rows = cut_lineage(bucket_rows(leaders, percent))
    sizes = rows.groupBy("bucket", "band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                               F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    one = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket")
    return cut_lineage(rows.join(one.hint("merge"), "bucket", "left_semi"))


def in_blocks(members: DataFrame) -> DataFrame:
    """(bucket, band, i, j, outside, id, comp) of the buckets (bucket, band, id, comp) with several components.

    Block (i, j) of a bucket holds its members of part i (outside = 0) and, of its members
    outside the largest component, part j (outside = 1).
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("home"), F.sum("n").alias("m"),
                                          F.count("*").alias("comps")).where("comps > 1")
    m = members.join(buckets.hint("merge"), "bucket").withColumn("out", F.col("comp") != F.col("home.comp"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    outs = F.ceil((F.col("m") - F.col("home.n")) / BLOCK).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    inside = F.transform(each(outs), lambda j: F.struct(
        F.pmod(F.xxhash64("id"), parts).cast("int").alias("i"), j.alias("j"), F.lit(0).alias("outside")))
    outside = F.when(F.col("out"), F.transform(each(parts), lambda i: F.struct(
        i.alias("i"), F.pmod(F.xxhash64("id", F.lit(7)), outs).cast("int").alias("j"), F.lit(1).alias("outside"))))
    return m.select("bucket", "band", "id", "comp", F.inline(
        F.concat(inside, F.coalesce(outside, F.array().cast("array<struct<i:int,j:int,outside:int>>")))))


def binary_views(column: pa.Array):
    """The values of a binary column without copies."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].tolist() if len(column) else [0]
    data = memoryview(column.buffers()[2] or b"")
    return (data[a:z] for a, z in zip(off[:-1], off[1:]))


def complete_blocks(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) that join different components, from rows (bucket, band, i, j, outside, id, comp, sig, shingles).

    A pair is looked at only in its first common band, so not again in other buckets; a pair
    that the links found so far connect is skipped.
    """
    least, shape = least_matches(percent), banding(percent)

    def links(rows):
        band = rows[0][1]
        roots: dict[int, int] = {}

        def root(c):
            while roots.get(c, c) != c:
                c = roots[c]
            return c

        members = [r for r in rows if r[4] == 0]
        if not members:
            return
        ids = np.array([r[5] for r in members])
        sig = np.stack([np.frombuffer(r[7], np.uint32) for r in members])
        sets = [np.frombuffer(r[8], np.uint64) for r in members]
        sizes = np.array([len(x) for x in sets])
        comps = np.array([r[6] for r in members])
        for r in rows:
            if r[4] == 0:
                continue
            mine, own = np.frombuffer(r[7], np.uint32), np.frombuffer(r[8], np.uint64)
            alive = np.flatnonzero((comps != r[6]) & (np.minimum(sizes, len(own)) * 100 >= np.maximum(sizes, len(own)) * percent))
            same = np.zeros(len(ids), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                same[alive] += (sig[alive, part] == mine[part]).sum(1)
                alive = alive[same[alive] >= m]
            if not len(alive):
                continue
            bands = (sig[alive].reshape(-1, *shape) == mine.reshape(shape)).all(2)
            for x in alive[bands.argmax(1) == band]:
                if root(r[6]) == root(int(comps[x])):
                    continue
                both = len(np.intersect1d(own, sets[x], assume_unique=True))
                if 100 * both >= percent * (len(own) + int(sizes[x]) - both):
                    roots[root(r[6])] = root(int(comps[x]))
                    yield r[5], int(ids[x])

    def run(batches):
        rows, key, found = [], None, []
        for b in batches:
            # signatures and sets stay where they arrived; a block only points into its batches
            plain = (b.column(c).to_pylist() for c in range(7))
            for row in zip(*plain, binary_views(b.column(7)), binary_views(b.column(8))):
                at = (row[0], row[2], row[3])
                if at != key:
                    if rows:
                        found += links(rows)
                    rows, key = [], at
                rows.append(row)
        if rows:
            found += links(rows)
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                              names=["u", "v"])

    b = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "outside", "id")
    return b.select("bucket", "band", "i", "j", "outside", "id", "comp", "sig", "shingles").mapInArrow(run, "u long, v long")


def link_leaders(docs: DataFrame, leaders: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(id, comp) of every leader that shares a bucket."""
    members = shared_buckets(leaders, percent)
    labels = cut_lineage(members.select("id").distinct().withColumn("comp", F.col("id")))
    leaders = cut_lineage(leaders.join(labels, "id", "left_semi"))
    sets = stored(full_sets(docs, labels.select("id"), shingle), "shingle-sets")
    pivots = members.groupBy("bucket").agg(F.min("id").alias("pivot"))
    pairs = members.join(pivots.hint("merge"), "bucket").where(F.col("id") != F.col("pivot")) \
        .select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    near = cut_lineage(plausible(cut_lineage(pairs), leaders, percent))
    labels = relabel(labels, similar(near, sets, percent))
    blocks = in_blocks(cut_lineage(members.join(labels.hint("merge"), "id")))
    blocks = blocks.join(leaders.select("id", "sig"), "id").join(sets, "id")
    found = complete_blocks(blocks, percent)
    by_id = labels.select(F.col("id").alias("l"), F.col("comp").alias("p"))
    return relabel(labels, _relabelled(_relabelled(found, "u", by_id), "v", by_id))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Texts are lower-cased (A-Z).  Fewer than ``shingle`` words make one shingle; null and blank
    texts have none and link with nothing.  Rows that share a ``doc_id`` are one document:
    what either links to, both do.  Rows with a null ``doc_id`` are kept and link with
    nothing (component null).  Extra columns are ignored; texts are read whole.
    """
    rows = stored(profile(docs, percent, shingle), "minhash")
    can = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = cut_lineage(rows.where(can).groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    leaders = rows.where(can).join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "k1", "k2"], "left_semi")
    leaders = leaders.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig").distinct()
    # one document with several texts: its classes share the id, and so one node
    labels = link_leaders(docs, leaders, percent, shingle)
    many = cut_lineage(rows.where(can).groupBy("doc_id").agg(
        F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d"))
        .where("a <> b or c <> d").select("doc_id"))
    if not many.isEmpty():
        odd = rows.where(can).select("doc_id", "k1", "k2").join(many, "doc_id", "left_semi") \
            .join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("id").alias("v"))       # such a document also joins the classes of its texts
        tied = labels.select(F.col("id").alias("u"), F.col("comp").alias("v")).union(odd)
        labels = components(tied)
    classes = cut_lineage(classes.join(labels, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("comp")))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(),
                  F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent, shingle).where(~F.col("kept")) \
        .select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(small_side(cut_lineage(gone), MOST_BROADCAST),
                     F.col("`doc_id`").cast("long") == F.col("_gone"), "left_anti")
