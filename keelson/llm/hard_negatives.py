"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut in two halves; each half has a codebook of centroids, and a pair of codes is
a cell.  For an anchor, a half can score at most its product with the centroid plus its
length times the code's radius; the sum of both halves' bounds holds for every row of the
cell.  A heap walks the cells from the highest bound down (both halves' codes sorted by
bound, neighbours pushed as cells are taken) and stops as soon as the next bound lies below
everything that could still enter the answer, so the answers are exact.

Spark deals the work: cells are packed into index shards of bounded size (a cell that is too
large is cut), anchors are sent to those shards whose best cell could still matter, and a
shard that very many anchors need is copied to several tasks.  Anchors first ask the shard
they lie in; the scores found there rule out most of what the others could add.  Centroids
come from a bounded sample, every row is indexed, and radii cover all rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import stored

CODES = 16                  # centroids of each half
SAMPLE, ROUNDS = 4096, 8    # rows the centroids are fitted on at most, and passes over them
SHARD_CELLS = 1 << 20       # numbers in the vectors of an index shard (16,384 rows of 64)
TASK_ANCHORS = 32_768       # anchors that one copy of a shard serves
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # percent of the positive's score that a negative's score may have
LABEL_OFF, LABELS, ANCHOR_OFF, SCALE = 7, 10, 50, 256
EXACT = 2.0 ** 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def vectors(table: DataFrame) -> DataFrame:
    """(uid, vec_id, label, vec): usable rows with whole-number components; ``uid`` names the row."""
    x = F.col("vec")
    rows = table.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"),
                        F.col("`embedding`").cast("array<double>").alias("vec"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.abs(v * SCALE) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where(sound)
    whole = F.transform(x, lambda v: F.when(F.abs(v * SCALE) >= EXACT, v * SCALE).otherwise(F.floor(v * SCALE).cast("double")))
    moved = F.when(F.col("vec_id") % LABEL_OFF == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", moved.alias("label"), whole.alias("vec")),
                  "vectors")


def matrix(column, dims: int) -> np.ndarray:
    """A list column as (rows, dims) doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes, off = np.diff(off), off - off[0]
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(off[:-1], sizes)] = flat
    return out


def distances(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows, codes); values too large for a double count as infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (half ** 2).sum(1)[:, None] - 2 * half @ centroids.T + (centroids ** 2).sum(1)
    return np.nan_to_num(np.maximum(d, 0), nan=np.inf)


def codebook(half: np.ndarray, codes: int = CODES) -> np.ndarray:
    """Centroids of the sampled halves by Lloyd's rounds, from rows spread over the sample."""
    centroids = half[np.unique(np.linspace(0, len(half) - 1, codes).astype(int))].copy()
    for _ in range(ROUNDS):
        near = distances(half, centroids).argmin(1)
        for c in range(len(centroids)):
            mine = half[near == c]
            if len(mine):
                centroids[c] = np.clip(mine, -1e150, 1e150).mean(0)
    return centroids


class Index:
    """What tasks know about the index: codebooks, radii, and the shards' cells (K*K cells and one entry per shard)."""

    def __init__(self, dims: int, books: list[np.ndarray]):
        self.dims, self.cut, self.books = dims, dims // 2, books
        self.radii = [np.zeros(len(b)) for b in books]
        self.shards = self.first = self.codes = np.zeros(0, np.int64)

    def halves(self, vec: np.ndarray) -> list[np.ndarray]:
        return [vec[:, :self.cut], vec[:, self.cut:]]

    def bounds(self, vec: np.ndarray) -> list[np.ndarray]:
        """For each half, the most a row with each code can score; a little is added for rounding."""
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for half, book, radius in zip(self.halves(vec), self.books, self.radii):
                length = np.sqrt((half ** 2).sum(1))[:, None]
                top = half @ book.T + length * radius
                slack = 1e-9 * length * (np.sqrt((book ** 2).sum(1)) + radius) + 1e-3
                out.append(np.nan_to_num(top + slack, nan=np.inf, posinf=np.inf))
        return out

    def shard_bounds(self, vec: np.ndarray) -> np.ndarray:
        """(rows, shards): the most any row of each shard can score."""
        one, two = self.bounds(vec)
        return np.maximum.reduceat(one[:, self.codes[:, 0]] + two[:, self.codes[:, 1]], self.first, axis=1)


def build(rows: DataFrame) -> tuple[DataFrame, Index]:
    """The rows with their cell and shard (uid, vec_id, label, vec, c1, c2, shard), and the index's small parts."""
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).select("vec").toArrow().column("vec")
    sample = matrix(sample, dims) if len(sample) else np.zeros((1, dims))
    index = Index(dims, [codebook(sample[:, :dims // 2]), codebook(sample[:, dims // 2:])])

    def assign(batches):
        for b in batches:
            vec = matrix(b.column("vec"), dims)
            codes, far = [], []
            for half, book in zip(index.halves(vec), index.books):
                d = distances(half, book)
                c = d.argmin(1)
                codes.append(c.astype(np.int32))
                with np.errstate(over="ignore", invalid="ignore"):
                    far.append(np.nan_to_num(np.sqrt(((half - book[c]) ** 2).sum(1)), nan=np.inf, posinf=np.inf))
            yield pa.record_batch(list(b.columns) + [pa.array(x) for x in codes + far],
                                  names=["uid", "vec_id", "label", "vec", "c1", "c2", "d1", "d2"])

    coded = stored(rows.mapInArrow(assign, "uid long, vec_id long, label long, vec array<double>, c1 int, c2 int, d1 double, d2 double"),
                   "coded-vectors")
    per_shard = max(SHARD_CELLS // max(dims, 1), 64)
    cells = sorted(coded.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"))
                   .collect())                                  # at most CODES * CODES rows
    starts, parts, codes, shards, total = [], [], [], [], 0
    for c1, c2, n, d1, d2 in cells:
        index.radii[0][c1], index.radii[1][c2] = max(index.radii[0][c1], d1), max(index.radii[1][c2], d2)
        k = math.ceil(n / per_shard)
        total += -total % per_shard if k > 1 else 0             # a large cell starts on a shard of its own
        starts.append(total // per_shard)
        parts.append(k)
        codes += [(c1, c2)] * k
        shards += [total // per_shard + i for i in range(k)]
        total += n if k == 1 else k * per_shard
    index.codes = np.array(codes, np.int64).reshape(-1, 2)
    index.shards, index.first = np.unique(np.array(shards, np.int64), return_index=True)
    where = coded.sparkSession.createDataFrame(
        [(int(c[0]), int(c[1]), int(s), int(k)) for c, s, k in zip(cells, starts, parts)], "c1 int, c2 int, start int, parts int")
    placed = coded.join(F.broadcast(where), ["c1", "c2"])
    shard = F.col("start") + F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    return stored(placed.select("uid", "vec_id", "label", "vec", "c1", "c2", shard.alias("shard")), "index"), index


def products(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as integers; beyond a double's whole numbers by Python's, held to 64 bits."""
    if exact:
        return (rows @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    return np.array([min(max(sum(x * int(y) for x, y in zip(a, r) if x), LEAST), MOST) for r in rows], np.int64)


class Shard:
    """The rows of an index shard, cell by cell."""

    def __init__(self, index: Index, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        get = lambda c: t.column(c).to_numpy()
        self.index, self.uid, self.id, self.label = index, get("uid"), get("vec_id"), get("label")
        self.vec = matrix(t.column("vec"), index.dims)
        self.size = float(np.abs(self.vec).max(initial=0))
        cell = get("c1").astype(np.int64) * len(index.books[1]) + get("c2")
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        ends = np.append(first[1:], len(cell))
        self.cells = {divmod(int(cell[a]), len(index.books[1])): (int(a), int(e)) for a, e in zip(first, ends)}
        self.codes = [np.array(sorted({c[i] for c in self.cells})) for i in (0, 1)]

    def walk(self, one: np.ndarray, two: np.ndarray):
        """(bound, first row, end) of the cells in falling order of their bounds."""
        one, two = one[self.codes[0]], two[self.codes[1]]
        by = [np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")]
        one, two = one[by[0]], two[by[1]]
        codes = [self.codes[0][by[0]].tolist(), self.codes[1][by[1]].tolist()]
        heap, taken = [(-(one[0] + two[0]), 0, 0)], set()
        while heap:
            less, i, j = heapq.heappop(heap)
            at = self.cells.get((codes[0][i], codes[1][j]))
            if at:
                yield -less, *at
            taken.add((i, j))
            for x, y in ((i + 1, j), (i, j + 1)):               # a cell follows once both cells before it are taken
                if x < len(one) and y < len(two) and (x == 0 or (x - 1, y) in taken) and (y == 0 or (x, y - 1) in taken):
                    heapq.heappush(heap, (-(one[x] + two[y]), x, y))

    def exact(self, anchor: np.ndarray) -> bool:
        return self.size * float(np.abs(anchor).max(initial=0)) * max(self.index.dims, 1) < EXACT

    def positives(self, uid: int, label: int, anchor: np.ndarray, bounds) -> list[tuple[int, int, int]]:
        """The best rows of the anchor's label: (-score, id, uid), best first."""
        best, exact = [], self.exact(anchor)
        for bound, a, e in self.walk(*bounds):
            least = -best[-1][0] if len(best) == POSITIVES else LEAST
            if bound < least:
                break
            mine = a + np.flatnonzero((self.label[a:e] == label) & (self.uid[a:e] != uid))
            scores = products(self.vec[mine], anchor, exact)
            best = self.better(best, POSITIVES, mine, scores, least, MOST)
        return best

    def better(self, best, most, rows, scores, low, high):
        """``best`` after the rows whose score lies between ``low`` and ``high`` came in."""
        near = np.flatnonzero((scores >= low) & (scores <= high))
        if not len(near):
            return best
        near = near[np.lexsort((self.uid[rows[near]], self.id[rows[near]], -scores[near]))[:most]]
        new = [(-int(scores[k]), int(self.id[rows[k]]), int(self.uid[rows[k]])) for k in near]
        return sorted(best + new)[:most]

    def negatives(self, label: int, anchor: np.ndarray, bounds, wanted: list[int]) -> list[list[tuple[int, int, int]]]:
        """For each positive's score, the best rows of other labels inside its window."""
        windows = [window(s) for s in wanted]
        found, exact = [[] for _ in wanted], self.exact(anchor)
        for bound, a, e in self.walk(*bounds):
            lows = [-f[-1][0] if len(f) == NEGATIVES else low for f, (low, _) in zip(found, windows)]
            open_ = [k for k, (_, high) in enumerate(windows) if lows[k] <= min(bound, high)]
            if not open_:
                break
            others = a + np.flatnonzero(self.label[a:e] != label)
            scores = products(self.vec[others], anchor, exact)
            for k in open_:
                found[k] = self.better(found[k], NEGATIVES, others, scores, lows[k], windows[k][1])
        return found


def window(score: int) -> tuple[int, int]:
    """Lowest and highest whole score with LOW * score <= 100 * x <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


RESULT = "anchor_uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, uid long, vec_id long, score long"
WANTS = "array<struct<positive_uid:bigint,positive_id:bigint,positive_score:bigint>>"


def routed(anchors: DataFrame, index: Index, home: bool) -> DataFrame:
    """Anchors (uid, vec_id, label, vec, shard, least, wants), once per shard (to) that may hold a row scoring ``least``.

    ``home`` sends each to its own shard only, otherwise to all such shards but that.  ``least`` null: any score.
    """
    names = ["uid", "vec_id", "label", "vec", "wants"]
    if home:
        return anchors.select(*names, F.col("shard").cast("int").alias("to"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                least = some.column("least").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                own = some.column("shard").to_numpy()
                tops = index.shard_bounds(matrix(some.column("vec"), index.dims))
                row, to = np.nonzero((tops >= least[:, None]) & (index.shards[None, :] != own[:, None]))
                for k in range(0, len(row), 4096):
                    out = some.select(names).take(pa.array(row[k:k + 4096]))
                    yield pa.RecordBatch.from_arrays(list(out.columns) + [pa.array(index.shards[to[k:k + 4096]].astype(np.int32))],
                                                     names=names + ["to"])

    return anchors.select("uid", "vec_id", "label", "vec", "wants", "least", "shard").mapInArrow(
        run, f"uid long, vec_id long, label long, vec array<double>, wants {WANTS}, to int")


def ask(rows: DataFrame, index: Index, anchors: DataFrame) -> DataFrame:
    """RESULT rows: what each shard answers to the anchors sent to it.

    An anchor without ``wants`` asks for positives (positive columns null), one with them
    for the negatives of each.  Rows come first in a task, then the anchors, batch by batch.
    """
    anchors = stored(anchors, "asked")
    copies = anchors.groupBy("to").agg(F.expr(f"(count(1) - 1) div {TASK_ANCHORS} + 1").cast("int").alias("copies"))
    base = rows.join(copies, rows["shard"] == copies["to"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    base = base.select("to", "copy", F.lit(0).alias("kind"), "uid", "vec_id", "label", "c1", "c2", "vec",
                       F.lit(None).cast(WANTS).alias("wants"))
    some = anchors.join(copies, "to").select(
        "to", F.pmod(F.xxhash64("uid"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "uid", "vec_id",
        "label", F.lit(0).alias("c1"), F.lit(0).alias("c2"), "vec", "wants")
    laid = base.union(some).repartition("to", "copy").sortWithinPartitions("to", "copy", "kind", "c1", "c2", "uid")

    def run(batches):
        key, parts, shard = None, [], None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("to", "copy", "kind")]
            change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            for a, e in zip(edges[:-1], edges[1:]):
                if a == e:
                    continue
                now = (cols[0][a], cols[1][a])
                if now != key:
                    key, parts, shard = now, [], None
                if cols[2][a] == 0:
                    parts.append(b.slice(a, e - a).select(["uid", "vec_id", "label", "c1", "c2", "vec"]))
                    continue
                if shard is None:
                    shard, parts = Shard(index, parts), []
                yield answers(shard, b.slice(a, e - a))

    return laid.mapInArrow(run, RESULT)


def answers(shard: Shard, some: pa.RecordBatch) -> pa.RecordBatch:
    """RESULT rows of one shard for a batch of anchors."""
    vec, out = matrix(some.column("vec"), shard.index.dims), []
    one, two = shard.index.bounds(vec)
    uid, ids, label = (some.column(c).to_pylist() for c in ("uid", "vec_id", "label"))
    for k, wants in enumerate(some.column("wants").to_pylist()):
        bounds = one[k], two[k]
        if not wants:
            out += [(uid[k], ids[k], None, None, None, u, i, -s) for s, i, u in shard.positives(uid[k], label[k], vec[k], bounds)]
            continue
        found = shard.negatives(label[k], vec[k], bounds, [w["positive_score"] for w in wants])
        out += [(uid[k], ids[k], w["positive_uid"], w["positive_id"], w["positive_score"], u, i, -s)
                for w, f in zip(wants, found) for s, i, u in f]
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names)


def first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` best answers of each group with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(table: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or with a null or non-finite component (or one that
    is not finite when scaled), take no part.  Shorter vectors count as ending in zeros.  Rows
    that repeat each count: an anchor's copy is another row and can be its positive.  Scores
    beyond 64 bits are held at their limits.  A positive with a negative score has no window.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows, index = build(vectors(table))
    anchors = rows.where(F.col("vec_id") % ANCHOR_OFF == 0).withColumns(
        {"wants": F.lit(None).cast(WANTS), "least": F.lit(None).cast("long")})
    near = stored(ask(rows, index, routed(anchors, index, home=True)), "near-positives")
    known = near.groupBy("anchor_uid").agg(F.when(F.count(F.lit(1)) >= POSITIVES, F.min("score")).alias("least"))
    asking = anchors.drop("least").join(known, anchors["uid"] == known["anchor_uid"], "left").drop("anchor_uid")
    far = ask(rows, index, routed(asking, index, home=False))
    best = stored(first(near.union(far), ["anchor_uid"], POSITIVES), "positives")
    wants = best.where("score >= 0").groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("uid").alias("positive_uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("wants"))
    asking = anchors.drop("wants", "least").join(wants, anchors["uid"] == wants["anchor_uid"]).drop("anchor_uid")
    near = stored(ask(rows, index, routed(asking, index, home=True)), "near-negatives")
    # a score that some positive still needs: its third best at home, or the low end of its window
    pair = ["anchor_uid", "positive_uid"]
    third = near.groupBy(*pair).agg(F.when(F.count(F.lit(1)) >= NEGATIVES, F.min("score")).alias("third"))
    need = asking.select(F.col("uid").alias("anchor_uid"), F.explode("wants").alias("w")).select(
        "anchor_uid", F.col("w.positive_uid").alias("positive_uid"), F.expr(f"w.positive_score div 100 * {LOW}").alias("low"))
    need = need.join(third, pair, "left").groupBy("anchor_uid").agg(F.min(F.coalesce("third", "low")).alias("least"))
    asking = asking.join(need, asking["uid"] == need["anchor_uid"]).drop("anchor_uid")
    far = ask(rows, index, routed(asking, index, home=False))
    best = first(near.union(far), pair, NEGATIVES)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
