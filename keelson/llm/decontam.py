"""Benchmark decontamination over a distributed positional inverted index.

1. Count in the corpus the terms that occur in the test items.
2. Of every window of a test item, take the two rarest terms as its seeds.
3. Store the postings (term, document, position) of all seed terms: the index.
4. Shift each posting back by the seed's place in its item.  Postings of one item that
   land on the same shifted position (a *diagonal* of document and item) agree; a
   window that occurs has both its seeds on one diagonal, so diagonals with one seed
   are dropped (unless the item has a one-word window).
5. Compare the item's remaining words along the surviving diagonals: exact matches.
   Proximity matches are items with several seeds on nearby diagonals.

Only DataFrame functions are used.  Postings shuffle by (document, item, diagonal), so
no term, however frequent, is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

from .text import lower_az, pick, small_side, stored, words

WINDOW = 10
SEEDS = 2
MOST_BROADCAST = 200_000        # rows of terms, seeds or document keys that may be broadcast
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"        # the same before lower-casing
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def raw_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, as written."""
    return words(text, RAW_SPLIT, SEPARATORS)


def phrase_words(text: Column) -> Column:
    """The same, lower-cased (A-Z)."""
    return words(lower_az(text), SPLIT, SEPARATORS)


def term_of(word: Column) -> Column:
    """A word lower-cased (A-Z); ``lower`` does that in one pass over the bytes of an ASCII word."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_az(word))


def corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text) of the rows with a text: ``fp`` tells rows with one id and different texts apart."""
    d = pick(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    return d.select("doc_id", F.xxhash64("text").alias("fp"), "text")


def test_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, iw) of the items that have words; ``item`` numbers distinct rows by hash."""
    b = pick(benchmark, item_id="string", text="string").where(F.col("text").isNotNull()).distinct()
    b = b.select(F.xxhash64(F.coalesce("item_id", F.lit("")), "text").alias("item"),
                 F.coalesce("item_id", F.lit("")).alias("item_id"), phrase_words(F.col("text")).alias("iw"))
    return b.where(F.size("iw") > 0)


def seeds_of(items: DataFrame, docs: DataFrame, window: int = WINDOW, seeds: int = SEEDS) -> DataFrame:
    """(term, item, off, need): the rarest terms of each window that can occur, and how many seeds must agree."""
    places = items.select("item", F.size("iw").alias("n"), F.posexplode("iw").alias("off", "term"))
    terms = small_side(places.select("term").distinct(), MOST_BROADCAST)
    every = docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(term_of(F.col("word")).alias("term"))
    seen = every.join(terms, "term").groupBy("term").agg(F.count("*").alias("tf"))
    places = places.join(cut_lineage(seen), "term")            # a term the corpus lacks rules its windows out
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - window + 1),
                        F.greatest(F.lit(0), F.least(F.col("off"), F.col("n") - window)))
    each = places.withColumn("start", F.explode(starts))
    win = Window.partitionBy("item", "start")
    each = each.withColumn("have", F.count("*").over(win)) \
        .withColumn("rank", F.row_number().over(win.orderBy("tf", "term", "off"))) \
        .where((F.col("have") == F.least(F.col("n"), F.lit(window))) & (F.col("rank") <= seeds))
    need = each.groupBy("item").agg(F.min(F.least(F.col("have"), F.lit(seeds))).alias("need"))
    return cut_lineage(each.select("term", "item", "off").distinct().join(need, "item"))


def build_index(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(term, doc_id, fp, pos): stored postings of the seed terms."""
    terms = small_side(seeds.select("term").distinct(), MOST_BROADCAST)
    every = docs.select("doc_id", "fp", F.posexplode(raw_words(F.col("text"))).alias("pos", "word")) \
        .select(term_of(F.col("word")).alias("term"), "doc_id", "fp", "pos")
    return stored(every.join(terms, "term"), "postings")


def diagonals(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, fp, item, diag) on which enough seeds of an item agree."""
    hits = index.join(small_side(seeds, MOST_BROADCAST), "term").select(
        "doc_id", "fp", "item", (F.col("pos") - F.col("off")).alias("diag"), "off", "need")
    agree = hits.groupBy("doc_id", "fp", "item", "diag").agg(
        F.min("off").alias("lo"), F.max("off").alias("hi"), F.max("need").alias("need"))
    return agree.where((F.col("need") == 1) | (F.col("hi") > F.col("lo"))).select("doc_id", "fp", "item", "diag")


def exact_matches(docs: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, fp, hits): per document the matches ``(item_id, at)``, ``at`` the places of matched windows."""
    cands = found.join(items, "item").groupBy("doc_id", "fp").agg(
        F.collect_list(F.struct("item_id", "diag", "iw")).alias("cands"))
    cands = cut_lineage(cands).select(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp"), "cands")
    keys = small_side(cands.select("c_id", "c_fp"), MOST_BROADCAST)
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("fp") == F.col("c_fp"))
    # words below the join: a projection right under the lambdas would be split again for every comparison
    d = docs.join(keys, same, "left_semi").select("doc_id", "fp", phrase_words(F.col("text")).alias("w"))
    d = d.distinct().join(cands, same)
    w = F.col("w")

    def windows(c):
        n = F.size(c["iw"])
        return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - window)), lambda s: F.forall(
            F.sequence(F.lit(0), F.least(F.lit(window), n) - 1),
            lambda j: F.when(c["diag"] + s + j >= 0, F.get(w, c["diag"] + s + j)).eqNullSafe(F.get(c["iw"], s + j))))

    hits = F.transform("cands", lambda c: F.struct(
        c["item_id"].alias("item_id"), F.least(F.lit(window), F.size(c["iw"])).alias("len"),
        F.transform(windows(c), lambda s: c["diag"] + s).alias("at")))
    return d.select("doc_id", "fp", F.filter(hits, lambda h: F.size(h["at"]) > 0).alias("hits")) \
        .where(F.size("hits") > 0)


def proximity_matches(index: DataFrame, seeds: DataFrame, slop: int = 8, share: float = 0.5) -> DataFrame:
    """(doc_id, fp, item, n_seeds): items of which at least ``share`` of the seeds (and two) lie within a
    band of ``2 * slop`` diagonals of a document, in whatever order."""
    total = seeds.groupBy("item").agg(F.count("*").alias("n_all"))
    near = index.join(small_side(seeds, MOST_BROADCAST), "term").select(
        "doc_id", "fp", "item", "off", F.explode(F.array(
            F.floor((F.col("pos") - F.col("off")) / (2 * slop)) * 2,
            F.floor((F.col("pos") - F.col("off") + slop) / (2 * slop)) * 2 + 1)).alias("band"))
    near = near.distinct().groupBy("doc_id", "fp", "item", "band").agg(F.count("*").alias("n"))
    near = near.groupBy("doc_id", "fp", "item").agg(F.max("n").alias("n_seeds"))
    return near.join(total, "item").where((F.col("n_seeds") >= 2) & (F.col("n_seeds") >= F.col("n_all") * share)) \
        .drop("n_all")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of the items' windows in each document, one row per input row.

    Columns doc_id, n_words, n_hit (words inside a match), n_items, items (sorted ids),
    contaminated.  An item of fewer than ``window`` words is one window; items and
    documents that are null or without words match nothing.  Items with a null id are
    listed as an empty string.  Rows that repeat a document each get its result; an
    item that repeats counts once.  Extra columns are ignored; texts are read whole.
    """
    words_of, items = corpus(docs), cut_lineage(test_items(benchmark))
    seeds = seeds_of(items, words_of, window)
    hits = exact_matches(words_of, items, diagonals(build_index(words_of, seeds), seeds), window)
    places = F.flatten(F.transform("hits", lambda h: F.flatten(
        F.transform(h["at"], lambda s: F.sequence(s, s + h["len"] - 1)))))
    hits = cut_lineage(hits.select(
        F.col("doc_id").alias("h_id"), F.col("fp").alias("h_fp"), F.size(F.array_distinct(places)).alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("items")))
    d = pick(docs, doc_id="long", text="string").select(
        "doc_id", F.xxhash64("text").alias("fp"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(raw_words(F.col("text")))).cast("long").alias("n_words"))
    d = d.join(small_side(hits, MOST_BROADCAST), F.col("doc_id").eqNullSafe(F.col("h_id"))
               & (F.col("fp") == F.col("h_fp")) & (F.col("n_words") > 0), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                    items_.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows; all columns and repeated rows stay."""
    bad = decontaminate(docs.select("doc_id", "text"), benchmark, window).where("contaminated") \
        .select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(small_side(cut_lineage(bad), MOST_BROADCAST),
                     F.col("`doc_id`").cast("long").eqNullSafe(F.col("_bad_id")), "left_anti")
