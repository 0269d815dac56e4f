"""Quality rules: a threshold table compiled into one Spark projection.

Each rule names a measure of the text and the range it must keep.  The measures are
plain SQL expressions over the words and lines of the whole text (no user functions),
so a rule set is one ``select`` that Spark runs inside the scan stage: no shuffle, no
state, any number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, lower_az, pick, words

SYMBOLS = "#*$%&|<>"
# Fixed value: stop words of LISTED languages; texts in others have no stop-word measure and pass that rule.
LISTED = ("en", "de", "fr", "es")
STOP_WORDS = ("the of and to in is that it was for on are as with be by this at from or an "
              "der die das und ist von mit den dem ein eine nicht auf als auch sich zu im "
              "le la les et est de des un une que qui dans pour pas sur en au "
              "el los las y es del por con para una no se su al lo").split()
# (rule, measure, least, most); None leaves that side open.
RULES = [
    ("too_short", "n_words", 20, None),
    ("repeated_windows", "repeat_ratio", None, 0.30),
    ("mean_word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.10),
    ("duplicate_lines", "dup_line_ratio", None, 0.50),
    ("shouting", "upper_ratio", None, 0.60),
    ("bars", "bar_ratio", None, 0.20),
    ("stop_words", "stop_ratio", 0.02, None),
]


def add_window_repeats(d: DataFrame, hashes: str, out: str, n: int = 8) -> DataFrame:
    """Column ``out``: words covered by n-word windows that the text holds twice or more.

    ``hashes`` names an array of word hashes; windows are compared by a 64-bit hash of
    theirs.  Most texts repeat none, which one ``array_distinct`` shows; only the others
    sort their windows, keep those with an equal neighbour and add up the covered words.
    Each step is a column of its own so that no lambda evaluates an earlier one again.
    """
    h, size = F.col(hashes), F.size(hashes)
    d = d.withColumn("_win", F.when(size >= n, F.transform(
        F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))))
    d = d.withColumn("_win", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.array_sort(
        F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    win = F.col("_win")
    d = d.withColumn("_hit", F.array_sort(F.transform(F.filter(
        F.transform(win, lambda x, i: F.when(F.get(win, i - 1)["h"].eqNullSafe(x["h"])
                                             | F.get(win, i + 1)["h"].eqNullSafe(x["h"]), x["i"])),
        lambda x: x.isNotNull()), lambda x: x)))
    hit = F.col("_hit")
    covered = F.aggregate(F.transform(hit, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(hit, i + 1) - x, F.lit(n)))),
                          F.lit(0), lambda a, b: a + b)
    return d.withColumn(out, F.coalesce(covered, F.lit(0))).drop("_win", "_hit")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and every measure, one row per input row; a null text measures like an empty one."""
    return _measured(pick(docs, doc_id="long", text="string"), ["doc_id"])


def _measured(d: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and every measure of the ``text`` column.

    With ``lang`` among them, ``stop_ratio`` is null for rows without a language or of one that has no list.
    """
    listed = F.lower(F.split(F.btrim("lang"), "[-_]")[0]).isin(*LISTED) if "lang" in carry else F.lit(True)
    d = d.select(*carry, F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    chars = F.length(F.translate("t", SPACES, ""))
    count = F.size("w")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumn("ln", lines).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # The measures pass through a generator of one row: a filter on them would otherwise be pushed below
    # with a copy of their whole expression tree for every use of a column.  The random field (never
    # looked at) keeps the optimizer from deriving such a filter of its own.
    raw = F.struct(
        count.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        F.size("ln").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "|", ""))).alias("n_bars"),
        F.size(F.array_intersect(F.transform(F.array_distinct("w"), lambda x: lower_az(F.rtrim(x, F.lit(".,")))),
                                 F.array(*[F.lit(x) for x in STOP_WORDS]))).alias("n_stops"), F.rand(0).alias("r"))
    d = add_window_repeats(d, "h", "repeated").select(*carry, F.explode(F.array(raw)).alias("m")).select(*carry, "m.*")
    n = F.col("n_words")
    return d.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio(F.col("n_repeat_words"), n).alias("repeat_ratio"),
        ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_ratio"),
        ratio(F.col("n_bars"), n).alias("bar_ratio"),
        F.when(listed, ratio(F.col("n_stops"), F.least(n, F.lit(100)))).alias("stop_ratio"))


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """The rule table as two expressions over the measures: the names of broken rules, and the verdict."""
    broken = []
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < F.lit(least))
        if most is not None:
            bad = bad | (F.col(measure) > F.lit(most))
        broken.append(F.when(bad, F.lit(name)))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return failed, F.size(failed) == 0


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``failed_rules`` (comma-joined), one row per input row.

    Null and empty texts have no words and fail the length rule.  Long texts are read
    whole.  Repeated rows each get their verdict; extra columns are ignored.  The stop-word
    rule holds for the LISTED languages by ``lang``, and for all rows if there is no such column.
    """
    lang = {"lang": "string"} if "lang" in docs.columns else {}
    return judged(pick(docs, doc_id="long", text="string", **lang), rules).drop("lang")


def judged(d: DataFrame, rules=RULES) -> DataFrame:
    """All columns of ``d`` but ``text``, with the measures and verdicts of ``text`` beside them."""
    failed, kept = compile_rules(rules)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (_measured(d, [c for c in d.columns if c != "text"]).withColumn("base_failed", base)
            .withColumn("_ok", kept).withColumn("failed_rules", F.array_join(failed, ","))
            .withColumn("kept", F.col("_ok") & ~F.col("base_failed")).drop("_ok"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` without the rows that ``apply_rules`` rejects; all columns and repeated rows stay.

    The verdict is computed beside the row it belongs to, so nothing is joined back.
    """
    names = docs.columns
    lang = [F.col("`lang`").cast("string").alias("lang")] if "lang" in names else []
    carried = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"),
                          *lang, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    seen = judged(carried, rules)
    return seen.where("kept").select(*[F.col("_row")[c].alias(c) for c in names])
