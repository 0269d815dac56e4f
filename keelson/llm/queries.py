"""The registered queries of this folder and their DuckDB SQL.

Each ``opN_*`` query applies its operator, with production parameters, to the whole
table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_sql(text: str, pattern: str = r"[^\x20\x09-\x0D]+") -> str:
    """The words of a text column as a DuckDB list; null has none."""
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({words_sql('text')}) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0 * source_size / w AS fill, 1.5 * sum(source_size) OVER () AS budget FROM s),
levels AS (
  SELECT *, row_number() OVER o AS rank,
         (budget - coalesce(sum(2.0 * source_size) OVER (ORDER BY fill, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST)),
cut AS (SELECT arg_min(level, rank) FILTER (WHERE level <= fill) AS level FROM levels),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN c.level IS NULL OR l.fill <= c.level THEN 2.0 * l.source_size ELSE l.w * c.level END AS target
  FROM levels l, cut c),
q AS (
  SELECT d.doc_id, d.size, d.key, d.source, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
stands AS (
  SELECT doc_id, size, key, CAST(cum + source_size * r AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) v(r) WHERE size > 0 AND target > 0),
kept AS (
  SELECT doc_id, size, count(*) AS copies FROM (
    SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM stands)
  WHERE total <= (SELECT floor(1.5 * sum(size)) FROM d) GROUP BY doc_id, size)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.copies, 0) * q.size AS taken, q.source,
       CAST(coalesce(k.copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN kept k ON k.doc_id = q.doc_id AND k.size = q.size
"""


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark, sf_dir):
    from .mixing import queue
    return queue(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    from .secret_scan import find_secrets
    return find_secrets(documents(spark, sf_dir))


# DuckDB twin of the rule table; thresholds and words are written out by hand.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words_sql('text')} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
hit AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^|]', '', 'g')) AS n_bars,
         len(list_intersect(list_distinct(list_transform(w, lambda x: translate(
             regexp_replace(x, '[.,]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))),
             string_split('the of and to in is that it was for on are as with be by this at from or an der die das und ist von mit den dem ein eine nicht auf als auch sich zu im le la les et est de des un une que qui dans pour pas sur en au el los las y es del por con para una no se su al lo', ' '))) AS n_stops
  FROM d LEFT JOIN hit USING (doc_id)),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         n_repeat_words, n_upper, n_bars, n_stops, len(ln) AS n_lines FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR (n_words > 0 AND (n_repeat_words / n_words > 0.30 OR word_chars / n_words < 2.0
                OR word_chars / n_words > 14.0 OR n_bars / n_words > 0.20))
            OR (word_chars > 0 AND (n_symbols / word_chars > 0.10 OR n_upper / word_chars > 0.60))
            OR (n_lines > 0 AND n_dup_lines / n_lines > 0.50)
            OR n_stops / least(n_words, 100) < 0.02) AS kept
FROM r
"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark, sf_dir):
    from .quality_rules import apply_rules
    return apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql(LOWER.format('text'), OP7_WORDS)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words_sql(LOWER.format('text'), OP7_WORDS)} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, CAST(least(len(w), 10) AS INTEGER) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
m AS (SELECT dw.doc_id, dw.i, bw.n, bw.item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, coalesce(it.items_sha256, sha256('')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


@query("op7_decontamination", OP7_SQL)
def op7_decontamination(spark, sf_dir):
    from pyspark.sql import functions as F

    from .decontam import decontaminate
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_token_rollup")
def op5_token_rollup(spark, sf_dir):
    """Totals after four batches over all documents: load, counts revised to include the end token (both folded
    into the totals table), removal of the documents without tokens, and the load again (already committed)."""
    import uuid

    from pyspark.sql import functions as F

    from keelson.session import scratch_path

    from . import token_rollup as R
    from .text import stored
    counts = stored(R.count_tokens(documents(spark, sf_dir)), "token-counts")
    path = scratch_path(spark, f"token-totals-{uuid.uuid4().hex}")
    revised = counts.withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", F.col("n_tokens") + 1)
    R.commit(R.inserts(counts), path, "load")
    R.commit(R.revisions(revised), path, "end-token")
    R.fold(spark, path)
    R.commit(R.deletes(revised.where(F.col("old_tokens") == 0)), path, "blank")
    R.commit(R.inserts(counts), path, "load")
    return R.totals(spark, path)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    from .toxicity import toxicity
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_token_output")
def op10_token_output(spark, sf_dir):
    from .token_output import token_output
    return token_output(documents(spark, sf_dir))


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql(LOWER.format('text'))} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.v FROM reach JOIN link ON link.u = reach.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op8_near_dedup", OP8_SQL)
def op8_near_dedup(spark, sf_dir):
    from .near_dedup import near_duplicates
    return near_duplicates(documents(spark, sf_dir))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM twice))),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeats
    return remove_repeats(documents(spark, sf_dir))


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    from .lm_scoring import lm_scores
    return lm_scores(documents(spark, sf_dir))


# CRC-32 in SQL: its table, and the checksum of a text from the table (column t) byte by byte.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)))"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs crc_table's column t in scope."""
    return (f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda h: CAST('0x' || h AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)))")


OP11_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {words_sql(LOWER.format('text'), OP7_WORDS)} AS w FROM documents),
b AS (SELECT {words_sql(LOWER.format('text'), OP7_WORDS)} AS w FROM benchmark),
df AS (
  SELECT doc_id, f, count(*) AS n
  FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d)
  GROUP BY doc_id, f),
bf AS (
  SELECT f, count(*) AS n
  FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
f AS (SELECT f, {crc_sql('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN f USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN f USING (f) GROUP BY bucket),
every AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all),
g AS (
  SELECT s.bucket, floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
                                   / ((CAST(s.n AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket, every),
m AS (
  SELECT doc_id, CAST(sum(df.n) AS BIGINT) AS n_features, CAST(floor(sum(df.n * gain) / sum(df.n)) AS BIGINT) AS weight
  FROM df JOIN f USING (f) JOIN g USING (bucket) GROUP BY doc_id),
o AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(d.w) >= 20 AS stands,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                                                          + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY stands ORDER BY score DESC, doc_id) AS place, sum(CAST(stands AS INTEGER)) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN stands AND place <= 25 * n // 100 THEN place END AS rank FROM p
"""


@query("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark, sf_dir):
    from .importance import resample
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = f"""
WITH {CRC_TABLE},
r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, {crc_sql("coalesce(text, '')")} AS crc FROM documents, crc_table),
g AS (SELECT doc_id, size, crc, count(*) AS m FROM r GROUP BY doc_id, size, crc),
cut AS (SELECT *, unnest(range(0, (m - 1) // 64 + 1)) AS piece FROM g),
p AS (
  SELECT doc_id, size, crc, piece, least(64, m - piece * 64) AS n,
         CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), crc, size, piece)), 1, 8) AS BIGINT) % 4096 AS vslot
  FROM cut),
t AS (
  SELECT e.vslot, CAST(coalesce(sum(size * n), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
  FROM (SELECT unnest(range(4096)) AS vslot) e LEFT JOIN p USING (vslot) GROUP BY e.vslot),
one AS (
  SELECT *, vslot % 24 AS shard,
         sum(bytes) OVER (PARTITION BY vslot % 24 ORDER BY bytes DESC, vslot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 24
         <= sum(bytes) OVER () AS stays
  FROM t),
loads AS (
  SELECT list(l ORDER BY shard) AS loads
  FROM (SELECT shard, CAST(coalesce(sum(bytes) FILTER (WHERE stays), 0) AS BIGINT) AS l FROM one GROUP BY shard)),
freed AS (SELECT coalesce(list({{'v': [bytes, vslot], 'moves': CAST([] AS BIGINT[])}} ORDER BY bytes DESC, vslot), []) AS f FROM one WHERE NOT stays),
done AS (
  SELECT f, list_reduce(f, lambda a, x: {{
      'v': list_transform(a.v, lambda y, i: CASE WHEN i = list_position(a.v, list_min(a.v)) THEN y + x.v[1] ELSE y END),
      'moves': list_append(a.moves, CAST(list_position(a.v, list_min(a.v)) - 1 AS BIGINT))}},
      {{'v': loads, 'moves': CAST([] AS BIGINT[])}}) AS r
  FROM loads, freed),
two AS (
  SELECT vslot, shard FROM one WHERE stays
  UNION ALL SELECT f[i].v[2], r.moves[i] FROM (SELECT f, r, unnest(range(1, len(f) + 1)) AS i FROM done)),
ahead AS (
  SELECT vslot, two.shard, coalesce(sum(rows) OVER (PARTITION BY two.shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM two JOIN t USING (vslot)),
placed AS (
  SELECT p.*, shard, ahead + coalesce(sum(n) OVER (PARTITION BY vslot ORDER BY doc_id, crc, size, piece
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p JOIN ahead USING (vslot))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(start + k AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, CAST(vslot AS INTEGER) AS vslot, 2 AS version
FROM (SELECT *, unnest(range(0, n)) AS k FROM placed)
"""


@query("op12_sharding", OP12_SQL)
def op12_sharding(spark, sf_dir):
    import uuid

    from keelson.session import scratch_path

    from .sharding import shard
    return shard(documents(spark, sf_dir), scratch_path(spark, f"slot-map-{uuid.uuid4().hex}"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM s WHERE alike),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND p.place <= 5
       AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
