"""Document find/aggregation queries (F2, F3, D1-D12) over ``documents``, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import documents as D
from keelson.plans.registry import query

C = F.col
FIELDS = ["doc_id", "lang", "source", "n_chars"]


@query("paginate", """
SELECT doc_id, lang, source, n_chars, (SELECT COUNT(*) FROM documents) AS total_rows
FROM documents ORDER BY doc_id LIMIT 100 OFFSET 200
""")
def q_paginate(r):
    """F3 third page of 100 documents by primary key, with the total."""
    return D.paginate(r.table("documents").select(*FIELDS), ["doc_id"], limit=100, offset=200)


@query("doc_find", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en'
ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100
""")
def q_doc_find(r):
    """F2 English documents, longest first, top 100."""
    return D.doc_find(r.table("documents"), C("lang") == "en", ("n_chars", -1), 100, "doc_id", FIELDS)


@query("doc_match", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars > 1000
""")
def q_doc_match(r):
    """D1 $match on language and length."""
    return D.doc_match(r.table("documents"), C("lang").isin("en", "fr") & (C("n_chars") > 1000)).select(*FIELDS)


@query("doc_project", """
SELECT doc_id, upper(lang) AS lang_upper, len(string_split(text, chr(10))) AS n_lines,
       len(string_split(text, ' ')) AS n_words, contains(text, '@') AS has_at
FROM documents
""")
def q_doc_project(r):
    """D2 $project with computed fields over whole texts."""
    return D.doc_project(r.table("documents"), {
        "doc_id": "doc_id", "lang_upper": F.upper("lang"), "n_lines": F.size(F.split("text", "\n")).cast("long"),
        "n_words": F.size(F.split("text", " ")).cast("long"), "has_at": F.col("text").contains("@")})


@query("doc_group", """
SELECT source AS _id, COUNT(*) AS docs, CAST(SUM(n_chars) AS BIGINT) AS total_chars,
       CAST(SUM(n_chars) AS DOUBLE) / COUNT(n_chars) AS avg_chars, min(n_chars) AS min_chars,
       max(n_chars) AS max_chars, arg_min(lang, doc_id) AS first_lang,
       array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs
FROM documents GROUP BY source
""")
def q_doc_group(r):
    """D3 $group by source: count, sum, avg, min, max, first, addToSet."""
    return D.doc_group(r.table("documents"), "source", {
        "docs": F.count(F.lit(1)), "total_chars": F.sum("n_chars"), "avg_chars": D.exact_avg("n_chars"),
        "min_chars": F.min("n_chars"), "max_chars": F.max("n_chars"), "first_lang": F.min_by("lang", "doc_id"),
        "langs": F.array_join(F.sort_array(F.collect_set("lang")), ",")})


@query("doc_sort_by_count", "SELECT lang AS _id, COUNT(*) AS count FROM documents GROUP BY lang")
def q_doc_sort_by_count(r):
    """D9 $sortByCount on language."""
    return D.doc_sort_by_count(r.table("documents"), "lang")


@query("doc_bucket", """
SELECT CASE WHEN n_chars >= 0 AND n_chars < 500 THEN '0' WHEN n_chars >= 500 AND n_chars < 2000 THEN '500'
            WHEN n_chars >= 2000 AND n_chars < 10000 THEN '2000' WHEN n_chars >= 10000 AND n_chars < 50000 THEN '10000'
            ELSE 'Other' END AS _id,
       COUNT(*) AS count, CAST(SUM(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY 1
""")
def q_doc_bucket(r):
    """D10 $bucket on document length."""
    return D.doc_bucket(r.table("documents"), "n_chars", [0, 500, 2000, 10000, 50000], "Other",
                        {"count": F.count(F.lit(1)), "total_chars": F.sum("n_chars")})


@query("doc_unwind", """
SELECT doc_id, unnest(range(len(parts))) AS line_no, length(unnest(parts)) AS line_length
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d
""")
def q_doc_unwind(r):
    """D7 $unwind every line of every document, with its index."""
    d = r.table("documents").select("doc_id", F.split("text", "\n").alias("lines"))
    u = D.doc_unwind(d, C("lines"), "line", index_name="line_no")
    return u.select("doc_id", C("line_no").cast("long").alias("line_no"),
                    F.length("line").cast("long").alias("line_length"))


@query("doc_lookup", """
SELECT d.doc_id, d.lang, COALESCE(l.n, 0) AS n_labels, COALESCE(l.js, '[]') AS labels
FROM documents d LEFT JOIN (
  SELECT doc_id, COUNT(*) AS n,
         CAST(to_json(list(struct_pack(quality := quality, toxic := toxic) ORDER BY quality, toxic)) AS VARCHAR) AS js
  FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
""")
def q_doc_lookup(r):
    """D8 $lookup of quality labels per document (no match -> [])."""
    j = D.doc_lookup(r.table("documents").select("doc_id", "lang"), r.table("labels"), "doc_id", "doc_id", "labels",
                     ["quality", "toxic"])
    return j.select("doc_id", "lang", F.size("labels").cast("long").alias("n_labels"),
                    F.to_json("labels").alias("labels"))


@query("doc_sample", """
SELECT doc_id, lang, source FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)) LIMIT 25
""")
def q_doc_sample(r):
    """D11 $sample of 25 documents (seeded hash order)."""
    return D.doc_sample(r.table("documents").select("doc_id", "lang", "source"), 25, "doc_id", seed=7)


@query("doc_union", """
SELECT doc_id, lang, source, n_chars FROM documents
UNION ALL
SELECT page_id AS doc_id, NULL AS lang, url AS source, NULL AS n_chars FROM pages
""")
def q_doc_union(r):
    """D12 $unionWith pages (missing fields NULL)."""
    pages = r.table("pages").select(C("page_id").alias("doc_id"), C("url").alias("source"))
    return D.doc_union(r.table("documents").select(*FIELDS), pages)


@query("doc_lookup_unwind", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def q_doc_lookup_unwind(r):
    """D8 + D7 $lookup of labels then $unwind (preserving documents without labels)."""
    return D.doc_lookup_unwind(r.table("documents").select("doc_id", "lang"), r.table("labels"), "doc_id", "doc_id",
                               ["quality", "toxic"])
