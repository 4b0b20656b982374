"""The queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.catalog import Entry
from . import (
    archives, ball_tree, decontaminate, knn, link_graph, near_dup, ngram_trie, packing, page_text, periodic_runs, quality,
    token_files, tool_calls,
)
from .common import table

ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def enter(run):
        ENTRIES[name] = Entry(run, sql)
        return run

    return enter


def fold(parts: int) -> Column:
    """The part of all documents that a doc_id belongs to."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op1_elias_fano_scores")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.score_documents(table(spark, folder, "documents"), fold(7) != 2)


@query(
    "op2_voronoi_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
      SELECT q.vec_id AS query_id, d.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.e) = len(q.e)
      WHERE q.vec_id % 20 = 0
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return knn.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op7_neighbour_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"), fold(5) != 0)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query(
    "op8_archive_converter",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
             sha1(coalesce(html, '')) AS hex
      FROM pages
    )
    SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
                   >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM p
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    records = archives.archive_pages(table(spark, folder, "pages"), least_revisit=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op4_decontamination",
    r"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), items AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark
    ), wins AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS size,
        array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
      FROM items, range(1, 1000000) r(s) WHERE s <= len(w) - least(len(w), 10) + 1 AND len(w) > 0
    ), sizes AS (SELECT DISTINCT size FROM wins),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM docs),
    found AS (
      SELECT p.doc_id, p.s, z.size, array_to_string(list_slice(p.w, p.s, p.s + z.size - 1), ' ') AS win
      FROM places p, sizes z WHERE p.s + z.size - 1 <= len(p.w)
    ), hits AS (SELECT f.doc_id, f.s, f.size, x.item_id FROM found f JOIN wins x ON x.win = f.win AND x.size = f.size),
    covered AS (
      SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id
    ), listed AS (
      SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(l.n, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256,
      coalesce(c.n, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_consensus_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_text(table(spark, folder, "pages"))


@query("op6_tool_call_linking")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return tool_calls.whole_conversations(table(spark, folder, "conversations"))


@query("op9_circulant_minhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"))


@query(
    "op11_link_propagation",
    r"""
    WITH RECURSIVE u AS (
      SELECT page_id, html, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS mark FROM pages
    ), r AS (
      SELECT page_id, html, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*') ELSE '' END AS raw,
        CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM u
    ), p AS (
      SELECT page_id, html, path,
        translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
      FROM r
    ), rules(rule, rhost, rpath, says) AS (
      VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
             ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
    ), judged AS (
      SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path, any_value(p.html) AS html,
        max_by(rule, len(rule)) AS rule, max_by(says, len(rule)) AS says
      FROM p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
      GROUP BY p.page_id
    ), raw_links AS (
      SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''),
        '(?i)<a\s[^<>]*?href\s*=\s*["'']?([^"''\s<>]*)', 1)) AS link
      FROM judged WHERE host <> ''
    ), links AS (
      SELECT DISTINCT page_id, host, CASE
          WHEN regexp_matches(link, '^(?i)(https?:)?//[^/?#]') THEN
            translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
          WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE host END AS target
      FROM raw_links
    ), counted AS (
      SELECT host AS src, target AS dst, CAST(count(*) AS DOUBLE) AS n FROM links WHERE target <> '' GROUP BY ALL
    ), hosts AS (
      SELECT host, count(*) FILTER (says = 'allow') / count(*) AS good, count(*) FILTER (says = 'block') / count(*) AS bad
      FROM judged WHERE host <> '' GROUP BY host
      UNION ALL
      SELECT DISTINCT dst, 0.0, 0.0 FROM counted WHERE dst NOT IN (SELECT host FROM judged)
    ), edges AS (
      SELECT src, dst, n FROM counted
      UNION ALL SELECT host, host, 1.0 FROM hosts WHERE host NOT IN (SELECT src FROM counted)
    ), back AS (
      SELECT src, dst, n FROM counted
      UNION ALL SELECT host, host, 1.0 FROM hosts WHERE host NOT IN (SELECT dst FROM counted)
    ), ahead AS (
      SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
    ), behind AS (
      SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM back
    ), moves AS (
      SELECT src, dst, 0.85 * share AS led, 0.0 AS back FROM ahead
      UNION ALL SELECT src, dst, 0.0, 0.85 * share FROM behind
      UNION ALL SELECT '', host, 0.15 * good, 0.15 * bad FROM hosts
      UNION ALL SELECT '', '', 1.0, 1.0
    ), flow(step, host, trust, distrust) AS (
      (SELECT 0, host, CAST(good AS DOUBLE), CAST(bad AS DOUBLE) FROM hosts UNION ALL SELECT 0, '', 1.0, 1.0)
      UNION ALL
      (SELECT any_value(step) + 1, dst, sum(trust * led), sum(distrust * back)
       FROM flow JOIN moves ON src = host WHERE step < 50 GROUP BY dst)
    ), ends AS (SELECT host, trust, distrust FROM flow WHERE step = 50 AND host <> '')
    SELECT j.page_id, j.host, j.path, j.rule,
      coalesce(j.says, CASE WHEN e.distrust >= 0.5 AND e.distrust > e.trust THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged j LEFT JOIN ends e ON e.host = j.host
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)],
        "host string, path string, allow boolean",
    )
    judged = link_graph.judge_urls(table(spark, folder, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op12_ball_tree_search",
    r"""
    WITH t AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents
    ), asked AS (
      SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
      ) GROUP BY ALL
    ), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
    whole AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM lengths),
    damped AS (SELECT doc_id, 75 + (25 * n * total) // length AS m FROM lengths, whole),
    weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, whole GROUP BY term
    ), scores AS (
      SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN damped USING (doc_id)
      GROUP BY item_id, doc_id
    ), ranks AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


@query(
    "op13_periodic_runs",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, CAST(doc_id AS VARCHAR) AS s
      FROM documents
    ), hashed AS (
      SELECT doc_id, w0, CAST(len(w0) AS BIGINT) AS n, xor(4294967295, list_reduce(
        flatten([[4294967295]] || list_transform(range(len(s)), lambda i: [CAST(ascii(s[i + 1]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h
      FROM d
    ), placed AS (
      SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed
    ), docs AS (
      SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(w0, lambda x, i:
        CASE WHEN i - 1 < a THEN x ELSE w0[a + (i - 1 - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w
      FROM placed
    ), grams AS (
      SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS gram
      FROM (SELECT doc_id, n, w, unnest(range(n - 5)) AS i FROM docs)
    ), pairs AS (
      SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y
      ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
    ), diagonals AS (
      SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
      GROUP BY doc_id, q, island HAVING count(*) + 5 >= greatest(q, 12 - q)
    ), runs AS (SELECT doc_id, start, length, min(q) AS period FROM diagonals GROUP BY ALL),
    listed AS (
      SELECT doc_id, count(*) AS n_runs, max_by(struct_pack(s := start, l := length, p := period),
          struct_pack(l := length, s := -start, p := -period)) AS best,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
      FROM runs GROUP BY doc_id
    ), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
      CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return runs_digest(periodic_runs.periodic_runs(with_planted_runs(table(spark, folder, "documents"))))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """In every tenth document, by crc32 of its id, the words from a place on repeat a stretch of the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    docs = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of all its runs and of its collapsed text."""
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    first = F.expr("array_max(transform(runs, r -> struct(r.length as l, -r.start as s, -r.period as p)))")
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
