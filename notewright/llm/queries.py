"""One query for each operator over the driver's tables, and DuckDB SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import chat, cover_tree, filter_audit, hard_negatives, kmeans_tree, line_dedup, lm, mixing, packing, quality, secret_scan, simhash, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""))
    made = chat.format_trees(chat.chains(rows))
    turns = F.array_join(F.transform(chat.turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.learned(F.col("formatted"), F.col("loss_spans"))
    read = made.select(F.col("tree").alias("conv_id"), F.size(chat.turns_of(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cover_tree.whole_numbers(table(spark, sf_dir, "embeddings"), "embedding")
    return cover_tree.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 20 == 0, 20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.dedup_passages(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents"), labels)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, "embedding", F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("part"), "text")
    return filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_cover_tree": op2_cover_tree,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_kmeans_tree": op4_kmeans_tree,
    "op5_mixing": op5_mixing,
    "op6_passages": op6_passages,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_secrets": op11_secrets,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op2_cover_tree": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v AS q JOIN v AS p ON q.vec_id % 50 = 0 AND q.r <> p.r
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op1_chat": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), escaped AS (
    SELECT *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS role_chars,
        length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) AS text_chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op11_secrets": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, p, g, least) AS (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', '(AKIA[A-Z0-9]+)', 1, 20), (2, 'hex', '([0-9a-f]+)', 1, 24),
    (3, 'entropy_hex', '([0-9A-Fa-f]+)', 1, 20), (4, 'entropy_base64', '([A-Za-z0-9+/_=-]+)', 1, 20)
), cut AS (
    SELECT r, doc_id, k, kind, least, regexp_split_to_array(t, p) AS gaps, regexp_extract_all(t, p) AS m, CASE WHEN g = 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p) END AS v
    FROM docs CROSS JOIN kinds
), one AS (SELECT r, doc_id, k, kind, least, unnest(list_zip(m, gaps[1:len(m)], v, range(1, len(m) + 1))) AS z FROM cut WHERE len(m) > 0),
placed AS (
    SELECT r, doc_id, k, kind, z[1] AS s, length(z[1]) AS n, length(z[3]) >= least AS long_enough,
        CAST(sum(length(z[2]) + length(z[1])) OVER (PARTITION BY r, k ORDER BY z[4]) - length(z[1]) AS BIGINT) AS a
    FROM one
), hits AS (SELECT *, a + n AS e FROM placed WHERE long_enough),
candidates AS (
    SELECT *, CASE k WHEN 3 THEN lower(s) ELSE s END AS low, row_number() OVER () AS c FROM hits
    WHERE k > 2 AND NOT regexp_matches(s, '^[A-Za-z]+([_=/+-]+[A-Za-z]+)*[_=/+-]*$') AND NOT regexp_matches(s, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}')
        AND NOT regexp_matches(s, '^/?([a-z0-9_-]+/){3,}') AND NOT regexp_matches(s, 'abcdefghijklmnop|ABCDEFGHIJKLMNOP|0123456789') AND NOT regexp_matches(s, 'EXAMPLE|example')
), slid AS (SELECT c, pos, substr(low, CAST(pos AS BIGINT) + 1, 20) AS w FROM (SELECT c, low, unnest(range(0, n - 19)) AS pos FROM candidates)),
characters AS (SELECT c, pos, unnest(string_split(w, '')) AS x FROM slid),
weights AS (SELECT c, pos, sum(CAST(round(n * log2(n) * 1048576) AS BIGINT)) AS weight FROM (SELECT c, pos, x, count(*) AS n FROM characters GROUP BY ALL) GROUP BY ALL),
hulls AS (
    SELECT h.r, h.doc_id, h.k, h.kind, h.a + min(w.pos) AS a, h.a + max(w.pos) + 20 AS e
    FROM candidates AS h JOIN weights AS w USING (c) WHERE w.weight <= floor(20 * (log2(20) - CASE h.k WHEN 3 THEN 3.0 ELSE 3.7 END) * 1048576) GROUP BY h.c, h.r, h.doc_id, h.k, h.kind, h.a
), spans AS (SELECT r, k, kind, a, e FROM hits WHERE k < 3 UNION ALL SELECT r, k, kind, a, e FROM hulls),
listed AS (
    SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans
    FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
""",
    "op12_hard_negatives": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, p.vec_id, a.label = p.label AS same, CAST(list_sum(list_transform(list_zip(a.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v AS a JOIN v AS p ON a.vec_id % 100 = 0 AND a.r <> p.r
), positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
met AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
    FROM positives AS p JOIN scored AS n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 10
""",
    "op13_filter_audit": r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
docs AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
    FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letter(l) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
    SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
counted AS (
    SELECT part, o, step, n, good, toxic, fails[o[step]] AS here, len(list_filter(o[1:step - 1], lambda f: fails[f])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) = 1 AS single
    FROM cells CROSS JOIN steps
), summed AS (
    SELECT part, o, step, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
        coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND single), 0) AS unique_fails,
        coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS toxic_lost
    FROM counted GROUP BY part, o, step
)
SELECT part, list_aggregate(list_transform(o, lambda f: substr('ABCDE', f, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM summed
""",
}
