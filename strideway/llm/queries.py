"""The queries opN_<name> of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.llm import automaton, bpe, langid, lsm, mixing, simhash, suffixes, topk, urlfilter, warc
from strideway.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automaton.remove_repeated(table(spark, sf_dir, "documents"), 20)
    return out.select(F.col("doc").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out():
    """Whether a document is kept from learning; a null doc_id is neither learned from nor held out."""
    return langid.bucket_of(F.col("doc_id")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lsm.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The table has no capture times: pages were captured a second apart.
    time = F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)))
    records = warc.read(warc.history(warc.write(pages, time)))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return bpe.digests(bpe.decode(tokens, RANKS, PATTERN))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated(table(spark, sf_dir, "documents"), 200)
    return out.select(F.col("doc").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


#: Levels of paths that the SQL of op10 walks; a deeper path's last segments stay as they are.
LEVELS = 8
LEVEL = """), k{d} AS (SELECT host, node, parts[{d}] AS part, sum(n) AS n FROM t{p} WHERE len(parts) >= {d} GROUP BY ALL
        ), v{d} AS (SELECT host, node FROM k{d} GROUP BY ALL HAVING count(*) > 8 AND sum(n) < 4 * count(*)
        ), t{d} AS (
            SELECT t{p}.* EXCLUDE (node), CASE WHEN len(parts) >= {d} THEN t{p}.node || '/' || CASE WHEN v{d}.host IS NULL THEN parts[{d}] ELSE '*' END ELSE t{p}.node END AS node
            FROM t{p} LEFT JOIN v{d} ON t{p}.host = v{d}.host AND t{p}.node = v{d}.node
        """

QUERIES = {f.__name__: f for f in (op1_top_k, op2_substring_dedup, op3_language_id, op4_exact_dedup, op5_warc, op6_byte_bpe, op7_mixing, op8_simhash, op9_suffix_array, op10_url_filter)}

ORACLES: dict[str, str] = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
        ), y AS (
            SELECT doc_id, j, word, string_agg(word, ' ') OVER f AS seq, count(*) OVER f = 20 AS whole
            FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), z AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, seq ORDER BY doc_id, j) > 1 AS again FROM y
        ), g AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM z
        ), k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
        ), q AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q
    """,
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(original) DESC, doc_id) AS keep_id
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, '')))) AS ord FROM documents
        ), n AS (SELECT greatest(1, ceil(count(*) / 4000.0))::BIGINT AS n FROM d
        ), s0 AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rank FROM d GROUP BY source
        ), s1 AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap, source_size * (6 // ((rank - 1) % 3 + 1)) AS fill FROM s0
        ), s2 AS (
            SELECT *, sum(source_size) OVER () AS all_words,
                   sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
            FROM s1 WINDOW b AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), s3 AS (SELECT *, cap * left_w < w * left_words AS isfull FROM s2
        ), s4 AS (
            SELECT *, all_words - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER () AS rest_w FROM s3
        ), s5 AS (
            SELECT *, CASE WHEN isfull THEN cap::DOUBLE ELSE coalesce((w * rest)::DOUBLE / nullif(rest_w, 0)::DOUBLE, 0) END AS target FROM s4
        ), s6 AS (
            SELECT *, greatest(1, least(4096, floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0) / 100)))::BIGINT AS block FROM s5
        ), s7 AS (SELECT *, floor(all_words / block + 0.5)::BIGINT AS blocks FROM s6
        ), q1 AS (
            SELECT rank, blocks, unnest(range(0, (target / block)::BIGINT + 60)) AS k, target FROM s7 WHERE target > 0
        ), q2 AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place, blocks FROM q1
        ), q3 AS (SELECT rank, count(*) AS seats FROM q2 WHERE place <= blocks GROUP BY rank
        ), s8 AS (SELECT s7.*, coalesce(seats, 0) AS seats FROM s7 LEFT JOIN q3 USING (rank)
        ), e AS (
            SELECT d.*, s8.source_size, target, block, seats, ('0x' || substr(ord, 1, 8))::BIGINT % n.n % greatest(1, least(n.n, s8.source_size // (block * 32))) AS shard
            FROM n, d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source
        ), h1 AS (
            SELECT source, shard, sum(size)::BIGINT AS shard_size, source_size, target, block, seats FROM e GROUP BY ALL
        ), r1 AS (
            SELECT source, shard, seats, shard_size, unnest(range(0, (seats * shard_size / source_size)::BIGINT + 60)) AS k FROM h1 WHERE shard_size > 0
        ), r2 AS (
            SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place FROM r1
        ), r3 AS (SELECT source, shard, count(*) AS shard_seats FROM r2 WHERE place <= seats GROUP BY ALL
        ), h2 AS (
            SELECT h1.*, coalesce(shard_seats, 0) * block AS won FROM h1 LEFT JOIN r3 ON h1.source IS NOT DISTINCT FROM r3.source AND h1.shard = r3.shard
        ), h3 AS (
            SELECT *, greatest(0, 3 * shard_size - won) AS room, sum(greatest(0, won - 3 * shard_size)) OVER (PARTITION BY source) AS over_,
                   coalesce(sum(greatest(0, 3 * shard_size - won)) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
            FROM h2
        ), h4 AS (SELECT source, shard, shard_size, (least(won, 3 * shard_size) + least(room, greatest(0, over_ - gone)))::BIGINT AS quota FROM h3
        ), o AS (
            SELECT e.*, h2.shard_size, h2.quota, coalesce(h2.quota // nullif(h2.shard_size, 0), 0) AS whole,
                   coalesce(sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM e JOIN h4 h2 ON e.source IS NOT DISTINCT FROM h2.source AND e.shard = h2.shard
        )
        SELECT doc_id, source, size, source_size, target, (whole * size + least(size, greatest(0, quota - whole * shard_size - ahead)))::BIGINT AS taken FROM o
    """,
    "op9_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), x AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 199)) AS i, h FROM d WHERE len(h) >= 400
        ), y AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM x
        ), r AS (SELECT m FROM y GROUP BY m HAVING count(*) > 1
        ), w AS (SELECT doc_id, i FROM y SEMI JOIN r USING (m)
        ), e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER o > 200, true) AS fresh FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e
        ), s AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY ALL
        ), gaps AS (SELECT doc_id, span, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a, b FROM s
        ), k AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op10_url_filter": r"""
        WITH r AS (
            SELECT page_id, contains(coalesce(url, ''), '://') AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages
        ), p AS (
            SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM r
        ), rules(rule, given, rhost, rpath) AS (
            VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
                   ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
        ), w AS (
            SELECT p.*, (SELECT arg_max(rule, len(rule)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule FROM p
        ), y AS (
            SELECT w.*, given, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '^([0-9]+(\.[A-Za-z0-9]+)?|[0-9A-Fa-f]{8,})$', '*')) AS parts
            FROM w LEFT JOIN rules USING (rule)
        ), t0 AS (
            SELECT host, parts, count(*) AS n, count(*) FILTER (given = 'allow') AS allow, count(given) AS labelled, '' AS node FROM y GROUP BY host, parts
        LEVELS), leaves AS (SELECT host, node, sum(allow)::DOUBLE AS a, sum(labelled)::DOUBLE AS m FROM tLAST GROUP BY ALL
        ), px AS (
            SELECT host, node, a, m, d, array_to_string(string_split(node, '/')[1:d], '/') AS id, CASE WHEN d > 1 THEN array_to_string(string_split(node, '/')[1:d - 1], '/') END AS up
            FROM (SELECT *, unnest(range(1, len(string_split(node, '/')) + 1)) AS d FROM leaves)
        ), nd AS (SELECT host, id, max(up) AS up, sum(a) AS a, sum(m) AS m FROM px GROUP BY host, id
        ), ra AS (SELECT c.host, c.id, c.a, c.m, (p.a + 2.0::DOUBLE) / (p.m + 4.0::DOUBLE) AS r FROM nd c JOIN nd p ON p.host = c.host AND p.id = c.up
        ), ct AS (SELECT host, id FROM ra WHERE m > 0 AND abs(a - m * r) > 1.96::DOUBLE * sqrt(m * r * (1 - r))
        ), tp AS (SELECT px.host, px.node, max_by(px.id, px.d) AS top FROM px JOIN ct USING (host, id) GROUP BY px.host, px.node
        ), mg AS (SELECT l.*, coalesce(top, '') AS top FROM leaves l LEFT JOIN tp USING (host, node)
        ), pu AS (SELECT host, top, (sum(a) + 2.0::DOUBLE) / (sum(m) + 4.0::DOUBLE) AS purity FROM mg GROUP BY host, top
        ), z AS (SELECT t.host, t.parts, t.node, CASE WHEN m > 0 THEN purity ELSE 0.5 END AS purity FROM tLAST t JOIN mg USING (host, node) JOIN pu USING (host, top)
        )
        SELECT page_id, y.host, path, rule, coalesce(given, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, node AS template
        FROM y JOIN z ON y.host = z.host AND y.parts = z.parts
    """.replace("LEVELS", "".join(LEVEL.format(d=d, p=d - 1) for d in range(1, LEVELS + 1))).replace("tLAST", f"t{LEVELS}"),
}
