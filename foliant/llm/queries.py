"""The operators over the given tables, whole; beside each its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, langid, pieces, pii
from foliant.llm.embedding_dedup import embedding_dedup
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.filter_audit import filter_audit
from foliant.llm.line_dedup import clean_lines
from foliant.llm.minhash import minhash_dedup
from foliant.llm.packing import pack
from foliant.llm.substring_dedup import substring_dedup
from foliant.llm.vector_codes import coded
from foliant.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, table: str, sql: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op5_packing", "documents")
def op5(documents: DataFrame) -> DataFrame:
    pieces = pack(documents, tokenizer("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query(
    "op6_exact_dedup",
    "documents",
    """
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t,
                 max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                 count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
    """,
)
def op6(documents: DataFrame) -> DataFrame:
    return exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op8_minhash",
    "documents",
    """
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2),
          lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
    c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have
          FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
          WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
    r AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT l.v, r.low FROM r JOIN l ON l.u = r.doc_id)
    SELECT doc_id, n AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept
    FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
    """,
)
def op8(documents: DataFrame) -> DataFrame:
    return minhash_dedup(documents, k=4).drop("digest")


@query(
    "op10_substring_dedup",
    "documents",
    """
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS w
               FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
    h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM s),
    o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM o WHERE low < doc_id),
    g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
           sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op10(documents: DataFrame) -> DataFrame:
    return substring_dedup(documents).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


@query("op1_pii", "documents")
def op1(documents: DataFrame) -> DataFrame:
    found = pii.detect(documents)
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


@query("op4_langid", "documents")
def op4(documents: DataFrame) -> DataFrame:
    fold = langid.fold("doc_id")
    model = langid.train(documents, fold > 1, fold == 1)
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


@query(
    "op9_embedding_dedup",
    "embeddings",
    """
    WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    s AS (SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
          AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
    r AS (SELECT vec_id, vec_id AS low FROM e UNION SELECT l.v, r.low FROM r JOIN l ON l.u = r.vec_id),
    n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
    SELECT r.vec_id, coalesce(max(n.n), 0) AS n_links, min(low) AS component_id, r.vec_id = min(low) AS kept
    FROM r LEFT JOIN n ON n.u = r.vec_id GROUP BY r.vec_id
    """,
)
def op9(embeddings: DataFrame) -> DataFrame:
    return embedding_dedup(embeddings)


@query(
    "op7_warc",
    "pages",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS low,
          array_to_string(list_transform(string_split(sha1(h), ''), lambda d: substr(
              '0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', d) - 3, 4)), '') AS bits
          FROM p)
    SELECT page_id, strlen(h) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(
               list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INT) * (16 >> k))) AS INT), 1)), '') AS payload_digest,
           CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> low THEN low END AS refers_to
    FROM f
    """,
)
def op7(pages: DataFrame) -> DataFrame:
    return archive_pages(pages).drop("url")


@query("op2_sentencepiece", "documents")
def op2(documents: DataFrame) -> DataFrame:
    # what is to be compared later goes along with the id
    given = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).alias("given")
    spelt = pieces.round_trip(documents.select(given, "text"), tokenizer("piece_bpe_32k.model"), id_col="given")
    return spelt.select(
        "doc_id.doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT) AS n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("text_sha256"), (F.col("doc_id.sha256") == F.sha2("text", 256)).alias("round_trip"),
    )


@query(
    "op3_chat",
    "conversations",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM t),
    c AS (SELECT conv_id, list([role, text] ORDER BY pos) AS l, count(*) AS n FROM p GROUP BY conv_id),
    x AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
    k AS (SELECT min(conv_id) AS conv_id FROM c WHERE l NOT IN (SELECT l FROM x) GROUP BY l),
    f AS (SELECT p.conv_id, (pos - 1) // 256 AS part, pos, '<|im_start|>' || replace(role, '<|', '<\\|') || chr(10) ||
          replace(text, '<|', '<\\|') || '<|im_end|>' || chr(10) AS line FROM p JOIN k USING (conv_id)),
    r AS (SELECT conv_id, part, sha256(string_agg(line, '' ORDER BY pos)) AS h FROM f GROUP BY conv_id, part)
    SELECT conv_id, n AS n_turns, k.conv_id IS NOT NULL AS kept, g.h AS rendered_sha256
    FROM c LEFT JOIN k USING (conv_id) LEFT JOIN (SELECT conv_id, sha256(string_agg(h, '' ORDER BY part)) AS h FROM r GROUP BY conv_id) g USING (conv_id)
    """,
)
def op3(conversations: DataFrame) -> DataFrame:
    decided, texts = chat.chat_format(conversations)
    parts = texts.select("key", F.struct("part", F.sha2("text", 256).alias("h")).alias("at"))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    whole = whole.select("key", F.sha2(F.array_join(F.transform("at", lambda x: x["h"]), ""), 256).alias("rendered_sha256"))
    return decided.join(whole, "key", "left").drop("key")


@query(
    "op11_line_dedup",
    "documents",
    """
    WITH d AS (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(1, 1 + len(string_split(coalesce(text, ''), chr(10)))))) AS z
               FROM documents),
    l AS (SELECT doc_id, z[1] AS line, z[2] AS pos, translate(trim(z[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d),
    c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.last > doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.last IS NULL OR c.last <= doc_id), '')) AS kept_sha256
    FROM l LEFT JOIN c USING (k) GROUP BY doc_id
    """,
)
def op11(documents: DataFrame) -> DataFrame:
    return clean_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _codes_sql(rounds: int) -> str:
    """One part of the check for every round: nearest entries, then their means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.entry) AS m "
            f"FROM p JOIN c{r} c USING (part) GROUP BY ALL)"
        )
        if r < rounds:
            steps.append(
                f"u{r} AS (SELECT part, CAST(m % 64 AS BIGINT) AS entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS BIGINT) AS mean "
                f"FROM a{r} JOIN p USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS pos) GROUP BY ALL)"
            )
            steps.append(
                f"c{r + 1} AS (SELECT c.part, c.entry, coalesce(list(mean ORDER BY pos) FILTER (mean IS NOT NULL), any_value(c.x)) AS x "
                f"FROM c{r} c LEFT JOIN u{r} u ON u.part = c.part AND u.entry = c.entry GROUP BY c.part, c.entry)"
            )
    return ",\n".join(steps)


@query(
    "op12_vector_codes",
    "embeddings",
    f"""
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    k AS (SELECT vec_id, label, list_transform(v, lambda c: CAST(floor(256 * c) AS BIGINT)) AS x FROM e
          WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    p AS (SELECT vec_id, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM k, (SELECT unnest(range(16)) AS part)),
    c0 AS (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
    {_codes_sql(2)},
    o AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 64 AS INT)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           sha256((SELECT string_agg(array_to_string(x, ','), ',' ORDER BY part, entry) FROM c2)) AS codebooks_sha256
    FROM o JOIN k USING (vec_id)
    """,
)
def op12(embeddings: DataFrame) -> DataFrame:
    return coded(embeddings)


SQL["op13_filter_audit"] = """
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
          CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
          FROM t LEFT JOIN g USING (doc_id)),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
          FROM o, (SELECT unnest(range(1, 6)) AS step)),
    n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    x AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS alone,
          before <> '' AND regexp_matches(fails, CASE WHEN before = '' THEN 'z' ELSE '[' || before || ']' END) AS earlier FROM n, s),
    r AS (SELECT part, filter_order, step, f,
          CAST(coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0) AS BIGINT) AS kept,
          CAST(coalesce(sum(n) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS removed,
          CAST(coalesce(sum(n) FILTER (failing AND earlier), 0) AS BIGINT) AS redundant,
          CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
          CAST(coalesce(sum(good) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS good_lost,
          CAST(coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


QUERIES["op13_filter_audit"] = op13
