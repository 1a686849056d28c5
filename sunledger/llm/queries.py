"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The conversation that says what the template uses to mark turns.
TRICK = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back_digest

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back_digest(format_chats(rows.unionByName(spark.createDataFrame(TRICK, rows.schema))))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_digest

    return shard_digest(read(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import with_copies

    planned = with_copies(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("source").alias("source")
    )


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_digest

    return audio_digest(read(spark, sf_dir, "documents"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_html_text, op4_chat_format, op5_sharding, op6_langid, op7_suffix_dedup, op8_packing, op9_mixing, op10_audio, op11_top_k, op12_filter_audit, op13_clustering)}

#: Vectors that take part, as integers: a place for the scale and one for a further condition.
_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more}"


def _clusters(rounds: int) -> str:
    """Each round as two common tables: the nearest centroid of every vector, and the floors of their means."""
    told = [
        f"""v AS (SELECT *, row_number() OVER () AS r FROM ({_VECTORS.format(scale=64, more=" AND len(embedding) = 64")}))""",
        "c0 AS (SELECT v, row_number() OVER (ORDER BY h, v) - 1 AS cluster FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, v LIMIT 16))",
    ]
    for i in range(rounds + 1):
        told.append(f"""a{i} AS (SELECT r, vec_id, v, cluster, distance FROM (SELECT v.r, v.vec_id, v.v, c.cluster,
                list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{i} AS c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            told.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY p) AS v FROM (SELECT cluster, p, (s - ((s % n) + n) % n) // n AS m FROM (
                SELECT cluster, p, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY ALL)) GROUP BY cluster),
            c{i + 1} AS (SELECT coalesce(m.v, c.v) AS v, c.cluster FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))""")
    return "WITH " + ", ".join(told) + f"""
        SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
               (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN c{rounds} AS c USING (cluster)"""


#: A control string of the chat template.
_CONTROL = r"</?s>|\[/?INST\]"

SQL = {
    "op4_chat_format": f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, n, who, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, who)),
        e AS (SELECT *, len(role) + len(regexp_extract_all(role, '\\\\|{_CONTROL}')) + len(text) + len(regexp_extract_all(text, '\\\\|{_CONTROL}')) + len('[INST][/INST]</s>') AS n FROM r),
        c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) + len('<s>') AS formatted FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM c""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
        blocks AS (SELECT k, b, substr(x, b * 2 + 1, (1000 + 399) * 2) AS x FROM (SELECT k, x, unnest(range(0, greatest(len(x) // 2 - 399, 0), 1000)) AS b FROM d)),
        wins AS (SELECT k, b + i AS p, hash(substr(x, i * 2 + 1, 800)) AS h FROM (SELECT k, b, x, unnest(range(0, least(1000, len(x) // 2 - 399))) AS i FROM blocks)),
        hits AS (SELECT k, p FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)),
        runs AS (SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS run FROM (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM hits)),
        spans AS (SELECT k, run, min(p) AS low, max(p) + 400 AS high FROM runs GROUP BY ALL),
        marks AS (SELECT k, high AS a, lead(low) OVER (PARTITION BY k ORDER BY low) AS b FROM spans UNION ALL SELECT d.k, 0, min(low) FROM d LEFT JOIN spans USING (k) GROUP BY d.k),
        parts AS (SELECT k, a, substr(x, a * 2 + 1, (coalesce(b, len(x) // 2) - a) * 2) AS x FROM marks JOIN d USING (k)),
        kept AS (SELECT k, coalesce(string_agg(x, '' ORDER BY a), '') AS x,
                        coalesce(string_agg(regexp_extract(regexp_replace(x, '^(?:[89AB][0-9A-F])+', ''), '^(?:[0-7].|[CD].[89AB].|E.(?:[89AB].){2}|F.(?:[89AB].){3})*'), '' ORDER BY a), '') AS whole FROM parts GROUP BY k),
        sums AS (SELECT k, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
        SELECT doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256, decode(unhex(whole)) AS text
        FROM d JOIN kept USING (k) LEFT JOIN sums USING (k)""",
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
        FROM t""",
    "op9_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
        w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, cap / weight AS fills_at,
                     (sum(source_size) OVER () * 1.5::DOUBLE
                      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        a AS (SELECT *, max(CASE WHEN fills_at > level THEN level END) OVER () AS lambda_at FROM l),
        t AS (SELECT source, source_size, CASE WHEN fills_at > level THEN least(weight * lambda_at, cap) ELSE cap END AS target FROM a),
        r AS (SELECT *, coalesce(target / nullif(source_size, 0), 0.0::DOUBLE) AS rate FROM t)
        SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, round(r.target, 6) AS target,
               (d.size * (floor(r.rate) + CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE
                                                    < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken, d.source
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op11_top_k": f"""
        WITH v AS (SELECT *, row_number() OVER () AS r FROM ({_VECTORS.format(scale=1024, more="")})),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
              FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM t),
        f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                     + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > smallest, false)::INT AS mask FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, unnest(range(1, 6)) AS u(step)),
        r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
                     coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
              FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
    "op13_clustering": _clusters(3),
}
