"""The corpus operators' queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, decontamination, exact, extraction, fingerprints, mixing, pieces, quality, sharding, simhash, toxicity, urls
from .common import ascii_lower_sql, bound_batches, table

SHARDS = 40


def tokenizer_model() -> str:
    """Path of the SentencePiece model, on every machine: ``SENTENCEPIECE_MODEL``, else the installed public one."""
    if path := os.environ.get("SENTENCEPIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bound_batches(table(spark, sf_dir, "documents"))
    digest = pieces.digests(pieces.encode(F.col("text"), tokenizer_model()), tokenizer_model())
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.*")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    placed = sharding.shard_by_bytes(docs.select("doc_id", "text", crc), SHARDS, columns=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_dedup(docs, keep="max").select("doc_id", *exact.RESULTS)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_ratio", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mix = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = mixing.words_taken(mix)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *decontamination.RESULTS)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _sql_exact() -> str:
    return f"""
    WITH d AS (SELECT doc_id, {ascii_lower_sql("coalesce(text, '')")} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)"""


def _sql_urls() -> str:
    fits = [(h + p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in urls.RULES]
    fits.sort(key=lambda x: -len(x[0]))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v, _ in fits)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, {ascii_lower_sql("regexp_extract(rest, '^[^/?#]*')")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE {verdict} ELSE 'allow' END AS verdict FROM ruled"""


def _sql_mixing() -> str:
    m = mixing
    weights = ", ".join(map(str, m.WEIGHTS))
    return f"""
    WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS mix,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, CAST(list_extract([{weights}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)} + 1 AS BIGINT)) AS DOUBLE) AS weight FROM s0),
    s2 AS (SELECT *, CAST(source_size * {m.PASSES} AS DOUBLE) AS lim, source_size * {m.PASSES} / weight AS ratio FROM s1),
    s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {m.SHARE}
                      - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
    s4 AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM s3),
    s5 AS (SELECT source, source_size, coalesce(least(lim, (SELECT arg_min(level, place) FROM s4 WHERE level <= ratio) * weight), lim) AS target FROM s4),
    s6 AS (SELECT *, greatest(1, least(CAST(ceil(sum(source_size) OVER () * CAST({m.SHARE} AS DOUBLE) / {m.BLOCKS}.0) AS BIGINT),
                                       CAST(ceil(source_size / {m.LEAST_BLOCKS}.0) AS BIGINT))) AS block_size FROM s5),
    s7 AS (SELECT *, CAST(ceil(source_size / CAST(block_size AS DOUBLE)) AS BIGINT) AS blocks, target / block_size AS need FROM s6),
    s8 AS (SELECT *, least(blocks * {m.PASSES}, CAST(ceil(need) AS BIGINT)) AS quota,
                  sum(need) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM s7),
    s9 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, (SELECT max(hi) FROM s8) AS whole FROM s8),
    points AS (SELECT n * {m.GOLDEN} - floor(n * {m.GOLDEN}) AS u FROM range(CAST((SELECT ceil(max(whole)) FROM s9) AS BIGINT)) r(n)),
    slots AS (SELECT s9.source, count(*) AS slots FROM points JOIN s9 ON u * whole >= lo AND u * whole < hi GROUP BY s9.source),
    used AS (SELECT s9.*, least(quota, coalesce(slots.slots, 0)) AS slots FROM s9 LEFT JOIN slots ON s9.source IS NOT DISTINCT FROM slots.source),
    laid AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d)
    SELECT doc_id, size, source_size, target,
           CAST(CASE WHEN blocks = 0 THEN 0 ELSE (slots // blocks) * size
                + greatest(0, least(place + size, (slots % blocks) * block_size) - place) END AS BIGINT) AS taken
    FROM laid JOIN used ON laid.source IS NOT DISTINCT FROM used.source"""


def _sql_centroids(k: int = 16, rounds: int = 3) -> str:
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
    vectors AS (SELECT row_number() OVER () AS row, vec_id, v FROM e),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS cluster, v AS c FROM vectors QUALIFY cluster < {k})"""
    for i in range(rounds + 1):
        text += f""",
    n{i} AS (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT row, cluster, CAST({apart} AS BIGINT) AS d FROM vectors CROSS JOIN c{i}) GROUP BY row)"""
        if i < rounds:
            text += f""",
    m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY spot) AS c FROM (SELECT cluster, spot, sum(x) AS s, count(*) AS n
             FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS spot FROM n{i} JOIN vectors USING (row)) GROUP BY cluster, spot) GROUP BY cluster),
    c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    return text + f"""
    SELECT vec_id, CAST(n.cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM n{rounds} n JOIN vectors USING (row) JOIN c{rounds} c ON n.cluster = c.cluster"""


def _sql_decontamination(window: int = decontamination.WINDOW) -> str:
    words = lambda c: f"regexp_extract_all({ascii_lower_sql(f"coalesce({c}, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row, {words("text")} AS w FROM documents),
    b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    grams AS (SELECT row, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
              FROM (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hits AS (SELECT row, n, i, item_id FROM grams JOIN win USING (n, phrase)),
    hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
    named AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hits GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)"""


def _sql_collocations() -> str:
    m = collocations
    gram = " UNION ALL ".join(f"SELECT lang, {n} AS size, list_slice(w, i, i + {n - 1}) AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, m.LONGEST + 1))
    return f"""
    WITH pieces AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
                    unnest(string_split_regex({ascii_lower_sql("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
    total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    f AS (SELECT lang, size, p, count(*) AS f FROM ({gram}) GROUP BY lang, size, p HAVING count(*) >= {m.SUPPORT}),
    cuts AS (SELECT lang, size, p, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
    scored AS (SELECT c.*, h.f AS l, t.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
               FROM cuts c JOIN f h ON c.lang = h.lang AND list_slice(c.p, 1, c.k) = h.p JOIN f t ON c.lang = t.lang AND list_slice(c.p, c.k + 1, c.size) = t.p),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, list_slice(p, i, i + n - 1) AS p, max(f) AS f FROM (SELECT lang, p, size, f, n, unnest(range(1, size - n + 2)) AS i
               FROM f, (SELECT unnest(range(2, {m.LONGEST})) AS n) WHERE n < size) GROUP BY 1, 2),
    kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.p = i.p WHERE i.f IS NULL OR CAST(i.f AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
    ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {m.TOP}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_fingerprints, op3_sentencepiece, op4_sharding, op5_exact_dedup, op6_url_filter, op7_quality, op8_mixing, op9_toxicity, op10_extraction, op11_centroid_clusters, op12_decontamination, op13_collocations)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": _sql_exact(), "op6_url_filter": _sql_urls(), "op8_mixing": _sql_mixing(),
        "op11_centroid_clusters": _sql_centroids(), "op12_decontamination": _sql_decontamination(), "op13_collocations": _sql_collocations(),
    }
