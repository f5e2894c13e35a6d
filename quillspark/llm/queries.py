"""Queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import audio, histogram_sort, huffman, language_id, mixing, packing, phrases, quality, simhash, token_counts, url_filter, vector_search, whitening
from quillspark.llm.common import checkpointed, new_folder, table, written

#: Rules of ``op3_url_filter``.
RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]
#: Of ``op2_token_counts``: the limit that is reported, and from how many characters on texts go through overlapping chunks.
OVER, CHUNK_CHARS = 512, 8192
MIX = {"target_entropy": 0.95, "max_repetition": 4.0, "block_tokens": 200_000, "block_rows": 100_000}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("embedding"), F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("usable")).where("usable")
    found = vector_search.exact_top_k(scaled, F.col("vec_id") % 20 == 0, k=20, integral=True)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), chunk_chars=CHUNK_CHARS)
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The files are written, and what follows reads them again.
    stored = written(audio.store_audio(table(spark, sf_dir, "documents")))
    read = audio.audio_features(stored)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", audio.digest(F.col("segments")).alias("feature"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"), keep_columns=["doc_id", "source", "lang"])
    return scored.select("doc_id", "source", "lang", "__q.*")


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted once; of a text only its hash goes on.
    counted = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORDS)).cast("long").alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("text")))
    mixed = mixing.temperature_mix(counted, tokens_col="tokens", **MIX)
    m = F.col("__mix")
    return mixed.select("doc_id", "source", m["tokens"].alias("tokens"), F.round(m["weight"], 6).alias("weight"), F.round(m["repetitions"], 6).alias("repetitions"), m["copy"].alias("copy"), m["block"].alias("block"), m["block_order"].alias("block_order"), m["order"].alias("mix_order"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64, shift=1_000_000)
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    huffman.write_ids(written(huffman.token_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, width=2)), folder, width=2)
    return huffman.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), top=2000, most_words=4, least=30, cover_percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vector_search, op2_token_counts, op3_url_filter, op4_language_id, op5_audio_features, op6_quality, op7_histogram_sort, op8_harmonic_packing, op9_simhash, op10_mixing, op11_whitening, op12_token_files, op13_phrases)}


def _op1_sql() -> str:
    return """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
             r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20"""


# Rules (longest first) and terms, and the numbers of the mix, spelt for the SQL on their own.
_SQL_RULES = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
_SQL_STRICT = "casino escort hentai jackpot malware phishing porn pornhub sexcam warez xxx".split()
_SQL_SOFT = "adult bet betting bonus cam cheap crack dating keygen loan nude pills poker replica sex slots torrent viagra".split()
_SQL_UPPER, _SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op3_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(host, path)} THEN '{value(host, path, verdict)}'" for host, path, verdict in _SQL_RULES) + " END"
    hit = lambda t: f"regexp_matches(folded, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INTEGER"
    # Of a strict term all hits count: a boundary that two hits share would be used up by the first, so boundaries are doubled.
    hits = lambda t: f"len(regexp_extract_all(' ' || regexp_replace(folded, '([^a-z0-9])', '\\1\\1', 'g') || ' ', '[^a-z0-9]{t}[^a-z0-9]'))"
    return f"""
        WITH p AS (SELECT page_id, url, translate(coalesce(url, ''), '{_SQL_UPPER}', '{_SQL_LOWER}') AS folded,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_SQL_UPPER}', '{_SQL_LOWER}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             h AS (SELECT *, {case(lambda host, path, verdict: host + path)} AS rule, {case(lambda host, path, verdict: verdict)} AS ruled,
                          ({" + ".join(hits(t) for t in _SQL_STRICT)})::INTEGER AS strict_hits,
                          ({" + ".join(hit(t) for t in _SQL_SOFT)})::INTEGER AS soft_hits FROM p)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
               strict_hits, soft_hits FROM h"""


def _op10_sql() -> str:
    step = lambda kind, holds: f"""
        {kind}(i, low, high) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
            SELECT i + 1, CASE WHEN holds THEN mid ELSE low END, CASE WHEN holds THEN high ELSE mid END FROM (
                SELECT i, low, high, (low + high) / 2 AS mid, {holds} AS holds FROM {kind}, one WHERE i < 49))"""  # noqa: E731
    mid = "((low + high) / 2)"
    z = f"list_sum(list_transform(p, lambda x: pow(x, {mid})))"
    flat = f"(ln({z}) - {mid} * list_sum(list_transform(p, lambda x: pow(x, {mid}) * ln(x))) / {z}) >= 0.95 * ln(len(p))"
    rare = f"pow(list_min(p), {mid} - 1) / {z} > 4.0"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
                                    md5(doc_id::VARCHAR || '|mix|' || md5(md5(coalesce(text, '')))) AS o FROM documents),
             s AS (SELECT k, sum(tokens)::BIGINT AS t, count(*) AS rows FROM d GROUP BY k),
             one AS (SELECT sum(t)::DOUBLE AS total, list(t / (SELECT sum(t) FROM s)::DOUBLE ORDER BY t) FILTER (t > 0) AS p FROM s),
             {step("f", flat)}, {step("r", rare)},
             e AS (SELECT round(greatest((SELECT max(low) FROM f), (SELECT max(low) FROM r)), 9) AS a),
             w AS (SELECT k, t, CASE WHEN t > 0 THEN pow(t / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) ELSE 0 END AS weight, t / total AS share, rows FROM s, one, e),
             m AS (SELECT *, CASE WHEN t > 0 THEN weight / share ELSE 0 END AS reps, greatest(ceil(t / 200000), ceil(rows / 100000), 1)::BIGINT AS blocks FROM w),
             b AS (SELECT d.*, m.t, m.weight, m.reps, ('0x' || o[1:8])::BIGINT % m.blocks AS block FROM d JOIN m USING (k)),
             c AS (SELECT *, sum(tokens) OVER (PARTITION BY k, block ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(tokens) OVER (PARTITION BY k, block) AS total FROM b),
             n AS (SELECT *, CASE WHEN t = 0 THEN 1 ELSE floor(reps + 1e-9)::BIGINT + CASE WHEN tokens > 0 AND upto - tokens / 2 < greatest(reps - floor(reps + 1e-9), 0) * total THEN 1 ELSE 0 END END AS copies FROM c)
        SELECT doc_id, source, tokens, round(weight, 6) AS weight, round(reps, 6) AS repetitions, copy::INTEGER AS copy, block,
               md5(copy::VARCHAR || '|' || block || '|mix|' || k) AS block_order, md5(copy::VARCHAR || '|' || o) AS mix_order
        FROM (SELECT *, unnest(range(copies)) AS copy FROM n)"""


def _op13_sql() -> str:
    return r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
             w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
             g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS ks(k)),
             f AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
             t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
             often AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
             c AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE words > 1),
             u AS MATERIALIZED (SELECT lang, words, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS tail FROM c, range(1, 4) AS ks(k) WHERE k < words),
             x AS MATERIALIZED (SELECT u.lang, u.words, u.phrase, a, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score, k
                   FROM u JOIN often l ON l.lang = u.lang AND l.phrase = head JOIN often r ON r.lang = u.lang AND r.phrase = tail),
             s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             i AS (SELECT lang, a, array_to_string(w[b:b + size - 1], ' ') AS phrase FROM c, range(2, 4) AS sizes(size), range(1, 4) AS firsts(b) WHERE size < words AND b + size - 1 <= words),
             h AS (SELECT lang, phrase, max(a) AS held FROM i GROUP BY ALL),
             k AS (SELECT s.* FROM s LEFT JOIN h USING (lang, phrase) WHERE h.held IS NULL OR 100 * h.held < 80 * s.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN t USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_search": _op1_sql(), "op3_url_filter": _op3_sql(), "op10_mixing": _op10_sql(), "op13_phrases": _op13_sql()}
