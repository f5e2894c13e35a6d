"""Registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.functions.lineage import shared_folder
from quillspark.operators import answer, chat, chunk, chunkset, collection, detect, embed, index, search
from quillspark.sources import html, readers

QUERY_VEC, SHIFTED = 7, 500
#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _read(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VEC).first()["embedding"]


_COS = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6)"
_BAND = "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'none' END"


@query(f"WITH s AS (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, label, score, {_BAND} AS quality FROM s")
def knn_topk(spark, sf_dir):
    return search.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, id_col="vec_id").withColumn("quality", chat.quality(F.col("score")))


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q WHERE e.label >= 3 AND e.label IN (3, 5, 7) ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    return search.search(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, "label:>=3 && label:[3, 5, 7]", id_col="vec_id")


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5")
def knn_batch(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return search.search_many(e, e.where("label = 3").select(F.col("vec_id").alias("query_id"), "embedding"), 5, id_col="vec_id")


@query()
def knn_indexed(spark, sf_dir):
    """The ten nearest of every twentieth vector through an index of all; its recall is tested against ``search_many``."""
    e = _read(spark, sf_dir, "embeddings")
    built = index.build(e, f"{shared_folder(spark)}/indexes/{uuid.uuid4()}", id_col="vec_id")
    return index.search_index(built, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, id_col="vec_id")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) AS clean FROM documents")
def clean_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


# Unicode's white space as a class of the SQL's patterns.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(f"""WITH o AS (SELECT doc_id, chr(160) || chr(12288) || replace(text, ' ', chr(8195) || chr(1)) || chr(10) || chr(160) || chr(10) || chr(1) || chr(8232) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda l: l <> ''), chr(10)) AS clean,
       len(list_filter(regexp_split_to_array(t, '[{_SPACE}]+'), lambda w: w <> ''))::INTEGER AS word_count FROM o""")
def clean_odd_spaces(spark, sf_dir):
    """Texts with the spaces of other scripts and with control characters, which stay."""
    odd = F.concat(F.lit("\u00a0\u3000"), F.replace(F.col("text"), F.lit(" "), F.lit("\u2003\u0001")), F.lit("\n\u00a0\n\u0001\u2028"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.clean_text(odd).alias("clean"), T.word_count(odd).alias("word_count"))


@query(r"SELECT doc_id, length(text)::INTEGER AS char_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS word_count FROM documents")
def word_char_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"))


# The patterns of the kinds, spelt for the SQL on their own.
_SQL_PATTERNS = {
    "n": (r"\n\d+\.\s+[A-Z][A-Z\s]{2,}", r"\n\d+\.\d+\s+[A-Z]", r"(?m)^\d+\.\s+[A-Z][A-Z\s]{2,}"), "s": (r"(?i)Article\s+\d+", r"(?i)Art\.\s+\d+", r"(?i)Section\s+\d+", r"§\s*\d+"),
    "l": (r"\([a-z]\)", r"\([ivx]+\)", r"\n\s*[•●○]\s", r"\n\s*-\s+[A-Z]"),
}
_HITS = lambda kind: " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in _SQL_PATTERNS[kind])
#: By id: a text as it is, with numbered sections, with articles, or with a list; the marks stand before each half, or before all.
_MADE_SQL = """CASE doc_id % 4 WHEN 0 THEN text
    WHEN 1 THEN chr(10) || '1. SCOPE TERMS' || chr(10) || text[1:length(text) // 2] || chr(10) || '2. PAYMENT TERMS' || chr(10) || text[length(text) // 2 + 1:]
    WHEN 2 THEN 'Article 1 - Scope' || chr(10) || text[1:length(text) // 2] || chr(10) || 'Article 2 - Terms' || chr(10) || text[length(text) // 2 + 1:]
    ELSE '(a) one' || chr(10) || '(b) two' || chr(10) || '(c) three' || chr(10) || '(e) five' || chr(10) || '(f) six' || chr(10) || text END"""


def _made_whole(docs: DataFrame) -> DataFrame:
    """The same, over whole texts."""
    t, kind, half = F.col("text"), F.col("doc_id") % 4, F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(t, F.lit(1), half), F.substring(t, half + 1, F.length(t))
    join = lambda *parts: F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = F.when(kind == 0, t).when(kind == 1, F.concat(F.lit("\n"), join("1. SCOPE TERMS", first, "2. PAYMENT TERMS", second))).when(kind == 2, join("Article 1 - Scope", first, "Article 2 - Terms", second)).otherwise(join("(a) one", "(b) two", "(c) three", "(e) five", "(f) six", t))
    return docs.select("doc_id", made.alias("text"))


@query(f"""WITH m AS (SELECT doc_id, {_MADE_SQL} AS t FROM documents), c AS (SELECT doc_id, {_HITS("n")} AS n, {_HITS("s")} AS s, {_HITS("l")} AS l, len(string_split(t, chr(10))) AS lines FROM m)
SELECT doc_id, CASE WHEN n >= 3 THEN 'numbered_sections' WHEN s >= 2 THEN 'statute' WHEN l >= 5 THEN 'policy_or_terms' ELSE 'unstructured' END AS doc_type,
 round(CASE WHEN n >= 3 THEN least(0.9, 0.6 + 0.05 * n) WHEN s >= 2 THEN least(0.85, 0.5 + 0.1 * s) WHEN l >= 5 THEN least(0.75, 0.4 + 10 * l / lines) ELSE 1.0 END::DOUBLE, 6) AS confidence,
 n::INTEGER AS section_count, s::INTEGER AS article_count, l::INTEGER AS list_count FROM c""")
def detect_doc_type(spark, sf_dir):
    found = detect.detect(_made_whole(_read(spark, sf_dir, "documents")))
    d = F.col("detection")
    return found.select("doc_id", d["doc_type"].alias("doc_type"), F.round(d["confidence"].cast("double"), 6).alias("confidence"), d["section_count"].alias("section_count"), d["article_count"].alias("article_count"), d["list_count"].alias("list_count"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[a-z]+', '', 'g'), '^\s+|\s+$', '', 'g') AS native, regexp_replace(text, '^\s+|\s+$', '', 'g') AS ocr FROM documents),
k AS (SELECT *, CASE WHEN length(native) >= 30 THEN 'native_text' WHEN length(native) > 0 AND length(ocr) > 2 * length(native) THEN 'hybrid' ELSE 'ocr' END AS page_type FROM p)
SELECT doc_id, page_type, md5(CASE page_type WHEN 'native_text' THEN native ELSE ocr END) AS digest FROM k""")
def page_decision(spark, sf_dir):
    """Native text is what is left of a text without its small letters."""
    made = readers.page_decision(F.regexp_replace("text", "[a-z]+", ""), F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", made["page_type"].alias("page_type"), F.md5(made["text"]).alias("digest"))


@query("SELECT source, count(*)::BIGINT AS pages, sum((lang = 'fr')::INTEGER)::BIGINT AS errors, CASE WHEN count(*) = 0 THEN 'failed' WHEN sum((lang = 'fr')::INTEGER) > 0 AND sum((lang = 'fr')::INTEGER) < count(*) THEN 'partial' WHEN sum((lang = 'fr')::INTEGER) > 0 THEN 'failed' ELSE 'success' END AS status FROM documents GROUP BY source")
def ingest_status(spark, sf_dir):
    n, e = F.count("*"), F.count_if(F.col("lang") == "fr")
    return _read(spark, sf_dir, "documents").groupBy("source").agg(n.alias("pages"), e.alias("errors"), readers.ingest_status(n, e).alias("status"))


_PARAGRAPHS = r"list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


@query(f"""WITH p AS (SELECT doc_id, list_transform({_PARAGRAPHS}, lambda p: {{'done': []::VARCHAR[], 'now': p, 'size': length(p)::BIGINT}}) AS parts FROM documents),
r AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN NULL ELSE list_reduce(parts, lambda x, y: CASE WHEN x.size + y.size > 3000 THEN {{'done': x.done || [x.now], 'now': y.now, 'size': y.size}} ELSE {{'done': x.done, 'now': x.now || chr(10) || chr(10) || y.now, 'size': x.size + y.size}} END) END AS s FROM p),
g AS (SELECT doc_id, CASE WHEN s IS NULL THEN [''] ELSE s.done || [s.now] END AS pages FROM r)
SELECT doc_id, (i - 1)::INTEGER AS page, pages[i] AS text FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM g)""")
def paginate_text(spark, sf_dir):
    pages = readers.split_pages(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page", "text"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?]+["''»]?)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))::INTEGER AS sentences FROM documents""")
def sentence_split(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"), "documented")).alias("sentences"))


_CLEAN = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10))"


@query(f"SELECT doc_id, CASE WHEN length(c) > 1000 THEN 'para_0_part0' ELSE 'para_0' END AS chunk_id, length(c)::INTEGER AS size, md5(c) AS digest FROM (SELECT doc_id, {_CLEAN} AS c FROM documents) WHERE c <> ''")
def chunk_paragraph(spark, sf_dir):
    chunks = _read(spark, sf_dir, "documents").select("doc_id", F.explode(chunk.paragraph_chunks(F.col("text"))).alias("c"))
    return chunks.select("doc_id", "c.chunk_id", F.length("c.content").alias("size"), F.md5("c.content").alias("digest"))


@query(f"SELECT doc_id, i::INTEGER AS part, md5(c[i * 500 + 1 : i * 500 + 500]) AS digest FROM (SELECT doc_id, c, unnest(range(ceil(length(c) / 500.0)::BIGINT)) AS i FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))")
def chunk_fixed_width(spark, sf_dir):
    options = chunk.ChunkOptions(max_chunk_size=500, preserve_sentence_integrity=False, sentence_overlap=False)
    chunks = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.paragraph_chunks(F.col("text"), options)).alias("part", "c"))
    return chunks.select("doc_id", "part", F.md5("c.content").alias("digest"))


def _chunks(spark, sf_dir, semantics="observed") -> DataFrame:
    return chunk.chunk_documents(_made_whole(_read(spark, sf_dir, "documents")), options=chunk.ChunkOptions(semantics=semantics))


@query()
def chunk_all(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "doc_type", "ordinal", "chunk_id", F.array_join("hierarchy", " > ").alias("path"), "start_pos", "end_pos", "content")


@query()
def chunk_all_documented(spark, sf_dir):
    return _chunks(spark, sf_dir, "documented").select("doc_id", "doc_type", "ordinal", "chunk_id", F.array_join("hierarchy", " > ").alias("path"), "content")


@query("SELECT event_id, user_id, event_type FROM events WHERE (props::JSON->>'k')::DOUBLE >= 40 AND (props::JSON->>'k')::DOUBLE <> 69 AND event_type IN (SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 2)")
def filter_nested(spark, sf_dir):
    """Events by a number within their properties."""
    events = _read(spark, sf_dir, "events").withColumn("props", F.parse_json("props"))
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return events.where(search.parse_filter(f"props.k:>=40 && props.k:!=69 && event_type:[{', '.join(kinds)}]", dict(events.dtypes))).select("event_id", "user_id", "event_type")


@query()
def layout_pages(spark, sf_dir):
    """Web pages by their layout: every page with a heading is cut under its headings."""
    pages = _read(spark, sf_dir, "pages").select("page_id", html.layout_of(F.col("html")).alias("seen")).select("page_id", "seen.*")
    chunks = chunk.chunk_documents(pages, "page_id", "text", "layout", detect_options=detect.DetectOptions(headings_least=1))
    return chunks.select("page_id", "doc_type", "ordinal", "chunk_id", F.array_join("hierarchy", " > ").alias("path"), "start_pos", "end_pos", "content")


@query()
def chunk_stats(spark, sf_dir):
    docs = _made_whole(_read(spark, sf_dir, "documents"))
    return chunkset.statistics(docs, chunk.chunk_documents(docs)).withColumn("chunk_types", F.to_json("chunk_types"))


@query()
def chunk_by_hierarchy(spark, sf_dir):
    return chunkset.by_hierarchy(_chunks(spark, sf_dir), ["1. SCOPE TERMS"]).select("doc_id", "ordinal", "content")


@query()
def export_markdown(spark, sf_dir):
    return chunkset.export(_chunks(spark, sf_dir), "markdown")


@query()
def export_csv(spark, sf_dir):
    return chunkset.export(_chunks(spark, sf_dir), "csv")


_BYTES = [f"('0x' || substring(md5(text), {33 - 2 * (i + 1)}, 2))::BIGINT / 255.0::DOUBLE" for i in range(16)]


@query(f"SELECT doc_id, round(x[1] / n, 6) AS first, round(x[16] / n, 6) AS last, len(x)::INTEGER AS dim FROM (SELECT doc_id, x, sqrt(list_dot_product(x, x)) AS n FROM (SELECT doc_id, [{', '.join(_BYTES)}]::DOUBLE[] || list_transform(range(48), lambda i: 0::DOUBLE) AS x FROM documents))")
def md5_embedding(spark, sf_dir):
    v = _read(spark, sf_dir, "documents").select("doc_id", V.md5_embedding(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"), F.size("v").alias("dim"))


@query("SELECT doc_id, 'chunk_' || sha256(text)[1:16] AS chunk_id FROM documents")
def content_id(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.content_id(F.col("text")).alias("chunk_id"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round((embedding[1]::DOUBLE * 3) / (3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS first FROM embeddings")
def l2_normalise(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(F.get(V.l2_normalize(tripled), F.lit(0)), 6).alias("first"))


@query("SELECT label AS key, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def dedup_keep_first(spark, sf_dir):
    return collection.dedup_keep_first(_read(spark, sf_dir, "embeddings").withColumnRenamed("label", "key"), "key", ["vec_id"]).select("key", "vec_id")


@query(f"SELECT coalesce(n.id, o.id) AS id, coalesce(n.label, o.label) AS label FROM (SELECT vec_id AS id, label FROM embeddings) o FULL JOIN (SELECT vec_id + {SHIFTED // 2} AS id, label + 100 AS label FROM embeddings) n ON o.id = n.id")
def upsert_merge(spark, sf_dir):
    old = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return collection.merge_rows(old, old.select((F.col("id") + SHIFTED // 2).alias("id"), (F.col("label") + 100).alias("label")))


@query("SELECT label::VARCHAR AS name, count(*)::BIGINT AS num_documents, max(len(embedding))::INTEGER AS embedding_dim FROM embeddings GROUP BY label")
def collection_stats(spark, sf_dir):
    """A collection for each label, and what the store says of them."""
    rows, root = _read(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/collections/{uuid.uuid4()}"
    store = collection.Collections(spark, root)
    for label, dim in rows.groupBy("label").agg(F.max(F.size("embedding"))).collect():
        store.create(collection.CollectionSchema(str(label), dim, buckets=4))
        own = rows.where(F.col("label") == label).select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("").alias("content"), "embedding")
        store.index(str(label), own, ["chunk_id"])
    return store.stats().select("name", "num_documents", "embedding_dim")


@query("""SELECT doc_id, part::INTEGER AS part, md5(text[part * 1000 + 1:part * 1000 + 1000]) AS digest FROM (
  SELECT doc_id, text, unnest(range(ceil(length(text) / 1000.0)::BIGINT)) AS part FROM (
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text[1:length(text) // 2] WHEN 1 THEN '' ELSE text END AS text FROM documents))""")
def replace_documents(spark, sf_dir):
    """Documents in parts of a thousand characters, of which a third was cut to half and a third emptied: their old parts go."""
    docs, kind = _read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    parts = lambda df: df.select("doc_id", "text", F.explode(F.filter(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int")), lambda i: i * 1000 < F.length("text"))).alias("part")).select("doc_id", F.concat_ws("#", "doc_id", "part").alias("id"), "part", F.md5(F.substring(F.col("text"), F.col("part") * 1000 + 1, F.lit(1000))).alias("digest"))
    changed = docs.where(kind < 2).select("doc_id", F.when(kind == 0, F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))).otherwise("").alias("text"))
    return collection.merge_rows(parts(docs), parts(changed), replaced=changed, by="doc_id").select("doc_id", "part", "digest")


@query(f"""SELECT doc_id, doc_id % 2 = 0 AND doc_id % 4 <> 0 AS known, round(CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 2.0 ELSE x[1] / n END, 6) AS first
 FROM (SELECT doc_id, x, sqrt(list_dot_product(x, x)) AS n FROM (SELECT doc_id, [{{bytes}}]::DOUBLE[] AS x FROM documents))""".replace("{bytes}", ", ".join(_BYTES)))
def embed_changed(spark, sf_dir):
    """Documents embedded where their vector isn't known: of every second one it is (marked by a 2), but half of these have changed."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), "doc_id", F.col("text").alias("content"))
    before = docs.where("doc_id % 2 = 0").withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    known = before.select("document", embed.content_hash(F.col("content"), embed.EmbedConfig()).alias("content_hash"), F.array(F.lit(2.0)).alias("embedding"))
    found, first = embed.embed_new(docs, known), F.get("embedding", F.lit(0))
    return found.select("doc_id", (first == 2).alias("known"), F.round(first, 6).alias("first"))


# Words and limits of the conversation, spelt for the SQL on their own.
_FOLLOWUP_SQL = "['what about', 'how about', 'and what', 'also', 'in addition', 'furthermore', 'moreover', 'can you explain', 'tell me more', 'elaborate', 'go on', 'continue', 'next']"
_CLARIFICATION_SQL = "['what do you mean', 'what does that mean', 'clarify', 'explain that', 'i don''t understand', 'unclear', 'confusing', 'rephrase', 'say that again', 'what is', 'define', 'meaning of']"
_REFERENCES_SQL, _FIRST_REFERENCES_SQL = "['that', 'this', 'it', 'they', 'those', 'these', 'he', 'she', 'him', 'her', 'them']", "['that', 'this', 'it', 'they', 'those', 'these']"
_COMMON_SQL = "['the', 'is', 'are', 'was', 'were', 'what', 'when', 'where', 'who', 'how', 'why', 'can', 'will', 'does']"


_HISTORY = f"""h AS (SELECT *, count(*) OVER w AS n_history, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS last_user, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS last_assistant
 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""
_KEYS = lambda c: rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]{{3,}}')), lambda w: NOT list_contains({_COMMON_SQL}, w))"


_CLASSIFY = rf"""WITH {_HISTORY}, t AS (SELECT conv_id, turn, n_history, last_user, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS q, {_KEYS("text")} AS a, {_KEYS("last_user")} AS b FROM h WHERE role = 'user'),
 k AS (SELECT *, list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '') AS tok FROM t)
SELECT conv_id, turn, n_history::BIGINT AS n_history, CASE WHEN n_history = 0 THEN 'new'
 WHEN len(list_filter({_CLARIFICATION_SQL}, lambda w: contains(q, w))) > 0 OR (contains(q, '?') AND len(list_intersect(tok, {_FIRST_REFERENCES_SQL})) > 0) THEN 'clarification'
 WHEN len(list_filter({_FOLLOWUP_SQL}, lambda w: contains(q, w))) > 0 OR regexp_matches(q, '^(and|but|also|or)\b') OR (n_history >= 2 AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / least(len(a), len(b)) > 0.3)
  OR list_contains({_REFERENCES_SQL}, tok[1]) OR len(list_filter(tok, lambda w: list_contains({_REFERENCES_SQL}, w))) >= 2 OR len(tok) <= 5 THEN 'followup' ELSE 'new' END AS query_type FROM k"""


@query(_CLASSIFY)
def classify_query(spark, sf_dir):
    return chat.classify_turns(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "n_history", "query_type")


@query(f"SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def history_window(spark, sf_dir):
    return chat.history(_read(spark, sf_dir, "conversations"))


@query(f"WITH {_HISTORY} SELECT conv_id, turn, last_user, last_assistant FROM h WHERE role = 'user'")
def previous_messages(spark, sf_dir):
    return chat.classify_turns(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "last_user", "last_assistant")


@query(f"SELECT vec_id, round(abs(embedding[1])::DOUBLE * 4, 4) AS score, {_BAND.replace('score', '(abs(embedding[1])::DOUBLE * 4)')} AS quality, 'file' || label || ' (Part ' || label || ' > Row ' || vec_id || ', p. ' || label || ',' || (label + 1) || ')' AS citation FROM embeddings")
def quality_citation(spark, sf_dir):
    score, s = F.abs(F.get("embedding", F.lit(0))).cast("double") * 4, lambda c: F.col(c).cast("string")
    cited = chat.citation(F.concat(F.lit("file"), s("label")), F.array(F.concat(F.lit("Part "), s("label")), F.concat(F.lit("Row "), s("vec_id"))), F.array(F.col("label"), F.col("label") + 1))
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 4).alias("score"), chat.quality(score).alias("quality"), cited.alias("citation"))


@query(f"WITH {_HISTORY}, p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'followup' ELSE 'clarification' END AS query_type, CASE conv_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS quality FROM h) SELECT conv_id, turn, CASE query_type WHEN 'new' THEN CASE quality WHEN 'high' THEN 'answer' WHEN 'none' THEN 'no_context' ELSE 'answer_with_care' END WHEN 'followup' THEN CASE WHEN quality IN ('high', 'medium') THEN 'follow_up' ELSE 'follow_up_no_context' END ELSE 'clarify' END AS prompt_kind FROM p")
def prompt_select(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 0, "new").when(F.col("turn") % 3 == 1, "followup").otherwise("clarification")
    band = F.when(F.col("conv_id") % 4 == 0, "high").when(F.col("conv_id") % 4 == 1, "medium").when(F.col("conv_id") % 4 == 2, "low").otherwise("none")
    return _read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", chat.prompt_kind(kind, band).alias("prompt_kind"))


_LAY = " || chr(10) || chr(10) || "
_PART = lambda name, value: f"'{name}:' || chr(10) || {value}"
_PASSAGES, _SOURCES, _ASKED = _PART("Passages", "context"), _PART("Sources", "cited"), _PART("Question", "text")
_EARLIER = [_PART("Earlier question", "coalesce(last_user, 'Previous question')"), _PART("Earlier answer", "coalesce(last_assistant, 'Previous answer')")]
_TEMPLATES = {
    "answer": ["'Answer the question from these passages and cite them.'", _PASSAGES, _SOURCES, _ASKED],
    "answer_with_care": ["'These passages may answer the question only in part. Say what they leave open.'", _PASSAGES, _SOURCES, _ASKED],
    "no_context": ["'No passage was found. Say so, and suggest how to ask better.'", _ASKED],
    "follow_up": ["'Continue the conversation from these passages.'", *_EARLIER, _PASSAGES, _ASKED],
    "follow_up_no_context": ["'Continue the conversation; no new passage was found.'", *_EARLIER, _ASKED],
    "clarify": ["'Explain the earlier answer more clearly.'", _EARLIER[1], _PASSAGES, _ASKED],
}


@query(f"""WITH {_HISTORY}, c AS ({_CLASSIFY}), p AS (SELECT h.conv_id, h.turn, h.text, h.last_user, h.last_assistant, c.query_type, 0.5 + h.turn / 20 AS score,
  '[Context 1] (Score: ' || printf('%.2f', (0.5 + h.turn / 20)::DOUBLE) || ')' || chr(10) || 'Source: conv' || h.conv_id || chr(10) || 'Section: Turn' || chr(10) || 'Content: ' || h.text || chr(10) AS context,
  'conv' || h.conv_id || ' (Turn, p. ' || h.turn || ')' AS cited FROM h JOIN c ON h.conv_id = c.conv_id AND h.turn = c.turn WHERE h.role = 'user'),
k AS (SELECT *, CASE query_type WHEN 'new' THEN CASE WHEN score >= 0.7 THEN 'answer' WHEN score >= 0.3 THEN 'answer_with_care' ELSE 'no_context' END WHEN 'followup' THEN CASE WHEN score >= 0.5 THEN 'follow_up' ELSE 'follow_up_no_context' END ELSE 'clarify' END AS kind FROM p)
SELECT conv_id, turn, kind, CASE kind {" ".join(f"WHEN '{k}' THEN {_LAY.join(v)}" for k, v in _TEMPLATES.items())} END AS prompt FROM k""")
def context_prompt(spark, sf_dir):
    asked = chat.classify_turns(_read(spark, sf_dir, "conversations"))
    context = F.array(F.struct(F.col("text").alias("text"), (F.lit(0.5) + F.col("turn") / 20).alias("score"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source_file"), F.array(F.lit("Turn")).alias("hierarchy"), F.array(F.col("turn").cast("int")).alias("page_numbers")))
    made = asked.withColumn("contexts", context).withColumn("kind", chat.prompt_kind(F.col("query_type"), chat.quality(F.get("contexts", F.lit(0))["score"])))
    return made.select("conv_id", "turn", "kind", chat.prompt(F.col("kind"), F.col("text"), chat.context_text(F.col("contexts")), chat.citations(F.col("contexts")), F.col("last_user"), F.col("last_assistant")).alias("prompt"))


_VECTOR = lambda c: f"[{', '.join(b.replace('md5(text)', f'md5({c})') for b in _BYTES)}]::DOUBLE[]"


@query(f"""WITH {_HISTORY}, t AS ({_CLASSIFY}),
q AS MATERIALIZED (SELECT h.conv_id || '-' || h.turn AS query_id, h.text, h.last_user, h.last_assistant, t.query_type, {_VECTOR("h.text")} AS v FROM h JOIN t ON h.conv_id = t.conv_id AND h.turn = t.turn WHERE h.role = 'user'),
d AS MATERIALIZED (SELECT doc_id::VARCHAR AS id, text, source, lang, {_VECTOR("text")} AS v FROM documents),
s AS (SELECT q.query_id, d.id, d.text, d.source, d.lang, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 6) AS score FROM q, d WHERE trim(q.text) <> ''),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 3 AND score >= 0.3),
c AS (SELECT query_id, count(*) AS used, max(score) AS best, first(text ORDER BY n) AS passage,
  string_agg('[Context ' || n || '] (Score: ' || printf('%.2f', floor(score * 100 + 0.5 + 1e-7) / 100) || ')' || chr(10) || 'Source: ' || coalesce(source, 'None') || chr(10) || 'Section: ' || coalesce(lang, '') || chr(10) || 'Content: ' || text || chr(10), chr(10) ORDER BY n) AS context,
  string_agg(coalesce(source, '') || ' (' || coalesce(lang, '') || ')', chr(10) ORDER BY n) FILTER (score >= 0.5) AS cited FROM r GROUP BY query_id),
p AS (SELECT q.query_id, q.text, last_user, last_assistant, query_type, coalesce(used, 0)::INTEGER AS contexts_used, passage, coalesce(context, '') AS context, coalesce(cited, '') AS cited,
  CASE WHEN best >= 0.7 THEN 'high' WHEN best >= 0.5 THEN 'medium' WHEN best >= 0.3 THEN 'low' ELSE 'none' END AS quality FROM q LEFT JOIN c USING (query_id)),
k AS (SELECT *, CASE query_type WHEN 'new' THEN CASE quality WHEN 'high' THEN 'answer' WHEN 'none' THEN 'no_context' ELSE 'answer_with_care' END
  WHEN 'followup' THEN CASE WHEN quality IN ('high', 'medium') THEN 'follow_up' ELSE 'follow_up_no_context' END ELSE 'clarify' END AS prompt_kind FROM p)
SELECT query_id, query_type, quality, prompt_kind, contexts_used, cited, md5(CASE prompt_kind {" ".join(f"WHEN '{k}' THEN {_LAY.join(v)}" for k, v in _TEMPLATES.items())} END) AS prompt,
 md5(coalesce(passage, 'No passage answers this.')) AS answer, false AS fallback_used FROM k""")
def answer_questions(spark, sf_dir):
    """All questions of the conversations, answered from the documents by the offline provider."""
    asked = chat.classify_turns(_read(spark, sf_dir, "conversations")).drop("query_type").withColumn("query_id", F.concat_ws("-", "conv_id", "turn"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", V.md5_embedding(F.col("text"), 64).alias("embedding"), F.col("source").alias("source_file"), F.array("lang").alias("hierarchy"))
    found = search.search_texts(docs, asked, lambda text: V.md5_embedding(text, 64), 3).where(F.col("score") >= chat.THRESHOLD)
    done = answer.answered(answer.prompted(asked, answer.gather(found, docs)), answer.PROVIDERS.get("extractive"))
    return done.select("query_id", "query_type", "quality", "prompt_kind", "contexts_used", F.array_join("citations", "\n").alias("cited"), F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"), "fallback_used")
