"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import centroid_clustering, chat, embedding_dedup, mixing, near_duplicates, quality_model, quality_rules, ranking_ties, secrets, sentencepiece_codec, substring_dedup, suffix_dedup, topk_search
from weftline.llm.common import documents


def piece_model() -> str:
    """The model that op1 encodes with; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(documents(spark, sf_dir, "doc_id", "text"), piece_model())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir, "doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.score(documents(spark, sf_dir, "doc_id", "text"), labels)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir, "doc_id", "text"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir, "doc_id", "text", "source"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT -7L AS conv_id, t.* FROM VALUES (0L, 'user', :said), (1L, 'assistant', :said) AS t(turn, role, text)", args={"said": said})
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.examples(turns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir, "doc_id", "text"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, sf_dir, "doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(documents(spark, sf_dir, "doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking_ties.rank_lines(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), k=2)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_ranking_ties": op12_ranking_ties,
    "op13_embedding_dedup": op13_embedding_dedup,
}

FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds one after another; the least of 64 x distance + number gives both."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {FINE} AND len(embedding) = 64)",
        f"s0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, e FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v.e, CAST(min(64 * (list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, s.e) + list_dot_product(s.e, s.e)) + c) AS BIGINT) AS m FROM v CROSS JOIN s{i} s GROUP BY vec_id, v.e)")
        if i < rounds:
            ctes.append(f"n{i} AS (SELECT c, list(x ORDER BY pos) AS e FROM (SELECT c, pos, floor(sum(x) / count(*)) AS x FROM (SELECT m % 64 AS c, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY c, pos) GROUP BY c)")
            ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT s.c, coalesce(n.e, s.e) AS e FROM s{i} s LEFT JOIN n{i} n ON n.c = s.c)")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance, CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia, CAST(sum(m // 64) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(s.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN s{rounds} s ON s.c = m % 64
"""

ORACLES: dict[str, str] = {
    "op6_chat_formatting": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + 2 * length(regexp_replace(text, '[^%<\[\]]', '', 'g')) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
    ELSE 14 + length(role) + 2 * length(regexp_replace(role, '[^%<\[\]]', '', 'g')) END AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM said
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
""",
    "op7_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), g AS (
  SELECT doc_id, pos, md5(concat_ws(' ', word, """
    + ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 20))
    + r""")) AS h, lead(word, 19) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM g WHERE whole
), later AS (
  SELECT doc_id, pos AS first, pos + 19 AS last FROM ranked WHERE n > 1
), flagged AS (
  SELECT w.*, coalesce(max(l.last) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS UNBOUNDED PRECEDING), 0) >= w.pos AS gone
  FROM w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.first = w.pos
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM flagged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_centroid_clustering": _clustering_sql(),
    "op12_ranking_ties": r"""
WITH id AS (
  SELECT sale_id, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)
), pooled AS (
  SELECT sale_id FROM id WHERE xor(crc, 4294967295) % 5 = 0
), line AS (
  SELECT CASE WHEN p.sale_id IS NOT NULL THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN p.sale_id IS NOT NULL THEN -1 ELSE coalesce(item_id % 5, -1) END AS part,
    CASE WHEN p.sale_id IS NOT NULL THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
    l.sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
    CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents, floor(quantity / 10) AS tens
  FROM sale_lines l LEFT JOIN pooled p ON p.sale_id = l.sale_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM line
)
SELECT vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranked WHERE pos <= 2
""",
    "op13_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE {FINE} AND label IS NOT NULL
), u AS MATERIALIZED (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0
), arc AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93 END
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, arc.y FROM reach r JOIN arc ON arc.x = r.other
), class AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), degree AS (
  SELECT x, count(*) AS n FROM arc GROUP BY x
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN class ON id = e.vec_id LEFT JOIN degree ON x = e.vec_id
""",
    "op9_near_duplicates": r"""
WITH RECURSIVE node AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS least, count(*) AS n_copies, row_number() OVER (ORDER BY min(doc_id)) AS id FROM documents GROUP BY 1
), said AS (
  SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM node
), shingle AS (
  SELECT DISTINCT id, array_to_string(words[pos:pos + 4], ' ') AS g FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM said WHERE len(words) > 0)
), size AS (
  SELECT id, count(*) AS n FROM shingle GROUP BY id
), pair AS (
  SELECT a.id AS x, b.id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN size s ON s.id = x JOIN size t ON t.id = y WHERE 5 * shared >= 4 * (s.n + t.n - shared)
), arc AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(id, other) AS (
  SELECT id, id FROM node UNION SELECT r.id, arc.y FROM reach r JOIN arc ON arc.x = r.other
), class AS (
  SELECT r.id, min(n.least) AS class_id FROM reach r JOIN node n ON n.id = r.other GROUP BY r.id
), degree AS (
  SELECT x AS id, count(*) AS n_links FROM arc GROUP BY x
)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM documents d JOIN node ON t = coalesce(d.text, '') JOIN class USING (id) LEFT JOIN degree USING (id)
""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(lines) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper FROM d
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), g AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1
), gaps AS (
  SELECT doc_id, least(5, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -5)) AS adds FROM twice
), r AS (
  SELECT doc_id, sum(adds) AS n FROM gaps GROUP BY doc_id
), v AS (
  SELECT m.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR word_chars > 25 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR (word_chars >= 40 AND 2 * n_upper > word_chars)) AS kept
FROM b
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
