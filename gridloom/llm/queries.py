"""The registered queries of the corpus operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, packing, token_store
from gridloom.llm.common import shared_dir
from gridloom.llm.embedding_dedup import near_vectors
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.line_dedup import remove_boilerplate
from gridloom.llm.minhash_dedup import near_duplicates
from gridloom.llm.mixing import mix_sources
from gridloom.llm.phrases import mine_phrases
from gridloom.llm.spelling import count_words, group_variants
from gridloom.llm.substring_dedup import repeated_passages
from gridloom.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL query: host, path prefix, verdict (fixed values of its contract).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rh, rp, v) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'),
                           ('net','/es/','block'), ('net','/fr/','block')
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT q.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

MIX_WEIGHTS = [5, 2, 1]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets, pieces = mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    taken = pieces.groupBy(F.col("doc_id").alias("d"), F.col("copy").alias("c")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    src = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (
        docs.join(src, docs["source"].eqNullSafe(src["s"]))
        .join(taken, docs["doc_id"].eqNullSafe(taken["d"]) & (docs["copy"] == taken["c"]), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s
), r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w
), q AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0) AS done, coalesce(sum(weight) OVER o, 0) AS done_weight
  FROM r WINDOW o AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, (all_size - done)::DOUBLE / (all_weight - done_weight)::DOUBLE AS lv FROM q
), t AS (
  SELECT source, source_size, cap, least(cap::DOUBLE, weight * (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, place LIMIT 1)) AS target FROM l
), u AS (SELECT *, least(cap, floor(target + 0.5)::BIGINT) AS quota FROM t
), p AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
            + greatest(0, least(pos + size, quota % source_size) - pos) END::BIGINT AS taken
FROM p
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.pmod(F.crc32(name.cast("binary")), F.lit(4)) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(
        table(spark, sf_dir, "documents"), shared_dir(spark), vocabulary("word_bpe_49k.json"), end_id=1, vocabulary_size=49408
    )
    return token_store.read_store(spark, path, digest=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048, vocabulary_size=50257)
    return placed


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.75, k=5)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), s AS (SELECT doc_id, md5_number_lower(g) AS h FROM g
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS rep FROM (SELECT doc_id, bit_xor(h) || ':' || sum(h % 1000000007) || ':' || count(*) AS p FROM s GROUP BY doc_id)
), t AS (SELECT s.doc_id, h, n FROM s JOIN k ON k.doc_id = s.doc_id AND rep = s.doc_id JOIN n ON n.doc_id = s.doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, doc_id FROM k WHERE rep <> doc_id UNION SELECT doc_id, rep FROM k WHERE rep <> doc_id
), r AS (
  SELECT doc_id AS node, doc_id AS lead FROM documents UNION SELECT e.b, r.lead FROM r JOIN e ON e.a = r.node WHERE r.lead < e.b
), c AS (SELECT node, min(lead) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), s AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_sum(list_transform(e, lambda y: y * y)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS lead FROM embeddings UNION SELECT l.b, r.lead FROM r JOIN l ON l.a = r.node WHERE r.lead < l.b
), c AS (SELECT node, min(lead) AS component_id FROM r GROUP BY node
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line, coalesce('+' || source, '-') AS site FROM documents
), b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts,
         (SELECT list(line) FROM b) AS gone FROM documents
), k AS (SELECT doc_id, parts, list_filter(parts, lambda x: NOT coalesce(list_contains(gone, trim(x, ' ')), false)) AS rest FROM d
)
SELECT doc_id, len(list_filter(parts, lambda x: trim(x, ' ') <> ''))::BIGINT AS n_lines, (len(parts) - len(rest))::BIGINT AS n_removed,
       sha256(array_to_string(rest, chr(10))) AS clean_sha256 FROM k
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), threshold=0.75, words=50)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents"), every=97), ratio=2)


OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), o AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS c FROM t WHERE length(run) >= 5 GROUP BY doc_id, run
), b AS (
  SELECT run, c, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM o
), h AS (
  SELECT run, c, xor(4294967295::BIGINT, list_reduce(b, lambda x, y: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda z, k: CASE WHEN z % 2 = 1 THEN xor(3988292384::BIGINT, z // 2) ELSE z // 2 END, xor(x, y)), 4294967295::BIGINT)) AS h FROM b
), e AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h
), w AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), r AS (SELECT word, n, left(word, (i - 1)::INT) || '*' || substr(word, i + 1) AS k, left(word, (i - 1)::INT) || substr(word, i + 1) AS d FROM p
), l AS (
  SELECT x.word AS a, y.word AS b, y.n AS bn FROM r x JOIN r y ON x.k = y.k AND x.word <> y.word
  UNION ALL SELECT r.word, w.word, w.n FROM (SELECT DISTINCT word, d FROM r) r JOIN w ON r.d = w.word
  UNION ALL SELECT w.word, r.word, r.n FROM (SELECT DISTINCT word, n, d FROM r) r JOIN w ON r.d = w.word
), g AS (SELECT a, count(*) AS n_near, max(bn) AS m FROM l GROUP BY a
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN (SELECT min(b) FROM l WHERE l.a = w.word AND l.bn = g.m) END AS form,
         CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN g ON g.a = w.word
), c(word, here, k) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, (SELECT arg_max(here, k) FROM c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), most=3, least=10, cover=50, first=2000)


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w, count(*) AS c FROM p GROUP BY lang, p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, c
  FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k
), f AS (SELECT lang, k, g, sum(c)::BIGINT AS f FROM g GROUP BY lang, k, g
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, g, string_split(g, ' ') AS s, f AS a FROM f WHERE k > 1 AND f >= 10
), o AS (
  SELECT lang, g, max(a) AS longer FROM (SELECT lang, array_to_string(s[1:2], ' ') AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(s[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, g
), x AS (SELECT lang, g, a, k, s, unnest(range(1, k)) AS i FROM c
), y AS (SELECT lang, g, a, i, array_to_string(s[1:i], ' ') AS before, array_to_string(s[i + 1:k], ' ') AS behind FROM x
), t AS (
  SELECT y.lang, y.g, a, i, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM y JOIN f l ON l.lang = y.lang AND l.g = before JOIN f r ON r.lang = y.lang AND r.g = behind
), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1
), k AS (
  SELECT b.lang, b.g AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, pattern, lone_space_begins=True), ranks)
    return decoded.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_bpe_codec": op13_bpe_codec,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op3_minhash_dedup": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_phrase_mining": OP12_SQL,
    "op9_embedding_dedup": OP9_SQL,  # exact: labels of up to 2048 vectors lose no link
}
