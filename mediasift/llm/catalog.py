"""The queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_windows, exact_dedup, hamming_search, language_id, merkle_manifest, mixing, near_dedup, quality, shallot_clusters, suffix_dedup, toxicity, url_filters
from .shared import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op5_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


@query("op7_hamming_topk", """
WITH c AS (
  SELECT vec_id AS id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.id AS query_id, c.id, bit_count(xor(q.code, c.code)) AS distance FROM c AS q JOIN c ON q.id <> c.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
""")
def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.top_k(rows, rows.where("id % 20 = 0"), k=10)


@query("op9_source_mixing", """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n) OVER () / n AS rate FROM n),
k AS (SELECT source, rate, i, CASE WHEN i = 0 THEN 0.0 ELSE ln(i) END AS ln_i FROM r, range(0, 1000) AS t(i) WHERE i <= ceil(rate + 10 * sqrt(rate) + 40)),
s AS (SELECT source, rate, i, exp(-rate + i * ln(rate) - sum(ln_i) OVER (PARTITION BY source ORDER BY i)) AS p FROM k),
c AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM s),
steps AS (SELECT source, list(cdf ORDER BY i) AS steps FROM c GROUP BY source),
u AS (SELECT doc_id, source, text, ('0x' || md5('mix|' || coalesce(doc_id::VARCHAR, ''))[:13])::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT doc_id, u.source, text, len(list_filter(steps, lambda x: x <= u)) AS n FROM u JOIN steps ON u.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, unnest(range(0, n))::INTEGER AS copy FROM m WHERE n > 0
""")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(documents(spark, sf_dir), temperature=0.5)
    return mixed.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.col("_copy").alias("copy"))


# (host, path, decision): the rules of the contract, fixed values.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op10_url_filters", r"""
WITH d AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
                               lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS kept
  FROM pages),
k AS (SELECT *, CASE WHEN host = '' THEN ':' || coalesce(url, '') ELSE regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS component FROM d),
rules(h, p, decision) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(decision, length(h || p)) AS decision
      FROM (SELECT DISTINCT host, path FROM k) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
j AS (SELECT k.*, f.rule, f.decision FROM k LEFT JOIN f ON k.host = f.host AND k.path = f.path)
SELECT page_id, host, path, rule, coalesce(decision, min(decision) OVER (PARTITION BY component), 'allow') AS verdict, component FROM j
""")  # no page of the given tables states a canonical link or a redirect, so a component is a page key here
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, decision string")
    return url_filters.judge_urls(pages, rules, url_filters.page_links(pages))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_file())


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text")


def labels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col(kind).alias("label"))


def toxicity_field(docs: DataFrame, sf_dir: str) -> toxicity.Field:
    """Learned from the labelled rows outside fold 0 of 5."""
    labelled = labels(docs.sparkSession, sf_dir, "toxic").where(fold(F.col("id"), 5) != 0)
    return toxicity.fit(id_and_text(docs), labelled)


@query("op2_toxicity_crf")
def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_field(docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")).where(fold(F.col("id"), 5) != 0)
    predicted = language_id.predict(docs, language_id.fit(id_and_text(docs), labelled))
    return predicted.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op8_quality_attention")
def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = labels(spark, sf_dir, "quality").where(fold(F.col("id"), 3) != 1)
    scored = quality.score(docs, quality.fit(id_and_text(docs), labelled))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "passages", "top_passage")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query("op12_merkle_manifest", r"""
WITH RECURSIVE
f AS (SELECT doc_id, lang, text,
        CASE WHEN doc_id IS NULL THEN '-' ELSE len(doc_id::VARCHAR) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
        || CASE WHEN n_chars IS NULL THEN '-' ELSE len(n_chars::VARCHAR) || ':' || n_chars END AS head FROM documents),
-- crc32 bit by bit: every character of the decimal id, then eight shifts
c AS (SELECT f.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda x: list_prepend(ascii(x)::UBIGINT, list_transform(range(8), lambda i: 999::UBIGINT))))),
        lambda a, b: CASE WHEN b < 999 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT) AS crc FROM f),
t AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS changed
      FROM c),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM t),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, max(level) + 1 AS level, pos // 8 AS pos, (max(n) + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM nodes WHERE n > 1 GROUP BY tree, pos // 8),
subs AS (SELECT tree, level AS height, digest AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subs) AS n, subroot AS digest FROM subs
  UNION ALL
  SELECT max(level) + 1 AS level, pos // 8 AS pos, (max(n) + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM tops WHERE n > 1 GROUP BY pos // 8),
r AS (SELECT digest AS root FROM tops WHERE n = 1),
-- every node a leaf meets on its way, lowest first: levels of its tree, then levels of the top tree
every AS (SELECT tree, level, pos, digest FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, pos, digest FROM tops WHERE n > 1),
way AS (
  SELECT l.doc_id, l.tree, l.leaf, l.pos AS home, l.pos AS own, 0 AS level, coalesce(changed, leaf) AS digest, '' AS proof, l.n, l.tree AS walk FROM l
  UNION ALL
  SELECT doc_id, tree, leaf, home, own // 8, level + 1, sha256(run), proof || others, (n + 7) // 8, walk FROM (
    SELECT w.doc_id, w.tree, w.leaf, w.home, w.own, w.level, w.proof, w.n, w.walk,
           string_agg(CASE WHEN e.pos = w.own THEN w.digest ELSE e.digest END, '' ORDER BY e.pos) AS run,
           coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (WHERE e.pos <> w.own), '') AS others
    FROM way AS w JOIN every AS e ON e.tree = w.walk AND e.level = w.level AND e.pos // 8 = w.own // 8 WHERE w.n > 1
    GROUP BY ALL)),
half AS (SELECT * FROM way WHERE n = 1),
up AS (
  SELECT h.tree, h.home, h.leaf, h.doc_id, h.tree AS own, 0 AS level, h.digest, h.proof, (SELECT count(*) FROM subs) AS n FROM half AS h
  UNION ALL
  SELECT tree, home, leaf, doc_id, own // 8, level + 1, sha256(run), proof || others, (n + 7) // 8 FROM (
    SELECT w.tree, w.home, w.leaf, w.doc_id, w.own, w.level, w.proof, w.n,
           string_agg(CASE WHEN e.pos = w.own THEN w.digest ELSE e.digest END, '' ORDER BY e.pos) AS run,
           coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (WHERE e.pos <> w.own), '') AS others
    FROM up AS w JOIN every AS e ON e.tree = -1 AND e.level = w.level AND e.pos // 8 = w.own // 8 WHERE w.n > 1
    GROUP BY ALL))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM up JOIN subs USING (tree), r WHERE up.n = 1
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by crc32 of its id) is tampered with: the letters A-Z of its text become small."""
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.unhex(merkle_manifest.leaf_digest(*fields, small)))
    manifest = merkle_manifest.build(docs, F.col("lang"), F.col("doc_id"), merkle_manifest.leaf_digest(*fields, F.col("text")), {"tampered": tampered})
    shown = F.coalesce(merkle_manifest.hex_text(F.col("tampered")), F.col("leaf"))
    proved = merkle_manifest.proofs(manifest).withColumn("root", F.lit(manifest.root).cast("string"))
    folded = proved.withColumn("folded_root", merkle_manifest.fold(shown, F.col("path")))
    return folded.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.path_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lloyd_sql(k: int, rounds: int, prefix: str) -> str:
    """DuckDB SQL of :func:`op11_shallot_clusters`: every round as a view of its own."""
    views = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{prefix}' || vec_id), v) - 1)::INTEGER AS c, v AS m FROM v ORDER BY c LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        views.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, min((d, c)) AS best FROM (
            SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY vec_id, v)""")
        if i < rounds:
            views.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} AS o LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
              SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)
            GROUP BY c) AS n ON o.c = n.c)""")
    return f"""WITH {', '.join(views)}
    SELECT vec_id, c AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON best[2] = c"""


@query("op11_shallot_clusters", lloyd_sql(40, 5, "2:"))
def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return shallot_clusters.clusters(vectors, "vec_id", "embedding", k=40, rounds=5, prefix="2:").withColumnRenamed("id", "vec_id")


@query("op13_chat_windows")
def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    windows = chat_windows.chat_windows(turns.unionAll(extra), budget=512, history=128, tokenizer=tokenizer_file("byte_bpe_50k.json"))
    return chat_windows.read_back(windows).withColumnRenamed("conv", "conv_id")
