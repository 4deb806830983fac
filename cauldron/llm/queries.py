"""The registered queries of the training-data operators and their SQL (where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cauldron.sources.tables import read_table

from . import (
    htmltext, langid, mixing, packing, quality, reversed_search, simhash, substring, tokencount, topk, toxicity, urlfilter, vectorcode,
)


BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Where the installed vocabulary file is; the same on every machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


def op4_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    unseen = langid.held_out(3, 1)
    model = toxicity.fit(docs.where(~unseen), read_table(spark, sf_dir, "labels").where(~unseen))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", unseen.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP5_SQL = """
WITH usable AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), length=1024, end_id=2)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read_table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), repeats=2)
    shards = F.array_sort(F.array_distinct(F.col("pieces.shard")))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, filters).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), items AS (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), size AS (
    SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM docs WHERE len(terms) > 0
), held AS (
    SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM items) GROUP BY d, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * (SELECT docs FROM size) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held GROUP BY term
), asked AS (
    SELECT i, item_id, term, count(*) AS times FROM items GROUP BY i, item_id, term
), scored AS (
    SELECT i, item_id, d, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * size.docs) // size.length))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN docs USING (d) CROSS JOIN size
    GROUP BY i, item_id, d, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: The contract's rules (fixed values): host, path, action.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), rules)


OP12_SQL = """
WITH cut AS (
    SELECT row_number() OVER () AS n, page_id,
           CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT n, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
    FROM cut
), rules(host, path, action) AS (
    VALUES """ + ", ".join(str(rule) for rule in URL_RULES) + """
), best AS (
    SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.encode(read_table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = vectorcode.ROUNDS) -> str:
    """Lloyd's rounds spelt out over (row, part, position, component); for vectors of one length."""
    ctes = ["""usable AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
)""", """cells AS MATERIALIZED (
    SELECT n, (i - 1) // (len(v) // 8) AS p, (i - 1) % (len(v) // 8) AS i, v[i] AS c
    FROM (SELECT n, v, unnest(range(1, len(v) + 1)) AS i FROM usable)
)""", "books0 AS MATERIALIZED (SELECT p, n - 1 AS e, i, c FROM cells WHERE n <= 16)"]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
    SELECT n, p, arg_min(e, away * 16 + e) AS e, min(away) AS away
    FROM (SELECT x.n, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS away FROM cells x JOIN books{r} b USING (p, i) GROUP BY ALL)
    GROUP BY n, p
)""")
        if r < rounds:
            ctes.append(f"""books{r + 1} AS MATERIALIZED (
    SELECT p, e, i, CAST(coalesce(m.c, b.c) AS BIGINT) AS c
    FROM books{r} b LEFT JOIN (
        SELECT p, e, i, (s - ((s % n) + n) % n) // n AS c
        FROM (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM cells JOIN near{r} USING (n, p) GROUP BY p, e, i)
    ) m USING (p, e, i)
)""")
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (
    SELECT n, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{rounds} GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM books{rounds}) AS codebooks_sha256
FROM coded JOIN usable USING (n)
"""


QUERIES = {q.__name__: q for q in (
    op1_isolation_rules, op2_substring_dedup, op3_simhash_vptree, op4_toxicity_bigru, op5_threshold_topk,
    op6_token_counts, op7_best_fit_packing, op8_mix_sources, op9_text_density, op10_language_bitmask,
    op11_reversed_search, op12_url_filters, op13_vector_codes)}
#: The others have no SQL: trained models, trees, XXH64, BPE, HTML and hash-drawn mixes; tests/llm holds them to plain versions.
ORACLE_SQL: dict[str, str] = {
    "op5_threshold_topk": OP5_SQL, "op11_reversed_search": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_vector_codes": _op13_sql()}
