"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, decontaminate, forest, langid, lexical, licenses, neardup, packing, suffix, topk, toxicity, urlfilter, whitening
from corpuslens.llm.common import held_out, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), added=packing.added_tokens())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by cosine, of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts' token ids and of what they decode to."""
    return bpe.digest_round_trip(table(spark, sf_dir, "documents"), bpe.ranks_file())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the bytes that repeated strings of 200 bytes cover."""
    return suffix.strip_repeats(table(spark, sf_dir, "documents"), 200)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all texts."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all texts."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs), keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licence, if any, that each text as a whole is."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, 256.0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity 0.85."""
    return neardup.link(table(spark, sf_dir, "documents"), 3, 85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the leading components of their covariance, each of variance one."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that stand in windows of ten words of benchmark items."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_nearest_neighbours, op3_byte_bpe, op4_suffix_dedup, op5_url_filters, op6_toxicity, op7_language_id, op8_license_scans, op9_exact_top_k, op10_minhash_near_dedup, op11_embedding_whitening, op12_ranked_search, op13_decontamination)}


def _license_sql() -> str:
    def form(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
        out = f"regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g')"
        for found, kept in licenses.SPELLINGS:
            out = f"replace({out}, '{found}', '{kept}')"
        return out

    def whole(lines: str) -> str:
        return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.LICENSES.items()))
    one_line = "text NOT LIKE '%' || chr(10) || '%' AND length(text) < 200"
    return f"""
WITH listed(license, text) AS (VALUES {rows}),
known AS (SELECT md5({whole(form('text'))}) AS digest, min(license) AS license FROM listed GROUP BY 1),
notices AS (SELECT list(DISTINCT {whole(form('text'))}) AS forms FROM listed WHERE {one_line}),
formed AS (SELECT doc_id, {form('text')} AS lines FROM documents)
SELECT doc_id, md5({whole('lines')}) AS digest, license,
       CAST(len(list_filter(string_split(lines, chr(10)), lambda x: list_contains(forms, trim(x)))) AS BIGINT) AS n_notice_lines
FROM formed CROSS JOIN notices LEFT JOIN known ON known.digest = md5({whole('lines')})"""


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, html,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best"""

TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
docs AS (SELECT r, doc_id, len(terms) AS n, terms FROM split WHERE len(terms) > 0),
total AS (SELECT count(*) AS many, sum(n) AS length FROM docs),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(many) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
lengths AS (SELECT r, doc_id, 75 + CAST((25 * n * many) // length AS BIGINT) AS m FROM docs, total),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""

_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
items AS (SELECT item_id, words, least(10, len(words)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[i + 1 : i + n], ' ') AS w FROM (SELECT item_id, words, n, unnest(range(len(words) - n + 1)) AS i FROM items)),
places AS (
  SELECT r, p, n, array_to_string(words[p + 1 : p + n], ' ') AS w
  FROM (SELECT r, words, n, unnest(range(len(words) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
hits AS (SELECT DISTINCT r, p, n, item_id FROM places JOIN windows USING (n, w)),
words_hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT r, p, unnest(range(n)) AS o FROM hits) GROUP BY r),
items_hit AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)"""

#: URL_SQL has no alias edges: it holds where the pages have no canonical or refresh link, as in the given tables.
ORACLE_SQL = {"op5_url_filters": URL_SQL, "op8_license_scans": _license_sql(), "op9_exact_top_k": TOP_K_SQL, "op12_ranked_search": SEARCH_SQL, "op13_decontamination": LEAKS_SQL}
