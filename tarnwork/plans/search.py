"""Registered queries for search and its evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import search as S
from tarnwork.operators.evaluation import best_per_file, counted_metrics, mean_metrics
from tarnwork.session import cut, once, spread, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def lexical_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The weighted postings of the documents with their kind, and the idf of each term, built once a session and folder."""
    rows = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "doc_kind"))
    return once(spark, f"lexical:{d}", lambda: S.lexical_index(rows, "id", "text", ["doc_kind"]))


def _sparse(spark: SparkSession, d: str, queries: DataFrame, k: int, shared: bool = False) -> DataFrame:
    weights, idf = lexical_index(spark, d)
    return S.sparse(queries, weights, k, idf=idf, shared=shared)


def search_dense(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return S.dense(_asked(rows), rows, 10).select("query_id", "id", "score", "rank")


def search_dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only rows with the query's own label."""
    rows = _vectors(spark, d)
    return S.dense(_asked(rows), rows, 10, filters=["label"]).select("query_id", "id", "score", "rank")


def search_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the list index against the exact search, per query."""
    rows = _vectors(spark, d).select("id", "vector")
    index, centres = S.ivf_index(rows, lists=16)
    found = S.ivf_search(_asked(rows), cut(index), centres, 10, probes=12)
    exact = S.dense(_asked(rows), rows, 10)
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def search_sparse(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d)
    return _sparse(spark, d, _asked(rows), 10).select("query_id", "id", "score", "rank")


def _both(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "doc_kind")
    return rows.join(_vectors(spark, d).drop("label"), "id", "left")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = _both(spark, d)
    weights, idf = lexical_index(spark, d)
    return S.hybrid(_asked(rows), rows, weights, 10, idf=idf).select("query_id", "id", "score", "rank")


def search_sparse_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only rows of the query's own kind."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "doc_kind")
    weights, idf = lexical_index(spark, d)
    return S.search(_asked(rows), rows, weights, channel="sparse", filters=["doc_kind"], idf=idf).select("query_id", "id", "score", "rank")


def search_code(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: both channels within the query's own kind, fused, the 50 best ranked anew, 10 given."""
    rows = _both(spark, d)
    weights, idf = lexical_index(spark, d)
    hits = S.search(_asked(rows), rows, weights, idf=idf, top_k=10, candidates=50, filters=["doc_kind"], reranked=True)
    return hits.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best of the lexical channel in the order of their word overlap, best 10."""
    rows = _texts(spark, d)
    hits = _sparse(spark, d, _asked(rows), 50, shared=True)
    return S.rerank(hits, _asked(rows), rows, 10).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = S.corpus_stats(cut(S.postings(_texts(spark, d), "id", "text")))
    return stats.select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval quality of the lexical channel: relevant are rows of the query's project and kind, categories are kinds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "project_id", "doc_kind")
    kin = ["project_id", "doc_kind"]
    asked = docs.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    classes = docs.where("project_id IS NOT NULL AND doc_kind IS NOT NULL").groupBy(*kin).agg(F.count("*").alias("relevant"))
    counts = asked.join(classes, kin).select("query_id", F.col("doc_kind").alias("category"), "relevant")
    hits = _sparse(spark, d, asked.select("query_id", "text"), 10).select("query_id", "id", "rank")
    found = hits.join(docs.select("id", *kin), "id").join(asked.select("query_id", *kin), ["query_id", *kin]).select("query_id", "rank")
    return mean_metrics(counted_metrics(counts, found)).select(F.coalesce("category", F.lit("all")).alias("category"), "queries", "recall_5", "recall_10", "ndcg_10")


def best_rank_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the lexical channel deduplicated to the best rank per source."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("source", F.lit("")).alias("file")))
    hits = _sparse(spark, d, _asked(docs), 50).join(docs.select("id", "file"), "id")
    return best_per_file(hits).select("query_id", "file", "rank")


_W = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_BM25 = f"""
WITH tok AS (SELECT doc_id AS id, {_W} AS w FROM documents),
post AS (SELECT term, id, len AS doc_len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(l) AS a FROM (SELECT id, max(doc_len) AS l FROM post GROUP BY id)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
wt AS (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / a)) AS weight FROM post JOIN dfs USING (term), st),
q AS (SELECT id AS query_id, unnest(list_distinct(w)) AS term FROM tok WHERE id % 100 = 0),
sc AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM q JOIN wt USING (term) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
"""
_COS = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"
_DENSE = "SELECT a.vec_id AS query_id, b.vec_id AS id, {cos} AS score FROM {q} a, embeddings b WHERE a.vec_id % 100 = 0 {more}"
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({0}) QUALIFY rank <= {1}"

QUERIES = {
    "search_dense": search_dense, "search_dense_filtered": search_dense_filtered, "search_ivf_recall": search_ivf_recall, "search_sparse": search_sparse, "search_hybrid": search_hybrid,
    "search_reranked": search_reranked, "search_sparse_filtered": search_sparse_filtered, "search_code": search_code, "corpus_stats": corpus_stats, "eval_metrics": eval_metrics, "best_rank_per_source": best_rank_per_source,
}
_KIND = """, kh AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = id WHERE a.doc_kind IS NOT DISTINCT FROM b.doc_kind)"""
_OVERLAP = "round(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(a.w))::DOUBLE, 6)"
SQL = {
    "search_sparse_filtered": _BM25 + _KIND + "SELECT query_id, id, score, rank FROM kh WHERE rank <= 10",
    "search_code": _BM25
    + _KIND
    + f""", e AS (SELECT vec_id, embedding, doc_kind FROM embeddings JOIN documents ON doc_id = vec_id),
dn AS ({_TOP.format(_DENSE.replace("embeddings b", "e b").format(cos=_COS, q="e", more="AND a.doc_kind IS NOT DISTINCT FROM b.doc_kind"), 50)}),
u AS (SELECT query_id, id, rank FROM dn UNION ALL SELECT query_id, id, rank FROM kh WHERE rank <= 50),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS old FROM fu QUALIFY old <= 50),
o AS (SELECT query_id, fr.id, old, coalesce(CASE WHEN len(a.w) > 0 THEN {_OVERLAP} END, 0) AS rerank_score FROM fr JOIN tok a ON a.id = query_id JOIN tok b ON b.id = fr.id)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM o QUALIFY rank <= 10""",
    "search_dense": _TOP.format(_DENSE.format(cos=_COS, q="embeddings", more=""), 10),
    "search_dense_filtered": _TOP.format(_DENSE.format(cos=_COS, q="embeddings", more="AND a.label = b.label"), 10),
    "search_sparse": _BM25 + "SELECT query_id, id, score, rank FROM hits WHERE rank <= 10",
    "search_hybrid": _BM25
    + f""", e AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
dn AS ({_TOP.format(_DENSE.format(cos=_COS, q="e", more="AND b.vec_id IN (SELECT doc_id FROM documents)"), 50)}),
u AS (SELECT query_id, id, rank FROM dn UNION ALL SELECT query_id, id, rank FROM hits WHERE rank <= 50),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 10""",
    "search_reranked": _BM25
    + """, o AS (SELECT h.query_id, h.id, h.rank AS old, round(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(a.w))::DOUBLE, 6) AS rerank_score
  FROM hits h JOIN tok a ON a.id = h.query_id JOIN tok b ON b.id = h.id WHERE h.rank <= 50)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM o QUALIFY rank <= 10""",
    "corpus_stats": _BM25 + "SELECT term, df, n AS n_docs, round(a, 6) AS avg_len FROM dfs, st",
    "eval_metrics": _BM25
    + """, lab AS (SELECT a.doc_id AS query_id, a.doc_kind AS category, b.doc_id AS id FROM documents a JOIN documents b ON a.project_id = b.project_id AND a.doc_kind = b.doc_kind WHERE a.doc_id % 100 = 0),
m AS (SELECT lab.query_id, category, count(*) AS rel, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg
  FROM lab LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h ON h.query_id = lab.query_id AND h.id = lab.id GROUP BY ALL),
x AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= rel) AS ideal FROM m)
SELECT coalesce(category, 'all') AS category, count(*) AS queries, round(avg(h5 / rel::DOUBLE), 6) AS recall_5, round(avg(h10 / rel::DOUBLE), 6) AS recall_10, round(avg(dcg / ideal), 6) AS ndcg_10 FROM x GROUP BY ROLLUP (category)""",
    "best_rank_per_source": _BM25
    + """SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY b, file) AS rank FROM (
  SELECT query_id, coalesce(source, '') AS file, min(rank) AS b FROM hits JOIN documents ON doc_id = id WHERE rank <= 50 GROUP BY ALL)""",
}
