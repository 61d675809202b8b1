"""The search index of a corpus as one thing: vectors and BM25 tables, written, read and searched together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import lexical
from gristmill.operators.fusion import fuse, top
from gristmill.operators.vector import nearest


class SearchIndex:
    """``write`` lays down the tables of a corpus (id, framework_name, tokens, embedding) in a folder, ``SearchIndex(spark, folder)`` reads them again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.vectors = folder, spark.read.parquet(f"{folder}/vectors")
        self.postings = lexical.read_index(spark, folder)

    @classmethod
    def write(cls, chunks: DataFrame, folder: str) -> SearchIndex:
        """Vectors, postings and statistics, replaced as a whole; chunks without a vector are found by their words alone."""
        chunks.filter(F.col("embedding").isNotNull()).select("id", "framework_name", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")
        lexical.write_index(chunks.select("id", "tokens"), folder)
        return cls(chunks.sparkSession, folder)

    def bm25(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank): only the postings of the query terms are read."""
        return lexical.index_top_k(queries, self.postings, k)

    def hybrid(self, queries: DataFrame, k: int = 5, method: str = "rrf", over_fetch: int = 2, **options) -> DataFrame:
        """(query_id, id, score, rank) of both arms fused; queries are (id, tokens, embedding)."""
        semantic = nearest(queries, self.vectors, over_fetch * k).select("query_id", "id", "distance", "rank")
        return top(fuse(semantic, self.bm25(queries, over_fetch * k).select("query_id", "id", "score", "rank"), "query_id", "id", method, **options), "query_id", "id", k)
