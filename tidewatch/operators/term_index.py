"""A stored index of reports, extended batch by batch and probed with the new reports of a run.

Counts of terms are stored, not weights, which change with every batch: a term's weight follows from the number of documents that hold
it now. A batch is kept as bags of terms in chunks of a bounded number of documents, each with its own list of terms (operators/bags.py), so that adding one
shuffles nothing. A probe reads all chunks: their terms meet for the counts, then the new documents' blocks are held against every block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.bags import BAGS, bags, chunk_terms, document_terms, vectors
from tidewatch.operators.pairs import block_pairs
from tidewatch.sources.runtime import Scratch

BLOCK = 4096  # documents of a chunk at most


class TermIndex:
    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/batch={batch}")

    def add(self, docs: DataFrame, batch: int, id_col: str = "id", text_col: str = "text") -> None:
        """Documents of new ids as a batch of that number; the same batch again replaces itself. Earlier batches aren't read or written."""
        self._write(bags(docs, id_col, text_col, self.block), "bags", batch)
        self._write(docs.select(F.col(id_col).cast("bigint").alias("id")), "documents", batch)

    def documents(self) -> DataFrame:
        return self.spark.read.schema("id bigint, batch int").parquet(f"{self.path}/documents")

    def bags(self) -> DataFrame:
        return self.spark.read.schema(f"{BAGS}, batch int").parquet(f"{self.path}/bags")

    def _numbered(self) -> tuple[DataFrame, DataFrame]:
        """The bags of all batches, their chunks by one number, and (batch, chunk, number): a row for each chunk is ranked."""
        chunks = self.bags().select("batch", "chunk").distinct()
        numbered = Scratch(self.spark, "probe").table(chunks.select("batch", "chunk", F.row_number().over(Window.orderBy("batch", "chunk")).cast("bigint").alias("number")))
        return self.bags().join(F.broadcast(numbered), ["batch", "chunk"]).drop("batch", "chunk").withColumnRenamed("number", "chunk"), numbered

    def postings(self) -> DataFrame:
        """(term, chunk, docs, n): the documents of each chunk that hold a term, a row for each chunk."""
        table, _ = self._numbered()
        held = document_terms(table).groupBy("chunk", "local").agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("docs"))
        return chunk_terms(table).join(held, ["chunk", "local"]).select("term", "chunk", "docs", "n")

    def weights(self) -> DataFrame:
        """(term, df, idf) over all batches, from the chunks' counts alone."""
        n = self.documents().count()
        return chunk_terms(self.bags()).groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1)

    def probe(self, batch: int, threshold: float) -> DataFrame:
        """(id1, id2, sim), id1 < id2: all pairs with a cosine of the threshold or more of which a document is in the batch; the other may be of any batch."""
        n, (table, numbered) = self.documents().count(), self._numbered()
        # A chunk's documents are of one batch, so that no vector is shuffled to learn its own.
        own = numbered.filter(F.col("batch") == batch).select(F.col("number").alias("chunk"), F.lit(True).alias("new"))
        return block_pairs(vectors(table, n).join(F.broadcast(own), "chunk", "left"), n, threshold, new=F.col("new")).select("id1", "id2", "sim")
