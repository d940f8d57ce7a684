"""Table folders for whole runs over small documents."""

from __future__ import annotations


def write_tables(spark, docs, folder):
    """documents, labels and benchmark as the pipeline reads them; returns the folder."""
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = docs.selectExpr("doc_id", "cast(1 as int) as quality", "cast(doc_id % 3 = 0 as int) as toxic")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs.filter("doc_id = 5").selectExpr("doc_id as item_id", "text").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)
