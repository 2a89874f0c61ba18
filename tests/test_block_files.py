"""Blocks of a catalogue lie a few to a file, as a task holds thousands of rows of a file at once."""

from pyspark.sql import functions as F

from flowlens.operators import blocks


def test_blocks_lie_a_few_to_a_file(spark):
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), "id").alias("text"))
    index = blocks.build_blocks(docs, with_latent=False, doc_rows=2)
    files = index.blocks.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("docs")).collect()
    assert sum(f.docs for f in files) == index.n_docs == 400
    assert max(f.n for f in files) <= 8
