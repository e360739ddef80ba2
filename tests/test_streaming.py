from pyspark.sql import functions as F

from textmart.functions import text as tx
from textmart.operators import classify
from textmart.plans import catalogue


def test_column_functions_work_on_streams(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def labelled(df):
        label = classify.classify_vote([F.col("text")], catalogue.TOPICS, gate=F.col("source"))
        return df.select("doc_id", tx.clean_text(F.col("text")).alias("text"), label.alias("label"))

    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    query = labelled(stream).writeStream.format("memory").queryName("labelled").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("labelled").collect())) == sorted(map(tuple, labelled(batch).collect()))
