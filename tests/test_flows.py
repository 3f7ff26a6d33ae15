from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import learners as L
from textloom.plans import rank, recall
from textloom.queries import QUERIES
from textloom.streaming.vocabulary import event_windows, word_counts


def test_flow_answers_every_query(spark, data):
    got = QUERIES["rank_flow"](spark, data)
    assert got.columns == ["item_id", "paper_id_1", "paper_id_2", "paper_id_3"] and got.count() == 40


def test_candidates_and_second_level(spark):
    raw = spark.createDataFrame([(i, f"word{i % 3} other{i} no_content", None) for i in range(9)] + [(None, "lost", None)], "doc long, text string, keys string")
    docs = recall.documents(raw, "doc", ["text", "keys"])
    assert docs.count() == 9
    queries = spark.createDataFrame([(q, f"word{q % 3} other{q}") for q in range(6)], "q long, text string").select("q", X.tokens("text").alias("tokens"))
    gold = queries.select("q", F.col("q").alias("doc"))
    pairs = recall.candidates(docs, queries, "doc", "q", gold, k=4)
    assert pairs.count() == 24 and pairs.agg(F.sum("target")).first()[0] == 6
    ranked = rank.rank(pairs.drop("rank").withColumn("cv", (F.col("q") % 2 + 1).cast("int")), "q", "doc", L.Variant("v", rounds=2, depth=2), gold)
    assert ranked.answers.count() == 6 and 0 < ranked.score.first()[0] <= 1
    assert rank.second_level(pairs, ranked, "q", "doc").filter("top1_pred IS NULL").count() == 0


def test_streams_equal_batches(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    q = word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("words").collect())) == sorted(map(tuple, word_counts(docs).collect()))


def test_event_windows(spark, data):
    got = event_windows(spark.read.parquet(f"{data}/events.parquet"))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
