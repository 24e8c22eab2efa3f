"""What changes with the size of a table: joins of written graphs, and how rows are dealt out."""

from pyspark.sql import functions as F

from seqloom.operators.aligned_growth import aligned_growth
from seqloom.operators.pograph import PoGraph
from seqloom.session import dealt, spread
from seqloom.sources import graphs


def chains(spark, nodes, graphs=10):
    """Paths and nodes of graphs that are chains; their files are much smaller than their rows."""
    at = (F.col("id") / graphs).cast("int")
    rows = spark.range(nodes).select((F.col("id") % graphs).alias("graph_id"), at.alias("pos"), at.cast("long").alias("node_id"))
    none = F.expr("cast(array() as array<bigint>)")
    one = F.lit(1).cast("long")
    return PoGraph(
        rows.select("graph_id", "node_id", F.lit("A").alias("symbol"), none.alias("aligned")),
        rows.select("graph_id", F.lit(0).alias("seq_rank"), "pos", "node_id", one.alias("weight")),
    )


def joined_plan(spark, capsys, nodes):
    graph = chains(spark, nodes).written()
    joined = graph.paths.join(graph.edges(), [graph.paths.graph_id == F.col("src")]).join(graph.nodes, "node_id")
    capsys.readouterr()
    joined.explain()
    return capsys.readouterr().out


def test_written_graphs_are_broadcast_by_their_rows(spark, capsys):
    assert "BroadcastHashJoin" not in joined_plan(spark, capsys, 200_000)
    assert "BroadcastHashJoin" in joined_plan(spark, capsys, 200)


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        parts = spread(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(name, before)
    assert len(parts) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in parts) == 20_000


def test_written_rows_are_dealt_out_by_their_number(spark, tmp_path):
    path = str(tmp_path / "rows")
    cores = spark.sparkContext.defaultParallelism
    spark.range(1_000 * cores).select((F.col("id") / 2).cast("long").alias("graph_id")).coalesce(1).write.parquet(path)
    parts = dealt(spark.read.parquet(path), 100, "graph_id").select("graph_id", F.spark_partition_id().alias("part"))
    most = parts.groupBy("part").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert most["most"] < 200 and most["all"] == 1_000 * cores
    assert parts.distinct().count() == 500 * cores  # the rows of a key stay together


def test_graphs_are_made_in_many_tasks(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(graphs, "star_graph", lambda sequences: sequences)
    monkeypatch.setattr(graphs, "po_graph", lambda sequences: sequences)
    for build in (graphs.positional_graph, graphs.star_aligned_graph):
        sequences = build(spark, "/root/testdata/sf0.001")
        assert sequences.rdd.getNumPartitions() >= 4 * cores
        own = sequences.select("graph_id", F.spark_partition_id().alias("part")).distinct()
        assert own.count() == own.select("graph_id").distinct().count()


def test_graphs_grow_in_many_tasks(spark):
    rows = spark.range(400).select(
        (F.col("id") / 2).cast("long").alias("graph_id"), (F.col("id") % 2).cast("int").alias("seq_rank"), F.lit("ACGT").alias("seq")
    )
    graph, scores = aligned_growth(rows)
    assert len(scores.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert scores.filter("seq_rank = 1 and score = 0").count() == 200
    assert graph.nodes.count() == 800
