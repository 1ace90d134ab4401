from terrane.session import durable
from terrane.streams import kernel_partitions


def test_tasks_after_a_checkpoint(spark):
    """The guessed size of a join is carried by its checkpoint; it must not become tens of thousands of empty tasks."""
    nodes = spark.read.parquet("/root/testdata/sf0.01/osm_nodes.parquet").select("id", "lat").filter("id % 1000 = 1")
    joined = nodes.crossJoin(nodes.withColumnRenamed("id", "a")).crossJoin(nodes.withColumnRenamed("id", "b")).select("id", "a", "b").filter("a = id and b = id")
    made = durable(joined)
    assert kernel_partitions(made) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, made.rdd.getNumPartitions())
