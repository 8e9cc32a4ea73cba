"""What a sketch leaves to the collector: an executor's heap grows with it, not with the rows it holds."""

from pyspark.sql import functions as F

from sealfold.llm import fingerprints


def allocated(spark) -> int:
    """Bytes that the threads of this JVM have allocated so far."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("java.lang:type=Threading")
    methods = {m.getName(): m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(method, *arguments):
        values = array(jvm.Object, len(arguments))
        for i, x in enumerate(arguments):
            values[i] = x
        return methods[method].invoke(server, values)

    ids, kinds = array(jvm.Object, 1), array(jvm.String, 1)
    ids[0], kinds[0] = call("getAttribute", name, "AllThreadIds"), "[J"
    return sum(x for x in call("invoke", name, "getThreadAllocatedBytes", ids, kinds) if x > 0)


def test_a_shingle_takes_few_objects(spark):
    texts, words = 8, 25_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: (i * (F.col("id") + 7)).cast("string")), " ")
    rows = spark.range(texts).repartition(1).select(text.alias("text")).cache()
    assert rows.count() == texts
    sketches = rows.select(fingerprints.sketch(F.col("text")).alias("s")).agg(F.sum(F.size("s")))
    assert sketches.first()[0] == texts * fingerprints.K
    before = allocated(spark)
    sketches.collect()
    a_shingle = (allocated(spark) - before) / (texts * (words - fingerprints.WORDS + 1))
    rows.unpersist()
    assert 0 < a_shingle < 800  # 1000 with an array for each shingle


def test_sketches_are_those_of_hashed_slices(spark):
    words = [f"W{i * i % 37}" for i in range(60)]
    rows = spark.createDataFrame([(" ".join(words[:n]),) for n in (0, 1, 4, 5, 6, 60)] + [("É x\ty  z Z q",)], "text string").withColumn("w", F.split(F.lower("text"), r"\s+"))
    sliced = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice(F.col("w"), i, 5)))
    want = F.when(F.col("text") == "", F.array().cast("array<bigint>")).when(F.size("w") < 5, F.array(F.xxhash64("w"))).otherwise(F.sort_array(F.array_distinct(sliced)))
    for r in rows.select(want.alias("want"), fingerprints.sketch(F.col("text")).alias("got")).withColumn("hex", fingerprints.to_text(F.col("got"))).collect():
        assert r["got"] == r["want"]
        assert r["hex"] == "".join(f"{x % 2**64:016x}" for x in r["got"])
