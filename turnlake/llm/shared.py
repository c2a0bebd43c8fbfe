"""Pieces that several operators of this subpackage use: staging, joins with hot keys and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE hot keys however large a table is;
#: their rows are dealt over SALTS tasks.
HOT_SHARE, SALTS = 1 / 512, 32
#: Tasks over which the links of a node are dealt, in rounds too short to look for hot nodes first.
LINK_SALTS = 8
#: Where keys are not counted, hot ones are looked for among one row in SAMPLED (the result does not depend on it).
SAMPLED, LEAST_SAMPLED = 32, 32

#: Rows of texts, and bytes, in an Arrow batch.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 500, 8 << 20

#: Characters that part words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders for sessions that name none; only a session on this machine, as in tests, gets one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: spark.checkpoint.dir where the session has it.

    Without it a session on one machine gets a temporary folder; on a cluster that would be a folder which executors do
    not share, so there the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="turnlake-checkpoint-"))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow carry at most TEXTS_AT_ONCE rows and about BYTES_AT_ONCE bytes at once to Python: texts are long, and a batch is held whole on both sides.

    These are settings of the session, read when a query is planned, so they stay set; smaller ones of the caller are kept.
    """
    for setting, most, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE, "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE, str(2**31 - 1))):
        now = str(spark.conf.get(setting, default))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: all that was made of them is itself staged or collected."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._staged_in)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", count: str | None = None, total: int | None = None) -> DataFrame:
    """left joined with right, which has one row for a key; the rows that a hot key has in left are dealt over SALTS tasks by `by`.

    Only hot keys are copied SALTS times in right. count names a column of right with the rows that left has of the key,
    and total is left's number of rows; without them hot keys are looked for in a sample of left. Which keys are hot is
    broadcast: at most 1 / HOT_SHARE. With how="left" rows with a null key are dealt too.
    """
    if count is None:
        sample = left.where(F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(SAMPLED)) == 0)
        counted = staged(sample.groupBy(*keys).agg(F.count("*").alias("_n")))
        seen = counted.agg(F.sum("_n")).first()[0] or 0
        hot = counted.where(F.col("_n") > max(LEAST_SAMPLED, HOT_SHARE * seen)).select(keys)
    else:
        hot = right.where(F.col(count) > max(LEAST_SAMPLED * SALTS, HOT_SHARE * (total or 0))).select(keys)
    hot = F.broadcast(hot.limit(int(1 / HOT_SHARE)).withColumn("_hot", F.lit(True)))
    null = F.lit(False)
    for key in keys:
        null = null | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(SALTS)).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull() | null, salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, by: Column) -> DataFrame:
    """left joined with right, which has one row for a key and few bytes; every key's rows in left are dealt by `by` over LINK_SALTS tasks."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(LINK_SALTS)]))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(LINK_SALTS)).cast("int"))
    return dealt.join(right.withColumn("_salt", salts), [key, "_salt"]).drop("_salt")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the graph whose links are the rows (a, b), longs: one row (node, component) for each linked node.

    component is the smallest node reachable. Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round is two aggregations and two joins on the links left, O(log^2 n) rounds, with the links written to the shared
    folder after each. Rows with a null end and loops take no part; an empty input gives an empty result.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = salted_join(both, low, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", F.col("v"))
        last = edges
        edges = staged(
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        after = signature(edges)
        unstaged(last)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
