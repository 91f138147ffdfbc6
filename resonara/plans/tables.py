"""Stand-ins for charts, files and sounds, made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions import ids

#: Scaled copies of a vector have this much added to its number.
COPY = 1_000_000
#: Rows are dealt over charts, two for so many consecutive keys: a chart has room for 3,843 identifiers.
PART_SPAN, ORDER_SPAN, VECTOR_SPAN = 4000, 30_000, 1900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chart_path(key: Column, span: int) -> Column:
    """The chart that a key falls to: every fourth key goes to the second of the two charts of its span."""
    number = F.floor(key / span) * 2 + F.when(key % 4 == 0, 1).otherwise(0)
    return F.concat(F.lit("song"), number.cast("string"), F.lit(".bms"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the files of charts: path, idx, num_int, num, name, file_size.  Some files of a full chart share an identifier."""
    part = table(spark, sf_dir, "part")
    number = (F.col("p_partkey") % (ids.LARGEST[62] + 1)).cast("int")
    name = F.concat(F.lit("sounds/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    return part.select(chart_path(F.col("p_partkey"), PART_SPAN).alias("path"), F.col("p_partkey").alias("idx"), number.alias("num_int"), ids.encode(number, 62).alias("num"), name.alias("name"), F.col("p_size").cast("long").alias("file_size"))


def replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement for every identifier of every chart of ``files``: none, itself, another, or one that is replaced itself; charts differ."""
    n = F.col("num_int")
    turn = (n + F.regexp_extract("path", r"\d+", 0).cast("int") % 2) % 5
    to = F.when(turn == 0, 0).when(turn == 1, n).when(turn == 3, n - 2).otherwise(n - 1)
    # A span of keys has two charts, so this is about two table rows for a part.
    charts = files(spark, sf_dir).select("path").distinct()
    every = charts.withColumn("num_int", F.explode(F.sequence(F.lit(0), F.lit(ids.LARGEST[62]))))
    return every.select("path", "num_int", F.greatest(to, F.lit(0)).cast("int").alias("replace_to"))


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts: a title, a definition for every part and a data line of encoded parts for every order.

    Line numbers rise with the key inside a chart; definitions come first.
    """
    item = table(spark, sf_dir, "lineitem")
    token = ids.encode((F.col("l_partkey") % (ids.LARGEST[62] + 1)).cast("int"), 62)
    data = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", token.alias("token")))), lambda x: x["token"]), "")
    channel = F.element_at(F.array(*[F.lit(c) for c in ("01", "11", "04", "D1", "5A", "29", "d1", "e9")]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    body = F.concat(F.lit("#"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0"), channel, F.lit(":"), "data", F.when(F.col("l_orderkey") % 7 == 0, F.lit("x")).otherwise(F.lit("")))
    orders = item.groupBy("l_orderkey").agg(data.alias("data"))
    main = orders.select(chart_path(F.col("l_orderkey"), ORDER_SPAN).alias("path"), (F.col("l_orderkey") % ORDER_SPAN + 10_000).alias("line_no"), body.alias("line"))
    own = files(spark, sf_dir)
    defined = own.select("path", (F.col("idx") % PART_SPAN + 1).alias("line_no"), F.concat(F.when(F.col("idx") % 50 == 0, F.lit("#wav")).otherwise(F.lit("#WAV")), "num", F.lit("  "), "name", F.lit(" ")).alias("line"))
    first = own.select("path", F.lit(0).cast("long").alias("line_no"), F.lit("#TITLE a song").alias("line")).distinct()
    return first.union(defined).union(main)


def samples(vector: Column) -> Column:
    return F.array(F.transform(vector, lambda v: v.cast("double")))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and scaled copies as one-channel sounds: vec_id, label, x (double).

    Copies have another RMS and a faint pattern added, so that no correlation is 1 but for rounding.
    """
    base = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    scaled = base.select((F.col("vec_id") + COPY).alias("vec_id"), "label", F.transform("x", lambda v, i: v * (1 + (F.col("vec_id") % 5) * 0.313) + i % 3 * 0.002).alias("x"))
    return base.union(scaled)


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their copies as files of charts with sounds: path, idx, num_int, num, name, file_size, fingerprint, label, sound, rms."""
    from resonara.functions import waves as w

    own = waves(spark, sf_dir)
    vector = F.col("vec_id") % COPY
    number = (vector % VECTOR_SPAN * 2 + F.when(F.col("vec_id") >= COPY, 2).otherwise(1)).cast("int")
    channels = F.array("x")
    sound = F.struct(F.lit(44100).alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bits_per_sample"), channels.alias("samples"))
    name = F.concat(F.lit("v"), F.lpad(number.cast("string"), 4, "0"), F.lit(".wav"))
    return own.select(chart_path(vector, VECTOR_SPAN).alias("path"), number.cast("long").alias("idx"), number.alias("num_int"), ids.encode(number, 62).alias("num"), name.alias("name"), F.col("label").cast("long").alias("file_size"), F.lit("").alias("fingerprint"), "label", sound.alias("sound"), w.rms(channels).alias("rms"))
