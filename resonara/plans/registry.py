"""Named queries of the engine, each over its whole tables."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions import ids, text
from resonara.functions import waves as w
from resonara.operators import blocking, cluster, facets, rewrite, similarity, stats, sweep
from resonara.operators.ranking import checkpointed
from resonara.plans import pipeline, tables
from resonara.sources import audio, charts

START, END = 10, 3000
KEYWORDS = ["widget", "gear", "hot", "a", "o"]


def six(c: str):
    return F.round(c, 6).alias(c)


# identifiers


def id_encode_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", ids.encode(F.col("p_partkey") % 1296, 36).alias("id36"), ids.encode(F.col("p_partkey"), 36).alias("in_range"))


def id_encode_62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", ids.encode(F.col("p_partkey") % 3844, 62).alias("id62"), ids.encode(F.col("p_partkey") % 3844, 10).alias("other_base"))


def id_decode_62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("idx", "num", ids.decode(F.col("num"), 62).alias("as62"), ids.decode(F.col("num"), 36).alias("as36"))


def id_invalid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.substring("c_name", F.lit(1), (F.col("c_custkey") % 4).cast("int"))
    return tables.table(spark, sf_dir, "customer").select("c_custkey", shown.alias("typed")).select("c_custkey", "typed", ids.decode(F.col("typed"), 62).isNull().alias("invalid62"), ids.legal_input(F.col("typed")).alias("legal"), ids.padded(F.col("typed")).alias("padded"))


def range_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.substr(F.col("num"), F.lit(1), (F.col("idx") % 7 + 1).cast("int")), ids.encode((F.col("idx") * 37 % 3844).cast("int"), 62)
    made = tables.files(spark, sf_dir).select("idx", start.alias("start_id"), end.alias("end_id"))
    return made.select("*", F.coalesce(ids.range_error(F.col("start_id"), F.col("end_id")), F.lit("")).alias("error"))


def field_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.files(spark, sf_dir).select("idx", F.concat((F.col("idx") % 130 - 10).cast("string"), F.when(F.col("idx") % 3 == 0, "%").otherwise("")).alias("threshold"), "num", ids.encode((F.col("idx") * 41 % 1296).cast("int"), 36).alias("end_id"))
    return made.select("idx", *[ids.field_error(f, F.col("threshold"), F.col("num"), F.col("end_id")).alias(f"{f}_error") for f in ("threshold", "start", "end")])


def threshold_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    typed = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat((k % 120).cast("string"), F.lit("%"))).when(k % 6 == 2, F.concat(F.lit("0."), k.cast("string"))).when(k % 6 == 3, F.concat(F.lit("-"), k.cast("string"))).when(k % 6 == 4, F.concat((k % 130).cast("string"), F.lit(".5"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("", " ", "NaN", "x", "1", "1%")]), (k % 36 / 6 + 1).cast("int")))
    parsed = tables.table(spark, sf_dir, "supplier").select("s_suppkey", typed.alias("typed")).withColumn("parsed", ids.threshold(F.col("typed")))
    return parsed.select("s_suppkey", "typed", F.round(F.col("parsed.value").cast("double"), 6).alias("value"), F.coalesce("parsed.error", F.lit("")).alias("error"))


def processing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    rows = None
    for start, end in ((-5, 50), (1, 5000), (100, 0), (1, 3843)):
        one = blocking.processing_range(files, start, end).select("path", F.lit(start).alias("asked_start"), F.lit(end).alias("asked_end"), "start_point", "end_point")
        rows = one if rows is None else rows.union(one)
    return rows


# paths and display


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return tables.table(spark, sf_dir, "pages").select("page_id", text.file_name(url).alias("file_name"), text.stem(url).alias("stem"), text.extension(url).alias("ext"), text.directory(url).alias("dir"), text.rooted(url).alias("rooted"), text.combined(F.lit("base/"), url).alias("combined"), text.unquoted(F.concat(F.lit('"'), url, F.lit('"'))).alias("unquoted"))


def chart_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".bms", ".BME", ".bml", ".pms", ".txt", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    named = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a.b/"), F.replace("p_name", F.lit(" "), F.lit(".")), ext).alias("file"))
    return named.select("p_partkey", text.is_chart(F.col("file")).alias("is_chart"), text.type_name(text.extension(F.col("file"))).alias("type_name"), text.output_name(F.col("file")).alias("output"))


def display_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    shown = F.when(k % 3 == 0, (k % 140 - 20).cast("string")).when(k % 3 == 1, F.concat(F.lit("0."), (k % 90 + 10).cast("string"))).otherwise(F.lit("none"))
    r = (k % 1000) / 1024
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.shown_percent(r).alias("percent"), text.entered_percent(shown).alias("entered"), F.round(text.bar_width(r * 2 - 0.5, F.lit(200.0)), 6).alias("width"), text.with_unit(shown).alias("with_unit"), text.without_unit(F.concat(shown, F.lit(" %"))).alias("without_unit"), text.is_numeric_input(shown).alias("numeric"))


# charts


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.chart(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 11 == 0, F.concat(F.lit("  "), "line")).otherwise(F.col("line")))
    return lines.groupBy("path", charts.line_class(F.col("line")).alias("class"), charts.is_definition(F.col("line")).alias("is_definition")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))


def wav_def_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.definitions(tables.chart(spark, sf_dir)).select("path", "idx", "num", "name")


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = tables.files(spark, sf_dir).filter("idx % 4 <> 0").select(F.concat(F.lit("songs/"), "name").alias("path"), F.col("file_size").alias("length"))
    defined = charts.definitions(tables.chart(spark, sf_dir).withColumn("path", F.concat(F.lit("songs/"), "path")))
    found, missing = charts.file_list(defined, listing)
    return found.select("path", "idx", "num_int", "name", "file_size").unionByName(missing.select("path", "idx", F.lit(None).cast("int").alias("num_int"), "name", F.lit(None).cast("long").alias("file_size")))


def numbered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = tables.files(spark, sf_dir).select("idx", F.col("name").alias("path"), (F.col("idx") % 3 != 0).alias("exists"))
    return audio.numbered(listing, 5, 800).select("idx", "num_int")


def channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("channel"))
    return made.select("channel", charts.is_sound_channel(F.col("channel")).alias("is_sound"), charts.is_sound_channel(F.lower("channel")).alias("lower_too"))


def base_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).groupBy((F.col("num_int") < 1296).alias("low")).agg(ids.base_of(F.col("num")).alias("radix"), F.max("num_int").alias("largest"))


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, replaces = tables.files(spark, sf_dir), tables.replaces(spark, sf_dir)
    numbered = rewrite.renumbered(rewrite.kept(files, replaces, START, END))
    return files, numbered, rewrite.final_map(files, replaces, numbered, START, END)


def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.kept(tables.files(spark, sf_dir), tables.replaces(spark, sf_dir), START, END).select("path", "place", "num_int", "idx", "name")


def survivor_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir)[1].select("path", "num_int", "new_int", "new_num", "name")


def final_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir)[2].select("path", "num", "new_num")


def token_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, replaces = tables.files(spark, sf_dir), tables.replaces(spark, sf_dir)
    # Both the definitions and the map are made of these.
    numbered = checkpointed(rewrite.renumbered(rewrite.kept(files, replaces, START, END)))
    mapping = rewrite.final_map(files, replaces, numbered, START, END)
    return rewrite.rewritten(tables.chart(spark, sf_dir), mapping, numbered, "sounds").select("path", "line_no", "line")


def change_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rewrite.tables_of(_map(spark, sf_dir)[2])
    return tables.chart(spark, sf_dir).join(table, "path", "left").select("path", "line_no", rewrite.changed_line(F.col("line"), F.col("table")).alias("line"))


def undefined_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _map(spark, sf_dir)[2].filter(F.col("num") < "P")
    return rewrite.undefined_references(tables.chart(spark, sf_dir), mapping).select("path", "id")


def unused_paths_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, numbered, _ = _map(spark, sf_dir)
    return rewrite.unused_files(files, numbered).select("path", "name")


# samples


def vec_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.waves(spark, sf_dir).select("vec_id", w.rms(F.array("x")).alias("rms"))
    band = w.rms_band(F.col("rms").cast("double"))
    return one.select("vec_id", F.round(F.col("rms").cast("double"), 6).alias("rms"), w.rms_step(F.col("rms")).alias("step"), F.round(band["low"], 6).alias("low"), F.round(band["high"], 6).alias("high"))


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.waves(spark, sf_dir).select("vec_id", w.normalized(F.col("x")).alias("n"))
    return n.select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.col("n")[63], 6).alias("last"), F.round(w.dot(F.col("n"), F.col("n")), 6).alias("norm"), w.all_zero(F.col("n")).alias("zero"))


def vec_peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.waves(spark, sf_dir).select("vec_id", w.peak_normalized(F.array("x", F.transform("x", lambda v: v * 2)))[1].alias("n"))
    return n.select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.array_max(F.transform("n", F.abs)), 6).alias("peak"))


def vec_rms_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.waves(spark, sf_dir).select("vec_id", w.by_mode(F.array("x"), "rms")[0].alias("n"))
    return n.select("vec_id", F.round(F.col("n")[0], 5).alias("first"), F.round(w.rms(F.array("n")).cast("double"), 5).alias("rms"))


def leading_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = lambda n: F.transform("x", lambda v, i: F.when(i < n, v * 0.0001).otherwise(v))
    both = F.array(quiet(F.col("vec_id") % 50), quiet(F.col("vec_id") % 33))
    made = tables.waves(spark, sf_dir).select("vec_id", both.alias("s"))
    return made.select("vec_id", w.leading_silence(F.col("s")).alias("silence"), w.total_samples(F.col("s")).alias("samples"), w.effective_length(F.col("s")).alias("effective"), F.round(w.megabytes(F.col("s"), F.col("s")), 9).alias("megabytes"))


def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.waves(spark, sf_dir).select("vec_id", w.deinterleaved(F.col("x"), (F.col("vec_id") % 3 + 1).cast("int")).alias("c"))
    return made.select("vec_id", F.size("c").alias("channels"), F.size(F.col("c")[0]).alias("frames"), F.round(F.element_at("c", -1)[1], 6).alias("second"))


def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.waves(spark, sf_dir).withColumn("sound", F.when(F.col("vec_id") % 9 != 0, F.array("x")))
    return audio.load_statistics(one.withColumn("memory_mb", w.megabytes(F.col("sound"), F.col("sound")))).withColumn("megabytes", F.round("megabytes", 6)).withColumn("success_percent", F.round("success_percent", 6))


# pairs


def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.correlated_within(tables.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3).withColumn("r", F.round("r", 6))


def pearson_raw_edgecases(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    k = F.col("vec_id") % 6
    y = F.when(k == 0, F.transform("x", lambda v: -v)).when(k == 1, F.transform("x", lambda v: v * 0 + 0.5)).when(k == 2, F.slice("x", 1, 10)).when(k == 3, F.transform("x", lambda v: v * 3 + 1)).when(k == 4, F.reverse("x")).otherwise(F.col("x"))
    x = F.when(k == 5, F.slice("x", 1, 3)).when((k == 1) & (F.col("vec_id") % 4 == 1), F.transform("x", lambda v: v * 0 + 0.5)).otherwise(F.col("x"))
    made = base.select("vec_id", x.alias("x"), F.when(k == 5, F.slice("x", 1, 3)).otherwise(y).alias("y"))
    return made.select("vec_id", F.round(w.pearson(F.col("x"), F.col("y")), 6).alias("r"))


def r_squared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    next_ = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    mixed = F.zip_with("x", "y", lambda a, b: a * 0.9 + b * 0.1)
    return one.join(next_, "vec_id").select("vec_id", F.round(w.r_squared(F.col("x"), mixed), 6).alias("close"), F.round(w.r_squared(F.col("x"), F.col("y")), 6).alias("far"))


def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sounds(spark, sf_dir).withColumn("block_key", blocking.block_key(F.col("file_size"), F.col("rms"))).groupBy("path", "block_key").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).withColumn("rms", F.when(F.col("idx") % 13 != 0, (F.col("idx") % 37) / 64).cast("float"))


def keyword_block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = blocking.blocked(_named(spark, sf_dir), START, END, KEYWORDS)
    return made.groupBy("path", "keyword", "block_key").agg(F.count("*").alias("n"), F.max("chunk_no").alias("last_chunk"))


def keyword_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.keyword_totals(_named(spark, sf_dir), START, END, KEYWORDS[:4])


def group_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _named(spark, sf_dir).withColumns({"rms": F.when(F.col("rms").isNotNull(), F.lit(0.5)).cast("float"), "file_size": F.lit(0).cast("long")})
    return blocking.blocked(files).select("path", "idx", "block_key", "chunk_no")


def band_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.sounds(spark, sf_dir).filter("rms is not null").withColumns({"keyword": F.lit(None).cast("string"), "block_key": F.lit("0"), "chunk_no": F.floor((F.col("idx") - 1) / 100)})
    met = similarity.candidates(files)
    return met.groupBy(F.col("a.path").alias("path"), F.col("a.chunk_no").alias("chunk_no")).agg(F.count("*").alias("pairs"), F.sum(F.col("a.num_int") * F.lit(4000).cast("long") + F.col("b.num_int")).alias("checksum"))


def exact_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank"), "p_name", F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")).otherwise("").alias("print"), "p_size")
    return similarity.exact_pairs(part, ["p_size"], "p_name", "print")


def matching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.matching(blocking.blocked(tables.sounds(spark, sf_dir)), 0.3)
    return found.select("path", "num_a", "num_b", F.round("r", 6).alias("r"), "how")


# words


def filename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string"), F.lit("_v2.("), "p_brand", F.lit(") 99.wav"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.words(text.stem(name)), "|").alias("words"))


def word_counts_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.word_counts(tables.files(spark, sf_dir)).select("path", "word", "shown", "cnt")


def prefix_facets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.prefix_facets(tables.files(spark, sf_dir))


def instrument_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.detect(tables.files(spark, sf_dir)).select("path", "idx", "instrument")


def instrument_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.instrument_facets(facets.detect(tables.files(spark, sf_dir)))


def text_and_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("instrument"))
    return files.filter(facets.shown(F.col("name"), F.col("instrument"), "E", ["brand#1", "BRAND#23", "Brand#4"])).select("p_partkey")


def chip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir).withColumn("instrument", F.when(F.col("idx") % 3 == 0, F.split("name", "[/_]")[1]).otherwise(""))
    return files.filter(facets.chosen(F.col("name"), F.col("instrument"), KEYWORDS[:3])).select("idx")


def keyword_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(len(KEYWORDS)).select(F.col("id").alias("ord"), F.element_at(F.array(*[F.lit(k) for k in KEYWORDS]), (F.col("id") + 1).cast("int")).alias("word"))
    return facets.keyword_by_table(tables.files(spark, sf_dir), listed)


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.files(spark, sf_dir).filter("idx % 2 = 0").select(F.upper("name").alias("name"), F.concat(F.lit("i"), (F.col("idx") % 9).cast("string")).alias("instrument"))
    return facets.assigned(tables.files(spark, sf_dir), found).select("idx", "instrument")


# statistics and thresholds


def reduction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reduction_statistics(tables.files(spark, sf_dir), tables.replaces(spark, sf_dir), START, END, by_path=True).withColumn("reduction_percent", F.round("reduction_percent", 6))


def reduction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("original"), F.countDistinct("p_name").alias("optimized"))
    return parts.select("p_brand", F.round(F.coalesce(F.try_divide(F.col("original") - F.col("optimized"), F.col("original")), F.lit(0.0)), 6).alias("rate"))


def replace_root_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.roots(tables.replaces(spark, sf_dir))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.hundredths(spark)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofyear("o_orderdate")
    return tables.table(spark, sf_dir, "orders").groupBy(day.alias("d")).agg(F.count("*").alias("n")).select((F.col("d") / 1000).alias("threshold"), (F.col("d") * 11 - 300 + F.col("n") % 7).alias("file_count"))


def optimal_threshold_topone(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    one = None
    for limit in (1295, 3843, 1):
        best = points.agg(sweep.best(limit).alias("b")).select(F.lit(limit).alias("file_limit"), "b.threshold", "b.file_count")
        one = best if one is None else one.union(best)
    none = points.filter("file_count > 100000").agg(sweep.best(1295).alias("b")).select(F.lit(0).alias("file_limit"), "b.threshold", "b.file_count")
    return one.union(none)


def sweep_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.until_enough(_points(spark, sf_dir))


# whole runs


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocked(tables.sounds(spark, sf_dir))


def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_clustered(spark, sf_dir), 0.3)


def component_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_clustered(spark, sf_dir), 0.3, "components")


def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.sounds(spark, sf_dir)
    return sweep.simulate(_clustered(spark, sf_dir), files.filter("rms is null"), sweep.thresholds(0.0, 1.0, 0.01), early_stop=False).withColumn("threshold", F.round("threshold", 2))


def _sound_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts that define the sounds, in list order, and use each in one of 400 data lines."""
    files = tables.sounds(spark, sf_dir)
    defined = files.select("path", F.col("idx").alias("line_no"), F.concat(F.lit("#WAV"), "num", F.lit(" "), "name").alias("line"))
    used = files.groupBy("path", (F.col("idx") % 400).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "num"))), lambda x: x["num"]), "").alias("data"))
    main = used.select("path", (F.col("k") + 10_000).alias("line_no"), F.concat(F.lit("#"), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit("11:"), "data").alias("line"))
    return defined.union(main)


def reduce_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.reduce_charts(_sound_charts(spark, sf_dir), tables.sounds(spark, sf_dir), 0.3).select("path", "line_no", "line")


def _partly_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.sounds(spark, sf_dir)
    failed = F.col("idx") % 17 == 0
    return files.withColumns({"sound": F.when(~failed, F.col("sound")), "rms": F.when(~failed, F.col("rms"))})


def find_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, best, warnings = pipeline.find_optimum(_partly_loaded(spark, sf_dir))
    shown = lambda k: [F.round(F.col(f"{k}.threshold"), 2).alias(f"{k}_threshold"), F.col(f"{k}.file_count").alias(f"{k}_count")]
    return best.join(warnings, "path", "left").select("path", *shown("base36"), *shown("base62"), F.coalesce("warning", F.lit("")).alias("warning"))


# sources


def _wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as two-channel 16-bit WAVE files (path, length, content); every ninth isn't one and every eleventh has no samples."""
    head = lambda size: (b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", size)).hex()
    byte = lambda n: F.lpad(F.hex(n.bitwiseAND(255)), 2, "0")
    level = F.transform("embedding", lambda v: F.floor(v.cast("double") * 32767 + 0.5).cast("int"))
    data = F.array_join(F.transform(level, lambda n: F.concat(byte(n), byte(F.shiftright(n, 8)))), "")
    content = F.when(F.col("vec_id") % 9 == 0, F.lit("00")).when(F.col("vec_id") % 11 == 0, F.lit(head(0))).otherwise(F.concat(F.lit(head(128)), data))
    made = tables.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.unhex(content).alias("content"))
    return made.select("path", F.length("content").cast("long").alias("length"), "content")


def wave_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.col("sound")
    made = audio.with_features(audio.decoded(_wave_files(spark, sf_dir)))
    return made.select("path", "file_size", sound["sample_rate"].alias("rate"), sound["channels"].alias("channels"), sound["bits_per_sample"].alias("bits"), w.total_samples(sound["samples"]).alias("frames"), F.round(F.get(F.get(sound["samples"], 1), 4).cast("double"), 6).alias("fifth_right"), F.round(F.col("rms").cast("double"), 5).alias("rms"), F.coalesce("error", F.lit("")).alias("error"))


def lazy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _wave_files(spark, sf_dir).filter(F.regexp_extract("path", r"\d+", 0).cast("long") % 4 != 0)
    wanted = _wave_files(spark, sf_dir).select("path")
    return audio.load_missing_too(wanted, audio.decoded(there)).select("path", F.col("sound").isNotNull().alias("loaded"), F.coalesce("error", F.lit("")).alias("error"))


def in_memory_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.array("embedding", F.transform("embedding", lambda v: v * F.lit(0.5).cast("float"))).alias("given"))
    made = audio.with_features(audio.of_arrays(rows, "given", 48000, 24))
    return made.select("vec_id", "sound.sample_rate", "sound.channels", F.col("sound.bits_per_sample").alias("bits"), w.total_samples(F.col("sound.samples")).alias("frames"), F.round(F.col("rms").cast("double"), 5).alias("rms"), F.round("memory_mb", 9).alias("megabytes"))


def format_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    sound = F.struct(F.when(k % 2 == 0, 44100).otherwise(48000).alias("sample_rate"), (k % 3).cast("int").alias("channels"), F.lit(16).alias("bits_per_sample"), F.array(F.slice("embedding", F.lit(1), (k % 5 + 1).cast("int"))).alias("samples"))
    one = tables.table(spark, sf_dir, "embeddings").select("vec_id", sound.alias("a"))
    other = one.select((F.col("vec_id") - 6).alias("vec_id"), F.col("a").alias("b"))
    return one.join(other, "vec_id").select("vec_id", w.same_format(F.col("a"), F.col("b")).alias("same"))


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.failures(audio.decoded(_wave_files(spark, sf_dir)))


# forms and lists


def path_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".bms", ".BME", ".wav", "")]), (k % 4 + 1).cast("int"))
    typed = F.when(k % 13 == 0, "  ").when(k % 5 == 0, F.concat(F.lit('"songs/'), "p_name", ext, F.lit('"'))).otherwise(F.concat(F.lit("songs/"), "p_name", ext))
    made = tables.table(spark, sf_dir, "part").select("p_partkey", typed.alias("typed"), F.when(k % 3 == 0, "").otherwise("out/x.bms").alias("out"))
    return made.select("p_partkey", text.input_path_error(F.col("typed"), k % 7 != 0).alias("input_error"), text.output_path_error(F.col("out"), k % 2 == 0).alias("output_error"), text.paths_specified(F.col("typed"), F.col("out")).alias("specified"))


def all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.files(spark, sf_dir).select("idx", F.concat((F.col("idx") % 130 - 10).cast("string"), F.lit("%")).alias("threshold"), "num", ids.encode((F.col("idx") * 41 % 1296).cast("int"), 36).alias("end_id"))
    each = [ids.field_error(f, F.col("threshold"), F.col("num"), F.col("end_id")) for f in ("threshold", "start", "end")]
    return made.select("idx", ids.all_errors(*each, separator="; ").alias("errors"))


def display_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    flag = F.when(k % 3 != 2, k % 3 == 0)
    word = F.when(k % 4 == 1, "").when(k % 4 != 2, F.col("p_brand"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.opacity(flag).alias("opacity"), text.is_half(text.opacity(flag)).alias("half"), text.inverse(flag).alias("inverse"), word.isNotNull().alias("there"), text.is_blank(word).alias("blank"))


def row_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    return facets.without(files, files.filter("idx % 7 = 3 or file_size > 45")).select("path", "idx")


def licence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 10 == 0).alias("is_app"))
    return facets.licences(rows).select("place", "name", "is_app")


QUERIES = {
    f.__name__: f
    for f in (
        id_encode_36, id_encode_62, id_decode_62, id_invalid_flags, range_validate, field_validate, threshold_parse, processing_range,
        path_functions, chart_names, display_conversions,
        line_classify, wav_def_scan, file_list, numbered_paths, channel_filter, base_detection,
        keep_first_dedup, survivor_renumber, final_id_map, token_rewrite, change_definition, undefined_refs_anti, unused_paths_anti,
        vec_rms, vec_normalize, vec_peak_normalize, vec_rms_normalize, leading_silence, deinterleave, load_statistics,
        pearson_pairs, pearson_raw_edgecases, r_squared_pairs, block_keys, keyword_block_keys, keyword_totals, group_chunking,
        band_join_pairs, exact_name_pairs, matching_pairs,
        filename_tokens, word_counts_having, prefix_facets_topk, instrument_best_match, instrument_facets, text_and_set_filter, chip_filter, keyword_first_match, name_lookup,
        reduction_stats, reduction_rate, replace_root_resolution, threshold_grid, optimal_threshold_topone, sweep_take_while,
        greedy_clusters, component_clusters, sweep_counts, reduce_pipeline, find_optimum,
        wave_decode, lazy_load, in_memory_sounds, format_compat, first_failures,
        path_validate, all_errors, display_flags, row_removal, licence_order,
    )
}
