"""Names that are used but not defined, with suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.lineage import written


def names_used(bookings: DataFrame, name: str) -> DataFrame:
    """(service_legacy_id, name): the distinct names that bookings of a service use."""
    return bookings.select(text.strip("service_legacy_id").alias("service_legacy_id"), text.strip(name).alias(name)).where(f"service_legacy_id <> '' and {name} <> ''").distinct()


def _grams(c: Column) -> Column:
    """The distinct runs of three characters of a text, whole if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(3))))


def containing(words: DataFrame, names: DataFrame) -> DataFrame:
    """(key, word, defined): the names (key, defined) that contain a word (key, word), whatever their case.

    Names are listed by key and each of their runs of three characters. A word meets the
    shortest of its runs' lists alone, if all its runs have one, and the names in it are
    tested for the word. A word of fewer than three characters meets the lists of the
    runs that start with it or hold it behind.
    """
    lists = written(names.select("key", "defined", F.explode(_grams(F.lower("defined"))).alias("gram")), "grams")
    sizes = lists.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = words.withColumn("grams", _grams(F.col("word")))
    long = asked.where(F.length("word") >= 3).select("key", "word", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    rarest = long.join(sizes, ["key", "gram"]).groupBy("key", "word", "of").agg(F.count(F.lit(1)).alias("have"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("have = of").select("key", "word", "gram")
    short = asked.where((F.length("word") < 3) & (F.col("word") != ""))
    if not short.isEmpty():
        hold = sizes.withColumnRenamed("gram", "_gram").join(short.select(F.col("key"), "word"), "key").where(F.col("_gram").contains(F.col("word")))
        rarest = rarest.unionByName(hold.select("key", "word", F.col("_gram").alias("gram")))
    return rarest.join(lists, ["key", "gram"]).where(F.lower("defined").contains(F.col("word"))).select("key", "word", "defined").distinct()


def undefined_names(usage: DataFrame, catalog: DataFrame, service_map: DataFrame, name: str, map_key: str) -> DataFrame:
    """(service_name, name, suggestions) of used names that the service's catalog lacks.

    usage: (service_legacy_id, name); catalog: (key, name), its key being the map's
    column `map_key`. Suggested are the service's names that contain a word of the used
    one, also inside a word; they are found by an index of the catalog's letters in threes.
    """
    used = usage.select(text.strip("service_legacy_id").alias("_src_id"), text.strip(name).alias(name)).where(f"_src_id <> '' and {name} <> ''").distinct()
    defined = catalog.toDF("key", "defined").select(text.strip("key").alias("key"), text.strip("defined").alias("defined")).where("key <> '' and defined <> ''").distinct()
    m = service_map.where(~text.is_blank("source_service_id")).groupBy(text.strip("source_service_id").alias("_src_id")).agg(F.max_by(F.struct(text.strip(map_key).alias("key"), text.strip("service_name").alias("service_name")), "map_ord").alias("m"))
    used = used.join(m, "_src_id").select("m.key", "m.service_name", name)
    missing = used.join(defined.withColumnRenamed("defined", name), ["key", name], "left_anti")
    words = missing.select("key", name, F.explode(F.array_distinct(text.search_words(name))).alias("word"))
    found = containing(words.select("key", "word").distinct(), defined.distinct())
    near = words.join(found, ["key", "word"]).select("key", name, "defined").distinct().groupBy("key", name).agg(F.array_join(F.array_sort(F.collect_set("defined")), "; ").alias("suggestions"))
    return missing.join(near, ["key", name], "left").select("service_name", name, F.coalesce("suggestions", F.lit("(no match found)")).alias("suggestions"))
