"""Options by place: configuration files in folders, the nearest of which holds for a document.

A folder's configuration lies in one of two files (`NAMES`, the first wins where both are there).
For a document that of the nearest folder above it counts, layered over the user's own, field by
field: a list or flag that it sets takes the place of the user's, maps are merged key by key.
Folders, not documents, are matched with configurations: each folder that holds documents is
joined with its ancestors, a few for each, and the longest that has a file wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.model import RuleSet

NAMES = (".prose/config.json", "prose.config.json")
OPTIONS = "struct<enable:array<string>,disable:array<string>,severity:map<string,string>,thresholds:map<string,double>,markdown:boolean>"


def _ids(rules: RuleSet) -> Column:
    """Each id and each name that stands for one."""
    known = {r.id: r.id for r in rules.rules} | {r.name: rules.resolve(r.name) for r in rules.rules if rules.resolve(r.name)}
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")


def parsed(content: Column, path: Column, rules: RuleSet) -> Column:
    """The options in a file, rules by their ids; names that no rule or several have do nothing. A file that is no such JSON object is an error that names it."""
    schema = "enable array<string>, disable array<string>, severity map<string,string>, thresholds map<string,double>, markdown boolean, __bad string"
    read = F.from_json(content, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    ids = _ids(rules)
    named = lambda c: F.filter(F.transform(c, lambda x: F.try_element_at(ids, x)), lambda x: x.isNotNull())

    def keyed(c: Column) -> Column:
        # a full id wins over a name that stands for it
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(F.try_element_at(ids, e["key"]).alias("id"), (e["key"] == F.try_element_at(ids, e["key"])).alias("full"), e["value"].alias("value")))
        known = F.filter(pairs, lambda p: p["id"].isNotNull() & p["value"].isNotNull())
        best = F.filter(known, lambda p: p["full"] | ~F.exists(known, lambda q: q["full"] & (q["id"] == p["id"])))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(best, lambda p: p["id"])), lambda i: F.struct(i.alias("key"), F.element_at(F.filter(best, lambda p: p["id"] == i), 1)["value"].alias("value"))))

    severity = F.transform_values(read["severity"], lambda k, v: F.when(v == "info", "suggestion").otherwise(v))
    wrong = F.exists(F.map_values(severity), lambda v: ~v.isin("error", "warning", "suggestion"))
    out = F.struct(named(read["enable"]).alias("enable"), named(read["disable"]).alias("disable"), keyed(severity).alias("severity"), keyed(read["thresholds"]).alias("thresholds"), read["markdown"].alias("markdown"))
    bad = read.isNull() | read["__bad"].isNotNull() | F.coalesce(wrong, F.lit(False))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(path, F.lit(": invalid configuration"))).cast(OPTIONS)).otherwise(out.cast(OPTIONS))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def configurations(files: DataFrame, rules: RuleSet) -> DataFrame:
    """folder and options of the configuration files among `files` (path, content); others are left out."""
    ending = [F.col("path").endswith("/" + n) | (F.col("path") == n) for n in NAMES]
    rank = F.when(ending[0], 0).when(ending[1], 1)
    folder = F.when(rank == 0, folder_of(folder_of(F.col("path")))).otherwise(folder_of(F.col("path")))
    own = files.where(rank.isNotNull()).select(folder.alias("folder"), F.struct(rank.alias("rank"), "path", "content").alias("f"))
    first = own.groupBy("folder").agg(F.min("f").alias("f"))
    return first.select("folder", parsed(F.col("f.content"), F.col("f.path"), rules).alias("options"))


def read_configurations(spark: SparkSession, folder: str, rules: RuleSet, levels: int = 16) -> DataFrame:
    """The configurations in a folder and below. Spark's listing leaves hidden folders out; those are asked for by pattern, up to `levels` folders down."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = [s.getPath().toString() for n in range(levels + 1) for s in system.globStatus(hadoop.Path(folder + "/*" * n + "/" + NAMES[0])) or ()]
    read = lambda: spark.read.format("binaryFile")
    files = read().option("recursiveFileLookup", True).option("pathGlobFilter", NAMES[1]).load(folder)
    files = files.unionByName(read().load(hidden)) if hidden else files
    return configurations(files.select("path", F.col("content").cast("string").alias("content")), rules)


def _merged(base: Column, over: Column) -> Column:
    both = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)
    return F.when(base.isNotNull() & over.isNotNull(), both).otherwise(F.coalesce(over, base))


def layered(base: Column, over: Column) -> Column:
    """Options with others on top, field by field."""
    taken = [F.coalesce(over[c], base[c]).alias(c) for c in ("enable", "disable")]
    maps = [_merged(base[c], over[c]).alias(c) for c in ("severity", "thresholds")]
    return F.struct(*taken, *maps, F.coalesce(over["markdown"], base["markdown"]).alias("markdown")).cast(OPTIONS)


def nearest(folders: DataFrame, configured: DataFrame) -> DataFrame:
    """folder, options and `from`, the folder whose configuration it is, of each of `folders` (folder) that has one above it."""
    parts = F.split("folder", "/", -1)
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    every = folders.select("folder", F.explode(above).alias("from"))
    found = every.join(configured.select(F.col("folder").alias("from"), "options"), "from")
    return found.groupBy("folder").agg(F.max_by(F.struct("options", "from"), F.length("from")).alias("x")).select("folder", "x.*")


def with_options(docs: DataFrame, configured: DataFrame, user: Column | None = None, call: Column | None = None) -> DataFrame:
    """`docs` (path, ...) with the `options` that hold for each (of the nearest folder over the user's, and those of the call over both), as `lint.find` takes them.
    A document without any has no options of its own; where a configuration says whether texts are Markdown, a column `markdown` does."""
    docs = docs.withColumn("__folder", folder_of(F.col("path")))
    near = nearest(docs.select(F.col("__folder").alias("folder")).distinct(), configured).select(F.col("folder").alias("__folder"), F.col("options").alias("__near"))
    df = docs.join(near, "__folder", "left")
    none = F.lit(None).cast(OPTIONS)
    held = layered(none if user is None else user.cast(OPTIONS), F.col("__near"))
    df = df.withColumn("options", held if call is None else layered(held, call.cast(OPTIONS))).drop("__near", "__folder")
    own = F.col("options.markdown")
    return df.withColumn("markdown", F.coalesce(own, F.col("markdown")) if "markdown" in docs.columns else F.coalesce(own, F.lit(False)))
