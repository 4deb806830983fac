"""Text files read in splits, with the place of every record: line numbers, and the objects of large JSON arrays.

Spark's text reader cuts files at any byte and hands records out in splits.
What a record means can depend on all that comes before it in its file: how
many lines there are, whether a string is open, how deep the braces nest. Each
split is summed up by itself, the sums run over the few splits of a file, and
every record adds its own place within its split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_stage_table

_SPLIT = ["file", "split"]


def _records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, split (its first byte), at (ascends within the split) and value of each record."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")


def _before(splits: DataFrame, *sums: str) -> DataFrame:
    """``sums`` of each split turned into those of all earlier splits of its file (one row a split)."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(*_SPLIT, *[c for c in splits.columns if c not in _SPLIT and c not in sums],
                         *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted) and value of every line."""
    lines = _records(spark, path)
    splits = lines.groupBy(*_SPLIT).agg(F.count("*").alias("before"), F.min("at").alias("first"))
    placed = lines.join(_before(splits, "before"), _SPLIT)
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def _quotes(text: Column) -> Column:
    """Number of quotes that open or close a string: those left when escape pairs are gone."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '[^"]', ""))


def _opened(text: Column) -> Column:
    """Number of opening braces outside strings, for text that starts outside one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^{]", ""))


def _depth(text: Column, inside: Column) -> Column:
    """Change of depth over a fragment and the brace that ends it, if it starts inside a string or not."""
    opens = F.when(inside, _opened(F.concat(F.lit('"'), text))).otherwise(_opened(text))
    ends_inside = (F.when(inside, 1).otherwise(0) + _quotes(text)) % 2 == 1
    return opens - F.when(ends_inside, 0).otherwise(1)


def array_objects(spark: SparkSession, path: str, wrapper: str = "customers") -> DataFrame | None:
    """file and text of every object of JSON documents that are an array, or an object that begins with ``wrapper``'s array.

    A document is read in as many tasks as Spark splits it into: fragments
    end at closing braces, wherever a split begins. Quotes before a fragment
    tell whether it starts in a string, braces before it how deep. Nearly all
    objects are one fragment; those with inner braces are put together by
    their number. None if a document has another form.
    """
    cut = _records(spark, path, "}")
    head = rf'^\s*\{{\s*"{wrapper}"\s*:\s*\['
    starts = cut.where("split = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"))
    known = F.col("head").rlike(r"^\s*\[") | F.col("head").rlike(head)
    if not starts.where(~F.coalesce(known, F.lit(False))).isEmpty():
        return None
    run = Window.partitionBy(*_SPLIT).orderBy("at")
    upto, earlier = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("odd", F.coalesce(F.sum(_quotes(F.col("value"))).over(earlier), F.lit(0)) % 2 == 1)
    # both cases: the split starts outside a string, or inside one
    cut = cut.withColumns({"out": _depth(F.col("value"), F.col("odd")), "in": _depth(F.col("value"), ~F.col("odd"))})
    cut = cut.withColumns({"run_out": F.sum("out").over(upto), "run_in": F.sum("in").over(upto)})
    cut = write_stage_table(cut, "fragments")
    splits = cut.groupBy(*_SPLIT).agg(F.sum(_quotes(F.col("value"))).alias("quotes"), F.sum("out").alias("out_all"), F.sum("in").alias("in_all"))
    splits = _before(splits, "quotes").withColumn("inside", F.col("quotes") % 2 == 1).withColumn(
        "depth", F.when(F.col("inside"), F.col("in_all")).otherwise(F.col("out_all")))
    splits = _before(splits.select(*_SPLIT, "inside", "depth"), "depth")
    cut = cut.join(splits, _SPLIT).join(starts.select("file", "first", F.col("head").rlike(head).cast("int").alias("base")), "file")
    cut = cut.withColumns({
        "after": F.col("depth") + F.when(F.col("inside"), F.col("run_in")).otherwise(F.col("run_out")),
        "change": F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))})
    first = (F.col("split") == 0) & (F.col("at") == F.col("first"))
    text = F.when(first, F.regexp_replace("value", rf"{head}|^\s*\[", "")).otherwise(F.col("value"))
    cut = cut.select(*_SPLIT, "at", text.alias("value"), (F.col("after") == F.col("base")).alias("ends"),
                     (F.when(first, F.col("base")).otherwise(F.col("after") - F.col("change")) == F.col("base")).alias("begins"))
    whole = cut.where("begins AND ends")
    # an object in several fragments: a number for each, from the ends before it
    pieces = cut.where("NOT (begins AND ends)").withColumn("new", F.col("begins").cast("int"))
    earlier = _before(pieces.groupBy(*_SPLIT).agg(F.sum("new").alias("objects")), "objects")
    pieces = pieces.withColumn("object", F.sum("new").over(upto)).join(earlier, _SPLIT).withColumn("object", F.col("object") + F.col("objects"))
    joined = pieces.groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts")) \
        .select("file", F.array_join(F.transform("parts", lambda p: p["value"]), "}").alias("value"))
    objects = whole.select("file", "value").unionByName(joined).where(F.instr("value", "{") > 0)
    return objects.select("file", F.concat(F.regexp_replace("value", r"^[\s,]*", ""), F.lit("}")).alias("text"))
