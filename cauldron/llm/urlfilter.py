"""URL filters: rules on a host suffix and a path prefix, met by hashes of what a URL expands to.

A URL is split into host and path. Every host suffix (whole labels) with every
path prefix whose shape (number of labels, length of the path) some rule has
is an expression of the URL. Expressions and rules meet in an equi-join on the
first eight hex digits of their SHA-256; a meeting counts only if the whole
digests agree. Of the rules that fit, the one with the longest host and path
wins, then the one with more labels, then a block over an allow. The rule is
known by its shape, so a row carries one number through the join and the
aggregation, and whole-stage code runs it all.

The rules are broadcast up to ``SHARED_RULES`` rows of fixed size; beyond that
both sides are dealt by (prefix, salt), as an expression like ``com/`` belongs
to a large share of all URLs. Rules of more than ``SHAPES`` shapes make every
prefix up to the longest rule an expression.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
rule, and the default verdict. A port or user name is part of the host. Very
long URLs expand to the rules' shapes only. Every row is judged by itself,
repeated ones too; null ids stay. A rule without host or action is no rule, a
null path is an empty one; repeated rules count once, and of an allow and a
block on the same place the block wins. Empty tables give no rows, no rules
the default. Other columns, clashing names included, are not looked at.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from .columnar import columns

SHARED_RULES = 100_000
SHAPES = 500
SALTS = 16
PREFIX_DIGITS = 8
DEFAULT = "allow"
_LABELS = 1 << 20  # labels and action take the lower bits of a rule's weight


def parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path) of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def suffix(host: Column, count: Column) -> Column:
    """The last ``count`` labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -count)


def weighed(rules: DataFrame) -> DataFrame:
    """digest, prefix, labels, path_length and weight (length, labels, block or allow as one number) of each rule."""
    whole = columns(rules, host="string", path="string", action="string").where("host IS NOT NULL AND action IN ('allow', 'block')")
    host, path = F.translate("host", ascii_uppercase, ascii_lowercase), F.coalesce("path", F.lit(""))
    cut = whole.select(F.sha2(F.concat(host, path), 256).alias("digest"), labels(host).alias("labels"),
                       F.length(path).alias("path_length"), F.length(F.concat(host, path)).alias("size"),
                       F.when(F.col("action") == "block", 1).otherwise(0).alias("blocks"))
    number = F.col("size").cast("long") * (2 * _LABELS) + F.col("labels") * 2 + F.max("blocks")
    return cut.groupBy("digest", "labels", "path_length", "size").agg(number.alias("weight")).select(
        F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), "digest", "labels", "path_length", "weight")


def _shapes(rules: DataFrame, limit: int) -> Column:
    """The (labels, path length) pairs that rules have, as an array; all up to the largest where there are too many."""
    pairs = rules.select("labels", "path_length").distinct().orderBy("labels", "path_length").limit(limit + 1).collect()
    if len(pairs) <= limit:
        made = [F.struct(F.lit(p.labels).alias("labels"), F.lit(p.path_length).alias("length")) for p in pairs]
        return F.array(*made) if made else F.from_json(F.lit("[]"), "array<struct<labels:int,length:int>>")
    most = rules.agg(F.max("labels").alias("labels"), F.max("path_length").alias("length")).first()
    counts = F.sequence(F.lit(1), F.least(labels(F.col("host")), F.lit(most.labels)))
    lengths = F.sequence(F.lit(0), F.least(F.length("path"), F.lit(most.length)))
    return F.flatten(F.transform(counts, lambda n: F.transform(
        lengths, lambda size: F.struct(n.alias("labels"), size.alias("length")))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, shared_rules: int = SHARED_RULES,
          shapes: int = SHAPES) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row of ``pages`` (page_id, url).

    ``rules`` has host, path and action (allow or block).
    """
    known = weighed(rules)
    few = known.limit(shared_rules + 1).count() <= shared_rules
    host, path = parts(F.col("url"))
    split = columns(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    # an id of the row in this scan: the rows of one page meet again in one group, which a map-side step already forms
    split = split.withColumn("row", F.monotonically_increasing_id())
    fitting = F.filter(_shapes(known, shapes), lambda s: (s["labels"] <= labels(F.col("host"))) & (s["length"] <= F.length("path")))
    spelt = F.transform(fitting, lambda s: F.concat(suffix(F.col("host"), s["labels"]), F.left(F.col("path"), s["length"])))
    asked = split.select("*", F.explode_outer(spelt).alias("expression")).withColumn("asked", F.sha2("expression", 256))
    asked = asked.withColumn("prefix", F.substring("asked", 1, PREFIX_DIGITS)).drop("expression")
    known = known.select("prefix", "digest", "weight")
    if few:
        met = asked.join(F.broadcast(known), "prefix", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    best = met.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(F.col("digest") == F.col("asked"), F.col("weight"))).alias("weight"))
    count = F.shiftright(F.pmod("weight", F.lit(2 * _LABELS)), 1).cast("int")
    tail = suffix(F.col("host"), count)
    length = F.shiftright("weight", 21).cast("int") - F.length(tail)
    verdict = F.when(F.col("weight").isNull(), default).when(F.col("weight") % 2 == 1, "block").otherwise("allow")
    return best.select("page_id", "host", "path", F.concat(tail, F.left(F.col("path"), length)).alias("rule"), verdict.alias("verdict"))
