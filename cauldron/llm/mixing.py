"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame operations only).

Sources in code-point order (null last) weigh ``weights`` over and over and
share ``share`` of all words; a target stops at ``repeats`` times its source's
words and the excess is reshared by weight (one water level solves that).

Each source's documents, in an order given by a hash, form one stream of
words, cut into blocks of equal length; a source's target is a quota of
blocks. The tree splits the vector of quotas in two halves again and again,
each time by a multivariate hypergeometric draw (source by source, each a
hypergeometric by inversion), until every output shard has its own exact
quotas. A shard then takes the next blocks of each source's permutation, one
permutation for each pass over the source, so shards are disjoint within a
pass; inside a shard a hash orders the pieces.

Nothing is drawn at random at run time: every draw hashes ``seed`` and its
place, so reruns and retried tasks agree. Running positions come from sums by
hash bucket plus a window inside a bucket, so no task holds a whole source.
The summary of sources (one row each) is the only table sorted in one task.

Edge cases: null or empty text has size 0 and takes nothing; a null source is
a source of its own; a source without words has target 0; repeated rows are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columnar import WORD_PATTERN, stage

#: Longest block in words; a source has at least MIN_BLOCKS blocks if it has the words for them.
BLOCK_WORDS, MIN_BLOCKS = 4096, 128
#: Rows that a bucket of the running sums should hold.
BUCKET_ROWS = 2_048
SHARDS_LOG2 = 6
#: Words of the mix that a part of a shard should hold: one task shuffles and writes a part.
PART_WORDS = 1 << 22
#: Primes above any block count (blocks of a source stay below 2^30): multipliers of the block permutations.
_PRIMES = (1610612741, 1879048201, 1200000041, 1400000023, 1300000003, 1500000001)
_LEVELS_A_STAGE = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float, weights: tuple, repeats: int) -> DataFrame:
    """source, source_size, rank and target of every source in ``sized`` (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = ranked.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # sources fill up in the order of cap / weight; the level is right at the first source that it doesn't fill
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.greatest(F.lit(0.0), F.coalesce(level["level"], F.lit(float("inf")))) * F.col("weight"))
    return levelled.withColumn("target", target).select("source", "source_size", "n_docs", "rank", "target")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` of ``total`` of which ``good`` are good, by inversion at ``u``.

    Weights follow the ratio of neighbouring probabilities, over eight
    standard deviations around the mean: what lies outside is below 1e-14.
    """
    n, k, m = (c.cast("double") for c in (total, good, drawn))
    mean = F.when(n > 0, k * m / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - m) / (n - 1)))).otherwise(0.0) * 8 + 2
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - spread)).cast("long")
    high = F.least(k, m, F.ceil(mean + spread)).cast("long")

    def ratio(x):  # P(x + 1) / P(x)
        return (k - x) * (m - x) / ((x + 1.0) * (n - k - m + x + 1.0))

    places = F.sequence(low, high)
    one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(places, one, lambda s, x: F.struct(
        F.when(x < high, s["w"] * ratio(x.cast("double"))).otherwise(0.0).alias("w"), (s["sum"] + s["w"]).alias("sum")),
        lambda s: s["sum"])
    start = F.struct(F.lit(1.0).alias("w"), (whole * u).alias("left"), F.lit(None).cast("long").alias("x"))
    return F.aggregate(places, start, lambda s, x: F.struct(
        F.when(x < high, s["w"] * ratio(x.cast("double"))).otherwise(0.0).alias("w"),
        (s["left"] - s["w"]).alias("left"),
        F.coalesce(s["x"], F.when(s["left"] - s["w"] <= 0, x)).alias("x")), lambda s: F.coalesce(s["x"], high))


def split_quotas(quotas: DataFrame, shards_log2: int = SHARDS_LOG2, seed: int = 8) -> DataFrame:
    """shard and quotas (array by source rank) from one row with the array ``quotas``; halves by hypergeometric draws."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")

    def add(a, b):
        return a + b

    for level in range(shards_log2):
        total = F.aggregate("quotas", F.lit(0).cast("long"), add)
        begin = F.struct(total.alias("total"), F.floor((total + F.col("node") % 2) / 2).cast("long").alias("room"),
                         F.array().cast("array<bigint>").alias("left"))

        def draw(s, j):
            q = F.element_at(F.col("quotas"), j)
            x = hypergeometric(s["total"], q, s["room"], _uniform(F.lit(seed), F.col("node"), j))
            return F.transform(F.array(x), lambda x: F.struct(
                (s["total"] - q).alias("total"), (s["room"] - x).alias("room"),
                F.concat(s["left"], F.array(x)).alias("left")))[0]

        index = F.when(F.size("quotas") > 0, F.sequence(F.lit(1), F.size("quotas"))).otherwise(F.array().cast("array<int>"))
        halves = nodes.withColumn("left", F.aggregate(index, begin, draw, lambda s: s["left"]))
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")))).alias("half")).select("half.*")
        if level % _LEVELS_A_STAGE == _LEVELS_A_STAGE - 1:
            nodes = nodes.repartition(F.col("node"))
    return nodes.select((F.col("node") - (1 << shards_log2)).alias("shard"), "quotas")


def plan(sized: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), repeats: int = 2,
         shards_log2: int = SHARDS_LOG2, seed: int = 8) -> DataFrame:
    """One row a source: its target, block length, blocks, quota, permutations and the first position of every shard."""
    rows = targets(sized, share, weights, repeats)
    size = F.col("source_size")
    # blocks of equal length, the last one nearly so
    fewest = F.greatest(F.least(size, F.lit(MIN_BLOCKS)), F.ceil(size / BLOCK_WORDS), F.lit(1))
    rows = rows.withColumn("length", F.greatest(
        F.lit(1), F.ceil(size / fewest), F.ceil(size / float(1 << 30))).cast("long"))
    rows = rows.withColumn("blocks", F.ceil(size / F.col("length")).cast("long"))
    rows = rows.withColumn("quota", F.when(size > 0, F.least(
        F.floor(F.col("target") * F.col("blocks") / size + 0.5), F.col("blocks") * repeats)).otherwise(0).cast("long"))
    passes = F.array(*[F.lit(e) for e in range(repeats)])
    primes = F.array(*[F.lit(p).cast("long") for p in _PRIMES])
    rows = rows.withColumn("factors", F.transform(passes, lambda e: F.element_at(
        primes, (F.pmod(F.xxhash64(F.lit(seed), "rank", e), F.lit(len(_PRIMES))) + 1).cast("int"))))
    rows = rows.withColumn("shifts", F.transform(passes, lambda e: F.pmod(
        F.xxhash64(F.lit(seed + 1), "rank", e), F.greatest("blocks", F.lit(1)))))
    rows = stage(rows, "mixing-sources")
    vector = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda r: r["quota"]).alias("quotas"))
    leaves = split_quotas(vector, shards_log2, seed)
    cells = leaves.select("shard", F.posexplode("quotas").alias("rank", "n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("first", first).groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("shard", "first"))), lambda c: c["first"]).alias("starts"))
    return rows.join(starts, "rank", "left")


def planned(docs: DataFrame, **how) -> DataFrame:
    """``plan`` of rows with source and ``_size``, written."""
    sized = docs.select(F.col("source").cast("string").alias("source"), F.col("_size").alias("size"))
    return stage(plan(sized, **how), "mixing-plan")


def draw(docs: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), repeats: int = 2,
         shards_log2: int = SHARDS_LOG2, seed: int = 8, sources: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ``_size``, ``_order`` and others) with its source's plan and its pieces.

    Added: source_size, target and pieces, an array of shard, epoch, and the
    begin and end of the drawn words in the document.
    """
    source = F.col("source").cast("string")
    if sources is None:
        sources = planned(docs, share=share, weights=weights, repeats=repeats, shards_log2=shards_log2, seed=seed)
    # running position of each row in its source: sums by bucket, then a window inside the bucket
    buckets = max(1, -(-(sources.agg(F.sum("n_docs")).first()[0] or 0) // BUCKET_ROWS))
    placed = docs.withColumn("_source", source).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
    sums = placed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id")
    rows = placed.withColumn("_run", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("_start", F.col("_base") + F.col("_run") - F.col("_size"))
    plans = sources.select(F.col("source").alias("_p"), "source_size", "target", "length", "blocks", "quota", "factors",
                           "shifts", "starts")
    rows = rows.join(plans, F.col("_source").eqNullSafe(F.col("_p")))
    start, end, length = F.col("_start"), F.col("_start") + F.col("_size"), F.col("length")

    def piece(block, epoch):
        place = epoch * F.col("blocks") + F.pmod(
            block * F.element_at("factors", epoch + 1) + F.element_at("shifts", epoch + 1), F.col("blocks"))
        return F.struct(
            place.cast("long").alias("place"), F.lit(epoch).alias("epoch"),
            (F.greatest(start, block * length) - start).cast("long").alias("begin"),
            (F.least(end, (block + 1) * length) - start).cast("long").alias("end"))

    touched = F.sequence(F.floor(start / length).cast("long"), F.floor((end - 1) / length).cast("long"))
    every = F.flatten(F.transform(F.array(*[F.lit(e) for e in range(repeats)]),
                                  lambda e: F.transform(touched, lambda b: piece(b, e))))
    drawn = F.filter(every, lambda p: p["place"] < F.col("quota"))
    shard = F.transform(drawn, lambda p: F.struct(
        (F.size(F.filter("starts", lambda s: s <= p["place"])) - 1).alias("shard"), p["epoch"].alias("epoch"),
        p["begin"].alias("begin"), p["end"].alias("end")))
    empty = F.array().cast("array<struct<shard:int,epoch:int,begin:bigint,end:bigint>>")
    rows = rows.withColumn("pieces", F.when(F.col("_size") > 0, shard).otherwise(empty))
    return rows.select(*docs.columns, "source_size", "target", "pieces")


def words_taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["begin"])


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and pieces of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("_size"),
                       F.xxhash64(F.lit(how.get("seed", 8)), "doc_id", "text").alias("_order"))
    drawn = draw(stage(rows, "mixing-sizes"), **how)
    return drawn.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                        words_taken(F.col("pieces")).alias("taken"), "pieces")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows with the columns of ``docs``, ``text`` the words drawn, in shards ordered by a hash.

    A shard consists of parts, ranges of that hash, whose number follows the
    words of the mix; a task writes whole parts. Neighbouring pieces that a
    pass draws from one document stay together, in the shard of the first, so
    a shard's words differ from its quotas by what documents cross its blocks'
    borders; a document drawn whole keeps its text as it is.
    """
    seed, names = how.get("seed", 8), docs.columns
    # the other columns travel under names that can't clash
    own = {"doc_id", "source", "text"}
    aliases = [n if n in own else f"_c{i}" for i, n in enumerate(names)]
    docs = docs.toDF(*aliases)
    chars = aliases[names.index("n_chars")] if "n_chars" in names else None
    rows = docs.withColumn("_size", word_count(F.col("text"))).withColumn(
        "_order", F.xxhash64(F.lit(seed), "doc_id", "text"))
    sources = planned(rows, **how)
    drawn = draw(rows, sources=sources, **how)
    kind = "array<struct<shard:int,epoch:int,begin:bigint,end:bigint>>"

    def grow(runs, p):
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] == p["begin"]) & (
            F.try_element_at(runs, F.lit(-1))["epoch"] == p["epoch"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            last["shard"].alias("shard"), last["epoch"].alias("epoch"), last["begin"].alias("begin"),
            p["end"].alias("end"))))).otherwise(F.concat(runs, F.array(p)))

    runs = F.aggregate("pieces", F.array().cast(kind), grow)
    out = drawn.withColumn("_run", F.explode(runs))
    whole = (F.col("_run.begin") == 0) & (F.col("_run.end") == F.col("_size"))
    white = r"[\x20\x09-\x0D]"
    parts = F.split(F.regexp_replace(F.col("text"), f"^{white}+", ""), f"(?<={white})(?=[^\\x20\\x09-\\x0D])")
    cut = F.array_join(F.slice(parts, (F.col("_run.begin") + 1).cast("int"),
                               (F.col("_run.end") - F.col("_run.begin")).cast("int")), "")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if chars:
        out = out.withColumn(chars, F.when(whole, F.col(chars)).otherwise(F.length("text")).cast(docs.schema[chars].dataType))
    local = F.xxhash64(F.lit(seed + 2), "_run", "_order")
    words = sources.agg(F.sum("target")).first()[0] or 0
    parts_log2 = (int(words) // (PART_WORDS << how.get("shards_log2", SHARDS_LOG2))).bit_length()
    part = F.shiftright("_local", 64 - parts_log2) if parts_log2 else F.lit(0).cast("long")
    out = out.withColumn("_shard", F.col("_run.shard")).withColumn("_local", local).withColumn("_part", part)
    out = out.repartition(F.col("_shard"), F.col("_part"))
    return out.sortWithinPartitions("_shard", "_part", "_local").select(*aliases).toDF(*names)
