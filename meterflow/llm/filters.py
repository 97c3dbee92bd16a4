"""Filter interaction audit: what each filter of a chain removes, repeats and loses, for every order of the filters.

A filter is an id table of the rows that fail it. Left-anti joins with the tables of a set of filters give the rows that
the set leaves; a left-semi join with the next filter's table before them gives what it removes from those rows. What a
prefix of an order leaves depends on the prefix as a set alone, so 2^n sets serve all n! orders.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A text that as many rows hold as one in so many of all is looked up in a broadcast list, which its own definition bounds.
HOT_SHARE = 1000
WORDS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
NAMES = "ABCDE"


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text fails filters A to D."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def copies(rows: DataFrame) -> DataFrame:
    """(rid) of the rows of (rid, doc_id, digest) whose digest a smaller doc_id has; rows without doc_id are neither copies nor originals.

    Only digests that several doc_ids hold meet the rows again. The commonest of these, HOT_SHARE at most, are broadcast,
    so that no task gets all copies of one text.
    """
    known = rows.where("doc_id is not null").select("rid", "doc_id", "digest")
    total = rows.count()
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    firsts = written(firsts.select("digest", "first", (F.col("n") * HOT_SHARE >= total).alias("hot")))
    known = known.join(F.broadcast(firsts.where("hot").select("digest", F.col("first").alias("common"))), "digest", "left")
    rest = known.where("common is null").join(firsts.where("not hot"), "digest").where("doc_id > first")
    return known.where("doc_id > common").select("rid").unionAll(rest.select("rid"))


def text_relations(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows (rid, part, good, toxic) of docs, and for each of the filters A to E the (rid) that fail it.

    A: under 200 words. B: fewer than half as many distinct words as words. C: over 2 of 100 characters are A-Z. D: holds
    any of #$%&*|. E: the same text as a smaller doc_id's. A null text is empty, a null source the part ''. Rows are told
    apart by a number of their own, so null and repeated doc_ids are counted row by row; a row is good (toxic) if any label
    row of its doc_id says so. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("text", WORDS), lambda w: w != "")
    thin = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    failing = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in text_conditions(F.col("text"), F.col("words")).items()]))
    thin = written(thin.withColumn("words", words).select("rid", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failing.alias("failing")))
    failed = thin.select("rid", F.explode("failing").alias("filter")).unionAll(copies(thin).withColumn("filter", F.lit("E")))
    failed = written(failed, "filter")
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    base = thin.select("rid", "doc_id", "part").join(marks, "doc_id", "left").select("rid", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return written(base), {name: failed.where(F.col("filter") == name).select("rid") for name in NAMES}


def _surviving(rows: DataFrame, relations: dict[str, DataFrame], bits: dict[str, int]) -> DataFrame:
    """A row for each row and set of filters (`prefix`, by bits) that it passes: one left-anti join for each relation."""
    rows = rows.withColumn("prefix", F.lit(0))
    for name, failing in relations.items():
        bit = bits[name]
        rows = rows.withColumn("prefix", F.explode(F.array("prefix", F.col("prefix") + bit)))
        failing = failing.withColumnRenamed("rid", "failing")
        rows = rows.join(failing, (F.col("rid") == F.col("failing")) & (F.col("prefix").bitwiseAND(bit) != 0), "left_anti")
    return rows


def audit(base: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    base: (rid, part, good, toxic), rid unique. relations: for each filter, named by one letter, the (rid) that fail it,
    each once. Counts are of rows within the part: kept after this step, removed here, redundant (failing this filter,
    removed by one before it), unique_fails (failing this filter alone), good and toxic among those removed; shapley is
    the filter's removed summed over all orders. Steps that remove nothing have zeros; a table without rows has no parts.
    """
    names = sorted(relations)
    bits = {name: 1 << k for k, name in enumerate(names)}
    every = sum(bits.values())

    def key(prefix: Column | int, bit: Column | int) -> Column | int:
        """The place of what the filter `bit` removes after a prefix; bit 0 stands for what the prefix keeps."""
        return prefix * (every + 1) + bit

    cells = _surviving(base.select("rid", "part"), relations, bits).groupBy("part", "prefix").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")).withColumn("bit", F.lit(0))
    for name in names:
        failed = base.join(relations[name], "rid", "left_semi")
        lost = _surviving(failed, {x: r for x, r in relations.items() if x != name}, bits).groupBy("part", "prefix")
        sums = lost.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
        cells = cells.unionByName(sums.withColumn("bit", F.lit(bits[name])))
    entry = F.struct(key(F.col("prefix"), F.col("bit")).alias("key"), F.struct("n", "good", "toxic").alias("value"))
    sums = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("sums"))  # at most (n + 2) * 2^(n - 1) entries a part

    def at(prefix: Column | int, bit: Column | int, field: str) -> Column:
        place = key(prefix, bit)
        return F.coalesce(F.try_element_at(F.col("sums"), F.lit(place) if isinstance(place, int) else place)[field], F.lit(0).cast("long"))

    def weighted(name: str) -> Column:
        others = [b for x, b in bits.items() if x != name]
        sets = (s for k in range(len(names)) for s in itertools.combinations(others, k))
        return sum((at(sum(s), bits[name], "n") * (math.factorial(len(s)) * math.factorial(len(others) - len(s))) for s in sets), F.lit(0).cast("long"))

    def by_name(values: dict[str, Column]) -> Column:
        return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])

    fixed = sums.withColumns({"unique": by_name({n: at(every - b, b, "n") for n, b in bits.items()}), "shares": by_name({n: weighted(n) for n in names})})
    steps = fixed.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    before = F.expr("substring(filter_order, 1, step - 1)")
    steps = steps.withColumn("name", F.expr("substring(filter_order, step, 1)")).withColumn("bit", F.element_at(by_name({n: F.lit(b) for n, b in bits.items()}), F.col("name")))
    steps = steps.withColumn("prefix", sum((F.when(F.contains(before, F.lit(n)), b).otherwise(0) for n, b in bits.items()), F.lit(0)))
    prefix, bit = F.col("prefix"), F.col("bit")
    return steps.select(
        "part",
        "filter_order",
        "step",
        at(prefix + bit, F.lit(0), "n").alias("kept"),
        at(prefix, bit, "n").alias("removed"),
        (at(F.lit(0), bit, "n") - at(prefix, bit, "n")).alias("redundant"),
        F.element_at("unique", F.col("name")).alias("unique_fails"),
        at(prefix, bit, "good").alias("good_lost"),
        at(prefix, bit, "toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("name")).alias("shapley"),
    )
