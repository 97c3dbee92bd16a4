"""A meter's reading from the boxes of its digits, as expressions over one array for each photo.

boxes: array<struct<x1, x2, digit, p1, second, p2>>; digit and second are the two likeliest digits with their chances.
A photo has a handful of boxes, as many as the detector returns at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import standard_class

#: A gap is a missing digit from so many mean steps on; of the first positions none is filled.
GAP, CRITICAL = 1.6, 2


def best_boxes(boxes: DataFrame, most: dict[str, int]) -> DataFrame:
    """The surest boxes of each photo and class, as many as `most` says for the class (1 for others)."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("class")], F.lit(1)) if most else F.lit(1)
    ranked = boxes.withColumn("class", standard_class(F.col("class")))
    n = F.row_number().over(Window.partitionBy("photo", "class").orderBy(F.desc("conf"), "x1"))
    return ranked.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def first_of_class(boxes: Column, name: str) -> Column:
    """The first box of a class in the detector's order; null without one."""
    return F.get(F.filter(boxes, lambda b: standard_class(b["class"]) == name), F.lit(0))


def ordered(boxes: DataFrame) -> DataFrame:
    """(photo, boxes): the boxes of each photo from left to right."""
    return boxes.groupBy("photo").agg(F.array_sort(F.collect_list(F.struct("x1", "x2", "digit", "p1", "second", "p2"))).alias("boxes"))


def centers(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: F.floor((b["x1"] + b["x2"]) / 2).cast("int"))


def missing_position(boxes: Column, width: Column, expected: int = 5) -> Column:
    """Where, from 0, the one missing digit belongs: at the first wide gap, or at the edge with the much wider margin; null if neither is there."""
    c = centers(boxes)
    n = F.size(c)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(c, i + 1) - F.element_at(c, i))
    mean = (F.element_at(c, -1) - F.element_at(c, 1)) / (n - 1)
    wide = F.get(F.filter(F.transform(steps, lambda s, i: F.when(s > mean * GAP, i + 1)), lambda i: i.isNotNull()), F.lit(0))
    left, right = F.element_at(c, 1), width - F.element_at(c, -1)
    edge = F.when(right > left * GAP, expected - 1).when(left > right * GAP, 0)
    return F.when(n == expected - 1, F.coalesce(wide, edge))


def upper_median_width(boxes: Column) -> Column:
    """The middle width of the boxes, the upper of the two middle ones."""
    widths = F.array_sort(F.transform(boxes, lambda b: b["x2"] - b["x1"]))
    return F.get(widths, F.floor(F.size(widths) / 2).cast("int"))


def drum(box: Column, least: float) -> Column:
    """The lower of two neighbouring digits that together are sure (9 of 9 and 0): the drum stands between them."""
    a, b = box["digit"], box["second"]
    wraps = (F.least(a, b) == 0) & (F.greatest(a, b) == 9)
    return F.when(box["p1"] + box["p2"] >= least, F.when(wraps, F.lit(9)).when(F.abs(a - b) == 1, F.least(a, b)))


def readings(photos: DataFrame, conf: float, expected: int = 5, forgive: int = 0, missing: str = "5", forgiven: str = "0", missing_mode: str = "placeholder", forgiven_mode: str = "placeholder", drum_rule: bool = False) -> DataFrame:
    """photos (boxes, width, last, ...) with number, reading, error, filled and cells.

    Boxes are read from left to right. With one digit too few, its place is filled (missing_mode placeholder) or left to
    the operator as ?. An unsure digit is settled, in this order, by the drum rule, by forgiveness in the last `forgive`
    places, by the last reading if it alone is unsure, comes first and the last reading's digit is one of its two; else
    it is ? and there is no number. error is null, nothing, count, gap, critical or low_conf; filled says what was put in.
    A null or empty array gives the error nothing.
    """
    rows = photos.withColumn("_n", F.coalesce(F.size(F.col("boxes")), F.lit(0))).withColumn("_n", F.greatest("_n", F.lit(0)))
    rows = rows.withColumn("_at", missing_position(F.col("boxes"), F.col("width"), expected))
    fatal = F.when(F.col("_n") == 0, "nothing").when(~F.col("_n").isin(expected, expected - 1), "count")
    fatal = fatal.when((F.col("_n") == expected - 1) & F.col("_at").isNull(), "gap").when(F.col("_at") < CRITICAL, "critical")
    b, at = F.col("boxes"), F.col("_at")
    none = F.array(F.lit(None).cast(photos.schema["boxes"].dataType.elementType))
    whole = F.when(F.col("_n") == expected, b).otherwise(F.concat(F.slice(b, F.lit(1), at), none, F.slice(b, at + 1, F.lit(expected))))
    rows = rows.withColumn("_fatal", fatal).withColumn("_all", F.when(F.col("_fatal").isNull(), whole))

    def cell(box: Column, pos: Column) -> Column:
        as_text = box["digit"].cast("string")
        put = lambda char, kind: F.struct(char.alias("char"), F.lit(kind).alias("kind"), pos.alias("pos"), box.alias("box"))
        blank = put(F.lit("?"), "missing") if missing_mode == "operator" else put(F.lit(missing), "placed")
        out = F.when(box.isNull(), blank).when(box["p1"] >= conf, put(as_text, "read"))
        if drum_rule:
            out = out.when(drum(box, conf).isNotNull(), put(drum(box, conf).cast("string"), "drum"))
        if forgive:
            out = out.when(pos >= expected - forgive, put(as_text if forgiven_mode == "model" else F.lit(forgiven), "forgiven"))
        return out.otherwise(put(F.lit("?"), "unsure"))

    rows = rows.withColumn("cells", F.transform("_all", cell))
    open_ = F.filter("cells", lambda c: c["char"] == "?")
    digits = F.when(F.col("last") >= 0, F.floor("last").cast("bigint").cast("string"))
    first = F.when(F.length(digits) <= expected, F.substring(F.lpad(digits, expected, "0"), 1, 1))
    one = F.get(open_, F.lit(0))
    settled = (F.size(open_) == 1) & (one["pos"] == 0) & (one["kind"] == "unsure") & ((first == one["box"]["digit"].cast("string")) | (first == one["box"]["second"].cast("string")))
    rows = rows.withColumn("_first", F.when(settled, first))
    fixed = F.transform("cells", lambda c: F.when(F.col("_first").isNotNull() & (c["pos"] == 0), F.struct(F.col("_first").alias("char"), F.lit("last").alias("kind"), c["pos"].alias("pos"), c["box"].alias("box"))).otherwise(c))
    rows = rows.withColumn("cells", fixed)
    reading = F.concat_ws("", F.transform("cells", lambda c: c["char"]))
    rows = rows.withColumn("reading", F.when(F.col("_fatal").isNull(), reading))
    unsure = F.contains("reading", F.lit("?"))
    put_in = F.transform(F.filter("cells", lambda c: c["kind"].isin("placed", "drum", "forgiven", "last")), lambda c: F.format_string("pos%d='%s' (%s)", c["pos"], c["char"], c["kind"]))
    rows = rows.withColumn("error", F.coalesce("_fatal", F.when(unsure, "low_conf"))).withColumn("number", F.when(~unsure, F.col("reading").try_cast("bigint")))
    return rows.withColumn("filled", F.when(F.size(put_in) > 0, F.concat_ws(", ", put_in))).drop("_n", "_at", "_fatal", "_all", "_first")


def error_text(cells: Column, reading: Column) -> Column:
    """The note on a reading with unsure digits, in the form that digit_stats() takes apart; null where none is unsure."""
    bad = F.transform(F.filter(cells, lambda c: c["kind"] == "unsure"), lambda c: F.format_string("pos%d(pred=%d,conf=%.3f)", c["pos"], c["box"]["digit"], c["box"]["p1"]))
    return F.when(F.size(bad) > 0, F.concat(F.lit("low conf digits: "), F.concat_ws(", ", bad), F.lit(" -> '"), reading, F.lit("'")))


def suppressed(boxes: DataFrame, keys: list[str], overlap: float = 0.5) -> DataFrame:
    """Boxes (x1, x2, conf) of each key that no surer kept box overlaps by `overlap` of the smaller one: greedy, from the surest on, as a fold over the key's few boxes."""
    struct = F.struct((-F.col("conf")).alias("o"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"))
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(struct)).alias("all"))

    def clash(kept: Column, b: Column) -> Column:
        shared = lambda k: (F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"])) / F.least(k["x2"] - k["x1"], b["x2"] - b["x1"])
        return F.exists(kept, lambda k: shared(k) >= overlap)

    kept = F.aggregate("all", F.array().cast("array<struct<o:double,x1:double,x2:double>>"), lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.concat(kept, F.array(b))))
    return rows.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.x1", "b.x2", (-F.col("b.o")).alias("conf"))


def chosen_lines(lines: DataFrame, keys: list[str], overlap: float = 0.5) -> DataFrame:
    """The lines of each key that stay where several readings of one place were found: (keys, refused, strict, x, y, w, h, likeness).

    Read lines go before refused ones, then those of the first pass (strict is false), then wider ones. A line whose box
    covers `overlap` of the smaller one's area with a kept line is left out, or takes the first such line's place if both
    are read alike (the same refused and strict, widths within a third of its height) and its likeness is greater. One
    fold over the few lines of a photo. Lines that agree in all of this go by likeness, x, y and h.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "likeness")]
    order = F.struct(F.col("refused"), F.col("strict"), (-F.col("w").cast("double")).alias("narrow"), (-F.col("likeness").cast("double")).alias("unlike"), F.col("x").cast("double").alias("ox"), F.col("y").cast("double").alias("oy"), F.col("h").cast("double").alias("oh"))
    struct = F.struct(order.alias("order"), *box)
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(struct)).alias("all"))

    def shared(a: Column, b: Column) -> Column:
        side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
        return side("x", "w") * side("y", "h") / F.greatest(F.lit(1.0), F.least(a["w"] * a["h"], b["w"] * b["h"]))

    def twins(new: Column, old: Column) -> Column:
        return (new["order"]["refused"] == old["order"]["refused"]) & (new["order"]["strict"] == old["order"]["strict"]) & (F.abs(new["w"] - old["w"]) <= new["h"] / 3)

    def fold(kept: Column, new: Column) -> Column:
        rival = F.array_position(F.transform(kept, lambda k: shared(k, new) >= overlap), True)
        swapped = F.transform(kept, lambda k, i: F.when((i == rival - 1) & twins(new, k) & (new["likeness"] > k["likeness"]), new).otherwise(k))
        return F.when(rival == 0, F.concat(kept, F.array(new))).otherwise(swapped)

    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), fold)
    return rows.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.order.refused", "b.order.strict", "b.x", "b.y", "b.w", "b.h", "b.likeness")


def meter_turn(turns: DataFrame) -> DataFrame:
    """(photo, turn): the first of the turns 0, 90, 180 and 270 with a meter; null if none has one. turns: photo, turn, has_meter."""
    return turns.groupBy("photo").agg(F.min(F.when(F.col("has_meter"), F.col("turn"))).alias("turn"))
