"""Joins and ranked lookups between readings, the register and the log. Equi-joins only; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup_variants
from .lineage import cut


def pick_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in this order. Catalyst keeps one row of each task's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_variants(reads: DataFrame, register: DataFrame, photo: str = "photo", serial: str = "serial_read") -> DataFrame:
    """Each read with priority and serial: the first variant of its serial that the register has.

    The variants are exploded with their rank and meet the distinct serials, so that no row is multiplied by the
    subscribers of a serial; per photo only the matches of the least rank stay.
    """
    tried = reads.select("*", F.posexplode(lookup_variants(F.col(serial))).alias("priority", "serial"))
    met = tried.join(register.select("serial").distinct(), "serial", "left_semi")
    best = F.min("priority").over(Window.partitionBy(photo))
    return met.withColumn("_best", best).where("priority = _best").drop("_best")


def prioritised(reads: DataFrame, register: DataFrame, photo: str = "photo", serial: str = "serial_read") -> DataFrame:
    """Each read with all register rows of the first variant of its serial that has any. The join is the last step: its rows are never shuffled."""
    found = first_variants(reads, register, photo, serial).withColumnRenamed("serial", "_serial")
    return _spread_join(register, found, "serial", "_serial").drop("_serial")


def ambiguous(reads: DataFrame, register: DataFrame) -> DataFrame:
    """(photo, n, accounts): photos whose serial has n > 1 accounts, joined by commas in the register's order.

    Accounts are listed once for each serial, and photos take the list of theirs. Only photos of several reads with
    different serials gather register rows.
    """
    listed = lambda rows, key: rows.groupBy(key).agg(F.countDistinct("account").alias("n"), F.array_sort(F.collect_list(F.struct("row_order", "account"))).alias("rows"))
    told = lambda rows: rows.where("n > 1").withColumn("accounts", F.concat_ws(",", F.transform("rows", lambda r: r["account"]))).drop("rows")
    asked = first_variants(reads, register).groupBy("photo").agg(F.collect_list("serial").alias("serials"))
    one = asked.where("size(serials) = 1").select("photo", F.col("serials")[0].alias("serial")).join(told(listed(register, "serial")), "serial")
    several = asked.where("size(serials) > 1").select("photo", F.explode("serials").alias("serial")).join(register, "serial")
    return one.select("photo", "n", "accounts").unionByName(told(listed(several, "photo")))


def in_register(reads: DataFrame, register: DataFrame, serial: str = "serial_read") -> DataFrame:
    """Reads with found: whether any variant of the serial is in the register."""
    variants = reads.select(serial).distinct().select(serial, F.explode(lookup_variants(F.col(serial))).alias("_variant"))
    known = variants.join(register.select(F.col("serial").alias("_variant")), "_variant", "left_semi").select(serial).distinct().withColumn("_known", F.lit(True))
    return reads.join(known, serial, "left").withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


#: The rows of a key are dealt to so many places, a power of two, which each row that meets them visits, and all places to so many tasks.
PLACES, TASKS = 4, 512
#: So many rows of a place are written with one row that meets them before the next comes.
BLOCK = 256


def _listed_join(rows: DataFrame, lists: DataFrame, key: str, by: str) -> DataFrame:
    """rows with the one long row of lists that has their key; rows of a key come out side by side.

    Files then hold few different lists in sequence and fold them to a small part of their bytes. Rows are dealt to places
    by a column, and tasks are numbered, since the result is far larger than what Spark chooses them by.
    """
    left = rows.withColumn("_place", F.xxhash64(by).bitwiseAND(PLACES - 1).cast("int")).repartition(TASKS, key, "_place")  # never null, so that no filter for it keeps the scans of branches apart
    right = lists.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))).repartition(TASKS, key, "_place")
    return left.join(right.hint("merge"), [key, "_place"]).drop("_place")


def _spread_join(visiting: DataFrame, dealt: DataFrame, a: str, b: str) -> DataFrame:
    """An equi-join a = b of few keys with very many rows each.

    Its rows are far more than its inputs, by whose bytes Spark would choose few tasks, so that the tasks are numbered here.
    Dealt rows are folded to blocks, and each visiting row is written with a whole block before the next: in files the
    columns of the one come in runs and those of the other in a short pattern that repeats, so that pairs take little disk.
    """
    left = visiting.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))).repartition(TASKS, a, "_place")
    at = F.xxhash64(*dealt.columns).bitwiseAND(PLACES - 1).cast("int")
    right = dealt.where(f"{b} is not null").withColumn("_at", at).repartition(TASKS, b, "_at")
    n = F.row_number().over(Window.partitionBy(b, "_at").orderBy(b))  # in any order
    blocks = right.withColumn("_block", F.floor((n - 1) / BLOCK)).groupBy(b, "_at", "_block").agg(F.collect_list(F.struct(*[c for c in dealt.columns if c != b])).alias("_rows"))
    met = blocks.join(left.hint("merge"), F.expr(f"{a} = {b} and _place = _at"))  # a block stays while the rows that visit it pass
    return met.select(*visiting.columns, b, F.explode("_rows").alias("_row")).select(*visiting.columns, b, "_row.*")


def or_key_join(photos: DataFrame, log: DataFrame) -> DataFrame:
    """Photos (photo_hash, name) with log rows (row_hash, row_name, ...): equal hashes where both have one, else equal names.

    The disjunction is three equi-joins whose rows cannot overlap: by hash, and by name for photos without hash, and for
    others with log rows without hash.
    """
    by_hash = _spread_join(photos.where("photo_hash <> ''"), log.where("row_hash <> ''"), "photo_hash", "row_hash")
    by_name = _spread_join(photos.where("photo_hash = ''"), log, "name", "row_name")
    bare_rows = _spread_join(photos.where("photo_hash is null or photo_hash <> ''"), log.where("row_hash = ''"), "name", "row_name")
    return by_hash.unionByName(by_name).unionByName(bare_rows)


def _deletions(text: Column) -> Column:
    """The text and each text that lacks one of its characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.when(F.length(text) == 0, F.array(text)).otherwise(F.array_distinct(F.concat(F.array(text), cut)))


def one_edit_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) of texts exactly one substitution, insertion or deletion apart.

    Two such texts share a form with at most one character deleted, so that the join is on equal forms instead of a
    comparison of all pairs; the distance of the survivors is then computed.
    """
    x = left.select(a).distinct().select(a, F.explode(_deletions(F.col(a))).alias("form"))
    y = right.select(b).distinct().select(b, F.explode(_deletions(F.col(b))).alias("form"))
    return x.join(y, "form").where(F.levenshtein(a, b) == 1).select(a, b).distinct()


def serial_hints(reads: DataFrame, register: DataFrame, top: int = 3) -> DataFrame:
    """For each read not in the register the nearest `top` one-edit serials: by size of the change, then by serial."""
    missing = in_register(reads, register).where("not found and length(serial_read) >= 3")
    variants = missing.select("serial_read").distinct().select("serial_read", F.explode(lookup_variants(F.col("serial_read"))).alias("variant"))
    near = one_edit_join(variants, register, "variant", "serial").join(variants, "variant").select("serial_read", "serial").distinct()
    first = pick_last(register, ["serial"], F.col("row_order"))
    met = missing.join(near, "serial_read").join(first, "serial").withColumn("delta", F.col("reading") - F.col("last"))
    order = Window.partitionBy("photo").orderBy(F.col("delta").isNull(), F.abs("delta"), "serial")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("photo", "serial_read", "serial", "account", "delta", "rank")


def substrings_of(text: Column, shortest: int = 3) -> Column:
    """The distinct runs of at least `shortest` characters of a short text."""
    starts = F.sequence(F.lit(1), F.length(text) - shortest + 1)
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(shortest), F.length(text) - i + 1), lambda n: F.substring(text, i, n)))
    return F.when(F.length(text) >= shortest, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def not_found_kinds(reads: DataFrame, register: DataFrame, serial: str = "serial_read") -> DataFrame:
    """(serial, kind) of distinct serials: one_edit if a variant is one edit from a register serial, truncated if it is part of one, else none.

    Containment is an equi-join with the exploded parts of the register's serials, which are short.
    """
    asked = reads.select(F.col(serial).alias("_s")).distinct()
    variants = asked.select("_s", F.explode(lookup_variants(F.col("_s"))).alias("variant"))
    near = one_edit_join(variants, register, "variant", "serial").join(variants, "variant").select("_s").distinct().withColumn("_near", F.lit(True))
    parts = register.select("serial").distinct().select(F.explode(substrings_of(F.col("serial"))).alias("_s")).distinct().withColumn("_part", F.lit(True))
    met = asked.join(near, "_s", "left").join(parts, "_s", "left")
    return met.select(F.col("_s").alias("serial"), F.when(F.col("_near"), "one_edit").when(F.col("_part"), "truncated").otherwise("none").alias("kind"))


def one_edit_candidates(rows: DataFrame, register: DataFrame, serial: str = "serial") -> DataFrame:
    """(the row's serial as _s, candidate, account, last): register serials one edit from a variant, each with its first register row."""
    asked = rows.select(F.col(serial).alias("_s")).distinct()
    variants = asked.select("_s", F.explode(lookup_variants(F.col("_s"))).alias("variant"))
    near = one_edit_join(variants, register, "variant", "serial").join(variants, "variant").select("_s", F.col("serial").alias("candidate")).distinct()
    first = pick_last(register, ["serial"], F.col("row_order")).select(F.col("serial").alias("candidate"), "account", "last")
    return near.join(first, "candidate").select("_s", "candidate", "account", "last")


def guesses(rows: DataFrame, register: DataFrame, low: float, high: float) -> DataFrame:
    """rows (serial, model_reading, ...) with candidates, fits and guess: of the one-edit candidates those whose change lies in [low, high]; the guess is the one that does, if just one.

    Readings with characters other than digits have no fits.
    """
    near = one_edit_candidates(rows, register).withColumnRenamed("_s", "serial")
    number = F.when(F.col("model_reading").rlike("^[0-9]+$"), F.col("model_reading").try_cast("bigint"))
    asked = rows.select("serial", "model_reading").distinct()
    met = asked.join(near, "serial")
    fit = (number - F.col("last")).between(low, high)
    by = met.groupBy("serial", "model_reading").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(fit).alias("fits"), F.min(F.when(fit, F.col("candidate"))).alias("_one"))
    out = rows.join(by, ["serial", "model_reading"], "left")
    out = out.withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("fits", F.coalesce("fits", F.lit(0)))
    return out.withColumn("guess", F.when(F.col("fits") == 1, F.col("_one"))).drop("_one")


def serial_choices(photos: DataFrame, register: DataFrame) -> DataFrame:
    """(photo, serial, account, row_order) for photos of an ambiguous serial: each account once, at its first row."""
    accounts = register.groupBy("serial", "account").agg(F.min("row_order").alias("row_order"))
    asked = photos.select("photo", F.col("serial").alias("_serial")).distinct()
    return _spread_join(accounts, asked, "serial", "_serial").select("photo", "serial", "account", "row_order")


def truths(reads: DataFrame, register: DataFrame) -> DataFrame:
    """(photo, accounts, reading): the sorted accounts whose serial is the read one but for leading zeros, and the greatest reading that met one.

    Accounts are listed once for each serial, and photos take the list of theirs. Only photos of several reads with
    different serials gather register rows.
    """
    bare = lambda c: F.ltrim(F.col(c), F.lit("0"))
    accounts = register.select(bare("serial").alias("_k"), "account")
    asked = reads.select("photo", "reading", bare("serial_read").alias("_k")).join(accounts.select("_k").distinct(), "_k", "left_semi")
    asked = asked.groupBy("photo").agg(F.collect_set("_k").alias("keys"), F.max("reading").alias("reading"))
    listed = accounts.groupBy("_k").agg(F.array_sort(F.collect_set("account")).alias("accounts"))
    one = _listed_join(asked.where("size(keys) = 1").select("photo", "reading", F.col("keys")[0].alias("_k")), listed, "_k", "photo")
    several = asked.where("size(keys) > 1").select("photo", "reading", F.explode("keys").alias("_k")).join(accounts, "_k")
    several = several.groupBy("photo").agg(F.array_sort(F.collect_set("account")).alias("accounts"), F.max("reading").alias("reading"))
    return one.select("photo", "accounts", "reading").unionByName(several)


def dense_ids(register: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(account): every zero-filled number from the register's smallest to its greatest, made by executors. More than `most` are refused, if it is given.

    Accounts that are no plain numbers don't count; a register without any gives no rows.
    """
    low, high = register.where("account rlike '^[0-9]+$'").agg(F.min(F.col("account").cast("bigint")), F.max(F.col("account").cast("bigint"))).first()
    if low is not None and most is not None and high - low + 1 > most:
        raise ValueError(f"{high - low + 1} numbers, more than {most}")
    ids = register.sparkSession.range(low or 0, 0 if low is None else high + 1)
    return ids.select(F.lpad(F.col("id").cast("string"), width, "0").alias("account"))


def placed(rows: DataFrame, share: str, key: str, ranges: int = 1024, parts: int = 64) -> DataFrame:
    """rows with `place`, their number in the order of share, from 0 to 1, and of key, a long number.

    Rows are counted by ranges of the share, then by share and parts of the key's range; a place is what comes before
    in these counts and the row's number in its part, so that no task orders more than a part of one share.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    own = rows.withColumns({"_r": F.floor(F.col(share) * ranges), "_p": F.floor((F.col(key) - F.lit(low or 0)) / step)})
    counts = own.groupBy("_r", share, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.groupBy("_r").agg(F.sum("_n").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).drop("_n")  # at most ranges + 1 rows
    inner = F.sum("_n").over(Window.partitionBy("_r").orderBy(share, "_p")) - F.col("_n")
    starts = counts.withColumn("_inner", inner).join(F.broadcast(before), "_r").select(share, "_p", (F.col("_before") + F.col("_inner")).alias("_start"))
    n = F.row_number().over(Window.partitionBy(share, "_p").orderBy(key))
    return own.join(starts, [share, "_p"]).withColumn("place", F.col("_start") + n).drop("_r", "_p", "_start")


def ordered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `place`, their number from 1 in this order: ranges are sorted side by side, and only their sizes are added up.

    Rows that agree in all of the order stay in one range, and their places among themselves are any.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("_range", F.shiftright("_id", 33)))  # the id has the range above its lower 33 bits
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(starts), "_range").withColumn("place", place).drop("_id", "_range", "_start")


def judged(guessed: DataFrame) -> DataFrame:
    """Guesses with verdict against the operator's answer (manual_outcome, manual_serial): right, other serial, not in table, ? or - without a guess."""
    found = F.col("manual_outcome").isin("PLUS", "MINUS", "SUSPICIOUS")
    verdict = F.when(F.col("guess").isNull(), "-").when(found & (F.col("guess") == F.col("manual_serial")), "right")
    return guessed.withColumn("verdict", verdict.when(F.col("manual_outcome") == "NOT_IN_DB", "not in table").when(found, "other serial").otherwise("?"))


def corrected(reads: DataFrame, register: DataFrame) -> DataFrame:
    """Each read with the first register row of the first variant of its serial that has one, and PLUS or MINUS by its change, whatever its size."""
    first = pick_last(register, ["serial"], F.col("row_order"))
    met = first_variants(reads, first).join(first, "serial").withColumn("delta", F.col("reading") - F.col("last"))  # at most one row a read
    return met.withColumn("outcome", F.when(F.col("delta").isNull() | (F.col("delta") >= 0), "PLUS").otherwise("MINUS"))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with n, their place among those of equal keys."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def top(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in this order; tasks keep k rows of a key before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
