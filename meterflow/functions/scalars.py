"""Column expressions for serials, accounts, readings, dates, shares and quantiles; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plain numbers only: Spark's casts would also take '12d' and ' 12 '.
NUMBER = r"^-?[0-9]+([.][0-9]+)?$"


def to_double(text: Column) -> Column:
    """A decimal with comma or point; null for anything else, empty text included."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def normalized_serial(text: Column) -> Column:
    """Blanks at the edges go, leading zeros stay."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lookup_variants(serial: Column) -> Column:
    """The serial as read and with one or two zeros before it, in the order in which they are looked up."""
    return F.array(serial, F.concat(F.lit("0"), serial), F.concat(F.lit("00"), serial))


def stored_account(text: Column) -> Column:
    """Trimmed, and without a fraction of zeros."""
    return F.regexp_replace(F.trim(text), r"^([0-9]+)[.]0+$", "$1")


def compared_account(text: Column) -> Column:
    """The whole number as text, which drops leading zeros; other texts as they are. Not the same rule as stored_account."""
    number = to_double(text)
    return F.coalesce(F.when(F.abs(number) < 9e18, number.try_cast("bigint").cast("string")), text)


def account_variants(account: Column) -> Column:
    """Forms in which an account is written: the number after two region digits with fewer leading zeros, then with the region."""
    rest = F.substring(account, 3, 1000)
    shortest = F.greatest(F.length(F.ltrim(rest, F.lit("0"))), F.lit(1))
    tails = F.transform(F.sequence(shortest, F.length(rest)), lambda n: F.substring(rest, F.length(rest) - n + 1, n))
    region = F.substring(account, 1, 2)
    both = F.array_distinct(F.concat(tails, F.transform(tails, lambda t: F.concat(region, t))))
    return F.when(~account.rlike("^[0-9]+$"), F.array().cast("array<string>")).when(F.length(account) <= 2, F.array(account)).otherwise(both)


def reading_digits(text: Column, digits: int = 5) -> Column:
    """A whole reading of at least 0 as so many digits; null where it is none or too long."""
    number = to_double(text)
    whole = F.when((number >= 0) & (number == F.floor(number)), number.try_cast("bigint").cast("string"))
    return F.when(F.length(whole) <= digits, F.lpad(whole, digits, "0"))


def delta_outcome(reading: Column, last: Column, threshold: float) -> Column:
    """PLUS without a last reading, SUSPICIOUS beyond the threshold, else by the sign of the change."""
    delta = reading - last
    return F.when(delta.isNull(), "PLUS").when(F.abs(delta) > threshold, "SUSPICIOUS").when(delta >= 0, "PLUS").otherwise("MINUS")


def hash_share(key: Column) -> Column:
    """A share in [0, 1) from the first 12 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def split_of(key: Column, train: float = 0.7, val: float = 0.15) -> Column:
    share = hash_share(key)
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")


def exclusive_quantile(values: Column, i: int, k: int) -> Column:
    """The i-th of k-1 cut points of a sorted array by the exclusive method; null for fewer than two values."""
    n = F.size(values)
    place = F.lit(i) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(place / k).cast("int"), n - 1))
    part = place - j * k
    at = lambda x: F.element_at(values, x.cast("int"))
    return F.when(n >= 2, (at(j) * (k - part) + at(j + 1) * part) / k)


def edit_kind(read: Column, true: Column) -> Column:
    """How one edit turns the true serial into the one read, and whether it is at the first, the last or a middle character."""
    longer = F.greatest(F.length(read), F.length(true))
    differs = F.filter(F.sequence(F.lit(1), longer), lambda p: F.substring(read, p, 1) != F.substring(true, p, 1))
    place = F.coalesce(F.get(differs, F.lit(0)), longer)
    kind = F.when(F.length(read) == F.length(true), "substitution").when(F.length(read) < F.length(true), "missing").otherwise("extra")
    where = F.when(place == 1, "first").when(place == longer, "last").otherwise("middle")
    return F.concat_ws(" ", kind, where)


def photo_date(name: Column) -> Column:
    """The first valid date that a file name carries as yyyymmdd or yyyy-mm-dd not within a longer number."""
    found = F.regexp_extract_all(name, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2}[-_.]?[0-9]{2}[-_.]?[0-9]{2})(?![0-9])"), F.lit(1))
    dates = F.transform(found, lambda d: F.to_date(F.try_to_timestamp(F.regexp_replace(d, "[-_.]", ""), F.lit("yyyyMMdd"))))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def drum_digit(first: Column, p1: Column, second: Column, p2: Column, threshold: float) -> Column:
    """The lower of two neighbouring digits (9 of 9 and 0) whose chances together reach the threshold; else null."""
    wraps = (F.least(first, second) == 0) & (F.greatest(first, second) == 9)
    near = F.abs(first - second) == 1
    return F.when((p1 + p2 >= threshold) & (near | wraps), F.when(wraps, F.lit(9)).otherwise(F.least(first, second)))


def plausible(reading: Column, last: Column, low: int = -1500, high: int = 3000) -> Column:
    """Whether the change since the last reading lies in the window; false where either is missing."""
    return F.coalesce((reading - last).between(low, high), F.lit(False))


#: Names of older detectors, and what they are called now. Fixed values.
CLASS_NAMES = {"gas_meter": "meter", "serial_number": "serial", "marker_id": "account"}


def standard_class(name: Column) -> Column:
    """The present name of a detector's class."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])[name], name)


def zero_filled(text: Column, width: int) -> Column:
    """Zeros before a text up to the width; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def clean_serial(text: Column) -> Column:
    """The text without blanks, points, commas and slashes at its edges."""
    return F.regexp_replace(text, r"(?U)^[\s.,/\\]+|[\s.,/\\]+$", "")


def number_text(number: Column) -> Column:
    """A number from a table cell as text, whole ones without a fraction; null as the empty text."""
    whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
    return F.coalesce(F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")), F.lit(""))


def crop_name_parts(name: Column) -> Column:
    """struct<photo, kind, n, answer> of <photo>__<kind><n>[__<answer>].jpg; null for other names."""
    pattern = r"^([^_]+(?:_[^_]+)*)__(serial|account|digit)([0-9]+)(?:__([0-9A-Za-z]+))?(?:[.][A-Za-z]+)?$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("photo"), part(2).alias("kind"), part(3).cast("int").alias("n"), F.nullif(part(4), F.lit("")).alias("answer")))


def valid_label(line: Column, classes: int) -> Column:
    """Whether a line has a known class and four fractions from 0 to 1."""
    cells = F.split(F.trim(line), r"\s+")
    number = F.transform(F.slice(cells, 2, 10), lambda c: F.when(c.rlike(NUMBER), c.try_cast("double")))
    class_ = F.when(F.get(cells, F.lit(0)).rlike("^[0-9]+$"), F.get(cells, F.lit(0)).try_cast("int"))
    return F.coalesce((F.size(cells) == 5) & (class_ < classes) & F.forall(number, lambda x: x.between(0, 1)), F.lit(False))


def preset_number(json: Column, key: str, low: float, high: float, default: int) -> Column:
    """A whole number of a JSON object of settings; the default where it is missing, no number or out of range."""
    value = F.get_json_object(json, f"$.{key}").try_cast("int")
    return F.when(value.between(low, high), value).otherwise(F.lit(default))


def serial_agrees(read: Column, serial: Column) -> Column:
    """Whether a variant of what was read is the serial but for one edit; an empty one never is."""
    near = F.exists(lookup_variants(F.trim(read)), lambda v: F.levenshtein(v, F.trim(serial)) <= 1)
    return F.coalesce((F.trim(read) != "") & near, F.lit(False))


def month_label(created: Column) -> Column:
    """yyyy-mm of a timestamp's text; null for other texts."""
    return F.when(created.rlike("^[0-9]{4}-[0-9]{2}"), F.substring(created, 1, 7))


def output_stem(path: Column) -> Column:
    """A path without extension as one name."""
    return F.regexp_replace(F.regexp_replace(path, "[.][^./]*$", ""), "/", "__")
