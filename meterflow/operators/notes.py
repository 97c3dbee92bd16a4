"""Notes written over photos: which account a note names and which reading it gives, judged against the register.

Written forms of accounts are exploded into keys and joined; a note's possible readings are exploded, its numbers are
explained account by account, and the answers of all readings are folded into one for each photo.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import account_variants, plausible
from .lineage import cut

#: Labels that inspectors write beside a number, and what they mean.
LABELS = {"лс": "account", "л/с": "account", "лц": "account", "пок": "reading", "пк": "reading", "пкз": "reading"}
#: The shortest tail of an account, the most accounts of one form, the longest reading, the most readings of a note.
MIN_TAIL, MAX_CANDIDATES, MAX_DIGITS, MAX_HYPOTHESES = 4, 3, 6, 256
_THREE = re.compile("(?<=к)3")


def _meaning(label: Column) -> Column:
    """account or reading; null for what is no label."""
    out = F.lit(None).cast("string")
    for name, meaning in LABELS.items():
        out = F.when(label == name, meaning).otherwise(out)
    return out


def attached(upper: str, lower: str) -> bool:
    """Whether two lines may be one: a number goes on, or a label stands alone beside a number."""
    label = lambda t: _THREE.sub("з", t) in LABELS
    ends, begins = upper[-1:].isdigit(), lower[:1].isdigit()
    return bool(ends and (begins or label(lower)) or begins and label(upper))


def spellings(text: str) -> list[str]:
    """The text, and the text with the letter that a 3 after к may be."""
    return list(dict.fromkeys([text, _THREE.sub("з", text)]))


def hypotheses(lines: list[str] | None) -> list[list[str]] | None:
    """Every way to read the lines: attached neighbours joined or not, in each spelling; None if there are too many."""
    texts = [t for t in (lines if lines is not None else []) if t]
    ways: list[list[str]] = [[texts[0]]] if texts else []
    for before, line in zip(texts, texts[1:]):
        apart = [[*w, line] for w in ways]
        ways = apart + [[*w[:-1], w[-1] + line] for w in ways] if attached(before, line) else apart
        if len(ways) > MAX_HYPOTHESES:
            return None
    found: dict[tuple[str, ...], None] = {}
    for way in ways:
        for spelled in product(*map(spellings, way)):
            found[spelled] = None
            if len(found) > MAX_HYPOTHESES:
                return None
    return [list(h) for h in found]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _hypotheses(lines: pd.Series) -> pd.Series:
    return lines.map(hypotheses)


def written_ways(lines: Column) -> Column:
    """hypotheses() as a column. A note whose lines don't touch and have no 3 after к reads one way: only the others go through Python."""
    texts = F.filter(lines, lambda t: t.isNotNull() & (t != ""))
    label = lambda t: _meaning(F.regexp_replace(t, "(?<=к)3", "з")).isNotNull()
    digit = lambda t, at: F.coalesce(F.substring(t, at, 1).rlike("[0-9]"), F.lit(False))

    def touches(i: Column) -> Column:
        upper, lower = F.get(texts, i), F.get(texts, i + 1)
        return (digit(upper, -1) & (digit(lower, 1) | label(lower))) | (digit(lower, 1) & label(upper))

    pairs = F.when(F.size(texts) > 1, F.sequence(F.lit(0), F.size(texts) - 2)).otherwise(F.array().cast("array<int>"))
    one = ~F.exists(pairs, touches) & ~F.exists(texts, lambda t: t.contains("к3"))
    own = F.when(F.size(texts) > 0, F.array(texts)).otherwise(F.array().cast("array<array<string>>"))
    return F.when(one, own).otherwise(_hypotheses(F.when(~one, lines)))


def tokens(text: Column) -> Column:
    """array<struct<kind, number>>: the numbers of a line with the meaning of the label before them, or after the last one if it has none before."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    n = F.size(runs)
    before = lambda i: F.when(i > 0, F.get(runs, i - 1))
    after = lambda i: F.when(i + 2 == n, F.get(runs, i + 1))
    kind = lambda i: F.coalesce(_meaning(before(i)), F.when(before(i).isNull(), _meaning(after(i))), F.lit(""))
    marked = F.transform(runs, lambda r, i: F.when(r.rlike("^[0-9]"), F.struct(kind(i).alias("kind"), r.alias("number"))))
    return F.filter(marked, lambda t: t.isNotNull())


def strange(text: Column) -> Column:
    """Whether a line has letters that are no label: it was misread."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.exists(runs, lambda r: ~r.rlike("^[0-9]") & _meaning(r).isNull())


def _heads(number: Column) -> Column:
    """Each head of a number with the value of the rest, which loses its zeros; rests of zeros have the value 0."""
    cuts = F.when(F.length(number) > 1, F.sequence(F.lit(1), F.length(number) - 1)).otherwise(F.array().cast("array<int>"))
    bare = lambda k: F.ltrim(F.substring(number, k + 1, F.length(number)), F.lit("0"))
    return F.transform(cuts, lambda k: F.concat(F.lit("h"), F.substring(number, F.lit(1), k), F.lit("|"), bare(k)))


def account_keys(accounts: DataFrame) -> DataFrame:
    """(key, account): every way to write each distinct account of digits.

    Without region and zeros; a tail of at least MIN_TAIL digits, not all zeros; a head with the value of the rest, not 0.
    """
    a = F.col("account")
    plain = accounts.select(F.trim("account").alias("account")).distinct().where("account rlike '^[0-9]+$'")
    starts = F.when(F.length(a) >= MIN_TAIL, F.sequence(F.lit(1), F.length(a) - MIN_TAIL + 1)).otherwise(F.array().cast("array<int>"))
    tails = F.filter(F.transform(starts, lambda k: F.substring(a, k, F.length(a))), lambda t: t.rlike("[1-9]"))
    heads = F.filter(_heads(a), lambda h: ~h.endswith("|"))
    written = F.transform(F.concat(account_variants(a), tails), lambda t: F.concat(F.lit("w"), t))
    return plain.select("account", F.explode(F.array_distinct(F.concat(written, heads))).alias("key"))


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting. The planner takes exploded rows for no more than the column they come from, and would broadcast millions of them through the driver."""
    return left.join(right.hint("merge"), on, how)


def accounts_of(numbers: DataFrame, keys: DataFrame) -> DataFrame:
    """(number, account): the accounts that each distinct number may write."""
    n = F.col("number")
    asked = numbers.select("number").distinct().where("number rlike '^[0-9]+$'")
    asked = asked.select("number", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("w"), n)), _heads(n)))).alias("key"))
    return _merged(asked, keys, "key").select("number", "account").distinct()


def interpreted(photos: DataFrame, register: DataFrame) -> DataFrame:
    """(photo, account, reading, understood, conflict) for photos (photo, lines, account, barrel, unread) and a register (account, last).

    With an account known from the meter, a note confirms it, gives a reading or is in conflict; without one it may name
    the one account that all its numbers and the reading fit. A note that can't be read, has lines left unread, strange
    letters or numbers left over is not understood. Each photo has one row.
    """
    asked = photos.withColumn("h", F.when(F.coalesce("unread", F.lit(0)) == 0, written_ways(F.coalesce("lines", F.array().cast("array<string>")))))
    ways = asked.select("photo", F.col("account").alias("known"), "barrel", F.posexplode("h").alias("way", "texts"))
    alone = F.exists("texts", lambda t: _meaning(t).isNotNull() | _meaning(F.regexp_replace(t, "(?<=к)3", "з")).isNotNull())
    ways = ways.where(~F.exists("texts", strange) & ~alone).withColumn("tokens", F.flatten(F.transform("texts", tokens))).where(F.size("tokens") > 0)
    ways = cut(ways.select("photo", "way", "known", "barrel", "tokens"))  # three joins read them
    parts = ways.select("photo", "way", "known", "barrel", F.posexplode("tokens").alias("at", "t")).select("photo", "way", "known", "barrel", "at", "t.*")
    forms = cut(accounts_of(parts.select("number"), account_keys(register.select("account"))))
    many = forms.groupBy("number").agg(F.count(F.lit(1)).alias("forms"), F.min("account").alias("only"))
    bare = F.ltrim(F.col("number"), F.lit("0"))
    of_barrel = F.col("barrel").isNotNull() & (bare != "") & F.contains(F.col("barrel").cast("string"), bare)
    few = _merged(forms, many.where(F.col("forms") <= MAX_CANDIDATES).select("number"), "number")
    named = _merged(parts.where("known is null and kind <> 'reading'").where(~((F.col("kind") == "") & F.coalesce(of_barrel, F.lit(False)))), few, "number")
    targets = named.select("photo", "way", F.col("account").alias("target")).unionAll(ways.where("known is not null").select("photo", "way", F.col("known").alias("target"))).distinct()

    lasts = register.groupBy(F.trim("account").alias("target")).agg(F.max("last").alias("last"))
    met = _merged(_merged(parts, targets, ["photo", "way"]), lasts, "target", "left")
    met = _merged(_merged(met, forms.select("number", F.col("account").alias("target"), F.lit(True).alias("is_form")), ["number", "target"], "left"), many, "number", "left")
    number = F.when(F.length("number") <= MAX_DIGITS, F.col("number").try_cast("bigint"))
    form = (F.col("kind") != "reading") & F.coalesce("is_form", F.lit(False))
    fits = F.when(F.col("last").isNull(), F.col("kind") == "reading").otherwise(plausible(number, F.col("last")))
    fits = F.when(F.col("last").isNull(), fits).otherwise(F.coalesce(fits, F.lit(False)))
    gives = ~form & (F.col("kind") != "account") & number.isNotNull() & fits
    extra = ~form & ~gives
    strong = (F.col("kind") == "account") | ((F.col("kind") == "") & (F.length("number") > MAX_DIGITS))
    told = met.groupBy("photo", "way", "target", "last", "known", "barrel").agg(
        F.array_sort(F.collect_set(F.when(gives, number))).alias("readings"),
        F.count_if(extra).alias("extra"),
        F.count_if(extra & strong & (F.coalesce("forms", F.lit(0)) == 1)).alias("others"),
    )
    one = F.when(F.size("readings") == 1, F.get("readings", F.lit(0)))
    told = told.withColumn("reading", one).withColumn("understood", (F.col("extra") == 0) & (F.col("known").isNotNull() | plausible(F.coalesce("reading", F.when(F.size("readings") != 1, F.col("barrel"))), F.col("last"))))
    names = F.when(F.col("understood") & F.col("known").isNull(), F.col("target"))
    by = told.groupBy("photo").agg(
        F.bool_or("understood").alias("understood"),
        F.array_sort(F.collect_set(names)).alias("accounts"),
        F.array_sort(F.collect_set(F.when(F.col("understood"), F.col("reading")))).alias("readings"),
        F.bool_or(F.col("known").isNotNull() & (F.col("others") > 0)).alias("against"),
    )
    out = _merged(photos.select("photo"), by, "photo", "left")
    understood, several = F.coalesce("understood", F.lit(False)), F.size("accounts") > 1
    return out.select(
        "photo",
        F.when(understood & ~several, F.get("accounts", F.lit(0))).alias("account"),
        F.when(understood & ~several & (F.size("readings") == 1), F.get("readings", F.lit(0))).alias("reading"),
        (understood & ~F.coalesce(several, F.lit(False))).alias("understood"),
        F.coalesce(F.when(understood, several).otherwise(F.col("against")), F.lit(False)).alias("conflict"),
    )


def rescued(notes: DataFrame) -> DataFrame:
    """notes (outcome, account, serial, serials, ambiguous, ...) with rescued: the account to go on with although the serial gave none.

    Of several subscribers the note's, if it is one of them; without a sure serial the note's; with a sure serial that
    is in no row only if the account's serial is at most one edit away; else null.
    """
    variants = lambda s: F.array(s, F.concat(F.lit("0"), s), F.concat(F.lit("00"), s))
    serial = F.coalesce(F.trim("serial"), F.lit(""))
    agrees = (serial != "") & F.exists("serials", lambda t: F.exists(variants(serial), lambda v: F.levenshtein(v, t) <= 1))
    take = F.when(F.col("outcome") == "SERIAL_AMBIGUOUS", F.array_contains("ambiguous", F.col("account"))).when(F.col("outcome").isin("NO_SERIAL", "SERIAL_LOW_CONF"), True)
    take = take.when(F.col("outcome") == "SERIAL_NOT_FOUND", agrees)
    return notes.withColumn("rescued", F.when(F.coalesce(take, F.lit(False)), F.col("account")))
