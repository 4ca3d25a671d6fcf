"""Functions of columns that the investigation needs: dispersion, money as text, personal data shapes, hashes, flattened JSON."""

from __future__ import annotations

import hashlib
import hmac
import json
from decimal import Decimal
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Shapes of national identifiers.
SHAPES = {"pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "aadhaar": r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b", "mobile": r"(?<![0-9])(?:\+91[\s-]?)?[6-9][0-9]{9}(?![0-9])"}


def halves_up(value: Column, digits: int) -> Column:
    """A double rounded in doubles, as SQL engines do: scaled, rounded to a whole number, scaled back. F.round goes by its shortest decimal
    text, which is another number where the scaled double isn't exactly a half."""
    return F.round(value * 10.0**digits) / 10.0**digits


def shannon_entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, entropy: bits of the distribution of value within each key; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    # with sums alone: log2(total) - sum(n log2 n) / total
    sums = counts.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, F.greatest(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))


def gini(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, gini of the values within each key, 0 where they add up to nothing; equal values are counted, so a key's ranks go over distinct values."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2)
    sums = ranked.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("t"), F.sum(F.col("v") * F.col("ranks")).alias("r"))
    return sums.select(key, F.coalesce(F.try_divide(2 * F.col("r"), F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"), F.lit(0.0)).alias("gini"))


def rupees(amount: Column) -> Column:
    """An amount as text in crores, lakhs, thousands or plain, with two digits, halves rounded away from 0."""
    exact = amount.cast("decimal(28,8)")
    of = lambda zeros, mark: F.concat(F.lit("₹"), F.round(exact * F.lit(Decimal(1).scaleb(-zeros)), 2).cast("decimal(30,2)").cast("string"), F.lit(mark))
    size = F.abs(exact)
    return F.when(size >= 10**7, of(7, "Cr")).when(size >= 10**5, of(5, "L")).when(size >= 10**3, of(3, "K")).otherwise(of(0, ""))


def shapes_in(text: Column) -> Column:
    """Names of the personal data shapes that a text has, joined by commas; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.array_join(F.array_compact(F.array(*(F.when(body.rlike(p), n) for n, p in SHAPES.items()))), ",")


#: How months and currencies begin a word in prose.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CURRENCIES = ("", "₹", "$", "€", "rs", "rs.", "inr", "usd", "eur")


def quantities_in(text: Column) -> Column:
    """The quantities that a sentence states, as doubles, word by word.

    A word is a quantity if its digits are one number, with commas and one point at most between them, and around them
    stand only signs, a currency, brackets, quotes, a per cent sign or marks of a sentence's end. So dates, times, names with digits and
    ranges aren't; nor is a number of four digits behind the name of a month. Null counts as empty.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " |\t|\n|\r"), lambda w: w != "")
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.lower(F.get(words, i - 1)).alias("before")))

    def number(pair: Column) -> Column:
        word = pair["word"]
        core = F.regexp_extract(word, "[0-9](.*[0-9])?", 0)
        head = F.ltrim(F.regexp_extract(word, "^[^0-9]*", 0), F.lit("([{\"'"))
        minus = head.endswith("-")
        currency = F.lower(F.rtrim(head, F.lit("+-")))
        tail = F.regexp_extract(word, "[^0-9]*$", 0)
        plain = core.rlike("^[0-9][0-9,]*([.][0-9]+)?$") & currency.isin(*CURRENCIES) & (F.ltrim(tail, F.lit(".,;:!?)]}\"'%")) == "")
        year = (F.length(core) == 4) & core.rlike("^[0-9]+$") & F.coalesce(F.substring(pair["before"], 1, 3).isin(*MONTHS), F.lit(False))
        value = F.replace(core, F.lit(","), F.lit("")).try_cast("double")
        return F.when((core != "") & plain & ~year, F.when(minus, -value).otherwise(value))

    return F.array_compact(F.transform(pairs, number))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two names, lower-cased and stripped, the lesser first; 0 where one is missing."""

    def one(x, y):
        if x is None or y is None:
            return 0.0
        x, y = sorted((str(x).strip().lower(), str(y).strip().lower()))
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex; null stays null."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, str(v).encode(), hashlib.sha256).hexdigest())

    return run(value)


@F.pandas_udf(StringType())
def canonical_json_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys and no blanks; null where it isn't JSON."""

    def one(t):
        try:
            return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return text.map(one)


def flattened(rows: DataFrame, column: str) -> list[Column]:
    """The leaves of a struct column as columns named by their dotted path, arrays as JSON."""
    from pyspark.sql.types import ArrayType, StructType

    def walk(kind, path):
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in walk(f.dataType, [*path, f.name])]
        value = F.col(".".join(f"`{p}`" for p in path))
        return [(F.to_json(value) if isinstance(kind, ArrayType) else value).alias(".".join(path[1:]))]

    return walk(rows.schema[column].dataType, [column])
