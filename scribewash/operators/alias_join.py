"""Dictionary rewriting by a join, for alias tables that are too large for one expression.

Tokens are exploded, the distinct ones looked up (exact spellings by an equi-join, near ones by edit
distance within blocks of equal deletion variants), and texts are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.commands import Profiles


def alias_table(df: DataFrame, profiles: Profiles) -> DataFrame:
    """(canon, canon_ord, form, fuzzy), one row for each spelling and each command itself."""
    rows = [(k, i, x, bool(v["fuzzy"])) for i, (k, v) in enumerate(profiles.items()) for x in [k, *v["forms"]]]
    return df.sparkSession.createDataFrame(rows, "canon string, canon_ord int, form string, fuzzy boolean")


def _variants(word: Column) -> Column:
    """The word with up to FUZZY_DISTANCE letters left out: two words within the distance share a variant."""
    out = F.array(word)
    for _ in range(C.FUZZY_DISTANCE):
        shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def _cuts(spark: SparkSession) -> DataFrame:
    """(n, i, j): which two letters go from a word of n letters; a place before or behind the word leaves it all."""
    least, most = C.FUZZY_LENGTHS
    rows = [(n, 0, n + 1) for n in range(least, most + 1)]
    rows += [(n, i, j) for n in range(least, most + 1) for i in range(1, n + 1) for j in range(i + 1, n + 2)]
    return spark.createDataFrame(rows, "n int, i int, j int")


def lookup_tokens(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """``tokens`` (token) to (token, canon): distinct tokens that stand for a command.

    A command itself comes before a near spelling, that before a listed one; then the order of commands. One
    pass: every distinct token meets the aliases once, by keys that say how (itself; a deletion variant, for
    tokens of a length that a near spelling may have).
    """
    words = tokens.select("token").distinct().withColumn("low", F.lower("token"))
    names = aliases.select("canon", "canon_ord", "fuzzy").distinct().where(~F.col("canon").rlike(f"[{C.CJK} ]")).withColumn("low", F.lower("canon"))
    fuzzy = names.where("fuzzy")
    key = lambda how, c: F.concat(F.lit(how), c)
    at = ["canon", "canon_ord", F.col("low").alias("name")]
    keys = names.select(key("=", F.col("low")).alias("key"), *at, F.lit(0).alias("kind"))
    keys = keys.unionByName(fuzzy.select(F.explode(F.transform(_variants(F.col("low")), lambda v: key("~", v))).alias("key"), *at, F.lit(1).alias("kind")))
    listed = aliases.where("form <> canon").select(key("=", F.lower("form")).alias("key"), "canon", "canon_ord", F.lower("form").alias("name"), F.lit(2).alias("kind"))
    keys = keys.unionByName(listed)

    near_sizes = fuzzy.select(F.explode(F.sequence(F.length("low") - C.FUZZY_DISTANCE, F.length("low") + C.FUZZY_DISTANCE)).alias("n")).distinct()
    cuts = _cuts(tokens.sparkSession).join(near_sizes, "n", "left_semi")  # some hundred rows
    # Plain expressions on exploded rows, which are compiled, rather than functions on arrays, which are not.
    w, i, j = F.col("low"), F.col("i"), F.col("j")
    variant = F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, j - i - 1), F.substring(w, j + 1, F.length(w)))
    asked = words.withColumn("n", F.length("low")).join(F.broadcast(cuts), "n").select("token", "low", key("~", variant).alias("key"))
    asked = asked.unionByName(words.select("token", "low", key("=", F.col("low")).alias("key")))
    close = F.levenshtein(F.col("low"), F.col("name"), C.FUZZY_DISTANCE).between(0, C.FUZZY_DISTANCE)
    found = asked.join(keys, "key").where((F.col("kind") != 1) | close)
    return found.groupBy("token").agg(F.min_by("canon", F.struct("kind", "canon_ord", "canon")).alias("canon"))


def profile_overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Profiles (canon, forms, fuzzy): ``over`` replaces key by key; no-op and blank spellings go."""
    kept = base.join(over.select("canon"), "canon", "left_anti").unionByName(over)
    return kept.withColumn("forms", F.filter("forms", lambda x: (F.trim(x) != "") & (x != F.col("canon"))))
