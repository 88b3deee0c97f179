"""Stylometry: function words, character trigrams, layout; cosine and mean absolute difference.

Counts are exploded and aggregated per text; nothing is collected. Defined results: null or wordless texts have no rates;
rates are rounded to six places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# English function words.
FUNCTION_WORDS = "a about after all also an and any as at be because been before but by can could do for from had has have he her his how i if in into is it its just may more most my no not of on one only or other our out over she so some such than that the their them then there these they this to under up was we were what when which who will with would you your".split()


def function_word_rates(rows: DataFrame) -> DataFrame:
    """(key, word, rate): occurrences of each function word per word of the text."""
    words = rows.dropDuplicates(["key"]).select("key", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    one = words.select("key", F.size("w").alias("n"), F.explode("w").alias("word")).where(F.col("word").isin(*FUNCTION_WORDS))
    return one.groupBy("key", "word", "n").agg(F.count(F.lit(1)).alias("c")).select("key", "word", F.round(F.col("c") / F.col("n"), 6).alias("rate"))


def top_trigrams(rows: DataFrame, group: str, k: int = 200) -> DataFrame:
    """(group, trigram, n): the k most frequent character trigrams of each group, ties in order of the trigram."""
    flat = F.regexp_replace(F.lower("text"), r"\s+", " ")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Counted within a batch first: what is shuffled are distinct trigrams, not characters.
        for b in batches:
            out = []
            for g, texts in b.groupby(group, dropna=False)["t"]:
                held: Counter = Counter()
                for t in texts:
                    held.update(map("".join, zip(t, t[1:], t[2:], strict=False)))
                out.append(pd.DataFrame({group: [None if pd.isna(g) else g] * len(held), "trigram": list(held), "n": list(held.values())}))
            yield pd.concat(out) if out else pd.DataFrame({group: [], "trigram": [], "n": []})

    kind = dict(rows.dtypes)[group]
    grams = rows.select(group, flat.alias("t")).where(F.length("t") >= 3).mapInPandas(count, f"{group} {kind}, trigram string, n bigint")
    counted = grams.groupBy(group, "trigram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "trigram")
    return counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def layout(text: Column) -> dict[str, Column]:
    """The text's form in whole numbers: shares in millionths, the mean line in thousandths of a character."""
    n = F.length(text)
    lines = F.split(text, "\n")
    part = lambda c, of, unit: F.floor(c * F.lit(float(unit)) / of)
    share = lambda cls: part(n - F.length(F.regexp_replace(text, cls, "")), n, 1_000_000)
    return {
        "blank_lines": part(F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"[ \t\r]", "") == "")), F.size(lines), 1_000_000),
        "mean_line": part(n, F.size(lines), 1000),
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "punctuation": share("[.,;:!?]"), "brackets": share(r"[(){}\[\]]"),
    }


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def group_cosine(rates: DataFrame, reference: str) -> DataFrame:
    """(key, cosine): of each key's rates to the reference key's, over the words of both."""
    ref = rates.where(F.col("key") == reference).select("word", F.col("rate").alias("r"))
    norm = rates.groupBy("key").agg(F.sqrt(F.sum(F.col("rate") * F.col("rate"))).alias("n"))
    own = ref.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rn"))
    dot = rates.join(ref, "word").groupBy("key").agg(F.sum(F.col("rate") * F.col("r")).alias("dot"))
    return norm.join(dot, "key", "left").join(F.broadcast(own)).select("key", F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("n") * F.col("rn")), 3).alias("cosine"))  # own is one row


# Words and lines from which a style report is reliable.
WORDS_LEAST, WORDS_GOOD, LINES_LEAST, LINES_GOOD = 200, 1000, 40, 150


def reliability(words: Column, lines: Column, code: Column) -> Column:
    """'good', 'fair' or 'too short': prose by its words, code by its lines."""
    n, least, good = F.when(code, lines).otherwise(words), F.when(code, LINES_LEAST).otherwise(WORDS_LEAST), F.when(code, LINES_GOOD).otherwise(WORDS_GOOD)
    return F.when(n < least, "too short").when(n < good, "fair").otherwise("good")


def style_report(rows: DataFrame) -> DataFrame:
    """(key, words, lines, code, reliability) of texts (key, text, kind)."""
    lines = F.size(F.split("text", "\n"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)))
    code = F.coalesce(F.col("kind") == "code", F.lit(False))
    return rows.where("text IS NOT NULL").select("key", words.alias("words"), lines.alias("lines"), code.alias("code"), reliability(words, lines, code).alias("reliability"))
