"""Road-name synonyms: dictionary lines, token substitution, permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import ascii_words, sanitize

#: ISO 639-3 codes of languages that have street-type dictionaries, and the folders of their files.
LANGUAGES = {"eng": "en", "cat": "ca", "spa": "es", "ara": "ar", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "rus": "ru", "zho": "zh"}
#: A small dictionary for tests and for use without files; lines as in the files.
SAMPLE = {
    "eng": ["avenue|ave|avn", "street|st|strt", "road|rd", "north|n", "saint|st"],
    "cat": ["carrer|c|c/"],
    "fra": ["rue|r", "avenue|av|ave"],
}


def parse_lines(lines: list[str]) -> dict[str, list[str]]:
    """Every component of a line is a key; its substitutes are the components of all its lines in the order first seen."""
    out: dict[str, list[str]] = {}
    for line in lines:
        parts = line.split("|")
        for key in parts:
            if key in out:
                out[key] += [p for p in dict.fromkeys(parts) if p not in out[key]]
            else:
                out[key] = list(parts)
    return out


def dictionary(df: DataFrame) -> DataFrame:
    """(lang, key, subs) from (lang, line_no, line), as parse_lines does."""
    parts = df.select("lang", "line_no", F.split("line", r"\|").alias("parts"))
    keys = parts.select("lang", "line_no", "parts", F.explode(F.array_distinct("parts")).alias("key"))
    return keys.groupBy("lang", "key").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "parts"))), lambda s: s["parts"]))).alias("subs"))


def read_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, line_no, line) of ``<folder>/<language>/street_types.txt``; a folder of such files is a parameter."""
    found = []
    for lang, name in LANGUAGES.items():
        text = spark.read.text(f"{folder}/{name}/street_types.txt", wholetext=True)
        found.append(text.select(F.lit(lang).alias("lang"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def sample_lines(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, line) for lang, lines in SAMPLE.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "lang string, line_no int, line string")


def subs_map(dicts: dict[str, dict[str, list[str]]]) -> Column:
    """Literal map lang -> token -> substitutes (dictionaries are a few hundred lines a language)."""
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k in dicts]),
        F.array(*[F.map_from_arrays(F.array(*[F.lit(t) for t in d]), F.array(*[F.array(*[F.lit(s) for s in subs]) for subs in d.values()])) for d in dicts.values()]),
    )


def options(tokens: Column, subs: Column) -> Column:
    """For each token itself and its substitutes; subs is a map for the row's language or null."""
    return F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(subs, t), F.array().cast("array<string>"))))


def product(choices: Column) -> Column:
    """All ways to take one string of each array, joined by spaces; leftmost varies slowest."""
    first = F.when(F.size(choices) > 0, choices[0]).otherwise(F.array(F.lit("")))
    rest = F.when(F.size(choices) > 1, F.slice(choices, F.lit(2), F.greatest(F.size(choices) - 1, F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    return F.aggregate(rest, first, lambda acc, o: F.flatten(F.transform(acc, lambda p: F.transform(o, lambda q: F.concat(p, F.lit(" "), q)))))


def permute_road(road: Column, subs: Column, dedupe: bool = False) -> Column:
    """All spellings of a road; with repetitions unless dedupe."""
    out = product(options(ascii_words(sanitize(road)), subs))
    return F.array_distinct(out) if dedupe else out


def permute_rows(df: DataFrame, dicts: DataFrame, key: str, road: str, lang: str, dedupe: bool = True) -> DataFrame:
    """(key, lang, permutations) by joining tokens with a dictionary table (lang, key, subs): for dictionaries too large for a literal."""
    tokens = df.select(key, lang, F.posexplode(ascii_words(sanitize(F.col(road)))).alias("pos", "token"))
    subs = dicts.select(F.col("lang").alias(lang), F.col("key").alias("token"), "subs")
    chosen = tokens.join(subs, [lang, "token"], "left").withColumn("choice", F.concat(F.array("token"), F.coalesce("subs", F.array().cast("array<string>"))))
    lists = chosen.groupBy(key, lang).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "choice"))), lambda s: s["choice"]).alias("choices"))
    out = product(F.col("choices"))
    return lists.select(key, lang, (F.array_distinct(out) if dedupe else out).alias("permutations"))


def line_numbers(df: DataFrame, lang: str, line: str) -> DataFrame:
    """(lang, line_no, line) for lines without numbers, in the order of the lines themselves."""
    return df.select(F.col(lang).alias("lang"), F.row_number().over(W.partitionBy(lang).orderBy(line)).alias("line_no"), F.col(line).alias("line"))
