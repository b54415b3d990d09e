"""Spelling variants grouped by anagram hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, by_shuffle, dealt, part_of, stage

#: Letters that a word may hold: a to z, and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: A letter's value is its place in this alphabet to this power. No two pairs of different fifth powers of such
#: numbers have the same sum, so the difference of two keys names the one letter exchanged for another.
POWER = 5
LEAST_LETTERS, LEAST_SEEN, TIMES = 5, 3, 2


def lower_letters(run: Column) -> Column:
    """A-Z alone in lower case; a run of ASCII takes the short way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def value_of(letter: Column) -> Column:
    code = F.ascii(letter)
    place = F.when(code.between(97, 122), code - 96).when(code.between(192, 255), code - 165)
    place = F.coalesce(place, F.raise_error(F.concat(F.lit("not a letter of the alphabet: "), letter)).cast("int")).cast("bigint")
    return place * place * place * place * place


def key_of(word: Column) -> Column:
    """The sum of the values of a word's letters: equal for anagrams."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: s + value_of(c))


def count_words(runs: DataFrame, least_letters: int = LEAST_LETTERS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """word, n of the words of at least so many letters that occur so often, from a table of occurrences (word). Occurrences
    are counted within tasks first, so that a word of any frequency is a row a task in the shuffle."""
    return runs.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_seen)


def _halves(letters: Column) -> Column:
    """The first and the last part of a word that has `letters` letters once the odd one is gone. One edit leaves one of both as it was."""
    half = F.floor(letters / 2).cast("int")
    first = F.concat(F.lit("<"), F.col("word").substr(F.lit(1), half))
    rest = F.length("word") - (letters - half)
    return F.explode(F.array(first, F.concat(F.lit(">"), F.col("word").substr(rest + 1, letters - half))))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that differ by exactly one inserted, deleted or replaced letter, once.

    words has word, n, key, a row a word. A replaced letter leaves the keys equal once each has lost the value of the letter that
    differs, a deleted one once the longer has. Keys meet together with the length and the half of the word that
    the edit left alone, so words that merely have the same letters hardly do; the order of letters is then verified.
    A word has at most as many near words as its letters and the alphabet allow, whatever the vocabulary's size.
    """
    size = F.length("word")
    less = F.explode(F.array_distinct(F.split("word", "")))
    lost = words.withColumn("letter", less).withColumn("k", F.col("key") - value_of(F.col("letter")))
    exchange = lost.select("word", "n", "k", size.alias("m"), _halves(size).alias("half"))
    longer = lost.select("word", "n", "k", (size - 1).alias("m"), _halves(size - 1).alias("half"))
    whole = words.select("word", "n", F.col("key").alias("k"), size.alias("m"), _halves(size).alias("half"))
    on = ["k", "m", "half"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        l_, r_ = left.withColumnsRenamed({"word": "a", "n": "n_a"}), right.withColumnsRenamed({"word": "b", "n": "n_b"})
        return l_.join(by_shuffle(r_), on).where(F.levenshtein("a", "b", 1) == 1)

    half = F.floor(F.col("m") / 2).cast("int")
    replaced = meet(exchange, exchange).where("a < b")
    # Both halves may agree where the letter stands between them: such a pair is taken by its first half.
    once = F.col("half").startswith("<") | (F.col("a").substr(F.lit(1), half) != F.col("b").substr(F.lit(1), half))
    inserted = meet(whole, longer).where(once)
    return replaced.unionByName(inserted).select("a", "n_a", "b", "n_b")


def roots(links: DataFrame) -> DataFrame:
    """word, root from links (word, form): forms followed to the last one, twice as far in each round.

    A form occurs at least TIMES as often as its word, so there are no circles and a chain is as long as the logarithm of a count;
    six rounds reach the end of any with 64-bit counts.
    """
    now = stage(links.select("word", F.col("form").alias("root"), part_of("word").alias("part")), "variant-roots")
    while True:
        up = dealt(by_shuffle(now.select(F.col("word").alias("root"), F.col("root").alias("up"))), now, "root")
        moved = stage(now.join(by_shuffle(up), ["root", "part"], "left").select("word", F.coalesce("up", "root").alias("root"), "part", F.col("up").isNotNull().alias("moved")), "variant-roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of counts (word, n), which has a row a word.

    A word's form is the near word of largest n (ties: smallest in code-point order), where that n is at least
    `times` the word's own; else null. root follows forms to the last; a word without a form is its own.
    Words without letters or null are left out; a letter outside the alphabet is an error. Further columns of counts are not
    used; an empty table gives an empty result.
    """
    words = stage(counts.where(F.col("word") != "").select("word", F.col("n").cast("bigint").alias("n"), key_of(F.col("word")).alias("key")), "variant-words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near"))
    near = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    takes = -F.col("best.least") >= times * F.col("n")
    formed = stage(
        words.drop("key").join(by_shuffle(near), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.least")).alias("form_n"),
        ),
        "variant-forms",
    )
    last = roots(formed.where("form is not null"))
    return formed.join(by_shuffle(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
