"""Which texts contain which quotes, without comparing each with each.

An inverted index over the rarest gram. A quote of four words or more can only
stand in texts that have each pair of its inner words, between words that end
and begin with the characters beside the pair; the least frequent of its pairs
names the candidates, and they are verified on the whole text. So the candidates
grow with the places of phrases, not of words, which any large table repeats. A
quote of three words goes by the one in the middle in the same way. A quote of
one or two words, whose ends may be parts of longer words, is looked up in
the vocabulary first: the rarest run of three characters names the words that
may contain it, and the texts of those words are the candidates.

Only places of what some quote needs leave the scan: a bit table of the needed
keys, which is a scalar subquery, drops nearly all others before the shuffle. A
key that shares its bits with a needed one gets through and is dropped by the
join, so the table's size bounds memory and decides on disk, not on results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # characters
MOST_WORDS = 22  # a bit table of 2^22 words has 32 MB
_CHUNK = 12  # so many bits of a word's number tell words of one chunk apart
_SPACE = r"\s+"


def find_quotes(
    quotes: DataFrame, quote: str, texts: DataFrame, text_id: str, text: str, store: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(quote, text_id) for each different quote and each text that contains it, as ``contains`` does.

    Null and empty quotes, and quotes of white space only, match nothing, as do
    null texts. ``store`` writes a table and reads it back: the index keeps the
    words that quotes need, and the candidates, apart from the texts, so the work
    grows with the texts and the matches, not with quotes times texts. A phrase
    that a third of all texts hold is a row per text; joins on words read both
    sides from a shuffle, which adaptive execution splits. The texts of candidates
    are shuffled once, for the verification.
    """
    needles = quotes.select(F.col(quote).alias("_quote")).where(F.trim(F.regexp_replace(quote, _SPACE, " ")) != "").distinct()
    # keys go with the number of their quote: a long quote has many, and would be moved with each
    needles = store(needles.select(
        F.monotonically_increasing_id().alias("_needle"), "_quote",
        F.split(F.regexp_replace("_quote", r"^\s+|\s+$", ""), _SPACE).alias("_words")))
    # the first and the last word of a quote may be parts of words
    pairs = needles.where(F.size("_words") >= 4).select("_needle", _phrases(F.col("_words"), 2).alias("_keys"))
    middles = needles.where(F.size("_words") == 3).select("_needle", _phrases(F.col("_words"), 1).alias("_keys"))
    fragments = needles.where(F.size("_words") < 3).select(
        "_needle", F.expr("if(size(_words) = 2 and length(_words[1]) > length(_words[0]), _words[1], _words[0])").alias("_part"))

    hay = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    split = hay.select("_id", F.split("_text", _SPACE).alias("_words"))
    postings = split.select("_id", F.explode(F.array_distinct("_words")).alias("_key"))
    long_ones = _candidates(pairs, _places(split, 2), store).unionByName(_candidates(middles, _places(split, 1), store))

    parts = store(fragments.select("_part").distinct())
    if parts.isEmpty():
        short_ones = long_ones.limit(0)
    else:
        vocabulary = postings.select(F.col("_key").alias("_word")).where("_word <> ''").distinct()
        grams = vocabulary.select(F.col("_word").alias("_id"), F.explode(_grams(F.col("_word"))).alias("_key"))
        wanted = parts.select(F.col("_part").alias("_needle"), _needed_grams(F.col("_part")).alias("_keys"))
        words = _candidates(wanted, grams, store).where(F.contains("_id", F.col("_needle")))
        holding = store(words.select(F.col("_needle").alias("_part"), F.col("_id").alias("_key")))
        by_part = _among(postings, holding).join(holding, "_key").select("_part", "_id").distinct()
        short_ones = fragments.join(by_part, "_part").select("_needle", "_id")

    candidates = store(long_ones.unionByName(short_ones).join(needles.select("_needle", "_quote"), "_needle")
                       .select("_quote", "_id"))
    met = _among(hay.withColumn("_key", F.col("_id")), candidates.select(F.col("_id").alias("_key"))).drop("_key")
    found = candidates.join(met, "_id").where(F.contains("_text", F.col("_quote")))
    return found.select(F.col("_quote").alias(quote), F.col("_id").alias(text_id))


def _candidates(needles: DataFrame, postings: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_needle, _id): the ids of the rarest of each needle's keys."""
    keys = store(needles.select("_needle", F.explode(F.array_distinct("_keys")).alias("_key")))
    listed = store(_among(postings, keys).join(keys.select("_key").distinct(), "_key"))
    counts = listed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    # a key without postings has the count 0 and is the rarest: its quotes stand nowhere
    rarest = store(keys.join(counts, "_key", "left").groupBy("_needle").agg(
        F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_key")))
    return rarest.join(_among(listed, rarest), "_key").select("_needle", "_id")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``_key`` may be one of ``wanted``, a stored table: all that are, and few others.

    A key sets two bits of one word of 64. There are four keys a word at most,
    unless ``MOST_WORDS`` is reached. Words are gathered in chunks, since one
    task makes the table of them.
    """
    words = 1 << max(_CHUNK, min(MOST_WORDS, (wanted.count() // 4).bit_length()))
    word, bits = _place("_key", words)
    # every word has a row, so its place in the array is its number
    numbers = rows.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    table = wanted.select(word.alias("_word"), bits.alias("_bits")).unionByName(numbers).groupBy("_word").agg(
        F.bit_or("_bits").alias("_bits"))
    chunks = table.groupBy(F.shiftright("_word", _CHUNK).alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_word", "_bits"))).getField("_bits").alias("_part"))
    whole = F.flatten(F.sort_array(F.collect_list(F.struct("_chunk", "_part"))).getField("_part"))
    held = F.get(chunks.agg(whole.alias("_table")).scalar(), word.cast("int"))
    return rows.where(held.bitwiseAND(bits) == bits)


def _place(key: str, words: int) -> tuple[Column, Column]:
    """The number of a key's word, and its bits there."""
    key_hash = F.xxhash64(key)

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(key_hash, shift).bitwiseAND(F.lit(63).cast("long"))
        return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))

    return key_hash.bitwiseAND(F.lit(words - 1).cast("long")), bit(32).bitwiseOR(bit(38))


def _phrases(words: Column, n: int) -> Column:
    """Hashes of all ``n`` words in a row that stand between two others, whose nearest characters count."""
    def phrase(i: Column) -> Column:
        return _hash([F.get(words, i + k) for k in range(n + 2)])

    return F.transform(F.sequence(F.lit(0), F.size(words) - (n + 2)), phrase)


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.right(words[0], F.lit(1)), *words[1:-1], F.left(words[-1], F.lit(1)))


def _places(split: DataFrame, n: int) -> DataFrame:
    """(_id, _key): ``_phrases`` of ``_words``, each once for a row of ``split``."""
    count = F.size("_words") - (n + 1)
    keys = F.when(count > 0, F.array_distinct(_phrases(F.col("_words"), n)))
    return split.select("_id", F.explode(keys).alias("_key"))


def _grams(word: Column) -> Column:
    """All runs of one, two and three characters; linear in the word."""
    letters = F.split(word, "")

    def runs(n: int) -> Column:
        return F.transform(letters, lambda x, i: F.array_join(F.slice(letters, i + 1, n), ""))

    return F.array_distinct(F.concat(letters, runs(2), runs(GRAM)))


def _needed_grams(part: Column) -> Column:
    """The whole part if it is shorter than a gram, else its runs of three characters."""
    letters = F.split(part, "")
    inside = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part) - (GRAM - 1))),
        lambda i: F.array_join(F.slice(letters, i, GRAM), ""))
    return F.when(F.length(part) <= GRAM, F.array(part)).otherwise(inside)
