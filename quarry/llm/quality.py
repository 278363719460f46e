"""Quality rules, line first.

A line fails if it is navigation (several | or >, or one of ``ITEM_LINES`` lines
or more in a row that hold at most ``ITEM_WORDS`` words and no sentence mark;
blank lines between them do not count), holds a boilerplate phrase, has
``MANY_WORDS`` words or more without any sentence mark, or signs in most words.
Failing lines are removed, which gives ``clean_text``, and a document that loses
more than ``MAX_LOST`` of its characters is rejected. All of it is built-in
column expressions.

A sentence mark is one of .!?… or of the Chinese, Arabic and Indic ones at a word's
end, quotes and brackets after it aside.

The base figures: words are runs of other characters than [\\x20\\x09-\\x0D];
n_repeat_words counts the words in 3-word windows that the text holds twice or
more. Windows are sorted by hash inside one text and equal ones confirmed by
their words.

Defined results: null and empty texts have no words, fail the base rule and are
not kept; the clean_text of a null text is null; repeated rows each get the same result;
very long texts are judged whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

MAX_LOST = 0.5
MANY_WORDS = 10
ITEM_WORDS, ITEM_LINES = 5, 4
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: A word's end after a sentence mark.
SENTENCE = r"""[.!?…؟।][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)|[。！？]"""
_GAP, _ITEM = r"[\x20\x09\x0B-\x0D]", WORD + r"""++(?<![.!?…؟।。！？][\"'”’»)\]]{0,2})"""
#: Short lines in a row. Possessive, so that long rows are matched without recursion.
MENU = rf"(?md)(?:^{_GAP}*+{_ITEM}(?:{_GAP}++{_ITEM}){{0,{ITEM_WORDS - 1}}}+{_GAP}*+(?:\n|\z)(?:^{_GAP}*+\n)*+){{{ITEM_LINES},}}+"
BARS, SIGNS = "|>»·•", "#*$%&<>{}[]~^="
#: Only lines with two of these are counted out.
TWO_BARS, TWO_SIGNS = (rf"[{c}][^{c}]*+[{c}]" for c in (r"|>»·•", r"#*$%&<>{}\[\]~^="))
BOILERPLATE = r"(?i)cookie policy|privacy policy|terms of (use|service)|all rights reserved|javascript is (required|disabled)|enable javascript|click here|read more|subscribe to|sign up for|log in to|share (this|on)|skip to content|powered by|advertisement"

#: Every boilerplate phrase holds one of these: texts without them are not searched.
FRAGMENTS = ["cookie policy", "privacy policy", "terms of", "all rights reserved", "javascript", "click here", "read more", "subscribe to", "sign up for", "log in to", "share ", "skip to content", "powered by", "advertisement"]
#: Windows of a text whose places fit below 48 bits of their hashes.
PACKED = 1 << 16


def words(text: Column) -> Column:
    """The words, as an array."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def window_hashes(w: Column) -> Column:
    """A hash of each 3-word window, in order; null below three words."""
    n = F.size(w)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def sorted_windows(h: Column, bits: Column) -> Column:
    """The windows of a text that may hold equal ones, by hash: plain longs with the
    place in the low ``bits`` (``PACKED`` windows at most), which sort much faster
    than structs; null otherwise."""
    packed = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
    return F.when((F.size(F.array_distinct(h)) < F.size(h)) & (F.size(h) <= PACKED), F.sort_array(packed))


def sorted_windows_of_long(h: Column) -> Column:
    """The same for longer texts: (hash, place) structs."""
    s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(h) > PACKED, s)


def repeated_starts(w: Column, s: Column, long: Column, bits: Column, low: Column) -> Column:
    """The sorted places of the 3-word windows that occur twice or more: neighbours
    with equal hashes and equal words. ``low`` masks the place."""

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def same(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def near(x: Column, y: Column) -> Column:
        return F.coalesce((F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0) & same(place(x), place(y)), F.lit(False))

    def near_long(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))

    twice = F.filter(s, lambda x, j: near(x, F.get(s, j - 1)) | near(x, F.get(s, j + 1)))
    twice_long = F.filter(long, lambda x, j: near_long(x, F.get(long, j - 1)) | near_long(x, F.get(long, j + 1)))
    return F.when(s.isNotNull(), F.sort_array(F.transform(twice, place))).when(long.isNotNull(), F.sort_array(F.transform(twice_long, lambda x: x["i"])))


def covered(p: Column) -> Column:
    """Words under the 3-word windows that start at the sorted places ``p``."""
    k = F.size(p)
    gaps = F.when(k > 1, F.aggregate(F.sequence(F.lit(1), k - 1), F.lit(0).cast("long"), lambda a, j: a + F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)))).otherwise(F.lit(0))
    return F.when(k > 0, gaps + 3).otherwise(F.lit(0)).cast("long")


def bad_line(x: Column, phrases: bool) -> Column:
    """A line that is navigation, words without a sentence or signs, or with
    ``phrases`` boilerplate."""

    def n(signs: str) -> Column:
        return F.length(x) - F.length(F.translate(x, signs, ""))

    n_words = n(" \t") + 1
    navigation = x.rlike(TWO_BARS) & (n(BARS) * 4 >= n_words)
    signs = x.rlike(TWO_SIGNS) & (n_words >= 4) & (n(SIGNS) * 2 >= n_words)
    endless = ~x.rlike(SENTENCE) & (n_words >= MANY_WORDS) & (F.size(words(x)) >= MANY_WORDS)
    return navigation | signs | endless | x.rlike(BOILERPLATE) if phrases else navigation | signs | endless


def score(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the base figures, clean_text, lost_share, base_failed and kept."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("text").isNull().alias("none"), F.lower("text").alias("lower"))
    phrases = F.lit(False)
    for p in FRAGMENTS:
        phrases = phrases | F.contains("lower", F.lit(p))
    some = F.split(F.regexp_replace("text", MENU, ""), "\n")
    good = F.when(phrases, F.filter(some, lambda x: ~bad_line(x, True))).otherwise(F.filter(some, lambda x: ~bad_line(x, False)))
    base = base.select("doc_id", "text", "none", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("real"), good.alias("good"))
    # Columns, so that no lambda below makes them again for each element.
    base = base.withColumn("h", window_hashes(F.col("w")))
    bits = F.length(F.bin(F.size("h")))
    base = base.withColumn("bits", bits).withColumn("low", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    base = base.withColumn("s", sorted_windows(F.col("h"), F.col("bits"))).withColumn("sl", sorted_windows_of_long(F.col("h")))
    base = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("real") - F.size(F.array_distinct("real"))).cast("long").alias("n_dup_lines"),
        F.length(F.array_join("real", "")).cast("long").alias("chars"),
        F.length(F.array_join(F.filter("good", lambda x: x.rlike(WORD)), "")).cast("long").alias("left"),
        F.when(~F.col("none"), F.array_join("good", "\n")).alias("clean_text"),
        # Always true, but a filter on the result is not moved below it, where all of this
        # would be put into its condition and made again for each element.
        F.when(F.spark_partition_id() >= 0, repeated_starts(*(F.col(c) for c in ("w", "s", "sl", "bits", "low")))).alias("p"),
    )
    base = base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered(F.col("p")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("chars") > 0, (F.col("chars") - F.col("left")) / F.col("chars")).otherwise(F.lit(1.0)).alias("lost_share"),
        "clean_text",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_share") <= MAX_LOST))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score(runtime.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share"), "clean_text")
