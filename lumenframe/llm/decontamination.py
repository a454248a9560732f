"""Benchmark decontamination with a distributed positional inverted index.

All steps are DataFrame functions. The index is one table of postings ``t, row, pos``
of all terms of the test set's vocabulary, written in one narrow pass over the
corpus and used by each step from there. A test window is looked up from its rarest
term: that term's postings, less its offset in the window, are the candidates' begins;
they are intersected with the postings of the second rarest term, less its offset,
which leaves little but matches, and then with those of all other terms. A phrase
match is a begin that is in all lists; a proximity match is a posting of the rarest
term with all of the window's terms within a distance, in any order.

Postings of windows' two rarest terms are shuffled, and of the others those of rows
that still have a candidate while these rows are counted to be at most
``broadcast_bytes``; beyond that all are, in one join by place. Equal windows are one,
however many items share them; items are put to the matches afterwards.

Defined results: null or blank texts have no words and no hits; a text of any length
is read whole; repeated rows are judged one by one (``row`` tells them apart); test
items without words match nothing; items with equal item_id count once; empty tables
give no hits; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands after a document's last word in the exploded list; no word is like it.
END, END_T = "\x00", -1


@dataclass(frozen=True)
class Phrases:
    """``window`` words are a test window; a shorter item is one window."""

    window: int = 13
    broadcast_bytes: int = 32 << 20


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else; the plain function is used on ASCII only."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """The words of a text, not yet lower-cased (that is cheaper word by word)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def fits(df: DataFrame, how: Phrases) -> bool:
    """Whether the rows of a stored table are few enough bytes to be broadcast."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0]
    return (size or 0) <= how.broadcast_bytes


def small(df: DataFrame, how: Phrases) -> DataFrame:
    """A stored table, marked for broadcast if it fits, else as it is."""
    return F.broadcast(df) if fits(df, how) else df


def test_words(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, words`` of each test item with words."""
    words = F.transform(word_list(F.col("text")), ascii_lower)
    own = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    return stored(own.where(F.size("words") > 0), "test-words")


@dataclass(frozen=True)
class Index:
    """``postings``: t, row, pos, and doc_id beside END, whose place is the document's
    number of words. ``vocabulary``: t, term."""

    postings: DataFrame
    vocabulary: DataFrame

    def places(self) -> DataFrame:
        return self.postings.where(F.col("t") != END_T).select("t", "row", "pos")

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("t") == END_T).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def positional_index(docs: DataFrame, tests: DataFrame, how: Phrases) -> Index:
    """The stored postings in ``docs`` of the terms of ``tests``."""
    spark = docs.sparkSession
    vocabulary = stored(tests.select(F.explode("words").alias("term")).distinct().select(F.monotonically_increasing_id().alias("t"), "term"), "vocabulary")
    listed = vocabulary.unionByName(spark.range(1).select(F.lit(END_T).cast("long").alias("t"), F.lit(END).alias("term")))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_list(F.col("text")).alias("words"))
    each = own.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(END))).alias("pos", "word"))
    each = each.select("row", "doc_id", "pos", ascii_lower(F.col("word")).alias("term"))
    met = each.join(F.broadcast(listed) if fits(vocabulary, how) else listed, "term")
    doc_id = F.when(F.col("t") == END_T, F.col("doc_id")).alias("doc_id")
    return Index(stored(met.select("t", "row", "pos", doc_id), "postings"), vocabulary)


@dataclass(frozen=True)
class Windows:
    """``ranked``: w, need and terms, structs ``tf, term, t, at`` from the rarest on, of each
    distinct window that can stand somewhere; ``items``: w, item_id."""

    ranked: DataFrame
    items: DataFrame


def ranked_windows(tests: DataFrame, index: Index, how: Phrases) -> Windows:
    """Windows with a term that the corpus lacks are left out."""
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - how.window, F.lit(0))))
    each = tests.select("item_id", "words", begins.alias("begin")).select("item_id", F.expr(f"slice(words, begin + 1, {how.window})").alias("words"))
    each = stored(each.distinct(), "item-windows")
    windows = stored(each.select("words").distinct().select(F.monotonically_increasing_id().alias("w"), "words"), "windows")
    counts = index.postings.groupBy("t").agg(F.count("*").alias("tf"))
    told = index.vocabulary.join(counts, "t", "left").select("t", "term", F.coalesce("tf", F.lit(0)).alias("tf"))
    known = windows.select("w", F.posexplode("words").alias("at", "term")).join(small(stored(told, "term-counts"), how), "term")
    ranks = known.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("tf", "term", "t", "at"))).alias("terms"))
    ranks = ranks.where(F.col("terms")[0]["tf"] > 0).select("w", F.size("terms").alias("need"), "terms")
    return Windows(stored(ranks, "ranked-windows"), stored(each.join(windows, "words").select("w", "item_id"), "windows-of-items"))


def phrase_matches(index: Index, windows: Windows, how: Phrases) -> DataFrame:
    """``row, w, begin, end``: places of a document where a whole test window stands."""
    places, ranked = index.places(), windows.ranked
    term = lambda k, f: F.get("terms", F.lit(k))[f]
    first = ranked.select("w", "need", term(0, "t").alias("t"), term(0, "at").alias("at"), term(1, "t").alias("t2"), term(1, "at").alias("at2"))
    begun = places.join(small(stored(first, "rarest-terms"), how), "t").select("row", "w", "need", (F.col("pos") - F.col("at")).alias("begin"), "t2", "at2")
    begun = stored(begun.where("begin >= 0"), "begins")
    seconds = places.join(small(stored(first.select("t2").where("t2 is not null").distinct().toDF("t"), "second-terms"), how), "t")
    asked = begun.where("need > 1").select("row", F.col("t2").alias("t"), (F.col("begin") + F.col("at2")).alias("pos"), "w", "need", "begin")
    both = stored(asked.join(seconds, ["row", "t", "pos"]).select("row", "w", "need", "begin"), "begins-of-two")
    others = both.where("need > 2").join(small(ranked.select("w", F.expr("slice(terms, 3, need)").alias("others")), how), "w")
    others = others.select("row", "w", "need", "begin", F.explode("others").alias("o"))
    others = stored(others.select("row", F.col("o.t").alias("t"), (F.col("begin") + F.col("o.at")).alias("pos"), "w", "need", "begin"), "other-places")
    rows = stored(both.select("row").distinct(), "rows-of-two")
    if fits(rows, how):
        places = places.join(F.broadcast(rows), "row")
    found = places.join(small(others, how), ["row", "t", "pos"]).groupBy("row", "w", "need", "begin").count()
    whole = found.where("count = need - 2").select("row", "w", "need", "begin")
    short = begun.where("need = 1").select("row", "w", "need", "begin").unionByName(both.where("need = 2"))
    return whole.unionByName(short).select("row", "w", "begin", (F.col("begin") + F.col("need")).alias("end"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, distance: int, how: Phrases = Phrases()) -> DataFrame:
    """``doc_id, item_id, pos``: postings of a window's rarest term that have all of
    the window's other terms within ``distance`` words, in any order."""
    tests = test_words(benchmark)
    index = positional_index(docs, tests, how)
    windows = ranked_windows(tests, index, how)
    rare = windows.ranked.select("w", F.col("terms")[0]["t"].alias("t"))
    begun = stored(index.places().join(small(stored(rare, "rarest-terms"), how), "t").select("row", "pos", "w"), "begins")
    around = begun.select("row", F.col("pos").alias("centre"), "w", F.explode(F.sequence(F.col("pos") - distance, F.col("pos") + distance)).alias("pos"))
    near = index.places().join(small(stored(around, "places-around"), how), ["row", "pos"]).groupBy("row", "centre", "w").agg(F.collect_set("t").alias("near"))
    wanted = windows.ranked.select("w", F.array_distinct(F.transform("terms", lambda x: x["t"])).alias("wanted"))
    met = near.join(small(stored(wanted, "wanted"), how), "w").where(F.size(F.array_except("wanted", "near")) == 0)
    told = met.select("row", "w", F.col("centre").alias("pos")).join(small(windows.items, how), "w").join(index.documents(), "row")
    return told.select("doc_id", "item_id", "pos").distinct()


def covered(spans: Column) -> Column:
    """Number of places that [begin, end) spans cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(s["begin"], acc["upto"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """``row, doc_id, n_words, n_hit, items`` per row of ``docs``; items are sorted ids."""
    tests = test_words(benchmark)
    index = positional_index(docs, tests, how)
    windows = ranked_windows(tests, index, how)
    hits = stored(phrase_matches(index, windows, how), "hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    items = hits.select("row", "w").distinct().join(small(windows.items, how), "w").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return index.documents().join(spans.join(items, "row"), "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns.

    The verdicts' row numbers are those of this very scan, so only flagged numbers
    are joined back.
    """
    numbers = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    own = stored(docs.select(F.monotonically_increasing_id().alias("__row"), *numbers), "numbered")
    judged = contamination(own.select(F.col("__row").alias("doc_id"), F.col(f"c{docs.columns.index('text')}").alias("text")), benchmark, how)
    bad = judged.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("__row"))
    return own.join(bad, "__row", "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
