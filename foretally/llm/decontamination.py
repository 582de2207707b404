"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters.  A benchmark
item is searched by its windows of ten consecutive words (a shorter item is one window).

1. The words of all documents are stored once as one cleaned text per row.
2. Corpus counts of the benchmark's words say which two terms of each window are rarest;
   a window with a word that no document has cannot occur and is dropped.
3. One pass over the documents stores the postings (row, position, term) of those rarest
   terms: the positional index.
4. Each window meets its rarest terms' postings, shifted by their places in the window; a
   place survives where both shifted lists agree.  Words come from the rarest lists first,
   so frequent words never start a search.
5. The remaining terms are looked up at their places in the surviving documents: a phrase
   stands where all its terms agree.

The index is dealt out by document, once, so that the shifted lists, which are several times
its size, are intersected where they arise.  A cleaned text moves once, to its surviving
places.  Nothing is gathered per term, so a term, passage or text held by any share of the
documents is spread by its rows; windows and terms are benchmark sized and Spark broadcasts
them only below its own threshold.

Null and empty texts have no words and no hits; repeated rows are separate rows with equal
results; a null item id counts as an item but is not listed.  Empty tables give no rows,
and with no items every document is clean.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.common import LOWER, UPPER, column, partitions
from foretally.session import durable

WINDOW = 10

# every ASCII character that is neither a letter nor a digit separates words
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def cleaned(text):
    """The words of a text with single spaces between them."""
    plain = F.translate(text, SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER)
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def words_of(text):
    """Words of a cleaned text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win, n): the distinct windows of each item as text with their word count."""
    words = items.select("item_id", words_of(cleaned(F.coalesce("text", F.lit("")))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return (words.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("win"))
            .distinct())


def store_words(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(rid, row, clean, n_words): one stored row per document with a row number of its own."""
    return durable(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*[column(docs, c) for c in carry]).alias("row"),
        cleaned(F.coalesce(column(docs, "text"), F.lit(""))).alias("clean"),
    ).withColumn("n_words", F.size(words_of(F.col("clean"))).cast("long")))


def exploded(stored: DataFrame) -> DataFrame:
    """Every posting: (rid, pos, term)."""
    return stored.filter(F.col("clean") != "").select("rid", F.posexplode(F.split("clean", " ")).alias("pos", "term"))


def term_counts(stored: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences in all documents of the windows' words."""
    terms = durable(windows.select(F.explode(F.split("win", " ")).alias("term")).distinct())
    return durable(exploded(stored).select("term").join(terms, "term").groupBy("term").agg(F.count("*").alias("n_corpus")))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, key, n, term, at, turn): the two rarest terms of each window that can occur at all;
    ``key`` is a number of the window."""
    different = durable(windows.select("win", "n").distinct()).withColumn("key", F.monotonically_increasing_id())
    parts = different.select("win", "key", "n", F.posexplode(F.split("win", " ")).alias("at", "term"))
    known = parts.join(counts, "term")
    by_win = Window.partitionBy("win")
    ranked = known.select("win", "key", "n", "term", "at", F.count("*").over(by_win).alias("known"),
                          F.row_number().over(by_win.orderBy("n_corpus", "term", "at")).alias("turn"))
    return durable(ranked.filter((F.col("known") == F.col("n")) & (F.col("turn") <= 2)).drop("known"))


def positional_index(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (rid, pos, term) of the given terms."""
    return durable(exploded(stored).join(terms.select("term").distinct(), "term").select("rid", "pos", "term"))


def agreeing(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """Places where a window would begin by both its rarest terms: (rid, key, n, start).

    The postings of a document meet in one task, whose number is stated: they are small, the
    shifted lists are not."""
    dealt = index.repartition(4 * partitions(index.sparkSession), "rid")
    met = dealt.join(rarest, "term").select("rid", "key", "n", (F.col("pos") - F.col("at")).alias("start")).filter("start >= 0")
    # a term's place in the window gives one posting a place, so each list counts once
    both = met.groupBy("rid", "key", "n", "start").agg(F.count("*").alias("lists"))
    return both.filter(F.col("lists") == F.least(F.col("n"), F.lit(2))).drop("lists")


def phrase_matches(stored: DataFrame, windows: DataFrame) -> DataFrame:
    """Stored exact occurrences of the windows: (rid, win, n, start)."""
    rarest = rarest_terms(windows, term_counts(stored, windows))
    candidates = durable(agreeing(positional_index(stored, rarest), rarest))
    # the other terms, in the surviving documents only; by the same way whatever the size
    named = candidates.join(rarest.filter("turn = 1").select("key", "win"), "key")
    places = named.groupBy("rid").agg(F.collect_list(F.struct("win", "n", "start")).alias("places"))
    texts = stored.select("rid", "clean").join(places.hint("merge"), "rid").select("rid", F.split("clean", " ").alias("words"), "places")
    met = texts.select("rid", "words", F.explode("places").alias("p")).select("rid", "words", "p.*")
    there = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")
    return durable(met.filter(there == F.col("win")).select("rid", "win", "n", "start"))


def near_matches(stored: DataFrame, windows: DataFrame, within: int = 20) -> DataFrame:
    """Proximity: (rid, win, start) where a window's two rarest terms lie at most ``within``
    words apart, in either order; ``start`` is the rarest term's position."""
    rarest = rarest_terms(windows, term_counts(stored, windows))
    index = positional_index(stored, rarest)
    sides = [index.join(rarest.filter(f"turn = {k}"), "term").select("rid", "win", F.col("pos").alias(f"pos{k}"),
                                                                     F.floor(F.col("pos") / within).cast("int").alias("cell")) for k in (1, 2)]
    # the second term lies in the first one's stretch of text or in one beside it
    left = sides[0].withColumn("cell", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])))
    met = left.join(sides[1], ["rid", "win", "cell"]).filter((F.abs(F.col("pos1") - F.col("pos2")) <= within) & (F.col("pos1") != F.col("pos2")))
    return met.select("rid", "win", F.col("pos1").alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Every document with what was found in it: ``row`` (the carried columns), ``n_words``,
    ``n_hit`` (words inside any occurrence), ``n_items``, ``item_ids`` (sorted as strings)."""
    stored = store_words(docs, carry or docs.columns)
    windows = durable(item_windows(items, size))
    matches = phrase_matches(stored, windows)
    # words under the union of the occurrences: what each adds beyond the earlier ones
    earlier = Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("rid", "start", "n").distinct()
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(earlier), F.lit(0))
    hits = (spans.select("rid", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reach)).alias("added"))
            .groupBy("rid").agg(F.sum("added").alias("n_hit")))
    found = matches.select("rid", "win").distinct().join(windows.select("win", "item_id"), "win").select("rid", "item_id").distinct()
    # at most one entry per benchmark item
    listed = found.groupBy("rid").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    per_doc = hits.join(listed, "rid")
    zero = F.lit(0).cast("long")
    return stored.join(per_doc, "rid", "left").select(
        "row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no window of an item occurs."""
    return contamination(docs, items, size).filter(F.col("n_hit") == 0).select("row.*")
