"""Language identification by compression with per-language zstandard dictionaries.

From labelled documents a raw-content dictionary is filled for each language.  A text is
then compressed once with each dictionary, and the language whose dictionary makes it
smallest is chosen; where the runner-up is nearly as small the choice counts as narrow.

* The dictionary of a language comes from a bounded sample: the ``SAMPLE_ROWS`` distinct
  texts of the smallest hash, an excerpt of at most ``EXCERPT`` characters from each, equal
  shares of ``DICTIONARY`` characters.  ``ALL_DICTIONARIES`` bounds all languages together
  (with many languages each gets less), so what tasks receive never grows with the corpus.
  Only texts and labels are learnt from; hashes of texts, not ids, choose the sample.
* Texts are compressed whole, in lower case, in pieces of ``PIECE`` bytes, so that the
  dictionary and not the text's own beginning is what helps, however long the text is.
* zstandard stores tiny texts as they are if nothing is gained; texts under ``SHORT`` bytes
  are therefore written three times in a row, which leaves only the first to be paid for.

``score`` is the winner's share if each further byte halves a language's weight.  A choice
is narrow if the winner saves less than ``MARGIN`` of the runner-up's size.

Defined results: a null text, an empty one and one without a letter have the language
``und``, score 0, and are narrow; so has every text if nothing was learnt.  Of equally small
languages the one with more documents learnt from wins, then the first by name.  Rows with a
null label or a null or letterless text are not learnt from.  Repeated texts count once in
a sample.  With one learnt language everything with a letter is that language, score 1.  An empty table gives no rows.  Columns are only seen
through ``carry``, so extra columns cannot clash.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.common import chunks, column, short_batches, worker_state

SAMPLE_ROWS = 512
EXCERPT = 1024
DICTIONARY = 1 << 16
ALL_DICTIONARIES = 1 << 24
SALT = 32
LEVEL = 9
PIECE = 2048
SHORT = 256
MARGIN = 0.02
UNKNOWN = "und"

GUESS = "lang string, score double, narrow boolean"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) of the labelled rows, languages of most rows first."""
    body, label = column(labelled, text).cast("string"), column(labelled, lang).cast("string")
    rows = labelled.where(label.isNotNull() & has_letter(body)).select(label.alias("lang"), F.lower(body).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    size = min(DICTIONARY, ALL_DICTIONARIES // len(counts))
    found = F.xxhash64("text")
    spare = F.greatest(F.length("text") - EXCERPT, F.lit(0))
    cut = rows.select("lang", found.alias("h"), F.sha2("text", 256).alias("same"),
                      F.substring(F.col("text"), (F.pmod(F.shiftright(found, 8), spare + 1) + 1).cast("int"), F.lit(EXCERPT)).alias("part"))
    # the smallest hashes of each language, in two rounds: no language is one task
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(SALT))).orderBy("h", "same")
    whole = Window.partitionBy("lang").orderBy("h", "same")
    once = cut.groupBy("lang", "h", "same").agg(F.min("part").alias("part"))
    few = once.withColumn("_at", F.row_number().over(salted)).where(F.col("_at") <= SAMPLE_ROWS)
    few = few.withColumn("_at", F.row_number().over(whole)).where(F.col("_at") <= SAMPLE_ROWS)
    parts = few.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("h", "same", "part"))).alias("parts"))
    share = F.greatest((F.lit(size) / F.size("parts")).cast("int"), F.lit(1))
    filled = parts.select("lang", F.array_join(F.transform("parts", lambda p: F.substring(p["part"], F.lit(1), share)), "\n").alias("content"))
    made = {r["lang"]: r["content"].encode("utf-8", "replace")[:4 * size] for r in filled.collect()}
    return sorted(made.items(), key=lambda x: (-counts[x[0]], x[0]))


class Compressors:
    """A digested dictionary per language."""

    def __init__(self, model: list[tuple[str, bytes]]):
        import zstandard

        self.names = [name for name, _ in model]
        self.each = []
        for _, content in model:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        if len(raw) < SHORT:
            raw = b" ".join([raw] * 3)
        pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.each]

    def guess(self, text: str) -> tuple[str, float, bool]:
        sizes = self.sizes(text)
        least = min(sizes)
        rest = sorted(sizes)[1:2]
        score = 1.0 / sum(2.0 ** max(least - s, -1000) for s in sizes)
        return self.names[sizes.index(least)], score, bool(rest) and rest[0] - least < MARGIN * rest[0]


def identify(df: DataFrame, model: list[tuple[str, bytes]], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: ``row`` (the columns in ``carry``, all by default), ``guess``
    (the nearest language), ``lang`` (the same, null where the choice is narrow), ``score``, ``narrow``."""
    short_batches(df.sparkSession)
    digest = hashlib.sha256(repr(model).encode()).hexdigest()

    @F.pandas_udf(GUESS)
    def guessed(texts: pd.Series) -> pd.DataFrame:
        known = worker_state(("languages", digest), lambda: Compressors(model))
        rows = [known.guess(t) for part in chunks(texts) for t in part]
        return pd.DataFrame(rows, columns=["lang", "score", "narrow"])

    carry = df.columns if carry is None else carry
    body = column(df, text).cast("string")
    kept = df.select(F.struct(*[column(df, c).alias(c) for c in carry]).alias("row"),
                     F.when(has_letter(body), F.lower(body)).alias("text"))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("narrow"))
    found = F.when(F.col("text").isNotNull(), guessed(F.coalesce("text", F.lit("a")))).otherwise(unknown) if model else unknown
    got = kept.select("row", found.alias("g"))
    return got.select("row", F.col("g.lang").alias("guess"), F.when(~F.col("g.narrow"), F.col("g.lang")).alias("lang"),
                      F.col("g.score").alias("score"), F.col("g.narrow").alias("narrow"))
