"""A training corpus from raw documents: quality rules, near duplicates, leaks, packing.

Each stage gets the documents its predecessor kept and works on all of them; what it
decides takes effect.  Stages before the last return the columns of ``documents``.

A stage's inner tables are needed until its result has been written, which is before the
next stage begins: that is when they are given back.  Null and empty texts fail the quality
rules; texts of any length are worked on whole; an empty table gives no rows.
"""

from functools import wraps

from foretally.llm import decontamination, jaccard_join, packing, quality
from foretally.llm.queries import WORD_BPE
from foretally.session import durable, release, tables_made
from foretally.sources.tables import table


_inner: list[str] = []  # tables of the stage before


def stage(fn):
    """Give back the inner tables of the stage before; its result, this one's ``docs``, is written."""
    @wraps(fn)
    def run_stage(spark, docs, sf_dir):
        release(spark, _inner)
        del _inner[:]
        with tables_made() as made:
            result = fn(spark, docs, sf_dir)
        _inner.extend(made)
        return result
    return run_stage


@stage
def quality_rules(spark, docs, sf_dir):
    """Drop documents that fail the base rules or lie outside their language's perplexity bands."""
    return quality.kept_documents(docs)


@stage
def near_duplicates(spark, docs, sf_dir):
    """Keep the document of smallest doc_id of each class linked by the 5-gram Jaccard join."""
    return jaccard_join.one_of_each(docs)


@stage
def decontaminate(spark, docs, sf_dir):
    """Drop documents in which a ten-word window of a benchmark item occurs."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark, docs, sf_dir):
    """Pack what is left into training sequences: one row per piece."""
    packed = packing.pack_documents(docs, WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

# tokens and the language model are beyond SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages one after another, each on the stored result of the one before."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, of_stage in STAGES:
        result = of_stage(spark, docs, sf_dir)
        with tables_made() as made:
            docs = durable(result)
        release(spark, before)
        before = made
    release(spark, _inner)
    del _inner[:]
    return docs
