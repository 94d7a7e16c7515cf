"""Full-text search: terms with positions, boolean and phrase matching, BM25 ranking over an inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import write_and_reread

#: Words (about) whose postings a task sorts at once.
GROUP_WORDS = 1 << 20
#: Frequent English words that carry no meaning of their own.
STOP_WORDS = "a an and are as at be but by for from has he in is it its not of on or she that the their they this to was we were which with you".split()


def terms(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _contains(text: Column, words: list[str], every: bool = True) -> Column:
    """A cheap test that goes before terms are split: the words occur in the text somewhere."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), None
    for w in words:
        one = low.contains(w)
        found = one if found is None else found & one if every else found | one
    return F.lit(every) if found is None else found


def has_all(text: Column, words: list[str]) -> Column:
    t = terms(text)
    return _contains(text, words) & F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(t, w))


def has_any(text: Column, words: list[str]) -> Column:
    return _contains(text, words, every=False) & F.arrays_overlap(terms(text), F.array(*map(F.lit, words)))


def has_none(text: Column, words: list[str]) -> Column:
    return ~has_any(text, words)


def has_prefix(text: Column, prefix: str) -> Column:
    return _contains(text, [prefix]) & F.exists(terms(text), lambda w: w.startswith(prefix))


def has_phrase(text: Column, words: list[str], gap: int = 1) -> Column:
    """Whether the words follow one another, each `gap` places after the one before."""
    joined = F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))
    if gap == 1:
        return _contains(text, words) & joined.contains(" " + " ".join(words) + " ")
    between = " (?:[^ ]+ ){%d}" % (gap - 1)
    return _contains(text, words) & joined.rlike(" " + between.join(map(re.escape, words)) + " ")


def _equals(word: str):
    return lambda w: w == word


def _row_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each row (id, terms): its words sorted by term, no row meeting another."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.cumsum(lengths) // GROUP_WORDS
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(lengths)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            n = lengths[begin:end]
            coded = batch.column(1).slice(begin, end - begin).flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            by = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(by, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(by[order]) > 0])
            ends = np.r_[first, len(order)]
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            term = coded.dictionary.take(pa.array(coded.indices.to_numpy()[order[first]]))
            ids = batch.column(0).slice(begin, end - begin).take(pa.array(row[order[first]]))
            yield pa.RecordBatch.from_arrays([term, ids, pa.array(np.diff(ends), pa.int64()), positions], names=["term", batch.schema.names[0], "tf", "positions"])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """The inverted index: (term, id, tf, positions) of every document; positions count stop words, which are left out.

    A row's postings are made where it is read. Only rows that share their id with others are grouped by term and id; these ids are written first.
    """
    schema = f"term string, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, tf long, positions array<int>"
    made = lambda d: d.select(id_col, terms(F.col(text_col)).alias("terms")).mapInArrow(_row_postings, schema)
    repeated = write_and_reread(docs.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_id")), "repeated-ids")
    if repeated.isEmpty():
        found = made(docs)
    else:
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        shared = made(docs.join(repeated, same, "left_semi")).groupBy("term", id_col)
        shared = shared.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        found = made(docs.join(repeated, same, "left_anti")).unionByName(shared)
    return found.where(~F.col("term").isin(stop_words)) if stop_words else found


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document that holds a query term; a better match has a lower, negative score."""
    # Bound to a lambda's variable, the terms are split once for all counts; the counts are written, since statistics and scores both read them.
    counts = lambda t: F.struct(F.size(t).alias("dl"), *[F.size(F.filter(t, _equals(q))).alias(f"tf_{i}") for i, q in enumerate(query)])
    counted = write_and_reread(docs.select(id_col, F.inline(F.transform(F.array(terms(F.col(text_col))), counts))), "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query))])
    scored = counted.where(" OR ".join(f"tf_{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))  # one row
    parts = [F.log(1 + (F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)) * F.col(f"tf_{i}") * (k1 + 1) / (F.col(f"tf_{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) for i in range(len(query))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return scored.select(id_col, (-total).alias("score"))
