"""BM25 over a corpus table ``(source, chunk_id, text)``.

Weights follow the common Okapi form with k1=1.5, b=0.75 and a floor for negative idf of
0.25 times the mean idf. The corpus is read twice: once to count its vocabulary, with
map-side combine, and once to score it. A frequent word meets every query in every document,
so scoring never forms (query, document) rows: each task builds the inverted lists of its documents and reads
only the blocks that can still change a query's best ``k``. Only those rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators.postings import Postings, ask
from foliant.plans.blocks import visit
from foliant.plans.ordered import top_n
from foliant.plans.session import cut_lineage, staged

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values
DOC = ["source", "chunk_id"]
TIMES = 8  # rows of words are small, and a query costs little more in a larger payload


def corpus_order() -> list[Column]:
    """Total order of a corpus: source, then the chunk id as text, then the text itself."""
    return [F.col("source").asc(), F.col("chunk_id").cast("string").asc(), F.col("text").asc()]


def ordered_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy(*corpus_order())


def positions(corpus: DataFrame) -> DataFrame:
    """1-based place of each row in corpus order.

    The range-sorted rows are checkpointed once with their partition-local number, so the
    partition sizes and the rows come from the same sort; only sizes meet in one task.
    """
    local = ordered_corpus(corpus).select(*DOC, F.monotonically_increasing_id().alias("m"))
    fixed = cut_lineage(local).select(
        *DOC,
        F.shiftright("m", 33).alias("part"),
        (F.col("m").bitwiseAND((1 << 33) - 1) + 1).alias("inside"),
    )
    sizes = fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return fixed.join(base, "part").select((F.col("base") + F.col("inside")).alias("position"), *DOC)


def tokenized(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    return corpus.select(*(by or []), *DOC, tokens(F.col("text")).alias("terms")).withColumn(
        "dl", F.size("terms")
    )


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _each(tokened: DataFrame, *columns: str) -> DataFrame:
    """``columns + [term]``: a row per word; the outer form keeps the planner from a filter that finds all words again."""
    return tokened.select(*columns, F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def _vocabulary(tokened: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [term, df, words]`` per distinct term. Every document also counts once under
    the empty term, which gives the corpus size and the word total in the same pass."""
    terms = F.array_append(F.array_distinct("terms"), F.lit(""))
    return (
        _each(tokened.select(*keys, "dl", terms.alias("terms")), *keys, "dl")
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words"))
    )


def term_stats(tokened: DataFrame) -> DataFrame:
    """``term, df, n_docs, avgdl, idf`` for the whole vocabulary."""
    counts = cut_lineage(_vocabulary(tokened, []))
    whole = counts.where("term = ''")
    n_docs = whole.select("df").scalar()
    avgdl = whole.select(F.col("words") / F.col("df")).scalar()
    raw = counts.where("term <> ''").withColumn("raw", _raw_idf(n_docs, F.col("df")))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor")).scalar()
    return raw.select(
        "term",
        "df",
        n_docs.alias("n_docs"),
        avgdl.alias("avgdl"),
        F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"),
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, weight``; a repeated query word counts each time."""
    return (
        _each(queries.select("query_id", tokens(F.col("text")).alias("terms")), "query_id")
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _saturation(tf, dl, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _scored(
    rows: DataFrame, weights: DataFrame, names: list[str], ties: list[str], k: int, entries: Callable[[pa.Table, pa.Array | None], tuple], schema: str,
) -> DataFrame:
    """Rows of each payload that may be among the best ``k`` of a query, by :mod:`foliant.operators.postings`.

    ``weights``: ``query_id, term, w``, terms being words or their numbers; ``entries(payload, vocabulary)`` gives row, value and term number of every posting and
    the terms; those outside ``vocabulary`` may be left out. Equal scores are ordered by ``ties`` as text.
    """

    def prepare(payload: pa.Table, asked: pa.Table | None) -> tuple[Postings, pa.Table]:
        wanted = None if asked is None else pc.unique(asked.column("term"))
        row, value, code, terms = entries(payload, wanted)
        order = pc.sort_indices(
            pa.table([payload.column(n).cast(pa.string()) for n in ties], names=ties), [(n, "ascending") for n in ties], null_placement="at_start"
        ).to_numpy()
        tie = np.empty(len(order), np.int64)
        tie[order] = np.arange(len(order))
        return Postings.of(tie, row, terms, value, code), payload.select(names)

    def search(made: tuple[Postings, pa.Table], block: pa.Table, held: dict) -> pa.RecordBatch | None:
        query, doc, score = ask(made[0], block, held, k)
        if not len(query):
            return None
        found = made[1].take(pa.array(doc)).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), *found.columns, pa.array(score)], ["query_id", *names, "score"])

    return visit(rows, weights, "query_id", F.length(F.col("term").cast("string")) + 24, prepare, search, schema, TIMES)


def _flat(column) -> tuple[np.ndarray, pa.Array]:
    """Row number of every list element, and the elements."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def _codes(words: pa.Array, vocabulary: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, -1 outside ``vocabulary``, and the words by number."""
    if vocabulary is None:
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), vocabulary


def search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` documents per query; equal scores keep corpus order.

    Scores are compared at nine places, because the order of a distributed sum is not fixed.
    """
    order = [
        F.round("score", 9).desc(), F.col("source").asc(), F.col("chunk_id").cast("string").asc()
    ]
    tokened = tokenized(corpus)
    stats = term_stats(tokened)
    weights = query_terms(queries).join(stats.withColumnRenamed("term", "__t"), F.col("term") == F.col("__t")).select(
        "query_id", "term", (F.col("weight") * F.col("idf")).alias("w"), "avgdl"
    )
    weights = cut_lineage(weights)
    average = weights.select(F.max("avgdl").alias("avgdl"))  # one number, the same in every row

    def entries(payload: pa.Table, vocabulary: pa.Array | None):
        row, flat = _flat(payload.column("terms").combine_chunks())
        code, terms = _codes(flat, vocabulary)
        held = code >= 0
        size = max(1, len(terms))
        pairs, tf = np.unique(row[held] * size + code[held], return_counts=True)
        at = pairs // size
        dl, avgdl = (payload.column(c).to_numpy() for c in ("dl", "avgdl"))
        return at, _saturation(tf, dl[at], avgdl[at]), pairs % size, terms

    types = dict(corpus.select(*DOC).dtypes)
    schema = f"query_id bigint, source {types['source']}, chunk_id {types['chunk_id']}, score double"
    rows = tokened.withColumn("avgdl", F.coalesce(average.scalar(), F.lit(1.0)))
    return top_n(_scored(rows, weights.drop("avgdl"), DOC, DOC, k, entries, schema), ["query_id"], order, k)


def _isolated_parts(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``document_id, record_id, word, part``: idf times saturation with the statistics of
    each document's own records, for the words some query holds.

    ``vocabulary``: ``term, word``, the words and their numbers. It is a written table, so that as long as it is small no word is
    shuffled by itself; what is shuffled carries numbers.
    """
    tokened = records.select(
        "document_id", "record_id", tokens(F.col("text")).alias("terms")
    ).withColumn("dl", F.size("terms"))
    counts = staged(_vocabulary(tokened, ["document_id"]), "counts")
    sizes = counts.where("term = ''").select(
        F.col("document_id").alias("d_n"), F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl")
    )
    raw = (
        counts.where("term <> ''")
        .join(staged(sizes, "sizes"), F.col("document_id") == F.col("d_n"))
        .withColumn("raw", _raw_idf(F.col("n"), F.col("df")))
    )
    floors = raw.groupBy(F.col("document_id").alias("d_f")).agg((F.avg("raw") * EPSILON).alias("floor"))
    # under new names, as the documents meet statistics made of themselves
    idf = (
        raw.join(vocabulary, "term")
        .join(floors, F.col("document_id") == F.col("d_f"))
        .select(
            F.col("document_id").alias("d"), F.col("word").alias("t"), "avgdl",
            F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"),
        )
    )
    # dealt as the statistics are, so that counting and meeting them is one shuffle
    hits = (
        _each(tokened, "document_id", "record_id", "dl")
        .join(vocabulary, "term")
        .select("document_id", "record_id", "dl", "word")
        .repartition("document_id", "word")
        .groupBy("document_id", "record_id", "dl", "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    part = F.col("idf") * _saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.join(idf, (F.col("document_id") == F.col("d")) & (F.col("word") == F.col("t"))).select(
        "document_id", "record_id", "word", part.alias("part")
    )


def isolated_search(records: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """Merged ranking over the isolated indexes: score, then record id.

    ``records``: ``document_id, record_id, text``. A record's word list is bounded by its text.
    """
    if not 1 <= k <= 32:
        raise ValueError("k must be between 1 and 32")
    wanted = staged(query_terms(queries), "wanted")
    vocabulary = staged(wanted.select("term").distinct().withColumn("word", F.monotonically_increasing_id()), "vocabulary")
    parts = _isolated_parts(records, vocabulary)
    order = [F.round("score", 9).desc(), F.col("record_id").asc()]
    names = ["document_id", "record_id"]
    listed = parts.groupBy(*names).agg(F.collect_list(F.struct("word", "part")).alias("parts"))

    def entries(payload: pa.Table, vocabulary: pa.Array | None):
        row, flat = _flat(payload.column("parts").combine_chunks())
        code, terms = _codes(flat.field("word"), vocabulary)
        held = code >= 0
        return row[held], flat.field("part").to_numpy(zero_copy_only=False)[held], code[held], terms

    types = dict(records.select(*names).dtypes)
    schema = f"query_id bigint, document_id {types['document_id']}, record_id {types['record_id']}, score double"
    weights = wanted.join(vocabulary, "term").select("query_id", F.col("word").alias("term"), F.col("weight").cast("double").alias("w"))
    return top_n(_scored(listed, weights, names, ["record_id"], k, entries, schema), ["query_id"], order, k)
