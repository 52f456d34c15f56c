"""Lexical index and BM25 search (k1 = 1.5, b = 0.75, negative weights replaced by a quarter of the mean weight)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from folioflow.functions.impact import Block
from folioflow.functions.text import terms
from folioflow.runtime import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Largest number of distinct (query, term) rows that is broadcast, some 20 MB.
QUERY_TERMS = 500_000
#: Terms of the texts, and queries, that one task meets.
BLOCK_TERMS, BLOCK_QUERIES = 4_000_000, 131_072
#: Fewest terms and queries that are worth a task of their own.
LEAST_TERMS, LEAST_QUERIES = 200_000, 8192
#: Folders of term hashes in a kept index; a search reads those of its terms only.
FOLDERS = 64


def _terms_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, t) with the terms of each text; the text itself goes no further."""
    return docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("doc_id"), terms(text_column).alias("t"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(term, df, total): in how many texts each term stands, and the empty term for the texts themselves, whose ``total`` is the sum of
    their lengths in terms. One scan, combined on the map side, so that only terms are shuffled."""
    each = _terms_of(docs, id_column, text_column).select(F.size("t").cast("long").alias("dl"), F.explode(F.array_union(F.array(F.lit("")), F.col("t"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))


def corpus(vocab: DataFrame) -> DataFrame:
    """One row: number of texts and their mean length in terms."""
    return vocab.where("term = ''").select(F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avgdl"))


def term_weights(vocab: DataFrame) -> DataFrame:
    """(term, df, idf, avgdl): negative weights become ``EPSILON`` times the mean of all weights."""
    raw = vocab.where("term <> ''").join(F.broadcast(corpus(vocab))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def asked_terms(queries: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, term, qf): a term that a query repeats counts again."""
    return queries.where(F.col(query_text).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(terms(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def _sent(asked: DataFrame):
    """Broadcast for a counted query set of at most ``QUERY_TERMS`` rows, else none: those joins are shuffled."""
    return F.broadcast if asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS else lambda df: df


def _score(postings: DataFrame, weighted: DataFrame, send, k: int | None) -> DataFrame:
    """(query_id, doc_id, score, rank) from (doc_id, term, tf, dl), partitioned by document, and (query_id, term, qf, idf, avgdl)."""
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = postings.join(send(weighted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, k)


def _labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning deals to as many different partitions as there are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by: dict[int, list[int]] = {}
    for i, p in spark.range(64 + 16 * max(n, parts)).select(F.col("id").cast("int").alias("i"), F.expr(f"pmod(hash(cast(id as int)), {parts})").alias("p")).collect():
        by.setdefault(p, []).append(i)
    turns = [x for turn in range(max(map(len, by.values()))) for x in (held[turn] for held in by.values() if turn < len(held))]
    return turns[:n]


def _met(asked: DataFrame, docs: DataFrame, vocab: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best, from asked terms (query_id, term, qf) and texts (doc_id, t), with ``by`` among the
    texts of equal ``by`` only, which both sides have.

    Texts and queries are dealt into blocks of bounded size, and each block of texts meets each block of queries once, in one task
    (:class:`Block`): pairs of a query and a text never become rows but for the few that may be among the ``k`` best.
    """
    spark = docs.sparkSession
    of = vocab.where("term = ''").first()
    empty = spark.createDataFrame([], T.StructType([asked.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())]))
    if of is None:
        return empty
    avgdl, keep = of["total"] / of["df"], [by] if by else []
    weighted = asked.join(term_weights(vocab), "term").select("query_id", *keep, "term", (F.col("qf") * F.col("idf")).alias("w"))
    each = cut(weighted.groupBy("query_id", *keep).agg(F.collect_list(F.struct("term", "w")).alias("x")).select("query_id", *keep, "x.term", "x.w"))
    asking, cores = each.count(), spark.sparkContext.defaultParallelism
    if not asking:
        return empty
    blocks = -(-of["total"] // BLOCK_TERMS)
    rounds = max(-(-asking // BLOCK_QUERIES), min(-(-asking // LEAST_QUERIES), -(-2 * cores // blocks)))
    if rounds == 1:
        blocks = max(blocks, min(cores, -(-of["total"] // LEAST_TERMS)))
    labels = F.array(*(F.lit(x) for x in _labels(spark, blocks * rounds)))
    place = lambda c, n: F.pmod(F.xxhash64(F.lit(7), c), F.lit(n)).cast("int")  # noqa: E731 - another hash than the one that deals to partitions
    # one string takes half the disk that an array does
    left = docs.withColumn("t", F.array_join("t", " ")).withColumn("cell", F.explode(F.slice(labels, place("doc_id", blocks) * rounds + 1, rounds)))
    own = F.filter(labels, lambda _, i: i % rounds == place("query_id", rounds))
    right = each.withColumn("cell", F.explode(own))

    def run(texts, queries):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(q, d, s):
            return pa.table({"query_id": q, "doc_id": d, "score": pa.array(s, pa.float64())})

        ids, there = queries["query_id"].combine_chunks(), texts["doc_id"].combine_chunks()
        none = out(ids.slice(0, 0), there.slice(0, 0), [])
        if not len(ids) or not len(there):
            return none
        texts = texts.take(pc.sort_indices(texts, sort_keys=[*((by, "ascending") for by in keep), ("doc_id", "ascending")]))
        there, blank = texts["doc_id"].combine_chunks(), pc.equal(texts["t"], "").to_numpy()
        lists = pc.split_pattern(texts["t"].combine_chunks(), " ")
        texts = texts.drop_columns("t")
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # rows of one id are one text
        fresh = lambda c: pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
        new = np.append(True, np.logical_or.reduce([fresh(texts[c].combine_chunks()) for c in (*keep, "doc_id")]))
        number, head = np.cumsum(new) - 1, np.flatnonzero(new)
        spread = queries["term"].combine_chunks()
        known = pc.unique(pc.list_flatten(spread))
        index = lambda flat: pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, t = len(head), index(pc.list_flatten(lists))
        key = t * n + np.repeat(number, length)
        length[blank] = 0
        key = np.sort(key[t >= 0])
        del t, lists
        texts, there, length = texts.take(pa.array(head)), there.take(pa.array(head)), length[head]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(start, append=len(key))
        key = key[start]
        term, doc = np.divmod(key, n)
        block = Block(term, doc, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / avgdl)), len(known), n)
        at = np.append(0, np.cumsum(pc.list_value_length(spread).to_numpy(zero_copy_only=False)))
        t, w = index(pc.list_flatten(spread)), pc.list_flatten(queries["w"].combine_chunks()).to_numpy(zero_copy_only=False)
        every = [(t[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:])]
        if keep:
            places = texts[by].combine_chunks().dictionary_encode()
            code = places.indices.to_numpy(zero_copy_only=False)
            want = pc.fill_null(pc.index_in(queries[by].combine_chunks(), places.dictionary), -1).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(code, want), np.searchsorted(code, want, "right")
            hits = ((q, *block.within(*every[q], low[q], high[q], key, k)) for q in np.flatnonzero(high > low))
        else:
            hits = block.search(every, k)
        rows = [x for x in hits if len(x[1])]
        if not rows:
            return none
        who = np.repeat([q for q, _, _ in rows], [len(d) for _, d, _ in rows])
        return out(ids.take(pa.array(who)), there.take(pa.array(np.concatenate([d for _, d, _ in rows]))), np.concatenate([s for _, _, s in rows]))

    schema = T.StructType([each.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, schema)
    return cut(ranked(found.withColumn("score", F.round("score", 6)).where("score > 0"), k))


def search(queries: DataFrame, docs: DataFrame, k: int = 15, query_id: str = "query_id", query_text: str = "text", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best texts of each query.

    Repeated query terms count again. Scores are compared after rounding to six digits, ties by the smaller id; scores not above
    zero are no hits. The texts are read twice, for the vocabulary and for their terms; what is shuffled is terms and hits.
    """
    return _met(asked_terms(queries, query_id, query_text), _terms_of(docs, id_column, text_column), cut(vocabulary(docs, id_column, text_column)), k)


def search_within(queries: DataFrame, docs: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, text, source) among the texts (doc_id, text, source) of their own source. The
    source is met before the ranking, so none is lost to others; weights are those of the whole corpus."""
    asked = asked_terms(queries).join(queries.select("query_id", "source").distinct(), "query_id").where("source is not null")
    own = docs.where("text is not null and source is not null").select("doc_id", "source", terms("text").alias("t"))
    return _met(asked, own, cut(vocabulary(docs)), k, "source")


def _folder(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int").alias("folder")


def write_index(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Keeps the postings, in folders by term hash, and the vocabulary of a table at ``path``."""
    each = _terms_of(docs, id_column, text_column).select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    posts = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    posts.select("*", _folder()).repartition("folder", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    vocabulary(docs, id_column, text_column).write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_index(docs: DataFrame, path: str, text_column: str = "text") -> tuple[DataFrame, DataFrame] | None:
    """(postings, vocabulary) kept at ``path``, or None where there is none or the number of texts has changed since."""
    spark = docs.sparkSession
    try:
        posts, vocab = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary")
    except AnalysisException:
        return None
    kept = vocab.where("term = ''").first()
    return (posts, vocab) if (kept["df"] if kept else 0) == docs.where(F.col(text_column).isNotNull()).count() else None


def search_index(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int | None = 15) -> DataFrame:
    """``search`` over a kept index: no text is read, and of the postings only those of the queries' terms."""
    posts, vocab = index
    asked = asked_terms(queries)
    send = _sent(asked)
    wanted = asked.select("term", _folder()).distinct()
    met = posts.join(send(wanted), ["folder", "term"], "left_semi").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return _score(met, asked.join(term_weights(vocab), "term"), send, k)


def ranked(scored: DataFrame, k: int | None, by: str = "query_id", ties: str = "doc_id") -> DataFrame:
    """Rank 1.. within each query by score, ties by the smaller id; Spark keeps only ``k`` rows a group before the exchange."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), ties)).cast("long"))
    return out.where(F.col("rank") <= k) if k else out
