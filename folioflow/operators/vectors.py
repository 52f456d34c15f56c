"""Exact vector search by cosine similarity, for one query and for a stated set of queries."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.functions.sets import dot, norm
from folioflow.operators.lexical import ranked
from folioflow.runtime import cut

#: Largest block of query vectors (rows) that is sent to the executors at once.
QUERY_BLOCK = 4096


def top_k(vectors: DataFrame, query: list[float], k: int = 15, id_column: str = "vec_id", vector: str = "embedding", where: str | None = None) -> DataFrame:
    """(vec_id, score, rank) of the ``k`` nearest; a metadata condition ``where`` is applied before the ranking."""
    base = vectors.where(where) if where else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    length = float(np.sqrt(np.sum(np.square(np.asarray(query, np.float64))))) or 1.0
    score = F.round(dot(F.col(vector), q) / (norm(F.col(vector)) * length), 6)
    scored = base.where(F.col(vector).isNotNull()).select(F.col(id_column), score.alias("score")).where("score is not null")
    best = scored.orderBy(F.desc("score"), id_column).limit(k)
    return ranked(best.withColumn("query_id", F.lit(0)), k, ties=id_column).drop("query_id")


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 15, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) for every query of a stated set against all vectors.

    Queries come to the driver in blocks of at most ``QUERY_BLOCK``, never all at once; each block goes out with its scan (a
    proven size), and every partition of ``vectors`` keeps only its own ``k`` best per query, so what is shuffled is k rows
    per query and partition. With more than one block, each block's result is written before the next begins. Null vectors
    and those of another length are no hits.
    """
    def scan(block: pd.DataFrame) -> DataFrame:
        ids = block["query_id"].to_numpy()
        matrix = np.array(block["q"].to_list(), np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

        def run(batches):
            held = None
            for batch in batches:
                batch = batch[batch[vector].map(lambda v: v is not None and len(v) == matrix.shape[1])]
                if not len(batch):
                    continue
                m = np.array(batch[vector].to_list(), np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                score = np.round(matrix @ m.T, 6) + 0.0
                own = batch[id_column].to_numpy()
                if held is not None:
                    score, own = np.hstack([held[1], score]), np.hstack([held[0], np.broadcast_to(own, (len(ids), len(own)))])
                else:
                    own = np.broadcast_to(own, (len(ids), len(own)))
                order = np.lexsort((own, -score), axis=1)[:, :k]
                held = np.take_along_axis(own, order, 1), np.take_along_axis(score, order, 1)
            if held is not None:
                yield pd.DataFrame({"query_id": np.repeat(ids, held[0].shape[1]), id_column: held[0].ravel(), "score": held[1].ravel()})

        return vectors.select(id_column, vector).mapInPandas(run, f"query_id long, {id_column} long, score double")

    found, held = None, []
    for row in chain(queries.where("q is not null").select("query_id", "q").toLocalIterator(), [None]):
        if row is not None:
            held.append((row["query_id"], row["q"]))
        if held and (row is None or len(held) == QUERY_BLOCK):
            one = ranked(scan(pd.DataFrame(held, columns=["query_id", "q"])), k, ties=id_column)
            several = found is not None or row is not None
            one = cut(one) if several else one
            found, held = one if found is None else found.unionByName(one), []
    return found if found is not None else vectors.sparkSession.createDataFrame([], f"query_id long, {id_column} long, score double, rank long")
