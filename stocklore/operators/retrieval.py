"""Ranked retrieval: BM25 over an inverted index, dense vectors, reciprocal-rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .durable import durable

# BM25 and fusion constants, and the dimension of the hash embedding.
K1, B = 1.5, 0.75
RRF_K = 60
HASH_DIMENSION = 512


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``token``, ``tf``, ``length``): term frequencies are taken within the row, before anything is shuffled."""
    words = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("_w")).withColumn("length", F.size("_w"))
    return words.select("doc", "length", F.explode("_w").alias("token")).groupBy("doc", "length", "token").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, text: str) -> DataFrame:
    """(``query``, ``doc``, ``lexical``) of every pair that shares a term. Corpus statistics are over all documents; repeated query terms count repeatedly.

    Query terms are combined with their weights first and broadcast only if their measured
    size allows (the planner decides); the postings are filtered to query terms before the shuffle.
    """
    terms = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(query_text))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("qf"))
    index = postings(docs, key, text)
    size = docs.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size(tokens(F.col(text)))), F.lit(1.0)).alias("avgdl"))
    used = index.join(terms.select("token").distinct(), "token", "left_semi")
    df = used.groupBy("token").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "token").crossJoin(F.broadcast(size)).withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return used.join(weighted, "token").groupBy("query", "doc").agg(F.sum(gain).alias("lexical"))


def best(scores: DataFrame, score: str, k: int, rank: str = "rank", partition: str = "query", tie: str = "doc") -> DataFrame:
    """The ``k`` best of each query; ties go to the smaller document key. Each task first keeps its own best, so a query's matches never meet in one task."""
    spread = scores.withColumn("_s", F.pmod(F.xxhash64(tie), F.lit(64)))
    local = Window.partitionBy(partition, "_s").orderBy(F.desc(score), tie)
    few = spread.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k).drop("_r", "_s")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(score), tie))).where(F.col(rank) <= k)


def reciprocal_ranks(*ranked: DataFrame) -> DataFrame:
    """(``query``, ``doc``, ``fusion``): sum of 1 / (60 + rank) over the rank lists a document stands in."""
    union = reduce(lambda a, b: a.unionByName(b), [r.select("query", "doc", "rank") for r in ranked])
    return union.groupBy("query", "doc").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fusion"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _in_blocks(queries: DataFrame, key: str, work) -> DataFrame:
    """``work(rows)`` over the query set in blocks of about ``MAX_QUERIES`` rows. Several blocks are worked off one after the other, each result written to the shared folder, so one block at a time is held."""
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    if blocks == 1:
        return work(queries.orderBy(key).collect())
    parts = (queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).orderBy(key).collect() for b in range(blocks))
    return reduce(DataFrame.unionByName, [durable(work(rows)) for rows in parts])


def _similar(ids: list, families: list, matrix: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """Cosines of a block of queries and a batch of vectors; documents of another known family than the query's get -inf."""
    sims = np.round(matrix @ _unit(np.stack(pdf["_v"].to_numpy()).astype(float)).T, 9)
    if any(f is not None for f in families):
        mine, theirs = np.array(families, object)[:, None], pdf["_f"].to_numpy(object)[None, :]
        sims[(mine != None) & (theirs != None) & (mine != theirs)] = -np.inf  # noqa: E711
    return sims


def _vectors(rows: DataFrame, key: str, vector: str, family: str | None) -> DataFrame:
    kind = F.lower(F.col(family)) if family else F.lit(None).cast("string")
    return rows.select(F.col(key).alias("_k"), F.col(vector).alias("_v"), kind.alias("_f")).where("_v is not null and _k is not null")


def dense_best(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, query_key: str | None = None, query_vector: str | None = None, family: str | None = None, query_family: str | None = None) -> DataFrame:
    """(``query``, ``doc``, ``dense``, ``rank``): the ``k`` nearest vectors by cosine of each stated query vector; ties go to the smaller document key.

    The query set goes in blocks, however large it is; a block is one matrix product against each
    Arrow batch, and every batch keeps its own best only. With families, documents of another known
    family than the query's don't match. Null vectors and keys have no row.
    """
    asked, held = _vectors(queries, query_key or key, query_vector or vector, query_family), _vectors(vectors, key, vector, family)
    schema = f"query {dict(asked.dtypes)['_k']}, doc {dict(held.dtypes)['_k']}, dense double"

    def work(rows: list) -> DataFrame:
        if not rows:
            return vectors.sparkSession.createDataFrame([], schema)
        context = vectors.sparkSession.sparkContext.broadcast(([r._k for r in rows], [r._f for r in rows], _unit(np.stack([np.asarray(r._v, float) for r in rows]))))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, families, matrix = context.value
            for pdf in batches:
                sims, docs = _similar(ids, families, matrix, pdf), pdf["_k"].to_numpy()
                order = np.lexsort((np.broadcast_to(docs, sims.shape), -sims), axis=1)[:, :k]
                out = pd.DataFrame({"query": np.repeat(np.array(ids, object), order.shape[1]), "doc": docs[order].ravel(), "dense": np.take_along_axis(sims, order, axis=1).ravel()})
                yield out[out["dense"] > -np.inf]

        return held.mapInPandas(score, schema)

    return best(_in_blocks(asked, "_k", work), "dense", k)


def dense_ranks(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, candidates: DataFrame, family: str | None = None, query_family: str | None = None) -> DataFrame:
    """(``query``, ``doc``, ``dense``, ``rank``) of candidate pairs (``query``, ``doc``): their exact place among all documents that the query's family lets in.

    Each query takes its candidates along; every batch counts the documents before each of them, and the counts are added up.
    """
    asked, held = _vectors(queries, query_key, query_vector, query_family), _vectors(vectors, key, vector, family)
    scored = candidates.join(held.select(F.col("_k").alias("doc"), F.col("_v").alias("_x")), "doc").join(asked.select(F.col("_k").alias("query"), F.col("_v").alias("_y")), "query")
    scored = scored.select("query", "doc", F.round(cosine(F.col("_x"), F.col("_y")), 9).alias("dense"))
    listed = asked.join(scored.groupBy(F.col("query").alias("_k")).agg(F.collect_list(F.struct("dense", "doc")).alias("_c")), "_k")
    schema = f"query {dict(asked.dtypes)['_k']}, doc {dict(held.dtypes)['_k']}, dense double, ahead long"

    def work(rows: list) -> DataFrame:
        if not rows:
            return vectors.sparkSession.createDataFrame([], schema)
        wanted = [[(c.dense, c.doc) for c in r._c] for r in rows]
        context = vectors.sparkSession.sparkContext.broadcast(([r._k for r in rows], [r._f for r in rows], _unit(np.stack([np.asarray(r._v, float) for r in rows])), wanted))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, families, matrix, pairs = context.value
            ahead = [np.zeros(len(p), np.int64) for p in pairs]
            for pdf in batches:
                pdf = pdf.sort_values("_k", ignore_index=True)
                sims, docs = _similar(ids, families, matrix, pdf), pdf["_k"].to_numpy()
                for q, mine in enumerate(pairs):
                    order = np.argsort(-sims[q], kind="stable")
                    fall = -sims[q][order]
                    for n, (dense, doc) in enumerate(mine):
                        lo, hi = np.searchsorted(fall, -dense, "left"), np.searchsorted(fall, -dense, "right")
                        ahead[q][n] += lo + np.searchsorted(docs[order[lo:hi]], doc, "left")
            yield pd.DataFrame([(i, doc, dense, int(n)) for i, mine, places in zip(ids, pairs, ahead) for (dense, doc), n in zip(mine, places)], columns=["query", "doc", "dense", "ahead"])

        return held.mapInPandas(count, schema)

    return _in_blocks(listed, "_k", work).groupBy("query", "doc").agg(F.first("dense").alias("dense"), (F.sum("ahead") + 1).alias("rank"))


def exact_ranks(scores: DataFrame, score: str, candidates: DataFrame) -> DataFrame:
    """(``query``, ``doc``, ``rank``) of candidate pairs among all scored pairs of their query, by falling ``score`` and then ``doc``.

    A query's scored pairs are spread over salts; each salt counts the pairs before every candidate, and the counts are added up.
    """
    salts = 32
    here = scores.select("query", "doc", F.col(score).alias("_x"))
    wanted = candidates.select("query", "doc").join(here, ["query", "doc"])
    spread_out = here.withColumn("_s", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).withColumn("_n", F.lit(1))
    asked = wanted.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_n", F.lit(0))
    before = F.sum("_n").over(Window.partitionBy("query", "_s").orderBy(F.desc("_x"), "doc", "_n"))
    return spread_out.unionByName(asked).withColumn("_b", before).where("_n = 0").groupBy("query", "doc").agg((F.sum("_b") + 1).alias("rank"))


MAX_QUERIES = 4096


def hash_embedding(text: Column, dimension: int = HASH_DIMENSION) -> Column:
    """Unit-length term counts at hashed places (BLAKE2b, 8 bytes, big-endian); the zero vector for texts without terms."""

    @F.pandas_udf("array<double>")
    def embed(lists: pd.Series) -> pd.Series:
        place: dict[str, int] = {}

        def one(words) -> np.ndarray:
            v = np.zeros(dimension)
            for w in words:
                if w not in place:
                    place[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % dimension
                v[place[w]] += 1
            n = np.linalg.norm(v)
            return v / n if n else v

        return lists.map(one)

    return embed(tokens(text))


def hybrid(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, text: str, k: int = 10, family: str | None = None, query_family: str | None = None) -> DataFrame:
    """BM25 and hash-embedding ranks fused: (``query``, ``doc``, ``lexical``, ``lexical_score``, ``dense``, ``fusion``, ``rank``).

    ``lexical_score`` is the share of the query's best BM25 score among the documents let in. With
    families given, a document of another known family than the query's is in neither list.

    The result is that of fusing the whole lists. Of the k best of either list each has at least
    1 / (60 + k), and a document beyond place d in both has at most 2 / (61 + d), so with d = 2 (60 + k)
    only documents within d of a list can be among the k best; their places in both lists are counted exactly.
    """
    lexical = bm25(queries, docs, query_key, query_text, key, text).withColumn("lexical", F.round("lexical", 9))
    if family and query_family:
        of_doc, of_query = docs.select(F.col(key).alias("doc"), F.lower(F.col(family)).alias("_fd")), queries.select(F.col(query_key).alias("query"), F.lower(F.col(query_family)).alias("_fq"))
        lexical = lexical.join(of_query, "query").join(of_doc, "doc").where("_fq is null or _fd is null or _fd = _fq").drop("_fd", "_fq")
    else:
        family = query_family = None
    lexical = durable(lexical.where("lexical > 0"))
    deep = 2 * (RRF_K + k)
    kinds = [F.col(family).alias("_fam")] if family else []
    vectors = durable(docs.select(F.col(key).alias("_id"), hash_embedding(F.col(text)).alias("_vec"), *kinds))
    asked = durable(queries.select(F.col(query_key).alias("_id"), hash_embedding(F.col(query_text)).alias("_vec"), *([F.col(query_family).alias("_fam")] if family else [])).where(F.exists("_vec", lambda x: x != 0)))
    fam = "_fam" if family else None
    near = dense_best(vectors, "_id", "_vec", asked, deep, family=fam, query_family=fam)
    candidates = durable(best(lexical, "lexical", deep).select("query", "doc").unionByName(near.select("query", "doc")).distinct())
    by_text = exact_ranks(lexical, "lexical", candidates)
    by_vector = durable(dense_ranks(vectors, "_id", "_vec", asked, "_id", "_vec", candidates, fam, fam))
    top = lexical.groupBy("query").agg(F.max("lexical").alias("_top"))
    scored = reciprocal_ranks(by_text, by_vector).join(lexical, ["query", "doc"], "left").join(by_vector.select("query", "doc", "dense"), ["query", "doc"], "left").join(top, "query", "left")
    scored = scored.select("query", "doc", "lexical", F.coalesce(F.col("lexical") / F.col("_top"), F.lit(0.0)).alias("lexical_score"), "dense", F.round("fusion", 12).alias("fusion"))
    return best(scored, "fusion", k)


def index_checksum(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: number of documents and an order-free checksum of the index content (sum of row hashes, so no task holds all rows)."""
    row = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return docs.agg(F.count("*").alias("documents"), F.sha2(F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string"), 256).alias("checksum"))
