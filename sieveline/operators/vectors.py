"""Term weights over corpora and neighbours of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(df: DataFrame, record: str, tokens: Column) -> DataFrame:
    """(record, term, tf) of an array of tokens."""
    return df.select(F.col(record).alias("record"), F.explode(tokens).alias("term")).groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, min_df: int = 2, vocabulary: int | None = None) -> DataFrame:
    """(term, df, cf) of terms in at least ``min_df`` records; with ``vocabulary`` those of the highest corpus counts."""
    d = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    return d.orderBy(F.desc("cf"), "term").limit(vocabulary) if vocabulary else d


def tfidf(tf: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """(record, term, weight): sublinear counts, smooth inverse document frequency, unit length per record.

    ``n``: one row with the number of records (``n``).
    """
    w = tf.join(df, "term").join(F.broadcast(n), F.lit(True)).select("record", "term", ((1 + F.log(F.col("tf"))) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("record").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "record").select("record", "term", (F.col("w") / F.col("norm")).alias("weight"))


def nearest(pool: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block_rows: int = 4096, group: str | None = None) -> DataFrame:
    """(query, neighbour, similarity, rank): the ``k`` pool rows with the highest cosine for each query, exactly.

    The queries are dealt to blocks of bounded size, which are sent once to every pool partition as a bounded broadcast;
    each partition keeps the best ``k`` of its rows per query, and the best of these are merged. A row is no neighbour
    of itself; with ``group``, rows of the query's own group are left out too. Rows without a vector, or of length 0,
    take no part. Ties go to the smaller key.
    """
    spark = pool.sparkSession
    cols = [F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), (F.col(group) if group else F.lit("")).cast("string").alias("grp")]
    q = queries.select(*cols).where("v IS NOT NULL AND key IS NOT NULL")
    p = pool.select(*cols).where("v IS NOT NULL AND key IS NOT NULL")
    blocks = max(1, -(-q.count() // block_rows))
    out = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # about block_rows rows
        if not rows:
            continue
        ids, groups = np.array([r["key"] for r in rows]), np.array([r["grp"] or "" for r in rows])
        m = np.array([r["v"] for r in rows], float)
        norm = np.linalg.norm(m, axis=1)
        m, ids, groups = m[norm > 0] / norm[norm > 0, None], ids[norm > 0], groups[norm > 0]
        shared = spark.sparkContext.broadcast((ids, groups, m))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, groups, m = shared.value
            for pdf in batches:
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                n = np.linalg.norm(x, axis=1)
                keep = n > 0
                if not keep.any() or not len(ids):
                    continue
                own, grp = pdf["key"].to_numpy()[keep], pdf["grp"].fillna("").to_numpy()[keep]
                s = m @ (x[keep] / n[keep, None]).T
                s[ids[:, None] == own[None, :]] = -9
                if group:
                    s[groups[:, None] == grp[None, :]] = -9
                top = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                at = np.repeat(np.arange(len(ids)), top.shape[1])
                sim = s[at, top.ravel()]
                good = sim > -9
                yield pd.DataFrame({"query": ids[at][good], "neighbour": own[top.ravel()][good], "similarity": sim[good]})

        part = p.mapInPandas(best, "query long, neighbour long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query long, neighbour long, similarity double, rank int")
    order = F.struct((-F.round("similarity", 9)).alias("s"), "neighbour")
    top = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return top.select("query", F.posexplode("best").alias("pos", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank"))


def neighbour_vote(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query, label, weight): the label with the largest summed similarity among a query's neighbours."""
    w = near.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("label")), "neighbour").where("label IS NOT NULL").groupBy("query", "label").agg(F.sum("similarity").alias("weight"))
    return w.groupBy("query").agg(F.max_by("label", F.struct("weight", -F.col("label"))).alias("label"), F.round(F.max("weight"), 4).alias("weight"))
