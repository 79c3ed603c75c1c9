"""Lexical, vector and hybrid retrieval, many queries at once.

Postings are one explode of the tokens; a query's terms meet them in a join on the
term, so only documents that share a term are scored. Top-k is a window that
Catalyst turns into a group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.text import tokenize
from ..functions.vectors import hybrid_score

K1, B = 1.2, 0.75
MARK, MARKS = "\x00", 256  # no token begins so


def top_k(rows: DataFrame, k: int, by: str, score: str, tie: str) -> DataFrame:
    """The best k rows of each group, ranked; ties by the smaller key."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, text): one explode and one shuffle."""
    return docs.select("id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: doc_count, avg_length; terms: term, df)."""
    sizes = docs.agg(F.count("*").alias("doc_count"), F.avg(F.coalesce(F.size(tokenize(F.col("text"))), F.lit(0))).alias("avg_length"))
    return sizes, postings(docs).groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, bm25) of queries (qid, text) against docs (id, text) that share a term; repeated query terms count each.

    One pass over the documents: a token goes on only if a query asks for its term,
    and a mark, one of a few hundred so that none is hot, stands for the document
    itself. Lengths, document frequencies and scores are small aggregates of what is left.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.select("term").union(docs.sparkSession.range(MARKS).select(F.concat(F.lit(MARK), F.col("id")))).distinct()
    tokens = docs.select("id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    spread = tokens.select("id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.concat(F.lit(MARK), F.pmod(F.xxhash64("id"), F.lit(MARKS)))), "tokens")).alias("term"))
    hits = checkpointed(spread.join(wanted, "term", "left_semi").groupBy("term", "id", "length").agg(F.count("*").alias("tf")))
    mark = F.col("term").startswith(MARK)
    sizes = hits.filter(mark).agg(F.count("*").alias("doc_count"), F.avg("length").alias("avg_length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each asked term, so that a frequent one is only counted
    weighed = hits.filter(~mark).join(df, "term").crossJoin(sizes)  # one row of totals
    idf = F.log((F.col("doc_count") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") / F.col("avg_length"))))
    scored = weighed.select("id", "term", (idf * part).alias("w"))
    return asked.join(scored, "term").groupBy("qid", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("bm25"))


def _unit(column: pd.Series) -> np.ndarray:
    """Vectors over their norms, in double precision; a zero vector stays zero."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _low(score: np.ndarray, k: int) -> np.ndarray:
    """A number for each row that its k-th largest reaches: the k-th of the largest of runs of columns."""
    width = max(1, score.shape[1] // (16 * k))
    runs = score.shape[1] // width
    most = score[:, : runs * width].reshape(len(score), runs, width).max(axis=2)
    return np.partition(most, runs - k, axis=1)[:, runs - k]


def _block_scores(k: int | None, least: float | None, exclude_self: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"qid": asked["qid"][:0], "id": rows["id"][:0], "vec": np.zeros(0)})
        rows = rows.sort_values("id", kind="stable")
        q, x, qids, ids = _unit(asked["vec"]), _unit(rows["vec"]), asked["qid"].to_numpy(), rows["id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(q), 256):
            score = q[lo : lo + 256] @ x.T
            far = qids[lo : lo + 256, None] == ids[None, :] if exclude_self else np.zeros((1, 1), bool)
            if k is None or k >= len(ids):
                score = np.round(score, 14)
                i, j = np.nonzero(~far & (np.ones(score.shape, bool) if least is None else score >= least))
                out.append((qids[lo + i], ids[j], score[i, j]))
                continue
            score[np.isnan(score) | far] = -np.inf
            i, j = np.nonzero(score >= np.maximum(_low(score, k), -np.inf if least is None else least)[:, None] - 1e-12)
            near = np.round(score[i, j], 14)  # equal vectors tie, whatever their place in the product
            good = near > -np.inf if least is None else near >= least
            i, j, near = i[good], j[good], near[good]
            order = np.lexsort((j, -near, i))  # ties by the smaller id
            i, j, near = i[order], j[order], near[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((qids[lo + i[best]], ids[j[best]], near[best]))
        qid, id_, vec = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"qid": qid, "id": id_, "vec": vec})

    return run


def vector_scores(queries: DataFrame, chunks: DataFrame, k: int | None = None, least: float | None = None, exclude_self: bool = False, by: str | None = None, per_block: int = 16_384) -> DataFrame:
    """(qid, id, vec) cosine of queries (qid, vec) with chunks (id, vec): pairs of at least ``least``, or each block's best ``k`` of a query.

    Blocks of queries meet blocks of chunks of the same length (and the same
    ``by``), a matrix product each. Null vectors meet nothing; a zero vector has
    cosine 0 with all.
    """
    keys = [F.size("vec").alias("size"), *([F.col(by).alias("by")] if by else [])]
    names = ["size", *(["by"] if by else []), "x", "y"]
    asked, rows = queries.filter(F.col("vec").isNotNull()), chunks.filter(F.col("vec").isNotNull())
    if k is None and least is None:
        raise ValueError("every pair is asked for: give k or least")
    blocks = [max(1, -(-df.count() // per_block)) for df in (asked, rows)]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda *c: [F.col(x).alias(x) for x in c]  # noqa: E731, columns of their own, as both sides may come from one table
    left = asked.select(*own("qid", "vec"), *keys, block("qid", blocks[0]).alias("x"), each(blocks[1]).alias("y"))
    right = rows.select(*own("id", "vec"), *keys, each(blocks[0]).alias("x"), block("id", blocks[1]).alias("y"))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {chunks.schema['id'].dataType.simpleString()}, vec double"
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(_block_scores(k, least, exclude_self), kinds)


def knn(queries: DataFrame, chunks: DataFrame, k: int = 10, least: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, vec): the nearest chunks by cosine, exactly."""
    return top_k(vector_scores(queries, chunks, k, least, exclude_self), k, "qid", "vec", "id")


def similar_of_type(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rank, id, vec): nearest chunks of the query's own type; chunks: id, type, vec."""
    asked = chunks.join(queries.select(F.col("qid").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("qid"), "type", "vec")
    typed = chunks.filter(F.col("type").isNotNull())
    return top_k(vector_scores(asked.filter(F.col("type").isNotNull()), typed, k, exclude_self=True, by="type"), k, "qid", "vec", "id")


def hybrid(candidates: DataFrame, queries: DataFrame, texts: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(qid, id, vec, bm25, score) of candidates (qid, id, vec): BM25 over each query's candidates, over its largest or 1.

    Of a candidate's tokens only those go on that its query asks for.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    wanted = candidates.select("qid", "id").join(asked.groupBy("qid").agg(F.collect_list("term").alias("wanted")), "qid", "left")
    pairs = wanted.join(texts, "id").select("qid", "id", "wanted", tokenize(F.col("text")).alias("tokens"))
    own = F.filter("tokens", lambda t: F.array_contains("wanted", t))
    w = Window.partitionBy("qid")
    sized = pairs.select("qid", "id", F.size("tokens").alias("length"), own.alias("tokens")).withColumn("n", F.count("*").over(w)).withColumn("avg", F.avg("length").over(w))
    terms = sized.select("qid", "id", "n", "avg", "length", F.explode("tokens").alias("term")).groupBy("qid", "id", "n", "avg", "length", "term").agg(F.count("*").alias("tf"))
    terms = terms.withColumn("df", F.count("*").over(Window.partitionBy("qid", "term")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") / F.col("avg"))))
    scored = terms.join(asked, ["qid", "term"]).groupBy("qid", "id").agg(F.sum(F.col("qtf") * idf * part).alias("raw"))
    out = candidates.join(scored, ["qid", "id"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    out = out.withColumn("bm25", F.col("raw") / F.greatest(F.max("raw").over(w), F.lit(1.0)))
    return out.select("qid", "id", "vec", "bm25", hybrid_score(F.col("vec"), F.col("bm25"), alpha).alias("score"))


def graph_boost(hits: DataFrame, dependents: DataFrame, dependencies: DataFrame, siblings: DataFrame) -> DataFrame:
    """hits (id, path, symbol, score) with boost for paths (path) and symbols (symbol) near the context, capped at 1."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = hits.join(flag(dependents, "path", "d1"), "path", "left").join(flag(dependencies, "path", "d2"), "path", "left").join(flag(siblings, "symbol", "d3"), "symbol", "left")
    boost = F.when(F.col("d1"), 0.1).otherwise(0.0) + F.when(F.col("d2"), 0.15).otherwise(0.0) + F.when(F.col("d3") & (F.col("symbol") != ""), 0.2).otherwise(0.0)
    return rows.withColumn("boost", boost).withColumn("score", F.least(F.lit(1.0), F.col("score") + F.col("boost"))).drop("d1", "d2", "d3")
