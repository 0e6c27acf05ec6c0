"""Full-text, vector and hybrid search, and context for questions. Queries come as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import hashed_vectors
from kgspark.operators.bm25 import scored_rows
from kgspark.sources.scratch import write_out
from kgspark.operators.rankings import top_per_group
from kgspark.operators.traversal import neighborhood
from kgspark.sources.graph import Graph

#: Vectors in a block, and queries multiplied with it at once.
BLOCK, AT_ONCE = 4000, 256
ENTITY_FLOOR, PROJECT_FLOOR = 0.7, 0.5


def terms(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def fulltext_search(rows: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 20, prefix: bool = False) -> DataFrame:
    """(query_id, id, score, rank): BM25 of the queries' terms (query_id, query); with ``prefix`` a term of three letters or more matches the words that begin
    with it, and a shorter one none."""
    words = rows.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("q")).distinct()
    scores = scored_rows(words, wanted, k, prefix).select("query_id", "id", F.round("score", 6).alias("score"))
    return top_per_group(scores, "query_id", "score", k, ("id",))


def _unit(column: str):
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def similar_by_embedding(vectors: DataFrame, queries: DataFrame, k: int = 10, floor: float = ENTITY_FLOOR, id_col: str = "vec_id", vector_col: str = "embedding", itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of each query (query_id, vector) with all vectors, the one of its id left out unless ``itself``.

    Queries and vectors are numbered into blocks. A pair of blocks is one group: it is multiplied as two
    matrices and returns each query's ``k`` best of the block, so rows follow queries times blocks, not pairs.
    """
    v = vectors.select(F.col(id_col).alias("id"), _unit(vector_col).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    q = queries.select("query_id", _unit("vector").alias("v")).filter("v IS NOT NULL AND query_id IS NOT NULL")
    v, q = write_out(v, "vectors"), write_out(q, "queries")
    n_v, n_q = (max(1, -(-rows.count() // BLOCK)) for rows in (v, q))
    number, width = F.monotonically_increasing_id(), F.size("v").alias("w")
    v, q = v.withColumn("j", (number % n_v).cast("int")), q.withColumn("i", (number % n_q).cast("int"))  # before the copies
    # a block of one side goes to every block of the other
    left = q.select(width, "i", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("j"), "query_id", F.lit(None).cast(v.schema["id"].dataType).alias("id"), "v")
    right = v.select(width, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), "j", F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "id", "v")

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        asked = rows.filter(rows["query_id"].is_valid()).combine_chunks()
        known = rows.filter(rows["id"].is_valid()).combine_chunks()
        a, b = (_matrix(side.column("v"), key[0].as_py()) for side in (asked, known))
        names, kept = known.column("id").to_numpy(), [np.empty((3, 0))]
        order = np.unique(names, return_inverse=True)[1] if len(names) else np.empty(0, np.int64)
        for at in range(0, len(a) if len(b) else 0, AT_ONCE):
            score = a[at : at + AT_ONCE] @ b.T
            score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score) + 0.0
            rank = np.where(np.isnan(score), np.inf, score)  # NaN is above all numbers, as in Spark
            own = asked.column("query_id").slice(at, AT_ONCE).to_numpy()[:, None] == names[None, :]
            rank[(own & (not itself)) | (rank < floor)] = -np.inf
            if k < rank.shape[1]:
                rank[rank < np.partition(rank, -k, axis=1)[:, [-k]]] = -np.inf
            x, y = np.nonzero(rank > -np.inf)
            by = np.lexsort((order[y], -rank[x, y], x))
            x, y = x[by], y[by]
            first = np.arange(len(x)) - np.searchsorted(x, x) < k
            x, y = x[first], y[first]
            kept.append(np.stack([x + at, y, score[x, y]]))
        x, y, score = np.concatenate(kept, axis=1)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(x.astype(np.int64))), "id": known.column("id").take(pa.array(y.astype(np.int64))), "score": score})

    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    found = left.unionByName(right).groupBy("w", "i", "j").applyInArrow(best, kinds)
    return top_per_group(found, "query_id", "score", k, ("id",))


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as the rows of a matrix."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in rows.chunks]
    return np.concatenate([np.empty(0), *parts]).reshape(-1, width)


def semantic_search(rows: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 20, floor: float = 0.0, dim: int = 64, encoder=hashed_vectors) -> DataFrame:
    """(query_id, id, score, rank): the rows whose texts are nearest by cosine to each query's text (query_id, query).

    Rows and queries are encoded together, so that words weigh alike; ``encoder(texts (doc_id, text), dim)`` gives (doc_id, embedding). Texts without
    words have no vector and are not found. Ids are whole numbers.
    """
    texts = rows.select(F.struct(F.lit(False).alias("asked"), F.col(id_col).cast("long").alias("id")).alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.select(F.struct(F.lit(True).alias("asked"), F.col("query_id").cast("long").alias("id")).alias("doc_id"), F.col("query").alias("text"))
    vectors = write_out(encoder(texts.unionByName(asked), dim), "encoded")
    known = vectors.filter("NOT doc_id.asked").select(F.col("doc_id.id").alias("id"), "embedding")
    wanted = vectors.filter("doc_id.asked").select(F.col("doc_id.id").alias("query_id"), F.col("embedding").alias("vector"))
    return similar_by_embedding(known, wanted, k, floor, "id", itself=True)  # ids of queries and of rows have nothing in common


def hybrid_merge(fulltext: DataFrame, semantic: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, source, rank): hits of both, those of the text search first; found twice is marked both."""
    f = fulltext.select("query_id", "id", F.col("rank").alias("fr"))
    s = semantic.select("query_id", "id", F.col("rank").alias("sr"))
    merged = f.join(s, ["query_id", "id"], "full_outer")
    source = F.when(F.col("fr").isNotNull() & F.col("sr").isNotNull(), "both").when(F.col("fr").isNotNull(), "fulltext").otherwise("semantic")
    order = F.when(F.col("fr").isNotNull(), -F.col("fr")).otherwise(-1_000_000 - F.col("sr"))
    return top_per_group(merged.select("query_id", "id", source.alias("source"), order.alias("_o")), "query_id", "_o", k, ("id",)).drop("_o")


def recall(g: Graph, questions: DataFrame, depth: int = 1, seeds: int = 5, limit: int = 10) -> DataFrame:
    """(query_id, kind, id): context of each question: seed entities, their neighbours, relations among them, chains and projects touched."""
    named = g.entities.select("entity_id", F.concat_ws(" ", "name", "definition", F.array_join("aliases", " ")).alias("text"))
    found = fulltext_search(named, questions, "entity_id", "text", seeds).select("query_id", F.col("id").alias("entity_id"))
    near = neighborhood(g.relations, found.select("entity_id").distinct(), depth, limit)
    reached = found.join(near.withColumnRenamed("entity_id", "other"), found["entity_id"] == near["seed"]).select("query_id", F.col("other").alias("entity_id")).distinct()
    ends = reached.select("query_id", F.col("entity_id").alias("src")), reached.select("query_id", F.col("entity_id").alias("dst"))
    inside = g.relations.join(ends[0], "src").join(ends[1], ["query_id", "dst"]).select("query_id", F.lit("relation").alias("kind"), F.col("rel_id").alias("id"))
    links = g.chain_links.select("chain_id", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    chains = links.join(reached, "entity_id").select("query_id", F.lit("chain").alias("kind"), F.col("chain_id").alias("id")).distinct()
    projects = g.mentions.join(found, "entity_id").select("query_id", F.lit("project").alias("kind"), F.col("project_id").alias("id")).distinct()
    limits = {"relation": 50, "chain": 10, "project": 5}
    out = reached.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"))
    for rows, kind in ((inside, "relation"), (chains, "chain"), (projects, "project")):
        out = out.unionByName(top_per_group(rows.withColumn("_o", F.lit(0)), "query_id", "_o", limits[kind], ("id",)).drop("_o", "rank"))
    return out


def recall_summary(g: Graph, questions: DataFrame, context: DataFrame, depth: int = 1, seeds: int = 5) -> DataFrame:
    """(query_id, entities, summary): what ``recall`` found for each question in words, seeds by rank; questions without a seed have no row."""
    named = g.entities.select("entity_id", F.concat_ws(" ", "name", "definition", F.array_join("aliases", " ")).alias("text"))
    found = fulltext_search(named, questions, "entity_id", "text", seeds).join(g.entities.select(F.col("entity_id").alias("id"), "name"), "id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]), ", ")
    starts = found.groupBy("query_id").agg(names.alias("_names"))
    counts = context.filter("kind = 'entity'").groupBy("query_id").agg(F.countDistinct("id").alias("entities"))
    words = F.concat(F.lit("Found "), F.col("entities").cast("string"), F.lit(f" entities across {depth} hops from "), F.col("_names"))
    return starts.join(counts, "query_id").select("query_id", "entities", words.alias("summary"))


def similar_or_nearest(similar: DataFrame, keys: DataFrame, vectors: DataFrame, k: int, floor: float = ENTITY_FLOOR) -> DataFrame:
    """(a, b, similarity, rank, source): each key's k best stored pairs (a, b, similarity, in either direction); keys without any ask with their vector
    (entity_id, embedding) among all vectors. Keys with neither have no row."""
    both = similar.select("a", "b", "similarity").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    wanted = keys.select(F.col("entity_id").alias("a")).distinct()
    best = both.join(wanted, "a", "left_semi").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    stored = top_per_group(best, "a", "similarity", k, ("b",)).withColumn("source", F.lit("stored"))
    asks = vectors.join(wanted.join(stored.select("a"), "a", "left_anti").withColumnRenamed("a", "entity_id"), "entity_id", "left_semi")
    near = similar_by_embedding(vectors, asks.select(F.col("entity_id").alias("query_id"), F.col("embedding").alias("vector")), k, floor, "entity_id")
    near = near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"), "rank", F.lit("vector").alias("source"))
    return stored.select("a", "b", "similarity", "rank", "source").unionByName(near)
