"""Document fingerprints: homomorphic multiset hashes, with DataFrame functions only.

A document is a multiset of parts. Each part is hashed to a vector; the fingerprint is the sum of the
vectors, lane by lane, modulo a power of two. Sums do not depend on order, and parts can be added or
taken away later by adding or subtracting their vectors.

The lanes come in two kinds. ``PARAGRAPH_LANES`` lanes of 28 bits sum hashes of whole paragraphs
(lines): two texts agree there when they hold the same paragraphs, in any order. ``CLAUSE_LANES``
lanes sum hashes of clauses that are only +1 or -1, times a weight that grows with the root of the
clause's length. Inner products of those sums estimate the inner products of the multisets, so the
likeness 2 xy / (xx + yy) of two fingerprints estimates how much text they share.

Defined cases: a null text is empty, and two texts without clauses are alike (1) if their paragraphs
agree, else 0. Every row has its result. Different texts of one id follow one another in order of their
MD5; equal rows count as one document, and each has its result; null ids come first. The only document
follows itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import table
from kgspark.sources.scratch import write_out

PARAGRAPH_LANES, PARAGRAPH_BITS = 8, 28
#: Two 30-bit halves of a hash; a packed sum holds a lane of each half, 32 bits apart.
HALF = 30
CLAUSE_LANES = 2 * HALF
CLAUSE_END = r"[.!?,;:|\n]+"


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id): the following id in ascending order, after the last one the first.

    Ids are dealt to ranges; only the last id of a range looks at the first one of the next range, in a
    table of one row per range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("id")).distinct().repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id())
    ids = write_out(ids, "ids")
    firsts = ids.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("p"), "id")).alias("first"))
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.first("first").over(everything)).alias("after")
    )
    last = F.lead(F.lit(True)).over(Window.partitionBy("range").orderBy("id")).isNull()
    following = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    return (
        ids.withColumn("_last", last)
        .withColumn("_next", following)
        .join(F.broadcast(firsts), "range")  # one row per shuffle partition
        .select("id", F.when(F.col("_last"), F.col("after.id")).otherwise(F.col("_next")).alias("next_id"))
    )


def _number(digest: str, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def parts(text: Column) -> Column:
    """Array of (kind, value): 0 once for the document, 1 for each paragraph, 2 for each clause; blank ones are left out."""

    def kind(k: int, values: Column) -> Column:
        return F.transform(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))

    return F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("value"))), kind(1, F.split(text, "\n")), kind(2, F.split(text, CLAUSE_END)))


def sum_vectors(parts_df: DataFrame, *keys: str) -> DataFrame:
    """(keys…, kind, value) -> keys…, paragraphs array<long>, clauses array<long>: the lanes of each document."""
    vectors = parts_df.withColumn("digest", F.when(F.col("kind") > 0, F.sha2(F.col("value").cast("binary"), 256)))
    vectors = vectors.select(
        *keys,
        *[F.when(F.col("kind") == 1, _number("digest", 1 + 7 * i, 7)).alias(f"p{i}") for i in range(PARAGRAPH_LANES)],
        F.when(F.col("kind") == 2, _number("digest", 1, 15)).alias("h"),
        F.floor(F.sqrt(F.length("value"))).alias("w"),
    )
    one = 1 | 1 << 32
    low = F.col("h").bitwiseAND(F.lit((1 << HALF) - 1))
    packed = low.bitwiseOR(F.shiftleft(F.shiftright("h", HALF), 32))
    vectors = vectors.select(*keys, *[f"p{i}" for i in range(PARAGRAPH_LANES)], F.when(F.col("h").isNotNull(), F.col("w")).alias("w"), packed.alias("packed"))
    sums = vectors.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"p{i}") for i in range(PARAGRAPH_LANES)],
        F.coalesce(F.sum("w"), F.lit(0)).alias("w"),
        *[F.coalesce(F.sum(F.shiftright("packed", i).bitwiseAND(F.lit(one)) * F.col("w")), F.lit(0)).alias(f"c{i}") for i in range(HALF)],
    )
    lanes = [F.col(f"p{i}") % F.lit(1 << PARAGRAPH_BITS) for i in range(PARAGRAPH_LANES)]
    # a lane holds the weights of the +1 clauses; twice that less all weights is the signed sum
    signed = [2 * F.col(f"c{i}").bitwiseAND(F.lit((1 << 32) - 1)) - F.col("w") for i in range(HALF)]
    signed += [2 * F.shiftright(f"c{i}", 32) - F.col("w") for i in range(HALF)]
    return sums.select(*keys, F.array(*lanes).alias("paragraphs"), F.array(*signed).alias("clauses"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)


def likeness(px: Column, cx: Column, py: Column, cy: Column) -> Column:
    """0 to 1 from the lanes of two fingerprints."""
    mass = _dot(cx, cx) + _dot(cy, cy)
    near = F.when(mass > 0, 2 * _dot(cx, cy) / mass).otherwise((px == py).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), near))


def written(paragraphs: Column, clauses: Column) -> Column:
    """Lanes as text: paragraph lanes in hexadecimal, clause lanes as signed numbers."""
    return F.concat_ws(":", F.array_join(F.transform(paragraphs, lambda v: F.lower(F.hex(v))), "."), F.array_join(F.transform(clauses, lambda v: v.cast("string")), "."))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraphs, clauses) of every row."""
    exploded = docs.select(id_col, F.explode(parts(F.coalesce(text_col, F.lit("")))).alias("part")).select(id_col, "part.*")
    return sum_vectors(exploded, id_col)


def own_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with null texts empty, and, where ids repeat, how many rows each one stands for.

    Where ids repeat, ``id`` is a struct of the id and the text's MD5, ordered like it, and the second table holds (id, copies).
    """
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("c")).filter("c > 1").limit(1).count()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if not repeated:
        return rows, None
    digest = F.md5(F.col("text").cast("binary"))
    counted = write_out(rows.groupBy("id", digest.alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies")), "rows")
    key = F.struct("id", "digest").alias("id")
    return counted.select(key, "text"), counted.select(key, "copies")


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    docs, copies = own_rows(table(spark, sf_dir, "documents"))
    # each document is the next one of exactly one other
    lengths = docs.select(F.col("id").alias("prev_id"), F.length("text").alias("n"))
    following = next_ids(docs, "id").select(F.col("id").alias("of"), "next_id")
    asked = lengths.join(following, F.col("prev_id").eqNullSafe(F.col("of"))).select("next_id", "prev_id", F.floor(F.col("n") / 4).cast("int").alias("k"))
    asked = write_out(asked, "asked")
    heads = docs.join(asked, F.col("id").eqNullSafe(F.col("next_id"))).select(F.col("prev_id").alias("head_of"), "k", F.expr("substring(text, 1, k)").alias("head"))
    before = asked.select(F.col("next_id").alias("me"), "prev_id")
    edited = docs.join(heads, F.col("id").eqNullSafe(F.col("head_of"))).join(before, F.col("id").eqNullSafe(F.col("me")))
    edited = edited.select("id", "prev_id", F.length("text").alias("n"), "text", F.expr("concat(substring(text, 1, length(text) - k), head)").alias("edited"))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    texts = edited.select("id", "prev_id", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(both).alias("t"))
    exploded = texts.select("id", "prev_id", "n", "sha", F.col("t.which").alias("which"), F.explode(parts(F.col("t.text"))).alias("part"))
    prints = sum_vectors(exploded.select("id", "prev_id", "n", "sha", "which", "part.*"), "id", "prev_id", "n", "sha", "which")
    # a print goes to its own document and, unless edited, to the document before it
    roles = F.when(F.col("which") == 1, F.array(F.struct(F.col("id").alias("to"), F.lit(1).alias("role")))).otherwise(
        F.array(F.struct(F.col("id").alias("to"), F.lit(0).alias("role")), F.struct(F.col("prev_id").alias("to"), F.lit(2).alias("role")))
    )
    sent = prints.select("n", "sha", "paragraphs", "clauses", F.explode(roles).alias("r")).select(F.col("r.to").alias("doc_id"), F.col("r.role").alias("role"), F.struct("n", "sha", "paragraphs", "clauses").alias("v"))
    met = sent.groupBy("doc_id").agg(*[F.first(F.when(F.col("role") == k, F.col("v")), ignorenulls=True).alias(name) for k, name in enumerate(("own", "changed", "after"))])
    if copies is not None:
        met = met.join(copies.withColumnRenamed("id", "of"), F.col("doc_id") == F.col("of"))
        met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("doc_id", F.col("doc_id.id"))
    p, c = F.col("own.paragraphs"), F.col("own.clauses")
    return met.select(
        "doc_id",
        F.col("own.n").cast("long").alias("n_chars"),
        F.col("own.sha").alias("edited_sha256"),
        written(p, c).alias("fingerprint"),
        written(F.col("changed.paragraphs"), F.col("changed.clauses")).alias("edited_fingerprint"),
        likeness(p, c, F.col("changed.paragraphs"), F.col("changed.clauses")).alias("near_edited"),
        likeness(p, c, F.col("after.paragraphs"), F.col("after.clauses")).alias("near_next"),
    )


def _sql_written(p: str, c: str) -> str:
    return f"array_to_string(list_transform({p}, lambda v: lower(to_hex(v))), '.') || ':' || array_to_string({c}, '.')"


def _sql_near(p: str, c: str, q: str, d: str) -> str:
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))::BIGINT"
    mass = f"({dot.format(c, c)} + {dot.format(d, d)})"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {mass} > 0 THEN (2 * {dot.format(c, d)})::DOUBLE / {mass} ELSE ({p} = {q})::INT::DOUBLE END))"


_HEX = "('0x' || substr(sha256(v), {at}, {n}))::BIGINT"
SQL = f"""
WITH r AS (SELECT doc_id AS id, coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY ALL),
o AS (SELECT id, text, copies, row_number() OVER (ORDER BY id NULLS FIRST, md5(text)) AS doc_id FROM r),
f AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id)) AS after,
  coalesce(lead(doc_id) OVER w, 1) AS next_id FROM o WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, next_id, 0 AS which, text FROM f UNION ALL
  SELECT doc_id, next_id, 1, substr(text, 1, (length(text) - length(text) // 4)::BIGINT) || substr(after, 1, (length(text) // 4)::BIGINT) FROM f),
u AS (SELECT doc_id, which, 1 AS kind, trim(unnest(string_split(text, chr(10))), ' ') AS v FROM e UNION ALL
  SELECT doc_id, which, 2, trim(unnest(string_split_regex(text, '{CLAUSE_END}')), ' ') FROM e),
h AS (SELECT doc_id, which, kind, floor(sqrt(length(v)))::BIGINT AS w, {_HEX.format(at=1, n=15)} AS h,
  [{', '.join(_HEX.format(at=1 + 7 * i, n=7) for i in range(PARAGRAPH_LANES))}] AS p FROM u WHERE v <> ''),
s AS (SELECT e.doc_id, e.which, any_value(e.next_id) AS next_id, any_value(e.text) AS text,
  [{', '.join(f'(coalesce(sum(p[{i + 1}]) FILTER (kind = 1), 0) % {1 << PARAGRAPH_BITS})::BIGINT' for i in range(PARAGRAPH_LANES))}] AS p,
  [{', '.join(f'coalesce(sum(w * (2 * ((h >> {i}) & 1) - 1)) FILTER (kind = 2), 0)::BIGINT' for i in range(CLAUSE_LANES))}] AS c
  FROM e LEFT JOIN h ON e.doc_id = h.doc_id AND e.which = h.which GROUP BY e.doc_id, e.which)
SELECT o.id AS doc_id, length(m.text)::BIGINT AS n_chars, sha256(x.text) AS edited_sha256,
  {_sql_written('m.p', 'm.c')} AS fingerprint, {_sql_written('x.p', 'x.c')} AS edited_fingerprint,
  {_sql_near('m.p', 'm.c', 'x.p', 'x.c')} AS near_edited, {_sql_near('m.p', 'm.c', 'n.p', 'n.c')} AS near_next
FROM s m JOIN s x ON m.doc_id = x.doc_id AND m.which = 0 AND x.which = 1
  JOIN s n ON m.next_id = n.doc_id AND n.which = 0
  JOIN (SELECT id, doc_id, unnest(range(copies)) FROM o) o ON o.doc_id = m.doc_id
"""
