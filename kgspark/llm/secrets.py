"""Secret scans, with DataFrame functions only.

Base rules find assignments, access keys and long hex runs. The method adds what two character Markov
models tell apart: one of random strings, one of ordinary identifiers. Both hold the chance of a character
given the one before it (the first one: given the start), counted over every token of ``LEAST`` or more
characters in the corpus; a token's label is whether a base rule covers it. All occurrences of a token are
left out of the counts that judge it. A token with a letter (others are numbers) that no base span touches is reported when its log-likelihood
ratio reaches ``odds`` in all and ``PER_CHARACTER`` for each character.

Positions come from one split by the rule's expression: the gaps before the matches and the matches'
own lengths, summed along the document. Spans are in code points, end exclusive.

Defined cases: a null text is empty and has no spans; equal rows of one id are scanned once and each
gets the result; a null id is an id like others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import table
from kgspark.sources.scratch import write_out

#: Least length of a token that the models judge.
LEAST = 12
KEYS = "|".join("".join(f"[{c}{c.upper()}]" for c in word) for word in ("password", "passwd", "secret", "token", "api")) + "_?[kK][eE][yY]"
VALUE = r"[A-Za-z0-9+/_.=-]+"
#: kind -> (expression, least length of its value); the order is that of ties.
RULES = {
    "assign": (rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?({VALUE})", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
    "markov": (rf"[A-Za-z0-9+/_=-]{{{LEAST},}}", LEAST),
}
KINDS = list(RULES)
#: Characters of a token and what stands for its start, and the share of a uniform draw in each model: random
#: strings keep half, so that characters never seen together stay likely; ordinary names keep little.
ALPHABET, START = 66, "^"
RANDOM_UNIFORM, ORDINARY_UNIFORM = 0.5, 0.02
#: Least log-likelihood ratio, in nats, of a reported token, and of each of its characters on the mean.
ODDS, PER_CHARACTER = 10.0, 0.7


def _matches(kind: str) -> Column:
    """Array of (kind, pos, gap, len, value_len, value) of one rule; the last gap has no match and is dropped."""
    rule, least = RULES[kind]
    text = F.col("text")
    rx = F.lit(rule)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    gaps = F.transform(F.split(text, rule, -1), lambda g: F.length(g))
    if kind == "assign":
        values = F.regexp_extract_all(text, rx, F.lit(2))
    else:
        values = found
    both = F.transform(
        F.arrays_zip(found.alias("m"), values.alias("v"), gaps.alias("g")),
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("pos"),
            z["g"].alias("gap"),
            F.length(z["m"]).alias("len"),
            (F.length(z["v"]) >= least).alias("good"),
            (F.when(F.lit(kind == "markov"), z["m"])).alias("token"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,good:boolean,token:string>>")
    return F.when(text.rlike(rule), F.filter(both, lambda z: z["len"].isNotNull())).otherwise(none)


def find_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, kind, start, end, token, touched): base spans and long tokens; touched: a base span overlaps."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    each = (
        rows.select("id", F.xxhash64("text").alias("h"), F.explode(F.concat(*[_matches(k) for k in KINDS])).alias("m"))
        .select("id", "h", "m.*")
        .repartition("id", "h")
        .distinct()
    )
    along = Window.partitionBy("id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along))
        .filter("good")
        .select("id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "token")
    )
    is_base = F.col("kind") < KINDS.index("markov")
    order = Window.partitionBy("id", "h").orderBy("start", "kind")
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # base spans of equal start come first in this order
    touched = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return placed.withColumn("touched", touched)


def transitions(tokens: DataFrame) -> DataFrame:
    """A row with ``g``, two characters in a row, for every place of every token; the first ones follow ``START``.

    Letters of a token in capitals throughout are read as small ones: case tells something only where it changes.
    """
    read = F.when(F.col("token").rlike("[a-z]"), F.col("token")).otherwise(F.lower("token"))
    pairs = F.zip_with(F.split(F.concat(F.lit(START), read), ""), F.split(read, ""), lambda a, b: F.concat(a, b))
    return tokens.withColumn("g", F.explode(pairs)).filter("g IS NOT NULL")


def train_models(tokens: DataFrame) -> DataFrame:
    """(token, secret, n) -> (g, p_random, n_ordinary, all_ordinary) of each transition; at most (ALPHABET + 1) * ALPHABET rows.

    p_random is the chance in random strings; n_ordinary counts the transition in ordinary tokens, all_ordinary all those from its first character.
    """
    counts = (
        transitions(tokens)
        .groupBy("g")
        .agg(F.sum(F.when(F.col("secret"), F.col("n")).otherwise(0)).alias("n_random"), F.sum(F.when(F.col("secret"), 0).otherwise(F.col("n"))).alias("n_ordinary"))
    )
    same = Window.partitionBy(F.substring("g", 1, 1))
    seen = (F.col("n_random") + F.lit(1.0 / ALPHABET)) / (F.sum("n_random").over(same) + 1)
    return counts.select(
        "g", (F.lit(1 - RANDOM_UNIFORM) * seen + F.lit(RANDOM_UNIFORM / ALPHABET)).alias("p_random"), "n_ordinary", F.sum("n_ordinary").over(same).alias("all_ordinary")
    )


def log_ratio() -> Column:
    """What a transition that an unlabelled token has m times, of those ``before`` from its first character, adds each time: its chance in random strings against that in the other ordinary tokens."""
    own, all_own = F.col("n") * F.col("m"), F.col("n") * F.col("before")
    others = (F.col("n_ordinary") - own + F.lit(1.0 / ALPHABET)) / (F.col("all_ordinary") - all_own + 1)
    return F.log("p_random") - F.log(F.lit(1 - ORDINARY_UNIFORM) * others + F.lit(ORDINARY_UNIFORM / ALPHABET))


def scan(docs: DataFrame, odds: float = ODDS, id_col: str = "doc_id") -> DataFrame:
    """(id, h, spans array<struct<start, kind, end>>) of the texts that have any; h is xxhash64 of the text."""
    spans = write_out(find_spans(docs, id_col), "spans")
    markov = KINDS.index("markov")
    tokens = spans.filter(F.col("kind") == markov).groupBy("token", F.col("touched").alias("secret")).agg(F.count("*").alias("n"))
    tokens = write_out(tokens.withColumn("of", F.monotonically_increasing_id()), "tokens")  # written, so numbers stay
    model = train_models(tokens)
    own = transitions(tokens.filter("NOT secret")).groupBy("of", "g").agg(F.first("n").alias("n"), F.count("*").alias("m"))
    own = own.withColumn("before", F.sum("m").over(Window.partitionBy("of", F.substring("g", 1, 1))))
    judged = (
        own.join(F.broadcast(model), "g")  # at most (ALPHABET + 1) * ALPHABET rows
        .groupBy("of")
        .agg(F.sum(F.round(log_ratio(), 6).cast("decimal(18,6)") * F.col("m").cast("int")).alias("llr"))
        .filter(F.col("llr") >= odds)
    )
    likely = tokens.join(judged, "of").filter(F.col("llr") >= F.lit(PER_CHARACTER) * F.length("token")).filter(F.col("token").rlike("[A-Za-z]")).select("token")
    added = spans.filter((F.col("kind") == markov) & ~F.col("touched")).join(likely, "token", "left_semi")
    columns = ("id", "h", "start", "kind", "end")
    every = spans.filter(F.col("kind") < markov).select(*columns).unionByName(added.select(*columns))
    return every.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_rows(docs: DataFrame, odds: float = ODDS, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` as (id, spans array); rows without a finding have an empty array."""
    found = scan(docs, odds, id_col)
    rows = docs.select(F.col(id_col), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    joined = rows.join(found, F.col(id_col).eqNullSafe(found["id"]) & (F.col("_h") == found["h"]), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return joined.select(rows[id_col], F.coalesce("spans", none).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    rows = scan_rows(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("markov"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql_rule(kind: str) -> str:
    rule, least = RULES[kind]
    quoted = rule.replace("'", "''")
    group = 2 if kind == "assign" else 0
    return f"""SELECT doc_id, h, {KINDS.index(kind)} AS kind, unnest(regexp_extract_all(text, '{quoted}')) AS m,
    unnest(regexp_extract_all(text, '{quoted}', {group})) AS v,
    unnest(list_transform(string_split_regex(text, '{quoted}')[:-2], lambda x: length(x))) AS gap,
    unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS pos, {least} AS least
    FROM d WHERE regexp_matches(text, '{quoted}')"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h FROM documents),
e AS ({' UNION ALL '.join(_sql_rule(k) for k in KINDS)}),
p AS (SELECT doc_id, kind, m, v, least, length(m) AS len,
  sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stop FROM e),
s AS (SELECT doc_id, kind, m AS token, (stop - len)::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE length(v) >= least),
b AS (SELECT * FROM s WHERE kind < 3),
t AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop) AS secret FROM s WHERE kind = 3),
u AS (SELECT token, secret, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT token, secret, n, substr('{START}' || CASE WHEN regexp_matches(token, '[a-z]') THEN token ELSE lower(token) END, i::BIGINT, 2) AS g, count(*)::BIGINT AS m FROM (SELECT *, unnest(range(1, length(token) + 1)) AS i FROM u) GROUP BY ALL),
o AS (SELECT *, sum(m) OVER (PARTITION BY token, secret, g[1]) AS before FROM g),
c AS (SELECT g, sum(n * m * secret::INT)::DOUBLE AS r, sum(n * m * (NOT secret)::INT)::DOUBLE AS o FROM g GROUP BY g),
m AS (SELECT g, {1 - RANDOM_UNIFORM}::DOUBLE * ((r + {1 / ALPHABET}::DOUBLE) / (sum(r) OVER (PARTITION BY g[1]) + 1)) + {RANDOM_UNIFORM / ALPHABET}::DOUBLE AS p_random, o AS n_o, sum(o) OVER (PARTITION BY g[1]) AS all_o FROM c),
l AS (SELECT token, m, ln(p_random) - ln({1 - ORDINARY_UNIFORM}::DOUBLE * ((n_o - n * o.m + {1 / ALPHABET}::DOUBLE) / (all_o - n * before + 1)) + {ORDINARY_UNIFORM / ALPHABET}::DOUBLE) AS llr FROM o JOIN m USING (g) WHERE NOT secret),
k AS (SELECT token FROM l WHERE regexp_matches(token, '[A-Za-z]') GROUP BY token HAVING sum(round(llr, 6)::DECIMAL(18, 6) * m) >= {ODDS} AND sum(round(llr, 6)::DECIMAL(18, 6) * m) >= {PER_CHARACTER} * length(token)),
a AS (SELECT doc_id, kind, start, stop FROM b UNION ALL SELECT doc_id, kind, start, stop FROM t WHERE NOT secret AND token IN (SELECT token FROM k)),
w AS (SELECT *, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop AS said FROM a)
SELECT d.doc_id, coalesce(count(*) FILTER (kind = 0), 0) AS n_assign, coalesce(count(*) FILTER (kind = 1), 0) AS n_access,
  coalesce(count(*) FILTER (kind = 2), 0) AS n_hex, coalesce(count(*) FILTER (kind = 3), 0) AS n_markov,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id
"""
