"""URL filter: rules, and for all other addresses the ratio of two character language models.

Rules come first: the longest rule whose host is the address's host or a parent domain of it and whose path begins the
address's path decides. What rules allow and block is the labelled sample: three quarters of those
addresses, by hash, train two smoothed variable-order Markov models, one of allowed and one of blocked addresses; the last
quarter calibrates the threshold. An address without a rule is scored by the difference of its two
log-likelihoods over its number of characters, and allowed if that reaches the threshold.

A model's chance of a character c after a context h is interpolated down the orders, where n counts, d is the number of
different characters seen after h and h' is h without its first character:

    p(c | h) = (n(hc) + d(h) p(c | h')) / (n(h) + d(h))

A context seen fewer than ``LEAST_SEEN`` times adds nothing (p(c | h) = p(c | h')), so the order varies with what was
seen. Below the empty context every character has the chance 1 / ``CHARACTERS``.

All of it is DataFrame functions. Every character with its ``ORDER`` predecessors is one string, a gram; counts of
shorter grams and contexts are sums over grams by suffix, so texts are cut once for counting and once for
scoring. Equal addresses count once in training. The values of grams are whole millionths of a nat, so sums
do not depend on their order. The table of grams is broadcast only where it was counted to be small.

Defined cases: a null address is an empty one, which is scored by its end mark alone; without ``://`` host and path are empty; a path
must really begin with the rule's, so ``http://a.net`` has the empty path and fits no rule here; repeated rows
and rows of one id all stay; without addresses of a class that class's model is uniform; without
calibration rows of both classes the threshold is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import HASH52_SQL, hash52, small, table
from kgspark.sources.scratch import drop, write_out

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Characters of context, times a context must be seen, and characters that are taken to be possible.
ORDER, LEAST_SEEN, CHARACTERS = 4, 2, 256
#: Parts of a labelled sample, of which the last calibrates; millionths; steps of the threshold, in millionths.
FOLDS, UNIT, STEP = 4, 1_000_000, 10_000
#: Rows up to which the values of grams are broadcast, each of a few dozen bytes.
MOST_GRAMS = 1_000_000
#: Begin and end marks; they are left out where an address has them.
BEGIN, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct<verdict, rule>, else null; of rules of one length the first by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = None
    for verdict, name, start in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def grams(url: Column) -> Column:
    """Each character of an address, and its end mark, with the ``ORDER`` characters before it."""
    plain = F.translate(F.coalesce(url, F.lit("")), BEGIN + END, "")
    padded = F.concat(F.lit(BEGIN * ORDER), plain, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def gram_values(counts: DataFrame) -> DataFrame:
    """(gram, value) from (gram, allow, block): the log ratio of the two models' chances of the last character, in millionths of a nat."""
    classes = ("allow", "block")
    ratio = counts.select("gram", *[F.lit(1 / CHARACTERS).alias(f"p_{c}") for c in classes])
    for k in range(ORDER + 1):
        piece = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(piece.alias("piece")).agg(*[F.sum(c).alias(f"n_{c}") for c in classes])
        context = seen.groupBy(F.substring("piece", 1, k).alias("context")).agg(
            *[F.sum(f"n_{c}").alias(f"h_{c}") for c in classes], *[F.sum(F.when(F.col(f"n_{c}") > 0, 1).otherwise(0)).alias(f"d_{c}") for c in classes]
        )
        if k == 0:
            context = F.broadcast(context)  # one row
        after = seen.join(context, F.substring("piece", 1, k) == F.col("context")).drop("context")
        ratio = ratio.join(after, piece == F.col("piece")).select("gram", *[
            F.when(F.col(f"h_{c}") >= LEAST_SEEN, (F.col(f"n_{c}") + F.col(f"d_{c}") * F.col(f"p_{c}")) / (F.col(f"h_{c}") + F.col(f"d_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
            for c in classes
        ])
    return ratio.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("value"))


def threshold(labelled: DataFrame) -> Column:
    """The score (in millionths, a multiple of ``STEP``) that best parts allowed and blocked rows of (score, verdict): the largest
    sum of both classes' shares on their own side, of several such thresholds the one nearest to 0. One row, made of one row for each step."""
    steps = labelled.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(*[F.sum(F.when(F.col("verdict") == c, 1).otherwise(0)).alias(c) for c in ("allow", "block")])
    ascending = Window.orderBy("step")
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    nearest = F.greatest(F.least("step", F.lit(0)), F.lag("step").over(ascending) + 1)  # parts the rows as step does
    cut = steps.select(
        nearest.alias("step"), F.coalesce(F.sum("block").over(before), F.lit(0)).alias("blocked"), F.coalesce(F.sum("allow").over(before), F.lit(0)).alias("missed"),
        *[F.sum(c).over(every).alias(f"all_{c}") for c in ("allow", "block")],
    ).filter("all_allow > 0 AND all_block > 0")
    good = F.col("blocked") * F.col("all_allow") - F.col("missed") * F.col("all_block")
    return cut.agg(F.coalesce(F.max(F.struct(good.alias("good"), (-F.abs("step")).alias("near"), "step"))["step"] * STEP, F.lit(0)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is null where a rule decides, else nats a character above the threshold."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    named = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    named = named.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.col("found").isNotNull()
    fold = F.pmod(hash52(F.coalesce("url", F.lit(""))), F.lit(FOLDS))

    each = write_out(named.select("url", F.col("found.verdict").alias("verdict")).groupBy("url", "verdict").agg(F.count("*").alias("copies")), "urls")
    trains = (fold < FOLDS - 1).cast("int")
    cut = each.select(F.explode(grams(F.col("url"))).alias("gram"), *[F.coalesce(trains * (F.col("verdict") == c).cast("int"), F.lit(0)).alias(c) for c in ("allow", "block")])
    counts = write_out(cut.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
    values = small(gram_values(counts), "values", MOST_GRAMS)

    asked = each.filter(F.col("verdict").isNull() | (fold == FOLDS - 1))
    scored = asked.select("url", "verdict", F.explode(grams(F.col("url"))).alias("gram")).join(values, "gram")
    scored = write_out(scored.groupBy("url", "verdict").agg(F.floor(F.sum("value") / F.count("*")).cast("long").alias("score")), "scores")
    line = threshold(scored.filter("verdict IS NOT NULL"))
    drop(counts)
    above = scored.filter("verdict IS NULL").join(F.broadcast(line)).select(F.col("url").alias("_url"), (F.col("score") - F.col("threshold")).alias("above"))
    judged = named.join(above, F.col("url").eqNullSafe(F.col("_url")) & F.col("found").isNull(), "left")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.when(ruled, F.col("found.verdict")).when(F.col("above") >= 0, "allow").otherwise("block").alias("verdict"),
        (F.col("above") / UNIT).alias("score"),
    )


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's address."""
    return judge(table(spark, sf_dir, "pages")).drop("score")


def _sql() -> str:
    """The query in SQL: one common table expression for each step of ``judge`` and each order of ``gram_values``."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN {{}}" for _, name, start in ordered)
    verdict = "CASE " + fits.format(*[f"'{v}'" for v, _, _ in ordered]) + " END"
    rule = "CASE " + fits.format(*[f"'{n}{s}'" for _, n, s in ordered]) + " END"
    fold = HASH52_SQL.format("coalesce(url, '')") + f" % {FOLDS}"
    sql = rf"""WITH a AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT *, {verdict} AS ruled, {rule} AS rule FROM a),
    e AS (SELECT DISTINCT url, ruled, {fold} AS fold, repeat(chr(2), {ORDER}) || translate(coalesce(url, ''), chr(2) || chr(3), '') || chr(3) AS t FROM b),
    g AS (SELECT url, ruled, fold, unnest(list_transform(range(1, len(t) - {ORDER} + 1), lambda i: substr(t, i, {ORDER + 1}))) AS gram FROM e),
    c AS (SELECT gram, count(*) FILTER (ruled = 'allow' AND fold < {FOLDS - 1}) AS allow, count(*) FILTER (ruled = 'block' AND fold < {FOLDS - 1}) AS block FROM g GROUP BY gram),
    r0 AS (SELECT gram, {1 / CHARACTERS}::DOUBLE AS pa, {1 / CHARACTERS}::DOUBLE AS pb FROM c)"""
    for k in range(ORDER + 1):
        step = "CASE WHEN h{0} >= {1} THEN (n{0} + d{0} * p{0}) / (h{0} + d{0})::DOUBLE ELSE p{0} END AS p{0}"
        sql += f""",
    s{k} AS (SELECT right(gram, {k + 1}) AS piece, left(right(gram, {k + 1}), {k}) AS context, sum(allow)::BIGINT AS na, sum(block)::BIGINT AS nb FROM c GROUP BY ALL),
    x{k} AS (SELECT context, sum(na)::BIGINT AS ha, sum(nb)::BIGINT AS hb, count(*) FILTER (na > 0) AS da, count(*) FILTER (nb > 0) AS db FROM s{k} GROUP BY context),
    r{k + 1} AS (SELECT gram, {step.format("a", LEAST_SEEN)}, {step.format("b", LEAST_SEEN)} FROM r{k} JOIN s{k} ON piece = right(gram, {k + 1}) JOIN x{k} USING (context))"""
    return sql + f""",
    v AS (SELECT gram, round((ln(pa) - ln(pb)) * {UNIT})::BIGINT AS value FROM r{ORDER + 1}),
    f AS (SELECT url, ruled, floor(sum(value)::BIGINT / count(*))::BIGINT AS score FROM g JOIN v USING (gram) WHERE ruled IS NULL OR fold = {FOLDS - 1} GROUP BY url, ruled),
    t1 AS (SELECT floor(score / {STEP})::BIGINT AS step, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM f WHERE ruled IS NOT NULL GROUP BY 1),
    t2 AS (SELECT greatest(least(step, 0), lag(step) OVER (ORDER BY step) + 1) AS step, coalesce(sum(block) OVER before, 0) * sum(allow) OVER () - coalesce(sum(allow) OVER before, 0) * sum(block) OVER () AS good, sum(allow) OVER () AS aa, sum(block) OVER () AS bb
      FROM t1 WINDOW before AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t3 AS (SELECT coalesce((SELECT step * {STEP} FROM t2 WHERE aa > 0 AND bb > 0 ORDER BY good DESC, abs(step), step DESC LIMIT 1), 0) AS line)
    SELECT page_id, host, path, rule, coalesce(b.ruled, CASE WHEN score >= line THEN 'allow' ELSE 'block' END) AS verdict
    FROM b LEFT JOIN f ON b.ruled IS NULL AND f.ruled IS NULL AND b.url IS NOT DISTINCT FROM f.url, t3"""


SQL = _sql()
