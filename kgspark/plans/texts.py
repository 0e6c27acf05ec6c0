"""Registered text operators over documents, pages and events; documents separate paragraphs by one line break."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from kgspark.functions import text as N
from kgspark.registry import register
from kgspark.sources.graph import read_table


def _doc_query(name, operator, sql=None, table="documents"):
    where = sys._getframe(1).f_globals["__name__"]
    register(name, sql, where)(lambda spark, sf_dir: operator(read_table(spark, sf_dir, table)))


STOPS = ", ".join(f"'{w}'" for w in N.STOP_WORDS)
SECTIONS = r"""WITH pg AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
pt AS (SELECT doc_id, pos, trim(p, ' ') AS p, regexp_matches(trim(p, ' '), '^#{1,4} ') AS h FROM pg),
mk AS (SELECT doc_id, pos, coalesce(last_value(CASE WHEN h THEN trim(regexp_replace(p, '^#{1,4} ', ''), ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS heading, CASE WHEN h THEN '' ELSE p END AS text FROM pt),
sc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS section_id, heading, text FROM mk WHERE text <> ''
  UNION ALL SELECT doc_id, 0, '', coalesce(text, '') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mk WHERE text <> '')),
sp AS (SELECT doc_id, section_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS text FROM sc),
cd AS (SELECT doc_id, text, count(*) AS frequency, list_sort(list(DISTINCT section_id)) AS sections FROM sp GROUP BY doc_id, text)
"""


def _sections(docs):
    return N.sections(docs, "\n")


_doc_query("sections", _sections, SECTIONS + "SELECT doc_id, section_id, heading, text FROM sc")
_doc_query("chunks", lambda docs: N.chunks(docs, 2000, "\n").select("doc_id", "part", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest")))
_doc_query(
    "entity_candidates", lambda docs: N.entity_candidates(_sections(docs)).select("doc_id", "text", "category", "frequency", F.array_join(F.transform("sections", lambda s: s.cast("string")), ",").alias("sections")),
    SECTIONS + "SELECT doc_id, text, 'Concept' AS category, frequency, array_to_string(sections, ',') AS sections FROM cd",
)
_doc_query(
    "co_occurrence", lambda docs: N.co_occurrence(N.entity_candidates(_sections(docs))),
    SECTIONS + """, loc AS (SELECT doc_id, text, unnest(sections) AS s FROM cd)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a, b) AS rank FROM (SELECT x.doc_id, x.text AS a, y.text AS b, count(*) AS n FROM loc x JOIN loc y ON x.doc_id = y.doc_id AND x.s = y.s AND x.text < y.text GROUP BY ALL)) WHERE rank <= 200""",
)
WEIGHTS = SECTIONS + f""", tk AS (SELECT doc_id, section_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda w: w NOT IN ({STOPS})) AS w FROM sc),
    tr AS (SELECT doc_id, section_id, term, count(*) AS tf FROM (SELECT doc_id, section_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk) GROUP BY ALL),
    wh AS (SELECT doc_id, term, sum(tf) AS total, count(*) AS df FROM tr GROUP BY ALL),
    vo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, term) AS k FROM wh) WHERE k <= 500),
    ns AS (SELECT doc_id, count(*) AS n FROM sc GROUP BY 1),
    wt AS (SELECT doc_id, section_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tr JOIN vo USING (doc_id, term) JOIN ns USING (doc_id)),
    nr AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, section_id)) AS v FROM wt)
"""
_doc_query(
    "tfidf_keywords", lambda docs: N.tfidf_keywords(_sections(docs)),
    WEIGHTS + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM (SELECT doc_id, term, round(sum(v), 6) AS score FROM nr GROUP BY ALL)) WHERE rank <= 20""",
)
_doc_query(
    "section_keywords", lambda docs: N.section_keywords(_sections(docs)),
    WEIGHTS + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY score DESC, term) AS rank FROM (SELECT doc_id, section_id, term, round(v, 6) AS score FROM nr)) WHERE rank <= 10""",
)
_doc_query(
    "relations_of_texts", lambda docs: N.extract_relations(N.entity_candidates(_sections(docs)))[0].select("doc_id", "source", "target", "rel_type", "weight"),
    SECTIONS + """, loc AS (SELECT doc_id, text, unnest(sections) AS s FROM cd)
    SELECT doc_id, a AS source, b AS target, 'CO_OCCURS' AS rel_type, n::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a, b) AS k FROM (SELECT x.doc_id, x.text AS a, y.text AS b, count(*) AS n FROM loc x JOIN loc y ON x.doc_id = y.doc_id AND x.s = y.s AND x.text < y.text GROUP BY ALL)) WHERE k <= 20""",
)
_doc_query("alias_groups", lambda e: N.alias_groups(e.select(F.floor(F.col("vec_id") / 50).alias("doc_id"), F.col("vec_id").cast("string").alias("name"), F.col("vec_id").alias("pos"), "embedding"), 0.2), None, "embeddings")
_doc_query("embed_texts", lambda docs: N.hashed_vectors(docs, 128).select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm")))
_doc_query(
    "parse_model_json", lambda e: N.parse_model_json(e.select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("answer")), "k int")[0].select("event_id", F.col("parsed.k").alias("k")),
    "SELECT event_id, (props ->> '$.k')::INT AS k FROM events", "events",
)
_doc_query(
    "normalize_entities", lambda p: N.normalize_entities(p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), F.upper("p_name")).alias("name")), "brand"),
    "SELECT p_brand AS brand, p_partkey AS pos, upper(p_name) AS name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) = 1", "part",
)
_doc_query(
    "fallback_entities", N.fallback_entities,
    f"""SELECT doc_id, upper(w[1]) || w[2:] AS name, rank FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS rank FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents)
    WHERE w NOT IN ({STOPS}) GROUP BY doc_id, w) WHERE rank <= 12""",
)
_doc_query(
    "sentences", lambda docs: N.sentences(docs).select("doc_id", "pos", "sentence"),
    r"""SELECT doc_id, pos::INT AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)) WHERE length(sentence) > 20""",
)
_doc_query(
    "html_titles", lambda p: p.select("page_id", N.html_title(F.col("html")).alias("title")),
    r"""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '')), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' ') AS title FROM pages""", "pages",
)
_doc_query(
    "render_readable", lambda docs: docs.select("doc_id", F.md5(N.render_readable(F.col("text"), "\n").cast("binary")).alias("digest")),
    """SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p, ' ') <> ''), lambda p: '<p>' || replace(replace(replace(replace(replace(trim(p, ' '), '**', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>'), '')) AS digest FROM documents""",
)
_doc_query(
    "slugs", lambda p: p.select("p_partkey", N.slugify(F.concat_ws(" & ", "p_name", "p_brand")).alias("runs"), N.slugify(F.concat_ws(" & ", "p_name", "p_brand"), "words").alias("words"), N.slugify(F.concat_ws(" & ", "p_name", "p_brand"), "and").alias("spelled"), N.humanize(N.slugify(F.col("p_name"))).alias("human")),
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS runs,
    regexp_replace(trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9 -]', '', 'g')), ' +', '-', 'g') AS words,
    trim(regexp_replace(lower(replace(p_name || ' & ' || p_brand, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '-') AS spelled,
    array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS human FROM part""", "part",
)
_doc_query(
    "upload_gate", lambda docs: N.upload_gate(docs.select(F.floor(F.col("doc_id") / 25).alias("batch"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".exe").otherwise(".txt")).alias("name"), F.length("text").alias("size"), "text"), 5000).select("batch", "name", "reason"),
    """SELECT batch, name, CASE WHEN name LIKE '%.exe' THEN 'extension' WHEN size = 0 THEN 'empty' WHEN size > 5000 THEN 'too large' WHEN row_number() OVER (PARTITION BY batch ORDER BY name, size) > 20 THEN 'too many files' END AS reason
    FROM (SELECT doc_id // 25 AS batch, doc_id || CASE WHEN doc_id % 7 = 0 THEN '.exe' ELSE '.txt' END AS name, length(text) AS size FROM documents)""",
)
