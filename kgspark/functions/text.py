"""Document preparation: sections, chunks, candidates, keywords, slugs and readable pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.sources.scratch import write_out

#: The category of each named-entity label; labels of None are dropped, others are a Concept.
CATEGORIES = {
    "PERSON": "Person", "ORG": "Organization", "GPE": "Place", "LOC": "Place", "FAC": "Place", "EVENT": "Event", "NORP": "Organization",
    "PRODUCT": "Resource", "LAW": "Law", "WORK_OF_ART": "Document", "LANGUAGE": "Concept", "MONEY": "Metric", "QUANTITY": "Metric", "PERCENT": "Metric",
    "DATE": None, "TIME": None, "CARDINAL": None, "ORDINAL": None,
}
#: English words without meaning of their own.
STOP_WORDS = "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just me more my no not of on one or our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()


def sections(docs: DataFrame, separator: str = r"\n{2,}", id_col: str = "doc_id") -> DataFrame:
    """(id, section_id, heading, text): paragraphs under the last heading (a paragraph that begins with one to four #).

    A heading's own paragraph gives a section of what follows its first line. Documents without a section are one.
    """
    paragraphs = docs.select(id_col, "text", F.posexplode(F.split(F.coalesce("text", F.lit("")), separator)).alias("pos", "p")).withColumn("p", F.trim("p"))
    is_heading = F.col("p").rlike(r"^#{1,4} ")
    heading = F.when(is_heading, F.trim(F.regexp_replace(F.substring_index("p", "\n", 1), r"^#{1,4} ", "")))
    along = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.when(is_heading, F.trim(F.regexp_replace("p", r"^[^\n]*\n?", ""))).otherwise(F.col("p"))
    marked = paragraphs.select(id_col, "pos", F.coalesce(F.last(heading, ignorenulls=True).over(along), F.lit("")).alias("heading"), body.alias("text"))
    kept = marked.filter("text <> ''")
    numbered = kept.withColumn("section_id", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1).select(id_col, "section_id", "heading", "text")
    whole = docs.join(kept.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit(0).alias("section_id"), F.lit("").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.unionByName(whole)


def cut_text(text: str, size: int, separator: str) -> list[str]:
    """Paragraphs packed in order to at most ``size``; over-long ones cut at the last space of their second half, else hard."""
    if size < 1:
        raise ValueError("size must be at least 1")
    out, now = [], ""
    for paragraph in text.split(separator):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if now and len(now) + len(separator) + len(paragraph) > size:
            out.append(now)
            now = ""
        while len(paragraph) > size:
            at = paragraph.rfind(" ", size // 2, size + 1)
            at = at if at > 0 else size
            out.append(paragraph[:at].rstrip())
            paragraph = paragraph[at:].lstrip()
        if paragraph:
            now = now + separator + paragraph if now else paragraph
    return [*out, now] if now else out


def chunks(docs: DataFrame, size: int = 30_000, separator: str = "\n\n", id_col: str = "doc_id") -> DataFrame:
    """(id, part, text): each document cut by ``cut_text``; parts count from 1."""
    if size < 1:
        raise ValueError("size must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, piece in enumerate(cut_text(text or "", size, separator), 1):
                    ids.append(key)
                    parts.append(k)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "part", "text"])

    return docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, f"{id_col} long, part int, text string")


def chunk_titles(parts: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, title) of ``chunks``: the document's title (null: empty), with `` - Part i`` where the document has more than one part."""
    many = parts.groupBy(id_col).agg(F.max("part").alias("_last"))
    titled = parts.select(id_col, "part").join(many, id_col).join(docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce("title", F.lit("")).alias("title")), id_col)
    return titled.select(id_col, "part", F.when(F.col("_last") > 1, F.concat("title", F.lit(" - Part "), F.col("part").cast("string"))).otherwise(F.col("title")).alias("title"))


def capitalised_spans(sections_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Built-in span source: (id, section_id, text, label, context) of words with a capital, four letters or longer."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,}"), F.lit(0))
    return sections_df.select(id_col, "section_id", F.posexplode(found).alias("pos", "span"), F.substring("text", 1, 200).alias("context")).select(id_col, "section_id", "pos", F.col("span").alias("text"), F.lit("MISC").alias("label"), "context")


def entity_candidates(sections_df: DataFrame, spans: Callable[[DataFrame], DataFrame] = capitalised_spans, id_col: str = "doc_id") -> DataFrame:
    """(id, text, category, frequency, sections, contexts): spans of the source, grouped by document and text.

    Labels map to categories, the first label of a text wins, "the " is stripped, texts of one letter go.
    """
    labels = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (k, v)])
    dropped = [k for k, v in CATEGORIES.items() if v is None]
    rows = spans(sections_df).filter(~F.col("label").isin(dropped)).withColumn("text", F.trim(F.regexp_replace("text", r"^(?i)the ", ""))).filter(F.length("text") >= 2)
    first = F.min(F.struct("section_id", "pos", "label"))
    context = F.array_sort(F.collect_set(F.struct("section_id", "context")))
    grouped = rows.groupBy(id_col, "text").agg(first.alias("f"), F.count("*").alias("frequency"), F.array_sort(F.collect_set("section_id")).alias("sections"), context.alias("c"))
    category = F.coalesce(F.try_element_at(labels, F.col("f.label")), F.lit("Concept"))
    return grouped.select(id_col, "text", category.alias("category"), "frequency", "sections", F.slice(F.col("c.context"), 1, 3).alias("contexts"))


def co_occurrence(candidates: DataFrame, top: int = 200, id_col: str = "doc_id") -> DataFrame:
    """(id, a, b, n, rank): pairs of candidates that share sections, the ``top`` of each document."""
    at = candidates.select(id_col, "text", F.explode("sections").alias("section_id"))
    pairs = at.withColumnRenamed("text", "a").join(at.withColumnRenamed("text", "b"), [id_col, "section_id"]).filter("a < b")
    counts = pairs.groupBy(id_col, "a", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "a", "b")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def words(text: Column, least: int = 2) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z]{{{least},}}"), F.lit(0))


#: Words weighed at once, about; what rounding to six places may move a score by.
WORDS, NEAR = 500_000, 2e-6


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where one of the sorted columns has a new value."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _leading(unit: np.ndarray, score: np.ndarray, code: np.ndarray, top: int) -> np.ndarray:
    """Rows that may be among the ``top`` of their unit by rounded score, then code; of equal scores so many first."""
    order = np.lexsort((code, -score, unit))
    unit, score = unit[order], score[order]
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(_starts(unit), place, 0))
    least = np.where(place - first == top - 1, score, -np.inf)
    ends = np.flatnonzero(_starts(unit))
    least = np.repeat(np.maximum.reduceat(least, ends), np.diff(np.append(ends, len(order)))) if len(order) else least
    same = np.maximum.accumulate(np.where(_starts(unit, score), place, 0))
    return order[(score >= least - NEAR) & (place - same < top)]


def leading_terms(sections_df: DataFrame, top: int, max_features: int = 500, id_col: str = "doc_id", summed: bool = False) -> DataFrame:
    """(id, section_id, term, score): a document's sections are its corpus; uni- and bigrams, smoothed idf, unit rows, of each section the ``top`` terms.

    With ``summed`` the sections' weights are added up and the terms are a document's. Scores are not rounded, so terms that
    rounding might lift are there too. A document's sections come as one row, many documents are weighed at once, and only the leading terms go on.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, len(whole) * WORDS // max(1, len(whole.column(1).flatten().flatten()[1].flatten())))
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                numbers, lists = batch.column(1).flatten().flatten()
                n = batch.column(1).value_lengths().to_numpy()
                doc, sizes = np.repeat(np.arange(len(batch)), n), lists.value_lengths().to_numpy()
                coded = pa.array(lists.flatten(), pa.string()).dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                known, v = coded.dictionary.take(pa.array(order)), len(order) + 1
                word = np.argsort(order)[coded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
                at = np.repeat(np.arange(len(sizes)), sizes)
                pair = np.flatnonzero(at[1:] == at[:-1])
                # a blank comes before all letters, so codes are in the order of terms
                section, code = np.concatenate([at, at[pair]]), np.concatenate([word * v, word[pair] * v + word[pair + 1] + 1])
                order = np.lexsort((section, code, doc[section]))
                section, code = section[order], code[order]
                new = np.flatnonzero(_starts(section, code))
                tf = np.diff(np.append(new, len(code)))
                section, code = section[new], code[new]
                of = doc[section]
                term = np.cumsum(_starts(of, code)) - 1
                heads = np.flatnonzero(_starts(of, code))
                total, df = np.bincount(term, tf, len(heads)), np.bincount(term, minlength=len(heads))
                order = np.lexsort((code[heads], -total, of[heads]))
                place = np.arange(len(order))
                kept = np.zeros(len(order), bool)
                kept[order] = place - np.maximum.accumulate(np.where(_starts(of[heads][order]), place, 0)) < max_features
                row = kept[term]
                w = tf[row] * (np.log((1 + n[of[row]]) / (1 + df[term[row]])) + 1)
                section, code, of = section[row], code[row], of[row]
                score = w / np.sqrt(np.bincount(section, w * w, len(sizes)))[section]
                if summed:
                    new = _starts(of, code)
                    score, section, code, of = np.bincount(np.cumsum(new) - 1, score, new.sum()), section[new], code[new], of[new]
                lead = _leading(of if summed else section, score, code, top)
                section, code, of = section[lead], code[lead], of[lead]
                one, two = known.take(pa.array(code // v)), known.take(pa.array(code % v - 1, mask=code % v == 0))
                terms = pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), numbers.take(pa.array(section)), terms, pa.array(score[lead], pa.float64())], [id_col, "section_id", "term", "score"])

    kept = lambda s: F.coalesce(F.filter(words(s["text"]), lambda w: ~w.isin(STOP_WORDS)), F.array().cast("array<string>"))
    whole = sections_df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct("section_id", "text")).alias("s"))  # one document
    rows = whole.select(id_col, F.transform("s", lambda s: F.struct(s["section_id"].alias("section_id"), kept(s).alias("w"))).alias("s"))
    kinds = [sections_df.schema[c].dataType.simpleString() for c in (id_col, "section_id")]
    return rows.mapInArrow(weigh, f"{id_col} {kinds[0]}, section_id {kinds[1]}, term string, score double")


def tfidf_keywords(sections_df: DataFrame, top: int = 20, max_features: int = 500, id_col: str = "doc_id") -> DataFrame:
    """(id, term, score, rank): weights of a document's sections summed, the ``top`` terms of each document."""
    scores = leading_terms(sections_df, top, max_features, id_col, summed=True).select(id_col, "term", F.round("score", 6).alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def section_keywords(sections_df: DataFrame, top: int = 10, max_features: int = 500, id_col: str = "doc_id") -> DataFrame:
    """(id, section_id, term, score, rank): the ``top`` terms of each section."""
    scores = leading_terms(sections_df, top, max_features, id_col).select(id_col, "section_id", "term", F.round("score", 6).alias("score"))
    order = Window.partitionBy(id_col, "section_id").orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def paired_relations(candidates: DataFrame, top: int = 20, id_col: str = "doc_id") -> DataFrame:
    """Built-in extractor: the ``top`` pairs of candidates that share sections, with the first context of the former as quote."""
    quotes = candidates.select(id_col, F.col("text").alias("a"), F.get("contexts", F.lit(0)).alias("evidence"))
    pairs = co_occurrence(candidates, top, id_col).join(quotes, [id_col, "a"])
    return pairs.select(id_col, F.col("a").alias("source"), F.col("b").alias("target"), F.lit("CO_OCCURS").alias("rel_type"), "evidence", F.col("n").cast("double").alias("weight"))


def extract_relations(candidates: DataFrame, extractor: Callable[[DataFrame], DataFrame] = paired_relations, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(relations, rejected) of an extractor's (id, source, target, rel_type, evidence, weight).

    Relations whose texts are blank, whose ends are one or are no candidates of the document are rejected with a reason.
    """
    names = candidates.select(id_col, "text").distinct()
    blank = F.exists(F.array("source", "target", "rel_type", "evidence"), lambda v: F.coalesce(F.trim(v) == "", F.lit(True)))
    rows = (
        extractor(candidates).select(id_col, "source", "target", "rel_type", "evidence", "weight")
        .join(names.select(id_col, F.col("text").alias("source"), F.lit(True).alias("_s")), [id_col, "source"], "left")
        .join(names.select(id_col, F.col("text").alias("target"), F.lit(True).alias("_t")), [id_col, "target"], "left")
    )
    reason = F.when(blank, "blank").when(F.col("source") == F.col("target"), "loop").when(F.col("_s").isNull() | F.col("_t").isNull(), "unknown end")
    rows = rows.withColumn("reason", reason).drop("_s", "_t")
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


#: Names of a document that are decided at once; names of a group that is compared with their leaders.
HEAD, PART = 1000, 2000


def alias_groups(vectors: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", head: int = HEAD, part: int = PART) -> DataFrame:
    """(id, leader, member): greedy leaders in order of ``pos``, then name; each takes the later free ones of higher cosine. Input: (id, name, pos, embedding).

    Leaders are the first maximal set of names of which no two are that near. It is found in rounds: of each document the
    first ``head`` names that are still free choose their leaders among themselves; the names after them are compared
    with those leaders in groups of about ``part``, and the free ones go on. So a document of any size is many groups of bounded size,
    and no pairs are listed. Null and zero vectors stay alone; leaders without members have no row.
    """
    def unit(column: pa.ChunkedArray) -> np.ndarray:
        flat = np.concatenate([np.empty(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]])
        x = np.nan_to_num(flat.astype(float).reshape(len(column), -1))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def lead(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pos", "ascending"), ("name", "ascending")])
        x = unit(rows.column("embedding"))
        leader = np.full(len(x), -1)
        for k in range(len(x)):
            if leader[k] < 0:
                took = k + np.flatnonzero((leader[k:] < 0) & (x[k:] @ x[k] > threshold))
                leader[took] = k
                leader[k] = k
        names = rows.column("name").combine_chunks()
        return pa.table({id_col: rows.column(id_col), "leader": names.take(pa.array(leader)), "member": names, "embedding": rows.column("embedding"), "pos": rows.column("pos")})

    def follow(rows: pa.Table) -> pa.Table:
        heads = rows.filter(rows["heads"]).sort_by([("pos", "ascending"), ("name", "ascending")])
        rest = rows.filter(pc.invert(rows["heads"]))
        a, b = unit(rest.column("embedding")), unit(heads.column("embedding"))
        over = a @ b.T > threshold if len(b) else np.zeros((len(a), 0), bool)
        found = over.any(axis=1)
        first = pa.array(np.where(found, over.argmax(axis=1) if len(b) else 0, 0), mask=~found)
        return pa.table({id_col: rest.column(id_col), "name": rest.column("name"), "pos": rest.column("pos"), "embedding": rest.column("embedding"), "leader": heads.column("name").combine_chunks().take(first)})

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, "name", "pos", "embedding")}
    free = vectors.select(id_col, "name", "pos", "embedding").filter("embedding IS NOT NULL AND name IS NOT NULL")
    order = Window.partitionBy(id_col).orderBy("pos", "name")
    out = None
    while True:
        sizes = free.groupBy(id_col).agg(F.count("*").alias("_n"))
        placed = free.join(sizes, id_col).withColumn("_whole", F.col("_n") <= head)
        small, large = placed.filter("_whole"), placed.filter("NOT _whole")
        first = write_out(small.withColumn("_k", F.lit(0)).unionByName(large.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= head)).drop("_k", "_n", "_whole"), "heads")
        chosen = write_out(first.groupBy(id_col).applyInArrow(lead, f"{id_col} {kinds[id_col]}, leader string, member string, embedding {kinds['embedding']}, pos {kinds['pos']}"), "chosen")
        pairs = chosen.select(id_col, "leader", "member")
        out = pairs if out is None else out.unionByName(pairs)
        rest = large.drop("_whole").join(first.select(id_col, "name", "pos"), [id_col, "name", "pos"], "left_anti")
        rest = rest.withColumn("_parts", F.ceil(F.col("_n") / part)).withColumn("_part", F.pmod(F.xxhash64("name", "pos"), F.col("_parts")))
        if rest.isEmpty():
            break
        counts = rest.groupBy(id_col).agg(F.first("_parts").alias("_parts"))
        leaders = chosen.filter("leader = member").select(id_col, F.col("member").alias("name"), "pos", "embedding").join(counts, id_col)
        leaders = leaders.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)))
        both = rest.select(id_col, "name", "pos", "embedding", F.col("_part").cast("long").alias("_part"), F.lit(False).alias("heads")).unionByName(leaders.select(id_col, "name", "pos", "embedding", "_part", F.lit(True).alias("heads")))
        seen = write_out(both.groupBy(id_col, "_part").applyInArrow(follow, f"{id_col} {kinds[id_col]}, name string, pos {kinds['pos']}, embedding {kinds['embedding']}, leader string"), "followed")
        out = out.unionByName(seen.filter("leader IS NOT NULL").select(id_col, "leader", F.col("name").alias("member")))
        free = seen.filter("leader IS NULL").drop("leader")
    many = out.groupBy(id_col, "leader").agg(F.count("*").alias("_n")).filter("_n > 1").select(id_col, "leader")
    return out.join(many, [id_col, "leader"], "left_semi").select(id_col, "leader", "member")


def hashed_vectors(rows: DataFrame, dim: int = 384, id_col: str = "doc_id") -> DataFrame:
    """Built-in encoder: (id, embedding) of unit length from hashed words, by tf and smoothed idf."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(dim)).cast("int")
    terms = rows.select(id_col, F.explode(words(F.col("text"))).alias("w")).groupBy(id_col, bucket.alias("k")).agg(F.count("*").alias("tf"))
    df = terms.groupBy("k").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    w = terms.join(F.broadcast(df), "k").crossJoin(F.broadcast(n)).withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # at most dim rows, and one
    entries = w.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm"))
    return entries.select(id_col, dense.alias("embedding"))


def parse_model_json(rows: DataFrame, schema: str, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): code fences stripped, then parsed; rows that do not parse keep their raw text."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(column, r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", ""))
    parsed = rows.withColumn("parsed", F.from_json(clean, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("parsed").isNotNull() & F.col("parsed._bad").isNull()
    return parsed.filter(F.coalesce(ok, F.lit(False))).withColumn("parsed", F.col("parsed").dropFields("_bad")), parsed.filter(~F.coalesce(ok, F.lit(False))).drop("parsed")


def normalize_entities(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Names trimmed, blank ones rejected, the first of each name in any case kept. Input: (id, pos, name, …)."""
    named = entities.withColumn("name", F.trim("name")).filter("name <> ''")
    first = Window.partitionBy(id_col, F.lower("name")).orderBy("pos")
    return named.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def fallback_entities(docs: DataFrame, top: int = 20, shown: int = 12, id_col: str = "doc_id") -> DataFrame:
    """(id, name, rank): the most frequent words of four letters and more, the first ones as names."""
    counts = docs.select(id_col, F.explode(words(F.coalesce("text", F.lit("")), 4)).alias("w")).filter(~F.col("w").isin(STOP_WORDS)).groupBy(id_col, "w").agg(F.count("*").alias("n"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "w")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(top, shown)).select(id_col, F.initcap("w").alias("name"), "rank")


def fallback_where_few(docs: DataFrame, candidates: DataFrame, fewer_than: int = 10, top: int = 20, shown: int = 12, id_col: str = "doc_id") -> DataFrame:
    """``fallback_entities`` of the documents with fewer distinct candidates (id, name) than that, none included."""
    enough = candidates.groupBy(id_col).agg(F.countDistinct("name").alias("n")).filter(F.col("n") >= fewer_than)
    return fallback_entities(docs.join(enough.select(id_col), id_col, "left_anti"), top, shown, id_col)


def sentences(docs: DataFrame, longer_than: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, sentence): split after . ! ? and white space; short ones left out."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[ \t\n\r]+")
    return docs.select(id_col, F.posexplode(parts).alias("pos", "sentence")).filter(F.length("sentence") > longer_than)


def html_title(page: Column) -> Column:
    """The title element, else the first h1, with basic references decoded and tags removed; null without either."""
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    h1 = F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    text = F.regexp_replace(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(h1), F.lit(""))), r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(text)


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def render_readable(text: Column, separator: str = "\n\n") -> Column:
    """Escaped body: paragraphs in p elements, those that begin with #, ## or ### in h1 to h3, ** removed."""

    def block(p: Column) -> Column:
        safe = escape_html(F.replace(F.trim(p), F.lit("**"), F.lit("")))
        level = F.length(F.regexp_extract(p, r"^(#{1,3}) ", 1))
        title = F.regexp_replace(safe, r"^#{1,3} ", "")
        return F.when(level > 0, F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), title, F.lit("</h"), level.cast("string"), F.lit(">"))).otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, block), "")


def slugify(text: Column, kind: str = "runs") -> Column:
    """runs: every run of other signs is one dash; words: punctuation goes, blanks become dashes; and: as runs, with & spelled out."""
    if kind == "words":
        return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9 -]", "")), r" +", "-")
    if kind == "and":
        text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def humanize(slug: Column, acronyms: tuple[str, ...] = ("ai", "api", "llm", "usa", "eu")) -> Column:
    """Dashes to blanks, words capitalised, acronyms in capitals."""
    return F.array_join(F.transform(F.split(slug, "-+"), lambda w: F.when(w.isin(*acronyms), F.upper(w)).otherwise(F.initcap(w))), " ")


def upload_gate(files: DataFrame, most_bytes: int, most_files: int = 20, batch_col: str = "batch") -> DataFrame:
    """Adds ``reason``: the first rule that a file (batch, name, size, text) breaks, null where it is accepted."""
    names = Window.partitionBy(batch_col, F.lower("name")).orderBy("name", "size")
    order = Window.partitionBy(batch_col).orderBy("name", "size")
    reason = (
        F.when(~F.lower("name").rlike(r"\.(md|txt|pdf)$"), "extension")
        .when(F.col("name").rlike(r"[/\\]|\.\."), "unsafe name")
        .when(F.col("size") == 0, "empty")
        .when(F.col("size") > most_bytes, "too large")
        .when(F.row_number().over(names) > 1, "duplicate name")
        .when(F.instr(F.coalesce("text", F.lit("")), "\x00") > 0, "not text")
        .when(F.row_number().over(order) > most_files, "too many files")
    )
    return files.withColumn("reason", reason)
