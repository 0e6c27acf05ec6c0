"""The graph's tables, and a graph derived from order data.

``Graph`` bundles one DataFrame per node label and relation type. ``order_graph`` maps order tables to it:
an order is a project, a part an entity, a line a mention; consecutive lines of an order are relations and
chain links, months are collections, customer segments directories, shipping months phases. ``ORDER_SQL``
states the same mapping as DuckDB common table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """entities(entity_id, name, category, definition, aliases), projects(project_id, name, summary, domain,
    subdomain, base_tags, created_at), project_collections(project_id, collection), project_directories(
    project_id, directory), mentions(entity_id, project_id, role), relations(rel_id, src, dst, rel_type, causal,
    magnitude, evidence_strength, year, project_id), chains(chain_id, project_id, name, link_count),
    chain_links(chain_id, order_index, src, dst), phases(project_id, phase_index, period)."""

    entities: DataFrame
    projects: DataFrame
    project_collections: DataFrame
    project_directories: DataFrame
    mentions: DataFrame
    relations: DataFrame
    chains: DataFrame
    chain_links: DataFrame
    phases: DataFrame

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    part = read_table(spark, sf_dir, "part")
    customer = read_table(spark, sf_dir, "customer")
    entity = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    project = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))

    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    placed = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    placed = placed.withColumn("pos", F.row_number().over(along) - 1).withColumn("next_part", F.lead("l_partkey").over(along))
    steps = placed.filter("next_part IS NOT NULL")
    relations = steps.filter("next_part <> l_partkey").select(
        F.concat_ws("-", F.lit("r"), "l_orderkey", "pos").alias("rel_id"),
        entity("l_partkey").alias("src"),
        entity("next_part").alias("dst"),
        F.col("l_linestatus").alias("rel_type"),
        F.when(F.col("l_returnflag") == "A", "enabling").when(F.col("l_returnflag") == "R", "reversing").otherwise("").alias("causal"),
        F.when(F.col("l_quantity") >= 40, "foundational").when(F.col("l_quantity") >= 20, "significant").otherwise("marginal").alias("magnitude"),
        F.when(F.col("l_returnflag") == "N", "suggestive").otherwise("established").alias("evidence_strength"),
        F.year("l_shipdate").alias("year"),
        project("l_orderkey").alias("project_id"),
    )
    chain_links = steps.select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("chain_id"), F.col("pos").alias("order_index"), entity("l_partkey").alias("src"), entity("next_part").alias("dst")
    )
    chains = steps.groupBy("l_orderkey").agg(F.count("*").alias("link_count")).select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("chain_id"), project("l_orderkey").alias("project_id"), F.concat(F.lit("chain "), F.col("l_orderkey").cast("string")).alias("name"), "link_count"
    )
    months = lines.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("period")).distinct()
    phases = months.select(project("l_orderkey").alias("project_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("period")) - 1).alias("phase_index"), "period")
    return Graph(
        entities=part.select(entity("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("definition"), F.split("p_type", " ").alias("aliases")),
        projects=orders.select(
            project("o_orderkey").alias("project_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("summary"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("subdomain"),
            F.array("o_orderpriority", F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("base_tags"), F.col("o_orderdate").alias("created_at"),
        ),
        project_collections=orders.select(project("o_orderkey").alias("project_id"), F.date_format("o_orderdate", "yyyy-MM").alias("collection")),
        project_directories=orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(project("o_orderkey").alias("project_id"), F.col("c_mktsegment").alias("directory")),
        mentions=lines.groupBy("l_partkey", "l_orderkey").agg(F.min("l_returnflag").alias("role")).select(entity("l_partkey").alias("entity_id"), project("l_orderkey").alias("project_id"), "role"),
        relations=relations,
        chains=chains,
        chain_links=chain_links,
        phases=phases,
    )


ORDER_SQL = """WITH placed AS (SELECT *, row_number() OVER w - 1 AS pos, lead(l_partkey) OVER w AS next_part FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)),
steps AS (SELECT * FROM placed WHERE next_part IS NOT NULL),
entities AS (SELECT 'e' || p_partkey AS entity_id, p_name AS name, p_brand AS category, p_type AS definition, string_split(p_type, ' ') AS aliases FROM part),
projects AS (SELECT 'p' || o_orderkey AS project_id, 'order ' || o_orderkey AS name, o_orderpriority || ' ' || o_orderstatus AS summary, o_orderpriority AS domain,
  o_orderstatus AS subdomain, [o_orderpriority, 'status ' || o_orderstatus] AS base_tags, o_orderdate AS created_at FROM orders),
project_collections AS (SELECT 'p' || o_orderkey AS project_id, strftime(o_orderdate, '%Y-%m') AS collection FROM orders),
project_directories AS (SELECT 'p' || o_orderkey AS project_id, c_mktsegment AS directory FROM orders JOIN customer ON o_custkey = c_custkey),
mentions AS (SELECT 'e' || l_partkey AS entity_id, 'p' || l_orderkey AS project_id, min(l_returnflag) AS role FROM lineitem GROUP BY l_partkey, l_orderkey),
relations AS (SELECT 'r-' || l_orderkey || '-' || pos AS rel_id, 'e' || l_partkey AS src, 'e' || next_part AS dst, l_linestatus AS rel_type,
  CASE l_returnflag WHEN 'A' THEN 'enabling' WHEN 'R' THEN 'reversing' ELSE '' END AS causal,
  CASE WHEN l_quantity >= 40 THEN 'foundational' WHEN l_quantity >= 20 THEN 'significant' ELSE 'marginal' END AS magnitude,
  CASE l_returnflag WHEN 'N' THEN 'suggestive' ELSE 'established' END AS evidence_strength, year(l_shipdate) AS year, 'p' || l_orderkey AS project_id
  FROM steps WHERE next_part <> l_partkey),
chain_links AS (SELECT 'c' || l_orderkey AS chain_id, pos AS order_index, 'e' || l_partkey AS src, 'e' || next_part AS dst FROM steps),
chains AS (SELECT 'c' || l_orderkey AS chain_id, 'p' || l_orderkey AS project_id, 'chain ' || l_orderkey AS name, count(*) AS link_count FROM steps GROUP BY l_orderkey),
phases AS (SELECT 'p' || l_orderkey AS project_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY period) - 1 AS phase_index, period
  FROM (SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem)),
pc AS (SELECT project_id, collection FROM project_collections),
scoped AS (SELECT DISTINCT collection, m.entity_id, m.project_id, m.role FROM mentions m JOIN pc USING (project_id)),
degrees AS (SELECT entity_id, count(e) AS degree FROM entities LEFT JOIN (SELECT src AS e FROM relations UNION ALL SELECT dst FROM relations) ON e = entity_id GROUP BY entity_id),
counts AS (SELECT entity_id, count(*) AS project_count FROM mentions GROUP BY entity_id),
metrics AS (SELECT entity_id, name, category, degree, coalesce(project_count, 0) AS project_count FROM entities JOIN degrees USING (entity_id) LEFT JOIN counts USING (entity_id))
"""
