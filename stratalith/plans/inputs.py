"""Stand-in inputs derived from the tables: versions, graphs, symbols, stores. Every one takes the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def queries_from_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def part_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two API versions of the parts: brands are modules, part keys are names."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    base = p.select(F.col("p_brand").alias("path"), key.cast("string").alias("name"), F.col("p_retailprice").cast("string").alias("signature"), F.col("p_name").alias("description"), F.lit(False).alias("deprecated"), key)
    before = base.filter(key % 11 != 0).drop("p_partkey")
    changed = base.withColumn("signature", F.when(key % 5 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature"))).withColumn("deprecated", key % 13 == 0)
    after = changed.filter(key % 7 != 0).drop("p_partkey")
    return before, after


PART_BEFORE = "SELECT p_brand AS path, CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS VARCHAR) AS signature, p_name AS description, FALSE AS deprecated FROM part WHERE p_partkey % 11 <> 0"
PART_AFTER = "SELECT p_brand AS path, CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '!' ELSE '' END AS signature, p_name AS description, p_partkey % 13 = 0 AS deprecated FROM part WHERE p_partkey % 7 <> 0"


def parameters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as ordered parameters, in two versions."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    sym, par = F.col("l_orderkey").cast("string").alias("symbol"), F.col("l_linenumber").cast("string").alias("param")
    kind = F.when(F.col("q") > 25, "string | null").when(F.col("q") > 10, "string").otherwise("number")
    later = F.when(F.col("q") > 40, "string").when(F.col("q") > 20, "string | null").when(F.col("q") > 10, "string").otherwise("boolean")
    before = rows.filter("l_linenumber < 6").select(sym, par, F.col("l_linenumber").alias("pos"), kind.alias("type"), (F.col("f") == "R").alias("optional"), F.lit(None).cast("string").alias("default_value"))
    after = rows.filter("l_linenumber > 1 OR l_orderkey % 2 = 0").select(sym, par, F.when(F.col("l_orderkey") % 3 == 0, 9 - F.col("l_linenumber")).otherwise(F.col("l_linenumber")).alias("pos"), later.alias("type"), (F.col("s") == "O").alias("optional"), F.when(F.col("l_orderkey") % 5 == 0, "0").alias("default_value"))
    return before, after


_LINES = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2"
PARAMS_BEFORE = f"SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_linenumber AS VARCHAR) AS param, l_linenumber AS pos, CASE WHEN q > 25 THEN 'string | null' WHEN q > 10 THEN 'string' ELSE 'number' END AS type, f = 'R' AS optional, CAST(NULL AS VARCHAR) AS default_value FROM ({_LINES}) WHERE l_linenumber < 6"
PARAMS_AFTER = f"SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_linenumber AS VARCHAR) AS param, CASE WHEN l_orderkey % 3 = 0 THEN 9 - l_linenumber ELSE l_linenumber END AS pos, CASE WHEN q > 40 THEN 'string' WHEN q > 20 THEN 'string | null' WHEN q > 10 THEN 'string' ELSE 'boolean' END AS type, s = 'O' AS optional, CASE WHEN l_orderkey % 5 = 0 THEN '0' END AS default_value FROM ({_LINES}) WHERE l_linenumber > 1 OR l_orderkey % 2 = 0"


def customer_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer points at a third of its key and at its nation's block of keys: a shallow graph with cycles."""
    c = table(spark, sf, "customer")
    one = c.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).cast("long").alias("dst"))
    two = c.filter(F.col("c_custkey") <= 20).select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 2 % 21).alias("dst"))
    return one.unionByName(two)


CUSTOMER_GRAPH = "(SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey * 2 % 21 FROM customer WHERE c_custkey <= 20)"


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of the same nation call each other upwards: (src, dst) ids."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 4).cast("long").alias("dst")).filter("src <> dst")


CALL_EDGES = "(SELECT s_suppkey AS src, s_suppkey // 4 AS dst FROM supplier WHERE s_suppkey <> s_suppkey // 4)"


def symbols(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Documents as symbols: sources are modules, first lines (or whole texts) descriptions."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "function").when(k == 1, "class").when(k == 2, "interface").otherwise("variable")
    p = lambda name, said: F.struct(F.lit(name).alias("name"), said.alias("description"))
    first = F.col("text") if whole else F.split("text", "\n")[0]
    return d.select(
        F.col("source").alias("path"),
        F.col("doc_id").cast("string").alias("name"),
        kind.alias("kind"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(first).alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "void").when(F.col("doc_id") % 3 == 1, "string").alias("return_type"),
        F.array(F.when(F.col("doc_id") % 2 == 0, "export").otherwise("private")).alias("modifiers"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("use()"))).otherwise(F.array().cast("array<string>")).alias("examples"),
        F.array(p("data", F.lit("")), p("count", F.col("lang"))).alias("params"),
        F.when(F.col("doc_id") % 10 == 0, "return null;").otherwise("return 1;").alias("signature"),
        F.array(F.concat(F.lit("#/definitions/"), (F.col("doc_id") * 2).cast("string"))).alias("refs"),
    )


SYMBOLS = """(SELECT source AS path, CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' ELSE 'variable' END AS kind,
 CASE WHEN doc_id % 6 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS description, CASE WHEN doc_id % 3 = 0 THEN 'void' WHEN doc_id % 3 = 1 THEN 'string' END AS return_type,
 CASE WHEN doc_id % 2 = 0 THEN 'export' ELSE 'private' END AS modifier, doc_id % 5 = 0 AS has_example, lang, CASE WHEN doc_id % 10 = 0 THEN 'return null;' ELSE 'return 1;' END AS signature, doc_id FROM documents)"""


WHOLE_SYMBOLS = SYMBOLS.replace("split_part(text, chr(10), 1)", "text")


def code_id():
    """The specification that a document refers to: its own number, or one that is defined nowhere."""
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "").otherwise("x"), F.col("doc_id").cast("string"))


def freshness_store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current files (all but each third document, each fifth altered) and a store of each second and each third one: every document is on a side."""
    d = table(spark, sf, "documents")
    uri = F.col("doc_id").cast("string").alias("uri")
    text = F.coalesce("text", F.lit(""))
    current = d.filter("doc_id % 3 <> 0").select(uri, F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("x"))).otherwise(text)).alias("hash"))
    store = d.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").select(uri, F.md5(text).alias("source_hash"))
    return current, store


CURRENT = "(SELECT CAST(doc_id AS VARCHAR) AS uri, md5(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END) AS hash FROM documents WHERE doc_id % 3 <> 0)"
STORE = "(SELECT CAST(doc_id AS VARCHAR) AS uri, md5(coalesce(text, '')) AS source_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)"
