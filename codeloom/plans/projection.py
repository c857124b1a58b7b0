"""An index made of the star-schema tables, so that every operator has data of any size.

Nations are modules, suppliers classes, parts methods, customers functions; line items and orders are
calls; events are histories and edits. The same text serves both SQL dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
KEPT = ("symbols", "relations")  # what the checking SQL makes once
AT = "'2024-01-01T00:00:00+00:00'"
_C_PATH = "CASE WHEN c_custkey % 2 = 0 THEN 'tests/test_n' || CAST(c_nationkey AS STRING) || '.py' ELSE 'app/n' || CAST(c_nationkey AS STRING) || '_svc.py' END"
_N_PATH = "'src/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '.py'"
_SYMBOL = "CAST({0} AS INT) AS start_line, CAST({1} AS INT) AS start_col, CAST({2} AS INT) AS end_line, CAST({3} AS INT) AS end_col"
_PROVENANCE = f"'tree' AS provenance_provider, '1' AS provenance_version, {AT} AS observed_at"


def sql(spark_dialect: bool) -> dict[str, str]:
    """The common table expressions, in order."""
    div = (lambda a, b: f"({a} DIV {b})") if spark_dialect else (lambda a, b: f"({a} // {b})")
    span = _SYMBOL.format
    return {
        "modules": f"SELECT DISTINCT path FROM (SELECT {_N_PATH} AS path FROM nation UNION ALL SELECT {_C_PATH} FROM customer) t",
        "classes": f"SELECT s_suppkey AS k, {_N_PATH} AS path, {_N_PATH} || ':S' || CAST(s_suppkey AS STRING) || '#class' AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "methods": f"""SELECT p_partkey AS pk, p_size, c.k, j, c.path, c.path || ':S' || CAST(c.k AS STRING) || '.m' || CAST(j AS STRING) || '#method' AS id
            FROM (SELECT p_partkey, p_size, p_partkey % ns AS k, {div("p_partkey", "ns")} AS j FROM part CROSS JOIN (SELECT count(*) AS ns FROM supplier) n) p JOIN classes c ON c.k = p.k""",
        "functions": f"""SELECT ck, path, path || ':' || name || '#function' AS id, name FROM (
            SELECT c_custkey AS ck, {_C_PATH} AS path, CASE WHEN c_custkey % 3 = 0 THEN 'test_c' ELSE 'c' END || CAST(c_custkey AS STRING) AS name FROM customer) t""",
        "symbols": f"""SELECT path || ':#module' AS id, path, '' AS qualname, 'module' AS kind, {span(1, 0, 1000000, 0)}, false AS is_stub, 'EXTRACTED' AS confidence, {_PROVENANCE} FROM modules
            UNION ALL SELECT id, path, 'S' || CAST(k AS STRING), 'class', {span("100 * k + 2", 0, "100 * k + 101", 0)}, false, 'EXTRACTED', {_PROVENANCE} FROM classes
            UNION ALL SELECT id, path, 'S' || CAST(k AS STRING) || '.m' || CAST(j AS STRING), 'method', {span("100 * k + 3 + 4 * j", 4, "100 * k + 6 + 4 * j", 20)}, p_size % 5 = 0,
                CASE WHEN p_size % 7 = 3 THEN 'INFERRED' WHEN p_size % 11 = 5 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END, {_PROVENANCE} FROM methods
            UNION ALL SELECT id, path, name, 'function', {span("10 * ck + 2", 0, "10 * ck + 8", 10)}, false, 'EXTRACTED', {_PROVENANCE} FROM functions""",
        "steps": """SELECT l_orderkey, l_linenumber, l_partkey, rf, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt
            FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS rf FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) t""",
        "edges": f"""SELECT a.id AS source, b.id AS target, 'calls' AS predicate, a.path AS site_file, l_orderkey + 1 AS l, l_linenumber AS c, min(CASE rf WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END) AS confidence
                FROM steps JOIN methods a ON a.pk = l_partkey JOIN methods b ON b.pk = nxt GROUP BY a.id, b.id, a.path, l_orderkey, l_linenumber
            UNION ALL SELECT DISTINCT f.id, m.id, 'calls', f.path, l_orderkey + 1, l_linenumber, 'EXTRACTED' FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN functions f ON f.ck = o_custkey JOIN methods m ON m.pk = l_partkey
            UNION ALL SELECT a.id, b.id, 'inherits', a.path, 100 * a.k + 2, 9, CASE WHEN a.k % 4 = 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END FROM classes a JOIN classes b ON b.k = {div("a.k", "2")} WHERE a.k > 0
            UNION ALL SELECT a.id, b.id, 'inherits', a.path, 100 * a.k + 2, 15, 'EXTRACTED' FROM (SELECT classes.*, (k * 7 + 3) % (SELECT count(*) FROM supplier) AS other FROM classes WHERE k % 5 = 2) a JOIN classes b ON b.k = a.other WHERE a.other <> a.k AND a.other <> {div("a.k", "2")}
            UNION ALL SELECT a.id, b.id, 'overrides', a.path, 100 * a.k + 3 + 4 * a.j, 4, 'EXTRACTED' FROM methods a JOIN methods b ON b.k = {div("a.k", "2")} AND b.j = a.j WHERE a.k > 0
            UNION ALL SELECT f.path || ':#module', CASE f.ck % 4 WHEN 0 THEN 'src.r' || CAST(n_regionkey AS STRING) || '.n' || CAST(n_nationkey AS STRING) WHEN 1 THEN 'r' || CAST(n_regionkey AS STRING) || '.n' || CAST(n_nationkey AS STRING)
                WHEN 2 THEN 'n' || CAST(n_nationkey AS STRING) || '.' || f.name ELSE 'ext.lib' || CAST(f.ck % 17 AS STRING) END, 'imports', f.path, f.ck + 1, 0, 'EXTRACTED'
                FROM functions f JOIN customer ON c_custkey = f.ck JOIN nation ON n_nationkey = (c_nationkey + c_custkey) % 25
            UNION ALL SELECT {_N_PATH} || ':#module', 'n' || CAST((n_nationkey * 3 + 1) % 25 AS STRING), 'imports', {_N_PATH}, 1, 0, 'EXTRACTED' FROM nation
            UNION ALL SELECT {_N_PATH} || ':#module', 'n' || CAST(n_nationkey AS STRING), 'imports', {_N_PATH}, 2, 0, 'EXTRACTED' FROM nation WHERE n_nationkey % 10 = 0
            UNION ALL SELECT {_N_PATH} || ':#module', 'os', 'imports', {_N_PATH}, 3, 0, 'EXTRACTED' FROM nation
            UNION ALL SELECT path || ':#module', id, 'defines', path, start_line, start_col, 'EXTRACTED' FROM symbols WHERE kind IN ('class', 'function')
            UNION ALL SELECT c.id, s.id, 'defines', s.path, s.start_line, s.start_col, 'EXTRACTED' FROM methods m JOIN symbols s ON s.id = m.id JOIN classes c ON c.k = m.k""",
        "relations": f"SELECT source, target, predicate, site_file, CAST(l AS INT) AS site_line, CAST(c AS INT) AS site_col, confidence, {_PROVENANCE} FROM edges",
        "history": "SELECT event_id AS history_id, CAST(user_id AS STRING) AS id, event_type AS content, 't' || lpad(CAST(event_id AS STRING), 12, '0') AS observed_at, event_type = 'error' AS tombstone FROM events",
        "edits": "SELECT 'w' || CAST(user_id % 20 AS STRING) AS key, CAST(event_id AS BIGINT) * 9000 + (user_id * 37) % 20000 AS at_ms, event_type, user_id, event_id FROM events",
    }


def ctes(last: str, spark_dialect: bool = False) -> str:
    """``name AS (...)`` of everything up to ``last``."""
    out = []
    for name, text in sql(spark_dialect).items():
        out.append(f"{name} AS {'MATERIALIZED ' if name in KEPT and not spark_dialect else ''}({text})")
        if name == last:
            break
    return ",\n".join(out)


_cache: dict[tuple[str, str, str], DataFrame] = {}


class Projection:
    """The projected tables of one data folder; each is written once for a session, like an index is."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str, keep: bool) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _cache:
            for t in TABLES:
                self.table(t).createOrReplaceTempView(t)
            df = self.spark.sql(f"WITH {ctes(name, True)} SELECT * FROM {name}")
            _cache[key] = written(df) if keep else df
        return _cache[key]

    @property
    def symbols(self) -> DataFrame:
        return self._sql("symbols", True)

    @property
    def relations(self) -> DataFrame:
        return self._sql("relations", True)

    @property
    def history(self) -> DataFrame:
        return self._sql("history", False)

    @property
    def edits(self) -> DataFrame:
        return self._sql("edits", False)

    def method_id(self, part: int = 0) -> str:
        return self._sql("methods", False).where(F.col("pk") == part).select("id").collect()[0]["id"]

    def sources(self) -> DataFrame:
        """Generated Python text: one file for each supplier, whose facts follow from the tables.

        Line 1 imports os, 2 a base and a function, 3 opens the class, then two lines for each method;
        at the end a function that refers to the class and calls itself.
        """
        parts, n = self.table("part").select("p_partkey", "p_size"), self.table("supplier").count()
        m = parts.select((F.col("p_partkey") % n).alias("k"), F.floor(F.col("p_partkey") / n).cast("long").alias("j"), (F.col("p_size") % 5 == 0).alias("empty"))
        m = m.join(m.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
        body = F.when(F.col("empty"), F.lit("        pass")).otherwise(F.concat(F.lit("        return helper(self.m"), ((F.col("j") + 1) % F.col("n")).cast("string"), F.lit("())")))
        lines = m.withColumn("line", F.concat(F.lit("    def m"), F.col("j").cast("string"), F.lit("(self):\n"), body))
        whole = lines.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda x: x["line"]), "\n").alias("body"))
        k, base = F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, F.lit("Protocol")).otherwise(F.concat(F.lit("Base"), (F.col("k") % 3).cast("string")))
        text = F.concat(F.lit("import os\nfrom ext.base import "), base, F.lit(", helper\nclass S"), k, F.lit("("), base, F.lit("):\n"), F.col("body"), F.lit("\ndef f"), k, F.lit("():\n    x = S"), k, F.lit("\n    return f"), k, F.lit("()\n"))
        return whole.select(F.concat(F.lit("gen/s"), k, F.lit(".py")).alias("path"), text.alias("source"))
