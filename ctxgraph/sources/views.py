"""The engine's tables as views of a star schema's tables.

The engine is generic over files, nodes, edges, refs, observations, sessions and
activity.  Here they are views over the tables of a data folder, each one SQL
statement that Spark and an ANSI engine read alike: for Spark the braces become
DataFrames, for the other engine names of common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_files": """
SELECT doc_id AS id, concat(source, '/', lang, '/doc', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, lang AS language,
       md5(text) AS content_hash, n_chars AS size_bytes, text AS content
FROM {documents}""",
    "v_nodes": """
SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, CAST(1 AS BIGINT) AS file_id, 'module' AS kind, r_name AS name,
       concat('region::', r_name) AS qualified_name, CAST(NULL AS VARCHAR(200)) AS signature,
       CAST(1 + 10 * r_regionkey AS BIGINT) AS line_start, CAST(10 + 10 * r_regionkey AS BIGINT) AS line_end,
       'pub' AS visibility, TRUE AS is_export FROM {region}
UNION ALL
SELECT CAST(2000000 + n_nationkey AS BIGINT), CAST(2 + n_regionkey AS BIGINT), 'class', n_name, concat('nation::', n_name), CAST(NULL AS VARCHAR(200)),
       CAST(1 + 8 * n_nationkey AS BIGINT), CAST(12 + 8 * n_nationkey AS BIGINT), 'public', FALSE FROM {nation}
UNION ALL
SELECT 3000000 + s_suppkey, s_suppkey % 50, 'struct', s_name, concat('supplier::', s_name), concat('struct ', s_name),
       1 + s_suppkey * 3, 9 + s_suppkey * 3, CASE WHEN s_acctbal < 0 THEN 'private' ELSE 'pub' END, s_acctbal >= 0 FROM {supplier}
UNION ALL
SELECT 4000000 + p_partkey, CAST(p_size AS BIGINT), 'function', p_name, concat(p_brand, '::', p_name), concat('fn ', p_name, '(', p_type, ')'),
       1 + p_partkey % 400, 1 + p_partkey % 400 + CAST(p_size AS BIGINT), CAST(NULL AS VARCHAR(20)), p_retailprice > 1000 FROM {part}""",
    "v_edges": """
SELECT CAST(2000000 + n_nationkey AS BIGINT) AS source_node_id, CAST(1000000 + n_regionkey AS BIGINT) AS target_node_id,
       'contains' AS kind, CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR(20)) AS context FROM {nation}
UNION ALL
SELECT 3000000 + s_suppkey, CAST(2000000 + s_nationkey AS BIGINT), 'type_ref', CAST(0.9 AS DOUBLE), CAST(NULL AS VARCHAR(20)) FROM {supplier}
UNION ALL
SELECT CASE WHEN l_linestatus = 'O' THEN 3000000 + l_suppkey ELSE 4000000 + l_partkey END,
       CASE WHEN l_linestatus = 'O' THEN 4000000 + l_partkey ELSE 3000000 + l_suppkey END,
       CASE WHEN l_linestatus = 'O' THEN 'calls' ELSE 'imports' END,
       CASE WHEN l_linestatus = 'O' THEN CAST(0.95 AS DOUBLE) - l_discount ELSE CAST(0.95 AS DOUBLE) END,
       CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'R' THEN 'loop' WHEN l_returnflag = 'A' THEN 'conditional' END END
FROM {lineitem}""",
    "v_refs": """
SELECT (l.l_orderkey * 10 + l.l_linenumber) * 97 + l.nth AS id, 3000000 + l.l_suppkey AS source_node_id, p.p_name AS target_name,
       CASE WHEN l.l_linestatus = 'O' THEN 'calls' ELSE 'type_ref' END AS edge_kind, concat('./', p.p_brand) AS import_path
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_linestatus) AS nth FROM {lineitem}) l
JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "v_obs": """
SELECT conv_id * 100 + turn AS id, conv_id AS session_id, text AS content, role AS headline,
       TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '1' MINUTE) * CAST(conv_id * 60 + turn * 2 AS INT) AS created_at, turn % 5 = 4 AS is_stale
FROM {conversations}""",
    "v_sessions": "SELECT session_id AS id, min(created_at) AS created_at, max(created_at) AS updated_at FROM {v_obs} GROUP BY session_id",
    "v_activity": "SELECT event_id AS observation_id, user_id AS session_id, ts AS created_at, event_type, CAST(floor(value) AS BIGINT) AS file_id FROM {events}",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """``Views(spark, folder).v_nodes`` and so on; base tables by their names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            made = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in _names(VIEWS[name])})
        elif name in TABLES:
            made = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        else:
            raise AttributeError(name)
        self.__dict__[name] = made
        return made


def with_views(sql: str) -> str:
    """``sql`` over the views as one statement: those it names, and what they
    name, become common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\bv_\w+", text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    if not need:
        return sql
    bodies = ",\n".join(f"{n} AS ({VIEWS[n].format(**{x: x for x in _names(VIEWS[n])})})" for n in need)
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ", ", sql, count=1) if re.match(r"\s*WITH\b", sql) else sql
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\b", sql) else ""
    return f"WITH {recursive}{bodies}\n{rest}"
