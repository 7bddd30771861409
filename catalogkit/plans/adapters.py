"""The given tables seen as a catalogue.

Each view is one SQL text that Spark and the oracle's engine both read; ``{array}`` stands for the
engine's array constructor and ``{name}`` for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

VIEWS: dict[str, str] = {
    # items with messy codes and gaps of every kind
    "items": """
        SELECT p.p_partkey AS k,
               CASE p.p_partkey % 3 WHEN 0 THEN concat(lower(p.p_type), lpad(CAST(p.p_partkey AS STRING), 5, '0'))
                    WHEN 1 THEN concat(p.p_type, '-', lpad(CAST(p.p_partkey AS STRING), 5, '0'))
                    ELSE concat(' ', p.p_type, '_', lpad(CAST(p.p_partkey AS STRING), 5, '0')) END AS raw,
               concat(p.p_type, '-', CAST(p.p_partkey AS STRING)) AS code,
               CASE WHEN p.p_partkey % 7 = 0 THEN NULL WHEN p.p_partkey % 11 = 0 THEN '' WHEN p.p_partkey % 13 = 0 THEN 'n/a'
                    WHEN p.p_partkey % 17 = 0 THEN '  ' ELSE p.p_name END AS title,
               CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE l.d END AS date,
               CASE WHEN p.p_partkey % 9 = 0 THEN NULL WHEN p.p_partkey % 10 = 0 THEN '' ELSE concat('Supplier#', lpad(CAST(l.lo AS STRING), 9, '0')) END AS owner,
               {array}(concat('Supplier#', lpad(CAST(CASE WHEN p.p_partkey % 4 = 1 THEN l.hi ELSE l.lo END AS STRING), 9, '0')),
                       concat('Supplier#', lpad(CAST(l.hi AS STRING), 9, '0'))) AS members,
               CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE p.p_brand END AS maker, p.p_type AS label,
               CASE WHEN p.p_partkey % 12 = 0 THEN p.p_type ELSE p.p_brand END AS series,
               CASE WHEN p.p_partkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p.p_size AS DOUBLE) END AS rating,
               p.p_size * 3 AS duration, split(p.p_name, ' ') AS tags,
               CASE WHEN p.p_partkey % 8 = 0 THEN '' ELSE concat('https://img.example.com/', CASE WHEN p.p_size % 3 = 0 THEN 'a/b' ELSE 'v' END, '/7',
                    lower(p.p_type), lpad(CAST(p.p_partkey AS STRING), 5, '0'), '/xpl.jpg') END AS cover,
               CASE p.p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pending' ELSE 'alpha' END AS source
        FROM {part} p LEFT JOIN (
            SELECT l_partkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi, CAST(CAST(min(l_shipdate) AS DATE) AS STRING) AS d FROM {lineitem} GROUP BY l_partkey
        ) l ON l.l_partkey = p.p_partkey
    """,
    # what three sources say about the same items, with gaps of their own
    "observations": """
        SELECT concat(p_type, '-', CAST(p_partkey AS STRING)) AS code, 'alpha' AS source, 1 AS priority,
               CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE concat('A ', p_name) END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS maker, CAST(NULL AS STRING) AS date
        FROM {part} UNION ALL
        SELECT concat(p_type, '-', CAST(p_partkey AS STRING)), 'beta', 2, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE concat('B ', p_name) END,
               CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE concat('b-', p_brand) END, CASE WHEN p_partkey % 7 <> 0 THEN '2001-02-03' END
        FROM {part} UNION ALL
        SELECT concat(p_type, '-', CAST(p_partkey AS STRING)), 'gamma', 3, concat('C ', p_name), concat('c-', p_brand), '2004-05-06' FROM {part} WHERE p_partkey % 11 <> 0
    """,
    "profiles": """
        SELECT s.s_name AS name, CASE WHEN s.s_suppkey % 6 = 0 THEN NULL ELSE n.n_name END AS team, CASE WHEN s.s_suppkey % 3 = 0 THEN '' ELSE concat('https://p.example.com/', CAST(s.s_suppkey AS STRING)) END AS avatar,
               CASE WHEN s.s_suppkey % 7 = 0 THEN 'A retired maker' ELSE 'A maker' END AS lead
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey WHERE s.s_suppkey % 10 <> 9
    """,
    # supplier k lists suppliers 2k and 3k, so clusters overlap
    "edges": """
        SELECT a.s_name AS canonical, b.s_name AS alias FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey * 2 WHERE a.s_suppkey > 0
        UNION SELECT a.s_name, b.s_name FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey * 3 WHERE a.s_suppkey > 0
    """,
    "curated": "SELECT s_name AS name FROM {supplier} WHERE s_suppkey % 4 <> 3",
    # what customers of a nation call its region, with noise
    "pairs": """
        SELECT concat('C-', CAST(c.c_custkey AS STRING)) AS code, concat(' ', n.n_name, '  x ') AS src_raw,
               CASE WHEN c.c_custkey % (c.c_nationkey + 3) = 0 THEN 'ELSEWHERE' ELSE r.r_name END AS dst_value
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
    """,
    # words of part names as a dictionary from two sources that differ
    "dictionary": """
        SELECT source, file_ord, row_ord, id, url, ja, zh_cn, zh_tw, en, translate, note FROM (
            SELECT 'one' AS source, 0 AS file_ord, min(p_partkey) AS row_ord, CAST(min(p_partkey) AS STRING) AS id, '' AS url, w AS ja,
                   CASE WHEN min(p_partkey) % 2 = 0 THEN concat(w, '-1') ELSE '' END AS zh_cn, '' AS zh_tw, upper(w) AS en, '' AS translate, concat('n', CAST(min(p_partkey) AS STRING)) AS note
            FROM (SELECT p_partkey, split(p_name, ' ')[{first}] AS w FROM {part}) x GROUP BY w
            UNION ALL
            SELECT 'two', 1, min(p_partkey), CAST(-min(p_partkey) AS STRING), 'u', w, concat(w, '-2'), concat(w, '-t'), '', '', 'seen'
            FROM (SELECT p_partkey, split(p_name, ' ')[{first}] AS w FROM {part}) y WHERE w <> 'red' GROUP BY w
        ) z
    """,
    "files": """
        SELECT concat('folder', CAST(p_partkey % 5 AS STRING)) AS parent, CAST(p_partkey AS STRING) AS fid,
               concat(CASE WHEN p_partkey % 4 = 0 THEN '2020-01-02 ' ELSE '' END, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' END,
                      lpad(CAST(CASE WHEN p_partkey % 50 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING), 5, '0'), CASE WHEN p_partkey % 5 = 0 THEN concat(' ', p_name) ELSE '' END,
                      CASE WHEN p_partkey % 6 = 0 THEN '_4K60fps' WHEN p_partkey % 6 = 1 THEN '_4Ks2' WHEN p_partkey % 6 = 2 THEN '[8K]' ELSE '' END,
                      CASE WHEN p_partkey % 7 = 0 THEN '.part2' WHEN p_partkey % 7 = 1 THEN ' (3)' ELSE '' END, CASE p_partkey % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.txt' ELSE '.mp4' END) AS fn
        FROM {part} UNION ALL
        SELECT concat('folder', CAST(p_partkey % 5 AS STRING)), concat('again', CAST(p_partkey AS STRING)), concat(p_type, CASE WHEN p_size > 40 THEN '_' ELSE '-' END, lpad(CAST(p_partkey AS STRING), 5, '0'), '.mp4')
        FROM {part} WHERE p_size > 30 UNION ALL
        SELECT concat('folder', CAST(p_partkey % 5 AS STRING)), concat('twice', CAST(p_partkey AS STRING)), concat(p_type, '-', lpad(CAST(p_partkey AS STRING), 5, '0'), '.mp4')
        FROM {part} WHERE p_size > 35
    """,
}

#: the tables that each view reads
USES = {
    "items": ("part", "lineitem"), "observations": ("part",), "profiles": ("supplier", "nation"), "edges": ("supplier",), "curated": ("supplier",),
    "pairs": ("customer", "nation", "region"), "dictionary": ("part",), "files": ("part",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in USES[name]}
    return spark.sql(VIEWS[name].format(array="array", first=0, **{t: "{" + t + "}" for t in TABLES}), **tables)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all cores: a small file is one task, however much work each of its rows is."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def oracle_views(*names: str) -> str:
    """A WITH clause for the oracle's engine, whose arrays start at 1."""
    parts = [f"{n} AS ({VIEWS[n].format(array='list_value', first=1, **{t: t for t in TABLES})})" for n in names]
    return "WITH " + ",\n".join(parts)
