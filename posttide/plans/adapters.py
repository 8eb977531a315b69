"""The given tables in the roles the jobs read: posts, gazetteer, labelled posts, training texts.

The tables hold no posts, so text, counters and places are derived from them row
by row. The SQL is plain enough to mean the same in Spark and DuckDB; `{name}`
stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTS = """
SELECT doc_id AS row_key, source AS file, doc_id AS pos,
  CASE doc_id % 9
    WHEN 0 THEN concat('town_', doc_id % 37, ', NATION_', doc_id * 7 % 25)
    WHEN 1 THEN concat('nation_', doc_id * 7 % 25)
    WHEN 2 THEN concat('Town_', doc_id % 37)
    WHEN 3 THEN concat('town_', doc_id % 37)
    WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'asia,' ELSE 'europe' END
    WHEN 5 THEN NULL
    WHEN 6 THEN concat('s.', doc_id % 37, ', town_', doc_id % 37, ', AMERICA')
    WHEN 7 THEN concat(' sup.plier', doc_id % 300, ' ')
    ELSE concat('x, town_', doc_id % 37, ' , NATION_', doc_id * 7 % 25, ', EUROPE')
  END AS location,
  CASE WHEN source = 'src7' THEN 'no date'
    WHEN doc_id % 13 = 0 THEN 'not a date'
    WHEN doc_id % 13 = 1 THEN NULL
    ELSE concat(CASE WHEN doc_id % 14 < 10 THEN 2022 ELSE 2023 END, '-',
                lpad(CAST(CASE WHEN doc_id % 14 < 10 THEN doc_id % 14 + 3 ELSE doc_id % 14 - 9 END
                          AS STRING), 2, '0'), '-',
                lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), ' 10:20:30',
                CASE WHEN doc_id % 2 = 0 THEN '.250' ELSE '' END)
  END AS tweetcreatedts,
  concat(text, ' https://t.co/', doc_id, ' #tag', doc_id % 7, ' @user', doc_id % 5,
         ' 😀 :) ', doc_id % 100, ' &amp; Cannot wars') AS text,
  replace(CASE doc_id % 11
    WHEN 0 THEN '[]'
    WHEN 1 THEN concat('[{{"text": "it', chr(39), 's"}}]')
    WHEN 2 THEN NULL
    WHEN 3 THEN ''
    WHEN 4 THEN '[{{"text": "a"}}] tail'
    WHEN 5 THEN '{{"text": "a"}}'
    WHEN 6 THEN '[{{"x": 1}}]'
    WHEN 7 THEN concat('[{{"text": "tag', doc_id % 7, '", "indices": [0, 4]}}, {{"text": "second"}}]')
    WHEN 8 THEN CASE doc_id % 5 WHEN 0 THEN '{{}}' WHEN 1 THEN '[{{"text": "a"}}] [1]' WHEN 2 THEN '[{{"text": "a"}}, {{}}]'
                                WHEN 3 THEN '[{{"text": "a"}}]]' ELSE ' [ ] ' END
    ELSE concat('[{{"text": "tag', doc_id % 7, '", "indices": [0, 4]}}]')
  END, '"', chr(39)) AS hashtags,
  CASE WHEN doc_id % 17 = 0 THEN 'x' WHEN doc_id % 17 = 1 THEN NULL
       ELSE CAST(n_chars % 1000 AS STRING) END AS following,
  CAST(doc_id * 31 % 2000 AS STRING) AS followers,
  CAST(n_chars AS STRING) AS totaltweets,
  CASE WHEN doc_id % 19 = 0 THEN '5.0' ELSE CAST(doc_id % 50 AS STRING) END AS retweetcount,
  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 23 = 1 THEN ' 12 '
       ELSE CAST(doc_id % 70 AS STRING) END AS favorite_count,
  lang AS language
FROM {documents}
"""

GAZETTEER = """
SELECT
  CASE WHEN s_suppkey % 3 = 0 THEN concat('Supplier', s_suppkey)
       ELSE concat('Town_', s_suppkey % 37) END AS city_name,
  CAST(s_suppkey % 180 AS DOUBLE) - 90 AS city_latitude,
  CAST(s_suppkey * 7 % 360 AS DOUBLE) - 180 AS city_longitude,
  CASE WHEN n_nationkey = 3 THEN NULL ELSE concat('S', n_nationkey) END AS state_code,
  n_name AS state_name,
  CAST(n_nationkey AS DOUBLE) + 0.5e0 AS state_latitude,
  CAST(n_nationkey AS DOUBLE) - 0.5e0 AS state_longitude,
  concat('R', r_regionkey) AS country_code,
  r_name AS country_name,
  CAST(r_regionkey AS DOUBLE) * 10 AS country_latitude,
  CAST(r_regionkey AS DOUBLE) * -10 AS country_longitude,
  s_suppkey AS row_id
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

PLACES = """
SELECT s_name AS city_name, CAST(s_suppkey % 180 AS DOUBLE) - 90 AS city_latitude,
  CAST(s_suppkey * 7 % 360 AS DOUBLE) - 180 AS city_longitude,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS state_name, r_name AS country_name,
  s_suppkey AS row_id
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

STATES = """
SELECT CASE WHEN n_nationkey % 10 = 0 THEN NULL ELSE n_name END AS state_name,
  concat('S', n_nationkey) AS state_code,
  CAST(n_nationkey AS DOUBLE) + 0.5e0 AS state_latitude,
  CAST(n_nationkey AS DOUBLE) - 0.5e0 AS state_longitude,
  concat('R', r_regionkey) AS country_code, r_name AS country_name,
  CAST(r_regionkey AS DOUBLE) * 10 AS country_latitude,
  CAST(r_regionkey AS DOUBLE) * -10 AS country_longitude
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

LABELLED = """
SELECT o_orderkey AS id, n_name AS country, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
  replace(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7), '-', '_') AS year_month,
  CASE WHEN o_orderstatus = 'P' AND n_nationkey % 4 = 0 THEN NULL
       WHEN o_orderkey % 1000003 * 7919 % 1000 < 650 + 8 * n_nationkey THEN 'POSITIVE'
       ELSE 'NEGATIVE' END AS sentiment,
  CASE WHEN o_orderstatus = 'P' AND n_nationkey % 4 = 0 THEN NULL
       ELSE 0.5e0 + CAST(o_orderkey % 1000003 * 7919 % 5000 AS DOUBLE) / 10000e0
  END AS sentiment_score
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

TRAINING = """
SELECT concat('', d.doc_id) AS textID, d.text AS text, d.text AS selected_text,
  CASE WHEN d.doc_id % 10 = 0 THEN 'neutral' WHEN d.doc_id % 10 = 1 THEN NULL
       WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

TABLES = {
    "documents", "labels", "supplier", "nation", "region", "orders", "customer",
}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table that may lie in a single file to all tasks."""
    return df.repartition(key)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter's rows, from the Parquet tables in `sf_dir`."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if "documents" in used:
        used["documents"] = spread(used["documents"], "doc_id")
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same text over tables that are registered by name."""
    return sql.format(**{t: t for t in TABLES}).strip()
