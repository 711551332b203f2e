"""The fleet of talks that the queries run over, derived from the driver's tables by plain SQL that Spark and DuckDB share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """
SELECT conv_id AS project_id, turn, concat('s', lpad(CAST(turn + 1 AS STRING), 4, '0')) AS segment_id,
 cum - dur_ms AS start_ms, cum AS end_ms, text
FROM (SELECT conv_id, turn, text, dur_ms, CAST(SUM(gap_ms + dur_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cum
 FROM (SELECT conv_id, turn, text, CAST(600 + (length(text) * 37) % 9000 AS BIGINT) AS dur_ms,
  CAST((conv_id * 7919 + turn * 104729) % 2500 AS BIGINT) AS gap_ms FROM {conversations}) a) b
"""
PROJECTS = """
SELECT project_id, CAST(MAX(end_ms) + 1000 + (project_id * 31) % 2000 AS BIGINT) AS duration_ms,
 CASE WHEN project_id % 2 = 0 THEN '25/1' ELSE '30000/1001' END AS fps FROM {segments} GROUP BY project_id
"""
REGIONS = """
SELECT project_id, CASE WHEN (project_id + turn) % 7 = 3 THEN start_ms + 400 ELSE start_ms END AS start_ms,
 CASE WHEN end_ms - start_ms >= 3000 THEN start_ms + CAST(floor((end_ms - start_ms) * 0.4) AS BIGINT) ELSE end_ms END AS end_ms
FROM {segments} WHERE (project_id + turn) % 11 <> 0
UNION ALL
SELECT project_id, start_ms + CAST(floor((end_ms - start_ms) * 0.6) AS BIGINT), end_ms
FROM {segments} WHERE (project_id + turn) % 11 <> 0 AND end_ms - start_ms >= 3000
"""
CUTS = """
SELECT project_id, concat('c', lpad(CAST(rn AS STRING), 4, '0')) AS cut_id, start_ms, end_ms, reason, status FROM (
 SELECT project_id, start_ms, end_ms, reason,
  CASE WHEN k % 5 = 0 THEN 'rejected' WHEN k % 5 = 1 THEN 'proposed' ELSE 'approved' END AS status,
  row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms, reason) AS rn FROM (
  SELECT project_id, turn + project_id AS k, start_ms - 300 - (turn * 53) % 200 AS start_ms, start_ms - 20 AS end_ms, 'silence' AS reason
   FROM {segments} WHERE turn > 0
  UNION ALL SELECT project_id, turn + project_id + 1, start_ms, end_ms + 10, 'manual' FROM {segments} WHERE (project_id + turn) % 13 = 5
  UNION ALL SELECT project_id, turn + project_id + 2, start_ms - 100, start_ms + 250, 'filler'
   FROM {segments} WHERE turn > 0 AND (project_id * 3 + turn) % 6 = 1) u ) w
"""
CANDIDATES = """
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_ms, end_ms) - 1 AS BIGINT) AS ord, start_ms, end_ms, 'silence' AS reason,
 CAST(0.95 AS DOUBLE) AS confidence, 'approved' AS status
FROM (SELECT project_id, start_ms - 280 + (project_id % 7) * 40 AS start_ms, start_ms - 20 + (project_id % 7) * 40 AS end_ms
 FROM {segments} WHERE turn > 0 AND (project_id + turn) % 4 <> 2) x
"""
PATCHES = """
SELECT project_id, segment_id, CAST(turn AS BIGINT) AS ord, concat(text, ' (fixed)') AS text FROM {segments} WHERE (project_id * 5 + turn) % 9 = 0
UNION ALL SELECT project_id, 's9999', CAST(100 AS BIGINT), 'nobody' FROM {projects} WHERE project_id % 5 = 2
UNION ALL SELECT project_id, segment_id, CAST(101 AS BIGINT), 'again' FROM {segments} WHERE project_id % 5 = 3 AND (project_id * 5 + turn) % 9 = 0
"""
TELOPS = """
SELECT project_id, CAST(turn AS BIGINT) AS idx, concat('telop ', segment_id) AS text,
 CASE WHEN project_id % 10 = 4 AND turn = 1 THEN 'missing' WHEN turn % 2 = 0 THEN 'default' ELSE 'emphasis' END AS style_preset,
 CASE WHEN turn % 4 = 1 THEN segment_id END AS segment_id, CASE WHEN turn % 4 <> 1 THEN start_ms + 100 END AS start_ms,
 CASE WHEN turn % 4 <> 1 THEN CAST(1500 AS BIGINT) END AS duration_ms
FROM {segments} WHERE turn % 4 = 1 OR turn % 6 = 2
"""
#: (name, reading order, SQL); every later table may read the earlier ones.
TABLES = {
    "segments": SEGMENTS, "projects": PROJECTS, "speech_regions": REGIONS, "cuts": CUTS, "candidates": CANDIDATES, "patches": PATCHES, "telops": TELOPS,
}
_NAMES = {"conversations": "conversations", **{k: k for k in TABLES}}


def oracle(sql: str) -> str:
    """The SQL with the fleet's tables in front, for an engine that has the driver's tables as views."""
    ctes = ",\n".join(f"{name} AS ({text.format(**_NAMES)})" for name, text in TABLES.items())
    return f"WITH {ctes}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"


@dataclass(frozen=True)
class Fleet:
    """The fleet's tables as lazy DataFrames."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @cached_property
    def segments(self) -> DataFrame:
        return self.sql(SEGMENTS, conversations=self.table("conversations"))

    @cached_property
    def projects(self) -> DataFrame:
        return self.sql(PROJECTS, segments=self.segments)

    @cached_property
    def regions(self) -> DataFrame:
        return self.sql(REGIONS, segments=self.segments)

    @cached_property
    def cuts(self) -> DataFrame:
        return self.sql(CUTS, segments=self.segments)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.sql(CANDIDATES, segments=self.segments)

    @cached_property
    def patches(self) -> DataFrame:
        return self.sql(PATCHES, segments=self.segments, projects=self.projects)

    @cached_property
    def telops(self) -> DataFrame:
        return self.sql(TELOPS, segments=self.segments)
