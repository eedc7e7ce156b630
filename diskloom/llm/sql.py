"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import language_id as lid
from . import sharding as sh


def language_id() -> str:
    return f"""
    WITH clean AS (
      SELECT doc_id, text, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '') AS c
      FROM (SELECT *, row_number() OVER () AS rid FROM documents)
    ), numbered AS (SELECT *, row_number() OVER () AS rid FROM clean),
    places AS (SELECT rid, c, unnest(range(1, len(c) + 1)) AS i FROM numbered WHERE text IS NOT NULL),
    grams AS (
      SELECT rid, unnest([c[i],
        CASE WHEN i < len(c) AND (c[i] <> ' ' OR c[i + 1] <> ' ') THEN c[i] || c[i + 1] END,
        CASE WHEN i + 1 < len(c) AND c[i + 1] <> ' ' THEN c[i] || c[i + 1] || c[i + 2] END]) AS g FROM places
    ), counted AS (SELECT rid, g, count(*) AS n FROM grams WHERE g IS NOT NULL AND g <> ' ' GROUP BY ALL),
    sampled AS (
      SELECT rid, lang FROM numbered WHERE lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) <= {lid.SAMPLE}
    ), profile AS (
      SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r
      FROM (SELECT lang, g, sum(n) AS n FROM counted JOIN sampled USING (rid) GROUP BY ALL)
      QUALIFY r <= {lid.PROFILE}
    ), ranked AS (
      SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) AS r FROM counted QUALIFY r <= {lid.PROFILE}
    ), langs AS (SELECT DISTINCT lang FROM profile),
    far AS (
      SELECT ranked.rid, langs.lang, sum(coalesce(abs(profile.r - ranked.r), {lid.PROFILE}))::BIGINT AS d, count(*) * {lid.PROFILE} AS worst
      FROM ranked CROSS JOIN langs LEFT JOIN profile ON profile.lang = langs.lang AND profile.g = ranked.g GROUP BY ALL
    ), best AS (SELECT rid, lang, d, worst FROM far QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, lang) = 1)
    SELECT doc_id, best.lang AS language, d AS distance, coalesce(worst, 0)::BIGINT AS worst,
           coalesce(d * 100 <= worst * {lid.ACCEPT}, false) AS accepted
    FROM numbered LEFT JOIN best USING (rid)
    """


def sharding() -> str:
    def best(weights: dict[int, float]) -> str:
        rows = ", ".join(f"({k}, {float(w)})" for k, w in sorted(weights.items()))
        return f"""SELECT rid, arg_max(k, [s, -k]) AS shard FROM (
          SELECT rid, k, -w / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || '#' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS s
          FROM keyed CROSS JOIN (VALUES {rows}) AS shards(k, w)) GROUP BY rid"""

    return f"""
    WITH keyed AS (SELECT doc_id, row_number() OVER () AS rid FROM documents),
    a AS ({best(sh.WEIGHTS)}), b AS ({best(sh.GROWN)})
    SELECT doc_id, a.shard::INTEGER AS shard, b.shard::INTEGER AS shard_after, a.shard <> b.shard AS moved
    FROM keyed JOIN a USING (rid) JOIN b USING (rid)
    """
