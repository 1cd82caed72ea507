"""Oracle SQL for near-duplicate queries: brute force on the whole table."""

from __future__ import annotations

from tidesift.functions import text as tx
from tidesift.plans.registry import first_wins_sql, place

SHINGLE_SQL = f"""
texts AS (
  SELECT min(doc_id) AS uid, s FROM (
    SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '{tx.WS}+', ' ', 'g')) AS s FROM documents)
  GROUP BY s),
shingles AS (
  SELECT uid, unnest(list_distinct(CASE WHEN s = '' THEN [] WHEN length(s) <= 5 THEN [s]
    ELSE list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)) END)) AS g FROM texts),
sizes AS (SELECT uid, count(*) AS n FROM shingles GROUP BY uid),
common AS (
  SELECT a.uid AS src, b.uid AS dst, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.uid < b.uid GROUP BY ALL),
jaccard AS (
  SELECT src, dst, CAST(n_both AS DOUBLE) / (x.n + y.n - n_both) AS jaccard
  FROM common JOIN sizes x ON src = x.uid JOIN sizes y ON dst = y.uid)"""

JACCARD_SQL = f"WITH {SHINGLE_SQL} SELECT src, dst, round(jaccard, 6) AS jaccard FROM jaccard WHERE jaccard >= 0.8"

MINHASH_DEDUP_SQL = f"""WITH RECURSIVE {SHINGLE_SQL},
edges AS (SELECT src, dst FROM jaccard WHERE jaccard >= 0.8),
{first_wins_sql('edges', 'lost')}
SELECT uid FROM texts WHERE uid NOT IN (SELECT uid FROM lost)"""

BAG_SQL = f"""
tokens AS (SELECT doc_id AS uid, regexp_extract_all(lower(coalesce(text, '')), '{tx.WORD}{{2,}}') AS w FROM documents),
bags AS (
  SELECT min(uid) AS uid, any_value(g) AS g FROM (
    SELECT uid, list_sort(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM tokens)
  WHERE len(g) > 0 GROUP BY g),
counts AS (SELECT uid, gram, count(*) AS n FROM (SELECT uid, unnest(g) AS gram FROM bags) GROUP BY ALL),
norms AS (SELECT uid, sum(n * n) AS q FROM counts GROUP BY uid),
products AS (
  SELECT a.uid AS src, b.uid AS dst, sum(a.n * b.n) AS top
  FROM counts a JOIN counts b ON a.gram = b.gram AND a.uid < b.uid GROUP BY ALL),
cosines AS (
  SELECT src, dst, CAST(top AS DOUBLE) / sqrt(CAST(x.q * y.q AS DOUBLE)) AS cosine
  FROM products JOIN norms x ON src = x.uid JOIN norms y ON dst = y.uid)"""

NGRAM_SQL = f"WITH {BAG_SQL} SELECT src, dst, round(cosine, 6) AS cosine FROM cosines WHERE cosine > 0.75"

NGRAM_DEDUP_SQL = f"""WITH RECURSIVE {BAG_SQL},
edges AS (SELECT src, dst FROM cosines WHERE cosine > 0.75),
{first_wins_sql('edges', 'lost')}
SELECT uid FROM tokens WHERE len(w) = 0
UNION ALL SELECT uid FROM bags WHERE uid NOT IN (SELECT uid FROM lost)"""

UNIT_SQL = """
raw AS (SELECT vec_id AS uid, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
unit AS (SELECT uid, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM raw)"""

# Inverted lists with nlist = int(4 sqrt(n)) hash-drawn centroids, rebuilt row by row.
CELL_SQL = f"""{UNIT_SQL},
centers AS (
  SELECT i - 1 AS cell, v FROM (SELECT v, {place()} AS i FROM unit)
  WHERE i <= (SELECT CAST(floor(4 * sqrt(count(*))) AS BIGINT) FROM unit)),
near AS (
  SELECT uid, cell, row_number() OVER (
    PARTITION BY uid ORDER BY round(list_inner_product(unit.v, centers.v), 9) DESC, cell) AS n
  FROM unit, centers)"""

# A full scan: every pair of vectors.
SCAN_SQL = f"""{UNIT_SQL},
hits AS (SELECT x.uid AS src, y.uid AS dst, round(list_inner_product(x.v, y.v), 9) AS score FROM unit x, unit y)"""

RADIUS_SQL = f"WITH {SCAN_SQL} SELECT src, dst, round(score, 6) AS score FROM hits WHERE src < dst AND score > 0.35"

RADIUS_DEDUP_SQL = f"""WITH RECURSIVE {SCAN_SQL},
edges AS (SELECT src, dst FROM hits WHERE src < dst AND score > 0.35),
{first_wins_sql('edges', 'lost')}
SELECT uid FROM unit WHERE uid NOT IN (SELECT uid FROM lost)"""

KNN_SQL = f"""{SCAN_SQL},
lists AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM hits),
knn AS (SELECT src, dst, score FROM lists WHERE n <= 5 AND src < dst)"""

KNN_PAIRS_SQL = f"WITH {KNN_SQL} SELECT src, dst, round(score, 6) AS score FROM knn WHERE score >= 0.35"

KNN_DEDUP_SQL = f"""WITH RECURSIVE {KNN_SQL},
edges AS (SELECT src, dst FROM knn WHERE score >= 0.35),
{first_wins_sql('edges', 'lost')}
SELECT uid FROM unit WHERE uid NOT IN (SELECT uid FROM lost)"""

SWEEP_LEVELS = (0.35, 0.4, 0.45)

SWEEP_SQL = (
    f"WITH RECURSIVE {KNN_SQL},"
    + ",".join(
        f"edges_{i} AS (SELECT src, dst FROM knn WHERE score >= {level}), {first_wins_sql(f'edges_{i}', f'lost_{i}')}"
        for i, level in enumerate(SWEEP_LEVELS)
    )
    + " UNION ALL ".join(
        f" SELECT CAST({level} AS DOUBLE) AS threshold, uid FROM unit WHERE uid NOT IN (SELECT uid FROM lost_{i})"
        for i, level in enumerate(SWEEP_LEVELS)
    )
)

# Queries are the mean vectors of the labels.
CENTROID_SQL = f"""{UNIT_SQL},
cells AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM raw),
means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL),
query AS (SELECT CAST(label AS BIGINT) AS query, list(x ORDER BY i) AS q FROM means GROUP BY label),
scores AS (
  SELECT query, uid, round(list_inner_product(q, v) / sqrt(list_inner_product(q, q)), 9) AS score FROM query, unit)"""

SEARCH_K_SQL = f"""WITH {CENTROID_SQL} SELECT query, uid, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uid) AS n FROM scores) WHERE n <= 3"""

SEARCH_RADIUS_SQL = f"WITH {CENTROID_SQL} SELECT query, uid, round(score, 6) AS score FROM scores WHERE score > 0.3"

COSINE_SQL = f"""WITH {CENTROID_SQL}
SELECT uid, label, round(score, 6) AS cosine, round(score, 6) AS cosine_by_distance, round(2 - 2 * score, 6) AS squared_distance
FROM scores JOIN unit USING (uid) WHERE CAST(label AS BIGINT) = query"""
