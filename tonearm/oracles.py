"""The registered queries in SQL over the same tables, written on their own as a check."""

from __future__ import annotations

from tonearm import schemas


def _values(rows: list[tuple]) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


VIEWS = f"""
WITH buckets(bucket, bucket_no) AS (VALUES {_values([(b, i) for i, b in enumerate(schemas.BUCKETS)])}),
rules(priority, keyword, bucket) AS (VALUES {_values(schemas.RULE_ROWS)}),
vocab(v, genre) AS (VALUES {_values(list(enumerate(schemas.VOCAB)))}),
members AS (SELECT *, o_custkey AS user_id FROM orders UNION ALL SELECT *, o_custkey + 1 FROM orders WHERE o_orderkey % 31 = 0),
lists AS (
  SELECT o_orderkey AS playlist_id, user_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner_id,
    o_orderstatus = 'P' OR o_orderkey % 31 = 0 AS collaborative, CASE o_orderkey % 23 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE bucket || ' mix' END AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate DESC, o_orderkey) AS ordinal
  FROM members JOIN buckets ON bucket_no = o_orderkey % 16),
items AS (
  SELECT l_orderkey AS playlist_id, user_id, l_partkey AS track_id, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey, user_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
    l_quantity <> 50 AS has_track, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'lib:track:' || l_partkey END AS uri,
    l_returnflag = 'R' AND l_linenumber = 7 AS is_local, NOT (l_linenumber = 6 AND l_returnflag = 'A') AS playable, l_partkey % 53 <> 0 AS has_artists
  FROM lineitem JOIN members ON o_orderkey = l_orderkey),
copyable AS (SELECT * FROM items WHERE has_track AND NOT is_local AND playable AND uri <> ''),
sortable AS (SELECT * FROM copyable WHERE has_artists),
seen AS (
  SELECT user_id, playlist_id, position, 0 AS artist_pos, l_suppkey AS artist_id FROM sortable
  UNION ALL SELECT user_id, playlist_id, position, 1, track_id % 100 FROM sortable WHERE track_id % 2 = 0),
artist_genres AS (
  SELECT s_suppkey AS artist_id, gpos, genre FROM (
    SELECT s_suppkey, 0 AS gpos, s_suppkey % 24 AS k FROM supplier UNION ALL SELECT s_suppkey, 1, (s_suppkey * 7 + 3) % 24 FROM supplier)
  JOIN vocab ON v = k WHERE s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0),
genre_bucket AS (
  SELECT genre, coalesce(arg_min(bucket, priority), 'Other') AS bucket FROM (SELECT DISTINCT genre FROM artist_genres)
  LEFT JOIN rules ON contains(lower(genre), keyword) GROUP BY genre),
dim AS (SELECT artist_id, arg_min(bucket, gpos) AS bucket FROM artist_genres JOIN genre_bucket USING (genre) WHERE bucket <> 'Other' GROUP BY artist_id),
assigned AS (
  SELECT s.user_id, s.playlist_id, s.position, s.track_id, s.uri, coalesce(arg_min(d.bucket, a.artist_pos) FILTER (d.bucket IS NOT NULL), 'Other') AS bucket
  FROM sortable s JOIN seen a ON a.user_id = s.user_id AND a.playlist_id = s.playlist_id AND a.position = s.position LEFT JOIN dim d ON d.artist_id = a.artist_id
  GROUP BY s.user_id, s.playlist_id, s.position, s.track_id, s.uri),
src AS (SELECT a.* FROM assigned a JOIN lists l USING (user_id, playlist_id) WHERE l.ordinal = 1),
bmap AS (
  SELECT user_id, bucket, count(*) AS n, min(position) AS first_position, string_agg(track_id::VARCHAR, ',' ORDER BY position) AS track_ids,
    row_number() OVER (PARTITION BY user_id ORDER BY min(position)) AS bucket_ordinal FROM src GROUP BY user_id, bucket),
verdicts AS (SELECT *, CASE WHEN trim(name) = '' THEN 'no name' WHEN owner_id <> user_id AND NOT collaborative THEN 'not editable' ELSE 'valid' END AS verdict FROM lists),
dests AS (SELECT * FROM verdicts WHERE ordinal > 1 AND verdict = 'valid'),
profile AS (SELECT user_id, playlist_id, bucket, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id, playlist_id) AS share FROM assigned GROUP BY user_id, playlist_id, bucket),
scores AS (
  SELECT m.user_id, m.bucket, d.playlist_id, d.ordinal,
    CASE WHEN (d.user_id, d.playlist_id) IN (SELECT (user_id, playlist_id) FROM profile) THEN coalesce(p.share, 0.0E0)
      WHEN len(list_filter(regexp_split_to_array(lower(m.bucket), '[\\s/&]+'), lambda k: contains(lower(d.name), k))) > 0 THEN 1.0E-1 ELSE 0.0E0 END AS score
  FROM bmap m JOIN dests d USING (user_id) LEFT JOIN profile p ON p.user_id = d.user_id AND p.playlist_id = d.playlist_id AND p.bucket = m.bucket),
best AS (
  SELECT user_id, bucket, playlist_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY score DESC, ordinal) AS r FROM scores WHERE score > 0) WHERE r = 1),
safety AS (
  SELECT d.user_id, d.playlist_id, count(*) FILTER (i.has_track AND NOT i.is_local AND i.playable AND i.uri <> '') AS n_copyable, count(i.playlist_id) AS n_items
  FROM dests d LEFT JOIN items i USING (user_id, playlist_id) GROUP BY ALL),
cand AS (SELECT s.user_id, s.bucket, m.bucket_ordinal, s.position, s.uri FROM src s JOIN bmap m USING (user_id, bucket)),
base AS (SELECT user_id, playlist_id, 0 AS segment, 0 AS bucket_ordinal, position, uri FROM copyable),
copies AS (
  SELECT user_id, playlist_id, row_number() OVER (PARTITION BY user_id, playlist_id ORDER BY segment, bucket_ordinal, position) - 1 AS position, uri FROM (
    SELECT * FROM base WHERE (user_id, playlist_id) IN (SELECT (user_id, playlist_id) FROM best)
    UNION ALL SELECT c.user_id, b.playlist_id, 1, c.bucket_ordinal, c.position, c.uri FROM cand c JOIN best b USING (user_id, bucket))),
ledger AS (
  SELECT m.user_id, m.bucket, b.playlist_id, m.n, CASE WHEN (b.playlist_id + m.user_id) % 11 <> 0 THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN (b.playlist_id + m.user_id) % 11 <> 0 THEN m.n ELSE 0 END AS tracks_added,
    CASE WHEN b.playlist_id IS NULL THEN 'no matching playlist' WHEN (b.playlist_id + m.user_id) % 11 = 0 THEN 'write failed' END AS reason,
    row_number() OVER (PARTITION BY m.user_id ORDER BY b.playlist_id IS NOT NULL, m.bucket_ordinal) AS result_ordinal
  FROM bmap m LEFT JOIN best b USING (user_id, bucket)),
wanted AS (SELECT DISTINCT artist_id FROM seen),
fresh AS (
  SELECT artist_id, string_agg(genre, ',' ORDER BY gpos) AS genres FROM artist_genres WHERE artist_id % 29 <= 14 AND artist_id IN (SELECT artist_id FROM wanted) GROUP BY artist_id),
missing AS (SELECT artist_id FROM wanted WHERE artist_id NOT IN (SELECT artist_id FROM fresh)),
ab AS (
  SELECT m.user_id, 'direct' AS run, 'direct-' || m.user_id AS action_id, m.bucket, m.bucket_ordinal, m.n, b.playlist_id AS pid, b.playlist_id::VARCHAR AS playlist_id,
    CASE WHEN m.user_id % 19 = 0 AND m.bucket_ordinal = 1 THEN 'undone' ELSE 'applied' END AS status FROM bmap m JOIN best b USING (user_id, bucket)
  UNION ALL SELECT user_id, 'auto', 'auto-' || user_id, bucket, bucket_ordinal, n, NULL, sha256('auto|' || user_id || '|' || bucket), 'applied' FROM bmap),
places AS (
  SELECT user_id, action_id, run, playlist_id, min(bucket_ordinal) AS place, string_agg(bucket, ',' ORDER BY bucket_ordinal) AS bucket_order, 'list ' || playlist_id[1:8] AS name, 's' || playlist_id AS expected
  FROM ab WHERE run = 'auto' OR pid % 29 <> 0 GROUP BY user_id, action_id, run, playlist_id),
req AS (SELECT user_id, run, action_id, bucket, run = 'direct' AND user_id % 31 = 0 AS invalid, user_id % 36 > CASE run WHEN 'direct' THEN 0 ELSE 6 END AS live FROM ab JOIN buckets USING (bucket) WHERE (bucket_no + user_id + (run = 'auto')::INT) % 3 = 0),
asked AS (
  SELECT user_id, action_id, bucket FROM req WHERE live AND NOT invalid
  UNION ALL SELECT DISTINCT user_id, action_id, 'Unknown' FROM req WHERE run = 'direct' AND user_id % 17 = 0 AND live AND NOT invalid),
unknown AS (SELECT * FROM asked q WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.action_id = q.action_id AND ab.bucket = q.bucket)),
again AS (SELECT q.user_id, q.action_id, q.bucket FROM asked q JOIN ab USING (action_id, bucket) WHERE ab.status = 'undone'),
misplaced AS (SELECT q.user_id, q.action_id, q.bucket, ab.playlist_id FROM asked q JOIN ab USING (action_id, bucket) WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.action_id = q.action_id AND p.playlist_id = ab.playlist_id)),
chosen AS (
  SELECT ab.* FROM ab JOIN asked USING (action_id, bucket)
  WHERE action_id NOT IN (SELECT action_id FROM unknown) AND action_id NOT IN (SELECT action_id FROM again) AND action_id NOT IN (SELECT action_id FROM misplaced)),
conflicts AS (
  SELECT c.user_id, c.action_id, c.playlist_id, p.name, p.expected, 'changed' AS actual, string_agg(c.bucket, ',' ORDER BY c.bucket_ordinal) AS buckets
  FROM chosen c JOIN places p ON p.action_id = c.action_id AND p.playlist_id = c.playlist_id WHERE CASE c.run WHEN 'direct' THEN c.pid % 5 = 0 ELSE c.playlist_id[1:1] = '0' END GROUP BY ALL),
rewrite AS (SELECT DISTINCT user_id, run, action_id, playlist_id, pid FROM chosen WHERE action_id NOT IN (SELECT action_id FROM conflicts)),
ok_write AS (SELECT DISTINCT action_id, playlist_id FROM rewrite WHERE CASE run WHEN 'direct' THEN (pid + user_id) % 11 <> 0 ELSE user_id % 11 <> 0 END),
stays AS (SELECT ab.* FROM ab WHERE status = 'applied' AND NOT EXISTS (SELECT 1 FROM chosen h WHERE h.action_id = ab.action_id AND h.bucket = ab.bucket)),
rebuilt AS (
  SELECT user_id, action_id, playlist_id, row_number() OVER (PARTITION BY action_id, playlist_id ORDER BY bucket_ordinal, position) - 1 AS position, uri FROM (
    SELECT r.user_id, r.action_id, r.playlist_id, 0 AS bucket_ordinal, b.position, b.uri FROM base b JOIN rewrite r ON r.pid = b.playlist_id AND r.user_id = b.user_id
    UNION ALL
    SELECT r.user_id, r.action_id, r.playlist_id, s.bucket_ordinal, c.position, c.uri FROM rewrite r JOIN stays s ON s.action_id = r.action_id AND s.playlist_id = r.playlist_id JOIN cand c ON c.user_id = s.user_id AND c.bucket = s.bucket)),
after AS (
  SELECT ab.user_id, ab.action_id, ab.bucket, ab.n, h.action_id IS NOT NULL AS was_asked, CASE WHEN h.action_id IS NOT NULL AND k.action_id IS NOT NULL THEN 'undone' ELSE ab.status END AS status
  FROM ab LEFT JOIN chosen h ON h.action_id = ab.action_id AND h.bucket = ab.bucket LEFT JOIN ok_write k ON k.action_id = ab.action_id AND k.playlist_id = ab.playlist_id),
sources AS (SELECT * FROM lists WHERE ordinal = 1),
backups AS (
  SELECT s.user_id, s.playlist_id, CASE WHEN s.playlist_id % 13 <> 0 THEN sha256('backup|' || s.user_id || '|' || s.playlist_id) END AS list_id,
    CASE WHEN s.playlist_id % 13 <> 0 THEN s.name || ' — Backup' END AS name,
    CASE WHEN s.playlist_id % 13 <> 0 THEN (SELECT count(*) FROM copyable c WHERE c.user_id = s.user_id AND c.playlist_id = s.playlist_id) ELSE 0 END AS tracks_copied,
    CASE WHEN s.playlist_id % 13 <> 0 THEN 'success' ELSE 'source not found' END AS status
  FROM sources s WHERE s.user_id % 2 = 0),
runs AS (
  SELECT s.user_id, s.playlist_id, coalesce(n, 0) AS n_sortable, CASE WHEN b.status = 'source not found' THEN 'aborted' WHEN n IS NULL THEN 'empty' ELSE 'sorted' END AS outcome
  FROM sources s LEFT JOIN (SELECT user_id, playlist_id, count(*) AS n FROM sortable GROUP BY ALL) k USING (user_id, playlist_id) LEFT JOIN backups b USING (user_id, playlist_id)),
going AS (SELECT user_id FROM runs WHERE outcome = 'sorted'),
wish AS (SELECT user_id, playlist_id, 2 * ordinal AS place FROM lists UNION ALL SELECT user_id, playlist_id + 1, 2 * ordinal + 1 FROM lists),
excluded AS (
  SELECT user_id, playlist_id, name, reason, row_number() OVER (PARTITION BY user_id ORDER BY part, place) AS place FROM (
    SELECT w.user_id, w.playlist_id, '' AS name, 'not found' AS reason, 0 AS part, w.place FROM wish w LEFT JOIN lists l USING (user_id, playlist_id) WHERE l.name IS NULL
    UNION ALL SELECT user_id, playlist_id, name, verdict, 1, ordinal FROM verdicts WHERE verdict <> 'valid' AND ordinal > 1)
  WHERE user_id IN (SELECT user_id FROM going)),
made AS (
  SELECT l.user_id, l.playlist_id, sha256('copy|' || l.user_id || '|' || l.playlist_id) AS list_id, CASE WHEN l.playlist_id % 4 = 0 THEN 'Named' ELSE name || ' — Copy' END AS copy_name
  FROM lists l WHERE EXISTS (SELECT 1 FROM best b WHERE b.user_id = l.user_id AND b.playlist_id = l.playlist_id)),
written AS (
  SELECT m.user_id, 'copy' AS run, list_id, copy_name AS name, m.bucket, m.bucket_ordinal, b.playlist_id AS pid FROM bmap m JOIN best b USING (user_id, bucket) JOIN made USING (user_id, playlist_id)
  UNION ALL SELECT m.user_id, 'direct', b.playlist_id::VARCHAR, l.name, m.bucket, m.bucket_ordinal, b.playlist_id
    FROM bmap m JOIN best b USING (user_id, bucket) JOIN safety s ON s.user_id = b.user_id AND s.playlist_id = b.playlist_id JOIN lists l ON l.user_id = b.user_id AND l.playlist_id = b.playlist_id WHERE s.n_copyable = s.n_items
  UNION ALL SELECT user_id, 'auto', sha256('auto|' || user_id || '|' || bucket), bucket, bucket, bucket_ordinal, NULL FROM bmap),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY bucket_ordinal) AS k FROM written WHERE (CASE run WHEN 'direct' THEN pid ELSE bucket_ordinal END + user_id) % 11 <> 0),
held AS (SELECT user_id, playlist_id, string_agg(uri, '+' ORDER BY position) AS uris FROM base GROUP BY ALL),
told AS (
  SELECT s.user_id, s.bucket, string_agg(s.uri, '+' ORDER BY s.position) AS uris,
    string_agg(s.track_id || '/track ' || s.track_id || '/artist ' || i.l_suppkey || CASE WHEN s.track_id % 2 = 0 THEN ',artist ' || (s.track_id % 100) ELSE '' END || '/' || CASE WHEN s.track_id % 10 <> 0 THEN 'album ' || (s.track_id % 10) ELSE '' END || '/' || CASE WHEN s.track_id % 4 <> 0 THEN 'lib/' || s.track_id ELSE '' END, '+' ORDER BY s.position) AS tracks
  FROM src s JOIN sortable i ON i.user_id = s.user_id AND i.playlist_id = s.playlist_id AND i.position = s.position GROUP BY ALL),
picked AS (SELECT *, user_id % 23 <> 0 AND user_id % 36 > 0 AND (k + user_id) % 2 = 0 AS picked FROM kept),
late AS (SELECT DISTINCT user_id, run FROM picked WHERE picked AND list_id[1:1] = '1'),
undone AS (SELECT p.*, p.picked AND p.user_id % 11 <> 0 AND l.run IS NULL AS gone FROM picked p LEFT JOIN late l ON l.user_id = p.user_id AND l.run = p.run),
recorded AS (
  SELECT u.user_id, run, TIMESTAMP '2024-01-30 00:00:00' + to_hours((u.user_id % 36)::INTEGER) AS created_at, u.user_id % 23 = 0 AS lost, arg_min(list_id, bucket_ordinal) AS first_list,
    string_agg(u.bucket || ':' || list_id || ':' || name || ':applied:' || uris || ':' || tracks, ';' ORDER BY bucket_ordinal) AS buckets,
    string_agg(u.bucket || ':' || list_id || ':' || name || ':' || CASE WHEN gone THEN 'undone' ELSE 'applied' END || ':' || uris || ':' || tracks, ';' ORDER BY bucket_ordinal) AS buckets_after
  FROM undone u JOIN told t ON t.user_id = u.user_id AND t.bucket = u.bucket GROUP BY u.user_id, run),
record_lists AS (
  SELECT user_id, run, string_agg(list_id || ':' || name || ':s' || list_id[1:8] || ':' || bucket_order || ':' || baseline, ';' ORDER BY place) AS destinations,
    string_agg(list_id || ':' || name || ':' || CASE WHEN gone THEN 'n' ELSE 's' END || list_id[1:8] || ':' || bucket_order || ':' || baseline, ';' ORDER BY place) AS destinations_after
  FROM (
    SELECT u.user_id, run, list_id, name, min(bucket_ordinal) AS place, string_agg(u.bucket, '+' ORDER BY bucket_ordinal) AS bucket_order, bool_or(gone) AS gone, coalesce(any_value(h.uris), '') AS baseline
    FROM undone u LEFT JOIN held h ON h.user_id = u.user_id AND h.playlist_id = u.pid GROUP BY u.user_id, run, list_id, name) GROUP BY user_id, run),
appended AS (SELECT c.user_id, b.playlist_id AS pid, row_number() OVER (PARTITION BY c.user_id, b.playlist_id ORDER BY c.bucket_ordinal, c.position) - 1 AS rank, c.uri FROM cand c JOIN best b USING (user_id, bucket)),
swapped AS (SELECT DISTINCT user_id, action_id, playlist_id, pid FROM chosen WHERE run = 'direct' AND action_id NOT IN (SELECT action_id FROM chosen WHERE pid % 7 = 0 AND run = 'direct')),
stored AS (
  SELECT l.user_id, l.playlist_id AS pid, w.pid IS NOT NULL AS swapped, a.pid IS NOT NULL AND l.playlist_id % 5 <> 0 AS appended
  FROM lists l LEFT JOIN swapped w ON w.user_id = l.user_id AND w.pid = l.playlist_id LEFT JOIN (SELECT DISTINCT user_id, pid FROM appended) a ON a.user_id = l.user_id AND a.pid = l.playlist_id),
stored_items AS (
  SELECT i.user_id, i.playlist_id AS pid, i.position - 1 AS position, CASE WHEN i.has_track THEN i.uri END AS uri FROM items i JOIN stored s ON s.user_id = i.user_id AND s.pid = i.playlist_id WHERE NOT swapped
  UNION ALL
  SELECT a.user_id, a.pid, (SELECT count(*) FROM items i WHERE i.user_id = a.user_id AND i.playlist_id = a.pid) + a.rank, a.uri FROM appended a JOIN stored s ON s.user_id = a.user_id AND s.pid = a.pid WHERE appended AND NOT swapped
  UNION ALL
  SELECT user_id, pid, row_number() OVER (PARTITION BY user_id, pid ORDER BY bucket_ordinal, position) - 1, uri FROM (
    SELECT r.user_id, r.pid, 0 AS bucket_ordinal, b.position, b.uri FROM base b JOIN swapped r ON r.pid = b.playlist_id AND r.user_id = b.user_id
    UNION ALL
    SELECT r.user_id, r.pid, s.bucket_ordinal, c.position, c.uri FROM swapped r JOIN stays s ON s.action_id = r.action_id AND s.playlist_id = r.playlist_id JOIN cand c ON c.user_id = s.user_id AND c.bucket = s.bucket))
"""

PAGES = VIEWS + """,
segs AS (SELECT user_id, playlist_id AS k, (position - 1) // 2 AS seg, count(*) AS n FROM items GROUP BY ALL),
ends AS (SELECT *, seg = max(seg) OVER (PARTITION BY user_id, k) AS last FROM segs),
landed AS (
  SELECT user_id, k, seg, n, 2 * seg - CASE WHEN k % 47 = 1 AND seg = 1 THEN 1 ELSE 0 END AS start, NOT last OR k % 53 = 1 AS named, CASE WHEN k % 43 = 1 AND seg = 0 THEN 2 ELSE 1 END AS times
  FROM ends WHERE NOT (k % 41 = 1 AND seg = 1) AND NOT (k % 59 = 1 AND seg = 0)),
good_pages AS (SELECT * FROM landed WHERE NOT (k % 61 = 1 AND seg = 0)),
faults AS (
  SELECT *, CASE WHEN lag(start) OVER w IS NULL AND start > 0 THEN 'no first page' WHEN start > lag(start + n) OVER w THEN 'gap' WHEN start < lag(start + n) OVER w THEN 'overlap'
    WHEN lead(start) OVER w IS NULL AND named THEN 'open end' END AS fault FROM good_pages WINDOW w AS (PARTITION BY user_id, k ORDER BY start)),
page_told AS (SELECT user_id, k, count(*) AS n_pages, sum(times - 1)::BIGINT AS n_repeated, sum(n)::BIGINT AS n_items, coalesce(arg_min(fault, start) FILTER (fault IS NOT NULL), 'complete') AS verdict FROM faults GROUP BY user_id, k)
"""

LONG = """
WITH named AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'order ' || l_orderkey ELSE 'all ' || l_returnflag END AS list, * FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position FROM named)
"""

REQUESTS = """
WITH r AS (
  SELECT c_custkey AS u, CASE WHEN c_custkey % 6 = 1 THEN 'liked' ELSE 'playlist' END AS st, c_custkey % 4 <> 0 AS existing,
    CASE WHEN c_custkey % 4 = 1 THEN 'copy' WHEN c_custkey % 4 = 2 OR c_custkey % 20 = 0 THEN 'direct' END AS wm,
    CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 8 <> 3 THEN 'p' || c_custkey END AS pid,
    CASE WHEN c_custkey % 10 = 0 THEN 'none' WHEN c_custkey % 12 = 0 THEN 'own' WHEN c_custkey % 4 <> 0 THEN 'two' END AS ids,
    CASE WHEN c_custkey % 11 = 0 THEN 'd1' WHEN c_custkey % 7 = 0 THEN 'd3' END AS named, c_custkey % 5 = 0 AS backup
  FROM customer),
f AS (
  SELECT *, concat_ws('; ',
    CASE WHEN pid = '' THEN 'playlistId: playlistId must not be blank' END,
    CASE WHEN ids = 'none' THEN 'editablePlaylistIds: editablePlaylistIds must contain at least one playlist id' END,
    CASE WHEN named = 'd1' THEN 'safeCopyNames.d1: safe copy name must be at most 100 characters' END) AS fields FROM r),
i AS (
  SELECT u, existing, wm, CASE WHEN fields <> '' THEN fields ELSE concat_ws('; ',
    CASE WHEN st = 'playlist' AND pid IS NULL THEN 'playlistId: playlistId is required when sourceType is playlist' END,
    CASE WHEN existing AND ids IS NULL THEN 'editablePlaylistIds: editablePlaylistIds are required for sort-into-existing mode' END,
    CASE WHEN st = 'liked' AND backup THEN 'createBackup: createBackup is only valid when sourceType is playlist' END,
    CASE WHEN NOT existing AND wm IS NOT NULL THEN 'existingPlaylistWriteMode: existingPlaylistWriteMode is only valid when outputMode is sort-into-existing' END,
    CASE WHEN named IS NOT NULL AND NOT existing THEN 'safeCopyNames: safeCopyNames is only valid when outputMode is sort-into-existing' END,
    CASE WHEN named IS NOT NULL AND existing AND wm = 'direct' THEN 'safeCopyNames: safeCopyNames is only valid when existingPlaylistWriteMode is copy' END,
    CASE WHEN named = 'd3' THEN 'safeCopyNames.d3: safeCopyNames key ''d3'' is not in editablePlaylistIds' END,
    CASE WHEN named = 'd3' THEN 'safeCopyNames.d4: safeCopyNames key ''d4'' is not in editablePlaylistIds' END,
    CASE WHEN st = 'playlist' AND existing AND ids = 'own' AND pid IS NOT NULL THEN 'editablePlaylistIds: source playlist cannot be a destination' END) END AS issues FROM f)
"""

PROFILES = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 1 THEN 'old' WHEN c_custkey % 3 <> 0 THEN c_name END AS display_name,
  CASE WHEN c_custkey % 2 = 1 THEN 'old.png' WHEN c_custkey % 4 <> 0 THEN 'img/' || c_custkey END AS picture_url,
  CASE WHEN c_custkey % 5 <> 0 THEN 'XX' END AS country
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0"""

ORACLES = {
    k: VIEWS + v
    for k, v in {
        "sortable_items": "SELECT user_id, playlist_id, position, track_id::VARCHAR AS track_id FROM sortable",
        "copyable_uris": "SELECT user_id, playlist_id, string_agg(uri, ',' ORDER BY position) AS uris FROM copyable GROUP BY ALL",
        "track_summary": "SELECT user_id, playlist_id, position, track_id::VARCHAR AS id, 'track ' || track_id AS name, 'artist ' || l_suppkey || CASE WHEN track_id % 2 = 0 THEN ',artist ' || (track_id % 100) ELSE '' END AS artists, CASE WHEN track_id % 10 <> 0 THEN 'album ' || (track_id % 10) ELSE '' END AS album, CASE WHEN track_id % 4 <> 0 THEN 'lib/' || track_id ELSE '' END AS url FROM sortable",
        "playlist_item_count": "SELECT l.user_id, l.playlist_id, CASE WHEN l.playlist_id % 15 <> 0 THEN c.n END AS n_items FROM lists l LEFT JOIN (SELECT user_id, playlist_id, count(*) AS n FROM items GROUP BY ALL) c USING (user_id, playlist_id)",
        "normalize_genre": "SELECT * FROM genre_bucket",
        "artist_bucket": "SELECT artist_id::VARCHAR AS artist_id, bucket FROM dim",
        "track_bucket": "SELECT user_id, playlist_id, position, track_id::VARCHAR AS track_id, bucket FROM assigned",
        "bucket_counts": "SELECT bucket, count(*) AS n FROM assigned GROUP BY bucket",
        "library_buckets": "SELECT user_id, bucket, count(*) AS n, min(position) AS first_position FROM assigned GROUP BY user_id, bucket",
        "bucket_map": "SELECT user_id, bucket, n, first_position, track_ids, bucket_ordinal FROM bmap",
        "distinct_artists": "SELECT user_id, artist_id::VARCHAR AS artist_id, playlist_id, position, artist_pos::BIGINT AS artist_pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist_id ORDER BY playlist_id, position, artist_pos) AS r FROM seen) WHERE r = 1",
        "fresh_artists": "SELECT artist_id::VARCHAR AS artist_id, genres FROM fresh",
        "missing_artists": "SELECT artist_id::VARCHAR AS artist_id FROM missing",
        "cache_upsert_latest": "SELECT user_id AS artist_id, max(ts) AS fetched_at, arg_max(value, ts) AS payload FROM events GROUP BY user_id",
        "effective_genres": "SELECT artist_id::VARCHAR AS artist_id, genres FROM fresh UNION ALL SELECT artist_id::VARCHAR, genre FROM missing JOIN vocab ON v = (artist_id + 1) % 24 WHERE artist_id % 5 <> 0",
        "artist_request_batches": ", q AS (SELECT user_id, artist_id, row_number() OVER (PARTITION BY user_id ORDER BY playlist_id, position, artist_pos) - 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist_id ORDER BY playlist_id, position, artist_pos) AS k FROM seen) WHERE k = 1 AND artist_id IN (SELECT artist_id FROM missing)) SELECT user_id, r // 50 AS batch_no, string_agg(artist_id::VARCHAR, ',' ORDER BY r) AS values FROM q GROUP BY 1, 2",
        "validate_playlists": "SELECT user_id, playlist_id, verdict FROM verdicts",
        "editable_playlists": "SELECT user_id, playlist_id, owner_id = user_id OR collaborative AS editable, NOT (owner_id = user_id OR collaborative) AND ordinal <> 1 AS unavailable FROM lists",
        "not_found_ids": "SELECT user_id, playlist_id, 'not found' AS reason FROM (SELECT user_id, playlist_id FROM lists UNION ALL SELECT user_id, playlist_id + 1 FROM lists) q WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.user_id = q.user_id AND l.playlist_id = q.playlist_id)",
        "selected_playlists": "SELECT user_id, playlist_id, ordinal FROM lists WHERE playlist_id % 3 = 0 AND ordinal <> 1",
        "genre_profile": "SELECT user_id, playlist_id, bucket, n, round(share, 9) AS share FROM profile",
        "bucket_match_scores": "SELECT user_id, bucket, playlist_id, round(score, 9) AS score FROM scores",
        "best_match": "SELECT user_id, bucket, playlist_id, round(score, 9) AS score FROM best",
        "unmatched_buckets": "SELECT user_id, bucket, n FROM bmap m WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.user_id = m.user_id AND b.bucket = m.bucket)",
        "replay_safe": "SELECT *, n_copyable = n_items AS safe FROM safety",
        "plan_auto_create": "SELECT user_id, bucket, sha256('auto|' || user_id || '|' || bucket) AS list_id, row_number() OVER (PARTITION BY user_id, bucket ORDER BY position) - 1 AS position, uri FROM src",
        "plan_safe_copy": "SELECT * FROM copies",
        "copy_names": "SELECT user_id, list_id, copy_name, user_id AS owner_id, false AS collaborative, false AS public FROM made",
        "plan_direct": "SELECT c.user_id, b.playlist_id, s.n_items + row_number() OVER (PARTITION BY c.user_id, b.playlist_id ORDER BY c.bucket_ordinal, c.position) - 1 AS position, c.uri FROM cand c JOIN best b USING (user_id, bucket) JOIN safety s ON s.user_id = b.user_id AND s.playlist_id = b.playlist_id WHERE s.n_copyable = s.n_items",
        "plan_backup": "SELECT l.user_id, l.name || ' — Backup' AS name, sha256('backup|' || l.user_id || '|' || l.playlist_id) AS list_id, row_number() OVER (PARTITION BY l.user_id ORDER BY c.position) - 1 AS position, c.uri FROM lists l JOIN copyable c USING (user_id, playlist_id) WHERE l.ordinal = 1",
        "write_batches": "SELECT user_id, playlist_id, position // 5 AS batch_no, string_agg(uri, ',' ORDER BY position) AS values FROM copies GROUP BY 1, 2, 3",
        "result_ledger": "SELECT * FROM ledger",
        "ledger_totals": "SELECT user_id, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, sum(tracks_added)::BIGINT AS tracks_added FROM ledger GROUP BY user_id",
        "unique_copies": "SELECT user_id, playlist_id, arg_min(bucket, result_ordinal) AS bucket FROM ledger WHERE status = 'success' GROUP BY 1, 2",
        "backup_status": "SELECT * FROM backups",
        "run_outcomes": "SELECT * FROM runs",
        "valid_destinations": "SELECT user_id, playlist_id, name, ordinal FROM dests WHERE user_id IN (SELECT user_id FROM going)",
        "excluded_playlists": "SELECT * FROM excluded",
        "refresh_artist_cache": "SELECT artist_id::VARCHAR AS artist_id, string_agg(genre, ',' ORDER BY gpos) AS genres, TIMESTAMP '2024-01-31 00:00:00' - to_days((artist_id % 29)::INTEGER) AS last_fetched_at FROM artist_genres WHERE artist_id NOT IN (SELECT artist_id FROM missing WHERE artist_id % 5 <> 0) GROUP BY artist_id UNION ALL SELECT artist_id::VARCHAR, genre, TIMESTAMP '2024-01-31 00:00:00' FROM missing JOIN vocab ON v = (artist_id + 1) % 24 WHERE artist_id % 5 <> 0",
        "append_lists": "SELECT c.user_id, b.playlist_id, coalesce((SELECT count(*) FROM items i WHERE i.user_id = b.user_id AND i.playlist_id = b.playlist_id), 0) + row_number() OVER (PARTITION BY c.user_id, b.playlist_id ORDER BY c.bucket_ordinal, c.position) - 1 AS position, c.uri FROM cand c JOIN best b USING (user_id, bucket)",
        "direct_ledger": "SELECT l.* REPLACE (CASE WHEN s.n_copyable <> s.n_items THEN 'failed' ELSE l.status END AS status, CASE WHEN s.n_copyable <> s.n_items THEN 0 ELSE l.tracks_added END AS tracks_added, CASE WHEN s.n_copyable <> s.n_items THEN 'the list holds items that could not be written again, so a direct change could not be undone' ELSE l.reason END AS reason) FROM ledger l LEFT JOIN safety s ON s.user_id = l.user_id AND s.playlist_id = l.playlist_id",
        "action_destinations": "SELECT p.user_id, p.action_id, p.playlist_id, p.place, p.bucket_order, coalesce((SELECT string_agg(uri, ',' ORDER BY position) FROM base b WHERE p.run = 'direct' AND b.user_id = p.user_id AND b.playlist_id::VARCHAR = p.playlist_id), '') AS baseline, p.expected FROM places p",
        "record_action": "SELECT user_id, run, CASE WHEN NOT lost THEN sha256('action|' || user_id || '|' || run || '|' || epoch_us(created_at)) END AS action_id, CASE WHEN NOT lost THEN created_at END AS created_at, CASE WHEN NOT lost THEN created_at + INTERVAL 24 HOURS END AS expires_at, CASE WHEN NOT lost THEN destinations END AS destinations, CASE WHEN NOT lost THEN buckets END AS buckets, CASE WHEN lost THEN 'no action was recorded: the final snapshot is not known of list ' || first_list END AS warning FROM recorded JOIN record_lists USING (user_id, run)",
        "update_action": "SELECT user_id, run, sha256('action|' || user_id || '|' || run || '|' || epoch_us(created_at)) AS action_id, created_at + INTERVAL 24 HOURS AS expires_at, greatest(1, (user_id % 36) * 3600)::BIGINT AS seconds_left FROM recorded WHERE NOT lost",
        "undo_snapshots": "SELECT p.user_id, p.action_id, p.playlist_id, CASE WHEN k.action_id IS NULL THEN 's' ELSE 'n' END || p.playlist_id AS expected FROM places p LEFT JOIN ok_write k USING (action_id, playlist_id)",
        "replace_lists": "SELECT i.user_id, i.playlist_id::VARCHAR AS playlist_id, i.position - 1 AS position, CASE WHEN has_track THEN uri END AS uri FROM items i WHERE NOT EXISTS (SELECT 1 FROM rewrite r WHERE r.user_id = i.user_id AND r.pid = i.playlist_id) UNION ALL SELECT user_id, playlist_id, position, uri FROM rebuilt",
        "latest_action": "SELECT user_id, event_id AS action_id, greatest(1, ceil(epoch(ts + INTERVAL 24 HOURS - TIMESTAMP '2024-01-29 12:00:00')))::BIGINT AS seconds_left FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-29 12:00:00' AND event_id % 10 <> 0",
        "latest_action_state": "SELECT user_id, event_id AS action_id, event_type || CASE WHEN event_id % 4 = 0 AND event_id % 28 <> 0 THEN ' again' ELSE '' END AS payload, greatest(1, ceil(epoch(ts + INTERVAL 24 HOURS - TIMESTAMP '2024-01-31 00:00:00')))::BIGINT AS seconds_left FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS r FROM events) WHERE r = 1 AND ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-31 00:00:00' AND event_id % 10 <> 0",
        "undo_unknown_buckets": "SELECT * FROM unknown",
        "undo_already_undone": "SELECT * FROM again",
        "undo_conflicts": "SELECT * FROM conflicts",
        "undo_rebuild": "SELECT * FROM rebuilt",
        "undo_transition": "SELECT user_id, action_id, bucket, status FROM after",
        "undo_totals": "SELECT user_id, action_id, count(*) FILTER (status <> 'undone') AS applied, count(*) FILTER (status = 'undone') AS undone, coalesce(sum(n) FILTER (status = 'undone'), 0)::BIGINT AS tracks_undone FROM after GROUP BY user_id, action_id",
        "undo_groups": ", g AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY place) AS group_no FROM places) SELECT ab.user_id, ab.action_id, coalesce(g.group_no, (SELECT count(*) FROM g h WHERE h.action_id = ab.action_id) + 1) AS group_no, coalesce(g.name, 'Other destinations') AS place, row_number() OVER (PARTITION BY ab.action_id, g.group_no ORDER BY bucket_ordinal) - 1 AS at, bucket FROM ab LEFT JOIN g ON g.action_id = ab.action_id AND g.playlist_id = ab.playlist_id",
        "undone_bucket_names": "SELECT user_id, action_id, string_agg(bucket, ',' ORDER BY bucket) AS buckets FROM after WHERE status = 'undone' GROUP BY user_id, action_id",
        "undo_records": "SELECT user_id, sha256('action|' || user_id || '|' || run || '|' || epoch_us(created_at)) AS action_id, destinations_after AS destinations, buckets_after AS buckets, user_id AS client_of, created_at + INTERVAL 24 HOURS AS expires_at FROM recorded JOIN record_lists USING (user_id, run) WHERE NOT lost",
        "undo_missing_destinations": "SELECT * FROM misplaced",
        "undo_outcomes": "SELECT DISTINCT user_id, action_id, CASE WHEN invalid THEN 'invalid request' WHEN NOT live THEN 'action not found' WHEN action_id IN (SELECT action_id FROM unknown) THEN 'unknown bucket' WHEN action_id IN (SELECT action_id FROM again) THEN 'already undone' WHEN action_id IN (SELECT action_id FROM misplaced) THEN 'missing destination' WHEN action_id IN (SELECT action_id FROM conflicts) THEN 'conflict' WHEN action_id IN (SELECT action_id FROM after WHERE was_asked AND status = 'applied') THEN 'partial' ELSE 'complete' END AS outcome FROM req",
        "stored_lists": "SELECT user_id, pid::VARCHAR AS playlist_id, position, uri FROM stored_items",
        "stored_heads": "SELECT s.user_id, s.pid::VARCHAR AS playlist_id, CASE WHEN swapped THEN 'v3' WHEN appended THEN 'v2' ELSE 'v1' END AS snapshot, (SELECT count(*) FROM stored_items i WHERE i.user_id = s.user_id AND i.pid = s.pid) AS n_items FROM stored s",
    }.items()
} | {
    "request_issues": REQUESTS + "SELECT u AS user_id, issues FROM i",
    "request_defaults": REQUESTS + "SELECT u AS user_id, CASE WHEN existing THEN coalesce(wm, 'copy') END AS write_mode FROM i WHERE issues = ''",
    "undo_request_gate": "SELECT c_custkey AS user_id, c_custkey % 5 NOT IN (0, 1, 2) AND c_mktsegment <> 'Pop' AS ok FROM customer",
    "user_profile_upsert": PROFILES,
    "public_users": f"SELECT user_id, display_name, picture_url FROM ({PROFILES})",
    "page_verdicts": PAGES + "SELECT user_id::VARCHAR AS user_id, k::VARCHAR AS playlist_id, n_pages, n_repeated, n_items, verdict FROM page_told",
    "broken_pages": PAGES + """SELECT ('{"user_id":"' || user_id || '","playlist_id":"' || k || '","offset":0,"next":"page/1","items":[{"item":{')[1:40] AS line FROM landed, range(times) WHERE k % 61 = 1 AND seg = 0""",
    "scanned_items": PAGES + "SELECT i.user_id::VARCHAR AS user_id, i.playlist_id::VARCHAR AS playlist_id, i.position - 1 AS position, CASE WHEN has_track THEN track_id::VARCHAR END AS track_id, CASE WHEN has_track THEN CASE WHEN NOT has_artists THEN 0 WHEN track_id % 2 = 0 THEN 2 ELSE 1 END END::INTEGER AS n_artists, coalesce(has_track AND NOT is_local AND playable AND uri <> '' AND has_artists, false) AS sortable FROM items i JOIN page_told t ON t.user_id = i.user_id AND t.k = i.playlist_id WHERE t.verdict = 'complete'",
    "scanned_liked": VIEWS + "SELECT i.user_id::VARCHAR AS user_id, 'liked' AS playlist_id, position - 1 AS position, track_id::VARCHAR AS track_id FROM sortable i JOIN lists l USING (user_id, playlist_id) WHERE l.ordinal = 1",
    "scanned_headers": VIEWS + "SELECT user_id::VARCHAR AS user_id, playlist_id::VARCHAR AS playlist_id, ordinal - 1 AS ordinal, name, owner_id::VARCHAR AS owner_id, collaborative, 's' || playlist_id AS snapshot_id FROM lists",
    "scanned_artists": "SELECT s_suppkey::VARCHAR AS artist_id, CASE WHEN s_suppkey % 13 <> 0 THEN 'genre ' || (s_suppkey % 24) ELSE 'old' END AS genres FROM supplier WHERE s_suppkey % 13 <> 0 OR s_suppkey % 3 = 0",
    "long_list_positions": LONG + "SELECT list, position, l_orderkey, l_linenumber, l_partkey FROM placed",
    "long_list_segments": LONG + "SELECT list, position // 100 AS segment, string_agg(l_partkey::VARCHAR, ',' ORDER BY position) AS values FROM placed GROUP BY 1, 2",
    "keyword_matches": "WITH k AS (SELECT DISTINCT unnest([substring(p_name, 2, 6), substring(p_type, 1, 4), right(p_brand, 2)]) AS keyword FROM part), t AS (SELECT DISTINCT p_name AS text FROM part) SELECT text, count(*) AS n, min(keyword) AS first, max(keyword) AS last FROM t JOIN k ON contains(text, keyword) GROUP BY text",
    "normalize_by_grams": VIEWS + "SELECT * FROM genre_bucket",
    "write_progress": VIEWS + """, c AS (SELECT user_id, playlist_id, (playlist_id + user_id) % 7 AS turn, count(*) AS n, (count(*) + 1) // 2 AS nb FROM copies GROUP BY ALL
  UNION ALL SELECT DISTINCT user_id, playlist_id, (playlist_id + user_id) % 7, 0, 1 FROM best b WHERE NOT EXISTS (SELECT 1 FROM copies k WHERE k.user_id = b.user_id AND k.playlist_id = b.playlist_id)),
  d AS (SELECT *, nb > 1 AND turn IN (0, 2, 3, 4) AS stopped FROM c)
SELECT user_id, playlist_id, nb AS n_batches, CASE WHEN stopped THEN 1 ELSE nb END AS done, CASE WHEN stopped THEN 2 ELSE n END AS n_written,
  CASE WHEN NOT stopped THEN 'complete' WHEN turn IN (0, 2) THEN 'failed' ELSE 'pending' END AS status, CASE WHEN stopped AND turn IN (3, 4) THEN 1 END AS next_batch,
  CASE WHEN stopped AND turn = 3 THEN 2 WHEN stopped AND turn = 4 THEN 1 END AS attempt, CASE WHEN stopped AND turn IN (3, 4) THEN 250 END AS wait_ms, 'b' || CASE WHEN stopped THEN 0 ELSE nb - 1 END AS snapshot,
  CASE WHEN stopped AND turn = 0 THEN 'broken' WHEN stopped AND turn = 2 THEN 'limited' END AS error FROM d""",
    "profile_upkeep": VIEWS + """, held_items AS (SELECT user_id, playlist_id, count(*) AS held FROM items GROUP BY ALL),
  now AS (SELECT user_id, playlist_id, position, bucket FROM assigned WHERE NOT (playlist_id % 3 = 0 AND position = 1)
    UNION ALL SELECT a.user_id, a.pid, h.held + a.rank + 1, a.bucket FROM (
      SELECT c.user_id, b.playlist_id AS pid, c.bucket, row_number() OVER (PARTITION BY c.user_id, b.playlist_id ORDER BY c.bucket_ordinal, c.position) - 1 AS rank FROM cand c JOIN best b USING (user_id, bucket)) a
      JOIN held_items h ON h.user_id = a.user_id AND h.playlist_id = a.pid)
SELECT user_id, playlist_id, bucket, count(*) AS n, min(position) AS first_position, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id, playlist_id), 9) AS share FROM now GROUP BY user_id, playlist_id, bucket""",
}
# the table on disk holds and gives what the operators on plain tables do
ORACLES |= {"artist_table": ORACLES["refresh_artist_cache"], "artist_table_genres": ORACLES["effective_genres"]}
