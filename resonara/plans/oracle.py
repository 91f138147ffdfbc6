"""DuckDB SQL of the engine's queries, over the same tables."""

from __future__ import annotations

A = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"


def enc(n: str, radix: int = 62) -> str:
    return f"(substr({A}, (({n}) // {radix})::INT + 1, 1) || substr({A}, (({n}) % {radix})::INT + 1, 1))"


def dec(x: str, radix: int = 62) -> str:
    digits = A if radix == 62 else A[:37] + "'"
    high, low = f"instr({digits}, substr({x}, 1, 1))", f"instr({digits}, substr({x}, 2, 1))"
    return f"(CASE WHEN length({x}) = 2 AND {high} > 0 AND {low} > 0 THEN ({high} - 1) * {radix} + {low} - 1 END)"


def chart_path(key: str, span: int) -> str:
    return f"('song' || (({key}) // {span} * 2 + CASE WHEN ({key}) % 4 = 0 THEN 1 ELSE 0 END) || '.bms')"


FILES = f"""files AS (
  SELECT {chart_path('p_partkey', 4000)} AS path, p_partkey AS idx, (p_partkey % 3844)::INT AS num_int, {enc('p_partkey % 3844')} AS num,
    'sounds/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.wav' AS name, p_size::BIGINT AS file_size FROM part)"""
STEMS = FILES + r""", stems AS (
  SELECT *, regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem FROM files)"""
REPLACES = """turns AS (
  SELECT path, n, (n + regexp_extract(path, '[0-9]+')::INT % 2) % 5 AS turn FROM (SELECT DISTINCT path FROM files), range(3844) t(n)),
replaces AS (SELECT path, n::INT AS num_int, greatest(CASE turn WHEN 0 THEN 0 WHEN 1 THEN n WHEN 3 THEN n - 2 ELSE n - 1 END, 0)::INT AS replace_to FROM turns)"""
CHART = (
    FILES
    + f""", items AS (
  SELECT l_orderkey, string_agg({enc('l_partkey % 3844')}, '' ORDER BY l_linenumber, l_partkey) AS data FROM lineitem GROUP BY l_orderkey),
chart AS (
  SELECT DISTINCT path, 0::BIGINT AS line_no, '#TITLE a song' AS line FROM files
  UNION ALL SELECT path, idx % 4000 + 1, (CASE WHEN idx % 50 = 0 THEN '#wav' ELSE '#WAV' END) || num || '  ' || name || ' ' FROM files
  UNION ALL SELECT {chart_path('l_orderkey', 30000)}, l_orderkey % 30000 + 10000, '#' || lpad((l_orderkey % 1000)::VARCHAR, 3, '0') || ['01', '11', '04', 'D1', '5A', '29', 'd1', 'e9'][(l_orderkey % 8 + 1)::INT] || ':' || data
    || (CASE WHEN l_orderkey % 7 = 0 THEN 'x' ELSE '' END) FROM items)"""
)
DEFINED = (
    CHART
    + r""", defined AS (
  SELECT path, line_no AS idx, regexp_extract(line, '^#WAV([0-9A-Za-z]{2})\s+(.+)$', 1) AS num, trim(regexp_extract(line, '^#WAV([0-9A-Za-z]{2})\s+(.+)$', 2)) AS name
  FROM chart WHERE regexp_matches(line, '^#WAV([0-9A-Za-z]{2})\s+(.+)$'))"""
)


def kept(files: str = FILES, replaces: str = REPLACES, start: int = 10, end: int = 3000) -> str:
    return (
        files
        + ", "
        + replaces
        + f""", reduced AS (
  SELECT f.*, CASE WHEN f.num_int BETWEEN {start} AND {end} AND r.replace_to > 0 THEN r.replace_to ELSE f.num_int END AS reduced FROM files f LEFT JOIN replaces r USING (path, num_int)),
kept AS (
  SELECT u.path, place, o.num_int, o.idx, o.name FROM (SELECT path, reduced, min(idx) AS place FROM reduced GROUP BY ALL) u
  JOIN (SELECT path, num_int, min(idx) AS idx, arg_min(name, idx) AS name FROM files GROUP BY path, num_int) o ON u.path = o.path AND u.reduced = o.num_int),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY upper(name), place) AS new_int, count(*) OVER (PARTITION BY path) AS n FROM kept),
numbered AS (SELECT path, num_int, new_int, CASE WHEN n > 1295 THEN {enc('new_int')} ELSE {enc('new_int', 36)} END AS new_num, name FROM ranked),
mapped AS (SELECT f.path, f.num, arg_max(m.new_num, f.idx) AS new_num FROM reduced f JOIN numbered m ON f.path = m.path AND f.reduced = m.num_int GROUP BY ALL)"""
    )


def changed(lines: str) -> str:
    """Data lines of ``lines`` (path, line_no, line) with their tokens replaced."""
    return rf"""split AS (SELECT path, line_no, substr(line, 1, 7) AS head, regexp_extract_all(substr(line, 8), '..?') AS ts FROM {lines}),
tokens AS (SELECT path, line_no, head, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM split),
changed AS (SELECT t.path, line_no, any_value(head) || string_agg(CASE WHEN t = '00' THEN t ELSE coalesce(new_num, t) END, '' ORDER BY pos) AS line FROM tokens t LEFT JOIN mapped m ON t = num AND t.path = m.path GROUP BY t.path, line_no)"""


def rewritten(before: str, name: str = "name") -> str:
    return rf"""WITH RECURSIVE {before}, marked AS (
  SELECT *, regexp_matches(line, '^#WAV[0-9A-Za-z]{{2}}') AS is_def, regexp_matches(line, '^#\d{{5}}:') AS is_main FROM chart),
anchor AS (SELECT path, coalesce(min(line_no) FILTER (is_def OR is_main), max(line_no) + 1) AS a FROM marked GROUP BY path),
sounding AS (SELECT * FROM marked WHERE is_main AND regexp_matches(line, '^#\d{{3}}(01|[1-6][1-9]):.')), {changed('sounding')},
together AS (
  SELECT n.path, a AS l, new_int AS s, '#WAV' || new_num || ' ' || {name} AS line FROM numbered n JOIN anchor USING (path)
  UNION ALL SELECT m.path, m.line_no, 1000000000, coalesce(c.line, m.line) FROM marked m LEFT JOIN changed c USING (path, line_no) WHERE NOT m.is_def)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY l, s) - 1 AS line_no, line FROM together"""


WAVES = """base AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
waves AS (SELECT * FROM base UNION ALL SELECT vec_id + 1000000, label, list_transform(x, lambda v, i: v * (1 + (vec_id % 5) * 0.313::DOUBLE) + (i - 1) % 3 * 0.002::DOUBLE) FROM base),
rms AS (SELECT *, sqrt(list_dot_product(x, x) / len(x))::FLOAT AS rms FROM waves),
centred AS (SELECT *, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS c FROM rms),
units AS (SELECT *, CASE WHEN sqrt(list_dot_product(c, c)) < 1e-10 THEN list_transform(c, lambda v: 0.0::DOUBLE) ELSE list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) END AS u FROM centred)"""
SOUNDS = (
    WAVES
    + f""", sounds AS (
  SELECT {chart_path('vec_id % 1000000', 1900)} AS path, (vec_id % 1000000 % 1900 * 2 + CASE WHEN vec_id >= 1000000 THEN 2 ELSE 1 END)::BIGINT AS idx, label, rms, u, label || '_' || trunc(rms * 100::FLOAT)::INT AS block_key
  FROM units)"""
)
BAND = "b.rms::DOUBLE <= CASE WHEN a.rms::DOUBLE < 0.001 THEN 0.002::DOUBLE ELSE a.rms::DOUBLE * 1.25::DOUBLE END"


def swept(grid: str, sounds: str = "sounds") -> str:
    """For each run of a block and each threshold of ``grid``: its numbers in sweep order and, by position, what the sweep leaves.

    Events are the leaders in order, each followed by the files it matches.
    """
    return f"""chunked AS (SELECT *, (row_number() OVER (PARTITION BY path, block_key ORDER BY idx) - 1) // 100 AS chunk_no FROM {sounds}),
r AS (SELECT *, path || ' ' || block_key || ' ' || chunk_no AS run, row_number() OVER (PARTITION BY path, block_key, chunk_no ORDER BY rms, idx) AS rank FROM chunked),
runs AS (SELECT run, any_value(path) AS path, list(idx ORDER BY rank) AS nums FROM r GROUP BY run),
linked AS (SELECT a.run, a.rank AS i, b.rank AS j, greatest(-1, least(1, list_dot_product(a.u, b.u))) AS c FROM r a JOIN r b ON a.run = b.run AND a.rank < b.rank AND {BAND}),
grid AS ({grid}),
events AS (
  SELECT run, t, i, j, row_number() OVER (PARTITION BY run, t ORDER BY i, j) AS k
  FROM (SELECT run, t, rank AS i, rank AS j FROM r, grid UNION ALL SELECT run, t, i, j FROM linked JOIN grid ON c >= t)),
state(run, t, k, path, nums, slots, leads, here) USING KEY (run, t) AS (
  SELECT run, t, 0::BIGINT, path, nums, list_transform(nums, lambda x: 0::BIGINT), false, 0::BIGINT FROM runs, grid
  UNION
  SELECT s.run, s.t, e.k, s.path, s.nums,
    CASE WHEN e.i = e.j THEN (CASE WHEN s.slots[e.i] = 0 THEN list_transform(s.slots, lambda x, p: CASE WHEN p = e.i THEN e.i ELSE x END) ELSE s.slots END)
      WHEN s.leads AND s.slots[e.j] = 0 AND s.nums[e.j] < s.nums[s.here] THEN list_transform(s.slots, lambda x, p: CASE WHEN p = s.here THEN e.j ELSE x END)
      WHEN s.leads AND s.slots[e.j] = 0 THEN list_transform(s.slots, lambda x, p: CASE WHEN p = e.j THEN s.here ELSE x END) ELSE s.slots END,
    CASE WHEN e.i = e.j THEN s.slots[e.i] = 0 ELSE s.leads END,
    CASE WHEN e.i = e.j THEN e.i WHEN s.leads AND s.slots[e.j] = 0 AND s.nums[e.j] < s.nums[s.here] THEN e.j ELSE s.here END
  FROM state s JOIN events e ON e.run = s.run AND e.t = s.t AND e.k = s.k + 1)"""


LEFT = """placed AS (SELECT run, t, path, unnest(nums) AS num_int, unnest(slots) AS slot, generate_subscripts(nums, 1) AS pos, nums, slots FROM state),
ends AS (
  SELECT run, t, pos, slot, slots FROM placed
  UNION ALL SELECT run, t, pos, slots[slot], slots FROM ends WHERE slots[slot] <> slot),
clusters AS (SELECT p.path, p.num_int, p.nums[p.slot] AS replace_to, p.nums[e.slot] AS root FROM placed p JOIN ends e ON e.run = p.run AND e.t = p.t AND e.pos = p.pos AND e.slots[e.slot] = e.slot)"""
COUNTS = """counted AS (SELECT path, t, sum(len(list_filter(slots, lambda x, p: x = p))) AS file_count FROM state GROUP BY path, t)"""


NAMED = STEMS + ", named AS (SELECT *, CASE WHEN idx % 13 <> 0 THEN ((idx % 37) / 64.0)::FLOAT END AS rms FROM stems)"
KEYWORD = "CASE WHEN contains(lower(stem), 'widget') THEN 'widget' WHEN contains(lower(stem), 'gear') THEN 'gear' WHEN contains(lower(stem), 'hot') THEN 'hot' WHEN contains(lower(stem), 'a') THEN 'a' WHEN contains(lower(stem), 'o') THEN 'o' END"
NOT_WORDS = "wav mp3 ogg flac aiff aif au raw pcm bit khz mono stereo left right mid side loop oneshot shot sample smp sfx fx edit mix master final ver version v01 v02 v03 test temp tmp backup bak copy new old untitled noname default misc other unknown file audio sound track song music bms bme bml bmg"


def words(stem: str) -> str:
    head = "regexp_extract(p, '^[a-zA-Z]+', 0)"
    whole = "CASE WHEN length(p) BETWEEN 3 AND 20 AND regexp_full_match(p, '[a-zA-Z][a-zA-Z0-9]*') THEN p END"
    parts = rf"list_filter(string_split_regex({stem}, '[_\- .()\[\]{{}}]'), lambda p: p <> '' AND NOT regexp_full_match(p, '\d+'))"
    return f"flatten(list_transform({parts}, lambda p: list_filter([CASE WHEN length({head}) >= 3 THEN {head} END, {whole}], lambda w: w IS NOT NULL)))"


COUNTED = (
    STEMS
    + f""", split AS (SELECT path, idx, {words('stem')} AS ws FROM stems),
found AS (SELECT path, idx, unnest(ws) AS shown, generate_subscripts(ws, 1) AS pos FROM split),
counted AS (
  SELECT path, lower(shown) AS word, arg_min(shown, idx * 1000 + pos) AS shown, count(*) AS cnt, min(idx * 1000 + pos) AS first FROM found
  WHERE length(shown) BETWEEN 3 AND 20 AND lower(shown) NOT IN ({', '.join(repr(x) for x in NOT_WORDS.split())}) GROUP BY path, lower(shown) HAVING count(*) >= 3),
matched AS (
  SELECT f.path, f.idx, c.shown, row_number() OVER (PARTITION BY f.path, f.idx ORDER BY c.cnt DESC, c.first) AS rn FROM stems f JOIN counted c ON f.path = c.path AND contains(lower(f.stem), c.word)),
instruments AS (SELECT f.path, f.idx, coalesce(m.shown, '') AS instrument FROM files f LEFT JOIN matched m ON f.path = m.path AND f.idx = m.idx AND m.rn = 1)"""
)
POINTS = """points AS (
  SELECT dayofyear(o_orderdate) / 1000.0::DOUBLE AS threshold, dayofyear(o_orderdate) * 11 - 300 + count(*) % 7 AS file_count FROM orders GROUP BY dayofyear(o_orderdate))"""


def best(limit: int, points: str = "points") -> str:
    fits, some = f"file_count BETWEEN 1 AND {limit}", "file_count > 0"
    return f"""SELECT {limit if points == 'points' else 0} AS file_limit,
  coalesce(max(threshold) FILTER ({fits}), arg_min(threshold, file_count * 1000 - threshold) FILTER ({some}), 0.6::DOUBLE) AS threshold,
  coalesce(arg_max(file_count, threshold) FILTER ({fits}), arg_min(file_count, file_count * 1000 - threshold) FILTER ({some}), 0)::BIGINT AS file_count FROM {points}"""


def bounds(start: int, end: int) -> str:
    return f"""SELECT path, {start} AS asked_start, {end} AS asked_end, greatest(arg_min(num_int, idx), {max(start, 1)}) AS start_point,
  least(greatest(max(num_int), 1), least({end if end > 0 else 'greatest(max(num_int), 1)'}, 3842)) AS end_point FROM files GROUP BY path"""


PEARSON = """sums AS (
  SELECT *, len(x) AS n, list_sum(x) AS sx, list_sum(y) AS sy, list_dot_product(x, x) AS sxx, list_dot_product(y, y) AS syy FROM made),
spread AS (SELECT *, sxx - sx * sx / n AS vx, syy - sy * sy / len(y) AS vy FROM sums)"""

#: The production grid as the sweep holds it, in single precision.
GRID = "SELECT ((100 - n) / 100.0::DOUBLE)::FLOAT::DOUBLE AS t FROM range(101) g(n)"
LOADED = "loaded AS (SELECT vec_id, embedding, 'v' || vec_id || '.wav' AS path, CASE WHEN vec_id % 9 = 0 THEN 'not a RIFF/WAVE or AIFF file' WHEN vec_id % 11 = 0 THEN 'no samples' ELSE '' END AS error FROM embeddings)"

SQL: dict[str, str] = {
    "id_encode_36": f"SELECT p_partkey, {enc('p_partkey % 1296', 36)} AS id36, CASE WHEN p_partkey <= 1295 THEN {enc('p_partkey', 36)} END AS in_range FROM part",
    "id_encode_62": f"SELECT p_partkey, {enc('p_partkey % 3844')} AS id62, {enc('p_partkey % 3844')} AS other_base FROM part",
    "id_decode_62": f"WITH {FILES} SELECT idx, num, {dec('num')} AS as62, {dec('num', 36)} AS as36 FROM files",
    "id_invalid_flags": f"""WITH t AS (SELECT c_custkey, substr(c_name, 1, c_custkey % 4) AS typed FROM customer)
SELECT c_custkey, typed, {dec('typed')} IS NULL AS invalid62, regexp_full_match(typed, '[0-9A-Za-z]{{0,2}}') AS legal, CASE WHEN typed = '' THEN '' ELSE lpad(typed, 2, '0') END AS padded FROM t""",
    "range_validate": f"""WITH {FILES}, t AS (SELECT idx, substr(num, 1, idx % 7 + 1) AS start_id, {enc('idx * 37 % 3844')} AS end_id FROM files)
SELECT idx, start_id, end_id, CASE WHEN length(start_id) <> 2 THEN 'start length' WHEN length(end_id) <> 2 THEN 'end length' WHEN {dec('start_id')} IS NULL OR {dec('end_id')} IS NULL THEN 'format'
  WHEN {dec('start_id')} < 1 THEN 'start too low' WHEN {dec('end_id')} <= {dec('start_id')} THEN 'end not after start' ELSE '' END AS error FROM t""",
    "field_validate": f"""WITH {FILES}, t AS (SELECT idx, idx % 130 - 10 AS v, {dec('num', 36)} AS s, idx * 41 % 1296 AS e FROM files)
SELECT idx, CASE WHEN v BETWEEN 0 AND 100 THEN '' ELSE 'out of range' END AS threshold_error,
  CASE WHEN s IS NULL THEN 'format' WHEN s < 1 THEN 'too low' WHEN s >= e THEN 'not below end' ELSE '' END AS start_error,
  CASE WHEN e = 0 THEN '' WHEN s IS NULL THEN 'format' WHEN e <= s THEN 'not above start' ELSE '' END AS end_error FROM t""",
    "threshold_parse": r"""WITH t AS (
  SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey::VARCHAR WHEN 1 THEN (s_suppkey % 120) || '%' WHEN 2 THEN '0.' || s_suppkey WHEN 3 THEN '-' || s_suppkey
    WHEN 4 THEN (s_suppkey % 130) || '.5' ELSE ['', ' ', 'NaN', 'x', '1', '1%'][(s_suppkey % 36 // 6 + 1)::INT] END AS typed FROM supplier),
c AS (SELECT *, trim(rtrim(typed, '%')) AS clean FROM t),
p AS (SELECT *, CASE WHEN regexp_full_match(clean, '[+-]?\d+') THEN try_cast(clean AS INT) END AS whole, CASE WHEN regexp_full_match(clean, '[+-]?(\d+\.?\d*|\.\d+)') THEN try_cast(clean AS FLOAT) END AS part FROM c),
v AS (SELECT *, (CASE WHEN whole = 1 THEN 1.0 WHEN whole BETWEEN 0 AND 100 THEN whole / 100.0 WHEN whole IS NULL AND part BETWEEN 0 AND 1 THEN part WHEN whole IS NULL AND part > 1 AND part <= 100 THEN part / 100.0 END)::FLOAT AS value FROM p),
e AS (SELECT *, CASE WHEN trim(typed) = '' THEN 'missing' WHEN whole IS NULL AND part IS NULL THEN 'format' WHEN value IS NULL THEN 'out of range' ELSE '' END AS error FROM v)
SELECT s_suppkey, typed, CASE WHEN error = '' THEN round(value::DOUBLE, 6) END AS value, error FROM e""",
    "processing_range": f"WITH {FILES} " + " UNION ALL ".join(bounds(*x) for x in ((-5, 50), (1, 5000), (100, 0), (1, 3843))),
    "path_functions": r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS file_name, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem,
  regexp_extract(url, '(\.[^./\\]+)$', 1) AS ext, regexp_replace(url, '[/\\]?[^/\\]*$', '') AS dir, regexp_matches(url, '^([/\\]|[A-Za-z]:)') AS rooted,
  CASE WHEN regexp_matches(url, '^([/\\]|[A-Za-z]:)') THEN url ELSE 'base/' || url END AS combined, trim(url, '"') AS unquoted FROM pages""",
    "chart_names": r"""WITH t AS (SELECT p_partkey, 'a.b/' || replace(p_name, ' ', '.') || ['.bms', '.BME', '.bml', '.pms', '.txt', ''][(p_partkey % 6 + 1)::INT] AS file FROM part),
e AS (SELECT *, regexp_extract(file, '(\.[^./\\]+)$', 1) AS ext FROM t)
SELECT p_partkey, lower(ext) IN ('.bms', '.bme', '.bml', '.pms') AS is_chart,
  CASE lower(ext) WHEN '.bms' THEN 'BMSファイル' WHEN '.bme' THEN 'BMEファイル' WHEN '.bml' THEN 'BMLファイル' WHEN '.pms' THEN 'PMSファイル' ELSE 'ファイル' END AS type_name,
  substr(file, 1, length(file) - length(ext)) || '_optimized' || ext AS output FROM e""",
    "display_conversions": r"""WITH t AS (SELECT p_partkey, p_partkey AS k, (p_partkey % 1000) / 1024.0::DOUBLE AS r,
  CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 140 - 20)::VARCHAR WHEN 1 THEN '0.' || (p_partkey % 90 + 10) ELSE 'none' END AS shown FROM part)
SELECT p_partkey, round_even(r * 100, 0)::INT AS percent,
  CASE k % 3 WHEN 0 THEN printf('%.2f', least(greatest(k % 140 - 20, 0), 100) / 100.0::DOUBLE) WHEN 1 THEN shown ELSE '0.40' END AS entered,
  round(200.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, r * 2 - 0.5::DOUBLE)), 6) AS width, shown || '%' AS with_unit, shown AS without_unit, regexp_full_match(shown, '[0-9.]*') AS numeric FROM t""",
    "line_classify": rf"""WITH {CHART}, t AS (SELECT path, line_no, CASE WHEN line_no % 11 = 0 THEN '  ' || line ELSE line END AS line FROM chart)
SELECT path, CASE WHEN regexp_matches(trim(line), '^#(WAV|BMP|BPM|STOP)[0-9A-Za-z]{{2}}') THEN 'HEADER' WHEN regexp_matches(trim(line), '^#\d{{5}}:') THEN 'MAIN' ELSE 'OTHER' END AS class,
  regexp_matches(line, '(?i)^#WAV[0-9A-Za-z]{{2}}') AS is_definition, count(*) AS n, min(line_no) AS first FROM t GROUP BY ALL""",
    "wav_def_scan": f"WITH {DEFINED} SELECT path, idx, num, name FROM defined",
    "file_list": f"""WITH {DEFINED}, radix AS (SELECT path, CASE WHEN bool_or(regexp_matches(num, '[a-z]')) THEN 62 ELSE 36 END AS radix FROM defined GROUP BY path),
listing AS (SELECT 'songs/' || name AS full_name, file_size FROM files WHERE idx % 4 <> 0)
SELECT 'songs/' || path AS path, d.idx, CASE WHEN l.full_name IS NOT NULL THEN (CASE WHEN radix = 62 THEN {dec('num')} ELSE {dec('num', 36)} END) END AS num_int, coalesce(l.full_name, d.name) AS name, l.file_size
FROM defined d JOIN radix USING (path) LEFT JOIN listing l ON l.full_name = 'songs/' || d.name""",
    "numbered_paths": "WITH t AS (SELECT p_partkey AS idx, row_number() OVER (ORDER BY p_partkey) + 4 AS num_int FROM part WHERE p_partkey % 3 <> 0) SELECT * FROM t WHERE num_int <= 800",
    "channel_filter": """WITH t AS (SELECT lpad(to_hex(n), 2, '0') AS c FROM range(256) r(n)), u AS (SELECT upper(c) AS channel FROM t)
SELECT channel, regexp_full_match(channel, '01|[1-6DE][1-9]') AS is_sound, regexp_full_match(channel, '01|[1-6DE][1-9]') AS lower_too FROM u""",
    "base_detection": f"WITH {FILES} SELECT num_int < 1296 AS low, CASE WHEN bool_or(regexp_matches(num, '[a-z]')) THEN 62 ELSE 36 END AS radix, max(num_int) AS largest FROM files GROUP BY 1",
    "keep_first_dedup": f"WITH {kept()} SELECT path, place, num_int, idx, name FROM kept",
    "survivor_renumber": f"WITH {kept()} SELECT path, num_int, new_int, new_num, name FROM numbered",
    "final_id_map": f"WITH {kept()} SELECT path, num, new_num FROM mapped",
    "token_rewrite": rewritten(kept(CHART), "substr(name, 8)"),
    "change_definition": rf"""WITH {kept(CHART)}, sounding AS (SELECT * FROM chart WHERE regexp_matches(line, '^#\d{{3}}(01|[1-6DEde][1-9]):.')), {changed('sounding')}
SELECT l.path, l.line_no, coalesce(c.line, l.line) AS line FROM chart l LEFT JOIN changed c USING (path, line_no)""",
    "undefined_refs_anti": rf"""WITH {kept(CHART)}, split AS (
  SELECT path, regexp_extract_all(substr(line, 8), '..') AS ts FROM chart WHERE regexp_matches(line, '^#\d{{5}}:') AND regexp_matches(line, '^#\d{{3}}(01|[1-6DE][1-9]):.')),
used AS (SELECT DISTINCT path, unnest(ts) AS id FROM split)
SELECT path, id FROM used u WHERE id <> '00' AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.path = u.path AND m.num = u.id AND m.num < 'P')""",
    "unused_paths_anti": f"WITH {kept()} SELECT path, name FROM files f WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.path = f.path AND lower(n.name) = lower(f.name))",
    "vec_rms": f"""WITH {WAVES} SELECT vec_id, round(rms::DOUBLE, 6) AS rms, trunc(rms * 100::FLOAT)::INT AS step,
  round(CASE WHEN rms::DOUBLE < 0.001 THEN 0 ELSE rms::DOUBLE * 0.8::DOUBLE END, 6) AS low, round(CASE WHEN rms::DOUBLE < 0.001 THEN 0.002::DOUBLE ELSE rms::DOUBLE * 1.25::DOUBLE END, 6) AS high FROM rms""",
    "vec_normalize": f"WITH {WAVES} SELECT vec_id, round(u[1], 6) + 0 AS first, round(u[64], 6) + 0 AS last, round(list_dot_product(u, u), 6) AS norm, list_max(list_transform(u, lambda v: abs(v))) <= 1e-9 AS zero FROM units",
    "vec_peak_normalize": f"""WITH {WAVES}, p AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v * 2))) AS peak FROM waves),
n AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN peak < 1e-10 THEN v * 2 ELSE v * 2 / peak END) AS n FROM p)
SELECT vec_id, round(n[1], 6) + 0 AS first, round(list_max(list_transform(n, lambda v: abs(v))), 6) AS peak FROM n""",
    "vec_rms_normalize": f"""WITH {WAVES}, n AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN rms::DOUBLE < 1e-10 THEN v ELSE v * 0.5::DOUBLE / rms::DOUBLE END) AS n FROM rms)
SELECT vec_id, round(n[1], 5) + 0 AS first, round(sqrt(list_dot_product(n, n) / len(n))::FLOAT::DOUBLE, 5) AS rms FROM n""",
    "leading_silence": f"""WITH {WAVES}, l AS (SELECT vec_id, list_transform(x, lambda v, i: abs(CASE WHEN i - 1 < vec_id % 50 THEN v * 0.0001::DOUBLE ELSE v END) > 0.001 OR abs(CASE WHEN i - 1 < vec_id % 33 THEN v * 0.0001::DOUBLE ELSE v END) > 0.001) AS loud FROM waves),
s AS (SELECT vec_id, greatest(coalesce(list_position(loud, true), 0) - 1, 0) AS silence FROM l)
SELECT vec_id, silence, 64 AS samples, 64 - silence AS effective, round(4 * 64 * 4 / 1048576.0::DOUBLE, 9) AS megabytes FROM s""",
    "deinterleave": f"WITH {WAVES} SELECT vec_id, vec_id % 3 + 1 AS channels, 64 // (vec_id % 3 + 1) AS frames, round(x[2 * (vec_id % 3 + 1)], 6) + 0 AS second FROM waves",
    "load_statistics": f"""WITH {WAVES}, t AS (SELECT vec_id % 9 <> 0 AS ok FROM waves)
SELECT count(*) AS processed, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) * 2 * 64 * 4 / 1048576.0::DOUBLE, 6) AS megabytes,
  round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 6) AS success_percent, count(*) FILTER (ok) * 100.0::DOUBLE / count(*) < 90 AS warn FROM t""",
    "pearson_pairs": f"""WITH {WAVES}, p AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, greatest(-1, least(1, list_dot_product(a.u, b.u))) AS r FROM units a JOIN units b ON a.label = b.label AND a.vec_id < b.vec_id WHERE b.vec_id < 1000000)
SELECT label, id_a, id_b, round(r, 6) AS r FROM p WHERE r >= 0.3""",
    "pearson_raw_edgecases": f"""WITH base AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
made AS (SELECT vec_id, CASE WHEN vec_id % 6 = 5 THEN e[1:3] WHEN vec_id % 6 = 1 AND vec_id % 4 = 1 THEN list_transform(e, lambda v: 0.5::DOUBLE) ELSE e END AS x,
  CASE vec_id % 6 WHEN 0 THEN list_transform(e, lambda v: -v) WHEN 1 THEN list_transform(e, lambda v: 0.5::DOUBLE) WHEN 2 THEN e[1:10] WHEN 3 THEN list_transform(e, lambda v: v * 3 + 1) WHEN 4 THEN list_reverse(e) ELSE e[1:3] END AS y FROM base),
{PEARSON}
SELECT vec_id, round(CASE WHEN len(x) <> len(y) THEN 0.0 WHEN n < 4 AND x = y THEN 1.0 WHEN vx < 1e-10 AND vy < 1e-10 THEN (CASE WHEN abs(sx / n - sy / n) < 1e-6 THEN 1.0 ELSE 0.0 END) WHEN vx < 1e-10 OR vy < 1e-10 THEN 0.0
  ELSE greatest(-1, least(1, (list_dot_product(x, list_resize(y, len(x), 0.0)) - sx * sy / n) / sqrt(vx * vy))) END, 6) + 0 AS r FROM spread""",
    "r_squared_pairs": """WITH one AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
t AS (SELECT a.vec_id, a.x, b.x AS y, list_transform(a.x, lambda v, i: v * 0.9::DOUBLE + b.x[i] * 0.1::DOUBLE) AS m FROM one a JOIN one b ON b.vec_id = a.vec_id + 1),
s AS (SELECT *, list_dot_product(x, x) - list_sum(x) * list_sum(x) / len(x) AS spread, list_transform(x, lambda v, i: v - m[i]) AS dm, list_transform(x, lambda v, i: v - y[i]) AS dy FROM t)
SELECT vec_id, round(greatest(0, least(1, 1 - list_dot_product(dm, dm) / spread)), 6) AS close, round(greatest(0, least(1, 1 - list_dot_product(dy, dy) / spread)), 6) AS far FROM s""",
    "block_keys": f"WITH {SOUNDS} SELECT path, block_key, count(*) AS n, min(idx) AS first FROM sounds GROUP BY path, block_key",
    "keyword_block_keys": f"""WITH {NAMED}, k AS (SELECT path, {KEYWORD} AS keyword, file_size || '_' || trunc(rms * 100::FLOAT)::INT AS block_key FROM named WHERE num_int BETWEEN 10 AND 3000 AND rms IS NOT NULL)
SELECT path, keyword, block_key, count(*) AS n, (count(*) - 1) // 100 AS last_chunk FROM k WHERE keyword IS NOT NULL GROUP BY ALL""",
    "keyword_totals": f"""WITH {NAMED}, k AS (SELECT num_int BETWEEN 10 AND 3000 AS inside, rms IS NOT NULL AS loaded, contains(lower(stem), 'widget') OR contains(lower(stem), 'gear') OR contains(lower(stem), 'hot') OR contains(lower(stem), 'a') AS found FROM named)
SELECT count(*) FILTER (inside) AS in_range, count(*) FILTER (NOT inside) AS out_of_range, count(*) FILTER (inside AND NOT loaded) AS no_sound, count(*) FILTER (inside AND loaded AND NOT found) AS no_keyword, count(*) FILTER (inside AND loaded AND found) AS matched FROM k""",
    "group_chunking": f"WITH {NAMED} SELECT path, idx, '0_50' AS block_key, (row_number() OVER (PARTITION BY path ORDER BY idx) - 1) // 100 AS chunk_no FROM named WHERE rms IS NOT NULL",
    "band_join_pairs": f"""WITH {SOUNDS}, r AS (SELECT path, idx, rms, (idx - 1) // 100 AS chunk_no, row_number() OVER (PARTITION BY path, (idx - 1) // 100 ORDER BY rms, idx) AS rank FROM sounds)
SELECT a.path, a.chunk_no, count(*) AS pairs, sum(a.idx * 4000 + b.idx)::BIGINT AS checksum FROM r a JOIN r b ON a.path = b.path AND a.chunk_no = b.chunk_no AND a.rank < b.rank AND {BAND} GROUP BY ALL""",
    "exact_name_pairs": """WITH p AS (SELECT p_partkey AS k, p_name, p_size, CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE '' END AS print FROM part)
SELECT a.k AS id_a, b.k AS id_b, a.p_name = b.p_name AS by_name FROM p a JOIN p b ON a.p_size = b.p_size AND a.k < b.k WHERE a.p_name = b.p_name OR (a.print <> '' AND a.print = b.print)""",
    "matching_pairs": f"""WITH {SOUNDS}, c AS (SELECT *, (row_number() OVER (PARTITION BY path, block_key ORDER BY idx) - 1) // 100 AS chunk_no FROM sounds),
r AS (SELECT *, row_number() OVER (PARTITION BY path, block_key, chunk_no ORDER BY rms, idx) AS rank FROM c),
p AS (SELECT a.path, a.idx AS num_a, b.idx AS num_b, greatest(-1, least(1, list_dot_product(a.u, b.u))) AS r FROM r a JOIN r b ON a.path = b.path AND a.block_key = b.block_key AND a.chunk_no = b.chunk_no AND a.rank < b.rank AND {BAND})
SELECT path, num_a, num_b, round(r, 6) AS r, 'correlation' AS how FROM p WHERE r >= 0.3""",
    "filename_tokens": rf"""WITH t AS (SELECT p_partkey, regexp_replace(replace(p_name, ' ', '-') || p_partkey || '_v2.(' || p_brand || ') 99.wav', '\.[^.]*$', '') AS stem FROM part)
SELECT p_partkey, array_to_string({words('stem')}, '|') AS words FROM t""",
    "word_counts_having": f"WITH {COUNTED} SELECT path, word, shown, cnt FROM counted",
    "prefix_facets_topk": rf"""WITH {STEMS}, p AS (SELECT path, idx, list_filter(string_split_regex(stem, '[_\- ]'), lambda x: x <> '')[1] AS part FROM stems),
c AS (SELECT path, arg_min(part, idx) AS keyword, count(*) AS cnt, min(idx) AS first FROM p WHERE length(part) >= 3 GROUP BY path, lower(part) HAVING count(*) >= 2)
SELECT path, keyword, cnt, TRUE AS is_selected FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY cnt DESC, first) <= 8""",
    "instrument_best_match": f"WITH {COUNTED} SELECT path, idx, instrument FROM instruments",
    "instrument_facets": f"""WITH {COUNTED}, c AS (SELECT path, instrument AS keyword, count(*) AS cnt, min(idx) AS first FROM instruments WHERE length(instrument) >= 3 GROUP BY ALL HAVING count(*) >= 2)
SELECT path, keyword, cnt FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY cnt DESC, first) <= 8""",
    "text_and_set_filter": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') AND lower(p_brand) IN ('brand#1', 'brand#23', 'brand#4')",
    "chip_filter": f"""WITH {STEMS}, t AS (SELECT *, CASE WHEN idx % 3 = 0 THEN string_split_regex(name, '[/_]')[2] ELSE '' END AS instrument FROM stems)
SELECT idx FROM t WHERE CASE WHEN instrument <> '' THEN lower(instrument) IN ('widget', 'gear', 'hot') ELSE contains(lower(stem), 'widget') OR contains(lower(stem), 'gear') OR contains(lower(stem), 'hot') END""",
    "keyword_first_match": f"WITH {STEMS}, k AS (SELECT path, idx, {KEYWORD} AS keyword FROM stems) SELECT * FROM k WHERE keyword IS NOT NULL",
    "name_lookup": f"WITH {FILES} SELECT idx, CASE WHEN idx % 2 = 0 THEN 'i' || (idx % 9) ELSE '' END AS instrument FROM files",
    "reduction_stats": f"""WITH {FILES}, {REPLACES}, t AS (SELECT f.path, f.num_int, coalesce(r.replace_to, 0) AS t FROM files f LEFT JOIN replaces r USING (path, num_int) WHERE f.num_int BETWEEN 10 AND 3000)
SELECT path, count(*) AS total, count(*) FILTER (t = num_int) AS unique_files, count(*) FILTER (t > 0 AND t <> num_int) AS replaced, count(*) FILTER (t <= 0 AND t <> num_int) AS not_processed,
  count(*) FILTER (t = num_int) + count(*) FILTER (t > 0 AND t <> num_int) AS processed, round(coalesce(count(*) FILTER (t > 0 AND t <> num_int) * 100.0::DOUBLE / nullif(count(*), 0), 0), 6) AS reduction_percent FROM t GROUP BY path""",
    "reduction_rate": "SELECT p_brand, round((count(*) - count(DISTINCT p_name)) / count(*)::DOUBLE, 6) AS rate FROM part GROUP BY p_brand",
    "replace_root_resolution": f"""WITH RECURSIVE {FILES}, {REPLACES}, walk AS (
  SELECT path, num_int, num_int AS here FROM replaces
  UNION SELECT w.path, w.num_int, r.replace_to FROM walk w JOIN replaces r ON r.path = w.path AND r.num_int = w.here AND r.replace_to > 0 AND r.replace_to <> w.here),
ends AS (SELECT path, num_int, min(here) AS root FROM walk GROUP BY ALL)
SELECT path, num_int, replace_to, root FROM replaces JOIN ends USING (path, num_int)""",
    "threshold_grid": "SELECT (100 - n) / 100.0::DOUBLE AS threshold FROM range(101) t(n)",
    "optimal_threshold_topone": f"WITH {POINTS}, nothing AS (SELECT * FROM points WHERE file_count > 100000) " + " UNION ALL ".join([*(best(x) for x in (1295, 3843, 1)), best(1295, "nothing")]),
    "sweep_take_while": f"""WITH {POINTS}, t AS (SELECT *, coalesce(sum(CASE WHEN file_count <= 1295 THEN 1 ELSE 0 END) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM points)
SELECT threshold, file_count FROM t WHERE hits = 0""",
    "greedy_clusters": f"WITH RECURSIVE {SOUNDS}, {swept('SELECT 0.3::DOUBLE AS t')}, {LEFT} SELECT path, num_int::INT AS num_int, replace_to::INT AS replace_to, root::INT AS root FROM clusters",
    "sweep_counts": f"WITH RECURSIVE {SOUNDS}, {swept(GRID)}, {COUNTS} SELECT path, round(t::DOUBLE, 2) AS threshold, file_count::BIGINT AS file_count FROM counted",
    "find_optimum": f"""WITH RECURSIVE {SOUNDS}, loaded AS (SELECT * FROM sounds WHERE idx % 17 <> 0), failed AS (SELECT path, count(*) AS failed, arg_min(idx, idx) AS first FROM sounds WHERE idx % 17 = 0 GROUP BY path),
{swept(GRID, 'loaded')}, {COUNTS}, full_counts AS (SELECT path, round(t::DOUBLE, 2) AS threshold, file_count + coalesce(failed, 0) AS file_count FROM counted LEFT JOIN failed USING (path)),
points AS (SELECT path, threshold, file_count FROM (SELECT *, coalesce(sum(CASE WHEN file_count <= 1295 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM full_counts) WHERE hits = 0),
chosen AS (SELECT path, {', '.join(f"""coalesce(max(threshold) FILTER (file_count BETWEEN 1 AND {n}), arg_min(threshold, file_count * 1000 - threshold) FILTER (file_count > 0), 0.6::DOUBLE) AS t{n},
  coalesce(arg_max(file_count, threshold) FILTER (file_count BETWEEN 1 AND {n}), arg_min(file_count, file_count * 1000 - threshold) FILTER (file_count > 0), 0)::BIGINT AS c{n}""" for n in (1295, 3843))} FROM points GROUP BY path)
SELECT path, t1295 AS base36_threshold, c1295 AS base36_count, CASE WHEN c3843 = 0 OR t3843 < t1295 THEN t1295 ELSE t3843 END AS base62_threshold, CASE WHEN c3843 = 0 OR t3843 < t1295 THEN c1295 ELSE c3843 END AS base62_count,
  CASE WHEN failed IS NULL THEN '' WHEN failed = 1 THEN '1 sound couldn''t be loaded and was left out: v' || lpad(first::VARCHAR, 4, '0') || '.wav' ELSE failed || ' sounds couldn''t be loaded and were left out' END AS warning FROM chosen LEFT JOIN failed USING (path)""",
    "reduce_pipeline": rewritten(kept(
        SOUNDS + f""", files AS (SELECT path, idx, idx::INT AS num_int, {enc('idx')} AS num, 'v' || lpad(idx::VARCHAR, 4, '0') || '.wav' AS name FROM sounds),
used AS (SELECT path, idx % 400 AS k, string_agg(num, '' ORDER BY idx) AS data FROM files GROUP BY ALL),
chart AS (SELECT path, idx AS line_no, '#WAV' || num || ' ' || name AS line FROM files UNION ALL SELECT path, k + 10000, '#' || lpad(k::VARCHAR, 3, '0') || '11:' || data FROM used)""",
        swept("SELECT 0.3::DOUBLE AS t") + ", " + LEFT + ", replaces AS (SELECT path, num_int::INT AS num_int, replace_to::INT AS replace_to FROM clusters)", 1, 3842)),
    "wave_decode": f"""WITH {LOADED}, w AS (SELECT *, CASE WHEN error = '' THEN list_transform(embedding, lambda v: floor(v::DOUBLE * 32767 + 0.5) / 32768::DOUBLE) END AS x FROM loaded)
SELECT path, CASE error WHEN '' THEN 172 WHEN 'no samples' THEN 44 ELSE 1 END::BIGINT AS file_size, CASE WHEN error = '' THEN 44100 END AS rate, CASE WHEN error = '' THEN 2 END AS channels, CASE WHEN error = '' THEN 16 END AS bits,
  CASE WHEN error = '' THEN 32 ELSE 0 END AS frames, round(x[10], 6) AS fifth_right, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64)::FLOAT::DOUBLE, 5) AS rms, error FROM w""",
    "lazy_load": f"WITH {LOADED}, l AS (SELECT path, CASE WHEN vec_id % 4 = 0 THEN 'missing' ELSE error END AS error FROM loaded) SELECT path, error = '' AS loaded, error FROM l",
    "in_memory_sounds": """WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT vec_id, 48000 AS sample_rate, 2 AS channels, 24 AS bits, len(x)::INT AS frames, round(sqrt(list_dot_product(x, x) * 1.25::DOUBLE / (2 * len(x)))::FLOAT::DOUBLE, 5) AS rms, round(4 * len(x) * 4 / 1048576.0::DOUBLE, 9) AS megabytes FROM t""",
    "format_compat": """SELECT a.vec_id, a.vec_id % 2 = b.vec_id % 2 AND a.vec_id % 3 = b.vec_id % 3 AND least(a.vec_id % 5 + 1, len(a.embedding)) = least(b.vec_id % 5 + 1, len(b.embedding)) AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 6""",
    "first_failures": f"WITH {LOADED} SELECT path, error FROM loaded WHERE error <> '' ORDER BY path LIMIT 5",
    "path_validate": """WITH t AS (SELECT p_partkey, p_partkey % 13 = 0 AS blank, p_partkey % 3 = 0 AS no_out FROM part)
SELECT p_partkey, CASE WHEN blank THEN '' WHEN p_partkey % 7 = 0 THEN 'not found' WHEN p_partkey % 4 > 1 THEN 'not supported' ELSE '' END AS input_error,
  CASE WHEN no_out OR p_partkey % 2 = 0 THEN '' ELSE 'no folder' END AS output_error, NOT blank AND NOT no_out AS specified FROM t""",
    "all_errors": f"""WITH {FILES}, t AS (SELECT idx, idx % 130 - 10 AS v, {dec('num', 36)} AS s, idx * 41 % 1296 AS e FROM files)
SELECT idx, concat_ws('; ', CASE WHEN v NOT BETWEEN 0 AND 100 THEN 'out of range' END, CASE WHEN s IS NULL THEN 'format' WHEN s < 1 THEN 'too low' WHEN s >= e THEN 'not below end' END,
  CASE WHEN e = 0 THEN NULL WHEN s IS NULL THEN 'format' WHEN e <= s THEN 'not above start' END) AS errors FROM t""",
    "display_flags": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS opacity, p_partkey % 3 = 0 AS half, p_partkey % 3 = 1 AS inverse, p_partkey % 4 <> 2 AS there, p_partkey % 4 IN (1, 2) OR p_brand = '' AS blank FROM part""",
    "row_removal": f"WITH {FILES} SELECT path, idx FROM files WHERE NOT (idx % 7 = 3 OR file_size > 45)",
    "licence_order": "SELECT row_number() OVER (ORDER BY s_suppkey % 10 = 0 DESC, s_name) AS place, s_name AS name, s_suppkey % 10 = 0 AS is_app FROM supplier",
    "component_clusters": f"""WITH RECURSIVE {SOUNDS}, c AS (SELECT *, (row_number() OVER (PARTITION BY path, block_key ORDER BY idx) - 1) // 100 AS chunk_no FROM sounds),
link AS (SELECT a.path, a.idx AS a, b.idx AS b FROM c a JOIN c b ON a.path = b.path AND a.block_key = b.block_key AND a.chunk_no = b.chunk_no AND a.idx <> b.idx AND list_dot_product(a.u, b.u) >= 0.3),
reach AS (SELECT path, idx AS a, idx AS b FROM c UNION SELECT r.path, r.a, l.b FROM reach r JOIN link l ON r.path = l.path AND r.b = l.a)
SELECT path, a AS num_int, min(b) AS replace_to, min(b) AS root FROM reach GROUP BY path, a""",
}
