"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from resonara.llm import license_scan, quality_rules, secret_scan, substring_dedup
from resonara.llm.decontamination import words_of

#: Characters of the runs that the Markov models judge.
RUN = "A-Za-z0-9+/_=-"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    """The quality rules: measures and votes of each text, and the estimation as a recursion over one row of rates."""
    rules = range(len(quality_rules.RULES))
    functions = ", ".join(f"'{x}'" for x in quality_rules.FUNCTION_WORDS.split())
    conditions = (
        ("100 * symbols > 10 * n", "100 * symbols <= n"),
        ("symbols >= n", "10 * symbols <= n"),
        ("chars < 3 * n OR chars > 10 * n", "35 * n <= 10 * chars AND 10 * chars <= 65 * n"),
        ("dup >= 2 AND 100 * dup > 30 * lines", "dup = 0 AND lines >= 3"),
        ("100 * repeated > 30 * n", "100 * repeated < 5 * n"),
        ("100 * upper > 30 * latin AND latin >= 20", "100 * upper < 10 * latin"),
        ("10 * latin >= 6 * chars AND n >= 20 AND function = 0", "function >= 3"),
        ("100 * lettered < 80 * n", "100 * lettered >= 95 * n"),
        ("lines >= 3 AND 100 * ended < 10 * lines", "100 * ended >= 70 * lines"),
        ("n >= 50 AND 100 * different < 10 * n", "n >= 50 AND 100 * different >= 25 * n"),
    )
    votes = ", ".join(f"CASE WHEN n = 0 THEN 0 WHEN {bad} THEN 2 WHEN {good} THEN 1 ELSE 0 END AS v{k}" for k, (bad, good) in enumerate(conditions))
    evidence = " + ".join(f"CASE v{k} WHEN 2 THEN ln(g{k} / b{k}) WHEN 1 THEN ln((1 - g{k}) / (1 - b{k})) ELSE 0 END" for k in rules)
    posterior = f"1 / (1 + exp(-(ln(1 - share) - ln(share) + {evidence})))"
    names = ", ".join(f"v{k}" for k in rules)

    def rate(weight: str, prior: float, k: int) -> str:
        return f"(coalesce(sum(c * {weight}) FILTER (v{k} = 2), 0) + 20 * {prior}::DOUBLE) / (coalesce(sum(c * {weight}) FILTER (v{k} <> 0), 0) + 20)"

    good = ", ".join(f"least(greatest({rate('p', 0.05, k)}, 1e-4::DOUBLE), 0.45::DOUBLE) AS g{k}" for k in rules)
    bad = ", ".join(f"{rate('(1 - p)', 0.4, k)} AS r{k}" for k in rules)
    bounded = ", ".join(f"least(greatest(r{k}, 2 * g{k}, 1e-3::DOUBLE), 0.99::DOUBLE) AS b{k}" for k in rules)
    return rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS dense,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts
), windows AS (
  SELECT row, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS w FROM split WHERE len(ws) > 2
), again AS (
  SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1
), covered AS (
  SELECT row, count(DISTINCT place) AS repeated FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY row
), measured AS (
  SELECT row, doc_id, len(ws) AS n, length(dense) AS chars, length(regexp_replace(dense, '[^#*$%&|<>]', '', 'g')) AS symbols, len(ls) - len(list_distinct(ls)) AS dup, coalesce(repeated, 0) AS repeated, len(ls) AS lines,
    length(regexp_replace(dense, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(dense, '[^A-Za-z]', '', 'g')) AS latin, len(list_intersect(list_distinct(ws), [{functions}])) AS function,
    len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS lettered, len(list_filter(ls, lambda l: regexp_matches(l, '[.!?"'':)…”»。！？][\x20\x09-\x0D]*$'))) AS ended, len(list_distinct(ws)) AS different
  FROM split LEFT JOIN covered USING (row)
), voted AS (
  SELECT *, {votes} FROM measured
), patterns AS (
  SELECT {names}, count(*) AS c FROM voted GROUP BY ALL
), model AS (
  SELECT 0 AS round, 0.2::DOUBLE AS share, {', '.join(f'0.05::DOUBLE AS g{k}' for k in rules)}, {', '.join(f'0.4::DOUBLE AS b{k}' for k in rules)}
  UNION ALL
  SELECT round, least(greatest(s, 1e-3::DOUBLE), 0.95::DOUBLE), {', '.join(f'g{k}' for k in rules)}, {bounded} FROM (
    SELECT round + 1 AS round, (sum(c * (1 - p)) + 20 * 0.2::DOUBLE) / (sum(c) + 20) AS s, {good}, {bad}
    FROM (SELECT m.round, c, {names}, {posterior} AS p FROM model m, patterns WHERE m.round < {quality_rules.ROUNDS}) GROUP BY round)
)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, repeated::BIGINT AS n_repeat_words,
  n < 50 OR 100 * repeated > 50 * n AS base_failed, NOT (n < 50 OR 100 * repeated > 50 * n) AND p >= 0.5 AS kept, round(p, 6) AS quality
FROM (SELECT v.*, {posterior} AS p FROM voted v, model WHERE round = {quality_rules.ROUNDS})"""


def secret_sql() -> str:
    """The secret scan: spans of each kind by running sums of lengths, and both Markov models counted from the same samples."""
    scan = secret_scan
    rows, letters, words = scan.RANDOM_STRINGS, "".join(scan.ALPHABET), scan.WORDS.split()

    def some(salt: int, below: int) -> str:
        return f"('0x' || substr(sha256('{salt} ' || n), 1, 8))::BIGINT % {below}"

    date = lambda salt: f"(2000 + {some(salt, 30)}) || '-' || lpad(({some(salt + 1, 12)} + 1)::VARCHAR, 2, '0') || '-' || lpad(({some(salt + 2, 28)} + 1)::VARCHAR, 2, '0')"
    cut = lambda *parts: " || '-' || ".join(f"substr(h, {a}, {z})" for a, z in parts)
    kinds = (
        "array_to_string(ws, '_') || number",
        "array_to_string(list_transform(ws, lambda w: upper(w[1]) || substr(w, 2)), '') || number",
        "array_to_string(ws, '-') || number",
        "upper(array_to_string(ws, '_')) || '_' || number",
        cut((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)),
        f"{date(10)} || '-' || {date(20)} || '-' || lpad(({some(30, 10_000)})::VARCHAR, 4, '0')",
        f"CASE WHEN {some(8, 4)} = 0 THEN repeat(substr('{letters}', ({some(34, len(letters))} + 1)::INT, 1), {some(9, 20)} + 20) ELSE substr(translate(h, 'abcdef', '012345'), 1, ({some(9, 20)} + 20)::INT) END",
        f"substr(translate(h, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, ({some(9, 40)} + 20)::INT)",
        f"array_to_string(ws, '/') || '/v' || {some(31, 20)} || '-' || {some(32, 20)} || '-' || {some(33, 100)}",
        cut((1, 6), (7, 6), (13, 6), (19, 6)),
    )
    five = ", ".join(f"words[({some(k, len(words))} + 1)::INT]" for k in range(5))
    found = " UNION ALL ".join(
        f"SELECT row, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, {quoted(pattern)}) AS ms, regexp_extract_all(text, {quoted(pattern)}, {group}) AS gs, string_split_regex(text, {quoted(pattern)}) AS gaps, {least} AS least FROM texts"
        for rank, (kind, pattern, group, least, _) in enumerate((*scan.KINDS, (scan.MODEL_KIND, f"[{RUN}]+", 0, scan.LEAST_TOKEN, ())))
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT string_split('{scan.WORDS}', ' ') AS words
), made AS (
  SELECT 'random' AS label, substr(CASE n % 4 WHEN 0 THEN p WHEN 1 THEN rtrim(translate(p, '+/', '-_'), '=') WHEN 2 THEN bare ELSE upper(bare) END, 1, [44, 40, 32, 24][(n // 4 % 4 + 1)::INT]) AS token, 1::BIGINT AS times
  FROM (SELECT *, regexp_replace(p, '[+/=]', '', 'g') AS bare FROM (SELECT n, to_base64(unhex(sha256(n::VARCHAR))) AS p FROM range({rows}) t(n)))
  UNION ALL
  SELECT 'ordinary', CASE n % {len(kinds)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(kinds))} END, 1
  FROM (SELECT n, sha256('ordinary ' || n) AS h, [{five}][1:{some(5, 5)} + 1] AS ws, CASE WHEN {some(6, 3)} = 0 THEN ({some(7, 1000)})::VARCHAR ELSE '' END AS number FROM range({3 * rows}) t(n), listed)
  UNION ALL
  SELECT 'corpus', token, count(*) FROM (SELECT unnest(regexp_extract_all(text, '{scan.CORPUS_TOKEN}')) AS token FROM texts) WHERE length(token) < {scan.LEAST_TOKEN} GROUP BY token
), pairs AS (
  SELECT label, substr(token, i, 2) AS pair, sum(times) AS c FROM (SELECT label, token, times, unnest(range(1, length(token))) AS i FROM made) GROUP BY ALL
), shares AS (
  SELECT label, pair, c / sum(c) OVER (PARTITION BY label) AS share FROM pairs
), parts AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM shares WHERE label = 'corpus') THEN {scan.CORPUS_PART}::DOUBLE ELSE 0 END AS part
), letters AS (
  SELECT unnest(string_split('{letters}', '')) AS letter
), cells AS (
  SELECT a.letter AS a, a.letter || b.letter AS pair, {scan.PAIR_MASS} * coalesce(max(share) FILTER (label = 'random'), 0) + 0.5::DOUBLE AS x,
    {scan.PAIR_MASS} * ((1 - any_value(part)) * coalesce(max(share) FILTER (label = 'ordinary'), 0) + any_value(part) * coalesce(max(share) FILTER (label = 'corpus'), 0)) + 0.5::DOUBLE AS y
  FROM letters a CROSS JOIN letters b CROSS JOIN parts LEFT JOIN shares s ON s.pair = a.letter || b.letter GROUP BY ALL
), ratios AS (
  SELECT pair, round(ln(x / sum(x) OVER (PARTITION BY a)) - ln(y / sum(y) OVER (PARTITION BY a)), 6) AS ratio FROM cells
), found AS ({found}
), each AS (
  SELECT row, rank, kind, least, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS k FROM found WHERE len(ms) > 0
), placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, rank ORDER BY k) AS z FROM each
), long_enough AS (
  SELECT row, rank, kind, m, (z - length(m))::BIGINT AS a, z::BIGINT AS z FROM placed WHERE length(g) >= least
), scores AS (
  SELECT m, sum(ratio) AS score FROM (SELECT m, unnest(range(1, length(m))) AS i FROM (SELECT DISTINCT m FROM long_enough WHERE kind = '{scan.MODEL_KIND}')) JOIN ratios ON pair = substr(m, i, 2) GROUP BY m
), spans AS (
  SELECT l.* FROM long_enough l LEFT JOIN scores s ON s.m = l.m WHERE l.kind <> '{scan.MODEL_KIND}' OR s.score > {scan.THRESHOLD}::DOUBLE * (length(l.m) - 1)
), gathered AS (
  SELECT row, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < {len(scan.KINDS)}) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN gathered USING (row)"""


WORDS_OF = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_sql() -> str:
    """The license scan by comparing every run of every text with every template."""
    scan = license_scan
    listed = lambda texts: "[" + ", ".join(quoted(f" {' '.join(x.decode() for x in words_of(t.encode()))} ") for t in texts) + "]::VARCHAR[]"
    templates = ", ".join(f"({quoted(name)}, {quoted(text)}, {listed(scan.TELLING.get(name, ()))}, {listed([scan.VERSION[name]] if name in scan.VERSION else [])})" for name, text in sorted(scan.TEMPLATES.items()))
    return rf"""
WITH RECURSIVE templates AS (
  SELECT name, {WORDS_OF} AS ws, telling, also FROM (VALUES {templates}) t(name, text, telling, also)
), own AS (
  SELECT DISTINCT name, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM templates)
), sizes AS (
  SELECT name, count(*) AS size FROM own GROUP BY name
), texts AS (
  SELECT row_number() OVER () AS row, doc_id, {WORDS_OF} AS ws FROM documents
), met AS (
  SELECT row, i, name, g, size FROM (SELECT row, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM texts)) JOIN own USING (g) JOIN sizes USING (name)
), runs AS (
  SELECT e.row, e.name, e.size, e.i AS last, min(b.i) AS first, count(DISTINCT b.g) AS n FROM met e JOIN met b ON b.row = e.row AND b.name = e.name AND b.i > e.i - e.size AND b.i <= e.i GROUP BY ALL
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row, name ORDER BY n DESC, last) = 1
), matching AS (
  SELECT b.*, doc_id, row_number() OVER (PARTITION BY b.row ORDER BY n DESC, n / size::DOUBLE DESC, b.name) AS k
  FROM (SELECT b.*, doc_id, telling, also, ' ' || array_to_string(texts.ws[first:last + 4], ' ') || ' ' AS said FROM best b JOIN texts USING (row) JOIN templates t ON t.name = b.name WHERE n / size::DOUBLE >= {scan.CONTAINMENT}::DOUBLE) b
  WHERE (len(telling) = 0 OR len(list_filter(telling, lambda p: contains(said, p))) > 0) AND (len(also) = 0 OR len(list_filter(also, lambda p: contains(said, p))) > 0)
), picked AS (
  SELECT DISTINCT row, 0::BIGINT AS k, [{{'a': 0::BIGINT, 'z': -1::BIGINT}}] AS taken, false AS stays FROM matching
  UNION ALL
  SELECT row, k, CASE WHEN fits THEN list_append(taken, {{'a': first, 'z': last}}) ELSE taken END, fits
  FROM (SELECT m.row, m.k, first, last, taken, len(list_filter(taken, lambda t: 2 * (least(last, t.z) - greatest(first, t.a) + 1) > least(last - first, t.z - t.a) + 1)) = 0 AS fits FROM picked p JOIN matching m ON m.row = p.row AND m.k = p.k + 1)
)
SELECT doc_id, name AS license, round(n / size::DOUBLE, 6) AS containment, (first - 1)::BIGINT AS first_word FROM matching JOIN picked USING (row, k) WHERE stays"""


#: Jumps of 1, 2, 4, ... chunks by which the SQL of substring dedup follows chunk ends: a text may have so many chunks.
DOUBLINGS = 16


def substring_sql() -> str:
    """Substring dedup: where a chunk that begins at each byte ends, the ends that are reached from a text's start, and spans of shared chunks."""
    scan = substring_dedup
    table = ", ".join(str(x) for x in scan._GEAR.tolist())
    rolled = " + ".join(f"coalesce(lag(g, {k}) OVER w, 0) * {1 << k}" if k else "g" for k in range(scan.WINDOW))
    # The end of the chunk from p: the first cut in reach, else the text's end if in reach, else the least hash in reach.
    jumps = "\n".join(
        f"), jump{k + 1} AS MATERIALIZED (SELECT a.row, a.p, b.e FROM jump{k} a JOIN jump{k} b ON b.row = a.row AND b.p = a.e\n"
        f"), reached{k + 1} AS MATERIALIZED (SELECT row, p FROM reached{k} UNION SELECT r.row, j.e FROM reached{k} r JOIN jump{k} j ON j.row = r.row AND j.p = r.p"
        for k in range(DOUBLINGS)
    )
    reach = f"ROWS BETWEEN {scan.MIN_BYTES} FOLLOWING AND {scan.MAX_BYTES} FOLLOWING"
    return rf"""
WITH texts AS (
  SELECT DISTINCT doc_id, text, hex(encode(text)) AS h FROM documents WHERE doc_id IS NOT NULL AND text <> ''
), numbered AS (
  SELECT row_number() OVER () AS row, doc_id, h, length(h) // 2 AS size FROM texts
), bytes AS (
  SELECT row, i, size, ('0x' || substr(h, 2 * i - 1, 2))::BIGINT AS byte FROM (SELECT row, h, size, unnest(range(1, size + 1)) AS i FROM numbered)
), geared AS (
  SELECT row, i, size, byte, [{table}][byte + 1] AS g FROM bytes
), hashed AS (
  SELECT row, i, size, ({rolled}) % {1 << 32} AS hash, lead(byte) OVER w & 192 <> 128 AS legal FROM geared WINDOW w AS (PARTITION BY row ORDER BY i)
), marked AS (
  SELECT row, i, size, i < size AND legal AS legal, i < size AND legal AND hash < {(1 << 32) // scan.ONE_IN} AS cut, hash FROM hashed
  UNION ALL SELECT row, 0, size, false, false, 0 FROM numbered
), jump0 AS MATERIALIZED (
  SELECT row, i AS p, coalesce(next_cut, CASE WHEN size - i <= {scan.MAX_BYTES} THEN size ELSE least_at END) AS e
  FROM (SELECT row, i, size, min(i) FILTER (cut) OVER w AS next_cut, arg_min(i, hash * 1000000000 + i) FILTER (legal) OVER w AS least_at FROM marked WINDOW w AS (PARTITION BY row ORDER BY i {reach}))
  WHERE i < size
), reached0 AS MATERIALIZED (
  SELECT row, 0::BIGINT AS p FROM numbered
{jumps}
), chunks AS (
  SELECT j.row, n.doc_id, j.p, j.e, substr(n.h, 2 * j.p + 1, 2 * (j.e - j.p)) AS c FROM reached{DOUBLINGS} r JOIN jump0 j ON j.row = r.row AND j.p = r.p JOIN numbered n ON n.row = j.row
), known AS (
  SELECT c, min(doc_id) AS first_id FROM chunks GROUP BY c HAVING min(doc_id) < max(doc_id)
), again AS (
  SELECT row, doc_id, p, e, first_id, CASE WHEN p = lag(e) OVER (PARTITION BY row ORDER BY p) THEN 0 ELSE 1 END AS opens FROM chunks JOIN known USING (c) WHERE doc_id > first_id
), islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY row ORDER BY p) AS island FROM again
), spans AS (
  SELECT row, doc_id, arg_min(first_id, p) AS first_id, min(p) AS a, max(e) AS z FROM islands GROUP BY row, doc_id, island
), placed AS (
  SELECT s.doc_id, s.first_id, s.row, a, z, length(decode(unhex(substr(h, 1, 2 * a)))) AS start, length(decode(unhex(substr(h, 2 * a + 1, 2 * (z - a))))) AS n_chars FROM spans s JOIN numbered n ON n.row = s.row
)
SELECT doc_id, first_id, start::BIGINT AS start, n_chars::BIGINT AS n_chars FROM placed WHERE n_chars >= {scan.LEAST_CHARS}"""


SQL: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op5_license_scan": license_sql(),
    "op7_substring_dedup": substring_sql(),
    "op9_secret_scan": secret_sql(),
    "op3_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), kept_safe AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|(?:start|sep|end)\|>)', '\1\\\2\3', 'g') AS body,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|\|(?:start|sep|end)\|>)', '\1\\\2\3', 'g') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + length('<|start|><|sep|><|end|>') + 1)::BIGINT AS formatted_chars
FROM kept_safe GROUP BY conv_id""",
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM c WHERE 100 * shared >= 85 * (na + nb - shared) UNION ALL SELECT b, a FROM c WHERE 100 * shared >= 85 * (na + nb - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id""",
    "op8_decontamination": r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT row_number() OVER () AS w, item, item_id, n, ws[i:i + n - 1] AS terms, array_to_string(ws[i:i + n - 1], ' ') AS said
  FROM (SELECT *, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), places AS (
  SELECT row, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM words, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n
), exact AS (
  SELECT p.row, p.i, p.n, w.item_id FROM (SELECT row, i, n, array_to_string(ws[i:i + n - 1], ' ') AS said FROM places) p JOIN windows w ON p.n = w.n AND p.said = w.said
), hit AS (
  SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS at FROM exact) GROUP BY row
), exact_items AS (
  SELECT row, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT row, item_id FROM exact WHERE item_id IS NOT NULL) GROUP BY row
), tokens AS (
  SELECT row, unnest(ws) AS term, generate_subscripts(ws, 1) AS at FROM words
), counts AS (
  SELECT term, count(*) AS c FROM tokens GROUP BY term
), terms AS (
  SELECT w, item_id, n, unnest(terms) AS term, generate_subscripts(terms, 1) AS k FROM windows
), rarest AS (
  SELECT w, any_value(item_id) AS item_id, any_value(n) AS n, arg_min(term, coalesce(c, 0) * 100 + k) AS term, arg_min(k, coalesce(c, 0) * 100 + k) AS k FROM terms LEFT JOIN counts USING (term) GROUP BY w HAVING min(coalesce(c, 0)) > 0
), starts AS (
  SELECT DISTINCT r.w, r.item_id, r.n, t.row, t.at - r.k + d AS s FROM rarest r JOIN tokens t USING (term), range(-2, 3) o(d)
), near AS (
  SELECT s.row, s.w, any_value(s.item_id) AS item_id FROM starts s JOIN terms x ON x.w = s.w JOIN tokens t ON t.row = s.row AND t.term = x.term AND t.at BETWEEN s.s + x.k - 2 AND s.s + x.k + 2
  GROUP BY s.row, s.w, s.s HAVING count(DISTINCT x.k) = any_value(s.n)
), near_items AS (
  SELECT row, count(*) AS n_near_items FROM (SELECT DISTINCT row, item_id FROM near WHERE item_id IS NOT NULL EXCEPT SELECT row, item_id FROM exact) GROUP BY row
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM words LEFT JOIN hit USING (row) LEFT JOIN exact_items USING (row) LEFT JOIN near_items USING (row)""",
}
