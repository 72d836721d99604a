"""SQL that gives the rows of the corpus queries that SQL can express, on tables whose doc_id is unique."""

from __future__ import annotations

from catalith.llm import secret_scan as secrets
from catalith.llm.license_scan import LOWER, NOTICES, PHRASES, UPPER
from catalith.llm.merkle_manifest import FAN, FIELDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

#: A window's words are doubled up: 2, 4, 8, 16 and 32 of them by leads; 32 + 16 + 2 = 50. Its md5 stands for it.
OP1 = f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w1 AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
w2 AS (SELECT *, word || ' ' || lead(word) OVER d AS g2 FROM w1 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w4 AS (SELECT *, g2 || ' ' || lead(g2, 2) OVER d AS g4 FROM w2 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w8 AS (SELECT *, g4 || ' ' || lead(g4, 4) OVER d AS g8 FROM w4 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w16 AS (SELECT *, g8 || ' ' || lead(g8, 8) OVER d AS g16 FROM w8 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w50 AS (
  SELECT doc_id, i, word, md5(g16 || ' ' || lead(g16, 16) OVER d || ' ' || lead(g16, 32) OVER d || ' ' || lead(g2, 48) OVER d) AS g50
  FROM w16 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
starts AS (SELECT doc_id, i, word, CASE WHEN g50 IS NOT NULL AND min(doc_id) OVER (PARTITION BY g50) < doc_id THEN i END AS again FROM w50),
marked AS (SELECT doc_id, i, word, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY i) >= i - 49, false) AS gone FROM starts),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS rest
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def _same(words: list[str]) -> str:
    """Whether the words stand at the current place and after it."""
    return " AND ".join([f"word = '{words[0]}'", *(f"lead(word, {j}) OVER d = '{x}'" for j, x in enumerate(words[1:], 1))])


def _op2() -> str:
    phrases = ", ".join(f"CASE WHEN {_same(p.split())} THEN '{label}' END" for label, p in PHRASES.items())
    notices = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(NOTICES))
    return rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts),
placed AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d AS gram, list_filter([{phrases}], lambda x: x IS NOT NULL) AS hits
  FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
hit AS (SELECT doc_id, i, unnest(hits) AS label FROM placed),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS found FROM hit GROUP BY doc_id),
notices(notice, label, text) AS (VALUES {notices}),
marked AS (SELECT notice, label, unnest(string_split(text, ' ')) AS marked, unnest(range(len(string_split(text, ' ')))) AS i FROM notices),
inside AS (
  SELECT notice, label, i, trim(marked, '[]') AS word,
    sum((marked LIKE '[%')::INT) OVER o - coalesce(sum((marked LIKE '%]')::INT) OVER before, 0) AS decides
  FROM marked WINDOW o AS (PARTITION BY notice ORDER BY i), before AS (PARTITION BY notice ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
notice_grams AS (
  SELECT notice, label, i AS place, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram,
    decides + lead(decides, 1) OVER o + lead(decides, 2) OVER o = 3 AS decides
  FROM inside WINDOW o AS (PARTITION BY notice ORDER BY i)
),
sizes AS (SELECT notice, count(gram) AS size, count(gram) FILTER (WHERE decides) AS must FROM notice_grams GROUP BY notice),
votes AS (SELECT doc_id, notice, label, place, decides, i - place AS diagonal FROM placed JOIN notice_grams USING (gram)),
lines AS (SELECT DISTINCT doc_id, notice, diagonal FROM votes),
apart AS (SELECT *, (diagonal - lag(diagonal) OVER d > 2)::INT AS new FROM lines WINDOW d AS (PARTITION BY doc_id, notice ORDER BY diagonal)),
merged AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY doc_id, notice ORDER BY diagonal) AS span FROM apart),
spans AS (
  SELECT doc_id, notice, label, span, count(DISTINCT place) / any_value(size) AS cover
  FROM votes JOIN merged USING (doc_id, notice, diagonal) JOIN sizes USING (notice)
  GROUP BY ALL HAVING cover >= 0.6 AND count(DISTINCT place) FILTER (WHERE decides) = any_value(must)
),
more AS (SELECT doc_id, list(DISTINCT label) AS found, max(cover) AS cover, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.found, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(more.found, [])))), ',') AS labels,
  (CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(more.cover, 0.0) END)::DOUBLE AS score, coalesce(more.n, 0)::BIGINT AS n_spans
FROM texts LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP2 = _op2()

#: Runs that two places or more share, one line longer in each round; a line keeps its line end when the text is put together.
OP5 = r"""
WITH RECURSIVE parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents),
split AS (SELECT doc_id, unnest(part) AS line, unnest(range(len(part))) AS nth, len(part) - 1 AS last FROM parts),
inked AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words FROM split),
lines AS (SELECT doc_id, nth, line, md5(line) AS id, n_words, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS pos FROM inked WHERE n_words > 0),
shared AS (
  SELECT 1::BIGINT AS k, doc_id, pos, id AS name FROM lines QUALIFY count(*) OVER (PARTITION BY id) > 1
  UNION ALL
  SELECT k + 1 AS k, shared.doc_id, shared.pos, md5(name || id) AS name
  FROM shared JOIN lines ON lines.doc_id = shared.doc_id AND lines.pos = shared.pos + k QUALIFY count(*) OVER (PARTITION BY md5(name || id)) > 1
),
again AS (SELECT k, doc_id, pos FROM shared WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY doc_id, pos) > 1),
later AS (SELECT k, doc_id, pos FROM again JOIN lines USING (doc_id, pos) WHERE k = 2 OR n_words >= 50),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(k)) AS pos FROM later),
runs AS (
  SELECT doc_id, count(*) AS n, max(n) AS longest, sum(n) AS removed
  FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone) GROUP BY doc_id, run) GROUP BY doc_id
),
matches AS (SELECT doc_id, max(k) AS k FROM shared GROUP BY doc_id),
left_over AS (
  SELECT doc_id, string_agg(line || CASE WHEN nth < last THEN chr(10) ELSE '' END, '' ORDER BY nth) AS rest
  FROM split LEFT JOIN (SELECT doc_id, nth, true AS dropped FROM lines JOIN gone USING (doc_id, pos)) USING (doc_id, nth) WHERE dropped IS NULL GROUP BY doc_id
)
SELECT doc_id, (SELECT count(*) FROM lines WHERE lines.doc_id = documents.doc_id)::BIGINT AS n_lines, coalesce(runs.removed, 0)::BIGINT AS n_removed,
  coalesce(runs.n, 0)::BIGINT AS n_runs, coalesce(runs.longest, 0)::BIGINT AS longest_run, coalesce(matches.k, 0)::BIGINT AS longest_match,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN runs USING (doc_id) LEFT JOIN matches USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_LOWER_WORDS} AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts),
grams AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d AS shingle FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM grams WHERE shingle IS NOT NULL
  UNION ALL
  SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) IN (1, 2)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * common.n >= 85 * (sx.n + sy.n - common.n)
),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y),
components AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""



def _hits(kind: int, pattern: str, least: int, group: int = 0) -> str:
    """The matches of a kind: their places follow from the lengths of the matches and of the gaps between them."""
    said = pattern.replace("'", "''")
    length = lambda part: f"coalesce(list_sum([length(x) for x in {part}]), 0)"
    return f"""
  SELECT r, source, {kind} AS kind, start, start + length(m) AS "end", value FROM (
    SELECT r, source, matches[i] AS m, regexp_extract(matches[i], '{said}', {group}) AS value,
      {length("gaps[1:i]")} + {length("matches[1:i-1]")} AS start
    FROM (SELECT r, source, matches, gaps, unnest(range(1, len(matches) + 1)) AS i FROM (
      SELECT r, source, regexp_extract_all(t, '{said}') AS matches, string_split_regex(t, '{said}') AS gaps FROM texts WHERE regexp_matches(t, '{said}')))
  ) WHERE length(value) >= {least}"""


OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_hits(0, secrets.ASSIGN, secrets.ASSIGN_LEAST, 2)}
  UNION ALL {_hits(1, secrets.ACCESS, secrets.ACCESS_LEAST)}
  UNION ALL {_hits(2, f"{secrets.HEX[:-1]}{{{secrets.HEX_LEAST},}}", secrets.HEX_LEAST)}),
every AS (SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secrets.LIVE_DIGITS}
  AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= {secrets.LIVE_LETTERS}
  AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_DISTINCT} AS live
  FROM (FROM base UNION ALL {_hits(3, f"{secrets.WIDE[:-1]}{{{secrets.WIDE_LEAST},}}", secrets.WIDE_LEAST)})),
candidates AS (SELECT * FROM every e WHERE kind < 3 OR live AND NOT EXISTS (FROM base b WHERE b.r = e.r AND b.start < e."end" AND e.start < b."end")),
owners AS (SELECT value, count(DISTINCT source) + max((source IS NULL)::INT) AS n FROM candidates GROUP BY value),
judged AS (
  SELECT *, CASE WHEN n >= {secrets.SHARED_OWNERS} THEN 'shared' WHEN live THEN 'live' ELSE 'unclear' END AS verdict,
    {list(secrets.KINDS)}[kind + 1] || ':' || start || ':' || "end" AS said
  FROM candidates JOIN owners USING (value)
),
kept AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (WHERE kind = 3) AS n_owned, count(*) FILTER (WHERE verdict = 'shared') AS n_shared, count(*) FILTER (WHERE verdict = 'live') AS n_live
  FROM judged WHERE kind < 3 OR verdict = 'live' GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("n_assign", "n_access", "n_hex", "n_owned", "n_shared", "n_live"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN kept USING (r)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


#: CRC-32 bit by bit over the decimal digits.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""
_RUN = f"PARTITION BY layer, tree, lvl, pos // {FAN} ORDER BY pos"
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    sha256({" || ".join(_field(f if f != "text" else f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END") for f in FIELDS)}) AS found
  FROM documents
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves
),
up AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, n, pos // {FAN}
),
roots AS (SELECT tree, lvl AS height, node AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM roots) AS n, subroot AS node FROM roots
  UNION ALL
  SELECT lvl + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // {FAN}
),
nodes AS (SELECT 0 AS layer, tree, lvl, pos, node FROM up WHERE n > 1 UNION ALL SELECT 1, 0, lvl, pos, node FROM top WHERE n > 1),
siblings AS (
  SELECT layer, tree, lvl, pos, coalesce(string_agg(node, '') OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER ({_RUN} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes
),
heights AS (SELECT tree, height, (SELECT max(lvl) FROM top) AS top_height FROM roots),
steps AS (
  SELECT r, k, CASE WHEN k < height THEN 0 ELSE 1 END AS layer, CASE WHEN k < height THEN tree ELSE 0 END AS tree,
    CASE WHEN k < height THEN k ELSE k - height END AS lvl, (CASE WHEN k < height THEN pos // ({FAN} ** k)::BIGINT ELSE tree // ({FAN} ** (k - height))::BIGINT END) AS pos
  FROM (SELECT r, tree, pos, height, unnest(range(height + top_height)) AS k FROM placed JOIN heights USING (tree))
),
paths AS (SELECT r, k, before, after FROM steps JOIN siblings USING (layer, tree, lvl, pos)),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS proof FROM paths GROUP BY r),
fold AS (
  SELECT r, 0 AS k, found AS node FROM placed
  UNION ALL
  SELECT r, k + 1, sha256(before || node || after) FROM fold JOIN paths USING (r, k)
),
folded AS (SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN roots USING (tree) JOIN folded USING (r) LEFT JOIN proofs USING (r), root
"""
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_license_scan": OP2,
    "op5_line_dedup": OP5,
    "op8_minhash_dedup": OP8,
    "op12_secret_scan": OP12,
    "op13_merkle_manifest": OP13,
}
