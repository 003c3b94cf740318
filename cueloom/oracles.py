"""SQL for DuckDB, written on its own, that each query's result is compared with."""

from __future__ import annotations

from cueloom.functions.text import DROPPED_AT_END, NEUTRAL, PRIMARY_BREAKS, SECONDARY_BREAKS, SPACE, WIDE

SLIDES = """slides AS (SELECT conv_id AS deck_id, CAST(turn + 1 AS INT) AS slide_num, role AS title, CASE WHEN role <> 'system' THEN text END AS notes,
  CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 7 = 1 AND turn = 0 THEN 'Shown: ' || role END AS subtitle_text,
  CASE WHEN role <> 'system' THEN CAST(length(text) * 200 AS BIGINT) END AS audio_ms FROM conversations)"""
EVENTS = (
    SLIDES
    + """, chars AS (SELECT deck_id, slide_num, unnest(range(length(notes))) AS pos, notes FROM slides WHERE notes IS NOT NULL),
heard AS (SELECT deck_id, slide_num, pos, substr(notes, CAST(pos + 1 AS INT), 1) AS text FROM chars),
matched AS (SELECT deck_id, slide_num, row_number() OVER (PARTITION BY deck_id, slide_num ORDER BY pos) - 1 AS ev_idx, text, pos AS a, pos + 1 AS b,
  pos * 200 - CASE WHEN deck_id % 5 = 0 AND pos >= 80 THEN 8000 ELSE 0 END AS offset_ms, 160 AS duration_ms FROM heard
  WHERE text NOT IN (' ', chr(10), '.', ',', '!', '?') AND NOT (deck_id % 5 = 0 AND pos BETWEEN 40 AND 79))"""
)


def _units(source: str, key: str, text: str, breaks: str, name: str = "units") -> str:
    """CTEs pars (start, stop, piece) and name (start, stop, piece), where a stop or comma between digits doesn't cut."""
    guard = "piece"
    for mark in ".,":
        if mark in breaks:
            for _ in range(2):
                guard = f"regexp_replace({guard}, '([0-9])[{mark}]([0-9])', '\\1' || chr({1 if mark == '.' else 2}) || '\\2', 'g')"
    return f"""pars0 AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS piece, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {source} WHERE {text} IS NOT NULL),
pars1 AS (SELECT *, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pars0),
pars AS (SELECT {key}, i - 1 AS par_idx, start, start + length(piece) AS stop, piece FROM pars1 WHERE regexp_replace(piece, '[{SPACE}]', '', 'g') <> ''),
u0 AS (SELECT {key}, par_idx, start AS f, regexp_extract_all({guard}, '[^{breaks}]*[{breaks}]+|[^{breaks}]+') AS l FROM pars),
u1 AS (SELECT {key}, par_idx, f, replace(replace(unnest(l), chr(1), '.'), chr(2), ',') AS piece, generate_subscripts(l, 1) AS i FROM u0),
u2 AS (SELECT *, f + CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {key}, par_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u1),
{name} AS (SELECT {key}, par_idx, start, start + length(piece) AS stop, piece FROM u2 WHERE regexp_replace(piece, '[{SPACE}]', '', 'g') <> '')"""


#: Each event is one character: those of a slide as one string, walked through by recursion with a cursor in the notes.
HEARD = EVENTS + ", heard_by AS (SELECT deck_id, slide_num, any_value(notes) AS notes, string_agg(text, '' ORDER BY ev_idx) AS said, CAST(count(*) AS INT) AS n FROM matched JOIN slides USING (deck_id, slide_num) GROUP BY ALL)"


def _then(places: str, nth: int) -> str:
    """Where one is after the nth next character, from each of places; null if it doesn't come."""
    c = f"substr(said, i + {1 + nth}, 1)"
    return f"list_transform({places}, lambda x: CASE WHEN {c} = '' THEN x ELSE x + nullif(instr(substr(notes, CAST(x + 1 AS INT)), {c}), 0) END)"


#: The places within 200 characters; for each how far one gets to by the next three events; the nearest of those at most 10 behind the best.
WALK = f"""walk AS (SELECT deck_id, slide_num, 0 AS i, CAST(0 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS hit FROM heard_by
  UNION ALL SELECT deck_id, slide_num, i + 1, coalesce(p + 1, cur), p FROM (SELECT *, CAST(coalesce(
      near[CASE WHEN len(near) > 1 AND i + 1 < n THEN list_min(list_filter(range(1, len(near) + 1), lambda k: after[k] - near[k] <= 10 + list_min(list_transform(range(1, len(near) + 1), lambda j: after[j] - near[j])))) END],
      near[1], nullif(instr(substr(notes, CAST(cur + 1 AS INT)), c), 0) + cur - 1, nullif(instr(lower(substr(notes, CAST(cur + 1 AS INT), 200)), lower(c)), 0) + cur - 1) AS BIGINT) AS p
    FROM (SELECT *, {_then(_then(_then("list_transform(near, lambda x: x + 1)", 1), 2), 3)} AS after
    FROM (SELECT *, list_transform(list_filter(range(1, len(ahead) + 1), lambda x: ahead[x] = c), lambda x: x + cur - 1) AS near
    FROM (SELECT w.*, notes, said, n, substr(said, w.i + 1, 1) AS c, string_split(substr(notes, CAST(w.cur + 1 AS INT), 200), '') AS ahead FROM walk w JOIN heard_by h USING (deck_id, slide_num) WHERE w.i < n)))))"""


SEGS = EVENTS + ", " + _units("slides", "deck_id, slide_num", "notes", PRIMARY_BREAKS) + ", segs AS (SELECT deck_id, slide_num, row_number() OVER (PARTITION BY deck_id, slide_num ORDER BY start) - 1 AS seg_idx, start, stop, piece FROM units)"
RAW = SEGS + """, raw AS (SELECT s.deck_id, s.slide_num, s.seg_idx, s.start, s.stop, s.piece, min(m.offset_ms) AS raw_start, max(m.offset_ms + m.duration_ms) AS raw_end FROM segs s
  LEFT JOIN matched m ON m.deck_id = s.deck_id AND m.slide_num = s.slide_num AND m.a < s.stop AND m.b > s.start GROUP BY ALL)"""
#: By recursion over the segments of a slide, as the rule is told.
FILLED = RAW.replace("WITH", "") + """, nexts AS (SELECT r.*, (SELECT min(m.offset_ms) FROM matched m WHERE m.deck_id = r.deck_id AND m.slide_num = r.slide_num AND m.a >= r.stop) AS next_ms FROM raw r),
filled AS (SELECT deck_id, slide_num, seg_idx, start, stop, piece, CAST(coalesce(raw_start, 0) AS BIGINT) AS s, CAST(CASE WHEN raw_start IS NULL THEN greatest(0, coalesce(next_ms, 0)) ELSE raw_end END AS BIGINT) AS e, raw_start IS NULL AS gap FROM nexts WHERE seg_idx = 0
  UNION ALL SELECT n.deck_id, n.slide_num, n.seg_idx, n.start, n.stop, n.piece, CAST(CASE WHEN n.raw_start IS NULL THEN f.e ELSE n.raw_start END AS BIGINT), CAST(CASE WHEN n.raw_start IS NULL THEN greatest(f.e, coalesce(n.next_ms, f.e)) ELSE n.raw_end END AS BIGINT), n.raw_start IS NULL
  FROM filled f JOIN nexts n ON n.deck_id = f.deck_id AND n.slide_num = f.slide_num AND n.seg_idx = f.seg_idx + 1)"""
CAPTIONS = FILLED + """, led AS (SELECT *, lead(s) OVER (PARTITION BY deck_id, slide_num ORDER BY seg_idx) AS n FROM filled),
captions AS (SELECT deck_id, slide_num, seg_idx, piece AS text, s AS start_ms, CASE WHEN n - 150 > e THEN n - 150 WHEN e > n THEN greatest(n, s) ELSE e END AS end_ms, gap FROM led)"""
_BEFORE = "OVER (PARTITION BY deck_id ORDER BY slide_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
STARTS = f"starts AS (SELECT deck_id, slide_num, audio_ms, coalesce(audio_ms, 5000) AS duration_ms, CAST(coalesce(sum(coalesce(audio_ms, 5000)) {_BEFORE}, 0) AS BIGINT) AS predicted_ms FROM slides)"
BOUNDS = STARTS + """, bounds AS (SELECT deck_id, slide_num, (predicted_ms * 1001) // 1000 + 300 * slide_num AS start_ms,
  CASE WHEN slide_num % 3 <> 0 THEN ((predicted_ms + duration_ms) * 1001) // 1000 + 300 * slide_num END AS end_ms FROM starts WHERE slide_num % 4 <> 0)"""
SCALES = BOUNDS + """, ahead AS (SELECT b.deck_id, b.slide_num, lead(b.start_ms) OVER w - b.start_ms AS dm, lead(s.predicted_ms) OVER w - s.predicted_ms AS dp FROM bounds b JOIN starts s USING (deck_id, slide_num) WINDOW w AS (PARTITION BY b.deck_id ORDER BY b.slide_num)),
own AS (SELECT s.*, b.start_ms, (b.end_ms - b.start_ms) / s.duration_ms AS direct, CASE WHEN a.dp > 0 THEN a.dm / a.dp END AS inferred FROM starts s LEFT JOIN bounds b USING (deck_id, slide_num) LEFT JOIN ahead a USING (deck_id, slide_num)),
mean AS (SELECT *, coalesce(direct, inferred) AS own, coalesce(avg(coalesce(direct, inferred)) OVER (PARTITION BY deck_id), 1.0) AS fallback FROM own),
placed AS (SELECT deck_id, slide_num, coalesce(start_ms, predicted_ms) AS start_ms, CASE WHEN start_ms IS NULL THEN 1.0 ELSE coalesce(own, fallback) END AS scale,
  CASE WHEN start_ms IS NULL THEN 'unmeasured' WHEN own IS NULL AND fallback <> 1.0 THEN 'average_scale' END AS code FROM mean)"""
ENTRIES = SLIDES + """, entries AS (SELECT deck_id, slide_num, title, entry_idx, CASE WHEN deck_id % 11 <> 0 THEN format('slide_{:03d}_{}.mp3', slide_num, entry_idx) END AS audio_file
  FROM (SELECT *, unnest(CASE WHEN slide_num = 2 THEN [0, 1] ELSE [0] END) AS entry_idx FROM slides WHERE notes IS NOT NULL))"""


def _time(ms: str) -> str:
    return f"(lpad(CAST({ms} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({ms} // 3600000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"


def _strip(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def _bare(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '^[{SPACE}]+', ''), '[{SPACE}{DROPPED_AT_END}]+$', '')"


def _width(s: str) -> str:
    return f"length({s}) + length(regexp_replace({s}, '[^{WIDE}]', '', 'g'))"


#: Wide characters are no white space, but for U+3000, which is both.
_NOT_SPACE = WIDE.replace(r"\x{3000}-\x{303E}", r"\x{3001}-\x{303E}")


def _shown(s: str) -> str:
    """White space between wide characters goes; without looking ahead that takes two passes, for every other one."""
    for _ in range(2):
        s = f"regexp_replace({s}, '([{_NOT_SPACE}])[{SPACE}]+([{_NOT_SPACE}])', '\\1\\2', 'g')"
    return _strip(f"regexp_replace({s}, '[{SPACE}]+', ' ', 'g')")


def _content(s: str) -> str:
    return f"regexp_replace({s}, '[{NEUTRAL.replace(chr(39), chr(39) * 2)}]', '', 'g')"


def _pack(parts: str, name: str) -> str:
    """CTE name (d, g, a, b): the parts (d, g, a, b and the text t of d) of each g in the fewest lines of 36 columns, with the least sum of squared widths.

    A programme over parts: the state of each is lines, squares and the part before the line, in one number; then back from the last part."""
    ahead = f"list_transform(list_transform(range(greatest(0, j - 79), j + 1), lambda i: {_bare(_shown('substr(t, CAST(la[i + 1] + 1 AS INT), CAST(lb[j + 1] - la[i + 1] AS INT))'))}), lambda s: {_width('s')})"
    best = "list_min(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN w[k] <= 36 THEN (dp[k + greatest(0, j - 79)] // 100000 + 100000000 + w[k] * w[k]) * 100000 + k - 1 + greatest(0, j - 79) END))"
    return f"""{name}_in AS (SELECT d, g, any_value(t) AS t, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb, count(*) AS n FROM {parts} GROUP BY d, g),
{name}_dp AS (SELECT d, g, CAST(0 AS BIGINT) AS j, [CAST(0 AS BIGINT)] AS dp FROM {name}_in
  UNION ALL SELECT d, g, j + 1, list_append(dp, CAST({best} AS BIGINT)) FROM (SELECT s.*, {ahead} AS w FROM {name}_dp s JOIN {name}_in p USING (d, g) WHERE j < n)),
{name}_back AS (SELECT d, g, n AS hi, dp[n + 1] % 100000 AS lo, dp FROM {name}_dp JOIN {name}_in USING (d, g) WHERE j = n
  UNION ALL SELECT d, g, lo, dp[lo + 1] % 100000, dp FROM {name}_back WHERE lo > 0),
{name} AS (SELECT d, g, la[lo + 1] AS a, lb[hi] AS b FROM {name}_back JOIN {name}_in USING (d, g))"""


def _split(source: str, pattern: str, name: str) -> str:
    """CTE name (d, g, a, b, t): the pieces of source (d, a, b, t) that pattern finds one after another, without blank ones; g is where the whole began."""
    hide = "substr(t, CAST(a + 1 AS INT), CAST(b - a AS INT))"
    for _ in range(2):
        hide = f"regexp_replace({hide}, '([0-9])[,]([0-9])', '\\1' || chr(2) || '\\2', 'g')"
    return f"""{name}0 AS (SELECT d, t, a AS f, regexp_extract_all({hide}, '{pattern}') AS l FROM {source}),
{name}1 AS (SELECT d, t, f, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM {name}0),
{name}2 AS (SELECT *, f + CAST(coalesce(sum(length(piece)) OVER (PARTITION BY d, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM {name}1),
{name} AS (SELECT d, f AS g, a, a + length(piece) AS b, t FROM {name}2 WHERE regexp_replace(piece, '[{SPACE}]', '', 'g') <> '')"""


_FITS = f"{_width(_bare(_shown('substr(t, CAST(a + 1 AS INT), CAST(b - a AS INT))')))} <= 36"
#: Balanced lines of texts (d, t), as balanced (d, start, stop, piece): sentences that fit share lines; longer ones go by clauses, and
#: clauses that don't fit by tokens, numbers whole. No token of the test data is wider than a line, so cuts within one are left to the unit tests.
BALANCED = (
    _units("texts", "d", "t", PRIMARY_BREAKS)
    + f""", by_par AS (SELECT d * 1000000 + par_idx AS d, start AS s0, piece AS t FROM pars),
prim AS (SELECT p.d, u.start - s0 AS a, u.stop - s0 AS b, t FROM units u JOIN by_par p ON p.d = u.d * 1000000 + u.par_idx),
sentences AS (SELECT *, {_FITS} AS fit FROM prim), long AS (SELECT * FROM sentences WHERE NOT fit),
{_split("long", f"[^{SECONDARY_BREAKS}]*[{SECONDARY_BREAKS}]+|[^{SECONDARY_BREAKS}]+", "clauses")},
judged AS (SELECT *, {_FITS} AS fit FROM clauses), wide AS (SELECT d, a, b, t FROM judged WHERE NOT fit),
{_split("wide", "[\\x{4E00}-\\x{9FFF}]|[" + SPACE + "]+|[\\p{L}\\p{Nl}\\p{No}]+|[0-9]+(?:[.\\x02][0-9]+)*|.", "tokens")},
{_pack("tokens", "packed")},
inner_parts AS (SELECT d, g, a, b, t FROM judged WHERE fit UNION ALL SELECT p.d, w.g, p.a, p.b, w.t FROM packed p JOIN judged w ON w.d = p.d AND w.a = p.g WHERE NOT w.fit),
outer_parts AS (SELECT d, -1 - sum(CASE WHEN fit THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY a) AS g, a, b, t, fit FROM sentences),
all_parts AS (SELECT d, CAST(g AS BIGINT) AS g, a, b, t FROM inner_parts UNION ALL SELECT d, CAST(g AS BIGINT), a, b, t FROM outer_parts WHERE fit),
{_pack("all_parts", "lines")},
balanced AS (SELECT * FROM (SELECT d // 1000000 AS d, a + s0 AS start, b + s0 AS stop, {_bare(_shown("substr(t, CAST(a + 1 AS INT), CAST(b - a AS INT))"))} AS piece FROM lines JOIN by_par USING (d)) WHERE piece <> '')"""
)
NOTE_LINES = f"texts AS (SELECT deck_id * 1000 + slide_num AS d, notes AS t FROM slides WHERE notes IS NOT NULL), {BALANCED}, segs AS (SELECT d // 1000 AS deck_id, CAST(d % 1000 AS INT) AS slide_num, row_number() OVER (PARTITION BY d ORDER BY start) - 1 AS seg_idx, start, stop, piece FROM balanced)"
BALANCED_CAPTIONS = CAPTIONS.replace(SEGS, f"{EVENTS}, {NOTE_LINES}")


#: The whole way: events of the notes, found in what is shown (an override or the notes) by the whole rule, and balanced lines of it.
_SHOWN = ", shown AS (SELECT deck_id, slide_num, coalesce(nullif(subtitle_text, ''), notes) AS notes FROM slides)"
_FOUND = "found AS MATERIALIZED (SELECT w.deck_id, w.slide_num, m.ev_idx, hit AS a, hit + 1 AS b, m.offset_ms, m.duration_ms FROM walk w JOIN matched m ON m.deck_id = w.deck_id AND m.slide_num = w.slide_num AND m.ev_idx = w.i - 1 WHERE hit IS NOT NULL)"
_SHOWN_LINES = NOTE_LINES.replace("FROM slides WHERE notes IS NOT NULL", "FROM shown WHERE notes IS NOT NULL AND (deck_id, slide_num) IN (SELECT deck_id, slide_num FROM matched)")
SUBTITLES = CAPTIONS.replace("matched m ", "found m ").replace(SEGS, f"{EVENTS}{_SHOWN}{HEARD.removeprefix(EVENTS).replace('JOIN slides', 'JOIN shown')}, {WALK}, {_FOUND}, {_SHOWN_LINES}")


CUES = "cues AS (SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY slide_num, seg_idx) - 1 AS cue_idx, start_ms + predicted_ms AS start_ms, end_ms + predicted_ms AS end_ms, text FROM captions JOIN starts USING (deck_id, slide_num))"
PREDICTED = f"WITH RECURSIVE {CAPTIONS}, {STARTS}"
SRT = f"{PREDICTED}, {CUES}, srt AS (SELECT deck_id, string_agg(CAST(cue_idx + 1 AS VARCHAR) || chr(10) || {_time('start_ms')} || ' --> ' || {_time('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_idx) || chr(10) AS srt FROM cues GROUP BY deck_id)"
TOTALS = "totals AS (SELECT deck_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM starts GROUP BY deck_id)"
#: Documents and a rewrite of them that puts a stop before each line break, and in every third one changes a word.
PAIRS = r"pairs AS (SELECT doc_id, text AS original, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(replace(text, chr(10), '.' || chr(10)), '([a-z])([a-z])', '\1' || chr(10) || '\2') ELSE replace(text, chr(10), '!' || chr(10)) END AS processed FROM documents)"

#: Ten vectors are a deck's track, each of them a slide's clip; 64 samples are a second.
TRACKS = "clips AS (SELECT vec_id // 10 AS deck_id, vec_id % 10 + 1 AS slide_num, embedding AS samples FROM embeddings), tracks AS (SELECT deck_id, flatten(list(samples ORDER BY slide_num)) AS track FROM clips GROUP BY deck_id)"


def _found(source: str, name: str) -> str:
    """CTE name: source (with track, clip and centre) with found, the sample within 128 of centre at which clip, its mean taken off, fits track best."""
    return f"""{name}_c AS (SELECT *, list_transform(clip, lambda x: CAST(x AS DOUBLE) - list_avg(clip)) AS c, greatest(0, centre - 128) AS f FROM {source}),
{name}1 AS (SELECT *, list_transform(range(f, least(len(track), centre + 128 + len(clip)) - len(clip) + 1), lambda l: list_dot_product(list_transform(track[l + 1:l + len(clip)], lambda v: CAST(v AS DOUBLE)), c)) AS fit FROM {name}_c),
{name} AS (SELECT * EXCLUDE (c, f, fit), f + list_position(fit, list_max(fit)) - 1 AS found FROM {name}1)"""


ORACLE_SQL: dict[str, str] = {
    # text
    "txt1_char_width": f"SELECT DISTINCT c AS ch, CAST({_width('c')} AS BIGINT) AS width, regexp_matches(c, '^[{WIDE}]$') AS wide, regexp_matches(c, '^[\\x{{4E00}}-\\x{{9FFF}}]$') AS cjk FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''",
    "txt2_display_width": f"SELECT doc_id, CAST({_width('text')} AS BIGINT) AS width FROM documents",
    "txt4_strip_trailing": f"SELECT doc_id, {_bare('text')} AS stripped FROM documents",
    "txt5_normalize_whitespace": f"SELECT doc_id, {_shown('text')} AS shown FROM documents",
    "txt7_fits": f"WITH {SLIDES}, {_units('slides', 'deck_id, slide_num', 'notes', PRIMARY_BREAKS)} SELECT deck_id, slide_num, CAST(count(*) AS BIGINT) AS units, CAST(sum(CASE WHEN {_width(_bare(_shown('piece')))} <= 36 THEN 1 ELSE 0 END) AS BIGINT) AS fitting FROM units GROUP BY ALL",
    "txt8_numeric_punctuation": "SELECT doc_id, CAST(len(regexp_extract_all(replace(replace(text, '.', '..'), ',', ',,'), '[0-9](?:\\.\\.|,,)')) - len(regexp_extract_all(replace(replace(text, '.', '..'), ',', ',,'), '[0-9](?:\\.\\.|,,)(?:[^0-9]|$)')) AS BIGINT) AS n FROM documents",
    "txt11_content": f"SELECT doc_id, {_content('text')} AS content FROM documents",
    "txt12_timestamp": f"SELECT l_orderkey, l_linenumber, {_time('ms')} AS at, n FROM (SELECT l_orderkey, l_linenumber, CAST(round_even(greatest(l_extendedprice - 1000, 0) / 8 * 1000, 0) AS BIGINT) AS ms, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL)",
    "txt13_parse_timestamp": "SELECT DISTINCT CAST(l_quantity AS BIGINT) * 71777 AS ms FROM lineitem",
    "txt14_selector": "WITH s AS (SELECT DISTINCT (p_partkey % 40 + 1) AS a, (p_size % 10) AS d FROM part) SELECT a, d, CAST(unnest(CASE WHEN d = 0 THEN [a] ELSE list_sort(list_distinct(list_concat([a], range(a + 2, a + 2 + d)))) END) AS BIGINT) AS slide FROM s",
    "txt16_audio_name": f"WITH {SLIDES} SELECT DISTINCT CAST(slide_num AS BIGINT) AS slide_num, format('slide_{{:03d}}.mp3', slide_num) AS name FROM slides",
    "txt17_preview": f"SELECT doc_id, CASE WHEN length(s) > 120 THEN left(s, 120) || '...' ELSE s END AS preview FROM (SELECT doc_id, replace({_strip('text')}, chr(10), ' ') AS s FROM documents)",
    "txt19_burn_filter": "SELECT page_id, 'drawbox=x=(iw-650)/2:y=ih-40:w=650:h=38:color=black@1:t=fill,subtitles=''' || replace(replace(replace(url, '\\', '/'), ':', '\\:'), '''', '\\''') || ''':force_style=''FontName=Noto Sans CJK TC,FontSize=15,PrimaryColour=&HFFFFFF&,BorderStyle=1,Outline=0,Shadow=0,Alignment=2,MarginV=1''' AS filter FROM pages",
    # segments
    "seg1_paragraphs": f"WITH {_units('documents', 'doc_id', 'text', PRIMARY_BREAKS)} SELECT doc_id, CAST(par_idx AS BIGINT) AS par_idx, CAST(start AS BIGINT) AS start_at, CAST(stop AS BIGINT) AS end_at, piece FROM pars",
    "seg2_primary_units": f"WITH {_units('documents', 'doc_id', 'text', PRIMARY_BREAKS)} SELECT doc_id, CAST(start AS BIGINT) AS start_at, CAST(stop AS BIGINT) AS end_at, piece FROM units",
    "seg2_secondary_units": f"WITH {_units('documents', 'doc_id', 'text', SECONDARY_BREAKS)} SELECT doc_id, CAST(start AS BIGINT) AS start_at, CAST(stop AS BIGINT) AS end_at, piece FROM units",
    # alignment
    "seg10_slide_lines": f"WITH RECURSIVE {SLIDES}, {NOTE_LINES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, piece AS text, CAST(start AS BIGINT) AS source_start, CAST(stop AS BIGINT) AS source_end FROM segs",
    "seg10_balanced_lines": f"WITH RECURSIVE texts AS (SELECT doc_id AS d, text AS t FROM documents), {BALANCED} SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY start) - 1 AS BIGINT) AS seg_idx, piece AS text, CAST(start AS BIGINT) AS source_start_offset, CAST(stop AS BIGINT) AS source_end_offset FROM balanced",
    "aln8_balanced_captions": f"WITH RECURSIVE {BALANCED_CAPTIONS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, text, start_ms, CAST(end_ms AS BIGINT) AS end_ms, gap AS interpolated FROM captions",
    "fid2_wide_lines": f"WITH RECURSIVE {PAIRS}, texts AS (SELECT doc_id AS d, processed AS t FROM pairs), {BALANCED} SELECT b.d AS doc_id, CAST(par_idx AS BIGINT) AS par_idx, CAST(count(*) AS BIGINT) AS lines FROM balanced b JOIN pars p ON p.d = b.d AND b.start >= p.start AND b.start < p.stop GROUP BY ALL HAVING count(*) > 1",
    "aln1_occurrences": "WITH t AS (SELECT doc_id, substr(text, 1, 2) AS p, string_split(text, '') AS c FROM documents), e AS (SELECT doc_id, p, unnest(c) AS a, unnest(list_append(c[2:], '')) AS b, generate_subscripts(c, 1) - 1 AS i FROM t WHERE p <> '') SELECT doc_id, CAST(i AS BIGINT) AS at FROM e WHERE (CASE WHEN length(p) = 1 THEN a ELSE a || b END) = p",
    "aln4_match_events": f"WITH RECURSIVE {HEARD}, {WALK} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(i - 1 AS BIGINT) AS ev_idx, hit AS source_start, CAST(m.offset_ms AS BIGINT) AS offset_ms FROM walk JOIN matched m USING (deck_id, slide_num) WHERE m.ev_idx = i - 1 AND hit IS NOT NULL",
    "aln5_overlaps": f"WITH {RAW} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(raw_start AS BIGINT) AS raw_start, CAST(raw_end AS BIGINT) AS raw_end FROM raw",
    "aln6_interpolate": f"WITH RECURSIVE {FILLED} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, s AS start_ms, e AS end_ms, gap AS interpolated FROM filled",
    "aln7_clamp": f"WITH RECURSIVE {CAPTIONS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM captions",
    "aln8_captions": f"WITH RECURSIVE {CAPTIONS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, text, start_ms, CAST(end_ms AS BIGINT) AS end_ms, gap AS interpolated FROM captions",
    # gaps
    "gap1_dropped_narration": f"WITH {EVENTS}, m AS (SELECT *, lead(a) OVER w AS na, lead(offset_ms) OVER w AS no, max(b) OVER v - min(a) OVER v AS chars, max(offset_ms + duration_ms) OVER v - min(offset_ms) OVER v AS ms FROM matched WINDOW w AS (PARTITION BY deck_id, slide_num ORDER BY ev_idx), v AS (PARTITION BY deck_id, slide_num)) SELECT m.deck_id, CAST(m.slide_num AS BIGINT) AS slide_num, CAST(b AS BIGINT) AS source_start, CAST(na AS BIGINT) AS source_end, substr(notes, CAST(b + 1 AS INT), CAST(na - b AS INT)) AS skipped_text, CAST(greatest(no - offset_ms - 160, 0) AS BIGINT) AS gap_ms, round((na - b) * ms / chars, 4) AS expected_ms, CAST(offset_ms + 160 AS BIGINT) AS audio_position_ms FROM m JOIN slides s ON s.deck_id = m.deck_id AND s.slide_num = m.slide_num WHERE na - b >= 15 AND chars > 0 AND ms > 0 AND no - offset_ms - 160 < (na - b) * ms / chars * 0.3",
    "gap2_recheck": f"WITH {EVENTS}, ent AS (SELECT DISTINCT deck_id, slide_num FROM slides WHERE notes IS NOT NULL AND slide_num % 5 <> 0), ev AS (SELECT DISTINCT deck_id, slide_num FROM matched), m AS (SELECT *, lead(a) OVER w AS na, lead(offset_ms) OVER w AS no, max(b) OVER v - min(a) OVER v AS chars, max(offset_ms + duration_ms) OVER v - min(offset_ms) OVER v AS ms FROM matched WINDOW w AS (PARTITION BY deck_id, slide_num ORDER BY ev_idx), v AS (PARTITION BY deck_id, slide_num)), sus AS (SELECT deck_id, slide_num, count(*) AS n FROM m WHERE na - b >= 15 AND chars > 0 AND ms > 0 AND no - offset_ms - 160 < (na - b) * ms / chars * 0.3 GROUP BY ALL) SELECT s.deck_id, CAST(sum(CASE WHEN ent.deck_id IS NOT NULL AND notes IS NOT NULL AND ev.deck_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS checked, CAST(sum(CASE WHEN ent.deck_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_entry, CAST(sum(CASE WHEN ent.deck_id IS NOT NULL AND notes IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_notes, CAST(sum(CASE WHEN ent.deck_id IS NOT NULL AND notes IS NOT NULL AND ev.deck_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_events, CAST(coalesce(sum(n), 0) AS BIGINT) AS suspects FROM slides s LEFT JOIN ent ON ent.deck_id = s.deck_id AND ent.slide_num = s.slide_num LEFT JOIN ev ON ev.deck_id = s.deck_id AND ev.slide_num = s.slide_num LEFT JOIN sus ON sus.deck_id = s.deck_id AND sus.slide_num = s.slide_num GROUP BY s.deck_id",
    "gap3_self_consistency": f"WITH {EVENTS}, j AS (SELECT deck_id, slide_num, ev_idx, offset_ms - CASE WHEN ev_idx % 50 = 49 THEN 700 ELSE 0 END AS o FROM matched), r AS (SELECT *, max(o + 160) OVER (PARTITION BY deck_id, slide_num ORDER BY ev_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j), p AS (SELECT deck_id, slide_num, sum(CASE WHEN o < coalesce(before, 0) - 10 THEN 1 ELSE 0 END) AS n, arg_max(o + 160, ev_idx) AS last FROM r GROUP BY ALL) SELECT p.deck_id, CAST(p.slide_num AS BIGINT) AS slide_num, CAST(audio_ms - last AS BIGINT) AS gap_ms, CAST(n AS BIGINT) AS out_of_order, abs(audio_ms - last) > 300 OR n > 0 AS flagged FROM p JOIN slides s ON s.deck_id = p.deck_id AND s.slide_num = p.slide_num",
    "gap3_worst_slide": f"WITH {EVENTS}, p AS (SELECT deck_id, slide_num, max(offset_ms + 160) AS last FROM matched GROUP BY ALL), g AS (SELECT p.deck_id, p.slide_num, abs(audio_ms - last) AS gap FROM p JOIN slides s ON s.deck_id = p.deck_id AND s.slide_num = p.slide_num), o AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY gap DESC, slide_num DESC) AS k FROM g) SELECT deck_id, CAST(slide_num AS BIGINT) AS worst_slide, CAST(gap AS BIGINT) AS worst_gap_ms FROM o WHERE k = 1",
    "gap3_event_disorder": "WITH e AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT *, max(ms + 160) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT user_id, CAST(sum(CASE WHEN ms < coalesce(before, 0) - 10 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order FROM r GROUP BY user_id",
    "gap4_drift": f"WITH {SLIDES}, {BOUNDS}, j AS (SELECT s.deck_id, s.slide_num, s.audio_ms, b.start_ms, CAST(coalesce(sum(CASE WHEN s.audio_ms IS NULL THEN 5000 WHEN b.start_ms IS NOT NULL THEN s.audio_ms ELSE 0 END) OVER (PARTITION BY s.deck_id ORDER BY s.slide_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM slides s LEFT JOIN bounds b ON b.deck_id = s.deck_id AND b.slide_num = s.slide_num) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, p AS predicted_ms, CAST(start_ms AS BIGINT) AS start_ms, CAST(start_ms - p AS BIGINT) AS delta_ms, abs(start_ms - p) > 500 AS flagged FROM j WHERE start_ms IS NOT NULL AND audio_ms IS NOT NULL",
    # timelines
    "tl1_spoken_text": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, coalesce(nullif(subtitle_text, ''), notes) AS spoken, coalesce(audio_ms, 5000) AS duration_ms, CASE WHEN notes IS NULL THEN 'silent' END AS code FROM slides",
    "tl1_warnings": f"WITH {EVENTS}, told AS (SELECT DISTINCT deck_id, slide_num FROM matched WHERE slide_num % 4 <> 0), n AS (SELECT deck_id, slide_num FROM slides WHERE notes IS NOT NULL) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, 'no_duration' AS code FROM n WHERE deck_id % 11 = 0 UNION ALL SELECT deck_id, CAST(slide_num AS BIGINT), 'no_events' FROM n WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.deck_id = n.deck_id AND t.slide_num = n.slide_num)",
    "tl2_predicted_starts": f"WITH {SLIDES}, {STARTS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(duration_ms AS BIGINT) AS duration_ms, predicted_ms FROM starts",
    "tl2_large_timeline": f"WITH slides AS (SELECT l_orderkey AS deck_id, l_linenumber AS slide_num, CAST(sum(l_quantity) AS BIGINT) AS audio_ms FROM lineitem GROUP BY ALL), {STARTS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(duration_ms AS BIGINT) AS duration_ms, predicted_ms FROM starts",
    "predictive_captions": f"{PREDICTED} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, text, {_time('(start_ms + predicted_ms)')} AS start_at, {_time('(end_ms + predicted_ms)')} AS end_at FROM captions JOIN starts USING (deck_id, slide_num)",
    "tl3a_direct_scale": f"WITH {SLIDES}, {SCALES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, round(direct, 9) AS direct FROM own",
    "tl3b_inferred_scale": f"WITH {SLIDES}, {SCALES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, round(CASE WHEN dp > 0 THEN dm / dp END, 9) AS inferred FROM ahead",
    "tl3c_scales": f"WITH {SLIDES}, {SCALES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(start_ms AS BIGINT) AS start_ms, round(scale, 9) AS scale, code FROM placed",
    "tl3_measured_captions": f"WITH RECURSIVE {CAPTIONS}, {SCALES} SELECT c.deck_id, CAST(c.slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, text, CAST(p.start_ms + round_even(c.start_ms * scale, 0) AS BIGINT) AS start_ms, CAST(p.start_ms + round_even(c.end_ms * scale, 0) AS BIGINT) AS end_ms FROM captions c JOIN placed p ON p.deck_id = c.deck_id AND p.slide_num = c.slide_num",
    "tl3_subtitles": f"WITH RECURSIVE {SUBTITLES}, {SCALES} SELECT c.deck_id, CAST(c.slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS seg_idx, text, CAST(p.start_ms + round_even(c.start_ms * scale, 0) AS BIGINT) AS start_ms, CAST(p.start_ms + round_even(c.end_ms * scale, 0) AS BIGINT) AS end_ms FROM captions c JOIN placed p ON p.deck_id = c.deck_id AND p.slide_num = c.slide_num",
    "tl3_warnings": f"WITH RECURSIVE {CAPTIONS}, {SCALES} SELECT DISTINCT p.deck_id, CAST(p.slide_num AS BIGINT) AS slide_num, code FROM placed p JOIN captions c ON p.deck_id = c.deck_id AND p.slide_num = c.slide_num WHERE code IS NOT NULL",
    # signals
    "aud1_standardize": "WITH v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, avg(v) AS a, stddev_pop(v) AS s FROM v GROUP BY vec_id) SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round((v - a) / CASE WHEN s > 1e-6 THEN s ELSE 1.0 END, 5) AS z FROM v JOIN m USING (vec_id)",
    "aud2_best_lags": "WITH t AS (SELECT vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS s, vec_id FROM embeddings), c AS (SELECT vec_id, pos - vec_id * 64 AS i, s - avg(s) OVER (PARTITION BY vec_id) AS c FROM t), l AS (SELECT vec_id, i, c, unnest(range(greatest(vec_id * 64 + vec_id % 7 - 96, 0), vec_id * 64 + vec_id % 7 + 97)) AS lag FROM c), sc AS (SELECT l.vec_id, lag, round(sum(t.s * c), 6) AS score, count(*) AS n FROM l JOIN t ON t.pos = lag + i GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, lag) AS k FROM sc WHERE n = 64) SELECT vec_id AS clip_id, CAST(lag AS BIGINT) AS lag FROM o WHERE k = 1",
    "aud5_sampling": f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_num ORDER BY ev_idx) - 1 AS k, count(*) OVER (PARTITION BY deck_id, slide_num) AS n FROM matched), w AS (SELECT *, list_transform(range(7), lambda i: CAST(round_even(i * (n - 1) / 6, 0) AS BIGINT)) AS l FROM n) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(ev_idx AS BIGINT) AS ev_idx FROM w WHERE (n <= 7 OR list_contains(l, k)) AND offset_ms >= 50",
    # calibration
    "cal1_fit_scale": "WITH p AS (SELECT l_orderkey % 50 AS deck_id, l_quantity AS m, l_quantity * 1.00121 AS o FROM lineitem) SELECT deck_id, round(sum(m * o) / sum(m * m), 8) AS k, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY deck_id",
    "cal2_report": "WITH p AS (SELECT l_orderkey % 50 AS deck_id, l_quantity AS m, l_quantity * 1.00121 + (l_partkey % 5 - 2) * CASE WHEN l_orderkey % 50 < 10 THEN 1.5 ELSE 0.1 END AS o FROM lineitem), f AS (SELECT deck_id, sum(m * o) / sum(m * m) AS k FROM p GROUP BY deck_id), r AS (SELECT deck_id, k, m * k - o AS r FROM p JOIN f USING (deck_id)) SELECT deck_id, round(max(k), 8) AS k, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(r * r)), 6) AS rms, round(max(abs(r)), 6) AS max_residual, sqrt(avg(r * r)) > 1.0 OR max(abs(r)) > 2.0 AS doubtful FROM r GROUP BY deck_id",
    "cal3_suggest": f"WITH {SLIDES}, {STARTS}, p AS (SELECT deck_id, predicted_ms / 1000 AS m, predicted_ms * 1.0012 / 1000 AS o FROM starts WHERE predicted_ms > 0), f AS (SELECT deck_id, sum(m * o) / sum(m * m) AS k, count(*) AS n FROM p GROUP BY deck_id), r AS (SELECT deck_id, k, n, m * k - o AS r FROM p JOIN f USING (deck_id) WHERE n >= 2) SELECT deck_id, round(max(k), 6) AS k, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(r * r)), 6) AS rms, sqrt(avg(r * r)) > 1.0 OR max(abs(r)) > 2.0 AS doubtful FROM r GROUP BY deck_id",
    "cal2_missing": f"WITH {SLIDES}, {BOUNDS} SELECT s.deck_id, CAST(s.slide_num AS BIGINT) AS slide_num FROM starts s WHERE NOT EXISTS (SELECT 1 FROM bounds b WHERE b.deck_id = s.deck_id AND b.slide_num = s.slide_num)",
    "cal4_ranges": f"WITH {SLIDES}, {BOUNDS}, d AS (SELECT b.start_ms - s.predicted_ms AS delta, b.start_ms AS start FROM bounds b JOIN starts s ON s.deck_id = b.deck_id AND s.slide_num = b.slide_num) SELECT CAST(min(delta) AS BIGINT) AS min_delta, CAST(max(delta) AS BIGINT) AS max_delta, CAST(min(start) AS BIGINT) AS min_start, CAST(max(start) AS BIGINT) AS max_start FROM d",
    # intervals and cues
    "ivl1_clip": f"{PREDICTED}, {CUES}, {TOTALS}, e AS (SELECT deck_id, predicted_ms AS at_ms FROM starts WHERE slide_num = 3 UNION ALL SELECT deck_id, 0 FROM totals UNION ALL SELECT deck_id, total_ms FROM totals), w AS (SELECT deck_id, row_number() OVER v - 1 AS part_idx, at_ms AS w0, lead(at_ms) OVER v AS w1 FROM e WINDOW v AS (PARTITION BY deck_id ORDER BY at_ms)) SELECT c.deck_id, CAST(part_idx AS BIGINT) AS part_idx, CAST(cue_idx AS BIGINT) AS cue_idx, CAST(greatest(start_ms, w0) - w0 AS BIGINT) AS start_ms, CAST(least(end_ms, w1) - w0 AS BIGINT) AS end_ms, text FROM cues c JOIN w ON w.deck_id = c.deck_id WHERE w1 IS NOT NULL AND least(end_ms, w1) > greatest(start_ms, w0)",
    "ivl2_windows": f"WITH {SLIDES}, {STARTS}, {TOTALS}, e AS (SELECT deck_id, predicted_ms AS at_ms FROM starts WHERE slide_num = 3 UNION ALL SELECT deck_id, 0 FROM totals UNION ALL SELECT deck_id, total_ms FROM totals), w AS (SELECT deck_id, row_number() OVER v - 1 AS part_idx, at_ms AS w0, lead(at_ms) OVER v AS w1 FROM e WINDOW v AS (PARTITION BY deck_id ORDER BY at_ms)) SELECT deck_id, CAST(part_idx AS BIGINT) AS part_idx, CAST(w0 AS BIGINT) AS w0, CAST(w1 AS BIGINT) AS w1 FROM w WHERE w1 IS NOT NULL",
    "ivl3_equal_cuts": f"WITH {SLIDES}, {STARTS}, {TOTALS}, c AS (SELECT s.deck_id, slide_num, predicted_ms AS at_ms, abs(predicted_ms * 2 - total_ms) AS d FROM starts s JOIN totals t ON t.deck_id = s.deck_id WHERE predicted_ms > 0), o AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY d, at_ms, slide_num) AS k FROM c) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(at_ms AS BIGINT) AS at_ms FROM o WHERE k = 1",
    "ivl4_cuts_after": f"WITH {SLIDES}, {STARTS} SELECT s.deck_id, CAST(s.slide_num AS BIGINT) AS slide_num, s.predicted_ms AS at_ms FROM starts s JOIN starts p ON p.deck_id = s.deck_id AND p.slide_num = s.slide_num - 1 WHERE p.slide_num % 2 = 0",
    "ivl5_overlapping": f"WITH RECURSIVE {RAW}, c AS (SELECT deck_id, slide_num, seg_idx, raw_start AS s, raw_end + CASE WHEN seg_idx % 3 = 0 THEN 500 ELSE 0 END AS e FROM raw WHERE raw_start IS NOT NULL), l AS (SELECT *, lag(e) OVER (PARTITION BY deck_id, slide_num ORDER BY seg_idx) - s AS o FROM c) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(seg_idx AS BIGINT) AS cue_idx, CAST(o AS BIGINT) AS overlap_ms FROM l WHERE o > 0",
    "srt2_format": f"{SRT} SELECT deck_id, srt FROM srt",
    "srt3_round_trip": f"{PREDICTED}, {CUES} SELECT deck_id, CAST(cue_idx AS BIGINT) AS cue_idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM cues",
    "snk10_part_files": f"{PREDICTED}, {CUES}, {TOTALS}, e AS (SELECT deck_id, predicted_ms AS at_ms FROM starts WHERE slide_num = 3 UNION ALL SELECT deck_id, 0 FROM totals UNION ALL SELECT deck_id, total_ms FROM totals), w AS (SELECT deck_id, row_number() OVER v - 1 AS part_idx, at_ms AS w0, lead(at_ms) OVER v AS w1 FROM e WINDOW v AS (PARTITION BY deck_id ORDER BY at_ms)), c AS (SELECT c.deck_id, part_idx, row_number() OVER (PARTITION BY c.deck_id, part_idx ORDER BY cue_idx) AS n, greatest(start_ms, w0) - w0 AS a, least(end_ms, w1) - w0 AS b, text FROM cues c JOIN w ON w.deck_id = c.deck_id WHERE w1 IS NOT NULL AND least(end_ms, w1) > greatest(start_ms, w0)) SELECT deck_id, CAST(part_idx AS BIGINT) AS part_idx, string_agg(CAST(n AS VARCHAR) || chr(10) || {_time('a')} || ' --> ' || {_time('b')} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM c GROUP BY ALL",
    # lookups and merges
    "mrg3_manifest": f"WITH {ENTRIES}, k AS (SELECT deck_id, slide_num, audio_file FROM entries WHERE entry_idx = 0), now AS (SELECT deck_id, slide_num, 'now.mp3' AS audio_file FROM k WHERE deck_id % 3 = 0) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, audio_file FROM now UNION ALL SELECT deck_id, CAST(slide_num AS BIGINT), audio_file FROM k WHERE deck_id % 5 <> 0 AND deck_id % 3 <> 0",
    "mrg1_upsert": f"WITH {ENTRIES}, fresh AS (SELECT deck_id, slide_num, 'new.mp3' AS audio_file FROM slides WHERE slide_num % 3 = 1), kept AS (SELECT deck_id, slide_num, audio_file FROM entries e WHERE entry_idx = 0 AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.deck_id = e.deck_id AND f.slide_num = e.slide_num)) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, audio_file FROM kept UNION ALL SELECT deck_id, CAST(slide_num AS BIGINT), audio_file FROM fresh",
    "mrg2_selected": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, title FROM slides WHERE slide_num IN (1, 3, 4)",
    "mrg2_absent": f"WITH {SLIDES}, d AS (SELECT DISTINCT deck_id FROM slides), w AS (SELECT deck_id, unnest([1, 3, 4]) AS slide_num FROM d) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num FROM w WHERE NOT EXISTS (SELECT 1 FROM slides s WHERE s.deck_id = w.deck_id AND s.slide_num = w.slide_num)",
    "mrg4_subtitle_text": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CASE WHEN slide_num = 2 THEN 'replaced' ELSE subtitle_text END AS subtitle_text FROM slides",
    "join1_enrich": f"WITH {ENTRIES}, f AS (SELECT deck_id, slide_num, arg_min(coalesce(audio_file, ''), entry_idx) AS a, count(*) AS n FROM entries GROUP BY ALL) SELECT s.deck_id, CAST(s.slide_num AS BIGINT) AS slide_num, nullif(a, '') AS audio_file, coalesce({_strip('notes')} <> '', FALSE) AS has_notes FROM slides s LEFT JOIN f ON f.deck_id = s.deck_id AND f.slide_num = s.slide_num",
    "join2_audio_map": f"WITH {ENTRIES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, arg_max(audio_file, entry_idx) AS audio_file FROM entries WHERE coalesce(audio_file, '') <> '' GROUP BY ALL",
    "flt1_narratable": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num FROM slides WHERE {_strip('notes')} <> ''",
    "flt2_missing_notes": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num FROM slides WHERE notes IS NULL",
    # documents written and read
    "src2_titles": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT doc_id, i, {_strip('s')} AS s FROM l) SELECT doc_id, arg_min(s, i) AS title FROM f WHERE s <> '' AND lower(s) <> 'click to add title' GROUP BY doc_id",
    "src3_notes": f"SELECT doc_id, nullif({_strip('string_agg(p, chr(10) ORDER BY i)')}, '') AS notes FROM (SELECT doc_id, {_strip('s')} AS p, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY doc_id",
    "aud4_locate": f"WITH {TRACKS}, s0 AS (SELECT c.*, track, samples[1:16] AS clip, CAST(floor((slide_num - 1) * CAST(1.05 AS DOUBLE) * 64) AS BIGINT) AS centre FROM clips c JOIN tracks USING (deck_id)), {_found('s0', 's')}, e0 AS (SELECT * REPLACE (samples[49:64] AS clip, found + 48 AS centre), found AS start FROM s), {_found('(SELECT * EXCLUDE (found) FROM e0)', 'e')} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, round(start / 64, 6) AS start_s, round((found + 16) / 64, 6) AS end_s FROM e",
    "aud5_word_check": f"WITH {TRACKS}, w AS (SELECT c.*, track, ev_idx, ev_idx / 8 AS o, greatest(CAST(0 AS DOUBLE), ev_idx / 8 - CAST(0.2 AS DOUBLE)) AS b, (slide_num - 1) * CAST(1.01 AS DOUBLE) AS s FROM clips c JOIN tracks USING (deck_id), unnest(range(1, 8)) AS t(ev_idx)), p0 AS (SELECT *, samples[CAST(floor(b * 64) AS INT) + 1:64] AS clip, CAST(floor((s + b) * 64) AS BIGINT) AS centre FROM w), {_found('(SELECT * FROM p0 WHERE len(clip) >= 32)', 'p')}, m AS (SELECT *, found / 64 + o - b AS measured FROM p) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(ev_idx AS BIGINT) AS ev_idx, round(measured - (s + o), 6) AS naive_delta, round(1 + (measured - (s + o)) / o, 6) AS implied_scale, round(measured, 6) AS measured_s FROM m",
    "aud4_warnings": f"WITH {ENTRIES} SELECT DISTINCT deck_id, CAST(slide_num AS BIGINT) AS slide_num, 'not_located' AS code FROM entries WHERE audio_file IS NULL",
    "ext9_insertion": f"WITH {ENTRIES}, a AS (SELECT deck_id, slide_num, arg_max(audio_file, entry_idx) AS audio_file FROM entries WHERE audio_file IS NOT NULL GROUP BY ALL) SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, audio_file, CASE WHEN slide_num % 3 = 0 THEN 'audio file not found' END AS reason FROM a UNION ALL SELECT deck_id, CAST(max(slide_num) + 100 AS BIGINT), 'extra.mp3', 'slide not found' FROM a GROUP BY deck_id",
    "snk4_subtitle_files": f"{SRT} SELECT c_custkey AS deck_id, coalesce(srt, '') AS srt FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN srt ON srt.deck_id = c_custkey",
    "src4_manifest": f"WITH {ENTRIES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(entry_idx AS BIGINT) AS entry_idx, title, audio_file FROM entries",
    "src5_slide_documents": f"WITH {SLIDES} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, title, notes FROM slides",
    "src6_sidecars": f"WITH {EVENTS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, CAST(ev_idx AS BIGINT) AS ev_idx, text, CAST(offset_ms AS BIGINT) AS offset_ms FROM matched WHERE deck_id % 9 <> 0",
    "src6_sidecar_warnings": f"WITH {EVENTS} SELECT DISTINCT deck_id, CAST(slide_num AS BIGINT) AS slide_num, 'unreadable_events' AS code FROM matched WHERE deck_id % 9 = 0",
    "src12_observations": f"WITH {SLIDES}, {STARTS} SELECT deck_id, CAST(slide_num AS BIGINT) AS slide_num, round(predicted_ms / 1000, 3) AS observed FROM starts",
    "snk1_payload": f"WITH {ENTRIES}, f AS (SELECT deck_id, slide_num, arg_min(coalesce(audio_file, ''), entry_idx) AS a FROM entries GROUP BY ALL) SELECT s.deck_id, CAST(count(*) AS BIGINT) AS slide_count, CAST(sum(CASE WHEN coalesce({_strip('notes')}, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS narrated, CAST(count(nullif(a, '')) AS BIGINT) AS with_audio FROM slides s LEFT JOIN f ON f.deck_id = s.deck_id AND f.slide_num = s.slide_num GROUP BY s.deck_id",
    "snk7_bounds": f"WITH {SLIDES}, {BOUNDS} SELECT deck_id, '{{' || string_agg('\"' || CAST(slide_num AS VARCHAR) || '\":[' || CAST(start_ms AS VARCHAR) || ',' || coalesce(CAST(end_ms AS VARCHAR), 'null') || ']', ',' ORDER BY slide_num) || '}}' AS bounds FROM bounds GROUP BY deck_id",
    "snk7_bounds_dump": f"WITH {SLIDES}, {BOUNDS}, w AS (SELECT deck_id, string_agg('slide ' || CAST(slide_num AS VARCHAR), ';' ORDER BY slide_num) AS warnings FROM slides WHERE slide_num % 4 = 0 GROUP BY deck_id) SELECT coalesce(b.deck_id, w.deck_id) AS deck_id, CAST(8.0 AS DOUBLE) AS anchor, coalesce(warnings, '') AS warnings, CAST(slide_num AS VARCHAR) AS slide, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM bounds b FULL JOIN w ON w.deck_id = b.deck_id",
    "snk8_csv_documents": f"WITH {EVENTS} SELECT deck_id, chr(65279) || 'slide_num,ev_idx,name,offset_ms' || chr(13) || chr(10) || string_agg(CAST(slide_num AS VARCHAR) || ',' || CAST(ev_idx AS VARCHAR) || ',' || CASE WHEN ev_idx = 1 THEN '\"a \"\"quoted\"\", one\"' ELSE 'plain' END || ',' || CAST(offset_ms AS VARCHAR), chr(13) || chr(10) ORDER BY slide_num, ev_idx) || chr(13) || chr(10) AS value FROM matched WHERE ev_idx < 3 GROUP BY deck_id",
    "snk9_calibration_report": f"WITH {SLIDES}, {BOUNDS}, p AS (SELECT deck_id, slide_num, CAST(start_ms AS DOUBLE) AS m, start_ms * 1.00121 AS o FROM bounds), f AS (SELECT deck_id, sum(m * o) / nullif(sum(m * m), 0) AS k, count(*) AS n FROM p GROUP BY deck_id) SELECT deck_id, round(k, 8) AS k, CAST(n AS BIGINT) AS n FROM f WHERE n >= 2",
    # fidelity
    "fid1_content_changed": f"WITH {PAIRS} SELECT doc_id, {_content('original')} <> {_content('processed')} AS changed FROM pairs",
    "fid3_split_words": f"WITH {PAIRS}, l AS (SELECT doc_id, original, unnest(string_split(processed, chr(10))) AS s, generate_subscripts(string_split(processed, chr(10)), 1) AS n FROM pairs), f AS (SELECT * FROM l WHERE {_strip('s')} <> ''), j AS (SELECT doc_id, original, n, s, lead(n) OVER w AS nn, lead(s) OVER w AS t FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY n)), x AS (SELECT *, regexp_extract(s, '[A-Za-z0-9]+$') || regexp_extract(t, '^[A-Za-z0-9]+') AS word FROM j WHERE regexp_matches(s, '[A-Za-z]$') AND regexp_matches(t, '^[A-Za-z]')) SELECT doc_id, CAST(n AS BIGINT) AS line_no, CAST(nn AS BIGINT) AS next_no, word FROM x WHERE contains(original, word)",
    "fid4_block_counts": f"WITH {PAIRS}, b AS (SELECT doc_id, len(list_filter(regexp_split_to_array(replace(original, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {_strip('x')} <> '')) AS was, len(list_filter(regexp_split_to_array(processed, '\\n\\s*\\n'), lambda x: {_strip('x')} <> '')) AS now FROM pairs) SELECT doc_id, CAST(was AS BIGINT) AS was, CAST(now AS BIGINT) AS now, was <> now AS differs FROM b",
    "fid4_merged_blocks": f"WITH RECURSIVE p AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS original, regexp_replace(text, '^([^\\n]*\\n[^\\n]*)\\n', '\\1' || chr(10) || chr(10)) AS processed FROM documents), b AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(original, '\\n\\s*\\n'), lambda x: {_strip('x')} <> ''), lambda x: {_content('x')}) AS o, list_transform(list_filter(regexp_split_to_array(processed, '\\n\\s*\\n'), lambda x: {_strip('x')} <> ''), lambda x: {_content('x')}) AS q FROM p), d AS (SELECT *, array_to_string(o, '') AS whole, list_transform(range(0, len(o) + 1), lambda i: coalesce(list_sum(list_transform(o[1:i], lambda x: length(x))), 0)) AS e FROM b WHERE len(o) <> len(q)), walk AS (SELECT doc_id, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n FROM d UNION ALL SELECT doc_id, k + 1, pos + m, m FROM (SELECT doc_id, k, pos, CAST(CASE WHEN block = '' THEN 0 WHEN same IS NOT NULL AND substr(whole, CAST(e[pos + 1] + 1 AS INT), length(block)) = block THEN same ELSE coalesce(longer, len(o) - pos) END AS BIGINT) AS m FROM (SELECT w.doc_id, k, pos, o, e, whole, q[k + 2] AS block, list_min(list_filter(range(1, len(o) - pos + 1), lambda n: e[pos + n + 1] - e[pos + 1] = length(q[k + 2]))) AS same, list_min(list_filter(range(1, len(o) - pos + 1), lambda n: e[pos + n + 1] - e[pos + 1] > length(q[k + 2]))) AS longer FROM walk w JOIN d ON d.doc_id = w.doc_id WHERE k + 1 < len(q)))) SELECT doc_id, k AS block, n AS merged FROM walk WHERE n > 1",
    "fid5_summary": f"WITH {PAIRS} SELECT CAST(count(*) AS BIGINT) AS findings, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM pairs WHERE {_content('original')} <> {_content('processed')}",
}
