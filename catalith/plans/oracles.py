"""DuckDB SQL for the catalogue queries, written apart from the operators."""

from __future__ import annotations

from catalith.plans.archive import duck_archive

SQL: dict[str, str] = {}


def on_archive(name: str, body: str) -> None:
    """A query over the archive view; ``body`` is a SELECT, or further common tables and a SELECT."""
    SQL[name] = f"WITH archive AS ({duck_archive()})" + (" " if body.startswith("SELECT") else ", ") + body


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def cap(x: str) -> str:
    return f"(upper({x}[1]) || lower({x}[2:]))"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- health -------------------------------------------------------------------

_RULES = [
    ("MISSING_TITLE", "error", "title IS NULL OR trim(title) = ''"),
    ("MISSING_ARTIST", "error", "artist IS NULL OR trim(artist) = ''"),
    ("MISSING_ALBUM", "warning", "album IS NULL OR trim(album) = ''"),
    ("MISSING_YEAR", "warning", "year IS NULL OR trim(year) = ''"),
    ("MISSING_GENRE", "warning", "genre IS NULL OR trim(genre) = ''"),
    ("MISSING_TRACK", "warning", "track IS NULL"),
    ("ZERO_DURATION", "error", "duration IS NULL OR duration < 1"),
    ("SUSPICIOUS_BITRATE", "error", "bitrate IS NULL OR bitrate < 64000 OR bitrate > 10000000"),
    ("LOW_QUALITY", "warning", "bitrate BETWEEN 64000 AND 127999"),
    ("LOSSLESS_EXPECTED", "warning", "(ext = '.flac' OR lower(codec) IN ('alac', 'flac')) AND bitrate < 300000"),
    ("NO_AUDIO_HASH", "warning", "audio_hash IS NULL OR audio_hash = ''"),
    ("UNKNOWN_CODEC", "warning", "codec IS NULL OR trim(codec) = ''"),
]
_ISSUES = "i AS (" + " UNION ALL ".join(f"SELECT file_path, '{c}' AS issue, '{s}' AS severity FROM archive WHERE status <> 'GHOST' AND ({w})" for c, s, w in _RULES) + ")"
on_archive("health_issue_rows", f"{_ISSUES} SELECT * FROM i")
on_archive("health_issue_breakdown", f"{_ISSUES} SELECT issue, severity, count(*) AS cnt FROM i GROUP BY ALL")
on_archive("health_top_files", f"{_ISSUES} SELECT file_path, count(*) AS cnt FROM i GROUP BY ALL ORDER BY cnt DESC, file_path LIMIT 10")
on_archive("status_counters", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("PENDING", "HASHED", "CATALOGUED", "GHOST", "QUARANTINED")) + ", count(DISTINCT artist) AS artists, max(finalized_at) AS last_finalized FROM archive")
on_archive("report_rollup", "r AS (SELECT coalesce(genre, '(none)') AS genre, coalesce(codec, '(none)') AS codec, size_bytes FROM archive) SELECT genre, codec, CAST(grouping(genre, codec) AS INTEGER) AS level, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM r GROUP BY ROLLUP (genre, codec)")
on_archive("bitrate_bands", "SELECT CASE WHEN bitrate IS NULL THEN 'unknown' WHEN bitrate < 128000 THEN 'under 128' WHEN bitrate < 256000 THEN '128-255' WHEN bitrate < 500000 THEN '256-499' ELSE '500 and more' END AS band, count(*) AS files FROM archive GROUP BY ALL")
on_archive("upgrade_candidates", """r AS (SELECT file_path, lower(trim(artist)) AS a, lower(trim(title)) AS t, coalesce(bitrate // 1000, 0) AS kbps, lower(codec) IN ('flac', 'alac', 'pcm_s16le', 'pcm_s24le', 'pcm_s32le') AS ll FROM archive WHERE trim(artist) <> '' AND trim(title) <> ''),
b AS (SELECT a, t, max(kbps) AS best_kbps FROM r WHERE ll GROUP BY ALL)
SELECT file_path, kbps, best_kbps FROM r JOIN b USING (a, t) WHERE NOT ll AND best_kbps - kbps >= 100""")
on_archive("spec_outliers", "o AS (SELECT file_path, CASE WHEN bitrate // 1000 < 96 THEN 'bitrate low' WHEN bitrate // 1000 > 2000 THEN 'bitrate high' WHEN sample_rate NOT IN (44100, 48000) THEN 'sample rate' WHEN channels > 2 THEN 'channels' END AS why FROM archive) SELECT * FROM o WHERE why IS NOT NULL")
on_archive("genre_counts", "SELECT trim(split_part(genre, ',', 1)) AS genre, count(*) AS tracks, count(DISTINCT file_path) AS files FROM archive WHERE trim(genre) <> '' GROUP BY 1")

_STEM = r"regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\.[^./]*$', '\1')"
on_archive("playlist_lines", f"""r AS (
  SELECT CASE trim(split_part(genre, ',', 1)) WHEN 'R&B/Funk/Soul' THEN 'R&B-Funk-Soul' ELSE translate(trim(split_part(genre, ',', 1)), '/ ', '-_') END AS playlist,
         artist, title, file_path, {_STEM} AS stem
  FROM archive WHERE status = 'CATALOGUED' AND trim(genre) <> ''),
l AS (
  SELECT playlist, file_path, '#EXTINF:-1,' || CASE WHEN coalesce(artist, '') <> '' AND coalesce(title, '') <> '' THEN trim(artist) || ' - ' || trim(title)
    WHEN instr(stem, ' - ') > 0 THEN trim(stem[1:instr(stem, ' - ') - 1]) || ' - ' || trim(stem[instr(stem, ' - ') + 3:]) ELSE stem END AS info
  FROM r)
SELECT playlist, info, file_path FROM l UNION ALL SELECT 'All', info, file_path FROM l""")
SQL["review_summary"] = "SELECT o_orderpriority AS issue_type, count(*) AS cnt, round(avg((o_orderkey % 100) / 100), 4) AS mean_confidence FROM orders GROUP BY 1"
SQL["run_stage_counters"] = "SELECT user_id % 10 AS stage, count(*) AS processed, count(*) FILTER (event_type = 'purchase') AS changed, count(*) FILTER (event_type = 'error') AS errored FROM events GROUP BY 1"

# -- flags --------------------------------------------------------------------

on_archive("corrupt_flags", f"""t AS (
  SELECT *, CASE lower(codec) WHEN 'flac' THEN 30000 WHEN 'alac' THEN 30000 WHEN 'aac' THEN 8000 WHEN 'mp3' THEN 8000 ELSE CASE ext WHEN '.flac' THEN 30000 ELSE 8000 END END AS floor_bps,
         {_STEM} AS stem FROM archive WHERE status = 'CATALOGUED' AND duration > 0),
r AS (SELECT file_path, CASE WHEN size_bytes < floor_bps * duration * 0.15 THEN 'too_small' WHEN duration < 45 AND NOT regexp_matches(stem, '(?i)\\b(intro|outro|skit|reprise|interlude|snippet|clip|bonus|fragment|excerpt|medley|bridge)\\b') THEN 'too_short' END AS reason FROM t)
SELECT * FROM r WHERE reason IS NOT NULL""")
on_archive("loudness_window", "SELECT file_path, lufs, lufs_tp, concat_ws('; ', CASE WHEN lufs < -19.5 THEN 'too quiet' END, CASE WHEN lufs > -16.5 THEN 'too loud' END, CASE WHEN lufs_tp > -1 THEN 'peak too high' END) AS reasons FROM archive WHERE lufs IS NOT NULL AND (lufs NOT BETWEEN -19.5 AND -16.5 OR lufs_tp > -1)")
on_archive("canon_action", "SELECT CASE WHEN lower(codec) IN ('alac', 'aac') AND ext = '.m4a' THEN 'PASSTHROUGH' WHEN lower(codec) IN ('flac', 'alac', 'pcm_s16le', 'pcm_s24le', 'pcm_s32le') THEN 'CONVERT' ELSE 'TRANSCODE' END AS action, count(*) AS files FROM archive GROUP BY 1")
on_archive("junk_classify", r"""r AS (SELECT file_path, lower(trim(coalesce(artist, ''))) AS a, lower(coalesce(title, '')) AS t, lower(coalesce(album, '')) AS b FROM archive),
j AS (SELECT file_path, CASE
  WHEN regexp_matches(a, 'louis armstrong|neil young|garth brooks|merle haggard|spirit|blondie|led zeppelin|jan|mary wells|refreshments|monks|thomas d''arcy|big blues corp city|sleep|sleep token|the healing|big sleep') THEN NULL
  WHEN regexp_matches(a, 'karaoke channel|hit tunes karaoke|monster karaoke|michael sealey|lauren ostrowski fenton|guided meditation guru|healing vibrations|michelle''s sanctuary') THEN 'known_junk_artist'
  WHEN regexp_matches(a, '\b(karaoke|tribute|sleep|meditation|hypnos[ie]s|relaxation|healing|sound bath|white noise|brown noise|pink noise|asmr)\b|\bre-?record') THEN 'artist_pattern'
  WHEN regexp_matches(t, 'karaoke version|in the style of|originally performed|made famous by|instrumental version|backing track') THEN 'title_pattern'
  WHEN regexp_matches(b, '\b(karaoke\b|tribute\b|meditation\b|sleep\b|hypnos|relax)') THEN 'album_pattern' END AS reason FROM r)
SELECT * FROM j WHERE reason IS NOT NULL""")
_VARIOUS = r"(lower(trim(coalesce({0}, ''))) IN ('various artists', 'various', 'va', 'various artist') OR regexp_matches(lower(trim(coalesce({0}, ''))), '^various artists?([^\p{{L}}\p{{N}}].*)?$'))"
on_archive("various_detect", f"SELECT file_path, artist FROM archive WHERE {_VARIOUS.format('artist')}")
on_archive("bracket_extract", rf"""n AS (
  SELECT id, translate(CASE id % 3 WHEN 0 THEN 'Various Artists - ' || artist || ' - Song.m4a' WHEN 1 THEN 'Song [' || artist || '-Label].m4a' ELSE artist || '.m4a' END, '/', '_') AS name
  FROM archive WHERE trim(artist) <> ''),
s AS (SELECT id, regexp_replace(name, '(.)\.[^./]*$', '\1') AS stem FROM n),
p AS (SELECT id, regexp_extract(stem, '\[([^\]]+)\]', 1) AS inside, list_transform(string_split(stem, ' - '), lambda x: trim(x)) AS parts FROM s),
q AS (SELECT id, CASE WHEN instr(inside, '-') > 0 AND length(trim(split_part(inside, '-', 1))) > 3 THEN trim(split_part(inside, '-', 1)) ELSE trim(inside) END AS br,
  CASE WHEN len(parts) >= 3 AND {_VARIOUS.format('parts[1]')} THEN parts[2] ELSE '' END AS seg FROM p)
SELECT id, CASE WHEN br <> '' AND NOT {_VARIOUS.format('br')} THEN br WHEN seg <> '' AND NOT {_VARIOUS.format('seg')} THEN seg ELSE '' END AS artist,
  CASE WHEN br <> '' AND NOT {_VARIOUS.format('br')} THEN 'bracket' WHEN seg <> '' AND NOT {_VARIOUS.format('seg')} THEN 'filename_segment' ELSE 'unknown' END AS strategy FROM q""")

# -- texts --------------------------------------------------------------------

_ARTICLES = "the|a|an|le|la|les|el|los|las|de|het|een|die|das|ein|eine"
_PAREN, _COMMA, _LEAD = rf"(?i),?\s*\(\s*({_ARTICLES})\s*\)\s*$", rf"(?i),\s*({_ARTICLES})\s*$", rf"(?i)^({_ARTICLES}) "


def article_suffix(x: str) -> str:
    base = strip(f"regexp_replace({x}, '{_PAREN}', '')")
    return rf"""CASE WHEN lower({x}) IN ('de la soul', 'la roux', 'los lobos', 'los lonely boys', 'die ärzte', 'die toten hosen', 'das efx') THEN {x}
  WHEN regexp_matches({x}, '{_COMMA}') THEN {x}
  WHEN regexp_matches({x}, '{_PAREN}') THEN CASE WHEN regexp_matches({base}, '{_COMMA}') THEN {base} WHEN rtrim({base}, ', ') = '' THEN {x} ELSE rtrim({base}, ', ') || ', ' || {cap(f"regexp_extract({x}, '{_PAREN}', 1)")} END
  WHEN regexp_matches({x}, '{_LEAD}.') THEN {strip(f"regexp_replace({x}, '{_LEAD}', '')")} || ', ' || {cap(f"regexp_extract({x}, '{_LEAD}', 1)")} ELSE {x} END"""


def title_case(x: str) -> str:
    special = rf"""regexp_replace(regexp_replace(regexp_replace({x}, '\b([Rr])ock\s*[''`]?\s*[Nn]\s*[''`]?\s*[Rr]oll\b', '\1ock ''n'' Roll', 'g'), '(?i)\bR\s*[''`&]\s*B\b', 'R&B', 'g'), '(?i)\b(?:ft|feat)\b\.?', 'feat.', 'g')"""
    from catalith.functions import vocabulary as V

    edge = r"""["''()\[\]{}.,!?;:-]"""
    clean = f"regexp_replace(w, '^{edge}+|{edge}+$', '', 'g')"
    kept = f"CASE WHEN {clean} = '' THEN w ELSE replace(w, {clean}, upper({clean})) END"
    words = rf"string_split_regex({strip(special)}, '\s+')"
    one = rf"""CASE WHEN regexp_matches(w, '^([A-Za-z]\.){{2,}}$') THEN upper(w)
      WHEN upper({clean}) IN ({quoted(V.KEEP_CAPS)}) THEN {kept}
      WHEN {clean} <> '' AND regexp_matches({clean}, '\p{{L}}') AND upper({clean}) = {clean} AND upper({clean}) NOT IN ({quoted(V.ROMAN_FALSE_FRIENDS)}) AND regexp_matches({clean}, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') THEN {kept}
      WHEN i = 1 OR i = len({words}) THEN {cap("w")}
      WHEN lower({clean}) IN ({quoted(V.LOWERCASE_WORDS)}) THEN lower(w) ELSE {cap("w")} END"""
    return f"CASE WHEN {strip(special)} = '' THEN {x} ELSE array_to_string(list_transform({words}, lambda w, i: {one}), ' ') END"


def all_caps(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{L}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]'))"


def without_track(x: str) -> str:
    patterns = [r"(?i)^\s*(?:disc|cd)\s*\d+\s*[-_. ]+\s*\d{1,3}\s*[-_. ]+", r"^\s*\d{1,2}\s*[-_.]\s*\d{1,3}\s+", r"^\s*\d{2,3}\s*[-_.]\s+", r"^\s*0\d\s+", r"^\s*\d{2,3}[._]\s*"]
    s = strip(x)
    tries = [strip(f"regexp_replace({s}, '{p}', '')") for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN {t} <> '' AND {t} <> {s} THEN {t} END" for t in tries) + f", {s})"


def path_component(x: str) -> str:
    typo = f"translate(coalesce({x}, ''), '‘’“”–—−`', '''''\"\"---''')"
    s = rf"""regexp_replace({squeeze(rf"regexp_replace(regexp_replace({typo}, '\p{{C}}', '', 'g'), '[\\/:*?" + chr(34) + "<>|]', '_', 'g')")}, '^[. ]+|[. ]+$', '', 'g')"""
    s = s.replace('" + chr(34) + "', '"')
    return rf"CASE WHEN {s} = '' THEN 'Unknown' WHEN regexp_matches(upper(split_part({s}, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || {s} ELSE {s} END"


def folder(x: str) -> str:
    s = f"""regexp_replace({strip(rf"regexp_replace({x}, '[\\/:*?\"<>|]', '_', 'g')")}, '^\\.+|\\.+$', '', 'g')[1:120]"""
    return f"CASE WHEN coalesce({s}, '') = '' THEN '_unknown_' ELSE {s} END"


_FULL = "('crosby, stills & nash', 'crosby, stills, nash & young', 'earth, wind & fire', 'simon & garfunkel', 'hall & oates', 'adam & the ants', 'barney bentall & the legendary hearts', 'of monsters and men', 'andrews sisters (the)')"
_FOLDER = "('crosby, stills & nash', 'crosby, stills, nash & young', 'earth, wind & fire', 'simon & garfunkel', 'hall & oates', 'sly & the family stone', 'adam & the ants', 'barney bentall & the legendary hearts', 'of monsters and men', 'big brother & the holding company', 'dr. hook & the medicine show')"

#: Steps as CTE columns, so that later steps can name earlier ones.
_GUESTLESS = rf"""g1 AS (SELECT *, {strip("coalesce(raw, '')")} AS s0 FROM g0),
g2 AS (SELECT *, {strip(r"regexp_replace(s0, '(?i)\s+(?:feat\.|featuring|ft\.?|with|duet with|vs\.?|versus|special guest|and friends)(?:\s.*)?$', '')")} AS s1 FROM g1),
g3 AS (SELECT *, CASE WHEN instr(s1, ',') > 0 AND instr(s1, '&') = 0 AND lower(trim(s1[instr(s1, ',') + 1:])) NOT IN ('the', 'a', 'an') THEN trim(split_part(s1, ',', 1)) ELSE s1 END AS s2 FROM g2),
g4 AS (SELECT *, CASE WHEN lower(s0) IN {_FULL} THEN s0 WHEN lower(s1) IN {_FULL} THEN s1 WHEN lower(s2) IN {_FULL} THEN s2 ELSE regexp_replace(s2, '(?i)\band\b', '&', 'g') END AS clean FROM g3),
g5 AS (SELECT *, {squeeze(r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(clean, '°', ''), '&', ' and '), '(?i)^\s*the\s+', ''), '(?i),\s*the\s*$', ''), '(?i)\(\s*the\s*\)\s*$', '')), '[^a-z0-9\s]', ' ', 'g')")} AS key FROM g4)"""

_FOLDERED = rf"""f1 AS (SELECT *, trim(CASE WHEN coalesce(raw, '') = '' THEN 'Unknown Artist' ELSE raw END) AS p0 FROM f0),
f2 AS (SELECT *, CASE WHEN lower(p0) IN {_FOLDER} THEN p0 ELSE trim(regexp_replace(p0, '(?i)\s+(?:feat\.?|featuring|ft\.?|with|duet with|vs\.?|versus)\s+.*$', '')) END AS p1 FROM f1),
f3 AS (SELECT *, CASE WHEN lower(p1) IN {_FOLDER} THEN p1 ELSE trim(split_part(p1, ';', 1)) END AS p2 FROM f2),
f4 AS (SELECT *, CASE WHEN lower(p2) IN {_FOLDER} THEN p2 ELSE trim(split_part(p2, ' & ', 1)) END AS p3 FROM f3),
f5 AS (SELECT *, CASE WHEN lower(p3) IN {_FOLDER} OR instr(p3, ' - ') = 0 THEN p3 ELSE trim(split_part(p3, ' - ', 1)) END AS p4 FROM f4),
f6 AS (SELECT *, CASE WHEN lower(p4) NOT IN {_FOLDER} AND instr(p4, ',') > 0 AND lower(trim(p4[instr(p4, ',') + 1:])) NOT IN ('the', 'a', 'an') THEN trim(split_part(p4, ',', 1)) ELSE p4 END AS p5 FROM f5),
f7 AS (SELECT *, CASE WHEN p5 = '' THEN 'Unknown Artist' ELSE p5 END AS folder_artist FROM f6)"""

_S = strip("artist")
on_archive("article_suffix", f"SELECT id, {article_suffix(_S)} AS value FROM archive WHERE artist IS NOT NULL")
on_archive("title_case", f"SELECT id, {title_case('title')} AS value FROM archive WHERE title IS NOT NULL")
on_archive("sanitize_value", rf"""a AS (SELECT id, translate(regexp_replace(replace(translate(trim(title), '/\', '--'), ':', ' - '), '[?*"<>|]', '', 'g'), '‘’“”–—−', '''''""---') AS v FROM archive WHERE title IS NOT NULL)
SELECT id, nullif(regexp_replace({squeeze("v")}, '[. ]+$', ''), '') AS value FROM a""")
on_archive("path_component", f"SELECT id, {path_component('title')} AS value FROM archive WHERE title IS NOT NULL")
on_archive("strip_track_no", f"SELECT id, {without_track('title')} AS value FROM archive WHERE title IS NOT NULL")


def near_key(x: str, title: bool) -> str:
    words = "single version|album version|remastered|radio edit|remaster|acoustic|karaoke|stereo|remix|live|mono|demo"
    if title:
        x = rf"regexp_replace({x}, '(?i)[(\[]\s*(?:(?:19|20)\d{{2}}\s+)?(?:{words})[\s\d,./+-]*[)\]]', ' ', 'g')"
        x = rf"regexp_replace(regexp_replace({x}, '[(\[]\s*(?:19|20)\d{{2}}\s*[)\]]', ' ', 'g'), '[(\[]\s*\d{{1,2}}\s*[)\]]', ' ', 'g')"
        x = rf"regexp_replace({x}, '(?i)\b(?:{words})\b', ' ', 'g')"
    x = f"regexp_replace(regexp_replace(lower({x}), '([áàâäãåéèêëíìîïóòôöõúùûüñçýÿ])', '\\1 ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"regexp_replace({squeeze(f'strip_accents({x})')}, '^the ', '')"


on_archive("near_normalise", f"SELECT id, {near_key('title', True)} AS value FROM archive WHERE title IS NOT NULL")
on_archive("fuzzy_normalise", rf"""SELECT id, {squeeze(r"regexp_replace(regexp_replace(lower(strip_accents(artist)), '^\s*(the|a|an)\s+', ''), '[^\p{L}\p{N}_\s]', ' ', 'g')")} AS value FROM archive WHERE artist IS NOT NULL""")
on_archive("consolidate_key", f"g0 AS (SELECT id, artist AS raw FROM archive WHERE artist IS NOT NULL), {_GUESTLESS} SELECT id, key AS value FROM g5")
on_archive("primary_artist", f"f0 AS (SELECT id, artist AS raw FROM archive WHERE artist IS NOT NULL), {_FOLDERED} SELECT id, folder_artist AS value FROM f7")
on_archive("lookup_form", rf"""s AS (SELECT id, {_S} AS s FROM archive WHERE artist IS NOT NULL),
b AS (SELECT *, trim(regexp_replace(rtrim(trim(regexp_replace(s, '{_PAREN}', '')), ', '), '{_COMMA}', '')) AS outer_base, trim(regexp_replace(s, '{_COMMA}', '')) AS comma_base FROM s)
SELECT id, CASE WHEN regexp_matches(s, '{_PAREN}') THEN CASE WHEN outer_base = '' THEN s ELSE {cap(f"regexp_extract(s, '{_PAREN}', 1)")} || ' ' || outer_base END
  WHEN regexp_matches(s, '{_COMMA}') THEN CASE WHEN comma_base = '' THEN s ELSE {cap(f"regexp_extract(s, '{_COMMA}', 1)")} || ' ' || comma_base END ELSE s END AS value FROM b""")


def display_title(x: str) -> str:
    words = rf"string_split_regex({strip(rf"regexp_replace({x}, '(?i),\s*the\s*$', '')")}, '\s+')"
    one = f"CASE WHEN lower(w) IN ('and', 'of', 'the') THEN lower(w) WHEN {all_caps('w')} AND length(w) <= 5 THEN w ELSE {cap('w')} END"
    return rf"(array_to_string(list_transform({words}, lambda w: {one}), ' ') || CASE WHEN regexp_matches({x}, '(?i),\s*the\s*$') THEN ', The' ELSE '' END)"


on_archive("display_title", f"SELECT id, {display_title('artist')} AS value FROM archive WHERE artist IS NOT NULL")
_FIXED_ARTIST = f"a1 AS (SELECT id, artist, title, album, CASE WHEN {all_caps('artist')} THEN {title_case('artist')} ELSE artist END AS cased FROM archive WHERE status = 'CATALOGUED')"
on_archive("normalised_fields", f"""{_FIXED_ARTIST},
a2 AS (SELECT id, 'artist' AS field, artist AS old_value, {article_suffix(strip('cased'))} AS new_value FROM a1
  UNION ALL SELECT id, 'title', title, CASE WHEN {all_caps('title')} THEN {title_case('title')} ELSE title END FROM a1
  UNION ALL SELECT id, 'album', album, CASE WHEN {all_caps('album')} THEN {title_case('album')} ELSE album END FROM a1)
SELECT * FROM a2 WHERE old_value <> new_value""")
on_archive("track_filename", f"""k AS (SELECT id, CASE WHEN coalesce(artist, '') = '' THEN 'Unknown Artist' ELSE artist END AS a, CASE WHEN coalesce(title, '') = '' THEN 'Unknown Title' ELSE title END AS t, ext FROM archive),
t AS (SELECT id, a, {without_track('t')} AS t, ext FROM k)
SELECT id, ({path_component('a')}) || ' - ' || ({path_component('t')}) || lower(ext) AS value FROM t""")
on_archive("export_paths", f"""f0 AS (SELECT *, artist AS raw FROM archive), {_FOLDERED},
p AS (SELECT *, CASE WHEN coalesce(album, '') = '' THEN 'Unknown Album' ELSE album END AS al, CASE WHEN coalesce(title, '') = '' THEN {_STEM} ELSE title END AS ti FROM f7)
SELECT id, ({folder('folder_artist')}) || '/' || ({folder('al')}) || '/' || CASE WHEN coalesce(track, 0) <> 0 THEN lpad(CAST(track AS VARCHAR), 2, '0') || ' - ' ELSE '' END || ({folder('ti')}) || ext AS value FROM p""")


def lcs(a: str, b: str) -> str:
    return f"""list_reduce(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j: CASE WHEN {a}[i] = {b}[j] THEN 1 ELSE 0 END)),
  lambda prev, m: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]), lambda r, x: list_append(r, CASE WHEN m[x[1]] = 1 THEN prev[x[1]] + 1 ELSE greatest(prev[x[1] + 1], r[x[1]]) END), [0]),
  list_transform(range(0, length({b}) + 1), lambda j: 0))[-1]"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE CAST(200 * {lcs(a, b)} AS DOUBLE) / (length({a}) + length({b})) END"


_NEXT = "n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name)"
SQL["fuzzy_ratio"] = f"WITH {_NEXT} SELECT x, y, CAST(round({ratio('x', 'y')}, 4) AS DOUBLE) AS score FROM p"
SQL["fuzzy_token"] = f"WITH {_NEXT}, t AS (SELECT x, y, array_to_string(list_sort(string_split(x, ' ')), ' ') AS tx, array_to_string(list_sort(string_split(y, ' ')), ' ') AS ty FROM p) SELECT x, y, CAST(round({ratio('tx', 'ty')}, 4) AS DOUBLE) AS score FROM t"
on_archive("audio_arithmetic", """SELECT id, -18.0::DOUBLE - lufs AS gain, round(pow(10, lufs_tp / 20), 6) AS peak, CAST(round_even((-18.0::DOUBLE - lufs) * 256, 0) AS BIGINT) AS q78,
  CASE WHEN lufs * 3 <= -70 THEN 'silence' ELSE 'ok' END AS state, CAST(greatest(120, ceil(duration * greatest(1, sample_rate / 48000)) + 30) AS BIGINT) AS hash_timeout, bitrate // 1000 AS kbps,
  CASE WHEN size_bytes < 1024 THEN printf('%.1f B', size_bytes::DOUBLE) WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) ELSE printf('%.1f MB', size_bytes / 1048576) END AS size FROM archive""")
on_archive("path_status", "SELECT id, CASE WHEN instr(file_path, '/DUPES_MOVED_FOR_REVIEW/') > 0 THEN 'DUPE_REVIEW' WHEN instr(file_path, '/TRIBUTE_REMOVED_FOR_REVIEW/') > 0 THEN 'TRIBUTE_REVIEW' ELSE 'CATALOGUED' END AS path_status, replace(file_path, '/DUPES_MOVED_FOR_REVIEW/', '/') AS library_path FROM archive")
on_archive("probe_flatten", "SELECT id, trim(coalesce(nullif(title, ''), 'stream title')) AS title, trim(nullif(artist, '')) AS artist, year, track, duration, bitrate, sample_rate, channels, codec FROM archive")

# -- duplicates ---------------------------------------------------------------

SQL["exact_dupe_groups"] = "SELECT 'dup_' || sha256(text)[1:12] AS group_id, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1"
SQL["first_seen_pairs"] = "WITH f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS first_key FROM documents) SELECT doc_id AS copy_key, first_key FROM f WHERE doc_id <> first_key"
_ORDER = "(lower(coalesce(codec, '')) IN ('flac', 'alac', 'pcm_s16le', 'pcm_s24le', 'pcm_s32le')) DESC, coalesce(bitrate, 0) DESC, coalesce(size_bytes, 0) DESC, file_path"
on_archive("keeper_ranking", f"r AS (SELECT file_path, audio_hash, status, row_number() OVER (PARTITION BY audio_hash ORDER BY {_ORDER}) AS place, count(*) OVER (PARTITION BY audio_hash) AS members FROM archive WHERE audio_hash IS NOT NULL) SELECT file_path, audio_hash, place, members, CASE WHEN members = 1 AND status = 'HASHED' THEN 'loser' WHEN place = 1 THEN 'keeper' ELSE 'loser' END AS verdict FROM r")
on_archive("orphan_group_winner", "r AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY (finalized_at IS NULL), coalesce(size_bytes, 0) DESC, file_path) AS n FROM archive WHERE audio_hash IS NOT NULL) SELECT audio_hash, file_path FROM r WHERE n = 1")
on_archive("sole_copies", "SELECT audio_hash, min(file_path) AS file_path FROM archive WHERE audio_hash IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
on_archive("claim_resolution", f"""c AS (SELECT * FROM archive WHERE status = 'CATALOGUED'),
g AS (SELECT file_path, 'dup_' || audio_hash[1:12] AS group_id, 0 AS source_rank, codec, bitrate, size_bytes FROM c WHERE audio_hash IS NOT NULL
  UNION ALL SELECT file_path, 't_' || lower(title), 1, codec, bitrate, size_bytes FROM c WHERE title <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source_rank, group_id ORDER BY {_ORDER}) AS place FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY source_rank, group_id) AS claim FROM r WHERE place > 1)
SELECT file_path, group_id, source_rank FROM l WHERE claim = 1""")
on_archive("collision_suffix", r"""t AS (SELECT id, '/out/track ' || id % 40 || CASE WHEN id % 7 = 0 THEN ' (2)' WHEN id % 11 = 0 THEN ' (4)' ELSE '' END || CASE WHEN id % 40 < 35 THEN ext ELSE '' END AS target FROM archive),
k AS (SELECT DISTINCT regexp_replace(target, 'track ([0-9])( |[.]|$)', 'track \1 (3)\2') AS path FROM t WHERE id % 13 = 0),
spelt AS (SELECT target AS path FROM t UNION SELECT path FROM k),
r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY id) - CASE WHEN target IN (SELECT path FROM k) THEN 0 ELSE 1 END AS rank FROM t),
m AS (SELECT target, max(rank) AS most FROM r GROUP BY target),
c AS (SELECT target, n, regexp_replace(target, '[.][^./]*$', '') || ' (' || n || ')' || regexp_extract(target, '([.][^./]*)$', 1) AS path FROM (SELECT target, unnest(range(2, most + 10)) AS n FROM m)),
f AS (SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY n) AS rank FROM c WHERE path NOT IN (SELECT path FROM spelt))
SELECT id, CASE WHEN r.rank = 0 THEN target ELSE f.path END AS final_path FROM r LEFT JOIN f USING (target, rank)""")
on_archive("cross_batch_flag", """h AS (SELECT * FROM archive WHERE audio_hash IS NOT NULL), l AS (SELECT audio_hash, '/old' || file_path AS twin FROM h WHERE id % 3 = 0 AND id % 2 = 0)
SELECT file_path, min(twin) AS twin, 'crossdupe_' || audio_hash[1:12] AS group_id FROM h JOIN l USING (audio_hash) WHERE file_path <> twin GROUP BY file_path, audio_hash""")
SQL["dedupe_report"] = "SELECT 'g' || o_custkey AS group_id, max(o_orderpriority) AS duplicate_type, count(*) FILTER (o_orderstatus = 'F') AS keep_count, count(*) FILTER (o_orderstatus = 'O') AS archive_count, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending_count FROM orders GROUP BY o_custkey"
on_archive("near_dupe_pairs", f"""r AS (SELECT file_path, {near_key('artist', False)} AS ak, {near_key('title', True)} AS tk, regexp_matches(title, '(?i)\\b(live|in concert|at the)\\b') AS live FROM archive WHERE status = 'CATALOGUED' AND trim(artist) <> '' AND trim(title) <> ''),
k AS (SELECT DISTINCT ak, tk FROM r),
p AS (SELECT a.ak, a.tk AS x, b.tk AS y FROM k a JOIN k b ON a.ak = b.ak AND 200 * least(length(a.tk), length(b.tk)) >= 88 * (length(a.tk) + length(b.tk)) AND a.tk <= b.tk),
s AS (SELECT *, round({ratio('x', 'y')}, 4) AS score FROM p),
f AS (SELECT m.file_path AS p, n.file_path AS q, score FROM s JOIN r m ON m.ak = s.ak AND m.tk = x JOIN r n ON n.ak = s.ak AND n.tk = y WHERE score >= 88 AND m.file_path <> n.file_path AND (x <> y OR m.file_path < n.file_path) AND NOT (m.live AND n.live))
SELECT 'near_' || sha256(least(p, q) || chr(10) || greatest(p, q))[1:8] AS group_id, least(p, q) AS file_a, greatest(p, q) AS file_b, CAST(round(score / 100, 4) AS DOUBLE) AS confidence FROM f""")
on_archive("acoustic_pairs", """r AS (SELECT file_path, 'rec' || id % 97 AS recording FROM archive WHERE id % 5 <> 0 AND id % 10 >= 8), f AS (SELECT recording, min(file_path) AS first_path FROM r GROUP BY 1)
SELECT 'acoustic_' || sha256(recording)[1:12] AS group_id, first_path, file_path FROM r JOIN f USING (recording) WHERE file_path <> first_path""")

# -- names --------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + quoted(r) + ")" for r in rows)


def _names() -> None:
    from catalith.functions import vocabulary as V
    from catalith.plans import catalogue as c

    best = "SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS n FROM (SELECT q, c, {0} AS score FROM rest, cand) WHERE score >= {1}"
    on_archive("canon_artist", f"""canon AS (SELECT * FROM (VALUES {_values(c.CANON)}) v(k, canonical) WHERE canonical <> ''),
n AS (SELECT DISTINCT artist AS raw, {squeeze('lower(artist)')} AS q FROM archive WHERE coalesce(artist, '') <> ''),
e AS (SELECT n.*, canonical FROM n LEFT JOIN canon ON q = k), rest AS (SELECT DISTINCT q FROM e WHERE canonical IS NULL AND q <> ''), cand AS (SELECT k AS c FROM canon),
b AS ({best.format(ratio('q', 'c'), 88)})
SELECT raw, coalesce(e.canonical, w.canonical, raw) AS canonical, CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN w.canonical IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS source
FROM e LEFT JOIN (SELECT q, canonical FROM b JOIN canon ON c = k WHERE n = 1) w ON e.q = w.q""")
    on_archive("canon_genre", f"""allowed AS (SELECT * FROM (VALUES {_values([(g,) for g in c.GENRES])}) v(g)), mapped AS (SELECT * FROM (VALUES {_values(c.GENRE_MAP)}) v(k, m)),
n AS (SELECT DISTINCT genre AS raw, lower(trim(genre)) AS q FROM archive WHERE coalesce(genre, '') <> ''),
e AS (SELECT n.*, g, m FROM n LEFT JOIN allowed ON q = lower(g) LEFT JOIN mapped ON q = k), rest AS (SELECT DISTINCT q FROM e WHERE g IS NULL AND m IS NULL), cand AS (SELECT lower(g) AS c FROM allowed),
b AS ({best.format(ratio('q', 'c'), 82)}), w AS (SELECT q, g AS near FROM b JOIN allowed ON c = lower(g) WHERE n = 1)
SELECT raw, coalesce(g, m, near) AS canonical, CASE WHEN g IS NOT NULL THEN 'allowed' WHEN m IS NOT NULL THEN 'mapped' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS source FROM e LEFT JOIN w USING (q)""")
    shown = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DISPLAY_NAMES.items())
    the = r"(regexp_matches(clean, '(?i)^\s*the\s+') OR regexp_matches(clean, '(?i),\s*the\s*$') OR regexp_matches(clean, '(?i)\(\s*the\s*\)\s*$'))"
    on_archive("consolidate_artists", f"""g0 AS (SELECT artist AS raw, count(*) AS n FROM archive WHERE status = 'CATALOGUED' AND trim(artist) <> '' GROUP BY 1), {_GUESTLESS},
c AS (SELECT *, {the} AS art FROM g5 WHERE clean <> ''),
r AS (SELECT *, count(*) OVER (PARTITION BY key) AS spellings, bool_or(art) OVER (PARTITION BY key) AS has_art, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(clean) DESC, lower(clean), clean) AS rk,
  CASE WHEN art THEN NULL ELSE row_number() OVER (PARTITION BY key, art ORDER BY n DESC, length(clean) DESC, lower(clean), clean) END AS bare_rk FROM c),
b AS (SELECT key, bool_or(has_art) AS has_art, max(CASE WHEN rk = 1 THEN clean END) AS best, max(CASE WHEN bare_rk = 1 THEN clean END) AS bare FROM r WHERE spellings > 1 GROUP BY key),
w AS (SELECT key, CASE key {shown} ELSE CASE WHEN has_art AND bare IS NOT NULL THEN {display_title('bare')} || ', The' ELSE {display_title('best')} END END AS new FROM b)
SELECT raw AS old, new, n FROM r JOIN w USING (key) WHERE raw <> new""")


_names()
on_archive("genre_majority_fill", """v AS (SELECT lower(trim(artist)) AS key, genre AS g, count(*) AS n FROM archive WHERE trim(artist) <> '' AND trim(genre) <> '' GROUP BY ALL),
b AS (SELECT key, g, row_number() OVER (PARTITION BY key ORDER BY n DESC, g) AS place FROM v)
SELECT file_path, g AS new_value FROM archive JOIN b ON key = lower(trim(artist)) AND place = 1 WHERE (genre IS NULL OR trim(genre) = '') AND trim(artist) <> ''""")
on_archive("album_variants", """a AS (SELECT regexp_extract(file_path, '(Brand#[0-9]+)', 1) AS artist, album, min(file_path) AS sample FROM archive WHERE trim(album) <> '' GROUP BY ALL),
r AS (SELECT *, count(*) OVER w AS spellings, first_value(album) OVER (w ORDER BY length(album) DESC, album DESC) AS canonical FROM a WINDOW w AS (PARTITION BY artist, lower(trim(album))))
SELECT artist, album, canonical, sample FROM r WHERE spellings > 1 AND album <> canonical""")

# -- table changes ------------------------------------------------------------

on_archive("partial_upsert", """s AS (SELECT CASE WHEN id % 2 = 0 THEN file_path ELSE '/new' || file_path END AS file_path FROM archive WHERE id % 4 < 2)
SELECT file_path, CASE WHEN s.file_path IS NOT NULL THEN 'HASHED' ELSE status END AS status, CASE WHEN s.file_path IS NOT NULL THEN NULL ELSE artist END AS artist, year FROM archive LEFT JOIN s USING (file_path)
UNION ALL SELECT file_path, 'HASHED', NULL, NULL FROM s ANTI JOIN archive USING (file_path)""")
on_archive("insert_ignore", "SELECT DISTINCT audio_hash, file_path FROM archive WHERE audio_hash IS NOT NULL")
on_archive("update_by_map", "SELECT id, CASE WHEN status = 'CATALOGUED' THEN CASE artist WHEN 'Beatles' THEN 'Beatles, The' WHEN 'abba' THEN 'ABBA' ELSE artist END ELSE artist END AS artist, status FROM archive")
on_archive("soft_reset", "SELECT id, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS audio_hash, CAST(NULL AS VARCHAR) AS finalized_at FROM archive WHERE status = 'CATALOGUED'")
on_archive("delete_stale", "SELECT file_path, status FROM archive WHERE status IS NULL OR status NOT IN ('GHOST', 'QUARANTINED')")
on_archive("review_apply", "SELECT file_path, CASE WHEN id % 12 = 0 THEN 'new ' || id ELSE artist END AS artist, title, album, CASE WHEN id % 4 = 0 AND id % 3 = 1 THEN 'new ' || id ELSE genre END AS genre, year, status FROM archive")
on_archive("review_counts", "SELECT count(*) FILTER (id % 4 = 0) AS approved, count(*) FILTER (id % 4 = 1) AS rejected, count(*) FILTER (id % 4 = 2) AS pending FROM archive")

# -- lineage ------------------------------------------------------------------

SQL["runs_recent"] = "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 20"
SQL["event_latest_per_key"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"
SQL["event_chain_resolve"] = """WITH RECURSIVE e AS (SELECT 'n' || event_id % 1000 AS old, arg_max('n' || (event_id * 7 + 3) % 1500, event_id) AS new FROM events GROUP BY 1),
w AS (SELECT old AS start, old AS final, 0 AS hops, [old] AS seen FROM e
  UNION ALL SELECT start, e.new, hops + 1, list_append(seen, e.new) FROM w JOIN e ON w.final = e.old WHERE hops < 10 AND NOT list_contains(seen, e.new))
SELECT start, arg_max(final, hops) AS final, max(hops) AS hops FROM w GROUP BY start"""
SQL["kept_paths"] = "SELECT event_id, '/a/' || user_id AS kept FROM events WHERE event_id % 3 = 0"
_DISK = "d AS (SELECT CASE WHEN id % 10 = 0 THEN '/stray' || file_path ELSE file_path END AS path FROM archive WHERE id % 7 <> 0)"
on_archive("audit_reconcile", f"""{_DISK}, c AS (SELECT file_path AS path, audio_hash FROM archive WHERE finalized_at <> ''), l AS (SELECT DISTINCT audio_hash FROM archive WHERE id % 3 <> 0 AND audio_hash IS NOT NULL)
SELECT path, CASE WHEN NOT EXISTS (FROM d WHERE d.path = c.path) THEN 'missing_on_disk' WHEN NOT EXISTS (FROM l WHERE l.audio_hash = c.audio_hash) THEN 'not_in_ledger' ELSE 'ok' END AS verdict FROM c
UNION ALL SELECT path, 'untracked' FROM d ANTI JOIN c USING (path)""")
on_archive("bitrot_diff", """a AS (SELECT * FROM archive WHERE audio_hash IS NOT NULL AND (id % 5 <> 0 OR id % 7 <> 0))
SELECT file_path AS path, CASE WHEN id % 5 = 0 THEN 'new' WHEN id % 7 = 0 THEN 'missing' WHEN id % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS verdict FROM a""")
on_archive("ledger_repair", """l AS (SELECT audio_hash, CASE WHEN id % 2 = 0 THEN file_path ELSE '/old' || file_path END AS file_path FROM archive WHERE audio_hash IS NOT NULL),
v AS (SELECT audio_hash, file_path, status FROM archive WHERE audio_hash IS NOT NULL AND id % 3 <> 0 AND coalesce(status, '') <> 'GHOST'),
b AS (SELECT audio_hash, file_path AS live, row_number() OVER (PARTITION BY audio_hash ORDER BY (coalesce(status, '') <> 'CATALOGUED'), file_path) AS n FROM v),
r AS (SELECT l.*, EXISTS (FROM v WHERE v.audio_hash = l.audio_hash AND v.file_path = l.file_path) AS there, live FROM l LEFT JOIN b ON b.audio_hash = l.audio_hash AND n = 1)
SELECT audio_hash, file_path, CASE WHEN there THEN 'keep' WHEN live IS NOT NULL THEN 'repoint' ELSE 'prune' END AS action, CASE WHEN NOT there THEN live END AS new_path FROM r""")
on_archive("ghost_sweep", f"{_DISK} SELECT file_path FROM archive WHERE coalesce(status, '') <> 'GHOST' AND file_path NOT IN (SELECT path FROM d)")
on_archive("dead_groups", f"{_DISK} SELECT audio_hash, count(*) AS members FROM archive WHERE audio_hash IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (file_path IN (SELECT path FROM d)) = 0")
on_archive("twin_join", "SELECT file_path, '/tier' || file_path[11:] AS tier_path FROM archive WHERE id % 2 = 0")
SQL["rolling_speed_flag"] = """WITH m AS (SELECT event_id, value, avg(value) OVER w AS mean, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(mean, 6) AS mean, n >= 5 AND value < 0.4::DOUBLE * mean AS slow FROM m"""
SQL["tumbling_counts"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["sliding_counts"] = """WITH b AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start, event_type, value FROM events)
SELECT window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM b GROUP BY ALL"""
SQL["session_counts"] = """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT min(ts) AS window_start, user_id, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""


on_archive("duplicate_members", """d AS (SELECT 'dup_' || audio_hash[1:12] AS group_id, CASE WHEN id % 2 = 0 THEN file_path ELSE '/gone' END AS file_path FROM archive WHERE audio_hash IS NOT NULL AND id % 3 = 0)
SELECT group_id, file_path, codec, bitrate, status AS file_status FROM d LEFT JOIN archive USING (file_path)""")
on_archive("ledger_members", "SELECT DISTINCT audio_hash, file_path, status FROM archive WHERE audio_hash IN (SELECT audio_hash FROM archive WHERE id % 5 = 0)")
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_SHORT, _LONG = "(CASE WHEN length(x) <= length(y) THEN x ELSE y END)", "(CASE WHEN length(x) <= length(y) THEN y ELSE x END)"
SQL["leader_clusters"] = f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS block FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY name) AS i FROM n),
p AS (SELECT a.block, a.i, b.i AS j, a.name AS x, b.name AS y FROM o a JOIN o b ON a.block = b.block AND b.i < a.i),
p2 AS (FROM p UNION ALL SELECT block, i, j, y, x FROM p WHERE length(x) = length(y)),
t AS (SELECT *, {_SORTED.format('x')} AS tx, {_SORTED.format('y')} AS ty, unnest(list_concat(list_transform(range(1, abs(length(x) - length(y)) + 2), lambda s: {_LONG}[s:s + length({_SHORT}) - 1]), list_transform(range(1, length({_SHORT}) + 1), lambda s: {_LONG}[1:s]), list_transform(range(1, length({_SHORT}) + 1), lambda s: {_LONG}[length({_LONG}) - s + 1:]))) AS w, {_SHORT} AS short FROM p2),
m AS (SELECT block, i, j FROM t GROUP BY ALL HAVING max(greatest({ratio('x', 'y')}, {ratio('tx', 'ty')}, {ratio('short', 'w')})) >= 70),
g AS (SELECT block, 1::BIGINT AS i, [1::BIGINT] AS leaders, 1::BIGINT AS leader FROM o WHERE i = 1
  UNION ALL SELECT block, i, CASE WHEN hit IS NULL THEN list_append(leaders, i) ELSE leaders END, coalesce(hit, i) FROM (
    SELECT g.block, g.i + 1 AS i, g.leaders, (SELECT min(m.j) FROM m WHERE m.block = g.block AND m.i = g.i + 1 AND list_contains(g.leaders, m.j)) AS hit FROM g WHERE EXISTS (FROM o WHERE o.block = g.block AND o.i = g.i + 1)))
SELECT g.block, o.name, l.name AS leader FROM g JOIN o ON o.block = g.block AND o.i = g.i JOIN o l ON l.block = g.block AND l.i = g.leader"""
on_archive("first_match", """c AS (SELECT lower(trim(artist)) AS a, lower(trim(title)) AS t, min(file_path) AS match FROM archive WHERE id % 2 = 1 GROUP BY ALL)
SELECT id, match FROM archive JOIN c ON lower(trim(artist)) = a AND lower(trim(title)) = t WHERE id % 2 = 0""")
on_archive("unknown_files", f"{_DISK} SELECT path FROM d WHERE path NOT IN (SELECT file_path FROM archive)")
on_archive("archive_by_status", "SELECT id, artist, album, title FROM archive WHERE status = 'CATALOGUED' ORDER BY artist NULLS FIRST, album NULLS FIRST, title NULLS FIRST, id")
on_archive("path_prefix", "SELECT file_path FROM archive WHERE starts_with(lower(file_path), '/vault/lib/brand#1')")
on_archive("analysable_files", """a AS (SELECT file_path, CAST(floor(duration * 30) AS BIGINT) AS s FROM archive WHERE duration >= 10 AND channels <= 2)
SELECT file_path, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS length FROM a""")
on_archive("report_lines", f"{_ISSUES} SELECT severity || '  ' || issue || '  ' || count(*) AS value FROM i GROUP BY issue, severity")
on_archive("lossy_rows", "SELECT artist, title, album, upper(codec) AS codec, bitrate // 1000 AS kbps, round(duration, 1) AS duration, file_path FROM archive WHERE lower(codec) NOT IN ('flac', 'alac', 'pcm_s16le', 'pcm_s24le', 'pcm_s32le') AND id % 4 <> 0")
on_archive("restore_commands", r"""SELECT 'mv -n -- ''' || replace(file_path, '''', '''\''''') || ''' ''' || replace(title, '''', '''\''''') || '''' AS value FROM archive WHERE title <> ''""")
SQL["looked_up"] = "WITH a AS (SELECT 'Brand#' || s_suppkey % 30 AS brand, min(s_name) AS answer FROM supplier WHERE s_suppkey % 10 >= 5 GROUP BY 1) SELECT p_partkey AS id, p_brand AS brand, answer FROM part LEFT JOIN a ON brand = p_brand"


# -- work on the files --------------------------------------------------------

_FOLDER = "regexp_replace({0}, '/[^/]*$', '')"
on_archive("loudness_pending", "SELECT id, file_path FROM archive WHERE status = 'CATALOGUED' AND coalesce(finalized_at, '') = ''")
on_archive("loudness_embeds", "SELECT id, file_path FROM archive WHERE status = 'CATALOGUED' AND finalized_at <> '' AND lufs IS NOT NULL AND id % 3 <> 0")
on_archive("wrong_modes", """l AS (SELECT file_path AS path, CASE WHEN id % 4 = 0 THEN 'dir' WHEN id % 9 = 0 THEN 'link' ELSE 'file' END AS kind, CASE WHEN id % 3 = 0 THEN 509 WHEN id % 5 = 0 THEN NULL ELSE 436 END AS mode FROM archive)
SELECT *, 509 AS wanted FROM l WHERE kind = 'dir' AND mode <> 509 UNION ALL SELECT *, 436 FROM l WHERE kind = 'file' AND mode <> 436""")
on_archive("analysis_state", """s AS (SELECT file_path, id % 260 AS t, CASE WHEN finalized_at <> '' THEN 'done' WHEN channels > 2 THEN 'skipped_multichannel' ELSE 'pending' END AS state FROM archive WHERE status = 'CATALOGUED')
SELECT file_path, state, CASE WHEN t = 0 OR state = 'skipped_multichannel' THEN NULL WHEN t > 200 THEN t / 2 WHEN t < 60 THEN t * 2.0::DOUBLE ELSE t::DOUBLE END AS bpm FROM s""")
on_archive("sidecar_covers", f"""l AS (SELECT {_FOLDER.format('file_path')} AS folder, ['front.png', 'notes.txt', 'cover.png', 'AlbumArtSmall.jpg', 'folder.jpg'][id % 5 + 1] AS name FROM archive WHERE id % 7 = 0),
b AS (SELECT folder, CASE min(CASE name WHEN 'cover.png' THEN 1 WHEN 'folder.jpg' THEN 2 WHEN 'front.png' THEN 3 ELSE 4 END) WHEN 1 THEN 'cover.png' WHEN 2 THEN 'folder.jpg' WHEN 3 THEN 'front.png' ELSE 'AlbumArtSmall.jpg' END AS name FROM l WHERE name <> 'notes.txt' GROUP BY folder)
SELECT file_path, folder || '/' || name AS cover FROM archive JOIN b ON {_FOLDER.format('file_path')} = folder""")


def _folder_name(x: str) -> str:
    cut = strip("regexp_replace(" + x + r""", '[\\/:*?"<>|]', '_', 'g')""")
    return rf"coalesce(nullif(regexp_replace({cut}, '^\.+|\.+$', '', 'g')[1:60], ''), '_unknown_')"


on_archive("transcode_plan", f"""SELECT file_path, '/transcode/' || {_folder_name("coalesce(nullif(artist, ''), 'Unknown Artist')")} || '/' || {_folder_name("coalesce(nullif(album, ''), 'Unknown Album')")} || '/'
  || CASE WHEN track IS NULL THEN '' WHEN track < 10 THEN '0' || track || ' - ' ELSE track || ' - ' END || {_folder_name("coalesce(nullif(title, ''), regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', ''))")} || '.m4a' AS target
FROM archive WHERE status = 'CATALOGUED' AND codec IN ('flac', 'alac') AND id % 5 <> 3""")
on_archive("release_lookups", """f AS (SELECT file_path, lower(trim(artist)) AS a, lower(trim(album)) AS b FROM archive WHERE status = 'CATALOGUED' AND trim(artist) <> '' AND id % 6 <> 0),
x AS (SELECT lower(trim(upper(artist))) AS a, min('a' || length(artist)) AS mb_artist_id FROM archive WHERE id % 4 = 0 GROUP BY 1), y AS (SELECT lower(trim(artist)) AS a, lower(trim(album)) AS b, min('r' || length(album)) AS mb_release_id FROM archive WHERE id % 5 = 0 GROUP BY 1, 2)
SELECT file_path, mb_artist_id, mb_release_id FROM f LEFT JOIN x USING (a) LEFT JOIN y USING (a, b) WHERE mb_artist_id IS NOT NULL OR mb_release_id IS NOT NULL""")
on_archive("preflight_checks", """SELECT 'room' AS name, 'WARN' AS result, '70' AS detail UNION ALL SELECT 'missing_keys', 'OK', '0' UNION ALL
SELECT 'repeated_keys', CASE WHEN n > 0 THEN 'FAIL' ELSE 'OK' END, n::VARCHAR FROM (SELECT count(file_path) - count(DISTINCT file_path) AS n FROM archive) UNION ALL
SELECT 'states', CASE WHEN n > 0 THEN 'WARN' ELSE 'OK' END, n::VARCHAR FROM (SELECT count(*) FILTER (status IS NULL) AS n FROM archive)""")
on_archive("integrity_flags", "SELECT file_path, id % 6 = 1 OR id % 4 = 1 AS integrity_ok FROM archive WHERE status = 'CATALOGUED' AND id % 3 > 0")
on_archive("rebuilt_rows", """r AS (SELECT id, file_path, size_bytes, CASE WHEN id % 4 > 0 THEN coalesce(audio_hash, 'none') END AS audio_hash, CASE WHEN id % 3 > 0 THEN title END AS title, CASE WHEN id % 3 > 0 THEN artist END AS artist FROM archive ORDER BY file_path LIMIT 500)
SELECT file_path, size_bytes, audio_hash, title, artist, CASE WHEN audio_hash IS NULL THEN 'PENDING' WHEN title IS NULL AND artist IS NULL THEN 'HASHED' ELSE 'CATALOGUED' END AS status FROM r""")
on_archive("canon_review", "SELECT artist AS raw, count(*) AS files FROM archive WHERE trim(artist) <> '' AND length(artist) % 3 <> 0 GROUP BY artist")
on_archive("ledger_readd", """l AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY size_bytes DESC, file_path) AS place FROM archive WHERE audio_hash IS NOT NULL AND finalized_at <> '' AND audio_hash NOT IN (SELECT audio_hash FROM archive WHERE id % 2 = 0 AND audio_hash IS NOT NULL))
SELECT audio_hash, file_path FROM l WHERE place = 1""")
on_archive("tag_diff", """a AS (SELECT * REPLACE (CASE WHEN id % 8 = 0 THEN 'Chieftains, The' ELSE artist END AS artist), artist AS tag_artist FROM archive),
c AS (SELECT file_path, 'artist' AS field, tag_artist AS o, artist AS n FROM a UNION ALL SELECT file_path, 'album', CASE WHEN id % 3 <> 0 THEN album END, album FROM a UNION ALL
  SELECT file_path, 'title', CASE WHEN id % 4 <> 0 THEN title END, title FROM a UNION ALL SELECT file_path, 'genre', CASE WHEN id % 5 <> 0 THEN genre END, genre FROM a UNION ALL
  SELECT file_path, 'year', CASE WHEN id % 6 <> 0 THEN year END, year FROM a UNION ALL SELECT file_path, 'track', CASE WHEN id % 7 <> 0 THEN track::VARCHAR END, track::VARCHAR FROM a UNION ALL
  SELECT file_path, 'albumartist', 'The Chieftains', 'Chieftains, The' FROM a WHERE id % 2 = 0 AND trim(artist) = 'Chieftains, The')
SELECT file_path, field, trim(coalesce(o, '')) AS old_value, trim(n) AS new_value FROM c WHERE trim(coalesce(n, '')) <> '' AND trim(coalesce(o, '')) <> trim(n)""")


on_archive("organise_plan", """r AS (SELECT id, '/library/A' || id % 5 || '/B' || id % 3 || '/' AS folder, 'A' || id % 5 || ' - t' || id % 20 || '.m4a' AS name FROM archive),
f AS (SELECT folder || name AS target, folder, CASE WHEN id < 60 AND id % 4 = 0 THEN folder || name WHEN id % 4 = 1 THEN folder || 'w' || id ELSE '/in/' || id END AS file_path FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY file_path) + CASE WHEN target IN (SELECT file_path FROM f) THEN 1 ELSE 0 END AS place FROM f WHERE file_path <> target)
SELECT file_path, target, 'skip' AS verdict FROM f WHERE file_path = target UNION ALL
SELECT file_path, CASE WHEN place = 1 THEN target ELSE replace(target, '.m4a', ' (' || place || ').m4a') END, CASE WHEN starts_with(file_path, folder) THEN 'rename' ELSE 'move' END FROM m""")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
