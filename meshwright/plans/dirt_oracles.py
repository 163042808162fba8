"""SQL for the queries of problems 3 to 5, written apart from the operators: by phrases and set logic, not by their methods."""

from __future__ import annotations

_P4 = """
WITH al AS (SELECT lower(trim(alias_name)) AS a, min(trim(site_field)) AS f FROM field_aliases GROUP BY 1),
e AS (SELECT r.record_id, r.feed_id, r.file_seq, lower(trim(j.key)) AS k, CASE WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type = 'BOOLEAN' THEN 'boolean' WHEN j.type = 'NULL' THEN NULL ELSE 'number' END AS kind,
    CASE WHEN j.type = 'NULL' THEN NULL WHEN j.type IN ('VARCHAR', 'BOOLEAN') THEN j.value->>'$' ELSE CAST(CAST(j.value->>'$' AS DOUBLE) AS VARCHAR) END AS v
  FROM feed_records r, json_each(r.payload) j),
nm AS (SELECT record_id, min(trim(v)) AS site FROM e JOIN al ON a = k AND f = 'site_name' WHERE v IS NOT NULL GROUP BY 1),
fl AS (SELECT feed_id, file_seq, lag(file_seq) OVER (PARTITION BY feed_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed_id, file_seq FROM feed_records)),
sc AS (SELECT feed_id, file_seq, k, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM e GROUP BY 1, 2, 3),
pr AS (SELECT * FROM fl WHERE prev IS NOT NULL),
nw AS (SELECT p.feed_id, p.file_seq, p.prev, s.k FROM pr p JOIN sc s USING (feed_id, file_seq) ANTI JOIN sc o ON o.feed_id = p.feed_id AND o.file_seq = p.prev AND o.k = s.k),
gn AS (SELECT p.feed_id, p.file_seq, p.prev, s.k FROM pr p JOIN sc s ON s.feed_id = p.feed_id AND s.file_seq = p.prev ANTI JOIN sc o ON o.feed_id = p.feed_id AND o.file_seq = p.file_seq AND o.k = s.k),
cd AS (SELECT n.feed_id, n.file_seq, n.prev, g.k AS g, n.k AS n, x.f AS gf, y.f AS nf FROM nw n JOIN gn g USING (feed_id, file_seq) LEFT JOIN al x ON x.a = g.k LEFT JOIN al y ON y.a = n.k),
sv AS (SELECT DISTINCT feed_id, file_seq, k, site, kind, v FROM e JOIN nm USING (record_id) WHERE v IS NOT NULL),
eq AS (SELECT c.feed_id, c.file_seq, c.g, c.n FROM cd c JOIN sv a ON a.feed_id = c.feed_id AND a.file_seq = c.prev AND a.k = c.g JOIN sv b ON b.feed_id = c.feed_id AND b.file_seq = c.file_seq AND b.k = c.n AND b.site = a.site
  WHERE c.gf IS NULL OR c.nf IS NULL GROUP BY ALL HAVING bool_and(a.kind = b.kind AND a.v = b.v)),
rn AS (SELECT feed_id, file_seq, g, n FROM cd WHERE gf = nf UNION SELECT * FROM eq)
"""
P4_FOUND = _P4 + """SELECT DISTINCT feed_id, file_seq, 'renamed' AS change_kind, n AS field_name FROM rn
UNION ALL SELECT feed_id, file_seq, 'added', k FROM nw WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.feed_id = nw.feed_id AND rn.file_seq = nw.file_seq AND rn.n = nw.k)
UNION ALL SELECT feed_id, file_seq, 'removed', k FROM gn WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.feed_id = gn.feed_id AND rn.file_seq = gn.file_seq AND rn.g = gn.k)
UNION ALL SELECT p.feed_id, p.file_seq, 'retyped', s.k FROM pr p JOIN sc s USING (feed_id, file_seq) JOIN sc o ON o.feed_id = p.feed_id AND o.file_seq = p.prev AND o.k = s.k WHERE len(s.kinds) > 0 AND len(o.kinds) > 0 AND s.kinds <> o.kinds"""
P4_ALTERNATIVES = _P4 + "SELECT feed_id, k AS field_name, kind, min(file_seq) AS first_file, max(file_seq) AS last_file, count(DISTINCT file_seq) AS files FROM e WHERE kind IS NOT NULL GROUP BY 1, 2, 3"

_DMS = r"^([+-]?\d+(?:\.\d+)?)[\s°]*(?:(\d+(?:\.\d+)?)[\s''′]+)?(?:(\d+(?:\.\d+)?)[\s\"″]*)?([NSEWnsew]?)$".replace('\\"', '"')


def _degrees_of(t: str) -> str:
    part = lambda i: f"TRY_CAST(regexp_extract(trim({t}), '{_DMS}', {i}) AS DOUBLE)"
    sign = f"CASE WHEN (upper(regexp_extract(trim({t}), '{_DMS}', 4)) IN ('S', 'W')) <> starts_with(trim({t}), '-') THEN -1 ELSE 1 END"
    return f"coalesce(TRY_CAST({t} AS DOUBLE), {sign} * (abs({part(1)}) + coalesce({part(2)}, 0) / 60 + coalesce({part(3)}, 0) / 3600))"


_PROPERTIES = {"site_name": "text", "site_type": "text", "longitude": "deg", "latitude": "deg", "altitude": "number", "height": "number", "device_sku": "text", "subscribers": "whole"}
_AS = {"text": "{}", "deg": "{}", "number": "TRY_CAST({} AS DOUBLE)", "whole": "CAST(trunc(TRY_CAST({} AS DOUBLE)) AS BIGINT)"}


def _property(p: str, kind: str) -> str:
    t = f"min(v) FILTER (property = '{p}')"
    return (_degrees_of(t) if kind == "deg" else _AS[kind].format(t)) + f" AS {p}"


_BRANCH = {"string": "{}", "number": "TRY_CAST({} AS DOUBLE)", "boolean": "CAST({} AS BOOLEAN)"}
P4_PROPERTIES = _P4.replace("WITH al AS", "WITH RECURSIVE al AS", 1) + f""", en AS (SELECT feed_id, g AS a, n AS b FROM rn UNION SELECT feed_id, n, g FROM rn),
ms AS (SELECT DISTINCT en.feed_id, en.a, al.f AS property, 0 AS steps FROM en JOIN al ON al.a = en.a UNION SELECT en.feed_id, en.a, property, steps + 1 FROM ms JOIN en ON en.feed_id = ms.feed_id AND en.b = ms.a WHERE steps < 12),
mn AS (SELECT feed_id, a, arg_min(property, (steps, property)) AS learnt FROM ms GROUP BY 1, 2),
pv AS (SELECT e.record_id, e.kind, e.v, coalesce(al.f, mn.learnt) AS property FROM e LEFT JOIN al ON al.a = e.k LEFT JOIN mn ON mn.feed_id = e.feed_id AND mn.a = e.k WHERE e.kind IS NOT NULL),
pt AS (SELECT record_id, {", ".join(_property(p, k) for p, k in _PROPERTIES.items())},
  {", ".join(_BRANCH[b].format(f"min(v) FILTER (property = '{p}' AND kind = '{b}')") + f" AS {p}_{b}" for p, k in _PROPERTIES.items() for b in _BRANCH if b != ("string" if k == "text" else "number"))} FROM pv GROUP BY 1)
SELECT r.record_id, r.feed_id, r.file_seq, pt.* EXCLUDE (record_id) FROM feed_records r LEFT JOIN pt USING (record_id)"""

#: Phrases of notes, by the unit they name. Fixed values.
_HEIGHT = {
    "cm": ("Zentimeter", "heights are centimetres", "height column in cm", "height x 100", "hauteur: cm"), "mm": ("height [mm]", "millimetres for all heights", "height in mm"),
    "in": ("heights in inches", "mount height, inches"), "m": ("height in metres", "height [m]", "heights are metric", "Höhe in m"),
    "ft": ("heights in ft", "hgt col. [ft]", "height given in feet", "height = feet", "all heights: feet", "Höhe in Fuß", "hauteurs en pieds"),
}
_LON = {"deg": ("lon in degrees", "base_lon decimal degrees"), "rad": ("in radians", "as rad", "base_lon: radians"), "arcsec": ("total arcsec", "as arc seconds"), "gon": ("base_lon in gon", "in gradians")}
_FEET = {"m": ("feet col. actually metres", "metres were put under feet", "feet column holds metres")}


def _says(phrases: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(note, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{u}'" for u, ps in phrases.items()) + " END"


_LENGTHS = "CASE WHEN u = '' THEN NULL " + " ".join(f"WHEN u IN ({', '.join(repr(x) for x in xs)}) THEN '{k}'" for k, xs in {
    "m": ("m", "metres", "metre"), "km": ("km",), "dm": ("dm",), "cm": ("cm", "centimetres"), "mm": ("mm", "millimetres"), "in": ("in", "inches", '"', "″"), "ft": ("ft", "feet", "foot", "fuß"), "yd": ("yd", "yards", "yard"),
}.items()) + " WHEN regexp_matches(u, '^(''|′|ft) ?[0-9]') THEN 'ft_in' END"
_TO_M = "CASE {u} WHEN 'm' THEN 1 WHEN 'km' THEN 1000 WHEN 'dm' THEN 0.1e0 WHEN 'cm' THEN 0.01e0 WHEN 'mm' THEN 0.001e0 WHEN 'in' THEN 0.0254e0 WHEN 'yd' THEN 0.9144e0 ELSE 0.3048e0 END"
_P5 = f"""
WITH nt AS (SELECT survey_id, {_says(_HEIGHT)} AS hu, {_says(_FEET)} AS fu, {_says(_LON)} AS lu FROM (SELECT survey_id, string_agg(unit_note, '; ') AS note FROM survey_notes GROUP BY 1)),
p AS (SELECT meas_id, survey_id, nullif(trim(height), '') AS h, nullif(trim(feet), '') AS f, nullif(trim(base_lon), '') AS l FROM mount_surveys),
q AS (SELECT *, CAST(replace(regexp_extract(h, '[0-9]+([.,][0-9]+)?'), ',', '.') AS DOUBLE) AS hn, lower(trim(regexp_replace(h, '^(ca[.] |~)?[0-9]+([.,][0-9]+)?', ''))) AS ht,
    TRY_CAST(regexp_extract(f, '[0-9]+([.][0-9]+)?') AS DOUBLE) + coalesce(TRY_CAST(regexp_extract(f, '(?:ft |'')([0-9]+)(?: in|")', 1) AS DOUBLE) / 12, 0) AS fn, lower(trim(regexp_replace(f, '^[0-9]+([.][0-9]+)?', ''))) AS ft, TRY_CAST(l AS DOUBLE) AS ln FROM p),
r AS (SELECT q.*, hu, fu, lu, {_LENGTHS.replace(' u ', ' ht ').replace('(u,', '(ht,')} AS hv, {_LENGTHS.replace(' u ', ' ft ').replace('(u,', '(ft,')} AS fv FROM q LEFT JOIN nt USING (survey_id)),
s AS (SELECT *, fn * {_TO_M.format(u="coalesce(fv, fu, 'ft')")} AS fm FROM r),
u AS (SELECT meas_id, 'height' AS field_name, 'm' AS want, coalesce(hv, hu, CASE WHEN f IS NULL THEN 'm' ELSE list_min([{{'d': abs(ln(hn * k.x / fm)), 'u': k.u}} for k in [{{'x': 1e0, 'u': 'm'}}, {{'x': 0.3048e0, 'u': 'ft'}}, {{'x': 0.01e0, 'u': 'cm'}}, {{'x': 0.0254e0, 'u': 'in'}}, {{'x': 0.001e0, 'u': 'mm'}}]]).u END) AS unit FROM s WHERE h IS NOT NULL
  UNION ALL SELECT meas_id, 'feet', 'ft', coalesce(fv, fu, 'ft') FROM s WHERE f IS NOT NULL
  UNION ALL SELECT meas_id, 'base_lon', 'deg', CASE WHEN ln IS NOT NULL THEN coalesce(lu, CASE WHEN abs(ln) <= 180 THEN 'deg' ELSE 'finer' END) WHEN regexp_matches(l, '^[0-9.]+ ?°? ?[EW]$|deg$') AND NOT regexp_matches(l, '[µu]deg$') THEN 'deg' ELSE 'other' END FROM s WHERE l IS NOT NULL)
"""
P5_FOUND = _P5 + "SELECT meas_id, field_name FROM u WHERE unit <> want"
_DEG, _MIN, _SEC, _LETTER = r"^([0-9]+) ?(?:°|deg)? ?", r"([0-9.]+) ?(?:''|′|min)", r"([0-9.]+) ?(?:\"|″|sec)", r"W$"
P5_VALUES = _P5 + f""", d AS (SELECT meas_id, l, lu, regexp_matches(l, '{_DEG}{_MIN}') AS dms, TRY_CAST(regexp_extract(l, '^-?[0-9.]+') AS DOUBLE) AS n, CASE WHEN regexp_matches(l, 'W$') THEN -1 ELSE 1 END AS sign,
    TRY_CAST(regexp_extract(l, '{_DEG}{_MIN}', 1) AS DOUBLE) + TRY_CAST(regexp_extract(l, '{_DEG}{_MIN}', 2) AS DOUBLE) / 60 + coalesce(TRY_CAST(regexp_extract(l, '{_MIN} ?{_SEC}', 2) AS DOUBLE), 0) / 3600 AS whole FROM s WHERE l IS NOT NULL),
e AS (SELECT *, CASE WHEN regexp_matches(l, '([µμu]deg|microdegrees?)$') THEN 'microdeg' WHEN regexp_matches(l, 'gon$') THEN 'gon' WHEN regexp_matches(l, 'rad$') THEN 'rad' WHEN regexp_matches(l, '[°EWg]$') THEN 'deg' WHEN lu IS NOT NULL THEN lu WHEN abs(n) <= 180 THEN 'deg' ELSE 'e7deg' END AS unit FROM d),
v AS (SELECT meas_id, 'base_lon' AS field_name, CASE WHEN dms THEN sign * whole ELSE sign * n * CASE unit WHEN 'deg' THEN 1 WHEN 'microdeg' THEN 1e-6 WHEN 'e7deg' THEN 1e-7 WHEN 'gon' THEN 0.9e0 WHEN 'rad' THEN 180 / pi() WHEN 'arcsec' THEN 1 / 3600e0 END END AS v FROM e
  UNION ALL SELECT meas_id, 'feet', fm / 0.3048e0 FROM s WHERE f IS NOT NULL
  UNION ALL SELECT meas_id, 'height', (hn + coalesce(TRY_CAST(regexp_extract(h, '(?:ft|''|′) ?([0-9]+)', 1) AS DOUBLE), 0) / 12) * {_TO_M.format(u="unit")} FROM s JOIN u USING (meas_id) WHERE h IS NOT NULL AND u.field_name = 'height')
SELECT meas_id, field_name, round(v, 6) + 0 AS value FROM v WHERE v IS NOT NULL"""


_NUMBER = r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
_UNSIGNED = r"([0-9]+([.][0-9]*)?|[.][0-9]+)"


def _angle(v: str, letters: str, most: int) -> str:
    dms = rf"^({_UNSIGNED})[ \t]*°[ \t]*({_UNSIGNED})[ \t]*''[ \t]*({_UNSIGNED})[ \t]*\"[ \t]*[{letters}]$".replace('\\"', '"')
    part = lambda i: f"TRY_CAST(regexp_extract({v}, '{dms}', {i}) AS DOUBLE)"
    return f"""CASE WHEN regexp_full_match({v}, '{_NUMBER}') THEN abs(TRY_CAST({v} AS DOUBLE)) <= {most}
  WHEN regexp_matches({v}, '^{_UNSIGNED}[ \t]*°?[ \t]*[{letters}]$') THEN TRY_CAST(regexp_extract({v}, '^({_UNSIGNED})', 1) AS DOUBLE) <= {most}
  WHEN regexp_matches({v}, '{dms}') THEN {part(4)} < 60 AND {part(7)} < 60 AND {part(1)} + {part(4)} / 60 + {part(7)} / 3600 <= {most} ELSE false END"""


_FIELD = r'[ \t]*("([^"]|"")*"[ \t]*|[^", \t][^,]*|)'
_P3 = f"""
WITH hd AS (SELECT file_name, min(raw_line) AS header FROM raw_lines WHERE line_no = 1 GROUP BY 1),
ln AS (SELECT line_id, file_kind, rtrim(raw_line, chr(13)) AS t, regexp_split_to_array(lower(replace(replace(header, chr(65279), ''), chr(13), '')), ',') AS cols FROM raw_lines JOIN hd USING (file_name) WHERE line_no > 1),
gr AS (SELECT *, regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*') AS well, regexp_extract_all(t || ',', '(?s){_FIELD},') AS parts FROM ln),
fd AS (SELECT line_id, file_kind, well AND len(parts) = len(cols) AS shaped, unnest(range(1, len(cols) + 1)) AS i, cols, parts FROM gr),
va AS (SELECT line_id, file_kind, shaped, trim(cols[i]) AS c, trim(CASE WHEN shaped THEN parts[i][:-2] END, ' ' || chr(9)) AS raw FROM fd),
tx AS (SELECT *, CASE WHEN starts_with(raw, '"') THEN trim(replace(raw[2:-2], '""', '"'), ' ' || chr(9)) ELSE raw END AS v FROM va),
ok AS (SELECT line_id, shaped AND CASE
    WHEN file_kind = 'mcs' AND starts_with(c, 'mcs') THEN regexp_full_match(v, '{_NUMBER}') AND TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 15 AND TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))
    WHEN file_kind = 'mcs' AND starts_with(c, 'snr') THEN regexp_full_match(v, '{_NUMBER}')
    WHEN file_kind = 'mcs' THEN regexp_full_match(v, '{_NUMBER}') AND TRY_CAST(v AS DOUBLE) >= 0
    WHEN c = 'base_lat' THEN {_angle('v', 'NS', 90)}
    WHEN c = 'base_lon' THEN {_angle('v', 'EW', 180)}
    WHEN c IN ('power', 'light') THEN upper(v) IN ('TRUE', 'FALSE')
    WHEN c IN ('height', 'feet') THEN v = '' OR (regexp_full_match(v, '{_NUMBER}') AND TRY_CAST(v AS DOUBLE) >= 0)
    WHEN c = 'type' THEN upper(split_part(v, ' ', 1)) IN ('POP', 'DN', 'CN') ELSE true END AS ok FROM tx)"""
P3_FOUND = _P3 + "SELECT line_id FROM ok GROUP BY 1 HAVING NOT bool_and(coalesce(ok, false))"


def _degrees(letters: str) -> str:
    dms = rf"^({_UNSIGNED})[ \t]*°[ \t]*({_UNSIGNED})[ \t]*''[ \t]*({_UNSIGNED})[ \t]*\"".replace('\\"', '"')
    part = lambda i: f"TRY_CAST(regexp_extract(v, '{dms}', {i}) AS DOUBLE)"
    size = f"CASE WHEN regexp_matches(v, '{dms}') THEN {part(1)} + {part(4)} / 60 + {part(7)} / 3600 ELSE TRY_CAST(regexp_extract(v, '^({_UNSIGNED})', 1) AS DOUBLE) END"
    return f"CASE WHEN regexp_full_match(v, '{_NUMBER}') THEN TRY_CAST(v AS DOUBLE) WHEN ends_with(v, '{letters[1]}') THEN -({size}) ELSE {size} END"


_COLUMNS = {
    **{f"m.{c}": (c, f"TRY_CAST(v AS {t})", f"file_kind = 'mcs' AND starts_with(c, '{c}')") for c, t in (("mcs", "DOUBLE"), ("snr", "DOUBLE"), ("mbps", "DOUBLE"), ("tx_backoff", "DOUBLE"))},
    **{c: (c, x, f"file_kind <> 'mcs' AND c = '{c}'") for c, x in (
        ("base_lat", _degrees("NS")), ("base_lon", _degrees("EW")), ("power", "upper(v) = 'TRUE'"), ("light", "upper(v) = 'TRUE'"), ("height", "TRY_CAST(v AS DOUBLE)"), ("feet", "TRY_CAST(v AS DOUBLE)"),
        ("type", "upper(split_part(v, ' ', 1))"), ("remarks", "v"))},
}
P3_TYPED = _P3 + ", " + f"""ty AS (SELECT line_id, {", ".join(f"max(CASE WHEN {when} THEN {x} END) AS {c}" for c, x, when in _COLUMNS.values())} FROM tx GROUP BY 1),
gd AS (SELECT line_id FROM ok GROUP BY 1 HAVING bool_and(coalesce(ok, false)))
SELECT line_id, file_name, lower(trim(raw_lines.file_kind)) AS file_kind, line_no, CAST(mcs AS BIGINT) AS mcs, ty.* EXCLUDE (line_id, mcs) FROM gd JOIN ty USING (line_id) JOIN raw_lines USING (line_id)"""
ORACLES = {"p3_found": P3_FOUND, "p3_typed": P3_TYPED, "p4_found": P4_FOUND, "p4_alternatives": P4_ALTERNATIVES, "p4_properties": P4_PROPERTIES, "p5_found": P5_FOUND, "p5_values": P5_VALUES}
