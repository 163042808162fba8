"""Problem 5: quantities recorded in different units.

Units are the nodes of a graph, known conversions its edges, each an affine function y = a*x + b. Shortest compositions
of edges give the conversion between any two units of a dimension; every cycle must compose to the identity, else the
graph is refused. The finished conversions are a small fixed table that values are joined with on their source unit and
canonical target.

A value's unit comes, in this order, from its own text, from the survey's note on that column, or from the row: feet are
feet, a height is in the unit in which it agrees best with the row's feet (metres without feet). A longitude is in
decimal degrees if within 180, counted all around if within 360, in arc seconds if within 648,000; beyond, a whole number
is in 1e-7 degrees (as encoders write them) and one with a fraction in 1e-6 degrees if that brings it within 180.
Values of several parts (feet and inches; degrees, minutes and seconds) are converted part by part and summed up.

Defined results
---------------
* Null and blank values give no row. Values without a number keep unit and result null.
* A stated but unknown unit is '?', its result is null, and it counts as another unit than the canonical one.
* 1,234.5 and 1.234,5 and 1 234.5 are one number; a single comma or point is a decimal one.
* Repeated rows are each returned; several notes of one survey count as one text.
* Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conversions (from, to, a, b): y = a*x + b. Fixed values.
EDGES = (
    ("km", "m", 1000.0, 0.0), ("m", "dm", 10.0, 0.0), ("dm", "cm", 10.0, 0.0), ("m", "cm", 100.0, 0.0), ("cm", "mm", 10.0, 0.0),
    ("in", "mm", 25.4, 0.0), ("in", "cm", 2.54, 0.0), ("ft", "in", 12.0, 0.0), ("yd", "ft", 3.0, 0.0), ("yd", "m", 0.9144, 0.0),
    ("ft", "m", 0.3048, 0.0),
    ("turn", "deg", 360.0, 0.0), ("turn", "gon", 400.0, 0.0), ("rad", "deg", 57.29577951308232, 0.0), ("deg", "arcmin", 60.0, 0.0),
    ("arcmin", "arcsec", 60.0, 0.0), ("deg", "microdeg", 1e6, 0.0), ("microdeg", "e7deg", 10.0, 0.0), ("deg360", "deg", 1.0, -360.0), ("deg360", "turn", 1 / 360, -1.0),
    ("degneg360", "deg", 1.0, 360.0),
)

#: Spellings of units in values, in lower case. Fixed values.
SPELLINGS = {
    "m": ("m", "metre", "metres", "meter", "meters", "mètre", "mètres", "metro", "metros"),
    "km": ("km", "kilometre", "kilometres", "kilometer", "kilometers"),
    "dm": ("dm", "decimetre", "decimetres", "decimeter", "decimeters", "dezimeter"),
    "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter"),
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"),
    "in": ("in", "inch", "inches", '"', "″", "''", "zoll", "pouces", "pulgadas"),
    "ft": ("ft", "foot", "feet", "'", "′", "fuß", "fuss", "pied", "pieds", "pies"),
    "yd": ("yd", "yds", "yard", "yards"),
    "deg": ("deg", "degs", "degree", "degrees", "°", "grad", "e", "w", "° e", "° w", "°e", "°w", "deg e", "deg w"),
    "rad": ("rad", "radian", "radians"),
    "gon": ("gon", "gons", "gradian", "gradians", "ᵍ"),
    "microdeg": ("µdeg", "μdeg", "udeg", "microdegree", "microdegrees", "microdeg"),
    "arcsec": ("arcsec", "arcsecs", "arcsecond", "arcseconds", "arc seconds", "as"),
    "arcmin": ("arcmin", "arcminute", "arcminutes", "arc minutes"),
}

#: Canonical unit of each field.
CANONICAL = {"height": "m", "feet": "ft", "base_lon": "deg"}

Affine = tuple[float, float]


def _compose(f: Affine, g: Affine) -> Affine:
    """g after f."""
    return g[0] * f[0], g[0] * f[1] + g[1]


def compositions(edges: Iterable[tuple[str, str, float, float]] = EDGES, tolerance: float = 1e-9) -> dict[tuple[str, str], Affine]:
    """Shortest composition for each pair of connected units; raises ValueError where a cycle isn't the identity."""
    out: dict[str, dict[str, Affine]] = defaultdict(dict)
    for a, b, k, d in edges:
        if k == 0:
            raise ValueError(f"{a} -> {b} can't be inverted")
        for x, y, f in ((a, b, (k, d)), (b, a, (1 / k, -d / k))):
            out[x].setdefault(y, f)
    found: dict[tuple[str, str], Affine] = {}
    for start in out:
        found[start, start] = (1.0, 0.0)
        queue = deque([start])
        while queue:
            at = queue.popleft()
            for to, f in out[at].items():
                if (start, to) not in found:
                    found[start, to] = _compose(found[start, at], f)
                    queue.append(to)
    for a, b, k, d in edges:  # every cycle is a sum of those that one edge closes
        for start in [s for s, t in found if t == a]:
            there, known = _compose(found[start, a], (k, d)), found[start, b]
            if any(abs(x - y) > tolerance * max(1.0, abs(x), abs(y)) for x, y in zip(there, known, strict=True)):
                raise ValueError(f"inconsistent cycle over {a} -> {b} from {start}: {there} against {known}")
    return found


def conversion_table(spark: SparkSession, edges=EDGES) -> DataFrame:
    """Fixed table of a few hundred rows: source_unit, target_unit, scale, shift."""
    return spark.createDataFrame([(a, b, *f) for (a, b), f in compositions(edges).items()], "source_unit string, target_unit string, scale double, shift double")


_GAP = r"[ '’\u00a0\u202f]"
_NUMBER = rf"([+-]?(?:\d{{1,3}}(?:,\d{{3}})+\.\d+|\d{{1,3}}(?:\.\d{{3}})+,\d+|\d{{1,3}}(?:,\d{{3}}){{2,}}|\d{{1,3}}(?:\.\d{{3}}){{2,}}|\d{{1,3}}(?:{_GAP}\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?:[eE][+-]?\d+)?)"
_PLAIN = rf"^(?:ca\.?|circa|approx\.?|about|~|≈)?\s*{_NUMBER}\s*(.*?)\s*\.?$"
_FEET_INCHES = r"(?i)^(?:ca\.?|circa|approx\.?|about|~|≈)?\s*(\d+)\s*(?:'|′|ft\.?|feet|foot)\s*(\d+(?:\.\d+)?)\s*(?:\"|″|''|in\.?|inch(?:es)?)?$"
_DMS = r"(?i)^(\d+)\s*(?:°|deg)?\s*(\d+(?:\.\d+)?)\s*(?:'|′|min)\s*(?:(\d+(?:\.\d+)?)\s*(?:\"|″|''|sec)?)?\s*([ew]?)$"


def _as_double(text: Column) -> Column:
    """A number with a decimal comma or point and any thousands separators; null for an empty text."""
    plain = F.regexp_replace(text, _GAP, "")
    plain = F.regexp_replace(plain, r"^([+-]?\d{1,3})([.,])(\d{3})\2(\d{3})(?!\d)", "$1$3$4")
    plain = F.regexp_replace(plain, r"[.,](?=\d{3}[.,]\d)", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


#: What a note says of a column, in the order tried; "not X" is taken out before. Fixed patterns.
_LENGTH_WORDS = (
    ("mm", r"mm|milli\w*|Milli\w*"), ("cm", r"cm|[cz]enti\w*|x 100"), ("in", r"inch(?:es)?|\[in\]|Zoll|pouces|pulgadas"),
    ("ft", r"ft|feet|foot|Fu(?:ß|ss)|pieds?|pies|imperial"), ("yd", r"yards?|yd"), ("m", r"m|met(?:re|er)s?|metric|m[èe]tres?|metros?"),
)
_LONGITUDE_WORDS = (
    ("arcsec", r"arc ?sec\w*"), ("rad", r"rad(?:ians?)?"), ("gon", r"gons?|gradians?|grads?"), ("microdeg", r"micro-?deg\w*|[uµμ]deg"),
    ("deg", r"(?:decimal )?deg(?:rees)?"),
)


def _clause(words: str, subject: str) -> str:
    """A clause of one note part (parts end at ';', ' / ' or '. ' with an abbreviation's dot allowed) with subject and unit."""
    part = r"(?:(?!; | / |\. (?!actually|\[)).)"
    word = rf"(?<![\wäöüß])(?:{words})(?![\wäöüß])"
    return rf"(?i)(?:{subject}{part}*?{word}|{word}{part}*?{subject})"


_HEIGHT = r"(?<![\w])(?:heights?|hgt|höhen?|hauteurs?|alturas?|elevation)(?!\w)"
_FEET = r"(?<![\w])feet col(?:umn|\.)?(?!\w)|(?<![\w])(?:under|in the|column) feet(?!\w)"
_LONGITUDE = r"(?<![\w])(?:base_lon|lon|longitudes?|längen?)(?!\w)"


def note_units(notes: DataFrame) -> DataFrame:
    """survey_id and the unit its notes name for height, feet and base_lon (null where they name none)."""
    text = F.array_join(F.sort_array(F.collect_set("unit_note")), "; ").alias("note")
    notes = notes.filter("survey_id is not null and trim(unit_note) <> ''").groupBy("survey_id").agg(text)
    # many notes are alike; columns are added in steps, so that each pattern is matched once
    texts = notes.select("note").distinct()
    texts = texts.withColumn("said", F.regexp_replace("note", r"(?i)\(?\b(?:not|nicht|pas|no)\b (?:in )?[\p{L}]+\)?", " "))
    said = F.col("said")
    of_feet = F.regexp_extract(said, rf"(?i)(?:[^;/]*?)(?:{_FEET})(?:(?!; | / |\. (?!actually)).)*", 0)
    # a part on the feet column says nothing of height; feet of ladders and the like name no column
    of_height = F.regexp_replace(said, rf"(?i)[^;/.]*(?:{_FEET})(?!\s*derived)(?:(?!; | / |\. (?!actually)).)*", " ")
    texts = texts.withColumns({"of_feet": of_feet, "of_height": of_height})
    texts = texts.withColumns({"of_feet": F.when(~F.col("of_feet").rlike(r"(?i)derived"), F.col("of_feet")), "of_height": F.regexp_replace("of_height", r"(?i),? feet column derived", " ")})
    of_feet, of_height = F.col("of_feet"), F.col("of_height")
    height, feet, lon = (F.lit(None).cast("string") for _ in range(3))
    for unit, words in reversed(_LENGTH_WORDS):
        height = F.when(of_height.rlike(_clause(words, _HEIGHT)), unit).otherwise(height)
    for unit, words in reversed(_LENGTH_WORDS):
        if unit != "ft":
            feet = F.when(of_feet.rlike(rf"(?i)(?<!\w)(?:{words})(?!\w)"), unit).otherwise(feet)
    for unit, words in reversed(_LONGITUDE_WORDS):
        lon = F.when(said.rlike(_clause(words, _LONGITUDE)), unit).otherwise(lon)
    return notes.join(texts.select("note", height.alias("height"), feet.alias("feet"), lon.alias("base_lon")), "note").drop("note")


#: Parts a value can have, with the units of the smaller ones by the label of the whole.
PARTS = {"ft_in": ("ft", "in", None), "dms": ("deg", "arcmin", "arcsec")}


def read_values(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Adds what each field's text says: {field}_n, _n2, _n3 (sizes of its parts), _sign, and _u, its unit.

    The unit is null if the text names none and '?' if it is unknown. Columns are added in steps, so that each pattern is
    matched once, and patterns are only tried on what is not a bare number.
    """
    spelt = F.create_map(*(F.lit(x) for unit, names in SPELLINGS.items() for name in names for x in (name, unit)))
    bare: dict[str, Column] = {}
    texts: dict[str, Column] = {}
    numbers: dict[str, Column] = {}
    parts: dict[str, Column] = {}
    for f in fields:
        whole = _DMS if f == "base_lon" else _FEET_INCHES
        text = F.trim(f)
        bare[f"{f}_bare"] = F.when(F.substring(text, -1, 1).between("0", "9"), text.try_cast("double"))
        extract = lambda pattern, i, f=f: F.when(F.col(f"{f}_bare").isNull(), F.regexp_extract(F.trim(f), pattern, i))
        texts |= {f"{f}_t0": extract(_PLAIN, 1), f"{f}_tail": F.lower(extract(_PLAIN, 2))}
        texts |= {f"{f}_t{i}": extract(whole, i) for i in range(1, 5 if f == "base_lon" else 3)}
        numbers |= {f"{f}_x{i}": _as_double(F.col(f"{f}_t{i}")) for i in range(1, 4 if f == "base_lon" else 3)}
        numbers[f"{f}_x0"] = F.coalesce(f"{f}_bare", _as_double(F.col(f"{f}_t0")))
        if f == "base_lon":
            numbers[f"{f}_letter"] = F.lower(F.col(f"{f}_t4"))
        compound = F.col(f"{f}_x1").isNotNull() & F.col(f"{f}_x2").isNotNull()
        parts |= {f"{f}_n": F.when(compound, F.col(f"{f}_x1")).otherwise(F.col(f"{f}_x0")), f"{f}_n2": F.when(compound, F.col(f"{f}_x2"))}
        unit = F.when(F.col(f"{f}_x0").isNotNull() & (F.col(f"{f}_tail") != ""), F.coalesce(spelt[F.col(f"{f}_tail")], F.lit("?")))
        parts[f"{f}_u"] = F.when(compound, "dms" if f == "base_lon" else "ft_in").otherwise(unit)
        if f == "base_lon":
            west = F.when(compound, F.col(f"{f}_letter") == "w").otherwise(F.col(f"{f}_tail").endswith("w"))
            parts |= {f"{f}_n3": F.when(compound, F.col(f"{f}_x3")), f"{f}_sign": F.when(west, -1.0).otherwise(1.0)}
        else:
            parts |= {f"{f}_n3": F.lit(None).cast("double"), f"{f}_sign": F.lit(1.0)}
    rows = rows.withColumns(bare).withColumns(texts).withColumns(numbers).withColumns(parts)
    return rows.drop(*bare, *texts, *numbers)


#: Units a bare height can be in; with others a note or the value says so.
HEIGHT_GUESSES = ("m", "ft", "cm", "in", "mm")


def _height_by_feet(log_ratio: Column, table: dict) -> Column:
    """The unit in which a bare height is nearest to the row's feet, by ratio; metres where that says nothing.

    log_ratio: logarithm of the height's number over the feet in metres, null if one of them is 0 or not known.
    """
    errors = F.array(*(F.struct(F.abs(log_ratio + F.lit(math.log(table[u, "m"][0]))).alias("off"), F.lit(i).alias("rank"), F.lit(u).alias("unit")) for i, u in enumerate(HEIGHT_GUESSES)))
    return F.when(log_ratio.isNotNull(), F.array_min(errors)["unit"]).otherwise(F.lit("m"))


def _lon_by_size(lon: Column, text: Column) -> Column:
    size = F.abs(lon)
    around = F.when(lon > 0, "deg360").otherwise("degneg360")
    whole = F.when(~text.rlike(r"[.,]\d"), "e7deg")
    return F.when(size <= 180, "deg").when(size <= 360, around).when(size <= 180 * 3600, "arcsec").otherwise(F.coalesce(whole, F.when(size <= 180e6, "microdeg").otherwise("e7deg")))


def convert_units(measured: DataFrame, notes: DataFrame) -> DataFrame:
    """All values of height, feet and base_lon in metres, feet and decimal degrees.

    Returns meas_id, field_name, raw_value, number (of its first part), source_unit, target_unit, how (value, note or row),
    value, and as_recorded: the conversion found is the identity.
    """
    table = compositions()
    spark = measured.sparkSession
    said = note_units(notes).select("survey_id", *(F.col(f).alias(f"note_{f}") for f in CANONICAL))
    rows = measured.select("meas_id", "survey_id", *CANONICAL).join(said, "survey_id", "left")
    rows = read_values(rows, CANONICAL)
    how = {f"{f}_how": F.when(F.col(f"{f}_u").isNotNull(), "value").when(F.col(f"note_{f}").isNotNull(), "note").otherwise("row") for f in CANONICAL}
    rows = rows.withColumns(how)
    rows = rows.withColumn("feet_u", F.coalesce("feet_u", "note_feet", F.lit("ft")))
    in_m = F.create_map(*(F.lit(x) for u in ("m", "km", "dm", "cm", "mm", "in", "ft", "yd") for x in (u, table[u, "m"][0])), F.lit("ft_in"), F.lit(table["ft", "m"][0]))
    feet_in_m = F.col("feet_n") * in_m[F.col("feet_u")] + F.coalesce(F.col("feet_n2") * F.lit(table["in", "m"][0]), F.lit(0.0))
    ratio = F.abs(F.col("height_n") / F.nullif("feet_in_m", F.lit(0.0)))
    rows = rows.withColumn("feet_in_m", feet_in_m).withColumn("ratio", ratio).withColumn("log_ratio", F.when(F.col("ratio") > 0, F.log("ratio")))
    rows = rows.withColumns({
        "height_u": F.coalesce("height_u", "note_height", _height_by_feet(F.col("log_ratio"), table)),
        "base_lon_u": F.coalesce("base_lon_u", "note_base_lon", _lon_by_size(F.col("base_lon_n"), F.col("base_lon"))),
    })
    long = rows.select("meas_id", F.explode(F.array(*(
        F.struct(
            F.lit(f).alias("field_name"), F.col(f).alias("raw_value"), *(F.col(f"{f}_{k}").alias(k) for k in ("n", "n2", "n3", "sign")),
            F.when(F.col(f"{f}_n").isNotNull(), F.col(f"{f}_u")).alias("source_unit"), F.lit(to).alias("target_unit"), F.col(f"{f}_how").alias("how"),
        ) for f, to in CANONICAL.items()))).alias("x")).select("meas_id", "x.*").filter("trim(raw_value) <> ''")
    # each part is joined with the conversion of its own unit
    whole = F.col("source_unit").isin(*PARTS)
    unit = lambda i: F.create_map(*(F.lit(x) for k, units in PARTS.items() if units[i] for x in (k, units[i])))[F.col("source_unit")]
    out = long.withColumns({"u": F.when(whole, unit(0)).otherwise(F.col("source_unit")), "u2": unit(1), "u3": unit(2)})
    for i in ("", "2", "3"):
        fixed = F.broadcast(conversion_table(spark).select(F.col("source_unit").alias(f"u{i}"), "target_unit", F.col("scale").alias(f"scale{i}"), F.col("shift").alias(f"shift{i}")))  # a fixed table
        out = out.join(fixed, [f"u{i}", "target_unit"], "left")
    part = lambda i: F.coalesce(F.col(f"n{i}") * F.col(f"scale{i}") + F.col(f"shift{i}"), F.lit(0.0))
    value = F.col("sign") * (F.col("n") * F.col("scale") + F.col("shift") + part("2") + part("3"))
    identity = (F.col("scale") == 1) & (F.col("shift") == 0) & ~whole
    return out.select(
        "meas_id", "field_name", "raw_value", (F.col("sign") * F.col("n")).alias("number"), "source_unit", "target_unit", "how", value.alias("value"), F.coalesce(identity, F.lit(False)).alias("as_recorded")
    )


def recorded_elsewise(converted: DataFrame) -> DataFrame:
    """Values whose conversion to the canonical unit is not the identity, or not known: those recorded in another unit."""
    return converted.filter("number is not null and not as_recorded")
