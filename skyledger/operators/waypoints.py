"""Reporting-point catalogue: raw table cells -> clean, merged, classified waypoints."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators import blocks
from skyledger.session import cut, spread

# Words, letters, patterns and limits of the catalogue's format.
TYPE_ON_DEMAND = "דרישה"
TYPE_MANDATORY = "חובה"
TYPE_AERODROME = "ARP"
HEBREW = r"[\u0590-\u05FF\uFB1D-\uFB4F]"
LETTERS = r"[\u05D0-\u05EA\u05F0-\u05F2\uFB1D-\uFB4F]"  # the same without points and marks
STEM_WORDS = {
    "מחלף": 5, "צומת": 5, "מצפה": 4, "קרית": 3, "נווה": 4, "כפר": 5, "עינות": 3,
    "שדה": 3, "עין": 4, "בית": 5, "ים": 4, "הר": 3, "נמל": 3,
}  # leading word of a place name -> how many more words may follow the second
KEY_FIRST_WORDS = (*STEM_WORDS, "תל", "באר", "מעלה", "שער", "גשר")
# Signs of a name of mixed origin, as patterns: foreign characters, a run of one letter, a digit that no gap sets apart.
FOREIGN_SIGNS = r"[A-Za-z0-9(){}\[\]<>/\\]|\.\.|--|\u2014"
LONE_VAVS = r"(?:^|\s)\u05D5{3,}\s|\s\u05D5{3,}$"
GLUED_DIGIT = r"[^\sA-Za-z0-9(){}\[\]<>/\\|\"\u201C\u201D\u2033\u05F4][0-9]"
# Marks at a cell's borders and behind a name.
BORDER_MARKS = "|[]<>"
END_MARKS = "*'\u05F3\u05F4\".,:;|/\\-"
JUNK_WORDS = ("היד", "הוחו", "חר", "דיו", "רודו", "רה", "רין", "ין")
FINAL_LETTERS = {"מ": "ם", "נ": "ן", "פ": "ף", "צ": "ץ"}
QUOTE_FROM, QUOTE_TO = "”“″’′º⁰", "\"\"\"''°0"
DIGIT_FROM, DIGIT_TO = "OoQlIi|SsB", "0001111558"
LAT_LIMITS = (29.0, 33.8)
LON_LIMITS = (34.0, 36.2)
BIDI_MARKS = r"[\u200E\u200F\u202A-\u202E\u2066-\u2069]"
CODE_PATTERN = r"^[A-Z]{4,5}$"
AIRPORT_CODE = r"^LL[A-Z]{2}$"
MAP_LINKS = {
    "bing": "https://www.bing.com/maps?cp=%s~%s&lvl=14.8&style=h",
    "google": "https://www.google.com/maps/@%s,%s,14.8z/data=!3m1!1e3",
    "apple": "https://maps.apple.com/?ll=%s,%s&z=14.8",
}
SEPARATOR = "\x1f"


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; the one text function Spark does not have.

    Defined in place, so that it travels to workers that do not have this package.
    """

    @F.pandas_udf(T.StringType())
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return normalise(text)


# --- text helpers ------------------------------------------------------------------


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _clean_line(c: Column) -> Column:
    """Plain quotes, single spaces, no direction marks (the text is NFKC already)."""
    return F.regexp_replace(_squeeze(F.translate(c, QUOTE_FROM, QUOTE_TO)), BIDI_MARKS, "")


def _clean_cell(c: Column) -> Column:
    return F.regexp_replace(_squeeze(c), r"[\x00-\x1f\x7f]", "")


def _replace_all(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, c)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where filters copy the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({HEBREW}+)"), F.lit(1))


# --- coordinates ---------------------------------------------------------------------


def tidy_dms(c: Column) -> Column:
    """Uniform spacing of a degree-minute-second text."""
    t = _replace_all(_clean_cell(c), [(r"\s*°\s*", "° "), (r"\s*'\s*", "'"), (r'\s*"\s*', '" ')])
    t = _replace_all(_squeeze(t), [(r"(?i)\s*N\s*$", " N"), (r"(?i)\s*E\s*$", " E")])
    return _squeeze(t)


def parse_dms(c: Column, hemisphere: str) -> Column:
    """First ``deg°min'sec"`` followed by the hemisphere letter, in degrees; NULL if none."""
    width = 2 if hemisphere == "N" else 3
    pattern = rf"(\d{{1,{width}}})\s*°\s*(\d{{1,2}})\s*'\s*(\d{{1,2}}(?:\.\d+)?)\s*\"\s*{hemisphere}"
    part = lambda t, i: F.regexp_extract(t, pattern, i).try_cast("double")
    return _let(c, lambda t: part(t, 1) + part(t, 2) / 60.0 + part(t, 3) / 3600.0)


def recover_dms(c: Column) -> Column:
    """Struct (deg, minute, sec) from recognised text with letters read for digits."""
    n = lambda t, i, k: F.substring(t, i, k).try_cast("int")
    triple = lambda d, m, s: F.struct(d.alias("deg"), m.alias("minute"), s.alias("sec"))

    def read(g: Column) -> Column:
        head, rest = g["head"], g["rest"]
        return (
            F.when(head.isNull(), F.lit(None))
            .when(rest == "", F.when(F.length(head) >= 6, triple(n(head, 1, 2), n(head, 3, 2), n(head, 5, 2))))
            .when(F.length(head) < 2, F.lit(None))
            .when(F.length(rest) == 3, triple(n(head, 1, 2), n(rest, 1, 1), n(rest, 2, 2)))
            .when(F.length(rest) >= 4, triple(n(head, 1, 2), n(rest, 1, 2), n(rest, 3, 2)))
        )

    groups = F.regexp_extract_all(F.translate(c, DIGIT_FROM, DIGIT_TO), F.lit(r"(\d+)"), F.lit(1))
    parts = _let(
        groups,
        lambda g: F.struct(
            F.get(g, 0).alias("head"),
            F.array_join(F.filter(g, lambda _, i: i > 0), "").alias("rest"),
        ),
    )
    return _let(parts, read)


def _recovered(c: Column, hemisphere: str, limits: tuple[float, float]) -> Column:
    """Struct (value, text): degrees within the limits, and the canonical text."""

    def read(p: Column) -> Column:
        good = (p["minute"] < 60) & (p["sec"] < 60)
        value = p["deg"] + p["minute"] / 60.0 + p["sec"] / 3600.0
        canonical = F.concat(
            F.format_string("%d° %02d' %02d\" ", p["deg"], p["minute"], p["sec"]), F.lit(hemisphere)
        )
        return F.struct(
            F.when(good & (value >= limits[0]) & (value <= limits[1]), value).alias("value"),
            F.when(good, canonical).otherwise(tidy_dms(c)).alias("text"),
        )

    return _let(recover_dms(c), read)


def _strict(c: Column, hemisphere: str) -> Column:
    return _let(tidy_dms(c), lambda t: F.struct(parse_dms(t, hemisphere).alias("value"), t.alias("text")))


# --- names -------------------------------------------------------------------------------


def split_name_type(blob: Column) -> Column:
    """Struct (name, rtype) from one text: leading ARP, a type word, ARP anywhere, nothing."""
    mark = F.regexp_extract(blob, f"({TYPE_ON_DEMAND}|{TYPE_MANDATORY})", 1)
    without = F.regexp_replace(blob, f"^(.*?)({TYPE_ON_DEMAND}|{TYPE_MANDATORY})", "$1")
    pair = lambda n, t: F.struct(n.alias("name"), t.alias("rtype"))
    return (
        F.when(
            F.startswith(blob, F.lit(TYPE_AERODROME)),
            pair(F.regexp_replace(F.trim(F.substr(blob, F.lit(4))), r"^\s*,\s*", ""), F.lit(TYPE_AERODROME)),
        )
        .when(mark != "", pair(_squeeze(without), mark))
        .when(
            blob.rlike(r"(?U)\bARP\b"),
            pair(_squeeze(F.regexp_replace(blob, r"(?U)\bARP\b", " ")), F.lit(TYPE_AERODROME)),
        )
        .otherwise(pair(blob, F.lit("")))
    )


def split_cells(cells: Column) -> Column:
    """Struct (name, rtype) from separate cells ``array<struct<x0, text>>``.

    The first cell that holds a type (word or ARP) gives it and keeps only its
    remaining text; names are then read from right to left.
    """
    mark_pattern = f"{TYPE_ON_DEMAND}|{TYPE_MANDATORY}"
    arp_pattern = r"(?iU)\bARP\b"
    full = F.filter(cells, lambda c: c["text"] != "")
    typed = F.array_position(
        F.transform(full, lambda c: c["text"].rlike(f"{mark_pattern}|{arp_pattern}")), True
    )
    hit = F.get(full, (typed - 1).cast("int"))["text"]
    mark = F.regexp_extract(hit, f"({mark_pattern})", 1)
    rtype = F.when(typed == 0, "").when(mark != "", mark).otherwise(TYPE_AERODROME)

    def rest(t: Column) -> Column:
        return F.trim(
            F.when(t.rlike(mark_pattern), F.regexp_replace(t, f"^(.*?)({mark_pattern})", "$1")).otherwise(
                F.regexp_replace(t, arp_pattern, " ")
            )
        )

    parts = F.transform(
        full,
        lambda c, i: F.struct(
            (-c["x0"]).alias("k"), i.alias("i"), F.when(i == typed - 1, rest(c["text"])).otherwise(c["text"]).alias("t")
        ),
    )
    kept = F.array_sort(F.filter(parts, lambda p: p["t"] != ""))
    return F.struct(F.trim(F.array_join(F.transform(kept, lambda p: p["t"]), " ")).alias("name"), rtype.alias("rtype"))


def _final_letters(c: Column) -> Column:
    """Every word's last letter in its closing form."""
    medial, final = ("".join(x) for x in (FINAL_LETTERS, FINAL_LETTERS.values()))

    def close(w: Column) -> Column:
        last = F.translate(F.right(w, F.lit(1)), medial, final)
        return F.when(w.rlike(rf"^{HEBREW}{{2,}}$"), F.concat(F.left(w, F.length(w) - 1), last)).otherwise(w)

    return F.array_join(F.transform(F.split(c, " "), close), " ")


def _without_noise(words: Column) -> Column:
    """Words less repeated letters, lone letters beside longer words, and known junk (unless all is junk)."""

    def no_lone(w: Column) -> Column:
        led = (F.size(w) == 2) & (F.length(F.get(w, 0)) == 1) & (F.length(F.get(w, 1)) > 1)
        return F.when(led, F.slice(w, 2, 1)).when(F.size(w) > 2, F.filter(w, lambda x: F.length(x) > 1)).otherwise(w)

    def no_junk(w: Column) -> Column:
        return _let(F.filter(w, lambda x: ~x.isin(*JUNK_WORDS)), lambda good: F.when(F.size(good) > 0, good).otherwise(w))

    varied = F.filter(words, lambda x: ~x.rlike(r"^(.)\1+$"))
    return _let(_let(varied, no_lone), no_junk)


def _place(words: Column, mixed: Column) -> Column:
    """The words of the place: the longest phrase a known first word opens, or the end of a long text."""
    more = F.create_map(*[F.lit(x) for pair in STEM_WORDS.items() for x in pair])
    phrases = F.filter(
        F.transform(words, lambda w, i: F.slice(words, i + 1, F.coalesce(F.try_element_at(more, w), F.lit(-2)) + 2)),
        lambda ph: F.size(ph) > 1,
    )
    letters = lambda ph: F.length(F.array_join(ph, " "))
    longest = F.aggregate(
        phrases, F.array().cast("array<string>"), lambda best, ph: F.when(letters(ph) > letters(best), ph).otherwise(best)
    )
    tail = F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5)
    opening = F.array_position(F.transform(tail, lambda w: w.isin(*KEY_FIRST_WORDS) | (F.length(w) > 3)), True)

    def choose(found: Column) -> Column:
        return (
            F.when((F.size(found) > 0) & (mixed | (letters(words) - letters(found) > 3)), found)
            .when((mixed | (F.size(words) > 4)) & (opening > 0), F.slice(tail, F.greatest(opening, F.lit(1)).cast("int"), 5))
            .otherwise(words)
        )

    return _let(longest, choose)


def polish_name(c: Column) -> Column:
    """The place name in a text of mixed origin.

    The text is cut once into runs of letters of the name's script; whatever stood
    between them only tells whether the text is ``mixed``. Words then lose noise, give
    up the place phrase, and get their closing letters.
    """

    def of(line: Column) -> Column:
        mixed = line.rlike(rf"{FOREIGN_SIGNS}|{LONE_VAVS}")
        # of these signs, cutting the text into words takes most away; what it leaves decides about phrases
        still = F.regexp_extract(line, f"{HEBREW}.*$", 0).rlike(rf"{GLUED_DIGIT}|--.*{HEBREW}|{LONE_VAVS}")

        def lead(w: Column) -> Column:
            stray = mixed & (F.size(w) == 2) & (F.length(F.get(w, 0)) < 4) & (F.length(F.get(w, 1)) > 3)
            return F.when(stray & ~F.get(w, 0).isin(*KEY_FIRST_WORDS), F.slice(w, 2, 1)).otherwise(w)

        words = F.regexp_extract_all(line, F.lit(f"({LETTERS}+)"), F.lit(1))
        return _let(_let(_let(words, _without_noise), lambda w: _place(w, still)), lead)

    return _final_letters(F.array_join(_let(_clean_line(c), of), " "))


def polish_names(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, polish_name(F.col(col)))


def clean_light(c: Column) -> Column:
    """Gentle clean of cell-wise recognised names; a detached first letter joins the last word.

    The name is a list of words: it begins at the first letter of the script, ends
    before trailing marks, and a single letter in front of words of the script goes behind the last.
    """
    last = lambda w: F.element_at(w, F.size(w))
    cut = lambda text: F.array_remove(F.split(text, r"\s+"), "")

    def begin(w: Column) -> Column:
        at = F.array_position(F.transform(w, lambda x: x.rlike(HEBREW)), True).cast("int")
        first = F.regexp_extract(F.get(w, at - 1), f"{HEBREW}.*$", 0)
        return F.when(at > 0, F.concat(F.array(first), F.slice(w, at + 1, F.size(w)))).otherwise(w)

    def end(w: Column) -> Column:
        return cut(F.rtrim(F.array_join(w, " "), F.lit(END_MARKS + " ")))

    def attach(w: Column) -> Column:
        plain = F.forall(w, lambda x: x.rlike(f"^{HEBREW}+$"))
        whole = F.concat(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), F.array(F.concat(last(w), F.get(w, 0))))
        return F.when((F.size(w) > 1) & (F.length(F.get(w, 0)) == 1) & plain, whole).otherwise(w)

    words = cut(F.translate(_clean_line(c), BORDER_MARKS, " " * len(BORDER_MARKS)))
    return _final_letters(F.array_join(_let(_let(_let(words, begin), end), attach), " "))


# --- catalogue -----------------------------------------------------------------------------


def clean_waypoints(cells: DataFrame) -> DataFrame:
    """Raw cell rows -> waypoint rows.

    ``cells``: edition, mode_id, sheet, sheet_ord, ord, strategy ('vector' or
    'recognised'), code, lat_text, lon_text, meta array<struct<x0, text>>. Rows
    without a proper code or position fall away. Rows are dealt to all cores first: the
    texts take long, and a catalogue of millions of rows fits one small file.
    """
    cells = spread(cells)
    recognised = F.col("strategy") == "recognised"
    joined = F.concat_ws(
        SEPARATOR,
        F.coalesce("lat_text", F.lit("")),
        F.coalesce("lon_text", F.lit("")),
        F.transform("meta", lambda m: F.translate(m["text"], SEPARATOR, " ")),
    )
    code = F.trim(F.when(recognised, F.replace(F.col("code"), F.lit(" "), F.lit(""))).otherwise(_clean_cell(F.col("code"))))
    header = F.contains(code, F.lit("Letter")) | (F.contains(code, F.lit("Code")) & (F.length(code) > 8))
    rows = cells.withColumn("code", code).where(~header & F.col("code").rlike(CODE_PATTERN))
    keep = [c for c in rows.columns if c not in ("lat_text", "lon_text")]
    texts = rows.withColumn("_t", F.split(nfkc(joined), SEPARATOR, -1)).select(
        *keep, F.transform("_t", lambda t: _clean_line(t)).alias("_t")
    )

    def position(i: int, hemisphere: str, limits: tuple[float, float]) -> Column:
        t = F.get("_t", i)
        return F.when(recognised, _recovered(t, hemisphere, limits)).otherwise(_strict(t, hemisphere))

    placed = (
        # exploded, so that the filter does not read the positions a second time
        texts.withColumn("_at", F.explode(F.array(F.struct(position(0, "N", LAT_LIMITS).alias("la"), position(1, "E", LON_LIMITS).alias("lo")))))
        .select(
            *keep, "_t",
            F.col("_at.la.value").alias("lat"), F.col("_at.lo.value").alias("lon"),
            F.col("_at.la.text").alias("lat_dms"), F.col("_at.lo.text").alias("lon_dms"),
        )
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )
    n_meta = F.size("meta")
    meta = F.transform(
        F.slice("_t", F.lit(3), F.greatest(n_meta, F.lit(1))),
        lambda t, i: F.struct(F.get("meta", i)["x0"].alias("x0"), t.alias("text")),
    )
    named = (
        placed.withColumn("_cells", F.when(n_meta > 0, meta).otherwise(F.array().cast("array<struct<x0:double,text:string>>")))
        .withColumn("_blob", _squeeze(F.array_join(F.transform("_cells", lambda c: c["text"]), " ")))
        .withColumn("_nt", F.when(recognised, split_cells(F.col("_cells"))).otherwise(split_name_type(F.col("_blob"))))
        # a row takes one of the two ways only
        .withColumn("_name", F.when(recognised, clean_light(F.col("_nt.name"))).otherwise(polish_name(F.col("_nt.name"))))
    )
    return named.select(
        "edition", "mode_id", "sheet", "sheet_ord", "ord", "code",
        F.col("_name").alias("name_he"),
        F.trim("_nt.rtype").alias("reporting_type"),
        "lat", "lon", "lat_dms", "lon_dms",
    )


def merge_waypoints(*sheets: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Union of sheets in order, first row per (code, position at 1e-5 degrees), index 1..N.

    Copies collapse in a partial aggregate before the shuffle. The index counts
    per block of source rows first and adds block offsets, so a large edition
    is not numbered by one task.
    """
    rows = reduce(lambda a, b: a.unionByName(b), sheets)
    rows = rows.withColumn("code", F.upper(F.trim("code"))).where(F.col("code") != "")
    key = ["edition", "mode_id", "code", "_klat", "_klon"]
    rest = [c for c in rows.columns if c not in ("edition", "mode_id", "code")]
    place = F.struct("sheet_ord", "ord")
    first = (
        rows.withColumn("_klat", F.bround(F.col("lat") * 1e5, 0))
        .withColumn("_klon", F.bround(F.col("lon") * 1e5, 0))
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), place).alias("r"))
        .select("edition", "mode_id", "code", "r.*")
        .withColumn("_block", F.struct("sheet_ord", F.floor(F.col("ord") / block_rows).alias("b")))
    )
    # Numbering reads the rows twice; the cleaned catalogue is written once for that.
    return (
        blocks.running_total(cut(first), ["edition", "mode_id"], ["sheet_ord", "ord"], F.lit(1), "idx", block="_block")
        .withColumn("idx", F.col("idx").cast("int"))
        .drop("_block")
    )


def reporting_class(rtype: Column) -> Column:
    t = F.trim(F.coalesce(rtype, F.lit("")))
    return (
        F.when(t == TYPE_MANDATORY, "mandatory")
        .when(t == TYPE_ON_DEMAND, "on_demand")
        .when(F.upper(t) == TYPE_AERODROME, "arp")
        .otherwise("unknown")
    )


def classify_waypoints(waypoints: DataFrame, provider: str = "bing") -> DataFrame:
    """Reporting class, airport flag, label and map link."""
    template = MAP_LINKS.get(provider, MAP_LINKS["bing"])
    return (
        waypoints.withColumn("class", reporting_class(F.col("reporting_type")))
        .withColumn("airport", (F.col("class") == "arp") | F.upper(F.trim("code")).rlike(AIRPORT_CODE))
        .withColumn("label", F.coalesce(F.nullif(F.trim("name_he"), F.lit("")), F.trim("code")))
        .withColumn("map_url", F.format_string(template, F.col("lat").cast("string"), F.col("lon").cast("string")))
    )


def sort_waypoints(waypoints: DataFrame, column: str) -> DataFrame:
    """Numbers by value, texts ignoring case, ties by index."""
    numeric = waypoints.schema[column].dataType.typeName() in ("double", "float", "integer", "long", "short")
    key = F.col(column) if numeric else F.lower(column)
    return waypoints.orderBy(key, "idx")


def name_order() -> list[Column]:
    """Export order: by name, nameless rows first, then by index."""
    return [F.coalesce("name_he", F.lit("")), F.col("idx")]


def lookup(waypoints: DataFrame, code: str) -> DataFrame:
    """All rows of a code (the filter is pushed to the table scan)."""
    return waypoints.where(F.col("code") == code)


