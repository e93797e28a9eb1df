"""Line dedup: repeated runs of lines, found by prefix doubling over line-id sequences.

Every document is the sequence of its lines that hold a word. Suffixes of these
sequences are named by prefix doubling: the name of the first 1, 2, 4, ... lines from a
place is the earliest place with the same lines, and a name of twice the length comes
from two names side by side. Places whose prefix occurs nowhere else have left the
table by then, so each round is smaller than the one before. Places with one name form
an interval of suffixes whose common prefix is that long; all but its earliest member
start a later copy. Overlapping copies join to maximal runs, and those lines go.

Only DataFrame operations are used. Names are joined back by key, and Spark splits the
partition of a line that a large part of all documents holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import cut

_GAP = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, _GAP, -1), lambda w: w != ""))


def _named(places: DataFrame, by: list[str]) -> DataFrame:
    """Places that share `by` with another place, with the earliest of them as (n_row, n_at)."""
    first = F.min(F.struct("nameless", "doc", "row", "at"))
    names = places.groupBy(*by).agg(first.alias("n"), F.count("*").alias("c")).filter("c > 1")
    # joined by one key made of all, so that both sides are shuffled for the join alone and hot partitions can be split
    names = names.select(F.struct(*by).alias("k"), "n")
    kept = ["nameless", "doc", "row", "at", "line", "words"]
    return places.withColumn("k", F.struct(*by)).join(names, "k").select(*kept, F.col("n.row").alias("n_row"), F.col("n.at").alias("n_at"))


def _doubled(named: DataFrame, step: int) -> DataFrame:
    """Names of the prefixes that reach `step` lines further than the given ones."""
    ahead = named.select("row", (F.col("at") - step).alias("at"), F.col("n_row").alias("m_row"), F.col("n_at").alias("m_at"))
    return _named(named.join(ahead, ["row", "at"]), ["n_row", "n_at", "m_row", "m_at"])


def repeated_lines(numbered: DataFrame, min_lines: int, line_words: int) -> DataFrame:
    """(row, line): the lines to delete of documents (row, doc, text); `line` counts all lines from 0."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    full = F.filter(lines, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    places = numbered.select("row", "doc", F.posexplode(full).alias("at", "s")).select(
        F.col("doc").isNull().alias("nameless"), "doc", "row", "at", F.col("s.line").alias("line"), _words(F.col("s.x")).alias("words"),
        F.xxhash64("s.x").alias("id1"), F.xxhash64(F.lit(1), F.col("s.x")).alias("id2"),
    )
    # written once: every round reads names, not texts
    single = cut(_named(places, ["id1", "id2"]))
    later = (F.col("n_row") != F.col("row")) | (F.col("n_at") != F.col("at"))
    gone = single.filter(later & (F.col("words") >= line_words)).select("row", "line")
    at, size = single, 1
    while size < min_lines:
        step = min(size, min_lines - size)
        at, size = _doubled(at, step), size + step
    copies = at.filter(later).select("row", F.explode(F.sequence("at", F.col("at") + (min_lines - 1))).alias("at"))
    covered = copies.distinct().join(single.select("row", "at", "line"), ["row", "at"]).select("row", "line")
    return gone.unionByName(covered).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, line_words: int = 5, report: bool = True) -> DataFrame:
    """All columns of `docs`, `text` without later copies; with `report` also `n_lines` and `removed` (runs of start, n).

    A run is deleted where it starts at least the second time, in order of key and line:
    a run of `min_lines` lines or more, or one line of `line_words` words or more. Lines
    end at newlines and are compared as they are; those without a word are no part of
    the sequences and stay. Rows that share a key follow in the order read, rows with a
    NULL key come last. A NULL text stays NULL with no lines; an emptied one is ''.
    Columns of the names of the report are replaced by it.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all")).withColumn("row", F.monotonically_increasing_id())
    # written once, so that a row keeps its number whatever happens to its task
    rows = cut(rows)
    numbered = rows.select("row", F.col(f"all.`{key}`").alias("doc"), F.col(f"all.`{text}`").alias("text"))
    gone = repeated_lines(numbered, min_lines, line_words)
    order = Window.partitionBy("row").orderBy("line")
    runs = gone.withColumn("start", F.col("line") - F.row_number().over(order)).groupBy("row", "start").agg(F.min("line").alias("first"), F.count("*").cast("int").alias("n"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("start"), "n"))).alias("runs"))
    both = rows.join(runs, "row", "left")
    whole = F.split(F.col(f"all.`{text}`"), "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["start"] + r["n"]))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("_lines")))
    parts = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"])
    kept = F.array_join(F.transform(parts, lambda g: F.array_join(F.slice("_lines", g["a"] + 1, g["b"] - g["a"]), "\n")), "\n")
    both = both.withColumn("_lines", F.when(F.col("runs").isNotNull(), whole))
    new = F.when(F.col("runs").isNull(), F.col(f"all.`{text}`")).otherwise(kept)
    count = F.coalesce(F.when(F.col(f"all.`{text}`").isNotNull(), F.size(whole)), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<start:int,n:int>>")
    out = [c for c in names if not (report and c.lower() in ("n_lines", "removed"))]
    cols = [new.alias(c) if c == text else F.col(f"all.`{c}`").alias(c) for c in out]
    if not report:
        return both.select(*cols)
    return both.select(*cols, count.alias("n_lines"), F.coalesce("runs", none).alias("removed"))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; NULL: as empty)."""
    out = dedup_lines(docs.select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["n"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Plain SQL for the same rows.
LINE_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
every AS (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS line FROM cut),
full_lines AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM every),
seq AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY line) AS x2, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS line2
        FROM full_lines WHERE words > 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, line) AS k1, row_number() OVER (PARTITION BY x, x2 ORDER BY doc_id, line) AS k2 FROM seq),
gone AS (SELECT doc_id, line FROM seen WHERE k1 > 1 AND words >= 5
         UNION SELECT doc_id, line FROM seen WHERE k2 > 1 AND x2 IS NOT NULL
         UNION SELECT doc_id, line2 FROM seen WHERE k2 > 1 AND x2 IS NOT NULL),
marked AS (SELECT e.*, g.line IS NOT NULL AS dead FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dead) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT dead), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
