"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

Of every ``run`` consecutive lines the one of least hash (the first on ties) is a fingerprint, and stands there once for
all the windows that choose it: two equal runs of that many lines always share one. Positions of equal fingerprints are
joined; a line that is chosen in one place only goes no further. From each place that is left the match is extended both
ways over the windows that chose it, told apart by 128 bits of their lines, and held against the first place in the
corpus with the same lines. Windows that stand earlier are marked; marked ones that overlap make up longer runs, each
line of which is deleted. A repeated run of ``run`` lines and more is found wherever its earlier copies stand, and
whatever stands about them; the first copy of every run stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, join_counted, row_key


def positions(docs: DataFrame, run: int) -> DataFrame:
    """docs (doc_id, doc, row, text) to one row for each position that is the least of some ``run`` lines: doc_id, doc, row,
    its fingerprint, and windows, those that it is the least of: i, the first line, and a and b, 128 bits of the lines."""
    split = F.split("text", "\n", -1)
    hashed = lambda *salt: F.transform("lines", lambda x: F.xxhash64(*map(F.lit, salt), x))
    lines = docs.filter(F.col("text").isNotNull()).select("doc_id", *ROW, split.alias("lines")).filter(F.size("lines") >= run)
    lines = lines.select("doc_id", *ROW, hashed().alias("h"), hashed(1).alias("k"))
    part = lambda c, i: F.slice(c, i + 1, run)
    least = lambda i: i + F.array_position(part("h", i), F.array_min(part("h", i))).cast("int") - 1
    window = lambda i: F.struct(i.alias("i"), least(i).alias("at"), F.xxhash64(part("h", i)).alias("a"), F.xxhash64(part("k", i)).alias("b"))
    every = lines.select("doc_id", *ROW, "h", F.transform(F.sequence(F.lit(0), F.size("h") - run), window).alias("w"))
    chosen = every.select("doc_id", *ROW, "h", "w", F.array_distinct(F.col("w.at")).alias("at"))
    near = lambda at: F.slice("w", F.greatest(at - run + 2, F.lit(1)), run)  # noqa: E731  windows that hold this line
    own = lambda at: F.transform(F.filter(near(at), lambda x: x["at"] == at), lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"), x["b"].alias("b")))
    print_of = lambda at: F.struct(F.element_at("h", at + 1).alias("fingerprint"), own(at).alias("windows"))
    return chosen.select("doc_id", *ROW, F.explode(F.transform("at", print_of)).alias("p")).select("doc_id", *ROW, "p.fingerprint", "p.windows")


def met(docs: DataFrame, run: int) -> DataFrame:
    """The positions whose fingerprint stands in more than one place."""
    every = cut(positions(docs, run))
    shared = cut(every.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1"))
    return join_counted(every, shared, ["fingerprint"])


def repeated_lines(docs: DataFrame, run: int) -> DataFrame:
    """doc, row, gone: the numbers of the lines to delete, from 0."""
    windows = met(docs, run).select("doc_id", *ROW, F.explode("windows").alias("w"))
    held = cut(windows.select(F.struct("doc_id", *ROW, "w.i").alias("place"), "w.a", "w.b"))
    first = cut(held.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_counted(held, first, ["a", "b"]).filter(F.col("place") > F.col("first"))
    lines = later.select("place.doc", "place.row", F.explode(F.sequence("place.i", F.col("place.i") + run - 1)).alias("i"))
    return lines.groupBy(*ROW).agg(F.collect_set("i").alias("gone"))


def drop_repeated_runs(docs: DataFrame, run: int = 2) -> DataFrame:
    """Adds kept (the text without later repeated runs of lines), n_lines and n_removed to docs (doc_id, text, others).

    A line goes if it lies in a run of ``run`` or more lines that also starts at an earlier place. Places are ordered by
    doc_id (nulls first), then the row's hash, then the line. Lines end at a line feed alone. Null texts have no lines
    and stay null; a text all of whose lines go becomes empty. Rows equal in doc_id and text count as one document and
    get the same result. Columns named kept, n_lines, n_removed, doc, row or gone are replaced.
    """
    docs = docs.drop("kept", "n_lines", "n_removed", *ROW, "gone").select("*", *row_key())
    gone = cut(repeated_lines(docs.select("doc_id", *ROW, "text"), run))
    joined = docs.join(gone, ROW, "left")
    split = F.split("text", "\n", -1)
    n = F.size(split)
    places = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    marks = F.sort_array(F.concat(F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(True).alias("stays"))), F.transform("gone", lambda i: F.struct(i.alias("i"), F.lit(False).alias("stays")))))
    stay = F.filter(F.arrays_zip(split.alias("line"), marks.alias("mark")), lambda x: x["mark"]["stays"])
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    return joined.select(
        *(c for c in docs.columns if c not in ROW),
        kept.alias("kept"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


#: By the definition of a repeated run of two lines and more, on the lines themselves: no hashes, no fingerprints.
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)),
later AS (
  SELECT doc_id, i FROM l WHERE next IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, i FROM later UNION SELECT doc_id, i + 1 FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""
