"""Removal of passages that repeat earlier ones, line by line, with DataFrame functions only.

Every run of whole lines that holds ``least_words`` words or more and occurs
earlier (in a document with a smaller id, or higher up) is deleted; its first
occurrence stays. Blank lines neither count nor break a run.

A window is the shortest run of lines from a line on, or up to a line, that
holds ``least_words`` words; its extent depends on its content alone. The
least line hash of each forward and backward window is its fingerprint, so
two documents that share such a run share the fingerprints of all windows in
it. Fingerprints found at one place only are dropped by a combinable count;
the windows of the others are matched by the hashes of their whole content
with the first place that has it. This replaces following matches line by
line: any line of a repeated run lies in a forward or a backward window of it,
so the union of matched windows covers the run to its ends without ever
comparing documents pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\r\x0b\f"


def _windows(docs: DataFrame, least_words: int) -> DataFrame:
    """A row per window: ``doc_id, mark`` (of the text), ``start, end`` (lines), ``least`` (fingerprint), ``k1, k2`` (content)."""
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "mark", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .select("doc_id", "mark", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n"))
        .where("n > 0")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(parts, "doc_id", "mark").dropDuplicates(["doc_id", "mark", "pos"])
    by = Window.partitionBy("doc_id", "mark")
    so_far = F.sum("n").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", so_far).withColumn("before", F.col("upto") - F.col("n"))
    ahead = by.orderBy("before").rangeBetween(0, least_words - 1)
    back = by.orderBy("upto").rangeBetween(1 - least_words, 0)

    def run(over) -> Column:
        pair = F.collect_list(F.struct("h1", "h2")).over(over)
        return F.struct(
            F.min("pos").over(over).alias("start"), F.max("pos").over(over).alias("end"), F.min("h1").over(over).alias("least"),
            F.xxhash64(F.transform(pair, lambda x: x["h1"])).alias("k1"), F.xxhash64(F.transform(pair, lambda x: x["h2"])).alias("k2"),
            F.sum("n").over(over).alias("words"),
        )

    both = lines.select("doc_id", "mark", run(ahead).alias("a"), run(back).alias("b"))
    both = both.select("doc_id", "mark", F.explode(F.array("a", "b")).alias("w")).select("doc_id", "mark", "w.*")
    return both.where(F.col("words") >= least_words).drop("words")


def repeated_runs(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """``(doc_id, mark, runs)``: the line ranges to delete from each document that has any, as ``array<struct<start, end>>``."""
    windows = table(_windows(docs, least_words), "line-windows")
    places = windows.groupBy("least").agg(F.min(F.struct("doc_id", "mark", "start")).alias("a"), F.max(F.struct("doc_id", "mark", "start")).alias("b"))
    shared = checkpointed(places.where("a <> b OR a.doc_id IS NULL").select("least"))
    matched = table(windows.join(shared, "least"), "line-matches")
    first = checkpointed(
        matched.groupBy("k1", "k2").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")).alias("first"),
            F.max(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")).alias("last"),
        ).where("first <> last").drop("last")
    )
    later = (
        matched.join(first, ["k1", "k2"])
        .where(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start") > F.col("first"))
        .select("doc_id", "mark", "start", "end").distinct()
    )
    by = Window.partitionBy("doc_id", "mark").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("fresh", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("doc_id", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def line_dedup(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, and with ``n_lines``, ``n_removed`` and ``runs`` added.

    Lines are split at line feeds and compared without blanks at their ends.
    ``runs`` lists the deleted ranges, first and last line from 0, as
    ``a-b,...``; ``n_removed`` counts the lines in them, ``n_lines`` all of
    them (0 for a null text). A text may lose every line and is then empty;
    null and empty texts stay as they are. Rows that repeat both id and text
    are one document that is listed twice and come out alike; rows with a null
    id come after all others. Columns named like the added ones are replaced.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "runs")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    runs = repeated_runs(base.select("doc_id", "text"), least_words)
    # All other columns travel inside one struct, so none of theirs can clash with names used here.
    whole = base.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"), F.xxhash64("text").alias("mark"))
    own, found = whole.alias("w"), runs.alias("r")
    joined = own.join(found, F.col("w.row.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.mark") == F.col("r.mark")), "left")
    text, cut = F.col("w.row.text"), F.col("r.runs")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.exists(cut, lambda r: (r["start"] <= i) & (i <= r["end"]))), "\n")
    removed = F.aggregate(cut, F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    return joined.select(
        *[F.when(cut.isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col("w.row")[c].alias(c) for c in kept_columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join(F.transform(cut, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ","), F.lit("")).alias("runs"),
    )


#: The same result in DuckDB SQL, with whole texts of lines in place of hashes.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM split
), counted AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto FROM lines WHERE n > 0
), runs AS (
  SELECT doc_id, min(pos) OVER a AS s, max(pos) OVER a AS e, list(line) OVER a AS content, sum(n) OVER a AS words FROM (SELECT *, upto - n AS before FROM counted)
  WINDOW a AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, max(pos) OVER b, list(line) OVER b, sum(n) OVER b FROM counted
  WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, s, e, min((doc_id, s)) OVER (PARTITION BY content) AS first FROM runs WHERE words >= 50
), cut AS (
  SELECT DISTINCT l.doc_id, l.pos FROM split l JOIN ranked r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.s AND r.e WHERE (r.doc_id, r.s) > r.first
), islands AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM cut) GROUP BY doc_id, g
), listed AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS runs, sum(b - a + 1) AS n FROM islands GROUP BY doc_id
)
SELECT d.doc_id, coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (c.pos IS NULL), '') AS text,
       count(*)::INTEGER AS n_lines, coalesce(any_value(i.n), 0)::INTEGER AS n_removed, coalesce(any_value(i.runs), '') AS runs
FROM documents d JOIN split s USING (doc_id) LEFT JOIN cut c ON c.doc_id = s.doc_id AND c.pos = s.pos LEFT JOIN listed i ON i.doc_id = d.doc_id
GROUP BY d.doc_id
"""
