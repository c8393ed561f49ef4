"""Line deduplication by winnowing over line hashes.  DataFrame functions only.

A document is a sequence of lines.  From each window of WINDOW consecutive line hashes the
smallest is selected as a fingerprint (winnowing), so two passages that share a whole window
share a selected fingerprint at the same place.  Fingerprints selected at one place only end
there.  At the others the windows are compared whole with all windows around the same
fingerprint: a window that already started earlier is a match, and matching windows that touch
extend it both ways to a maximal repeated run, which is deleted.  The first occurrence stays.

A line of LONG_WORDS words or more is a passage by itself and needs no neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.registry import query, table
from refrain.operators.settle import settle

WINDOW = 2
LONG_WORDS = 50


def _once(value: Column) -> Column:
    """Compute an array once: a generator over it is not copied into the expressions that use it."""
    return F.explode(F.array(value))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(rows: DataFrame, width: int, long_words: int) -> DataFrame:
    """(id, text_hash, line, length, anchor, content): every window, and every long line, that is not blank."""
    trimmed = lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))
    lines = rows.select("id", "text_hash", _once(F.transform(_lines(F.col("text")), trimmed)).alias("lines"))
    hashed = lines.select("id", "text_hash", "lines", _once(F.transform("lines", lambda x: F.xxhash64(x))).alias("hashes"))

    def window(i: Column, n: int | None) -> Column:
        length = F.lit(n)
        own = F.slice("lines", i + 1, length)
        return F.struct(
            i.cast("int").alias("line"),
            length.cast("int").alias("length"),
            F.array_min(F.slice("hashes", i + 1, length)).alias("anchor"),
            F.when(F.exists(own, lambda x: x != ""), F.unhex(F.md5(F.array_join(own, "\n")))).alias("content"),
        )

    places = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width)).otherwise(F.array().cast("array<int>"))
    long = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.size(F.split(F.get("lines", i), " ")) >= long_words)
    both = F.concat(F.transform(places, lambda i: window(i, width)), F.transform(long, lambda i: window(i, 1)))
    return hashed.select("id", "text_hash", F.explode(both).alias("w")).select("id", "text_hash", "w.*").where("content is not null")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per document row: id, n_lines, n_removed, n_runs, kept_text.

    Lines are compared with white space runs as one space and trimmed; kept lines stay as they
    are.  Null texts are empty texts: one empty line, kept.  Windows of blank lines are never
    repeats.  Earlier means a smaller id (null ids first, then by a hash of the text), or the
    same document and an earlier line; rows that repeat id and text are one document and lose
    the same lines.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    windows = settle(_windows(rows, width, long_words).distinct())
    place = F.struct("id", "text_hash", "line")

    anchors = windows.groupBy("anchor").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = settle(anchors.where(~F.col("first").eqNullSafe(F.col("last"))).select("anchor"))
    around = settle(windows.join(shared, "anchor", "left_semi"))
    firsts = around.groupBy("length", "content").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = settle(firsts.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = around.join(firsts, ["length", "content"]).where(~place.eqNullSafe(F.col("first")))

    order = Window.partitionBy("id", "text_hash").orderBy("line", "length")
    reach = F.max(F.col("line") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.coalesce(F.col("line") > reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy("id", "text_hash", "run").agg(F.min("line").alias("start"), F.max(F.col("line") + F.col("length")).alias("stop"))
    per_document = settle(runs.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs")))

    none = F.array().cast("array<struct<start:int,stop:int>>")
    theirs = per_document.withColumnsRenamed({"id": "r_id", "text_hash": "r_hash"})
    # Sorted on either side at every size: whether the runs would fit a broadcast depends on the data.
    joined = rows.join(theirs.hint("merge"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    cut = joined.select("id", "text", F.coalesce("runs", none).alias("runs"), _once(_lines(F.col("text"))).alias("lines"))
    froms = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["stop"]))
    tos = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(froms.alias("a"), tos.alias("b")), lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"])))
    return cut.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["start"])).alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


@query(
    "op10_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
        FROM documents
    ), t AS (
        SELECT doc_id, line, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS content FROM l
    ), pairs AS (
        SELECT doc_id, line, content, lead(content) OVER (PARTITION BY doc_id ORDER BY line) AS following FROM t
    ), w AS (
        SELECT doc_id, line, 2 AS n, content || chr(10) || following AS content FROM pairs WHERE following IS NOT NULL AND content || following <> ''
        UNION ALL
        SELECT doc_id, line, 1 AS n, content FROM t WHERE len(string_split(content, ' ')) >= 50
    ), later AS (
        SELECT doc_id, line, n FROM w QUALIFY row_number() OVER (PARTITION BY n, content ORDER BY doc_id, line) > 1
    ), gone AS (
        SELECT DISTINCT doc_id, line + i AS line FROM later, (VALUES (0), (1)) v(i) WHERE i < n
    ), flagged AS (
        SELECT t.*, g.line IS NOT NULL AS removed FROM t LEFT JOIN gone g USING (doc_id, line)
    ), edges AS (
        SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM flagged
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_runs,
           sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT removed), '')) AS kept_sha256
    FROM edges GROUP BY doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))
