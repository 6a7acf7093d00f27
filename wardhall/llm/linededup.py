"""Line dedup by distinct-site spread.

Every line's sites are counted with a HyperLogLog sketch that merges by aggregation.  A line well over the threshold
is boilerplate by its sketch; one near the threshold gets an exact distinct count.  Boilerplate lines leave every
document; only lines that owe their spread to whole copies of one text stay in those copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .shared import written

MIN_SITES = 10
#: Runs of blanks other than a single space.
_BLANKS = r" [ \t\r\f\x0B]+|[\t\r\f\x0B][ \t\r\f\x0B]*"
#: A line with more than this share of all lines is hot: at most 1000 are.
_HOT = 1000


def _line_key(line: Column) -> Column:
    """A line without outer blanks, each inner run of blanks as one space."""
    return F.trim(F.regexp_replace(line, _BLANKS, " "))


def hot_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that make up a thousandth of all or more: a thousand rows at most, so they may be broadcast."""
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return written(counts.filter(F.col("n") * _HOT >= lines.count()).select("h1", "h2"))


def matching(lines: DataFrame, keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose (h1, h2) is among ``keys``; hot lines are matched where they lie, only the others are dealt by key."""
    here = keys.join(F.broadcast(hot), ["h1", "h2"], "left_semi")  # no more than the hot ones
    apart = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(keys, ["h1", "h2"], "left_semi")
    return lines.join(F.broadcast(here), ["h1", "h2"], "left_semi").union(apart)


def boilerplate_lines(lines: DataFrame, min_sites: int, hot: DataFrame) -> DataFrame:
    """(h1, h2) of the lines found on ``min_sites`` sites or more; ``lines`` has h1, h2 and site.

    Sketches err by about 1.6 per cent, and hardly at all when small: lines within a tenth of the threshold, and
    within two sites, are counted exactly, from one row for each of their sites.
    """
    band = max(2.0, 0.1 * min_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("sites")).filter(F.col("sites") >= min_sites - band)
    spread = written(spread)
    near = spread.filter(F.col("sites") <= min_sites + band).select("h1", "h2")
    sites = matching(lines.select("h1", "h2", "site"), near, hot).filter("site is not null").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return written(spread.filter(F.col("sites") > min_sites + band).select("h1", "h2").union(exact.select("h1", "h2")))


def copied_rows(rows: DataFrame, min_sites: int) -> DataFrame:
    """(copy_id, copy_tag) of the rows whose whole text, blanks apart, is found on ``min_sites`` sites or more; ``rows`` has doc_id, tag, text and site."""
    whole = F.regexp_replace(_line_key(F.col("text")), " ?\n ?", "\n")
    texts = rows.filter("text <> ''").select("doc_id", "tag", "site", whole.alias("whole"))
    texts = written(texts.select("doc_id", "tag", "site", F.xxhash64("whole").alias("h1"), F.xxhash64(F.lit(1), "whole").alias("h2")))
    hot = hot_lines(texts)
    return matching(texts, boilerplate_lines(texts, min_sites, hot), hot).select(F.col("doc_id").alias("copy_id"), F.col("tag").alias("copy_tag")).distinct()


def _without_own_copies(cut: DataFrame, rows: DataFrame, min_sites: int, hot: DataFrame) -> DataFrame:
    """``cut`` without the lines of widely copied texts that are not on ``min_sites`` sites in other rows too."""
    copied = copied_rows(rows, min_sites)
    marked = written(cut.join(copied, cut["doc_id"].eqNullSafe(copied["copy_id"]) & (cut["tag"] == copied["copy_tag"]), "left").drop("copy_id"))
    apart = marked.filter("copy_tag is null")
    spread = boilerplate_lines(apart, min_sites, hot)
    return apart.drop("copy_tag").unionByName(matching(marked.filter("copy_tag is not null").drop("copy_tag"), spread, hot).select(*apart.drop("copy_tag").columns))


def deduplicated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``row`` (all columns of ``docs`` as c0, c1, ...), doc_id, kept_text, n_lines, n_removed, removed_chars.

    Every non-empty line is judged, however short and in whatever script, and every row loses its boilerplate lines,
    whatever their share of it; but a line of a text that is itself on ``min_sites`` sites goes from there only if it is
    on as many in rows that are no such copies.  A null text has no lines and stays null; an empty text is one empty line.  Lines of
    rows with a null site count for no site.  Equal rows get equal results, rows with the same id stay apart, a null id
    is kept, an empty table gives no rows, and columns of any name pass through in ``row``.  A text of any length is split
    whole, once: its lines' hashes are written, and all counts and joins read those.
    """
    names = docs.columns
    whole = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), docs[key].alias("doc_id"), docs[text].alias("text"), docs[site].cast("string").alias("site"), F.xxhash64(docs[text], docs[key]).alias("tag")
    )
    lines = whole.select("doc_id", "tag", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "tag", "site", "pos", F.length("line").alias("chars"), F.explode(F.array(_line_key(F.col("line")))).alias("line")).filter("line <> ''")  # a generator, so that filters don't work the key out again
    lines = written(lines.select("doc_id", "tag", "site", "pos", "chars", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    hot = hot_lines(lines)
    cut = _without_own_copies(matching(lines, boilerplate_lines(lines, min_sites, hot), hot), whole, min_sites, hot)
    cut = cut.select("doc_id", "tag", "pos", "chars").distinct()
    cut = cut.groupBy(F.col("doc_id").alias("cut_id"), F.col("tag").alias("cut_tag")).agg(F.collect_list("pos").alias("cut"), F.sum("chars").alias("cut_chars"))
    both = whole.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left")
    take = F.col("cut").isNotNull()
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("cut", i)), "\n")
    return both.select(
        "row", "doc_id", F.when(take, kept).otherwise(F.col("text")).alias("kept_text"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(take, F.size("cut")).otherwise(0).cast("long").alias("n_removed"), F.when(take, F.col("cut_chars")).otherwise(0).cast("long").alias("removed_chars"),
    )


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with its columns, boilerplate lines taken out of the text; ``size``, if there, follows the text."""
    found = deduplicated_lines(docs, key, text, site)
    out = []
    for i, c in enumerate(docs.columns):
        col = F.col(f"row.c{i}")
        if c == text:
            col = F.col("kept_text")
        elif c == size:
            col = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(col)
        out.append(col.alias(c))
    return found.select(*out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed_chars", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text, trim(regexp_replace(text, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS flat FROM documents),
w AS (SELECT r, source, regexp_replace(flat, ' ?\\n ?', chr(10), 'g') AS whole FROM docs WHERE text <> ''),
copied AS (SELECT r FROM w WHERE whole IN (SELECT whole FROM w GROUP BY whole HAVING count(DISTINCT source) >= {MIN_SITES})),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL),
k AS (SELECT l.*, trim(regexp_replace(line, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS key, r IN (SELECT r FROM copied) AS copy FROM l),
b AS (SELECT key, count(DISTINCT source) >= {MIN_SITES} AS anywhere, count(DISTINCT source) FILTER (NOT copy) >= {MIN_SITES} AS apart FROM k WHERE key <> '' GROUP BY key),
m AS (SELECT k.*, coalesce(CASE WHEN copy THEN apart ELSE anywhere END, false) AS cut FROM k LEFT JOIN b ON k.key = b.key),
d AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(sum(length(line)) FILTER (cut), 0) AS removed_chars, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut) AS kept
  FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN d USING (r)
"""
