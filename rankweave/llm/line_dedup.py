"""Boilerplate lines: how many distinct sites a line is on, by merged sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, text_key

#: a line on so many distinct sites is boilerplate
MIN_SITES = 10
#: 2^12 registers: a relative standard error of 1.6 %
LOG2_REGISTERS = 12
#: a sketch this close to the threshold is not trusted (15 standard errors)
BAND = 0.25

BREAK = "\n"


def line_rows(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(key1, key2, site, pos, line1, line2) for every line that isn't blank; 128-bit line hash."""
    rows = docs.select(
        *text_key(F.col(text_col)),
        F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), BREAK)).alias("pos", "line"),
    ).where(F.trim("line") != "")
    return rows.select("key1", "key2", "site", "pos", *text_key(F.col("line"), "line"))


def spread_lines(
    lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, registers: int = LOG2_REGISTERS
) -> DataFrame:
    """(line1, line2) of the lines on at least `min_sites` distinct sites; null is no site.

    Every task sketches the sites of its lines, the sketches of a line merge in the aggregation,
    so a line that a third of all rows carry moves as one sketch a task. Estimates further than
    `band` from the threshold decide; the lines between get an exact distinct count.
    """
    sketch = F.hll_sketch_agg("site", registers)
    spread = cut_lineage(
        lines.groupBy("line1", "line2")
        .agg(F.hll_sketch_estimate(sketch).alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - band))
    )
    clear = spread.where(F.col("sites") > min_sites * (1 + band)).select("line1", "line2")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line1", "line2")
    # distinct first, combined map-side: a hot line meets the join with one row a site
    exact = (
        lines.where("site IS NOT NULL")
        .select("line1", "line2", "site")
        .distinct()
        .join(near, ["line1", "line2"], "left_semi")
        .groupBy("line1", "line2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line1", "line2")
    )
    return clear.union(exact)


def remove_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    band: float = BAND,
    registers: int = LOG2_REGISTERS,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """`docs` with every line removed that is on at least `min_sites` distinct sites.

    Lines end at a line feed and are compared as they stand. Blank lines belong to the layout
    and stay; every copy of a boilerplate line goes. A text of which no line is left becomes
    empty, a null text stays null, rows and other columns stay as they are. `counts` names two
    more columns: lines of the text (null: 0) and lines removed.

    Texts are matched by their hash, so equal texts share one decision list and ids are not
    needed. Only hashes and positions are shuffled, and each text once.
    """
    lines = line_rows(docs, site_col, text_col)
    bad = cut_lineage(spread_lines(lines, min_sites, band, registers))
    marked = lines.join(bad.withColumn("hit", F.lit(True)), ["line1", "line2"])
    # which of a text's lines go: one array a text, whatever the number of its copies
    gone = marked.groupBy("key1", "key2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    n_lines, n_gone = counts or (fresh(docs, "n_lines"), fresh(docs, "n_removed"))
    k1, k2, at = (fresh(docs, n) for n in ("text_key1", "text_key2", "gone_lines"))
    gone = gone.toDF(k1, k2, at)
    keyed = docs.select(
        "*", *[c.alias(n) for c, n in zip(text_key(F.col(text_col)), (k1, k2))]
    ).join(gone, [k1, k2], "left")
    parts = F.split(text_col, BREAK)
    # the kept stretches between removed positions, each cut out in one step
    stops = F.concat(F.col(at), F.array(F.size(parts)))
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + 1))
    spans = F.arrays_zip(starts.alias("s"), stops.alias("e"))
    kept = F.flatten(
        F.transform(spans, lambda x: F.slice(parts, x["s"] + 1, x["e"] - x["s"]))
    )
    text = F.when(F.col(at).isNull(), F.col(text_col)).otherwise(F.array_join(kept, BREAK))
    made = keyed.withColumns(
        {
            text_col: text,
            n_lines: F.coalesce(F.size(parts), F.lit(0)).cast("long"),
            n_gone: F.coalesce(F.size(at), F.lit(0)).cast("long"),
        }
    )
    return made.select(*docs.columns, *(counts or ()))
