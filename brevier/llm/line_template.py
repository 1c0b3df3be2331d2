"""Line dedup with a fixed-depth template tree.

A line descends by its token count and its first ``DEPTH`` tokens, where a token with a
digit, an ``@`` or ``://`` is a variable field.  A line's leaf is the first of these that
``MIN_DOCS`` different texts reach: all leading tokens, or all but one, the one that varies
being a wildcard child (last, middle, first).  Inside a leaf a token is part of a template
where it stands in the same place of ``MIN_DOCS`` lines; every other place is variable.  So
a leaf has as many templates as its lines have patterns of fixed tokens.  A line carries its
template if ``SIMILARITY`` of all its places, and of the places after the leading ones, are
fixed words.  Besides, a line of any length is a template of its own, word for word.

Templates found in ``MIN_DOCS`` or more different texts, and whole lines of ``LONG`` words
or more found in two, are dropped from all documents but the first (smallest doc_id) that
has them.  Exact copies of a text count once, so copies alone make nothing recur.

Texts are split once; lines travel without the text they come from.

Defined cases: a null text has no lines and stays null; lines without a word stay; a null
doc_id is its own id and comes last; rows that repeat doc_id and text are treated alike; a
line that carries several recurring templates stays only where it is the first of each; no
rows give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

DEPTH, MIN_DOCS, MIN_WORDS, SIMILARITY, LONG = 3, 10, 4, 0.6, 50
#: Rows of leaves, fixed tokens or recurring templates (8 to 40 bytes each) sent to every task; more are joined by a shuffle.
MOST_BROADCAST = 500_000
FIELD = "[0-9@]|://"
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
ENDS = " \t\x0b\x0c\r"


def _masked(token: Column) -> Column:
    return F.when(token.rlike(FIELD), F.lit("<*>")).otherwise(token)


#: Stands for a null doc_id, which comes last.
LAST = (1 << 63) - 1


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be sent to every task if it has few rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def split_lines(docs: DataFrame) -> DataFrame:
    """Written: doc_id, h (of the text), i, line, n (words), k1 and k2 (of the line), leaves
    (that it may belong to, null if short) for every line with a word."""
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    rows = split.select("doc_id", "h", F.posexplode("lines").alias("i", "line"))
    rows = rows.select("doc_id", "h", "i", F.btrim("line", F.lit(ENDS)).alias("line")).where("line <> ''")
    rows = rows.withColumn("n", F.regexp_count("line", F.lit(f"{WORD}++")))
    lead = rf"^({WORD}++){BLANK}++({WORD}++){BLANK}++({WORD}++)"
    a, b, c = (_masked(F.regexp_extract("line", lead, k)) for k in (1, 2, 3))
    any_ = F.lit("<any>")
    leaves = F.array(*[F.xxhash64("n", *path) for path in ((a, b, c), (a, b, any_), (a, any_, c), (any_, b, c))])
    # the last bit of k2 says that two texts are enough
    long = F.shiftleft(F.hash("line").cast("long"), 1).bitwiseOR((F.col("n") >= LONG).cast("long"))
    rows = rows.withColumns({
        "k1": F.xxhash64("line"), "k2": long, "leaves": F.when(F.col("n") >= MIN_WORDS, leaves),
    })
    return scratch.save(rows, "lines")


def lines_in_leaves(lines: DataFrame) -> DataFrame:
    """Written: doc_id, h, i, n, leaf, line of the lines whose leaf recurs."""
    ways = lines.where("leaves IS NOT NULL").select("h", F.explode("leaves").alias("leaf")).distinct()
    hot = ways.groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_DOCS).select("leaf")
    hot = scratch.save(hot, "line-leaves")
    kept = ("doc_id", "h", "i", "n", "leaf", "line")
    rows = lines.where("leaves IS NOT NULL")
    if hot.count() <= MOST_BROADCAST:
        for k in range(DEPTH + 1):
            one = F.broadcast(hot.select(F.col("leaf").alias(f"way{k}")))
            rows = rows.withColumn(f"at{k}", F.get("leaves", F.lit(k))).join(one, F.col(f"at{k}") == F.col(f"way{k}"), "left")
        rows = rows.withColumn("leaf", F.coalesce(*[F.col(f"way{k}") for k in range(DEPTH + 1)]))
        return scratch.save(rows.where("leaf IS NOT NULL").select(*kept), "line-candidates")
    at = F.struct("doc_id", "h", "i").alias("at")
    ways = rows.select(at, F.posexplode("leaves").alias("way", "leaf")).join(hot, "leaf")
    ways = ways.groupBy("at").agg(F.min(F.struct("way", "leaf")).alias("best")).select("at", "best.leaf")
    rows = rows.select("*", at).join(ways, "at")
    return scratch.save(rows.select(*kept).dropDuplicates(["doc_id", "h", "i"]), "line-candidates")


def templates(lines: DataFrame) -> DataFrame:
    """k1, k2 (of the template), doc_id, h, i of the lines that carry one."""
    tokens = F.transform(F.split("line", f"{BLANK}+"), _masked)
    places = lines.select("doc_id", "h", "i", "n", "leaf", F.posexplode(tokens).alias("place", "token")).where("token <> '<*>'")
    places = places.select("doc_id", "h", "i", "n", "leaf", "place", F.xxhash64("leaf", "place", "token").alias("key"))
    places = scratch.save(places, "line-places")
    common = places.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") >= MIN_DOCS).select("key")
    fixed = places.join(_small(scratch.save(common, "line-fixed")), "key").groupBy("doc_id", "h", "i", "n", "leaf")
    found = fixed.agg(
        F.expr("shiftleft(bit_xor(key), 1)").alias("k2"), F.count("*").alias("words"), F.sum((F.col("place") >= DEPTH).cast("long")).alias("after"),
    )
    alike = (F.col("words") >= SIMILARITY * F.col("n")) & (F.col("after") >= SIMILARITY * (F.col("n") - DEPTH))
    return found.where(alike).select(F.col("leaf").alias("k1"), "k2", "doc_id", "h", "i")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, i of the lines to drop; a line may come twice."""
    lines = split_lines(docs)
    candidates = lines_in_leaves(lines)
    keys = scratch.save(templates(candidates).select("k1", "k2", "doc_id", "h", "i"), "line-templates")
    keys = lines.select("k1", "k2", "doc_id", "h", "i").unionByName(keys)
    who = F.coalesce("doc_id", F.lit(LAST))
    each = keys.groupBy("k1", "k2", "h").agg(F.min(who).alias("who"))
    met = each.groupBy("k1", "k2").agg(F.count("*").alias("texts"), F.min(F.struct("who", "h")).alias("first"))
    met = met.where(F.col("texts") >= F.when(F.col("k2").bitwiseAND(1) == 1, 2).otherwise(MIN_DOCS))
    met = scratch.save(met.select("k1", "k2", F.col("first.who").alias("first_who"), F.col("first.h").alias("first_h")), "line-recurring")
    gone = keys.join(_small(met), ["k1", "k2"]).where((who != F.col("first_who")) | (F.col("h") != F.col("first_h")))
    gone = scratch.save(gone.select("doc_id", "h", "i"), "line-gone")
    scratch.drop(lines, candidates, met)
    return gone


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` in ``doc``, with n_lines, n_dropped and the remaining ``clean_text``."""
    key = lambda: F.struct("doc_id", "h").alias("line_key")
    drops = recurring_lines(docs).groupBy(key()).agg(F.collect_set("i").alias("gone"))
    drops = scratch.save(drops, "line-drops")
    rows = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("line_key"))
    out = rows.join(drops, "line_key", "left").withColumn("lines", F.split("doc.text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.concat_ws("\n", F.transform(stay, lambda i: F.get("lines", i)))
    return out.select(
        "doc",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left).alias("clean_text"),
    )
