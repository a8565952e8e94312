"""Deletion of later copies of repeated line runs, by a suffix array over line ranks.

DataFrame operations only. The array is built by prefix doubling: level a ranks every suffix
by its first 2**a lines, level a + 1 by the pair (rank here, rank 2**a lines on). Suffixes of
equal rank are an interval of the array whose longest common prefix is 2**a at least; an
interval of any other depth is named by the two ranks that overlap to cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, Settled, meet

_DOC, _NAME = ["doc", "h"], ["name", "name2"]


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc", "h", "pos", F.xxhash64("line").alias("name"), F.xxhash64(F.lit("line"), "line").alias("name2"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))


def _below(counts: DataFrame, group: str, by: str, n: str, width: int) -> DataFrame:
    """counts with below: the sum of n over the rows of the same group with a smaller ``by``.

    Groups are cut into ranges of ``width`` of by; ranges are summed first, so a group with very
    many rows is not added up in one task.
    """
    at = counts.withColumn("range", F.floor(F.col(by) / width))
    sums = at.groupBy(group, "range").agg(F.sum(n).alias("in_range"))
    before = sums.withColumn("base", F.sum("in_range").over(Window.partitionBy(group).orderBy("range")) - F.col("in_range")).drop("in_range")
    inner = F.sum(n).over(Window.partitionBy(group, "range").orderBy(by)) - F.col(n)
    return at.withColumn("inner", inner).join(before, [group, "range"]).withColumn("below", F.col("base") + F.col("inner")).drop("range", "inner", "base")


def _ranks(names: DataFrame) -> DataFrame:
    """names(name, name2, n) with rank: how many suffixes begin with a smaller name.

    Names are uniform hashes, so their top 12 bits deal them into 4096 even, ordered buckets;
    only the buckets' sums meet in one task.
    """
    at = names.withColumn("bucket", F.shiftright("name", 52))
    sums = at.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("bucket").orderBy(*_NAME)) - F.col("n")
    return at.withColumn("inner", inner).join(F.broadcast(before), "bucket").select(*_NAME, "n", (F.col("base") + F.col("inner")).alias("rank"))


def _doubled(suffixes: DataFrame, step: int, total: int) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes that some other suffix still equals.

    Of the names that follow a rank, only those that follow it more than once are counted:
    their places stay below the number of suffixes of that rank, so ranks stay distinct and in order.
    """
    right = suffixes.select("sid", (F.col("off") - step).alias("off"), F.col("rank").alias("next"))
    pairs = suffixes.join(right, ["sid", "off"])
    sizes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    new = _below(sizes, "rank", "next", "n", max(1, total // HOT)).select("rank", "next", "n", (F.col("rank") + F.col("below")).alias("new"))
    return pairs.join(new, ["rank", "next"]).select("sid", "off", F.col("new").alias("rank"))


def repeated_runs(docs: DataFrame, settle: Settled, min_words: int = 50) -> DataFrame:
    """(doc, h, first, last): the maximal runs of lines of docs(doc, text) to delete.

    A run of consecutive lines counts if it has ``min_words`` words and occurs before, in the
    order of (doc, hash of the text, line); occurrences may overlap. Lines are equal if their
    bytes are (by two 64-bit hashes; 1e11 lines have a chance of 1e-17 that two unlike ones
    agree). ``first`` and ``last`` count lines from 0.
    """
    settle = settle.part()
    lines = settle(_lines(docs).dropDuplicates([*_DOC, "pos"]))
    often = settle(lines.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = meet(lines, often, _NAME, lines.count()).drop("n")
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    kept = settle(kept.withColumn("run", F.col("pos") - F.row_number().over(by_doc)))
    # A stretch of lines that each occur elsewhere; a repeated run lies within one.
    marks = [F.bit_xor(F.xxhash64(*_NAME, F.col("pos") - F.col("start"), F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    starts = kept.groupBy(*_DOC, "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("len"), F.sum("words").alias("total")).where(F.col("total") >= min_words)
    placed = settle(_null_safe(kept, starts, [*_DOC, "run"]))
    whole = settle(placed.groupBy(*_DOC, "start", "len").agg(*marks))
    place = F.struct(*_DOC, "start")
    first = settle(whole.groupBy("len", "m1", "m2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")))
    whole = settle(whole.join(first, ["len", "m1", "m2"]).withColumn("copy", ~place.eqNullSafe(F.col("at"))))
    copies = whole.where("copy").select(*_DOC, F.col("start").alias("pos"), "len")

    unique = settle(whole.where("not copy").select(*_DOC, "start", "len", F.monotonically_increasing_id().alias("sid")))
    line = _null_safe(placed.select(*_DOC, "start", "pos", *_NAME, "words"), unique.select(*_DOC, "start", "sid"), [*_DOC, "start"])
    line = settle(line.select("sid", (F.col("pos") - F.col("start")).alias("off"), *_NAME, "words"))
    # Words before each line of a stretch, and after its last: the places where a window can end.
    ends = unique.select("sid", F.col("len").alias("off"), F.lit(0).alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("off")) - F.col("words")
    places = line.select("sid", "off", "words").unionByName(ends).withColumn("before", before)
    far = Window.partitionBy("sid").orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words)
    near = Window.partitionBy("sid").orderBy("before").rangeBetween(Window.unboundedPreceding, -min_words)
    shortest = places.select("sid", "off", F.min("off").over(far).alias("to"), F.max("off").over(near).alias("from"))
    spans = shortest.select("sid", F.explode(F.array(F.struct("off", F.col("to")), F.struct(F.col("from").alias("off"), F.col("off").alias("to")))).alias("s"))
    spans = spans.select("sid", "s.off", (F.col("s.to") - F.col("s.off")).alias("len")).where("off is not null and len is not null").distinct()
    spans = settle(spans.withColumn("level", F.floor(F.log2(F.col("len").cast("double"))).cast("int")))
    top = spans.agg(F.max("level")).first()[0]

    rank = settle(_ranks(line.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("n"))))
    total = line.count()
    suffixes = settle(meet(line.select("sid", "off", *_NAME), rank, _NAME, total).select("sid", "off", "rank"))
    found = [copies]
    level = 0
    while top is not None and level <= top:
        here = spans.where(F.col("level") == level).join(suffixes, ["sid", "off"])
        tail = suffixes.select("sid", (F.col("off") + F.lit(1 << level)).alias("end"), F.col("rank").alias("tail"))
        here = here.withColumn("end", F.col("off") + F.col("len")).join(tail, ["sid", "end"])
        here = _place(here.select("sid", "off", "len", "rank", "tail"), unique)
        here = settle(here)
        interval = settle(here.groupBy("len", "rank", "tail").agg(F.min(F.struct(*_DOC, "pos")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        later = here.join(interval, ["len", "rank", "tail"]).where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("at")))
        found.append(settle(later.select(*_DOC, "pos", "len")))
        level += 1
        if level <= top:
            suffixes = settle(_doubled(suffixes, 1 << (level - 1), total))
            if suffixes.isEmpty():
                break
    gone = found[0]
    for more in found[1:]:
        gone = gone.unionByName(more)
    return settle.last(_islands(gone))


def _place(spans: DataFrame, unique: DataFrame) -> DataFrame:
    return spans.join(unique.select("sid", *_DOC, "start"), "sid").withColumn("pos", F.col("start") + F.col("off"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet, keeping a's columns and those that b adds."""
    b = b.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"r_{k}"])
    return a.join(b, on, how).drop(*[f"r_{k}" for k in keys])


def _islands(spans: DataFrame) -> DataFrame:
    """Unions of spans that overlap or touch."""
    order = Window.partitionBy(*_DOC).orderBy("pos", "len")
    reach = F.max(F.col("pos") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("reach", reach).withColumn("new", F.when(F.col("reach") >= F.col("pos"), 0).otherwise(1))
    grouped = marked.withColumn("island", F.sum("new").over(order))
    return grouped.groupBy(*_DOC, "island").agg(F.min("pos").alias("first"), (F.max(F.col("pos") + F.col("len")) - 1).alias("last")).drop("island")


def line_dedup(docs: DataFrame, settle: Settled, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with ``text_col`` less its later copies of repeated line runs, and what was done.

    Adds ``ld_lines`` (before), ``ld_removed`` and ``ld_runs`` (array of struct<first, last>);
    columns of those names are replaced, all others pass through. A null text stays null with 0
    lines; an empty text is one line without words. A text of which all goes becomes ''. Of
    equal texts the one of the smallest id keeps its lines (null ids come first); rows that
    repeat both id and text are one document and are treated alike.
    """
    docs = docs.drop("ld_lines", "ld_removed", "ld_runs")
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(source, settle, min_words).groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ld_runs"))
    runs = runs.withColumnsRenamed({"doc": "ld_doc", "h": "ld_h"})
    # A merge join at every size: what it moves is in proportion to the texts.
    out = docs.hint("merge").join(runs, docs[id_col].eqNullSafe(runs["ld_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == runs["ld_h"]), "left").drop("ld_doc", "ld_h")
    split = F.split(F.col(text_col).cast("string"), "\n")
    keep = F.filter(split, lambda x, i: ~F.exists("ld_runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    gone = F.aggregate("ld_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    hit = F.col("ld_runs").isNotNull()
    return out.select(
        *[F.when(hit, F.array_join(keep, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).alias("ld_lines"),
        F.when(hit, gone).otherwise(0).alias("ld_removed"),
        F.coalesce("ld_runs", F.array().cast("array<struct<first:int,last:int>>")).alias("ld_runs"),
    )
