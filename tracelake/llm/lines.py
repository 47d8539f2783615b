"""Line dedup by content-defined chunks of lines, in DataFrame functions alone.

A document's lines are hashed, and a rolling hash over the hashes of two neighbouring lines says where it is cut: before
line i if the hash of lines i-1 and i falls into the chunking's residue class. There is one chunking for each residue of
CLASSES; where one cuts, the others don't, so that together they have multi-line chunks all through a passage, wherever
it stands. At the edges of a passage the cut depends on what stands beside it; so, besides, for every line that isn't
blank the fewest lines with over LONG words that start with it are taken, and the fewest that end with it. In a passage
with over LONG words the chunk that starts with its first line lies inside, and for each line after that chunk so does
the one that ends with it. Therefore every passage of whole lines with over LONG words that repeats is found whole, but
for blank lines at its ends, and most of shorter multi-line ones.

A chunk hash that occurs more than once in the corpus is looked up again with its bytes; if all chunks of that hash have
the same bytes, every occurrence but the first (by doc_id, text hash and line) is removed. Chunks whose hash stands for
different bytes are left alone. What is removed always remains elsewhere: its first occurrence loses a line only to a
chunk that occurs still earlier.

Only hashes are counted over all chunks; texts move only for repeated ones. Grouping is by hash with map-side partial
sums, so a chunk with a third of all occurrences is no heavier than another.

The chunks of over LONG words may be one long line; with long=False only the content-defined chunks, of two lines and
more, are taken.

Null texts stay null. Lines end at line feeds; other characters belong to the line. Rows that repeat id and text are one
document: none loses text to the other. Null ids sort first. Documents whose lines all go keep an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, restored, stored, table

CLASSES, LONG = 2, 50
#: Colliding hashes up to this number are left out by a list, more by a join.
FEW = 1000


def _words(line: Column) -> Column:
    """Words of a line, by its spaces; none in a blank one."""
    return F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reach(counts: Column, k: Column, most: int) -> Column:
    """struct<sum, n>: how many of the up to `most` counts from place k on add up to over LONG, and their sum; null if all together don't."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    done = F.aggregate(F.slice(counts, k + 1, F.lit(most)), start, lambda a, c: F.when(a["sum"] > LONG, a).otherwise(F.struct((a["sum"] + c).alias("sum"), (a["n"] + 1).alias("n"))))
    return F.when(done["sum"] > LONG, done)


def chunks(lines: Column, classes: int = CLASSES, long: bool = True) -> Column:
    """array<struct<s, e, h>> of the candidates: lines s to e - 1 (from 0) and the hash of their hashes."""

    def hashed(spans: Column, hashes: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(F.slice(hashes, x["s"] + 1, x["e"] - x["s"])).alias("h")))

    def cut_up(hashes: Column, n: Column, rest: int) -> Column:
        def cut(i: Column) -> Column:
            return (i == 0) | (F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(classes)) == rest)

        def spans(starts: Column) -> Column:
            all_ = F.transform(starts, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(starts, k + 1), n).alias("e")))
            return hashed(F.filter(all_, lambda x: x["e"] - x["s"] >= 2), hashes)

        return _let(F.filter(F.sequence(F.lit(0), n - 1), cut), spans)

    def over_long(hashes: Column, counts: Column) -> Column:
        # Lines that aren't blank have a word each, so LONG + 1 of them always reach over LONG.
        some = F.filter(F.transform(counts, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] > 0)

        def found(rows: Column, back: bool) -> Column:
            number = F.struct(F.transform(rows, lambda x: x["i"]).alias("i"), F.transform(rows, lambda x: x["c"]).alias("c"))

            def spans(v: Column) -> Column:
                ends = F.transform(v["i"], lambda i, k: F.struct(i.alias("i"), F.get(v["c"], k).alias("c"), k.alias("k"), F.coalesce(_reach(v["c"], k, 6), _reach(v["c"], k, LONG + 1)).alias("r")))
                # A chunk that isn't over LONG without its last line is among those by first line already.
                ends = F.filter(ends, lambda x: x["r"].isNotNull() & (x["r"]["sum"] - x["c"] > LONG) if back else x["r"].isNotNull())
                far = lambda x: F.get(v["i"], x["k"] + x["r"]["n"] - 1)
                return F.transform(ends, lambda x: F.struct((far(x) if back else x["i"]).alias("s"), ((x["i"] if back else far(x)) + 1).alias("e")))

            return _let(number, spans)

        def spans(rows: Column) -> Column:
            return hashed(F.concat(found(rows, False), _let(F.reverse(rows), lambda r: found(r, True))), hashes)

        return _let(some, spans)

    marks = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).alias("c")))
    parts = lambda m: F.struct(F.transform(m, lambda x: x["h"]).alias("h"), F.transform(m, lambda x: x["c"]).alias("c"), F.size(m).alias("n"))
    return _let(marks, lambda m: _let(parts(m), lambda v: F.array_distinct(F.concat(*(cut_up(v["h"], v["n"], r) for r in range(classes)), *([over_long(v["h"], v["c"])] if long else [])))))


def marked(docs: DataFrame, classes: int = CLASSES, long: bool = True) -> DataFrame:
    """The same rows with `_spans`, array<struct<s, e, h, gone>>: the document's repeated chunks; gone: it isn't the chunk's first occurrence."""
    found = stored(docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.inline(chunks(F.split("text", "\n"), classes, long))))
    place = F.struct("doc_id", "th", "s")
    twice = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "first")
    spans = found.join(twice, "h").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.struct("s", "e", "h", (place != F.col("first")).alias("gone")).alias("x"))
    spans = spans.groupBy("_d", "_t").agg(F.collect_set("x").alias("_spans"))
    return docs.join(spans, docs["doc_id"].eqNullSafe(spans["_d"]) & (F.xxhash64(docs["text"]) == spans["_t"]), "left").drop("_d", "_t")


def collisions(rows: DataFrame) -> DataFrame:
    """Hashes of repeated chunks that stand for different bytes, by comparing the bytes of all occurrences."""
    lines = F.split("text", "\n")
    chunk = _let(lines, lambda l: F.transform("_spans", lambda x: F.struct(x["h"].alias("h"), F.array_join(F.slice(l, x["s"] + 1, x["e"] - x["s"]), "\n").alias("chunk"))))
    bytes_ = rows.where("_spans IS NOT NULL").select(F.inline(chunk))
    return bytes_.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")


def dedup_lines(docs: DataFrame, classes: int = CLASSES, removed: str | None = "lines_removed", long: bool = True) -> DataFrame:
    """The same rows with repeated chunks cut out of `text`, and how many lines went, under the name `removed` if it is given; a column of that name is replaced."""
    own = ("doc_id", "text")
    docs = docs.drop(removed) if removed else docs
    rows = stored(marked(docs.select(*numbered(docs, own)), classes, long))
    odd = collisions(rows).limit(FEW + 1).collect()
    if len(odd) > FEW:
        bad = collisions(rows)
        left = rows.where("_spans IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.inline("_spans")).join(bad, "h", "left_anti")
        left = left.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("s", "e", "h", "gone")).alias("_spans"))
        rows = rows.drop("_spans").join(left, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left").drop("_d", "_t")
    skip = F.array(*(F.lit(r["h"]) for r in odd[:FEW])).cast("array<long>") if 0 < len(odd) <= FEW else None
    gone = F.filter("_spans", lambda x: x["gone"] & ~F.array_contains(skip, x["h"]) if skip is not None else x["gone"])
    lines = F.split("text", "\n")
    kept = _let(F.struct(lines.alias("l"), gone.alias("g")), lambda v: F.filter(v["l"], lambda x, i: ~F.exists(v["g"], lambda r: (i >= r["s"]) & (i < r["e"]))))
    cut = F.when(F.size(gone) > 0, F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n"))).otherwise(F.struct(F.col("text").alias("text"), F.lit(0).alias("n")))
    out = rows.withColumn("_cut", cut)
    return out.withColumn("text", F.col("_cut.text")).select(*restored(docs, own), *([F.col("_cut.n").alias(removed)] if removed else []))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def characters(text: str) -> Column:
    return F.length(text).cast("long")
