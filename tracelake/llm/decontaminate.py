"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions alone.

Words are runs of other than white space, lower-cased; shingles are five words with repeats, or the whole sequence if
there are fewer. A document is contaminated by an item if some window of the item's number of words has a weighted
Jaccard similarity of at least SIMILARITY with it: the sum over shingles of the smaller count by that of the larger.

1. Anchors keep documents that can't match from being cut into windows, without losing one that can. A window that
   similar lacks at most a fifth of the item's shingle places. A word that the window lacks takes with it all
   shingles that hold it, five if it stands four words from either end; so of enough words five apart, one must be in
   the window. Each item's anchors are words that satisfy this, of those the ones that fewest documents of a bounded
   sample have; the sample decides the choice only, any choice loses nothing. Documents are asked for anchors through
   a bitmap of MARKS bits, as large for any benchmark; what it lets through by accident costs time only.
2. In documents with an anchor the shingles that are an item's give the windows to look at: each start that lines up
   such a shingle with its place in the item, and those up to a fifth of the item's shingles to either side, since
   words put in or left out shift the window by one each. Words are hashed once, shingles are hashes of word hashes.
   Documents with fewer than four fifths of an item's shingles have no window for it.
3. Each window gets a SimHash of its shingles; windows with the same words are one. Its 64 bits and the item's are cut
   into BLOCKS blocks. Two fingerprints within RADIUS bits are within some block's threshold, which add up to RADIUS less
   three, so the item's side asks with all values within so many bits of each of its blocks, and joining on (words, block
   number, value) finds all pairs within RADIUS.
4. Windows within RADIUS bits are cut out of their texts again and verified by the exact similarity of their shingles.
   RADIUS is two standard deviations and more above the distance that similarity 0.8 has on average (9.7 bits).

Texts are stored and moved, never their words: a window is its document, start and length. Null texts and empty items
match nothing. Rows that repeat id and text are one document. Items with equal texts are all reported.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .lines import _let

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 18, 4
BITS = 64
#: Bits of the anchors' map, and about how many documents the anchors' choice is made by.
MARKS, SAMPLE = 1 << 18, 4096
SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Space-joined shingles of an array of words; the array is read several times, so it should be a column."""
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.when(F.size(w) > 0, F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(h: Column, k: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of word hashes, which is read several times; beyond its end are nulls, which a hash passes over."""
    places = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
    return F.when(F.size(h) > 0, F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))).otherwise(F.array().cast("array<long>"))


def simhash(windows: DataFrame, hashes: str, keys: list[str]) -> DataFrame:
    """keys and fp of each row; `hashes` are its shingles' hashes. Two bits of a hash are spread over two 32-bit counters of a long, so 32 sums count all 64 bits of more shingles than an array can have."""

    def spread(part: int) -> Column:
        two = F.shiftrightunsigned("h", 2 * part)
        low, high = two.bitwiseAND(F.lit(1).cast("long")), F.shiftright(two, 1).bitwiseAND(F.lit(1).cast("long"))
        return F.sum(low.bitwiseOR(F.shiftleft(high, 32))).alias(f"c{part}")

    sums = windows.select(*keys, F.explode(hashes).alias("h")).groupBy(*keys).agg(*(spread(p) for p in range(32)), F.count("*").alias("_n"))
    fp = F.lit(0).cast("long")
    for p in range(32):
        for i in range(2):
            count = F.shiftrightunsigned(f"c{p}", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("_n"), F.lit((1 << (2 * p + i)) - (1 << 64 if 2 * p + i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def blocks_of(fp: Column, blocks: int = BLOCKS) -> Column:
    """array<struct<block, value>>"""
    width = BITS // blocks
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value")) for k in range(blocks)))


def within(width: int, bits: int) -> list[int]:
    """All numbers of `width` bits of which at most `bits` are set."""
    return [sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(width), n)]


def longs(numbers: list[int]) -> Column:
    """An array of 64-bit numbers, from one literal that Catalyst folds."""
    signed = " ".join(str(x - (1 << 64) if x >> 63 else x) for x in numbers)
    return F.split(F.lit(signed), " ").cast("array<long>") if numbers else F.array().cast("array<long>")


def thresholds(radius: int, blocks: int = BLOCKS) -> list[int]:
    """How many bits may differ in each block so that two fingerprints within the radius are within one of them: were all exceeded, radius + 1 bits would differ."""
    return [(radius + 1) // blocks + (k < (radius + 1) % blocks) - 1 for k in range(blocks)]


def near(fps: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(n, w, item_id, hamming) of all windows (n, w, fp) and items (item_id, n, fp) of one length within `radius` bits."""
    masks = F.array(*(longs(within(BITS // blocks, t) if t >= 0 else []) for t in thresholds(radius, blocks)))
    left = fps.select("n", "w", "fp", F.inline(blocks_of(F.col("fp"), blocks)))
    asked = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.inline(blocks_of(F.col("fp"), blocks)))
    asked = asked.select("item_id", "n", "item_fp", "block", F.explode(F.transform(F.get(masks, F.col("block")), lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # Thousands of values an item are more than Spark would guess: they are dealt, not broadcast.
    return left.join(asked.hint("merge"), ["n", "block", "value"]).withColumn("hamming", apart).where(F.col("hamming") <= radius).select("n", "w", "item_id", "hamming").distinct()


def anchors(items: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """(item_id, word): words of which each window that matches has one. items: item_id, words; rarity: word, seen.

    With s shingles at most s / 5 may be missing. Up to four: none, so any word will do. Up to eight: one, so a word
    that is in two. Beyond, words that stand four from either end are in five, and so many of them, five apart, are
    taken that they are in more than may be missing.
    """
    n = F.size("words")
    places = F.greatest(n - (SHINGLE - 1), F.lit(1))
    lacking = F.floor(places * (1 - SIMILARITY) + 1e-9).cast("int")
    parts = F.when(places < 9, 1).otherwise(F.floor(lacking / SHINGLE) + 1).cast("int")
    exploded = items.where(n > 0).select("item_id", n.alias("n"), lacking.alias("lacking"), parts.alias("parts"), F.posexplode("words").alias("p", "word"))
    edge = F.when(F.col("lacking") == 0, 0).when(F.col("n") < 13, 1).otherwise(SHINGLE - 1)
    inner = F.col("n") - 2 * edge
    part = F.floor((F.col("p") - edge) * F.col("parts") / inner)
    # The next part's first place is five away from the last one allowed in this part.
    ahead = F.floor((F.col("p") - edge + (SHINGLE - 1)) * F.col("parts") / inner)
    fits = (F.col("p") >= edge) & (F.col("p") < F.col("n") - edge) & ((ahead == part) | (part == F.col("parts") - 1))
    allowed = exploded.where(fits).withColumn("part", part)
    allowed = allowed.join(rarity, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0))) if rarity is not None else allowed.withColumn("seen", F.lit(0))
    ranked = allowed.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy("seen", F.desc(F.length("word")), "p")))
    return ranked.where("rank = 1").select("item_id", "word")


def _bits(h: Column) -> list[Column]:
    """Of a hash three numbers below MARKS."""
    return [F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(MARKS - 1).cast("long")).cast("int") for i in range(3)]


def marked(known: DataFrame):
    """Whether a hash is one of `known` (a column h), or is let through by accident: a test by a bitmap of MARKS bits."""
    map_ = [0] * (MARKS // 64)
    for r in known.select(F.explode(F.array(*_bits(F.col("h")))).alias("bit")).distinct().collect():  # MARKS rows at most
        map_[r["bit"] >> 6] |= 1 << (r["bit"] & 63)
    held = longs(map_)
    bit = lambda b: F.call_function("shiftrightunsigned", F.get(held, F.shiftright(b, 6)), b.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1

    def test(h: Column) -> Column:
        a, b, c = map(bit, _bits(h))
        return a & b & c

    return test


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, th, item_id, start, n_words, hamming, similarity): the best window of each document and item that match. th is the text's hash."""
    spark = docs.sparkSession
    items = stored(benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct())
    items = items.withColumn("h", _let(hashed(F.col("words")), lambda h: shingle_hashes(h)))
    cut = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    share = -(-(SAMPLE << 20) // max(1, docs.count()))
    some = cut.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 20)) < min(1 << 20, share)).select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    theirs = items.select(F.explode("words").alias("word")).distinct()
    rarity = some.join(theirs, "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    held = stored(cut.where(F.exists(hashed(words(F.col("text"))), marked(anchors(items, rarity).select(F.xxhash64("word").alias("h"))))))

    # Shingles of the items in the documents that have an anchor: each lines a window up.
    of_items = items.select("item_id", F.size("words").alias("n"), F.size("h").alias("m"), F.posexplode("h").alias("j", "h"))
    # Items of fewer than five words are one shingle of their size; these sizes are at most four.
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]
    hits = None
    for size in sorted(sizes):
        in_docs = held.select("doc_id", "th", _let(hashed(words(F.col("text"))), lambda h: F.struct(F.size(h).alias("len"), shingle_hashes(h, size).alias("h"))).alias("x"))  # noqa: B023
        in_docs = in_docs.select("doc_id", "th", F.col("x.len").alias("len"), F.posexplode("x.h").alias("i", "h"))
        found = in_docs.join(of_items.where((F.col("n") == size) if size < SHINGLE else (F.col("n") >= size)), "h")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], docs.select("doc_id").schema.add("th", "long").add("item_id", benchmark.schema["item_id"].dataType).add("start", "integer").add("n_words", "integer").add("hamming", "integer").add("similarity", "double"))
    # A window that matches has four fifths of the item's shingles, so its document has as many places that hold one.
    same = hits.groupBy("doc_id", "th", "len", "item_id", "n", "m").agg(F.collect_set("i").alias("places"), F.collect_set(F.col("i") - F.col("j")).alias("at"))
    same = stored(same.where(F.size("places") >= F.ceil(F.col("m") * least - 1e-9)).drop("places", "item_id"))
    held = stored(held.where(marked(same.select(F.col("th").alias("h")))(F.col("th"))))
    slack = F.floor(F.col("m") * (1 - least) + 1e-9).cast("int")
    starts = same.select("doc_id", "th", "len", "n", slack.alias("slack"), F.explode("at").alias("at")).distinct()
    starts = starts.select("doc_id", "th", "len", "n", F.explode(F.sequence(F.col("at") - F.col("slack"), F.col("at") + F.col("slack"))).alias("at"))
    starts = starts.where("at < len").select("doc_id", "th", F.greatest("at", F.lit(0)).alias("start"), "n").distinct()

    def inlined(places: DataFrame, body) -> DataFrame:
        """body(words of the text, array of the document's places) inlined; places: doc_id, th and columns without nulls."""
        columns = [c for c in places.columns if c not in ("doc_id", "th")]
        per_doc = places.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct(*columns)).alias("_places"))
        both = held.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
        return both.select("doc_id", "th", F.inline(_let(words(F.col("text")), lambda w: body(w, F.col("_places")))))

    def part(w: Column, p: Column) -> Column:
        return F.slice(w, p["start"] + 1, p["n"])

    def named(w: Column, places: Column) -> Column:
        return _let(hashed(w), lambda h: F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), F.xxhash64(part(h, p)).alias("w"))))

    # Windows with the same words are one: copies of a passage cost nothing.
    windows = stored(inlined(starts, named))
    one = F.min(F.struct("doc_id", "th", "start")).alias("x")
    kinds = stored(windows.groupBy("n", "w").agg(one).select("n", "w", "x.*"))
    signed = inlined(kinds, lambda w, places: _let(hashed(w), lambda h: F.transform(places, lambda p: F.struct(p["n"].alias("n"), p["w"].alias("w"), _let(part(h, p), lambda x: shingle_hashes(x)).alias("hashes")))))
    item_fps = simhash(items.select("item_id", F.size("words").alias("n"), "h"), "h", ["item_id", "n"])
    close = stored(near(simhash(signed, "hashes", ["n", "w"]), item_fps, radius, blocks))

    # Exact: equal shingles by their words, with how often they stand on either side.
    wanted = kinds.join(close.select("n", "w").distinct(), ["n", "w"])
    mine = inlined(wanted, lambda w, places: F.transform(places, lambda p: F.struct(p["n"].alias("n"), p["w"].alias("w"), _let(part(w, p), lambda x: shingles(x)).alias("shingles"))))
    mine = mine.select("n", "w", F.size("shingles").alias("mine"), F.explode("shingles").alias("s")).groupBy("n", "w", "mine", "s").agg(F.count("*").alias("a"))
    other = items.select("item_id", F.size("h").alias("theirs"), F.explode(shingles(F.col("words"))).alias("s")).groupBy("item_id", "theirs", "s").agg(F.count("*").alias("b"))
    common = close.join(mine, ["n", "w"]).join(other, ["item_id", "s"]).groupBy("n", "w", "item_id", "hamming", "mine", "theirs").agg(F.sum(F.least("a", "b")).alias("common"))
    similarity = F.round(F.col("common").cast("double") / (F.col("mine") + F.col("theirs") - F.col("common")), 9)
    checked = common.withColumn("similarity", similarity).where(F.col("similarity") >= least).select("n", "w", "item_id", "hamming", "similarity")
    found = windows.select("doc_id", "th", "start", "n", "w").join(checked, ["n", "w"])
    best = F.max_by(F.struct("start", F.col("n").alias("n_words"), "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "th", "item_id").agg(best.alias("x")).select("doc_id", "th", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without contaminated ones; others keep their row as it is."""
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "n_words", "similarity")


#: All windows that share a shingle with an item of five words or more, and those equal to a shorter item, by brute force.
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
ORACLE = {
    "op5_decontaminate": rf"""WITH d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
j AS (SELECT item_id, w, len(w) AS n, greatest(len(w) - 4, 1) AS m FROM i WHERE len(w) > 0),
ds AS (SELECT doc_id, text, len(w) AS len, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
js AS (SELECT item_id, s, count(*) AS k FROM (SELECT item_id, array_to_string(w[q + 1 : q + 5], ' ') AS s FROM (SELECT *, unnest(range(n - 4)) AS q FROM j WHERE n >= 5)) GROUP BY 1, 2),
c AS (SELECT DISTINCT doc_id, text, len, item_id, n, m, unnest(range(greatest(p - m + 1, 0), p + 1)) AS start FROM ds JOIN js USING (s) JOIN j USING (item_id)),
o AS (SELECT c.doc_id, c.text, c.len, c.item_id, c.n, c.m, c.start, ds.s, count(*) AS k FROM c JOIN ds ON ds.doc_id IS NOT DISTINCT FROM c.doc_id AND ds.text = c.text AND ds.p BETWEEN c.start AND c.start + c.m - 1 GROUP BY ALL),
x AS (SELECT o.doc_id, o.text, o.item_id, o.n, o.start, o.m, least(o.m, o.len - 4 - o.start) AS mine, sum(least(o.k, js.k)) AS common FROM o JOIN js ON js.item_id = o.item_id AND js.s = o.s GROUP BY ALL),
y AS (SELECT doc_id, text, item_id, start, n, common::DOUBLE / (m + mine - common) AS sim FROM x
UNION ALL SELECT doc_id, text, item_id, start, n, 1.0 FROM (SELECT d.doc_id, d.text, d.w, j.item_id, j.n, j.w AS v, unnest(range(len(d.w) - j.n + 1)) AS start FROM d, j WHERE j.n < 5 AND len(d.w) >= j.n) WHERE w[start + 1 : start + n] = v)
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, round(sim, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY round(sim, 9) DESC, start) AS rn FROM y WHERE sim >= 0.8 - 1e-10) WHERE rn = 1""",
}
