"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of the text's likelihood, the likelihood of the language declared in markup
or metadata, and a prior of the host. Text: hashed trigrams of bytes, naive Bayes, tempered since trigrams overlap by
two. Prior: all languages, then the address suffix, the domain and the host, each level smoothed by the one above it
with STRENGTH rows. Declared: how often each declared code goes with each language, smoothed towards honesty. The counts
behind prior and declaration are sums of text posteriors over all rows by grouped aggregation, and every row's own
share is taken out before they judge it. A text without letters, or whose best language has a posterior under LEAST, is
rejected; its language is "und".

Plan: one pass sums posteriors by (host, declared) within each task and then by key; hosts meet their domain's and
suffix's sums; a second pass reads each text with its host's row. That table goes to all tasks only if Spark finds it
small enough to broadcast; else rows are joined by host, where adaptive execution splits a host that is too large.

The trigram model is fitted on a bounded sample: of each language about SAMPLE labelled rows, by a hash of id and text.
Every labelled language is in the model, however few rows it has; texts are scored against AT_ONCE languages at a time,
so that a task's memory doesn't grow with their number but for the model itself. Null text counts as empty: rejected.
Null hosts are one host without a name, null or malformed declarations are no evidence. Without any labelled language
every text with letters is "und" and rejected, as there is nothing to know it by.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, restored, sliced, stored, table
from .urls import split_url

SAMPLE, AT_ONCE, BUCKETS = 2000, 8, 1 << 15
STRENGTH, HONEST, DECLARED, LEAST, TEMPER = 10.0, 0.9, 20.0, 0.5, 1 / 3
UND = "und"
#: Bytes of text that a task scores at once; its trigrams' scores take about a hundred times that.
SLICE = 1 << 18
CODE = "^([A-Za-z]{2,3})(?:[-_].*)?$"
#: Bytes as the model sees them: ASCII letters in lower case, bytes of longer characters as they are, all else a space.
SEEN = np.array([b | 32 if chr(b).isalpha() and b < 128 else b if b > 127 else 32 for b in range(256)], np.uint32)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of a slice of texts, first and end of each text's trigrams, and each text's letters."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = SEEN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    letters = np.concatenate([[0], np.cumsum(data != 32)])
    letters = letters[offsets[1:]] - letters[offsets[:-1]]
    buckets = ((data[:-2] * 40503 + data[1:-1]) * 2654 + data[2:]) % 32749 % BUCKETS if len(data) > 2 else np.empty(0, np.uint32)
    return buckets, offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1]), letters


def likelihoods(texts: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihood (texts x languages) and letters of each text. model: buckets x languages."""
    buckets, first, end, letters = trigrams(texts)
    out = np.zeros((len(texts), model.shape[1]))
    some = np.nonzero(end > first)[0]
    if len(some):
        bounds = np.stack([first[some], end[some]], 1).ravel()
        for low in range(0, model.shape[1], AT_ONCE):
            part = model[:, low : low + AT_ONCE]
            scores = np.empty((len(buckets) + 1, part.shape[1]))
            np.take(part, buckets, axis=0, out=scores[:-1])
            scores[-1] = 0
            out[some, low : low + AT_ONCE] = np.add.reduceat(scores, bounds, axis=0)[::2]
    return out * TEMPER, letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages) from labelled rows: lang, key, text."""
    sizes = {r["lang"]: r["n"] for r in rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    shares = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1 << 20, -(-(sample << 20) // sizes[lang])))))
    share, place = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0)), {lang: i for i, lang in enumerate(langs)}
    picked = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < share).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for b in sliced(batches, 1, SLICE):
            buckets, first, end, _ = trigrams(b.column(1))
            for lang, low, high in zip(b.column(0).to_pylist(), first, end):
                counts[place[lang]] += np.bincount(buckets[low:high], minlength=BUCKETS)
        for at, x in counts.items():
            (bucket,) = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), at), pa.int32()), pa.array(bucket, pa.int32()), pa.array(x[bucket])], names=["at", "bucket", "n"])

    # At most BUCKETS rows a language.
    counts = np.zeros((BUCKETS, len(langs)))
    found = picked.mapInArrow(run, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    return langs, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _sums(rows: DataFrame, shared: Broadcast, n: int) -> DataFrame:
    """(host, declared, s0, s1, ...): summed text posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums: dict = defaultdict(lambda: np.zeros(n))
        for b in sliced(batches, 2, SLICE):
            logs, letters = likelihoods(b.column(2).fill_null(b""), model)
            p = softmax(logs) * (letters > 0)[:, None]
            for key, x in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), p):
                sums[key] += x
            if len(sums) * n > 6_400_000:
                yield out(sums)
                sums.clear()
        yield out(sums)

    def out(sums: dict) -> pa.RecordBatch:
        values = np.round(np.array([*sums.values()]).reshape(-1, n) * 1e6).astype(np.int64)  # whole millionths: their order doesn't matter
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), *(pa.array(values[:, i]) for i in range(n))], names=["host", "declared", *(f"s{i}" for i in range(n))])

    each = rows.select("host", "declared", F.col("text").cast("binary").alias("text")).mapInArrow(run, "host string, declared string, " + ", ".join(f"s{i} long" for i in range(n)))
    return each.groupBy("host", "declared").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n)))


def identify(df: DataFrame, train: DataFrame, text: Column, host: Column, declared: Column, sample: int = SAMPLE) -> DataFrame:
    """The rows of `df`, its columns under the names x0, x1 ... of numbered(), and found_lang, posterior, text_lang, accepted. train: lang, key, text."""
    spark, given = df.sparkSession, df
    langs, model = fit(train, sample)
    n = len(langs)
    extra = "found_lang string, posterior double, text_lang string, accepted boolean"
    if not n:
        return df.select(*numbered(df), F.lit(UND).alias("found_lang"), F.lit(0.0).alias("posterior"), F.lit(UND).alias("text_lang"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast(model)
    code = F.nullif(F.lower(F.regexp_extract(declared, CODE, 1)), F.lit(""))
    rows = given.select(*numbered(given), F.coalesce(host, F.lit("")).alias("_host"), code.alias("_declared"), text.cast("binary").alias("_text"))
    sums = stored(_sums(rows.select(F.col("_host").alias("host"), F.col("_declared").alias("declared"), F.col("_text").alias("text")), shared, n))
    total = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    packed = lambda name: F.array(*(F.col(f"s{i}").cast("double") / 1e6 for i in range(n))).alias(name)
    # Codes of two or three letters: at most 26^2 + 26^3 rows.
    claims = {r["declared"]: np.array(r["x"]) for r in sums.where("declared IS NOT NULL").groupBy("declared").agg(*total).select("declared", packed("x")).collect()}
    everything = np.array(sums.agg(*total).select(packed("x")).first()["x"] or [0.0] * n, float)
    everything = np.nan_to_num(everything)
    hosts = sums.groupBy("host").agg(*total).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains, suffixes = hosts.groupBy("domain").agg(*total).select("domain", packed("_of_domain")), hosts.groupBy("suffix").agg(*total).select("suffix", packed("_of_suffix"))
    known = hosts.select(F.col("host").alias("_host"), "domain", "suffix", packed("_of_host")).join(domains, "domain").join(suffixes, "suffix").drop("domain", "suffix")
    known = stored(known)
    claims_table = spark.sparkContext.broadcast((claims, everything))
    keep = [f"x{i}" for i in range(len(given.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (claims, everything) = shared.value, claims_table.value
        names = np.array([*langs, UND], object)
        for b in sliced(batches, len(keep), SLICE):
            logs, letters = likelihoods(b.column("_text").fill_null(b""), weights)
            own = softmax(logs) * (letters > 0)[:, None]
            prior = np.maximum(everything - own, 0) + 1
            prior /= prior.sum(1, keepdims=True)
            for level in ("_of_suffix", "_of_domain", "_of_host"):
                seen = np.maximum(np.array(b.column(level).to_pylist(), float).reshape(-1, n) - own, 0)
                prior = (seen + STRENGTH * prior) / (seen.sum(1, keepdims=True) + STRENGTH)
            claim = np.zeros_like(logs)
            for i, d in enumerate(b.column("_declared").to_pylist()):
                if d is not None:
                    honest = np.where(np.array(langs) == d, HONEST, (1 - HONEST) / n)
                    claim[i] = np.log((np.maximum(claims[d] - own[i], 0) + DECLARED * honest) / (np.maximum(everything - own[i], 0) + DECLARED))
            post = softmax(logs + np.log(prior) + claim)
            best, alone = post.argmax(1), logs.argmax(1)
            sure = post[np.arange(len(best)), best]
            ok = (letters > 0) & (sure >= LEAST)
            found = names[np.where(ok, best, n)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(found, pa.string()), pa.array(np.where(letters > 0, sure, 0.0)), pa.array(names[np.where(letters > 0, alone, n)], pa.string()), pa.array(ok)],
                names=[*keep, "found_lang", "posterior", "text_lang", "accepted"],
            )

    fields = ", ".join(f"x{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields))
    return rows.select(*keep, "_text", "_host", "_declared").join(known, "_host").select(*keep, "_text", "_declared", "_of_host", "_of_domain", "_of_suffix").mapInArrow(run, f"{fields}, {extra}")


def training(docs: DataFrame) -> DataFrame:
    return docs.select("lang", F.col("doc_id").alias("key"), "text")


def documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents (see identify): their source is the host, their lang column the declaration."""
    return identify(docs, training(docs), F.col("text"), F.col("source"), F.col("lang"), sample)


#: What a page shows, roughly, and what it declares.
HIDDEN = r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;"
DECLARATION = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z_-]+)"


def pages(web: DataFrame, train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Pages: host and suffix are those of the url, the declaration is that of the html element."""
    return identify(web, train, F.regexp_replace("html", HIDDEN, " "), split_url(F.col("url"))[0], F.regexp_extract("html", DECLARATION, 1), sample)


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents that aren't rejected; lang is the language found."""
    found = documents(docs, sample).where("accepted")
    return found.select(*(F.col("found_lang").alias("lang") if c == "lang" else x for c, x in zip(docs.columns, restored(docs))))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; of the two ids one is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    web = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("html", DECLARATION, 1).alias("declared"))
    result = [F.col("found_lang").alias("lang"), "posterior", "text_lang", "accepted"]
    null = F.lit(None).cast("long")
    one = documents(docs).select(F.col("x0").alias("doc_id"), null.alias("page_id"), F.col("x3").alias("declared"), *result)
    return one.union(pages(web, training(docs)).select(null, F.col("x0"), F.col("x3"), *result))
