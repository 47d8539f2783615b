import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import language

SYLLABLES = {"en": "the ing tion and er on it he is re".split(), "de": "sch ein ung der ch en zu be ge ö".split(), "fr": "eau que les ou oi é ment aux le é".split()}


def text(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, text(lang, rng), lang, f"src{i % 4}") for i, lang in enumerate(rng.choice(sorted(SYLLABLES)) for _ in range(240))]


def test_held_out_accuracy(spark, docs, corpus):
    rng = random.Random(2)
    new = [(1000 + i, text(lang, rng, 8), None, "src1") for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    got = {r["x0"]: r for r in language.documents(docs(*corpus, *new)).collect()}
    right = sum(got[1000 + i]["found_lang"] == lang for i, lang in enumerate(sorted(SYLLABLES) * 20))
    assert right >= 58 and all(r["accepted"] for r in got.values())


def test_wrong_declaration_yields_to_text_and_doubtful_text_to_evidence(spark, docs, corpus):
    rng = random.Random(4)
    odd = [(2000, text("fr", rng, 80), "en", "src1"), (2001, "xq", "de", "german")] + [(3000 + i, text("de", rng), "de", "german") for i in range(40)]
    got = {r["x0"]: r for r in language.documents(docs(*corpus, *odd)).collect()}
    assert got[2000]["found_lang"] == "fr" and got[2001]["found_lang"] == "de"


def test_pages_use_host_and_declaration(spark, docs, corpus):
    rng = random.Random(6)
    rows = [(i, f"http://a{i % 2}.example.{'de' if i % 2 else 'com'}/x", f"<html lang='{('en', 'de')[i % 2]}-XX'><script>no</script><p>{text(('en', 'de')[i % 2], rng)}</p>") for i in range(40)]
    rows += [(100, "http://a1.example.de/y", "<p>xq</p>"), (101, None, None), (102, "http://b.de/", "<p>xq zz</p>")]
    web = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["x0"]: r for r in language.pages(web, language.training(docs(*corpus))).collect()}
    assert got[0]["found_lang"] == "en" and got[1]["found_lang"] == "de" and got[100]["found_lang"] == "de" and got[102]["found_lang"] == "de"
    assert not got[101]["accepted"] and got[101]["found_lang"] == "und"


def test_trigrams_equal_definition():
    texts = pa.array([b"Ab c", b"", None, b"x", "é1".encode(), b"abcd"], pa.binary()).fill_null(b"")
    buckets, first, end, letters = language.trigrams(texts.slice(1))
    model = np.random.default_rng(0).normal(size=(language.BUCKETS, 3))
    seen = lambda t: [int(language.SEEN[b]) for b in t]
    key = lambda a, b, c: ((a * 40503 + b) * 2654 + c) % 2**32 % 32749 % language.BUCKETS
    want = [sum((model[key(*s[i : i + 3])] for i in range(len(s) - 2)), np.zeros(3)) * language.TEMPER for s in map(seen, [b"", b"", b"x", "é1".encode(), b"abcd"])]
    got, counts = language.likelihoods(texts.slice(1), model)
    assert np.allclose(got, want) and counts.tolist() == [0, 0, 1, 2, 4] == letters.tolist()


def test_odd_rows(spark, odd, empty, docs, corpus):
    rows = odd.union(docs(*corpus))
    clash = rows.withColumn("host", F.lit("clash")).withColumn("accepted", F.lit(1)).withColumn("_host", F.lit(1)).withColumn("x0", F.lit(1)).withColumn("a.b", F.lit(2))
    got = language.documents(clash).where("x3 IS NULL").collect()
    assert len(got) == 11 and {r["x0"] for r in got if not r["accepted"]} == {1, 2, 3}
    assert language.accepted(clash).columns == clash.columns and language.accepted(clash).count() == rows.count() - 3
    assert language.documents(empty).count() == 0
    none = language.documents(odd).collect()
    assert len(none) == 11 and not any(r["accepted"] for r in none)
    kept = language.accepted(rows)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 3


def test_rare_and_many_languages_are_kept(docs, corpus):
    """A language with three rows, and 70 more than the frequent ones: each document keeps its own."""
    rng = random.Random(12)
    own = {f"q{chr(97 + i // 26)}{chr(97 + i % 26)}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(8)] for i in range(70)}
    rows = [(5000 + 10 * i + k, " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(40)), lang, "src1") for i, (lang, parts) in enumerate(own.items()) for k in range(3)]
    got = {r["doc_id"]: r["lang"] for r in language.accepted(docs(*corpus, *rows)).collect()}
    assert got == {r[0]: r[2] for r in [*corpus, *rows]}


def brute_posteriors(rows):
    """The fused posterior of each row from the definitions, with dictionaries; every row is in the sample."""
    langs = sorted({r[2] for r in rows if r[2]})
    grams = {}
    for k, r in enumerate(rows):
        s = [int(language.SEEN[b]) for b in (r[1] or "").encode()]
        grams[k] = [((a * 40503 + b) * 2654 + c) % 2**32 % 32749 % language.BUCKETS for a, b, c in zip(s, s[1:], s[2:])]
    letters = [sum(int(language.SEEN[b]) != 32 for b in (r[1] or "").encode()) for r in rows]
    counts = {lang: Counter(g for k, r in enumerate(rows) if r[2] == lang for g in grams[k]) for lang in langs}
    sizes = {lang: sum(c.values()) for lang, c in counts.items()}
    log = lambda lang, g: math.log((counts[lang][g] + 0.5) / (sizes[lang] + 0.5 * language.BUCKETS))
    text_ = [np.array([language.TEMPER * sum(log(lang, g) for g in grams[k]) for lang in langs]) for k in range(len(rows))]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = [soft(t) * (n > 0) for t, n in zip(text_, letters)]
    part = lambda host, level: {"suffix": host.rsplit(".", 1)[1] if "." in host else "", "domain": ".".join(host.split(".")[-2:]), "host": host}[level]
    hosts = [r[3] or "" for r in rows]
    out = {}
    for k, r in enumerate(rows):
        others = lambda keep: sum((own[j] for j in range(len(rows)) if keep(j)), np.zeros(len(langs))) - own[k]  # noqa: B023, E731
        prior = others(lambda j: True) + 1
        prior = prior / prior.sum()
        for level in ("suffix", "domain", "host"):
            seen = others(lambda j: part(hosts[j], level) == part(hosts[k], level))  # noqa: B023
            prior = (seen + language.STRENGTH * prior) / (seen.sum() + language.STRENGTH)
        claim = np.zeros(len(langs))
        if r[2]:
            honest = np.array([language.HONEST if lang == r[2] else (1 - language.HONEST) / len(langs) for lang in langs])
            claim = np.log((others(lambda j: rows[j][2] == r[2]) + language.DECLARED * honest) / (others(lambda j: True) + language.DECLARED))  # noqa: B023
        out[k] = soft(text_[k] + np.log(prior) + claim) if letters[k] else None
    return langs, out


def test_posteriors_equal_brute_force(docs):
    """Text, host levels and declarations, with ties, blank texts and rows that repeat."""
    rng = random.Random(9)
    hosts = ["a.example.de", "b.example.de", "c.other.fr", "plain", None]
    rows = [(k, text(rng.choice(sorted(SYLLABLES)), rng, rng.randint(1, 5)), rng.choice([*sorted(SYLLABLES), None]), rng.choice(hosts)) for k in range(60)]
    rows += [(60, "zz", "de", "plain"), (61, "zz", "de", "plain"), (62, "", "fr", "plain"), (63, None, None, None), (64, "12 3", "en", "a.example.de")]
    langs, want = brute_posteriors(rows)
    got = {r["x0"]: r for r in language.documents(docs(*rows)).collect()}
    for k, post in want.items():
        if post is None:
            assert (got[k]["found_lang"], got[k]["posterior"], got[k]["accepted"]) == ("und", 0.0, False)
        else:
            assert got[k]["posterior"] == pytest.approx(post.max(), abs=1e-4) and got[k]["accepted"] == (post.max() >= language.LEAST)
            if got[k]["accepted"]:
                assert post[langs.index(got[k]["found_lang"])] == pytest.approx(post.max(), abs=1e-4)
