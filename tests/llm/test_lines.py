import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm import lines


def cut(spark, docs, rows):
    return {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.dedup_lines(docs(*rows)).collect()}


def passage(seed, n=12):
    rng = random.Random(seed)
    return [f"p{seed} line {i} " + " ".join(f"w{rng.randrange(999)}" for _ in range(6)) for i in range(n)]


def own(k, n):
    return [f"document {k} sentence {i} stands alone" for i in range(n)]


def test_shared_passages_go_wherever_they_stand(spark, docs):
    shared = passage(1)
    rows = [(k, "\n".join([*own(k, k), *shared, *own(-k - 1, 3)])) for k in range(1, 7)]
    got = cut(spark, docs, rows)
    assert got[1] == (rows[0][1], 0)
    for k, text in rows[1:]:
        left = got[k][0].split("\n")
        assert set(own(k, k)) | set(own(-k - 1, 3)) <= set(left)
        assert not set(shared) & set(left) and got[k][1] == len(text.split("\n")) - len(left)
    everywhere = {x for t, _ in got.values() for x in t.split("\n")}
    assert everywhere == {x for _, t in rows for x in t.split("\n")}


def test_long_lines_go_short_ones_stay(spark, docs):
    long, short = " ".join(f"w{i}" for i in range(60)), "License: free"
    got = cut(spark, docs, [(1, f"a\n{long}\nb"), (2, f"c c\n{long}\n{short}\nd"), (3, f"{short}\nother")])
    assert got[1][1] == 0 and got[2] == (f"c c\n{short}\nd", 1) and got[3] == (f"{short}\nother", 0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=8), min_size=1, max_size=8))
def test_no_line_is_lost_and_first_documents_stay(spark, docs, spec):
    rows = [(i, "\n".join(f"line number {x}" for x in s)) for i, s in enumerate(spec)]
    got = cut(spark, docs, rows)
    assert {x for t, _ in got.values() for x in t.split("\n") if x} == {x for _, t in rows for x in t.split("\n") if x}
    for i, t in rows:
        assert len(t.split("\n")) - got[i][1] == (len(got[i][0].split("\n")) if got[i][0] or got[i][1] < len(t.split("\n")) else 0)


def brute(rows, classes=lines.CLASSES):
    """Chunks found by the definition, on hashes that Spark gives."""
    import xxhash

    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    pack = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    places, spans = {}, {}
    for d, text in rows:
        ls = text.split("\n")
        hs = [h(x) for x in ls]
        found = set()
        for rest in range(classes):
            starts = []
            for i in range(len(ls)):
                roll = pack(hs[i], pack(hs[i - 1], 42)) if i else 0
                roll = roll - (1 << 64) if roll >> 63 else roll
                if i == 0 or roll % classes == rest:
                    starts.append(i)
            found |= {(s, e) for s, e in zip(starts, [*starts[1:], len(ls)]) if e - s >= 2}
        count = [x.count(" ") + 1 if x.strip(" ") else 0 for x in ls]
        for s in range(len(ls)):
            e = next((e for e in range(s + 1, len(ls) + 1) if sum(count[s:e]) > lines.LONG), None)
            if count[s] and e:
                found.add((s, e))
        spans[d] = found
        for s, e in found:
            places.setdefault("\n".join(ls[s:e]), set()).add((d, s))
    out = {}
    for d, text in rows:
        ls = text.split("\n")
        gone = {i for s, e in spans.get(d, ()) if min(places["\n".join(ls[s:e])]) != (d, s) for i in range(s, e)}
        out[d] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone))
    return out


def test_equals_brute_force(spark, docs):
    rng = random.Random(3)
    pool = [passage(s, rng.randint(1, 6)) for s in range(6)] + [[" ".join(f"v{i}" for i in range(55))]]
    pool += [["", "a few words", "", *(f"one word each {i}" for i in range(14)), ""], [f"w{i}" for i in range(60)]]
    rows = [(k, "\n".join(x for _ in range(rng.randint(1, 5)) for x in (rng.choice(pool) if rng.random() < 0.6 else own(k * 10 + rng.randrange(9), 2)))) for k in range(40)]
    assert cut(spark, docs, rows) == brute(rows)


def test_collisions_are_left_alone(spark, docs, monkeypatch):
    """With hashes cut to nothing all chunks collide, and only the bytes can tell: nothing is removed, by either path."""
    rows = [(1, "\n".join(passage(1))), (2, "\n".join(passage(1)))]
    real = lines.collisions
    monkeypatch.setattr(lines, "collisions", lambda df: df.where("_spans IS NOT NULL").select(F.explode("_spans.h").alias("h")).distinct())
    assert all(n == 0 for _, n in cut(spark, docs, rows).values())
    monkeypatch.setattr(lines, "FEW", 0)
    assert all(n == 0 for _, n in cut(spark, docs, rows).values())
    monkeypatch.setattr(lines, "collisions", real)
    assert cut(spark, docs, rows)[2] == ("", 12)
    df = lines.marked(docs(*rows))
    assert lines.collisions(df).count() == 0
    clash = df.withColumn("_spans", F.transform("_spans", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(7).cast("long").alias("h"), s["gone"].alias("gone"))))
    assert [r["h"] for r in lines.collisions(clash).collect()] == [7]


def test_odd_rows(odd, empty):
    got = lines.dedup_lines(odd.withColumn("s", F.lit(1)).withColumn("th", F.lit("x")).withColumn("_spans", F.lit(1)).withColumn("_d", F.lit(2)).withColumn("a.b", F.lit(3))).collect()
    assert len(got) == 11 and [r["text"] for r in got if r["doc_id"] in (1, 2)].count(None) == 1
    assert {r["text"] for r in got if r["doc_id"] in (5, 6)} == {"one two three four five six seven"}
    assert got[0].asDict().keys() >= {"s", "th", "lines_removed", "_spans", "_d", "a.b"} and got[0]["_d"] == 2
    assert lines.dedup_lines(empty).count() == 0


def test_passages_of_uneven_lines_go_whole(spark, docs):
    """Every line of the passage goes from all later documents, whatever stands around it."""
    for counts in ([51, 20, 20], [60, 45], [30, 30, 12], [40, 40, 5], [5, 40, 40], [3, 60, 2, 2]):
        shared = [" ".join(f"u{len(counts)}x{i}y{j}" for j in range(n)) for i, n in enumerate(counts)]
        rows = [(k, "\n".join([*own(k, 2), *shared, *own(-k - 1, 2)])) for k in range(1, 25)]
        got = cut(spark, docs, rows)
        assert got[1] == (rows[0][1], 0)
        assert all(got[k][0].split("\n") == [*own(k, 2), *own(-k - 1, 2)] for k, _ in rows[1:])


def test_options_and_clash(spark, docs):
    """Without the long passages a single line stays; a column named as the new one is replaced."""
    one, two = " ".join(f"z{i}" for i in range(60)), passage(3, 8)
    rows = [(k, "\n".join([*own(k, 2), one, *own(-k - 1, 2), *two])) for k in range(1, 5)]
    short = {r["doc_id"]: r for r in lines.dedup_lines(docs(*rows).withColumn("lines_removed", F.lit("old")), long=False).collect()}
    assert all(one in r["text"] for r in short.values()) and short[1]["lines_removed"] == 0
    assert all(r["lines_removed"] >= 4 for k, r in short.items() if k > 1)
    whole = lines.dedup_lines(docs(*rows).withColumn("lines_removed", F.lit("old")))
    assert whole.columns.count("lines_removed") == 1 and all((one in r["text"]) == (r["doc_id"] == 1) for r in whole.collect())
