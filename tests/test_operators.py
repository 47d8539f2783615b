import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.operators import coupling, dlp, drift, graph, history, identity, payload, reports, search, tables

T0 = datetime(2024, 1, 1, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def versions(spark, rows):
    return spark.createDataFrame([("art", i, at(t), f, n) for i, (t, f, n) in enumerate(rows)], "artifact_id string, id int, ts timestamp, fingerprint string, lines int")


def test_fix_and_revert(spark):
    x = history.signals(versions(spark, [(100, "A", 80), (130, "B", 3), (5000, "A", 1)]), window_s=60).first()
    assert (x["immediate_fix"], x["reverted"]) == (1.0, 1.0)
    assert history.signals(versions(spark, [(100, "A", 40), (130, "B", 35)]), window_s=60).first()["immediate_fix"] == 0.0


def test_churn_decays(spark):
    v = versions(spark, [(60 * i, str(i), 1) for i in range(4)])
    score = lambda s: history.risk(history.signals(v, spark.createDataFrame([(at(s),)], "now timestamp"))).first()["churn"]
    now, later = score(240), score(120 * 86400)
    assert now / (now + 3) > 0.5 and later / (later + 3) < 0.05


def test_cochange(spark):
    files = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "c"), ("c2", "c")], "commit string, file string")
    pairs = coupling.cochange(files)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)] and coupling.depends_on(pairs).count() == 2
    assert coupling.cochange(files, bulk=2, support=2).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components_and_closure(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    comp = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in coupling.components(df).collect()}
    assert got == {x: comp[x] for x in linked}
    seen, frontier = set(), {edges[0][1]}
    while frontier:
        seen |= frontier
        frontier = {a for a, b in edges if b in frontier} - seen
    reach = coupling.dependents(df, spark.createDataFrame([(edges[0][1],)], "id long"))
    assert {r["id"] for r in reach.collect()} == seen - {edges[0][1]}


def test_components_of_few_edges_take_one_checkpoint(spark, monkeypatch):
    """Of a chain, which takes several rounds of contraction; more edges than FEW give the same by rounds."""
    taken = []
    monkeypatch.setattr(coupling, "checkpointed", lambda df, f=coupling.checkpointed: taken.append(df) or f(df))
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] + [("é", "z"), ("z", "z"), ("z", None)]
    found = []
    for few in (coupling.FEW, 0):
        monkeypatch.setattr(coupling, "FEW", few)
        found.append({(r["id"], r["component"]) for r in coupling.components(spark.createDataFrame(chain, "src string, dst string")).collect()})
        taken.append(None)
    assert found[0] == found[1] == {(f"n{i:02}", "n00") for i in range(41)} | {("é", "z"), ("z", "z")}
    assert taken.index(None) == 1 and len(taken) > 4


def test_rollup(spark):
    symbols = spark.createDataFrame([("f", 0.2, 0.0), ("f", 0.8, 0.4)], "parent_id string, a double, p double")
    files = spark.createDataFrame([("f", "r", 0.0, 0.1), ("g", "r", 0.3, 0.0)], "id string, parent_id string, a double, p double")
    up = coupling.rollup(symbols, files, ["a", "p"])
    assert {tuple(r) for r in up.collect()} == {("f", "r", 0.8, 0.4), ("g", "r", 0.3, 0.0)}


@pytest.mark.parametrize(("declared", "actual", "want"), [(["a"], ["a", "b", "c"], (["b", "c"], [], 2 / 3)), (["a", "b"], ["a"], ([], ["b"], 0.5)), ([], [], ([], [], 0.0))])
def test_drift(spark, declared, actual, want):
    row = spark.createDataFrame([(declared, actual)], "d array<string>, a array<string>").select(drift.drift(F.col("d"), F.col("a")).alias("x")).first()["x"]
    assert (row["undeclared"], row["phantom"], pytest.approx(row["score"])) == want


def test_correlate_short_and_long_spans(spark):
    sessions = spark.createDataFrame([("s", 1, at(0), at(60)), ("long", 1, at(0), at(90 * 3600)), ("ages", 1, at(-3 * 10**8), at(0))], "session string, key int, first timestamp, last timestamp")
    v = spark.createDataFrame([(1, at(-1700), "in"), (1, at(-1900), "out"), (1, at(1860), "edge"), (1, at(80 * 3600), "late"), (2, at(0), "other")], "key int, ts timestamp, version string")
    got = {(r["session"], r["version"]) for r in drift.correlate(sessions, v).collect()}
    assert got == {("s", "in"), ("s", "edge"), ("long", "in"), ("long", "edge"), ("long", "late"), ("ages", "in"), ("ages", "out")}


def test_identity(spark):
    schema = "scope string, path string, id string, hash string, shingles array<bigint>"
    known = spark.createDataFrame([("r", "a.py::f", "1", "h1", [1, 2, 3]), ("r", "a.py::g", "2", "h2", [7, 8, 9]), ("r", "a.py::x", "3", "h3", [20, 21]), ("r", "b.py::m", "4", "h4", [31, 32, 33])], schema)
    seen = [("r", "a.py::f", "h1", [1, 2, 3]), ("r", "a.py::g2", "h2", [7, 8, 9]), ("r", "c.py::m", "h4", [31, 32, 33]), ("r", "n.py::new", "h9", [99])]
    resolved, removed = identity.resolve(known, spark.createDataFrame(seen, "scope string, path string, hash string, shingles array<bigint>"))
    got = {r["path"]: (r["status"], r["from_path"]) for r in resolved.collect()}
    assert got == {"a.py::f": ("unchanged", None), "a.py::g2": ("renamed", "a.py::g"), "c.py::m": ("moved", "b.py::m"), "n.py::new": ("added", None)}
    assert [r["id"] for r in removed.collect()] == ["3"]


def greedy(known, observed, least):
    """All pairs by falling similarity, then paths; each end once."""
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    pairs = sorted((-like(set(a), set(b)), k, o) for k, a in known.items() for o, b in observed.items() if like(set(a), set(b)) >= least)
    out, used = {}, set()
    for _, k, o in pairs:
        if k not in used and o not in out:
            out[o] = k
            used.add(k)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_identity_equals_greedy(spark, seed):
    """Copies, empty sets, a line that all share, and near ones; two scopes."""
    rng = random.Random(seed)
    base = [sorted(rng.sample(range(1, 60), rng.randint(0, 12))) for _ in range(8)]
    change = lambda s: sorted({99, *(x for x in s if rng.random() < 0.85)} if s else s)
    rows, seen, want = [], [], {}
    for scope in "ab":
        known = {f"old/{i}": change(rng.choice(base)) for i in range(25)}
        observed = {f"new/{i}": change(rng.choice(base)) for i in range(25)}
        rows += [(scope, k, f"{scope}{k}", k, s) for k, s in known.items()]
        seen += [(scope, o, o, s) for o, s in observed.items()]
        want |= {(scope, o): f"{scope}{k}" for o, k in greedy(known, observed, 0.6).items()}
    resolved, _ = identity.resolve(spark.createDataFrame(rows, "scope string, path string, id string, hash string, shingles array<bigint>"), spark.createDataFrame(seen, "scope string, path string, hash string, shingles array<bigint>"))
    assert {(r["scope"], r["path"]): r["id"] for r in resolved.where("status <> 'added'").collect()} == want


def test_greedy_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([("s", "k1", "o1", 0.9), ("s", "k1", "o2", 0.95), ("s", "k2", "o2", 0.8), ("s", "k2", "o1", 0.7)], "scope string, known string, observed string, similarity double")
    assert {(r["known"], r["observed"]) for r in identity.assign(pairs).collect()} == {("k1", "o2"), ("k2", "o1")}


def test_dlp(spark):
    rows = [("a", ["aws_access_key"], True), ("x/.env", [], True), ("/etc/passwd", [], True), ("src/a.py", [], True), ("y/.env", ["jwt"], False)]
    found = dlp.findings(spark.createDataFrame(rows, "path string, secret_kinds array<string>, remote boolean"))
    assert {(r["path"], r["rule"], r["severity"]) for r in found.collect()} == {("a", "secret-in-read", "critical"), ("x/.env", "sensitive-path", "warn"), ("/etc/passwd", "external-read", "warn")}
    assert dlp.at_least(found, "critical").count() == 1 and "AKIA" not in str(found.collect())


def test_tables(spark):
    s = "id int, v int, t string"
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], s), spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e"), (3, 2, "f")], s)
    assert {tuple(r) for r in tables.upsert(old, new, ["id"], ["v"]).collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 2, "f")}
    assert [tuple(r) for r in tables.append_new(old, new, ["id"], ["v"]).collect()] == [(3, 1, "e")]


def test_eight_writers(spark, tmp_path):
    """Appends of eight writers, each run twice: 200 versions, none lost and none doubled."""
    from tracelake.streaming.jobs import append_once

    sink = append_once(str(tmp_path / "v"), ["id"], ["id"])
    for writer in range(8):
        batch = spark.createDataFrame([(f"{writer}-{i}", writer) for i in range(25)], "id string, author int").coalesce(1)
        sink(batch, writer), sink(batch, writer)
    got = spark.read.parquet(str(tmp_path / "v"))
    assert got.count() == 200 and got.select("author").distinct().count() == 8


def test_shared_version_excludes_stale(spark):
    edges = spark.createDataFrame([("commit", "f", "v1"), ("agent", "f", "v1"), ("stale", "f", "v0")], "src string, dst string, version string")
    tasks = spark.createDataFrame([("commit", None), ("agent", "x"), ("stale", "x")], "id string, source_adapter string")
    assert [tuple(r) for r in reports.shared_versions(edges, tasks).collect()] == [("commit", "agent")]


def test_histogram(spark):
    x = reports.histogram(spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (0.1, 0.9)], "apriori double, aposteriori double")).first()
    assert (x["green"], x["yellow"], x["red"], x["gold"]) == (1, 1, 1, 1)


def test_today(spark):
    rows = [("drifted", 1, at(9 * 3600), 0.5, 0), ("clean", 2, at(8 * 3600), 0.0, 0), ("old", 3, at(0), 0.9, 3)]
    got = reports.today(spark.createDataFrame(rows, "session string, id int, ts timestamp, drift double, secret_reads int"), F.lit(at(6 * 3600))).collect()
    assert [(r["session"], r["attention"]) for r in got] == [("drifted", True), ("clean", False)]


def test_touched_lines(spark):
    rows = [("t", i / 25, f"p{i:02d}") for i in range(25)]
    x = reports.touched_lines(spark.createDataFrame(rows, "task string, fused double, path string")).first()
    assert x["total"] == 25 and x["touched"].startswith("p24") and "p00" not in x["touched"] and x["touched"].endswith("+17 more")


def test_diff_falls_back_to_parent(spark):
    v = spark.createDataFrame([("s1", "f", "r1", None), ("s2", "f", "r9", None), ("s3", "f", "r1", "own")], "id string, parent_id string, source string, diff string")
    p = spark.createDataFrame([("f", "r1", "d1", at(0), "1"), ("f", "r2", "d2", at(5), "2")], "artifact_id string, source string, diff string, ts timestamp, id string")
    assert {r["id"]: r["diff"] for r in graph.diff_of(v, p).collect()} == {"s1": "d1", "s2": "d2", "s3": "own"}


def test_payload_round_trip_and_purge(spark, tmp_path):
    files = spark.createDataFrame([("a/x.py", "one"), ("b.py", "two"), ("c.py", "one")], "path string, text string")
    store = payload.put(files, "text")
    assert store.count() == 2
    key, other = "ab" * 32, "cd" * 32
    sealed = payload.seal(store, key)
    opened = payload.open_sealed(payload.rewrap(sealed, key, other), other)
    keys = lambda df: {bytes(r["k"]) for r in df.select(F.aes_decrypt("wrapped", F.unhex(F.lit(key)), F.lit("GCM")).alias("k")).collect()}
    assert len(keys(sealed)) == 2 and not keys(sealed) & keys(payload.seal(store, key)) and keys(sealed) == keys(sealed)
    assert sorted(bytes(r["content"]) for r in opened.collect()) == [b"one", b"two"]
    manifest = payload.checkpoint(files, F.lit(T0))
    key_ = manifest.first()["checkpoint_id"]
    assert payload.rewind(manifest, store, key_, str(tmp_path)) == 3 and (tmp_path / "a/x.py").read_text() == "one"
    bad = manifest.withColumn("rel_path", F.lit("../x"))
    with pytest.raises(ValueError):
        payload.rewind(bad, store, key_, str(tmp_path))
    v = spark.createDataFrame([(1, "t1", at(0), "r1", False), (2, "t1", at(9), "r1", False), (3, "t2", at(0), "r2", False)], "id int, task_id string, ts timestamp, ref string, payload_purged boolean")
    shelf = spark.createDataFrame([("r1",), ("r2",)], "ref string")
    marked, left, counts = payload.purge(v, shelf, F.lit(at(5)))
    assert [r["ref"] for r in left.collect()] == ["r1"] and tuple(counts.first()) == (2, 2, 1) and marked.where("payload_purged").count() == 2


def test_search(spark):
    tasks = spark.createDataFrame([("old", at(-200 * 86400), 0.0, [1.0, 0.0]), ("new", at(0), 0.0, [1.0, 0.0]), ("far", at(0), 0.0, [0.0, 1.0])], "id string, created_at timestamp, risk double, vec array<double>")
    pool = search.top_k(tasks, [1.0, 0.0], 3)
    assert [r["id"] for r in search.hybrid(pool, 1, F.lit(at(0))).collect()] == ["new"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), max_size=6), min_size=2, max_size=12))
def test_similar_pairs_match_brute_force(spark, sets):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, shingles array<bigint>")
    reps = {}
    for i, s in enumerate(sets):
        reps.setdefault(frozenset(s), i)
    want = {(min(i, j), max(i, j)) for a, i in reps.items() for b, j in reps.items() if i != j and a and b and len(a & b) / len(a | b) >= 0.5}
    assert {(r["a"], r["b"]) for r in search.similar_pairs(df).collect()} == want


def test_trees_and_lines(spark):
    s = "path string, text string"
    before, after = spark.createDataFrame([("a", "x\ny"), ("b", "k")], s), spark.createDataFrame([("a", "x\nz\nz"), ("c", "n")], s)
    hashed = lambda df: df.select("path", F.md5("text").alias("hash"))
    assert {tuple(r) for r in drift.tree_diff(hashed(before), hashed(after)).collect()} == {("a", "modified"), ("b", "deleted"), ("c", "added")}
    assert {tuple(r) for r in drift.line_delta(before, after).collect()} == {("a", 2, 1), ("b", 0, 1), ("c", 1, 0)}


def test_embed_equals_scalar(spark):
    from tracelake.functions import scalars as S

    rows = spark.createDataFrame([(1, "fix it"), (2, "fix the parser, the PARSER"), (3, "")], "id int, text string")
    want = {r["id"]: [round(x, 9) for x in r["v"]] for r in rows.select("id", S.local_embed(F.col("text"), 8).alias("v")).collect()}
    assert {r["id"]: [round(x, 9) for x in r["vec"]] for r in search.embed(rows, "id", "text", 8).collect()} == want


def test_spans_meet_in_pieces_without_pairs(spark, monkeypatch):
    """Counts and first versions equal brute force where keys are cut into many pieces; neither plan joins sessions with versions."""
    monkeypatch.setattr(drift, "VERSIONS", 40)
    monkeypatch.setattr(drift, "SESSIONS", 3)
    rng = random.Random(6)
    v = [(rng.choice([*"abcdefgh", None]), k, at(60 * rng.randrange(4000)), i, rng.choice([None, i])) for i in range(300) for k in [rng.choice([0, 1, None])]]
    spans = [(f"s{i}", rng.choice([0, 1, 2, None]), t, t + rng.randrange(3000)) for i in range(30) for t in [rng.randrange(4000)]]
    sessions = spark.createDataFrame([(s, k, at(60 * a), at(60 * b)) for s, k, a, b in spans], "session string, key int, first timestamp, last timestamp")
    changes = spark.createDataFrame(v, "artifact_id string, key int, ts timestamp, version int, lines int")
    first, counts = {}, {}
    for s, k, a, b in spans:
        near = [x for x in v if x[1] is not None and x[1] == k and at(60 * (a - 30)) <= x[2] <= at(60 * (b + 30))]
        first |= {(s, x[0]): (x[3], x[4]) for x in sorted(near, key=lambda x: (x[2], x[3]), reverse=True)}
        if near:
            counts[s] = (len(near), len({x[0] for x in near} - {None}))
    edges, found = drift.gap_fill(sessions, changes), drift.span_counts(sessions, changes)
    assert {(r["src"], r["dst"]): (r["version"], r["lines"]) for r in edges.collect()} == first and edges.count() == len(first)
    assert {r["session"]: (r["versions"], r["artifacts"]) for r in found.collect()} == counts
    assert drift.gap_fill(sessions.limit(0), changes).count() == drift.span_counts(sessions, changes.limit(0)).count() == 0


def test_turns_meet_versions_in_slots_without_pairs(spark, monkeypatch):
    """Drift equals brute force for short, long and endless spans, over several batches; no join, and no list of paths is shuffled."""
    monkeypatch.setattr(drift, "PATHS", 5)
    monkeypatch.setattr(drift, "SLOTS", tuple(7_200_000_000 * 4**i for i in range(3)))
    rng = random.Random(8)
    v = [(rng.choice([0, 1, None]), rng.choice([at(60 * rng.randrange(-20000, 20000)), None]), rng.choice([*"abcdefgh", "é", "zz", None])) for _ in range(400)]
    turns = [(i, rng.choice([0, 1, 2, None]), rng.choice([at(60 * t), None] if i % 7 == 0 else [at(60 * t)]), at(60 * (t + rng.choice([0, 40, 400, 3000, 30000]))), sorted(rng.sample("abcxyé", rng.randrange(4)))) for i in range(120) for t in [rng.randrange(-20000, 20000)]]
    frame = spark.createDataFrame(turns, "id int, key int, first timestamp, last timestamp, declared_so_far array<string>")
    found = drift.observed(frame, spark.createDataFrame(v, "key int, ts timestamp, path string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(turns)
    for i, k, a, b, said in turns:
        done = sorted({p for key, t, p in v if p and t and a and k is not None and key == k and a - timedelta(minutes=30) <= t <= b + timedelta(minutes=30)})
        undeclared, phantom = sorted(set(done) - set(said)), sorted(set(said) - set(done))
        score = (len(undeclared) + len(phantom)) / len(set(done) | set(said)) if done or said else 0.0
        assert (got[i]["done"], got[i]["drift"]["undeclared"], got[i]["drift"]["phantom"], got[i]["declared_so_far"]) == (done, undeclared, phantom, said)
        assert got[i]["drift"]["score"] == pytest.approx(score)
