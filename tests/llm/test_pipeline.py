import random

import corpus_pipeline
from tracelake.llm import registry


def test_stages(spark, docs, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "on", "and", "re"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    plain = [(i, "\n".join(line(12) for _ in range(4)), "en", f"s{i % 3}", 0) for i in range(40)]
    item, passage = line(25), "\n".join(line(15) for _ in range(8))
    rows = [
        *plain, (100, plain[3][1], "en", "s0", 0), (101, plain[3][1].upper().split("\n")[0], "en", "s0", 0), (102, plain[4][1].split("\n")[0], "en", "s0", 0), (103, plain[4][1].split("\n")[0].upper(), "en", "s0", 0),
        (104, f"{line(9)} {item} {line(9)}", "en", "s1", 0), (105, None, "en", "s1", 0), (106, "12 34", None, None, 0), (107, f"{line(20)}\n{passage}", "en", "s1", 0), (108, f"{line(21)}\n{passage}\n{line(22)}", "en", "s2", 0),
    ]
    docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, sets = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = str(tmp_path / name.replace(" ", "-"))
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns
        out.write.parquet(at)
        kept = spark.read.parquet(at)
        sets.append({r["doc_id"]: r["text"] for r in kept.collect()})
    ids = {r[0] for r in rows}
    assert set(sets[0]) == ids - {105, 106} == set(sets[1])
    assert sets[1][107] == rows[-2][1] and len(sets[1][108]) < len(rows[-1][1]) - 60 and sets[1][100] == ""
    assert set(sets[2]) == set(sets[1]) - {103} and set(sets[3]) == set(sets[2]) - {104}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.select("doc_id").collect()} == set(sets[3])
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registry():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
