import random
import re

import corpus_pipeline as C
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, tmp_path):
    """Each stage on its own input: clean documents stay, planted cases are caught."""
    rng = random.Random(4)
    syllables = {"aa": ["lor", "mip", "sun", "tak", "vel"], "bb": ["çau", "éti", "ñor", "öst", "üme"]}
    word = lambda g: "".join(rng.choice(syllables[g]) for _ in range(rng.randint(1, 4)))
    text = lambda g, n: " ".join(word(g) for _ in range(n))
    clean = [(i, text(g := rng.choice("ab") * 2, rng.randint(40, 120)), g) for i in range(120)]
    passage, leak = text("aa", 60), text("bb", 40)
    docs = list(clean)
    docs += [(1000 + i, f"{text('aa', 50)}\n{passage}\n{text('aa', 50)}", "aa") for i in range(8)]
    docs += [(1100 + i, clean[0][1] + (" x" if i else ""), clean[0][2]) for i in range(4)]
    docs += [(1200 + i, f"{text('bb', 60)} {leak} {text('bb', 60)}", "bb") for i in range(3)]
    docs += [(1300, None, "aa"), (1301, "12 34", None), (1302, "", "bb")]
    spark.createDataFrame([(*d, "s", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, text("aa", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "pieces":
            assert now.columns == list(C.COLUMNS)
        assert set(range(1, 120)) <= set(seen[name]) and all(seen[name][i].text == t for i, t, _ in clean[1:])
    assert not {1300, 1301, 1302} & set(seen["language_id"])
    holders = [i for i, r in seen["line_dedup"].items() if passage in r.text]
    assert holders == [1007]
    before = [(i, r.text) for i, r in seen["line_dedup"].items()]
    assert set(seen["minhash"]) == {d for d, _, c in brute(before, 80) if d == c}
    assert not set(range(1100, 1104)) & set(seen["minhash"]) and 0 in seen["minhash"]
    assert not any(leak in r.text for r in seen["decontamination"].values())
    assert all(r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in seen["pieces"].values())
    assert {i: r.text for i, r in seen["pieces"].items()} == {i: r.text for i, r in seen["decontamination"].items()}


def test_run_on_the_small_tables(spark):
    rows = C.run(spark, SF).select("doc_id", "text", "n_tokens").collect()
    ids = [r.doc_id for r in rows]
    assert 0 < len(ids) == len(set(ids))
    assert all(r.n_tokens >= len(re.findall(r"\S+", r.text)) for r in rows)


def test_short_passages_of_the_benchmark_are_cut(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{text} {item} end", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = C.drop_benchmarks(spark, docs, str(tmp_path)).collect()
    assert row.text.split() == [*text.split(), "end"]
