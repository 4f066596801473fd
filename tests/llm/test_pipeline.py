import random

import pytest

import corpus_pipeline as P
from parchmint.llm import queries

WORDS = {"en": "the of and ing tion with that this for are".split(), "fr": "le la été ça où une des pour avec très".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where, rng = tmp_path_factory.mktemp("tables"), random.Random(0)
    text = lambda lang, n=60: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", str(rng.randrange(999))]) for _ in range(n))
    item = " ".join("".join(rng.choice("bcdfg") for _ in range(5)) for _ in range(20))
    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(80)]
    rows += [(100, rows[1][1], "en"), (101, "123 456", None), (102, None, "en"), (103, text("en") + " " + item, "en"), (104, text("en") + " password=abcdefghijklmnop", "en"), (105, text("en", 3000), "en"), (3, rows[3][1], "en")]
    df = spark.createDataFrame([(d, t, k, "s", len(t or "")) for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = ids(docs)
    clean = list(range(80))
    assert seen["language_id"] == sorted([*clean, 3, 100, 103, 104, 105])
    assert seen["simhash_near_dedup"] == sorted([*clean, 103, 104, 105])
    assert seen["decontamination"] == seen["secret_scan"] == sorted([*clean, 104, 105])
    hidden = docs.filter("doc_id = 104").first()
    assert "[SECRET]" in hidden.text and "abcdefghijklmnop" not in hidden.text and hidden.n_chars == len(hidden.text)
    packed = P.run(spark, folder)
    assert sorted({r.doc_id for r in packed.collect()}) == seen["secret_scan"]


def test_contract():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert P.QUERIES == {"pipeline": P.run} and len(P.STAGES) == 5


def test_scratch_tables_are_removed(spark):
    from parchmint.llm import common

    df = common.materialize(spark.range(5).toDF("a"), "kept")
    assert df.count() == 5 and common.clear_scratch(spark) >= 1 and common.clear_scratch(spark) == 0
