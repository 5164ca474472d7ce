"""op5 counts trusted texts where they are read; only doubtful ones are joined."""

import collections

import pyarrow as pa
import pytest

from vendora.llm import kneser_ney
from vendora.llm.registry import prepare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark):
    prepare(spark)
    keys = [None, *range(400), *range(0, 400, 10)]          # a null id, and ids that come twice
    src = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "key long, text string").repartition(3)
    trusted = spark.createDataFrame([(None,), *((k,) for k in range(0, 400, 3)), (9999,)], "key long")
    want = collections.Counter(f"text {i}" for i, k in enumerate(keys) if k is not None and k % 3 == 0)
    return src, trusted, want


def test_certain_texts_are_not_shuffled(spark):
    src, trusted, want = frames(spark)
    src = src.coalesce(1).localCheckpoint()
    certain, *doubtful = kneser_ney.of_trusted(src, trusted, lambda batches: batches, "text string", 2)
    assert "Exchange" not in plan(certain)
    sure = collections.Counter(r.text for r in certain.collect())
    assert sum(sure.values()) >= 0.9 * sum(want.values())
    assert sure + collections.Counter(r.text for x in doubtful for r in x.collect()) == want


@pytest.mark.parametrize("most", [15, 16])
def test_full_bitmaps_leave_the_rows_to_the_join(spark, most, monkeypatch):
    src, trusted, want = frames(spark)
    # hashes of few different values: most keys share theirs with others
    few = lambda bits, keys: real(bits, keys & 7)
    real, bitmap = kneser_ney.hits, kneser_ney.bitmap
    monkeypatch.setattr(kneser_ney, "hits", few)
    monkeypatch.setattr(kneser_ney, "bitmap", lambda keys, column, most: bitmap(keys.selectExpr(f"{column} & 7 AS {column}"), column, most))
    certain, doubtful = kneser_ney.of_trusted(src, trusted, lambda batches: batches, "text string", 2, most)
    got = collections.Counter(r.text for x in (certain, doubtful) for r in x.collect())
    assert got == want and doubtful.count() > 100


def test_texts_travel_once_and_compressed(spark):
    prepare(spark)
    texts = ["", "a" * 5_000_000, *("the cat sat on the mat. " * 40 + str(i) for i in range(60))]
    src = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "key long, lang string, text string")
    batches = [b for b in kneser_ney.packed(src.selectExpr("0 AS block", "*").toArrow().to_batches())]
    tab = pa.Table.from_batches(batches)
    assert tab.nbytes < sum(map(len, texts)) / 3
    assert [t for part in kneser_ney.unpacked(tab) for t in part.column("text").to_pylist()] == texts
    scored = kneser_ney.score(src, spark.range(40, 60).selectExpr("id AS key"))
    assert {r.key: r.n_symbols for r in scored.collect()} == {i: len(t) + 1 for i, t in enumerate(texts)}
    assert "ReusedExchange" in plan(scored)
