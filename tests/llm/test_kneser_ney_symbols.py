"""op5's symbols are the bytes themselves."""

from vendora.llm import kneser_ney

GOOD = "мама мыла раму и папа пел"
MIXED = "мбна пьмв тблх к рбрб рдн"       # every byte in the sixteen of GOOD's
CASES = ["The Cat Sat", "tHE cAT sAT", "the cat 123", "the cat 977"]


def test_bytes_of_a_range_are_told_apart(spark):
    texts = [GOOD] * 3 + ["the cat sat 123"] * 3
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate([*texts, GOOD, MIXED, *CASES])], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    good, mixed, *cases = (got[len(texts) + i].log_prob for i in range(2 + len(CASES)))
    assert good > mixed + 10 and len({round(x, 3) for x in cases}) == len(CASES)
    assert cases[2] > cases[3]
