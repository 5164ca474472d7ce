"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names, for each operator and each stage of the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vendora.llm import (decontaminate, html_template, jaccard_trie, kneser_ney, line_dedup, ppm, quality_lines,
                         sentencepiece_bpe, token_rollup, toxicity)
from vendora.session import scratch_path, ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, doc int, digest string, n long, line string, node int, n_lines int, score string, label int"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "k", 1, "d", 2, "l", 3, 4, "s", 5)


ROWS = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, PASSAGE), row(5, PASSAGE), row(5, PASSAGE), row(6, LONG),
        row(7, f"{PASSAGE}\nand other words that stand alone here é漢 😀"), row(None, "a row without an id but with some words"),
        row(8, "short", None, None), row(9, PASSAGE.replace("seven", "7")), row(10, "\x00 odd \x0b bytes �")]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, None), (7, 0, 1), (None, 1, 1), (9, None, 0)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, PASSAGE), (4, "never in any of these documents at all today")], "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_line_dedup(docs, none):
    got = line_dedup.dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_removed", "n_near", "all_removed"}
    rows = got.collect()
    assert len(rows) == len(ROWS)
    r = {x.doc_id: x for x in rows}
    assert r[1].text is None and r[2].text == "" and r[3].text == " \n\t " and r[4].text == PASSAGE
    assert r[5].text == "" and r[5].all_removed and r[9].text == "" and r[9].n_near == 1
    assert [x.n_removed for x in rows if x.doc_id == 5] == [1, 1]           # repeated rows alike
    assert r[7].text == "and other words that stand alone here é漢 😀" and r[7].n_lines == 2
    assert r[6].text == LONG and r[8].text == "short" and r[None].n_removed == 0
    assert line_dedup.dedup(none).collect() == []


def test_quality(docs, none):
    rows = quality_lines.quality(docs, max_docs=2).collect()
    assert len(rows) == len(ROWS)
    r = {x.doc_id: x for x in rows}
    assert (r[1].n_words, r[1].word_chars, r[1].base_failed, r[1].kept) == (0, 0, True, False)
    assert r[5].n_words == 12 and r[5].clean_text == "" and r[7].clean_text.startswith("and other") and r[8].clean_text == "short"
    assert r[6].n_words == 60_000 and r[6].base_failed is True              # its three-word windows repeat
    assert quality_lines.quality(none).collect() == []


def test_decontaminate(docs, none, items, spark):
    got = {(r.doc, r.item) for r in decontaminate.search(docs, items).collect()}
    assert got == {(d, i) for d in (4, 5, 7) for i in (1, None)}
    assert decontaminate.search(none, items).collect() == []
    assert decontaminate.search(docs, items.limit(0)).collect() == []
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 6, 8, 9, 10]


def test_toxicity(docs, none, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score_documents(none, labels).collect() == []
    assert all(r.score < 0.01 for r in toxicity.score_documents(docs, labels.limit(0)).collect())


def test_kneser_ney(docs, none, labels):
    rows = kneser_ney.classify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    r = {x.doc_id: x for x in rows}
    assert not r[1].kept and not r[2].kept and r[1].n_symbols == 1 and r[4].perplexity > 0
    assert kneser_ney.classify(none, labels).collect() == []
    flat = kneser_ney.classify(docs, labels.limit(0)).collect()
    assert all(abs(x.perplexity - kneser_ney.SIZE) < 1e-3 for x in flat)


def test_sentencepiece(docs, none):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    full = sentencepiece_bpe.encode_documents(docs).collect()
    assert sorted(len(r.ids) for r in full) == sorted(len(sp.encode(r[1] or "")) + 1 for r in ROWS)
    for r in sentencepiece_bpe.encode_documents(docs, with_text=False).collect():
        ids = sp.encode(next(x[1] for x in ROWS if x[0] == r.doc_id) or "") + [sp.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(none).collect() == []


def test_rollup(docs, none, spark):
    counts = token_rollup.count_documents(docs, "v")
    rows = counts.collect()
    assert len(rows) == len(ROWS) and {r.key: r.n_tokens for r in rows}[1] == 0
    store = token_rollup.Store(spark, scratch_path(spark, "t"))
    assert store.totals().collect() == []
    assert store.commit("a", token_rollup.inserts(counts)) and not store.commit("a", token_rollup.inserts(counts))
    assert store.commit("nothing", token_rollup.inserts(token_rollup.count_documents(none, "v")))
    total = {(r.source, r.lang): r.n_docs for r in store.totals().collect()}
    assert total == {("s", "en"): len(ROWS) - 1, (None, None): 1}
    store.fold()
    assert len(store.live()) == 1 and {(r.source, r.lang): r.n_docs for r in store.totals().collect()} == total
    store.commit("b", token_rollup.deletes(counts))
    assert store.totals().collect() == []


def test_ppm(docs, none):
    rows = ppm.score_documents(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in rows)
    r = {x.doc_id: x for x in rows}
    assert r[1].n_tokens == 1 and r[1].score == r[2].score == r[3].score and r[6].n_tokens == 60_001
    assert len({x.score for x in rows if x.doc_id == 5}) == 1
    assert ppm.score_documents(none).collect() == []
    flat = ppm.score_documents(docs, train=F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 for x in flat)


def test_jaccard(docs, none):
    rows = jaccard_trie.join(docs).collect()
    assert len(rows) == len(ROWS)
    r = {x.doc_id: x for x in rows}
    assert (r[1].n_shingles, r[1].component_id) == (0, 1) and r[3].component_id == 3
    assert r[4].component_id == r[5].component_id == 4 and r[4].n_shingles == 10 and r[9].component_id == 9
    assert r[8].n_shingles == 1 and r[None].component_id is None
    assert jaccard_trie.join(none).collect() == []
    kept = jaccard_trie.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_html(spark):
    ship_package(spark)
    page = ("<html><body><nav>menu</nav><header>top</header><div class='cookie-notice'>we use</div><main><article><h1>Head &amp; more</h1>"
            "<p>First&nbsp;line <b>bold</b>\n text<p>Second {}<aside>side</aside><form>f</form><script>x('</p>')</script><br>tail</article>"
            "<section id=comments><p>reader says</p></section></main><div class=ad>buy</div><footer>foot</footer></body></html>")
    rows = [(i, f"http://h.example/{i}", page.format(f"number {i}"), 9) for i in range(8)]
    rows += [(20, None, page.format("x"), 9), (21, "http://other.example/", None, 9), (22, "http://h.example/", "", 9), (23, "http://h.example/a", "<p>bare <i>text", 9), (None, "http://h.example/0", rows[0][2], 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html_template.extract(pages).collect()
    r = {x.page_id: x for x in got}
    assert len(got) == len(rows) and r[21].text == "" and r[22].text == "" and r[23].text == "bare text"
    for i in range(8):
        assert r[i].text == f"Head & more First line bold text Second number {i} tail" and r[i].n_chars == len(r[i].text)
    assert r[20].text == "Head & more First line bold text Second x tail" and r[None].text == r[0].text
    assert html_template.extract(pages.limit(0)).collect() == []


def test_pipeline_stages(docs, none, labels, items, spark):
    folder = scratch_path(spark, "tables")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        left[name] = sorted(r.doc_id or 0 for r in got.collect())
        if name != "sentencepiece":
            assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert stage(spark, none, folder).collect() == []
    assert left["line_dedup"] == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert left["ngram_jaccard"] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert left["decontamination"] == [0, 1, 2, 3, 6, 8, 9, 10]
    assert len(left["sentencepiece"]) == len(ROWS)
