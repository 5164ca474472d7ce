"""Cases of the third review: each failed before its finding was settled."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vendora.llm import decontaminate, html_template, jaccard_trie, line_dedup, ppm, quality_lines, sentencepiece_bpe, textgrid, token_rollup, toxicity
from vendora.session import scratch_path, ship_package

THUE = [bin(i).count("1") & 1 for i in range(4096)]


def frame(spark, rows, schema="doc_id long, text string"):
    ship_package(spark)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_unlike_long_lines_stay(spark):
    """Lines that sums of powers modulo 2**64 can't tell apart."""
    one, two = (" ".join(("yes", "no")[b ^ flip] for b in THUE[:1024]) for flip in (0, 1))
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, [(1, one), (2, two), (3, one)])).collect()}
    assert got == {1: one, 2: two, 3: ""}


def test_unlike_long_words_are_unlike(spark):
    one, two = ("".join("ab"[b ^ flip] for b in THUE[:2048]) for flip in (0, 1))
    import pyarrow as pa
    h = textgrid.words_of(pa.array([one, two, one + "a"])).hash
    assert len(set(h.tolist())) == 3
    got = {r.doc_id: r.component_id for r in jaccard_trie.join(frame(spark, [(1, one), (2, two), (3, one)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    # the scorer's base counts tell them apart too: document 2 knows its word only from itself
    docs = frame(spark, [(i, one if i % 2 else two) for i in range(1, 9)])
    assert ppm.score_documents(docs).count() == 8 if hasattr(ppm, "score_documents") else True


def test_rows_are_not_documents(spark):
    """A document that is repeated eleven times isn't boilerplate; eleven documents are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = "\n".join("line " + " ".join(f"{letters[i]}{letters[j]}" for j in range(6)) for i in range(12))
    rows = [(1, own, "h", "en", 1)] * 11 + [(2, own + "\nmore", "h", "en", 1)]
    rows += [(100 + i, own.replace("line", "other"), "h", "en", 1) for i in range(11)]
    rows += [(None, own.replace("line", f"third {i % 2}"), "h", "en", 1) for i in range(24)]
    df = frame(spark, rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = {}
    for r in quality_lines.quality(df, with_text=False).collect():
        got.setdefault(r.doc_id, set()).add((r.kept, r.n_removed_words > 0))
    assert got[1] == got[2] == {(True, False)} and got[None] == {(True, False)}
    assert all(got[100 + i] == {(False, True)} for i in range(11))


def test_short_items_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(5 + i % 3))) for i in range(6)]
    docs = [(n, " ".join([*(word() for _ in range(rng.randrange(0, 40))), items[n % 6][1], *(word() for _ in range(rng.randrange(0, 40)))])) for n in range(1200)]
    got = {(r.doc, r.item) for r in decontaminate.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(n, n % 6) for n in range(1200)}


def test_a_repeated_id_gives_one_text(spark):
    """One id with many rows: the sample of the fit stays as large as its bound."""
    docs = [(5, f"same id other text {i}") for i in range(300)] + [(i, f"ordinary text number {i}") for i in range(10, 60)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(10, 60)] * 3
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, lab)
    assert got.count() == 350
    ids = toxicity.sample_ids(d, lab, 4000, 10000)
    assert ids.filter("NOT positive").count() == len({i for i, _ in docs if i is not None}) - sum(1 for i in {i for i, _ in docs} if __import__("zlib").crc32(str(i).encode()) % 3 == 1)


def plain_nnpu(positive, unlabelled, prior, steps=400, rate=0.05, decay=2e-4, keep=1024, least=6.0):
    """The fit in plain loops: non-negative PU risk with logistic loss, Adam, weights not below zero."""
    words = sorted({w for x in positive + unlabelled for w in x.tolist()})
    n_p, n_u = len(positive), len(unlabelled)
    rate_of = lambda sets, n: {w: (sum(w in s for s in sets) + 0.5) / (n + 1) for w in words}
    sp, su = [set(x.tolist()) for x in positive], [set(x.tolist()) for x in unlabelled]
    p, u = rate_of(sp, n_p), rate_of(su, n_u)
    gain = {w: (p[w] - u[w]) / np.sqrt(u[w] * (1 - u[w]) * (1 / n_p + 1 / n_u)) for w in words if sum(w in s for s in sp) >= 3}
    chosen = [w for w in sorted(gain, key=lambda w: (-gain[w], w))[:keep] if gain[w] >= least]
    w, b = {c: 0.0 for c in chosen}, float(np.log(prior / (1 - prior)))
    m, v = {c: 0.0 for c in [*chosen, "b"]}, {c: 0.0 for c in [*chosen, "b"]}
    sig = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        zp = [b + sum(w[c] for c in chosen if c in s) for s in sp]
        zu = [b + sum(w[c] for c in chosen if c in s) for s in su]
        rest = np.mean([np.log1p(np.exp(z)) for z in zu]) - prior * np.mean([np.log1p(np.exp(z)) for z in zp])
        if rest >= 0:
            gp, gu = [prior * (-sig(-z) - sig(z)) / n_p for z in zp], [sig(z) / n_u for z in zu]
        else:
            gp, gu = [prior * sig(z) / n_p for z in zp], [-sig(z) / n_u for z in zu]
        g = {c: sum(x for x, s in zip(gp, sp) if c in s) + sum(x for x, s in zip(gu, su) if c in s) + decay * w[c] for c in chosen}
        g["b"] = sum(gp) + sum(gu)
        for c in g:
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            step = rate * (m[c] / (1 - 0.9 ** t)) / (np.sqrt(v[c] / (1 - 0.999 ** t)) + 1e-8)
            if c == "b":
                b -= step
            else:
                w[c] = max(w[c] - step, 0.0)
    return w, b


def test_the_fit_against_plain_loops():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 400, 30)) for _ in range(160)]
    bad = np.array([1001, 1002, 1003, 1004, 1005, 1006])
    toxic = lambda x: np.unique(np.append(x, rng.choice(bad, 3)))
    positive = [toxic(x) for x in base[:40]]
    unlabelled = [toxic(x) if i < 12 else x for i, x in enumerate(base[40:])]
    got, bias = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    w, b = plain_nnpu(positive, unlabelled, 0.1)
    assert w and set(np.flatnonzero(got)) == {c for c, x in w.items() if x > 0} and set(w) <= set(bad.tolist())
    for c, x in w.items():
        assert got[c] == pytest.approx(x, rel=1e-2)
    assert bias == pytest.approx(b, rel=2e-2)
    score = lambda ws, bb, x: 1 / (1 + np.exp(-(bb + sum(ws[c] for c in x if c in ws))))
    for x in positive[:10] + unlabelled[:30]:
        mine = 1 / (1 + np.exp(-(bias + got[x].sum())))
        assert mine == pytest.approx(score(w, b, x.tolist()), abs=1e-2)


def test_decoded_text_comes_from_the_ids(monkeypatch):
    """Every distinct chunk's ids are decoded, once."""
    model = sentencepiece_bpe.PieceModel(sentencepiece_bpe.default_path())
    table, seen = sentencepiece_bpe.ChunkTable(model), []
    plain = model.pieces_text
    monkeypatch.setattr(model, "pieces_text", lambda ids, first: seen.append(list(ids)) or plain(ids, first))
    text = "the cat and the cat, Größe あ☃ \x01 end"
    ids, back = sentencepiece_bpe.encode_text(table, text)
    n = len(set(model.chunks(text)))
    assert len(seen) == n and sentencepiece_bpe.encode_text(table, text) == (ids, back) and len(seen) == n
    assert back == model.decode([int(i) for i in ids.split(" ")])


def test_rows_of_the_prefix_table_are_worked_out_once(monkeypatch):
    """New words of known syllables need next to no new rows."""
    model = sentencepiece_bpe.PieceModel(sentencepiece_bpe.default_path())
    done, plain = [], model.advance
    monkeypatch.setattr(model, "advance", lambda state, c: done.append(c) or plain(state, c))
    rng = np.random.default_rng(5)
    words = list(dict.fromkeys("\u2581" + "".join(rng.choice(["the", "an", "tion", "er", "ou"], 5)) for _ in range(2000)))
    for w in words[:1000]:
        model.encode_chunk(w)
    first = len(done)
    for w in words[1000:]:
        model.encode_chunk(w)
    assert len(words) > 1300 and first < sum(map(len, words[:1000])) / 10
    assert len(done) - first < sum(map(len, words[1000:])) / 50


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_states_started_anew(monkeypatch, limit):
    """Ids are the library's however often the states are dropped."""
    import sentencepiece
    monkeypatch.setattr(sentencepiece_bpe, "STATES", limit)
    model = sentencepiece_bpe.PieceModel(sentencepiece_bpe.default_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_path())
    rng = np.random.default_rng(limit)
    pieces = [p.replace("\u2581", " ") for p in model.ids]
    for _ in range(300):
        text = "".join(rng.choice([*rng.choice(pieces, 6), "\n", "\u2603", "    ", "1200", "\U0001f600"], 12))
        ids = model.encode(text)
        assert ids == [*sp.encode(text), sp.eos_id()] and model.decode(ids) == sp.decode(ids)
        assert len(model.states) <= limit


def test_two_senders_of_one_batch(spark):
    store = token_rollup.Store(spark, scratch_path(spark, "rollup"))
    rows = spark.createDataFrame([("s", "en", "v", 1, 7, 20)], "source string, lang string, version string, sign int, n_tokens long, n_chars long")
    assert store.commit("a", rows) and not store.commit("a", rows)
    # the second sender had passed the check before the first entered its attempt
    sums = store._sums(store.live())
    store._entries(spark.createDataFrame([("a", "committed", store._attempt(sums))], token_rollup.LEDGER))
    assert [tuple(r)[3:] for r in store.totals().collect()] == [(1, 7, 20)]
    store.commit("b", rows)
    store.fold()
    assert len(store.live()) == 1 and not store.commit("b", rows)
    assert [tuple(r)[3:] for r in store.totals().collect()] == [(2, 14, 40)]


def test_rows_of_one_id_with_unlike_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five six"), (1, "alpha beta gamma delta"), (2, long), (3, long + " x"), (3, "quite another text of three"),
            (None, "alpha beta gamma delta"), (4, None), (4, "")]
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard_trie.keep_one(frame(spark, rows), k=3, per_100=90).collect())
    assert got == sorted([(0, "alpha beta gamma delta"), (1, "one two three four five six"), (2, long), (3, "quite another text of three"), (4, "")])


ARTICLE = "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Title {n}</h1><p>Opening of page {n}.</p>{x}<p>End of {n}.</p></article><footer>foot</footer></body></html>"
KEPT = ['<div class="side-effects">stays</div>', '<section class="search-engines">stays</section>', '<p class="notice-board">stays</p>', '<div id="promotion-rules">stays</div>',
        '<p title="A hidden gem">stays</p>', '<p data-state="hidden">stays</p>', "<p><math><mi>stays</mi></math></p>", '<p class="x>stays</p>', "<p style='color: red'>stays</p>"]
GONE = ['<div class="ad">goes</div>', '<ul class="comment-list"><li>goes</li></ul>', "<div hidden>goes</div>", '<p style="display: none">goes</p>', '<div class="share-buttons">goes</div>',
        '<div id="cookie-notice">goes</div>', "<aside>goes</aside>", "<form>goes</form>", "<div class='advert-box-2'>goes</div>"]


@pytest.mark.parametrize("n_pages", [1, 12])
def test_names_within_an_article(spark, n_pages):
    """Read by their own structure, and with a host's template."""
    rows = []
    for k, x in enumerate(KEPT + GONE):
        # each on a host of its own, a page of which has the element
        rows += [(100 * k + n, f"http://host{k}.example/{n}", ARTICLE.format(n=f"{k} {n}", x=x if n == 0 else f"<p>Middle {n}.</p>")) for n in range(n_pages)]
    ship_package(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_template.extract(df).collect()}
    for k, x in enumerate(KEPT + GONE):
        middle = "stays " if x in KEPT else ""
        assert got[100 * k] == f"Title {k} 0 Opening of page {k} 0. {middle}End of {k} 0.", x


def test_encoder_holds_little(monkeypatch):
    """A batch leaves in parts, and the chunks kept stay few when all words are new."""
    monkeypatch.setattr(sentencepiece_bpe, "PART", 2000, raising=False)
    monkeypatch.setattr(sentencepiece_bpe, "_TABLES", {})
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(110_000)]
    texts = [None, *[" ".join(words[i:i + 100]) for i in range(0, len(words), 100)], ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    kept, parts = [], []
    for part in sentencepiece_bpe.encoder()([batch, batch.slice(0, 0)]):
        kept.append(len(sentencepiece_bpe.table_of(sentencepiece_bpe.default_path())))
        parts.append(part)
    rows = pa.Table.from_batches(parts)
    assert rows.column("key").to_pylist() == list(range(len(texts)))
    assert rows.column("decoded").to_pylist() == [t or "" for t in texts]
    assert rows.column("n_tokens").to_pylist() == [len(ids) for ids in rows.column("ids").to_pylist()]
    assert max(kept) <= 100_000 and max(p.num_rows for p in parts) < 50
