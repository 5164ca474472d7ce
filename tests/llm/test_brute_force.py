"""Each query on the smallest tables against a plain Python version, DuckDB, the
sentencepiece library or held-out labels."""

import collections
import hashlib
import html as entities
import math
import random
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF_SMALL
from vendora.llm import decontaminate, jaccard_trie, kneser_ney, ppm, textgrid, toxicity
from vendora.llm.registry import table
from vendora.session import ship_package

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def rows(name, cols):
    return duckdb.sql(f"SELECT {cols} FROM '{SF_SMALL}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(rows("documents", "doc_id, text"))


def run(spark, name):
    return E.queries()[name](spark, SF_SMALL)


@pytest.mark.parametrize("name", ["op2_quality_lines", "op3_decontaminate"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = run(spark, name).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()[list(got.columns)]
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


# a character of a script without spaces is a word; two of them count as one word of a line's length
LONE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in textgrid.UNSPACED.tolist()) + "]"
UNIT = re.compile(rf"{LONE}|(?:(?!{LONE})[a-z0-9\u0080-\U0010ffff])+")


def dedup_lines(docs):
    """Lines that stay, by document: equal lines go at any length, long ones also when they
    are one edit away from an earlier long line."""
    seen, long, changed, longer, out = set(), set(), set(), set(), {}
    for d, t in sorted(docs.items()):
        stay = []
        for line in (t or "").split("\n"):
            w = tuple(UNIT.findall(line.translate(UPPER)))
            if not w:
                stay.append(line)
                continue
            if w in seen:
                continue
            seen.add(w)
            if sum(1 if re.fullmatch(LONE, x) else 2 for x in w) < 10:
                stay.append(line)
                continue
            without = [w[:p] + w[p + 1:] for p in range(len(w))]
            near = w in longer or any(v in long or (p, v) in changed for p, v in enumerate(without))
            long.add(w)
            longer.update(without)
            changed.update(enumerate(without))
            if not near:
                stay.append(line)
        out[d] = "\n".join(stay) if t else t
    return out


def test_line_dedup(spark, texts):
    want = dedup_lines(texts)
    got = {r.doc_id: r for r in run(spark, "op1_line_dedup").collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert sum(r.n_near for r in got.values()) > 0


def components(docs, per_100=90, k=3):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall((t or "").translate(UPPER))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= per_100 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op10_jaccard_trie").collect()}
    assert got == components(texts)


def test_jaccard_families(spark):
    """Copies with a few words changed, chains of copies of copies, and shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(60)]
    docs, n = {}, 0
    for _ in range(6):
        base = [word() for _ in range(rng.randint(40, 160))]
        chain = list(base)
        for _ in range(14):
            copy = list(rng.choice([base, chain]))
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            chain = copy
            docs[n] = " ".join(copy)
            n += 1
    for _ in range(12):
        docs[n] = " ".join(shared + [word() for _ in range(rng.randint(0, 30))])
        n += 1
    for t in ("a", "a b", "a b", "a b c", "A B c", "a b c d", "", " "):
        docs[n] = t
        n += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    ship_package(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_trie.join(df).collect()}
    want = components(docs)
    assert got == want and len({c for _, c in want.values()}) < n - 20


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_dense(spark, seed):
    """Short texts that share most of their words, so that nearly every pair is close to the limit."""
    rng = random.Random(seed)
    base = [f"{'x' * rng.randint(1, 6)}{i}" for i in range(60)]
    docs = {}
    for n in range(150):
        w = list(base[:rng.randint(8, 60)])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice([f"own{n}", "alt1", "alt2", rng.choice(base)])
        if rng.random() < 0.2:
            w = w[rng.randint(0, 3):]
        docs[n] = " ".join(w)
    ship_package(spark)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_trie.join(df).collect()}
    assert got == components(docs)


def test_toxicity_held_out(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    ship_package(spark)
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    got = E.queries()["op4_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    hits = [y for _, y, p in held if p]
    assert auc > 0.93 and sum(hits) / len(hits) > 0.75 and sum(hits) / len(pos) > 0.7


def test_toxicity_labels_of_the_held_out_fold_are_not_read(spark):
    ship_package(spark)
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    a = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels.filter(~toxicity.held_out())).collect()}
    assert a == b


def test_html(spark):
    got = {r.page_id: r.text for r in run(spark, "op6_html_template").collect()}
    for page, source in rows("pages", "page_id, html"):
        article = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1|div|li)[^>]*>", article)]
        assert got[page] == " ".join(x for x in parts if x)


def test_sentencepiece(spark, texts):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run(spark, "op7_sentencepiece").collect():
        ids = sp.encode(texts[r.doc_id]) + [sp.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_prefix_table_random():
    import sentencepiece

    from vendora.llm import sentencepiece_bpe as m
    sp = sentencepiece.SentencePieceProcessor(model_file=m.default_path())
    known, rng = m.table_of(m.default_path()), random.Random(1)
    letters = "ab the  \n\t ▁é漢字😀<s></s>\x00�﷽ing.%&1200"
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = sp.encode(t) + [sp.eos_id()]
        assert m.encode_text(known, t) == (" ".join(map(str, ids)), sp.decode(ids))


def test_rollup(spark):
    from vendora.llm import token_rollup as tr
    enc, want, seen = tr.encoding_of(tr.default_path()), collections.Counter(), set()
    for _, text, lang, source in rows("documents", "doc_id, text, lang, source"):
        if text not in seen:
            seen.add(text)
            for what, n in (("docs", 1), ("tokens", len(enc.encode_ordinary(text)) + 1), ("chars", len(text))):
                want[source, lang, what] += n
    got = collections.Counter()
    for r in run(spark, "op8_token_rollup").collect():
        assert r.version == "byte_bpe_50k+end"
        for what, n in (("docs", r.n_docs), ("tokens", r.n_tokens), ("chars", r.n_chars)):
            got[r.source, r.lang, what] += n
    assert got == want


def ppm_model(train, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for sym in train:
        padded = [257] * order + sym
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][tuple(padded[i - k:i])][padded[i]] += 1
    return counts


def ppm_log(counts, order, context, s):
    """log10 P(s | context), going down the orders with the set of ruled-out symbols."""
    out, ruled = 0.0, set()
    for k in range(order, -1, -1):
        seen = counts[k].get(tuple(context[len(context) - k:]), {})
        left = {x: n for x, n in seen.items() if x not in ruled}
        total = sum(left.values())
        if total:
            if s in left:
                return out + math.log10((2 * left[s] - 1) / (2 * total))
            out += math.log10(len(left) / (2 * total))
        ruled |= set(seen)
    return out - math.log10(257 - len(ruled))


def symbols(text):
    return [*" ".join(WORD.findall(text.translate(UPPER))).encode(), 256]


def test_ppm(spark, texts):
    order = ppm.ORDER
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = ppm_model([symbols(t) for d, t in texts.items() if not held[d]], order)
    tokens = {d: [*WORD.findall(t.translate(UPPER)), None] for d, t in texts.items()}
    known = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(known.values()), len(known)
    got = {r.doc_id: r for r in run(spark, "op9_ppm_score").collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (held[d], n, len(tokens[d]), sum(known[w] > 0 for w in tokens[d]))
        assert r.base_score == pytest.approx(sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d]), rel=1e-9)
        if held[d] or len(texts[d]) < 1500:
            padded = [257] * order + symbols(texts[d])
            want = sum(ppm_log(counts, order, padded[i - order:i], padded[i]) for i in range(order, len(padded)))
            assert r.score == pytest.approx(want, rel=1e-5)
    # a distribution: all symbols of a context together
    for context in ([257] * order, [*b" the "][-order:], [1] * order):
        assert sum(10 ** ppm_log(counts, order, context, s) for s in range(257)) == pytest.approx(1)


def kn_model(train):
    """P(s | context) of the interpolated modified Kneser-Ney model, from its definition."""
    grams = collections.Counter()
    for sym in train:
        padded = [kneser_ney.EDGE] * (kneser_ney.ORDER - 1) + sym
        for i in range(len(sym)):
            grams[tuple(padded[i:i + kneser_ney.ORDER])] += 1
    orders = {kneser_ney.ORDER: grams}
    for k in range(kneser_ney.ORDER - 1, 0, -1):
        orders[k] = collections.Counter(g[1:] for g in orders[k + 1])
    cuts, followers = {}, {}
    for k, c in orders.items():
        n1, n2, n3, n4 = (sum(x == j for x in c.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0
        cuts[k] = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 / n3 if n3 else 0)] if n1 and n2 else [0.5, 0.75, 0.9]
        cuts[k] = [max(0, x) for x in cuts[k]]
        followers[k] = collections.defaultdict(dict)
        for g, x in c.items():
            followers[k][g[:-1]][g[-1]] = x

    def p(context, s):
        k = len(context) + 1
        lower = p(context[1:], s) if context else 1 / kneser_ney.SIZE
        f = followers[k].get(tuple(context))
        if not f:
            return lower
        d = cuts[k]
        total, mass = sum(f.values()), sum(d[min(x, 3) - 1] for x in f.values())
        own = f[s] - d[min(f[s], 3) - 1] if s in f else 0
        return own / total + mass / total * lower
    return p


def test_kneser_ney(spark, texts):
    good = {d for d, q in rows("labels", "doc_id, quality") if q == 1}
    fold = lambda t: [*kneser_ney.FOLD[list(t.encode())].tolist(), kneser_ney.EDGE] if t else [kneser_ney.EDGE]
    p = kn_model([fold(t) for d, t in texts.items() if d in good])
    got = {r.doc_id: r for r in run(spark, "op5_kneser_ney").collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        if len(t) > 1500:
            continue
        sym = fold(t)
        padded = [kneser_ney.EDGE] * (kneser_ney.ORDER - 1) + sym
        want = sum(math.log10(p(padded[i:i + kneser_ney.ORDER - 1], s)) for i, s in enumerate(sym))
        assert got[d].log_prob == pytest.approx(want, rel=1e-4) and got[d].n_symbols == len(sym)
    assert sum(r.kept for d, r in got.items() if d in good) >= 0.97 * len(good)


def test_pipeline(spark, texts):
    """Each stage against a plain version on what the stage before kept."""
    docs = table(spark, SF_SMALL, "documents")
    items = rows("benchmark", "item_id, text")
    scores = {r.doc_id: r.predicted for r in run(spark, "op4_toxicity").collect()}
    left = {d: t for d, t in texts.items() if not scores[d]}
    stage = dict(corpus_pipeline.STAGES)
    ship_package(spark)

    def check(name, docs, want):
        from vendora.llm.registry import written
        got = written(stage[name](spark, docs, SF_SMALL), "t")
        assert {r.doc_id: r.text for r in got.select("doc_id", "text").collect()} == want
        return got

    docs = check("toxicity", docs, left)
    lines = dedup_lines(left)
    left = {d: t for d, t in lines.items() if t == texts[d] or t.split()}
    docs = check("line_dedup", docs, left)
    left = {d: left[d] for d, (_, c) in components(left, per_100=80, k=5).items() if c == d}
    docs = check("ngram_jaccard", docs, left)

    def shingles(t):
        w = ALNUM.findall(t.translate(UPPER))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    tests = [shingles(t) for _, t in items]
    left = {d: t for d, t in left.items() if not any(s and 100 * len(s & shingles(t)) >= decontaminate.PER_100 * len(s) for s in tests)}
    check("decontamination", docs, left)
    last = {r.doc_id: r for r in E.queries()["pipeline"](spark, SF_SMALL).collect()}
    assert {d: r.decoded for d, r in last.items()} == left and all(r.n_tokens == len(r.ids) for r in last.values())
