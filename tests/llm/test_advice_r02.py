"""Cases of the second review: each failed before its finding was settled."""

import random
import re

import pytest

import corpus_pipeline
from vendora.llm import html_template, jaccard_trie, line_dedup
from vendora.session import ship_package


def near_components(docs, k, per_100):
    """Smallest id of each document's component, from all pairs."""
    sets = {}
    for d, t in docs.items():
        w = t.split()
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
    return {d: top(d) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_the_pipeline(spark, seed):
    """The stage against all pairs at five words and 0.8, with random word changes."""
    rng = random.Random(seed)
    docs, n = {}, 0
    for size in (12, 60, 100, 120, 300, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(8):
            copy = list(base)
            for at in rng.sample(range(size), rng.randint(0, 1 + size // 30)):
                copy[at] = f"own{n}"
            docs[n] = " ".join(copy)
            n += 1
    want = near_components(docs, 5, 80)
    assert want != near_components(docs, 3, 90)
    ship_package(spark)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_trie.join(df, k=5, per_100=80).collect()} == want
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == {d for d, c in want.items() if d == c}


LETTERS = r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]"
UNITS = re.compile(rf"{LETTERS}|(?:(?!{LETTERS})[a-zA-Z0-9\u0080-\U0010ffff])+")


def deduped(docs):
    """Lines that stay, each held against all earlier ones."""
    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:p] + b[p + 1:] == a for p in range(len(b)))

    def long(w):
        return sum(1 if re.fullmatch(LETTERS, x) else 2 for x in w) >= 10
    seen, out = [], {}
    for d, t in sorted(docs.items()):
        stay = []
        for line in t.split("\n"):
            w = UNITS.findall(line.lower())
            if not w or not any(w == v or (long(w) and long(v) and one_edit(w, v)) for v in seen):
                stay.append(line)
            seen.append(w)
        out[d] = "\n".join(stay)
    return out


def test_short_and_unspaced_lines(spark):
    """Equal lines of any length go; near lines of scripts without spaces too."""
    zh, th, ja = "我们今天在北京的公园里看见了很多红色的花", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวน", "今日はとても天気がいいので散歩に行きました"
    docs = {1: f"All rights reserved.\nmenu\n\n---\n{zh}\n短い行です", 2: f"one two\n{zh.replace('红', '白')}\nall RIGHTS reserved\n---\n{th}",
            3: f"menu\n{zh}\none three\n{th[:-1]}\n短い列です", 4: f"{ja} in 2020\nOne two\n短い行です\n𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉𠀊", 5: f"{ja}in 2020\n𠀀𠀁𠀂𠀃𠀅𠀆𠀇𠀈𠀉𠀊\n{zh[:9]}", 6: "menu"}
    rng = random.Random(3)
    for d in range(10, 40):
        docs[d] = "\n".join("".join(rng.choice("天地人 a") for _ in range(rng.randint(0, 14))) for _ in range(12))
    ship_package(spark)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    want = deduped(docs)
    assert {d: r.text for d, r in got.items()} == want
    assert want[3] == "one three\n短い列です" and got[6].all_removed and got[2].n_near == 1


def extracted(spark, pages):
    ship_package(spark)
    rows = [(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return [r.text for r in sorted(html_template.extract(df).collect())]


def test_html_copies(spark):
    """A host of copies of one page, with scripts, menus and markup of their own, beside other pages."""
    page = "<html><head><title>t</title></head><body><nav>menu {0}</nav><script>x={0}</script><div class=top>All news</div><article><p>{1}</p><p>{2}</p></article></body></html>"
    copies = [page.format(i, "Head", "The one text of the copies.") for i in range(60)]
    copies += [c.replace("<article>", "<article class=print>") for c in copies[:20]]
    others = [page.format(i, f"Title {i}", f"A text of its own, number {i}.") for i in range(6)]
    want = "Head The one text of the copies."
    assert all(t == want for t in extracted(spark, copies))
    got = extracted(spark, copies[:60] + others)
    assert got == [want] * 60 + [f"Title {i} A text of its own, number {i}." for i in range(6)]
    # blocks of the template still go
    more = [page.format(i, f"Title {i}", f"Text {i}.</p><p>Read on in our shop.") for i in range(12)]
    assert extracted(spark, more + more[:1] * 50)[:12] == [f"Title {i} Text {i}." for i in range(12)]


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main class=page>{}</main>", "<div class=post>{}</div>"])
def test_html_title_and_lead(spark, outer):
    """The title and the lead stand outside of the element with most of the text."""
    inner = outer.format("<h1>Title {0}</h1><p class=lead>Lead of {0}</p><div class=body><p>{1}</p><p>Ends {0}</p></div><p class=more>Read on in our shop</p>")
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class=wrap><div class=top>All the news of the day</div>" + inner + "</div><footer>foot</footer></body></html>"
    pages = [page.format(i, f"Much text of number {i}. " * 20) for i in range(10)]
    want = [" ".join(f"Title {i} Lead of {i} {f'Much text of number {i}. ' * 20}Ends {i}".split()) for i in range(10)]
    assert extracted(spark, pages) == want
