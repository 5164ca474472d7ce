"""op11 to op13: SQL on the small tables, brute force on made-up ones, and edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from vendora.llm import merkle, phrases, warc
from vendora.session import scratch_path, ship_package

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_warc_dictionary", "op12_merkle_manifest", "op13_phrases"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = E.queries()[name](spark, SF_SMALL)
    want = con.execute(E.oracle_sql()[name]).fetchall()
    cols = [c[0] for c in con.description]
    assert sorted(got.columns) == sorted(cols)
    got = [tuple(r) for r in got.select(*cols).collect()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


# --- Merkle manifest --------------------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """(root, steps of each leaf) by plain recursion."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
    root, above = tree([h("".join(r)) for r in runs])
    return root, [[("".join(r[:i]), "".join(r[i + 1:]))] + above[j] for j, r in enumerate(runs) for i in range(len(r))]


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for d, s, lang, n, t in rows:
        groups[s].append((-1 if d is None else d, h("".join(map(enc, (d, s, lang, n, t))))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([leaf for _, leaf in sorted(groups[s])]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (d, leaf), steps in zip(sorted(groups[s]), subs[s][1]):
            out.append((d, leaf, subs[s][0], root, tuple(steps + top)))
    return sorted(out)


def manifest_rows(spark, rows, parts=3):
    ship_package(spark)
    df = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(parts))
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in df.collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 4, "": 2}, {"hot": 2200, "b": 28, "é": 1, "z": 730, None: 9}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((rng.randrange(10 ** 6), s, rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["a\nb", "", None, "é" * 5, "x" * 3000])))
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_manifest_edges(spark):
    rows = [(1, "s", "en", 3, "abc")] * 5 + [(None, "s", None, None, None), (None, None, "en", 0, ""), (1, "s", "en", 3, "other")]
    got = manifest_rows(spark, rows)
    assert got == brute_manifest(rows) and len(got) == 8
    assert manifest_rows(spark, []) == []
    alone = manifest_rows(spark, rows[:1])
    assert alone[0][1] == alone[0][2] == alone[0][3] and alone[0][4] == ()


def test_tampering_is_found(spark):
    """Exactly the documents whose text the deletion changes fail."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())
    import zlib
    got = {r.doc_id: r.verified for r in E.queries()["op12_merkle_manifest"](spark, SF_SMALL).collect()}
    assert got == {d: not ("\n" in (t or "") and zlib.crc32(str(d).encode()) % 2 == 0) for d, t in texts.items()}
    assert len(set(got.values())) == 2


def test_manifest_ignores_other_columns(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(5)]
    ship_package(spark)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tree", "2 AS hash", "3 AS at", "4 AS seg", "5 AS __key", "6 AS root")
    got = sorted((r.doc_id, r.leaf) for r in merkle.manifest(df).collect())
    assert got == [x[:2] for x in brute_manifest(rows)]


# --- WARC archives ----------------------------------------------------------------------------------

def archives(spark, rows, **kw):
    ship_package(spark)
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, **kw)
    return path, {(r.page_id, r.payload_digest): r for r in warc.read_archives(spark, path).collect()}


def test_archive_round_trip(spark):
    rng = random.Random(3)
    body = lambda n: "<html>" + " ".join(rng.choice(["läufer", "price", "<p>", "🙂", "menu", "item"]) for _ in range(n)) + "</html>"
    same = body(900)
    rows = [(i, f"http://h/{i}?q=ä b", same if i % 3 == 0 else body(rng.randint(0, 600))) for i in range(300)]
    rows += [(1000, None, None), (1001, "u", ""), (1002, "u", "x" * 999), (1003, "v", "x" * 999), (1004, "u", "é" * 500), (1005, "v", "é" * 500),
             (None, "u", "é" * 500), (1006, "u\r\nWARC-Type: evil", "a\r\n\r\nb"), (1007, "big", "long " * 400_000)]
    path, got = archives(spark, rows, archive_bytes=300_000)
    assert len(got) == len(rows)
    for page, url, html in rows:
        data = (html or "").encode()
        r = got[page, hashlib.sha1(data).hexdigest()]
        assert r.payload_bytes == len(data)
        copies = [p for p, _, t in rows if t == html and len(data) >= 1000]
        keep = max((p for p in copies if p is not None), default=page)
        assert (r.record_type, r.refers_to) == (("response", None) if page == keep else ("revisit", keep))
        assert r.payload == (data if page == keep else None)
        assert r.warc_refers_to == (None if page == keep else got[keep, r.payload_digest].record_id)
    assert got[1006, hashlib.sha1(b"a\r\n\r\nb").hexdigest()].record_type == "response"
    assert len({r.record_id for r in got.values()}) == len(rows)


def test_archive_format(spark):
    """Each file: the dictionary in a skippable frame, then one frame for each record, readable alone."""
    import zstandard
    rows = [(i, f"http://h/{i}", f"<html><body>{'common words of every page ' * 5}{random.Random(i).random()}</body></html>") for i in range(400)]
    path, got = archives(spark, rows, archive_bytes=30_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).filter("length > 0").collect()]
    assert len(files) > 1
    n = 0
    for data in files:
        assert data[:4] == b"\x5D\x2A\x4D\x18"
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert words.dict_id()
        rest = data[8 + size:]
        while rest:
            if rest[:4] == b"P*M\x18":
                assert rest[4:8] == bytes(4)
                rest = rest[8:]
                continue
            assert zstandard.get_frame_parameters(rest).dict_id == words.dict_id()
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            record = one.decompress(rest)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Type") == 1
            rest, n = one.unused_data, n + 1
    assert n == len(rows) + len(files)                     # a warcinfo record each
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(t.encode())) for _, _, t in rows)
    assert sum(map(len, files)) < plain + 400 * 400


def test_archive_edges(spark):
    _, got = archives(spark, [])
    assert got == {}
    _, got = archives(spark, [(1, "u", "few")])            # too few records for a dictionary
    assert [(r.page_id, r.record_type, bytes(r.payload)) for r in got.values()] == [(1, "response", b"few")]
    ship_package(spark)
    df = spark.createDataFrame([(5, "u", "x" * 2000)] * 3 + [(7, "u", "x" * 2000)], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df.selectExpr("*", "1 AS page", "2 AS payload", "3 AS same", "4 AS ident"), path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()) == [(5, "revisit", 7)] * 3 + [(7, "response", None)]


# --- phrases ----------------------------------------------------------------------------------------

def brute_phrases(rows, min_count, covered, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, w[i:i + k]] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if any(x == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) and 100 * b >= covered * a for (x, v), b in cand.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def phrase_rows(spark, rows, **kw):
    ship_package(spark)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    return {tuple(r) for r in phrases.collocations(df, **kw).collect()}


@pytest.mark.parametrize("every", [2, 7, 1000])
def test_phrases(spark, every):
    """Copies, passages that many texts share, breaks of all kinds; chunks short, middle and of whole texts."""
    rng = random.Random(every)
    word = lambda: rng.choice("a b c dd E é ff 　 - x y".split(" "))
    gap = lambda: rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!?"])
    text = lambda n: "".join(word() + gap() for _ in range(n))
    shared = [text(40) for _ in range(3)]
    rows = [(rng.choice(["en", "de", None, "und", ""]), text(rng.randint(0, 60)) + rng.choice(["", *shared]) + text(rng.randint(0, 30))) for _ in range(60)]
    rows += [("en", rows[0][1])] * 40 + [(None, None), ("en", ""), ("de", " . ")]
    kw = dict(min_count=5, covered=60, top=25)
    got = phrase_rows(spark, rows, every=every, **kw)
    assert got == brute_phrases(rows, **kw) and len(got) > 50


def test_phrase_edges(spark):
    assert phrase_rows(spark, []) == set()
    assert phrase_rows(spark, [("en", None), (None, "alone")], min_count=1) == set()
    rows = [("en", "yes no " * 4000), ("en", "w" * 70_000 + " tail")]
    kw = dict(min_count=1, covered=80, top=100)
    assert phrase_rows(spark, rows, **kw) == brute_phrases(rows, **kw)


def test_phrases_of_equal_hash(spark):
    """Words that a polynomial hash can't tell apart are counted apart."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [("en", f"{one} x")] * 3 + [("en", f"{two} x")] * 2
    kw = dict(min_count=1, covered=80, top=100)
    assert phrase_rows(spark, rows, **kw) == brute_phrases(rows, **kw)


def test_scores_are_exact(spark):
    """Products pass 64 bits."""
    a = 7_000_000_000_000_001
    often = spark.createDataFrame([("en", "x", 1, a + 3), ("en", "y", 1, a + 5), ("en", "x y", 2, a)], "lang string, phrase string, k int, f long")
    assert phrases.scored(often).first().score == 2_000_000 * a // (2 * a + 8)
