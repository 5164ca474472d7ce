r"""Main text of web pages by template deduction over same-host pages.

Tokens of a page are its elements (by their path of tags, classes and ids) and its
text blocks (by path and text).  A token's occurrence vector lists how often each
page of the host has it; tokens with equal vectors form an equivalence class.  The
vector is kept as a sum of hashes of (page, count), so classes come out of one
aggregation however many pages a host has.  Pages of a host with the same text
outside the noise parts (mirrors, print views, recrawls) count as one page, which has
a token as often as the copy that has it most.

A class is valid for the template if at least half of the host's pages hold it and
it has two tokens or more.  Valid classes nest by their paths; elements that a
valid class has once on each page bound the slots.  A slot's text is what it holds
outside the parts that are never article text (menus, headers, footers, sidebars,
notices, adverts, forms, comments) and outside text blocks that nearly all pages of
the host have.  The main slot is the outermost ``article`` of the template, else its
outermost ``main``, that holds half of the host's text; where there is none, the
innermost slot that holds all of it, so nothing is lost on the way down.  What a page
holds in the main slot is its text, less those parts and blocks.

Hosts with fewer than ``MIN_PAGES`` such pages, and pages without the host's main slot,
are read by their own structure: ``article`` or ``main`` elements, else the body.

Blocks: character references decoded, white space made one space, trimmed;
joined in page order by one space.

Scale: one shuffle of (host, content) counts and two of (host, token) sums, added up in
each task before it (the first brings the tokens of copies together); pages are not
shuffled when the table of templates is small enough for the planner
to broadcast, else joined by host (a hot host is split by the skew join).

Cases: null or empty html gives the empty text; null url: by its own structure;
repeated rows count as one page; unclosed tags end with what encloses them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.bits import bitmap, hits
from vendora.llm.registry import query, table, written

MIN_PAGES = 5
SUPPORT = 0.5              # of the host's pages, for a valid class
CONSTANT = 0.9             # of the host's pages, for a text block that belongs to the template
MAIN_SHARE = 0.5           # of the host's text, for an article or main element to be the main slot

# Elements of HTML by how they are read.
RAW = "script|style|noscript|template|textarea|select|iframe|object|svg|title|button|option|canvas|video|audio"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var wbr img "
             "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mfenced mpadded semantics".split())
NOISE_TAGS = set("nav aside footer form head menu dialog".split())
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre address figure fieldset hr".split())
NOISE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                  "notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus "
                  "sidebar side widget widgets menu nav navbar navigation navigator breadcrumb breadcrumbs header masthead topbar footer "
                  "copyright share sharing social related recommended pager pagination search toolbar skip".split())
# Words that say nothing on their own: with a noise word they name a kind of noise (comment-list, ad-box).
NEUTRAL = set("list box container wrapper wrap block section area inner outer item items row col panel top bottom left right main content text title body "
              "link links button buttons icon icons bar form field group js css".split())
NOISE_ROLES = set("navigation banner complementary contentinfo search form menu dialog alert".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    # a quote that is never closed: the tag ends at its bracket
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
# the attribute itself, or a style; other attributes' values may say what they like
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|$|/)", re.I)
UNSHOWN = re.compile(r"\bstyle\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NONE = re.compile(r"display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "path", "noise")

    def __init__(self, tag: str, path: str, noise: bool):
        self.tag, self.path, self.noise = tag, path, noise


def is_noise(tag: str, names: str, role: str, in_article: bool, attr: str) -> bool:
    if tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not in_article):
        return True
    if attr and hidden(attr):
        return True
    if not names or tag in ("html", "body", "article", "main"):
        return False
    if in_article:
        # within an article a name must be noise as a whole: side-effects, search-engines and notice-board are its topics
        return any(noise_name(name) for name in names.lower().split())
    return not NOISE_WORDS.isdisjoint(SPLIT.split(names.lower()))


def noise_name(name: str) -> bool:
    """Is every part of a class or id a noise word, or one that says nothing beside it?"""
    parts = [p for p in SPLIT.split(name) if p and not p.isdigit()]
    found = NOISE_WORDS.intersection(parts) - {"header"}
    return bool(found) and all(p in NOISE_WORDS or p in NEUTRAL for p in parts)


def hidden(attr: str) -> bool:
    if "hidden" in attr.lower() and HIDDEN.search(QUOTED.sub('""', attr)):
        return True
    style = UNSHOWN.search(attr)
    return bool(style and NONE.search(style.group(1)))


def read(page: str):
    """(elements in order as Node, blocks as (Node, text)) of a page."""
    root = Node("", "", False)
    stack, opened, blocks, text = [root], [], [], []

    def flush():
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if t:
                blocks.append((owner(), t))

    def owner():
        # the block element that holds the text
        for node in reversed(stack):
            if node.tag not in INLINE:
                return node
        return root

    def close_to(k: int):
        flush()
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = (m.group("tag") or m.group("tag2") or "").lower()
        if not tag:
            continue                        # comment, declaration or an element whose content isn't text
        if m.group("end") or m.group("end2"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in INLINE:
                        close_to(k)
                    else:
                        del stack[k]
                    break
                if stack[k].tag in ("article", "body", "td", "main") and tag in INLINE | {"p", "li"}:
                    break                   # a stray end tag doesn't close what encloses it
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            while len(stack) > 1 and stack[-1].tag in INLINE:
                stack.pop()                 # an unclosed inline element ends with its block
            siblings = CLOSED_BY_SIBLING.get(tag, {"p"} if tag in ENDS_P else ())
            if stack[-1].tag in siblings:
                stack.pop()
        attrs = m.group("attr") if m.group("tag") else m.group("attr2")
        names = role = ""
        if "=" in attrs:
            for name, value in ATTR.findall(attrs):
                value = value.strip("\"'").lower()
                if name.lower() == "role":
                    role = value
                else:
                    names += " " + value
        top = stack[-1]
        if tag in INLINE:
            # inline elements keep the path of their block
            node = Node(tag, top.path, top.noise or is_noise(tag, names, role, True, attrs))
        else:
            inside = any(x.tag in ("article", "main") for x in stack)
            step = tag + "".join("." + c for c in sorted(set(names.split())) if not any(ch.isdigit() for ch in c))
            node = Node(tag, f"{top.path}/{step}", top.noise or is_noise(tag, names, role, inside, attrs))
            opened.append(node)
        if node.noise != top.noise:
            # text before a noisy inline element belongs to what encloses it
            flush()
        stack.append(node)
    text.append(page[at:])
    flush()
    return opened, blocks


def key_of(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\x00{text}") >> 1


def content_of(host: str, blocks) -> int:
    """Digest of the text outside the noise parts."""
    return xxhash.xxh64_intdigest("\x00".join([host, *[text for node, text in blocks if not node.noise]])) >> 1


def contents(batches):
    """(host, content) of each page."""
    for batch in batches:
        hosts, pages = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "html"))
        got = [(host, content_of(host, read(page or "")[1])) for host, page in zip(hosts, pages) if host is not None]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.string()), pa.array([c for _, c in got], pa.int64())], names=["host", "content"])


TOKENS = "host string, content long, token long, path string, block boolean, noise boolean, n_pages long, occurs long, v1 long, v2 long, chars long"


def tokens(repeated):
    """(host, token) sums over the pages of a batch: pages, occurrences, two halves of
    the occurrence vector's hash, text length, with the path of the element or of the
    text block's element.
    Pages whose content may be ``repeated`` give rows of their own, with their content
    (else null)."""

    def run(batches):
        for batch in batches:
            sums: dict = {}
            hosts, pages = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "html"))
            for host, page in zip(hosts, pages):
                if host is None:
                    continue
                opened, blocks = read(page or "")
                content = content_of(host, blocks)
                seen: dict = {}
                for node in opened:
                    t = seen.setdefault((key_of(node.path), node.path, False, node.noise), [0, 0])
                    t[0] += 1
                # what encloses text outside the noise parts isn't noise
                paths = {p: v for (k, p, b, z), v in seen.items() if not z}
                for node, text in blocks:
                    if node.noise:
                        continue
                    t = seen.setdefault((key_of(node.path, text), node.path, True, False), [0, 0])
                    t[0] += 1
                    t[1] += len(text)
                    p = node.path
                    while p:
                        if p in paths:
                            paths[p][1] += len(text)
                        p = p.rpartition("/")[0]
                copy = content if hits(repeated.value, np.array([content]))[0] else None
                for (token, path, block, noise), (count, chars) in seen.items():
                    s = sums.setdefault((host, copy, token, path, block, noise), [0, 0, 0, 0, 0])
                    if copy is not None:
                        # the vector's hash follows when all copies are together
                        s[:] = 1, max(s[1], count), 0, 0, max(s[4], chars)
                        continue
                    h = xxhash.xxh64_intdigest(f"{content}\x00{count}")
                    s[0] += 1
                    s[1] += count
                    s[2] += h & 0x7FFFFFFF
                    s[3] += h >> 33
                    s[4] += chars
            if sums:
                cols = list(zip(*[(*k, *v) for k, v in sums.items()]))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in TOKENS.split(", ")])
    return run


def host_of(url):
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, constant): path of the main slot and hashes of the template's text
    blocks, of the hosts with enough pages.  ``pages``: host, html."""
    content = written(pages.mapInArrow(contents, "host string, content long").groupBy("host", "content").agg(F.count("*").alias("n")), "html-contents")
    # written, so that the planner knows its size before it picks the join
    counted = written(content.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES), "html-hosts")
    repeated = pages.sparkSession.sparkContext.broadcast(bitmap(content.filter("n > 1"), "content"))
    token = pages.mapInArrow(tokens(repeated), TOKENS).groupBy("host", "content", "token", "path", "block", "noise")
    # copies are one page; their vector's hash is drawn here
    own, h = F.col("content").isNull(), F.xxhash64("content", "occurs")
    token = (token.agg(*[F.sum(c).alias(c) for c in ("n_pages", "v1", "v2")],
                       *[F.when(own, F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("occurs", "chars")])
             .select("host", "token", "path", "block", "noise", F.when(own, F.col("n_pages")).otherwise(1).alias("n_pages"), "occurs",
                     F.when(own, F.col("v1")).otherwise(h.bitwiseAND(0x7FFFFFFF)).alias("v1"),
                     F.when(own, F.col("v2")).otherwise(F.shiftrightunsigned(h, 33)).alias("v2"), "chars")
             .groupBy("host", "token", "path", "block", "noise")
             .agg(*[F.sum(c).alias(c) for c in ("n_pages", "occurs", "v1", "v2", "chars")]))
    token = token.join(counted, "host").filter(F.col("n_pages") >= SUPPORT * F.col("n"))
    # equal vectors: an equivalence class
    vector = ["host", "v1", "v2", "n_pages", "occurs"]
    # dealt by vector, else a host's tokens would stay together in the task that joined them
    valid = token.repartition(*vector).groupBy(*vector, "n").agg(F.count("*").alias("size"), F.collect_list(F.struct("token", "path", "block", "noise", "chars")).alias("members"))
    valid = valid.filter("size >= 2").select(*vector, "n", F.inline("members"))
    valid = written(valid, "html-valid")
    fixed = valid.filter("block").filter(F.col("n_pages") >= CONSTANT * F.col("n"))
    # a text block lies in all elements on its path
    steps = F.split("path", "/")
    within = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    known = (fixed.select("host", F.explode(within).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("fixed")))
    slot = (valid.filter("NOT block AND NOT noise AND occurs = n_pages").join(known, ["host", "path"], "left")
            .select("host", "path", F.size(steps).alias("depth"), (F.col("chars") - F.coalesce("fixed", F.lit(0))).alias("chars"),
                    F.regexp_extract("path", r"([^/.]*)[^/]*$", 1).alias("tag")))
    whole = slot.groupBy("host").agg(F.max("chars").alias("whole")).filter("whole > 0")
    slot = slot.join(whole, "host")

    def outermost(tag: str):
        return F.min_by("path", F.when((F.col("tag") == tag) & (F.col("chars") >= MAIN_SHARE * F.col("whole")), F.struct("depth", -F.col("chars"), "path")))

    main = slot.groupBy("host").agg(F.coalesce(outermost("article"), outermost("main"),
                                               F.max_by("path", F.when(F.col("chars") == F.col("whole"), F.struct("depth", "path")))).alias("main"))
    constant = fixed.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("constant"))
    return main.join(constant, "host", "left")


def main_text(page: str, main: str | None, constant) -> str:
    """The article's blocks of one page."""
    opened, blocks = read(page)
    drop = set(constant or ())
    if not main or not any(n.path == main for n in opened):
        main, drop = None, set()
        for tag in ("article", "main"):
            got = sorted((n.path for n in opened if n.tag == tag and not n.noise), key=lambda p: p.count("/"))
            if got:
                main = got[0]
                break
    out = []
    for node, text in blocks:
        inside = not main or node.path == main or node.path.startswith(main + "/")
        if inside and not node.noise and not (drop and key_of(node.path, text) in drop):
            out.append(text)
    return " ".join(out)


def extractor(batches):
    for batch in batches:
        col = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        texts = [main_text(h or "", m, c) for h, m, c in zip(col["html"].to_pylist(), col["main"].to_pylist(), col["constant"].to_pylist())]
        yield pa.RecordBatch.from_arrays([col["page"], col["url"], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                                         names=["page", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    src = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(url).alias("host"))
    # written, so that the planner knows its size before it picks the join
    known = written(templates(src.select("host", "html")), "html-templates")
    kind = pages.schema[key].dataType.simpleString()
    out = src.join(known, "host", "left").select("page", "url", "html", "main", "constant").mapInArrow(
        extractor, f"page {kind}, url string, text string, n_chars long")
    return out.select(F.col("page").alias(key), F.col("url").alias(url), "text", "n_chars")


@query("op6_html_template")
def op6(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
