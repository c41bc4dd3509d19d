"""Main text of HTML pages by equivalence-class template deduction.

A page is a sequence of tokens: elements, known by their path of tags, classes and ids, and runs of text, known by path and
wording. Over the pages of one host each token has an occurrence vector; pages with the same longest run of text are copies and
count as one. Tokens with equal vectors form a class; a member is valid if it occurs once on each of its pages and the element
around it does too, so that valid classes nest into the host's template. A run of text belongs to the template if at least half
of the pages that have its element have it; what else stands between the template's tokens are slots. An
element in the article whose class may or may not mean a side matter (`share`, `notice`) is one if the template has it.
The main slot is the valid element that declares itself the article, or holds most of the text outside menus and the like.
Extraction takes the blocks of that slot without the template's texts. A page that its host's template does not fit, or of a host of
one page, is judged by its own elements in the same way.

Vectors are never built: equal vectors are found by a XOR of hashes of pages, which aggregates before the shuffle, so
a host with a third of all pages costs no more than others. Templates meet pages in a join by host that AQE can split.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import Scratch, arrow_limits, settle

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("nav aside footer form script style noscript template iframe svg math canvas button select option datalist textarea input object embed audio video head title dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Class words of side matters; in the article, those that also occur in the names of text need the template's word.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar topbar breadcrumb breadcrumbs masthead footer "
    "sidebar widgets cookie cookies consent gdpr newsletter subscribe subscription signup login sharing comment comments commentlist disqus respond pagination pager toolbar".split()
)
WEAK = frozenset("banner foot aside widget notice notices notification alert popup modal overlay share social related recommended recommendations replies reply form search copyright legal disclaimer skip hidden".split())
#: Words that say nothing beside those.
GENERIC = frozenset("area articles article bar block body bottom box btn button buttons center column container content cta element entry group header holder icon icons inner item items left link links list main module outer page panel post posts right row section site slot tools top unit view wrap wrapper".split())
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
KIN = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that may be the main one without saying so.
PLAIN = frozenset("body center div section td".split())
HOLDERS = frozenset("article aside blockquote body dd div fieldset figure footer form header html li main nav section td th".split())

TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z0-9]+")
#: Pages that a template needs, and the share of an element's pages on which a text in it belongs to the template.
LEAST, OFTEN = 3, 0.5
#: The share of text that a main element must hold; the share of a declared article beyond which repeated texts are a copy's, not the template's.
HOLDS, COPIED = 0.75, 0.3


def digest(value: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    out: list[bool] = field(default_factory=list)  # in a part that is no main text
    rank: list[int] = field(default_factory=list)  # 2: article, 1: main
    chars: list[int] = field(default_factory=list)  # of main text below
    depth: list[int] = field(default_factory=list)
    deep: list[bool] = field(default_factory=list)  # in an article or main element, or one
    weak: list[bool] = field(default_factory=list)  # out if the template has it
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def marks_of(names: str) -> tuple[bool, bool]:
    """Whether a name of an element marks a side matter for certain, and whether one may: a word of MARKS or of WEAK, and beside it generic ones only."""
    sure = maybe = False
    for name in names.split():
        words = [x for x in PARTS.split(name) if x and not x.isdigit()]
        if words and all(x in MARKS or x in WEAK or x in GENERIC for x in words):
            sure |= any(x in MARKS for x in words)
            maybe |= any(x in WEAK for x in words)
    return sure, maybe


def scan(source: str) -> Page:
    """The page's elements and runs of text, in order. Tags that HTML leaves out are closed; nothing makes it fail."""
    page, stack, block = Page(), [], 0
    at, end = 0, len(source)

    def add(tag: str, raw: str) -> int:
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        own = stack[-1] if stack else -1
        label = f"{tag}.{' '.join(sorted(DIGITS.sub('0', attrs.get('class', '')).split()))}#{DIGITS.sub('0', attrs.get('id', ''))}"
        role = attrs.get("role", "").lower()
        core = tag in ("html", "body", "article", "main")
        deep = own >= 0 and page.deep[own]
        names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower()
        sure, maybe = marks_of(names)
        marked = not core and (sure or (not deep and (maybe or any("header" in (x := set(PARTS.split(name)) - {""}) and x <= GENERIC for name in names.split()))))
        unseen = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        page.tag.append(tag)
        page.parent.append(own)
        page.deep.append(deep or tag in ("article", "main"))
        page.depth.append(page.depth[own] + 1 if own >= 0 else 0)
        page.path.append(digest(label, page.path[own] if own >= 0 else 0))
        inside = own >= 0 and page.out[own]
        # A header is one of the page, unless it stands in the article and has its title.
        heads = tag == "header" and not deep
        page.out.append(inside or tag in ASIDE or heads or role in ROLES or marked or unseen or (tag == "article" and (sure or maybe)))
        page.weak.append(maybe and deep and not core)
        page.rank.append(2 if tag == "article" or attrs.get("itemprop", "").lower() == "articlebody" else 1 if tag == "main" or role == "main" else 0)
        page.chars.append(0)
        return len(page.tag) - 1

    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if source[m.start()] != "<" or m.end() - m.start() == 1:
                page.texts.append((stack[-1] if stack else -1, block, m[0]))
            continue
        tag, raw = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if page.tag[stack[k]] == tag:
                    del stack[k:]
                    break
                if page.tag[stack[k]] in HOLDERS and tag not in BLOCK:
                    break
            block += tag in BLOCK
            continue
        if tag in BLOCK or tag in CLOSES:
            stops, kin = (CLOSES[tag], KIN.get(tag, (tag,))) if tag in CLOSES else (HOLDERS, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                name = page.tag[stack[k]]
                if name in kin:
                    del stack[k:]
                    break
                if name in stops:
                    break
            block += 1
        if tag == "br":
            page.texts.append((stack[-1] if stack else -1, block, " "))
        n = add(tag, raw)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = end if close is None else close.start()
        if tag not in VOID and not raw.rstrip().endswith("/"):
            stack.append(n)
        elif raw.rstrip().endswith("/") and tag not in VOID and tag not in RAW:
            stack.append(n)  # HTML knows no self-closing for these
    for n, _, text in page.texts:
        if n >= 0 and not page.out[n]:
            page.chars[n] += len(text.strip())
    for n in range(len(page.tag) - 1, -1, -1):
        if page.parent[n] >= 0 and not page.out[n]:
            page.chars[page.parent[n]] += page.chars[n]
    return page


def text_token(page: Page, n: int, text: str) -> int | None:
    text = " ".join(text.split())
    return digest(text, page.path[n] if n >= 0 else 0) if text else None


def main_element(page: Page, mains: list[int]) -> int:
    """The page's main element: the first of the template's that it has, or its own; -1 for the whole page."""
    here = {p: n for n, p in reversed(list(enumerate(page.path))) if not page.out[n]}
    for p in mains:
        if p in here and page.chars[here[p]]:
            return here[p]
    for rank in (2, 1):
        own = [n for n in range(len(page.tag)) if page.rank[n] == rank and not page.out[n] and page.chars[n]]
        if own:
            return max(own, key=lambda n: (page.chars[n], -n))
    total = sum(page.chars[n] for n in range(len(page.tag)) if page.parent[n] < 0)
    fit = [n for n in range(len(page.tag)) if page.tag[n] in PLAIN and not page.out[n] and page.chars[n] >= HOLDS * total and total]
    return max(fit, key=lambda n: (page.depth[n], page.chars[n], -n), default=-1)


def main_text(source: str, mains: list[int], fixed: set[int], fixtures: set[int] | None) -> str:
    """The blocks of the main element, each on a line. fixtures: the template's weakly marked elements; None if there is no template."""
    page = scan(source)
    top = main_element(page, mains)
    inside = [top < 0] * len(page.tag)
    for n in range(len(page.tag)):
        inside[n] = n == top or top < 0 or (page.parent[n] >= 0 and inside[page.parent[n]])
        if page.weak[n] and n != top and (fixtures is None or page.path[n] in fixtures):
            inside[n] = False
        if top < 0 and page.parent[n] >= 0 and not inside[page.parent[n]]:
            inside[n] = False
    runs = [(n, block, text, text_token(page, n, text) in fixed) for n, block, text in page.texts if (n < 0 and top < 0) or (n >= 0 and inside[n] and not page.out[n])]
    size = lambda drop: sum(len(text.strip()) for _, _, text, known in runs if known or not drop)
    # A declared article of which much is repeated, or a page all of which is, is a copy.
    most = COPIED if top >= 0 and page.rank[top] else 1.0
    drop = size(True) < size(False) and size(True) <= most * size(False)
    blocks: dict[int, list[str]] = {}
    for _, block, text, known in runs:
        if not (drop and known):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


_TOKENS = T.StructType([T.StructField("host", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("kind", "token", "page", "parent", "times", "chars", "rank", "depth", "weak")]])
PAGE, ELEMENT, TEXT = 0, 1, 2


def _tokens(batches):  # noqa: ANN001, ANN202
    """Tokens of each host and page, once for the copies in a batch."""
    import pyarrow as pa

    for batch in batches:
        sums: dict[tuple, tuple] = {}
        for host, source in zip(*(batch.column(k).to_pylist() for k in range(2))):
            page = scan(source or "")
            longest = max((" ".join(t.split()) for n, _, t in page.texts if n >= 0 and not page.out[n]), key=lambda x: (len(x), x), default="")
            own = (host, digest(longest))
            sums[*own, PAGE, 0] = (0, 1, 0, 0, 0, 0)
            counts: dict[tuple[int, int], list[int]] = {}
            for n, p in enumerate(page.path):
                if not page.out[n]:
                    x = counts.setdefault((ELEMENT, p), [page.path[page.parent[n]] if page.parent[n] >= 0 else 0, 0, 0, page.rank[n] if page.tag[n] in PLAIN or page.tag[n] == "html" or page.rank[n] else -1, page.depth[n], int(page.weak[n])])
                    x[1] += 1
                    x[2] += page.chars[n]
            for n, _, text in page.texts:
                if n >= 0 and not page.out[n] and (t := text_token(page, n, text)) is not None:
                    counts.setdefault((TEXT, t), [page.path[n], 0, 0, 0, 0, 0])[1] += 1
            for key, x in counts.items():
                sums[*own, *key] = tuple(x)
        if sums:
            cols = list(zip(*[(host, kind, token, page, *v) for (host, page, kind, token), v in sums.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=_TOKENS.names)
        del sums
    settle()


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, mains, fixed, fixtures) of pages (host, html): paths of main elements, best first, the template's texts, and its weakly marked elements."""
    found = pages.filter(F.col("host").isNotNull()).mapInArrow(_tokens, _TOKENS)
    rest = ("parent", "times", "chars", "rank", "depth", "weak")
    once = found.groupBy("host", "kind", "token", "page").agg(*[F.max(c).alias(c) for c in rest])
    sums = once.groupBy("host", "kind", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("page", "times")).alias("sign"), *[F.max(c).alias(c) for c in ("parent", "rank", "depth", "weak")])
    sums = scratch(sums.filter((F.col("kind") == PAGE) | (F.col("pages") >= LEAST)))
    elements = sums.filter(F.col("kind") == ELEMENT)
    around = elements.select(F.col("host").alias("_h"), F.col("token").alias("_t"), F.col("pages").alias("_pages"))
    within = (F.col("host") == F.col("_h")) & (F.col("parent") == F.col("_t"))
    texts = sums.filter(F.col("kind") == TEXT).join(around, within).filter(F.col("pages") >= OFTEN * F.col("_pages"))
    fixed = texts.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixed"))
    # A weakly marked element on half of the pages that have the element around it belongs to the template.
    weak = elements.filter("weak = 1").join(around, within).filter(F.col("pages") >= OFTEN * F.col("_pages"))
    fixtures = weak.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixtures"))
    # Valid: once on each page that has it, inside an element of which the same holds, or at the top.
    single = elements.filter((F.col("rank") >= 0) & (F.col("pages") == F.col("times")))
    outer = elements.filter(F.col("pages") == F.col("times")).select(F.col("host").alias("_h"), F.col("token").alias("_t"))
    valid = single.join(outer, within, "left").filter(F.col("_t").isNotNull() | (F.col("depth") == 0))
    # A class's best element: the article, else the innermost with most of the class's text.
    most = valid.groupBy("host", "sign").agg(F.max("chars").alias("most"))
    held = valid.select("host", "sign", "token", "pages", "chars", "rank", "depth").join(most, ["host", "sign"]).filter((F.col("rank") > 0) | (F.col("chars") >= HOLDS * F.col("most")))
    best = held.filter("chars > 0").groupBy("host", "sign").agg(F.max(F.struct("rank", "depth", "chars", "pages", "token")).alias("x"))
    mains = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("x.rank", "x.pages", "x.chars", "x.token")), asc=False).alias("m"))
    known = sums.filter((F.col("kind") == PAGE) & (F.col("pages") >= LEAST)).select("host").join(mains, "host", "left").join(fixed, "host", "left").join(fixtures, "host", "left")
    none = F.array().cast("array<long>")
    return known.select("host", F.coalesce(F.transform("m", lambda x: x["token"]), none).alias("mains"), F.coalesce("fixed", none).alias("fixed"), F.coalesce("fixtures", none).alias("fixtures"))


def _extract(batches):  # noqa: ANN001, ANN202
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(source or "", mains or [], set(fixed or []), None if fixtures is None else set(fixtures)) for source, mains, fixed, fixtures in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])
    settle()


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.col(url), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of df.

    A null html counts as empty and has the empty text. Pages without a url, or with one without host, have no template and are judged alone.
    Rows that repeat a page give the same text each; equal pages of one host count as one, so their article is no part of the
    template. An empty table gives none; other columns are not read.
    """
    arrow_limits(df.sparkSession)
    scratch = Scratch(df.sparkSession, "pages")
    pages = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(url).alias("host"))
    known = scratch(templates(pages.select("host", "html"), scratch))
    met = pages.join(known.select(F.col("host").alias("_host"), "mains", "fixed", "fixtures"), F.col("host") == F.col("_host"), "left")
    kind = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return scratch.release(met.select("key", "url", "html", "mains", "fixed", "fixtures").mapInArrow(_extract, kind).select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars"))
