"""Main text of web pages, with site templates removed.

Pages are parsed into element trees. The hashes of their block subtrees are counted per host, once for each different
article; a subtree that recurs with so many articles of its host is a template and goes, within the article too, but never the
article itself. Running text (a paragraph, heading, list or table) recurs by chance where it is short and on purpose where it is
quoted or copied, so by itself it is a template only if it is in most articles of its host. What is left within the article (the main element, else the
outermost articles, else the body) is the text, without the elements and the class, id and role names that mark navigation,
notices, adverts, forms and comments. Within the article ids mark nothing, and names nothing that is a heading, a section or
running text.

Defined cases: null html is empty; a page without text has an empty string; rows with a null url belong to no host and lose no
templates; rows that share a page_id are pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, written

#: A template is in so many different pages of its host at least, however many there are.
LEAST_PAGES = 8
#: Words of the least template: of an element of running text, of any other block.
FLOW_WORDS, OTHER_WORDS = 4, 2
#: The least share of a host's articles that have a template of running text.
FLOW_SHARE = 0.5
#: Rows of a subtree or an article that meet in one place, and how many of them with more rows there can be.
HOT_PAGES, HOT_KEYS = 500, 10_000

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FLOW = frozenset("blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("annotation annotation-xml aside button canvas datalist dialog footer form head iframe menu meter nav noembed noframes noscript object progress script search select style svg template textarea title".split())
# Names in class, id and role that mark what isn't the article.
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification popup modal overlay dialog alert newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus respond replies widget skip".split()
)
# The compounds of them that mark it too; other compounds, as has-sidebar or share-price, don't.
COMPOUNDS = frozenset(
    "site-footer page-footer main-footer global-footer footer-nav footer-menu footer-links footer-widgets site-nav main-nav primary-nav secondary-nav top-nav global-nav nav-bar nav-menu nav-links site-navigation main-navigation post-navigation "
    "posts-navigation page-navigation main-menu site-menu primary-menu side-bar primary-sidebar secondary-sidebar sidebar-widget widget-area breadcrumb-nav breadcrumb-trail page-numbers site-banner top-banner ad-banner banner-ad ad-box ad-slot "
    "ad-unit ad-container ad-wrapper ads-box ads-container advert-box google-ads sponsored-content sponsored-links promo-box promo-banner cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup cookie-policy-notice consent-banner "
    "consent-popup gdpr-notice gdpr-banner newsletter-signup newsletter-form newsletter-box newsletter-popup email-signup signup-form subscribe-form subscribe-box subscription-form login-form login-box search-form search-box share-bar share-box "
    "share-buttons share-links share-this sharing-buttons social-share social-sharing social-links social-media social-icons social-buttons related-posts related-articles related-links related-content related-stories recommended-posts "
    "recommended-articles comment-list comment-form comments-area comments-section comment-section comments-list disqus-thread reply-form modal-dialog popup-overlay skip-link skip-links skip-nav skip-to-content".split()
)
# Names of what stands beside an article and is made of articles itself.
BESIDE = frozenset("comment comments disqus respond replies related recommended".split())
_CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_P_SCOPE = frozenset("button td th caption table html object template".split())
_HEAD = frozenset("base link meta noscript script style template title".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def _marked(attributes: str, ids: bool = True) -> tuple[bool, int]:
    """Whether an element is hidden, and whether a name marks it: 1, or 2 if the name is of what stands beside an article. ids: an id counts too."""
    named = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
        if name in ("class", "role") or name == "id" and ids:
            for one in value.replace("_", "-").split():
                if one in NAMES or one in COMPOUNDS:
                    named = max(named, 1 if BESIDE.isdisjoint(one.split("-")) else 2)
    return False, named


class Node:
    __slots__ = ("tag", "dropped", "named", "parts", "digest", "words")

    def __init__(self, tag: str, dropped: bool, named: int = 0) -> None:
        """named: dropped for its name alone."""
        self.tag, self.dropped, self.named, self.parts, self.digest, self.words = tag, dropped, named, [], 0, 0

    def close(self) -> None:
        split = [p.split() if isinstance(p, str) else p for p in self.parts]
        self.words = sum(p.words if isinstance(p, Node) else len(p) for p in split)
        text = "\x1f".join(f"\x1e{p.digest:x}" if isinstance(p, Node) else " ".join(p) for p in split)
        self.digest = xxhash.xxh3_64_intdigest(f"{self.tag}\x1d{text}".encode("utf-8", "surrogatepass"))


def parse(source: str) -> Node:
    """The tree of block elements and dropped ones; inline elements leave their text in the block they are in."""
    root = Node("html", False)
    stack = [root]
    #: where the open elements of each tag are in the stack
    depths: dict[str, list[int]] = {}
    at = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            depths[stack[-1].tag].pop()
            stack.pop().close()

    def last(tags) -> int:
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def find(tags, scope) -> int:
        i = last(tags)
        return i if i and i >= last(scope) else 0

    scan = _TOKEN.search
    while True:
        m = scan(source, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if stack[-1].tag == tag and len(stack) > 1:
                pop_to(len(stack) - 1)
            elif tag in BLOCK or tag in DROPPED:
                i = find({tag}, ("table",) if tag not in ("table", "body", "html") and tag in ("li", "p", "td", "th", "tr") else ())
                if i:
                    pop_to(i)
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
        if stack[-1].tag == "head" and tag not in _HEAD:
            pop_to(len(stack) - 1)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            at = end.start() if end else len(source)
            if end:
                close = source.find(">", at)
                at = close + 1 if close >= 0 else len(source)
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in _CLOSES_P:
            i = find({"p"}, _P_SCOPE)
            if i:
                pop_to(i)
        if tag in _IMPLIED:
            closes, scope = _IMPLIED[tag]
            while i := find(closes, scope):
                pop_to(i)
        if tag in ("html", "body"):
            continue
        attributes = m[3]
        # within an article ids are made from headings, and names of running text and sections say what these are about
        within = bool(depths.get("article") or depths.get("main"))
        hidden, named = _marked(attributes, not within) if attributes and attributes.strip(" /") else (False, 0)
        named = 0 if hidden or tag in DROPPED or within and (tag in FLOW or tag == "section") else named
        dropped = tag in DROPPED or hidden or named > 0
        # inline elements matter only where they are dropped, and then those of the same name within
        if tag in BLOCK or dropped or stack[-1].tag == tag:
            node = Node(tag, dropped, named)
            stack[-1].parts.append(node)
            if tag != "hr":
                depths.setdefault(tag, []).append(len(stack))
                stack.append(node)
            else:
                node.close()
            if not attributes.endswith("/") or tag != "svg":
                continue
            pop_to(len(stack) - 1)
    if at < len(source):
        stack[-1].parts.append(entities.unescape(source[at:]))
    pop_to(1)
    root.close()
    _keep_article(root)
    return root


def _keep_article(root: Node) -> None:
    """Undoes drops by name of what holds the main element or, where no article is left otherwise, the articles."""
    held: dict[str, list[tuple[Node, ...]]] = {"main": [], "article": []}
    stack: list[tuple[Node, tuple[Node, ...], bool]] = [(root, (), False)]
    while stack:
        node, names, within = stack.pop()
        if node.named:
            names = (*names, node)
        if node.tag == "main" or node.tag == "article" and not within:
            held[node.tag].append(names)
        within = within or node.tag == "article"
        if node.tag != "main":
            stack += [(p, names, within) for p in reversed(node.parts) if isinstance(p, Node) and (p.named or not p.dropped)]
    # of several ones the unnamed are the article: teasers and comments are articles too
    found = held["main"] or [names for names in held["article"] if all(n.named == 1 for n in names)]
    if found and all(found):
        for node in (n for names in found for n in names):
            node.dropped, node.named = False, 0


def _nodes(root: Node, into_dropped: bool = False):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and (into_dropped or not p.dropped)]


def _article(root: Node) -> list[Node]:
    main = [n for n in _nodes(root) if n.tag == "main"]
    if main:
        return main[:1]
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            found.append(node)
        else:
            stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped]
    return found


def article_form(root: Node) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """The lines of the article, each with the innermost block that it is in; for each block, the one around it and its digest."""
    roots = _article(root)
    whole = not roots
    lines: list[tuple[str, int]] = []
    around, digests = [0], [0]
    text: list[str] = []

    def flush(block: int) -> None:
        if text:
            if joined := " ".join("".join(text).split()):
                lines.append((joined, block))
            text.clear()

    for top in roots or [root]:
        stack = [(iter(top.parts), 0)]
        while stack:
            parts, block = stack[-1]
            part = next(parts, None)
            if part is None:
                flush(block)
                stack.pop()
            elif isinstance(part, str):
                text.append(part)
            else:
                if part.tag in BLOCK:
                    flush(block)
                else:
                    text.append(" ")
                if not part.dropped and not (whole and part.tag == "header"):
                    if part.tag in BLOCK:
                        around.append(block)
                        digests.append(part.digest)
                        block = len(around) - 1
                    stack.append((iter(part.parts), block))
    return lines, around, digests


def form_text(lines, around, digests, templates) -> str:
    """The lines that are in no template."""
    gone = [False]
    for up, digest in zip(around[1:], digests[1:], strict=True):
        gone.append(gone[up] or digest in templates)
    return "\n".join(line for line, block in lines if not gone[block])


def main_text(root: Node, templates: frozenset[int] = frozenset()) -> str:
    return form_text(*article_form(root), templates)


def template_digests(root: Node) -> dict[int, bool]:
    """The subtrees of a page that can be templates, and whether they are running text: its blocks of some words, within the article too, but neither the article nor what holds it."""
    article = {id(n) for n in _article(root)}
    holding, above, stack = {id(root)} | article, {}, [root]
    while stack:
        node = stack.pop()
        if id(node) in article:
            up = above.get(id(node))
            while up is not None and up not in holding:
                holding.add(up)
                up = above.get(up)
        else:
            below = [p for p in node.parts if isinstance(p, Node) and not p.dropped]
            above.update((id(p), id(node)) for p in below)
            stack += below
    return {n.digest: n.tag in FLOW for n in _nodes(root, True) if id(n) not in holding and n.tag in BLOCK | DROPPED and n.words >= (FLOW_WORDS if n.tag in FLOW else OTHER_WORDS)}


def _host() -> F.Column:
    return F.nullif(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(host: str, *digests: int) -> int:
    """A subtree or an article of a host."""
    return _signed(xxhash.xxh3_64_intdigest(f"{host}\x1d{digests}".encode("utf-8", "surrogatepass")))


def _article_key(host: str, root: Node) -> int:
    return _key(host, 0, *(n.digest for n in _article(root) or [root]))


def _subtrees(frames):
    """A page's article, its host, and its subtrees with whether the article can lose them."""
    for frame in frames:
        articles, hosts, subtrees = [], [], []
        for host, source in zip(frame["host"], frame["html"], strict=True):
            root = parse(source or "")
            inside = set(article_form(root)[2])
            articles.append(_article_key(host, root))
            hosts.append(_key(host))
            subtrees.append([{"key": _key(host, d), "within": d in inside, "flow": flow} for d, flow in sorted(template_digests(root).items())])
        yield pd.DataFrame({"article": articles, "host": hosts, "subtrees": subtrees})


def _forms(frames):
    """The pages' articles, packed: they are smaller to shuffle than the pages."""
    for frame in frames:
        articles, forms = [], []
        for host, source in zip(frame["host"], frame["html"], strict=True):
            root = parse(source or "")
            lines, around, digests = article_form(root)
            own = [_key(host, d) for d in digests] if host else digests
            articles.append(_article_key(host, root) if host else None)
            forms.append(zlib.compress(json.dumps((lines, around, own), ensure_ascii=False).encode("utf-8", "surrogatepass"), 1))
        # a column of whole numbers and nulls: as floats the keys would lose their last bits
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "article": pd.array(articles, dtype="Int64"), "form": forms})


def article_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, hot_pages: int = HOT_PAGES) -> tuple[DataFrame, DataFrame]:
    """(article, templates): the templates in an article, as keys; and (article, pages). No list grows with a host."""
    marked = pages.select("article", "host", F.explode("subtrees").alias("x")).select("article", "host", "x.*")
    totals = pages.groupBy("article").agg(F.count("*").alias("pages"))
    # copies of an article count once: else its own text would be a template
    counted = marked.groupBy("key", "article").agg(F.count("*").alias("n"), F.any_value("host").alias("host"), F.any_value("flow").alias("flow")).groupBy("key").agg(F.count("*").alias("articles"), F.sum("n").alias("n"), F.any_value("host").alias("host"), F.any_value("flow").alias("flow"))
    counted = written(counted.where(F.col("articles") >= least_pages), "recurring")
    hosts = pages.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("all"))
    most_of_host = counted.where("flow").join(hosts, "host").where(F.col("articles") >= FLOW_SHARE * F.col("all"))
    templates = counted.where("not flow").select("key", "n").unionByName(most_of_host.select("key", "n"))
    templates = written(templates, "templates")
    # few of them can be in more than one in HOT_KEYS of their rows: those are broadcast, so no key takes many rows to a task
    most = max(hot_pages, -(-(templates.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS))
    hot = templates.where(F.col("n") > most).select("key", F.lit(True).alias("hot"))
    met = marked.where("within").join(F.broadcast(hot), "key", "left")
    cold = met.where("hot is null").join(templates.where(F.col("n") <= most).select("key"), "key")
    hits = met.where("hot").select("article", "key").unionByName(cold.select("article", "key"))
    return hits.groupBy("article").agg(F.collect_set("key").alias("templates")), totals


def salted(rows: DataFrame, templates: DataFrame, totals: DataFrame, hot_pages: int = HOT_PAGES) -> tuple[DataFrame, DataFrame]:
    """Rows with a salt and templates once for each salt of their article, so that no (article, salt) has much more than hot_pages rows.

    Articles on more than hot_pages pages, and on more than one in HOT_KEYS of all pages, are salted: there are HOT_KEYS of them
    at most, which bounds what is broadcast.
    """
    total = totals.agg(F.sum("pages")).first()[0] or 0
    most = max(hot_pages, -(-total // HOT_KEYS))
    hot = totals.where(F.col("pages") > most).select("article", F.expr(f"cast(ceil(pages / {most}) as long)").alias("salts"))
    # rows without a host meet nothing and are spread
    salt = F.expr("pmod(xxhash64(page_id, url), if(article is null, 1000000L, coalesce(salts, 1L)))")
    rows = rows.join(F.broadcast(hot), "article", "left").withColumn("salt", salt).drop("salts")
    templates = templates.join(F.broadcast(hot), "article", "left").withColumn("salt", F.explode(F.expr("sequence(0L, coalesce(salts, 1L) - 1)"))).drop("salts")
    return rows, templates


def _texts(frames):
    for frame in frames:
        texts = []
        for form, known in zip(frame["form"], frame["templates"], strict=True):
            lines, around, keys = json.loads(zlib.decompress(form).decode("utf-8", "surrogatepass"))
            texts.append(form_text(lines, around, keys, frozenset(map(int, known)) if known is not None else ()))
        yield pd.DataFrame({"page_id": frame["page_id"].astype("string").astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, hot_pages: int = HOT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars."""
    # ids as text: a column of whole numbers and nulls would become floats
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host())
    # pages are parsed for their subtrees and again for their articles: kept between, these would take more disk than they spare time
    subtrees = mapped(rows.where("host is not null").select("host", "html"), _subtrees, "article long, host long, subtrees array<struct<key: long, within: boolean, flow: boolean>>")
    templates, totals = article_templates(written(subtrees, "subtrees"), least_pages, hot_pages)
    forms, templates = salted(mapped(rows, _forms, "page_id string, url string, article long, form binary"), templates, totals, hot_pages)
    joined = forms.join(templates, ["article", "salt"], "left").select("page_id", "url", "form", "templates")
    return mapped(joined, _texts, "page_id long, url string, text string, n_chars long")
