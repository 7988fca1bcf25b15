"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of block elements with their
classes. A node whose text is the same on many pages of the host has little content importance (one
less the mean entropy of its text features over the pages), one that always has the same children
little presentation importance (the entropy of its child sequences); branches of low importance
are template, not article. How low, the host's own nodes say: importance falls by a step from what
holds most of its text to its template. What elements and classes say about themselves (navigation, footer,
advert, comments, ...) is believed from the first page on, also where a host has too few pages. Copies
of an article count as one page, and what a marked article holds is never taken for template.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from momentloom.session import stage

#: Pages of distinct articles a node must be on before its entropy says anything; importance below which it is
#: template on a host without a step; weight of presentation beside content.
LEAST_PAGES, LOW, PRESENTATION = 8, 0.2, 0.1
#: A step between the importances of a host's nodes, and the share of its text that has to lie above it.
STEP, MAIN_SHARE = 0.1, 0.5

# Elements of HTML by what they do to text.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript", "template"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
             "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
             "table tbody td tfoot th thead tr ul option optgroup select button".split())
_NOISE = set("nav footer aside form head menu dialog button select option optgroup fieldset legend svg math canvas object audio video "
             "map applet search datalist".split())
_NOISE_WORDS = set("ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promotion banner "
                   "menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail widget widgets footer masthead toolbar comment comments "
                   "discussion disqus respond responses replies reply cookie cookies consent gdpr notice notices notification alert popup modal "
                   "overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login "
                   "signin search pagination pager skip hidden".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_KEEP_TAGS = {"html", "body", "article", "main"}
_COMMENTS = {"comments", "responses", "replies", "disqus", "discussion"}
#: Inside an article these are its text, whatever their classes.
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre caption figcaption summary".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
_FENCE = {"ul", "ol", "dl", "table", "article", "section", "div", "nav", "aside", "main", "body", "html", "blockquote", "form", "footer", "header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)  # only a quote behind = opens a value
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if "=" in source or "hidden" in source else {}


def _words(value: str) -> set[str]:
    return set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))


class _Element:
    __slots__ = ("tag", "label", "path", "noise", "level", "children", "inline")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "_Element | None"):
        self.tag, self.inline = tag, tag not in _BLOCK
        words = _words(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else set()
        self.label = f"{tag}.{attrs['class'].lower()}" if attrs.get("class") else tag
        self.path = f"{parent.path}/{self.label}" if parent else self.label
        self.level, self.noise, self.children = (parent.level, parent.noise, []) if parent else (0, False, [])
        inside = self.level > 0
        role = attrs.get("role", "").lower()
        own = tag in _NOISE or role in _NOISE_ROLES or (tag == "header" and not inside) or "hidden" in attrs or attrs.get("aria-hidden") == "true" \
            or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        if self.level == 2 and tag != "article":
            # An article's own parts are called many things; only a class that is such a word as a whole counts.
            own = own or (tag not in _TEXT_TAGS and bool(set(attrs.get("class", "").lower().split()) & _NOISE_WORDS)) or bool(words & _COMMENTS)
        elif tag not in _KEEP_TAGS or (tag == "article" and inside):
            own = own or bool(words & _NOISE_WORDS) or ("header" in words and not inside)
        self.noise = self.noise or own
        if not self.noise:
            if tag == "article" or attrs.get("itemprop") == "articleBody":
                self.level = 2
            elif tag == "main" or role == "main":
                self.level = max(self.level, 1)
            elif tag == "h1" and self.level == 1:
                self.level = 2  # the title of an article that begins behind it


def parse(html: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """Text blocks (text, node path, level) in page order, without those that elements and classes
    call noise, and the nodes with their child sequences. Level 2 is inside an article, 1 inside
    main. A block ends where a block element begins or ends; ``br`` and inline elements don't end
    it. Unclosed and misnested tags, comments, stray quotes and cut-off pages are read as browsers do, roughly.
    """
    root = _Element("html", {}, None)
    stack, blocks, styles, text = [root], [], [], []
    at, size = 0, len(html)

    def flush():
        words = " ".join(unescape("".join(text)).split())
        if words:
            top = next(e for e in reversed(stack) if not e.inline)
            blocks.append((words, top.path, top.level))
        text.clear()

    def say(words: str):
        if not stack[-1].noise:
            text.append(words)

    def close(depth: int):
        if depth == 0 or not all(e.inline for e in stack[depth:]):
            flush()
        while len(stack) > depth:
            done = stack.pop()
            if not done.noise:
                styles.append((done.path, " ".join(done.children)))

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in _RAW and not ends:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if end is None:
                at = size
            else:
                close_at = html.find(">", end.start())
                at = size if close_at < 0 else close_at + 1
            continue
        if tag == "br":
            say(" ")
        if tag in _VOID and tag != "hr":
            continue
        if not ends:
            attrs = _attributes(m[3])
            if tag not in _BLOCK:  # an inline element matters only if it is noise
                if tag in _NOISE or attrs:
                    inner = _Element(tag, attrs, stack[-1])
                    if inner.noise and not stack[-1].noise and not m[3].endswith("/"):
                        stack.append(inner)
                continue
            flush()
            if tag == "hr":
                continue
            if tag in ("html", "body") and any(e.tag == tag for e in stack[1:] or stack):
                continue
            if tag == "html":
                continue
            drop = _CLOSES.get(tag)
            if drop:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in drop:
                        close(k)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                    elif stack[k].tag in _FENCE and not (tag == "body"):
                        break
            open_p = next((k for k in range(len(stack) - 1, -1, -1) if not stack[k].inline), 0)
            if stack[open_p].tag == "p":
                close(open_p)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
                close(len(stack) - 1)
            child = _Element(tag, attrs, stack[-1])
            stack[-1].children.append(child.label)
            stack.append(child)
        elif tag == "p" and not any(e.tag == "p" for e in stack):
            flush()
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
    close(0)
    return blocks, styles


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PARSED = ("page_id bigint, url string, host string, article bigint, blocks array<struct<text: string, node: bigint, level: int, feature: bigint>>, "
           "styles array<struct<node: bigint, style: bigint>>")


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, article (the text on the page's highest level), blocks and styles of
    each row; articles, nodes, features and styles as hashes."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        number = lambda s: xxh3_64_intdigest(s) - 2**63
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                blocks, styles = parse(html or "")
                top = max((level for _, _, level in blocks), default=0)
                rows.append({"page_id": page, "url": url, "host": host_of(url), "article": number("\n".join(t for t, _, level in blocks if level == top)),
                             "blocks": [{"text": t, "node": number(p), "level": level, "feature": number(t)} for t, p, level in blocks],
                             "styles": [{"node": a, "style": b} for a, b in {(number(p), number(s)) for p, s in styles}]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    import pyarrow as pa

    block = pa.struct([("text", pa.string()), ("node", pa.int64()), ("level", pa.int32()), ("feature", pa.int64())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("article", pa.int64()), ("blocks", pa.list_(block)),
                        ("styles", pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())])))])
    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, _PARSED)


def node_importance(parsed: DataFrame) -> DataFrame:
    """host, node, n_pages, chars, content, presentation, importance of each node with text.

    Pages are counted by distinct articles, so copies say no more than one page. The tree of a
    host is the table of its nodes: rows are combined before each shuffle, so a host with a
    third of all pages is no more than its nodes and articles. Entropies are in units of the
    logarithm of the node's pages, a feature weighing as much as the pages it is on; a node on fewer
    than ``LEAST_PAGES`` pages has importance 1.
    """
    texts = parsed.select("host", "article", F.explode(F.transform("blocks", lambda b: F.struct(
        b["node"].alias("node"), b["feature"].alias("feature"), F.char_length(b["text"]).alias("chars")))).alias("x"))
    features = texts.select("host", "article", "x.node", "x.feature", "x.chars").distinct().groupBy("host", "node", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    nodes = (parsed.select("host", "article", F.explode(F.array_distinct(F.col("blocks.node"))).alias("node")).distinct()
             .groupBy("host", "node").agg(F.count(F.lit(1)).alias("n_pages")))
    spread = features.groupBy("host", "node").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("_content"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    styles = (parsed.select("host", "article", F.explode("styles").alias("x")).select("host", "article", "x.node", "x.style").distinct()
              .groupBy("host", "node", "style").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("host", "node").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("_style")))
    whole = F.log(F.greatest("n_pages", F.lit(2)))
    few = F.col("n_pages") < LEAST_PAGES
    return (nodes.join(spread, ["host", "node"]).join(styles, ["host", "node"], "left")
            .withColumn("content", F.when(few, 1.0).otherwise(1 - F.col("_content") / whole))
            .withColumn("presentation", F.when(few, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("_style", F.lit(0.0)) / whole)))
            .select("host", "node", "n_pages", "chars", "content", "presentation",
                    F.when(few, 1.0).otherwise(F.col("content") * (1 - PRESENTATION) + F.col("presentation") * PRESENTATION).alias("importance")))


def template_nodes(importance: DataFrame) -> DataFrame:
    """host, node of the nodes that are template.

    A host's nodes in order of importance: the highest step of ``STEP`` or more above which lie
    ``MAIN_SHARE`` of the host's text parts article from template. Without one, ``LOW`` does. Nodes
    on few pages lie above all steps.
    """
    up = W.partitionBy("host").orderBy("importance", "node")
    down = W.partitionBy("host").orderBy(F.desc("importance"), F.desc("node")).rowsBetween(W.unboundedPreceding, 0)
    above = F.sum("chars").over(down) / F.sum("chars").over(W.partitionBy("host"))
    step = (F.col("importance") - F.lag("importance").over(up) >= STEP) & (above >= MAIN_SHARE)
    marked = importance.withColumn("_edge", F.when(step, F.col("importance")))
    cut = F.coalesce(F.max("_edge").over(W.partitionBy("host")), F.lit(LOW))
    return marked.withColumn("_cut", cut).filter(F.col("importance") < F.col("_cut")).select("host", "node")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text per row of ``pages`` (page_id, url, html).

    Text blocks of the article (else of main, else of the page) joined by one newline. A marked
    article stays whole; from main or the page the branches of low importance on the page's host
    are left out. White space inside a block becomes one
    space; character references are decoded. If a page has nothing but low branches, its tree
    says nothing about it and the blocks stay. A null, empty or text-free page gives an empty
    text; pages without a readable host form one site. Repeated rows are extracted each.
    """
    parsed = stage(parse_pages(pages), "parsed")
    # Written first, so that Spark knows its size: a small table goes to the pages, not they to it.
    low = stage(template_nodes(node_importance(parsed)).groupBy("host").agg(F.collect_set("node").alias("low")), "low")
    level = F.coalesce(F.array_max(F.col("blocks.level")), F.lit(0))
    rows = parsed.select("page_id", "url", "host", F.filter("blocks", lambda b: b["level"] == level).alias("blocks")).join(low, "host", "left")
    high = F.filter("blocks", lambda b: (b["level"] == 2) | ~F.array_contains(F.coalesce("low", F.array().cast("array<bigint>")), b["node"]))
    kept = F.when(F.col("low").isNull() | (F.size(high) == 0), F.col("blocks")).otherwise(high)
    return rows.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
