"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tag names with their
classes).  For each node Spark counts, over the host's pages, how often each presentation (the
sequence of child tags) and each content (the text below the node) occurs.  A host of m pages is
taken to have ``PRIOR`` pages more, which nothing repeats; with the base m + PRIOR,

* the presentation importance is the entropy of a node's presentations,
* a content that df pages share has importance 1 - log(df), and the content importance of the node
  is the mean over its occurrences,
* the two are combined with weights 1 - GAMMA**l and GAMMA**l for l different presentations.

So importance is defined for every m, and what two or three pages share keeps more of it than what
hundreds share.  A branch below ``LOW`` goes if about as many pages present it alike, and so does a
single text block below it.  Besides, elements that HTML or their class names declare as menus,
headers, footers, side bars, notices, adverts, forms, comments and the like have no importance from
the start, and where a page marks its article or main part, text outside has none either.  If
repetition alone would empty a page, it is not applied to that page.  Declared names do not count on
elements around the page's own main part (see ``Page._settle``).

Counts are aggregated in tasks before the shuffle; only low nodes (few for each host) go back to
the pages, by a broadcast join if there are few enough, else by a shuffled one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.llm.words import small_batches
from ctxtab.session import cut_lineage

GAMMA = 0.9
LOW = 0.05
PRIOR = 0.35              # pages of their own kind that a host is taken to have besides those seen
COUNTER = 200_000         # entries a task holds before it sends its counts
BROADCAST_ROWS = 100_000
PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F  # of the names of contents

# Element names and class words of the HTML standard and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary
table tbody td tfoot th thead title tr ul""".split())
NOISE_TAGS = frozenset("""head nav footer aside form button select option input textarea script style noscript iframe template svg math
object canvas dialog menu""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert newsletter subscribe subscription signup sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header masthead
footer comment comments reply replies respond disqus share sharing social related recommended widget popup modal overlay toolbar pagination
pager copyright disclaimer login search skip""".split())
# Of these, the words of what stands beside a page's own article, which other articles may be inside of.
OTHER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments reply replies
respond related recommended widget""".split())
HEADER_WORDS = frozenset("header masthead".split())
SAYS_OF_PAGE = frozenset("has no with without".split())  # has-sidebar names the page, not a side bar
MAIN_TAGS = ("article", "main")
LOOSE, OTHER, FIRM = 1, 2, 3  # marks of noise: by name, role or form; by a word of OTHER_WORDS; by element or hidden
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_CLOSES_P = BLOCK - {"br", "option", "optgroup", "title"}
# Fixed value: a start tag on the left ends an open element on the right, up to the nearest enclosing one of its scope.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"})}


def _short(s: str) -> str:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Node:
    """An element; its blocks of text are those numbered from ``first`` up to ``end``."""

    __slots__ = ("tag", "path", "mark", "up", "noise", "main", "header", "heading", "children", "first", "end", "open", "marks", "cell", "low", "own")

    def __init__(self, tag: str, path: str, mark: int, up: Node | None, main: bool, header: bool, first: int):
        self.tag, self.path, self.mark, self.up, self.main, self.header = tag, path, mark, up, main, header
        self.noise = mark > 0 or (up is not None and up.noise)
        self.heading = tag in HEADINGS or (up is not None and up.heading)
        self.children: list[str] = []
        self.first, self.end, self.open = first, first, True
        self.marks, self.cell, self.low, self.own = 0, None, False, False


class Page:
    """Blocks of text of a page, each with its innermost element, from one pass over its tokens.

    Time and memory are linear in the page, however deep elements nest: an element knows its range of
    blocks, and open elements are found by their places on the stack, kept for each tag name.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, Node]] = []
        self.nodes: list[Node] = []
        self._text: list[str] = []
        self._at: Node | None = None
        self._begun: list[int] = []  # for each block begun, how many texts came before it
        self.root = Node("", "", 0, None, False, False, 0)
        self.stack: list[Node] = [self.root]
        self._open: dict[str, list[int]] = {}   # places on the stack of open elements, by tag
        self._open_blocks: list[int] = []
        self._open_closers: list[int] = []      # of those that end a paragraph
        self.bounded = True          # text outside the main part goes
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            tag = m.group(2)
            if tag is None:
                if m.group()[0] != "<" or len(m.group()) == 1:
                    self._add(m.group())
                continue
            tag = tag.lower()
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, m.group(3))
            if tag in RAW and not m.group(3).rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, m.end())
                at = close.start() if close else len(source)  # what stands inside is no markup and no text
        self._flush()
        self._cut(1)
        self._begun.append(len(self.blocks))
        for n in self.nodes:  # from blocks begun to blocks that have a text
            n.first, n.end = self._begun[n.first], self._begun[n.end]
        for tag in ("main", "article"):
            self._settle(tag)

    def _add(self, text: str) -> None:
        if text.strip() and self._at is None:
            self._at = self.stack[-1]
            self._begun.append(len(self.blocks))
        if self._at is not None or text.strip():
            self._text.append(text)

    def _flush(self) -> None:
        if self._at is not None:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((text, self._at))
        self._text, self._at = [], None

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in _CLOSES_P:
            if self._open_closers and self.stack[self._open_closers[-1]].tag == "p":
                self._cut(self._open_closers[-1])
        if tag in _ENDS:
            ended, within = (max((self._open[t][-1] for t in tags if self._open.get(t)), default=0) for tags in _ENDS[tag])
            if ended > within:
                self._cut(ended)
        top = self.stack[-1]
        name, mark = tag, 0 if tag not in NOISE_TAGS else LOOSE if tag == "form" else FIRM
        header = top.header or (tag == "header" and top.main)
        if attrs.strip(" /"):
            a = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
            words = f"{a.get('class', '')} {a.get('id', '')}".split()
            if words:
                name = ".".join([tag, *sorted(set(a.get("class", "").lower().split()))])
            if tag not in ("html", "body", *MAIN_TAGS):
                found = {w.lower() for x in words for k in [_SPLIT.split(x)] if k[0].lower() not in SAYS_OF_PAGE for w in k} & NOISE_WORDS
                if top.main and found & HEADER_WORDS:  # of the article: its heading stays
                    header, found = True, found - HEADER_WORDS
                if "hidden" in a or a.get("aria-hidden") == "true":
                    mark = FIRM
                elif found or a.get("role", "").lower() in NOISE_ROLES:
                    mark = max(mark, OTHER if found & OTHER_WORDS else LOOSE)
            elif tag in MAIN_TAGS and {w.lower() for x in words for w in _SPLIT.split(x)} & {"comment", "comments", "reply"}:
                mark = FIRM
        if tag == "header" and not top.main:
            mark = FIRM
        top.children.append(tag)
        if tag in VOID:
            return
        path = f"{top.path}/{name}"
        node = Node(tag, path if len(path) <= 300 else "#" + _short(path), mark, top, top.main or tag in MAIN_TAGS, header, len(self._begun))
        self.nodes.append(node)
        for places in self._places(tag):
            places.append(len(self.stack))
        self.stack.append(node)

    def _places(self, tag: str) -> list[list[int]]:
        return [self._open.setdefault(tag, []), *([self._open_blocks] if tag in BLOCK else []), *([self._open_closers] if tag in _CLOSES_P else [])]

    def _shut(self, node: Node) -> None:
        for places in self._places(node.tag):
            places.pop()
        node.open, node.end = False, len(self._begun)

    def _cut(self, k: int) -> None:
        """End the elements from place ``k`` of the stack on."""
        while len(self.stack) > k:
            node = self.stack.pop()
            if node.open:
                self._shut(node)
        while not self.stack[-1].open:
            self.stack.pop()

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._open.get(tag):
            return
        k = self._open[tag][-1]
        if tag not in BLOCK and self._open_blocks and self._open_blocks[-1] > k:
            self._shut(self.stack[k])   # an inline element that ends inside a block: the block stays open
        else:
            self._cut(k)

    def _settle(self, tag: str) -> None:
        """Marks around the page's own ``tag`` (main or article) go, and around those in the same wrappers.

        Its own is one inside no other, with the weakest and the fewest marks around it, then the longest.
        Firm marks go if the page has no text else, and those of other articles' places if it has no more
        text else.  Text outside then stays too if it is longer and the page marks no other main part.
        """
        found = []
        has = tag != "main" and any(n.tag == "main" and not n.noise and n.end > n.first for n in self.nodes)
        # marked elements around a node as linked cells (name, worst, how many, node, cell further out); none inside another ``tag``
        self.root.cell, names = (0, 0, 0, None, None), {}
        for n in self.nodes:
            n.marks, out = n.up.marks + (n.mark > 0), n.up.cell
            if out is None or n.tag == tag:
                n.cell = None
            elif n.mark:
                n.cell = (names.setdefault((n.path, out[0]), len(names) + 1), max(n.mark, out[1]), out[2] + 1, n, out)
            else:
                n.cell = out
        for n in self.nodes:
            if n.tag != tag or n.mark or n.end == n.first or (has and not n.up.main):  # beside a main part no article is the page's own
                continue
            if n.up.cell is not None:
                length = sum(len(text) for text, last in self.blocks[n.first:n.end] if tag == "main" or last.marks == n.marks)
                if length:
                    found.append((n.up.cell[1], n.up.cell[2], -length, n.up.cell))
        if not found:
            return
        worst, _, length, around = min(found, key=lambda x: x[:3])
        if not worst:
            return
        left = len(self.kept())
        if (worst == FIRM and left) or (worst == OTHER and tag != "main" and left > -length):
            return
        if tag != "main" and left > -length and not any(n.main and not n.noise and n.end > n.first for n in self.nodes):
            self.bounded = False
        for *_, cell in found:
            if cell[0] == around[0]:
                while cell[3] is not None and cell[3].mark:
                    cell[3].mark, cell = 0, cell[4]
        for n in self.nodes:
            n.noise = n.mark > 0 or n.up.noise

    def kept(self, low_paths=frozenset(), low_texts=frozenset()) -> str:
        for n in self.nodes:
            n.low = n.up.low or n.path in low_paths
            n.own = n.up.own or (n.main and not n.noise)
        has_main = self.bounded and any(last.own for _, last in self.blocks)
        out, again = [], []
        for text, last in self.blocks:
            if last.noise or (has_main and not last.main) or (last.header and not last.heading):
                continue
            again.append(text)
            if not last.low and not (low_texts and (last.path, _short(text)) in low_texts):
                out.append(text)
        return "\n".join(out or again)

    def contents(self):
        """A function that names the text below a node: a polynomial hash of its blocks' hashes, from sums up to each block."""
        upto, power = [0], [1]
        for text, _ in self.blocks:
            upto.append((upto[-1] * BASE + int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=15).digest(), "little")) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        return lambda n: f"{(upto[n.end] - upto[n.first] * power[n.end - n.first]) % PRIME:x}.{n.end - n.first}"


def _counts(batches):
    """(host, path, kind, feature, pages) of a task's pages; features are presentations (0) and contents (1)."""
    def send(counter):
        cols = list(zip(*counter)) if counter else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                                           pa.array(cols[3], pa.string()), pa.array(list(counter.values()), pa.int64())], ["host", "path", "kind", "feature", "pages"])
    counter: Counter = Counter()
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page, seen = Page(source or ""), set()
            content = page.contents()
            for n in page.nodes:
                if n.noise:  # goes in any case
                    continue
                seen.add((host, n.path, 0, _short(" ".join(n.children))))
                seen.add((host, n.path, 1, content(n)))
            for text, last in page.blocks:
                if not last.noise:
                    seen.add((host, last.path, 2, _short(text)))
            counter.update(seen)
            if len(counter) > COUNTER:
                yield send(counter)
                counter = Counter()
    yield send(counter)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, feature): low nodes (feature null) and low text blocks of each host; ``pages`` has host and html."""
    counted = (pages.select("host", "html").mapInArrow(_counts, "host string, path string, kind int, feature string, pages long")
               .groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("n")))
    size = pages.groupBy("host").agg(F.count("*").alias("m"))
    node = counted.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("most"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("shown_log"),
        F.sum(F.when(F.col("kind") == 0, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("said"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("said_log"))
    base = F.log(F.col("m") + F.lit(PRIOR))
    shows = (F.log("shown") - F.col("shown_log") / F.col("shown")) / base
    says = 1 - F.col("said_log") / F.col("said") / base
    weight = F.pow(F.lit(GAMMA), "styles")
    # a path that fewer of the host's pages have than would make a shared text low is no evidence
    nodes = (node.join(size, "host").where(F.log("most") >= base * (1 - LOW))
             .where((1 - weight) * shows + weight * says < LOW).select("host", "path", F.lit(None).cast("string").alias("feature")))
    texts = (counted.where("kind = 2").join(size, "host").where(1 - F.log("n") / base < LOW).select("host", "path", "feature"))
    return nodes.unionByName(texts)


def _extract(batches):
    for batch in batches:
        out = []
        for source, low in zip(batch.column("_html").to_pylist(), batch.column("_low").to_pylist()):
            paths = {x["path"] for x in low or () if x["feature"] is None}
            texts = {(x["path"], x["feature"]) for x in low or () if x["feature"] is not None}
            out.append(Page(source or "").kept(paths, texts))
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(out, pa.string())], ["_doc", "_text"])


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_out: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by one line feed in page order.  Null html: empty text.  Pages with a null
    url or one without a host are one host.  Repeated rows count as pages each.  A column named
    like the result is replaced.  Empty table: empty result.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    low = cut_lineage(style_tree(pages.select(host.alias("host"), F.col(html_col).alias("html"))))
    by_host = low.groupBy("host").agg(F.collect_list(F.struct("path", "feature")).alias("_low")).withColumnRenamed("host", "_host")
    by_host = F.broadcast(by_host) if low.count() <= BROADCAST_ROWS else by_host
    keep = [c for c in pages.columns if c not in (html_col, text_out)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), host.alias("_host"), F.col(html_col).alias("_html"))
    rows = rows.join(by_host, "_host", "left").select("_doc", "_html", "_low")
    schema = T.StructType([rows.schema["_doc"], T.StructField("_text", T.StringType())])
    return rows.mapInArrow(_extract, schema).select("_doc.*", F.col("_text").alias(text_out))
