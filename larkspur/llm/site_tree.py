"""Main text of pages by site style trees (Yi, Liu and Li, KDD 2003).

Pages of one host are merged into a tree of element nodes, named by their path of tags and classes. Each node has a
presentation importance (the entropy of the ways its children are laid out over the host's pages, to the base of the
number of pages) and a content importance (1 less the mean entropy of each content's spread over the pages: text that
stands in every page has entropy 1). Branches whose composite importance is low are taken out of every page of the
host. The plain text elements of articles share their paths with the text itself, so there each repeated block is
judged alone. Elements whose tag, role or class says that they are no main text (menus, headers, footers, adverts, ...) have
importance 0 on any host, and where a page marks its article, nothing outside it counts (main_blocks tells the exceptions).

Pages are parsed in Python, one at a time; merging, entropies and pruning are DataFrame aggregates with partial sums
before the shuffle, so a host of any size is never gathered.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small, stage

#: A branch is judged on hosts with so many pages that hold it, and pruned below this importance.
LEAST_PAGES = 4
LEAST_IMPORTANCE = 0.3
#: Weight of content against presentation.
CONTENT_WEIGHT = 0.9
SALTS = 16

#: Fixed vocabulary of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video form button select option textarea input label nav header footer aside dialog menu".split())
BLOCKS = frozenset("address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCKS | SKIPPED & frozenset("form nav header footer aside dialog menu".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion reader-comments related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tbody thead tfoot tr dl dt dd figure figcaption".split())
#: Names that say no more than that an element holds something, and names of containers of main text.
NEUTRAL = frozenset("area bar block box button buttons container content inner item items label link links list message outer section slot text title unit wrap wrapper".split())
CONTENT = frozenset("body content entry post story".split())
#: Elements of running text. One within an article is boilerplate only if all words of its class and id say so.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
_WORDS = re.compile(r"[a-z0-9]+")


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _short(path: str) -> str:
    """A path itself, or of a long one a digest of the whole and its last 400 characters."""
    return path if len(path) <= 440 else f"#{_digest(path)}/{path[-400:]}"


#: A skip by tag, role or attribute, and one by words of class or id alone. More than SURE - 1 of the latter count as sure.
SURE, WORD = 1_000, 1


class _Page(HTMLParser):
    """Blocks of text with the path of each, and each element's layout of children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int, bool]] = []  # tag, path, SURE or WORD added for each skip, inside an article
        self.blocks: list[tuple[str, int, bool, str]] = []  # path, sum of skips, inside an article, text
        self.layout: dict[str, list[str]] = {}
        self.pieces: list[str] = []
        self.at = ("", 0, False, True)

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            path, skip, article, _ = self.at
            self.blocks.append((path, skip, article, text))

    def _where(self) -> tuple[str, int, bool, bool]:
        for tag, path, skip, article in reversed(self.stack):
            if tag in BLOCKS or tag in SKIPPED:
                return path, skip, article, True
        return ("", 0, False, True)

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS or tag in SKIPPED
        if tag in CLOSES_P:
            self._close("p", stop=("article", "section", "div", "td", "th", "body", "li", "blockquote"))
        if tag == "li":
            self._close("li", stop=("ul", "ol", "menu"))
        if tag in ("dt", "dd"):
            self._close("dt", stop=("dl",))
            self._close("dd", stop=("dl",))
        if block:
            self._flush()
        if tag in ("br", "td", "th"):
            self.pieces.append(" ")
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "itemprop")}
        words = set(_WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}".lower()))
        parent = self.stack[-1] if self.stack else ("", "", 0, False)
        article = parent[3] or tag in ("article", "main") or named.get("role", "").lower() == "main" or named.get("itemprop", "") == "articleBody"
        named_so = bool(words & BOILERPLATE) and not (article and tag in TEXT and words - BOILERPLATE - NEUTRAL)
        sure = tag in SKIPPED or named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
        skip = SURE if sure else WORD if named_so else 0
        if tag in ("html", "body", "article", "main") and not named.get("role"):
            skip = 0  # the page or its article as a whole is no boilerplate, whatever its class lists
        name = ".".join([tag, *sorted(words)])
        self.layout.setdefault(parent[1], []).append(name)
        self.stack.append((tag, _short(f"{parent[1]}/{name}"), parent[2] + skip, article))
        if block:
            self.at = self._where()

    def _close(self, tag, stop=()):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._flush()
                del self.stack[i:]
                self.at = self._where()
                return
            if self.stack[i][0] in stop or self.stack[i][0] in SKIPPED:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or all(x[0] != tag for x in self.stack):
            return
        if tag in BLOCKS or tag in SKIPPED:
            self._flush()
        while self.stack.pop()[0] != tag:
            pass
        self.at = self._where()

    def handle_data(self, data):
        self.pieces.append(data)


def parse(html: str) -> tuple[list[tuple[str, int, bool, str]], dict[str, list[str]]]:
    """(blocks with their skips, layouts of children by path) of a page; broken markup is read as far as it goes."""
    page = _Page()
    page.feed(html)
    page.close()
    page._flush()
    return page.blocks, page.layout


def _in_content(path: str) -> bool:
    """Whether an element above, outside any article, is named as a container of main text."""
    for name in path.split("/"):
        tag, *words = name.split(".")
        if tag in ("article", "main"):
            return False
        if tag not in TEXT and CONTENT & set(words):
            return True
    return False


def main_blocks(blocks: list[tuple[str, int, bool, str]]) -> list[tuple[str, str]]:
    """(path, text) of the blocks that may be main text, before the site's tree is asked.

    Where the page marks an article, those inside it; but where a container named as content stands apart from every
    article and has more text than they, that, since such articles are teasers. Where words of classes and ids alone
    would leave nothing of the whole page, they don't count within its article.
    """
    open_ = [b for b in blocks if not b[1]]
    if not open_:
        return [(p, t) for p, skip, article, t in blocks if article and skip < SURE]
    inside = [b for b in open_ if b[2]]
    if not inside:
        return [(p, t) for p, _, _, t in open_]
    apart = [b for b in open_ if not b[2] and _in_content(b[0])]
    if sum(len(b[3]) for b in apart) > sum(len(b[3]) for b in inside) and not any(_in_content(b[0]) for b in inside):
        inside = apart
    return [(p, t) for p, _, _, t in inside]


def _free(path: str) -> bool:
    """Whether a path goes on from its article by plain text elements alone; such branches are judged block by block."""
    names = path.split("/")
    for i, name in enumerate(names):
        if name.split(".")[0] in ("article", "main"):
            return all(n in PLAIN for n in names[i + 1 :])
    return False


_PARSED = "page_id long, url string, blocks array<struct<path:string,free:boolean,text:string>>, layout array<struct<path:string,digest:string>>"


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("path", pa.string()), ("free", pa.bool_()), ("text", pa.string())])), pa.list_(pa.struct([("path", pa.string()), ("digest", pa.string())]))]
        names = ["page_id", "url", "blocks", "layout"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for html in part.column("html").to_pylist():
                    blocks, layout = parse(html)
                    kept = [{"path": p, "free": _free(p), "text": t} for p, t in main_blocks(blocks)]
                    seen = {b["path"] for b in kept if not b["free"]}
                    rows.append((kept, [{"path": p, "digest": _digest("|".join(c))} for p, c in layout.items() if p in seen]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([r[0] for r in rows], kinds[2]), pa.array([r[1] for r in rows], kinds[3])], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, _PARSED)


def low_branches(parsed: DataFrame) -> DataFrame:
    """(host, path) of the branches to prune: of importance below LEAST_IMPORTANCE on at least LEAST_PAGES different pages."""
    # pages of equal blocks and layouts count once, however many copies the host has
    parsed = parsed.select("host", F.xxhash64("blocks", "layout").alias("row"), "blocks", "layout")
    blocks = parsed.select("host", "row", F.explode("blocks").alias("b")).where("not b.free").select("host", "row", "b.path", F.xxhash64("b.text").alias("content"))
    blocks = blocks.distinct()
    pages = blocks.select("host", "path", "row").distinct().groupBy("host", "path").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    spread = blocks.groupBy("host", "path", "content").agg(F.count("*").alias("c"))
    content = spread.join(pages, ["host", "path"]).groupBy("host", "path").agg(F.first("m").alias("m"), (1 - F.avg(F.log("c") / F.log("m"))).alias("content"))
    styles = parsed.select("host", "row", F.explode("layout").alias("l")).select("host", "row", "l.path", "l.digest").distinct().groupBy("host", "path", "digest").agg(F.count("*").alias("c"))
    total = styles.groupBy("host", "path").agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    presented = styles.join(total, ["host", "path"]).where("n > 1").groupBy("host", "path").agg((-F.sum(p * F.log(p) / F.log("n"))).alias("presentation"))
    both = content.join(presented, ["host", "path"], "left")
    importance = (1 - CONTENT_WEIGHT) * F.coalesce("presentation", F.lit(0.0)) + CONTENT_WEIGHT * F.col("content")
    return both.where(importance < LEAST_IMPORTANCE).select("host", "path")


def low_texts(parsed: DataFrame) -> DataFrame:
    """(host, block) of the plain blocks of articles to prune: digests of path and text that recur over the host's pages.

    Such a block is a branch's leaf of its own: its content importance is 1 - log c / log m, for c of the m different
    pages with that path.
    """
    parsed = parsed.select("host", F.xxhash64("blocks", "layout").alias("row"), "blocks")
    blocks = parsed.select("host", "row", F.explode("blocks").alias("b")).where("b.free").select("host", "row", F.xxhash64("b.path").alias("path"), F.xxhash64("b.path", "b.text").alias("block")).distinct()
    pages = blocks.select("host", "path", "row").distinct().groupBy("host", "path").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    held = blocks.groupBy("host", "path", "block").agg(F.count("*").alias("c")).where("c > 1")
    return held.join(pages, ["host", "path"]).where(1 - F.log("c") / F.log("m") < LEAST_IMPORTANCE).select("host", "block")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html; more columns are ignored).

    Blocks keep the page's order, white space inside a block is one space, blocks are joined by a line end; nothing
    is cut. Null and empty html, and pages of boilerplate alone, give ''. A null url is a host of its own. Repeated
    rows give repeated results. No rows give no rows.
    """
    host = F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    parsed = stage(_parsed(pages).select("page_id", "url", F.lower(host).alias("host"), "blocks", "layout").withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    branches = low_branches(parsed).select("host", "path", F.lit(None).cast("long").alias("block"))
    texts = low_texts(parsed).select("host", F.lit(None).cast("string").alias("path"), "block")
    low = stage(branches.unionByName(texts).groupBy("host").agg(F.collect_set("path").alias("low"), F.collect_set("block").alias("repeated")), "low-branches")
    if small(low) is not low:
        joined = parsed.join(small(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = parsed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kept = F.filter("blocks", lambda b: F.col("low").isNull() | F.when(b["free"], ~F.array_contains("repeated", F.xxhash64(b["path"], b["text"]))).otherwise(~F.array_contains("low", b["path"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
