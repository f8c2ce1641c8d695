"""Main text of web pages by consensus host paths.

A page is cut into tags and text by one regular expression and read once with
a stack of open elements, however deep. Menus, headers, footers, scripts and
styles are passed over by tag or role, and hidden elements. Asides, forms and dialogs are left out unless the
page lies in them: they hold more than half of its text outside links, and an article or hardly any other text is there. Words of classes
and ids (sidebar, advert, comments, ...) only make an element suspect: it is
left out unless it holds more than half of the page's text outside links; one
whose name says nothing else, as ``comments``, only counts as text where hardly
any other is there, or, comments aside, an article lies in it. Each page votes for its container: its
article or main element, or the innermost element around all articles of size,
else the innermost container of all text outside links. Votes count by the share of
the text they hold and are added up for each host and generalised tag-class
path in Spark, and every page is read again with its host's winning path. A
page that lacks that path, or has less than a quarter of a long text there, uses its own best container.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Articles count if together they hold this share of the text outside links.
COVER = 0.4
#: Articles of at least this share of the largest one are parts of the main text; a host's path must hold as much of the page's own best container.
PART = 0.25
#: A suspect element with more than this share of the text is none.
MOST = 0.5
#: A plainly named one of this many characters is none if at most so much of the text is elsewhere.
LONG, REST = 200, 0.05

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^<>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b(?!\s*=)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names and words of classes, ids and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
PASSED_TAGS = set("nav footer head button menu input label".split())
PASSED_ROLES = set("navigation banner contentinfo search alert menu menubar".split())
#: These are passed over unless the page lies in them.
SOFT = set("aside form dialog".split()) | {"complementary"}
#: What these hold is no text. Where one does not end, those of the first kind take the rest, the others end at the next block.
RAW = set("script style noscript template textarea".split())
RAW_TO_BLOCK = set("iframe svg title select object".split())
PASSED_WORDS = set(
    "nav navbar navigation menu masthead footer sidebar aside ad ads advert adverts advertisement advertising banner "
    "sponsor sponsored promo promoted comment comments disqus respond replies responses cookie cookies consent notice notices "
    "notification popup modal newsletter subscribe share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager widget toolbar login signup search header gdpr overlay".split()
)
COMMENT_WORDS = set("comment comments disqus respond replies responses".split())
#: Beside these, a class word still says nothing else; before a word, the others only tell of the page's state.
NEUTRAL_WORDS = set(
    "site page top bottom left right box list block section area wrap wrapper container inner outer bar item items links "
    "link primary secondary global region module panel col column row group".split()
)
STATE_WORDS = set("with has no without is".split())
#: Elements that may be voted for, besides custom ones and cells of several blocks.
CONTAINERS = set("html body main article section div center".split()) | {""}
HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
CONTENT_WORDS = set("article post entry story title main content body text".split())
ARTICLE_WORDS = set("article post entry story".split())
CLOSES = {  # an opening tag ends these open elements, up to the scope
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "p": {"p", "head"},
}
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW | RAW_TO_BLOCK}
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - {'legend'}))})\b", re.I)
SCOPE = set("table ul ol dl div article section main body td th blockquote".split())


class Element:
    __slots__ = ("tag", "name", "parent", "depth", "key", "passed", "suspect", "article", "linked", "dropped", "weight", "apart", "count", "holds")

    def __init__(self, tag: str, name: str, parent: Element | None, passed: bool, suspect: int, article: bool, linked: bool) -> None:
        self.tag, self.name, self.parent, self.passed, self.suspect = tag, name, parent, passed, suspect
        self.article, self.linked = article, linked
        self.depth = parent.depth + 1 if parent else 0
        self.key = path_key(name, parent.key if parent else 0)
        self.dropped = False
        self.weight = self.apart = 0.0  # text outside links; of that, outside articles
        self.count, self.holds = 0, False  # text blocks; whether an article that is not suspect lies in it

    def path(self) -> str:
        names, at = [], self
        while at is not None:
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


def path_key(name: str, above: int = 0) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above)


def _suspicion(tag: str, names: list[str]) -> int:
    """0: no class word; 1: some; 2: a name that says nothing else; 3: comments."""
    tokens = [[w.lower() for w in WORD.findall(name)] for name in names]
    tokens = [t for t in tokens if t and not (len(t) > 1 and t[0] in STATE_WORDS)]
    words = {w for t in tokens for w in t}
    passed = words & PASSED_WORDS
    if not passed or (passed == {"header"} and words & CONTENT_WORDS):
        return 0
    plain = [bool(set(t) & PASSED_WORDS) and set(t) <= PASSED_WORDS | NEUTRAL_WORDS for t in tokens]
    if tag in ("article", "main"):
        return (3 if words & COMMENT_WORDS else 2) if all(plain) else 0
    if words & COMMENT_WORDS:
        return 3
    return 2 if any(plain) and not words & CONTENT_WORDS else 1


def _opened(tag: str, attrs: str, parent: Element) -> Element:
    found: dict[str, str] = {}
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in ATTR.finditer(attrs):
            found[(m[1] or m[5]).lower()] = m[2] or m[3] or m[4] or ""
    names = found.get("class", "").split()
    classes = sorted({re.sub(r"\d+", "#", c.replace(">", "")) for c in names})
    role = found.get("role", "").lower()
    if "id" in found:
        names = [*names, found["id"]]
    suspect = _suspicion(tag, names) if names and tag not in ("html", "body") else 0
    if (tag in SOFT or role in SOFT) and tag not in ("html", "body", "main", "article"):
        suspect = max(suspect, 2)
    article = tag in ("article", "main") or role in ("main", "article")
    if not article and not suspect and tag in ("div", "section", "td"):
        article = any(w.lower() in ARTICLE_WORDS for name in names for w in WORD.findall(name))
    passed = parent.passed
    if not passed and tag not in ("html", "body", "main", "article"):
        passed = (
            tag in PASSED_TAGS
            or (tag == "header" and not parent.article)
            or role in PASSED_ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower()
        )
    linked = (tag == "a" and bool(HREF.search(attrs))) or parent.linked
    return Element(tag, ".".join([tag, *classes]), parent, passed, suspect, article or parent.article, linked)


Block = tuple[Element, str, float]


def _parsed(html: str | None) -> tuple[list[Element], list[Block]]:
    """All elements, and the text blocks outside passed ones in order: element, text, weight outside links."""
    root = Element("", "", None, False, 0, False, False)
    stack, elements, found = [root], [root], []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    plain = 0

    def flush() -> None:
        nonlocal plain
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = stack[-1]
                while holder.tag and holder.tag not in BLOCKS:
                    holder = holder.parent
                found.append((holder, text, min(float(plain), float(len(text)))))
            parts.clear()
        plain = 0

    def close(at: int) -> None:
        open_tags.subtract(e.tag for e in stack[at:])
        del stack[at:]

    html = html or ""
    open_ended: set[str] = set()  # raw elements that end nowhere further on

    def after_raw(tag: str, at: int) -> int:
        """The position after a raw element whose start tag ends at ``at``."""
        if tag not in open_ended:
            if m := RAW_END[tag].search(html, at):
                return m.end()
            open_ended.add(tag)
        if tag in RAW:
            return len(html)
        m = NEXT_BLOCK.search(html, at)
        return m.start() if m else len(html)

    at_char = 0
    while m := TOKEN.match(html, at_char):
        text, tag, at_char = m["text"], m["tag"], m.end()
        if text is not None:
            if not stack[-1].passed:
                text = unescape(text) if "&" in text else text
                parts.append(text)
                if not stack[-1].linked:
                    plain += len(text.strip())
        elif tag is not None:
            tag = tag.lower()
            if tag in RAW_END and not m["end"]:
                at_char = after_raw(tag, at_char)
            elif m["end"]:
                if tag in BLOCKS:
                    flush()
                if open_tags[tag]:
                    at = len(stack) - 1
                    while stack[at].tag != tag:
                        at -= 1
                    close(at)
            else:
                if tag in BLOCKS:
                    flush()
                elif tag in ("br", "wbr", "img", "input"):
                    parts.append(" " if tag != "wbr" else "")
                ended = CLOSES.get(tag) or ({"p", "head"} if tag in BLOCKS else ())
                if any(open_tags[t] for t in ended):
                    at = len(stack) - 1
                    while at > 0 and stack[at].tag not in ended and stack[at].tag not in SCOPE:
                        at -= 1
                    if at > 0 and stack[at].tag in ended:
                        close(at)
                if tag not in VOID:
                    element = _opened(tag, m["attrs"], stack[-1])
                    stack.append(element)
                    elements.append(element)
                    open_tags[tag] += 1
    flush()
    return elements, found


def _summed(elements: list[Element], found: list[Block]) -> None:
    """Weights and counts of each element with all in it: children come after their parents."""
    for element in elements:
        element.weight = element.apart = 0.0
        element.count, element.holds = 0, False
    for element, _, weight in found:
        element.weight += weight
        element.apart += 0.0 if element.article else weight
        element.count += 1
    for element in reversed(elements[1:]):
        above = element.parent
        above.weight += element.weight
        above.apart += element.apart
        above.count += element.count
        above.holds = above.holds or element.holds or (element.article and not element.suspect and bool(element.weight))


def blocks(html: str | None) -> tuple[list[Element], list[Block]]:
    """All elements, with the weights of what stays, and the page's text blocks without suspect elements."""
    elements, found = _parsed(html)
    _summed(elements, found)
    total = elements[0].weight
    for element in elements[1:]:
        drop = False
        if element.suspect:
            most = element.weight > MOST * total
            lone = element.weight >= LONG and total - element.weight <= REST * total
            drop = not (most and (element.suspect == 1 or lone or (element.suspect == 2 and element.holds)))
        element.dropped = element.parent.dropped or drop
    found = [block for block in found if not block[0].dropped]
    _summed(elements, found)
    return elements, found


def _around(elements: list[Element], chosen: list[Element]) -> Element:
    """The innermost element around all of ``chosen``."""
    at = chosen[0]
    for other in chosen[1:]:
        while at is not other:
            if at.depth >= other.depth:
                at = at.parent
            else:
                other = other.parent
    return at


def best_container(elements: list[Element], found: list[Block]) -> tuple[Element, float] | None:
    """The page's main container and the share of the weight it holds.

    That is its article, or the innermost element around its articles of size;
    where they hold too little, the innermost container of all weight outside
    articles. A page without weight has its root, so all its blocks.
    """
    root = elements[0]
    if not root.weight:
        return (root, 0.0) if found else None
    articles = [e for e in elements[1:] if e.article and not e.parent.article and not e.dropped and e.weight]
    if articles and sum(e.weight for e in articles) >= COVER * root.weight:
        largest = max(e.weight for e in articles)
        best = _around(elements, [e for e in articles if e.weight >= PART * largest])
    else:
        best = max((e for e in elements if e.apart == root.apart), key=lambda e: e.depth)
    while not (best.tag in CONTAINERS or "-" in best.tag or (best.tag in ("td", "th") and best.count > 1)):
        best = best.parent
    return best, best.weight / root.weight


def vote(html: str | None) -> tuple[str, float] | None:
    """Path and share of the page's main container; a page without weight or container has no vote."""
    best = best_container(*blocks(html))
    return (best[0].path(), best[1]) if best and best[1] and best[0].tag else None


def main_text(html: str | None, path: str | None = None) -> str:
    """The text blocks in the containers of ``path``, else in the page's best one."""
    elements, found = blocks(html)
    key = 0
    for name in (path or "").split(">"):
        key = path_key(name, key)

    def inside(chosen: Callable[[Element], bool]) -> list[str]:
        held: set[Element] = set()
        for element in elements:
            if element.parent in held or chosen(element):
                held.add(element)
        return [text for element, text, _ in found if element in held]

    best = best_container(elements, found)
    texts = inside(lambda e: e.key == key) if path else []
    if texts and best and best[0].weight >= LONG:
        # Of nested elements of the path each counts, so this is no less than what they hold.
        texts = texts if sum(e.weight for e in elements if e.key == key) >= PART * best[0].weight else []
    if not texts and best:
        texts = inside(lambda e: e is best[0])
    return "\n\n".join(texts)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(host, *v) for host, html in zip(batch["host"], batch["html"], strict=True) if (v := vote(html))]
        yield pd.DataFrame(rows, columns=["host", "path", "score"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(html, path) for html, path in zip(batch["html"], batch["path"], strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def host_of(url: str) -> F.Column:
    found = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: ``host, path``; most votes, then score, then the lesser path."""
    votes = pages.select(host_of("url").alias("host"), "html").mapInPandas(_votes, "host string, path string, score double")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.col("score"), F.col("path"))).alias("best")).select(
        "host", F.col("best.path").alias("path")
    )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): ``page_id, url, text, n_chars``.

    A null, empty or textless page gives an empty text. Pages without a host
    vote together. Repeated rows vote and return each; an empty table gives
    no rows.
    """
    winners = keep(host_paths(pages), "host-paths")
    read = pages.select("page_id", "url", "html").withColumn("host", host_of("url")).join(winners, "host", "left")
    return read.select("page_id", "url", "html", "path").mapInPandas(
        _texts, "page_id long, url string, text string, n_chars long"
    )
