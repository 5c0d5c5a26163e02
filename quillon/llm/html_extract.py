"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; the weights are smoothed log odds of lying
inside or outside the content, counted per class of word or tag on labelled pages: those of TRAINING (content marked by
hand) and, of the pages themselves, up to about SAMPLE (least by hash) with exactly one article element, whose words are
the content; each counts as it is and with the article made a plain box, so that pages without one are learnt as well.
One linear scan finds the contiguous region of the greatest score. Words of elements that are never article text (menus,
forms, adverts, comments ...) score nothing and are left out, inside the region too. Which elements these are besides those that their
tag says, is learnt: each part of class, id and role has log odds, counted on labelled names and on the elements around
and beside the articles of the pages, and an element with a word whose parts sum to less than LEAST is left out. An article or main element inside a
wrapper that is merely so marked counts as content again, unless it is marked itself or lies in an article. Such an element without an end tag ends before the next
paragraph, heading, section or article, so that it cannot swallow the page.

Text of the region: character references decoded per text node, white space in a block made one space, blocks trimmed
and joined by one newline in page order. Tags that do not parse are text; unclosed elements end with their parents.

Nulls and empty pages give "" and 0; pages without words give "". Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

# Element names of the HTML standard by their role here.
RAW = "script style template noscript iframe svg"
BOILER = "nav footer aside form button select textarea menu dialog head"
PARAGRAPH = "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption br hr address dd dt li ul ol dl figure table thead tbody tfoot tr td th caption"
BOX = "div section center fieldset details summary hgroup header"
OUTER = "article main body html"
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta meter nobr object q s samp small source span strike strong sub sup time tt u var wbr"
MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose merror msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml"
VOID = "area base br col embed hr img input link meta param source track wbr"
# Labelled values of class, id and role attributes: of elements that hold article text, and of elements that are none of it. They are training
# data like TRAINING: each part of a value is a feature with a weight, so names that are not listed are judged by their parts.
KEPT_NAMES = (
    "content has-sidebar; article-body; post-content; entry-content; story with-comments; page-with-menu; layout with-sidebar; post has-comments; body with-ads; "
    "no-share; no-sidebar; no-ads; no-comments; has-banner; widget-area-wrapper; main-column; text-block; rich-text; body-copy; page-wrapper; container; "
    "container-fluid; row; col; col-left; section; section-body; lead; intro; figure; caption; quote; table-wrap; code-block; article-header; post-title; headline; "
    "summary; byline; single-post; hentry; prose; math; example; page; inner; block; media; image-left; gallery-item; is-active; clearfix; paragraph; chapter; theorem; "
    "definition; list; list-items; box; text-box; item; wrap; area; posts-page; form-factor; links-text; buttons-guide; main; content-area; group; widget-body-text"
).split("; ")
REMOVED_NAMES = (
    "ad; ads; advert; advertisement; adverts; adsense; banner; breadcrumb; breadcrumbs; comment; comments; commentlist; respond; disqus; cookie; cookies; consent; gdpr; "
    "notice; notices; alert; disclaimer; sidebar; menu; navbar; navigation; nav; footer; masthead; popup; modal; overlay; promo; promotion; related; recommended; share; "
    "sharing; social; sponsor; sponsored; subscribe; newsletter; signup; login; widget; toolbar; pagination; pager"
).split("; ")
REMOVED_COMPOUNDS = (
    "comment-list; comments-section; comment-form; user-comments; reader-comments; comment-area; cookie-banner; cookie-notice; related-posts; related-articles; ad-slot; "
    "ad-container; ad-unit; top-ads; share-buttons; social-share; share-bar; share-links; alert-box; site-notice; site-footer; page-footer; nav-bar; side-menu; menu-item; "
    "breadcrumb-trail; newsletter-form; signup-box; login-form; popup-box; promo-box; sponsored-item; subscribe-box; pagination-list; sidebar-widget; widget-list"
).split("; ")
#: How many elements a value of one word in REMOVED_NAMES counts for; what all pages together count for at most, for a part; the score below which an
#: element is no article text.
SINGLE, PAGES, LEAST = 6, 3.0, -0.2
#: Parts of names that are learnt from pages.
MOST_PARTS = 20_000

_RAW, _BOILER, _PARA, _BOX, _OUTER, _INLINE, _VOID = (frozenset(x.split()) for x in (RAW, BOILER, PARAGRAPH, BOX, OUTER, INLINE, VOID))
_INLINE |= frozenset(MATH.split())
_BLOCK = _PARA | _BOX | _OUTER | _BOILER - {"br"}
_AFRESH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote section article main body".split())  # what an open element without end cannot hold
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>" + "|".join(RAW.split()) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>",
    re.S | re.I,
)
_ARTICLE = re.compile(r"<(/?)article\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[A-Z]?[a-z]{1,20}|[A-Z]{2,20}(?![a-z])|[^\W\d_]{2,20}")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_OPEN, _CLOSE = "\ue000", "\ue001"  # marks of the content in labelled pages: private-use characters


def names_of(attrs: str) -> list[set[str]] | None:
    """The parts, in small letters, of each word of an element's class, id and role; None if it is hidden."""
    found: list[set[str]] = []
    if attrs and _TELLING.search(attrs):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "style" and _NO_DISPLAY.search(value):
                return None
            if name in ("class", "id", "role"):
                found += [{x.lower() for x in _PART.findall(word)} for word in value[:1000].split()]
    return found


def part_weights(counts: dict[str, list[float]]) -> dict[str, float]:
    """Log odds for each part of lying in an element of article text: labelled names, and [kept, removed] elements of pages ("part:<name>"), which
    together count for PAGES elements at most, so that a site's own wrappers cannot outvote what names say everywhere."""
    seen: dict[str, list[float]] = {}
    for names, place, times in ((KEPT_NAMES, 0, 1), (REMOVED_NAMES, 1, SINGLE), (REMOVED_COMPOUNDS, 1, 1)):
        for name in names:
            for part in _PART.findall(name):
                seen.setdefault(part.lower(), [0.0, 0.0])[place] += times
    for kind, (kept, removed) in counts.items():
        if kind.startswith("part:"):
            share = min(1.0, PAGES / (kept + removed))
            t = seen.setdefault(kind[5:], [0.0, 0.0])
            t[0], t[1] = t[0] + kept * share, t[1] + removed * share
    return {part: math.log((kept + 0.5) / (removed + 0.5)) for part, (kept, removed) in seen.items()}


@lru_cache(maxsize=1)
def default_parts() -> dict[str, float]:
    return part_weights({})


def _marked(attrs: str, parts: dict[str, float]) -> int:
    """2 if the attributes hide the element, 1 if the parts of a word of its class, id or role say that it is no article text, else 0."""
    found = names_of(attrs)
    return 2 if found is None else int(any(sum(parts.get(x, 0.0) for x in word) < LEAST for word in found))


def _left_out(name: str, attrs: str, above: int, inside: bool, stack: list, parts: dict[str, float]) -> int:
    """Whether an element is not article text: 0 no, 1 merely by words of attributes outside any article, 2 for good."""
    if above == 2 or name in _BOILER or name == "header" and not inside:
        return 2
    if name in _OUTER:
        return 0 if above and name in ("article", "main") and not _marked(attrs, parts) else above
    mark = _marked(attrs, parts)
    return max(above, 2 if mark and any(x[0] == "article" for x in stack) else mark)


def _unclosed(tokens: list[re.Match]) -> set[int]:
    """The starts of elements that no end tag of their name closes."""
    open_: dict[str, list[int]] = {}
    for m in tokens:
        if name := (m["tag"] or m["tag2"] or "").lower():
            if not (m["end"] or m["end2"]):
                open_.setdefault(name, []).append(m.start())
            elif open_.get(name):
                open_[name].pop()
    return {at for found in open_.values() for at in found}


def events(page: str, parts: dict[str, float] | None = None) -> list[tuple[str, str | None, bool]]:
    """The page as (class, text, is block edge): class "word:..." with the raw text, or "tag:..." without one. parts: weights of parts of names."""
    parts = default_parts() if parts is None else parts
    out: list[tuple[str, str | None, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, not article text (_left_out), inside an article
    tokens = list(_TOKEN.finditer(page))
    unclosed, loose = _unclosed(tokens), 0  # loose: elements on the stack that are not article text and have no end
    at = 0

    def text(until: int) -> None:
        if until > at:
            _, bad, inside = stack[-1] if stack else ("", 0, False)
            out.append(("word:none" if bad else "word:article" if inside else "word:plain", page[at:until], False))

    for m in tokens:
        text(m.start())
        at = m.end()
        name = (m["tag"] or m["tag2"] or "").lower()
        if not name:
            out.append(("tag:raw", None, False))
            continue
        closing = bool(m["end"] or m["end2"])
        if loose and not closing and name in _AFRESH:
            k = next((k for k, x in enumerate(stack) if x[0].startswith("!")), len(stack))
            del stack[k:]
            loose = 0
        bad, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        role = "para" if name in _PARA else "inline" if name in _INLINE else "box" if name in _BOX else "outer" if name in _OUTER else "other"
        where = ("inner" if inside else "none") if bad else "article" if inside else "plain"
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in _OUTER and name not in _OUTER:
                    break
        elif name not in _VOID:
            above = bad
            if name in _PARA or name in _BOX or name in _OUTER or name in _BOILER:
                if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
                    above = stack[-1][1] if stack else 0
            own = _left_out(name, m["attrs"] or "", above, inside, stack, parts)
            if name not in _INLINE or own and not bad:
                ends = m.start() not in unclosed or not own or bad
                loose += not ends
                stack.append((name if ends else "!" + name, own, inside or name in ("article", "main")))
            if own and not bad:
                role = "boiler"
        out.append((f"tag:{role}:{where}", None, name in _BLOCK))
    text(len(page))
    return out


#: Labelled pages the default weights are counted on; the article lies between the two marks.
TRAINING = tuple(
    x.replace("[[", _OPEN).replace("]]", _CLOSE)
    for x in (
        "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>[[A title of words</h1><p>Some words of the first paragraph are here.</p><p>More <b>bold</b> words follow and they are many in this text.</p><p>End.]]</p></article><footer>Words of the foot</footer></body></html>",
        "<html><body><header><h1>Site name</h1></header><div class=ad>Buy this now</div><main><h1>[[Head line</h1><p>One two three four five six seven.<br>Eight nine.</p><ul><li>first item here</li><li>second item here</li></ul><p>Last.]]</p></main><aside>See also this and that</aside><div id=comments><p>I like it very much</p></div></body></html>",
        "<body><div>Menu words</div><div><div>Sub menu</div></div><div><h1>[[Title only</h1><p>A plain page without article elements has its words in paragraphs of some length.</p><p>They come one after another, and links are few among them.</p><p>So it ends.]]</p></div><div>Imprint</div><div>Contact</div></body>",
        "<body><article><header><h1>[[Head</h1></header><p>Words of it.</p><aside class=sidebar><h2>See</h2><ul><li><a href=z>that</a></li></ul></aside><p>More words.</p><div class=ad><p>Buy</p><div><span>now</span></div></div><section><p>And more.</p></section><p class=notice>Mind this<p>Yet more.</p><form><input><label>Mail</label><button>Go</button></form><script>x</script><!-- c --><p>The last.]]</p></article><div>x</div></body>",
        "<body><article><h1>[[Short]]</h1></article><form><label>Name</label><input></form><footer>c</footer></body>",
    )
)


def marked_counts(pages) -> dict[str, list[float]]:
    """Words and tags [inside, outside] the content per class, of pages with marked content."""
    counts: dict[str, list[float]] = {}
    for page in pages:
        now = False
        for kind, text, _ in events(page):
            for k, part in enumerate(re.split(f"[{_OPEN}{_CLOSE}]", text)) if text is not None else ((0, None),):
                if k:
                    now = not now
                counts.setdefault(kind, [0, 0])[not now] += len(part.split()) if part is not None else 1
    return counts


def _parts_beside(page: str):
    """(part, 0 or 1) of the names of elements around the page's one article, and of those beside it: elements inside it tell nothing."""
    begin, end = (m.start() for m in _ARTICLE.finditer(page))
    around: list[tuple[str, set[str]]] = []
    for m in _TOKEN.finditer(page):
        name = (m["tag"] or "").lower()
        if m.start() == begin:
            for _, found in around:
                yield from ((p, 0) for p in found)
        elif not name or begin < m.start() < end or name in _VOID or name in _INLINE:
            continue
        elif m["end"]:
            for k in range(len(around) - 1, -1, -1):
                if around[k][0] == name:
                    if m.start() < begin:  # closed before the article begins: beside it
                        yield from ((p, 1) for _, found in around[k:] for p in found)
                    del around[k:]
                    break
        elif (names := names_of(m["attrs"] or "")) is not None:
            found = set().union(*names)
            if m.start() > end:
                yield from ((p, 1) for p in found)
            else:
                around.append((name, found))


def article_counts(page: str | None) -> dict[str, list[float]]:
    """The same of a page with exactly one article, its words being the content; else none."""
    counts: dict[str, list[float]] = {}
    if not page or len(_ARTICLE.findall(page)) != 2:
        return counts
    seen = events(page)
    words = [i for i, (kind, text, _) in enumerate(seen) if kind == "word:article" and text.strip()]
    if words:
        for part, where in _parts_beside(page):
            counts.setdefault(f"part:{part}", [0, 0])[where] += 1
        for form in (seen, events(_ARTICLE.sub(r"<\1div>", page))):
            for i, (kind, text, _) in enumerate(form):  # the two have the same tokens
                counts.setdefault(kind, [0, 0])[not words[0] <= i <= words[-1]] += 1 if text is None else len(text.split())
    return counts


class Weights(dict):
    """Weights per class of word or tag, and those of the parts of names under "part:<name>"."""

    @property
    def parts(self) -> dict[str, float]:
        if "_parts" not in self.__dict__:
            self.__dict__["_parts"] = {k[5:]: w for k, w in self.items() if k.startswith("part:")}
        return self.__dict__["_parts"]


def weigh(counts: dict[str, list[float]]) -> Weights:
    """Weights per class: words at least 0.2, tags at most -0.01, words that are never article text 0; parts of names as `part_weights`."""
    weights = {f"part:{p}": w for p, w in part_weights(counts).items()}
    for kind, (inside, outside) in counts.items():
        if kind.startswith("part:"):
            continue
        odds = math.log((inside + 0.5) / (outside + 0.5))
        weights[kind] = 0.0 if kind == "word:none" else max(0.2, odds) if kind.startswith("word") else min(-0.01, odds)
    return Weights(weights)


def train(pages) -> Weights:
    """Weights from pages with marked content."""
    return weigh(marked_counts(pages))


def learned(pages: DataFrame, sample: int = 20_000) -> Weights:
    """Weights from TRAINING and pages(html): one aggregation of a few dozen classes and the parts of names, over about `sample` pages at most;
    of the parts the MOST_PARTS that most pages have."""
    every = -(-pages.count() // sample)

    def run(batches):
        for batch in batches:
            total: dict[str, list[float]] = {}
            for page in batch.html:
                for kind, (x, y) in article_counts(page).items():
                    t = total.setdefault(kind, [0, 0])
                    t[0] += x
                    t[1] += y
            yield pd.DataFrame([(k, x, y) for k, (x, y) in total.items()], columns=["kind", "inside", "outside"])

    picked = pages.where(F.pmod(F.xxhash64("html"), F.lit(every)) == 0) if every > 1 else pages
    found = picked.select("html").mapInPandas(run, "kind string, inside double, outside double").groupBy("kind").agg(F.sum("inside"), F.sum("outside"))
    counts = marked_counts(TRAINING)
    found = found.toDF("kind", "inside", "outside")
    parts = F.col("kind").startswith("part:")
    common = found.where(parts).orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(MOST_PARTS)
    for kind, x, y in found.where(~parts).unionByName(common).collect():
        t = counts.setdefault(kind, [0, 0])
        t[0] += x
        t[1] += y
    return weigh(counts)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return train(TRAINING)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous run of the greatest positive sum; of equal ones the first, shortest. (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    seen = events(page or "", weights.parts)
    get = weights.get
    scores = [get(kind, -0.01 if kind.endswith((":inner", ":article", ":raw")) else -1.0) if text is None else get(kind, 0.2) * len(text.split()) for kind, text, _ in seen]
    a, b = best_region(scores)
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if words := "".join(now).split():
            blocks.append(" ".join(words))
        now.clear()

    for kind, text, edge in seen[a:b]:
        if edge:
            close()
        elif text is None:
            if kind.startswith("tag:para"):  # a line break
                now.append(" ")
        elif kind != "word:none":
            now.append(entities.unescape(text))
    close()
    return "\n".join(blocks)


def html_extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars. labelled: pages with content marked as in TRAINING; else as `learned`."""
    bounded_batches(pages.sparkSession)
    weights = train(labelled) if labelled else learned(pages)

    @F.pandas_udf("string")
    def run(pages_: pd.Series) -> pd.Series:
        return pd.Series([extract(x, weights) for x in pages_], dtype=object)

    out = pages.select("page_id", "url", run("html").alias("text"))
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
