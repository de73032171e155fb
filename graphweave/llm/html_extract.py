"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens in page order: words and tags.  Tags score
negative.  A word scores its gain, less what the elements around it weigh against
it: every element has features (its tag, the parts of its class and id, its role),
every feature a weight, and the worst element around a word counts.  One linear scan
finds the contiguous run of the largest total, the content region; its text is that
of the words in it that score positive.

Weights come from labelled pages, here those whose markup names their article.  A
tag's penalty is the log ratio of its rates outside and inside articles, a word's
gain is the log ratio of word rates, and a feature's weight is the log ratio of the
words inside and outside articles in elements that stand where both meet (their
parents hold words of both kinds).  Few or no labelled words leave a feature near
its usual weight: below 0 for menus, forms, adverts, notices or comments, above 0
for articles, 0 for all that isn't listed.  Labels outweigh that.  Wrappers don't count
against what they hold (``freed``): the document and its body, what surrounds the main
article, and compound names around most of a page.

Where an element above 0 (``POSITIVE``) holds words, words outside of such elements
score negative, at a cost that no gap between articles can add up to a word's gain, so
that all articles of a page are kept, and these names decide more than the scan does.
Elsewhere what surrounds a block decides whether the region reaches it.

Character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined by one space.

Null or empty html: empty text.  Broken markup: a tag without an end is dropped,
an open comment or script runs to the end, unclosed elements end with their
parents; time and memory grow with the page, so very long pages are taken whole.
A page that is boilerplate only: empty text.  Ties: the first region.  Repeated rows
stay; null ids and urls stay; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video"}
#: Uses of a tag that the usual penalty counts for.
PRIOR = 50
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KNOWN = INLINE | {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "hr", "figure", "figcaption", "dl", "dt", "dd", "body", "head", "html", "script", "style", "meta", "link", "title"}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[\s_-]+")
#: Usual weights of tags and roles, and of parts of classes and ids; WEAK ones count for less beside other parts.
USUAL = dict.fromkeys(["nav", "footer", "aside", "form", "button", "select", "fieldset", "menu", "dialog", "input", "datalist", "head", "=hidden"], -3.0)
USUAL |= dict.fromkeys(["=navigation", "=banner", "=contentinfo", "=complementary", "=search", "=form", "=alert", "=dialog", "=menu", "=menubar", "=toolbar", "=alertdialog"], -3.0)
USUAL |= {"article": 2.0, "main": 2.0, "=main": 2.0, "=articlebody": 2.0, "header": -2.5, ".header": -2.5}
USUAL |= dict.fromkeys(
    [".ad", ".ads", ".adv", ".advert", ".adverts", ".advertisement", ".advertising", ".adsense", ".banner", ".banners", ".sponsor", ".sponsored", ".sponsors", ".promo", ".promos", ".promotion", ".promotions", ".cookie", ".cookies", ".consent", ".gdpr", ".popup", ".popups", ".modal", ".newsletter", ".subscribe", ".subscription", ".signup", ".login", ".paywall", ".sidebar", ".menu", ".menus", ".nav", ".navbar", ".navigation", ".breadcrumb", ".breadcrumbs", ".topbar", ".toolbar", ".pagination", ".pager", ".footer", ".masthead", ".comment", ".comments", ".commentlist", ".disqus", ".replies", ".widget", ".widgets", ".copyright", ".disclaimer", ".skiplink"],
    -2.5,
)
WEAK = dict.fromkeys([".notice", ".notices", ".alert", ".alerts", ".overlay", ".respond", ".reaction", ".reactions", ".share", ".sharing", ".social", ".related", ".recommend", ".recommended", ".recommendations", ".trending", ".search", ".side"], -2.5)
PART = 0.3  # of a weak weight beside other parts
POSITIVE = 1.0
BETWEEN = 1e-9  # cost of words and tags between articles: less than any article's gain
#: Labelled words that the usual weight of a feature counts for; features that are learned at most, those of the most words.
FEATURE_PRIOR, FEATURES = 50, 20_000
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"""(?>[^"'>]*)(?>(?:"[^"]*"|'[^']*')[^"'>]*)*>""")
ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)


def tokens(page: str):
    """('t', text), ('o', tag, attributes) or ('c', tag) in page order; bodies of raw elements and comments are left out."""
    at, n, low, no_end = 0, len(page), None, False
    while at < n:
        k = page.find("<", at)
        if k < 0:
            yield "t", page[at:], ""
            return
        if k > at:
            yield "t", page[at:k], ""
        after = page[k + 1 : k + 2]
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", k)
            at = n if end < 0 else end + 1
        elif m := NAME.match(page, k + 1):
            if no_end:
                return
            e = TAG_END.match(page, m.end())
            end = e.end() - 1 if e else page.find(">", m.end())
            if end < 0:
                no_end = True
                return
            at, tag = end + 1, m[1].lower()
            if page[k + 1] == "/":
                yield "c", tag, ""
            else:
                rest = page[m.end() : end]
                yield "o", tag, rest
                if tag in RAW and not rest.endswith("/"):
                    low = page.lower() if low is None else low
                    if len(low) != n:  # a few capitals change length in lower case
                        low = page.translate({c: c + 32 for c in range(65, 91)})
                    close = low.find(f"</{tag}", at)
                    at = n if close < 0 else close
        else:
            yield "t", "<", ""
            at = k + 1


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(rest)} if rest else {}


def features(tag: str, rest: str) -> list[str]:
    """Tag, parts of class and id ('.part'; all of them as one name too), and role, item property or hiding ('=value')."""
    if not rest or rest.isspace():
        return [tag]
    own = attributes(rest)
    out = [tag]
    for key in ("class", "id"):
        if key in own:
            for name in CAMEL.sub("-", own[key]).split():
                found = [x for x in PARTS.split(name.lower()) if x]
                out += [f".{x}" if len(found) == 1 else f".{x}+" for x in found]
    for key in ("role", "itemprop"):
        if own.get(key):
            out.append(f"={own[key].lower()}")
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        out.append("=hidden")
    return out


def usual(feature: str) -> float:
    """The weight of a feature that no label tells of; '+' marks one of several parts."""
    name = feature.rstrip("+")
    return USUAL.get(name, 0.0) or WEAK.get(name, 0.0) * (PART if feature.endswith("+") else 1.0)


def flow(page: str, enter):
    """Events (kind, value, state): runs of text ('w'), block ends ('b'), tags ('t').

    ``enter(state, tag, attributes)`` gives the state inside an element from that outside;
    each open element keeps its own, so ends cost no search.
    """
    state = enter(None, "", "")
    stack: list[tuple[str, int, object]] = []  # tag, place of the innermost block, state outside
    number: dict[str, int] = {}  # open elements by tag

    def leave(k: int):
        nonlocal state
        while len(stack) > k:
            tag, _, state = stack.pop()
            number[tag] -= 1

    for kind, value, rest in tokens(page):
        if kind == "t":
            yield "w", value, state
            continue
        if value not in INLINE:
            yield "b", "", state
        if kind == "o":
            if value in CLOSES or (value not in INLINE and value not in VOID):
                k = stack[-1][1] if stack else -1
                if k >= 0 and stack[k][0] in CLOSES.get(value, {"p"}):
                    leave(k)
            yield "t", value, state
            if value in VOID:
                continue
            outside, state = state, enter(state, value, rest)
            stack.append((value, len(stack) if value not in INLINE else stack[-1][1] if stack else -1, outside))
            number[value] = number.get(value, 0) + 1
        else:
            if number.get(value):
                k = len(stack) - 1
                while stack[k][0] != value:
                    k -= 1
                leave(k)
            yield "t", value, state
    yield "b", "", state


class Element:
    """Words of a labelled page in an element, inside and outside articles."""

    __slots__ = ("features", "inside", "article", "parent", "words")

    def __init__(self, parent: Element | None, tag: str, rest: str):
        self.features, self.parent = features(tag, rest), parent
        self.article = tag in ("article", "main") or "=main" in self.features or "=articlebody" in self.features
        self.inside = self.article or parent is not None and parent.inside
        self.words = [0, 0]


def tally(page: str) -> dict[tuple[str, bool], int]:
    """Words (''), tags ('<tag') and words by feature, inside and outside the article of a labelled page; empty if it names none.

    A feature counts in elements of words of one kind whose parent has both; the tag counts where nothing else is known of the element.
    """
    found: dict[tuple[str, bool], int] = {}
    elements: list[Element] = []

    def enter(outside, tag, rest):
        elements.append(Element(outside, tag, rest))
        return elements[-1]

    for kind, value, state in flow(page, enter):
        if kind == "w":
            n = len(value.split())
            state.words[state.inside] += n
            found["", state.inside] = found.get(("", state.inside), 0) + n
        elif kind == "t":
            key = (f"<{value if value in KNOWN else 'other'}", state.inside)
            found[key] = found.get(key, 0) + 1
    if not found.get(("", True)):
        return {}
    for e in reversed(elements):  # children come after their parents
        if e.parent is not None:
            e.parent.words = [x + y for x, y in zip(e.parent.words, e.words, strict=True)]
    for e in elements:
        if e.parent is not None and all(e.parent.words) and sum(map(bool, e.words)) == 1:
            inside = e.words[1] > 0
            for f in e.features[1:] or e.features:
                found[f, inside] = found.get((f, inside), 0) + e.words[inside]
    return found


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """'': a word's gain; '<tag': its penalty, both positive; others: the weights of features."""
    tags = {k: n for k, n in counts.items() if k[0] == "" or k[0][0] == "<"}
    total = {i: sum(n for (_, j), n in tags.items() if i == j) + 1 for i in (True, False)}
    rate = lambda t, i: (tags.get((t, i), 0) + 0.5) / total[i]
    out = {"": min(3.0, max(0.25, math.log(rate("", True) / rate("", False))))} if tags else {"": 1.0}
    for t in sorted(KNOWN | {"other"}):
        often = 0.3 if t in INLINE or t in ("p", "br", "h1", "h2", "h3", "h4", "blockquote") else 2.0
        n = sum(tags.get((f"<{t}", i), 0) for i in (True, False))
        measured = min(6.0, max(0.05, 1.0 + math.log(rate(f"<{t}", False) / rate(f"<{t}", True)))) if n else often
        out[f"<{t}"] = (n * measured + PRIOR * often) / (n + PRIOR)  # few labelled uses: near the usual penalty
    for f in sorted({f for f, _ in counts if f and f[0] != "<"}):
        odds = math.exp(usual(f))
        inside, outside = (counts.get((f, i), 0) + FEATURE_PRIOR * x / (1 + odds) for i, x in ((True, odds), (False, 1.0)))
        out[f] = max(-4.0, min(4.0, math.log(inside / outside)))
    return out


def freed(parent: list[int], tags: list[str], found: list[list[str]], words: list[int], own: list[float]) -> set[int]:
    """Elements whose weight doesn't count against what they hold.

    The document and its body; what surrounds the largest positive element, if that has a third of the
    page's words; and elements with half of the words that only parts of compound names weigh against,
    such as ``has-sidebar`` or ``comments-open``.
    """
    out = {k for k, t in enumerate(tags) if t in ("html", "body")}
    whole = words[0]
    best = max((k for k, x in enumerate(own) if x >= POSITIVE and 3 * words[k] >= whole), key=lambda k: words[k], default=0)
    while best:
        best = parent[best]
        out.add(best)
    for k, x in enumerate(own):
        if x < 0 and 2 * words[k] >= whole and all(f.endswith("+") or usual(f) >= 0 for f in found[k]):
            out.add(k)
    return out


def scored(page: str, weight: dict[str, float]) -> tuple[list[tuple[str, str, bool]], list[float]]:
    """Events (kind, value, whether its words are text) and their scores."""
    gain = weight[""]
    parent: list[int] = []
    tags: list[str] = []
    found: list[list[str]] = []

    def enter(outside, tag, rest):
        parent.append(0 if outside is None else outside)
        tags.append(tag)
        found.append(features(tag, rest) if tag else [])
        return len(parent) - 1

    events = list(flow(page, enter))
    words = [0] * len(parent)
    for kind, value, k in events:
        if kind == "w":
            words[k] += len(value.split())
    for k in range(len(parent) - 1, 0, -1):  # children come after their parents
        words[parent[k]] += words[k]
    known = lambda f: weight[f] if f in weight else usual(f)
    free = freed(parent, tags, found, words, [sum(map(known, x)) for x in found])
    states = [(0.0, False, False)]  # worst weight around, text of a positive element, anywhere in one
    for k in range(1, len(parent)):
        worst, positive, within = states[parent[k]]
        # an article's own header is part of it
        own = sum(known(f) for f in found[k] if f not in ("header", ".header", ".header+") or not positive)
        if own < 0 and k in free:
            own = 0.0
        positive = worst > -gain and own > -gain and (positive or own >= POSITIVE)
        states.append((min(worst, own), positive, within or positive))
    named = any(k == "w" and states[s][1] and v.strip() for k, v, s in events)
    out, scores = [], []
    for kind, value, k in events:
        worst, positive, within = states[k]
        text = worst > -gain and (positive or not named)
        if kind == "w":
            n = len(value.split())
            scores.append(n * (gain if named else gain + worst) if text else -n * min(gain, 0.1 - gain - worst) if not named else 0.0 if within else -n * BETWEEN)
        elif kind == "t":
            scores.append(-weight.get(f"<{value}", weight["<other"]) * (1.0 if not named else 0.0 if within else BETWEEN))
        else:
            scores.append(0.0)
        out.append((kind, value, text))
    return out, scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run of the largest total; (0, 0) if none is positive.  Ties: the first that ends."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract_text(page: str | None, weight: dict[str, float]) -> str:
    if not page:
        return ""
    events, scores = scored(page, weight)
    first, end = best_region(scores)
    blocks, run = [], []
    for kind, value, text in [*events[first:end], ("b", "", False)]:
        if kind == "b":
            if words := entities.unescape("".join(run)).split():
                blocks.append(" ".join(words))
            run = []
        elif kind == "w" and text:
            run.append(value)
    return " ".join(blocks)


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights from all pages that name their article; counts of tags and of the ``FEATURES`` commonest features reach the driver."""

    def run(batches):
        total: dict[tuple[str, bool], int] = {}

        def flush():
            out = pa.RecordBatch.from_pydict({"tag": [k[0] for k in total], "inside": [k[1] for k in total], "n": list(total.values())})
            total.clear()
            return out

        for b in batches:
            for page in b.column("html").to_pylist():
                for k, n in tally(page or "").items():
                    total[k] = total.get(k, 0) + n
                if len(total) > 1 << 16:
                    yield flush()
        if total:
            yield flush()

    rows = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "tag string, inside boolean, n long")
    sums = rows.groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("outside"))
    size = F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0))
    mark = (F.col("tag") == "") | F.col("tag").startswith("<")
    found = sums.orderBy(F.desc(mark), F.desc(size), "tag").limit(FEATURES).collect()
    return weights({(r["tag"], i): n for r in found for i, n in ((True, r["inside"]), (False, r["outside"])) if n is not None})


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars)"""
    prepare(pages.sparkSession)
    weight = weight or learn(pages)

    def run(batches):
        for b in batches:
            text = [extract_text(x, weight) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
