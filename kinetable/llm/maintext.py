"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags and double line breaks.  The first pass decides blocks by where they stand
(menus, footers, sidebars, forms, adverts and the like by tag, class, id or role), by link density, and by length
and stop-word density; short blocks and those of middling density stay open.  In the second pass an open block inherits the
label of its nearest decided neighbours: both good, good; both bad, bad; if they differ, a block with a fair share
of stop words is good and any other is bad.  Inside an article or main element a block has only its neighbours there,
and the element itself speaks for it where none is decided.

Edge cases: a null or empty page has the empty text; cut-off pages and unclosed or stray tags are read as far as
they go (a tag that never ends is markup; controls, media and drawings end with their parent); repeated pages give equal rows; nothing is cut from long texts; extra
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, slices, table

#: Function words of four languages.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so that the their them there they this to was we were what when which who will with you".split(),
    "de": "als am an auch auf aus bei bis das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war was wenn wie wird zu zum zur über".split(),
    "es": "a al como con de del el ella en entre es esta este ha hay la las le lo los me más no o para pero por que se si sin sobre son su sus también un una y ya".split(),
    "fr": "a au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été".split(),
}
EVERY = frozenset().union(*STOP_WORDS.values())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text: raw text, which runs to its end tag or to the page's end, and elements, which end with their parent.
RAW = "script style noscript template textarea title iframe".split()
HIDDEN = frozenset("select button object canvas svg math audio video map".split())
#: What a block's start tag ends (a paragraph, if not told otherwise), with a hidden element in it that has no end tag of its own.
ENDED = {
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "body": {"head"},
    **{t: {"td", "th", "caption"} for t in ("td", "th")}, "tr": {"td", "th", "tr", "caption"}, **{t: {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"} for t in ("thead", "tbody", "tfoot")},
}
SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in HIDDEN}
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
#: Words that name parts of a page which are no article.
HINTS = (
    r"ads?|advert\w*|banner|breadcrumbs?|captcha|carousel|comments?|consent|cookies?|copyright|disclaimer|disqus|footer|legal|login|menu|modal|nav|navbar|navigation|newsletter|notices?|alert"
    r"|pager|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget"
)
HEAD_HINTS = r"header|masthead|topbar"
COMMENT_HINTS = r"comments?|disqus|replies|respond"


def _names(hints: str) -> re.Pattern:
    """A class or id, or part of one between double marks, that begins or ends with one of the words."""
    return re.compile(rf"(?<![^\s])(?:{hints})(?![a-z])|(?<![a-z])(?<!has-)(?<!no-)(?<!with-)(?:{hints})(?=[-_]?\d*(?:\s|$))", re.I)


HINT, HEAD_HINT, COMMENTS = _names(HINTS), _names(HEAD_HINTS), _names(COMMENT_HINTS)
#: Names of topics and of settings say nothing about the part that carries them.
TOPICS = re.compile(r"(?<![^\s])(?:(?:category|categories|cat|tag|topic|term|tax|series|format|keyword)[-_]\S*|\S*[-_](?:open|closed|enabled|disabled|on|off))(?=\s|$)", re.I)
#: Words for the build of a page behind which the name proper ends.
BUILD = re.compile(
    r"(?:[-_](?:inner|outer|wrap|wrapper|container|content|contents|list|items?|links?|box|block|area|section|column|col|row|group|title|text|body|buttons?|bar|panel|desktop|mobile|top|bottom|left|right|main|primary|secondary))+"
    r"(?=[-_]?\d*(?:\s|$))", re.I,
)
#: One reader's comment, where an article element holds it.
COMMENT = re.compile(r"(?<![^\s])(?:comment|reply)(?:[-_](?:body|item|content|entry|\d+))?(?=\s|$)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|lang|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<drop>{'|'.join(RAW)})(?=[\s/>])(?:[^>]*/>|[^>]*(?:>|\Z).*?(?:</(?P=drop)(?![^\s/>])[^>]*(?:>|\Z)|\Z))"
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/><]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>"""
    rf"|<(?P<odd>{'|'.join(sorted(HIDDEN))})(?=[\s/>])[^>]*>"  # with unpaired quotes
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
LINK_DENSITY, SHORT, LONG, LOW, HIGH = 0.35, 70, 200, 0.2, 0.3


@dataclass
class Block:
    text: str
    linked: int
    region: int  # 1 in an article, -1 in a part that is none, 0 elsewhere
    heading: bool
    doubt: int = 0  # number of the part that only a name or a form speaks against
    label: str = ""


class Region:
    def __init__(self, tag: str, kind: int, comments: bool, hidden: bool, unclosed: bool = False, doubt: int = 0) -> None:
        self.tag, self.kind, self.comments, self.hidden, self.unclosed, self.doubt = tag, kind, comments, hidden, unclosed, doubt


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)} if text else {}


def _region(tag: str, own: dict[str, str], outer: Region, number: int) -> Region:
    """Elements and roles decide at once; a name or a form only raises a doubt, which the text may overrule."""
    if tag in ("html", "body"):
        return Region(tag, 0, False, outer.hidden)
    role = own.get("role", "").lower()
    names = f"{own.get('class', '')} {own.get('id', '')}"
    article = tag in ("article", "main") or role in ("main", "article")
    if names.strip():
        names = BUILD.sub("", TOPICS.sub("", names.replace("__", " ").replace("--", " ")))
    comments = outer.comments or bool((COMMENT if tag == "article" else COMMENTS).search(names)) and (tag == "article" or not article)
    bad = tag in BAD_TAGS or role in ROLES or outer.kind <= 0 and tag == "header"
    doubt = 0
    if comments or bad:
        kind = -1
    elif article:
        kind = 1
    elif tag == "form" or HINT.search(names) or outer.kind <= 0 and HEAD_HINT.search(names):
        kind, doubt = -1, number
    else:
        kind, doubt = outer.kind, outer.doubt
    if "hidden" in own:
        kind, comments, doubt = outer.kind, outer.comments, outer.doubt
    return Region(tag, kind, comments, "hidden" in own, doubt=doubt)


def _close(stack: list[Region], tag: str) -> None:
    """End the innermost element of this name and what is in it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            break


def _stays_hidden(stack: list[Region], tag: str, close: bool) -> bool:
    """Whether a tag inside a hidden region leaves the text before it going on; hidden elements that a start tag ends are taken off."""
    if close:  # of something hidden, or of nothing that is open
        return next((x.hidden for x in reversed(stack) if x.tag == tag), True)
    if tag in BLOCKS:
        k = len(stack) - 1
        while stack[k].unclosed:
            k -= 1
        if stack[k].tag in ENDED.get(tag, {"p"}):
            del stack[k + 1 :]
    return stack[-1].hidden


def blocks(page: str) -> tuple[list[Block], str]:
    """The page's blocks in order, and the language it names."""
    out: list[Block] = []
    stack = [Region("", 0, False, False)]
    parts: list[str] = []
    linked, in_link, breaks, heading, lang = 0, 0, 0, False, ""

    def finish() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, min(linked, len(text)), stack[-1].kind, heading, stack[-1].doubt))
        parts.clear()
        linked, heading = 0, False

    def put(piece: str) -> None:
        nonlocal linked, breaks
        if stack[-1].hidden:
            return
        piece = unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if piece.strip():
            breaks = 0
            linked += len(" ".join(piece.split())) if in_link else 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["odd"] or "").lower()
        if not tag:
            if m["drop"]:
                parts.append(" ")
            continue
        if tag in HIDDEN and not m["close"] and not (m["attrs"] or "").endswith("/"):
            if stack[-1].tag == tag and tag in ("select", "button"):  # these end where the next begins
                stack.pop()
            parts.append(" ")
            end = SAME[tag].search(page, at)
            stack.append(Region(tag, stack[-1].kind, stack[-1].comments, True, not (end and end[1]), stack[-1].doubt))
            continue
        if stack[-1].hidden and _stays_hidden(stack, tag, bool(m["close"])):
            if m["close"]:
                _close(stack, tag)
            elif tag in BLOCKS and tag not in VOID and not m["attrs"].endswith("/"):
                stack.append(Region(tag, stack[-1].kind, stack[-1].comments, True, doubt=stack[-1].doubt))
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                finish()
            else:
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m["close"] else 1
        if tag in BLOCKS:
            finish()
            in_link = in_link if tag != "p" else 0
        if m["close"]:
            _close(stack, tag)
        elif tag not in VOID and (tag in BLOCKS or m["attrs"]) and not m["attrs"].endswith("/"):
            own = _attributes(m["attrs"])
            lang = lang or (own.get("lang", "") if tag == "html" else "")
            if tag in ("p", "li") and stack[-1].tag == tag:  # these end where the next begins
                stack.pop()
            if tag in BLOCKS or "class" in own or "id" in own or "role" in own or "hidden" in own:
                stack.append(_region(tag, own, stack[-1], m.start() + 1))
        if tag in BLOCKS and not m["close"]:
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    if at < len(page):
        put(page[at:])
    finish()
    return out, lang[:2].lower()


def _density(text: str, stop: frozenset[str] | set[str]) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in stop for w in words) / len(words)


def _overrule(found: list[Block], stop: frozenset[str] | set[str]) -> None:
    """A doubted part that holds most of the page's prose (long blocks dense in stop words, hardly linked) is judged by its text."""
    if not any(b.doubt for b in found) or any(b.region > 0 for b in found):  # a page that names its article means it
        return
    prose: dict[int, int] = {}
    for b in found:
        if (b.region >= 0 or b.doubt) and len(b.text) > LONG and b.linked <= LINK_DENSITY * len(b.text) and _density(b.text, stop) >= HIGH:
            prose[b.doubt] = prose.get(b.doubt, 0) + len(b.text)
    most = next((d for d, n in prose.items() if d and 2 * n > sum(prose.values())), None)
    for b in found:
        if most is not None and b.doubt == most:
            b.region = 0


def _first_pass(b: Block, stop: frozenset[str] | set[str]) -> str:
    if b.region < 0:
        return "bad"
    if b.linked > LINK_DENSITY * len(b.text):
        return "bad"
    if b.region > 0 and (b.heading or len(b.text) < SHORT):
        return "short"
    if "©" in b.text and len(b.text) < LONG:
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return "short"
    density = _density(b.text, stop)
    if density >= HIGH:
        return "good" if len(b.text) > LONG else "fair"
    if density >= LOW or b.region > 0:
        return "fair"
    return "bad"


def _neighbours(found: list[Block]) -> list[tuple[str, bool]]:
    """Label of the nearest decided block before each one, and whether a fair block stands nearer.

    For blocks of an article only decided blocks of articles count.
    """
    out, last, inside, fair = [], "", "", False
    for b in found:
        out.append((inside if b.region > 0 else last, fair))
        if b.label in ("good", "bad"):
            last, fair = b.label, False
            inside = b.label if b.region > 0 else inside
        elif b.label == "fair":
            fair = True
    return out


def _second_pass(found: list[Block]) -> None:
    """Open blocks take the labels of their nearest decided neighbours."""
    before, after = _neighbours(found), _neighbours(found[::-1])[::-1]
    labels = []
    for b, (one, fair_one), (two, fair_two) in zip(found, before, after, strict=True):
        if b.label in ("good", "bad"):
            labels.append(b.label)
        elif b.region > 0:
            labels.append("bad" if one == two == "bad" and b.label == "short" and not b.heading else "good")
        elif one == two:
            labels.append(one or ("good" if b.label == "fair" else "bad"))
        elif not one or not two:
            labels.append("good" if b.label == "fair" or b.heading and two == "good" else "bad")
        else:  # good on one side; a fair block that stands nearer on the other speaks for it too
            nearer = fair_one if one == "bad" else fair_two
            labels.append("good" if b.label == "fair" or nearer or b.heading and two == "good" else "bad")
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str) -> str:
    """Main text of a page: good blocks in page order, one a line."""
    found, lang = blocks(page)
    stop = set(STOP_WORDS[lang]) if lang in STOP_WORDS else EVERY
    _overrule(found, stop)
    for b in found:
        b.label = _first_pass(b, stop)
    _second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html", 8 << 20):
            texts = [main_text(x) if x else "" for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))
    return some.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
