"""HTML extraction: the main text of a page, by two passes of rules over its blocks.

Method: the page is cut into blocks at block-level tags; scripts, styles, forms, comments and the content of other
elements that hold no text for readers go first.  Pass one classifies each block by its length, its link density and its
density of stop words: mostly links is bad, long and rich in stop words is good, rich in stop words or with a few of them
is near-good, without is poor, and what is too short to tell is short.  Pass two settles short, poor and near-good blocks
from their nearest decided neighbours: between two good ones a block is good, between two bad ones bad, and between a good
and a bad one it follows the good one if it is near-good or if both are in the same container.  On a page without a good
block, stop words say little (it may be in a language without a list): then near-good blocks and all blocks that are
neither short nor in a bad neighbourhood are its text.

Names of elements are evidence beside the rules.  Those that say what they hold (navigation, footers, asides, and classes
or ids made of words such as ``sidebar``, ``ad``, ``cookie`` or ``comments``) make their blocks bad.  An ``article`` or
``main`` is one container with all that is in it; a block outside of a page's article isn't good on its own, it takes
good neighbours.  Stop words are those of the given lists, for all languages at once.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
line feed, and nothing else is dropped or capped.

Defined cases: null or empty html gives an empty text; html without any tag is one block; broken markup is read as far as
tags can be told; repeated rows give a row each; an empty table gives an empty result; further columns are carried along,
except those named as a result column, which it replaces.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import bounded_batches

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was
    we were which will with you aber als am an auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer
    er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind und uns von war was wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que
    qui sa se ses son sont sur un une vous al como con de del el ella en entre es esta este esto la las le lo los más me mi
    muy no nos o para pero por que se si sin sobre su sus también un una y ya yo""".split()
)
LONG, SHORT = 200, 70
LINKS, STOP_HIGH, STOP_LOW = 0.5, 0.2, 0.1

#: Elements whose content goes; a script or style that is never closed takes the rest of the page with it, as in browsers.
_DROPPED = "script|style|noscript|template|iframe|object|embed|svg|canvas|video|audio|map|select|textarea|button|form|datalist|dialog|head"
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
_BAD = frozenset("nav footer aside menu".split())
#: Elements whose class says nothing about what they are for.
_FREE = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that tell what an element is for.
_BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|search|share|sharing|social|related|recommended|widget|comments?|comment-list|replies|reply|respond|disqus|discussion|complementary|contentinfo|copyright|legal|pagination|pager|toolbar|tags|byline-share|skip|hidden|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRS = re.compile(r"((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_CLOSE = {t: re.compile(rf"</{t}(?![a-zA-Z0-9:-])", re.I | re.A) for t in _DROPPED.split("|")}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CLOSES_P = _BLOCK - {"body", "html"}
_WORD = re.compile(r"\w+")


class _Block:
    __slots__ = ("bad", "box", "heading", "inside", "links", "parts")

    def __init__(self, box: int, bad: bool, inside: bool, heading: bool) -> None:
        self.parts, self.links, self.box, self.bad, self.inside, self.heading = [], 0, box, bad, inside, heading

    def text(self) -> str:
        return " ".join(_html.unescape("".join(self.parts)).split())


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text, and then a tag in lower case (if any), whether it closes, and its attributes; each character is looked at a
    few times at most, whatever is broken."""
    at = kept = gt = 0
    never: set[str] = set()  # dropped elements that aren't closed any more
    while (lt := page.find("<", at)) >= 0:
        gt = gt if gt > lt else page.find(">", lt)
        if gt < 0:
            break
        end, tag, close, attrs = lt, "", False, ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) + 3
            end = len(page) if end < 3 else end
        elif page.startswith(("<!", "<?"), lt):
            end = gt + 1
        elif name := _NAME.match(page, lt + 1):
            rest = _ATTRS.match(page, name.end())
            tag, close = name[2].lower(), bool(name[1])
            end = rest.end() if rest else page.find(">", name.end()) + 1
            attrs = page[name.end() : end - 1]
        else:
            at = lt + 1
            continue
        text, at = page[kept:lt], end
        if tag in _CLOSE and not close and not attrs.endswith("/") and tag not in never:
            if m := _CLOSE[tag].search(page, at):
                at = page.find(">", m.end()) + 1 or len(page)
            elif tag in ("script", "style"):
                at = len(page)
            else:
                never.add(tag)
        kept = at
        yield text, tag, close, attrs
    yield page[kept:], "", False, ""


def _blocks(page: str) -> list[tuple[str, _Block]]:
    stack: list[tuple[str, bool, bool, int]] = []  # tag, bad, inside the article, container
    opened: Counter[str] = Counter()
    out: list[_Block] = []
    bad = inside = heading = False
    box = boxes = link = 0
    now: _Block | None = None

    def pop() -> str:
        opened[stack[-1][0]] -= 1
        return stack.pop()[0]

    for text, tag, close, attrs in _pieces(page):
        if text and (now or text.strip()):
            if now is None:
                now = _Block(box, bad, inside, heading)
                out.append(now)
            now.parts.append(text)
            if link:
                now.links += len(text.strip())
        if not tag:
            continue
        if tag in _CLOSE:
            now = None if tag in ("form", "head", "dialog") else now
            continue
        if tag == "a":
            link = not close
            continue
        if tag == "br":
            if now:
                now.parts.append(" ")
            continue
        if tag not in _BLOCK and not (close or "class" in attrs or "id" in attrs or "role" in attrs or "hidden" in attrs):
            continue
        if close:
            if tag not in _BLOCK and not opened[tag]:
                continue
            if opened[tag]:
                while pop() != tag:
                    pass
        elif tag not in _VOID and not attrs.endswith("/"):
            if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                pop()
            say = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
            _, was_bad, was_in, was_box = stack[-1] if stack else ("", False, False, 0)
            word = tag not in _FREE and any((w := _BAD_WORDS.search(say.get(k, ""))) and not (was_in and w[0].strip(" _-").lower() == "header") for k in ("class", "id", "role"))
            off = "hidden" in say or say.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", say.get("style", ""))
            is_bad = was_bad or tag in _BAD or bool(word) or bool(off) or tag == "header" and not was_in
            is_in = was_in or tag in ("article", "main") or say.get("role") == "main"
            # An article is one container, but for what is bad in it.
            if tag in _BLOCK and tag not in ("p", "li") and tag not in _HEAD and (not was_in or is_bad and not was_bad):
                boxes += 1
                was_box = boxes
            opened[tag] += 1
            stack.append((tag, is_bad, is_in, was_box))
        if tag in _BLOCK:
            now, link = None, 0
        _, bad, inside, box = stack[-1] if stack else ("", False, False, 0)
        heading = any(x[0] in _HEAD for x in stack[-2:])
    return [(t, b) for b in out if (t := b.text())]


def _kind(text: str, b: _Block) -> str:
    """Pass one."""
    if b.bad or b.links / max(1, len(text)) > LINKS:
        return "bad"
    if len(text) < SHORT:
        return "short"
    words = _WORD.findall(text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    return "near" if stop >= STOP_LOW else "poor"


def _settled(kind: str, box: int, heading: bool, near: list[tuple[str, int]]) -> bool:
    """Pass two: whether a block that isn't decided is good, by the kinds and containers of its nearest decided neighbours."""
    good = [of for k, of in near if k == "good"]
    if not good:
        return False
    return len(good) == 2 or kind == "near" or heading or box in good


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    blocks = _blocks(page)
    kinds = [_kind(t, b) for t, b in blocks]
    article = any(b.inside and k != "bad" for k, (_, b) in zip(kinds, blocks))
    if article:  # what is outside takes good neighbours
        kinds = ["poor" if k in ("good", "near") and not b.inside else k for k, (_, b) in zip(kinds, blocks)]
    if "good" not in kinds:
        open_ = [(i, k, blocks[i][0]) for i, k in enumerate(kinds) if k != "bad" and (blocks[i][1].inside or not article)]
        own = [i for i, k, t in open_ if k == "near" or k == "poor" and (article or len(t) > LONG)]
        for i in own or [i for i, k, _ in open_ if k == "poor" or article] or [i for i, _, _ in open_]:
            kinds[i] = "good"
    before: list[tuple[str, int] | None] = []
    last = None
    for k, (_, b) in zip(kinds, blocks):
        before.append(last)
        last = (k, b.box) if k in ("good", "bad") else last
    out, last = [], None
    for k, (text, b), left in zip(reversed(kinds), reversed(blocks), reversed(before)):
        if k == "good" or k != "bad" and _settled(k, b.box, b.heading, [x for x in (left, last) if x]):
            out.append(text)
        last = (k, b.box) if k in ("good", "bad") else last
    return "\n".join(reversed(out))


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (which needs ``html``) and ``text``, ``n_chars``."""
    bounded_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    place = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, pages.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
