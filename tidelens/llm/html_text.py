"""Operator 9: main text of web pages by line-block distribution.

Markup is stripped in one forward scan, so that every block of the page becomes a line with its length. Menus, footers,
sidebars, page headers, dialogs and buttons are left out by their element, and blocks whose class, id or role says that they
are an advert, a notice, a sidebar or reader comments by their name; where such a part stood, empty lines part the text.
Names are read as compounds, by their last telling word: ``related-posts`` and ``left-sidebar`` are noise, while
``related-work`` and ``side-effects`` hold words that say something else, so they only have no length. A form is left out
unless it holds a marked article or most of a page's text; labels are text unless they are all that a line of a form has.

On pages that mark their article the marked lines are the text. Elsewhere the lengths decide, lines that are mostly
links having none. The text's container is the innermost part of several lines with most of the page's length, and its lines
are the text, but for lists of links at its ends. Before and behind it, lengths are summed over sliding windows of
lines: what lies between the first surge and the last dive stays, a surge being a sum of at least ``PART`` of the sum
at the container's middle code point, so that it follows the page's own distribution. The ends of these spans,
and of a container that is all of the page, are cut to lines that are long by this measure, are headings, or have the element of most of the text.

Comments and scripts leave no space behind, as a browser has none there. A name such as ``with-sidebar`` describes the
part that has a sidebar, not one; where names and elements leave no text at all, names are not believed.

Defined cases: a null or empty page has the empty text; broken or cut markup is read as far as it goes (only
scripts, styles and the like run to the end of the page where nothing closes them), in time that grows with the page's
length; repeated rows are extracted each; other columns are ignored; an empty table gives no rows; nothing of the article is capped.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

#: Lines of a window; least sum of a surge; a surge's part of the usual sum; least text of a form that is a page.
WINDOW, SURGE, PART, FORM_TEXT = 3, 12, 0.15, 200
_RAW = re.compile(r"<!--|<!\[CDATA\[|<(script|style|textarea|iframe|noscript|title|template|svg|math|object|canvas|head)\b", re.I)
#: Raw elements that end the page where nothing closes them.
_TO_END = frozenset("script style textarea iframe noscript title".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)(?:>|(?=<)|\Z)|<[!?][^>]*+>")
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements that end a block, that have no content, and whose content is never article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("nav footer aside button select dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that lay out other blocks.
LAYOUT = frozenset("article blockquote body center details div dl fieldset figure form html main ol section table tbody td tr ul".split())
#: Words of class, id or role that mark a part as something other than the article.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar comment comments disqus replies reply respond discussion share sharing social related recommended recommendations teaser teasers widget login search pagination pager copyright disclaimer".split())
ARTICLE_WORDS = frozenset("article main".split())
#: Words that say how a part is laid out, not what is in it; a name's last other word tells what it is.
LAYOUT_WORDS = frozenset("area article articles author avatar bar block body bottom box button buttons col column container content count desktop entries entry form group header heading icon icons inner item items leaderboard left link links list lists main media meta mobile outer panel post posts right row section slot stories story strip text thread title top unit wide widgets wrap wrapper zone".split())
#: Words by which a name tells what a part has or is laid out with.
_HAS = frozenset("with has have no without layout hide hidden show".split())


class Part(NamedTuple):
    """An open or closed block of a page: the part around it, its element, whether it is the article, and what makes it suspect."""

    parent: int
    tag: str
    article: bool
    suspect: str  # "", "form", "noise" or "hint"


class Line(NamedTuple):
    text: str
    size: int  # code points, 0 where most of them are links
    part: int
    label: bool  # nothing but labels


def _names(attributes: str) -> tuple[str, bool]:
    """What class, id or role say of a part: "noise", "hint" or nothing, and whether it is the article."""
    found, article = set(), False
    for a, b, c in _NAME.findall(attributes):
        for name in (a or b or c).split():
            said = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            if _HAS.isdisjoint(said):
                article |= not ARTICLE_WORDS.isdisjoint(said)
                if not NOISE_WORDS.isdisjoint(said):
                    telling = [w for w in said if w in NOISE_WORDS or w not in LAYOUT_WORDS and len(w) > 1]
                    found.add("noise" if telling[-1] in NOISE_WORDS else "hint")
    return "noise" if "noise" in found else "hint" if found else "", article


def without_raw(page: str) -> str:
    """The page without comments, scripts, drawings and the like, and its head; each kind of end is looked for once where there is none."""
    out, at, scan, none = [], 0, 0, set()
    lower = page.lower() if page.isascii() else re.sub(r"[A-Z]+", lambda m: m[0].lower(), page)

    def end(what: str, start: int) -> int:
        """Behind the next end of this kind, or -1."""
        if what in none:
            return -1
        if what.startswith("</"):
            hit = re.compile(rf"{what}\s*+>").search(lower, start)
            k = hit.end() if hit else -1
        else:
            k = lower.find(what, start)
            k = k + len(what) if k >= 0 else -1
        if k < 0:
            none.add(what)
        return k

    while tag := _RAW.search(page, scan):
        scan, name = tag.end(), (tag[1] or "").lower()
        if not name:
            stop = end("-->" if tag[0] == "<!--" else "]]>", scan)
            stop = len(page) if stop < 0 else stop
        else:
            open_end = end(">", scan)
            if open_end < 0:
                break
            if name in ("svg", "math") and page[open_end - 2] == "/":
                stop = open_end
            else:
                stop = end(f"</{name}", open_end)
                if name == "head":
                    body = end("<body", open_end)
                    stop = min(x for x in (stop, body - len("<body")) if x >= 0) if stop >= 0 or body >= 0 else -1
                if stop < 0 and name in _TO_END:
                    stop = len(page)
        if stop < 0:
            out.append(page[at:scan])
            at = scan
            continue
        out.append(page[at : tag.start()])
        at = scan = stop
    out.append(page[at:])
    return "".join(out)


def lines_of(page: str, by_name: bool = True) -> tuple[list[Line], list[Part]]:
    """The page's lines, empty ones where noise elements stood, and its parts, the first of which is the page.

    Without ``by_name`` parts are noise by their element only.
    """
    page = without_raw(page)
    lines, parts = [], [Part(-1, "", False, "")]
    stack: list[tuple[str, int, bool, bool]] = []  # open elements: name, part around, whether noise, whether it is an article
    opened: Counter[str] = Counter()
    noise = article = links = linked = labels = labelled = part = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked, labelled
        line = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
        if line:
            lines.append(Line(line, 0 if linked * 2 > len(line) else len(line), part, labelled >= len(line)))
        text.clear()
        linked = labelled = 0

    def gap() -> None:
        lines.extend([Line("", 0, part, False)] * WINDOW)

    at = 0
    for tag in _TAG.finditer(page):
        if not noise and tag.start() > at:
            piece = page[at : tag.start()]
            text.append(piece)
            linked += len(piece.strip()) if links else 0
            labelled += len(piece.strip()) if labels else 0
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in ("a", "label"):
            links, labels = (0 if closing else 1, labels) if name == "a" else (links, 0 if closing else 1)
            continue
        if name == "br":
            if not noise:
                text.append(" ")
            continue
        if name not in BLOCKS and name not in NOISE and name != "span":
            continue
        if closing:
            if not opened[name]:
                continue
            if name in BLOCKS and not noise:
                flush()
            while True:
                own, part_around, was_noise, was_article = stack.pop()
                opened[own] -= 1
                noise -= was_noise
                article -= was_article
                if own != "span":
                    part = part_around
                if was_noise and not noise and own in BLOCKS:
                    gap()
                if own == name:
                    break
            continue
        said, named = _names(attributes) if attributes else ("", False)
        said = said if by_name and name not in ("html", "body") else ""
        bad = name in NOISE or (name == "header" and not article) or (name == "span" and said == "noise")
        if not noise and name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            opened["p"] -= 1
            part = stack.pop()[1]
        good = not noise and not bad and (name in ("article", "main") or named and said != "noise" and name in ("div", "section"))
        if bad and not noise and name in BLOCKS:
            gap()
        stack.append((name, part, bad, good))
        opened[name] += 1
        noise += bad
        article += good
        if name != "span" and not noise:
            parts.append(Part(part, name, good, "form" if name == "form" else said))
            part = len(parts) - 1
    if not noise:
        text.append(page[at:])
        flush()
    return lines, parts


def _totals(lines: list[Line], parts: list[Part], sizes: list[int]) -> list[int]:
    """The length of each part with all parts in it."""
    out = [0] * len(parts)
    for line, size in zip(lines, sizes):
        out[line.part] += size
    for k in range(len(parts) - 1, 0, -1):
        out[parts[k].parent] += out[k]
    return out


def _verdicts(lines: list[Line], parts: list[Part]) -> tuple[list[bool], list[bool], list[bool]]:
    """For each part whether it is noise, in the article, and without length, with the parts around it."""
    total = _totals(lines, parts, [0 if line.label else line.size for line in lines])
    text = _totals(lines, parts, [len(line.text) for line in lines])
    true_article = [p.article and p.suspect != "noise" and text[k] > 0 for k, p in enumerate(parts)]
    holds = [False] * len(parts)
    for k in range(len(parts) - 1, 0, -1):
        holds[parts[k].parent] |= holds[k] or true_article[k]
    some = any(true_article)
    noise, inside, weightless = [False], [False], [False]
    for k, p in enumerate(parts[1:], 1):
        most = 2 * total[k] >= total[0]
        if p.suspect == "form":
            bad = not holds[k] and not (most and total[k] >= FORM_TEXT)
        elif p.tag in ("article", "main"):
            bad = p.suspect == "noise" and some and not holds[k]
        else:
            bad = p.suspect == "noise"
        noise.append(bad or noise[p.parent])
        inside.append(p.article or inside[p.parent])
        weightless.append(weightless[p.parent] or p.suspect == "hint" and not most)
    return noise, inside, weightless


def sums_of(sizes: list[int]) -> np.ndarray:
    """Sums over windows of lines, each around its line."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n, half = len(sizes), WINDOW // 2
    k = np.arange(n)
    return total[np.minimum(n, k + half + 1)] - total[np.maximum(0, k - half)]


def regions(sizes: list[int], surge: float) -> list[tuple[int, int]]:
    """Runs of lines between a rise from nothing and a dive of the window sums, from the first with a surge to the last."""
    sums = sums_of(sizes)
    up = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    runs = list(zip(np.flatnonzero(np.diff(up) > 0).tolist(), np.flatnonzero(np.diff(up) < 0).tolist()))
    high = [k for k, (a, b) in enumerate(runs) if sums[a:b].max() >= surge]
    return runs[high[0] : high[-1] + 1] if high else []


def _container(lines: list[Line], parts: list[Part], sizes: list[int]) -> tuple[int, int]:
    """The lines of the innermost part of several lines that has most of the page's length."""
    total = _totals(lines, parts, sizes)
    several = _totals(lines, parts, [int(size > 0) for size in sizes])
    best = max((k for k, p in enumerate(parts) if 2 * total[k] > total[0] and (k == 0 or p.tag in LAYOUT and several[k] > 1)), default=0)
    within = [k == best for k in range(len(parts))]
    for k in range(best + 1, len(parts)):
        within[k] = within[k] or within[parts[k].parent]
    own = [k for k, line in enumerate(lines) if within[line.part] and line.text]
    return own[0], own[-1] + 1


def _usual_sum(sizes: list[int]) -> int:
    """The window sum of the line that has the middle code point, lines being ordered by their sums."""
    sums, lengths = sums_of(sizes), np.asarray(sizes)
    order = np.argsort(sums, kind="stable")
    return int(sums[order][np.searchsorted(2 * np.cumsum(lengths[order]), lengths.sum())])


def _by_length(lines: list[Line], parts: list[Part], sizes: list[int]) -> list[int]:
    """The lines of the text of a page that marks no article."""
    first, last = _container(lines, parts, sizes)
    has_text = [k for k, line in enumerate(lines) if line.text]
    whole = has_text[0] == first and has_text[-1] == last - 1
    surge = max(SURGE, PART * _usual_sum(sizes[first:last]))
    tag = lambda k: parts[lines[k].part].tag

    def links(ks: list[int]) -> int:
        """How many lines at the start of ``ks`` are a list of links."""
        n = next((i for i, k in enumerate(ks) if sizes[k]), len(ks))
        return n if n >= WINDOW or n and all(tag(k) in ("li", "td") for k in ks[:n]) else 0

    kept = [k for k in range(first, last) if lines[k].text]
    kept = kept[links(kept) :]
    kept = kept[: len(kept) - links(kept[::-1])]
    lengths: Counter[str] = Counter()
    for k in kept:
        if tag(k) not in HEADINGS:
            lengths[tag(k)] += sizes[k]
    usual = HEADINGS.union(t for t, _ in lengths.most_common(1))

    def cut(ks: list[int]) -> list[int]:
        """The lines from the first to the last that are long or have a usual element."""
        long = [k for k in ks if tag(k) in usual or sizes[k] >= surge]
        return [k for k in ks if long and long[0] <= k <= long[-1]]

    kept = cut(kept) if whole else kept
    for a, b in ((0, first), (last, len(lines))):
        found = regions(sizes[a:b], surge) if b > a else []
        if found:
            kept += cut([k for k in range(a + found[0][0], a + found[-1][1]) if lines[k].text])
    heading = next((k for k in range(first - 1, -1, -1) if lines[k].text), -1)
    if heading >= 0 and tag(heading) in HEADINGS:
        kept.append(heading)
    return sorted(set(kept))


def main_text(page: str | None, by_name: bool = True) -> str:
    """The article of a page, its blocks joined by an empty line."""
    lines, parts = lines_of(page or "", by_name)
    noise, inside, weightless = _verdicts(lines, parts)
    forms = [False]
    for p in parts[1:]:
        forms.append(p.tag == "form" or forms[p.parent])
    # What is left out leaves a gap, so that the sums fall to nothing there.
    left: list[Line] = []
    for line in lines:
        if noise[line.part] or line.label and forms[line.part]:
            left.extend([Line("", 0, 0, False)] * WINDOW)
        else:
            left.append(line)
    if not any(line.text for line in left):
        return main_text(page, by_name=False) if by_name else ""
    marked = [line.text for line in left if line.text and inside[line.part]]
    if marked:
        return "\n\n".join(marked)
    sizes = [0 if weightless[line.part] else line.size for line in left]
    return "\n\n".join(left[k].text for k in _by_length(left, parts, sizes)) if any(sizes) else ""


def _run(batches):
    for batch in slices(batches, "html", 4_000_000):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; no shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_run, f"page_id {kind}, url string, text string, n_chars long")
