"""Main text of web pages from streamed parser events.

The standard library's parser is fed in pieces; its events make blocks (the lines of the shown page), each
with its text, tags and links. Elements that HTML itself calls furniture (nav, footer, form, hidden ones
and the like) have no text. The text-to-tag ratios of the blocks, link texts left out and lowered where a
class or id names furniture, are smoothed by a Gaussian over their neighbours; two-means clustering
of these ratios gives the threshold above which blocks are content.

The innermost container that holds all content, or the outermost article or main around it, is the
article; without either it grows outwards while what it gains is not mostly links. Within it, blocks
below the threshold (headings, short paragraphs) are kept with their neighbours, except where a name plainly says
furniture, and in containers without content whose text is mostly links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwire.llm.common import slices

# Element and attribute names of HTML, and words that name page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg head title iframe object canvas audio video textarea select button math".split())
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = {"br", "td", "th"}
CONTAINERS = set("article main section div td body blockquote".split())
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies social share sharing related widget widgets toolbar pagination pager masthead "
    "notification notifications announcement responses promoted topbar sidenav subnav search login".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words that say where or how a named part stands, and nothing of its content.
PLACED = set("left right top bottom upper lower inner outer first last big small main box boxes bar list item items container wrapper wrap area block blocks section row col column columns unit slot panel group holder inline".split())
#: What a name that plainly or perhaps says furniture makes of a ratio.
PLAIN, PERHAPS = 0.02, 0.5
#: An open one of these ends where one of the set starts.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NEVER_NAMED = set("html body main article h1 h2 h3 h4 h5 h6".split())
PIECE = 1 << 16


def furniture(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Furniture by the page's own markup."""
    if tag in SILENT or tag in FURNITURE or tag == "header" and not inside_article:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def hint(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> float:
    """What the names of an element make of the ratios in it.

    A name of furniture words, or of these and words of place, says it plainly; one that has other words too
    (``share-price``) only perhaps.
    """
    out = 1.0
    for name, value in attrs:
        if name not in ("class", "id") or not value or tag in NEVER_NAMED and not (tag == "article" and "comment" in value.lower().split()):
            continue
        for token in value.lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            named = [w for w in words if w in NAMED or w == "header" and not inside_article]
            if named:
                out = min(out, PLAIN if all(w in PLACED for w in words if w not in named) else PERHAPS)
    return out


class Page(HTMLParser):
    """Blocks of a page. Any number of elements may be open: names are counted, so none is looked for in vain."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, float]] = []  # tag, furniture, container, hint of all that is open
        self.open: Counter[str] = Counter()
        self.owners = [0]  # parent of each container
        self.kinds = ["page"]
        self.hints = [1.0]
        self.off = self.articles = self.menus = self.silent = 0
        #: text, characters in links, tags, container, furniture, hint
        self.blocks: list[tuple[str, int, int, int, bool, float]] = []
        self.parts: list[str] = []
        self.linked = self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.blocks.append((text, self.linked, self.tags, self.container(), self.off > 0, self.shift()))
        self.parts, self.linked, self.tags = [], 0, 0

    def container(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def shift(self) -> float:
        return self.stack[-1][3] if self.stack else 1.0

    def pop(self) -> None:
        tag, off, _, _ = self.stack.pop()
        self.open[tag] -= 1
        self.off -= off
        self.articles -= tag in ("article", "main")
        self.menus -= off and tag in ("nav", "header", "menu")
        self.silent -= tag in SILENT

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        while self.stack and tag in CLOSES.get(self.stack[-1][0], ()):
            self.pop()
        if tag in BLOCKS and self.open["p"]:  # formatting left open does not keep a paragraph open
            at = len(self.stack) - 1
            while self.stack[at][0] not in BLOCKS and self.stack[at][0] not in CELLS:
                at -= 1
            if self.stack[at][0] == "p":
                while len(self.stack) > at:
                    self.pop()
        if tag in ("article", "main"):  # a menu or header that was never closed ends here
            while self.menus:
                self.pop()
        if tag == "body":
            while self.silent:
                self.pop()
        self.tags += 1
        if tag in CELLS:
            self.parts.append(" ")
        if tag in VOID:
            return
        off = furniture(tag, attrs, self.articles > 0)
        shift = min(self.shift(), hint(tag, attrs, self.articles > 0))
        where = self.container()
        if tag in CONTAINERS:
            self.owners.append(where)
            self.kinds.append(tag)
            self.hints.append(shift)
            where = len(self.owners) - 1
        self.stack.append((tag, off, where, shift))
        self.open[tag] += 1
        self.off += off
        self.articles += tag in ("article", "main")
        self.menus += off and tag in ("nav", "header", "menu")
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Middle between the centres of two clusters."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        middle = (low + high) / 2
        above = values > middle
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 0.6) -> str:
    """The article's blocks in page order, joined by line feeds; empty if there is none."""
    if not html:
        return ""
    page = Page()
    for i in range(0, len(html), PIECE):
        page.feed(html[i : i + PIECE])
    page.close()
    page.flush()
    blocks = page.blocks
    own = [0 if off else len(t) - min(n, len(t)) for t, n, _, _, off, _ in blocks]
    if not any(t and not off for t, _, _, _, off, _ in blocks):
        return ""
    ratios = smooth(np.array([b[5] * n / max(1, b[2]) for n, b in zip(own, blocks)]), sigma)
    line = threshold(ratios)
    content = [bool(ratio >= line and n) for ratio, n in zip(ratios, own)]
    weight, length, plain = (inside(page, (x * y for x, y in zip(xs, ys))) for xs, ys in ((own, content), ([len(b[0]) for b in blocks], [not b[4] for b in blocks]), (own, [1] * len(own))))
    if not weight[0]:
        return ""
    # the innermost container that holds every block above the threshold, several articles included
    chosen = max(c for c in range(len(weight)) if weight[c] == weight[0])
    above = [chosen]
    while above[-1]:
        above.append(page.owners[above[-1]])
    named = [c for c in above if page.kinds[c] in ("article", "main")]
    if named:  # a lead may stand beside the inner article
        chosen = named[-1]
    else:  # a lead, heading or tail may stand beside the inner container, unless that is mostly links
        for c in above[1:]:
            if 2 * (plain[c] - plain[chosen]) < length[c] - length[chosen]:
                break
            chosen = c
    within = {chosen}
    for c in range(chosen + 1, len(page.owners)):
        if page.owners[c] in within and not (not weight[c] and 2 * plain[c] < length[c]):  # not a container of links alone
            within.add(c)
    plainly = [b[5] <= PLAIN < page.hints[chosen] for b in blocks]
    return "\n".join(b[0] for b, hot, out in zip(blocks, content, plainly) if b[0] and not b[4] and b[3] in within and (hot or not out))


def inside(page: Page, values: Iterable[float]) -> list[float]:
    """Sums of the blocks' values for each container and all within it."""
    out = [0.0] * len(page.owners)
    for b, x in zip(page.blocks, values):
        out[b[3]] += x
    for c in range(len(out) - 1, 0, -1):
        out[page.owners[c]] += out[c]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``.

    Null or empty html gives an empty text. Rows that share a page_id are read one by one;
    null ids and urls stay null. Other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name="html"):
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
