"""The main text of web pages, by boosted trees over nodes of the document tree and hierarchical decoding.

A page is parsed into its elements. Boosted trees give each element with text a probability of being main text, from its tag,
depth, place among its siblings, the lengths, links and blocks below it, and the tokens of its class, id and role and of those
above it. Decoding chooses a label for each element: whole (all below is main text), none (nothing is), or mixed (each child
decides); an element below a whole or an empty one has the same label, so ancestors and descendants never contradict each other. The labels of the
page are those of the highest joint likelihood, found from the leaves upwards.

The trees learn from pages that `sample_pages` writes by rules, with many layouts and known main text; PAGES of them, whatever the corpus.

A page without html, or without main text, gives an empty text; scripts, styles and other elements without prose never count; broken markup is closed as
browsers do it; repeated rows each get their result; elements whose labels are equally likely are left out; a page is parsed in time in proportion to its length, and a very long one is a step of its own; a table without rows gives none;
columns beside page_id, url and html play no part.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .quality_classifier import _tree, holds

#: Pages in the fit.
PAGES = 500
TREES, DEPTH, RATE = 40, 4, 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style title textarea template noscript iframe noembed noframes object svg math canvas select option button datalist audio video xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Open elements that a start tag ends, up to the nearest of the stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Tokens of class, id and role, by what they speak for.
GOOD = frozenset("article body content entry main post story text prose hentry articlebody".split())
BAD = frozenset(
    "ad ads advert advertisement advertising alert author banner bio breadcrumb breadcrumbs byline captcha comment comments consent contentinfo cookie cookies copyright dialog discussion disqus "
    "feedback footer foot form gdpr head header links login logo masthead menu meta modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup popular privacy promo "
    "promoted rail recommended related reply replies respond responses search share sharing sidebar signup site skip social sponsor sponsored subscribe tags taboola toc tools topbar trending widget".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")


class Page:
    """Elements in page order (element 0 holds all others), and the text blocks, each with the elements that its parts lie in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens, self.end = ["#page"], [-1], [0], [()], [0]
        self.pieces: list[tuple[int, str, int]] = []  # (element, text, block)
        stack, block, at = [0], 0, 0
        silent = 0  # how many open elements are silent
        places: dict[str, list[int]] = {}  # where on the stack the open elements of a name are

        def close(n: int) -> None:
            nonlocal silent, block
            while len(stack) > n:
                tag = self.tag[stack.pop()]
                places[tag].pop()
                silent -= tag in SILENT
                block += tag in BLOCK

        def last(names: tuple[str, ...]) -> int:
            return max([places[x][-1] for x in names if places.get(x)], default=0)

        def up_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
            while (k := last(names)) > last(stops):
                close(k)

        def text(a: int, b: int) -> None:
            if not silent and b > a:
                self.pieces.append((stack[-1], entities.unescape(source[a:b]), block))

        n = len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                break
            text(at, m.start())
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                stop = 0 if name in BLOCK else last(("td", "th", "table"))
                if (k := last((name,))) and k >= stop:
                    close(k)
                else:
                    block += name == "p"
                continue
            if name in BLOCK:
                block += 1
                if name in ENDS:
                    up_to(*ENDS[name])
                if name not in ("html", "body"):
                    up_to(("p",), ("table", "td", "th", "div", "article", "section", "main", "aside", "li", "blockquote", "form", "button"))
            elif name in ENDS:
                up_to(*ENDS[name])
            elif name == "br" and not silent:
                self.pieces.append((stack[-1], " ", block))
            if name in VOID:
                continue
            if name in ("html", "body") and places.get(name):
                continue
            e = len(self.tag)
            words: tuple[str, ...] = ()
            if m[3]:
                found = [w for k, a, b, c in _ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role", "itemprop") for w in _TOKEN.findall((a or b or c).lower())]
                words = tuple(dict.fromkeys(found))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tokens.append(words)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
                at = stop.start() if stop else n
            places.setdefault(name, []).append(len(stack))
            stack.append(e)
            silent += name in SILENT
            if m[3].rstrip().endswith("/") and name not in BLOCK and name not in RAW:
                close(len(stack) - 1)
        text(at, n)
        close(1)

    def blocks(self, keep: np.ndarray) -> list[str]:
        """The texts of blocks, of the pieces whose elements are kept."""
        out: list[str] = []
        last, own = -1, []
        for e, t, b in self.pieces:
            if not keep[e]:
                continue
            if b != last:
                if own and (whole := " ".join("".join(own).split())):
                    out.append(whole)
                own, last = [], b
            own.append(t)
        if own and (whole := " ".join("".join(own).split())):
            out.append(whole)
        return out


FEATURES = (
    "depth tag_article tag_main tag_nav tag_aside tag_header tag_footer tag_form tag_p tag_heading tag_list tag_link tag_table tag_container good bad good_above bad_above bad_below "
    "share_of_text length links_share blocks mean_block elements_per_char stops_per_char place siblings text_before children prose_share sibling_prose"
).split()
_KINDS = {"article": 0, "main": 1, "nav": 2, "aside": 3, "header": 4, "footer": 5, "form": 6, "p": 7, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 8), **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd", "menu"), 9), "a": 10, **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), 11), **dict.fromkeys(("div", "section", "center", "span"), 12)}


def features(page: Page) -> np.ndarray:
    """A row for each element; those without text below have zero length."""
    n = len(page.tag)
    own, linked, stops, blocks, prose = (np.zeros(n) for _ in range(5))
    in_link = np.zeros(n, bool)
    parent = page.parent
    kinds = [_KINDS.get(t, -1) for t in page.tag]
    good, bad = np.zeros(n), np.zeros(n)
    bad_tag = (2, 3, 5, 6)
    good_above, bad_above, children, place = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for e in range(n):
        for w in page.tokens[e]:
            good[e] += w in GOOD
            bad[e] += w in BAD
        p = parent[e]
        if p >= 0:
            place[e] = children[p]
            children[p] += 1
            in_link[e] = in_link[p] or kinds[e] == 10
            good_above[e] = good_above[p] + good[p] + (kinds[p] in (0, 1))
            bad_above[e] = bad_above[p] + bad[p] + (kinds[p] in bad_tag)
    total = 0
    before = np.full(n, -1.0)
    seen: dict[int, int] = {}
    lengths: dict[int, int] = {}
    for e, t, b in page.pieces:
        size = len(t.strip())
        if size:
            own[e] += size
            linked[e] += size * in_link[e]
            stops[e] += t.count(".") + t.count(",") + t.count("?") + t.count("!")
            lengths[b] = lengths.get(b, 0) + size
            if b not in seen:
                seen[b] = e
                blocks[e] += 1
            x = e
            while x >= 0 and before[x] < 0:
                before[x] = total
                x = parent[x]
            total += size
    for b, e in seen.items():
        prose[e] += lengths[b] if lengths[b] >= 80 else 0
    below = bad + np.array([k in bad_tag for k in kinds])
    elements = np.ones(n)
    for e in range(n - 1, 0, -1):
        p = parent[e]
        for x in (own, linked, stops, blocks, prose, elements, below):
            x[p] += x[e]
    out = np.zeros((n, len(FEATURES)))
    length = np.maximum(own, 1)
    out[:, 0] = page.depth
    for e, k in enumerate(kinds):
        if k >= 0:
            out[e, 1 + k] = 1
    up = np.array([max(p, 0) for p in parent])
    columns = (good, bad, good_above, bad_above, below - bad - np.array([k in bad_tag for k in kinds]), own / max(total, 1), own, linked / length, blocks, own / np.maximum(blocks, 1), elements / length, stops / length, place, children[up], before / max(total, 1), children, prose / length, (prose[up] - prose) / np.maximum(own[up] - own, 1))
    out[:, 14:] = np.stack(columns, 1)
    return out


class Boosted:
    """Boosted trees: a tree is its leaves' paths with values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 34)[1:-1], method="inverted_cdf")) for k in range(x.shape[1])]
        mean = float((y * weight).sum() / weight.sum())
        self.base, self.trees = log(mean / (1 - mean)), []
        draw = np.random.default_rng(11)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            own = np.flatnonzero(draw.random(len(y)) < 0.6)
            some = set(draw.permutation(x.shape[1])[: x.shape[1] * 2 // 3].tolist())
            paths = _tree(x, [c if k in some else c[:0] for k, c in enumerate(cuts)], (y - p) * weight, own, DEPTH, ())
            inner = {path[:k] for path, _ in paths for k in range(len(path))}
            tree = []
            for path, rows in paths:
                if path not in inner:
                    step = float(((y - p) * weight)[rows].sum() / max((p * (1 - p) * weight)[rows].sum(), 1e-2))
                    tree.append((path, RATE * min(max(step, -4), 4)))
            self.trees.append(tree)
            f += self._tree(tree, x)

    @staticmethod
    def _tree(tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for path, value in tree:
            out[holds(path, x)] += value
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._tree(t, x) for t in self.trees))))


def decode(page: Page, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each element whether its own text is main text, by the best labels of the page."""
    n = len(page.tag)
    p = np.clip(p, 1e-3, 1 - 1e-3)
    none_of, whole_of = np.log(1 - p), np.log(p)
    mixed_of = np.log(1 - 0.98 * np.abs(2 * p - 1))
    direct = np.zeros(n, bool)
    for e, t, _ in page.pieces:
        if t.strip():
            direct[e] = True
    own = np.where(direct, np.maximum(whole_of, none_of), 0.0)  # of a mixed element, its own text is a child by itself
    empty = length <= 0
    for x in (none_of, whole_of, mixed_of, own):
        x[empty] = 0.0
    none_all, whole_all, split = none_of.copy(), whole_of.copy(), mixed_of + own
    best = np.zeros(n)
    for e in range(n - 1, -1, -1):  # children come after their parents
        best[e] = max(none_all[e], whole_all[e], split[e])
        if e:
            q = page.parent[e]
            none_all[q] += none_all[e]
            whole_all[q] += whole_all[e]
            split[q] += best[e]
    keep, fixed = np.zeros(n, bool), np.zeros(n, bool)
    for e in range(n):
        q = page.parent[e]
        if e and fixed[q]:
            keep[e], fixed[e] = keep[q], True
        elif split[e] > max(none_all[e], whole_all[e]):
            keep[e] = p[e] > 0.5
        else:
            keep[e], fixed[e] = whole_all[e] > none_all[e], True
    return keep


MARKED = "\x01"  # at the begin of main text in sample pages


def sample_pages(count: int, seed: int = 3) -> list[str]:
    """Pages of many layouts; blocks of main text begin with MARKED."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v sh".split() for b in ("a", "e", "i", "o", "u", "an", "er")]

    def words(a: int, b: int) -> str:
        out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b))]
        out[0] = out[0].capitalize()
        return " ".join(w + ("." if r.random() < 0.08 else "," if r.random() < 0.06 else "") for w in out)

    def attributes(names: list[str], plain: float = 0.25) -> str:
        if r.random() < plain:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', ' class="box"', ' class="row col"'])
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{r.choice(["wrap", "inner", "block", "top"])}"', f' class="x {name}"'])

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{k}">{words(1, 4)}</a>' for k in range(r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def paragraph(main: bool) -> str:
        mark = MARKED if main else ""
        kind = r.random()
        body = words(1, 6) if r.random() < 0.15 else words(8, 90)
        if kind < 0.08:
            return f"<p><b>{mark}{words(3, 12)}<br><p>{mark}{body}</p>"
        if kind < 0.16:
            return f'<p>{mark}{body} <a href="#">{words(1, 3)}</a> {words(3, 20)}</p>'
        if kind < 0.22:
            return "<ul>" + "".join(f"<li>{mark}{words(3, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.26:
            return f"<blockquote><p>{mark}{body}</p></blockquote>"
        if kind < 0.3:
            return f"<h2>{mark}{words(2, 8)}</h2><p>{mark}{body}"
        if kind < 0.33:
            return f"<div>{mark}{body}</div>"
        if kind < 0.35:
            return "<table><tr>" + "".join(f"<td>{mark}{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>"
        return f"<p>{mark}{body}</p>"

    def advert() -> str:
        return f"<{(t := r.choice(['div', 'div', 'aside', 'section']))}{attributes(['ad', 'ads', 'advert', 'sponsored', 'promo', 'banner'], 0.1)}>{words(3, 40)}</{t}>"

    def notice() -> str:
        return f"<div{attributes(['cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup'], 0.1)}><p>{words(5, 40)}</p><button>{words(1, 2)}</button></div>"

    def menu() -> str:
        t = r.choice(["nav", "nav", "div", "ul"])
        return f"<{t}{attributes(['nav', 'menu', 'navbar', 'breadcrumb', 'topbar'], 0.3)}>{links(3, 12)}</{t}>"

    def head() -> str:
        t = r.choice(["header", "div"])
        return f"<{t}{attributes(['header', 'masthead', 'site-header', 'logo'], 0.3 if t == 'header' else 0.05)}><a href='/'>{words(1, 4)}</a><p>{words(2, 9)}</p></{t}>"

    def sidebar() -> str:
        t = r.choice(["aside", "div"])
        inner = "".join(r.choice([lambda: f"<h3>{words(1, 4)}</h3>{links(2, 8)}", lambda: f"<p>{words(5, 40)}</p>"])() for _ in range(r.randint(1, 3)))
        return f"<{t}{attributes(['sidebar', 'related', 'widget', 'popular', 'rail'], 0.4 if t == 'aside' else 0.05)}>{inner}</{t}>"

    def comments() -> str:
        t = r.choice(["section", "div"])
        posts = "".join(r.choice([f"<div class='comment'><b>{words(1, 2)}</b><p>{words(4, 60)}</p></div>", f"<li class='reply'><p>{words(4, 50)}</p></li>", f"<p>{words(4, 40)}</p>"]) for _ in range(r.randint(1, 6)))
        return f"<{t}{attributes(['comments', 'discussion', 'responses', 'comment-list', 'disqus'], 0.0)}><h3>{words(1, 3)}</h3>{posts}</{t}>"

    def form() -> str:
        return f"<form{attributes(['newsletter', 'search', 'signup', 'login'])}><label>{words(1, 6)}</label><input><p>{words(3, 12)}</p><button>{words(1, 2)}</button></form>"

    def foot() -> str:
        t = r.choice(["footer", "footer", "div"])
        return f"<{t}{attributes(['footer', 'copyright', 'site-footer'], 0.4 if t == 'footer' else 0.05)}>&copy; {words(2, 14)} {links(0, 5) if r.random() < 0.4 else ''}</{t}>"

    pages = []
    for _ in range(count):
        inner = [paragraph(True) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.7:
            inner.insert(0, f"<h1>{MARKED}{words(3, 12)}</h1>")
        for part in (advert, notice, form, lambda: f"<div class='share social'>{links(2, 4)}</div>", sidebar):
            if r.random() < 0.12:
                inner.insert(r.randint(0, len(inner)), part())
        if r.random() < 0.1:
            inner.append(comments())
        t = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        main = f"<{t}{attributes(['content', 'article', 'post', 'entry-content', 'main', 'story'], 0.5 if t in ('article', 'main') else 0.15)}>{''.join(inner)}</{t}>"
        before = [p() for p in (head, menu, advert, notice, sidebar, form) if r.random() < 0.4]
        after = [p() for p in (sidebar, comments, advert, foot, foot, form) if r.random() < 0.4]
        if r.random() < 0.3:
            main = f"<div{attributes(['wrapper', 'container', 'page', 'layout'])}>{main}{sidebar() if r.random() < 0.5 else ''}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main}{''.join(after)}"
        pages.append(page + ("</body></html>" if r.random() < 0.8 else ""))
    return pages


def fit(count: int = PAGES) -> Boosted:
    xs, ys, ws = [], [], []
    for source in sample_pages(count):
        page = Page(source)
        inside, outside = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        marked = {b for _, t, b in page.pieces if MARKED in t}
        page.pieces = [(e, t.replace(MARKED, ""), b) for e, t, b in page.pieces]
        for e, t, b in page.pieces:
            if t.strip():
                (inside if b in marked else outside)[e] += 1
        for e in range(len(page.tag) - 1, 0, -1):
            inside[page.parent[e]] += inside[e]
            outside[page.parent[e]] += outside[e]
        x = features(page)
        for label, own in ((1, inside > 0), (0, outside > 0)):  # a mixed element counts half for either
            xs.append(x[own])
            ys.append(np.full(own.sum(), label))
            ws.append(np.where((inside > 0) & (outside > 0), 0.5, 1.0)[own])
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_text(source: str | None, model: Boosted) -> str:
    return extract_all([source], model)[0]


def extract_all(sources: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    rows = [features(p) for p in pages]
    p = model.probability(np.concatenate(rows))
    out, at = [], 0
    for page, x in zip(pages, rows):
        keep = decode(page, x[:, FEATURES.index("length")] * (x[:, FEATURES.index("share_of_text")] > 0), p[at : at + len(x)])
        out.append(" ".join(page.blocks(keep)))
        at += len(x)
    return out


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), model: Boosted | None = None) -> DataFrame:
    """`columns`, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # as many trees for any corpus
    kinds = dict(pages.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 1 << 19):
                texts = extract_all(batch.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    return pages.select(*columns, "html").mapInArrow(apply, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "text string", "n_chars bigint"]))
