"""HTML main-text extraction from flat text blocks.

A page is cut into text blocks at block-level tags. Each block has its word count and link
density, and those of the blocks before and after it. These alone can't tell a short notice
from a short paragraph, so a block also has what it stands in: whether it is a heading, whether
an article or main element or one of the elements for what surrounds it holds it, and how
its enclosing elements are named. What a name says isn't written down here: it is learned,
word by word, from the labelled table, as the log of how often blocks under it are the
article's and how often not. A decision tree trained on the same table keeps the blocks of
the article.

Defined results: a null html is empty; an empty page has an empty text. Scripts, styles,
comments and form controls never make blocks; formulas, drawings' labels, and what stands
in for scripts or objects are text like any other. Unclosed elements and comments run
to the end of the page. White space in a block becomes one space; blocks are joined by \\n
in page order, none dropped for its length. Rows that repeat get equal results. Other
columns are read only if asked for, so their names can't clash.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, worker_cache

#: Elements that end a block where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page: code, form controls, what stands in for media.
RAW = frozenset("title script style template textarea iframe canvas audio video noembed noframes select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that by the standard hold what surrounds an article.
AROUND = frozenset("nav aside footer form menu button fieldset dialog search legend".split())
_WORD = re.compile(r"[a-z]+")
_TAG = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WITH = re.compile(r"\b(?:with|has|no|without)[-_]?\w+")

#: What the tree sees of each block, and of the blocks before and after it.
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "around", "worst_name", "last_name"]


def _says(tag: str, rest: str, held: bool) -> tuple[bool, bool, tuple]:
    """(whether an element is for what surrounds an article, whether it is for one, the names in
    its class, id and role, each as its words). held: whether it is in an article, whose header is part of it."""
    around, names = tag in AROUND or tag == "header" and not held, set()
    for name, value in _ATTRIBUTE.findall(rest) if rest.strip(" /") else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            around = True
        elif name == "style":
            around |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role"):
            names.update(tuple(_WORD.findall(v)) for v in _WITH.sub(" ", _CAMEL.sub("-", value).lower()).split())
    return around, tag in ("article", "main"), tuple(sorted(names - {()}))


def blocks(page: str) -> list[tuple]:
    """(text, words, words in links, heading, article, around, names) of each text block.
    names: those of each enclosing element inside the innermost article or main element."""
    out, parts, linked = [], [], []
    # element, then what is said of it and all that it is under: heading, article, around, names
    stack: list[tuple] = []
    in_link, at, n = 0, 0, len(page)

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            link = _SPACE.sub(" ", html.unescape(" ".join(linked))).strip()
            out.append((text, text.count(" ") + 1, link.count(" ") + 1 if link else 0, *(stack[-1][1:] if stack else (False, False, False, ()))))
        parts.clear()
        linked.clear()

    def text_to(end: int) -> None:
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked.append(page[at:end])

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text_to(n)
            break
        text_to(m.start())
        opens = m.group()
        if opens == "<!--":
            end = page.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        m_end = _TAG_END.match(page, m.start() + 1)
        end = m_end.end() if m_end else page.find(">", m.start()) + 1
        if not end:
            at = n
            continue
        at = end
        name = _NAME.match(page, m.start() + (2 if opens[1] == "/" else 1))
        if not name or opens in ("<!", "<?"):
            continue
        tag = name.group().lower()
        if opens[1] == "/":
            if tag in BLOCK:
                close()
            if tag == "a":
                in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if (tag in RAW or tag == "xmp") and page[at - 2] != "/":
            ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "xmp":  # what is in it is shown as it is written
                close()
                parts.append(html.escape(page[at : ends.start() if ends else n]))
                close()
            if ends or tag in ("script", "style", "textarea", "xmp"):
                at = ends.end() if ends else n
                continue
        if tag in BLOCK:
            close()
        if tag == "a":
            in_link = 1
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            stack.pop()  # these end where the next one begins
        if tag == "body":
            stack.clear()
        under = stack[-1][1:] if stack else (False, False, False, ())
        around, article, names = _says(tag, page[name.end() : end - 1], under[1]) if tag not in ("html", "body") else (False, False, ())
        around |= under[2]
        before = () if article and not around else under[3]
        stack.append((tag, under[0] or tag in HEADINGS, article or under[1], around, (*before, names) if names else before))
    close()
    return out


def _scores(names: tuple, weights: dict) -> tuple[float, float]:
    """What the names of the enclosing elements say at worst, and what the last one says. A name
    says the mean of its words' weights, and nothing if a word isn't in the table: a
    share-price isn't a share bar."""
    said = []
    for element in names:
        known = [sum(weights[w] for w in words) / len(words) for words in element if all(w in weights for w in words)]
        said += [max(known, key=abs)] if known else []
    return (min(said), said[-1]) if said else (0.0, 0.0)


def features(found: list[tuple], weights: dict | None = None) -> np.ndarray:
    weights = worker_cache("html names", lambda: name_weights(_labelled())) if weights is None else weights
    x = np.zeros((len(found), len(FEATURES)))
    for i, (_, words, linked, heading, article, around, names) in enumerate(found):
        x[i, :2] = min(words, 200), linked / words
        x[i, 6:] = heading, article, around, *_scores(names, weights)
    if len(found) > 1:
        x[1:, 2:4] = x[:-1, :2]
        x[:-1, 4:6] = x[1:, :2]
    return x


def name_weights(pages: list[str]) -> dict[str, float]:
    """Of each word in the names of elements, how much more often blocks under it are the
    article's than not, as a logarithm."""
    n: dict[str, list[int]] = {}
    for page in pages:
        for b in blocks(page):
            for word in {w for element in b[6] for words in element for w in words}:
                n.setdefault(word, [0, 0])[b[0].startswith("=")] += 1
    return {w: float(np.log((yes + 0.5) / (no + 0.5))) for w, (no, yes) in n.items()}


# --- Decision tree ---------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A tree by Gini impurity: (feature, threshold, low, high), or the share of positives."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            k = int(low.sum())
            if min(k, len(y) - k) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def keeps(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def _labelled() -> list[str]:
    """The labelled table: made-up pages. A block of the article starts with `=`; all others
    belong to what surrounds it."""
    def words(n: int, word: str = "word") -> str:
        return " ".join([word] * n) + "."

    def own(n: int) -> str:
        return "=" + words(n)

    def links(*names: str) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{v}</a></li>" for i, v in enumerate(names)) + "</ul>"

    menu = links("Home", "News", "All our topics", "About")

    def around(n: int, k: int) -> list[str]:
        """One of each kind of surroundings, with the k-th of its usual names."""
        note, of = words(n, "notice"), lambda names: names.split()[k % len(names.split())]
        talk = f"<div><b>Ann</b><p>{words(n, 'reply')}</p><p>Yes.</p></div><div><p>{words(n // 2 + 3, 'reply')}</p></div>"
        return [
            f"<nav>{menu}</nav>",
            f'<div class="{of("menu navbar main-nav top-navigation breadcrumbs")}">{menu}</div>',
            f'<div class="{of("ad advert ads-top advertisement sponsored promo")}">{note}</div>',
            f'<aside class="{of("aside info box note side")}">{note}</aside>',
            f'<div class="{of("sidebar side-column rail widget sidebar-right")}"><h3>Popular</h3>{menu}<p>{note}</p></div>',
            f'<header class="{of("top masthead site-header head banner")}"><p>Site name</p><p>{note}</p></header>',
            f'<div id="{of("header masthead site-header banner page-header")}"><p>Site name</p><p>{words(6, "slogan")}</p></div>',
            f"<form><p>Search here</p><label>{note}</label></form>",
            f'<section class="{of("comments discussion comment-list responses reader-comments")}"><h2>Comments</h2>{talk}</section>',
            f'<div class="{of("newsletter newsletter-signup subscribe subscription-box signup")}">{note}</div>',
            f'<div id="{of("related recommended related-links related-posts trending")}"><h3>Read on</h3>{menu}</div>',
            f"<footer>&copy; site {note}</footer>",
            f'<div class="{of("footer site-footer foot bottom-footer page-footer")}"><p>&copy; site</p><p>{note}</p></div>',
            f'<div id="{of("cookie-notice cookies consent gdpr-banner notice")}"><p>{note}</p></div>',
            f'<div class="{of("share social share-buttons social-links share-bar")}"><a href="/s">Share</a> <a href="/m">Mail</a></div>',
            f'<div role="{of("alert dialog complementary banner contentinfo")}"><p>{note}</p></div>',
            f'<div class="{of("popup modal overlay popup-box login")}"><p>{note}</p><p>Close</p></div>',
        ]

    sizes = [2, 4, 9, 14, 25, 40, 60, 90]
    bodies = [
        f"<h1>=A title</h1><p>{own(60)}</p><p>{own(1)}</p><p>{own(18)}</p><h2>=Part</h2><p>{own(1)}</p><p>{own(70)}</p>",
        f"<h1>=A title of six words here</h1><p>{own(30)}</p><ul><li>=item one</li><li>=item two of the list</li></ul><p>{own(8)}</p>",
        f"<p>{own(90)}</p><blockquote>{own(15)}</blockquote><p><a href='/l'>=linked words</a></p><p>{own(45)}</p>",
        f"<h1>=Short</h1><p>{own(3)}</p><p>{own(6)}</p>",
        f"<h1>=A title</h1><p>{own(120)}</p>",
        f"<h1>=Title</h1><p>=One.</p><p>=Two.</p><p>{own(12)}</p><p>=Three.</p>",
        f"<header><h1>=A title</h1><p>=By someone</p></header><div class='text'><p>{own(33)}</p></div><figure><figcaption>{own(7)}</figcaption></figure><p>{own(2)}</p>",
    ]
    wraps = ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', "<article><p><b>{}</article>", '<div class="entry story">{}</div>', '<div class="article-body">{}</div>']
    pages = []
    for i, wrap in enumerate(wraps):
        for j, n in enumerate(sizes):
            parts = around(n, i + j)
            for k in range(0, len(parts), 3):
                # every third page has something of its surroundings within its article
                inside = parts[(k + 8) % len(parts)] if (i + j + k) % 3 == 0 else ""
                article = wrap.format(bodies[(j + k) % len(bodies)] + inside + (f"<p>{own(n)}</p>" if inside else ""))
                pages.append(f"<html><head><title>T</title></head><body>{parts[k]}{article}{parts[(k + 3 + i) % len(parts)]}{parts[(k + 7) % len(parts)]}</body></html>")
            # the article alone, and last on its page
            alone = wrap.format(bodies[(i + j) % len(bodies)])
            pages += [f"<body>{alone}</body>", alone, f"<body>{parts[(i + j) % 2]}{wrap.format(bodies[5])}{parts[11 + j % 2]}</body>", f"<html><body>{parts[(i + j) % len(parts)]}{alone}</body></html>"]
    # pages without a sign of where the article is: long blocks without links, and what is among them
    for j, n in enumerate(sizes):
        for body in bodies[:1] + bodies[4:5]:
            last = around(n, j)[(j + n) % 17]
            pages.append(f"<html><body>{menu}<div>{body}<p>{own(40)}</p></div>{menu if j % 2 else ''}{last}</body></html>")
            # nor of what surrounds it: there, short blocks stand among links, or last
            before = f"<div>{words(3, 'site')}</div><div>{menu}</div><div>{words(5, 'slogan')}</div><div><a href='/m'>Menu</a></div>"
            after = f"<div><a href='/s'>Share</a> <a href='/m'>Mail</a></div><div>{words(2 + j % 3, 'rights')}</div><div>{menu}</div><div>{words(4 + j % 3, 'site')}</div>"
            pages.append(f"<html><body>{before}<div>{body}<p>{own(n)}</p><p>{own(35)}</p></div>{after}</body></html>")
            pages += [f"<h1>=A title</h1><p>{own(n)}</p><p>{own(50)}</p>", f"<p>{own(n + 20)}</p>"]
            pages.append(f"<html><body><table><tr><td>{menu}</td><td>{body}</td></tr></table><p><a href='/x'>Back to the start page</a></p>{last}</body></html>")
    return pages


def train(pages: list[str]):
    """(weights of names, tree) of labelled pages; nothing is random, so they are the same everywhere."""
    weights = name_weights(pages)
    found = [blocks(page) for page in pages]
    x = np.concatenate([features(f, weights) for f in found])
    return weights, grow(x, np.array([b[0].startswith("=") for f in found for b in f], float))


def tree():
    """The tree of the labelled table."""
    return train(_labelled())[1]


def main_text(page: str | None, model) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, features(found)) if keeps(model, row)) if found else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, and text and n_chars, of each row of ``pages``."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        model = worker_cache("html tree", tree)
        for batch in batches:
            texts = [main_text(t.as_py(), model) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)
