"""Main text of web pages: the maximum-scoring contiguous run of a page's tokens.

A page is a row of words and tags. A word's kind is the part of the page that it stands in: a content element, a menu,
header, footer or sidebar, a container with a known name, or none of these; a tag's kind is its name. Weights are
log-odds of the kinds in labelled pages: words of the main text score positive, words of other parts and all tags
negative. One linear scan finds the run with the largest sum, and the words in it that score positive are the text.
Named parts inside a content element are holes that the run passes for nothing, as they may be longer than what
follows them. Only scripts, styles, forms and what is hidden are left out by rule. Where a page without content
elements would have most of its words in parts that score negative by their names, the names are not looked at.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.frames import arrow_schema, column, map_rows, record

#: A tag with quoted attributes, a comment, a declaration, or a lone "<" as text.
_tag = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
#: A tag whose quotes don't match.
_loose = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)")
_attribute = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_no_display = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

#: Elements whose content is no text.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas select option datalist button xmp noembed noframes".split())
SKIPPED = frozenset("head form fieldset label legend".split())
#: Elements that are a part of the page by themselves.
PARTS = frozenset("nav header footer aside menu dialog".split())
#: Elements that names can make a part; headings, paragraphs and inline elements are left as they are.
CONTAINERS = frozenset("div section ul ol dl table center figure details".split())
CONTENT = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag's weight is this share of a main-text word's below zero, at least.
TAG_COST = 0.05

Token = tuple[str, str]  # "<p", "</p", ... and the part of the page that it stands in; or "@" and that part, and the text


def attributes_of(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed([*_attribute.finditer(text)])}


def names_of(values: dict[str, str]) -> Iterator[str]:
    """Whole class names, ids, roles and labels of an element."""
    for k in ("id", "class", "role", "aria-label"):
        yield from values.get(k, "").lower().replace("_", "-").split()


def tokens(page: str, names: frozenset[str] | set[str] | None) -> list[Token]:
    """Tags and the text between them; scripts, styles, forms and hidden elements are left out.

    ``names``: container names that make a part of the page; None: any name does.
    """
    out: list[Token] = []
    # open containers, parts and content elements: name and the part that their text belongs to
    open_: list[tuple[str, str]] = []
    at, skipping, depth, seen_content = 0, "", 0, False
    size = len(page)
    while at < size:
        found = page.find("<", at)
        if found < 0:
            found = size
        match = (_tag.match(page, found) or _loose.match(page, found)) if found < size else None
        part = open_[-1][1] if open_ else ""
        if found > at and not skipping:
            out.append((f"@{part}", page[at:found]))
        if match is None:
            if found < size and not skipping:
                out.append((f"@{part}", "<"))
            at = found + 1
            continue
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        closing = match[1] == "/"
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name not in ("select", "option", "button", "textarea", "datalist"):
                at = size
            continue
        if skipping:
            if name in CONTENT and not closing and not seen_content:
                skipping = ""  # what is skipped was never closed
            else:
                if name == skipping:
                    depth += -1 if closing else 1
                    if not depth:
                        skipping = ""
                continue
        values = attributes_of(match[3]) if match[3] and not closing else {}
        if not closing and name not in VOID and (name in SKIPPED or name not in CONTENT and name not in ("html", "body") and ("hidden" in values or _no_display.search(values.get("style", "")))):
            skipping, depth = name, 1
            out.append(("<-", ""))
            continue
        if closing:
            out.append((f"</{name}", part))
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        elif name in CONTENT:
            # a part before the first content element may never have been closed
            open_.append((name, part if part.startswith(("aside", "footer")) else "content" if not seen_content or part in ("", "content") else part))
            seen_content = True
        elif name in PARTS or name in CONTAINERS:
            where = "in" if part == "content" or part.endswith("|in") else "out"
            if name in PARTS:
                own = f"{name}|{where}"
            else:
                own = next((f".{n}|{where}" for n in names_of(values) if names is None or f".{n}|{where}" in names), part)
            open_.append((name, own))
        if not closing:
            out.append((f"<{name}", open_[-1][1] if open_ else ""))
    if seen_content:
        out = [("@beside", text) if kind == "@" else (kind, text) for kind, text in out]
    return out


#: What the labelled pages are made of: texts, and names of containers that hold no main text.
SENTENCES = (
    "They went down to the shore before the sun rose.", "Food and fuel cost more than in any month of the year before.", "Take the wheel out and look for the hole with some water.",
    "The guests had more of the ball and yet lost.", "We did not expect this so soon, she said.", "You need two levers and a pump.", "Bread and cheese came from the farm.",
)
LINKS = ("Home", "Topics", "Sign in", "Sport", "Contact us", "All rights reserved", "Terms of use", "Follow us", "Read more")
ANYWHERE = (
    "ad ads advert adverts advertisement adsense ad-banner ad-container ad-slot ad-wrapper sponsored comments comment-list comments-area disqus-thread "
    "cookie-notice cookie-banner cookie-consent cookie-bar gdpr share-buttons social-share social-links navbar breadcrumb breadcrumbs pagination sidebar "
    "newsletter-signup related-posts related-articles site-header site-footer"
).split()
OUTSIDE = (
    "nav navigation menu menubar main-nav site-nav sidenav side-nav pager header page-header masthead topbar footer page-footer bottombar banner cookie cookies consent notice notices "
    "popup modal overlay promo promotion sponsor advertising widget comment reply replies disqus respond share sharing social newsletter subscribe subscription signup login toolbar disclaimer copyright"
).split()


def labelled_pages(seed: int = 7, copies: int = 3) -> Iterator[str]:
    """Pages whose main text stands between marks, \\x02 before and \\x03 after each piece.

    Every name stands outside the main text a few times; those that content elements may use for sections of their
    own also stand inside it. Half of the pages have a content element.
    """
    r = random.Random(seed)
    said = lambda n: " ".join(r.choices(SENTENCES, k=n))
    links = lambda: "".join(f"<li><a href='/{k}'>{r.choice(LINKS)}</a></li>" for k in range(r.randint(2, 6)))
    # a name makes a container a part; one that is met inside the main text as well speaks for neither
    boiler = lambda tag, extra="": f"<{tag}{extra}>" + r.choice((f"<ul>{links()}</ul>", f"<p>{r.choice(LINKS)}</p>", said(1), f"<div>{said(2)}</div>")) + f"</{tag}>"
    named = lambda n: boiler(r.choice(("div", "section", "ul")), f" class='{n}'")
    plain = lambda: f"<div><ul>{links()}</ul></div><div><p>{r.choice(LINKS)}</p></div><table><tr><td><a href='/'>{r.choice(LINKS)}</a></td></tr></table>"

    def main(inner: list[str]) -> str:
        """Paragraphs as main text with parts between them that are not."""
        out = [f"\x02<h1>{said(1)}</h1>"]
        for k in range(r.randint(3, 7)):
            out.append(r.choice((f"<p>{said(2)}</p>", f"<p>{said(1)}<br>{said(1)} <b>{said(1)}</b></p>", f"<ul><li>{said(1)}</li><li>{said(1)}</li></ul>", f"<h2>{said(1)}</h2><p>{said(3)}</p>", f"<blockquote><p>{said(1)}</p></blockquote>", f"<div>{said(2)} <a href='/x'>{said(1)}</a></div>")))
            if k < len(inner):
                out.append("\x03" + inner[k] + "\x02")
        return "".join(out) + "\x03"

    for _ in range(copies):
        everything = [named(n) for n in (*ANYWHERE, *OUTSIDE)] + [boiler(t) for t in sorted(PARTS)] * 4
        within = [named(n) for n in ANYWHERE] + [boiler(t) for t in sorted(PARTS)]
        r.shuffle(everything)
        r.shuffle(within)
        while everything:
            around, everything = everything[:3], everything[3:]
            inner, within = within[:2], within[2:]
            content = r.choice(("article", "main"))
            own = "".join(f"<section class='{n}'>{said(2)}</section>" for n in r.sample(OUTSIDE, 12))
            yield f"<html><body>{''.join(around)}{plain()}<{content}>{main(inner)}\x02{own}\x03</{content}>{plain()}</body></html>"
            box = r.choice(("div", "section", "td"))
            yield f"<html><body>{plain()}{''.join(around)}<{box}>{main([])}</{box}>{plain()}</body></html>"


@lru_cache(1)
def fit_weights() -> dict[str, float]:
    """Log-odds of each kind of token in the main text of the labelled pages against the rest.

    Words are compared with words and tags with tags. Tags come out negative or are held a little below zero, so
    markup alone never pays. The empty kind is the weight of tags that no labelled page has.
    """
    inside, outside = Counter(), Counter()
    for page in labelled_pages():
        main = False
        for kind, piece in tokens(page, None):
            for k, run in enumerate(re.split("([\x02\x03])", piece) if not kind.startswith("<") else [piece]):
                if run in ("\x02", "\x03"):
                    main = run == "\x02"
                else:
                    (inside if main else outside)[kind] += len(run.split()) if kind.startswith("@") else 1
    weights = {}
    for sign in "@<":
        kinds = [k for k in inside.keys() | outside.keys() if k.startswith(sign)]
        total_in, total_out = sum(inside[k] for k in kinds), sum(outside[k] for k in kinds)
        weights |= {k: math.log((inside[k] + 0.5) / total_in) - math.log((outside[k] + 0.5) / total_out) for k in kinds}
    word = max(weights["@"], 0.1)
    weights["@"] = word
    weights = {k: v if k.startswith("@") else min(v, -TAG_COST * word) for k, v in weights.items()}
    return weights | {"": min(v for k, v in weights.items() if not k.startswith("@")) / 2}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, empty if no sum is positive; the first of ties."""
    best, at, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at, end = total, start, i + 1
    return at, end


def words_in(found: list[Token]) -> int:
    return sum(len(text.split()) for kind, text in found if kind.startswith("@"))


def main_text(page: str, weights: dict[str, float]) -> str:
    names = frozenset(k[1:] for k in weights if k.startswith("@."))
    found = tokens(page, names)
    if not any(kind[1:] in CONTENT for kind, _ in found):
        against = sum(len(text.split()) for kind, text in found if kind.startswith("@.") and weights[kind] < 0)
        if 2 * against > words_in(found):
            found = tokens(page, frozenset())
    other, plain = weights[""], weights["@"]
    scores = []
    for kind, text in found:
        part = kind[1:] if kind.startswith("@") else text
        if part.endswith("|in") and weights.get(f"@{part}", plain) < 0:
            scores.append(0.0)  # a hole in a content element
        else:
            scores.append(weights.get(kind, plain) * len(text.split()) if kind.startswith("@") else weights.get(kind, other))
    start, end = best_run(scores)
    blocks: list[list[str]] = [[]]
    for kind, text in found[start:end]:
        if not kind.startswith("@"):
            if kind == "<-" or kind.strip("</") in BLOCKS:
                blocks.append([])
        elif weights.get(kind, plain) > 0:
            blocks[-1].append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page; the text is empty if the html is null, empty or without main text.

    Rows keep their number; ids and urls may be null or repeat, other columns are not read.
    """
    weights = weights or fit_weights()
    schema = "page_id long, url string, text string, n_chars long"
    target = arrow_schema(pages.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", weights) for x in column(batch, "html").to_pylist()]
            yield record({"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": texts, "n_chars": list(map(len, texts))}, target)

    return map_rows(pages.select("page_id", "url", "html"), rows, schema)
