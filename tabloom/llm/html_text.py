"""Main text of web pages by a maximum-scoring subsequence.

A page becomes one sequence of tags and words. Every item has a score, words of running text above zero, tags and
words of links mostly below; the best contiguous region of the sequence is found by one scan that keeps the best sum so
far. The blocks of that region are the text, without subtrees whose element or class names say that they are
not content (menus, forms, notices, adverts, comments, ...): those score nothing and are never given out. A form or
an element with such a name is a wrapper of the page, and not left out, if it holds ``main`` or an ``article`` that has no such
name itself; a form, or an element whose name has other words too (``has-sidebar``), also if it holds most of the page's words.
Elements named after comments are wrappers only around ``main`` or around the first article if that has a heading, and adverts
never by their words: a long thread is not the text. Inside an article fewer names count, and an id only as a whole, as sections
are named after their subject; and a region that touches an article takes in all of it.

Scores are log odds of lying inside the content, learned from labelled pages: the few in ``html_samples`` and a bounded
sample of the given pages that label themselves by exactly one ``article`` element. Each labelled page is counted
twice, with the place of its items relative to ``article`` or ``main`` and without, so pages with neither are read by
the same scores.

Defined cases: null or empty html and pages without words give the empty text; unclosed and stray tags end where the
next block or the enclosing element ends; a comment, script or style without end runs to the end of the page;
ties between regions go to the first; nothing is cut off or left out by length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import map_rows

SAMPLE = 2000
SEED = 5
#: The built-in labelled pages count as much as so many of the table's.
SAMPLE_WEIGHT = 20

_token = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|object|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S | re.I)
_named = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_hidden = re.compile(r"""aria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|display\s*:\s*none)""", re.I)
_values = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
_bare_hidden = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span "
    "strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
APART = set("nav footer aside form menu button dialog head input select option fieldset video audio canvas map".split())
#: Words of class, id and role names that say the same of any element.
APART_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion promotions banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar sidebars side aside rail widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies "
    "discussion footer foot masthead topbar toolbar newsletter subscribe subscription signup login search searchbox skip complementary "
    "contentinfo navigation tags metadata copyright legal disclaimer outbrain taboola".split())
#: Those of them that make no wrapper by holding many words.
COMMENT_NAMES = set("comment comments commentlist disqus respond reply replies discussion".split())
ADVERT_NAMES = set("ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion promotions outbrain taboola".split())
#: Those that count inside an article, where the others may name a subject.
STRICT_NAMES = ADVERT_NAMES | set(
    "banner cookie cookies consent gdpr popup modal overlay sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended recommendations comment comments commentlist disqus respond replies newsletter subscribe "
    "subscription signup login".split())
#: Elements whose class names do not count: they hold the page.
WHOLE = {"html", "body", "article", "main"}
#: Formatting inside running text costs nothing.
FREE = INLINE - {"a"}
LISTS = set("ul ol li dl dt dd".split())
TAGS = INLINE | set(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th section article main header footer nav aside form blockquote pre "
    "figure figcaption address center html body head hr details summary".split())
#: An opening tag ends the open elements named with it, up to the nearest of the boundary elements.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def hides(rest: str) -> bool:
    """Whether a tag hides its element: the bare attribute, aria-hidden or display:none."""
    return bool(_hidden.search(rest) or "hidden" in rest.lower() and _bare_hidden.search(_values.sub("= ", rest)))


def names_of(name: str, rest: str) -> list[tuple[bool, list[str]]]:
    """(whether it is the id, its words) of every class, id and role name; the ids of headings name their subject."""
    return [(m[1].lower() == "id", [p.lower() for p in _parts.findall(token)]) for m in _named.finditer(rest)
            if name not in HEADS or m[1].lower() != "id" for token in (m[2] or m[3] or m[4] or "").split()]


def named_apart(name: str, rest: str, inside: bool = False) -> bool:
    """Whether the words of class, id or role say that the element is no main text; ``inside`` an article fewer count."""
    if not inside:
        return any(p in APART_NAMES for _, parts in names_of(name, rest) for p in parts)
    return any((all if of_id else any)(p in STRICT_NAMES for p in parts) for of_id, parts in names_of(name, rest) if parts)


#: How an element that is apart may yet be a wrapper: never, around the article, around the first article with a heading, by its words.
NEVER, AROUND, HEADED, BY_WORDS = range(1, 5)


def apart(name: str, rest: str, inside: bool = False) -> int:
    """0 for an element that may be main text, else in what case it is a wrapper."""
    if name in APART:
        return BY_WORDS if name == "form" and not hides(rest) else NEVER
    if name in WHOLE or not rest.strip():
        return 0
    if hides(rest):
        return NEVER
    if not named_apart(name, rest, inside):
        return 0
    named = [parts for _, parts in names_of(name, rest) if any(p in APART_NAMES for p in parts)]
    words = {p for parts in named for p in parts}
    if words & COMMENT_NAMES:
        return HEADED
    return AROUND if words & ADVERT_NAMES or any(all(p in APART_NAMES for p in parts) for parts in named) else BY_WORDS


def items(page: str | None, label: str | None = None, wrappers: frozenset[int] | None = None) -> list[tuple]:
    """(feature, number of items, text or None, whether it starts a block, scope, labelled inside) in page order.

    Feature None: inside a subtree that is apart. Scope: 2 inside ``article``, 1 inside ``main`` only, else 0. ``label``: an
    attribute that marks labelled content; without it the content is what lies in ``article``. ``wrappers``: where the
    tags of wrappers start, which are not apart; found by a scan before.
    """
    out: list[tuple] = []
    stack: list[list] = []  # name, apart, scope, link, labelled, surely apart, note of a form or named element
    blocks: list[int] = []  # places of the open elements that are no formatting
    open_: Counter = Counter()  # how many elements of a name are open
    notes: list[list[int]] = []  # place of the tag, words before, words up to the end, place of the end, case
    cores: list[int] = []  # places of main and of articles without such a name
    mains: list[int] = []
    first: int | None = None  # place of the first article, and of the first one if that has a heading
    headed: int | None = None
    counted = 0  # words that are not surely apart
    page = page or ""
    at = 0
    fresh = True

    def words(text: str) -> None:
        nonlocal counted
        n = len(text.split())
        if not n and not text:
            return
        top = stack[-1] if stack else ("", False, 0, False, False)
        counted += 0 if stack and top[5] else n
        feature = None if top[1] else "word:link" if top[3] else "word:head" if any(s[0] in HEADS for s in stack[-3:]) else "word"
        out.append((feature, n, text, fresh, top[2], top[4]))

    def close(k: int, place: int) -> None:
        for s in stack[k:]:
            if s[6]:
                s[6][2:4] = counted, place
            open_[s[0]] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    for m in _token.finditer(page):
        if m.start() > at:
            words(entities.unescape(page[at:m.start()]))
            fresh = False
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, rest = name.lower(), m["rest"]
        block = name not in INLINE
        kind = name if name in TAGS else "other"
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if open_[name] else None
            top = stack[-1] if stack else ("", False, 0, False, False)
            out.append((None if top[1] else f"/{kind}", 1, None, False, top[2], top[4]))
            if k is not None and (block or not blocks or blocks[-1] <= k):
                close(k, m.start())
        else:
            if block:  # a new block ends an open paragraph and formatting left open in it
                if blocks and stack[blocks[-1]][0] in ENDED:
                    close(blocks[-1], m.start())
            if name in ENDS:
                own, edge = ENDS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in edge:
                        break
                    if stack[i][0] in own:
                        close(i, m.start())
                        break
            top = stack[-1] if stack else ("", False, 0, False, False)
            within = max(top[2], {"article": 2, "main": 1}.get(name, 0))
            kept_out = apart(name, rest, top[2] == 2)
            note = [m.start(), counted, counted, m.start(), kept_out] if kept_out > NEVER else None
            sure = bool(stack and top[5]) or kept_out == NEVER or (name == "header" and not top[2])
            if not sure and (name == "main" or name == "article" and not named_apart(name, rest)):
                cores.append(m.start())
                if name == "main":
                    mains.append(m.start())
                elif first is None:
                    first = m.start()
            if name in HEADS and headed is None and top[2] == 2 and len(cores) - len(mains) == 1:
                headed = first
            gone = top[1] or sure or (kept_out > NEVER and m.start() not in (wrappers or ()))
            marked = top[4] or (name == "article" if label is None else label in rest)
            out.append((None if gone else kind, 1, None, False, within, marked))
            if name not in VOID and not rest.endswith("/"):
                if block:
                    blocks.append(len(stack))
                open_[name] += 1
                stack.append([name, gone, within, top[3] or name == "a", marked, sure, note])
                if note:
                    notes.append(note)
        if name == "br":
            out.append((None, 0, " ", False, stack[-1][2] if stack else 0, False))
        fresh = fresh or block
    if at < len(page):
        words(entities.unescape(page[at:]))
    if wrappers is None and notes:
        close(0, len(page))
        around = {AROUND: cores, BY_WORDS: cores, HEADED: mains if headed is None else [*mains, headed]}
        found = frozenset(a for a, before, upto, b, case in notes
                          if case == BY_WORDS and 2 * (upto - before) > counted or any(a < c < b for c in around[case]))
        if found:
            return items(page, label, found)
    return out


HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that end where any block begins.
ENDED = {"p", *HEADS}


def scoped(found: list[tuple]) -> bool:
    return any(i[4] and i[0] is not None for i in found)


def count_labelled(page: str | None, label: str | None = None) -> dict[tuple[str, bool], int]:
    """Items of a labelled page by (feature with and without scope, inside the content)."""
    found, out = items(page, label), {}
    has = scoped(found)
    for feature, n, _, _, within, inside in found:
        if feature is None or feature.lstrip("/") in ("article", "main"):
            continue
        views = [f"{feature}|none"] + ([f"{feature}|{'in' if within else 'out'}"] if has else [])
        for view in views:
            out[view, inside] = out.get((view, inside), 0) + n
    return out


def weights(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log odds of every feature, for tags moved down and for words up so that tags cost and words earn."""
    out = {}
    for feature in {f for f, _ in counts}:
        inside, outside = counts.get((feature, True), 0) + 1, counts.get((feature, False), 0) + 1
        odds = math.log(inside / outside)
        if feature.startswith("word"):
            out[feature] = max(-4.0, min(1.0, odds))
        elif feature.split("|")[0].lstrip("/") in FREE:
            out[feature] = 0.0
        elif feature.split("|")[0].lstrip("/") in LISTS:  # a list of links costs by its links
            out[feature] = max(-0.4, min(0.0, odds - 1.0))
        else:
            out[feature] = max(-4.0, min(0.0, odds - 1.0))
    return out


def default_weights() -> dict[str, float]:
    return weights(sample_counts())


def sample_counts() -> dict[tuple[str, bool], float]:
    from tabloom.llm.html_samples import LABEL, PAGES

    out: dict = {}
    for page in PAGES:
        for k, n in count_labelled(page, LABEL).items():
            out[k] = out.get(k, 0) + n
    return out


def extract(page: str | None, scores: dict[str, float]) -> str:
    """The blocks of the best region, joined by an empty line."""
    found = items(page)
    has = scoped(found)
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, (feature, n, _, _, within, _) in enumerate(found):
        if feature is None:
            continue
        scope = ("in" if within else "out") if has else "none"
        score = scores.get(f"{feature}|{scope}")
        if score is None:
            word, free = feature.startswith("word"), feature.lstrip("/") in FREE
            score = (1.0 if scope != "out" else -2.0) if word else 0.0 if free else -1.0
        if total <= 0:
            total, start = 0.0, i
        total += n * score
        if total > best:
            best, best_from, best_to = total, start, i + 1
    if best_to:  # an article that the region touches belongs to it whole
        while best_from and found[best_from][4] == 2 and found[best_from - 1][4] == 2 and found[best_from][0] != "article":
            best_from -= 1
        while best_to < len(found) and found[best_to - 1][4] == 2 and found[best_to][4] == 2 and found[best_to][0] != "article":
            best_to += 1
    number, of_block = 0, []
    for _, _, text, fresh, _, _ in found:
        number += text is not None and fresh
        of_block.append(number)
    # a block belongs to the region whole, also what lies behind tags that cost
    within = {of_block[i] for i in range(best_from, best_to) if found[i][2] is not None and found[i][0] is not None}
    blocks: dict[int, list[str]] = {}
    for (feature, _, text, _, _, _), block in zip(found, of_block, strict=True):
        if text is not None and block in within and (feature is not None or text == " "):
            blocks.setdefault(block, []).append(text)
    made = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(b for b in made if b)


# ---- tables -----------------------------------------------------------------------------------


def train(pages: DataFrame, sample: int = SAMPLE, seed: int = SEED, page_id: str = "page_id", html: str = "html") -> dict[str, float]:
    """Scores from the built-in pages and a sample of about ``sample`` pages with exactly one article element."""
    labelled = pages.select(F.col(f"`{page_id}`").alias("_id"), F.col(f"`{html}`").alias("_html")).where(
        F.size(F.split(F.lower("_html"), r"<article[\s>]")) == 2)
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("_id").cast("string")), F.lit(1 << 30))
    n = labelled.count()
    total = {k: v * SAMPLE_WEIGHT for k, v in sample_counts().items()}
    if not n:
        return weights(total)

    def count(frames):
        out: dict = {}
        for frame in frames:
            for page in frame["_html"]:
                for k, v in count_labelled(page).items():
                    out[k] = out.get(k, 0) + v
        yield pd.DataFrame([(f, i, v) for (f, i), v in out.items()], columns=["feature", "inside", "n"])

    chosen = labelled.where(spread < int(min(1, sample / n) * (1 << 30))).select("_html")
    for f, i, v in chosen.mapInPandas(count, "feature string, inside boolean, n bigint").groupBy("feature", "inside").agg(F.sum("n")).collect():
        total[f, i] = total.get((f, i), 0) + v
    return weights(total)


def main_text(pages: DataFrame, scores: dict[str, float], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; nothing moves between tasks."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def work(ids, urls, texts):
        made = [extract(t, scores) for t in texts]
        return ids, urls, made, [len(m) for m in made]

    return map_rows(pages, [page_id, url, html], work, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars bigint")
