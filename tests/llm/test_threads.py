"""Reader comments stay out however long they are; what an article says stays in; bad markup costs linear time."""

import random
import time

import pytest

from tabloom.llm import html_text

TEXT = "The river rose over night and nobody in the village crossed it before noon on that day."
SAID = "I was there myself, and I can say that none of this is true, whatever the paper writes."
W = html_text.default_weights()


def page(article, rest):
    return f"<html><body><nav><a href=/>Home</a></nav>{article}{rest}<footer>end</footer></body></html>"


THREADS = [f"<section class='comments'>{f'<p>{SAID}</p>' * 6}</section>", f"<div id='comments'>{f'<div><p>{SAID}</p></div>' * 9}</div>",
           f"<div class='sidebar'>{f'<p>{SAID}</p>' * 6}</div>", f"<div id='comments'>{f'<article><p>{SAID}</p></article>' * 6}</div>",
           f"<ol class='comment-list'>{f'<li><article><p>{SAID}</p></article></li>' * 6}</ol>", f"<div class='advert-box'>{f'<p>{SAID}</p>' * 6}</div>",
           f"<div id='disqus_thread'>{f'<p>{SAID}</p>' * 30}</div>"]


@pytest.mark.parametrize("thread", THREADS)
@pytest.mark.parametrize("article", ["<article><h1>River</h1>%s</article>", "<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_threads_stay_out(article, thread):
    got = html_text.extract(page(article % f"<p>{TEXT}</p><p>{TEXT}</p>", thread), W)
    assert SAID not in got and got.endswith(f"{TEXT}\n\n{TEXT}")


@pytest.mark.parametrize("thread", THREADS[:2])
def test_threads_inside_the_article_stay_out(thread):
    assert html_text.extract(page(f"<article><h1>River</h1><p>{TEXT}</p>{thread}<p>{TEXT}</p></article>", ""), W) == f"River\n\n{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("tag", ["<section id='discussion'>", "<section id='related-work'>", "<p class='legal'>", "<p class='reply'>", "<div id='legal-framework'>",
                                 "<section class='notice'>", "<div id='search-methods'>"])
def test_sections_named_after_their_subject_stay(tag):
    end = f"</{tag[1:].split()[0]}>"
    got = html_text.extract(page(f"<article><p>{TEXT}</p>{tag}{SAID}{end}<p>{TEXT}</p></article>", ""), W)
    assert got == f"{TEXT}\n\n{SAID}\n\n{TEXT}"


def test_an_article_is_taken_whole():
    closing = "<ul><li>a</li><li>b</li><li>c</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    got = html_text.extract(page(f"<article><ul><li>first</li></ul><p>{TEXT}</p><p>{TEXT}</p>{closing}</article>", "<div>Other words of the page</div>"), W)
    assert got.split("\n\n") == ["first", TEXT, TEXT, "a", "b", "c", "1", "2", "3", "4"]


def test_a_wrapper_named_for_comments_holds_the_article():
    inner = f"<article><h1>River</h1><p>{TEXT}</p></article><div class='comments'><p>{SAID}</p></div>"
    assert html_text.extract(page(f"<div class='comments-open'>{inner}</div>", ""), W) == f"River\n\n{TEXT}"
    assert html_text.extract(page(f"<div class='comments-open'><main><p>{TEXT}</p></main></div>", ""), W) == TEXT


@pytest.mark.parametrize("bad", ["<span></i>", "</b>", "<span><hr>", "<b><i></b>", "<li><span>"])
def test_bad_markup_costs_linear_time(bad):
    html = f"<article><p>{TEXT}</p></article>" + bad * (1_000_000 // len(bad))
    start = time.time()
    html_text.extract(html, W)
    assert time.time() - start < 20  # seconds of a slow machine; the square of the length would take hours


def brute_best(scored):
    """The first region of the highest sum, by all pairs of ends."""
    best = (0.0, 0, 0)
    for i in range(len(scored)):
        total = 0.0
        for j in range(i, len(scored)):
            total += scored[j]
            if total > best[0] + 1e-12:
                best = (total, i, j + 1)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_region_is_the_best_of_all(seed):
    """On pages of plain blocks the text is that of the highest-scoring region found by trying all."""
    rnd = random.Random(seed)
    parts = [rnd.choice([f"<p>{' '.join(['word'] * rnd.randint(1, 9))} {k}</p>", f"<div><a href=/x>link {k}</a></div>", f"<ul><li>{k}</li></ul>", "<table><tr><td></td></tr></table>"])
             for k in range(14)]
    html = "".join(parts)
    found = html_text.items(html)
    scores = [0.0 if f is None else n * W.get(f"{f}|none", 1.0 if f.startswith("word") else 0.0 if f.lstrip("/") in html_text.FREE else -1.0) for f, n, *_ in found]
    _, lo, hi = brute_best(scores)
    number, blocks, chosen = 0, {}, set()
    for k, (f, _, text, fresh, *_) in enumerate(found):
        number += text is not None and fresh
        if text is not None and f is not None:
            blocks.setdefault(number, []).append(text)
            if lo <= k < hi:
                chosen.add(number)
    want = [" ".join("".join(blocks[b]).split()) for b in sorted(chosen)]
    assert html_text.extract(html, W) == "\n\n".join(w for w in want if w)
