"""Pages whose wrappers and headings have names that also occur on boilerplate."""

import pytest

from tabloom.llm import html_text

LONG = "The river rose over night and nobody in the village crossed it before noon on that day."


@pytest.mark.parametrize("tag, end", [
    ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="has-sidebar">', "</div>"), ('<div class="overflow-hidden">', "</div>"),
    ('<div style="overflow:hidden">', "</div>"), ('<form action="/page">', "</form>"), ("<div title='not hidden'>", "</div>")])
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_wrappers_are_read(tag, end, inner):
    page = "<html><body>" + tag + inner % f"<p>{LONG}</p><p>{LONG}</p>" + "<div class=sidebar>Side words</div>" + end + "<footer>end</footer></body></html>"
    assert html_text.extract(page, html_text.default_weights()) == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("name", ["related-work", "search", "legal-framework"])
def test_headings_with_ids_stay(name):
    page = f'<article><p>{LONG}</p><h2 id="{name}">A heading</h2><p>{LONG}</p></article>'
    assert html_text.extract(page, html_text.default_weights()) == f"{LONG}\n\nA heading\n\n{LONG}"


@pytest.mark.parametrize("tag", ["<div hidden>", '<div class=x hidden id="y">', '<div aria-hidden="true">', '<div style="color:red; display: none">', "<div class='ad'>",
                                 '<div id="comments"><article class="comment-body">', "<form>"])
def test_boilerplate_stays_out(tag):
    page = f"<article><p>{LONG}</p><p>{LONG}</p></article>{tag}<p>{LONG}</p>"
    assert html_text.extract(page, html_text.default_weights()) == f"{LONG}\n\n{LONG}"
