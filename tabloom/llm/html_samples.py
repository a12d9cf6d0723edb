"""Labelled pages for the scores of ``html_text``: content elements carry the attribute ``data-main``.

Written for this library; they show layouts without semantic elements, with side columns, comments and forms.
"""

LABEL = "data-main"

_SENTENCE = "The river had risen over night and the ferry stayed at the northern bank until noon, so the market opened late."
_OTHER = "Nobody in the village remembered such a spring, and the older people said that the mill would not turn before May."
_SHORT = "A short note."


def _paragraphs(n: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{(_SENTENCE, _OTHER)[i % 2]}</{tag}>" for i in range(n))


_LINKS = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in ("home", "news", "sport", "weather", "contact"))
_CARDS = "".join(f'<div><a href="/{i}">Read more about topic {i}</a></div>' for i in range(6))
_TABLE = "<table><tr><td><a href='/a'>One</a></td><td><a href='/b'>Two</a></td></tr></table>"

PAGES = [
    f'<html><body><div><ul>{_LINKS}</ul></div><div data-main><h1>Late market</h1>{_paragraphs(5)}</div><div>{_CARDS}</div><div>All rights reserved 2020</div></body></html>',
    f'<html><body><table><tr><td><ul>{_LINKS}</ul></td><td data-main><h2>{_SHORT}</h2>{_paragraphs(4)}<blockquote>{_OTHER}</blockquote></td></tr></table><div><a href="#">Top</a></div></body></html>',
    f'<html><body><div><div><a href="/">Start</a> <a href="/all">All</a></div></div><div data-main><h1>On rivers</h1>{_paragraphs(3)}<ul><li>{_SENTENCE}</li><li>{_OTHER}</li></ul>{_paragraphs(2)}</div><div>{_TABLE}</div></body></html>',
    f'<html><body><main><div data-main><h1>Spring</h1>{_paragraphs(6)}<h2>Later</h2>{_paragraphs(2)}</div></main><div><ul>{_LINKS}</ul><p>Written by staff</p></div></body></html>',
    f'<html><body><ul>{_LINKS}</ul><div data-main>{_SENTENCE}<br><br>{_OTHER}<br><br>{_SENTENCE}</div><ul>{_LINKS}</ul></body></html>',
    f'<html><body><div>{_CARDS}</div><article data-main><h1>The mill</h1><div>{_paragraphs(4)}</div></article><div>{_CARDS}<p>Copyright</p></div></body></html>',
]
