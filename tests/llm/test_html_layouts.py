"""Pages set by hand, in layouts the training pages don't have, with the text that is wanted."""

import pytest

from lodestone.llm import html_extract

A = "The first sentence of the piece, which is of some length. It goes on for a while."
B = "A second block; it has another sentence or two. They say more of the same matter."
INSIDE = [  # what an article may hold
    ('<section id="discussion"><h2>Discussion</h2><p>We found that it holds, as others did before.</p></section>', "Discussion\n\nWe found that it holds, as others did before."),
    ('<ul><li><a href="/1">Miller and others, On the growth of trees in the north. 1998.</a></li><li><a href="/2">Smith, A study of the older maps, volume two. 2004.</a></li></ul>', "Miller and others, On the growth of trees in the north. 1998.\n\nSmith, A study of the older maps, volume two. 2004."),
    ('<div class="warning"><p>Do not mix the two liquids, they react at once.</p></div>', "Do not mix the two liquids, they react at once."),
    ('<p class="related-work">Others have looked at this question before, with less data.</p>', "Others have looked at this question before, with less data."),
    ('<p class="message">The message was short, and it came too late for all of them.</p>', "The message was short, and it came too late for all of them."),
    ('<div class="side-by-side"><p>On the left stands the old form, on the right the new one.</p></div>', "On the left stands the old form, on the right the new one."),
    ('<figure class="banner"><figcaption>The town in winter, seen from the hill above the river.</figcaption></figure>', "The town in winter, seen from the hill above the river."),
    ('<div data-id="menu"><p>It was served with bread, and with a glass of red wine.</p></div>', "It was served with bread, and with a glass of red wine."),
    ('<p>See <a href="/x">this</a> and <a href="/y">that</a>.</p>', "See this and that."),
    ("<dl><dt>Term</dt><dd>What it means, in a few words.</dd></dl>", "Term\n\nWhat it means, in a few words."),
    ("<table><tr><td>Year</td><td>Rain, in mm</td></tr></table>", "Year\n\nRain, in mm"),
]
OUTSIDE = [  # what a page may hold beside it
    '<div class="ad-slot-2">Buy the new one today, it is cheap.</div>',
    '<div id="cookie-banner"><p>We use cookies to make this page better for you.</p><button>OK</button></div>',
    '<div class="comments-area"><h3>2 comments</h3><div class="comment"><p>Nice piece, thank you for it.</p></div></div>',
    '<aside><h3>Read on</h3><ul><li><a href="/a">Another piece</a></li></ul></aside>',
    '<div class="newsletter-signup"><p>Get our letter every week, it is free.</p><form><input></form></div>',
    '<nav class="breadcrumbs"><a href="/">Home</a> / <a href="/n">News</a></nav>',
    "<div>&copy; 2021 The Example Company</div>",
    '<table><tr><td><a href="/a">Home</a></td><td><a href="/b">News</a></td><td><a href="/c">About</a></td></tr></table>',
    '<footer><p>Imprint and terms of use.</p></footer>',
    '<div class="related-posts"><ul><li><a href="/q">More on this</a></li><li><a href="/r">And this</a></li></ul></div>',
]
SHELLS = [("<article>", "</article>"), ('<main><div class="story-text">', "</div></main>"), ('<div id="content">', "</div>")]


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("part, text", INSIDE)
def test_parts_of_an_article_stay(model, part, text, shell):
    page = f"<html><body>{shell[0]}<h1>The title</h1><p>{A}</p>{part}<p>{B}</p>{shell[1]}</body></html>"
    assert model.extract([page]) == ["\n\n".join(["The title", A, text, B])]


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("part", OUTSIDE)
def test_parts_around_an_article_go(model, part, shell):
    for page in (f"<body>{part}{shell[0]}<h1>The title</h1><p>{A}</p><p>{B}</p>{shell[1]}</body>", f"<body>{shell[0]}<h1>The title</h1><p>{A}</p><p>{B}</p>{shell[1]}{part}</body>"):
        assert model.extract([page]) == ["\n\n".join(["The title", A, B])]


@pytest.mark.parametrize("tag", ["svg", "select", "iframe", "noscript", "object", "textarea"])
def test_unclosed_elements_do_not_eat_the_page(model, tag):
    assert model.extract([f"<article><p>{A}</p><{tag}><p>{B}</p></article>"]) == [f"{A}\n\n{B}"]


def test_unclosed_script_is_never_text(model):
    assert model.extract([f"<article><p>{A}</p><script>var x = 1; // {B}"]) == [A]


def test_names_of_other_attributes_tell_nothing():
    assert html_extract.hints(' data-id="menu" aria-class="nav"') == () and html_extract.hints(' data-x="1" id="menu"') == ("menu",)
    assert html_extract.hints(' class="side-by-side related-work"') == () and html_extract.hints(" class=ad-slot-2") == ("ad",)
