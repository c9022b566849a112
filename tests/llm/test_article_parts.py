"""Parts that stand in or around an article of long paragraphs."""

import pytest

from themelift.llm.html_extract import blocks, main_text, selected

P = "The river rises in the hills, runs past the mill and the old town, and meets the sea after forty miles of meadows."
Q = "In spring the water is high; in summer, when rain is rare, children wade across it and look for stones and crabs."
LONG = " ".join(["Words of thirty, said by somebody else, are kept as they are."] * 3)


def text(middle="", end="", after=""):
    page = (
        f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>River</h1><p>{P}</p>"
        f"{middle}<p>{Q}</p>{end}</article>{after}<footer>Foot</footer></body></html>"
    )
    return main_text(page).split("\n")


@pytest.mark.parametrize(
    "part", ["<button>Share now</button>", "<label>EMAIL</label>", "<span hidden>SECRET</span>", "<span class=ad>BUYNOW</span>", '<a class="share" href=1>Tweet</a>']
)
def test_inline_parts_are_cut_out(part):
    assert text(end=f"<p>One more line, with words {part} and an end.</p>") == ["River", P, Q, "One more line, with words and an end."]


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ("<ul><li><a href=1>One work</a></li><li><a href=2>Another work</a></li></ul>", ["One work", "Another work"]),
        ('<p class="skip-lazy">Lazy words, loaded later.</p>', ["Lazy words, loaded later."]),
        (f'<blockquote class="tweet reply">{LONG}</blockquote>', [LONG]),
        ('<h2 class="share-title">Shares of land</h2>', ["Shares of land"]),
        ("<aside><p>Buy a boat, cheap, now, in all colours of the sea and of the hills, at the mill.</p></aside>", []),
        ('<div class="ad-box advert"><p>Buy a boat, cheap, now, in all colours, today.</p></div>', []),
    ],
)
def test_between_paragraphs(part, want):
    assert text(middle=part) == ["River", P, *want, Q]


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ("<h2>References</h2><ul><li><a href=1>One work</a></li><li><a href=2>Another</a></li></ul>", ["References", "One work", "Another"]),
        ("<dl><dt>Mill</dt><dd>A house with a wheel</dd><dt>Weir</dt><dd>A low dam</dd></dl>", ["Mill", "A house with a wheel", "Weir", "A low dam"]),
        ("<table><tr><th>Year</th><th>Level</th></tr><tr><td>1990</td><td>4</td></tr></table>", ["Year", "Level", "1990", "4"]),
        ("<pre>flow = 4 * width</pre>", ["flow = 4 * width"]),
        ("<p>All rights reserved.</p>", ["All rights reserved."]),
        ('<div class="related"><h3>Related</h3><ul><li><a href=1>Other river</a></li></ul></div>', []),
        ('<div class="share"><a>Tweet</a> <a>Mail</a></div>', []),
        (f"<section class=comments><h2>Comments</h2><p>{Q} I think, and so do others, here.</p></section>", []),
        ("<form><p>Join, please, now, and write to us, dear friends of rivers all over the world!</p></form>", []),
    ],
)
def test_at_the_end(part, want):
    assert text(end=part) == ["River", P, Q, *want]


@pytest.mark.parametrize(
    "part",
    [
        "<p>All rights reserved.</p>", "<div>© 2024 Mill</div>", "<p>Copyright (c) 2024 Mill</p>",
        "<ul class=related><li><a href=1>Other river</a></li></ul>", f"<div id=comments><p>{Q} I think, and so do others.</p></div>",
    ],
)
def test_after_the_article(part):
    assert text(after=part) == ["River", P, Q]


def test_the_numbers_decide():
    """Menus and footers come to the comparison as blocks and go by their numbers."""
    found, parents = blocks(f"<body><nav><p>Home and more</p></nav><article><p>{P}</p></article><footer><p>Foot</p></footer></body>")
    assert [b.text for b in found] == ["Home and more", P, "Foot"] and selected(found, parents).tolist() == [False, True, False]


def test_pages_without_article():
    def flat(more):
        page = f"<html><body><div id=menu><a href=1>Home</a><a href=2>About us</a></div><div><h1>River</h1><p>{P}</p><p>{Q}</p>{more}</div><div class=foot>© Mill</div></body></html>"
        return main_text(page).split("\n")

    assert flat("") == ["River", P, Q]
    assert flat("<ul><li>Stones of the river bed</li></ul>") == ["River", P, Q, "Stones of the river bed"]
    assert main_text("<nav>only</nav>") == "" and main_text("<footer>© 2024</footer>") == ""
