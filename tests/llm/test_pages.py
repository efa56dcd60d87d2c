"""Pages written by hand, without names that say what is the article: none comes from the generator that the trees are fitted on."""

import pytest

from siltstone.llm import html_extract as H

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>'
LINKS = '<div><a href="/">Start</a> <a href="/m">Maps</a> <a href="/t">Tickets</a> <a href="/q">Questions</a></div>'
FOOT = '<footer>&copy; 2020 Site. <a href="/x">Privacy</a> <a href="/y">Imprint</a></footer>'
RIVER = ["Rivers carve the land slowly, and they carry silt to the sea over many hundreds of years, until a plain has grown where there was a bay.",
         "Most towns grew beside them, since water was needed every day, for people and for beasts, for mills and for washing.",
         "Where two of them met there was often a market, and where they could be crossed on foot there was a road."]
P = "".join(f"<p>{x}</p>" for x in RIVER)

PAGES = {
    "body": (f"<html><body>{NAV}{P}{FOOT}</body></html>", RIVER),
    "heading in body": (f"<html><body>{LINKS}<h1>On rivers</h1>{P}{FOOT}</body></html>", ["On rivers", *RIVER]),
    "div": (f"<html><body>{NAV}<div>{P}</div>{FOOT}</body></html>", RIVER),
    "section": (f"<html><body>{NAV}<section>{P}</section>{FOOT}</body></html>", RIVER),
    "an id that says nothing": (f"<html><body>{NAV}<div id=x>{P}</div>{FOOT}</body></html>", RIVER),
    "table cell": (f"<html><body><table><tr><td>{LINKS}</td><td>{P}</td></tr></table>{FOOT}</body></html>", RIVER),
    "one paragraph": (f"<html><body>{NAV}<p>{RIVER[0]}</p>{FOOT}</body></html>", RIVER[:1]),
    "wrappers": (f"<html><body>{NAV}<div><div><div>{P}</div></div></div>{FOOT}</body></html>", RIVER),
    "lists of links about it": (f"<html><body>{LINKS}<div><div>{P}</div><div><ul><li><a href=/1>Lakes</a></li><li><a href=/2>Seas</a></li><li><a href=/3>Ponds</a></li></ul></div></div>{FOOT}</body></html>", RIVER),
    "a list in it": (f"<html><body>{NAV}<div>{P}<ul><li>The first of them flows to the north, past the hills.</li><li>The other one flows to the south, into the lake.</li></ul></div>{FOOT}</body></html>", [*RIVER, "The first of them flows to the north, past the hills.", "The other one flows to the south, into the lake."]),
    "a quotation in it": (f"<html><body>{NAV}<div>{P}<blockquote><p>No one steps into the same river twice, it is said, for it is another river.</p></blockquote></div>{FOOT}</body></html>", [*RIVER, "No one steps into the same river twice, it is said, for it is another river."]),
    "unclosed paragraphs": (f"<html><body>{NAV}<div><p>{'<p>'.join(RIVER)}</div>{FOOT}</body></html>", RIVER),
    "a search form": (f"<html><body>{NAV}<form action=/s><label>Search</label><input name=q></form><div>{P}</div>{FOOT}</body></html>", RIVER),
    "a script and a style": (f"<html><head><style>p {{ margin: 0 }}</style></head><body><script>var a = '<p>no</p>';</script>{NAV}<div>{P}</div>{FOOT}</body></html>", RIVER),
    "a link in the text": (f"<html><body>{NAV}<div>{P.replace('market', '<a href=/m>market</a>')}</div>{FOOT}</body></html>", RIVER),
}


@pytest.fixture(scope="module")
def model():
    return H.train()


def test_most_pages_without_names_come_out_exactly(model):
    wrong = [k for k, (page, want) in PAGES.items() if H.extract(page, model) != "\n\n".join(want)]
    assert len(wrong) <= len(PAGES) // 10, wrong


@pytest.mark.parametrize("name", ["body", "div", "section", "an id that says nothing", "table cell", "one paragraph", "wrappers"])
def test_plain_layouts_give_their_paragraphs(model, name):
    page, want = PAGES[name]
    assert H.extract(page, model) == "\n\n".join(want)


def test_some_text_is_found_wherever_there_is_any_outside_links(model):
    for page in ("<p>x y z</p>", "just words", "<table><tr><td>a few words here</td></tr></table>", "<nav><a href=/>Home</a></nav><center>One line of text.</center>"):
        assert H.extract(page, model)
    assert H.extract("<nav><a href=/>Home</a></nav>", model) == "" and H.extract("", model) == "" and H.extract(None, model) == ""
