"""Visibility, spans and deep pages of the HTML renderer."""

import random
import time
from collections import Counter

import pytest

from sunlattice.llm import common, html_render

PAGES = [
    ("<p>a</p><svg><title>t</title><desc>d</desc><text>chart label</text></svg><math><mi>x</mi><annotation>no</annotation></math>y", "a\n\nchart labelxy"),
    ('<div style="visibility:hidden">x<b style="visibility : visible">seen</b>x</div>', "seen"),
    ('<div style="visibility:hidden"><img alt="no"><i style="display:none;visibility:visible">no</i></div>z', "z"),
    ('<p aria-hidden="true">shown</p><p hidden>no</p>', "shown"),
    ('<p style="color:red; display : none ">no</p><p style="display:none;display:block">yes</p>', "yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td>1<td rowspan=3>tall<td>2<tr><td>3<td>4<tr><td colspan=1>5</table>", "1 | tall | 2\n3 |      | 4\n5 |"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
    ("<table><tr><td colspan=2 rowspan=2>wide<td>x<tr><td>y</table>", "wide | x\n |  | y"),
    ("<object>instead</object>", "instead"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_painted_text(page, text):
    assert html_render.render(html_render.parse(page), painted=True) == text


def test_hidden_parts_of_made_pages():
    """Nested elements that hide or show: words are seen as the rules say, in order."""
    rng = random.Random(3)

    def grow(depth, gone, hidden, seen, words):
        out = []
        for _ in range(rng.randrange(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                w = f"w{len(words)}"
                words.append(w)
                out.append(f" {w} ")
                if not gone and not hidden:
                    seen.append(w)
                continue
            tag, how = rng.choice(["div", "span", "b", "section", "ul", "blockquote"]), rng.choice(["", "", " hidden", ' style="display:none"', ' style="visibility:hidden"', ' style="visibility:visible"', ' aria-hidden="true"'])
            inner_hidden = True if "visibility:hidden" in how else False if "visibility:visible" in how else hidden
            out.append(f"<{tag}{how}>" + grow(depth - 1, gone or how == " hidden" or "none" in how, inner_hidden, seen, words) + f"</{tag}>")
        return "".join(out)

    for _ in range(200):
        seen, words = [], []
        page = grow(5, False, False, seen, words)
        got = html_render.render(html_render.parse(page), painted=True)
        assert [x for x in got.split() if x.startswith("w")] == seen


def test_real_pages_with_hidden_parts(spark):
    """Every word of a page is either in its text or in a part that is hidden, told from the page's own marks."""
    pages = common.table(spark, "/root/testdata/sf0.01", "pages").collect()
    some = 0
    for r in pages:
        text = html_render.render(html_render.parse(r.html), painted=True)
        shown = html_render.parse(r.html)
        hidden = []
        todo = [(shown, False)]
        while todo:
            x, gone = todo.pop()
            if isinstance(x, str):
                hidden += x.split() if gone else []
            else:
                todo += [(k, gone or not html_render.visible(x, True)) for k in x.kids]
        some += bool(hidden)
        whole = Counter("".join(x for x in _strings(shown)).replace("|", " ").split())
        lost = whole - Counter(text.replace("|", " ").split()) - Counter(hidden)
        assert sum(lost.values()) <= 0.1 * sum(whole.values()) + 3
    assert some > 10


def _strings(root):
    todo, out = [root], []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(f" {x} ")
        else:
            todo += reversed(x.kids)
    return out


def test_deep_and_long_pages_take_linear_time(spark):
    began = time.time()
    for page in ("<b><div>x</div>" * 20_000, "<div>" * 30_000 + "</span>" * 30_000 + "deep", "<ul><li>" * 10_000 + "x", "<i>" * 30_000 + "</p>" * 2000 + "x", "<p>word " * 100_000):
        assert html_render.render(html_render.parse(page))
    assert time.time() - began < 30
    rows = [(1, "<p>x", "old", 5), (1, "<p>x", "old", 5), (2, None, None, None), (None, "", "t", 1)]
    pages = common.prepare(spark).createDataFrame(rows, "page_id long, html string, text string, n_lines int")
    got = Counter((r.page_id, r.text) for r in html_render.extract(pages).collect())
    assert got == {(1, "x"): 2, (2, None): 1, (None, ""): 1}
    assert html_render.extract(pages.limit(0)).count() == 0


def test_what_never_ends_takes_no_longer():
    for page in ("<a " * 350_000, "<a" * 500_000, "<a x='" * 170_000, "<a \"\" " * 150_000 + "'", "<a \"<b '" * 120_000, "<p><!-- " * 120_000, "<![CDATA[" * 110_000, "<! " * 350_000, "</a " * 250_000 + ">"):
        began = time.perf_counter()
        html_render.parse(page)
        assert time.perf_counter() - began < 4, page[:20]


def test_tags_end_outside_quotes():
    shown = lambda page: html_render.render(html_render.parse(page))
    assert shown("""a <b title="x > y" data='">'>bold</b> c""") == "a bold c"
    assert shown("1 < 2 <i>and</i> 3 <4") == "1 < 2 and 3 <4"
    assert shown("""a <b title="never ends>b <i>c</i>""") == 'a <b title="never ends>b c'
    assert shown("a<br/>b<BR>c") == "a\nb\nc"


def test_controls_and_what_browsers_do_not_paint():
    shown = lambda page: html_render.render(html_render.parse(page))
    assert shown("<input placeholder=Name><input value=v placeholder=Name><input type=hidden placeholder=no>") == "Namev"
    assert shown("<textarea>\none\n  two</textarea>") == "one\n  two" and shown("<textarea placeholder=Say></textarea>") == "Say"
    assert shown("<select><optgroup label=Fruit><option>fig</optgroup></select>") == "Fruit\nfig"
    assert shown("a<dialog>no</dialog><dialog open>yes</dialog>") == "a\nyes"
    assert shown("<progress>50%</progress><meter>1</meter>x <ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>") == "x kr"
    assert shown("<ol><li>a<li value=5>b<li>c</ol>") == "1. a\n5. b\n6. c"
