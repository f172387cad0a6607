import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import html_text as h

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("  a\n b <b> c</b>d ", "a b cd"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name      | N\nlong name | 1"),
    ("<table><caption>C</caption><tr><td rowspan=2>a<td>b<tr><td>c</table>z", "C\na | b\n  | c\n\nz"),
    ("<table><td>a<td><table><tr><td>x<td>yy</table></table>", "a | x | yy"),
    ("<head><title>t</title></head><style>p{}</style><script>var t='</p>';</script>v<!-- c -->w", "vw"),
    ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p style='visibility:hidden'>no</p>yes", "yes"),
    ("<div hidden><p>a<p>b</div>c", "c"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("a &amp; b &eacute; &lt;i&gt;&nbsp;x", "a & b é <i>\xa0x"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>a<div>b</div>c</p>d", "a\n\nb\nc\n\nd"),
    ("<b>un<p>closed", "un\n\nclosed"),
    ("</td></p>x</b>y<", "xy<"),
    ("<img alt='pic'> <input type=hidden value=q><input type=submit value=Go>", "pic Go"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("<p>a</p\n>b<P CLASS='x>y'>c", "a\n\nb\n\nc"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_rendering(html, text):
    assert h.text_of(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td colspan=9>", "</table>", "<li>", "<ul>", "</ul>", "<b", ">", "<!--", "-->", "<script>", "</script>", "x", " ", "&amp;", "\"", "<div style=display:none>", "</div>", "<select><option>", "İ"]), max_size=30))
def test_anything_goes(parts):
    h.text_of("".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</i>", "<div>", "</div>", "<h2>", "<dd>"]), max_size=30))
def test_no_visible_text_is_lost(tags):
    words = [f" w{k}w " for k in range(len(tags))]
    text = h.text_of("".join(t + x for t, x in zip(tags, words, strict=True)))
    assert sorted(text.replace("|", " ").replace("- ", " ").split()) == sorted(x.strip() for x in words)


def test_pages(spark):
    deep = "<div>" * 30000 + "deep"
    rows = [(1, "u", "<p>a<p>b"), (2, None, None), (None, "v", ""), (3, "w", deep), (3, "w", "<table>" + "<tr><td>c" * 5000)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")).collect()
    assert [(r.page_id, r.url, r.n_chars, r.n_lines) for r in got] == [(1, "u", 4, 3), (2, None, 0, 0), (None, "v", 0, 0), (3, "w", 4, 1), (3, "w", 9999, 5000)]
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_depth_spans_and_digits():
    """What is hidden stays hidden at any depth; spans are as the standard bounds them."""
    import sys

    sys.setrecursionlimit(10_000_000)
    for depth in (450, 30_000):
        assert h.text_of("<div>" * depth + "<div hidden>secret<div>more</div>all</div>seen" + "</div>" * depth + "<p>end") == "seen\n\nend"
        assert h.text_of("<div hidden>" + "<b>" * depth + "x" + "</b>" * depth + "y</div>z") == "z"
    wide = "<table><tr><td colspan=%s>a<td>b<tr>" + "<td>c" * 150 + "<td>d</table>"
    lines = h.text_of(wide % 150).split("\n")
    assert lines[0].index("b") == lines[1].index("d")
    for digits in ("9" * 5000, "0" * 5000 + "2", "-3", "x", ""):
        assert "b" in h.text_of(f"<table><tr><td colspan='{digits}' rowspan='{digits}'>a<td>b</table>")
