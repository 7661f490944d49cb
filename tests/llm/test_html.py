import random

import pytest

from fluxmill.llm import html

CASES = [
    ("", ""),
    (None, ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b  <b>c</b>\n d", "a\n\nb c d"),
    ("<title>t</title><style>x</style><script>if (a</b>c) '</p>'</script>seen", "seen"),
    ("<div>a</div><div>b<div>c</div></div>d", "a\nb\nc\nd"),
    ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
    ("<ul><li>x<li>y<ol start=3><li>i<li>j</ol><li>z</ul>after", "- x\n- y\n  3. i\n  4. j\n- z\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12</table>", "Name       Qty\napple pie  3\nfig        12"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one</table>", "a         b\n          c\nwide one"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("x<pre>\n a\n  b</pre>y", "x\n\n a\n  b\n\ny"),
    ("<p hidden>no</p><p style='display: none'>no</p><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<details><summary>head</summary>body</details><details open><summary>h</summary>b</details>", "head\nh\nb"),
    ("<!-- no -->a<!doctype html>b<?pi?>c", "abc"),
    ("<a href='x>y'>link</a> <img alt=no> &lt;tag&gt; a&nbsp;b &#233;", "link <tag> a b é"),
    ("a</p>b</div>c</body></html>d", "abcd"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<textarea>typed &amp; <b></textarea><select><option>o<option>p</select>", "typed & <b>\no\np"),
    ("<h1>Head</h1>text<hr>more", "Head\n\ntext\n\nmore"),
    ("a<script>never closed", "a"),
    ("1 < 2 and 3 > 2 <", "1 < 2 and 3 > 2 <"),
    ("<div style='visibility: hidden'>no<b style='visibility:visible'>yes</b>no<p style='display:none'>no<b style='visibility:visible'>no</b></p></div>", "yes"),
    ("<style>.gone{display:none} #x, p.y { color: red; visibility: hidden } @media print { b { display: none } } a b{display:none}</style><p class='a gone'>no</p><p id=x>no<i style='visibility:visible'>but</i></p><p class=y>no</p><a><b>yes</b></a>", "but\n\nyes"),
    ("<style>p{display:none} .show{display:block} i{display:none !important}</style><p>no<p class=show>yes <i style='display:inline'>no</i></p><p style='display:block'>and</p>", "yes\n\nand"),
    ("<p hidden style='display:block'>shown</p>", "shown"),
    ("<ol><li>a<li value=7>b<li>c</ol><ol reversed><li>x<li>y</ol>", "1. a\n7. b\n8. c\n\n2. x\n1. y"),
    ("<table><tr><td>a<br>b<ul><li>x<li>y</ul><td>right<p>more</table>", "a    right\nb\n     more\n- x\n- y"),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<table><tr><td colspan=1000 rowspan=65534>a<td>z<tr><td>b</table>", "a  z\n   b"),
    ("<svg><title>no</title><text>drawn</text></svg> <math><mi>x</mi></math> <map>m</map>", "drawn x m"),
    ("<table><tr><td>" + "w" * 70 + "<td>b<tr><td>c<td>d</table>", "w" * 70 + "  b\nc  d"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rendering(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x", "<a href=\"" * 5000, "<" * 200_000, "<table>" * 3000 + "t", "<p a='" * 3000, "</div>" * 50_000, "<span>" * 30_000 + "</p><li>x" * 10_000, "<table>" + "<td rowspan=65534 colspan=3>a" * 400 + "<tr><td>b" * 4000, "<p><body>" * 20_000])
def test_hostile_pages_end(page):
    assert len(html.render(page)) <= 12 * len(page)


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 5000 + "</table>",
        "<table><tr>" + "<td>" * 2 + "<td>".join("w" * 40 for _ in range(900)) + "<tr><td colspan=899><td>x" * 2000,
        "<blockquote>" * 3000 + "<br>x" * 5000,
        "<table><tr><td>" * 40 + "a<td>b" + ("<tr><td>" + "c" * 50 + "<td>d") * 300,
    ],
)
def test_text_is_of_the_order_of_its_page(page):
    """Long cells, wide tables, deep indents and nested tables don't multiply the page."""
    assert len(html.render(page)) <= 12 * len(page)


def naive(tree, shown=True):
    """The text of a made page, straight from what it was made of, as a list of paragraphs of lines."""
    parts, line = [], None  # a part: (blank line around it?, lines)
    for kind, value, inner in tree:
        visible = {"": shown, "h": False, "v": True}[value] if kind in ("p", "div", "b") and value in ("", "h", "v") else shown
        if kind == "text":
            if shown:
                line = (line + [value]) if line else [value]
        elif kind == "b":
            for got in naive(inner, visible):
                line = (line or []) + got[1]
        elif kind == "none":
            pass
        else:
            if line:
                parts.append((False, [" ".join(line)]))
            line = None
            if kind in ("p", "div"):
                lines = [x for x in naive(inner, visible)]
                text = [(" ".join(y for x in lines for y in x[1]))] if lines else []
            elif kind == "ul":
                text = [f"- {x}" for x in inner] if shown else []
            else:
                rows = inner if shown else []
                wide = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))] if rows else []
                text = ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows]
            if any(text):
                parts.append((kind != "div", text))
            elif kind != "div":
                parts.append((True, []))
    if line:
        parts.append((False, [" ".join(line)]))
    return parts


def joined(parts):
    out, wide = "", False
    for apart, lines in parts:
        wide = wide or apart
        if lines:
            out += ("\n\n" if wide else "\n") * bool(out) + "\n".join(lines)
            wide = apart
    return out


def source(tree):
    style = {"": "", "h": " style='visibility:hidden'", "v": ' style="visibility: visible"'}
    out = ""
    for kind, value, inner in tree:
        if kind == "text":
            out += f" {value} "
        elif kind == "none":
            out += f"<div style='display:none'>{source(inner)}</div>" if value else "<script>x < y</script>"
        elif kind == "ul":
            out += "<ul>" + "".join(f"<li>{x}" for x in inner) + "</ul>"
        elif kind == "table":
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in inner) + "</table>"
        else:
            out += f"<{kind}{style[value]}>{source(inner)}</{kind}>"
    return out


def test_made_pages_equal_a_naive_rendering():
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abcdef") for _ in range(dice.randint(1, 9)))

    def texts(depth):
        kinds = ["text", "text", "b"] if depth else ["text"]
        return [(k, word(), None) if k == "text" else (k, dice.choice(["", "h", "v"]), texts(depth - 1)) for k in (dice.choice(kinds) for _ in range(dice.randint(1, 3)))]

    for _ in range(400):
        tree = []
        for _ in range(dice.randint(1, 7)):
            kind = dice.choice(["text", "p", "div", "ul", "table", "none", "b"])
            if kind == "text":
                tree.append((kind, word(), None))
            elif kind == "ul":
                tree.append((kind, "", [word() for _ in range(dice.randint(1, 4))]))
            elif kind == "table":
                across = dice.randint(1, 4)
                tree.append((kind, "", [[word() for _ in range(across)] for _ in range(dice.randint(1, 4))]))
            else:
                tree.append((kind, dice.choice(["", "h", "v"]), texts(2)))
        assert html.render(source(tree)) == joined(naive(tree)), source(tree)


def test_tree_has_implied_elements():
    table = html.parse("<table><td>a<td>b<tr><td>c</table>").kids[0]
    assert [r.tag for r in table.kids] == ["tr", "tr"]
    assert [[c.tag for c in r.kids] for r in table.kids] == [["td", "td"], ["td"]]


def test_frames(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (None, None, None), (1, "<p>a", "t")], "page_id long, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html.extract(df.limit(0)).count() == 0
