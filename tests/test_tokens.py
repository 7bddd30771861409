import html as entities
import re
from collections import Counter, defaultdict

from catalogkit.plans import queries
from catalogkit.sources import tokens

PAGES = [
    (1, '<div class="panel"><a>Ann</a><strong class="symbol female">f</strong><a>Bob</a><strong class="male x">m</strong><a>Cy</a><b>♂</b><a>Dee <i>Lee</i></a></div><a>Out</a>'),
    (2, '<ul><li><a>One</a><li>Two<li><ul><li>Deep</ul>Three</ul><p>first<p>second<b>bold<div>block</div>'),
    (3, None), (4, ""), (5, "just text &amp; more"), (6, '<A HREF="x" href="y">Up</A></b></i><br/><img src=z><p/>in<script>var a="<p>no</p>"</script>'),
    (7, "<dl><dt>Term<dd>What<dt>Next<dd>More</dl><table><tr><td>1<td>2<tr><th>3</table>"),
]


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


def test_nesting_and_unclosed_tags(spark):
    got = defaultdict(list)
    for r in tokens.elements(frame(spark)).sort("page_id", "place").collect():
        got[r.page_id].append((r.tag, r.depth, r.parent, r.text))
    assert sorted(got) == [1, 2, 6, 7]
    assert got[2] == [
        ("ul", 0, None, "OneTwoDeepThree"), ("li", 1, 0, "One"), ("a", 2, 1, "One"), ("li", 1, 0, "Two"), ("li", 1, 0, "DeepThree"), ("ul", 2, 4, "Deep"), ("li", 3, 5, "Deep"),
        ("p", 0, None, "first"), ("p", 0, None, "secondbold"), ("b", 1, 8, "bold"), ("div", 0, None, "block"),
    ]
    assert [(t, d) for t, d, *_ in got[6]] == [("a", 0), ("br", 0), ("img", 0), ("p", 0), ("script", 1)]
    assert [(t, x) for t, _, _, x in got[7] if t in ("dt", "dd", "td", "th")] == [("dt", "Term"), ("dd", "What"), ("dt", "Next"), ("dd", "More"), ("td", "1"), ("td", "2"), ("th", "3")]
    first = tokens.elements(frame(spark), tags=["a"]).where("page_id = 6").first()
    assert first.attrs == {"href": "x"}


def test_links_marked_by_their_sibling_are_left_out(spark):
    got = {r.page_id: r.names for r in tokens.unmarked(frame(spark), "male", "♂").collect()}
    assert got == {1: ["Ann", "Dee Lee", "Out"], 2: ["One"], 6: ["Up"]}
    inside = {r.page_id: r.names for r in tokens.unmarked(frame(spark), "male", "♂", inside="panel").collect()}
    assert inside == {1: ["Ann", "Dee Lee"]}


def outline(html):
    """Another reading, for pages whose only unclosed elements are p and what p holds."""
    html = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", html)
    parts = re.findall(r"(?s)<(script|style)>(.*?)</\1>|<(/?)(\w+)[^>]*>|([^<]+)", html)
    stack, rows = [], []
    for raw, _, slash, tag, text in parts:
        if raw:
            rows.append({"tag": raw, "depth": len(stack), "parent": stack[-1] if stack else None, "n": 0})
        elif text:
            for at in stack:
                rows[at]["n"] += len(entities.unescape(text))
        elif slash:
            names = [rows[at]["tag"] for at in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
        else:
            names = [rows[at]["tag"] for at in stack]
            if tag in ("p", "footer", "article", "div", "nav", "h1", "ul") and "p" in names:
                del stack[names.index("p") :]
            rows.append({"tag": tag, "depth": len(stack), "parent": stack[-1] if stack else None, "n": 0})
            if tag not in ("br", "meta"):
                stack.append(len(rows) - 1)
    followed = Counter()
    for parent in {r["parent"] for r in rows}:
        own = [r["tag"] for r in rows if r["parent"] == parent]
        followed.update(a for a, b in zip(own, own[1:]) if a == b)
    tags = {r["tag"] for r in rows}
    return {t: (sum(r["tag"] == t for r in rows), max(r["depth"] for r in rows if r["tag"] == t), followed[t], sum(r["n"] for r in rows if r["tag"] == t)) for t in tags}


def test_registered_outline_equals_another_reading(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: outline(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = defaultdict(dict)
    for r in queries.page_outline(spark, sf).collect():
        got[r.page_id][r.tag] = (r.n, r.deepest, r.followed, r.letters)
    assert dict(got) == want
