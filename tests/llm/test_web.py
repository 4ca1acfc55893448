import itertools
import random
import re

import pytest

from filewright.llm import html_extract, queries, url_filter
from tests.llm.oracle import same

SF = "/root/testdata/sf0.01"


def text(page, made=None):
    return html_extract.main_text(page, made or html_extract.wrapper([page]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<nav>menu</nav><article><h1>A&nbsp;B</h1><p>one<br>two<p>three <b>bold</b>!</article><footer>f</footer>", "A B\none\ntwo\nthree bold!"),
        ("<article><p>x</p><div class='ad'>buy</div><aside>s</aside><form>q</form><script>1<2</script><style>p{}</style><p>y</p><div id=comments><p>c</p></div></article>", "x\ny"),
        ("<body><div class=sidebar>s</div><div class='post-content'><p>long enough article</p></div><div class='cookie-notice'>ok?</div>", "long enough article"),
        ("<article><p>a &lt;b&gt; &#228; &am", "a <b> ä &am"),
        ("<article><p title='a > b'>kept</p><!-- <p>no</p> --><p hidden>no</p><p class=", "kept"),
        ("<article><table><tr><td>1</td><td>2</td></tr></table><ul><li>x<li>y</ul></article>", "1 2\nx\ny"),
        ("<main><article class=comment><p>reader</p></article><p>the text of it</p></main>", "the text of it"),
    ],
)
def test_main_text(page, want):
    assert text(page) == want


def page(n, extra=""):
    return f"<body><div>Site name</div>{extra}<div><p>Body {n} of this page is {n * 7} words long, and says many things.</p><p>Second {n}</p></div><div>All rights</div></body>"


def parts(made):
    return {x.key: x for x in html_extract._preorder(html_extract.loads(made), html_extract._kids)}


def test_wrappers_find_slots_groups_and_optional_parts():
    pages = [page(n, "<table><tr><td>t</td></tr></table>" if n % 2 else "") for n in range(5)]
    pages[4] = pages[4].replace("</p></div><div>All", "</p><p>Third</p></div><div>All")
    made = html_extract.wrapper(pages)
    found = parts(made)
    assert found["table"].optional and not found["body"].optional
    assert found["p"].repeated and found["p"].text is None
    assert html_extract.dumps(html_extract.loads(made)) == made
    got = text(pages[3], made)
    assert got == "Body 3 of this page is 21 words long, and says many things.\nSecond 3"


def test_several_tags_in_a_row_are_one_repeated_group():
    many = "".join(f"<h2>Head {n}</h2><p>Text {n}</p><p>More {n}</p>" for n in range(9))
    pages = [f"<body>{many}</body>", "<body><h2>Other</h2><p>One</p></body>"]
    found = parts(html_extract.wrapper(pages))
    assert found["(h2 p)"].repeated and found["(h2 p)"].tag == "(" and [x.key for x in found["(h2 p)"].kids] == ["h2", "p"]
    assert found["p"].repeated and [x.key for x in found["body"].kids] == ["(h2 p)"]
    assert text(pages[0], html_extract.wrapper(pages)).count("\n") == 26


def brute_common(a, b):
    """The length of the longest common subsequence of labelled keys, by trying every subset."""
    label = lambda keys: [(k, keys[:i].count(k)) for i, k in enumerate(keys)]
    a, b = label(a), label(b)
    for size in range(len(a), -1, -1):
        for some in itertools.combinations(a, size):
            it = iter(b)
            if all(x in it for x in some):
                return size
    return 0


def test_alignment_agrees_with_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("pqrs") for _ in range(rng.randrange(8))] for _ in range(2))
        pairs = html_extract.common(a, b)
        assert len(pairs) == brute_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and sorted(j for _, j in pairs) == [j for _, j in pairs]


def accepts(part, node):
    """Whether a wrapper's part matches an element, by a naive matcher of its children's pattern."""
    spelled = lambda x: "(" + "".join(map(spelled, x.kids)) + ")" + ("+" if x.repeated else "") if x.tag == "(" else f"(?:{letters[x.key]})" + ("+" if x.repeated else "")
    letters = {}
    for x in html_extract._preorder(part, html_extract._kids):
        letters.setdefault(x.key, chr(0x4E00 + len(letters)))
    pattern = "".join(f"(?:{spelled(x)})" + ("?" if x.optional else "") for x in part.kids)
    kids = html_extract._elements(node)
    if not re.fullmatch(pattern, "".join(letters.get(x.key, "!") for x in kids)):
        return False
    by_key = {x.key: x for x in html_extract._preorder(part, html_extract._kids)}
    return all(accepts(by_key[x.key], x) for x in kids)


def test_a_wrapper_matches_every_page_that_made_it():
    rng = random.Random(9)
    for _ in range(60):
        pages = []
        for _ in range(4):
            kinds = [x for x in ("<h2>{}</h2>", "<p>{}</p>", "<hr>", "<ul><li>{}</li><li>b</li></ul>", "<table></table>") if rng.random() < 0.7]
            pages.append("<body>" + "".join(x.format(rng.randrange(9)) * rng.randrange(1, 3) for x in kinds) + "</body>")
        made = html_extract.loads(html_extract.wrapper(pages))
        assert all(accepts(made, html_extract.parse(x)) for x in pages)


def test_pages_without_names_are_read_by_their_slots():
    def plain(n):
        menu = "".join(f"<li><a href=/{n}{k}>Menu {k * n}</a></li>" for k in range(6))
        return f"<body><div><ul>{menu}</ul></div><div>Buy thing {n}</div><div><h1>Title {n}</h1><div><p>{'Word ' * 30}{n}</p><div>Read our app</div><p>End {n}</p></div></div><div>Contact {n}</div></body>"

    pages = [plain(n) for n in range(6)]
    made = html_extract.wrapper(pages)
    assert text(pages[4], made) == "Title 4\n" + "Word " * 30 + "4\nEnd 4"
    assert text(pages[4], None) != html_extract.main_text(pages[4], None)


def test_deep_and_wide_pages():
    deep = "<div>" * 100_000 + "x" + "</div>" * 100_000
    assert text(deep) == "x"
    wide = "<body>" + "".join(f"<p>{n}</p>" for n in range(50_000))
    assert text(wide).count("\n") == 49_999
    kinds = "<body>" + "".join(f"<{'div' if n % 2 else 'p'} class={''.join(chr(97 + int(d)) for d in str(n))}>{n}</{'div' if n % 2 else 'p'}>" for n in range(50_000))
    made = html_extract.wrapper([kinds, kinds])
    assert len(made) < 10_000 and text(kinds, made).count("\n") == 49_999


def made_of(pages):
    return html_extract.wrapper(pages)


def test_template_takes_several_different_pages():
    copies = [page(1)] * 5
    assert "Body 1" in text(page(1), made_of(copies)) and "Body 1" in text(page(1), made_of([*copies, page(2)]))
    quote = "<blockquote>Said once</blockquote>"
    pages = [page(n).replace("<p>Second", quote + "<p>Second") if n == 2 else page(n) for n in range(5)]
    assert "Said once" in text(pages[2], made_of([pages[2], *pages]))
    twice = [f"<body><div class=a>Site</div><div class=b>Long text {n} of the page</div></body>" for n in range(3)]
    assert text(twice[1], made_of(twice)) == "Long text 1 of the page"


def test_article_nodes_of_readers_are_no_article():
    assert text("<main><article class=comment><p>reader</p></article><p>the text of it</p></main>") == "the text of it"


def test_wrappers_rule_where_markup_names_an_article():
    notice = [f"<body><article><div class=x>Read our app</div><div class=t><p>Story {n} says {n * 3}</p></div></article></body>" for n in range(4)]
    assert text(notice[2], made_of(notice)) == "Story 2 says 6"
    teaser = [f"<body><div class=top>Site</div><article><p>Teaser</p></article><div class=t><p>Story {n} is long and says {n * 3} things</p></div></body>" for n in range(4)]
    assert text(teaser[2], made_of(teaser)) == "Story 2 is long and says 6 things"


def article(body, n=0):
    return f"<html><body><header>My site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=content><h1>Title {n}</h1>{body}</div><footer>All rights {n}</footer></body></html>"


def test_near_copies_of_a_host_keep_their_text():
    body = "<p>The first paragraph of all these pages.</p><p>Updated {}</p><ul><li>one of it</li><li>two of it</li></ul><blockquote>As it was said</blockquote><h2>Conclusion</h2>"
    for names in (True, False):
        pages = [article(body.format(n)) for n in range(5)]
        if not names:
            pages = [x.replace(" class=content", "") for x in pages]
        made = made_of(pages)
        for n, x in enumerate(pages):
            assert text(x, made) == f"Title 0\nThe first paragraph of all these pages.\nUpdated {n}\none of it\ntwo of it\nAs it was said\nConclusion"
    bare = [f"<body><div>Long constant text of copies that is the same</div><div>and more of it, all of it the same text</div><div>Day {n}</div></body>" for n in range(5)]
    assert text(bare[1], made_of(bare)).startswith("Long constant text")


def test_recurring_headings_and_items_stay():
    pages = [article(f"<p>Recipe {n} is about {n * 3} cooks and their long days.</p><h2>Ingredients</h2><ul><li>Salt</li><li>{n} eggs</li></ul><h2>Method</h2><p>Stir {n} times</p><h2>Conclusion</h2>", n) for n in range(6)]
    made = made_of(pages)
    assert text(pages[3], made) == "Title 3\nRecipe 3 is about 9 cooks and their long days.\nIngredients\nSalt\n3 eggs\nMethod\nStir 3 times\nConclusion"


@pytest.mark.parametrize("n", [60, 260, 3000])
def test_many_named_siblings_after_an_advert(n):
    wide = "<body><article><div class=advert>Buy it</div>" + "".join(f"<div id=s{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>Section {k}</div>" for k in range(n)) + "</article></body>"
    assert text(wide) == "\n".join(f"Section {k}" for k in range(n))
    assert text(wide, made_of([wide, wide.replace("Section", "Part")])) == text(wide)


def test_names_count_as_a_whole_and_never_for_text():
    body = "<h2 id=privacy-and-related-work>Privacy and related work</h2><p class=share-price>Shares rose</p><div class=share-price>Again</div><p class=notice>A notice in words</p><div class='cookie-notice box'>Cookies!</div><section id=site-footer-2>Foot</section>"
    assert text(article("<p>The text of the page, which is long.</p>" + body)) == "Title 0\nThe text of the page, which is long.\nPrivacy and related work\nShares rose\nAgain\nA notice in words"


def test_link_lists_after_text_stay_and_menus_before_it_go():
    links = "".join(f"<li><a href=/{k}>Source number {k}</a></li>" for k in range(4))
    body = f"<p>The text of the page, which is long enough to be its main text, and goes on for some time.</p><h2>References</h2><ol>{links}</ol>"
    assert text(article(body)).endswith("References\nSource number 0\nSource number 1\nSource number 2\nSource number 3")
    menu = f"<body><div class=content><ul>{links}</ul><h1>T</h1>{body}</div></body>"
    assert text(menu).startswith("T\nThe text") and text(menu).endswith("Source number 3")


def naive(tree):
    """The text of an article element without what its tags leave out, block by block."""
    found = re.search(r"<article>(.*)</article>", tree, re.DOTALL)[1]
    found = re.sub(r"<(aside|nav|form|script)\b.*?</\1>", "\n", found, flags=re.DOTALL)
    lines = re.sub(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|section)\b[^>]*>", "\n", re.sub(r"</?(?:b|a)\b[^>]*>", "", found)).split("\n")
    return "\n".join(" ".join(x.split()) for x in lines if x.strip())


def test_small_hosts_match_a_naive_extractor():
    rng = random.Random(6)
    for _ in range(40):
        pages, shared = [], [f"<{t}>{' '.join(rng.choices('abcdefg', k=9))}</{t}>" for t in rng.choices(["p", "h2", "blockquote"], k=4)]
        for n in range(rng.randint(1, 6)):
            kinds = ["<p>one <b>two</b> three {} {}</p>", "<h3>head {}</h3>", "<ul><li>x {}</li><li>y</li></ul>", "<aside>buy {}</aside>", "<form>q</form>", "<script>x=1</script>", *shared]
            body = "".join(rng.choice(kinds).format(rng.randint(0, 10**6), rng.randint(0, 10**6)) for _ in range(rng.randint(3, 12)))
            pages.append(f"<body><nav>menu {n}</nav><article><h1>The title of page {n} says much</h1><p>Some words that are its own {rng.random()}</p>{body}</article><footer>f</footer></body>")
        made = made_of(pages)
        assert [text(x, made) for x in pages] == [naive(x) for x in pages]


def test_extract_over_odd_rows(spark, tmp_path, monkeypatch):
    rows = [(n, f"http://h{n % 2}.example/{n}", page(n), "t") for n in range(12)] + [(20, None, None, "t"), (21, "nonsense", "", "t"), (22, "http://h0.example/", page(1), "t"), (22, "http://h0.example/", page(1), "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    small = sorted(((r.page_id, r.text) for r in html_extract.extract(frame).collect()), key=str)
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(((r.page_id, r.text) for r in html_extract.extract(frame).collect()), key=str) == small
    assert len(small) == len(rows) and dict(small)[20] == "" and "Body 4" in dict(small)[4]
    assert html_extract.extract(frame.limit(0)).count() == 0
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op3_html(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and all(r.n_chars == len(r.text) for r in got.collect())


def test_url_query_matches_sql(spark):
    assert same(spark, queries.op10_url_filter, queries.OP10_SQL, SF) == 250


def test_topk_query_matches_sql(spark):
    assert same(spark, queries.op9_topk, queries.OP9_SQL, SF) == 500


def test_validity_intervals_and_odd_captures(spark):
    events = spark.createDataFrame(
        [("block", "Bad.Example.", "add", "2024-01-10"), ("block", "bad.example", "remove", "2024-02-01"), ("block", "bad.example", "add", "2024-03-01"), ("allow", "ok.bad.example", "add", "2024-01-01"), ("block", "site.example/a/b/", "add", "2024-01-01"), ("block", "Site.example/News", "add", "2024-01-01"), ("block", None, "add", "2024-01-01"), ("block", " ", "add", "2024-01-01"), ("block", "x.example", "add", None), ("block", "bad.example", "add", "2024-01-10")],
        "policy string, entry string, action string, day string",
    ).selectExpr("policy", "entry", "action", "cast(day as timestamp) at")
    rows = [
        (1, "http://bad.example/", "2024-01-09", False), (2, "http://bad.example/", "2024-01-10", True), (3, "https://u:p@www.BAD.example.:80/x", "2024-01-31", True), (4, "http://bad.example/", "2024-02-01", False),
        (5, "http://bad.example/", "2024-03-05", True), (6, "http://ok.bad.example/", "2024-03-05", False), (7, "http://notbad.example/", "2024-03-05", False), (8, "http://site.example/a/b?q", "2024-03-05", True),
        (9, "http://site.example//a/b/c#x", "2024-03-05", True), (10, "http://site.example/a/bc", "2024-03-05", False), (11, None, "2024-03-05", False), (12, "no host", "2024-03-05", False), (13, "http://bad.example/", None, False), (2, "http://bad.example/", "2024-01-10", True),
        (14, "http://SITE.example/News/x", "2024-03-05", True), (15, "http://site.example/news/x", "2024-03-05", False),
    ]
    frame = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, day string, want boolean, policy2 string").selectExpr("page_id", "url", "want", "cast(day as timestamp) fetched_at", "policy2 as key")
    got = url_filter.evaluate(frame, events).collect()
    assert len(got) == len(rows) and all(r.blocked == r.want for r in got)
    clash = url_filter.evaluate(frame.selectExpr("*", "'mine' as policy", "1 as since"), events)
    assert clash.columns == url_filter.evaluate(frame, events).columns and clash.where("blocked").count() == sum(r[3] for r in rows)
    assert url_filter.evaluate(frame.limit(0), events).count() == 0 and url_filter.evaluate(frame, events.limit(0)).where("blocked").count() == 0
