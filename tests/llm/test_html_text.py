import html
import random
import re
import time

from typetrace.llm.common import table
from typetrace.llm.html_text import extract_pages, main_text

LONG = "A sentence of the article that is long enough to raise the sum of its window well above the surge."


def test_article_of_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    text = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", text[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def page(*parts):
    return "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


def test_named_containers_are_no_text():
    for junk in ("<nav>%s</nav>", "<header>%s</header>", "<footer>%s</footer>", "<aside>%s</aside>", "<form>%s</form>", "<script>%s</script>", "<style>%s</style>",
                 '<div class="cookie-notice">%s</div>', '<div id="sidebar">%s</div>', '<section class="adBanner">%s</section>', '<ul role="navigation"><li>%s</ul>',
                 '<div class="reader comments"><p>%s</p></div>', "<div hidden>%s</div>", "<!-- %s -->", '<div style="display: none">%s</div>'):
        assert main_text(page(junk % LONG, f"<div><h2>Head</h2><p>{LONG}</p></div>", junk % LONG)) == f"Head {LONG}"
        if "header" in junk:  # an article's own header has its title
            continue
        assert main_text(page(f"<article><p>Short.</p>{junk % LONG}<p>End.</p></article>", f"<p>{LONG}</p>")) == "Short. End."


def test_blocks_references_and_white_space():
    assert main_text(page("<article><p>a&amp;b &lt;c&gt;\n\t d<b>e</b>f<br>g<p>&eacute;&#233;&#xe9;</article>")) == "a&b <c> def g ééé"
    assert main_text("<article>1 < 2 and <b class='>'>x</b></article>") == "1 < 2 and x"


def test_lists_of_links_are_no_text():
    links = "".join(f'<p><a href="/{i}">A link with a rather long title number {i}</a></p>' for i in range(20))
    assert main_text(page(links, "<hr>" * 5, f"<p>{LONG}</p><p>Short.</p>", links)) == f"{LONG} Short."


def test_text_after_adverts_stays():
    body, advert = f"<p>{LONG}</p>" * 8, "<div class='ad'><div><p>Buy</p></div><div><p>now</p></div></div>"
    assert main_text(page(body, advert * 4, f"<p>{LONG}</p>")) == " ".join([LONG] * 9)
    assert main_text(page(body, advert, "<p>The end.</p>")) == " ".join([LONG] * 8 + ["The end."])


def test_a_name_alone_drops_no_body():
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    for wrap in ('<div class="story share-enabled">%s</div>', '<div class="search-result notice-board"><div id="content">%s</div></div>', '<div class="banner-page"><article>%s</article></div>'):
        assert main_text(page("<nav>Home</nav>", wrap % body, "<footer>Imprint</footer>")) == f"Head {LONG} {LONG}"
    inner = f'<div class="story share-enabled">{body}<div class="share"><p>Tell your friends</p></div></div>'
    assert main_text(page(inner)) == f"Head {LONG} {LONG}"


def test_paragraphs_with_links_stay():
    linked = '<p>See <a href="/1">the long title of a first source</a> and <a href="/2">the title of a second one</a>.</p>'
    assert main_text(page(f"<p>{LONG}</p>", linked, f"<p>{LONG}</p>")) == f"{LONG} See the long title of a first source and the title of a second one. {LONG}"


def plain(lines):
    """Text between the first surge and the last dive, line by line from the rules: (text, characters in links)."""
    total = lambda i: (sum(len(t) for t, _ in lines[i:i + 3]), sum(n for _, n in lines[i:i + 3]))
    sums = [0 if n > 0.5 * t else t for t, n in map(total, range(len(lines)))]
    least = 86 if max(sums, default=0) >= 86 else 1
    inside = set()
    for i in range(len(lines)):
        if sums[i] >= least:
            while i < len(lines) and sums[i]:
                inside.add(i)
                i += 1
    if not inside:
        return ""
    mostly = [2 * n > len(t) for t, n in lines]
    kept = [k for k in range(min(inside), min(len(lines), max(inside) + 3)) if lines[k][0] and any(sums[j] for j in (k - 2, k - 1, k) if j >= 0)]
    while kept and mostly[kept[0]]:
        kept = kept[1:]
    while kept and mostly[kept[-1]]:
        kept = kept[:-1]
    return " ".join(lines[k][0] for k in kept)


def test_random_pages_match_a_plain_version():
    rnd = random.Random(2)
    for _ in range(300):
        lines = []
        for _ in range(rnd.randrange(30)):
            text = " ".join("word" * rnd.randrange(1, 4) for _ in range(rnd.choice([1, 2, 5, 20])))
            lines.append((text, len(text) if rnd.random() < 0.5 else 0))
        markup = "".join(f"<p><a href='/'>{t}</a></p>" if n else f"<p>{t}</p>" for t, n in lines)
        spaced = [("", 0)] if lines else []
        for line in lines:
            spaced += [line, ("", 0)]
        assert main_text(f"<body>{markup}</body>") == plain(spaced)


def test_odd_markup_takes_time_in_proportion():
    for piece in ("<div></section>", "</", "<!", "<p", "<div>", "</div>", "<a href=\"", "<!--"):
        took = []
        for size in (1 << 18, 1 << 20):
            start = time.process_time()
            main_text(piece * (size // len(piece)) + "end")
            took.append(time.process_time() - start)
        assert took[1] < 3 + 12 * took[0] and took[1] < 8, (piece, took)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<<<>>>"), (6, "u", "<script>never ends"),
            (7, "u", "<article>" + "<p>word</p>" * 50_000), (7, "u", "<article>x</article>"), (None, "u", "<div><div></p></div>t"), (8, "u", '<a href="' * 300), (9, "u", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(((r.page_id, r.text[:20], r.n_chars) for r in extract_pages(df).collect()), key=repr)
    assert (1, "", 0) in got and (2, "", 0) in got and (3, "plain words", 11) in got and (4, "unclosed bold", 13) in got and (6, "", 0) in got and (9, "", 0) in got
    assert (7, "x", 1) in got and (7, "word word word word ", 249_999) in got and (None, "t", 1) in got
    assert len(got) == len(rows)
    assert extract_pages(df.filter("false")).collect() == []
