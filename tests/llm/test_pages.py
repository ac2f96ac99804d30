"""Main text and language of pages."""

import math
import time
from html.parser import HTMLParser

import pytest

from graphloom.llm.extraction import extract_main_text, main_text, second_pass
from graphloom.llm.language import CELLS, DECLARED_SMOOTH, MOST, SMOOTH, TEMPER, identify_language, trigrams
from graphloom.llm.shared import table

BODY = "It is the first of the long paragraphs that the page is about, and there is more of it in the next one."
PAGE = f"""<html><head><title>T</title><script>if (a < b) {{ x("<p>no</p>") }}</script></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>{BODY}<p>Short.<br>caf&eacute;&#33;   x</p><table><tr><td>one</td><td>two</td></tr></table></article>
<aside>Related</aside><form><input value=q>Subscribe</form><div class="comments"><p>{BODY}</p></div><footer>(c)</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == f"Head & line\n{BODY}\nShort. café! x\none\ntwo"


def test_without_semantic_tags():
    page = f"<div><a href=a>one</a> <a href=b>two</a></div><div><p>{BODY}</p><p>Yes.</p><p>{BODY}</p></div><div><a href=c>three</a></div>"
    assert main_text(page) == f"{BODY}\nYes.\n{BODY}"


def test_misleading_articles():
    """The body stands in plain divs, teasers in articles."""
    teasers = "".join(f"<article><h3><a href=/{k}>Another story {k}</a></h3><p>Teaser {k}</p></article>" for k in range(3))
    page = f"<nav>Home</nav><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div><div>{teasers}</div><footer>(c)</footer>"
    assert main_text(page) == f"Head\n{BODY}\n{BODY}"
    assert main_text(f"<div>{teasers}</div>{page}") == f"Head\n{BODY}\n{BODY}"


def test_link_lists_in_an_article():
    links = "See <a href=/1>another of the stories that we have on this site and in it</a>"
    page = f"<article><h1>Head</h1><p>{BODY}</p><ul><li>{links}</li><li>{links}</li></ul><p>The end.</p><p>{BODY}</p><p>Bye.</p></article><footer>(c)</footer>"
    assert main_text(page).split("\n")[:2] == ["Head", BODY]
    assert "another of the stories" not in main_text(page)
    assert main_text(page).endswith(f"{BODY}\nBye.")


def test_short_article_without_other_text():
    assert main_text("<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>Of.</p><p>To it.</p></article><footer>(c)</footer>") == "Head\nOf.\nTo it."


def test_broken_pages():
    for page in (None, "", "<", "<p", "<script>never closed", "<!-- never closed", "&#xZZ; &bogus", "</div></div>" * 50, "<div>" * 5000):
        assert isinstance(main_text(page), str)


def test_undecided_blocks_follow_the_nearer_neighbour():
    assert second_pass([1, 0, 0, 0, -1]) == [True, True, False, False, False]
    assert second_pass([0, 0, -1]) == [True, True, False]  # nothing to inherit


def test_short_pages_keep_all_of_their_text():
    assert main_text("<body><p>Short note.</p></body>") == "Short note."
    assert main_text("<h1>Title</h1><p>One line.</p><p>Two lines.</p>") == "Title\nOne line.\nTwo lines."
    assert main_text("<nav><a href=/>Home</a></nav><p>Short note.</p><footer>(c)</footer>") == "Short note."


@pytest.mark.parametrize("page", ["<a " * 80_000, '<a "' * 80_000 + ">", '<a ">" ' * 80_000, "<![CDATA[" * 80_000 + "<p>x</p>", "<div>" * 40_000 + "</span></p></section>" * 40_000, "<!" * 100_000, "<video>" * 100_000, "<a x='" * 80_000 + ">", "<div class=ad>x " * 40_000, "<article>x " * 40_000, "<" * 400_000, "<p>" * 100_000])
def test_long_broken_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


PARAGRAPHS = [f"{k} of the many things that are said in this article is that it was written by one of us for all of you, and that with it there is not much to be done about the weather of the day." for k in ("One", "Another")]
ARTICLE = "<article>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>"
PLAIN = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        "<div id='page' class='site has-sidebar'>{}</div>",
        "<div class='content no-sidebar'>{}</div>",
        "<form id=aspnetForm action='/x'>{}</form>",
        "<div id=search-results-page-wrapper>{}</div>",
        "<div class='layout sidebar-right'><div class=menu-page>{}</div></div>",
        "<body class='modal-open nav'><div role=search>{}</div></body>",
        "<header><nav><a href=/>The home of it all</a></nav></header>{}<footer>(c) the owners of this and of that</footer>",
        "{}<div class=comments><p>It is the first of the comments that are on this page, and it is not of the article.</p></div>",
        "{}<ol class=comment-list><li><article class='comment-body'><p>It is the first of the comments that are on this page, and not of the article.</p></article></ol>",
        "{}<section class=related-posts><article><p>This is the start of one of the other posts that are to be read on this site.</p></article></section>",
        "{}<aside><article><p>This is the start of one of the other posts that are to be read on this site.</p></article></aside>",
        "<video src=a.mp4>{}",
        "<iframe src=a>{}",
        "<button>{}",
        "<select><option>{}",
    ],
)
@pytest.mark.parametrize("body", [ARTICLE, PLAIN])
def test_wrappers_and_open_elements_keep_the_article(page, body):
    assert main_text(page.format(body)) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("begin", ["<article class='hentry comments-open'>", "<article class='post has-sidebar no-comments'>", "<article id=related>", "<main class=search-page><div class=sidebar-left>", "<main><form class=login>"])
def test_classes_of_articles(begin):
    assert main_text(begin + PLAIN) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("tag", ["<video src=a.mp4>", "<iframe src=a>", "<button>", "<noscript>", "<svg>", "<map>"])
def test_elements_without_an_end_inside_an_article(tag):
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p>{tag}<p>{PARAGRAPHS[1]}</p></article>") == "\n".join(PARAGRAPHS)


def test_scripts_without_an_end_take_the_rest():
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p><script>var a = '<p>'; {PARAGRAPHS[1]}") == PARAGRAPHS[0]


@pytest.mark.parametrize("attribute", ["data-x=o'clock", "title=5\"", "alt='a > b'", 'x="a > b" y', "data-y = 'it > \"that\"'", "it's", "=\"", "a==\"b>c\""])
def test_quotes_open_after_an_equals_sign_only(attribute):
    assert main_text(f"<article><p {attribute}>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></article>").replace('c">', "").endswith("\n".join(PARAGRAPHS))


def test_linked_sentence_of_an_article_goes_with_its_neighbours():
    link = "See <a href=/p>the long paper on the things that are said of this and of that in the years that were</a> for it."
    plain = link.replace("<a href=/p>", "").replace("</a>", "")
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p><p>{link}</p><p>{PARAGRAPHS[1]}</p></article>") == "\n".join([PARAGRAPHS[0], plain, PARAGRAPHS[1]])
    teaser = "<a href=/q>All of the other things that are to be read on this site and on that</a>"
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p><p>{teaser}</p><p>{PARAGRAPHS[1]}</p></article>") == "\n".join(PARAGRAPHS)


def test_outer_parts_inside_an_article_stay_out():
    assert main_text(f"<article><p>{PARAGRAPHS[0]}</p><div class=ad>Buy all of the things that are on sale in this shop of the town, and be with us.</div><p>{PARAGRAPHS[1]}</p><div class=share>Share it with all of the people that you are with</div></article>") == "\n".join(PARAGRAPHS)


class Articles(HTMLParser):
    """The characters in articles, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.out.append(data)


def test_whole_table_against_another_parser(spark, sf_dir):
    """The pages of the tables hold their main text in one article."""
    pages = table(spark, sf_dir, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_main_text(pages).collect():
        parser = Articles()
        parser.feed(html[r["page_id"]] or "")
        assert "".join(r["text"].split()) == "".join("".join(parser.out).split())


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "http://a.fr/", "", "x"), (None, "not an address", PAGE, "x"), (2, "http://a.fr/", PAGE * 50, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_main_text(pages).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    texts = spark.createDataFrame([(BODY, "en"), ("il est dans la maison et les gens sont la pour la fin", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    found = identify_language(pages, texts).collect()
    assert len(found) == 4
    assert all(r["lang"] in ("en", "fr") for r in found)
    assert all(r["lang"] is None for r in identify_language(pages, texts.limit(0)).collect())
    assert identify_language(pages.limit(0), texts).collect() == []
    assert extract_main_text(pages.limit(0)).collect() == []


def test_languages_of_all_pages(spark, sf_dir):
    got = identify_language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    assert got.count() == table(spark, sf_dir, "pages").count()
    assert got.filter("lang <=> text_lang").count() >= 0.95 * got.count()


def test_fusion_against_brute_force(spark):
    """Text likelihoods, declarations and smoothed priors, page by page in plain Python."""
    french = "il est dans la maison et les gens sont la pour la fin de la vie que nous avons"
    texts = [(BODY, "en"), (french, "fr"), (BODY[::-1], "xx")]
    rows = [(k, f"http://{h}/{k}", f"<html lang={d}><article><p>{t}</p></article>") for k, (h, d, t) in enumerate([("a.x.fr", "fr", french), ("a.x.fr", "en", french), ("b.x.fr", "fr", BODY), ("www.z.com", "en", BODY), ("www.z.com", "fr", "of la"), ("z.com", "xx", ""), ("", "en", french)])]
    found = {r["page_id"]: r for r in identify_language(spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.createDataFrame(texts, "text string, lang string")).collect()}
    langs, counts = ["en", "fr", "xx"], {}
    for text, lang in texts:
        counts[lang] = [0] * CELLS
        for c in trigrams(text):
            counts[lang][c] += 1
    logs = {x: [math.log((c + 0.5) / (sum(counts[x]) + 0.5 * CELLS)) for c in counts[x]] for x in langs}
    likelihood = []
    for _, _, page in rows:
        own = [sum(logs[x][c] for c in trigrams(main_text(page))) * TEMPER for x in langs]
        likelihood.append([max(v - max(own), -MOST) for v in own])
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    post = [soft(v) for v in likelihood]
    told = [page.split("lang=")[1].split(">")[0] for _, _, page in rows]
    table_ = {t: [sum(p[i] for p, x in zip(post, told, strict=True) if x == t) for i in range(3)] for t in [*langs, "other"]}
    for k, (_, url, _) in enumerate(rows):
        host = url.split("/")[2]
        prior, own = None, len(rows)
        prior = [(sum(p[i] for p in post) - post[k][i] + SMOOTH / 3) / (own - 1 + SMOOTH) for i in range(3)]
        for of in (lambda h: h.rsplit(".", 1)[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
            if not host:
                break
            group = [j for j in range(len(rows)) if rows[j][1].split("/")[2] and of(rows[j][1].split("/")[2]) == of(host)]
            prior = [(sum(post[j][i] for j in group) - post[k][i] + SMOOTH * prior[i]) / (len(group) - 1 + SMOOTH) for i in range(3)]
        column = [sum(table_[t][i] for t in table_) + DECLARED_SMOOTH for i in range(3)]
        declared = [math.log((table_[told[k]][i] + DECLARED_SMOOTH / 4) / column[i]) for i in range(3)]
        fused = soft([math.log(prior[i]) + likelihood[k][i] + declared[i] for i in range(3)])
        assert found[k]["lang"] == langs[fused.index(max(fused))]
        assert abs(found[k]["posterior"] - max(fused)) < 1e-5


def test_the_address_decides_without_text(spark):
    french = "il est dans la maison et les gens sont la pour la fin de la vie que nous avons"
    rows = [(k, f"http://www.site.fr/{k}", f"<article><p>{french} {k}</p></article>") for k in range(12)]
    rows += [(100 + k, f"http://www.site.com/{k}", f"<article><p>{BODY} {k}</p></article>") for k in range(12)]
    rows += [(50, "http://www.site.fr/empty", ""), (51, "http://www.site.com/empty", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = spark.createDataFrame([(BODY, "en"), (french, "fr")] * 3, "text string, lang string")
    lang = {r["page_id"]: r["lang"] for r in identify_language(pages, texts).collect()}
    assert (lang[50], lang[51]) == ("fr", "en")
