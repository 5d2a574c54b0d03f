import pytest

from kinetable.llm import maintext as M

LONG = (
    "The cat sat on the mat and it was there for all of the day with the other animals in the house, and then it went to the garden to look at "
    "the birds which were in the trees. That is what it did when it was in the mood for it."
)
NEXT = "It was the best of the times and it was also the worst of them, as all of us know from the book that we have read in the school when we were so young."


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<article><h1>A &amp; B</h1><p>One&nbsp;two<br>three <b>four</b>\n five</p></article><footer>&copy; 2020 the of and</footer>", "A & B\nOne two three four five"),
        (f"<nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>{LONG}</div><article><h1>T</h1><p><b>Short.<br></article><footer>x</footer>", "T\nShort."),
        (f"<body class='page has-sidebar'><div id=content><h2>Title here</h2><p>{LONG}</p><p>Short one.</p><p>{NEXT}</p></div><div class='sidebar'><p>{LONG}</p></div>", f"Title here\n{LONG}\nShort one.\n{NEXT}"),
        (f"<main><p>{LONG}</p><section id='comments'><article><p>{LONG}</p></article></section></main>", LONG),
        (f"<article><p>{LONG}</p><form><label>Name</label><input><textarea>{LONG}</textarea></form><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>", LONG),
        (f"<article><p>{LONG}</p><ul class=related><li><a href=a>One story</a></li></ul><div role=navigation>{LONG}</div></article>", LONG),
        (f"<article><p>{LONG}</p><p>cut off &am", f"{LONG}\ncut off &am"),
        (f"<article><p>{LONG}</p><p title='a > b'>kept</p><p clas", f"{LONG}\nkept"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><p>&#x41;&#66;&eacute;&lt;p&gt;</p></article>", "ABé<p>"),
        (f"<div class='cookie-notice'>{LONG}</div><p>{LONG}</p><p hidden>{NEXT}</p>", LONG),
        ("</p></div>stray <b>text", ""),
    ],
)
def test_pages(page, text):
    assert M.main_text(page) == text


@pytest.mark.parametrize("tag", "video-js svg-icon button-group map-view select-box object-view script-box".split())
def test_custom_elements_are_ordinary(tag):
    assert M.main_text(f"<article><p>{LONG}</p><{tag} id=v></{tag}><p>{NEXT}</p></article>") == f"{LONG}\n{NEXT}"


@pytest.mark.parametrize("tag", "select button object canvas svg math audio video map".split())
def test_hidden_elements_end_with_their_parent(tag):
    for page in (
        f"<article><p>{LONG}</p><div><{tag} a='b > c'>no</div><p>{NEXT}</p></article>",
        f"<article><p>{LONG}</p><table><tr><td><{tag}>no<td>{NEXT}</table></article>",
        f"<article><p>{LONG}</p><p>{NEXT}<{tag} class=share><div>no</div>no</{tag}></p></article>",
        f"<article><p>{LONG}<{tag} class=share>no<p>{NEXT}</article><footer><{tag}>no</{tag}></footer>",
        f"<article><p>{LONG}</p><p>{NEXT}<{tag} a='b>no</{tag}></p></article>",
    ):
        assert M.main_text(page) == f"{LONG}\n{NEXT}"
    assert M.main_text(f"<article><p>One <{tag} id=x><div>no<br><br>no</div></{tag}> two <{tag}/> three</p></article>") == "One two three"


def test_ends_of_raw_text_and_of_unclosed_paragraphs():
    assert M.main_text(f"<article><p>{LONG}</p><script>var a = '<p>{NEXT}</p>'</article>") == LONG
    assert M.main_text(f"<article><p>{LONG}<video src=x>no<p>{NEXT}</article>") == f"{LONG}\n{NEXT}"
    assert M.main_text(f"<article><p>{LONG}<object data=x><p>no</p></object></p><p>{NEXT}</article>") == f"{LONG}\n{NEXT}"
    assert M.main_text(f"<article><p>One <object><object>no</object>no</object>two <span hidden>no</span>three</p></article>") == "One two three"


def test_nothing_is_cut_from_long_pages():
    page = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(3000)) + "</article>"
    assert M.main_text(page) == "\n".join(f"{LONG} {k}" for k in range(3000))


def test_table(spark):
    rows = [(1, "u", f"<article><p>é {LONG}</p></article>", "x"), (1, "u", f"<article><p>é {LONG}</p></article>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(str((r.page_id, r.url, r.text, r.n_chars)) for r in M.extract_text(pages).collect())
    one = str((1, "u", f"é {LONG}", len(LONG) + 2))
    assert got == sorted([one, one, str((2, None, "", 0)), str((None, "v", "", 0))])
    assert M.extract_text(pages.limit(0)).count() == 0


PROSE = [
    f"The committee said that it was going to look at the plans for the canal, and that they had been in the works for a long time because of the many rules that apply to it in this part of the country, number {k}."
    for k in range(4)
]
ARTICLES = [
    '<article class="post category-legal tag-social">', '<main class="site-main comments-open">', '<article id="related-work">', '<div class="article-body restaurant-menu-review">',
    '<form id="f" action="x">', '<article class="hentry tag-newsletter tag-cookies has-sidebar">', '<div class="post-content no-sidebar">', '<div id="content" class="with-share">',
    '<section class="entry category_navigation">', '<div class="story topic-advertising">', '<main id="login-guide">', '<div class="popup-story">', '<div class="page comments-closed">',
    '<article class="post format-alert">', '<div role="main" class="menu-open">', '<article class="post-1 related">', '<div class="term-footer body">', '<div class="the-social-network review">',
    '<div class="entry-content"><div class="series-notices">', '<div class="l-share-price-report">',
]


@pytest.mark.parametrize("start", ARTICLES)
def test_names_do_not_outrank_article_text(start):
    tag = start[1:].split()[0].rstrip(">")
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f'<html><body class="home comments-open"><nav>Home About Contact</nav>{start}{body}</{tag}><div class="site-footer-inner">© 2020 The company</div></body></html>'
    assert M.main_text(page) == "\n".join(PROSE)


@pytest.mark.parametrize("start", [
    '<div class="site-footer">', '<div class="c-nav__list">', '<div id="main-sidebar-2">', '<div class="newsletter-signup-box">', '<section class="post-share-buttons">', '<div class="comments-area">', '<aside>',
])
def test_other_parts_stay_out(start):
    tag = start[1:].split()[0].rstrip(">")
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f"<html><body><div>{body}</div>{start}<p>{PROSE[0].replace('committee', 'reader')}</p></{tag}></body></html>"
    assert M.main_text(page) == "\n".join(PROSE)


def test_long_reader_comments_stay_out():
    story = "<p>" + "It was the best of the times for the people in the town. " * 8 + "</p>"
    comments = "".join(f'<article class="comment-{k}"><p>{p * 4}</p></article>' for k, p in enumerate(PROSE))
    for page in (f'<body><div>{story}</div><div class="comments">{comments}</div></body>', f"<body><div>{story}</div>{comments}</body>"):
        assert "committee" not in M.main_text(page) and "best of the times" in M.main_text(page)
