"""Common shapes of pages: parts of an article side by side, and readers' comments that are articles by their tag."""

from evtspark.llm import html_text


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n)) + "."


def texts(spark, pages):
    df = spark.createDataFrame([(k, "https://site.example/p", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.main_text(df).orderBy("id").collect()]


def test_both_halves_of_an_article_stay(spark):
    usual = [f'<body><div class="main"><div class="first"><p>{words(f"u{k}x", 80)}</p></div></div></body>' for k in range(8)]
    split = f'<body><div class="main"><div class="first"><p>{words("a", 45)}</p></div><div class="second"><p>{words("b", 55)}</p></div></div></body>'
    got = texts(spark, [*usual, split])
    assert got[-1] == f"{words('a', 45)} {words('b', 55)}" and got[:-1] == [words(f"u{k}x", 80) for k in range(8)]


def test_the_vote_still_decides(spark):
    """A page whose own best container is one that no other page has stays on the host's path."""
    usual = [f'<body><div class="wrap"><div class="story"><p>{words(f"u{k}x", 80)}</p></div></div></body>' for k in range(8)]
    odd = f'<body><div class="wrap"><section class="tray"><div class="x"><p>{words("more", 30)}</p></div></section><div class="story"><p>{words("s", 80)}</p></div></div></body>'
    page = html_text.Page(odd)
    story = next(n for n in page.containers() if n.tag == "div" and n.good == len(words("s", 80)) and n.depth == 2)
    assert page.text_of(story.path) == words("s", 80) and page.text_of(story.path, frozenset({max(page.containers(), key=page.score).path})) != words("s", 80)
    assert texts(spark, usual) == [words(f"u{k}x", 80) for k in range(8)]


def test_comments_are_no_articles(spark):
    def page(n, length, wrapped=True):
        talk = "".join(f'<li><article class="comment-body"><p>{words(f"c{k}x", length)}</p></article></li>' for k in range(n))
        talk = f'<div id="comments" class="comments-area"><ol class="comment-list">{talk}</ol></div>' if wrapped else talk.replace("<li>", "").replace("</li>", "")
        return f'<body><main><article class="post"><h1>{words("t", 4)}</h1><p>{words("a", 60)}</p></article>{talk}</main></body>'

    want = f"{words('t', 4)} {words('a', 60)}"
    assert texts(spark, [page(0, 0), page(1, 20), page(3, 40), page(12, 60), page(2, 20, False)]) == [want] * 5


def test_a_discussion_that_is_the_page_stays(spark):
    assert texts(spark, [f'<body><article class="discussion"><p>{words("d", 60)}</p></article></body>']) == [words("d", 60)]
