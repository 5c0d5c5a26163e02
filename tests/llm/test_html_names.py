"""Elements that are told by their names: compound ones, wrappers, and what pages themselves teach."""

import pytest

from quillon.llm import html_extract as H

REST = ["comment-list", "cookie-banner", "related-posts", "ad-slot", "share-buttons", "alert-box", "userComments", "ad", "notice top", "footer_links", "promo-2 large", "RelatedArticles", "site-cookie-consent"]
KEPT = ["content has-sidebar", "with-comments", "widget-area-wrapper", "page-with-menu", "no-share", "article-body", "unheard-of", "adapt", "commence", "lead", ""]


def page(inner, wrap="div"):
    return f"<body><nav>menu</nav><article><h1>Title here</h1><p>Words of the first paragraph are here.</p>{inner}<p>More words of the last one.</p></article><footer>foot</footer></body>"


@pytest.mark.parametrize("name", REST)
def test_compound_names_inside_the_article_go(name):
    got = H.extract(page(f'<div class="{name}"><p>not this</p></div>'), H.default_weights())
    assert got == "Title here\nWords of the first paragraph are here.\nMore words of the last one."


@pytest.mark.parametrize("name", KEPT)
def test_other_names_stay(name):
    got = H.extract(page(f'<div class="{name}"><p>but this</p></div>'), H.default_weights())
    assert got == "Title here\nWords of the first paragraph are here.\nbut this\nMore words of the last one."


@pytest.mark.parametrize("name", [*KEPT, "sidebar-layout", "ad-free"])
def test_wrappers_of_the_article_stay(name):
    got = H.extract(f'<body><div class="{name}">{page("")}</div></body>', H.default_weights())
    assert got == "Title here\nWords of the first paragraph are here.\nMore words of the last one."


def test_sections_by_id_and_role():
    inner = '<section id="comments-section"><p>no</p></section><div role="navigation">no</div><div hidden>no</div><div id="chapter-2"><p>yes</p></div>'
    assert H.extract(page(inner), H.default_weights()).split("\n")[2:-1] == ["yes"]


def test_pages_teach_names(spark):
    """A name that is seen only beside articles is left out inside one too; one that is seen around them stays."""
    beside = '<body><div class="quux-zone"><p>a b c</p></div><div class="frobwrap"><article><h1>T</h1><p>one two three four</p></article></div><div class="quux-zone">x</div></body>'
    df = spark.createDataFrame([(k, beside, "u") for k in range(5)], "page_id long, html string, url string")
    weights = H.learned(df)
    assert weights.parts["quux"] < H.LEAST and weights.parts["frobwrap"] > 0
    assert H.article_counts(beside)["part:quux"] == [0, 2] and H.article_counts(beside)["part:frobwrap"] == [1, 0]
    assert "no" not in H.extract(page('<div class="quux">no</div>'), weights).split("\n")
    assert "no" in H.extract(page('<div class="quux">no</div>'), H.default_weights()).split("\n")


def plain_extract(html, weights):
    """The whole method without the linear scan: every run of events is summed."""
    seen = H.events(html, weights.parts)
    scores = [weights.get(k, -0.01 if k.endswith((":inner", ":article", ":raw")) else -1.0) if t is None else weights.get(k, 0.2) * len(t.split()) for k, t, _ in seen]
    best = max(((sum(scores[a:b]), -a, -(b - a)) for a in range(len(seen)) for b in range(a + 1, len(seen) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return ""
    run = seen[-best[1] : -best[1] - best[2]]
    import html as entities

    text = "".join("\n" if edge else (" " if k.startswith("tag:para") else "") if t is None else "" if k == "word:none" else entities.unescape(" ".join(["", *t.split(), ""]) if t.strip() else " ") if t else "" for k, t, edge in run)
    return "\n".join(x for x in (" ".join(b.split()) for b in text.split("\n")) if x)


def test_the_whole_method_equals_a_plain_version():
    weights = H.default_weights()
    for inner in ['<div class="comment-list"><p>no</p></div>', "<ul><li>a</li><li>b c</li></ul>", "x<br>y &amp; z", '<table><tr><td>1</td><td>2</td></tr></table><aside>no</aside>', ""]:
        for html in (page(inner), page(inner).replace("article", "div"), f"<div class='menu'>m n o</div>{page(inner)}<div id=comments>q r s</div>"):
            assert H.extract(html, weights) == plain_extract(html, weights), html
