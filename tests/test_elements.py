"""Fields of pages by selectors."""

import pytest
from pyspark.sql import functions as F

from listingflow.functions import html
from listingflow.functions.elements import Fields, Tree, compiled, first, select_fields

DETAIL = """<!doctype html><body><h1 class="x top-card-layout__title">A &amp; B</h1><a class='topcard__org-name-link' href=/c> Acme <b>Ltd</b> </a>
<div class="topcard__flavor-row z"><span class="topcard__flavor topcard__flavor--bullet"> Rome <i>IT</i></span></div><span class=posted-time-ago__text>2 days</span>
<ul><li><h3 class=h> Seniority level </h3><span> Senior </span><li><h3>Job function</h3><p>no</p><span>Mining</span></ul>
<div class="description__text--rich"><div class="show-more-less-html__markup"><div>First part.</div><p>Second <b>part.</p></div></div>
<span class="tvm__text--low-emphasis tvm__text"><strong>Remote</strong></span>"""


def fields(page, **table):
    return dict(zip(table, Fields(table).take(Tree(page))))


def test_detail_pages(spark):
    df = spark.createDataFrame([(1, DETAIL), (2, None), (3, ""), (4, "<div class=description__text--rich><div class='show-more-less-html__markup'><div>open"), (5, "<<>< h1 class=topcard__title>"), (6, "x" * 100_000 + "<p>" * 20_000)], "k int, h string")
    got = {r["k"]: r["d"].asDict() for r in df.select("k", html.detail_record(F.col("h")).alias("d")).collect()}
    assert got[1] == {
        "title": "A & B", "company": "Acme Ltd", "location": "Rome", "postedTime": "2 days", "applicants": "", "salaryRange": "", "descriptionText": "First part.Second part.",
        "seniorityLevel": "Senior", "employmentType": "", "jobFunction": "Mining", "industries": "", "remoteBox": "Remote",
    }
    empty = dict.fromkeys(got[1], "")
    assert got[2] == got[3] == got[5] == got[6] == empty and got[4] == {**empty, "descriptionText": "open"}


def test_cards_nested_and_broken(spark):
    card = "<li class=r><div class='base-card' data-entity-urn='urn:li:jobPosting:%d'><a class='base-card__full-link' href='/jobs/view/go-dev-%d?a=1&amp;b=2'>x</a><img data-delayed-url='%s' src=s.png><h3 class=base-search-card__title><div> Go <b>dev</b></div> Remote</h3><h4 class='base-main-card__subtitle'><span>By <a href=/acme>Acme</a></span></h4><span class='job-search-card__location'>Rome</span></div><ul><li>inner</li></ul></li>"
    page = "<ul>" + card % (7, 7, "d.png") + "<li>none</li>" + card % (8, 8, "") + "<li><div class='base-search-card'>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = df.select(F.explode(html.card_records(F.col("h"), ["go"], F.lit("2024-05-06").cast("timestamp"))).alias("c")).select("c.*").collect()
    assert [(r["id"], r["title"], r["company"], r["companyUrl"], r["url"], r["img"], r["location"], r["stackRequired"], r["remoteOk"]) for r in got] == [
        ("7", "Go dev Remote", "By Acme", "/acme", "/jobs/view/go-dev-7?a=1&b=2", "d.png", "Rome", ["go"], True),
        ("8", "Go dev Remote", "By Acme", "/acme", "/jobs/view/go-dev-8?a=1&b=2", "s.png", "Rome", ["go"], True),
        ("", "", "", "", "", "", "", [], False),
    ]


def test_selectors():
    page = "<div id=a class='x y'><p class=q>one<p class='q r'>two<span>three</span></div><div class=xx><p>four</p><em>five</em><p>six</p></div>"
    tree = Tree(page)
    text = lambda s: (lambda k: None if k is None else tree.whole[slice(*tree.spans[k])])(first(tree, compiled(s)))
    assert text("p") == "one" and text(".r") == "twothree" and text("div.y.x > p.r span") == "three" and text("div > span") is None
    assert text("[class*=xx] p") == "four" and text("em ~ p") == "six" and text("p:contains(fo) ~ em") == "five" and text("em, p.r") == "twothree" and text("div[id] p") == "one"
    assert fields(page, a=((".none", "em"), "text"), b=((".q.r",), "own"), c=(("div",), "id"), d=((".none",), "text")) == {"a": "five", "b": "two", "c": "a", "d": ""}
    for wrong in ("", "a:hover", "p[", "> "):
        with pytest.raises(ValueError):
            compiled(wrong)


def test_own_tables(spark):
    df = spark.createDataFrame([("<title>T &lt;</title><style>p{}</style><p>x",), (None,)], "h string")
    got = [tuple(r["f"]) for r in df.select(select_fields(F.col("h"), {"t": (("title",), "text"), "p": (("article", "p"), "text")}).alias("f")).collect()]
    assert got == [("T <", "x"), ("", "")]
