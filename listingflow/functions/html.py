"""Fields of captured listing pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingflow.functions.elements import select_each, select_fields
from listingflow.functions.numbers import card_salary, to_utc_date
from listingflow.functions.text import first_filled, remote_flag, stack_tags, trimmed

#: Where a search page keeps its cards and their fields.
CARD = r"""(<div[^>]*class="[^"]*base-search-card[^"]*"[^>]*>[\s\S]*?</div>\s*</div>)"""
CARD_FIELDS = {
    "title": r"""<h3[^>]*class="[^"]*base-search-card__title[^"]*"[^>]*>([^<]*?)</h3>""",
    "company": r"""<h4[^>]*class="[^"]*base-search-card__subtitle[^"]*">[\s\S]*?<a[^>]*>([^<]*?)</a>""",
    "location": r"""<span[^>]*class="[^"]*job-search-card__location[^"]*"[^>]*>([^<]*?)</span>""",
    "url": r"""href="([^"]*jobs/view/[^"]*)\"""",
}


def search_cards(html: Column, card: str = CARD, fields: dict[str, str] = CARD_FIELDS) -> Column:
    """An array with the fields of every card that has title, company and URL; its id is the digits after the URL's last hyphen."""
    take = lambda c, p: F.nullif(trimmed(F.regexp_extract(c, p, 1)), F.lit(""))
    made = F.transform(F.regexp_extract_all(html, F.lit(card), 1), lambda c: F.struct(*[take(c, p).alias(n) for n, p in fields.items()]))
    good = F.filter(made, lambda x: x["title"].isNotNull() & x["company"].isNotNull() & x["url"].isNotNull())
    number = lambda u: first_filled(F.regexp_extract(F.substring_index(F.substring_index(u, "?", 1), "-", -1), r"(\d+)", 1))
    return F.transform(good, lambda x: F.struct(F.coalesce(number(x["url"]), F.lit("unknown")).alias("id"), *[x[n].alias(n) for n in fields]))


def tag_text(html: Column, tag: str, mark: str = "") -> Column:
    """The text of the first element ``tag`` whose attributes contain ``mark``; empty without one."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*{mark}[^>]*>(.*?)</{tag}>", 1)
    return trimmed(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " "))


def detail_fields(html: Column, places: dict[str, tuple[str, str]]) -> Column:
    """A struct of texts by (tag, mark); all of them empty for a missing page."""
    return F.struct(*[F.coalesce(tag_text(html, t, m), F.lit("")).alias(n) for n, (t, m) in places.items()])


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("""(?i)<a\\s[^>]*href="([^"]*)\""""), 1)


#: Selectors of a card's parts, the first that is there counts.
CARD_ITEMS, CARD_HOLDS = "li", "[class*=base-search-card],[class*=base-main-card]"
CARD_TABLE = {
    "urn": (("[data-entity-urn]",), "data-entity-urn"),
    "title": ((".base-search-card__title", ".base-main-card__title"), "text"),
    "url": ((".base-card__full-link", ".base-search-card--link"), "href"),
    "company": ((".base-search-card__subtitle", ".base-main-card__subtitle"), "text"),
    "companyUrl": ((".base-search-card__subtitle a", ".base-main-card__subtitle a"), "href"),
    "location": ((".job-search-card__location", ".main-job-card__location"), "text"),
    "day": ((".job-search-card__listdate", ".job-search-card__listdate--new", ".main-job-card__listdate"), "datetime"),
    "salary": ((".job-search-card__salary-info", ".main-job-card__salary-info"), "text"),
    "late": (("img",), "data-delayed-url"),
    "now": (("img",), "src"),
}
#: Selectors of the fields of a detail page.
DETAIL_TABLE = {
    "title": (("h1.top-card-layout__title, h1.topcard__title",), "text"),
    "company": (("a.topcard__org-name-link",), "text"),
    "location": (("div[class*=topcard__flavor-row] > span[class*=topcard__flavor--bullet]",), "own"),
    "postedTime": (("span.posted-time-ago__text",), "text"),
    "applicants": (("span.num-applicants__caption",), "text"),
    "salaryRange": (("div.compensation__salary, span.main-job-card__salary-info",), "text"),
    "descriptionText": (("div.description__text--rich div.show-more-less-html__markup",), "text"),
    "seniorityLevel": (("h3:contains(Seniority level) ~ span",), "own"),
    "employmentType": (("h3:contains(Employment type) ~ span",), "own"),
    "jobFunction": (("h3:contains(Job function) ~ span",), "own"),
    "industries": (("h3:contains(Industries) ~ span",), "own"),
    "remoteBox": (("span.tvm__text.tvm__text--low-emphasis strong",), "text"),
}


def card_records(html: Column, stacks: list[str], now: Column) -> Column:
    """An array of records of 18 fields, one for each list item of a search page that holds a card; none for a null page.

    The page is read once, nested and broken markup as it stands; parts that aren't there are empty.
    """

    def record(c: Column) -> Column:
        url = F.regexp_replace(c["url"], r"(?i)^(?:https?://(?:www\.)?linkedin\.com){1,2}(https?://)", "$1")
        pay = card_salary(c["salary"])
        fields = {
            "id": F.regexp_extract(F.substring_index(c["urn"], ":", -1), r"(\d+)", 1),
            "city": c["location"], "url": url, "companyUrl": c["companyUrl"], "img": F.coalesce(F.nullif(c["late"], F.lit("")), c["now"]),
            "date": to_utc_date(F.lit(None).cast("string"), now), "postedDate": to_utc_date(c["day"], now), "title": c["title"], "company": c["company"],
            "location": c["location"], "salaryCurrency": pay["currency"], "salaryMax": pay["max"], "salaryMin": pay["min"], "countryCode": F.lit(""), "countryText": F.lit(""),
            "descriptionHtml": F.lit(""), "remoteOk": remote_flag(c["title"]), "stackRequired": stack_tags(c["title"], url, stacks),
        }
        return F.struct(*[x.alias(n) for n, x in fields.items()])

    return F.transform(select_each(html, CARD_ITEMS, CARD_HOLDS, CARD_TABLE), record)


def detail_record(html: Column) -> Column:
    """A struct of the twelve fields of a detail page, from one pass; those that aren't there, and all of a null page, are empty."""
    return select_fields(html, DETAIL_TABLE)
