"""HTML corpora held as (url, html) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import contact_fields
from ..functions.links import ANY_REPORT_FILE, FULL_INSPECTION, REPORT_LINK_DATE, anchors
from ..functions.markup import PAGE, elements, has_class
from ..functions.text import non_blank, squeeze, strip

# ---- fixed values ---------------------------------------------------------
MIN_MAIN_TEXT = 500
SCHOOL_ROW = r"school_([0-9]+)"
SCHOOL_SLUG = r"institutions/school/([^/?#]+)"
COLLECTION = ("section", ".gem-c-document-list__item", ".gem-c-document-list")
PUBLICATIONS = "/government/publications/"
NO_SECTION = "Notices"
# ---------------------------------------------------------------------------


def extract_links(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per anchor: position, href, text (in page order)."""
    found = pages.select(*keep, F.posexplode_outer(anchors(F.col(html))).alias("position", "a"))
    return found.where(F.col("position").isNotNull()).select(
        *keep, "position", F.col("a.href").alias("href"), F.col("a.text").alias("text")
    )


def extract_contacts_dl(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return pages.select(*keep, contact_fields(F.col(html)).alias("c")).select(*keep, "c.*")


def html_main_text(html: Column) -> Column:
    """Text of main / article / wrapper / body, else of the page, blanks squeezed; null when short.

    Several elements of a kind give their texts one after the other; one
    inside another of its kind is not repeated.
    """
    found = elements(html, ["main", "article", ".govuk-main-wrapper", "body", PAGE])

    def text(cond) -> Column:
        held = F.filter(found, lambda e: cond(e) & ~e["inner"])
        return non_blank(F.array_join(F.transform(held, lambda e: e["text"]), ""))

    named = lambda n: text(lambda e: e["name"] == n)
    wrapper = text(lambda e: has_class(e, "govuk-main-wrapper"))
    main = F.coalesce(named("main"), named("article"), wrapper, named("body"), named(PAGE))
    main = strip(F.regexp_replace(F.regexp_replace(main, r"[\s\x{A0}]+\n", "\n"), r"[ \t]{2,}", " "))
    return F.when(F.length(main) >= MIN_MAIN_TEXT, main)


def best_report_link(html: Column) -> Column:
    """struct(href, report_date, is_full): full inspections first, then newest.

    Works on the anchors of one page, so no exchange is needed.
    """

    def candidate(a: Column, i: Column) -> Column:
        raw = non_blank(F.regexp_extract(a["text"], REPORT_LINK_DATE, 1))
        iso = F.when(raw.rlike("^[0-9]{4}-"), raw.try_cast("date"))
        named = F.try_to_date(
            F.regexp_replace(raw, r"^([0-9]+)\s+([A-Za-z]{3})[A-Za-z]*\s+([0-9]{4})$", "$1 $2 $3"), "d MMM yyyy"
        )
        day = F.coalesce(iso, named)
        full = a["text"].rlike(FULL_INSPECTION)
        return F.struct(
            (~full).alias("light"),
            (-F.coalesce(F.unix_date(day), F.lit(0))).alias("age"),
            i.alias("i"),
            a["href"].alias("href"),
            day.cast("string").alias("report_date"),
            full.alias("is_full"),
        )

    usable = F.filter(
        anchors(html), lambda a: a["href"].rlike(ANY_REPORT_FILE) & a["text"].rlike("(?i)inspect|report")
    )
    best = F.array_min(F.transform(usable, candidate))
    return F.when(
        best.isNotNull(),
        F.struct(best["href"].alias("href"), best["report_date"].alias("report_date"), best["is_full"].alias("is_full")),
    )


def _exploded(pages: DataFrame, html: str, keep: tuple[str, ...], wanted: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
    found = pages.select(*keep, F.explode_outer(elements(F.col(html), wanted, groups)).alias("e"))
    return found.where(F.col("e").isNotNull())


def school_listing(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Result rows of listing pages: isi_id, slug, name, address (null when blank), in page order by ``position``.

    ``keep`` identifies a page. A row counts with an id of its own and a link
    to a school in its name cell; the first such link and the first location
    cell are taken.
    """
    found = _exploded(pages, html, keep, ("tr", "td", "a"), (".result",))
    e = F.col("e")
    name_link = (e["name"] == "a") & F.array_contains(F.split("e.up_class", r"\s+"), "name") & e["href"].rlike(SCHOOL_SLUG)
    place = (e["name"] == "td") & has_class(e, "location")
    row = (e["name"] == "tr") & has_class(e, "result")
    owner = F.when(row, e["at"]).otherwise(e["group"])
    facts = found.where(row | (name_link | place) & e["group"].isNotNull()).select(
        *keep,
        owner.alias("position"),
        e["at"].alias("at"),
        F.when(row, non_blank(F.regexp_extract(e["id"], SCHOOL_ROW, 1))).alias("isi_id"),
        F.when(name_link, F.struct(F.regexp_extract(e["href"], SCHOOL_SLUG, 1).alias("slug"), squeeze(e["text"]).alias("name"))).alias("link"),
        F.when(place, F.struct(squeeze(e["text"]).alias("address"))).alias("place"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    rows = facts.groupBy(*keep, "position").agg(F.max("isi_id").alias("isi_id"), first("link"), first("place"))
    return rows.where(F.col("isi_id").isNotNull() & F.col("link").isNotNull()).select(
        *keep, "position", "isi_id", "link.slug", "link.name", non_blank(F.col("place.address")).alias("address")
    )


def collection_links(pages: DataFrame, base: str, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Publication links of collection pages: href (made absolute by ``base``), title, section; one row for each href.

    ``keep`` identifies a page. The section is the first heading of the
    innermost list around a link, or "Notices"; of several links to one href
    the one in the list that opens last counts, the last one within it.
    """
    found = _exploded(pages, html, keep, (*COLLECTION, "h2", "h3", "a"), COLLECTION)
    e = F.col("e")
    listed = (e["name"] == "section") | has_class(e, COLLECTION[1][1:]) | has_class(e, COLLECTION[2][1:])
    heading = e["name"].isin("h2", "h3")
    link = (e["name"] == "a") & e["group"].isNotNull() & e["href"].contains(PUBLICATIONS) & (squeeze(e["text"]) != "")
    origin = base[: base.index("/", base.index("://") + 3)]
    href = (
        F.when(e["href"].startswith("http"), e["href"])
        .when(e["href"].startswith("/"), F.concat(F.lit(origin), e["href"]))
        .otherwise(F.concat(F.lit(base[: base.rindex("/") + 1]), e["href"]))
    )
    # Lists, headings and links of a page stay together from here on: the pages are read once, and no size of what
    # they hold is guessed for a join.
    facts = found.where(listed | heading | link).select(
        *keep,
        e["at"].alias("at"),
        F.when(listed, F.struct(e["last"].alias("last"))).alias("list"),
        F.when(heading, F.struct(e["at"].alias("at"), strip(e["text"]).alias("text"))).alias("head"),
        F.when(link, F.struct(e["group"].alias("group"), href.alias("href"), strip(e["text"]).alias("title"))).alias("link"),
    )
    facts = facts.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keep)) if keep else facts
    # the first heading that opens after a list's start tag is its own if the list still lasts
    ahead = Window.partitionBy(*keep).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    headed = facts.withColumn("head", F.last("head", ignorenulls=True).over(ahead))
    own = F.when(F.col("head.at") <= F.col("list.last"), non_blank(F.col("head.text")))
    as_list = F.when(F.col("list").isNotNull(), F.struct(F.col("at").alias("group"), F.lit(True).alias("listed"), own.alias("section")))
    as_link = F.when(
        F.col("link").isNotNull(),
        F.struct(F.col("link.group").alias("group"), F.lit(False).alias("listed"), F.lit(None).cast("string").alias("section")),
    )
    roles = headed.select(*keep, "at", "link.href", "link.title", F.explode(F.array_compact(F.array(as_list, as_link))).alias("r"))
    of_group = Window.partitionBy(*keep, "r.group")
    named = roles.select(
        *keep, "r.group", "r.listed", "at", "href", "title",
        F.max("r.listed").over(of_group).alias("known"),
        F.coalesce(F.max("r.section").over(of_group), F.lit(NO_SECTION)).alias("section"),
    ).where(~F.col("listed") & F.col("known"))
    last = F.max_by(F.struct("title", "section"), F.struct("group", "at"))
    return named.groupBy(*keep, "href").agg(last.alias("l")).select(*keep, "href", "l.title", "l.section")
