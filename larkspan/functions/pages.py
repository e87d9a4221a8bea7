"""Fields of listing pages and cards, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of a listing card in a result page.
CARD = r"(?s)<article[^>]*data-name=['\"]CardComponent['\"].*?</article>"
CARD_LINK = r"(?s)data-name=['\"]LinkArea['\"].*?<a[^>]*href=['\"]([^'\"]*)['\"]"
CARD_TITLE = r"(?s)data-mark=['\"]OfferTitle['\"][^>]*>\s*<span[^>]*>(.*?)</span>"
CARD_DESCRIPTION = r"(?s)data-name=['\"]Description['\"].*?<p[^>]*>(.*?)</p>"
CARD_GALLERY = r"(?s)data-name=['\"]Gallery['\"].*?</ul>"
CARD_PHOTO = r"<img[^>]*src=['\"]([^'\"]+)['\"]"
CARD_ID = r"/([0-9]+)/?(?:[?#].*)?$"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def page_card(html: Column) -> Column:
    """B33. Title, heading, first paragraph and links of a page."""
    return F.struct(
        F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1).alias("heading"),
        F.regexp_extract(html, "(?s)<p>(.*?)</p>", 1).alias("description"),
        _all(html, '<a href="([^"]*)"').alias("links"),
    )


def cards(html: Column) -> Column:
    """B33. The listing cards of a result page: id, link, title, description, photos."""

    def card(block: Column) -> Column:
        link = F.regexp_extract(block, CARD_LINK, 1)
        return F.struct(
            F.nullif(F.regexp_extract(link, CARD_ID, 1), F.lit("")).try_cast("long").alias("id"),
            link.alias("link"),
            F.regexp_extract(block, CARD_TITLE, 1).alias("title"),
            F.regexp_extract(block, CARD_DESCRIPTION, 1).alias("description"),
            _all(F.regexp_extract(block, CARD_GALLERY, 0), CARD_PHOTO).alias("photos"),
        )

    return F.transform(_all(html, CARD, 0), card)
