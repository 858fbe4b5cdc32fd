"""The region types: what each is, where it belongs and what becomes of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Structural types and their block.
STRUCTURAL = {
    "title": "heading", "heading": "heading",
    "text": "prose", "summary": "prose", "quote": "quote", "callout": "prose", "transcript": "prose", "footnote": "prose",
    "list": "list", "steps": "list", "definition_list": "list", "references": "list",
    "table": "table", "infobox": "pairs", "metadata": "pairs", "stats": "pairs",
    "code": "code", "math": "code",
    "image": "media", "gallery": "media", "video": "media", "audio": "media", "chart": "media", "map": "media", "canvas": "media", "embed": "media",
    "decoration": "empty", "unclear": "mixed",
}
# Slot types and the slot they declare.
SLOT_OF = {
    "site_header": "header", "site_nav": "header", "search": "header", "account": "header", "skip_link": "header", "site_notice": "header",
    "site_footer": "footer", "legal_notice": "footer",
    "section_nav": "nav", "breadcrumbs": "nav", "table_of_contents": "nav", "pagination": "nav", "tabs": "nav", "version_switcher": "nav", "settings": "nav", "filters": "nav",
    "byline": "byline", "author_bio": "author", "badge": "byline", "correction": "notice", "disclosure": "notice", "content_warning": "notice",
    "comments": "comments", "reviews": "reviews", "rating": "reviews", "reactions": "comments", "vote_controls": "comments", "user_card": "comments",
    "related": "related", "teaser_card": "teasers", "product_card": "listing", "trending": "trending", "tag_cloud": "tags", "external_links": "related",
    "ad": "ad", "sponsored": "ad", "cross_promo": "promo", "newsletter": "promo", "subscribe": "promo", "paywall": "paywall", "app_nag": "promo",
    "hero": "hero", "feature_grid": "features", "cta": "cta", "testimonial": "testimonials", "logo_cloud": "features", "team": "features", "pricing_table": "pricing",
    "form": "form", "login_form": "form", "poll": "form", "feedback": "form", "contact_details": "contact", "download": "article", "calendar": "article",
    "toolbar": "tools", "page_tools": "tools", "share": "tools", "action_button": "tools", "accordion": "article",
    "cookie_banner": "gate", "consent_gate": "gate", "age_gate": "gate", "popup": "gate", "sticky_bar": "gate", "chat_widget": "gate",
    "buy_box": "listing", "cart": "listing", "checkout": "listing",
    "status_message": "notice", "empty_state": "notice", "progress": "notice",
}
# Types that open a section.
OPENING = frozenset(
    "site_header site_nav site_footer legal_notice section_nav breadcrumbs table_of_contents comments reviews related teaser_card "
    "trending cross_promo newsletter subscribe feature_grid testimonial product_card pricing_table hero cookie_banner consent_gate "
    "tag_cloud logo_cloud team".split()
)
# Slot types that always are one block.
FIXED_BLOCK = {
    "teaser_card": "cards", "product_card": "cards", "user_card": "cards", "related": "cards", "trending": "cards", "feature_grid": "cards", "team": "cards", "logo_cloud": "cards",
    "comments": "thread", "reviews": "thread",
    "site_nav": "links", "section_nav": "links", "breadcrumbs": "links", "table_of_contents": "links", "tag_cloud": "links", "external_links": "links",
}
# Dispositions other than keep.
DROP = frozenset("ad sponsored cross_promo newsletter subscribe paywall app_nag cookie_banner consent_gate age_gate popup sticky_bar chat_widget site_notice decoration skip_link".split())
DEMOTE = frozenset(
    "site_header site_nav site_footer legal_notice account search version_switcher settings share page_tools toolbar feedback "
    "action_button related trending tag_cloud external_links hero cta logo_cloud unclear table_of_contents section_nav breadcrumbs "
    "pagination tabs filters".split()
)

TYPES = (*STRUCTURAL, *SLOT_OF)


# The types of two earlier lists, in their order.
V49 = (
    "title heading summary text byline metadata image gallery video audio table list steps quote code math callout infobox "
    "footnote references table_of_contents embed comments rating tabs related teaser_card pagination external_links form search "
    "action_button site_header site_nav section_nav breadcrumbs page_tools account share site_footer cookie_banner ad sponsored "
    "newsletter subscribe paywall app_nag decoration unclear"
)
V109 = (
    "title heading summary key_points text byline author_bio metadata badge correction disclosure content_warning image gallery "
    "chart video audio transcript table list steps definition_list faq timeline quote code code_output math callout infobox "
    "footnote references table_of_contents accordion tabs embed map poll calendar contact_details download comments reviews "
    "rating reactions vote_controls post_header user_card related teaser_card product_card trending tag_cloud archive_nav "
    "pagination external_links sitelinks form login_form search filters action_button buy_box cart checkout pricing_table "
    "settings site_header site_nav section_nav breadcrumbs version_switcher page_tools feedback account share site_footer "
    "legal_notice skip_link site_notice cookie_banner consent_gate age_gate popup sticky_bar chat_widget ad sponsored newsletter "
    "subscribe paywall app_nag cross_promo hero feature_grid cta testimonial logo_cloud stats team dashboard_widget data_grid "
    "toolbar canvas status_message empty_state progress decoration unclear"
)

#: Named lists of types that a label run may use; ``with_type_list`` adds or replaces one.
TYPE_LISTS: dict[str, tuple[str, ...]] = {"current": TYPES, "v49": tuple(V49.split()), "v109": tuple(V109.split())}


def with_type_list(name: str, types: Iterable[str], lists: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """The named lists with one more, or another one of that name; a type may stand in it once."""
    own = tuple(types)
    if not own or len(set(own)) < len(own):
        raise ValueError(f"list {name} is empty or has a type twice")
    return {**(TYPE_LISTS if lists is None else lists), name: own}


def type_lists_table(spark: SparkSession, lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(list, type) of all named lists."""
    return spark.createDataFrame([(n, t) for n, types in (TYPE_LISTS if lists is None else lists).items() for t in types], "list string, type string")


def type_lists_sql(lists: dict[str, tuple[str, ...]] | None = None) -> str:
    """The same table as SQL values."""
    rows = ", ".join(f"('{n}', '{t}')" for n, types in (TYPE_LISTS if lists is None else lists).items() for t in types)
    return f"(select * from (values {rows}) as v(list, type))"


def disposition(kind: str) -> str:
    return "drop" if kind in DROP else "demote" if kind in DEMOTE else "keep"


def type_rows() -> list[tuple]:
    """(type, structural, block, slot, opens, disposition); block is null where the region's structure decides."""
    return [(t, t in STRUCTURAL, STRUCTURAL.get(t) or FIXED_BLOCK.get(t), SLOT_OF.get(t), t in OPENING, disposition(t)) for t in TYPES]


def types_table(spark: SparkSession) -> DataFrame:
    """The taxonomy as a table of fixed size, safe to broadcast."""
    return spark.createDataFrame(type_rows(), "type string, structural boolean, block string, slot string, opens boolean, disposition string")


def types_sql() -> str:
    """The same table as SQL values."""
    quote = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in type_rows())
    return f"(select * from (values {rows}) as v(type, structural, block, slot, opens, disposition))"
