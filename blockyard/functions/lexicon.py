"""Patterns of what a region's names and text say, and their flags as bit sets.

Arrow looks for the patterns in a batch of texts (RE2, one pass over a text for each pattern, whatever it holds).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of class, id, role and label, in lower case.
HINTS = {
    "cookie": r"cookie|consent|gdpr|privacy-(banner|notice|center)|sp_message|sourcepoint",
    "comments": r"\bcomment|disqus|discussion|conversation|replies|\bthread",
    "reviews": r"\breview",
    "rating": r"\brating|stars?\b|score",
    "vote": r"\bvot(e|ing)|upvote|downvote|useful",
    "reaction": r"reaction|\blike-|likes\b|clap|applause",
    "share": r"\bshare|sharedaddy|social|addthis|sociable",
    "byline": r"byline|author(?!-bio)|dateline|writtenby|p-author|timestamp|posted-on|post-meta|article-meta|entry-meta|meta-dynamic",
    "authorBio": r"author-bio|bio\b|about-the-author|author-box|author-card",
    "related": r"related|recommend|also-like|you-may|more-like|similar|read-more|more-from|further|see-also|hatnote",
    "trending": r"trending|popular|most-read|most-viewed|most-shared|hot-network|top-stories|top-picks|best-?seller",
    "tags": r"\btags\b|tag-cloud|tag-list|taglist|topic-list|keywords",
    "newsletter": r"newsletter|mailing|email-signup|formkit|seva-form",
    "subscribe": r"subscribe|subscription|membership|member-only",
    "paywall": r"paywall|regwall|meter|premium|locked|gate\b",
    "ad": r"(^|[^a-z])ad([^a-z]|$)|advert|adbox|ad-unit|ad-slot|adslot|banner-ad|dfp|gpt-|taboola|outbrain|skyscraper|billboard|mpu\b|leaderboard",
    "sponsored": r"sponsor|branded|partner-content|paid-post|promoted",
    "promo": r"promo|cross-?promo|upsell|marketing|campaign|house-ad",
    "toolbar": r"toolbar|tool-bar|actions-bar|action-bar",
    "pageTools": r"page-tools|page-actions|article-tools|article-actions|post-actions",
    "hero": r"\bhero|jumbotron|masthead-hero|splash|cover-wrap|billboard-hero",
    "testimonial": r"testimonial|pull-?quote|quote-card|customer-story",
    "pricing": r"pricing|price-table|plans?\b|tier",
    "cta": r"\bcta\b|call-to-action|signup-cta|get-started|try-|start-",
    "card": r"\bcard(?!__heading)|teaser|promo-card|article-item|post-item|listing-item|result-item|product-item|entry-list|item-card|story-card",
    "product": r"product|listing|sku|price\b|buy",
    "infobox": r"infobox|fact-?box|key-facts|at-a-glance|vcard|summary-box",
    "callout": r"admonition|hatnote|\bnote\b|alert|notice|warning|callout|tip\b|important|caution|dyk|did-you-know",
    "caption": r"caption|credit",
    "accordion": r"accordion|collapsible|expandable",
    "tabs": r"\btabs?\b|tablist|tabbed|underline-?nav",
    "filters": r"filter|facet|sort-?by|refine",
    "search": r"search|searchbox|search-form|typeahead",
    "login": r"login|log-in|signin|sign-in|password|auth\b",
    "account": r"account|user-menu|profile-menu|avatar|signup|sign-up|register",
    "breadcrumb": r"breadcrumb|crumb",
    "pagination": r"paginat|pager\b|page-nav|load-more|show-more|see-more|next-page|prev-page",
    "toc": r"\btoc\b|table-of-contents|tableofcontents|contents-list|in-this-article|jump-links|on-this-page|sidebar-nav|left-nav",
    "references": r"reference|citation|reflist|cite|bibliograph|sources?\b|works-cited",
    "footnote": r"footnote|fn-|endnote|noteref|sosumi|legal-footnote",
    "skip": r"skip-?(to|link|nav)|visually-hidden|sr-only|screen-reader",
    "footer": r"\bfooter|\bfoot\b|site-footer|page-footer|colophon",
    "header": r"\bheader|masthead|site-header|page-header|top-?bar|navbar|global-nav|topbar",
    "nav": r"\bnav\b|\bmenu|navigation|subnav|sidenav|sidebar-nav|section-nav|local-nav|tabs-nav",
    "legal": r"legal|copyright|terms|disclaimer|imprint|impressum|sosumi|fine-?print",
    "disclosure": r"disclosure|affiliate|why-trust|trust-|editorial-standards|how-we-test",
    "version": r"version|edition|language|lang-|locale|switcher|dropdown-lang|region-select",
    "settings": r"settings|preferences|appearance|\bunits?\b",
    "steps": r"instruction|direction|method|steps?\b|procedure|how-to",
    "ingredients": r"ingredient",
    "nutrition": r"nutrition",
    "gallery": r"gallery|slideshow|carousel|slider|photos",
    "video": r"video|player|youtube|vimeo|jwplayer|brightcove",
    "audio": r"audio|podcast|listen",
    "chart": r"\bchart|\bgraph\b|infographic|visuali[sz]ation|datawrapper|flourish",
    "map": r"\bmap\b|leaflet|mapbox|google-maps",
    "code": r"\bcode|highlight|syntax|prettyprint|codeblock",
    "quote": r"blockquote|\bquote|pullquote",
    "stats": r"\bstats?\b|statistic|counter|numbers|metrics|figures",
    "team": r"\bteam\b|staff|people|members",
    "logos": r"logo-?(cloud|wall|bar|grid)|trusted-by|as-seen|partners|customers-logos|clients",
    "feature": r"feature|benefit|bento|value-prop|capabilit|solution",
    "form": r"\bform\b|fieldset|input-group",
    "poll": r"\bpoll\b|survey|vote-poll",
    "chat": r"\bchat|intercom|drift|livechat|bot\b|assistant",
    "sticky": r"sticky|fixed-bar|floating|toast|snackbar",
    "popup": r"\bmodal\b|popup|lightbox|interstitial",
    "empty": r"empty|placeholder|skeleton|no-results|nothing",
    "progress": r"progress|loading|spinner|skeleton|loader",
    "status": r"status|flash|alert-success|alert-error",
    "decoration": r"decorat|divider|separator|spacer|ornament|icon-only",
    "title": r"\btitle|headline|heading-1|page-title|article-title|entry-title|post-title|firstheading|first-heading",
    "summary": r"standfirst|\bdeck\b|\blede\b|lead\b|subtitle|sub-?head|excerpt|summary|description|abstract|intro\b|dek\b|teaser-text|tldr",
    "content": r"article|entry-content|post-content|content-body|story-body|article-body|prose|rich-text|wysiwyg|body-copy|paragraph",
    "metadata": r"\bmeta\b|recipe-details|specs?\b|specification|key-facts|quick-facts|properties|attributes|about-item|details-list",
    "transcript": r"transcript",
    "correction": r"correction|amend|clarification",
    "contentWarning": r"content-warning|trigger-warning|sensitive|nsfw",
    "badge": r"\bbadge|\bpill\b|\bchip\b|tag-label",
    "contact": r"contact-(us|details|info)|\baddress|\bphone|email-us|get-in-touch|vcard",
    "download": r"download|attachment|file-list|\bpdf\b",
    "cart": r"\bcart|basket|bag\b",
    "checkout": r"checkout|payment|billing",
    "buy": r"buy-?box|add-to-cart|purchase|price-box|offer-box|deals?\b",
    "calendar": r"calendar|schedule|dates|events",
    "canvas": r"\bcanvas\b|whiteboard|drawing-area|board-canvas",
    "agegate": r"age-?gate|age-verif|adult",
    "appNag": r"app-banner|smart-banner|get-the-app|download-app|open-in-app|app-nag|install-app",
    "siteNotice": r"site-notice|announcement|global-alert|banner-notice|top-notice|promo-bar",
    "external": r"external-links|outbound|links-section",
    "user": r"user-card|profile-card|user-info|author-card|member-card|hovercard",
    "feedback": r"feedback|helpful|was-this|rate-this-page",
}

# Patterns of the text, in any case.
TEXTS = {
    "byline": r"^\s*(by|von|par|written by|words by|photograph(y|s)? by)\b|last modified|modified on|answered|asked \d|edited \d|\b(by|von)\s+[A-Z][a-z]+\s+[A-Z]|published|updated on|updated \d|posted (on|by)|min(ute)?s? read|\b\d+ ?(hours?|days?|minutes?|weeks?|months?|years?) ago\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.? \d{1,2},? \d{4}|\d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]* \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\/\d{1,2}\/\d{2,4}",
    "hnSubtext": r"\d+ points? by \S+ .*\bcomments?\b|\bpoints? by\b",
    "cookie": r"\bcookies?\b|consent|we and our partners|accept all|manage (your )?(cookies|preferences|choices)|privacy (policy|settings)|personali[sz]ed ad",
    "skip": r"^skip (to|navigation)|^jump to (main|content|navigation)|^back to top",
    "legal": r"©|\(c\) ?\d{4}|copyright|all rights reserved|\bterms (of|&|and)\b|privacy policy|\bimprint\b|\bimpressum\b|is not responsible for|trademark|registered in",
    "signin": r"^(sign|log) ?in\b|^(sign|log) ?in ?(or|\/) ?(sign ?up|register|create)|sign in or register|create (a |an )?(free )?account|^register\b|^sign ?up\b|^log ?in\b|^my account|^account$|^profile$",
    "subscribe": r"\bsubscribe\b|\bsubscription\b|newsletter|sign up (for|to) (our|the)|get (our|the) (free )?newsletter|inbox|join (free|now|today)|become a (member|supporter)",
    "paywall": r"subscribe to (read|continue)|to continue reading|already (a )?subscriber|member-only|members only|log in to (read|view)|you('ve| have) reached|free articles? (left|remaining)|unlock (this|full|all)|premium (access|content|subscri)",
    "related": r"^(related|more|read more|you may also like|you might also like|recommended|see also|more (from|on|like|in) |also (in|on) |further reading|more stories|explore more|next up|up next|latest from|discover more)",
    "trending": r"^(most (read|popular|viewed|shared|commented)|trending|popular|top (stories|picks|rated)|hot network|what's hot|editor'?s picks|best ?sellers?)",
    "comments": r"^(comments?|discussion|responses?|replies|join the conversation|leave a (reply|comment)|add a comment|\d+ comments?)\b",
    "reviews": r"^(customer )?reviews?\b|\breviews? \(\d|\d+ reviews?\b|write a review",
    "rating": r"\d(\.\d)? ?(out of|\/) ?(5|10)\b|\d+(,\d{3})* ratings?\b|★|☆|\d(\.\d)? stars?\b|\brate (this|it)\b|\bratings?\b",
    "vote": r"^(upvote|downvote|vote)|this (answer|question) (is|shows)|useful|not useful|\+\d+\b.*\b\d+$|▲|▼",
    "share": r"^(share|share this|share on|copy link|tweet|email this|print)\b",
    "pagination": r"^(load more|show more|see (all|more)|more results|view (all|more)|next( page)?|previous( page)?|older|newer|page \d|\d+ of \d+|«|»|›|‹|→|←)\b|^(\d+\s*){3,}$",
    "search": r"^search\b|search the site|search for|^find\b|type to search|search\.\.\.|^q$",
    "cta": r"^(get started|start (now|free|your)|try (it|now|free)|sign up (now|free)|download (now|the app)|buy now|shop now|contact sales|book (now|a demo)|request (a )?demo|join (now|us|free)|apply now|donate|support us)\b",
    "appNag": r"(get|open|download|use) (the |our )?app\b|available on the app store|get it on google play|continue in (the )?app|better in the app",
    "contact": r"\b(tel|call us|email us|contact us|opening hours|\+\d{1,3}[ -]?\d{2,4}[ -]?\d{3,4})\b",
    "ago": r"\b(\d+|a|an|over a) ?(hours?|days?|minutes?|weeks?|months?|years?|h|d|m) ago\b|\byesterday\b|\btoday\b",
    "answered": r"^(answered|asked|edited|modified|viewed)\b",
    "steps": r"^(step \d|\d+\.\s)|^(preheat|mix|stir|add|bake|whisk|combine|heat|cook|pour|place|remove|serve|let|cool|beat|fold|roll|cut|chop|slice|drain|season|bring|reduce|simmer|fry|grill|roast|boil)\b",
    "ingredient": r"^\d+([\/.]\d+)? ?(cups?|tbsp|tsp|tablespoons?|teaspoons?|g|kg|ml|l|oz|lb|pounds?|ounces?|cloves?|large|medium|small|pinch|handful)\b",
    "nutrition": r"calories[\s\S]*(fat|carbs?|protein)|nutrition (facts|information)|per serving",
    "metadata": r"(prep|cook|total) time|servings?:|yield:|serves \d|difficulty:|file size|word count|released? (on|date)|runtime:|director:|\bborn\b|\bdied\b|founded|isbn|price:|\bsku\b",
    "loading": r"^loading|lorem ipsum|nulla facilisi|please wait|^…$|^\.\.\.$",
    "empty": r"no (results|comments|items|posts|reviews) (yet|found)|nothing (here|to show|found)|be the first to|your (cart|basket|list) is empty",
    "error": r"something went wrong|try again|an error occurred|could not load|failed to load",
    "quiz": r"\bquiz\b|\bpoll\b|vote now|what do you think\?|take our|test your",
    "correction": r"^(correction|clarification|editor'?s note|this (article|story) (was|has been) (corrected|amended|updated))",
    "disclosure": r"affiliate|we may earn|commission|sponsored by|paid partnership|why you can trust|our (expert|review) process|how we test|editorial (independence|standards)|advertiser disclosure",
    "contentWarning": r"content warning|trigger warning|may (be|contain|find) (upsetting|distressing|disturbing)|viewer discretion|contains (strong|explicit|graphic)",
    "agegate": r"are you (over|at least) 1[89]|(confirm|verify) (your|you are of) (legal )?age|enter your (date of )?birth|must be 1[89]",
    "feedback": r"was this (page |article )?(helpful|useful)|rate this page|give feedback|report (a )?(problem|bug|abuse|issue)|send feedback|tell us what you think",
    "download": r"\bdownload\b|\.pdf\b|\.zip\b|\.docx?\b|\.xlsx?\b|\(pdf,? ?\d|\bkb\b|\bmb\b",
    "cart": r"\b(cart|basket|bag)\b.*\b\d|\d+ items? in (your )?(cart|basket)|add(ed)? to (cart|basket|bag)",
    "checkout": r"checkout|proceed to payment|place (your )?order|payment (method|details)|billing address|shipping address",
    "weather": r"°[CF].*°[CF]|\bfeels like\b|\bchance of (rain|showers)",
    "transcript": r"^\[?\d{1,2}:\d{2}(:\d{2})?\]?\s[\s\S]*\n\[?\d{1,2}:\d{2}",
    "dictionary": r"\bnoun\b|\bverb\b|\badjective\b|pronunciation|\/[a-zˈˌːə]+\/",
}
# Fixed value: words of controls.
ACTION = r"\b(save|share|cook mode|rss|feed|follow|subscribe|add|jump|expand|collapse|show|hide|load|copy|print|reply|edit|rate|report|more|close|open|menu|search|play|pause|mute|like|bookmark|merken|hinzufügen|zur merkliste|teilen|speichern|read more|see all|view all|sign|log|get|try|start|go to|skip|next|previous|back|submit|send|post|comment|upvote|downvote|vote|watch|listen|download|install|buy|cart|checkout|apply|donate|join|register|continue|accept|reject|agree|dismiss|ok|yes|no|cancel)\b"

WORD_BITS = 60


def java(pattern: str, lower: bool = False) -> str:
    """The pattern as Spark's regular expressions need it: word boundaries are those of ASCII letters, the end is the end.

    With ``lower`` it is for lower-cased text, which is much faster than a match in any case. A boundary before a letter
    or digit is a lookbehind, one after such a lookahead; where a group may begin with another character it is both.
    """
    word, edge = "[A-Za-z0-9_]", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

    def boundary(m: re.Match) -> str:
        rest = pattern[m.end() :]
        if re.match(r"[A-Za-z0-9]|\\d|\((\?:)?[A-Za-z0-9\\(]", rest) and not (rest[0] == "(" and r"|\+" in rest):
            return f"(?<!{word})"
        return f"(?!{word})" if re.match(r"$|[|) ,(\[]", rest) and re.search(r"[A-Za-z0-9?)\]}\d]$", pattern[: m.start()]) else edge

    out = re.sub(r"(?<!\\)\$", lambda _: r"\z", re.sub(r"\\b", boundary, pattern))
    return lowered(out) if lower else out


def lowered(pattern: str) -> str:
    """The pattern for lower-cased text: its letters in lower case, but for classes such as \\S."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


#: RE2 looks nowhere ahead: the part of a pattern that does, what must not be found there, and what is looked for once that is a mere letter.
AHEAD = {"author(?!-bio)": ("author-bio", "author"), r"\bcard(?!__heading)": ("card__heading", r"\bcard")}


def _found(values: pa.Array, pattern: str) -> np.ndarray:
    held = np.zeros(len(values), bool)
    parts = pattern.split("|")
    for part in AHEAD.keys() & set(parts):
        without, alone = AHEAD[part]
        held |= pc.match_substring_regex(pc.replace_substring(values, without, "_"), alone).to_numpy(zero_copy_only=False)
        pattern = "|".join(x for x in parts if x != part)
    return held | pc.match_substring_regex(values, lowered(pattern)).to_numpy(zero_copy_only=False)


def bit_set(subject: Column, patterns: list[str]) -> Column:
    """A bit for each pattern that a lower-cased text matches; null matches none. Equal texts of a batch are looked at once."""

    @F.arrow_udf("long")
    def bits(values: pa.Array) -> pa.Array:
        told = values.dictionary_encode()
        held = np.zeros(len(told.dictionary) + 1, np.int64)
        for k, p in enumerate(patterns):
            held[:-1] |= _found(told.dictionary, p).astype(np.int64) << k
        return pa.array(held[told.indices.fill_null(len(told.dictionary)).to_numpy()])

    return bits(subject)


def flag_columns(hint: Column, text: Column) -> dict[str, Column]:
    """hints_0, hints_1 and texts_0: bit sets of the patterns that a region's names and text match, both in lower case; empty names match none."""
    names = list(HINTS.values())
    parts = [names[i : i + WORD_BITS] for i in range(0, len(names), WORD_BITS)]
    out = {f"hints_{i}": F.when(hint == "", F.lit(0).cast("long")).otherwise(bit_set(hint, p)) for i, p in enumerate(parts)}
    return out | {"texts_0": bit_set(text, list(TEXTS.values()))}


def flag_sql(kind: str, name: str) -> str:
    """SQL that tests one flag: kind is 'h' for names, 'x' for text."""
    k = list(HINTS if kind == "h" else TEXTS).index(name)
    column = f"hints_{k // WORD_BITS}" if kind == "h" else "texts_0"
    return f"(({column} & {1 << k % WORD_BITS}L) <> 0)"


def set_flags() -> Column:
    """Names of the flags that are set, 'h:' or 'x:' and the pattern's name, for ``labels.audit_flags``."""
    each = [F.when(F.expr(flag_sql(kind, n)), F.lit(f"{kind}:{n}")) for kind, names in (("h", HINTS), ("x", TEXTS)) for n in names]
    return F.array_compact(F.array(*each))
