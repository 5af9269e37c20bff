"""URL, host and source-type columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.binding import let
from weighbridge.functions.text import strip
from weighbridge.settings import EVIDENCE, MEMORY_DOMAIN, QUARANTINE, VERIFIED

# Hosts typed exactly.
EXACT_HOSTS = {
    "news.ycombinator.com": "forum",
    "learn.microsoft.com": "official_documentation",
    "developer.mozilla.org": "official_documentation",
    "docs.python.org": "official_documentation",
    "abcnews.go.com": "news",
    "news.google.com": "news",
    "news.sky.com": "news",
}
# First host label that decides the type.
HOST_LABELS = {
    "docs": "official_documentation",
    "doc": "official_documentation",
    "developer": "official_documentation",
    "developers": "official_documentation",
    "forum": "forum",
    "forums": "forum",
    "community": "forum",
    "discuss": "forum",
    "boards": "forum",
    "blog": "blog",
    "blogs": "blog",
    "news": "news",
    "store": "vendor",
    "shop": "vendor",
}
# Type of a registered domain.
TYPE_OF_DOMAIN = {
    "wikipedia.org": "encyclopedia",
    "wikiwand.com": "encyclopedia",
    "wiki2.org": "encyclopedia",
    "wikidata.org": "encyclopedia",
    "britannica.com": "encyclopedia",
    "encyclopedia.com": "encyclopedia",
    "newworldencyclopedia.org": "encyclopedia",
    "scholarpedia.org": "encyclopedia",
    "dbpedia.org": "encyclopedia",
    "readthedocs.io": "official_documentation",
    "readthedocs.org": "official_documentation",
    "kubernetes.io": "official_documentation",
    "rust-lang.org": "official_documentation",
    "nodejs.org": "official_documentation",
    "go.dev": "official_documentation",
    "reuters.com": "news",
    "apnews.com": "news",
    "bbc.com": "news",
    "bbc.co.uk": "news",
    "nytimes.com": "news",
    "theguardian.com": "news",
    "washingtonpost.com": "news",
    "cnn.com": "news",
    "nbcnews.com": "news",
    "cbsnews.com": "news",
    "npr.org": "news",
    "bloomberg.com": "news",
    "ft.com": "news",
    "wsj.com": "news",
    "economist.com": "news",
    "aljazeera.com": "news",
    "cbc.ca": "news",
    "abc.net.au": "news",
    "dw.com": "news",
    "france24.com": "news",
    "techcrunch.com": "news",
    "theverge.com": "news",
    "arstechnica.com": "news",
    "wired.com": "news",
    "zdnet.com": "news",
    "cnet.com": "news",
    "engadget.com": "news",
    "politico.com": "news",
    "axios.com": "news",
    "latimes.com": "news",
    "usatoday.com": "news",
    "time.com": "news",
    "newsweek.com": "news",
    "forbes.com": "news",
    "businessinsider.com": "news",
    "telegraph.co.uk": "news",
    "independent.co.uk": "news",
    "thetimes.co.uk": "news",
    "thehindu.com": "news",
    "scmp.com": "news",
    "japantimes.co.jp": "news",
    "straitstimes.com": "news",
    "smh.com.au": "news",
    "globalnews.ca": "news",
    "ctvnews.ca": "news",
    "foxnews.com": "news",
    "huffpost.com": "news",
    "vox.com": "news",
    "propublica.org": "news",
    "reddit.com": "forum",
    "stackexchange.com": "forum",
    "stackoverflow.com": "forum",
    "superuser.com": "forum",
    "serverfault.com": "forum",
    "askubuntu.com": "forum",
    "mathoverflow.net": "forum",
    "quora.com": "forum",
    "medium.com": "blog",
    "substack.com": "blog",
    "wordpress.com": "blog",
    "blogspot.com": "blog",
    "blogger.com": "blog",
    "tumblr.com": "blog",
    "dev.to": "blog",
    "hashnode.dev": "blog",
    "ghost.io": "blog",
    "livejournal.com": "blog",
    "typepad.com": "blog",
    "amazon.com": "vendor",
    "ebay.com": "vendor",
    "walmart.com": "vendor",
    "bestbuy.com": "vendor",
    "target.com": "vendor",
    "newegg.com": "vendor",
    "etsy.com": "vendor",
    "aliexpress.com": "vendor",
    "alibaba.com": "vendor",
    "apple.com": "vendor",
    "microsoft.com": "vendor",
    "samsung.com": "vendor",
    "sony.com": "vendor",
    "dell.com": "vendor",
    "hp.com": "vendor",
    "lenovo.com": "vendor",
    "nvidia.com": "vendor",
    "intel.com": "vendor",
    "amd.com": "vendor",
    "oracle.com": "vendor",
    "adobe.com": "vendor",
    "salesforce.com": "vendor",
    "ikea.com": "vendor",
    "nike.com": "vendor",
    "tesla.com": "vendor",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table; NULL for an unknown key."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def canonical_url(url: Column) -> Column:
    """Trimmed, without fragment and without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"(?s)#.*\z", ""), r"/+\z", "")


def domain_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; ``unknown`` where there is none."""
    host = F.regexp_extract(
        strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?\[?([^/?#:\]]*)", 1
    )
    named = F.coalesce(F.nullif(F.lower(host), F.lit("")), F.lit("unknown"))
    return F.regexp_replace(named, r"^www\.", "")


def source_type(domain: Column, wing: Column | None = None) -> Column:
    """Where a passage comes from. The wing decides first, then an exact host,
    then the first host label, then the longest registered domain."""
    wing = F.lit(None).cast("string") if wing is None else wing
    recalled = F.coalesce(F.nullif(domain, F.lit("")), F.lit(MEMORY_DOMAIN)) == MEMORY_DOMAIN
    host = F.regexp_replace(F.lower(strip(F.coalesce(domain, F.lit("")))), r"^www\.", "")
    return (
        F.when(wing == VERIFIED, "memory_verified")
        .when(wing.isin(EVIDENCE, QUARANTINE) & recalled, "memory_evidence")
        .otherwise(let(host, lambda h: _type_of_host(h, F.coalesce(wing, F.lit("")) != "")))
    )


def _type_of_host(host: Column, has_wing: Column) -> Column:
    def by_label(labels: Column) -> Column:
        suffixes = F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        )
        types = F.filter(F.transform(suffixes, lambda s: _lookup(TYPE_OF_DOMAIN, s)), lambda t: t.isNotNull())
        first_label = F.when(F.size(labels) > 1, F.get(labels, 0))
        return F.coalesce(_lookup(HOST_LABELS, first_label), F.get(types, 0))

    return (
        F.when(host.isin("", MEMORY_DOMAIN), F.when(has_wing, "memory_evidence").otherwise("unknown"))
        .otherwise(F.coalesce(_lookup(EXACT_HOSTS, host), let(F.split(host, r"\."), by_label), F.lit("unknown")))
    )


def fetch_outcome(status: Column, content_type: Column, text: Column) -> Column:
    """``struct<error,ok>`` of a crawled page."""
    # Content types with readable text.
    readable = F.lit(False)
    for prefix in ("text/html", "application/xhtml+xml", "text/plain"):
        readable = readable | F.startswith(content_type, F.lit(prefix))
    named = F.coalesce(F.nullif(content_type, F.lit("")), F.lit("unknown"))
    empty = F.coalesce(text, F.lit("")) == ""
    error = (
        F.when(status >= 400, F.concat(F.lit("http "), status.cast("string")))
        .when(~F.coalesce(readable, F.lit(False)), F.concat(F.lit("unsupported content type "), named))
        .when(empty, "no extractable text")
    )
    return F.struct(error.alias("error"), (error.isNull() & ~empty).alias("ok"))
