"""Full-text links in the JSON answers of open-access registries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

# Registry endpoints, in priority order.
RENDER_URL = "https://www.ebi.ac.uk/europepmc/webservices/rest/%s/fullTextPDF"
API_URLS = {
    "europepmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
    "?query={query}&format=json&pageSize=1&resultType=core",
    "unpaywall": "https://api.unpaywall.org/v2/{doi}?email={contact}",
    "crossref": "https://api.crossref.org/works/{doi}",
}

_EUROPEPMC = (
    "resultList struct<result: array<struct<pmcid: string, isOpenAccess: string, inEPMC: string, "
    "fullTextUrlList: struct<fullTextUrl: array<struct<url: string, documentStyle: string, availability: string>>>>>>"
)
_LOCATION = "struct<url: string, url_for_pdf: string>"
_UNPAYWALL = f"is_oa boolean, best_oa_location {_LOCATION}, oa_locations array<{_LOCATION}>"
_CROSSREF = "message struct<link: array<struct<URL: string, `content-type`: string>>>"


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def europepmc_url(body: Column) -> Column:
    """An open PDF link of the first result, else its render address when it is open."""
    hit = F.get(F.from_json(body, _EUROPEPMC)["resultList"]["result"], F.lit(0))
    links = F.filter(
        hit["fullTextUrlList"]["fullTextUrl"],
        lambda u: (_low(u["documentStyle"]) == "pdf")
        & _low(u["availability"]).isin("open access", "free")
        & blank_to_null(u["url"]).isNotNull(),
    )
    open_access = (_low(hit["isOpenAccess"]) == "y") | (_low(hit["inEPMC"]) == "y")
    pmcid = blank_to_null(hit["pmcid"])
    render = F.when(open_access & pmcid.isNotNull(), F.format_string(RENDER_URL, F.url_encode(pmcid)))
    return F.coalesce(F.get(links, F.lit(0))["url"], render)


def unpaywall_url(body: Column) -> Column:
    """Best location's PDF, then its page, then any location's PDF; open records only."""
    doc = F.from_json(body, _UNPAYWALL)
    best = doc["best_oa_location"]
    others = F.filter(doc["oa_locations"], lambda loc: blank_to_null(loc["url_for_pdf"]).isNotNull())
    url = F.coalesce(
        blank_to_null(best["url_for_pdf"]), blank_to_null(best["url"]), F.get(others, F.lit(0))["url_for_pdf"]
    )
    return F.when(F.coalesce(doc["is_oa"], F.lit(False)), url)


def crossref_url(body: Column) -> Column:
    """First link typed as PDF, else the first whose address ends in ``.pdf``."""
    links = F.filter(
        F.from_json(body, _CROSSREF)["message"]["link"], lambda x: blank_to_null(x["URL"]).isNotNull()
    )
    typed = F.filter(links, lambda x: _low(x["content-type"]) == "application/pdf")
    named = F.filter(links, lambda x: F.lower(x["URL"]).endswith(".pdf"))
    return F.coalesce(F.get(typed, F.lit(0))["URL"], F.get(named, F.lit(0))["URL"])


RESOLVERS = {"europepmc": europepmc_url, "unpaywall": unpaywall_url, "crossref": crossref_url}
MIN_MARKUP_BYTES = 512


def file_suffix(content_type: Column, content: Column) -> Column:
    """``.pdf``, ``.xml`` or ``.html`` for usable full text, else null."""
    kind = _low(content_type)
    n = F.length(content)
    pdf = kind.contains("application/pdf") | (F.substring(content, 1, 5) == F.lit(b"%PDF-"))
    xml = kind.contains("application/xml") | kind.contains("text/xml")
    markup = (kind.contains("text/html") | xml) & (n >= MIN_MARKUP_BYTES)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(None)).when(pdf, ".pdf").when(
        markup, F.when(kind.contains("xml"), ".xml").otherwise(".html")
    )


__all__ = ["API_URLS", "RESOLVERS", "crossref_url", "europepmc_url", "file_suffix", "unpaywall_url"]
