"""Identity keys of pages, sites and domains, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that don't tell pages apart, and path words that say nothing.
TRACKING = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")
NOISE = ("html", "htm", "php", "aspx", "index", "status", "www")


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def domain(url: Column) -> Column:
    """Host in lower case, without a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"^[^@]*@|:[0-9]*$", ""), r"^www\.", "")


def norm_url(url: Column) -> Column:
    """Page identity: no scheme, fragment, www, trailing slashes or tracking parameters. An address may lack its scheme, or its host."""

    def kept(pair: Column) -> Column:
        name = F.lower(F.split(pair, "=")[0])
        return (pair != "") & ~F.startswith(name, F.lit("utm_")) & ~name.isin(*TRACKING)

    rest = F.array_join(F.filter(F.split(query(url), "&"), kept), "&")
    page = F.concat(F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.concat(page, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))


def site_of(url: Column) -> Column:
    """Domain, with the first directory of pages that lie deeper than the root."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat(domain(url), F.lit("/"), parts[0])).otherwise(domain(url))


def url_words(url: Column) -> Column:
    """Words of the path with three letters or more, but for noise."""
    return F.filter(
        F.split(path(url), r"[^A-Za-zÀ-ÿ]+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*NOISE)
    )


def joined(address: Column, page: Column) -> Column:
    """An address as it is meant on a page: with a scheme, without one, from the host's root, or from the page's folder; else null."""
    root, folder = F.regexp_extract(page, r"(?i)^(https?://[^/?#]+)", 1), F.regexp_extract(page, r"(?i)^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    climb = r"^(https?://[^/]+(?:/[^/]+)*?)(?:/(?!\.\.)[^/]+)?/\.\./"

    def meant(a: Column) -> Column:
        up = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.concat(folder, F.regexp_replace(a, r"^(\./)+", "")), lambda x, _: F.regexp_replace(x, climb, "$1/"))
        return (
            F.when(F.rlike(a, F.lit("(?i)^https?://")), a)
            .when(F.startswith(a, F.lit("//")), F.concat(F.regexp_extract(page, r"(?i)^(https?):", 1), F.lit(":"), a))
            .when(F.rlike(a, F.lit("(?i)^[a-z][a-z0-9+.-]*:")) | (root == ""), F.lit(None))
            .when(F.startswith(a, F.lit("/")), F.concat(root, a))
            .when(a != "", up)
        )

    return F.get(F.transform(F.array(address), meant), F.lit(0))
