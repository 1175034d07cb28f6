"""URL functions: expressions for parts and roots, Arrow functions for full normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), r"^[^@]*@|:(?:80|443)$", ""))


def normal_basic(url: Column) -> Column:
    """Scheme and host lower-cased, default port, fragment and last slash gone; the query stays."""
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.regexp_replace(part(url, 3), "/+$", ""), part(url, 4))


def root(url: Column, segments: int = 1) -> Column:
    """Host and first path segments."""
    return F.array_join(F.concat(F.array(host(url)), F.slice(F.filter(F.split(part(url, 3), "/"), lambda x: x != ""), 1, segments)), "/")


def classify(url: Column) -> Column:
    """What a repository URL points to, by the first rule that fits."""
    return (
        F.when(url.rlike(r"/issues/[0-9]+"), "issue").when(url.rlike(r"/pull/[0-9]+"), "pull").when(url.contains("/releases"), "release").when(url.rlike(r"/raw/|^https?://raw\."), "raw")
        .when(url.rlike(r"\.git$"), "clone").when(url.rlike(r"^https?://[^/]+/[^/?#]+/[^/?#]+/?$"), "repo").otherwise("other")
    )


#: Characters that stay as they are in paths, in parameters and in fragments.
PATH_SAFE, QUERY_SAFE, FRAGMENT_SAFE = "~:/#[]@!$&'()*+,;=", "~:/?[]@!$'()*+,;", "~="
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: The parameters that say what a page is, by host without www.
PARAMETERS = {"google.com": ("q", "ie"), "baidu.com": ("wd", "ie"), "bing.com": ("q",), "youtube.com": ("v", "search_query")}


def normal_url(url: str | None, scheme: str = "https", only: dict | None = None) -> str | None:
    """One URL normalised: scheme and host lower-cased, IDNA, default port, dot segments and repeated slashes gone, percent-encoding only where it is needed.

    User names stay, and so do the order of parameters and their repeats. only: by host without www., the parameters that stay; all others go. What can't be read stays as it is.
    """
    import unicodedata
    from urllib.parse import quote, unquote, urlsplit, urlunsplit

    text = (url or "").strip()
    if not text or text == "-" or (text[0] == "/" and text[:2] != "//"):
        return url
    if text[:2] == "//":
        text = f"{scheme}:{text}"
    elif ":" not in text[:7]:
        text = f"{scheme}://{text}"
    again = lambda s, safe: quote(unicodedata.normalize("NFC", unquote(s)), safe)
    try:
        u = urlsplit(text.replace("#!", "?_escaped_fragment_=").rstrip("&? "))
        user, at, place = u.netloc.rpartition("@")
        name, colon, port = place.partition(":") if not place.startswith("[") else (place, "", "")
        name = ".".join(p.encode("idna").decode() for p in name.lower().strip(".").split(".") if p)
    except (ValueError, UnicodeError):
        return url
    if port.isdigit():
        port = "" if int(port) == PORTS.get(u.scheme) else str(int(port))
    kept: list[str] = []
    parts = again(u.path, PATH_SAFE).split("/")
    for p in parts:
        if p == "..":
            kept = kept[:-1]
        elif p not in ("", "."):
            kept.append(p)
    path = "/" + "/".join(kept) + ("/" if kept and parts[-1] in ("", ".", "..") else "")
    params = [[again(x, QUERY_SAFE) for x in p.split("=", 1)] for p in u.query.split("&") if p]
    if only is not None:
        params = [p for p in params if p[0] in only.get(name.removeprefix("www."), ())]
    query = "&".join("=".join(p) if p[1:] != [""] else p[0] for p in params)
    who = user + at if user not in ("", ":") else ""
    return urlunsplit((u.scheme, f"{who}{name}:{port}" if port else who + name, path, query, again(u.fragment, FRAGMENT_SAFE)))


@F.pandas_udf(T.StringType())
def normal_full(s: pd.Series) -> pd.Series:
    return s.map(normal_url)


@F.pandas_udf(T.StringType())
def normal_filtered(s: pd.Series) -> pd.Series:
    """Normal URLs with only the parameters that say what a page is."""
    return s.map(lambda x: normal_url(x, only=PARAMETERS))


def human_url(url: str | None) -> str | None:
    """A URL's normal form with each host label, path segment, parameter and fragment decoded that can be: where the whole still has the same normal form."""
    from urllib.parse import unquote, urlsplit

    whole = normal_url(url)
    if not whole or "://" not in whole:
        return whole
    u = urlsplit(whole)
    user, at, place = u.netloc.rpartition("@")
    name, colon, port = place.partition(":")
    # what can be decoded, each with what stands before it
    pieces: list[list[str]] = [["", f"{u.scheme}://{user}{at}"]]
    pieces += [["." * bool(k), p] for k, p in enumerate(name.split("."))] + [["", colon + port]]
    pieces += [["/", p] for p in u.path.split("/")[1:]]
    for k, p in enumerate(u.query.split("&") if u.query else []):
        key, equals, value = p.partition("=")
        pieces += [["&" if k else "?", key], [equals, value]]
    pieces += [["#", u.fragment]] if u.fragment else []
    labels = range(1, 1 + len(name.split(".")))
    for k, (before, piece) in enumerate(pieces):
        try:
            said = piece.encode().decode("idna") if k in labels and piece.startswith("xn--") else piece if k <= labels[-1] + 1 else unquote(piece, errors="strict")
        except (UnicodeError, ValueError):
            continue
        if said != piece:
            pieces[k] = [before, said]
            if normal_url("".join(x for p in pieces for x in p)) != whole:
                pieces[k] = [before, piece]
    return "".join(x for p in pieces for x in p)


@F.pandas_udf(T.StringType())
def humanize(s: pd.Series) -> pd.Series:
    return s.map(human_url)
