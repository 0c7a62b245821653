"""Resolution of a link against a page's URL, for the thorough path: parses strictly, encodes what a URL cannot hold."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", re.S)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_CONTROL = re.compile(r"[\x00-\x1F\x7F]")
#: A path that may stand as it is; a host with an optional user before it and digits for a port.
_LEGAL_PATH = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@\[\]/%]*")
_LEGAL_HOST = re.compile(r"(?:[^@]*@)?(?:\[[^\]]*\]|[A-Za-z0-9\-._~!$&'()*+,;=\x80-\U0010ffff]*)(?::[0-9]*)?")
_PATH_SAFE = "$&+,/:;=@-._~"


class Unparsable(ValueError):
    """The text is no URL."""


def encoded_path(path: str) -> str:
    """The path as it is if all its characters may stand there; else decoded and encoded anew."""
    return path if _LEGAL_PATH.fullmatch(path) else quote(unquote_to_bytes(path), safe=_PATH_SAFE)


def parsed(url: str) -> tuple[str, str | None, str, str | None, str | None, str | None]:
    """(scheme, authority, path, query, fragment, opaque); None for a part that is not there, '' for no scheme."""
    if _CONTROL.search(url):
        raise Unparsable
    rest, hash_, fragment = url.partition("#")
    scheme, found = "", _SCHEME.fullmatch(rest)
    if rest.startswith(":"):
        raise Unparsable
    if found:
        scheme, rest = found[1].lower(), found[2]
    rest, mark, query = rest.partition("?")
    asked, said = query if mark else None, fragment if hash_ else None
    if _BAD_ESCAPE.search(fragment):
        raise Unparsable
    if not rest.startswith("/"):
        if scheme:
            return scheme, None, "", asked, said, rest
        if ":" in rest.split("/", 1)[0]:
            raise Unparsable  # a first segment with a colon would be a scheme
    authority = None
    if rest.startswith("//") and (scheme or not rest.startswith("///")):
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
        if not _LEGAL_HOST.fullmatch(authority):
            raise Unparsable
    if _BAD_ESCAPE.search(rest):
        raise Unparsable
    return scheme, authority, encoded_path(rest), asked, said, None


#: A page's own URL is the base of all its links.
_parsed_base = lru_cache(maxsize=64)(parsed)


def without_dots(path: str) -> str:
    """The path from its root, its . and .. worked off."""
    if not path:
        return ""
    out: list[str] = []
    parts = path.removeprefix("/").split("/")
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    if parts[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


def resolve(base: str, href: str) -> str | None:
    """``href`` as seen from ``base``, as a URL; None where either does not parse."""
    try:
        scheme, authority, path, query, fragment, opaque = parsed(href)
        own, own_authority, own_path, own_query, own_fragment, _ = _parsed_base(base)
    except Unparsable:
        return None
    if opaque is not None:
        head, path = f"{scheme}:", opaque
    else:
        if scheme or authority is not None:
            path = without_dots(path)
        else:
            authority = own_authority
            if not path and query is None:
                query = own_query
                fragment = own_fragment if fragment in (None, "") else fragment
            path = without_dots(own_path if not path else path if path.startswith("/") else own_path[: own_path.rfind("/") + 1] + path)
        head = f"{scheme or own}:" + ("" if authority is None else f"//{authority}")
    return head + path + ("" if query is None else f"?{query}") + (f"#{fragment}" if fragment else "")
