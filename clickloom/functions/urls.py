"""URL normalisation and domains as native Columns: two regular expressions each, the rest is plain string work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known protocols, and the grammar of a URL with them; groups: 1 protocol,
#: 2 authority, 4 host, 6 path.
PATTERN = (
    r"^(?i)(https?|ftp|file|jar|mailto|jrt):"
    r"(?://(([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(:(?:-1|[0-9]*))?)(?=[/?#]|$)|(?!//))([^?#]*)"
)
#: Control characters and the space, which may stand around a URL.
AROUND = "".join(map(chr, range(33)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: the optimiser can't copy it into each place of use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _trimmed(url: Column) -> Column:
    """Without control characters and spaces around it, and without a leading `url:`."""
    return _let(F.btrim(url, F.lit(AROUND)), lambda u: F.when(F.lower(F.left(u, F.lit(4))) == "url:", F.substring(u, 5, 1 << 30)).otherwise(u))


def is_wellformed(url: Column) -> Column:
    return F.coalesce(_trimmed(url).rlike(PATTERN), F.lit(False))


def _lower_protocol(url: Column) -> Column:
    n = F.instr(url, "://")
    return F.concat(F.lower(F.substr(url, F.lit(1), n - 1)), F.substr(url, n))


def normalized(url: Column) -> Column:
    """protocol://host + path: port, user, query and fragment go; null where the URL is malformed.

    The protocol is lower-cased; the host's case and the path's dots stay.
    """
    return _let(_trimmed(url), lambda u: F.when(u.rlike(PATTERN), _let(F.regexp_replace(u, f"(?s){PATTERN}.*$", "$1://$4$6"), _lower_protocol)))


def normalized_or_same(url: Column) -> Column:
    """normalized(), and a malformed URL as it stands."""
    return _let(url, lambda u: F.coalesce(normalized(u), u))


def _authority(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, ":", 1)) + 1)
    return F.when(F.startswith(after, F.lit("://")) & url.rlike(PATTERN), F.regexp_extract(url, PATTERN, 2))


def authority(url: Column) -> Column:
    """The authority with user and port: null for malformed URLs and where `//` is missing, empty where it is empty."""
    return _let(_trimmed(url), _authority)
