"""Domain events to metrics. Each function gives the metrics of one kind of event as Columns,
for facts.fan_out(); a metric that an event does not produce is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.identifiers import join_parts, referrer_host, referrer_path
from .facts import ABSOLUTE, metric

# The kinds of actions, imports and access channels.
ACTIONS = ("share", "comment", "rating", "view", "favorite")
IMPORTS = ("replace", "import", "append")
CHANNELS = ("download", "website", "api", "print", "widget", "rss", "email", "unknown")


def _each(names: list[str], value: Column, *entities: Column) -> list[Column]:
    return [metric(e, F.lit(n), value) for e in entities for n in names]


def _if(condition: Column, m: Column) -> Column:
    return F.when(condition, m)


def token_on_view(view: Column, token: Column) -> list[Column]:
    there = token.isNotNull()
    return [
        _if(there, metric(join_parts(view, "-apps"), token, F.lit(1))),
        _if(there, metric(join_parts("app-", token), view, F.lit(1))),
    ]


def child_loaded(parent: Column, child: Column, display: Column) -> list[Column]:
    kind = F.when(display.isNull() | (display == ""), "filter-").when(display.isin("map", "chart"), F.concat(display, F.lit("-")))
    return [_if(kind.isNotNull(), metric(join_parts("children-loaded-", parent), F.concat(kind, child), F.lit(1)))]


def search(owner: Column, query: Column, prefix: str = "search-") -> list[Column]:
    """prefix: search- for a view, users-search- and datasets-search- for a domain."""
    return [metric(join_parts("searches-", owner), join_parts(prefix, query), F.lit(1))]


def created(domain: Column, what: str) -> list[Column]:
    """what: users-created or app-token-created."""
    return _each([what], F.lit(1), domain)


def token_request(token: Column, domain: Column, ip: Column) -> list[Column]:
    app = join_parts("application-", token)
    return [
        metric(F.lit("ip-applications"), join_parts("application-", token, "-", ip), F.lit(1)),
        metric(join_parts(domain, "-applications"), app, F.lit(1)),
        metric(F.lit("applications"), app, F.lit(1)),
        metric(app, F.lit("requests"), F.lit(1)),
    ]


def token_request_for_view(view: Column, token: Column) -> list[Column]:
    return [metric(join_parts("view-", view, "-apps"), F.coalesce(token, F.lit("anon")), F.lit(1))]


def api_query(view: Column, query: Column) -> list[Column]:
    return [
        metric(join_parts("view-", view, "-query"), F.coalesce(query, F.lit("select *")), F.lit(1)),
        metric(view, F.lit("queries-served"), F.lit(1)),
    ]


def token_used(ip: Column) -> list[Column]:
    return []


def view_changed(domain: Column, parent: Column, what: str) -> list[Column]:
    """what: maps-, charts- or filters-, then created or deleted."""
    return _each([what], F.lit(1), domain, parent)


def dataset_changed(domain: Column, blob: Column, href: Column, what: str) -> list[Column]:
    """what: datasets-created or datasets-deleted."""
    return [
        _if(blob, metric(domain, F.lit(f"{what}-blobby"), F.lit(1))),
        _if(href, metric(domain, F.lit(f"{what}-href"), F.lit(1))),
        metric(domain, F.lit(what), F.lit(1)),
    ]


def rows_created(count: Column, domain: Column, view: Column) -> list[Column]:
    return _each(["rows-created"], count, domain, view)


def rows_deleted(count: Column, domain: Column, view: Column, token: Column) -> list[Column]:
    return _each(["rows-deleted"], count, domain, view) + token_on_view(view, token)


def dataset_referrer(url: Column, view: Column) -> list[Column]:
    return _visits("referrer", url, view)


def _visits(kind: str, url: Column, owner: Column) -> list[Column]:
    host = referrer_host(url)
    return [
        metric(join_parts(f"{kind}-hosts-", owner), join_parts("referrer-", host), F.lit(1)),
        metric(join_parts(f"{kind}-paths-", owner, "-", host), join_parts("path-", referrer_path(url)), F.lit(1)),
    ]


def publish(url: Column, view: Column, domain: Column) -> list[Column]:
    uid = metric(join_parts("publishes-uids-", domain), join_parts("uid-", view), F.lit(1))
    return [uid, *_visits("publishes", url, view), *_visits("publishes", url, domain)]


def action(kind: Column, view: Column, domain: Column, value: Column, token: Column) -> list[Column]:
    rating, viewed = kind == "rating", kind == "view"
    other, plural = ~kind.isin("rating", "view"), F.concat(kind, F.lit("s"))
    out = []
    for owner in (view, domain):
        out += [
            _if(rating, metric(owner, F.lit("ratings-total"), value)),
            _if(rating, metric(owner, F.lit("ratings-count"), F.lit(1))),
            _if(viewed, metric(owner, F.lit("view-loaded"), F.lit(1))),
            _if(other, metric(owner, plural, value)),
        ]
    out.append(_if(viewed, metric(join_parts("views-loaded-", domain), join_parts("view-", view), F.lit(1))))
    return out + token_on_view(view, token)


def transferred(direction: str, view: Column, domain: Column, count: Column) -> list[Column]:
    """direction: in or out. The view may be null."""
    name = F.lit(f"bytes-{direction}")
    return [_if(view.isNotNull(), metric(view, name, count)), metric(domain, name, count)]


def row_access(channel: Column, domain: Column, view: Column, count: Column, token: Column) -> list[Column]:
    out = []
    for prefix, n in (("rows-accessed-", F.lit(1)), ("rows-loaded-", count)):
        out += [metric(owner, join_parts(prefix, channel), n) for owner in (view, domain)]
    seen = metric(join_parts("views-downloaded-", domain), join_parts("view-", view), F.lit(1))
    return [*out, _if(channel == "download", seen), *token_on_view(view, token)]


def geocoding(domain: Column, view: Column, count: Column) -> list[Column]:
    return _each(["geocoding-requests"], count, view, domain)


def dataset_disk(view: Column, author: Column, size: Column) -> list[Column]:
    return [
        metric(view, F.lit("disk-usage"), size, ABSOLUTE),
        metric(join_parts("user-", author, "-views-disk-usage"), join_parts("view-", view), size, ABSOLUTE),
    ]


def domain_disk(domain: Column, size: Column) -> list[Column]:
    return [metric(domain, F.lit("disk-usage"), size, ABSOLUTE)]


def user_domain_disk(user: Column, domain: Column, size: Column) -> list[Column]:
    return [metric(join_parts(domain, "-users-disk-usage"), join_parts("user-", user), size, ABSOLUTE)]
