"""Tags as text, series keys and label matchers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def canonical_tags(tags: Column) -> Column:
    """`k=v` by ascending key, joined with commas; null and empty maps give ''. A null value is written as 'null'."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, _no_tags())))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")


def series_key(org_id: Column, metric: Column, canonical: Column) -> Column:
    return F.concat(org_id, F.lit("|"), metric, F.lit("|"), canonical)


def series_id(key: Column) -> Column:
    """64-bit id of a series key. The registry of resolve_series raises if two keys share one."""
    return F.xxhash64(key)


def parse_tags(text: Column) -> Column:
    """The map of canonical text: parts at commas, key and value at the first '='. Parts without a key go; the last of equal keys stays."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.instr(p, "=") > 1)
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v"), i.alias("i")))
    last = F.filter(keyed, lambda e: ~F.exists(keyed, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def host_from_tags(text: Column) -> Column:
    """Value of the first `host=` part of canonical text, '' without one."""
    hosts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.startswith("host="))
    return F.coalesce(F.substr(F.get(hosts, F.lit(0)), F.lit(6)), F.lit(""))


def force_host_tag(tags: Column, host: Column) -> Column:
    """The tags with `host` set to the sender's host, whatever they said."""
    rest = F.map_filter(F.coalesce(tags, _no_tags()), lambda k, _: k != "host")
    return F.map_concat(rest, F.create_map(F.lit("host"), host))


def match_labels(tags: Column, matchers: Iterable[tuple[str, str, str]]) -> Column:
    """All of (label, op, value) hold; op is =, !=, =~ or !~. A missing label is ''; regexes match whole values."""

    def one(m: tuple[str, str, str]) -> Column:
        label, op, value = m
        actual = F.coalesce(F.try_element_at(tags, F.lit(label)), F.lit(""))
        hit = actual.rlike(rf"\A(?:{value})\z") if "~" in op else actual == value
        return ~hit if op.startswith("!") else hit

    return reduce(lambda a, b: a & b, map(one, matchers), F.lit(True))
