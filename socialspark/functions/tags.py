"""Expressions over an event's tag array (array of string arrays)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from socialspark.functions.text import is_hex64


def slot(tag: Column, n: int) -> Column:
    """Slot ``n`` of a tag, '' if it has fewer."""
    return F.coalesce(F.get(tag, F.lit(n)), F.lit(""))


def marker(tag: Column) -> Column:
    return F.lower(F.trim(slot(tag, 3)))


@dataclass(frozen=True)
class TagPredicate:
    """What a tag must be: key, value(s), marker(s) it has or has not, and a bound on its place."""

    key: str | None = None
    values: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    exclude_markers: tuple[str, ...] = ()
    before_index: int | None = None

    def test(self, tag: Column, index: Column) -> Column:
        ok = F.lit(True)
        if self.key is not None:
            ok = ok & (slot(tag, 0) == self.key)
        if self.values:
            ok = ok & slot(tag, 1).isin(*self.values)
        if self.markers:
            ok = ok & marker(tag).isin(*self.markers)
        if self.exclude_markers:
            ok = ok & ~marker(tag).isin(*self.exclude_markers)
        if self.before_index is not None:
            ok = ok & (index < self.before_index)
        return ok

    def select(self, tags: Column) -> Column:
        """The tags that fit, in order."""
        return F.filter(tags, lambda t, i: self.test(t, i))

    def values_of(self, tags: Column) -> Column:
        return F.transform(self.select(tags), lambda t: slot(t, 1))

    def any(self, tags: Column) -> Column:
        return F.size(self.select(tags)) > 0


def values(tags: Column, key: str) -> Column:
    return TagPredicate(key).values_of(tags)


def first_value(tags: Column, key: str) -> Column:
    """First value of a key; null if there is none."""
    return F.get(values(tags, key), F.lit(0))


def refs(tags: Column, key: str = "e") -> Column:
    """Values of a key that are 64 bytes long."""
    return F.filter(values(tags, key), lambda v: F.octet_length(v) == 64)


def _e(tags: Column, **kw) -> Column:
    return F.filter(TagPredicate("e", **kw).values_of(tags), lambda v: F.octet_length(v) == 64)


def direct_parent(tags: Column) -> Column:
    """First reply-marked, else last unmarked, else first event reference."""
    return F.coalesce(F.get(_e(tags, markers=("reply",)), F.lit(0)), F.element_at(F.nullif(_e(tags, markers=("",)), F.array().cast("array<string>")), -1), F.get(_e(tags), F.lit(0)))


def root_ref(tags: Column, event_id: Column) -> Column:
    """Root-marked, else first event reference that is not a mention; never the event itself."""
    found = F.coalesce(F.get(_e(tags, markers=("root",)), F.lit(0)), F.get(_e(tags, exclude_markers=("mention",)), F.lit(0)))
    return F.nullif(found, event_id)


def notification_reason(kind: Column, tags: Column, fallback: Column) -> Column:
    """Why an event concerns its viewer."""
    e = TagPredicate("e")
    replies = TagPredicate("e", markers=("", "root", "reply")).any(tags)
    quotes = TagPredicate("q").any(tags) | TagPredicate("e", markers=("mention",)).any(tags)
    return (
        F.when(kind == 3, "follow").when(kind.isin(6, 16), "repost").when(kind == 7, "reaction").when(kind == 9735, "zap")
        .when(kind.isin(1, 1111) & replies, "reply").when(kind.isin(1, 1111) & quotes, "quote")
        .when(kind.isin(1, 1111) & ~e.any(tags), "mention").otherwise(fallback)
    )


def quoted_ids(tags: Column) -> Column:
    return F.array_distinct(refs(tags, "q"))


def zap_request_tag(tags: Column, key: str) -> Column:
    """First value of a key in the zap request that the description holds."""
    inner = F.from_json(first_value(tags, "description"), "pubkey string, tags array<array<string>>")
    return first_value(inner["tags"], key)


def zap_msats(tags: Column) -> Column:
    from socialspark.functions.text import uint_or_zero

    asked = uint_or_zero(F.coalesce(zap_request_tag(tags, "amount"), F.lit("")))
    return F.when(asked > 0, asked).otherwise(uint_or_zero(F.coalesce(first_value(tags, "amount"), F.lit(""))))


def zap_sender(tags: Column, pubkey: Column) -> Column:
    inner = F.from_json(first_value(tags, "description"), "pubkey string, tags array<array<string>>")
    return F.coalesce(F.nullif(first_value(tags, "P"), F.lit("")), F.nullif(inner["pubkey"], F.lit("")), pubkey)


def relationship(follows: Column, followed_by: Column) -> Column:
    return F.when(follows & followed_by, "mutual").when(follows, "following").when(followed_by, "follows_you").otherwise("none")


def relay_list(tags: Column) -> Column:
    """url, read, write of the relay tags; no marker means both."""
    return F.transform(TagPredicate("r").select(tags), lambda t: F.struct(slot(t, 1).alias("url"), (slot(t, 2) != "write").alias("read"), (slot(t, 2) != "read").alias("write")))


def address(kind: Column, pubkey: Column, tags: Column) -> Column:
    """kind:pubkey:d of a replaceable or addressable event; null for others."""
    replaceable = kind.isin(0, 3) | kind.between(10_000, 19_999)
    d = F.when(replaceable, F.lit("")).otherwise(F.coalesce(first_value(tags, "d"), F.lit("")))
    return F.when((replaceable | kind.between(30_000, 39_999)) & is_hex64(pubkey), F.concat_ws(":", kind.cast("string"), pubkey, d))


def is_reply(kind: Column, tags: Column) -> Column:
    return kind.isin(1, 1111) & F.exists(tags, lambda t: (F.lower(slot(t, 0)) == "e") & (F.size(t) >= 2))


def selected_refs(tags: Column, selectors: list[TagPredicate], fallback: str | None = None, itself: Column | None = None, limit: int | None = None) -> Column:
    """Values of the first selector that matches anything, else all (FIRST: in order, LAST: from the end), without the event itself."""
    none = F.array().cast("array<string>")
    options = [F.nullif(s.values_of(tags), none) for s in selectors]
    if fallback:
        every = TagPredicate(selectors[0].key if selectors else "e").values_of(tags)
        options.append(F.slice(F.reverse(every) if fallback == "LAST" else every, 1, 1))
    found = F.array_distinct(F.coalesce(*options, none))
    if itself is not None:
        found = F.filter(found, lambda v: v != itself)
    return F.slice(found, 1, limit) if limit else found
