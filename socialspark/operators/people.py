"""Profiles, follows, lists, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.functions.tags import TagPredicate, relationship, refs, relay_list
from socialspark.operators.latest import latest, newest_first, top_per_key
from socialspark.sources.scratch import cut

#: Search tiers: (score, how, field).
TIERS = ((100, "is", "name"), (98, "is", "display_name"), (96, "is", "nip05"), (90, "starts", "name"), (88, "starts", "display_name"), (86, "starts", "nip05"),
         (76, "has", "name"), (74, "has", "display_name"), (72, "has", "nip05"), (60, "has", "lud16"), (50, "has", "website"), (30, "has", "about"), (10, "has", "raw_json"))


def decorated(rows: DataFrame, profiles: DataFrame, key: str = "pubkey") -> DataFrame:
    """Add author_name (display name, else name) and author_picture; both empty counts as no profile."""
    p = profiles.select(F.col("pubkey").alias(key), F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("name", F.lit(""))).alias("author_name"), F.nullif("picture", F.lit("")).alias("author_picture"))
    return rows.join(p, key, "left")


def follow_counts(contacts: DataFrame, stats: DataFrame) -> DataFrame:
    """(pubkey, following, followers): distinct contacts, followers from the statistics."""
    own = contacts.select("pubkey", F.size(F.array_distinct("contacts")).cast("long").alias("following"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return stats.select("pubkey", "followers").join(own, "pubkey", "left").select("pubkey", zero("following"), zero("followers"))


def relationships(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, candidate, label) from both directions of the follow edges."""
    there = follows.select(F.col("follower").alias("viewer"), F.col("followed").alias("candidate")).withColumn("_a", F.lit(True))
    back = follows.select(F.col("follower").alias("candidate"), F.col("followed").alias("viewer")).withColumn("_b", F.lit(True))
    j = pairs.join(there, ["viewer", "candidate"], "left").join(back, ["viewer", "candidate"], "left")
    return j.select("viewer", "candidate", relationship(F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))).alias("label"))


def searched(profiles: DataFrame) -> DataFrame:
    """Profiles with the text that a search looks through, and a number for postings (equal numbers only add candidates)."""
    text = F.lower(F.concat_ws(" ", "name", "display_name", "nip05", "lud16", "website", "about", "raw_json"))
    return profiles.withColumns({"text": text, "doc": F.xxhash64("pubkey")})


def _grams(text: Column) -> Column:
    """The distinct strings of 3 characters in ``text``, and those of 1 and 2 that have three bytes or more, as every shorter query has."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
    return F.array_distinct(F.concat(of(3), *[F.filter(of(k), lambda g: F.octet_length(g) >= 3) for k in (1, 2)]))


def gram_postings(profiles: DataFrame) -> DataFrame:
    """(gram, doc): the posting lists of all profiles, in order of the gram, so that a few lists are read from few row groups."""
    return searched(profiles).select(F.explode(_grams(F.col("text"))).alias("gram"), "doc").repartitionByRange("gram").sortWithinPartitions("gram", "doc")


def gram_counts(postings: DataFrame) -> DataFrame:
    """(gram, n): lengths of the posting lists."""
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def search_profiles(queries: DataFrame, profiles: DataFrame, limit: int = 10, block: int = 1000, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, pubkey, relevance, position): profiles that hold a query of three bytes or more, by tier.

    ``queries`` is a stated set, worked off in blocks of about ``block``; a query that is a key finds its profile too. Each
    query takes the posting list of its rarest gram, and only the profiles on it are searched for the whole query.
    ``index`` (posting lists, their lengths) is written beforehand; without it it is made here.
    """
    q = cut(queries.select(F.trim("query").alias("query")).where(F.octet_length("query") >= 3).distinct(), "search-queries")
    if index is None:
        postings = cut(gram_postings(profiles), "postings")
        index = postings, cut(gram_counts(postings), "gram-counts")
    blocks = max(-(-q.count() // block), 1)
    parts = [_search_block(q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), profiles, limit, *index) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def rarest_grams(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """(query, gram): each query's gram with the shortest list; none for a query with a gram that no profile has."""
    low = F.lower("query")
    own = F.when(F.char_length(low) < 3, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))
    grams = queries.select("query", F.explode(F.array_distinct(own)).alias("gram"))
    rarest = grams.join(counts, "gram", "left").groupBy("query").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
    return rarest.where("r.n IS NOT NULL").select("query", "r.gram")


def _search_block(queries: DataFrame, profiles: DataFrame, limit: int, postings: DataFrame, counts: DataFrame) -> DataFrame:
    rare = rarest_grams(queries, counts).collect()  # one row for each query of the block
    wanted = queries.sparkSession.createDataFrame([(r.query, r.gram) for r in rare], "query string, gram string")
    low = F.col("low")
    fields = ["pubkey", "created_at", *dict.fromkeys(f for _, _, f in TIERS), "query", "low"]
    holds, p = F.contains("text", low), searched(profiles)
    lists = postings.where(F.col("gram").isin(sorted({r.gram for r in rare})) if rare else F.lit(False)).join(wanted, "gram").select("query", "doc").distinct()
    found = p.join(lists, "doc").withColumn("low", F.lower("query")).where(holds).select(*fields)
    keys = queries.where(F.col("query").rlike("^[0-9a-f]{64}$")).withColumn("low", F.lower("query"))
    keyed = p.join(keys, F.col("pubkey") == F.col("query")).where(~holds).select(*fields)
    tests = {"is": lambda f: F.lower(f) == low, "starts": lambda f: F.startswith(F.lower(f), low), "has": lambda f: F.contains(F.lower(f), low)}
    key = F.when(F.col("pubkey") == F.col("query"), F.lit(100.0)).otherwise(F.lit(0.0))
    score = F.greatest(key, *[F.when(tests[how](F.col(f)), F.lit(float(s))).otherwise(F.lit(0.0)) for s, how, f in TIERS])
    scored = found.unionByName(keyed).withColumn("relevance", score)
    return top_per_key(scored, ["query"], [F.desc("relevance"), F.desc("created_at"), F.asc("pubkey")], limit, name="position").select("query", "pubkey", "relevance", "position")


def merged_search(external: DataFrame, local: DataFrame, limit: int) -> DataFrame:
    """(query, pubkey, position): external rows first, local ones fill the rest, each profile once. Both: (query, pubkey, position)."""
    both = external.withColumn("src", F.lit(0)).unionByName(local.select("query", "pubkey", "position").withColumn("src", F.lit(1)))
    first = latest(both, ["query", "pubkey"], [F.asc("src"), F.asc("position")])
    return top_per_key(first, ["query"], [F.asc("src"), F.asc("position"), F.asc("pubkey")], limit, name="place").select("query", "pubkey", F.col("place").alias("position"))


def messages(events: DataFrame, tags: DataFrame, kinds: tuple[int, ...] = (4, 1059), limit: int = 500) -> DataFrame:
    """(viewer, id, position): message envelopes sent or received by every viewer, newest first."""
    sent = events.where(F.col("kind").isin(*kinds)).select(F.col("pubkey").alias("viewer"), "id", "created_at")
    received = tags.where((F.col("tag_key") == "p") & F.col("kind").isin(*kinds)).select(F.col("tag_value").alias("viewer"), F.col("event_id").alias("id"), "created_at")
    return top_per_key(sent.unionByName(received).distinct(), ["viewer"], [F.desc("created_at"), F.desc("id")], limit, name="position").select("viewer", "id", "position")


def conversations(events: DataFrame) -> DataFrame:
    """(one, other, id, created_at, sender) of direct messages; each pair of people in one order, for all pairs."""
    m = events.where("kind = 4").select("id", "created_at", F.col("pubkey").alias("sender"), F.explode(F.array_distinct(refs(F.col("tags"), "p"))).alias("peer"))
    return m.select(F.least("sender", "peer").alias("one"), F.greatest("sender", "peer").alias("other"), "id", "created_at", "sender")


def social_graph(events: DataFrame) -> DataFrame:
    """(pubkey, follows, mutes, relays): from the newest list of each kind; ties take the smaller id."""
    newest = latest(events.where("kind IN (3, 10000, 10002)"), ["pubkey", "kind"], [F.desc("created_at"), F.asc("id")])
    list_of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.concat_ws(",", value)))
    relays = F.transform(relay_list(F.col("tags")), lambda r: F.concat(r["url"], F.when(r["read"], "+r").otherwise(""), F.when(r["write"], "+w").otherwise("")))
    return newest.groupBy("pubkey").agg(list_of(3, refs(F.col("tags"), "p")).alias("follows"), list_of(10000, refs(F.col("tags"), "p")).alias("mutes"), list_of(10002, relays).alias("relays"))


def seen_until(events: DataFrame, d: str = "seen") -> DataFrame:
    """(pubkey, seen_until) of the newest app-data event with a fixed d tag; negative or missing marks are 0."""
    mine = events.where("kind = 30078").where(TagPredicate("d", values=(d,)).any(F.col("tags")))
    newest = latest(mine, ["pubkey"], [F.desc("created_at"), F.desc("id")])
    return newest.select("pubkey", F.greatest(F.coalesce(F.get_json_object("content", "$.seenUntil").try_cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("seen_until"))


def profile_summaries(profiles: DataFrame, events: DataFrame, counts: DataFrame) -> DataFrame:
    """(pubkey, name, following, followers, created_at): created is the first event's time, else the profile's."""
    first = events.groupBy("pubkey").agg(F.min("created_at").alias("first_at"))
    j = profiles.join(first, "pubkey", "left").join(counts, "pubkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("pubkey", "name", zero("following"), zero("followers"), F.coalesce("first_at", "created_at").alias("created_at"))
