"""The given event, order and supplier tables as canonical social-event tables.

Events, tags, zaps and the tables every read needs (reply edges, newest contact lists, scores) are written once for a data
folder and application, to the shared folder, in the order of kind and time; queries read those, so that filters on kind, time
and key prune their row groups and no query builds the log again.

The mapping is arithmetic on event_id, with one join for the authors of targets, so it needs no ranking
over all rows: in each run of ten ids the first four are notes, two are reactions, then a repost, a zap,
a comment and an event of a rarer kind. That join and the sort run over the given numbers; hashes, tags and
contents, which are twenty times as wide, are worked out of its rows and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from socialspark.operators import enrich, jobs
from socialspark.sources.ingest import flatten_tags, note_zaps
from socialspark.sources.scratch import cut, exists, remove
from socialspark.sources.tables import table

KIND = """CASE WHEN event_id % 10 < 4 THEN 1 WHEN event_id % 10 < 6 THEN 7 WHEN event_id % 10 = 6 THEN 6
 WHEN event_id % 10 = 7 THEN 9735 WHEN event_id % 10 = 8 THEN 1111
 ELSE CASE event_id DIV 10 % 6 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 10002 WHEN 3 THEN 30078 WHEN 4 THEN 4 ELSE 10000 END END"""

#: Columns of ``Tables.numbers``.
GIVEN = ("event_id", "user_id", "value", "event_type", "kind", "created_at", "target_user")
#: Number of a note.
NOTE = "4 * (event_id DIV 10) + event_id % 10"


def _note(number: str) -> str:
    """event_id of the note with a number."""
    return f"(10 * (({number}) DIV 4) + ({number}) % 4)"


#: (application, data folder, table): the state of the folder's files, the written table's path and schema.
_written: dict[tuple[str, str, str], tuple[str, str, StructType]] = {}
_bounds: dict[tuple[str, str, str], Row] = {}


def files_state(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of a data folder's files, so that tables written from others are not used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, seen = [path], []
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sha256("\n".join(sorted(seen)).encode()).hexdigest()


@dataclass
class Tables:
    """Canonical tables of one data folder; each is built from the given files when first asked for."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def state(self) -> str:
        return files_state(self.spark, self.sf_dir)

    def stored(self, name: str, build: Callable[[], DataFrame], order: tuple[str, ...]) -> DataFrame:
        """A table that is written once for the folder as it is; one written from other files is given up."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        state, path, schema = _written.get(key, ("", "", None))
        if state != self.state or not exists(self.spark, path):
            rows = build()
            made = cut(rows.sortWithinPartitions(*order) if order else rows, f"table-{name}")
            if path:
                remove(self.spark, path)
            _written[key] = (self.state, made.scratch_path, made.schema)
            path, schema = made.scratch_path, made.schema
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def bounds(self):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.state)
        if key not in _bounds:
            _bounds[key] = table(self.spark, self.sf_dir, "events").selectExpr("count(*) AS rows", "max(event_id) + 1 AS n", "max(user_id) + 1 AS users", "date_trunc('second', max(ts)) AS as_of").first()
        return _bounds[key]

    @property
    def as_of(self):
        """The newest event's time; stands for now."""
        return F.lit(self.bounds.as_of).cast("timestamp_ntz")

    @cached_property
    def numbers(self) -> DataFrame:
        """event_id, user_id, value, event_type, kind, created_at and the user id of the target's author, by kind and time: what the canonical event is worked out of."""
        return self.stored("numbers", self._numbers, ("kind", "created_at"))

    def _target(self) -> str:
        """event_id of the note that an event answers or engages; null if none."""
        notes = max(4 * (self.bounds.n // 10), 1)
        return f"CASE WHEN kind = 1 THEN CASE WHEN note % 2 = 1 THEN {_note('event_id * 31 % note')} END WHEN kind IN (6, 7, 1111, 9735) THEN {_note(f'event_id * 31 % {notes}')} END"

    def _numbers(self) -> DataFrame:
        given = table(self.spark, self.sf_dir, "events").selectExpr("event_id", "user_id", "value", "event_type", f"{KIND} AS kind", "date_trunc('second', ts) AS created_at")
        named = given.selectExpr("*", f"{NOTE} AS note").selectExpr("*", f"{self._target()} AS target").drop("note")
        authors = given.where("kind = 1").select(F.col("event_id").alias("target"), F.col("user_id").alias("target_user"))  # targets are notes
        # always by shuffle: a few numbers a row, and the same plan at any size
        found = named.where("target IS NOT NULL").join(authors.hint("merge"), "target", "left").drop("target")
        return found.unionByName(named.where("target IS NULL").drop("target").withColumn("target_user", F.lit(None).cast("long")))

    @cached_property
    def events(self) -> DataFrame:
        """id, pubkey, kind, created_at, tags, content, event_id, user_id: the canonical event."""
        return self.stored("events", lambda: self.canonical(self.numbers.sortWithinPartitions("kind", "created_at")), ())

    def canonical(self, numbers: DataFrame) -> DataFrame:
        """The canonical events of some rows of ``numbers``, in their order; further columns go along."""
        users = self.bounds.users
        notes = max(4 * (self.bounds.n // 10), 1)
        ev = numbers.selectExpr("*", "sha2('e' || event_id, 256) AS id", "sha2('u' || user_id, 256) AS pubkey", "sha2('u' || target_user, 256) AS target_pubkey", f"{NOTE} AS note")
        ev = ev.selectExpr(
            "*", f"{self._target()} AS target",
            f"CASE WHEN kind = 1 AND note % 4 = 1 THEN {_note('event_id * 17 % note')} END AS root", f"CASE WHEN kind = 1 AND event_id % 5 = 0 THEN {_note(f'event_id * 17 % {notes}')} END AS quote",
        )
        h = lambda prefix, x: f"sha2('{prefix}' || ({x}), 256)"
        msat = "cast(cast(round(value * 1000) as bigint) as string)"
        tags = f"""CASE
            WHEN kind IN (6, 7) THEN array(array('e', {h('e', 'target')}, '', ''), array('p', target_pubkey))
            WHEN kind = 9735 THEN concat(array(array('e', {h('e', 'target')}), array('p', target_pubkey), array('P', {h('u', f'event_id * 7 % {users}')})),
                CASE WHEN event_id % 3 = 0 THEN array() ELSE array(array('amount', {msat})) END,
                array(array('bolt11', 'lnbc' || (event_id % 900 + 1) || 'u1abc'), array('description', '{{"pubkey":"' || {h('u', f'event_id * 7 % {users}')} || '","tags":[["amount","' || {msat} || '"],["e","' || {h('e', 'target')} || '"]]}}')))
            WHEN kind = 1111 THEN array(array('e', {h('e', 'target')}, '', 'root'), array('p', target_pubkey))
            WHEN kind = 1 AND note % 4 = 1 THEN array(array('e', {h('e', 'root')}, '', 'root'), array('e', {h('e', 'target')}, '', 'reply'), array('p', target_pubkey))
            WHEN kind = 1 AND note % 4 = 3 THEN array(array('e', {h('e', 'target')}), array('p', target_pubkey))
            WHEN kind = 1 AND quote IS NOT NULL THEN array(array('q', {h('e', 'quote')}))
            WHEN kind = 3 THEN transform(filter(sequence(0, 9), k -> (user_id * 3 + k * 7 + event_id) % {users} <> user_id), k -> array('p', {h('u', f'(user_id * 3 + k * 7 + event_id) % {users}')}))
            WHEN kind = 10002 THEN array(array('r', 'wss://a' || (event_id % 7) || '.example', 'read'), array('r', 'wss://b.example'), array('r', 'wss://c' || (event_id % 3) || '.example', 'write'))
            WHEN kind = 30078 THEN array(array('d', CASE WHEN event_id % 20 = 9 THEN 'seen' ELSE 'settings' END))
            WHEN kind = 4 THEN array(array('p', {h('u', f'(user_id + event_id) % {users}')}))
            WHEN kind = 10000 THEN array(array('p', {h('u', f'(user_id * 5 + event_id) % {users}')}), array('p', {h('u', f'(user_id + 1) % {users}')}))
            ELSE array() END"""
        content = """CASE WHEN kind = 7 THEN element_at(array('+', '', '-', '!'), cast(event_id % 4 + 1 as int))
            WHEN kind = 0 THEN '{"name":"user' || user_id || '","display_name":"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'User Number ' || user_id END || '","picture":"https://img.example/' || user_id || '.png","about":"about ' || event_type || '","nip05":"u' || user_id || '@example.com","website":"https://site' || (user_id % 9) || '.example"}'
            WHEN kind = 30078 THEN '{"seenUntil":' || (event_id * 1000) || '}' WHEN kind IN (1, 1111) THEN 'note about ' || event_type || ' ' || cast(event_id % 97 as string) ELSE '' END"""
        more = [c for c in numbers.columns if c not in GIVEN]
        return ev.selectExpr("id", "pubkey", "kind", "created_at", f"cast({tags} AS array<array<string>>) AS tags", f"{content} AS content", "event_id", "user_id", *more)

    @cached_property
    def tags(self) -> DataFrame:
        return self.stored("tags", lambda: flatten_tags(self.events), ("tag_key", "kind", "created_at"))

    @cached_property
    def zaps(self) -> DataFrame:
        return self.stored("zaps", lambda: note_zaps(self.events), ("created_at",))

    @cached_property
    def edges(self) -> DataFrame:
        """Reply edges."""
        return self.stored("edges", lambda: jobs.reply_edges(self.tags), ("created_at",))

    @cached_property
    def contacts(self) -> DataFrame:
        """Newest contact lists."""
        return self.stored("contacts", lambda: jobs.contacts_latest(self.events), ("pubkey",))

    @cached_property
    def follows(self) -> DataFrame:
        return jobs.follow_edges(self.contacts)

    @cached_property
    def derived_tags(self) -> DataFrame:
        """Tags that a processor derived from contents."""
        return enrich.keyword_tags(self.events.where("kind IN (1, 1111)"), ("click", "error", "purchase", "signup", "view"))

    @cached_property
    def users(self) -> DataFrame:
        return self.events.select("pubkey").distinct()

    @cached_property
    def scores(self) -> DataFrame:
        """source, pubkey, score, followers, nodes, fetched_at: two versions of each author's external score."""
        return self.stored("scores", self._scores, ("pubkey",))

    def _scores(self) -> DataFrame:
        u = table(self.spark, self.sf_dir, "events").select("user_id").distinct()
        two = u.selectExpr("user_id", "explode(array(0, 1)) AS v")
        return two.selectExpr("'reputation' AS source", "sha2('u' || user_id, 256) AS pubkey", "cast((user_id * 7 + v * 13) % 101 as double) AS score", "cast((user_id * 37 + v) % 1000 as bigint) AS followers",
                              "cast(1000 as bigint) AS nodes", "timestamp_ntz '2024-01-29 00:00:00' + make_interval(0, 0, 0, v, user_id % 24) AS fetched_at")

    @cached_property
    def replies_with_text(self) -> DataFrame:
        """Replies whose content is a document's text: input of the quality metrics."""
        docs = table(self.spark, self.sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
        notes = self.events.where("kind IN (1, 1111)").drop("content")
        return notes.join(docs, "event_id").withColumnRenamed("text", "content")

    @cached_property
    def relays(self) -> DataFrame:
        """event_id, relay, first_seen_at, last_seen_at."""
        two = self.events.selectExpr("id", "created_at", "event_id", "explode(array(0, 1)) AS v")
        return two.selectExpr("id AS event_id", "'wss://relay' || ((event_id + v) % 5) || '.example' AS relay", "created_at AS first_seen_at", "created_at + make_interval(0, 0, 0, 0, 0, v) AS last_seen_at")

    @cached_property
    def reviews(self) -> DataFrame:
        """Review events (kind 38000) of mints, from orders and suppliers."""
        n = table(self.spark, self.sf_dir, "supplier").selectExpr("max(s_suppkey) + 1 AS n").first().n or 1
        o = table(self.spark, self.sf_dir, "orders")
        return o.selectExpr("sha2('r' || o_orderkey, 256) AS id", "sha2('u' || o_custkey, 256) AS pubkey", "38000 AS kind", "o_orderdate AS created_at",
                            f"array(array('k', '38172'), array('u', ' https://Mint-' || (o_orderkey % {n}) || '.example/'), array('d', 'm' || (o_orderkey % {n}))) AS tags",
                            "CASE WHEN o_orderkey % 7 = 0 THEN 'no score' ELSE 'fine [' || substring(o_orderpriority, 1, 1) || '/5]' END AS content")

    @cached_property
    def audits(self) -> DataFrame:
        """url, name, state, n_mints, n_melts, n_errors, info (JSON in a string)."""
        s = table(self.spark, self.sf_dir, "supplier")
        return s.selectExpr("'https://mint-' || s_suppkey || '.example' AS url", "s_name AS name", "CASE WHEN s_suppkey % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS state", "cast(s_suppkey * 3 % 100 as bigint) AS n_mints", "cast(s_suppkey * 7 % 50 as bigint) AS n_melts",
                            "cast(s_suppkey % 4 as bigint) AS n_errors", "'{\"nuts\":{\"4\":{\"methods\":[{\"unit\":\" SAT\"},{\"unit\":\"usd\"}]},\"5\":{\"methods\":[{\"unit\":\"sat\"}]}},\"contact\":[{\"method\":\"key\",\"info\":\"op' || s_suppkey || '\"}]}' AS info").where("url NOT LIKE '%9.example'")
