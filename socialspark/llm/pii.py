"""Personal data in texts: proposals by regular expression, checksums that confirm them, context words that adjust a score.

DataFrame functions only, one row at a time and nothing shuffled. A kind's pattern is applied once: its matches are set
between marks (U+E000, which the text itself loses to U+E001 first, so that no position moves), the text is split at
the marks, and lengths of the pieces, summed in chunks, give positions in code points.

Base spans (kinds email, ip, card, phone) are the leftmost non-overlapping matches that pass their check: parts of an
ip at most 255, cards 13 to 19 digits that pass Luhn, phones 9 to 15 digits; a match that fails is dropped without a
second try. Base spans always stay, whatever their score. Further spans come from wider patterns (``MORE``): account
numbers by country length and mod-97 (kind iban), written-out addresses (email), eight groups of hexadecimal (ip),
four groups of four digits inside longer runs of digits (card, Luhn), national numbers (phone). They stay at a score
of ``THRESHOLD`` or more and where no base span overlaps them. A score starts from the pattern's own value and goes up
by ``STEP`` if a word for the kind stands within 40 code points before or 24 after (no further than the neighbouring
match), down by it if a word against it does.

Defined cases: null text is empty and has no spans; null doc_ids and repeated rows are rows like others; other columns
are not read by :func:`find` and pass :func:`redact` unchanged, whatever their names; an empty table gives an empty
result; adjacent matches of one kind are two spans; a text of any length is one row, in time linear in its length for
the patterns, and in count times the chunk of 512 for positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "\ue000", "\ue001"
CHUNK = 512
THRESHOLD = 60
STEP = 30
BEFORE, AFTER = 40, 24
KINDS = ("email", "ip", "card", "phone", "iban")

#: Base patterns as specified, and in a form that takes the same matches in linear time (possessive, no start inside a run).
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: name: kind, pattern, characters that may not stand next to a match. Repetitions are bounded.
MORE = {
    "written": ("email", r"[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[](?:dot|DOT)[)\]]|[.]) ?[A-Za-z0-9-]{1,63}){1,8}", "[A-Za-z0-9@]"),
    "hex": ("ip", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", "[0-9A-Za-z:]"),
    "groups": ("card", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "[0-9]"),
    "national": ("phone", r"[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}", "[0-9A-Za-z+]"),
    "account": ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "[A-Za-z0-9]"),
}
START = {"email": 90, "ip": 60, "card": 80, "phone": 60, "written": 60, "hex": 70, "groups": 50, "national": 30, "account": 90}
FOR = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server|client|login",
    "card": "card|cards|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = {
    "email": "example|placeholder",
    "ip": "version|release|section|chapter|build",
    "card": "isbn|order|invoice|serial|tracking|checksum",
    "phone": "isbn|order|invoice|serial|version|checksum",
    "iban": "sample|serial|checksum",
}
#: Length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
IP_PART = "0*(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though the body names it often and in its own lambdas."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def piece_starts(lengths: Column) -> Column:
    """Sums of the entries before each entry, in chunks, so that the work is entries times the chunk and not its square."""

    def placed(chunks: Column) -> Column:
        at = lambda k: F.aggregate(F.slice(chunks, F.lit(1), k), F.lit(0).cast("long"), lambda s, c: s + c["sum"])
        return F.flatten(F.transform(chunks, lambda c, k: let(at(k), lambda a: F.transform(c["own"], lambda _, i: a + total(F.slice(c["own"], F.lit(1), i))))))

    own = lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))
    chunk = lambda k: let(own(k), lambda o: F.struct(o.alias("own"), total(o).alias("sum")))
    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), chunk), placed)


def matches(t: Column, pattern: str, use) -> Column:
    """``use`` of an array of (m, start, before, after, prev, next): each match, its position, the texts between it and
    its neighbours, and the characters beside it. An empty array where nothing matches."""

    def rows(p: Column) -> Column:
        beside = lambda text, other, cut: cut(F.when(text == "", F.coalesce(other, F.lit(""))).otherwise(text), F.lit(1))
        row = lambda j, starts: F.struct(
            F.get(p, j).alias("m"), F.get(starts, j).alias("start"), F.get(p, j - 1).alias("before"), F.get(p, j + 1).alias("after"),
            beside(F.get(p, j - 1), F.get(p, j - 2), F.right).alias("prev"), beside(F.get(p, j + 1), F.get(p, j + 2), F.left).alias("next"),
        )
        at = lambda lengths: let(piece_starts(lengths), lambda starts: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda j: row(j, starts)))
        return let(F.transform(p, lambda x: F.length(x).cast("long")), at)

    found = let(F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK), rows)
    return F.when(F.rlike(t, F.lit(pattern)), use(found)).otherwise(F.array().cast(f"array<{SPAN}>"))


SPAN = "struct<place:int,kind:string,start:bigint,end:bigint,score:int,base:boolean>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def luhn(d: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return s + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def account_length(m: Column) -> Column:
    """Code points of the match that the country's length takes; null for unknown countries and short matches."""
    known = F.create_map(*[F.lit(x) for pair in IBAN_LENGTH.items() for x in pair])
    wanted = F.try_element_at(known, F.left(m, F.lit(2)))
    fits = F.filter(F.sequence(F.lit(1), F.length(m)), lambda e: F.length(F.replace(F.left(m, e), F.lit(" "), F.lit(""))) == wanted)
    return F.try_element_at(fits, F.lit(1))


def mod97(account: Column) -> Column:
    """The rest of the account number, its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def add(s: Column, i: Column) -> Column:
        v = F.position(F.substring(turned, i, F.lit(1)), F.lit(ALPHABET)) - 1
        return (F.when(v > 9, s * 100).otherwise(s * 10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def words(alternatives: str) -> str:
    return rf"(^|[^\p{{L}}])({alternatives})([^\p{{L}}]|$)"


def score(name: str, kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit("  "), F.left(after, F.lit(AFTER))))
    has = lambda w: F.when(F.rlike(near, F.lit(words(w))), STEP).otherwise(0)
    return (F.lit(START[name]) + has(FOR[kind]) - has(AGAINST[kind])).cast("int")


def span(name: str, kind: str, r: Column, length: Column, base: bool) -> Column:
    return F.struct(
        F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), r["start"].alias("start"), (r["start"] + length).alias("end"),
        score(name, kind, r["before"], r["after"]).alias("score"), F.lit(base).alias("base"),
    )


def base_passes(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": F.rlike(m, F.lit(rf"^{IP_PART}[.]{IP_PART}[.]{IP_PART}[.]{IP_PART}$")),
        "card": n.between(13, 19) & luhn(digits(m)),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(t: Column, kind: str) -> Column:
    use = lambda found: F.transform(F.filter(found, lambda r: base_passes(kind, r["m"])), lambda r: span(kind, kind, r, F.length(r["m"]), True))
    return matches(t, BASE[kind][1], use)


def more_spans(t: Column, name: str) -> Column:
    kind, pattern, beside = MORE[name]
    alone = lambda c: ~F.rlike(c, F.lit(beside))

    def passes(r: Column) -> Column:
        if name == "account":
            def valid(n: Column) -> Column:
                then = F.when(n < F.length(r["m"]), F.substring(r["m"], n + 1, F.lit(1))).otherwise(r["next"])
                return n.isNotNull() & alone(r["prev"]) & alone(then) & (mod97(F.left(r["m"], n)) == 1)

            return F.coalesce(let(account_length(r["m"]), valid), F.lit(False))
        checked = luhn(digits(r["m"])) if name == "groups" else F.lit(True)
        return alone(r["prev"]) & alone(r["next"]) & checked

    length = lambda r: account_length(r["m"]) if name == "account" else F.length(r["m"])
    scored = lambda found: F.transform(F.filter(found, passes), lambda r: span(name, kind, r, length(r), False))
    return matches(t, pattern, lambda found: F.filter(scored(found), lambda s: s["score"] >= THRESHOLD))


def without_marks(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, OTHER)


def spans(text: Column) -> Column:
    """All spans of a text, by kind as in ``KINDS``, then start."""

    def of(t: Column) -> Column:
        base = F.concat(*[base_spans(t, kind) for kind in BASE])
        more = F.concat(*[more_spans(t, name) for name in MORE])
        crosses = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        return let(base, lambda b: let(more, lambda m: F.when(F.size(m) == 0, F.array_sort(b)).otherwise(
            F.array_sort(F.concat(b, F.filter(m, lambda s: ~F.exists(b, lambda x: crosses(s, x))))))))

    return let(without_marks(text), of)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (place, kind, start, end, score, base); positions in code points, end exclusive."""
    return docs.select(F.col("doc_id").cast("long"), spans(F.col("text")).alias("spans"))


def joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as text), n_added."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; of spans of different kinds that overlap, the
    part that both cover goes once, under the first one's kind. A null text stays null, a text without spans is kept as it is."""

    def masked(t: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            gap = F.substring(t, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
            put = F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
            return F.struct(F.greatest(s["at"], x["end"].cast("int")).alias("at"), F.concat(s["out"], F.array(put)).alias("out"))

        by_start = F.array_sort(spans(t), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["place"] - b["place"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        end = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t)))
        return let(by_start, lambda b: F.when(F.size(b) == 0, t).otherwise(F.aggregate(b, first, step, end)))

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), let(F.col(text), masked)))


def _sql() -> str:
    """The same in SQL: matches as rows, with the patterns as specified."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = [*[(k, k, v[0], "") for k, v in BASE.items()], *[(name, *v) for name, v in MORE.items()]]
    mark = "chr(57344)"
    pieces = " UNION ALL ".join(
        f"SELECT rid, doc_id, {quoted(name)} AS name, {quoted(kind)} AS kind, {KINDS.index(kind)} AS place, {START[name]} AS first_score, {quoted(beside or '^$^')} AS beside, "
        f"{quoted(words(FOR[kind]))} AS w_for, {quoted(words(AGAINST[kind]))} AS w_against, {str(name in BASE).lower()} AS base, "
        f"string_split(regexp_replace(t, {quoted(pattern)}, {mark} || '\\0' || {mark}, 'g'), {mark}) AS p FROM t"
        for name, kind, pattern, beside in names)
    lengths = ", ".join(f"('{c}', {n})" for c, n in IBAN_LENGTH.items())
    luhn_sql = "list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (n - i) % 2 = 1 THEN 2 * d[i]::INT - CASE WHEN d[i]::INT > 4 THEN 9 ELSE 0 END ELSE d[i]::INT END)) % 10 = 0"
    turned = "substr(replace(left(m, take), ' ', ''), 5) || left(m, 4)"
    mod_sql = f"list_reduce(list_transform(range(1, length({turned}) + 1), lambda i: strpos('{ALPHABET}', substr({turned}, i, 1)) - 1), lambda s, v: (CASE WHEN v > 9 THEN s * 100 ELSE s * 10 END + v) % 97, 0) = 1"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
pieces AS ({pieces}),
cut AS (SELECT *, unnest(range(2, len(p), 2)) AS j FROM pieces WHERE len(p) > 1),
found AS (
  SELECT * EXCLUDE (p, j), p[j] AS m, coalesce(list_sum(list_transform(p[1:j - 1], lambda x: length(x))), 0)::BIGINT AS start,
    p[j - 1] AS before, p[j + 1] AS after,
    right(CASE WHEN p[j - 1] = '' AND j > 2 THEN p[j - 2] ELSE p[j - 1] END, 1) AS prev,
    left(CASE WHEN p[j + 1] = '' THEN coalesce(p[j + 2], '') ELSE p[j + 1] END, 1) AS next FROM cut),
country(code, need) AS (VALUES {lengths}),
sized AS (
  SELECT found.*, regexp_replace(m, '[^0-9]', '', 'g') AS d, length(regexp_replace(m, '[^0-9]', '', 'g')) AS n,
    CASE WHEN name <> 'account' THEN length(m) ELSE list_filter(range(1, length(m) + 1), lambda e: length(replace(left(m, e), ' ', '')) = need)[1] END AS take
  FROM found LEFT JOIN country ON code = left(m, 2)),
checked AS (
  SELECT * FROM sized WHERE CASE name
    WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(m, '^{IP_PART}[.]{IP_PART}[.]{IP_PART}[.]{IP_PART}$')
    WHEN 'card' THEN CASE WHEN n BETWEEN 13 AND 19 THEN {luhn_sql} ELSE false END
    WHEN 'phone' THEN n BETWEEN 9 AND 15
    WHEN 'account' THEN CASE WHEN take IS NULL THEN false ELSE NOT regexp_matches(prev, beside)
      AND NOT regexp_matches(CASE WHEN take < length(m) THEN substr(m, take + 1, 1) ELSE next END, beside) AND {mod_sql} END
    WHEN 'groups' THEN NOT regexp_matches(prev, beside) AND NOT regexp_matches(next, beside) AND {luhn_sql}
    ELSE NOT regexp_matches(prev, beside) AND NOT regexp_matches(next, beside) END),
near AS (SELECT *, start + take AS stop, lower(right(before, {BEFORE}) || '  ' || left(after, {AFTER})) AS near FROM checked),
scored AS (
  SELECT *, first_score + CASE WHEN regexp_matches(near, w_for) THEN {STEP} ELSE 0 END - CASE WHEN regexp_matches(near, w_against) THEN {STEP} ELSE 0 END AS score FROM near),
kept AS (
  SELECT rid, kind, place, start, stop, base, kind || ':' || start || ':' || stop AS label FROM scored s
  WHERE base OR (score >= {THRESHOLD} AND NOT EXISTS (SELECT 1 FROM scored b WHERE b.rid = s.rid AND b.base AND b.start < s.stop AND s.start < b.stop)))
SELECT t.doc_id, {', '.join(f"count(*) FILTER (WHERE base AND kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg(label, ',' ORDER BY place, start) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(label, ',' ORDER BY place, start), '') AS spans, count(*) FILTER (WHERE NOT base) AS n_added
FROM t LEFT JOIN kept USING (rid) GROUP BY t.rid, t.doc_id
"""


SQL = _sql()
