"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm them, words nearby move the score.
The patterns give the matches of the plain ones in ``PLAIN``; possessive quantifiers and starts at
the edge of a run keep their time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, and one of our own for account numbers.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9]([\x20]?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}([\x20]?[A-Z0-9]{1,3})?",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
    "iban": PLAIN["iban"],
}
BASE = ("email", "ip", "card", "phone")
#: Cheap tests that every text with a confirmed span passes.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z][A-Z][0-9][0-9]")),
}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT_CHARS = 40
#: Our own context words and scores.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|pay|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|appelez|llame)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
NEARBY = 0.2
FOUND = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    worth = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(turned, i, F.lit(1)))
    value = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.when(code(i) >= 65, code(i) - 55).otherwise(code(i) - 48))
    return F.aggregate(value, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.rlike(hit, F.lit(rf"^(?:{BYTE}\.){{3}}{BYTE}$")),
        "card": lambda: F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False),
        "phone": lambda: F.length(digits).between(9, 15),
        "iban": lambda: mod97(F.regexp_replace(hit, " ", "")),
    }[kind]()


def _spans(kind: str, pieces: Column, hits: Column) -> Column:
    """Spans of the confirmed hits; pieces are the stretches of text around them."""
    n = F.size(hits)
    around = lambda i: F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS)))
    score = lambda i: F.lit(SCORES[kind]) + F.when(F.rlike(around(i), F.lit(CONTEXT[kind])), F.lit(NEARBY)).otherwise(F.lit(0.0))
    items = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(F.get(hits, i)).alias("size"), _confirmed(kind, F.get(hits, i)).alias("ok"), score(i).alias("score")))
    # Places are sums of lengths. A sum is carried along by appending to an array, which copies it, so hits are summed in blocks of
    # about the root of their number: first the blocks, then the hits of each from where it starts.
    step = F.ceil(F.sqrt(n)).cast("int")

    def sums(lengths: Column, first: Column) -> Column:
        """Where each of some lengths begins, from ``first`` on."""
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(lengths, start, lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.all, F.array(acc.at)).alias("all")), lambda acc: acc.all)

    def placed(items: Column) -> Column:
        both = F.transform(items, lambda x: x.gap + x.size)
        blocks = F.transform(F.sequence(F.lit(1), n, step), lambda k: F.slice(both, k, step))
        starts = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x)), F.lit(0))
        begins = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda x: sums(x.b, x.s)))
        spans = F.zip_with(items, begins, lambda x, at: F.struct(x.ok.alias("ok"), F.lit(kind).alias("kind"), (at + x.gap).alias("start"), (at + x.gap + x.size).alias("end"), x.score.alias("score")))
        return F.transform(F.filter(spans, lambda x: x.ok), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.score.alias("score")))

    return F.when(n > 0, placed(items)).otherwise(F.array().cast(FOUND))


def find(docs: DataFrame, kinds=tuple(PATTERNS)) -> DataFrame:
    """doc_id and ``found``: the spans (kind, start, end, score) by kind and start, for every row.

    Offsets are code points, the end is exclusive. Matches are leftmost and don't overlap within a
    kind; those that fail their check are dropped. Null and empty texts have none; rows with a null
    doc_id and repeated rows are kept as they are; extra columns are ignored; no rows give no rows. Texts
    of any length are read whole, in a time nearly in proportion to length and hits.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in kinds:
        hint, pattern = HINTS[k](F.col("text")), F.lit(PATTERNS[k])
        none = F.array().cast("array<string>")
        out = out.withColumn(f"{k}_hits", F.when(hint, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    for k in kinds:
        out = out.withColumn(f"{k}_pieces", F.when(F.size(f"{k}_hits") > 0, F.split("text", PATTERNS[k], -1)))
    return out.select("doc_id", F.concat(*(_spans(k, F.col(f"{k}_pieces"), F.col(f"{k}_hits")) for k in kinds)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as a string, their scores in
    hundredths in the same order, and how many have a word of their kind nearby."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s.kind.isin(*BASE))
    scores = F.concat_ws(",", F.transform("found", lambda s: F.round(s.score * 100).cast("int").cast("string"))).alias("scores")
    nearby = lambda s: s.score > F.element_at(F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv)), s.kind) + NEARBY / 2
    n_nearby = F.size(F.filter("found", nearby)).cast("long").alias("n_nearby")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores, n_nearby)


def _oracle() -> str:
    """The same in DuckDB, from the plain patterns."""
    def digits(h):
        return f"regexp_replace({h}, '[^0-9]', '', 'g')"

    def luhn_sql(h):
        d = f"reverse({digits(h)})"
        return f"list_sum(list_transform(generate_series(1, len({d})), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr({d}, i, 1)::INT) - CASE WHEN substr({d}, i, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr({d}, i, 1)::INT END)) % 10 = 0"

    def mod_sql(h):
        c = f"replace({h}, ' ', '')"
        t = f"(substr({c}, 5) || substr({c}, 1, 4))"
        return f"list_reduce(list_prepend(0, list_transform(generate_series(1, len({t})), lambda i: CASE WHEN ascii(substr({t}, i, 1)) >= 65 THEN ascii(substr({t}, i, 1)) - 55 ELSE ascii(substr({t}, i, 1)) - 48 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"

    ok = {
        "email": "true", "ip": f"regexp_full_match(h, '(?:{BYTE}\\.){{3}}{BYTE}')", "card": f"CASE WHEN len({digits('h')}) BETWEEN 13 AND 19 THEN {luhn_sql('h')} ELSE false END",
        "phone": f"len({digits('h')}) BETWEEN 9 AND 15", "iban": mod_sql("h"),
    }
    rows = []
    for at, (k, p) in enumerate(PLAIN.items()):
        near = f"regexp_matches(right(g, {CONTEXT_CHARS}) || ' ' || left(g2, {CONTEXT_CHARS}), '{CONTEXT[k]}')"
        rows.append(f"""SELECT r, {at} AS o, '{k}' AS kind, s, s + len(h) AS e, {near} AS near, {round(100 * SCORES[k])} + CASE WHEN {near} THEN {round(100 * NEARBY)} ELSE 0 END AS score FROM (
          SELECT r, h, g, g2, sum(len(g)) OVER w + coalesce(sum(len(h)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM (SELECT r, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS g, unnest(gaps[2:len(hits) + 1]) AS g2, unnest(range(len(hits))) AS i FROM (SELECT r, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM d)) WINDOW w AS (PARTITION BY r ORDER BY i)
        ) WHERE {ok[k]}""")
    text = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"(count(kind) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(rows)})
    SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY o, s) FILTER (o < 4), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY o, s), '') AS spans,
      coalesce(string_agg(score::VARCHAR, ',' ORDER BY o, s), '') AS scores, (count(kind) FILTER (near))::BIGINT AS n_nearby
    FROM (SELECT r, doc_id FROM d) LEFT JOIN f USING (r) GROUP BY r, doc_id"""


ORACLE = _oracle()
