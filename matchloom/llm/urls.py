"""URL filters: longest host and path rule first, else a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in a URL; a hit counts if no letter or
digit touches it on either side. Each distinct term counts once with its weight. A strict term
reaches the limit by itself, soft terms only together.
"""

from __future__ import annotations

from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
STRICT, SOFT, LIMIT = 6, 2, 6
#: Our own vocabulary: term -> weight. One strict term, or three distinct soft ones, reach the limit.
VOCABULARY = (
    {t: STRICT for t in ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "milf", "nsfw", "warez", "keygen", "viagra", "cialis")}
    | {t: SOFT for t in ("adult", "sex", "sexy", "nude", "erotic", "dating", "casino", "poker", "bet", "slots", "bonus", "jackpot", "gambling", "torrent", "crack", "pills", "loan", "free", "cheap", "hot", "girls", "teen", "webcam", "x")}
)


class Terms:
    """A vocabulary {term: weight} and its automaton, which a worker makes once, when it first needs it."""

    def __init__(self, weights: dict[str, int]):
        self.weights, self._found = dict(sorted(weights.items())), None

    def __getstate__(self):
        return {"weights": self.weights, "_found": None}

    @property
    def automaton(self):
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._found.add_word(term, (term, weight))
            self._found.make_automaton()
        return self._found


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def weigh(url: str, automaton) -> tuple[int, int]:
    """Summed weight and number of the distinct terms of a lower-case URL, by whole words."""
    hits = {t: w for end, (t, w) in automaton.iter(url) if _edge(url, end + 1) and _edge(url, end - len(t))}
    return sum(hits.values()), len(hits)


def _weights(sent, batches):
    terms = sent.value
    for batch in batches:
        urls = batch.column(1).to_pylist()
        found = [weigh(u.translate(_LOWER), terms.automaton) if u and terms.weights else (0, 0) for u in urls]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())], names=[*batch.schema.names, "term_weight", "n_terms"])


_LOWER = {c: c + 32 for c in range(65, 91)}


MAX_TERMS = 1_000_000


def _lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_vocabulary(terms: DataFrame) -> dict[str, int]:
    """The vocabulary of a table (term, weight): terms with A-Z lower-cased, as URLs are, the largest weight of each. It is held by every
    worker, so more than MAX_TERMS terms are an error; null or empty terms and null weights are left out."""
    rows = terms.filter("term <> '' and weight is not null").groupBy(_lower("term").alias("term")).agg(F.max("weight").cast("int").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r.term: r.weight for r in rows}


def judge(pages: DataFrame, rules=RULES, vocabulary=None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, term_weight, n_terms for every row of ``pages``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there up to ``?``, ``#`` or the end; both empty without ``://`` and for null URLs, which no rule
    fits and which are allowed. The longest fitting rule decides; without one the vocabulary
    does: a dict, or a table (term, weight) for :func:`read_vocabulary`; by default our own short one.
    URLs of any length are read whole. Repeated rows give repeated rows, no rows none; extra columns are
    ignored.
    """
    if isinstance(vocabulary, DataFrame):
        vocabulary = read_vocabulary(vocabulary)
    sent = pages.sparkSession.sparkContext.broadcast(Terms(VOCABULARY if vocabulary is None else vocabulary))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    parts = pages.select("page_id", "url").mapInArrow(partial(_weights, sent), "page_id long, url string, term_weight int, n_terms int")
    parts = parts.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    method = F.when(F.col("term_weight") >= limit, "block").otherwise("allow")
    parts = parts.withColumn("chosen", chosen)
    return parts.select("page_id", "host", "path", "chosen.rule", F.coalesce("chosen.verdict", method).alias("verdict"), "term_weight", "n_terms")


def oracle() -> str:
    """The same for DuckDB, with one regular expression a term."""
    def hit(t):
        return f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"

    weight = " + ".join(f"{w} * {hit(t)}" for t, w in sorted(VOCABULARY.items()))
    count = " + ".join(hit(t) for t in sorted(VOCABULARY))
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + f" WHEN term_weight >= {LIMIT} THEN 'block' ELSE 'allow' END"
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH a AS (SELECT page_id, {lower("coalesce(url, '')")} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, ({weight})::INT AS term_weight, ({count})::INT AS n_terms FROM a)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, term_weight, n_terms FROM b"""
