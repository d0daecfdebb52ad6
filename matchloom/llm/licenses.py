"""License scans by diagonal voting, with DataFrame functions only.

Hashes of all rolling word k-grams of the texts are joined to their positions in templates. Hits of
one place have one offset between text and template, its diagonal, and vote for it; neighbouring
diagonals, which a few words put in or left out make, are merged, and a merged span is verified by the
share of its words and of the template's that hits cover.

There are two kinds of templates: short phrases, cut into pairs of words, of which every vote is
needed, and notices, cut into runs of five words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licenses as their stewards publish them, and their labels.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details.": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl",
    "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/": "cc-by",
}
PAIR, RUN = 2, 5
SIMILARITY = 0.8
#: Votes under which a diagonal of a notice is chance, and words between two diagonals that are merged.
VOTES, SLACK = 3, 8
#: Rows of the template table up to which it is broadcast, about 100 bytes each; a larger one is joined by a shuffle.
BROADCAST_GRAMS = 20_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    # lower() is the fast way; of all other letters, only these two become or hold one of a-z.
    low = F.when(F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SPLIT), "")


def templates(phrases=None, notices=None) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, k, words, grams) of all templates; a notice of fewer words than a run is an error."""
    out = []
    for k, texts in ((PAIR, PHRASES if phrases is None else phrases), (RUN, NOTICES if notices is None else notices)):
        for text, label in texts.items():
            held = [w for w in re.split(SPLIT, text.translate(str.maketrans(_UPPER, _LOWER))) if w]
            if len(held) < k:
                raise ValueError(f"a template needs {k} words: {text!r}")
            out.append((len(out), label, k, len(held), [" ".join(held[i : i + k]) for i in range(len(held) - k + 1)]))
    return out


def hits(docs: DataFrame, known: list) -> DataFrame:
    """(row, doc_id, n_words, template, tpos, pos): every k-gram of a text at every place where a template has it;
    one row more for each document, without a template, carries documents that have none.

    The scan of the texts is one pass without a shuffle; only hits leave it.
    """
    spark = docs.sparkSession
    grams = [(gram, k, t, i) for t, _, k, _, held in known for i, gram in enumerate(held)]
    table = spark.createDataFrame([*grams, ("", 0, -1, -1)], "gram string, k int, template int, tpos int")
    # Hashes of the parts, as texts are hashed; no text has the hash of the row that stands for a document.
    table = table.withColumn("hash", F.when(F.col("k") > 0, F.xxhash64("k", F.split("gram", " "))).otherwise(F.lit(0).cast("long")))
    table = F.broadcast(table) if len(grams) <= BROADCAST_GRAMS else table
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    names = [f"p{i}" for i in range(RUN)]
    shifted = F.arrays_zip(*((F.col("words") if i == 0 else F.slice("words", F.lit(i + 1), F.size("words"))).alias(p) for i, p in enumerate(names)))
    placed = rows.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(shifted).alias("pos", "p")).select("row", "doc_id", "n_words", "pos", *(F.col("p")[n].alias(n) for n in names))
    hashed = lambda k: F.xxhash64(F.lit(k), *names[:k])
    either = F.when(F.col("pos").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("pos") == 0, F.array(hashed(PAIR), hashed(RUN), F.lit(0).cast("long"))).otherwise(F.array(hashed(PAIR), hashed(RUN)))
    text = F.when(F.col("k") == PAIR, F.concat_ws(" ", *names[:PAIR])).when(F.col("k") == RUN, F.concat_ws(" ", *names)).otherwise("")
    found = placed.select("*", F.explode(either).alias("hash")).join(table, "hash").filter(text == F.col("gram"))
    return found.select("row", "doc_id", "n_words", "template", "tpos", F.coalesce("pos", F.lit(0)).alias("pos"))


def places(found: DataFrame, known: list) -> DataFrame:
    """(row, label, n, first, last): the phrases that stand in a text whole, by label."""
    spark = found.sparkSession
    phrases = F.broadcast(spark.createDataFrame([(t, label, n - k + 1) for t, label, k, n, _ in known if k == PAIR], "template int, label string, needed long"))
    votes = found.join(phrases, "template").groupBy("row", "label", "template", "needed", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"))
    return votes.filter("votes = needed").groupBy("row", "label").agg(F.count("*").alias("n"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))


def spans(found: DataFrame, known: list, similarity: float = SIMILARITY) -> DataFrame:
    """(row, label, start, end, score): the notices that a text holds at ``similarity`` or more, in words."""
    spark = found.sparkSession
    notices = F.broadcast(spark.createDataFrame([(t, label, n) for t, label, k, n, _ in known if k == RUN], "template int, label string, length int"))
    voted = found.join(notices, "template").groupBy("row", "label", "template", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("at"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SLACK).cast("int"), F.lit(0))
    merged = voted.filter(F.col("votes") >= VOTES).withColumn("apart", apart).withColumn("span", F.sum("apart").over(line))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("at")), lambda t: F.sequence(t, t + RUN - 1)))))
    first, last = F.min(F.col("diagonal") + F.array_min("at")), F.max(F.col("diagonal") + F.array_max("at")) + RUN
    whole = merged.groupBy("row", "label", "template", "length", "span").agg(first.alias("start"), last.alias("end"), covered.alias("covered"))
    score = F.col("covered") / F.greatest("length", F.col("end") - F.col("start"))
    return whole.withColumn("score", score).filter(F.col("score") >= similarity).select("row", "label", "start", "end", "score")


def scan(docs: DataFrame, phrases=None, notices=None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices of every row.

    n_base: places of whole phrases, their smallest and largest start as first_word and last_word (null
    without one); labels of phrases, and of phrases and notices together, each once, in order. score: 1 with a
    phrase, else the highest similarity of a notice, 0 without any. ``phrases`` and ``notices`` are dicts
    text -> label. Null and empty texts have no words; repeated rows are scanned one by one, texts of any length whole;
    other columns are ignored; no rows give no rows.
    """
    known = templates(phrases, notices)
    found = materialize(hits(docs.select("doc_id", "text"), known), "license-hits")
    none = lambda t: F.lit(None).cast(t)
    id_type = docs.schema["doc_id"].dataType
    facts = found.filter("template < 0").select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("n"), none("int").alias("first"), none("int").alias("last"), none("string").alias("base"), none("string").alias("label"), F.lit(0.0).alias("score"), F.lit(0).alias("notice"))
    base = places(found, known).select("row", none(id_type).alias("doc_id"), none("int").alias("n_words"), "n", "first", "last", F.col("label").alias("base"), "label", F.lit(1.0).alias("score"), F.lit(0).alias("notice"))
    more = spans(found, known, similarity).select("row", none(id_type).alias("doc_id"), none("int").alias("n_words"), F.lit(0).cast("long").alias("n"), none("int").alias("first"), none("int").alias("last"), none("string").alias("base"), "label", "score", F.lit(1).alias("notice"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = facts.unionByName(base).unionByName(more).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sum("n").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        listed("base").alias("base_labels"), listed("label").alias("labels"), F.max("score").alias("score"), F.sum("notice").alias("n_notices"),
    )
    return out.drop("row")


def _oracle() -> str:
    """The same in DuckDB over plain strings."""
    known = templates()
    grams = ", ".join(f"({t}, '{label}', {k}, {n}, {i}, '{g}')" for t, label, k, n, held in known for i, g in enumerate(held))
    one = lambda c: f"array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ',')"
    return f"""
    WITH g(template, label, k, length, tpos, gram) AS (VALUES {grams}),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{SPLIT[1:-2]}]+') AS w FROM documents),
    p AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS pos FROM d),
    q AS (SELECT r, pos, {PAIR} AS k, w || ' ' || lead(w) OVER o AS gram FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)
      UNION ALL SELECT r, pos, {RUN}, w || {" || ".join(f"' ' || lead(w, {i}) OVER o" for i in range(1, RUN))} FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
    hit AS (SELECT r, template, label, g.k, length, tpos, pos, pos - tpos AS diagonal FROM q JOIN g ON g.gram = q.gram AND g.k = q.k),
    voted AS (SELECT r, template, label, k, length, diagonal, count(*) AS votes FROM hit GROUP BY ALL),
    base AS (SELECT r, label, diagonal FROM voted WHERE k = {PAIR} AND votes = length - {PAIR - 1}),
    near AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart FROM voted WHERE k = {RUN} AND votes >= {VOTES}),
    merged AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM near),
    word AS (SELECT DISTINCT m.r, m.template, m.span, unnest(range(h.tpos, h.tpos + {RUN})) AS t FROM merged m JOIN hit h ON h.r = m.r AND h.template = m.template AND h.diagonal = m.diagonal),
    size AS (SELECT m.r, m.template, m.label, m.length, m.span, max(h.pos) + {RUN} - min(h.pos) AS words FROM merged m JOIN hit h ON h.r = m.r AND h.template = m.template AND h.diagonal = m.diagonal GROUP BY ALL),
    notice AS (SELECT s.r, s.label, (count(*) / greatest(s.length, s.words))::DOUBLE AS score FROM size s JOIN word w ON w.r = s.r AND w.template = s.template AND w.span = s.span GROUP BY s.r, s.template, s.label, s.length, s.span, s.words HAVING count(*) / greatest(s.length, s.words) >= {SIMILARITY}),
    fact AS (SELECT r, diagonal AS first, label AS base, label, 1.0::DOUBLE AS score, 0 AS notice FROM base UNION ALL SELECT r, NULL, NULL, label, score, 1 FROM notice)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, count(first)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(first)::BIGINT AS last_word, coalesce({one("base")}, '') AS base_labels, coalesce({one("label")}, '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score, coalesce(sum(notice), 0)::BIGINT AS n_notices
    FROM d LEFT JOIN fact USING (r) GROUP BY r, d.doc_id, w"""


ORACLE = _oracle()
