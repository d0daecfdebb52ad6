"""License scans against plain versions."""

import random
import re

import duckdb
import pytest

from matchloom.llm import licenses

COLUMNS = "doc_id n_words n_base first_word last_word base_labels labels score n_notices".split()
MIT, APACHE, GPL = (next(t for t, label in licenses.NOTICES.items() if label == x) for x in ("mit", "apache", "gpl"))


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def plain(text):
    """Words and phrases by looking at every place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_whole_table_against_plain_version_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(licenses.scan(docs))
    assert sorted(r[:6] for r in got) == sorted(((r.doc_id, *plain(r.text)) for r in docs.select("doc_id", "text").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({licenses.ORACLE})").fetchall(), key=str) == got


def test_notices_by_similarity(spark):
    """One word in fourteen changed, three words put in and two left out keep a notice; half of it doesn't."""
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(n))
    words = MIT.split()
    typos = [w if i % 14 else "changed" for i, w in enumerate(words)]
    shifted = [*words[:20], "one", "two", "three", *words[20:60], *words[62:]]
    cases = {1: MIT, 2: f"{filler(300)} {' '.join(typos)} {filler(40)}", 3: f"{filler(50)}\n{' '.join(shifted)}", 4: " ".join(words[: len(words) // 2]), 5: f"{APACHE} {filler(3)} {GPL} {APACHE.upper()}", 6: filler(900), 7: f"{MIT} " * 40}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*cases.items()], "doc_id long, text string")).collect()}
    assert got[1].score == 1.0 and got[1].labels == "mit" and got[1].base_labels == "" and got[1].n_notices == 1
    assert got[2].labels == got[3].labels == "mit" and 0.8 <= got[2].score < 1 and 0.8 <= got[3].score < 1
    assert (got[4].labels, got[4].score, got[6].labels, got[6].score) == ("", 0.0, "", 0.0)
    assert got[5].labels == "apache,gpl" and got[5].n_notices == 3 and got[5].n_base == 4
    assert got[7].n_notices == 40


def test_odd_rows(spark):
    texts = [None, "", " ..", "mit", "MIT License", "mit-license mit  LICENSE", "CC BY cc by", "CC-BY", "cc by", "gnu general public license gnu general public", "apaKe license İ", "Apache\nLicense " * 30_000, "éapache license", "mit license"]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, "mit license"), (3, "mit license"), (None, "cc by"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as labels", "2 as pos", "3 as hash")
    got = sorted((r[:6] for r in rows(licenses.scan(df))), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in data), key=str)
    assert licenses.scan(df.filter("doc_id > 99")).count() == 0
    assert rows(licenses.scan(df.repartition(5))) == rows(licenses.scan(df))
    with pytest.raises(ValueError):
        licenses.templates({"short": "x"})
