"""Every operator on odd tables: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe, decontam, jaccard, langid, lattice, licenses, pii, token_files, toxicity, warc

RANKS, TOKENIZER = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
#: Names that the operators use for columns of their own, somewhere.
CLASHES = "_doc _m _m_email _text _block _row _terms _pattern _matches _matches_email _spans _set _lost_id _lost_set _digest _lines _norm _found _id _score _lang_pred key copy entities words entity content told sig token n place start ids_crc32 index y order shard target blocks cell node copies unit tie distance".split()
LONG = "So on and so forth it goes, with mail to some.one@mail.example and more; " * 4000
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "x" * 200_000), (6, "The same text of some words, twice over."), (6, "The same text of some words, twice over."),
    (7, "The same text of some words, twice over."), (None, "No id, but mail to some.one@mail.example all the same."), (None, None), (8, "All rights reserved."), (9, "\U0001f600 été 日本語 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in TEXTS], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def odd(plain):
    return plain.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "goes with mail to some one mail example and more so on"), (2, None), (3, ""), (4, "same text of some words twice over"), (5, "same text of some words twice over"), (6, "nowhere to be found in any of these texts at all")], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, 1) for i in range(1, 10)] + [(None, 1, 0), (6, None, 1)], "doc_id long, toxic int, y int")


OPERATORS = {
    "toxicity": lambda df, s, b: toxicity.score(df, toxicity.train(df, _labels(s))),
    "bpe": lambda df, s, b: bpe.encode(df, RANKS, P.PATTERN),
    "pii": lambda df, s, b: pii.redact(pii.find(df)),
    "licenses": lambda df, s, b: licenses.scan(df),
    "decontam": lambda df, s, b: decontam.find(df, b),
    "language": lambda df, s, b: langid.predict(df, langid.train(df)),
    "jaccard": lambda df, s, b: jaccard.join(df),
    "sets": lambda df, s, b: jaccard.with_sets(df),
    "token_files": lambda df, s, b: token_files.round_trip(df, TOKENIZER, 2),
}


def _rows(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_tables(spark, plain, odd, none, bench, name):
    run = OPERATORS[name]
    want = run(plain, spark, bench)
    own = [c for c in want.columns if c not in CLASHES or c in ("start", "ids_crc32")]
    wanted = _rows(want, own)
    assert len(wanted) == len(TEXTS)
    got = run(odd, spark, bench.withColumns({c: F.lit(7) for c in CLASHES}))
    assert _rows(got, own) == wanted
    kept = [c for c in CLASHES if c in got.columns and c not in want.columns]
    if name not in ("licenses", "jaccard", "token_files"):
        assert kept == [c for c in CLASHES if c not in want.columns]
        assert got.agg(*(F.min(c) == 7 for c in kept), *(F.max(c) == 7 for c in kept)).first() == (True,) * (2 * len(kept))
    assert run(none, spark, bench).count() == 0


def test_values_of_the_odd_cases(spark, plain, bench):
    found = {(r.doc_id, r.text): [x.item_id for x in r.found] for r in decontam.find(plain, bench).collect()}
    assert found[4, LONG] == [1] and found[6, TEXTS[5][1]] == [4] == found[7, TEXTS[7][1]] and found[1, None] == [] == found[2, ""]
    marked = pii.find(plain).select("doc_id", F.size("email").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in marked) == sorted((i or 0, (t or "").count("@")) for i, t in TEXTS)
    joined = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(plain).collect()]
    assert joined.count((6, 4, 6)) == 2 and (7, 4, 6) in joined and (1, 0, 1) in joined and (5, 1, 5) in joined and (None, 0, None) in joined
    licences = {r.doc_id: r.licenses for r in licenses.scan(plain).collect() if r.doc_id}
    assert licences[8] == "LicenseRef-All-Rights-Reserved" and licences[1] == licences[2] == ""


def test_ties_take_the_first_language_and_equal_scores_stay(spark):
    rows = spark.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(rows, langid.train(rows)).collect()} == {"aa"}
    model = toxicity.train(rows, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(rows, model).collect()}) == 1


def test_archives_of_odd_pages(spark):
    long = "é" * 300_000
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, long), (4, "v", long), (4, "v", long), (None, "w", long)], "page_id long, url string, html string")
    clashing = pages.withColumns({c: F.lit(7) for c in CLASHES})
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = _rows(warc.round_trip(pages), columns)
    assert _rows(warc.round_trip(clashing), columns) == want and warc.round_trip(clashing.where("false")).count() == 0
    assert [r[3] for r in want if r[0] == "4"] == ["response", "response"] and [r[4] for r in want if r[0] in ("3", "None")] == ["4", "4"]


def test_vectors_of_odd_tables(spark):
    big, tiny = [1.7e308, 1.7e308], [1e-300, 1.1e-300]
    rows = [(1, big), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, tiny), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, -0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(str, lattice.links(df).collect()))
    assert sorted(map(str, lattice.links(df.withColumns({c: F.lit(7) for c in CLASHES})).collect())) == want
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.links(df).collect() if r.vec_id}
    assert got[1] == (4, 1) and got[2] == (4, 1) and got[3] == (4, 1) and got[10] == got[11] == (1, 10)
    assert all(got[k] == (0, k) for k in (4, 5, 6, 7, 8, 9))


def test_many_rows_of_one_id_are_dealt_to_several_files(spark):
    df = spark.createDataFrame([(None if k % 3 else 5, f"text number {k}") for k in range(400)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the rows were many
    try:
        shards = token_files.write(df, token_files.shared_folder(spark, "t"), TOKENIZER, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 1
    got = token_files.read(shards).orderBy("start").collect()
    assert len(got) == 400 and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
