"""Operators that SQL cannot express, against plain versions; the others' SQL on the small tables."""

import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import decontam, jaccard, langid, pii, queries, toxicity

TABLES = "documents embeddings pages benchmark labels conversations".split()


def _values(frame, columns):
    return sorted(tuple("None" if pd.isna(v) else v if isinstance(v, str) else repr(float(v) + 0.0) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, wanted = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _values(got, sorted(got.columns)) == _values(wanted, sorted(got.columns))


def _plain_ftrl(rows, labels, epochs):
    """FTRL-proximal over dictionaries, one coordinate at a time."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= toxicity.L1 else -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for index, label in zip(rows, labels):
            w = {int(i): weight(int(i)) for i in index}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - label
            for i in w:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.ALPHA * w[i]
            bias_n += g * g
            bias -= 0.1 * g / (1 + math.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_toxicity_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(24)], 12)) + (" bad word" if k % 3 == 0 else "") for k in range(150)]
    rows = toxicity._buckets(pa.array(texts), toxicity.BITS)
    labels = np.array([float(k % 3 == 0) for k in range(150)])
    weights, bias = toxicity.ftrl(rows, labels)
    want, want_bias = _plain_ftrl(rows, labels, toxicity.EPOCHS)
    assert {int(i): weights[i] for i in np.flatnonzero(weights)} == pytest.approx(want) and bias == pytest.approx(want_bias) and want
    df = spark.createDataFrame([*enumerate(texts), (200, "")], "doc_id long, text string")
    at = np.flatnonzero(weights)
    got = {r.doc_id: r.score for r in toxicity.score(df, (at, weights[at], bias)).collect()}
    for k, index in enumerate([*rows, []]):
        total = bias + sum(want.get(int(i), 0.0) for i in index)
        assert got[k if k < 150 else 200] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-5)


def _plain_vector(text, dimensions):
    """The bundle of a text's n-grams, one at a time."""
    vectors = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (langid.LETTERS, dimensions))
    letters = [ord(c) % (langid.LETTERS - 1) + 1 if c.isalpha() else 0 for c in f" {text.lower()} "]
    letters = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
    out = np.zeros(dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            out += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c].astype(float)
    return out


def test_language_equals_a_plain_version(spark):
    rows = [(1, "The cat sat, on THE mat!", "en"), (2, "Der Hund;  die Katze", "de"), (3, "été à la mer", "fr"), (4, "a", "en"), (5, "99 -- 7", "de"), (6, "the dog and die maus", None), (7, None, "en"), (8, "ΑΒΓ abc", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.train(df)
    sums = {}
    for _, text, lang in rows:
        if text and lang:
            sums[lang] = sums.get(lang, 0) + _plain_vector(text, langid.DIMENSIONS)
    assert sorted(prototypes) == ["de", "en", "fr"]
    for lang, total in sums.items():
        assert prototypes[lang] == pytest.approx(total / np.linalg.norm(total))
    for r in langid.predict(df, prototypes).collect():
        vector = _plain_vector(r.text or "", langid.DIMENSIONS)
        if not vector.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = {k: float(v @ vector / np.linalg.norm(vector)) for k, v in sorted(prototypes.items())}
        assert r.lang_pred == max(cosines, key=cosines.get) and r.score == pytest.approx(max(0.0, cosines[r.lang_pred]))


def _plain_distance(item, text):
    """The least edits from ``item`` to a part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_equals_a_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, text = ("".join(rng.choice(list("abc "), rng.integers(1, n))) for n in (90, 60))
        assert decontam.edit_distance(item, text)[0] == _plain_distance(item, text)


def test_decontamination_against_all_pairs(spark):
    """Items of all sizes, short ones too, in texts with edits up to the bound: what is found is true, and 0.9 of what is true is found."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(words[k] for k in rng.integers(0, 300, n))
    items = ["q", "xq", "qzj", "zqxj", "jq vz", "kzq jxv", "vqj zkxq"] + [prose(n) for n in rng.integers(3, 60, 40)]
    items = list(dict.fromkeys(items))

    def edited(text, share):
        chars = list(text)
        for k in sorted(rng.choice(len(chars), int(share * len(chars)), replace=False), reverse=True):
            chars[k : k + 1] = [[], ["j"], [chars[k], "z"]][rng.integers(0, 3)]
        return "".join(chars)

    texts = [prose(12) + " " + edited(t, share) + " " + prose(12) for t in items for share in (0, 0.05, 0.1, 0.15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, x.item_id): x.distance for r in decontam.find(docs, bench).collect() for x in r.found}
    flat = decontam.normalised(pa.array(texts)).to_pylist()
    true = {(d, i): e for d, text in enumerate(flat) for i, item in enumerate(items) if (e := decontam.edit_distance(item, text)[0]) <= decontam.DISTANCE * len(item)}
    assert all(true[k] <= v <= decontam.DISTANCE * len(items[k[1]]) for k, v in got.items())
    assert len(got) >= 0.9 * len(true) > 100
    assert all(k in got for k, v in true.items() if v == 0 or len(items[k[1]]) < 10)


def test_terms_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    people = {f"name{k}x": f"p{k}@mail.example" for k in range(8)}
    texts = []
    for k in range(160):
        name = list(people)[rng.integers(0, 8)]
        texts.append(" ".join([*rng.choice([f"common{j}" for j in range(30)], 6), name if rng.random() < 0.7 else "someone", people[name] if rng.random() < 0.6 else "unknown", f"own{k}"]))
    texts += texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [set(re.findall(r"\w{2,}", re.sub(r"\S+@\S+", " ", t))) for t in texts]
    held = [set(re.findall(r"\S+@\S+", t)) for t in texts]
    want = set()
    for e in people.values():
        holders = [k for k, h in enumerate(held) if e in h]
        content = math.log2(len(texts) / len(holders))
        for w in set().union(*(words[k] for k in holders)):
            both = [k for k in holders if w in words[k]]
            told = math.log2(len(both) * len(texts) / (len(holders) * sum(w in x for x in words)))
            if len({texts[k] for k in both}) >= pii.SUPPORT and told >= pii.DISCLOSURE * content and len(both) >= 2**-pii.LEFT_BITS * sum(w in x for x in words):
                want.add((f"email:{e}", w))
    found = pii.disclosing_terms(pii._vocabulary(df).cache())
    assert {(r.entity, r.term) for r in found.collect()} == want and want
    for r in pii.find(df).collect():
        assert {t.value for t in r.term} == {w for _, w in want} & words[r.doc_id]


def _shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage's rows, from the rows that the stage before kept, by plain loops."""
    import base64

    import corpus_pipeline
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = decontam.normalised(pa.array([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])).to_pylist()
    stage = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.stored(stage["language"](spark, docs, sf), "t")
    before, rows = docs.collect(), {r.doc_id: r for r in kept.collect()}
    learn = [r for r in before if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sums = {}
    for r in learn:
        sums[r.lang] = sums.get(r.lang, 0) + _plain_vector(r.text, langid.DIMENSIONS)
    for r in before:
        vector = _plain_vector(r.text or "", langid.DIMENSIONS)
        best = max((v @ vector / np.linalg.norm(v) / np.linalg.norm(vector) for v in sums.values()), default=0) if vector.any() else -9
        bound = corpus_pipeline.LANGUAGE_SCORE - corpus_pipeline.LANGUAGE_NOISE / math.sqrt(max(1, len(r.text or "")))
        assert (r.doc_id in rows) == (max(best, 0) >= bound if vector.any() else False)

    sets = {i: _shingles(r.text) for i, r in rows.items()}
    label = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    kept = corpus_pipeline.stored(stage["near_duplicates"](spark, kept, sf), "t")
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if label[i] == i}

    after = corpus_pipeline.stored(stage["decontaminated"](spark, kept, sf), "t")
    flat = dict(zip([r.doc_id for r in kept.collect()], decontam.normalised(pa.array([r.text for r in kept.collect()])).to_pylist()))
    leaks = {i for i, t in flat.items() if any(decontam.edit_distance(b, t)[0] <= decontam.DISTANCE * len(b) for b in bench)}
    assert {r.doc_id for r in after.collect()} == set(flat) - leaks

    clean = corpus_pipeline.stored(stage["sanitised"](spark, after, sf), "t")
    marks = {r.doc_id: sorted((s.start, s.end) for k in pii.KINDS for s in r[k]) for r in pii.find(after).collect()}
    for r in clean.collect():
        whole = next(x.text for x in after.collect() if x.doc_id == r.doc_id) if marks[r.doc_id] else None
        assert r.n_chars == len(r.text)
        if whole:
            assert not any(whole[a:b] in r.text and "@" in whole[a:b] for a, b in marks[r.doc_id])

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in stage["tokens"](spark, clean, sf).collect():
        assert r.ids == e.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
