"""The training-data operators against brute force on small tables with nulls, ties and repeats."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe, components, decontam, jaccard, langid, lattice, licenses, pii, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, extra int"
TEXTS = [
    None, "", "   \n\t ", "a", "Hello, world! it's  fine\r\n\r\n  yes", "été ß \U0001f600 日本語  x 1.2,3 ..", "one two three four five six seven eight", "one two three four five six seven eight",
    "ONE two three\tfour five six seven eight", "<|endoftext|> \0 nul \x1c sep", "x" * 5000, " lead", "trail ", "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(TEXTS)] + [(6, TEXTS[6], None, None, None), (None, "no id here at all", "en", None, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_equals_library(docs, empty):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    made = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(made) == len(TEXTS) + 2
    for r in made:
        assert r.ids == e.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_random_strings():
    import random

    import tiktoken

    random.seed(1)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    texts = ["".join(random.choice("ab .,\n'st é9_ \t\0") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    replay = bpe.MergeReplay(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert replay.encode(pa.array(texts)).to_pylist() == [e.encode_ordinary(t) for t in texts]


def test_bpe_when_a_merge_makes_a_lower_rank():
    """Ranks in an order that training cannot give: still lowest first, leftmost first."""
    replay = bpe.MergeReplay.__new__(bpe.MergeReplay)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab"]
    replay.ranks, replay.tokens = {t: k for k, t in enumerate(tokens)}, tokens
    replay.byte_ids = list(range(256))
    replay.prepare()

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((replay.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [replay.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    words = ["".join(w).encode() for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    got = [np.frombuffer(b, np.uint32).tolist() for b in replay.replay(words)]
    assert got == [alone(w) for w in words]


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in token_files.round_trip(docs, P.path("byte_bpe_50k.json"), 2).collect():
        got.setdefault(r.doc_id, []).append(r)
    start = 0
    for key in sorted(got, key=lambda k: -(2**63) if k is None else k):
        for r in sorted(got[key], key=lambda r: r.start):
            text = "no id here at all" if key is None else TEXTS[key]
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert sum(map(len, got.values())) == len(TEXTS) + 2
    assert token_files.round_trip(empty, P.path("byte_bpe_50k.json"), 2).count() == 0


def test_token_files_find_damage(spark, docs, tmp_path):
    shards = token_files.write(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"), 2)
    path = shards.first().path[7:]
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_files.read(shards).collect()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_equal_plain_patterns(spark, empty):
    import random

    random.seed(2)
    texts = [None, "", "a@b.c%d@e.f x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 010-9999 é +44 20 7946 0958.", "9" * 30_000, "a" * 30_000 + "@"]
    texts += ["".join(random.choice("aZ@.%-+ ()0123456789é\U0001f600") for _ in range(random.randint(0, 80))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base for r in pii.find(df).select("doc_id", pii.listed(pii.KINDS[:4]).alias("base")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in _spans(t or "")), t
    assert pii.find(empty).count() == 0


def test_pii_disclosing_terms_and_redaction(spark):
    texts = [f"Zorbanek {a} from zed@mail.example {b} today" for a, b in zip(("wrote", "asked", "called", "phoned"), ("about", "again", "with", "after"))] + [f"plain today writes from colour {k}" for k in range(10)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.redact(pii.find(df)).collect()}
    assert [t.value for t in rows[0].term] == ["Zorbanek"]
    assert "[EMAIL]" in rows[0].text and "Zorbanek" not in rows[0].text and "[TERM]" in rows[0].text
    assert rows[5].text == texts[5] and rows[99].text is None


def test_pii_terms_over_whole_texts_and_in_every_document(spark):
    """Far from the entity, short, with digits, in Han, and in a document without the entity."""
    far = " ".join(f"filler{k}" for k in range(60))
    texts = [f"Bo {k}a1 K7x9 \u674e\u660e\u5230\u4e86{'\u7532\u4e59\u4e19\u4e01'[k]} {far} from zed@mail.example" for k in range(4)]
    texts += ["yesterday Bo and k7X9 left, \u4e0e\u674e\u660e\u540c"] + [f"{far} number {k}" for k in range(20)]
    df = spark.createDataFrame([*enumerate(texts), (None, "Bo again")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.redact(pii.find(df)).collect()}
    assert {"Bo", "K7x9"} <= {t.value for t in rows[0].term}
    assert {"Bo", "k7X9", "\u674e\u660e"} <= {t.value for t in rows[4].term}
    assert [t.value for t in rows[None].term] == ["Bo"]
    assert all(rows[k].text == texts[k] for k in range(5, 25))


def test_licenses(spark, empty):
    df = spark.createDataFrame([(1, "Copyright 2020 X\nLICENSED under the MIT licence!!"), (2, "x\nAll rights reserved.\nReleased under the MIT License."), (3, None), (4, "no licence")], "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.licenses) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "LicenseRef-All-Rights-Reserved,MIT"), 3: (None, ""), 4: (None, "")}
    assert licenses.scan(empty).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""  # wrapped


def test_licenses_full_texts_and_runs_over_lines(spark):
    texts = [MIT, f"MIT License\n\nCopyright (c) 2020 X\n\n{MIT}\n", f"Some code.\n\n{MIT}\n\nMore text.", "This work is licensed under\nthe MIT License.", "Note: released under the MIT License. Enjoy.", "Released under the MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.licenses) for r in licenses.scan(df).collect()}
    assert got == {0: ("MIT", "MIT"), 1: ("MIT", "MIT"), 2: (None, "MIT"), 3: ("MIT", "MIT"), 4: (None, "MIT"), 5: (None, "")}
    own = licenses.known(spark).where("license = 'ISC'")
    assert licenses.scan(df, digests=own).where("licenses <> ''").count() == 0


def test_warc(spark, tmp_path):
    big, small = "<p>" + "x" * 1200, "<p>small"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "é" * 600), (None, "u", big), (2, "v", big), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.round_trip(pages).drop("payload", "url").collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    by = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got]
    assert by == [(1, "revisit", 2, 1203), (2, "response", None, 1203), (2, "response", None, 1203), (3, "response", None, 8), (4, "response", None, 8), (5, "response", None, 0), (6, "response", None, 1200), (7, "response", None, 0), (None, "revisit", 2, 1203)]
    assert got[0].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    index = warc.write(pages, f"file://{tmp_path}/warc")
    assert warc.read(index.where("page_id = 6")).first().payload.decode() == "é" * 600
    assert warc.round_trip(pages.where("false")).count() == 0


def test_lattice_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base, base + 0.08 * rng.normal(size=base.shape), base[:5], 3 * base[:2]])
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(near)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in lattice.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    v = np.array([r[1] for r in rows[: len(near)]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T >= 0.95
    assert [got[k].n_links for k in range(len(v))] == (close.sum(axis=1) - 1).tolist()
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.array([label[close[k]].min() for k in range(len(v))])
    assert [got[k].component_id for k in range(len(v))] == label.tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(900, 906))
    assert lattice.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_recall_at_the_bound():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    e = rng.normal(size=v.shape)
    e -= (e * v).sum(axis=1)[:, None] * v
    e /= np.linalg.norm(e, axis=1)[:, None]
    a, b = lattice.cells(v).reshape(3000, -1), lattice.cells(0.95 * v + np.sqrt(1 - 0.95**2) * e).reshape(3000, -1)
    assert np.mean([np.isin(x, y).any() for x, y in zip(a, b)]) > 0.98


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 9), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    assert components.components(edges.where("false")).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_jaccard_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        own = [words[k] for k in rng.integers(0, 400, rng.integers(3, 120))]
        for _ in range(rng.integers(1, 7)):
            copy = list(own)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = words[rng.integers(0, 400)]
            texts.append(" ".join(copy))
    texts += ["shared line of some boilerplate words here " + t for t in texts[:20]] + [None, "", " ", "A b", "a B", "a  b\n"]
    sets = [_shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k].component_id for k in range(len(texts))] == label
    assert jaccard.join(docs).count() == len(TEXTS) + 2 and jaccard.join(empty).count() == 0


@pytest.mark.parametrize("deal_rows", [2, 3])
def test_jaccard_with_dealt_tokens_equals_brute_force(spark, monkeypatch, deal_rows):
    """Sets that are mostly one frequent passage, some of them with salted tokens and some without, still meet at their rare ones."""
    monkeypatch.setattr(jaccard, "DEAL_ROWS", deal_rows)
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join(passage + [f"own{g}x{k}" for k in range(24)] + [f"n{g}y{c}z{k}" for k in range(c)]) for g in range(12) for c in range(3)]
    texts += [" ".join(passage[: rng.integers(60, 100)]) for _ in range(6)]
    sets = [_shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k in range(len(texts))] == label

    batch = pa.RecordBatch.from_pydict({"text": texts})
    hashes = jaccard.shingle_sets(pa.array(texts))
    tokens, seen = np.unique(np.concatenate(hashes), return_counts=True)
    rows = pa.Table.from_batches(jaccard._prefixes([batch], jaccard._Order(tokens[seen >= jaccard.REPORT], seen[seen >= jaccard.REPORT]), deal_rows)).sort_by([("dealt", "ascending"), ("sig", "ascending")])
    made = set(zip(rows["token"].to_pylist(), rows["sig"].to_pylist()))
    kept = {(t, g) for b in jaccard._repeated(rows.combine_chunks().to_batches()) for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    holders = {}
    for t, g in made:
        holders.setdefault(t, set()).add(g)
    assert {(t, g) for t, g in made if len(holders[t]) > 1} <= kept


def test_tree_join_prunes_nothing_that_links():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = np.sort(rng.choice(1000, 60, replace=False)).astype(np.uint64)
        make = lambda: np.sort(rng.choice(pool, rng.integers(40, 55), replace=False))
        query, rows = make(), [(k, make()) for k in range(20)]
        got = jaccard._tree_join(query, [(k, [(0, int(x)) for x in s], s) for k, s in rows])
        assert sorted(got) == [k for k, s in rows if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]


def test_decontamination(spark, empty):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = ["".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(800)]
    item = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 800, n))
    items = [item(35) for _ in range(20)]
    clean = [item(200) for _ in range(30)]
    leaks = []
    for k, t in enumerate(items):
        words = t.split()
        words[rng.integers(0, 35)] = "qqqq"
        leaks.append(clean[k] + " " + " ".join(words).upper() + "! " + clean[k + 1])
    docs = spark.createDataFrame([*enumerate(leaks + clean), (100, None), (101, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.found] for r in decontam.find(docs, bench).collect()}
    assert sum(got[k] == [k] for k in range(20)) >= 19
    assert all(not got[k] for k in [*range(20, 50), 100, 101])
    assert decontam.find(docs, bench.where("false")).where("size(found) > 0").count() == 0 and decontam.find(empty, bench).count() == 0


def _edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k, kind = rng.integers(0, len(chars)), rng.integers(0, 3)
        chars[k : k + (kind != 1)] = [] if kind == 2 else ["abcdefghijklmnopqrstuvwxyz "[rng.integers(0, 27)]]
    return "".join(chars)


def test_decontamination_recall_at_its_own_distance():
    """Passages with as many random edits as DISTANCE admits, of mixed kinds, are found."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(800)]
    items = [" ".join(vocabulary[k] for k in rng.integers(0, 800, n)) for n in rng.integers(15, 60, 60)]
    texts = [_edited(rng, t, int(decontam.DISTANCE * len(t))) for t in items]
    index = decontam.Index(tuple(range(60)), tuple(items))
    got = index.found(decontam.normalised(pa.array(texts)))
    want = [decontam.edit_distance(t, decontam.normalised(pa.array([x]))[0].as_py())[0] <= decontam.DISTANCE * len(t) for t, x in zip(items, texts)]
    assert sum(w and k in g for k, (w, g) in enumerate(zip(want, got))) >= 0.9 * sum(want) > 50


def test_decontamination_finds_passages_without_one_exact_long_word():
    rng = np.random.default_rng(13)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(8, 12))) for _ in range(800)]
    items = [" ".join(vocabulary[k] for k in rng.integers(0, 800, 20)) for _ in range(20)]
    texts = [" ".join(w[:3] + "ü" + w[4:] for w in t.split(" ")) for t in items]
    got = decontam.Index(tuple(range(20)), tuple(items)).found(pa.array(texts))
    assert sum(k in g for k, g in enumerate(got)) >= 19


def test_edit_distance():
    assert decontam.edit_distance("kitten", "xx sitting xx")[0] == 2
    assert decontam.edit_distance("abc", "abc") == (0, 3) and decontam.edit_distance("abc", "")[0] == 3


def test_language(spark, docs, empty):
    rows = [(k, "the cat and the dog with that thing " * 3 + str(k), "en") for k in range(20)] + [(k, "der hund und die katze nicht auch " * 3 + str(k), "de") for k in range(20, 40)]
    prototypes = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(prototypes) == ["de", "en"]
    got = [r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "und die nicht"), (2, "the thing and"), (3, "123 ..."), (4, None)], "doc_id long, text string"), prototypes).collect()]
    assert got == ["de", "en", "und", "und"]
    scored = langid.predict(docs, prototypes)
    assert scored.count() == len(TEXTS) + 2 and scored.where("score < 0 or score > 1").count() == 0
    assert langid.train(empty) == {} and langid.predict(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(8)
    words = [f"calm{k}" for k in range(200)]
    rows = [(k, " ".join(rng.choice(words, 60)) + (" you wretch indeed" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 240"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id >= 240"), model).toPandas()
    assert ((got.score >= 0.3) == (got.toxic == 1)).mean() > 0.95
    assert toxicity.score(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.train(df, df.select("doc_id", "toxic").where("false"))
    assert toxicity.score(empty, none).count() == 0 and len(none[0]) == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (None, "this is a text without an identifier at all", "en", "s", 43)], docs.schema)
    current = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, current, sf), f"test-{name}")
        if name != "tokens":
            assert after.columns == docs.columns
        assert 0 < after.count() <= current.count()
        current = after
    assert current.where(F.col("doc_id") >= 10_001).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), sf).count() == 0
