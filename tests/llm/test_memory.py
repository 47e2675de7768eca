"""What operators leave in the memory of executors and workers, and how much they take at once."""

import re

import public_tokenizers as P
import pytest

import corpus_pipeline
from fathom.llm import arrow, bpe


def _collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(bean.getCollectionCount() for bean in beans if "Concurrent" not in bean.getName())


def test_settling_collects_on_executors(spark, monkeypatch):
    monkeypatch.setattr(arrow, "release", lambda _: None)
    before = _collections(spark)
    arrow.settle(spark)
    assert _collections(spark) > before


def test_settling_frees_the_tables_of_a_worker(monkeypatch):
    monkeypatch.setattr(arrow, "_held", ["an operator", "its tables"])
    assert arrow.resource((), tuple) == () and arrow._held == [(), ()]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_settles_first(spark, sf, monkeypatch, name, stage):
    class Settled(Exception):
        pass

    def settle(_):
        raise Settled

    monkeypatch.setattr(corpus_pipeline, "settle", settle)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    with pytest.raises(Settled):
        stage(spark, docs, sf)


def _plans(spark, work):
    """Physical plans of all that ``work()`` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    known = store.executionsList()
    last = max((known.apply(i).executionId() for i in range(known.size())), default=-1)
    work()
    bus.waitUntilEmpty()
    made = store.executionsList()
    return [made.apply(i).physicalPlanDescription() for i in range(made.size()) if made.apply(i).executionId() > last]


def _python(plans):
    return [p for p in plans if re.search("Python|Pandas|Arrow", p)]


def test_sanitising_runs_no_python_on_executors(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plans = _plans(spark, lambda: corpus_pipeline.sanitised(spark, docs, sf).write.format("noop").mode("overwrite").save())
    assert len(plans) > 5 and not _python(plans)


def test_unloading_reaches_the_workers_and_settling_does_not(spark):
    assert _python(_plans(spark, lambda: arrow.unload(spark)))
    settled = _plans(spark, lambda: arrow.settle(spark))
    assert settled and not _python(settled)


def test_a_replay_takes_a_bounded_block_of_words(monkeypatch):
    replay = bpe.MergeReplay(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(30_000)) + " " + "z" * 100_000 + " end"
    plain = replay.replay
    taken = []

    def counted(words):
        taken.append([len(words), sum(map(len, words))])
        return plain(words)

    monkeypatch.setattr(replay, "replay", counted)
    made = replay.encode(arrow.pa.array([text]))
    assert sum(n for n, _ in taken) > 30_000
    assert all(n == 1 or size <= bpe.REPLAY_BYTES for n, size in taken)
    assert replay.decode(made).to_pylist() == [text.encode()]


def test_blocks_hold_every_word_in_order():
    words = [b"a", b"", b"b" * (bpe.REPLAY_BYTES + 1), b"c", b"d" * bpe.REPLAY_BYTES, b"e"]
    assert [len(b) for b in bpe.blocks(words)] == [2, 1, 1, 1, 1]
    assert [w for b in bpe.blocks(words) for w in b] == words
    assert list(bpe.blocks([])) == []
