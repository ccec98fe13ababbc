"""Shards of near copies: what is dealt out for a text doesn't grow with the number of texts."""

import random

from granary.llm import simhash


def written(spark):
    """Records that stages have written to shuffles so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_dozen_keys_a_text(spark):
    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(30))) for i in range(2000)]
    before = written(spark)
    assert simhash.similar(spark.createDataFrame(texts, "doc_id long, text string")).where("doc_id <> component_id").count() == 0
    assert written(spark) - before < 60 * len(texts)  # two shuffles of sixty bands and more, by bits


def test_keys_are_shared_as_often_as_sets_are_alike():
    r = random.Random(7)
    keys, met = simhash.MinKeys(1), 0
    assert keys.of(simhash.shingle_hashes(b"", 5)) == keys.of(simhash.shingle_hashes(b" ", 5))
    for _ in range(1000):
        words = [f"w{r.randrange(10**6)}".encode() for _ in range(120)]
        both = [simhash.np.unique(simhash.shingle_hashes(b" ".join(words[a : a + 108]), 1)) for a in (0, 12)]  # 96 of 120 are shared
        met += keys.of(both[0]) == keys.of(both[1])
    assert 0.35 < met / 1000 < 0.47  # 0.8 ** 4 is 0.41
