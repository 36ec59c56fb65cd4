"""Very long texts, repeated and conflicting labels, nulls, empty tables and clashing columns."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sondeo.llm import chat, lang_id, near_dedup, pu_quality, quality_rules, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def long_text(words: int, seed: int = 0) -> str:
    """A text of some megabytes of different words, with word borders around block ends."""
    return " ".join(f"w{(i * 7919 + seed) % 1_000_003}é" for i in range(words))


def test_statistics_of_texts_over_a_block(spark):
    t = long_text(250_000) + "\nA B C\nA B C\n" + "x" * 2_000_000
    r = quality_rules.statistics(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    w = t.split()
    three = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    assert len(t) > 3 << 20 and (r.n_words, r.word_chars, r.n_distinct, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(set(w)), 1, len(hit))


def test_language_of_long_texts_is_that_of_all_of_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs)
    one = docs.filter("lang = 'fr' and length(text) > 500").orderBy("doc_id").first().text
    rows = [(1, (one + "\n") * (3_000_000 // len(one)), None, None, "s"), (2, "一" * 1_200_000, None, None, "s"), (3, "1 " * 1_000_000, None, None, "s"), (3, "1 " * 1_000_000, None, None, "s")]
    got = {r.doc_id: r.lang_pred for r in lang_id.predict(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), model).collect()}
    assert got[1] == "fr" and got[3] == "und"


def test_quality_of_odd_labels_and_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("mine").alias("score"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = labels.unionByName(labels).unionByName(labels.filter("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema))
    model = pu_quality.fit(docs.select("doc_id", "text"), twice)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, long_text(150_000)), (None, "a b c"), (-4, "x" * 1_500_000)], "doc_id long, text string")
    got = pu_quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (-1, -2)}) == 1
    assert pu_quality.score(odd.limit(0), model).count() == 0


def test_chat_of_long_and_null_rows(spark):
    big = "</s>[INST] " * 200_000
    ddl = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", big), (1, 1, "assistant", big), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, None, None, None), (2, 3, "assistant", "x"), (2, 3, "assistant", "x")]
    out = {r.tree: r for r in chat.read_back(chat.format_chats(chat.linear_messages(spark.createDataFrame(rows, ddl)))).collect()}
    assert [t["text"] for t in out[1].turns] == [big, big] and list(out[1].loss_texts) == [big]
    assert [t["text"] for t in out[None].turns] == ["a", "b"] and len(out[2].turns) == 3 and list(out[2].loss_texts) == ["x", "x"]
    assert chat.format_chats(chat.linear_messages(spark.createDataFrame([], ddl))).count() == 0


def _cut(texts):
    """What op2's contract leaves of each text, by counting all strings of 200 bytes."""
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_contexts_of_one_digest_are_judged_by_their_bytes(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    texts = []
    for _ in range(600):  # two texts share a passage; with digests of one byte some of its edges clash
        same = word(260)
        texts += [word(220) + same + word(220) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: bytes(x.kept) for x in suffix_dedup.remove_repeats(rows, digest=1).collect()}
    assert [got[i] for i in range(len(texts))] == _cut([x.encode() for x in texts])


def test_a_class_of_different_bytes_is_not_whole():
    r = random.Random(12)
    a, b = (bytes(r.randrange(97, 123) for _ in range(230)) for _ in range(2))
    c = a[:210] + b[210:]
    held = [(1, 5, b"x", 0, 0, 0, a), (1, 5, b"x", 0, 1, 0, c), (2, 6, b"y", 0, 2, 0, b), (2, 6, b"y", 0, 3, 0, b)]
    names = ["deal", "name", "context", "file", "row", "first", "data"]
    got = pa.Table.from_batches(suffix_dedup._sort_contexts(200)([pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in held])])).to_pylist()
    assert sorted((x["row"], x["start"], x["end"], x["whole"]) for x in got) == [(0, 0, 210, False), (1, 0, 210, False), (2, 0, 230, False), (3, 0, 230, True)]


def test_many_copies_and_frequent_keys_are_met(spark):
    r = random.Random(13)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    notice = word(350)
    texts = [word(90) + notice + word(90) for _ in range(1500)]  # over the 1,000 rows from which keys are broadcast
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _cut([x.encode() for x in texts])
    for hot in (4000, 3):
        got = {x.doc_id: bytes(x.kept) for x in suffix_dedup.remove_repeats(rows, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_very_long_texts(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    near, far = ([w if r.random() > share else "x" + w for w in base] for share in (1 / 400, 1 / 10))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far), 1)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, near, far)]
    assert 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 85 * len(sets[0] | sets[2])
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(rows).collect())
    assert got == [(1, len(sets[0]), 1, True), (2, len(sets[1]), 1, False), (3, len(sets[2]), 3, True)]
