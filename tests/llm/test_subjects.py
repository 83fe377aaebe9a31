import random

from inkloom.llm.subjects import assign_subjects, features, sentences, train

TOPICS = {"law": "judge verdict witness appeal clause court".split(), "sport": "goal referee match sprint coach league".split(), "法": "法官 判决 证人 合同 法庭".split()}
NAMES = "Ann Bob Cyd Dan Eve Fay Gus Hal".split()


def sentence(topic, r):
    if topic is None:
        return f"{r.choice(NAMES)} carried the lantern over the {r.choice(['bridge', 'garden', 'river'])}."
    w = r.choice(TOPICS[topic])
    return f"{r.choice(NAMES)}看见{w}，天色已晚。" if topic == "法" else f"{r.choice(NAMES)} saw the {w} near the river."


def document(topics, r, n=12):
    return " ".join(sentence(r.choice(topics) if r.random() < 0.7 else None, r) for _ in range(n))


def test_held_out_accuracy(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(480):
        topics = [r.choice(list(TOPICS))]
        docs.append((i, document(topics, r), "clash"))
        labels.append((i, topics[0]))
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, "   ", "x"), (1003, " ".join(sentence(None, r) for _ in range(12)), "x"), (None, "judge", "x"), (5, docs[5][1], "x"), (1004, "The judge saw the verdict. " * 3000, "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, labels string")
    lab = spark.createDataFrame([*labels[:400], (1, None), (None, "law"), (3, "unlisted"), (9999, "law")], "doc_id long, subject string")
    names = spark.createDataFrame([(t, "d") for t in TOPICS] + [(None, "d")], "subject string, description string")
    model = train(df, lab, names)
    out = [tuple(x) for x in assign_subjects(df, model).collect()]
    got = {}
    for i, s in out:
        got.setdefault(i, set()).add(s)
    assert len(out) == len(set(out)) and None not in got
    held = [got.get(i, set()) == {s} for i, s in labels[400:]]
    assert sum(held) / len(held) >= 0.95
    assert not any(k in got for k in (1000, 1001, 1002, 1003)) and got[1004] == {"law"}
    assert assign_subjects(df.limit(0), model).count() == 0
    assert assign_subjects(df, train(df, lab.limit(0), names)).count() == 0


def test_sentences_and_features():
    assert sentences('He left. “Where is it?” asked Ann; she ran. No. 47 again!') == ["He left.", "“Where is it?” asked Ann; she ran.", "No. 47 again!"]
    assert sentences("门开了。“谁？”他问道。\n雨停了！") == ["门开了。", "“谁？”他问道。", "雨停了！"]
    assert sentences(None) == [] == sentences("🙂 ..")
    b, o = features(["the court", "the court", "", "法庭里"])
    assert (b[o == 0] == b[o == 1]).all() and not (o == 2).any() and (o == 3).sum() == 3


def test_letters_after_a_long_rule_count():
    rule = "=" * 60 + " The judge spoke."
    assert sentences(rule) == [rule] and sentences("=" * 60 + " ab") == [] == sentences("1 2 3 " * 20)
