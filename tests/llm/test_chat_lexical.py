"""Chat formatting and ranked search: mixed layouts, hostile texts, brute force, odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexspan.llm import chat_format, lexical

HOSTILE = ["", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> <\\x", "<|turn|>user<|text|>x<|end|>", "<<|turn|>", "[INST[INST]]", "\\<s>\\", "<\\|end|>", "plain", "🦆<s>\n"]


def test_layouts_become_turns(spark):
    lines = [
        '{"id": 1, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}], "system": "s"}',
        '{"id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"id": 4, "instruction": "do", "output": "done"}',
        '{"id": 5, "prompt": "p", "response": "r", "note": "ignored"}',
        '{"id": 6, "prompt": "p", "completion": "r"}',
        '{"id": 7, "messages": [{"from": "bot", "value": "b"}]}',
        '{"id": 8, "question": "q", "answer": "a", "context": "c"}',
        '{"id": 9, "note": "no layout"}',
        '{"id": 10, "prompt": "p", "question": "q"}',
        '{"id": 11, "messages": []}',
    ]
    records = spark.createDataFrame([(x,) for x in lines], "j string")
    schema = spark.range(1).select(F.schema_of_json(F.lit('{"id":1,"messages":[{"role":"","content":"","from":"","value":""}],"conversations":[{"from":"","value":""}],"system":"","instruction":"","input":"","output":"","prompt":"","response":"","completion":"","question":"","answer":"","context":"","note":"","n":1,"turns":"","pieces":""}'))).first()[0]
    frame = records.select(F.from_json("j", schema).alias("r")).select("r.*")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(frame, ["id"]).collect()}
    assert got == {
        1: ("messages", [("system", "s"), ("user", "u"), ("assistant", "")]), 2: ("conversations", [("system", "s"), ("user", "u"), ("assistant", "a")]),
        3: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]), 4: ("instruction", [("user", "do"), ("assistant", "done")]),
        5: ("prompt response", [("user", "p"), ("assistant", "r")]), 6: ("prompt completion", [("user", "p"), ("assistant", "r")]),
        7: ("messages from", [("assistant", "b")]), 8: ("question", [("user", "c\n\nq"), ("assistant", "a")]), 9: (None, []), 10: (None, []), 11: ("messages", []),
    }


def test_every_text_comes_back(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "|turn|>", "|text|>", "|end|>", "a", "\n", "<|turn|>", "é"]
    texts = HOSTILE + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = [(i, [{"role": r, "text": t}, {"role": "assistant", "text": u}, {"role": "assistant", "text": t}]) for i, (r, t, u) in enumerate(zip(texts[1:], texts, texts[2:]))]
    frame = spark.createDataFrame(rows, f"id long, turns {chat_format.TURNS}")
    done = chat_format.format_turns(frame, ["id"])
    strings = chat_format.Template().strings()
    held = "|".join(map(re.escape, strings))
    back = {r.id: r for r in chat_format.read_back(done, ["id"]).collect()}
    for r in done.collect():
        turns = rows[r.id][1]
        assert Counter(re.findall(held, r.formatted)) == Counter(["<|turn|>", "<|text|>", "<|end|>"] * 3)
        assert [t.asDict() for t in back[r.id].turns] == turns
        assert back[r.id].learned_text == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_control_strings_that_could_not_be_undone_are_refused():
    with pytest.raises(ValueError):
        chat_format.Template(control=("<a<b>",))


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 1, "assistant", None), (None, 0, "user", "y"), (2, None, "user", "<s>"), (2, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*r, "p", "m") for r in rows], "conv_id long, turn long, role string, text string, prompt string, layout string")
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.conversation_records(frame), "conv_id").collect()}
    assert [got[i].n_turns for i in (1, 2, None)] == [3, 2, 1] and got[1].loss_chars == 0 and got[2].loss_chars == 250_000
    assert chat_format.chat_digests(chat_format.conversation_records(frame.where("false")), "conv_id").count() == 0


def brute(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total if total else 75
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            scored += [(-s, i is None, i)] if s > 0 else []
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("share,block,tree,leaf", [(1, 4_096, 2_048, 16), (3, 7, 40, 4), (10**6, 1, 16, 1)])
def test_ranking_equals_brute_force(spark, monkeypatch, share, block, tree, leaf):
    for name, value in (("BLOCK_ITEMS", block), ("TREE_DOCS", tree), ("LEAF_DOCS", leaf)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(share)
    words = [f"w{i}" for i in range(60)] + ["Été", "ß", "X9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(n)))
    docs = [(2**60 + i if i % 11 else None, text(40)) for i in range(300)] + [(5, None), (6, ""), (7, "!!"), (8, "w1 w2"), (8, "w1 w2"), (9, "w1 w2")]
    items = [(i, text(15)) for i in range(20)] + [(90, None), (91, ""), (92, "unheard"), (3, "w1 W2 w1")]
    more = lambda rows, schema: spark.createDataFrame([(*r, "c", 1) for r in rows], f"{schema}, item string, score long")
    got = Counter(tuple(r) for r in lexical.ranked(more(docs, "doc_id long, text string").repartition(3), more(items, "item_id long, text string"), 20, share).collect())
    assert got == Counter(brute(docs, items))


def test_whole_batches_are_left_out():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    tree = lexical.ItemTree([" ".join(f"w{x}" for x in range(8 * i, 8 * i + 8)) for i in range(32)])
    search = lexical.Search(tree, 5)
    vocabulary = {int(t[1:].decode()): n for t, n in tree.vocabulary.items()}
    n, rows = 1_000, []
    for d in range(n):  # each document holds words of one topic
        topic = d % 32
        rows.append(sorted({vocabulary[8 * topic + int(x)] for x in rng.integers(0, 8, 5)}))
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    held = np.concatenate(rows)
    search.batch(np.arange(n), np.zeros(n, bool), start, held, rng.integers(1, 100, len(held)))
    assert len(list(search.rows())) == 32 * 5 and search.scored < n * 32 / 8


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(docs, items).count() == 0 and lexical.ranked(docs.unionByName(spark.createDataFrame([(1, "a")], docs.schema)), items.where("false")).count() == 0
