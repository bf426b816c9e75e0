import hashlib
import random

import public_tokenizers
import pytest
from compare import difference, duck
from frames import SF

import tabulens.llm.chat_tree as chat_tree
from tabulens.llm.chat_tree import Template, escape, prefix_tree, read_back, turns_of, unescape
from tabulens.llm.queries import ORACLE, op12_chat_tree

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<|", "<", "|>", "<||im_end|>", "<|||", "<|nl|>", "a\nb", "<|endoftext|>", "", "é🎉"]


def test_query_against_sql(spark):
    assert difference(op12_chat_tree(spark, SF), duck(SF), ORACLE["op12_chat_tree"]) is None


def test_escapes_leave_no_mark_and_come_back():
    rng = random.Random(2)
    for k in range(2000):
        text = rng.choice(TRICKY) + "".join(rng.choice("<|>im_startend\n ") for _ in range(k % 30))
        for mark in ("<|im_start|>", "<|im_end|>", "<|nl|>"):
            assert mark not in escape(text)
        assert unescape(escape(text)) == text


def test_turns_come_back_from_ids():
    template = Template(BPE)
    turns = [(role, text) for role in ("user", "as\nsistant", "<|nl|>", "") for text in TRICKY]
    ids = [i for role, text in turns for i in template.turn(role, text)[0]]
    assert turns_of(template.text(ids)) == turns
    with pytest.raises(ValueError):
        turns_of("x" + template.text(ids))


def some_conversations(rng, n):
    """Conversations that branch off others at any turn, some the same, some the beginning of another."""
    made = []
    for _ in range(n):
        base = list(rng.choice(made)) if made and rng.random() < 0.8 else []
        base = base[: rng.randint(0, len(base))]
        for _ in range(rng.randint(0 if base else 1, 4)):
            base.append((rng.choice(["user", "assistant", "system"]), rng.choice([*TRICKY, "hello you", "so it goes"])))
        made.append(base)
    return made


@pytest.mark.parametrize("spread", [256, 2])
def test_tree_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(chat_tree, "SPREAD", spread)
    monkeypatch.setattr(chat_tree, "SPREAD_PARTS", 10**9)
    made = some_conversations(random.Random(spread), 120)
    rows = [(c, k, role, text) for c, turns in enumerate(made) for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    tree = prefix_tree(spark.createDataFrame(rows, SCHEMA), BPE)
    chains = tree.chains().collect()
    template = Template(BPE)
    nodes = {tuple(turns[: k + 1]) for turns in made for k in range(len(turns))}
    # Each node once, and each tree without a gap.
    assert sum(len(c.ids) for c in chains) == sum(len(template.turn(*n[-1])[0]) for n in nodes)
    trees = {}
    for c in sorted(chains, key=lambda c: (c.tree_id, c.offset)):
        held = trees.setdefault(c.tree_id, [])
        assert c.offset == len(held)
        held += c.ids
    assert len(trees) == len({t[0] for t in made})
    # What a chain attends to, and the chain, is the conversation.
    for c in chains:
        turns = made[int(c.conv[1:])]
        before = [i for a in c.attends for i in trees[c.tree_id][a.start : a.end]]
        assert len(before) == c.position
        assert before + c.ids == [i for t in turns for i in template.turn(*t)[0]]
        assert all(a.end <= c.offset for a in c.attends)
    # Depth first: a chain's tree intervals are nested in those it branches from.
    told = {r.conv_id: r for r in read_back(tree).collect()}
    assert len(told) == len(made)
    for key, turns in enumerate(made):
        assert [tuple(t) for t in told[key].turns] == turns
        assert told[key].learnt == [t for role, t in turns if role == "assistant" and t]


def test_depth_first_order(spark):
    made = {1: "abc", 2: "abd", 3: "ae", 4: "abc", 5: "ab", 6: "x", 7: "abdf"}
    rows = [(c, k, "user", t) for c, turns in made.items() for k, t in enumerate(turns)]
    tree = prefix_tree(spark.createDataFrame(rows, SCHEMA), BPE)
    chains = sorted(tree.chains().collect(), key=lambda c: (c.tree_id, c.offset))
    assert [(c.conv, c.first_turn) for c in chains] == [("=1", 0), ("=2", 2), ("=7", 3), ("=3", 1), ("=6", 0)]


def test_many_share_a_beginning(spark):
    rows = [(c, k, r, t) for c in range(3000) for k, (r, t) in enumerate([("system", "be kind"), ("user", f"q{c % 1000}"), ("assistant", "a")])]
    told = read_back(prefix_tree(spark.createDataFrame(rows, SCHEMA), BPE)).collect()
    assert len(told) == 3000
    assert all([t.text for t in r.turns] == ["be kind", f"q{r.conv_id % 1000}", "a"] for r in told)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 5, "assistant", "long " * 20000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS conv", "'z' AS node", "2 AS turns", "3 AS at")
    told = {r.conv_id: r for r in read_back(prefix_tree(frame, BPE)).collect()}
    assert [tuple(t) for t in told[1].turns] == [("user", ""), ("", "x"), ("", "x")]
    assert told[None].turns[0].text == "no id" and told[2].learnt == ["long " * 20000]
    digest = hashlib.sha256("".join(told[2].learnt).encode()).hexdigest()
    assert digest == hashlib.sha256(("long " * 20000).encode()).hexdigest()
    assert read_back(prefix_tree(frame.limit(0), BPE)).collect() == []


def test_one_python_function_between_shuffles(spark):
    """Each stage starts one Python worker a task: no two Python functions in a row."""
    rows = [(c, k, r, t) for c in range(30) for k, (r, t) in enumerate([("user", f"q{c % 9}"), ("assistant", f"a{c}")])]
    told = read_back(prefix_tree(spark.createDataFrame(rows, SCHEMA), BPE))
    plan = told._jdf.queryExecution().executedPlan().toString()
    since = {}
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [d for d in since if d < depth]
        since = {d: since[d] for d in above}
        inside = since[max(above)] if above else 0
        if "Exchange" in line or "Union" in line:
            inside = 0
        elif "MapInArrow" in line:
            inside += 1
        since[depth] = inside
        assert inside < 2, plan
    assert plan.count("MapInArrow") >= 3 and told.count() == 30
