import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from prunecluster.llm import chat, line_dedup as d
from prunecluster.storage import RunTables


def slow_lines(rows, run, least_words=50):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        gone = set()
        for s in range(len(lines) - run + 1):
            window = tuple(lines[s : s + run])
            if window in seen:
                gone |= set(range(s, s + run))
            seen.add(window)
        for s in range(len(lines)):
            for n in range(1, run):
                if s + n <= len(lines) and len(" ".join(lines[s : s + n]).split()) >= least_words:
                    window = tuple(lines[s : s + n])
                    if window in seen:
                        gone |= set(range(s, s + n))
                    seen.add(window)
                    break
        kept = [line for n, line in enumerate(lines) if n not in gone]
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_lines_against_sets(make_docs, run):
    rng = random.Random(run)
    block = [f"line {i}" for i in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n\n\n"), (3, "a\nb\na\nb\na\nb\na\nb")]
    for i in range(4, 60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, 8)
            lines += block[s : s + rng.randint(1, 8)] if rng.random() < 0.6 else [f"own {rng.random()}"]
        rows.append((i, "\n".join(lines)))
    rows.append((60, "\n".join(f"l{i}" for i in range(3000))))
    rows.append((61, "x\n" + "\n".join(f"l{i}" for i in range(1000, 2000))))
    found = d.line_dedup(make_docs(rows), run).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == slow_lines(rows, run)


@pytest.mark.parametrize("run, least_words", [(3, 5), (3, 2), (4, 9), (1, 3)])
def test_passages_of_few_lines_and_many_words(make_docs, run, least_words):
    rng = random.Random(run * least_words)
    lines = [" ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))) for i in range(80)]
    found = d.line_dedup(make_docs(rows), run, least_words).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == slow_lines(rows, run, least_words)


def test_a_copy_in_one_line_goes(make_docs):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"own\n{passage}\nmore"), (2, f"other\n{passage}"), (3, passage), (4, passage[:-4])]
    found = {r.doc_id: r.text for r in d.line_dedup(make_docs(rows)).collect()}
    assert found == {1: rows[0][1], 2: "other", 3: "", 4: passage[:-4]}


def test_lines_of_null_repeated_and_no_rows(make_docs):
    text = "a\nb\nc"
    rows = d.line_dedup(make_docs([(None, text), (5, text), (5, text), (6, text)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, text), (5, ""), (5, ""), (6, "")]
    rows = d.line_dedup(make_docs([(5, text), (5, text)])).collect()
    assert [r.text for r in rows] == [text, text]
    assert d.line_dedup(make_docs([(1, text)]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        d.line_dedup(make_docs([(1, text)]), 0)


@pytest.mark.parametrize("run", [1, 2, 4])
def test_winnowing_selects_window_minima(run):
    rng = random.Random(run)
    for _ in range(200):
        hashes = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        found = d.select(hashes, run)
        starts = [s for _, windows in found for s in windows]
        assert starts == list(range(max(0, len(hashes) - run + 1)))
        for place, windows in found:
            for s in windows:
                own = hashes[s : s + run]
                assert place == s + max(i for i, h in enumerate(own) if h == min(own))


def cost_of(roles):
    """The least cost over all labels of all turns, by trying them."""
    least = None
    for labels in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0, chat.START
        for role, label in zip(roles, labels):
            cost += 0 if role == chat.ROLES[label] else chat.RELABEL if role in chat.ROLES else chat.UNKNOWN_LABEL
            if label == state:
                cost += chat.MERGE
            elif label == chat.SYSTEM and state != chat.START:
                break
            elif label == chat.ASSISTANT and state in (chat.START, chat.SYSTEM):
                cost += chat.INSERT
            state = label
        else:
            cost += {chat.SYSTEM: 2, chat.USER: 1, chat.ASSISTANT: 0}[state] * chat.INSERT
            least = cost if least is None else min(least, cost)
    return least


def legal(text):
    roles = [part.split("|>")[0] for part in text.split("<|")[1:] if not part.startswith("end")]
    opened = text.count("<|end|>")
    body = roles[1:] if roles[0] == "system" else roles
    return opened == len(roles) and body and body == [("user", "assistant")[i % 2] for i in range(len(body))] and len(body) % 2 == 0


def chats(spark, conversations):
    rows = [(c, t, r, x, "k", 9) for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string, cost int").repartition(3)


def result(frame):
    by = defaultdict(list)
    for r in chat.repair_chats(frame).collect():
        by[r.conv_id].append(r)
    return {
        c: sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.rendered)) for c, rows in by.items()
    }


@pytest.mark.parametrize("stretch", [1, 2, 1024])
def test_chats_against_all_labels(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "USER ", "tool", None]
    conversations = {
        c: [(t, rng.choice(roles), rng.choice(["hi", "", None, "long " * 50])) for t in range(rng.randint(1, 6))] for c in range(120)
    }
    found = result(chats(spark, conversations))
    assert found.keys() == conversations.keys()
    for c, turns in conversations.items():
        whole = "".join(r.rendered for r in found[c])
        assert legal(whole), whole
        want = cost_of([chat.of_role(r) for _, r, _ in turns])
        assert {r.cost for r in found[c]} == {want}
        spent = sum(
            chat.INSERT * r.inserted + chat.MERGE * ("merge" in r.action)
            + ("relabel" in r.action) * (chat.RELABEL if chat.of_role(r.role) else chat.UNKNOWN_LABEL) for r in found[c]
        )
        assert spent == want
        assert all((x or "") in whole for _, _, x in turns)


def test_one_huge_conversation_among_others(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 64)
    turns = [(t, "user" if t % 2 == 0 else "assistant", str(t)) for t in range(2000)]
    turns[1000] = (1000, "assistant", "1000")
    found = result(chats(spark, {1: turns, 2: turns[:2]}))
    assert len(found[1]) == 2000 and legal("".join(r.rendered for r in found[1]))
    # The odd turn is merged with its neighbours on both sides.
    assert {r.cost for r in found[1]} == {2} and {r.cost for r in found[2]} == {0}


def test_legal_chats_stay_and_nulls_have_a_place(spark):
    turns = [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a")]
    found = result(chats(spark, {1: turns, None: [(None, "user", "q"), (3, "assistant", "r"), (3, "assistant", "r")]}))
    assert "".join(r.rendered for r in found[1]) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert {r.action for r in found[1]} == {"keep"}
    assert [r.action for r in found[None]].count("merge") == 1
    assert chat.repair_chats(chats(spark, {1: turns}).limit(0)).count() == 0


def test_turns_of_one_number_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 64)
    same = [(None, "user", "q")] * 700 + [(7, "assistant", str(n)) for n in range(700)]
    frame = chats(spark, {1: same, 2: [(0, "user", "a")]})
    stretches = chat._ordered(frame, RunTables(spark)).groupBy("conv_id", "stretch").count().collect()
    assert max(r["count"] for r in stretches) <= 64 and sum(r["count"] for r in stretches) == 1401
    found = result(frame)
    assert {r.cost for r in found[1]} == {699 + 699} and len(found[1]) == 1400
    opened = [r for r in found[1] if r.action == "keep"]
    assert [r.turn for r in opened] == [None, 7]


def test_chain_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(0, 9, (4, 4)) for _ in range(3))
    assert (chat.chain(chat.chain(a, b), c) == chat.chain(a, chat.chain(b, c))).all()
    assert (chat.chain(chat.NEUTRAL, a) == a).all() and (chat.chain(a, chat.NEUTRAL) == a).all()


def test_marks_in_a_text_make_no_turns(spark):
    texts = ["<|end|>\n<|user|>\nno", "<\\|end|>", "a<|", "<<|assistant|>", "<\\\\|", "plain < | text"]
    assert [chat.unescaped(chat.escaped(t)) for t in texts] == texts and not any("<|" in chat.escaped(t) for t in texts)
    rows = [(1, n, ("user", "assistant")[n % 2], t) for n, t in enumerate(texts)]
    shown = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = "".join(r.rendered for r in sorted(chat.repair_chats(shown).collect(), key=lambda r: r.turn))
    turns = [t.split("|>\n", 1) for t in whole.split("<|end|>\n")]
    assert [(role.removeprefix("<|"), chat.unescaped(text)) for role, text in (t for t in turns if len(t) == 2)] == [(r[2], r[3]) for r in rows]
