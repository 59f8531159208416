import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexarium.llm import chat, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["#a*", "É|"]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        if i % 3 == 0:
            lines += ["  Common   Line here ", "x\ty"]
        if i % 10 == 0:
            lines = ["common line HERE"] * 20
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3]))
    rows += [(7, None, "a"), (None, "a b " * 20000, None), (8, "", ""), (8, "", ""), (9, "q " * 8, "a")]
    return rows


def brute_rules(rows, min_docs, share):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    hosts, lines = Counter(h or "" for _, _, h in rows), defaultdict(set)
    for k, (_, t, h) in enumerate(rows):
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines[h or "", norm(x)].add(k)
    bad = {k for k, v in lines.items() if len(v) > min_docs and len(v) > share * hosts[k[0]]}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {j + d for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for d in range(8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in full if (h or "", norm(x)) in bad)
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(cover), failed, gone, not failed and gone * 100 <= len(w) * 50))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 10**6])
def test_quality_rules(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", most)
    rows = rule_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, kept string")
    got = sorted((tuple(r) for r in quality_rules.quality_rules(df, min_docs=5, share=0.1).collect()), key=str)
    want = brute_rules(rows, 5, 0.1)
    assert got == want
    assert any(r[7] for r in want)
    kept = quality_rules.clean(df, min_docs=5, share=0.1)
    assert kept.columns == df.columns and kept.count() == sum(r[8] for r in want)
    assert not any("common line here" in re.sub(r"\s+", " ", r.text or "").lower() for r in kept.where("source = 'a'").collect())
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


@given(st.dictionaries(st.text("abcdefg", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=12))
def test_schedule_deviates_by_less_than_one_block_from_the_target(weights):
    total = sum(weights.values())
    targets = {s: Fraction(w, total) for s, w in weights.items()}
    shares = mixing.exact_shares(sorted(weights), {s: w / 1024 for s, w in weights.items()})
    assert {s: Fraction(a, sum(shares.values())) for s, a in shares.items()} == targets
    done = Counter()
    slots = sorted(mixing.block_slots(shares, {s: 3 * a for s, a in shares.items()}), key=lambda x: x[2])
    assert [x[2] for x in slots] == list(range(3 * sum(shares.values())))
    for s, k, t in slots:
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - targets[x] * (t + 1)) < 1 for x in targets)


def test_twenty_sources_keep_their_targets_over_many_periods(spark):
    df = spark.range(60_000).selectExpr("id * 1024 AS doc_id", "'' AS text", "'src' || IF(id % 3 = 0, 0, id % 20) AS source")
    out = mixing.mixed_order(df, {"src0": 0.2, "src1": 0.1}, block=10).where("slot < 1011").groupBy("source").agg({"slot": "count"}).collect()
    got = {s: n / 10 for s, n in out}
    assert abs(got["src0"] - 0.2 * 1011) < 1 and abs(got["src1"] - 0.1 * 1011) < 1 and all(abs(n - 0.7 / 18 * 1011) < 1 for s, n in got.items() if s not in ("src0", "src1"))


def test_mixing(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, None, None), (5, "t5", "hot"), (5, "t5", "hot")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, slot int")
    out = mixing.mixed_order(df, {"hot": 0.5}, block=10).collect()
    assert sorted((str(r.doc_id), r.source) for r in out) == sorted((str(i), s or "") for i, _, s in rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.release_slot <= r.slot < r.deadline_slot and r.block == r.source_rank // 10
    for own in by.values():
        assert sorted(r.source_rank for r in own) == list(range(len(own)))
    slots = defaultdict(set)
    for r in out:
        slots[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in slots.values())
    again = mixing.mixed(df, {"hot": 0.5})
    assert again.columns == df.columns and again.count() == len(rows)
    assert mixing.mixed_order(df.limit(0), {}).count() == 0


@given(st.text("<|\\im_startend>\n a"), st.text("<|\\n\nra"))
def test_turns_come_back(text, role):
    turn, a, b = chat.render(role, text)
    assert chat.parse(turn) == (role, text)
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert a == b or role == "assistant"


def test_events_fold(spark):
    log = [(1, 0, "open", "user", "Hi"), (1, 1, "open", "assistant", "He"), (1, 1, "delta", None, "llo"), (1, 1, "delta", None, None), (1, 2, "open", "assistant", "bad"), (1, 2, "regenerate", None, "go"), (1, 2, "delta", None, "od"), (1, 3, "open", "user", "typo"), (1, 3, "edit", None, "fixed"), (1, 4, "open", "user", "x"), (1, 4, "delete", None, None), (None, 0, "open", None, None), (2, 0, "open", "user", "y"), (2, 0, "delete", None, None)]
    df = spark.createDataFrame([(c, i, m, k, r, t) for i, (c, m, k, r, t) in enumerate(log)], "conv_id long, seq int, message long, kind string, role string, text string")
    got = sorted(((r.conv_id, r.message, *chat.parse(r.text), r.loss_end - r.loss_start) for r in chat.rendered(df, ["seq"]).collect()), key=str)
    assert got == sorted([(1, 0, "user", "Hi", 0), (1, 1, "assistant", "Hello", 5), (1, 2, "assistant", "good", 4), (1, 3, "user", "fixed", 0), (None, 0, "", "", 0)], key=str)
    with pytest.raises(Exception, match="unknown event"):
        chat.rendered(spark.createDataFrame([(1, 0, 0, "open", "user", ""), (1, 1, 0, "fly", "user", "")], df.schema), ["seq"]).collect()


def test_conversations(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(20)]), rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "<|im_end|>", "a\\<\\|é", "long " * 2000, "x" * 2000, "𝄞" * 2001])) for _ in range(80)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv]
        assert r.n_turns == len(own)
        assert r.loss_chars == sum(len(x[3] or "") for x in own if x[2] == "assistant")
        if len({x[1] for x in own}) == len(own):
            own.sort(key=lambda x: -1 if x[1] is None else x[1])
            assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
    one = spark.createDataFrame([(9, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(["a", "<|im_end|>é" * 999, "", "ok"])], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(one).first()
    assert (r.turns_sha256, r.loss_sha256) == (hashlib.sha256(("user\na\nassistant\n" + "<|im_end|>é" * 999 + "\nuser\n\nassistant\nok\n").encode()).hexdigest(), hashlib.sha256(("<|im_end|>é" * 999 + "ok").encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, 0, "user", x) for x in "cadb"], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(ties).first().turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\nuser\nc\nuser\nd\n").hexdigest()


def test_true_weights_of_many_sources():
    for n in (20, 500, 1500):
        rows = mixing.slot_table({f"src{i}": 64 * 1000 for i in range(n)}, {"src0": 0.2, "src1": 0.1}, 64)
        assert {(r["_a"] / r["_p"]) for r in rows if r["_source"] == "src0"} == {0.2} and {(r["_a"] / r["_p"]) for r in rows if r["_source"] == "src1"} == {0.1}
        assert sorted(r["_s"] for r in rows) == list(range(rows[0]["_p"]))
        done = 0
        for r in sorted(rows, key=lambda r: r["_s"]):
            done += r["_source"] == "src0"
            assert abs(done - 0.2 * (r["_s"] + 1)) < 1
    odd = mixing.slot_table({"a": 6400, "b": 640, "c": 640}, {"a": 0.123456789, "b": 0.0}, 64)
    assert len(odd) == 100 + 10 + 1 and all(r["_k"] * r["_p"] // r["_a"] <= r["_s"] < -(-(r["_k"] + 1) * r["_p"] // r["_a"]) for r in odd)
    assert all(r["_f"] >= max(x["_s"] for x in odd if x["_source"] != "b") for r in odd if r["_source"] == "b")


def test_more_than_a_thousand_sources(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"s{i}") for i in range(1100)], "doc_id long, text string, source string")
    out = mixing.mixed_order(df, {"s0": 0.2}).collect()
    assert len({r.slot for r in out}) == 1100 and all(r.release_slot <= r.slot < r.deadline_slot for r in out)
