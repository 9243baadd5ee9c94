"""Hard negatives, held-out passages and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import conversations, hard_negatives, held_out_passages

# ---- hard negatives


def brute_negatives(rows, anchors, k=5):
    """rows: (key, label, features); key order, nulls last."""
    lengths = Counter(len(v) for _, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) and abs(x * 256) <= 1 << 26 for x in v))
    dims = max(lengths, key=lambda n: (lengths[n], n), default=0)
    good = [(key, label, [int(np.floor(256 * np.float64(x))) for x in v]) for key, label, v in rows
            if label is not None and v and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * 256) <= 1 << 26 for x in v)]
    first = lambda found: sorted(found, key=lambda f: (-f[0], tuple((x is None, x or 0) for x in f[1])))[:k]
    out = []
    for i, (key, label, v) in enumerate(good):
        if not anchors(key):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), other, la) for j, (other, la, w) in enumerate(good) if j != i]
        for p, pos, _ in first([s for s in score if s[2] == label]):
            for rank, (n, neg, _) in enumerate(first([s for s in score if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]), 1):
                out.append((key, pos, rank, neg, p, n))
    return sorted(out, key=repr)


def mined(df, anchors, **more):
    got = hard_negatives.mine_hard_negatives(df, anchors, **more).collect()
    return sorted(((tuple(r["anchor"]), tuple(r["positive"]), r["rank"], tuple(r["negative"]), r["positive_score"], r["negative_score"]) for r in got), key=repr)


def test_hard_negatives_of_pattern_rows(frame):
    """Own records: market, symbol, session_date, feature columns and an outcome; blocks and chunks of a few rows."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 6))
    rows = [(("US" if i % 3 else "KR", f"S{i % 40:02}", f"2024-01-{1 + i // 40:02}"), bool(draw.integers(2)), [float(x) for x in centres[i % 4] + 0.2 * draw.normal(size=6)]) for i in range(400)]
    rows += [(("US", "TIE", f"2024-02-{d:02}"), bool(d % 2), [1.0] * 6) for d in range(1, 20)]  # equal vectors
    rows += [rows[0], (("US", None, None), True, [0.5] * 6), (("US", "X", "n"), None, [0.1] * 6), (("US", "Y", "n"), True, [float("nan")] * 6), (("US", "Z", "n"), True, [None] * 6),
             (("US", "W", "n"), True, [1e200] * 6), (("US", "V", "n"), False, [1e-200] * 6), (("US", "U", "n"), False, [0.0] * 6)]
    columns = [f"f_{k}" for k in range(6)]
    df = frame([(*key, label, *v, "x", 1) for key, label, v in rows], "market string, symbol string, session_date string, pattern_hit boolean, " + ", ".join(f"{c} double" for c in columns) + ", v string, block int")
    old = hard_negatives.BLOCK, hard_negatives.CHUNK, hard_negatives.PAGE
    hard_negatives.BLOCK, hard_negatives.CHUNK, hard_negatives.PAGE = 32, 8, 4
    try:
        got = mined(df, F.col("symbol").isin("S00", "S07", "TIE") | F.col("symbol").isNull(), features=columns)
        empty = mined(df.limit(0), F.col("symbol") == "S00", features=columns)
    finally:
        hard_negatives.BLOCK, hard_negatives.CHUNK, hard_negatives.PAGE = old
    want = brute_negatives(rows, lambda key: key[1] in ("S00", "S07", "TIE", None))
    assert got == want and len(want) > 100 and empty == []


def test_hard_negatives_of_arrays(frame):
    rows = [((i,), i % 5, [float(x) for x in np.random.default_rng(i).normal(size=3)]) for i in range(60)]
    rows += [((100,), 1, [1.0, 2.0]), ((101,), 1, []), ((102,), 1, None), ((103,), 2, [float("inf"), 0.0, 0.0]), ((None,), 2, [0.3, 0.2, 0.1])]
    df = frame([(*key, label, v) for key, label, v in rows], "symbol bigint, outcome int, features array<float>")
    shown = [(key, label, None if v is None else [float(np.float32(x)) for x in v]) for key, label, v in rows]
    assert mined(df, F.col("symbol") % 7 == 0, key=("symbol",), label="outcome", features="features") == brute_negatives(shown, lambda key: key[0] is not None and key[0] % 7 == 0)
    assert mined(df, F.lit(False), key=("symbol",), label="outcome", features="features") == []


def test_zone_maps_leave_blocks_out():
    """A block whose bounds stay below a window's floor is not read."""
    import pyarrow as pa

    zones = pa.table({"block": [0, 1], "page": [0, 0], "least": [[10, 10], [-5, -5]], "most": [[20, 20], [0, 0]], "labels": [[1], [1]]})
    anchors = pa.table({"chunk": [7], "anchor": [3], "label": [1], "v": pa.array([[1, 1]], pa.list_(pa.int32())), "windows": pa.array([[{"window": 0, "low": 15, "high": None}]], hard_negatives._WINDOWS)})
    run = hard_negatives._reached(2, True)
    assert run((pa.scalar(7),), anchors, zones).to_pylist() == [{"chunk": 7, "block": 0}]


def test_hilbert_neighbours_differ_by_one_step():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = points[np.argsort(hard_negatives.hilbert_index(points, 3))]
    assert len(set(hard_negatives.hilbert_index(points, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ---- held-out passages


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_held_out(articles, held_out, size=10):
    windows = {}
    for item, text in held_out:
        w = plain_words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add("" if item is None else str(item))
    out = []
    for key, text in articles:
        w, hit, items = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    items |= windows[tuple(w[s:s + n])]
        runs = [(a, max(g) + 1) for a, g in ((min(g), g) for g in ([x[1] for x in grp] for _, grp in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0])))]
        out.append((key, text, len(w), len(hit), tuple(sorted(items)), tuple(runs), bool(hit)))
    return sorted(out, key=repr)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeinorst") for _ in range(draw.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_held_out_passages(frame, monkeypatch, limit):
    """With the set broadcast and dealt by hash."""
    import barlens.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(held_out_passages, "BROADCAST_BYTES", limit)
    a, b = prose(1, 40), prose(2, 14)
    held = [("1", a), ("10", b), ("2", "short one HERE"), ("3", ""), ("4", None), ("5", "..!"), (None, prose(7, 12)), ("1", prose(8, 11)), ("6", a), ("7", "Ça va—日本"), ("1", a)]
    texts = [prose(3, 30) + " " + a.upper() + ". " + prose(4, 20), b + "\n" + b, "x" + b, " ".join(b.split()[:9]), a[:-1], "a short,one;here b", "short one", None, "", "...", prose(7, 12),
             ", ".join(prose(8, 11).split()), "ça va 日本 ça va 日本", "Ça-va_日本", (prose(9, 3000) + " " + a + " ") * 3, "short one here " * 500, prose(5, 200)]
    articles = [(f"evt_{i}", t) for i, t in enumerate(texts)] + [("evt_0", texts[0]), (None, texts[0]), (None, None)]
    df = frame([(*r, 1, "x") for r in articles], "event_id string, title string, n int, digest string")
    items = frame([(*r, "x", 2) for r in held], "event_id string, title string, key string, length int")
    got = held_out_passages.flag_held_out(df, items).collect()
    rows = sorted(((r["event_id"], r["title"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"]), r["contaminated"]) for r in got), key=repr)
    assert rows == brute_held_out(articles, held)
    assert held_out_passages.flag_held_out(df.limit(0), items).count() == 0
    assert held_out_passages.flag_held_out(df, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_held_out_passages_in_capitals(frame):
    """Only A-Z have one case: letters that change their form with what surrounds them, or into a-z."""
    item = "ΑΣ Β İstanbul K k ΟΔΟΣ É é Σ z"
    held = [("1", item), ("2", item.replace("É", "é")), ("3", "Σ"), ("4", "ς x")]
    articles = [("a", "see ΑΣ'Β, İSTANBUL K-K ΟΔΟΣ'É'é.Σ'Z end"), ("b", item.lower()), ("c", "ΑΣ Β İstanbul K k ΟΔΟΣ é é Σ z"), ("d", "σ Σ ς X"), ("e", "K " + item.replace("K", "k"))]
    got = held_out_passages.flag_held_out(frame(articles, "event_id string, title string"), frame(held, "event_id string, title string")).collect()
    rows = sorted(((r["event_id"], r["title"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"]), r["contaminated"]) for r in got), key=repr)
    assert rows == brute_held_out(articles, held)
    assert [r[6] for r in rows] == [True, False, True, True, True]


def test_held_out_texts_are_cut_once(frame):
    """Probing is compiled as a whole: no function over arrays, and no text is cut into words twice."""
    df = frame([("a", prose(1, 20))], "event_id string, title string")
    windows = held_out_passages.held_out_windows(df).localCheckpoint()
    plan = held_out_passages._probed(df, windows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "lambdafunction" not in plan and "translate" not in plan


def test_held_out_words_leave_the_text(frame):
    a = "one two three four five six seven eight nine ten"
    df = frame([("evt_1", f"Keep, this. {a.upper()}! And (that)."), ("evt_2", "nothing"), ("evt_3", a), ("evt_4", None)], "event_id string, title string")
    rows = held_out_passages.flag_held_out(df, frame([("q", a)], "event_id string, title string"))
    got = dict(rows.select("event_id", held_out_passages.without_spans("title", "spans")).collect())
    assert got == {"evt_1": "Keep, this! And (that).", "evt_2": "nothing", "evt_3": "", "evt_4": None}


# ---- conversations


def plain_repair(kinds):
    """Every state's least (cost, letters), single edits at a time."""
    best = {0: (0, "")}

    def insert():
        for _ in range(3):
            for p, q in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if p in best and (w := (best[p][0] + 3, best[p][1] + "I")) < best.get(q, (1e9,)):
                    best[q] = w

    for kind in kinds:
        insert()
        new = {}
        for p, (c, a) in best.items():
            x, i, follow = (3 if kind.isupper() else 0), kind.lower(), (3 if p == 2 else 2)
            ways = [(p, c + 4, a + "D")]
            if i != "d":
                ways.append((follow, c + 3 + x, a + "R"))
            if i == ("a" if p == 2 else "u"):
                ways.append((follow, c + x, a + "K"))
            if i == "s" and p == 0:
                ways.append((1, c + x, a + "K"))
            for q, *w in ways:
                new[q] = min(new.get(q, (1e9,)), tuple(w))
        best = new
    insert()
    return min(best[q] for q in (0, 3) if q in best)


def tree_repair(kinds):
    walk, out, held = conversations.Survivors(0), [], 0
    for kind in kinds:
        walk.step(conversations.ROW_OPTIONS[kind])
        out += [letters for letters, _ in walk.settled()]
        held = max(held, walk.held)
    q = conversations.best_end(walk)
    cost, rest = walk.close(q)
    tail = conversations._TAIL[q]
    return (cost + 3 * len(tail), "".join([*out, *(letters for letters, _ in rest), tail])), held


def test_survivor_tree():
    for n in range(4):
        for kinds in itertools.product("dsuaoSUAO", repeat=n):
            assert tree_repair(kinds)[0] == plain_repair(kinds), kinds
    draw = random.Random(5)
    for _ in range(200):
        kinds = "".join(draw.choice("dsuaoSUAOuaua") for _ in range(draw.randint(4, 300)))
        assert tree_repair(kinds)[0] == plain_repair(kinds), kinds
    assert tree_repair("ua" * 4000)[1] < 10  # what all survivors share has left the tree


def brute_report(turns):
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    seen, kinds, faults = set(), [], []
    for _, _, role, text in rows:
        visible = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        i = role[:1] if role[:1] in ("s", "u", "a") else "o"
        faults.append(fault)
        kinds.append("d" if fault in ("blank", "duplicate") else i.upper() if fault else i)
    cost, audit = plain_repair(kinds)
    left, state, lines = iter(rows), 0, []
    for letter in audit:
        if letter == "I":
            state, role = (3, "assistant") if state == 2 else (2, "user")
            lines.append(f"{role}:")
            continue
        _, _, role, text = next(left)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s" and state == 0:
            state = 1
        else:
            state, other = (3, "assistant") if state == 2 else (2, "user")
            role = role if letter == "K" else other
        lines.append(f"{role}:{text}")
    numbers = {t for _, t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    count = Counter(faults)
    return (rows[0][0], gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("block", [conversations.BLOCK, 3])
def test_conversation_report(frame, block, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", block)
    draw = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No", " ", "", None, "Why?", "a much longer line. " * 50]
    turns = []
    for c in [*range(60), None, -5]:
        for t in range(draw.choice([1, 2, 5, 9, 40])):
            turns.append((c, draw.choice([t, t, t, t + 3]) if c != 7 else None, draw.choice(roles), draw.choice([*texts, f"{t} said. ", f"{t} cut"])))
    # Equal turns are told apart by role alone here: their texts' order is the hash's.
    turns = list({(c, t, r if r is not None else " "): (c, t, r, x) for c, t, r, x in turns}.values())
    turns += [(1000, k, "user", f"{k}.") for k in range(200)] + [(1001, 5, "user", "same.")] * 30
    df = frame([(*r, "x", 9) for r in turns], "conv_id bigint, turn bigint, role string, text string, kind string, block int")
    rows = conversations.repair_conversations(df)
    got = sorted((tuple(r) for r in conversations.conversation_report(rows).collect()), key=repr)
    by = {}
    for r in turns:
        by.setdefault(r[0], []).append(r)
    assert got == sorted((brute_report(v) for v in by.values()), key=repr)
    assert rows.count() == len(turns)
    empty = conversations.repair_conversations(df.limit(0))
    assert empty.count() == 0 and conversations.conversation_report(empty).count() == 0
