import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from touchline.llm import turn_repair

KIND = "conv_id long, turn long, role string, text string, id string, place string, fault string, audit string"


def slow_script(turns):
    """Cheapest edits by walking the grammar turn by turn; turns are (initial, fault)."""
    moves = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def better(best, state, script):
        if state not in best or script < best[state]:
            best[state] = script
            return True
        return False

    def with_inserts(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (state, role) in moves:
                        changed |= better(best, moves[state, role], (cost + 2, audit + "I"))
        return best

    best = with_inserts({"0": (0, "")})
    for initial, fault in turns:
        after = {}
        for state, (cost, audit) in best.items():
            better(after, state, (cost + 3, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, initial) in moves:
                    better(after, moves[state, initial], (cost + extra, audit + "K"))
                for role in "ua":
                    if (state, role) in moves and role != initial:
                        better(after, moves[state, role], (cost + 2 + extra, audit + "R"))
        best = with_inserts(after)
    return min(best[s] for s in ("0", "a") if s in best)


def slow_repair(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is None:
            continue
        convs[c] += []
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            convs[c] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for c, turns in convs.items():
        turns.sort()
        numbers = [t for known, t, *_ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen = [], set()
        for _, _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = slow_script(list(zip(initials, faults)))
        kept, lines = iter(turns), []
        n_out = len(audit) - audit.count("D")
        for edit in audit:
            turn = None if edit == "I" else next(kept)
            if edit != "D":
                role = turn[2] if edit == "K" else ["user", "assistant"][(len(lines) - n_out % 2) % 2]
                lines.append(f"{role}:{turn[3] if turn else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out)


def letters(turns):
    return "".join("x" if f in ("blank", "duplicate") else (i if i in "sua" else "o").upper() if f else (i if i in "sua" else "o") for i, f in turns)


def test_every_short_conversation():
    kinds = [("s", None), ("u", None), ("a", None), ("u", "truncated"), ("o", None), ("a", "blank")]
    for n in range(5):
        for turns in itertools.product(kinds, repeat=n):
            assert turn_repair.whole(letters(turns)) == slow_script(turns), turns


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations_and_pieces(seed):
    rng = random.Random(seed)
    kinds = [(i, f) for i in "suao" for f in (None, None, None, "truncated", "blank")]
    for _ in range(60):
        calm = [("ua"[k % 2], None) if rng.random() < 0.7 else rng.choice(kinds) for k in range(rng.randint(5, 60))]
        want = slow_script(calm)
        assert turn_repair.whole(letters(calm)) == want
        cuts, code = sorted(rng.sample(range(1, len(calm)), 2)), letters(calm)
        tables = [turn_repair.table(code[a:b]) for a, b in zip([0, *cuts], [*cuts, len(code)])]
        both = turn_repair.joined(turn_repair.joined(tables[0], tables[1]), tables[2])
        assert min(both[k] for k in ((0, 0), (0, 3)) if k in both) == want


def made(seed, n_convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "  ", "", None, "What?\n", "Stop! ", "é.", "a. b", "x" * 5000 + "."]
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else t + rng.randint(0, 2)
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "sage"]), rng.choice(texts), "a", "b", "c", "d"))
    return [*rows, *rows[:5], (None, 1, "user", "no id", "a", "b", "c", "d"), (-3, 7, "user", "only", "a", "b", "c", "d")]


@pytest.mark.parametrize("piece", [2, 256])
def test_query_by_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    monkeypatch.setattr(turn_repair, "FAN_IN", 3)
    rows = made(piece, 60, 14)
    found = turn_repair.repair(spark.createDataFrame(rows, KIND).repartition(3))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert all(t == "bigint" for _, t in found.dtypes[:7])
    assert sorted(map(tuple, found.collect())) == slow_repair(rows)


def test_empty_table_and_dropped_conversation(spark):
    assert turn_repair.repair(spark.createDataFrame([], KIND)).collect() == []
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = turn_repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "a", "b", "c", "d")], KIND)).collect()
    assert list(map(tuple, found)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
