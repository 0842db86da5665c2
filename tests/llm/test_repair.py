import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from hexlytics.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, n long, kind string, chunk long"
BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(place.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def kinds(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(BLANK):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(BLANK)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, lines) by trying all edits."""
    def follows(initials, more):
        return re.fullmatch("s?(ua)*u?", initials + more) is not None

    @lru_cache(None)
    def best(i, state, inserts):
        # ``state``: what the initials so far end in; that decides all that may follow.
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        full = {"": "", "s": "s", "u": "u", "a": "ua"}[state]
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 2)
            out.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role[:1] and follows(full, role[:1]):
                    cost, audit, lines = best(i + 1, role[0], 2)
                    out.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                for new in ("user", "assistant"):
                    if follows(full, new[0]):
                        cost, audit, lines = best(i + 1, new[0], 2)
                        out.append((cost + 2 + extra, "R" + audit, (f"{new}:{text}", *lines)))
        for new in ("user", "assistant"):
            if inserts and follows(full, new[0]):
                cost, audit, lines = best(i, new[0], inserts - 1)
                out.append((cost + 2, "I" + audit, (f"{new}:", *lines)))
        return min(out) if out else (10 ** 9, "", ())

    return best(0, "", 2)


def by_hand(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(damaged([r for r in rows if r[0] == conv]),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = kinds(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit, lines = cheapest(tuple(mine), tuple(faults))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture()
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256").collect()), key=str)


def made(conversations, length, seed, roles=("user", "assistant", "user", "assistant", "system", "tool")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), rng.choice(["a.", "b", "é! ", "c?\n", " ", "d e", f"x{rng.random()}."]))
            for c in range(conversations) for t in range(rng.randint(1, length))]


ODD = [
    (None, 0, "user", "a."), (None, None, None, None), (None, 3, "assistant", None),
    (900, None, "user", "b."), (900, None, "user", "b."), (900, 5, "", "c."), (900, 5, "s", "c."),
    (901, 1, "system", "x."), (902, 1, "ufo", "x."), (902, 2, "ape", "y."), (902, 900, "User", "z."),
    (903, 7, "user", "word " * 5000),
]


@pytest.mark.parametrize("chunk", [3, 512])
def test_small_conversations_by_hand(talks, chunk):
    rows = made(120, 9, 1) + ODD + [(904, t, "user", "only drops") for t in range(400)
                                    if zlib.crc32(f"904:{t}".encode()) % 20 == 0]
    expected = by_hand(rows)
    assert (904, 0, 0, 0, 0, 0, 0, "", EMPTY) in expected
    assert found(R.repair(talks(rows), chunk)) == expected


@pytest.mark.parametrize("roles", [("tool",), ("user", "assistant")])
def test_one_long_conversation_over_many_chunks(talks, roles):
    rng = random.Random(7)
    rows = [(1, t, roles[t % len(roles)], f"{rng.random()}.") for t in range(170)]
    rows += [(2, t, "user", "same.") for t in range(20)]
    expected = by_hand(rows)
    assert found(R.repair(talks(rows), 5)) == expected
    # Without fix-up passes, the matrices settle it.
    assert found(R.repair(talks(rows), 5, passes=1)) == expected


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    kinds_ = "suauauauauauaUAua"
    said = R.first_vector(kinds_, R.END)
    other = (5, 1, 0, 3)
    assert R.first_vector(kinds_, other, R.END, said) == R.first_vector(kinds_, other)


def test_matrix_is_the_sum_of_all_vectors():
    rng = random.Random(3)
    for _ in range(50):
        line = "".join(rng.choice("suaoSUAOdb") for _ in range(rng.randint(1, 12)))
        end = tuple(rng.randint(0, 6) for _ in range(4))
        m = R.matrix(line)
        whole = tuple(min(m[4 * s + e] + end[e] for e in range(4)) for s in range(4))
        assert R._plain(whole) == R.first_vector(line, end)


def test_empty_table(talks):
    assert found(R.repair(talks([]))) == []
