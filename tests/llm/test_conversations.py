import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rinseframe.llm import conversations, queries
from rinseframe.llm.conversations import Prefixes, cheapest, faults, repaired, solve
from tests.llm.helpers import FOLDER

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ORDER = {"": 0, "s": 1, "u": 2, "a": 3}


def plain_edits(kinds):
    """The least (cost, audit) by plain strings: from the end, over (row, last initial)."""
    found = {}
    for i in range(len(kinds), -1, -1):
        for last in ("", "s", "u", "a"):
            offers = [(0, "")] if i == len(kinds) and last in ("", "a") else []
            if i < len(kinds):
                initial, kind = kinds[i]
                extra = 5 if kind == "truncated" else 0
                moves = [("D", 2, last)]
                if kind not in ("blank", "duplicate"):
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                    moves += [("K", extra, initial)] if initial and initial in legal else []
                    moves += [("R", 1 + extra, role) for role in "ua" if role in legal]
                offers += [(cost + found[i + 1, then][0], edit + found[i + 1, then][1]) for edit, cost, then in moves if (i + 1, then) in found]
            if offers:
                found[i, last] = min(offers)
        for _ in range(4):  # insertions stay at the row
            for last in ("", "s", "u", "a"):
                role = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
                if (i, role) in found:
                    offer = (5 + found[i, role][0], "I" + found[i, role][1])
                    found[i, last] = min(found.get((i, last), offer), offer)
    return found[0, ""]


def plain(rows):
    """The whole contract over damaged (conv, turn, role, text) rows in order; dropped rows have no role."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv] += [] if role is None else [(turn, role, text)]
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in found if t is not None]
        kinds, seen, counts = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in found:
            body = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                counts[kind] += 1
            kinds.append((role[:1], kind))
        cost, audit = plain_edits(kinds)
        left, at, last = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else found[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            left.append(f"{role}:{text}")
        initials = [r[:1] for _, r, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        role, text = shown[2:]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if fault == 0:
            yield conv, turn, None, None
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if fault == 3 else 1)


def kinds_of(form):
    return [({"o": "t", "x": "u"}.get(c.lower(), c.lower()), "blank" if c == "x" else "truncated" if c.isupper() else "") for c in form]


def test_all_short_forms():
    for n in range(6):
        for form in itertools.product("suaoxSUA", repeat=n):
            assert cheapest("".join(form)) == plain_edits(kinds_of(form)), form


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaoxSUAO", max_size=60))
def test_longer_forms(form):
    assert cheapest(form) == plain_edits(kinds_of(form))


def test_an_audit_says_what_it_costs():
    rng = random.Random(3)
    for _ in range(200):
        form = "".join(rng.choices("suaoxUA", k=rng.randrange(40)))
        cost, audit = cheapest(form)
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool") for c in form]
        left = list(repaired(roles, ["."] * len(form), audit))
        initials = "".join(role[0] for role, _, _ in left)
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1 and initials != "s"
        paid, at = 0, 0
        for edit in audit:
            paid += {"K": 0, "R": 1, "D": 2, "I": 5}[edit] + 5 * (edit in "KR" and form[at].isupper())
            at += edit != "I"
        assert paid == cost and at == len(form)


@pytest.mark.parametrize("prime", [None, 1, 3])
def test_prefixes_compare_as_strings(monkeypatch, prime):
    """Also where hashes collide all the time."""
    if prime:
        monkeypatch.setattr(conversations, "_PRIME", prime)
    made, strings, rng = Prefixes(), [""], random.Random(5)
    for _ in range(400):
        node = rng.randrange(len(strings)) if rng.random() < 0.3 else len(strings) - 1
        letter = rng.choice("DK" if rng.random() < 0.9 else "IR")
        assert made.extend(node, letter) == len(strings)
        strings.append(strings[node] + letter)
    for _ in range(3000):
        a, b = rng.randrange(len(strings)), rng.randrange(len(strings))
        assert made.less(a, b) == (strings[a] < strings[b])
        assert made.text(a) == strings[a]


def test_blocks_join_as_one():
    rng = random.Random(7)
    for _ in range(150):
        form = "".join(rng.choices("suaoxUA", weights=[1, 4, 4, 1, 1, 1, 1], k=rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(form) + 1), min(3, len(form))))
        parts = [form[a:b] for a, b in zip([0, *cuts], [*cuts, len(form)])]
        rows = []
        for i, part in enumerate(parts):
            found = [x for s in range(4) for x in solve(part, s)]
            rows.append({"number": i, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_initial": None, "last_initial": None,
                         "first_turn": None, "last_turn": None, "n_turns": 0, "costs": [-1 if x is None else x[0] for x in found],
                         "audits": ["" if x is None else x[1] for x in found]})
        import pyarrow as pa

        report, pieces = conversations._joined(pa.Table.from_pylist(rows, pa.schema([
            *((c, pa.int64()) for c in ("number", "blank", "duplicate", "truncated", "illegal")), ("first_initial", pa.string()), ("last_initial", pa.string()),
            ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])))
        assert (report["cost"], report["audit"]) == cheapest(form) and "".join(p["piece"] for p in pieces) == report["audit"]


def test_faults():
    assert faults(["user", "user", "tool", "user"], ["Hi.", "Hi.", "no end ", " \t"]) == ("uxOx", [1, 1, 1])
    assert faults(["user"], ["a\xa0"])[0] == "U" and faults(["user"], ["\xa0"])[0] == "U"


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def check(spark, rows, partitions=3):
    """Rows without ties in a conversation's turns, damaged and repaired by both."""
    report = conversations.repair(queries.damaged(rows_of(spark, rows).repartition(partitions)), absent="dropped").report
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in report.collect()}
    assert got == plain(damage(rows)) and report.columns == ["conv_id", *NAMES]


def made(conversations_, rng, most):
    words = ["Yes.", "No!", "Why?", "cut off", " ", "", "Ünï.", "tab\t", "line\n.", None]
    for c in range(conversations_):
        for t in range(rng.randrange(1, most)):
            yield c, t * rng.choice([1, 1, 2]) + 10 * t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(words[:5] * 3 + words)


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = list(made(120, rng, 14))
    rows += [(None, 1, "user", "nobody's."), (None, 2, "assistant", "row."), (500, None, "user", "no turn."), (501, None, None, None)]
    check(spark, rows)


def test_conversations_in_many_blocks(spark, monkeypatch):
    """One conversation holds most rows and lies in many blocks and partitions."""
    rng = random.Random(13)
    rows = list(made(5, rng, 6)) + [(77, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"text {i // 3}.", f"t{i}!"])) for i in range(9000)]
    check(spark, rows, 7)


def test_what_is_left(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "No."), (2, 5, "user", " ")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(5000)]
    done = conversations.repair(rows_of(spark, rows))
    turns = done.turns.orderBy("conv_id", "block", "place").collect()
    report = {r.conv_id: r for r in done.report.collect()}
    assert [(r.role, r.text, r.edit) for r in turns if r.conv_id == 1] == [("user", "There.", "K"), ("assistant", "Yes.", "K")]
    assert report[1].audit == "DKK" and report[2].audit == "DD" and report[2].gaps == 4 and report[3].cost == 0
    for c in report:
        left = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == c)
        assert report[c].repaired_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_odd_tables(spark):
    odd = rows_of(spark, [(None, None, None, None)] * 4 + [(1, 1, "user", "x" * 3_000_000 + "."), (1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "é.")])
    odd = odd.selectExpr("*", "'a' AS audit", "1 AS number", "true AS whole", "0 AS conv", "'x' AS hash")
    got = {r.conv_id: r for r in conversations.repair(odd).report.collect()}
    assert got[None].audit == "DDDD" and got[None].blank == 4 and got[None].gaps == 0 and got[None].cost == 8
    assert got[1].duplicate == 1 and got[1].audit == "KDK" and got[1].cost == 2
    empty = conversations.repair(odd.limit(0))
    assert empty.report.count() == 0 and empty.turns.count() == 0
    far = conversations.repair(rows_of(spark, [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")])).report.first()
    assert far.gaps == (1 << 63) - 1 and far.audit == "KK"
    text = conversations.repair(rows_of(spark, [("a", 1, "user", "a."), ("a", 2, "assistant", "b.")], "conv_id string, turn long, role string, text string")).report.first()
    assert text.conv_id == "a" and text.cost == 0


def test_equal_turns_are_ordered_by_role(spark):
    report = conversations.repair(rows_of(spark, [(1, 0, "user", "b."), (1, 0, "assistant", "a."), (1, 1, "assistant", "c.")])).report.first()
    assert report.audit == "DKK" and report.gaps == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op13_conversation_repair(spark, FOLDER).collect()}
    assert got == plain(damage(rows)) and len(got) == len({r[0] for r in rows})
