"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lapsegrid.llm import queries, repair

SF = "/root/testdata/sf0.01"
VALID = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by Dijkstra over (rows used, role given last), least audit first."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and VALID.fullmatch("".join(r[0] for r, _ in out)):
            return cost, audit, out
        fits = lambda c: {"": "su", "s": "u", "u": "a", "a": "u"}[last].count(c)  # noqa: E731, B023
        for name in ("user", "assistant"):
            if fits(name[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] and fits(role[0]):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
            for name in ("user", "assistant"):
                if fits(name[0]):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, name[0], (*out, (name, text))))
    raise AssertionError


def plain(turns):
    """The whole contract over (conv_id, turn, role, text) tuples."""
    convs = {}
    for conv, turn, role, text in turns:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        pick = zlib.crc32(key.encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        own += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turn = [t for t, _, _ in own if t is not None]
        count = lambda f: sum(r[2] == f for r in rows)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, repaired = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def result(frame):
    rows = frame.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_a_plain_search(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_repair(spark, SF)) == plain(turns)


def test_nulls_ties_repeats_clashing_columns_and_long_texts(spark):
    turns = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be."), (1, 1, None, "No role."), (1, 2, "assistant", None), (1, 2, "assistant", "\x0b\t"),
        (None, 0, "user", "A?"), (None, None, "robot", "B!"), (2, None, None, None), (3, 5, "assistant", "x" * 3_000_000 + "."), (3, 9, "assistant", "End"),
        (4, 1, "", "Empty role."), (4, 2, "system", "Late."), (5, 7, "user", "Q.\x85"), (5, 7, "assistant", "Z. \n"), (5, 7, "assistant", "A. \n"),
    ] + [(k, t, r, f"{r} {k % 2}.") for k in range(10, 60) for t, r in enumerate(("system", "user", "assistant", "user"))]
    frame = spark.createDataFrame([(*t, 1, "c", 2) for t in turns], "conv_id long, turn long, role string, text string, place int, audit string, pick int")
    assert result(repair.repair(frame)) == plain(turns)


def test_every_row_dropped_and_an_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(frame).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(repair.repair(frame)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_ids(spark):
    turns = [("a", 0, "user", "Hi."), ("b", 1, "assistant", "Yes."), ("a", 1, "assistant", "Good"), (None, 0, "user", "X.")]
    assert result(repair.repair(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"))) == plain(turns)


def _rows(signature):
    names = {"s": "system", "u": "user", "a": "assistant", "o": "robot", "x": "user"}
    return [(names[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in signature]


@pytest.mark.parametrize("seed", range(3))
def test_trie_gives_the_cheapest_and_least_audit(seed):
    rng = random.Random(seed)
    found = sorted({"".join(rng.choices("xsuaoSUAO", [2, 2, 4, 4, 1, 1, 2, 2, 1], k=rng.randrange(9))) for _ in range(400)})
    trie = repair.Trie()
    assert [trie.at(s) for s in found] == [cheapest(_rows(s))[:2] for s in found]
    assert trie.nodes == len({s[:k] for s in found for k in range(1, len(s) + 1)})


def test_long_signature_is_linear():
    cost, audit = repair.Trie().at("ua" * 100_000 + "u")
    assert (cost, audit) == (3, "K" * 200_001 + "I")
