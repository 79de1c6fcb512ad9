"""Conversation structure repair: cheapest edits by a DP whose layers are shared in a prefix trie.

A conversation is reduced to its signature, one symbol per row (what the row's role and fault allow).
Signatures are dealt by range and sorted, so that each task meets them in the order of a walk through
the prefix trie: it keeps the DP layers of the path that it stands on, drops those below the prefix it
shares with the next signature and adds one per new node. At a terminal node the costs of the path's
layers give the cheapest audit. Ranges also split by a hash of the conversation, so a signature that
very many conversations have is not one task.

A conversation's own rows are never held together: faults and places come from windows, and the repaired
text is hashed row by row. Its signature and its audit are values of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, columns, staged

#: Costs of the edits, of a row that stays cut off, and the roles that edits give.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
#: The damage's modulus; white space; how a whole text ends.
DAMAGE = 20
NOT_BLANK, WHOLE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: States of the roles given so far: none, a system turn, a user turn, an assistant turn.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
FAR = 1 << 60


def given(state: int) -> str:
    """The only role that a rerole or an insert can give in a state: its initial."""
    return "a" if state == ASKED else "u"


def row_edits(symbol: str) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that consume a row. Symbols: ``x`` must go; the initial
    of the role (``o``: another role), as a capital if the text is cut off."""
    out = [("D", k, k, DELETE) for k in range(4)]
    if symbol != "x":
        more = CUT if symbol.isupper() else 0
        out += [("K", k, to, more) for (k, r), to in STEP.items() if r == symbol.lower()]
        out += [("R", k, STEP[k, given(k)], REROLE + more) for k in range(4)]
    return out


EDITS = {c: row_edits(c) for c in "xsuaoSUAO"}


def inserted(costs: list[int]) -> list[int]:
    """Costs of the states when rows may be inserted: two in turn lead to every state that inserts reach."""
    out = list(costs)
    for _ in range(2):
        for k in range(4):
            to = STEP[k, given(k)]
            out[to] = min(out[to], out[k] + INSERT)
    return out


class Trie:
    """The path of a walk through the prefix trie of sorted signatures, with the DP layer of each node."""

    def __init__(self):
        self.signature, self.layers, self.nodes, self.last = "", [inserted([0, FAR, FAR, FAR])], 0, None

    def at(self, signature: str) -> tuple[int, str]:
        """Cost and ASCII-least audit of the cheapest repair. Layers are computed for nodes that the
        path to the signature before doesn't have."""
        if self.last is not None and signature == self.signature:
            return self.last
        shared = len(commonprefix([self.signature, signature]))
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            before, after = self.layers[-1], [FAR] * 4
            for _, k, to, cost in EDITS[symbol]:
                after[to] = min(after[to], before[k] + cost)
            self.layers.append(inserted(after))
            self.nodes += 1
        self.signature = signature
        self.last = self.answer()
        return self.last

    def answer(self) -> tuple[int, str]:
        """Edges of cheapest ways are found backwards along the path, the least letters forwards."""
        n, cost = len(self.signature), min(self.layers[-1][START], self.layers[-1][ANSWERED])
        ways: list[list[dict[str, tuple[int, int]]]] = [[{} for _ in range(4)] for _ in range(n + 1)]
        good = [[False] * 4 for _ in range(n + 1)]
        for k in (START, ANSWERED):
            good[n][k] = self.layers[n][k] == cost
        for i in range(n, -1, -1):
            here = self.layers[i]
            for _ in range(2):
                for k in range(4):
                    to = STEP[k, given(k)]
                    if good[i][to] and here[k] + INSERT == here[to]:
                        good[i][k] = True
                        ways[i][k]["I"] = (i, to)
            if i:
                for letter, k, to, price in EDITS[self.signature[i - 1]]:
                    if good[i][to] and self.layers[i - 1][k] + price == self.layers[i][to]:
                        good[i - 1][k] = True
                        ways[i - 1][k][letter] = (i, to)
        audit, i, k = [], 0, START
        while way := ways[i][k]:
            letter = min(way)
            audit.append(letter)
            i, k = way[letter]
        return cost, "".join(audit)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of turns after the damage; null roles and texts are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % DAMAGE).alias("pick"))
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("pick") == 4, USER).otherwise(F.col("role"))
    return rows.where("pick <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation (from 1), signature symbol and what the counts need. Rows are taken by
    turn, nulls first, then by role and text."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    blank, whole = ~F.col("text").rlike(NOT_BLANK), F.col("text").rlike(WHOLE)
    marked = dealt.withColumn("fault", F.when(blank, "b").when(again, "d").when(~whole, "t").otherwise("-"))
    own = Window.partitionBy("conv_id").orderBy(*order)
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(plain)).otherwise(plain)
    pair = F.concat(F.lag(initial).over(own), initial)
    before = F.lag("turn").over(own)
    return marked.select(
        "conv_id", F.row_number().over(own).alias("place"), "turn", "role", "text", "fault", symbol.alias("symbol"),
        (pair.isNotNull() & ~F.coalesce(pair, F.lit("su")).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~before.eqNullSafe(F.col("turn"))).alias("new_turn"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, and its symbols in turn."""
    fault = lambda c: F.count_if(F.col("fault") == c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0))
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda s: s.symbol), "")
    return rows.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), fault("b").alias("blank"), fault("d").alias("duplicate"), fault("t").alias("truncated"),
        F.count_if("illegal").alias("illegal"), symbols.alias("signature"),
    )


def _answers(batches) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        found = [trie.at(s) for (s,) in columns(batch, "signature")]
        kept = {c: batch.column(c) for c in batch.schema.names if c != "signature"}
        yield pa.record_batch(kept | {"cost": pa.array([c for c, _ in found], pa.int64()), "audit": pa.array([a for _, a in found], pa.string())})


def answered(convs: DataFrame) -> DataFrame:
    """Conversations with cost and audit in place of the signature."""
    schema = ", ".join([*(f"{c} {t}" for c, t in convs.dtypes if c != "signature"), "cost long, audit string"])
    dealt = convs.repartitionByRange("signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.mapInArrow(_answers, schema)


class Repaired:
    """The repaired text of one conversation as a running hash."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, START, hashlib.sha256(), False

    def _emit(self, role: str, text: str, initial: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun, self.state = True, STEP[self.state, initial]

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._emit(USER if given(self.state) == "u" else ASSISTANT, "", given(self.state))
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._emit(role, text, role[0])
        elif letter == "R":
            self._emit(USER if given(self.state) == "u" else ASSISTANT, text, given(self.state))

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """A conversation's head (place 0), then its rows in turn -> one row with the hash of the repaired text."""
    head, own, done, kind = None, None, [], None

    def made():
        cols = list(zip(*done, strict=True)) or [[]] * (len(_COUNTS) + 3)
        named = dict(zip(_COUNTS, (pa.array(c, pa.int64()) for c in cols[1:-2]), strict=True))
        return pa.record_batch({"conv_id": pa.array(cols[0], kind)} | named | {"audit": pa.array(cols[-2], pa.string()), "repaired_sha256": pa.array(cols[-1], pa.string())})

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for place, role, text, *stats in columns(batch, "place", "role", "text", "conv_id", *_COUNTS, "audit"):
            if place:
                own.row(role, text)
                continue
            if head is not None:
                done.append((*head, own.digest()))
            head, own = stats, Repaired(stats[-1])
        if done:
            yield made()
            done = []
    if head is not None:
        done.append((*head, own.digest()))
        yield made()


def repair(turns: DataFrame) -> DataFrame:
    """Damage ``turns`` (conv_id, turn, role, text) by rule, count faults, and repair each conversation at least cost:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space, null turns come first, a null conv_id is a conversation of its own. Ties of turn are
    taken by role, then text; repeated rows are duplicates. Roles that start with another letter than s, u or a can't be kept.
    A conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing. Other columns are
    ignored; an empty table gives an empty result. Texts may be of any length; a conversation's audit is one value.
    """
    bounded_batches(turns.sparkSession)
    rows = staged(faults(damaged(turns)), "repair-rows")
    known = turns.select("conv_id").distinct()
    found = signatures(rows.drop("text", "role")).withColumnRenamed("conv_id", "own")
    convs = known.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own").na.fill(0, list(_COUNTS[:-1])).na.fill("", ["signature"])
    heads = answered(convs)
    kinds = dict(heads.dtypes)
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = heads.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), *_COUNTS, "audit").unionByName(
        rows.select("conv_id", "place", "role", "text", *(empty(c) for c in (*_COUNTS, "audit")))
    )
    schema = f"conv_id {kinds['conv_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_apply, schema)


# -- the same by recursive SQL, one conversation at a time ----------------
def _plus(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_FAR = f"{{'c': {FAR >> 10}, 'a': ''}}"
_MORE = f"(CASE WHEN y = upper(y) THEN {CUT} ELSE 0 END)"


def _when(role: str, state: str) -> str:
    return f"CASE WHEN lower(y) = '{role}' THEN {_plus(state, _MORE, 'K')} ELSE {_FAR} END"


def _reroled(state: str) -> str:
    return f"CASE WHEN y <> 'x' THEN {_plus(state, f'{REROLE} + {_MORE}', 'R')} ELSE {_FAR} END"


_ROW = ", ".join(
    f"{_least(_plus(f's{k}', str(DELETE), 'D'), *more)} AS t{k}"
    for k, more in enumerate([[], [_when("s", "s0")], [f(*a) for x in ("s0", "s1", "s3") for f, a in ((_when, ("u", x)), (_reroled, (x,)))], [_when("a", "s2"), _reroled("s2")]])
)
_INSERTS = [_least("t2", *(_plus(f"t{k}", str(INSERT), "I") for k in (0, 1, 3))), _least("t3", _plus("u2", str(INSERT), "I"))]

ORACLE = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS key FROM conversations),
picked AS MATERIALIZED (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: cast(ascii(key[i]) AS bigint))),
 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {DAMAGE} AS pick FROM keyed, k),
dm AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN '{USER}' ELSE role END AS role, CASE pick WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN pick = 3 THEN 2 ELSE 1 END)) AS copy FROM picked WHERE pick <> 0),
nb AS MATERIALIZED (SELECT *, row_number() OVER own AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body, lag(role[1]) OVER own || role[1] AS pair
 FROM dm WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
fl AS MATERIALIZED (SELECT *, CASE WHEN ltrim(body, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM nb),
sg AS MATERIALIZED (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
 string_agg(CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE CASE WHEN fault = 't' THEN upper(r) ELSE r END END, '' ORDER BY place) AS sig FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS r FROM fl) GROUP BY conv_id),
dp AS (SELECT conv_id, sig, cast(0 AS bigint) AS i, {{'c': cast(0 AS bigint), 'a': cast('' AS varchar)}} AS s0, {{'c': cast({FAR >> 10} AS bigint), 'a': cast('' AS varchar)}} AS s1, {{'c': cast({INSERT} AS bigint), 'a': cast('I' AS varchar)}} AS s2, {{'c': cast({2 * INSERT} AS bigint), 'a': cast('II' AS varchar)}} AS s3 FROM sg
 UNION ALL SELECT conv_id, sig, i, t0, t1, u2, {_INSERTS[1]} FROM (SELECT *, {_INSERTS[0]} AS u2 FROM (SELECT conv_id, sig, i, {_ROW} FROM (SELECT conv_id, sig, i + 1 AS i, sig[i + 1] AS y, s0, s1, s2, s3 FROM dp WHERE i < len(sig))))),
an AS MATERIALIZED (SELECT conv_id, w.c AS cost, w.a AS audit FROM (SELECT conv_id, list_min([s0, s3]) AS w FROM dp WHERE i = len(sig))),
em AS (SELECT conv_id, audit, cast(0 AS bigint) AS p, cast(0 AS bigint) AS i, '' AS said, '' AS state FROM an
 UNION ALL SELECT e.conv_id, e.audit, e.p + 1, e.i + CASE WHEN e.audit[e.p + 1] = 'I' THEN 0 ELSE 1 END, e.audit[e.p + 1],
 CASE e.audit[e.p + 1] WHEN 'D' THEN e.state WHEN 'K' THEN f.role[1] ELSE CASE WHEN e.state = 'u' THEN 'a' ELSE 'u' END END FROM em e LEFT JOIN fl f ON f.conv_id = e.conv_id AND f.place = e.i + 1 WHERE e.p < len(e.audit)),
tx AS (SELECT em.conv_id, string_agg(CASE said WHEN 'K' THEN f.role ELSE CASE state WHEN 'u' THEN '{USER}' ELSE '{ASSISTANT}' END END || ':' || CASE said WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS text
 FROM em LEFT JOIN fl f ON f.conv_id = em.conv_id AND f.place = em.i AND said <> 'I' WHERE said NOT IN ('', 'D') GROUP BY em.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(tx.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sg USING (conv_id) LEFT JOIN an USING (conv_id) LEFT JOIN tx USING (conv_id)"""
