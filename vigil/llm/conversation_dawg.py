"""Conversation structure repair over a suffix-shared DAWG of role/fault signatures.

A conversation is the string of its rows' signatures: the role's initial and the first fault. Repair turns it, at the
least cost, into one whose initials match ``(s?(ua)+)?``. The cost-to-go from a row depends on the rest of the string
and on the state of that grammar only, so equal endings share one automaton node. Distinct signatures of all
conversations, read backwards and sorted over range partitions, visit the nodes of the minimised automaton depth first: a node's
costs and best edits are computed once for each grammar state, and a task holds one path of nodes at a time.

Long conversations are cut into pieces of ``PIECE`` rows, counted from the end. A piece's table of costs from state to
state joins it to the pieces behind it, so that no conversation's signature is one row or one task's state. Rows that
are equal in conversation, turn, role and text are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.rownumber import number_rows

PIECE = 4096          # rows of a conversation that one signature string covers, at most
INF = 1 << 40
#: grammar states: nothing yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
#: a user row leads to USER and is due everywhere but after a user row; an assistant row is due there
DUE = (USER, USER, ASSISTANT, USER)
#: costs of ending in each state: complete pairs or nothing at all; a state's inserts come on top
END = (0, INF, INF, 0)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
#: signatures: initial s, u, a or another, by fault: none, truncated, or one that must be deleted
PLAIN, CUT, GONE = "suax", "SUAX", "0123"
_KIND = {c: (i, f) for f, letters in enumerate((PLAIN, CUT, GONE)) for i, c in enumerate(letters)}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BLANK_TEXT = r"\A[\x20\x09-\x0D]*\z"
ENDED_TEXT = r"[.!?][\x20\x09-\x0D]*\z"

#: for each state, (cost, next state, letter, whether a row is used up)
Step = tuple[int, int, str, bool]


def with_inserts(steps: list[Step]) -> list[Step]:
    """The best step of each state if an empty row of the due role may come first. Two inserts lead back to the state
    after them, so two rounds settle the costs; a state's letters differ, so that ties go to the ASCII-least."""
    for _ in range(2):
        steps = [min(s, (INSERT + steps[DUE[q]][0], DUE[q], "I", False), key=lambda x: (x[0], x[2]))
                 if steps[DUE[q]][0] < INF else s for q, s in enumerate(steps)]
    return steps


def ending(costs: tuple[int, ...]) -> list[Step]:
    """The steps behind the last row, where state q ends at ``costs[q]``."""
    return with_inserts([(c, q, "", False) for q, c in enumerate(costs)])


def before(letter: str, after: list[Step]) -> list[Step]:
    """The steps of each state before a row of that signature, given those behind it."""
    initial, fault = _KIND[letter]
    extra = LEFT_TRUNCATED if fault == 1 else 0
    out = []
    for q in range(4):
        options: list[Step] = [(DELETE + after[q][0], q, "D", True)]
        if fault < 2:
            options.append((REROLE + extra + after[DUE[q]][0], DUE[q], "R", True))
            to = SYSTEM if initial == 0 and q == START else DUE[q] if initial == (1 if DUE[q] == USER else 2) else None
            if to is not None:
                options.append((extra + after[to][0], to, "K", True))
        best = min(options, key=lambda x: (x[0], x[2]))
        out.append((min(best[0], INF), *best[1:]))
    return with_inserts(out)


class Path:
    """The automaton's nodes from the end of a string to its first row; the next string reuses those of a shared ending."""

    def __init__(self) -> None:
        self.costs: tuple[int, ...] | None = None
        self.string = ""
        self.nodes: list[list[Step]] = []
        self.made = 0

    def go(self, backwards: str, costs: tuple[int, ...]) -> None:
        shared = 0
        if costs != self.costs:
            self.nodes = [ending(costs)]
        else:
            for a, b in zip(backwards, self.string):
                if a != b:
                    break
                shared += 1
            del self.nodes[shared + 1:]
        for letter in backwards[shared:]:
            self.nodes.append(before(letter, self.nodes[-1]))
        self.made += len(backwards) - shared
        self.string, self.costs = backwards, costs

    def edits(self, state: int) -> tuple[int, str, int]:
        """(cost, letters, state at the end) of the best edits from a state before the first row."""
        cost, letters, depth = self.nodes[-1][state][0], [], len(self.nodes) - 1
        while True:
            _, to, letter, used = self.nodes[depth][state]
            if not letter:
                return cost, "".join(letters), state
            letters.append(letter)
            state, depth = to, depth - used


def _over_paths(batches: Iterator[pa.RecordBatch], row, schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Each row (backwards, costs, ...) of sorted batches, by one path of nodes."""
    path = Path()
    for batch in batches:
        rows = [row(path, *values) for values in zip(*[c.to_pylist() for c in batch.columns])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


# ------------------------------------------------------------------ damage and faults

def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32(``conv_id:turn``) % 20 deals: 0 drops a row, 1
    empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it a user's. Nulls read as one space."""
    conv, turn = rows["conv_id"].cast("long"), rows["turn"].cast("long")
    code = F.crc32(F.concat(_space(conv), F.lit(":"), _space(turn)).cast("binary")) % 20
    base = rows.select(conv.alias("conv_id"), turn.alias("turn"), _space(rows["role"]).alias("role"),
                       _space(rows["text"]).alias("text"), code.alias("code"))
    return base.where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def placed_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies), equal ones counted, with ``place``, which rises in the order of all
    conversations: by turn (nulls first), ties by role, then text."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return materialize(once.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("place", F.monotonically_increasing_id()))


def faults(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, place, copies, initial, first, rest, at): a row's fault is the first of blank, duplicate (its role and
    text stand earlier in the conversation) and truncated; ``first`` is its first copy's, ``rest`` the other copies'.
    ``at`` counts the rows before it, of all conversations. A text's first place is joined on the place, which no two rows share."""
    narrow = placed.select("conv_id", "turn", "place", "copies", "role", F.sha2("text", 256).alias("digest"),
                           F.rlike("text", F.lit(BLANK_TEXT)).alias("blank"),
                           (~F.rlike("text", F.lit(ENDED_TEXT))).alias("open"))
    seen = (narrow.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
            .select("place", F.lit(True).alias("new")))
    marked = narrow.join(seen, "place", "left").select(
        "conv_id", "turn", "place", "copies", F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated").alias("first"),
        F.when(F.col("blank"), "blank").otherwise("duplicate").alias("rest"))
    return number_rows(marked, [F.col("place")], size="copies", out="at")


def _signature(fault: Column) -> Column:
    """A row's letter by initial and fault."""
    place = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(4)
    return F.when(fault.isin("blank", "duplicate"), F.substring(F.lit(GONE), place, F.lit(1))).when(
        fault == "truncated", F.substring(F.lit(CUT), place, F.lit(1))).otherwise(F.substring(F.lit(PLAIN), place, F.lit(1)))


def pieces(marked: DataFrame, piece: int) -> DataFrame:
    """(conv_id, back, place, inside, signature): the signature string of each piece of a conversation; ``back`` counts pieces
    from the end, ``place`` is its first row's, ``inside`` whether it begins behind that row's first copy. A group has
    ``piece`` rows at most."""
    ends = marked.groupBy("conv_id").agg(F.max(F.col("at") + F.col("copies")).alias("end")).withColumnRenamed("conv_id", "of")
    rows = marked.join(ends, F.col("conv_id").eqNullSafe(F.col("of"))).withColumns({
        "last": F.expr(f"(end - at - 1) div {piece}"), "least": F.expr(f"(end - at - copies) div {piece}")})
    # a run of copies may reach over several pieces: its part in each
    cut = rows.withColumn("back", F.explode(F.sequence("least", "last"))).withColumns({
        "a": F.greatest(F.col("at"), F.col("end") - (F.col("back") + 1) * piece),
        "b": F.least(F.col("at") + F.col("copies"), F.col("end") - F.col("back") * piece)})
    here = F.col("a") == F.col("at")
    letters = cut.select("conv_id", "back", "a", "place", (~here).alias("inside"), F.concat(
        F.when(here, _signature(F.col("first"))).otherwise(""),
        F.repeat(_signature(F.col("rest")), (F.col("b") - F.col("a") - F.when(here, 1).otherwise(0)).cast("int"))).alias("s"))
    in_order = F.array_sort(F.collect_list(F.struct("a", "s", "place", "inside")))
    return letters.groupBy("conv_id", "back").agg(in_order.alias("rows")).select(
        "conv_id", "back", F.col("rows")[0]["place"].alias("place"), F.col("rows")[0]["inside"].alias("inside"),
        F.array_join(F.col("rows.s"), "").alias("signature"))


# ------------------------------------------------------------------ the automaton

def _sorted_backwards(strings: DataFrame, *first: str) -> DataFrame:
    """Strings with a shared ending side by side, over range partitions."""
    return strings.repartitionByRange(*first, "backwards").sortWithinPartitions(*first, "backwards")


def state_tables(signatures: DataFrame) -> DataFrame:
    """(backwards, costs): for each distinct string, the cost from state i before it to state j behind it at 4 * i + j."""
    unit = [tuple(0 if i == j else INF for i in range(4)) for j in range(4)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [Path() for _ in unit]

        def row(_: Path, backwards: str) -> tuple:
            for p, costs in zip(paths, unit):
                p.go(backwards, costs)
            return backwards, [paths[j].nodes[-1][i][0] for i in range(4) for j in range(4)]
        return _over_paths(batches, row, [("backwards", pa.string()), ("costs", pa.list_(pa.int64()))])

    return _sorted_backwards(signatures.select("backwards").distinct()).mapInArrow(
        tables, "backwards string, costs array<bigint>")


def best_edits(signatures: DataFrame) -> DataFrame:
    """(backwards, ending, opens, edits): for each distinct string with the costs behind it, the best edits (cost
    within the string, letters, state at the end) from each state; from the first state only where ``opens`` (a conversation's first piece)."""
    kind = pa.struct([("cost", pa.int64()), ("letters", pa.string()), ("state", pa.int32())])

    def row(path: Path, ends: list[int], backwards: str, opens: bool) -> tuple:
        path.go(backwards, tuple(ends))
        found = [path.edits(q) for q in range(1 if opens else 4)]
        return ends, backwards, opens, [{"cost": c - ends[q], "letters": x, "state": q} for c, x, q in found]

    schema = [("ending", pa.list_(pa.int64())), ("backwards", pa.string()), ("opens", pa.bool_()), ("edits", pa.list_(kind))]
    strings = signatures.select("ending", "backwards", "opens").distinct()
    return _sorted_backwards(strings, "ending").mapInArrow(
        lambda batches: _over_paths(batches, row, schema),
        "ending array<bigint>, backwards string, opens boolean, edits array<struct<cost:bigint,letters:string,state:int>>")


def _with_endings(parts: DataFrame) -> DataFrame:
    """Each piece with ``ending``, the costs behind it: the last piece's are the grammar's, another's come from the
    tables of the pieces behind it. Only conversations of several pieces, a row a piece, are folded."""
    last = F.array(*[F.lit(c).cast("long") for c in END])
    several = parts.where("back > 0").select("conv_id").distinct().withColumnRenamed("conv_id", "of")
    many = parts.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    tables = state_tables(many)

    def fold(rows):
        import pandas as pd
        rows = rows.sort_values("back", ignore_index=True)
        costs, out = list(END), []
        for table in rows["costs"]:
            out.append(costs)
            # what all states pay alike does not change the choice, and cutting it lets more strings share their ends
            costs = [min(INF, min(int(table[4 * i + j]) + costs[j] for j in range(4))) for i in range(4)]
            costs = [c - min(costs) if c < INF else INF for c in costs]
        return pd.DataFrame({"conv_id": rows["conv_id"], "back": rows["back"], "ending": out})

    folded = many.join(tables, "backwards").select("conv_id", "back", "costs").groupBy("conv_id").applyInPandas(
        fold, "conv_id long, back long, ending array<bigint>")
    behind = folded.select(F.col("conv_id").alias("of"), F.col("back").alias("piece"), F.col("ending").alias("found")).where("piece > 0")
    return parts.join(behind, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("back") == F.col("piece")), "left").select(
        *parts.columns, F.coalesce("found", last).alias("ending"))


def _chosen(solved: DataFrame) -> DataFrame:
    """The edits of each piece from the state in which the pieces before it end."""
    one = solved.where("opens").withColumn("state", F.lit(START))
    rest = solved.where("not opens or back > 0")

    def follow(rows):
        import pandas as pd
        rows = rows.sort_values("back", ascending=False, ignore_index=True)
        state, out = START, []
        for ends in rows["ends"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"conv_id": rows["conv_id"], "back": rows["back"], "state": out})

    states = rest.select("conv_id", "back", F.col("edits.state").alias("ends")).groupBy("conv_id").applyInPandas(
        follow, "conv_id long, back long, state int")
    named = states.select(F.col("conv_id").alias("of"), F.col("back").alias("piece"), "state")
    later = solved.where("not opens").join(
        named, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("back") == F.col("piece"))).drop("of", "piece")
    return one.unionByName(later).withColumn("edit", F.get("edits", F.col("state"))).select(
        "conv_id", "back", "place", "inside", "signature", F.col("edit.letters").alias("letters"), F.col("edit.cost").alias("cost"))


# ------------------------------------------------------------------ results

class Rebuilt:
    """The hash of a repaired conversation, from its rows and letters as they come in order."""

    def __init__(self) -> None:
        self.sha, self.empty, self.state, self.letters, self.owed = hashlib.sha256(), True, START, [], 0

    def _put(self, role: str, text: str, state: int) -> None:
        self.sha.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty, self.state = False, state

    def _due(self) -> tuple[str, int]:
        to = DUE[self.state]
        return "user" if to == USER else "assistant", to

    def _inserts(self) -> None:
        """Letters that need no text: inserts, and the deletion of copies that are still to come."""
        while self.letters and (self.letters[-1] == "I" or self.owed):
            if self.letters.pop() == "I":
                role, to = self._due()
                self._put(role, "", to)
            else:
                self.owed -= 1

    def edits(self, letters: str) -> None:
        self.letters = list(letters[::-1]) + self.letters   # what is left stands last, as letters are popped
        self._inserts()

    def row(self, role: str, text: str, copies: int) -> None:
        letter = self.letters.pop()
        if letter == "K":
            self._put(role, text, SYSTEM if role[:1] == "s" else self._due()[1])
        elif letter == "R":
            due, to = self._due()
            self._put(due, text, to)
        self.owed = copies - 1
        self._inserts()


def repaired(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation that has rows. A hash covers a whole conversation, so its rows
    pass one task, in order, one at a time; nothing but a piece's letters is held."""
    rows = placed.select("conv_id", "place", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ahead"), "role", "text",
                         "copies").unionByName(
        chosen.select("conv_id", "place", F.when(F.col("inside"), 2).otherwise(0).alias("kind"), (-F.col("back")).alias("ahead"),
                      F.lit("").alias("role"), F.col("letters").alias("text"), F.lit(0).cast("long").alias("copies")))
    order = ["conv_id", "place", "kind", "ahead"]
    ordered = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "copies")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for conv, kind, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.sha.hexdigest()))
                    now, state = conv, Rebuilt()
                if kind == 1:
                    state.row(role, text, copies)
                else:
                    state.edits(text)
            yield _two(out)
            out = []
        if state is not None:
            yield _two([(now, state.sha.hexdigest())])

    def _two(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()),
                                           pa.array([h for _, h in found], pa.string())], ["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(hashes, "conv_id long, repaired_sha256 string")


def _illegal(chosen: DataFrame) -> DataFrame:
    """(conv_id, illegal): adjacent initials, inside pieces and over their borders, that the grammar has not side by side."""
    plain = F.translate("signature", CUT + GONE, PLAIN * 2)
    inside = chosen.withColumn("i", plain).select(
        "conv_id", "back", F.substring("i", 1, 1).alias("first"), F.substring("i", -1, 1).alias("last"),
        (F.length("i") - 1 - _legal_pairs(F.col("i"))).cast("long").alias("illegal"))
    ahead = inside.select(F.col("conv_id").alias("of"), (F.col("back") - 1).alias("behind"), F.col("last").alias("ahead"))
    over = inside.join(ahead, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("back") == F.col("behind")), "left")
    pair = F.concat("ahead", "first")
    return over.groupBy("conv_id").agg(F.sum(
        F.col("illegal") + F.when(pair.isNull() | pair.isin("su", "ua", "au"), 0).otherwise(1)).alias("illegal"))


def _legal_pairs(initials: Column) -> Column:
    """How often su, ua and au stand in a string, overlaps included."""
    def times(pair: str) -> Column:
        return (F.length(initials) - F.length(F.replace(initials, F.lit(pair), F.lit("")))) / len(pair)
    return times("su") + times("ua") + times("au")


def repair(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per distinct ``conv_id`` of ``conversations`` (conv_id, turn, role, text): (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256), after the damage of ``damaged``.

    The null conv_id is a conversation like others. Rows are taken by turn, nulls first; rows of one turn by role, then
    text; equal rows are copies that stand side by side. A null turn counts for no gap. Null roles and texts read as
    one space, so such a text is blank, and such a role no initial of the grammar. A conversation without rows after
    the damage has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Long texts are read
    whole. The audit of a conversation, a letter an edit, and its hash are single values of one row; other columns are
    not read, whatever their names.
    """
    placed = placed_rows(damaged(conversations))
    marked = faults(placed)
    parts = pieces(marked, piece).withColumn("backwards", F.reverse("signature"))
    tops = parts.groupBy("conv_id").agg(F.max("back").alias("top")).withColumnRenamed("conv_id", "of")
    parts = materialize(parts.join(tops, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn(
        "opens", F.col("back") == F.col("top")).drop("of", "top"))
    ended = materialize(_with_endings(parts))
    solved = materialize(ended.join(best_edits(ended), ["backwards", "ending", "opens"]))
    chosen = materialize(_chosen(solved))
    audits = chosen.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("ahead"), "letters"))),
                                 lambda x: x["letters"]), "").alias("audit"), F.sum("cost").alias("cost"))
    firsts, turns = F.col("first"), "decimal(38,0)"   # no difference of two longs overflows it
    turn = F.col("turn").cast(turns)
    counts = marked.groupBy("conv_id").agg(
        F.when(F.max(turn).isNotNull(), F.least(F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn"),
                                                F.lit((1 << 63) - 1).cast(turns))).alias("gaps"),
        F.sum(F.when(firsts == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(firsts == "duplicate", F.col("copies")).when(firsts == "blank", 0)
              .otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.when(firsts == "truncated", 1).otherwise(0)).alias("truncated"))
    out = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    for side, names in ((counts, ["gaps", "blank", "duplicate", "truncated"]), (_illegal(chosen), ["illegal"]),
                        (audits, ["audit", "cost"]), (repaired(placed, chosen), ["repaired_sha256"])):
        side = side.select(F.col("conv_id").alias("of"), *names)
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    whole = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        "conv_id", *[v.alias(c) for c, v in whole.items()],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
