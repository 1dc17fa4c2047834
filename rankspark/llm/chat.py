"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

The states are roles. Each line of a transcript is an observation: the speaker marker it
begins with ("User:", "### Assistant", "<|system|>"), the role field of its row if it is
the row's first line, whether it asks a question or gives standing instructions, and its
length. Transitions between rows and at markers are those of turns; within a row a line
mostly goes on with the line before. Viterbi gives the most likely roles of a whole
conversation, and each run of lines of a row with one role becomes one rendered turn.

Emissions and turn transitions are counted over all rows whose role is known.

Rows are numbered within their conversation by a range sort and prefix sums, and a
conversation is cut into runs of RUN rows by that number. The best paths through a run are a small
matrix; the matrices of a long conversation are chained first, which fixes the roles at
its runs' ends, and then each run is decoded on its own. No task holds more than one run.

Defined results: a null text is empty, and an empty row is one empty line. A null or
unknown role is recovered. Rows without a turn number all count; rows that repeat wholly, with their
turn number, count once, or all with merge_repeats=False, as in the registered query. Rows of one turn number are ordered by role and text; a
null turn comes last, a null conversation is one of its own.
An empty table gives an empty table. Only the four named columns are read, so no other
column's name can clash.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, cut

ROLES = ("system", "user", "assistant")
#: Names of speakers in role fields and at line starts.
SPEAKERS = {
    "system": ("system", "sys", "developer", "context"),
    "user": ("user", "human", "customer", "client", "prompter", "question", "instruction", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "agent", "answer", "response", "a"),
}
NAMES = {name: i for i, role in enumerate(ROLES) for name in SPEAKERS[role]}
_MARKER = re.compile(r"\s*(?:(?:#{1,6}\s*|\*\*\s*|<\|(?:im_start\|>)?\s*|\[\s*)([A-Za-z]+)\s*(?:\*\*|\|>|\])?\s*(?::(?:\*\*)?|>|$|(?<=[|\]>*])(?=\s|$))|([A-Za-z]+)\s*:)\s*")
_STANDING = re.compile(r"(?i)\b(?:you are|you must|always|never|your task|respond (?:only )?in|do not)\b")
#: A marker or role field names the right speaker so often; a line goes on so often.
TRUST, STAY = 0.98, 0.97
RUN = 4096
#: So many characters of a text take part in the sampled bounds of the range sort.
HEAD = 256
LOW = -1e300


def observe(line: str, first: bool) -> tuple[int, int, int]:
    """(role of the line's marker or -1, where the text after it starts, symbol of the rest)."""
    m = _MARKER.match(line)
    role = NAMES.get((m.group(1) or m.group(2)).lower(), -1) if m else -1
    at = m.end() if role >= 0 else 0
    n = len(line) - at
    symbol = (4 if "?" in line else 0) + (8 if _STANDING.search(line) else 0) + (0 if n < 80 else 1 if n < 200 else 2 if n < 600 else 3)
    return role, at, symbol + (16 if first else 0)


SYMBOLS = 32


def train(rows: DataFrame) -> dict:
    """Logs of turn transitions, of the first role and of emissions, from the rows whose
    role is known. Counts of 3 x 3 and 3 x 32 cells reach the driver."""
    known = rows.where("given >= 0").select("conv", "turn", "given", "text")

    def run(batches):
        for batch in batches:
            n: dict[tuple[int, int], int] = {}
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    key = role, observe(line, k == 0)[2]
                    n[key] = n.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["role", "symbol", "n"])

    emitted = known.select("given", "text").mapInArrow(run, "role int, symbol int, n bigint").groupBy("role", "symbol").agg(F.sum("n").alias("n")).collect()
    turns = known.select("conv", "turn", "given").distinct()
    after = turns.select(F.col("conv").alias("c"), (F.col("turn") - 1).alias("t"), F.col("given").alias("next"))
    moved = turns.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).groupBy("given", "next").count().collect()
    starts = turns.where("turn = 0").groupBy("given").count().collect()
    k = len(ROLES)
    emit = [[1.0] * SYMBOLS for _ in range(k)]
    for r in emitted:
        emit[r[0]][r[1]] += r[2]
    # a little weight for what no labelled row shows; without any, a question and its answer alternate
    move = [[0.1, 1.0, 0.5], [0.02, 0.2, 1.0], [0.02, 1.0, 0.2]]
    for r in moved:
        move[r[0]][r[1]] += r[2]
    start = [0.5, 1.0, 0.2]
    for r in starts:
        start[r[0]] += r[1]

    def logs(v):
        return [math.log(x / sum(v)) for x in v]

    return {"emit": [logs(v) for v in emit], "move": [logs(v) for v in move], "start": logs(start)}


def lines_of(model: dict, text: str | None, given: int):
    """(emissions of each role, whether a turn may begin, marker's end, line) of a row's lines."""
    yes, no = math.log(TRUST), math.log((1 - TRUST) / (len(ROLES) - 1))
    out = []
    for k, line in enumerate((text or "").split("\n")):
        marker, at, symbol = observe(line, k == 0)
        e = [model["emit"][s][symbol] for s in range(len(ROLES))]
        for named in (marker, given if k == 0 and marker < 0 else -1):
            if named >= 0:
                e = [v + (yes if s == named else no) for s, v in enumerate(e)]
        out.append((e, k == 0 or marker >= 0, at, line))
    return out


def _moves(model: dict, turn: bool, first: bool):
    if first:
        return [model["start"]] * len(ROLES)
    if turn:
        return model["move"]
    stay, go = math.log(STAY), math.log((1 - STAY) / (len(ROLES) - 1))
    return [[stay if a == b else go for b in range(len(ROLES))] for a in range(len(ROLES))]


def through(model: dict, observed: list, begins: bool) -> list[list[float]]:
    """Best log-likelihoods of a run from each role before it to each role at its end."""
    k = range(len(ROLES))
    best = [[0.0 if a == b else LOW for b in k] for a in k]
    for i, (e, turn, _, _) in enumerate(observed):
        m = _moves(model, turn, begins and i == 0)
        best = [[max(row[a] + m[a][b] for a in k) + e[b] for b in k] for row in best]
    return best


def decode(model: dict, observed: list, begins: bool, enter: int | None = None, leave: int | None = None) -> list[int]:
    """Most likely roles of a run's lines. enter, leave: roles before it and at its end, if fixed."""
    k = range(len(ROLES))
    score = [0.0 if enter is None or s == enter else LOW for s in k]
    back = []
    for i, (e, turn, _, _) in enumerate(observed):
        m = _moves(model, turn, begins and i == 0)
        came = [max(k, key=lambda a: score[a] + m[a][b]) for b in k]
        score = [score[came[b]] + m[came[b]][b] + e[b] for b in k]
        back.append(came)
    at = max(k, key=lambda s: score[s]) if leave is None else leave
    path = []
    for came in reversed(back):
        path.append(at)
        at = came[at]
    return path[::-1]


def chain(matrices: list[list[list[float]]]) -> list[int]:
    """The role at each run's end on the best path through all runs."""
    k = range(len(ROLES))
    score, back = [0.0] * len(ROLES), []
    for m in matrices:
        came = [max(k, key=lambda a: score[a] + m[a][b]) for b in k]
        score = [score[came[b]] + m[came[b]][b] for b in k]
        back.append(came)
    at, out = max(k, key=lambda s: score[s]), []
    for came in reversed(back):
        out.append(at)
        at = came[at]
    return out[::-1]


def render(role: str, content: str) -> str:
    return f"<|{role}|>\n{content}\n<|end|>"


def turns_of(observed: list, roles: list[int], rows: list[int]):
    """(row, part, role, content) of each run of a row's lines with one role."""
    part, held = 0, []
    for i, (_, _, at, line) in enumerate(observed):
        held.append(line[at:])
        ends = i + 1 == len(observed) or rows[i + 1] != rows[i]
        if ends or roles[i + 1] != roles[i]:
            yield rows[i], part, ROLES[roles[i]], "\n".join(held).strip()
            part, held = 0 if ends else part + 1, []


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, merge_repeats: bool = True) -> DataFrame:
    label = F.lower(F.trim(F.col(role_col)))
    given = F.coalesce(*[F.when(label.isin(*SPEAKERS[r]), F.lit(i)) for i, r in enumerate(ROLES)], F.lit(-1))
    at = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), given.alias("given"), F.col(text_col).alias("text"))
    # a row id deals equal rows to several ranges
    row = F.when(F.coalesce(F.length("text"), F.lit(0)) <= HEAD, F.monotonically_increasing_id() - (1 << 62)).otherwise(F.lit(0))
    if not merge_repeats:
        return at.withColumn("row", row)
    loose = at.where("turn is null").withColumn("row", row)
    return at.where("turn is not null").distinct().withColumn("row", F.lit(0).cast("long")).unionByName(loose)


def numbered(rows: DataFrame) -> DataFrame:
    """conv, turn, given, text, at (rows of a conversation are in its order), run, and long:
    whether the conversation has several runs."""
    order = [F.col("conv"), F.asc_nulls_last("turn"), F.col("given")]
    # a head sorts as its text does; a whole text that is another's head comes before it, as its row is negative
    ranged = rows.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(*order, "head", "row")
    table = cut(ranged.sortWithinPartitions(*order, "text").select("conv", "turn", "given", "text", F.monotonically_increasing_id().alias("at")), "turns")
    table = table.withColumn("part", F.shiftright("at", 33))
    whose = Window.partitionBy("conv")
    before = whose.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each conversation in each range
    spans = table.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = spans.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whose).alias("all")).where(F.col("all") > RUN)
    spans = spans.select(F.col("conv").alias("sc"), F.col("part").alias("sp"), (F.col("before") - F.col("first")).alias("shift"))
    # fewer than one for each RUN rows, and one for each range; a range bounds the rows of a pair
    placed = table.join(broadcast_if_small(cut(spans, "spans")), F.col("conv").eqNullSafe(F.col("sc")) & (F.col("part") == F.col("sp")), "left")
    run = F.expr(f"(at + shift) div {RUN}")
    return placed.select("conv", "turn", "given", "text", "at", F.coalesce(run, F.lit(0)).cast("long").alias("run"), F.col("shift").isNotNull().alias("long"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", merge_repeats: bool = True) -> DataFrame:
    """conv_id, turn, part, role, content and rendered of each recovered turn. merge_repeats: rows that
    repeat wholly, with their turn number, count once; without it every row counts."""
    bounded_batches(conversations.sparkSession)
    rows = numbered(_rows(conversations, conv_col, turn_col, role_col, text_col, merge_repeats))
    kind = conversations.schema[conv_col].dataType.simpleString()
    model = train(rows)

    def runs(batches, each):
        """Calls ``each`` with the rows of one run after another."""
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = row["conv"], row["run"]
                if held and now != key:
                    yield each(key, held)
                    held = []
                key = now
                held.append(row)
        if held:
            yield each(key, held)

    def summed(batches):
        def each(key, held):
            seen = [o for r in held for o in lines_of(model, r["text"], r["given"])]
            m = through(model, seen, key[1] == 0)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], conv_type), pa.array([key[1]], pa.int64()), pa.array([[v for a in m for v in a]], pa.list_(pa.float64()))], ["conv", "run", "m"])

        yield from runs(batches, each)

    def chained(batches):
        for batch in batches:
            convs, run, enter, leave = [], [], [], []
            for conv, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = chain([[s["m"][i : i + len(ROLES)] for i in range(0, len(s["m"]), len(ROLES))] for s in steps])
                convs += [conv] * len(ends)
                run += [s["run"] for s in steps]
                enter += [None, *ends[:-1]]
                leave += ends
            yield pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(run, pa.int64()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32())], ["fc", "fr", "enter", "leave"])

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(conversations.schema[conv_col].dataType)
    parts = rows.where("long").repartition("conv", "run").sortWithinPartitions("conv", "run", "at")
    matrices = parts.mapInArrow(summed, f"conv {kind}, run bigint, m array<double>")
    steps = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "m"))).alias("steps"))  # one small matrix for each RUN rows
    fixed = steps.mapInArrow(chained, f"fc {kind}, fr bigint, enter int, leave int")
    every = rows.join(broadcast_if_small(cut(fixed, "run-ends")), F.col("conv").eqNullSafe(F.col("fc")) & (F.col("run") == F.col("fr")), "left").drop("fc", "fr")
    every = every.repartition("conv", "run").sortWithinPartitions("conv", "run", "at")

    def decoded(batches):
        def each(key, held):
            seen, of = [], []
            for i, r in enumerate(held):
                got = lines_of(model, r["text"], r["given"])
                seen += got
                of += [i] * len(got)
            roles = decode(model, seen, held[0]["enter"] is None, held[0]["enter"], held[0]["leave"])
            return [(key[0], held[i]["turn"], part, role, content, render(role, content)) for i, part, role, content in turns_of(seen, roles, of)]

        out = []
        for found in runs(batches, each):
            out += found
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out):
        kinds = (conv_type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["conv", "turn", "part", "role", "content", "rendered"])

    return every.mapInArrow(decoded, f"conv {kind}, turn bigint, part int, role string, content string, rendered string").withColumnRenamed("conv", conv_col)
