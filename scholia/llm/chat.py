"""Chat transcripts: roles are recovered by a hidden Markov model over lines, then turns are rendered in one form.

A transcript is a sequence of lines. A line's features are its speaker marker (a role word with a colon, brackets or
hashes around it, or none), its length class and whether it ends with a question mark. The states are, for each role, the
first line of a turn, a further line, and a blank line; start, transition and emission counts are learned from labelled
lines (add-one smoothing) and the most probable states of a transcript come from Viterbi.

A transcript can be as long as the table. Lines are sorted by range, so a long one spans many tasks. Each task reduces
its range to a (max, +) matrix from the state of its first line to that of its last; one row a task is then solved in
order, which gives every range its end states, and each task traces its own states between them. The result is
a most probable path of each whole transcript, whatever the ranges.

Defined cases: null text is one empty line; null roles are not learned from and roles outside ROLES count as `user`;
null conv_id is one transcript; rows with equal places are ordered by their line; with nothing to learn from, all counts
are equal; of paths of equal probability any may be given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant", "tool")
KINDS = ("first", "further", "blank")
K = len(ROLES) * len(KINDS)
#: Words that mark a speaker.
WORDS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a"),
    "tool": ("tool", "function"),
}
_ANY = "|".join(w for ws in WORDS.values() for w in ws)
#: <|im_start|>user, <|user|>, [user], ### User:, **User:**, User:
MARKER = rf"(?i)^\s*(?:<\|(?:im_start\|>)?({_ANY})(?:\|>)?|\[({_ANY})\]:?|(?:#+ *|\*\*)?({_ANY})(?:\*\*)?:(?:\*\*)?)\s*"
N_SYMBOLS = (len(ROLES) + 1) * 4 * 2


def symbol(line: Column) -> Column:
    """The observation of a line, a number below N_SYMBOLS."""
    word = F.lower(F.concat(*[F.regexp_extract(line, MARKER, i) for i in (1, 2, 3)]))
    mark = F.lit(0)
    for i, role in enumerate(ROLES):
        mark = F.when(word.isin(*WORDS[role]), i + 1).otherwise(mark)
    n = F.length(F.trim(line))
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 200, 2).otherwise(3)
    return mark * 8 + size * 2 + F.rtrim(line).endswith("?").cast("int")


def state(role: Column, line: Column, place: Column) -> Column:
    """The labelled state of the line at a place (from 0) of a turn."""
    number = F.lit(ROLES.index("user"))
    for i, name in enumerate(ROLES):
        number = F.when(F.lower(role) == name, i).otherwise(number)
    kind = F.when(place == 0, 0).when(F.trim(line) == "", 2).otherwise(1)
    return number * len(KINDS) + kind


class Model:
    """Log probabilities: start[K], step[K, K], emit[K, N_SYMBOLS]."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        def logs(x: np.ndarray) -> np.ndarray:
            return np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))

        first = np.array([k % len(KINDS) == 0 for k in range(K)])
        self.start = np.where(first, logs(start), -1e6)
        self.step, self.emit = logs(step), logs(emit)


def fit(lines: DataFrame) -> Model:
    """Learn from lines (conv_id, turn, place, line, role): grouped counts, a row for each pair of states or symbol."""
    rows = lines.where("role is not null").select("conv_id", "turn", "place", symbol(F.col("line")).alias("o"), state(F.col("role"), F.col("line"), F.col("place")).alias("s"))
    emit, step, start = np.zeros((K, N_SYMBOLS)), np.zeros((K, K)), np.zeros(K)
    for r in rows.groupBy("s", "o").count().collect():  # at most K * N_SYMBOLS rows
        emit[r["s"], r["o"]] = r["count"]
    ahead = rows.select("conv_id", "turn", (F.col("place") - 1).alias("place"), F.col("s").alias("t"))
    inner = rows.join(ahead.hint("merge"), ["conv_id", "turn", "place"])
    last = rows.groupBy("conv_id", "turn").agg(F.max_by("s", "place").alias("s"), F.min_by("s", "place").alias("t"))
    after = last.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("t2"))
    outer = last.join(after.hint("merge"), ["conv_id", "turn"]).select("s", F.col("t2").alias("t"))
    for r in inner.select("s", "t").union(outer).groupBy("s", "t").count().collect():  # at most K * K rows
        step[r["s"], r["t"]] = r["count"]
    for r in last.groupBy("conv_id").agg(F.min_by("t", "turn").alias("t")).groupBy("t").count().collect():  # at most K rows
        start[r["t"]] = r["count"]
    return Model(start, step, emit)


def _inside(pdf: pd.DataFrame, m: Model) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each line its emission scores, and the step scores from the line before (None: a transcript starts)."""
    key, before = pdf["key"].to_numpy(), None
    for k, o in zip(key, pdf["o"].to_numpy(), strict=True):
        yield m.emit[:, o], (m.step if k == before else None)
        before = k


def transfer(pdf: pd.DataFrame, m: Model) -> np.ndarray:
    """Best score from each state of the range's first line to each of its last, both lines' emissions included."""
    score = None
    for emit, step in _inside(pdf, m):
        if score is None:
            score = np.where(np.eye(K, dtype=bool), emit[:, None], -np.inf)
        elif step is None:
            score = score.max(axis=1, keepdims=True) + m.start + emit
        else:
            score = (score[:, :, None] + step).max(axis=1) + emit
    return score


def trace(pdf: pd.DataFrame, m: Model, first: int, last: int) -> list[int]:
    """The best states of a range, given those of its first and last line."""
    score, back = None, []
    for emit, step in _inside(pdf, m):
        if score is None:
            score = np.full(K, -np.inf)
            score[first] = emit[first]
        elif step is None:
            back.append(np.full(K, int(score.argmax())))
            score = score.max() + m.start + emit
        else:
            through = score[:, None] + step
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + emit
    states = [last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def ends(pdf: pd.DataFrame, m: Model) -> pd.DataFrame:
    """(range, first, last) states from the ranges' matrices, in order; a row a range."""
    pdf = pdf.sort_values("range", ignore_index=True)
    score, links = None, []
    for i, r in enumerate(pdf.itertuples(index=False)):
        matrix = np.frombuffer(r.matrix).reshape(K, K)
        if score is not None and pdf["last_key"][i - 1] == r.first_key:
            through = score[:, None] + m.step
        else:
            through = (np.zeros(K) if score is None else score)[:, None] + m.start
        entry = through.max(axis=0)
        whole = entry[:, None] + matrix
        links.append((through.argmax(axis=0), whole.argmax(axis=0)))
        score = whole.max(axis=0)
    out, last = [], int(score.argmax())
    for number, (before, inner) in zip(reversed(pdf["range"].tolist()), reversed(links), strict=True):
        first = int(inner[last])
        out.append((number, first, last))
        last = int(before[first])
    return pd.DataFrame(out, columns=["range", "first", "last"])


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """lines (conv_id, place, line), place of any sortable type, with role, kind and turn_place: where its turn begins."""
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = lines.select("conv_id", "place", "line", key.alias("key"), symbol(F.col("line")).alias("o"))
    rows = rows.repartitionByRange(n, "key", "place").sortWithinPartitions("key", "place", "line")
    rows = common.materialise(rows.select(F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth"), "*"), "chat-lines")

    def reduce_range(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        return pd.DataFrame({"range": [pdf["range"].iloc[0]], "first_key": [pdf["key"].iloc[0]], "last_key": [pdf["key"].iloc[-1]], "matrix": [transfer(pdf, model).tobytes()]})

    reduced = rows.select("range", "nth", "key", "o").groupBy("range").applyInPandas(reduce_range, "range int, first_key string, last_key string, matrix binary")
    solved = common.materialise(reduced.groupBy().applyInPandas(lambda pdf: ends(pdf, model), "range int, first int, last int"), "chat-ranges")

    def decode(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("nth")
        return pd.DataFrame({"range": left["range"], "nth": left["nth"], "state": trace(left, model, int(right["first"].iloc[0]), int(right["last"].iloc[0])) if len(left) else []})

    states = rows.select("range", "nth", "key", "o").groupBy("range").cogroup(solved.groupBy("range")).applyInPandas(decode, "range int, nth long, state int")
    states = common.materialise(states, "chat-states")
    # a turn is named by its first line; a line before the first turn of its range belongs to the last of those before
    begins = states.where(f"state % {len(KINDS)} = 0")
    w = Window.orderBy("range")  # a row a range
    lasts = solved.select("range").join(begins.groupBy("range").agg(F.max("nth").alias("last")).hint("merge"), "range", "left")
    lasts = lasts.select("range", F.lag(F.last("last", ignorenulls=True).over(w)).over(w).alias("open"))
    inside = Window.partitionBy("range").orderBy("nth")
    own = F.last(F.when(F.col("state") % len(KINDS) == 0, F.col("nth")), ignorenulls=True).over(inside)
    states = states.withColumn("turn_nth", own).join(F.broadcast(lasts), "range")
    states = states.select("range", "nth", "state", F.coalesce("turn_nth", "open", "nth").alias("turn_nth"))
    named = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / len(KINDS)) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("state") % len(KINDS) + 1).cast("int"))
    out = rows.hint("merge").join(states, ["range", "nth"])
    return out.select("conv_id", "place", "line", named.alias("role"), kind.alias("kind"), "turn_nth")


def render(parsed: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, rendered, n_lines): a row for each turn, in the canonical form."""
    line = F.when(F.col("kind") == "first", F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    turns = parsed.withColumn("said", line).groupBy("conv_id", "turn_nth").agg(
        F.min("place").alias("place"), F.min_by("role", "place").alias("role"), F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("place", "said"))).alias("lines"),
    )
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["said"]), "\n"), F.lit("\n"))
    turns = turns.withColumn("text", text)
    return turns.select("conv_id", "place", "role", "text", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("rendered"), "n_lines")


def transcript(conversations: DataFrame) -> DataFrame:
    """Lines (conv_id, turn, place, line, role) of plain transcripts of conversations (conv_id, turn, role, text).

    Each conversation has one of four marker styles; in the last, a marker is written only in every other turn, and
    turns are parted by blank lines.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.coalesce(F.lower("role"), F.lit("user"))
    text = F.coalesce("text", F.lit(""))
    bare = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.initcap(role), F.lit(": "), text)).otherwise(text)
    whole = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": "), text))
        .when(style == 1, F.concat(F.lit("### "), F.when(role == "user", "Human").otherwise(F.initcap(role)), F.lit(":\n"), text))
        .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n"), text))
        .otherwise(F.concat(bare, F.lit("\n")))
    )
    return conversations.select("conv_id", "turn", "role", F.posexplode(F.split(whole, "\n")).alias("place", "line"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from plain transcripts of all conversations; learned from three quarters of them."""
    common.prepare(spark)
    lines = transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = fit(lines.where(F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)) != 2, F.lit(True))))
    parsed = parse(lines.select("conv_id", F.struct("turn", F.col("place").alias("line_no")).alias("place"), "line"), model)
    turns = render(parsed)
    return turns.select("conv_id", F.col("place.turn").alias("turn"), F.col("place.line_no").alias("line_no"), "role", "text", "rendered", "n_lines")
