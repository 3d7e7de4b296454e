"""Chat formatting: roles of a transcript's lines by a hidden Markov model (operator 5)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.storage import table

#: The last one stands for every other speaker (tools, narrators, speakers without a role).
ROLES = ("system", "user", "assistant", "other")
#: Hidden states: the first line of a turn of each role, then further lines.
STATES = tuple((r, begin) for begin in (True, False) for r in range(len(ROLES)))
#: Speaker markers by the role that they usually name.
MARKERS = {
    "system": ("system", "sys", "instructions", "context", "<|system|>", "### system"),
    "user": ("user", "human", "you", "q", "question", "customer", "prompt", "<|user|>", "### instruction", "[inst]"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "<|assistant|>", "### response", "[/inst]"),
    "other": ("tool", "function", "observation", "result", "narrator", "note", "speaker", "<|tool|>", "### tool"),
}
MARKER = re.compile(
    r"\s*(?:(?P<tag><\|\w+\|>|###\s*\w+:?|\[/?inst\])\s*|\**(?P<name>[A-Za-z][A-Za-z0-9 _]{0,19}?)\**\s*(?::|>)\**(?:\s+|$))", re.I
)
KNOWN = {m: k for k, role in enumerate(ROLES) for m in MARKERS[role]}
NONE, OTHER = len(ROLES), len(ROLES) + 1
#: Upper bounds of the bins of a line's length and of a block's (the lines up to the next blank one).
LINE_BINS = (0, 15, 30, 60, 90, 120, 160, 200, 260, 330)
BLOCK_BINS = (0, 40, 80, 120, 160, 200, 250, 300, 350, 400, 500, 700, 1000, 1400)
#: Numbers of values of a line's features: marker and place (first, behind a blank line, other) together, as a turn
#: needs a marker or a blank line to open; length, ending, opening; length and lines of the block that it opens.
PLACES = 3
SIZES = ((len(ROLES) + 2) * PLACES, len(LINE_BINS) + 1, 4, 3, len(BLOCK_BINS) + 2, 7)
#: Share of the conversations, by hash, that the model may be trained on, and most of them, those of least hash; the
#: others are held out.
SHARE, TRAINING = 0.2, 2000
#: Weights of the even distribution in the features of a line, but for its marker, and in the steps between states.
DOUBT, RARE = 0.02, 0.0003
END = "<|end|>"


def marker(line: str) -> tuple[int, int]:
    """(value, length): which role a line's speaker marker names, and how long it is."""
    m = MARKER.match(line)
    if not m:
        return NONE, 0
    name = re.sub(r"\s+", " ", (m["tag"] or m["name"]).lower()).rstrip(":").strip()
    if name in KNOWN:
        return KNOWN[name], m.end()
    return (OTHER, m.end()) if m["name"] and m["name"].istitle() and " " not in m["name"] else (NONE, 0)


def observe(lines: list[str]) -> np.ndarray:
    """The features of each line as small integers."""
    out = np.zeros((len(lines), len(SIZES)), int)
    found = [marker(line) for line in lines]
    rests = [line[size:].strip() for line, (_, size) in zip(lines, found, strict=True)]
    length = count = 0
    for k in range(len(lines) - 1, -1, -1):
        rest, blank = rests[k], not lines[k].strip()
        length, count = (0, 0) if blank else (length + len(rest), count + 1)
        opens = not blank and (k == 0 or not lines[k - 1].strip())
        out[k] = (
            found[k][0] * PLACES + (0 if k == 0 else 1 if opens else 2),
            bisect.bisect_left(LINE_BINS, len(rest)),
            0 if not rest else 1 if rest[-1] == "?" else 2 if rest[-1] in ".!:" else 3,
            0 if not rest else 1 if rest[0].isupper() else 2,
            1 + bisect.bisect_left(BLOCK_BINS, length) if opens else 0,
            min(count, 6) if opens else 0,
        )
    return out


class RoleModel:
    """Hidden Markov model whose states emit a line's features independently; add-one counts in logarithms."""

    def __init__(self):
        n = len(STATES)
        self.start = np.ones(n)
        self.step = np.full((n, n), 0.05)
        self.emit = [np.full((n, size), 0.05 if f else 0.0002) for f, size in enumerate(SIZES)]
        for k, (role, begin) in enumerate(STATES):  # markers open turns of the role that they name
            self.emit[0][k, [(role if begin else NONE) * PLACES + p for p in range(PLACES)]] += 2

    def fit(self, labelled: list[tuple[list[str], list[int]]]) -> RoleModel:
        """labelled: lines of a transcript and their states."""
        for lines, states in labelled:
            if not states:
                continue
            seen = observe(lines)
            self.start[states[0]] += 1
            for a, b in zip(states, states[1:], strict=False):
                self.step[a, b] += 1
            for f, counts in enumerate(self.emit):
                np.add.at(counts, (states, seen[:, f]), 1)
        self.start = np.log(self.start / self.start.sum())
        # further lines follow a turn of their own role only
        for k, (role, begin) in enumerate(STATES):
            if not begin:
                self.start[k] = -np.inf
                for j, (other, _) in enumerate(STATES):
                    if other != role:
                        self.step[j, k] = 0
        with np.errstate(divide="ignore"):
            allowed = self.step > 0
            even = allowed / allowed.sum(axis=1, keepdims=True)
            self.step = np.log((1 - RARE) * self.step / self.step.sum(axis=1, keepdims=True) + RARE * even)
        # a state that is seldom seen looks like lines in general, but for its marker
        general = [c.sum(axis=0) / c.sum() for c in self.emit]
        self.emit = [c + 5 * g if f else c for f, (c, g) in enumerate(zip(self.emit, general, strict=True))]
        shares = [c / c.sum(axis=1, keepdims=True) for c in self.emit]
        # a feature that was never seen with a state is a hint, no proof; a marker in the wrong place is one
        self.emit = [np.log((1 - DOUBT) * c + DOUBT / c.shape[1] if f else c) for f, c in enumerate(shares)]
        return self

    def decode(self, lines: list[str]) -> list[int]:
        """The likeliest states of lines (Viterbi)."""
        if not lines:
            return []
        seen = observe(lines)
        scores = sum(e[:, seen[:, f]].T for f, e in enumerate(self.emit))
        best, back = self.start + scores[0], []
        for row in scores[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        states = [int(best.argmax())]
        for pointer in reversed(back):
            states.append(int(pointer[states[-1]]))
        return states[::-1]

    def parse(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a transcript; markers go, lines within a turn stay."""
        lines = transcript.split("\n") if transcript else []
        turns: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.decode(lines), strict=True):
            role, begin = STATES[state]
            if begin or not turns:
                turns.append((ROLES[role], [line[marker(line)[1] :]]))
            else:
                turns[-1][1].append(line)
        return [(role, "\n".join(text).strip("\n")) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: each turn as <|role|>, its text and the end mark, a line each."""
    return "".join(f"<|{role}|>\n{text}\n{END}\n" for role, text in turns)


def parse_canonical(text: str) -> list[tuple[str, str]]:
    """The turns of what render gave, as long as no text holds the end mark on a line of its own."""
    return re.findall(rf"<\|(\w+)\|>\n(.*?)\n{re.escape(END)}\n", text, re.S)


#: Ways in which the query writes conversations as transcripts (marks of ROLES; between turns).
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: ", "\n"),
    ("System: ", "Human: ", "AI: ", "Observation: ", "\n\n"),
    ("Context: ", "Q: ", "A: ", "Note: ", "\n"),
    ("<|system|> ", "<|user|> ", "<|assistant|> ", "<|tool|> ", "\n"),
    ("### System: ", "### Instruction: ", "### Response: ", "### Tool: ", "\n\n"),
    ("", "", "", "", "\n\n"),
)


def transcribe(turns: list[tuple[str, str]], style: int) -> tuple[str, list[int]]:
    """A conversation as a transcript of one of the STYLES, and the states of its lines."""
    *marks, between = STYLES[style % len(STYLES)]
    lines: list[str] = []
    states: list[int] = []
    for role, text in turns:
        r = ROLES.index(role)
        own = (marks[r] + text).split("\n")
        if lines and between == "\n\n":
            lines.append("")
            states.append(states[-1] % len(ROLES) + len(ROLES))
        lines += own
        states += [r] + [r + len(ROLES)] * (len(own) - 1)
    return "\n".join(lines), states


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, style, trained, turns): the ordered turns of each conversation, its transcript's style and whether the
    model may be trained on it.

    Turns go by number, null first, then role and text.  A role that is none of ROLES, or null, is "other"; a null
    text is empty.  Each row without a conv_id is a conversation of its own, also where such rows are equal; they are not
    grouped.  A conversation is one document: its turns meet in one row.
    """
    role = F.coalesce(F.when(F.col("role").isin(*ROLES), F.col("role")), F.lit(ROLES[-1])).alias("role")
    rows = turns.select("conv_id", "turn", role, F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    grouped = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.withColumn("alone", F.lit(None).cast("long"))
    single = rows.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns"), F.xxhash64("turn", "role", "text").alias("alone"))
    mark = F.xxhash64("conv_id", "alone")
    return grouped.unionByName(single).select(
        "conv_id",
        F.pmod(mark, F.lit(len(STYLES))).cast("int").alias("style"),
        trained(mark).alias("trained"),
        F.expr("transform(turns, t -> struct(t.role, t.text))").alias("turns"),
    )


def trained(mark: Column) -> Column:
    """Whether a conversation's hash puts it among those that the model may see."""
    return F.pmod(F.xxhash64(mark, F.lit("training")), F.lit(1000)) < int(SHARE * 1000)


def sampled_turns(turns: DataFrame, most: int = TRAINING) -> DataFrame:
    """The rows of turns of the `most` conversations, of those that the model may see, of least hash.

    Only ids are sorted and sent around; the texts of other conversations are neither shuffled nor collected.
    """
    mark = F.xxhash64("conv_id", F.lit(None).cast("long"))
    seen = turns.where(F.col("conv_id").isNotNull() & trained(mark))
    keys = seen.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most)
    # at most `most` ids
    return seen.select("conv_id", "turn", "role", "text").join(F.broadcast(keys), "conv_id", "left_semi")


def _pairs(turns) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in turns]


def train_roles(turns: DataFrame, most: int = TRAINING) -> RoleModel:
    """The model of the transcripts of at most `most` conversations of turns (see sampled_turns).

    Each is seen in all styles; an empty sample leaves the model with what its markers say.
    """
    sample = conversations(sampled_turns(turns, most)).orderBy("conv_id").collect()
    labelled = []
    for row in sample:
        for style in range(len(STYLES)):
            text, states = transcribe(_pairs(row["turns"]), style)
            labelled.append((text.split("\n") if states else [], states))
    return RoleModel().fit(labelled)


def format_chats(transcripts: DataFrame, model: RoleModel, column: str = "transcript") -> DataFrame:
    """transcripts plus n_turns, roles and rendered, the canonical rendering; the column that was parsed goes.

    Row-local.  Defined results: a null or empty transcript has no turns and renders as empty text; a long transcript
    is one pass over its lines; repeated rows give repeated results; an empty table gives an empty one; columns pass
    unchanged whatever their names, but for those that have our names, which are replaced.  Of equally likely readings
    the one whose states come first counts.
    """

    @F.pandas_udf("n_turns long, roles string, rendered string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        found = [model.parse(t or "") for t in texts]
        rows = [(len(t), ",".join(r for r, _ in t), render(t)) for t in found]
        return pd.DataFrame(rows, columns=["n_turns", "roles", "rendered"])

    quoted = column.replace("`", "``")
    names = ("n_turns", "roles", "rendered")
    kept = [c for c in transcripts.columns if c not in (column, *names)]
    own = transcripts.select(*(F.col(f"`{c.replace('`', '``')}`") for c in kept), parsed(F.col(f"`{quoted}`")).alias("__parsed"))
    return own.withColumns({n: F.col("__parsed")[n] for n in names}).drop("__parsed")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as transcripts, parsed and rendered; right tells whether the turns came back, trained
    whether the model may have seen them."""
    turns = table(spark, sf_dir, "conversations")
    model = train_roles(turns)

    @F.pandas_udf("transcript string, truth string")
    def written(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for talks, styles in batches:
            told = [_pairs(t) for t in talks]
            yield pd.DataFrame(
                {
                    "transcript": [transcribe(t, s)[0] for t, s in zip(told, styles, strict=True)],
                    "truth": [render([(r, x.strip("\n")) for r, x in t]) for t in told],
                }
            )

    talks = conversations(turns).select("conv_id", "style", "trained", written("turns", "style").alias("w"))
    found = format_chats(talks.select("conv_id", "style", "trained", "w.transcript", "w.truth"), model)
    return found.withColumn("right", F.col("rendered") == F.col("truth")).drop("truth")
