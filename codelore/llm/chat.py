r"""Chat formatting by a finite-state machine over roles (operator 4, DataFrame functions only).

A declarative :class:`Template` names the marks around turns, the transitions between states for
every role, and the roles whose texts are trained on.  A conversation's turns, in order, become
segments ``(text, loss)``: mark, escaped text, mark; their concatenation is the formatted text.

The machine's step for a run of turns is a function from states to states, kept as an array with
the end state for every start state.  Such functions compose, so turns are first folded within
buckets of ``BUCKET`` turn numbers and the buckets' functions are then composed: a conversation
of any length is aggregated before its pieces meet in one row.

Control strings inside a text or role are escaped reversibly: a backslash is doubled, and one
backslash is put after the first character of a control string.  Unescaping reverses exactly
that, so marks in the formatted text are only those of the template.

Defined results: null texts and roles are empty; a role that the machine has no transition for,
or an order it does not allow, makes ``valid`` false, and the conversation is formatted all the
same; turns are ordered by (turn, role, text), so repeated rows are repeated turns; rows with a
null conversation id form one conversation; very long texts are formatted whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelore.llm.common import table

BUCKET = 64


@dataclasses.dataclass(frozen=True)
class Template:
    """Marks, control strings and the role machine of a chat format."""

    begin: str = "<s>"
    end: str = "</s>"
    open: str = "<|turn|>"
    separator: str = "<|text|>"
    close: str = "<|end|>"
    #: Further strings that must not appear verbatim in texts.
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)
    states: tuple[str, ...] = ("start", "told", "asked", "answered")
    #: (state, role) to state; what is missing rejects.
    transitions: dict = dataclasses.field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.open, self.separator, self.close, *self.reserved)

    def check(self) -> None:
        if any(len(c) < 2 or "\\" in c or any(c[0] in x[1:] for x in self.controls) for c in self.controls):
            raise ValueError("control strings need two characters, no backslash, and no control's first character inside")


def _openings(template: Template, escaped: bool) -> str:
    rest: dict[str, list[str]] = {}
    for control in template.controls:
        rest.setdefault(control[0], []).append(re.escape(control[1:]))
    slash = r"\\" if escaped else ""
    return "|".join([r"\\", *(f"{re.escape(first)}(?={slash}(?:{'|'.join(ends)}))" for first, ends in rest.items())])


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_openings(template, False)})", r"$1\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"({_openings(template, True)})\\", "$1")


def _machine(template: Template) -> tuple[Column, dict[str, int]]:
    """The transition table: row 0 for other roles, then one row per role; last state rejects."""
    index = {s: i for i, s in enumerate(template.states)}
    reject = len(index)
    roles = {r: i + 1 for i, r in enumerate(dict.fromkeys(r for _, r in template.transitions))}
    rows = [[reject] * (reject + 1)]
    for role in roles:
        rows.append([index[template.transitions[s, role]] if (s, role) in template.transitions else reject for s in template.states] + [reject])
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows]), roles


def _role_row(role: Column, roles: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, i in roles.items():
        out = F.when(role == F.lit(name), F.lit(i)).otherwise(out)
    return out


def format_conversations(
    df: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``valid``, ``segments`` and ``formatted``."""
    template.check()
    machine, roles = _machine(template)
    rows = df.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("_bucket", F.floor(F.col("turn") / bucket))
    identity = F.array(*[F.lit(i) for i in range(len(template.states) + 1)])
    folded = rows.groupBy("_conv", "_bucket").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select(
        "_conv",
        F.struct(
            F.col("_bucket").alias("at"),
            F.size("turns").cast("long").alias("n"),
            F.aggregate("turns", identity, lambda acc, t: F.transform(acc, lambda s: F.get(F.get(machine, _role_row(t["role"], roles)), s))).alias("step"),
            F.flatten(
                F.transform(
                    "turns",
                    lambda t: F.array(
                        F.struct(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.separator)).alias("text"), F.lit(False).alias("loss")),
                        F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
                        F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
                    ),
                )
            ).alias("segments"),
        ).alias("part"),
    )
    accepting = [template.states.index(s) for s in template.accepting]
    edge = lambda mark: F.array(F.struct(F.lit(mark).alias("text"), F.lit(False).alias("loss")))
    whole = folded.groupBy("_conv").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        F.col("_conv").alias(conv_col),
        F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n_turns"),
        F.aggregate("parts", F.lit(0), lambda state, p: F.get(p["step"], state)).isin(*accepting).alias("valid"),
        F.concat(edge(template.begin), F.flatten(F.col("parts.segments")), edge(template.end)).alias("segments"),
    )
    return whole.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    inner = F.substring(formatted, F.lit(len(template.begin) + 1), F.char_length(formatted) - len(template.begin) - len(template.end))
    turns = F.split(inner, re.escape(template.close))
    kept = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))
    bodies = F.transform(kept, lambda t: F.split(F.substring(t, F.lit(len(template.open) + 1), F.char_length(t)), re.escape(template.separator), 2))
    return F.transform(bodies, lambda b: F.struct(unescape(F.get(b, F.lit(0)), template).alias("role"), unescape(F.get(b, F.lit(1)), template).alias("text")))


def trained_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    done = format_conversations(rows.unionByName(extra)).select("conv_id", "valid", "formatted", read_turns(F.col("formatted")).alias("turns"), trained_text(F.col("segments")).alias("trained"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: Valid: an optional system turn, then user and assistant by turns, at least one user.
ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, 23 + length(role) + length(text)
      + len(regexp_extract_all(role || text, '\\|<s>|</s>|<\|turn\|>|<\|text\|>|<\|end\|>|\[INST\]|\[/INST\]')) as n
  from rows)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (7 + sum(n))::bigint as formatted_chars,
       regexp_matches(string_agg(role, ',' order by turn, role, text) || ',', '^(system,)?(user,assistant,)*(user,)?$')
         and bool_or(role = 'user') as valid
from sized group by conv_id
"""

QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLES = {"op4_chat_formatting": ORACLE}
