"""Conversation columns: checks, token counts, role mapping, message arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from weftline import fixed_values as fixed
from weftline.functions.text import TokenCounter, is_sound_text, render, token_count, token_counts

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_payload(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def two_turns(prompt: Column, answer: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", answer))


def map_roles(source_turns: Column, mapping: dict[str, str] = fixed.SOURCE_ROLES) -> Column:
    """Messages of ``{from, value}`` turns; a role outside the mapping becomes null."""
    return F.transform(
        source_turns,
        lambda turn: F.struct(
            map_role(turn["from"], mapping).alias("role"), turn["value"].alias("content")
        ),
    )


def map_role(role: Column, mapping: dict[str, str] = fixed.SOURCE_ROLES) -> Column:
    mapped = F.lit(None).cast("string")
    for source, target in mapping.items():
        mapped = F.when(role == source, target).otherwise(mapped)
    return mapped


def roles_known(messages: Column) -> Column:
    return F.forall(messages, lambda m: m["role"].isNotNull())


def contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["content"])


def conversation_tokens(messages: Column, counter: TokenCounter | None = None) -> Column:
    counts = token_counts(contents(messages), counter)
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)


@dataclass(frozen=True)
class ChatTemplate:
    """How a trainer writes a chat as one text: ``start``, every turn with ``{role}`` and ``{content}``, ``end``.

    The default is the ChatML form.  ``roles`` renames roles, as for templates that call the assistant ``model``.
    """

    turn: str = "<|im_start|>{role}\n{content}<|im_end|>\n"
    start: str = ""
    end: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def text(self, messages: Column) -> Column:
        """The chat of an array of messages; null where a role or a content is."""
        names = dict(self.roles)

        def named(role: Column) -> Column:
            for old, new in names.items():
                role = F.when(role == old, new).otherwise(role)
            return role

        turns = F.transform(messages, lambda m: render(self.turn, role=named(m["role"]), content=m["content"]))
        whole = F.concat(F.lit(self.start), F.array_join(turns, ""), F.lit(self.end))
        return F.when(F.forall(turns, lambda t: t.isNotNull()), whole)


CHAT = ChatTemplate()


def chat_tokens(messages: Column, template: ChatTemplate = CHAT, counter: TokenCounter | None = None) -> Column:
    """Tokens of a whole chat, counted as the one text that a trainer sees, marks of the template included."""
    return token_count(template.text(messages), counter)


def free_of(text: Column, tokens: list[str] = fixed.BANNED_TOKENS) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | text.contains(token)
    return ~found


def no_banned_tokens(messages: Column, tokens: list[str] = fixed.BANNED_TOKENS) -> Column:
    return F.forall(messages, lambda m: free_of(m["content"], tokens))


def well_formed_messages(parsed: Column) -> Column:
    """Every entry has exactly the string fields ``role`` and ``content``."""

    def field_is_text(entry: Column, field: str) -> Column:
        kind = F.schema_of_variant(F.try_element_at(entry, F.lit(field)))
        return F.coalesce(kind == "STRING", F.lit(False))

    return parsed.isNotNull() & F.forall(
        parsed,
        lambda entry: F.coalesce(F.size(entry) == 2, F.lit(False))
        & field_is_text(entry, "role")
        & field_is_text(entry, "content"),
    )


def typed_messages(parsed: Column) -> Column:
    """Messages of a well-formed ARRAY<MAP<STRING, VARIANT>>."""

    def text(entry: Column, field: str) -> Column:
        return F.try_variant_get(F.try_element_at(entry, F.lit(field)), "$", "string").alias(field)

    return F.transform(parsed, lambda entry: F.struct(text(entry, "role"), text(entry, "content")))


def alternates(messages: Column) -> Column:
    """User and assistant take turns, the user begins, every content is sound text.

    A conversation without turns passes.
    """
    state = F.struct(F.lit(True).alias("ok"), F.lit("assistant").alias("last"))

    def step(acc: Column, turn: Column) -> Column:
        role = turn["role"]
        fits = role.isin("user", "assistant") & (role != acc["last"]) & is_sound_text(turn["content"])
        return F.struct(
            (acc["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"),
            F.coalesce(role, F.lit("")).alias("last"),
        )

    return messages.isNotNull() & F.aggregate(messages, state, step, lambda acc: acc["ok"])


def turns_match(first: Column, second: Column) -> Column:
    return F.size(first) == F.size(second)


def length_ratio_ok(
    original: Column,
    translated: Column,
    low: float = fixed.MIN_LENGTH_RATIO,
    high: float = fixed.MAX_LENGTH_RATIO,
    counter: TokenCounter | None = None,
) -> Column:
    """Every translated turn is ``low`` to ``high`` times as long as its original.

    Turns are paired as far as the shorter side goes; an original without tokens fails.
    """
    pairs = F.least(F.size(original), F.size(translated))

    def counts(messages: Column) -> Column:
        return F.slice(token_counts(contents(messages), counter), F.lit(1), pairs)

    def fits(before: Column, after: Column) -> Column:
        ratio = F.try_divide(after.cast("double"), before.cast("double"))
        return F.coalesce(ratio.between(low, high), F.lit(False))

    verdicts = F.zip_with(counts(original), counts(translated), fits)
    return F.forall(verdicts, lambda verdict: verdict)


def with_thinking(
    reasoning: Column,
    answer: Column,
    start: str = fixed.TRAIN_THINK_START,
    end: str = fixed.TRAIN_THINK_END,
) -> Column:
    return F.concat(F.lit(start + " "), reasoning, F.lit(" " + end + " "), answer)


def reasoning_system(
    start: str = fixed.TRAIN_THINK_START, end: str = fixed.TRAIN_THINK_END
) -> Column:
    return render(fixed.REASONING_SYSTEM, start=start, end=end)
