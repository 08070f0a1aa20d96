"""Messages and chat templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string>>"
#: Messages that call tools: arguments as JSON text.
CALLING = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
#: Fixed values of the published chat template.
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_BEFORE = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_AFTER = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'


def instruction_messages(instruction: Column, output: Column | None = None, system: str | None = None) -> Column:
    """System (if given), user and, for training, assistant."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = ([message("system", F.lit(system))] if system is not None else []) + [message("user", instruction)] + ([message("assistant", output)] if output is not None else [])
    return F.array(*parts)


def render(messages: Column, default_system: str = DEFAULT_SYSTEM, prompt: bool = False, tools: Column | None = None, calls: bool = False) -> Column:
    """The training text of messages: a system turn first (the default if there is none), tool turns in a row under one user turn; prompt adds the start of an answer.

    tools: array<string> of JSON signatures, told in the system turn where there are any. calls: messages are CALLING, and answers may call tools.
    """
    opening = F.try_element_at(messages, F.lit(1))
    own = F.coalesce(opening["role"], F.lit("")) == "system"
    told = F.lit(False) if tools is None else F.coalesce(F.size(tools) > 0, F.lit(False))
    said = F.when(own, opening["content"]).otherwise(F.lit(default_system))
    signatures = F.lit("") if tools is None else F.array_join(F.transform(tools, lambda x: F.concat(F.lit("\n"), x)), "")
    head = F.when(told, F.concat(F.lit("<|im_start|>system\n"), said, F.lit(TOOLS_BEFORE), signatures, F.lit(TOOLS_AFTER), F.lit("<|im_end|>\n"))).when(own, "").otherwise(f"<|im_start|>system\n{default_system}<|im_end|>\n")

    def turn(m: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(messages, i)["role"])
        after = F.try_element_at(messages, i + 2)["role"]
        tool = F.concat(
            F.when(F.coalesce(before, F.lit("")) != "tool", "<|im_start|>user").otherwise(""), F.lit("\n<tool_response>\n"), m["content"], F.lit("\n</tool_response>"),
            F.when(F.coalesce(after, F.lit("")) != "tool", "<|im_end|>\n").otherwise(""),
        )
        if calls:
            call = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
            content = F.coalesce(m["content"], F.lit(""))
            calling = F.concat(F.lit("<|im_start|>assistant"), F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(""), F.array_join(F.transform(m["tool_calls"], call), ""), F.lit("<|im_end|>\n"))
            special = F.when((m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), calling).when(told & own & (i == 0), "")
        else:
            special = F.when(told & own & (i == 0), "")
        return special.when(m["role"] == "tool", tool).when(m["role"].isin("system", "user", "assistant"), F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))).otherwise("")

    text = F.concat(head, F.array_join(F.transform(messages, turn), ""))
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if prompt else text


def response_spans(text: Column) -> Column:
    """What assistants say in a rendered text, for training on answers only."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)(?:<\|im_end\|>|$)"), F.lit(1))


def conversations(turns: Column) -> Column:
    """Messages in the order of turns, from array<struct<turn, role, content>>."""
    return F.transform(F.array_sort(turns), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
