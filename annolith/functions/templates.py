"""Chat templates as Column expressions: what a model's own template would make of a conversation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.functions.prompts import fallback_text
from annolith.functions.text import strip


@dataclass(frozen=True)
class ChatTemplate:
    """Text before the conversation, text around a turn of each role, and what asks for the next answer.

    A role without an entry makes the template fail, as a template that raises does; render() then falls back to plain text.
    """

    turns: dict[str, tuple[str, str]]
    start: str = ""
    answer: str = ""
    trim: bool = True
    aliases: dict[str, str] = field(default_factory=dict)


#: The marks of two wide-spread formats.
CHATML = ChatTemplate({r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}, answer="<|im_start|>assistant\n", trim=False)
INSTRUCT = ChatTemplate({"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}, start="<s>")
TEMPLATES = {"chatml": CHATML, "instruct": INSTRUCT}


def render_turn(template: ChatTemplate, role: Column, content: Column) -> Column:
    """One turn; NULL for a role that the template does not know or a turn without content."""
    text = strip(content) if template.trim else content
    out = F.lit(None).cast("string")
    for name, (before, after) in template.turns.items():
        known = [name, *(a for a, of in template.aliases.items() if of == name)]
        out = F.when(role.isin(known), F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def render(template: ChatTemplate | None, messages: Column, ask: bool = True) -> Column:
    """A conversation (array of role and content) as a prompt; plain ROLE: text blocks without a template, and where it fails or is blank."""
    plain = fallback_text(messages)
    if template is None:
        return plain
    turns = F.transform(messages, lambda m: render_turn(template, m.role, m.content))
    whole = F.concat(F.lit(template.start), F.array_join(turns, ""), F.lit(template.answer if ask else ""))
    usable = ~F.exists(turns, lambda t: t.isNull()) & (strip(whole) != "")
    return F.when(F.coalesce(usable, F.lit(False)), whole).otherwise(plain)
