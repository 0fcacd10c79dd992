"""Text expressions: white space, literals, snippets, truncation, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as Python's str.split sees it; event patterns of the collect step
WHITE = r"(?U)[\s\x1c-\x1f]+"
GREETING = r"^(hi|hello|thanks|thank you|你好|您好|好的|收到|明白|嗯嗯|ok\b)"
DECISION = r"(决定|采用|改成|切换|方案|fix|修复|处理|实现|完成|done|resolved?)"
ERROR = r"(error|exception|traceback|failed|failure|bug|报错|错误|异常|失败|崩溃|panic|not found)"
QUESTION = r"(\?$|是否|要不要|需要|待确认|todo|待办|next)"
CODE = r"```[\s\S]+?```"
PATH = r"(?:(?:[A-Za-z]:)?[\\/][^\s'\"`]+|(?:\./|\.\./|~?/)?[\w.-]+(?:/[\w.-]+)+)"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f؜‎‏‪-‮⁦-⁩]"


def collapse(text: Column) -> Column:
    """White-space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def literal_pattern(literal: str) -> str:
    """Case-insensitive pattern of a literal; a quote end inside it is split."""
    return r"(?iu)\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def has_literal(text: Column, literal: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(literal_pattern(literal))), F.lit(False))


def find_literal(text: Column, literal: str) -> Column:
    """0-based position of the first occurrence in code points; null without one."""
    lead = F.regexp_extract(text, r"(?ius)^(.*?)\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E", 1)
    return F.when(has_literal(text, literal), F.length(lead))


def snippet(text: Column, literal: str, context: int = 48) -> Column:
    """The literal in bold with up to ``context`` characters on either side, ``...`` where cut."""
    at, n = find_literal(text, literal), len(literal)
    start = F.greatest(at - context, F.lit(0))
    end = F.least(at + n + context, F.length(text))
    return F.when(at.isNotNull(), F.concat(
        F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, at - start), F.lit("**"), F.substring(text, at + 1, F.lit(n)), F.lit("**"),
        F.substring(text, at + n + 1, end - at - n), F.when(end < F.length(text), "...").otherwise("")))


def clip(text: Column, limit: int, mark: str = "...", room: bool = True) -> Column:
    """At most ``limit`` characters; ``mark`` replaces what is cut, inside the limit with ``room``."""
    keep = limit - len(mark) if room else limit
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, keep)), F.lit(mark)))


def excerpt(text: Column, limit: int = 96) -> Column:
    return clip(collapse(text), limit, room=False)


def title(*candidates: Column, fallback: str = "Untitled Session") -> Column:
    """First candidate that is not blank, collapsed, at most 100 characters."""
    tidy = [F.nullif(F.substring(collapse(c), 1, 100), F.lit("")) for c in candidates]
    return F.coalesce(*tidy, F.lit(fallback))


# fixed values: short titles of tools by layout
TOOL_TITLES = {
    "codex": {"exec_command": "bash", "apply_patch": "patch", "patch": "patch", "subagent": "subagent"},
    "kimi": {"ReadFile": "read", "Glob": "glob", "StrReplaceFile": "edit", "Grep": "grep", "WriteFile": "write", "Shell": "bash"},
    "pi": {"bash": "bash", "edit": "edit", "grep": "grep", "read": "read", "write": "write"},
}


def tool_title(tool: Column, layout: str) -> Column:
    """Short title of a tool in a layout; others are called by their name."""
    known = TOOL_TITLES.get(layout, {})
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[tool], tool) if known else tool


def normal_path(path: Column, base: str = "/", home: str | None = None) -> Column:
    """An absolute path without ``.``, ``..`` and repeated separators; null for a blank one.

    A relative path is below ``base``; ``~`` at the beginning is ``home``.  Links
    are not followed: an expression cannot ask the file system."""
    given = F.trim(path)
    if home is not None:
        given = F.when((given == "~") | given.startswith("~/"), F.concat(F.lit(home), F.substring(given, 2, 1 << 30))).otherwise(given)
    whole = F.when(given.startswith("/"), given).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), given))
    # a fold over the segments with a stack
    step = lambda stack, x: F.when(x.isin("", "."), stack).when(x == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(x)))
    kept = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when(given != "", F.concat(F.lit("/"), F.array_join(kept, "/")))


def basename(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1), F.lit(""))


def body_text(text: Column) -> Column:
    """Without control and direction characters; tab and line end stay."""
    return F.regexp_replace(text, CONTROL, "")


def display_text(text: Column, limit: int = 500) -> Column:
    """One line of at most ``limit`` characters."""
    return clip(collapse(F.regexp_replace(text, CONTROL, " ")), limit, "…")


def distinct_folded(values: Column, limit: int) -> Column:
    """Distinct values by lower case in first-seen order and spelling, at most ``limit``."""
    step = lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda a: F.lower(a) == F.lower(x)), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(values, F.array().cast("array<string>"), step)


def find_paths(text: Column, limit: int = 6) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATH), F.lit(0))
    return distinct_folded(F.transform(found, lambda x: F.regexp_replace(x, r"^[.,:;)\]}]+|[.,:;)\]}]+$", "")), limit)


def event_kind(role: Column, text: Column) -> Column:
    """Kind of a collect event; null where the text says nothing."""
    tidy = collapse(text)
    like = lambda c, p: F.regexp_like(c, F.lit("(?i)" + p))
    return (
        F.when(tidy.isNull() | (tidy == "") | (like(tidy, GREETING) & (F.length(tidy) <= 60)), F.lit(None).cast("string"))
        .when(role == "user", "user_intent").when(like(text, CODE), "code").when(like(tidy, ERROR), "error")
        .when(like(tidy, QUESTION), "open_question").when(like(tidy, DECISION), "decision").when(role == "assistant", "assistant_key").otherwise("message")
    )


def safe_name(session_id: Column) -> Column:
    """File stem of a session: a portable id itself, else ``~`` and its SHA-256."""
    plain = F.regexp_like(session_id, F.lit(r"^[a-z0-9][a-z0-9._-]{0,119}$")) & ~F.regexp_like(session_id, F.lit(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)|\.$"))
    return F.when(plain, session_id).otherwise(F.concat(F.lit("~"), F.sha2(session_id.cast("binary"), 256)))
