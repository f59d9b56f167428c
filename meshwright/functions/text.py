"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGE_BY_EXTENSION

# Tag rules, applied in this order, case-insensitively, anywhere in the text.
TAG_RULES = (
    ("auth", "authentication"),
    ("pay(ment)?|billing|invoice|checkout", "payments"),
    ("model|schema|entity|orm", "data-model"),
    ("test|spec", "test"),
    ("api|endpoint|route|handler|controller", "api"),
    ("db|database|repo|repositor", "database"),
    ("config|setting|env", "config"),
    ("util|helper|common|shared", "utility"),
    ("middleware|interceptor|filter|guard", "middleware"),
    ("migration", "migration"),
    ("queue|worker|job|task|celery", "async-worker"),
    ("cache|redis|memcache", "cache"),
    ("log|monitor|metric|trace|observ", "observability"),
)
# Question patterns by intent; the first intent with a match wins.
INTENT_RULES = {
    "path": (
        "how does .+ (reach|get to|flow (through|to|into))", "path (from|between) .+ (to|and)", "flow (from|through)", "trace .+ to",
    ),
    "impact": (
        "what (breaks|fails|changes) if", "what depends on", "(callers?|dependents?) of", "who (uses|calls|imports)",
        "impact of (changing|removing|modifying)",
    ),
    "structural": (
        "what (calls|imports|inherits|implements|extends)", "which (files?|classes?|functions?|methods?) (call|import|use|define)",
        "where is .+ (defined|implemented|declared)", "list (all )?(functions?|classes?|endpoints?|models?)",
        "show me (all )?(functions?|classes?|files?)", "find (all )?(functions?|classes?|files?) (that|where|with)",
    ),
}
CHARS_PER_TOKEN = {"claude": 3.5, "gpt": 4.0}
DEFAULT_CHARS_PER_TOKEN = 3.5
ELLIPSIS = "…"


def truncate(text: Column, limit: int = 512) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(text)


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def estimate_tokens(length: Column, model: Column | str | None = None) -> Column:
    """Tokens of a text of that many characters. Without a model at least 1; with one, none for an empty text."""
    if model is None:
        return F.greatest(F.lit(1), F.floor(length / DEFAULT_CHARS_PER_TOKEN).cast("int"))
    name = F.lower(F.coalesce(F.lit(model) if isinstance(model, str) else model, F.lit("")))
    ratio = F.lit(DEFAULT_CHARS_PER_TOKEN)
    for family, chars in reversed(CHARS_PER_TOKEN.items()):
        ratio = F.when(name.contains(family), chars).otherwise(ratio)
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / ratio).cast("int")))


def most_chars(budget: int, model: str) -> int:
    """The greatest length whose estimate for a model is within the budget; -1 if none is."""
    if budget < 1:
        return 0 if budget == 0 else -1
    ratio = next((chars for family, chars in CHARS_PER_TOKEN.items() if family in (model or "").lower()), DEFAULT_CHARS_PER_TOKEN)
    n = int((budget + 1) * ratio) + 1
    while n // ratio > budget:
        n -= 1
    return n


def extension(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty without one, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^.].*?(\.[^.]*)$", 1))


def language(extension_: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair))
    return F.coalesce(F.element_at(table, extension_), F.lit("unknown"))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 16)


def node_id(scope: Column, fqn: Column) -> Column:
    return short_hash(scope, fqn)


def edge_id(src: Column, edge_type: Column, dst: Column) -> Column:
    return short_hash(src, edge_type, dst)


def auto_tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){pattern}"), F.lit(tag)) for pattern, tag in TAG_RULES)))


def with_auto_tags(tags: Column, text: Column) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), auto_tags(text))


def importance(centrality: Column, change_frequency: Column) -> Column:
    return centrality * (1 + change_frequency)


def parse_list(text: Column) -> Column:
    """A JSON list of strings; what isn't one is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def last_segment(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def module_path(dotted: Column, suffix: str) -> Column:
    return F.concat(F.replace(dotted, F.lit("."), F.lit("/")), F.lit(suffix))


def embedding_document(node_type: Column, fqn: Column, docstring: Column, file_path: Column) -> Column:
    filled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat(node_type, F.lit(": "), fqn), filled("Doc: ", F.substring(docstring, 1, 300)), filled("File: ", file_path))


def intent(question: Column) -> Column:
    out = F.lit("semantic")
    for name, patterns in reversed(INTENT_RULES.items()):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | question.rlike(f"(?i){p}")
        out = F.when(hit, name).otherwise(out)
    return out


def symbol_candidates(question: Column) -> Column:
    """Words that look like symbols, then quoted strings, in order."""
    # Both patterns.
    words = F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-z]+[A-Za-z0-9]*|[a-z]+_[a-z_]+[a-z0-9]*)\b"), F.lit(1))
    quoted = F.regexp_extract_all(question, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    return F.concat(words, quoted)


def name_match(terms: Column, fqn: Column, name: Column) -> Column:
    """Share of the terms that stand in the lower-cased fqn and name; at most 1."""
    text = F.lower(F.concat_ws(" ", F.coalesce(fqn, F.lit("")), F.coalesce(name, F.lit(""))))
    hits = F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t))))
    return F.when(F.size(terms) > 0, F.least(F.lit(1.0), hits / F.size(terms))).otherwise(0.0)


def location(file_path: Column, start: Column, end: Column) -> Column:
    lines = F.when(F.coalesce(start, F.lit(0)) != 0, F.concat(F.lit(":"), start, F.when((F.coalesce(end, F.lit(0)) != 0) & (end != start), F.concat(F.lit("-"), end)).otherwise("")))
    return F.concat(F.coalesce(file_path, F.lit("")), F.coalesce(lines, F.lit("")))


def node_block(node_type: Column, fqn: Column, signature: Column, docstring: Column, file_path: Column, start: Column, end: Column, related: Column) -> Column:
    """One node as text; related is an array of (edge_type, dst_name), of which five are shown."""
    # The block's headings and marks.
    filled = lambda before, c, after: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))
    shown = F.transform(F.slice(related, 1, 5), lambda e: F.concat(F.lit("  - "), e.edge_type, F.lit(" → `"), e.dst_name, F.lit("`")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), node_type, F.lit(": `"), F.coalesce(fqn, F.lit("")), F.lit("`")),
        filled("**Signature:** `", truncate(signature, 150), "`"),
        filled("**Doc:** ", truncate(docstring, 300), ""),
        F.concat(F.lit("**File:** `"), location(file_path, start, end), F.lit("`")),
        F.when(F.size(related) > 0, F.concat(F.lit("**Relationships:**\n"), F.array_join(shown, "\n"))),
    )


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def span_text(file_path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", file_path, start, end)
