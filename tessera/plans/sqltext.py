"""Render the text rule lists of ``tessera.functions.text`` as DuckDB SQL.

Used only by the oracle: the SQL twin applies the same ordered steps with
``regexp_replace(..., 'g')`` (RE2) and ``replace`` as Spark does with Java
regular expressions.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from tessera.functions import text as TX


def sql_str(s: str) -> str:
    """A DuckDB string expression equal to ``s`` (control characters via chr)."""
    parts, buf = [], []
    for ch in s:
        if ord(ch) < 32 or ord(ch) == 127:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str('^' + TX.WS + '+|' + TX.WS + '+\\z')}, '', 'g')"


def steps(expr: str, rule_steps: Iterable[TX.Step]) -> str:
    for s in rule_steps:
        if s.kind == "re":
            expr = f"regexp_replace({expr}, {sql_str(s.find)}, {sql_str(s.repl)}, 'g')"
        elif s.kind == "lit":
            expr = f"replace({expr}, {sql_str(s.find)}, {sql_str(s.repl)})"
        elif s.kind == "lower":
            expr = f"lower({expr})"
        elif s.kind == "strip":
            expr = strip_ws(expr)
        elif s.kind == "chop_comma":
            expr = f"regexp_replace({expr}, ',\\z', '')"
        else:
            raise ValueError(s.kind)
    return expr


def clean_article(expr: str, lower: bool = False) -> str:
    out = steps(expr, TX.LIGHT_STEPS)
    return f"lower({out})" if lower else out


def clean_hard(expr: str) -> str:
    return steps(expr, TX.HARD_STEPS)


def strip_title(expr: str, remove_section: bool = False) -> str:
    tmp = expr
    for m in TX.TITLE_MARKERS:
        tmp = f"replace({tmp}, {sql_str(m)}, '')"
    tmp = f"replace({tmp}, chr(160), ' ')"
    k = 2 if remove_section else 1
    parts = f"string_split({tmp}, '-')"
    kept = f"({parts})[1:greatest(len({parts}) - {k}, 0)]"
    joined = strip_ws(f"array_to_string(list_transform({kept}, lambda x: {strip_ws('x')}), ' ')")
    return f"(CASE WHEN contains({tmp}, '-') THEN {joined} ELSE {tmp} END)"


def str_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def ws_split(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {sql_str(TX.WS + '+')}), lambda x: x <> '')"


def tokens(expr: str, stop: Sequence[str] | None = None) -> str:
    stop = TX.stopwords() if stop is None else stop
    t = f"regexp_replace({expr}, {sql_str(TX.char_class(TX.ASCII_PUNCTUATION))}, '', 'g')"
    t = f"regexp_replace({t}, {sql_str('http' + TX.NOT_WS + '+' + TX.WS + '*')}, '', 'g')"
    case = "CASE " + " ".join(
        f"WHEN lower(t) = '{w}' THEN [substr(t, 1, {k}), substr(t, {k + 1})]" for w, k in TX.TREEBANK_SPLITS.items()
    ) + " ELSE [t] END"
    toks = f"flatten(list_transform({ws_split(t)}, lambda t: {case}))"
    return (f"list_filter({toks}, lambda x: regexp_full_match(x, '\\p{{L}}{{2,}}') "
            f"AND NOT list_contains({str_list(stop)}, x))")


def sentences(expr: str) -> str:
    return f"list_transform(list_filter(string_split({expr}, '.'), lambda x: x <> ''), lambda x: {strip_ws('x')})"


def first_words(expr: str, n: int) -> str:
    return f"array_to_string((string_split({expr}, ' '))[1:{n}], ' ')"
