"""Text rules as Column expressions.

Each cleaning rule set is *data*: an ordered list of steps.  ``apply_steps``
folds it into one nested Spark expression (a single projection inside
whole-stage codegen, no UDF); ``tessera.plans.sqltext`` renders the very same
list as DuckDB SQL for the oracle.

Regex dialects: the reference runs Python ``re`` with Unicode ``\\s \\w \\d``.
Java's and RE2's shorthand classes are ASCII, so every class is spelled out
(``WS``, ``WORD``, ``DIGIT`` below) and ``.`` is written ``[^\\n]``; case-free
brand words use explicit ``[bB]`` classes.  The same pattern text then means
the same thing in Spark and in DuckDB.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stopwords import LISTS

# ---------------------------------------------------------------- classes
# Python's Unicode whitespace (str.isspace), word and decimal-digit classes.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
ANY = r"[^\n]"  # Python's '.' without DOTALL
SENTENCE_MARK = "\ue000"  # private-use character marking sentence ends


def char_class(chars: str) -> str:
    """A regex class matching exactly the given characters (code-point escapes)."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in dict.fromkeys(chars)) + "]"


def nocase(word: str) -> str:
    """Case-free literal: letters become [xX] classes, '.' a wildcard."""
    out = []
    for c in word:
        if c.isalpha():
            out.append(f"[{c.lower()}{c.upper()}]")
        elif c == ".":
            out.append(ANY)
        elif c == " ":
            out.append(" ")
        else:
            out.append("\\" + c)
    return "".join(out)


# ---------------------------------------------------------------- fixed values
# Fixed values (reference semantics), in the reference's order.
# Symbols deleted by the light article cleaning:
LIGHT_DELETED_SYMBOLS = "–•™©®●▶\ufe0e►…\"$%&()*œ†¥+:;µ≤≥æ«‘π<=>[\\]^_`‚‘{|}~\\'"
# Python's string.punctuation (deleted by the hard cleaning and the tokenizer):
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Brand phrases removed (case-free) by the light cleaning; '.' is a wildcard:
LIGHT_BRAND_PHRASES = ("bild.de",)
LIGHT_BRAND_PHRASES_AFTER = ("bildplus", "bild plus", "mehr gleich bei bild.")
STANDARD_SITE = ("derStandard.at", "derStandard")
# Title markers removed before the section split:
TITLE_MARKERS = ("bild.de", "Bild.de", "*** BILDplus Inhalt ***")
# Extra stopwords added to the German list:
EXTRA_STOPWORDS = ("dass", "", "/t", "   ", "...", "worden", "jahren", "jahre", "jahr",
                   "heißt", "heißen", "müsse", "prozent", "BILD", "etwas")
# Treebank-style splits of run-together words (prefix length kept as first token):
TREEBANK_SPLITS = {"cannot": 3, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3}


# ---------------------------------------------------------------- steps
@dataclass(frozen=True)
class Step:
    kind: str            # "re" | "lit" | "lower" | "strip" | "chop_comma"
    find: str = ""
    repl: str = ""       # for "re": group refs written \1 (rendered $1 for Java)
    needs: str = ""      # for "re": what every match holds; Spark searches texts without it for nothing else


def _re(p: str, r: str = "", needs: str = "") -> Step:
    return Step("re", p, r, needs)


def _lit(a: str, b: str = "") -> Step:
    return Step("lit", a, b)


STRIP = Step("strip")

def light_steps(phrases: Sequence[str] = LIGHT_BRAND_PHRASES, phrases_after: Sequence[str] = LIGHT_BRAND_PHRASES_AFTER) -> tuple[Step, ...]:
    """The light cleaning's steps.  A site's own phrases (regular expressions, case-free) go before and
    after the standard site's name is unified; none may be given."""
    return (
        _re(r" \(" + DIGIT + r"+\)", needs=" ("),  # a bracketed number after a blank
        _re(DIGIT + r"+:+" + DIGIT + r"+-", needs=":"),  # two numbers with a colon, up to a hyphen
        _re(r"\(+" + DIGIT + r"+:+" + DIGIT + r"\)+", needs=":"),  # number, colon, one digit, bracketed
        _re(char_class(LIGHT_DELETED_SYMBOLS)),             # odd symbols
        *[_re(nocase(p)) for p in phrases],
        _re(nocase(STANDARD_SITE[0]), STANDARD_SITE[1]),
        *[_re(nocase(p)) for p in phrases_after],
        _re(DIGIT + "{1,2}" + ANY + DIGIT + "{1,2}" + ANY + DIGIT + "{4}"),  # dates
        _lit("!", "."),
        _lit("\n", ""),
        *[_lit(" " * n, " ") for n in range(3, 20)],        # 3..19 blanks, in turn
        _lit("...", "."),
        _re(WS + "+-", needs="-"),                         # blank(s) before a dash
        _re("http" + NOT_WS + "+" + WS + "*", needs="http"),  # URLs
        # '^$<digits>$' can never match: '$' is deleted above.
        _re(r"^[0-9]+(\.[0-9][0-9])?€", needs="€"),        # leading euro price
        _lit(" €", " EURO"),
        _lit(" £", " POUNDS"),
        _lit("“"), _lit("„"),
        _lit("\xa0"), _lit("\xad"), _lit("\u2005"),          # nbsp, soft hyphen, 1/4 em space
        _lit("\u2009", " "),                                # thin space
        _lit(" . ", ". "),
        _re("(" + WORD + "+)/(" + WORD + "+)", r"\1 \2", needs="/"),  # a slash between words
        _lit("\u27a1\ufe0f"),                               # arrow emoji
        _lit("  ", " "),
        _re(WS + "+", " "),
        STRIP,
        _lit("..", "."),
        Step("chop_comma"),
        STRIP,
    )


LIGHT_STEPS: tuple[Step, ...] = light_steps()

HARD_STEPS: tuple[Step, ...] = (
    Step("lower"),
    _re(char_class(ASCII_PUNCTUATION)),
    _re(DIGIT + ANY),                                  # a digit and the next char
    _lit("\n", ""),
    _lit(" " * 37, " "),
    _re("bild" + ANY + "de"),
    _lit("bildplus"),
    _lit("\u2009", " "),
    _re(WS + "–" + WS, " "),
    _re(DIGIT),
    # '...', ' -' and '. ' rules and the URL rule need '.' or '-': already deleted.
    _lit("„"), _lit("‚"),
    _lit("\xa0", " "),
    _lit("“"), _lit("\u2005"),
    _lit("  ", " "),
    STRIP,
)


def _java_repl(r: str) -> str:
    out, i = [], 0
    while i < len(r):
        if r[i] == "\\" and i + 1 < len(r) and r[i + 1].isdigit():
            out.append("$" + r[i + 1])
            i += 2
        elif r[i] in "$\\":
            out.append("\\" + r[i])
            i += 1
        else:
            out.append(r[i])
            i += 1
    return "".join(out)


# The characters of ``WS``.
WS_CHARS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _quick_class(chars: str) -> str:
    """``char_class`` for Java: a bit set decides on characters below 256, and one range test passes over
    most others."""
    low, high = [c for c in chars if ord(c) < 256], [c for c in chars if ord(c) >= 256]
    near = "".join(f"\\x{{{ord(c):X}}}" for c in low)
    far = f"[\\x{{{min(map(ord, high)):X}}}-\\x{{{max(map(ord, high)):X}}}&&{char_class(''.join(high))}]" if high else ""
    return f"[{near}{far}]"


# Patterns and replacements of the cleaning steps as Java's matcher runs through them fastest, with the same
# result.  The slash: what follows a word and is not yet part of a match, a second slash included, so that of
# a/b/c only the first goes; the letter beyond 16 bits makes the look back count whole characters.  The last:
# single blanks, which would be replaced by themselves, are no match.
_QUICK = {
    (char_class(LIGHT_DELETED_SYMBOLS), ""): (_quick_class(LIGHT_DELETED_SYMBOLS), ""),
    (WS + "+-", ""): (_quick_class(WS_CHARS) + "++-", ""),
    ("(" + WORD + "+)/(" + WORD + "+)", r"\1 \2"): ("/(?<=" + WORD[:-1] + "\U0001d400]/)(" + WORD + "++/?)", " $1"),
    (WS + "+", " "): (f" {_quick_class(WS_CHARS)}++|{_quick_class(WS_CHARS.replace(' ', ''))}{_quick_class(WS_CHARS)}*+", " "),
}


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def _where(c: Column, some: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that ``some`` picks, the others as they are.  The array of one is a name for
    ``c``, which is worked out once."""
    return F.transform(F.array(c), lambda x: F.when(some(x), change(x)).otherwise(x))[0]


def _replace(c: Column, s: Step) -> Column:
    pattern, repl = _QUICK.get((s.find, s.repl), (s.find, _java_repl(s.repl)))
    if not s.needs:
        return F.regexp_replace(c, pattern, repl)
    return _where(c, lambda x: F.contains(x, F.lit(s.needs)), lambda x: F.regexp_replace(x, pattern, repl))


def apply_steps(c: Column, steps: Iterable[Step]) -> Column:
    for s in steps:
        if s.kind == "re":
            c = _replace(c, s)
        elif s.kind == "lit":
            c = F.replace(c, F.lit(s.find), F.lit(s.repl))
        elif s.kind == "lower":
            c = F.lower(c)
        elif s.kind == "strip":
            c = strip_ws(c)
        elif s.kind == "chop_comma":
            c = _where(c, lambda x: F.endswith(x, F.lit(",")), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
        else:
            raise ValueError(s.kind)
    return c


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- P1-P5
def clean_article(c, lower: bool = False, steps: Sequence[Step] = LIGHT_STEPS) -> Column:
    """Light cleaning for sentence encoders (newer rule set); ``light_steps`` gives the steps for other
    sites' phrases."""
    out = apply_steps(_col(c), steps)
    return F.lower(out) if lower else out


def clean_hard(c, stemming: bool = False) -> Column:
    """Hard cleaning (lower case, no punctuation or digits)."""
    out = apply_steps(_col(c), HARD_STEPS)
    if stemming:
        out = F.array_join(F.transform(F.split(out, WS + "+", -1), light_stem), " ")
    return out


def remove_title_markers(c, markers: Sequence[str] = TITLE_MARKERS) -> Column:
    c = _col(c)
    for m in markers:
        c = F.replace(c, F.lit(m), F.lit(""))
    return F.replace(c, F.lit("\xa0"), F.lit(" "))


def strip_title(c, remove_section: bool = False, markers: Sequence[str] = TITLE_MARKERS) -> Column:
    """Drop the ' - Section - Site' suffix of an SEO title.

    Without any '-' the title is returned unchanged (after marker removal).
    """
    tmp = remove_title_markers(c, markers)
    drop = 2 if remove_section else 1
    parts = F.split(tmp, "-", -1)
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - drop, F.lit(0)))
    joined = strip_ws(F.array_join(F.transform(kept, strip_ws), " "))
    return F.when(F.contains(tmp, F.lit("-")), joined).otherwise(tmp)


def compose_text(seo_title, text, remove_section: bool = True, lower: bool = False) -> Column:
    """Stripped title + '. ' + body, then the light cleaning (null-propagating)."""
    return clean_article(F.concat(strip_title(seo_title, remove_section), F.lit(". "), _col(text)), lower)


def first_words(c, n: int) -> Column:
    """The first ``n`` blank-separated words (split on single blanks)."""
    return F.array_join(F.slice(F.split(_col(c), " ", -1), 1, n), " ")


def mix(headline, text=None, seo_title=None, n_words: int = 150, lower_strip: bool = False) -> Column:
    """P5: headline + ' ' + first ``n_words`` words of the text, or (with
    ``seo_title``) headline + ' ' + stripped title; ``lower_strip`` lower-cases
    the headline and deletes ASCII punctuation."""
    head = F.lower(_col(headline)) if lower_strip else _col(headline)
    tail = strip_title(seo_title) if seo_title is not None else first_words(text, n_words)
    out = F.concat(head, F.lit(" "), tail)
    if lower_strip:
        out = F.regexp_replace(out, char_class(ASCII_PUNCTUATION), "")
    return out


# ---------------------------------------------------------------- F1-F7
def sentences(c) -> Column:
    """split on '.', drop empty pieces, strip each (array)."""
    return F.transform(F.filter(F.split(_col(c), r"\.", -1), lambda x: x != ""), strip_ws)


def sentences_lang(c) -> Column:
    """F2 (approximation of a language-aware splitter): split after . ! ? + blanks."""
    marked = F.regexp_replace(_col(c), "([.!?])" + WS + "+", "$1" + SENTENCE_MARK)
    return F.filter(F.transform(F.split(marked, SENTENCE_MARK, -1), strip_ws), lambda x: x != "")


def ws_split(c) -> Column:
    """Python ``str.split()``: Unicode whitespace runs, no empty tokens."""
    return F.filter(F.split(_col(c), WS + "+", -1), lambda x: x != "")


@functools.lru_cache(maxsize=None)
def stopwords(language: str = "german", extra: tuple[str, ...] = EXTRA_STOPWORDS) -> tuple[str, ...]:
    """the stopword list of ``language`` plus ``extra``, sorted."""
    return tuple(sorted(set(LISTS[language]) | set(extra)))


def _treebank_split(tok: Column) -> Column:
    low = F.lower(tok)
    out = F.array(tok)
    for word, k in TREEBANK_SPLITS.items():
        out = F.when(low == word, F.array(F.substring(tok, 1, k), F.substring(tok, k + 1, 100))).otherwise(out)
    return out


def tokens(c, stop: Sequence[str] | None = None, stem: bool = False) -> Column:
    """word tokens of a text (array).

    ASCII punctuation deleted, 'http...' runs removed, whitespace tokens with
    the run-together splits of a Treebank tokenizer, then kept if alphabetic,
    at least two letters long and not a stopword (case-sensitive)."""
    stop = stopwords() if stop is None else tuple(stop)
    t = F.regexp_replace(_col(c), char_class(ASCII_PUNCTUATION), "")
    t = F.regexp_replace(t, "http" + NOT_WS + "+" + WS + "*", "")
    toks = F.flatten(F.transform(ws_split(t), _treebank_split))
    # ``isin`` over a literal list becomes a hash-set lookup (InSet)
    kept = F.filter(toks, lambda x: x.rlike(r"^\p{L}{2,}$") & ~x.isin(list(stop)))
    return F.transform(kept, light_stem) if stem else kept


def remove_stopwords(arr: Column, stop: Sequence[str] | None = None) -> Column:
    """drop every stopword token (the reference removes only one)."""
    stop = stopwords() if stop is None else tuple(stop)
    return F.filter(arr, lambda x: ~x.isin(list(stop)))


def ngrams(arr: Column, n: int = 2) -> Column:
    """contiguous n-grams joined by a blank (empty when too short).

    ``arr`` should be a column reference: a lambda re-evaluates a captured
    expression for every element."""
    if n == 1:
        return arr
    size = F.size(arr)
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(arr, i, n), " "))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams_upto(arr: Column, n: int = 2) -> Column:
    """Unigrams through n-grams, in that order (a 1..n n-gram range)."""
    return F.concat(arr, *[ngrams(arr, k) for k in range(2, n + 1)])


def vectorizer_tokens(c) -> Column:
    """Default tokenisation of a count vectoriser: lower case, runs of two or
    more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD + "{2,}"), 0)


# Light suffix stemmer (approximation of a German Snowball stemmer; not
# bit-equal, used only when asked for).
_STEM_SUFFIXES = ("ern", "em", "er", "en", "es", "e", "s")


def light_stem(w: Column) -> Column:
    low = F.lower(w)
    low = F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ä"), F.lit("a")), F.lit("ö"), F.lit("o"))
    low = F.replace(low, F.lit("ü"), F.lit("u"))
    return F.regexp_replace(low, "^(.{3,}?)(" + "|".join(_STEM_SUFFIXES) + ")$", "$1")


def join_words(arr: Column, sep: str = ", ", n: int | None = None) -> Column:
    """join (the first ``n``) words by ``sep``."""
    return F.array_join(F.slice(arr, 1, n) if n else arr, sep)
