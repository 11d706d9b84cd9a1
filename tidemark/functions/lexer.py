"""SQL text as tokens, and as a shape in which names and literals stand by their numbers: column expressions only.

One regular expression cuts a statement into tokens: literals, quoted names, numbers, words, operators; white space and
comments fall, what stands in ``/*! */`` counts. A shape is the tokens joined by single spaces, a literal as ``'i'`` and a
quoted name as ```i```, i being its place among the tokens. So patterns over a shape never look into a literal, a name or
a comment, and parentheses in it are real ones; ``said`` gives back the text. All repeats in the patterns are possessive:
they run in a loop, so that literals and lists of any length cost no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = r"'(?:[^'\\]++|''|\\[\s\S])*+'"
_PLAIN_LITERAL = r"'(?:[^']++|'')*+'"
_REST = (
    r"|\$\$(?:[^$]++|\$(?!\$))*+\$\$" r'|"(?:[^"]++|"")*+"' r"|`(?:[^`]++|``)*+`" r"|\d++(?:\.\d++)?+(?:[eE][+-]?\d++)?+\w*+" r"|[\p{L}_$@][\p{L}\p{N}_$@]*+" r"|<=>|<=|>=|<>|!=|:=|\|\||&&|::|[\s\S]"
)
_SKIPPED = r"\s++|/\*(?!!)(?:[^*]++|\*(?!/))*+\*/|--(?=\s|$)[^\n]*+|#[^\n]*+|/\*!\d*+|\*/"
#: A name in a shape, and one that may stand behind that of its database.
NAME = r"([^\s(),;.'=]+)"
QUALIFIED = rf"(?:{NAME} \. )?{NAME}"


def nested(depth: int = 12) -> str:
    """Pattern of a parenthesis in a shape with all that stands in it, ``depth`` levels deep at most."""
    inside = r"[^()]*+"
    for _ in range(depth):
        inside = rf"(?:[^()]++|\({inside}\))*+"
    return rf"\({inside}\)"


NESTED = nested()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(sql: Column, escapes: bool = True) -> Column:
    """Tokens of a statement; ``escapes`` tells whether a backslash does in literals."""
    pattern = rf"(?:{_SKIPPED})|({_LITERAL if escapes else _PLAIN_LITERAL}{_REST})"
    return F.filter(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(pattern), F.lit(1)), lambda t: t != "")


def unquoted(token: Column) -> Column:
    """A name or literal without its quotes."""

    def of(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        return F.when(quote.isin("'", "`", '"') & (F.length(t) > 1), F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.concat(quote, quote), quote)).otherwise(t)

    return let(token, of)


_ESCAPES = ((r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"), (r"(?<!\\)((?:\\\\)*+)\\t", "$1\t"), (r"(?<!\\)((?:\\\\)*+)\\r", "$1\r"), (r"\\([\s\S])", "$1"))


def literal_text(token: Column, escapes: bool = True) -> Column:
    """The value of a literal; of backslash escapes the usual ones."""

    def of(t: Column) -> Column:
        plain = t
        for pattern, to in _ESCAPES if escapes else ():
            plain = F.regexp_replace(plain, pattern, to)
        return F.when(t.contains("\\"), plain).otherwise(t)

    return let(unquoted(token), of)


def scanned(sql: Column, escapes: bool = True) -> Column:
    """toks, shape and use_db of a statement: a USE in front of it is taken off, and the last semicolon."""

    def after_use(toks: Column) -> Column:
        semi, n = F.array_position(toks, ";").cast("int"), F.size(toks)
        use = (F.upper(F.get(toks, F.lit(0))) == "USE") & (n > 1)
        rest = F.when(use & (semi > 0) & (semi < n), F.slice(toks, semi + 1, F.greatest(n - semi, F.lit(0)))).otherwise(toks)
        rest = F.when(F.element_at(F.concat(F.array(F.lit("")), rest), -1) == ";", F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        return F.struct(rest.alias("toks"), F.when(use, unquoted(F.get(toks, F.lit(1)))).otherwise(F.lit("")).alias("use_db"))

    def number(t: Column, i: Column) -> Column:
        first, place = F.substring(t, 1, 1), i.cast("string")
        return F.when((first == "'") | t.startswith("$$"), F.concat(F.lit("'"), place, F.lit("'"))).when(first.isin("`", '"'), F.concat(F.lit("`"), place, F.lit("`"))).otherwise(t)

    shaped = lambda s: F.struct(s["toks"].alias("toks"), s["use_db"].alias("use_db"), F.array_join(F.transform(s["toks"], number), " ").alias("shape"))
    return let(let(tokens(sql, escapes), after_use), shaped)


def said(part: Column, toks: Column) -> Column:
    """The token that a part of a shape stands for."""
    return let(part, lambda p: F.when(p.rlike(r"^['`]\d+['`]$"), F.get(toks, F.substr(p, F.lit(2), F.length(p) - 2).try_cast("int"))).otherwise(p))


def name_of(part: Column, toks: Column) -> Column:
    """The name that a part of a shape stands for, without quotes."""
    return unquoted(said(part, toks))


def text_of(shape: Column, toks: Column) -> Column:
    """A piece of a shape as SQL text again, with single spaces, none within its parentheses' edges and before commas."""
    tight = F.regexp_replace(F.regexp_replace(F.regexp_replace(shape, r"(?<![,=]) ?\( ", "("), r" (?=[),;])", ""), r" ?(\.|::) ?", "$1")
    pieces = F.regexp_extract_all(tight, F.lit(r"(['`]\d+['`]|[^'`]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: said(p, toks)), "")


def items(shape: Column) -> Column:
    """Items of a list, cut at commas that stand in no parenthesis."""
    found = F.regexp_extract_all(F.concat(shape, F.lit(" ,")), F.lit(rf"((?:[^(),]++|{NESTED})*+),"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def flat(shape: Column) -> Column:
    """A shape with ``()`` for all that stands in parentheses."""
    return F.regexp_replace(shape, NESTED, "()")


def whole(toks: Column, shape: Column) -> Column:
    """Whether a statement's quotes and parentheses all close."""
    return ~F.exists(toks, lambda t: t.isin("'", "`", '"')) & ~F.replace(flat(shape), F.lit("()"), F.lit("")).rlike("[()]")
