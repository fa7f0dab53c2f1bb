"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def token_estimate(chars: Column) -> Column:
    """Tokens of so many characters, four each, rounded up."""
    return F.ceil(chars / 4).cast("long")


def first_sentence(doc: Column, most: int = 100) -> Column:
    return truncate(F.element_at(F.split(collapse(doc), r"(?<=[.!?])\s"), 1), most)


def unquote(c: Column) -> Column:
    return F.regexp_extract(c, r"""^(['"`])(.*)\1$""", 2)


def reindent(c: Column) -> Column:
    """Lines without the indent that all filled ones share."""
    lines = F.split(c, "\n")
    widths = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    common = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, common + 1)), "\n")


def line_slice(c: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1."""
    return F.array_join(F.slice(F.split(c, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def external_name(qualifier: Column, name: Column) -> Column:
    return F.concat(F.coalesce(F.concat(qualifier, F.lit(".")), F.lit("")), name)


def relative_path(path: Column, root: str) -> Column:
    clean = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(base), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean)


def age(seconds: Column) -> Column:
    return (F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
            .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days ago"))))


def answer(reply: Column) -> Column:
    """What the last line that begins with ``ANSWER:`` says, else the whole reply."""
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*\**answer:"))
    return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), r"(?i)^\s*\**answer:\**", "")), reply)


def csv_field(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: Words of a request that name no code.
STOP_WORDS = frozenset(
    "the and for with that this from into when then than what which where while have has had are was were will would should could can not but all any each every some more most other such only own same "
    "too very just also about after before over under again further once here there why how both few add adds added change changes changed make makes made use uses used using fix fixes fixed update updates "
    "rename renames move moves remove removes delete deletes create creates new old code file files method methods function functions class classes field fields test tests call calls called return returns value values "
    "find show explain refactor implement support need needs want like don does done way work works which decide decides decided built build full empty give gives given get gets set sets let lets keep keeps "
    "directly method's class's code's main source tree repository instead without within based other".split()
)


def is_code(token: Column, called: Column | None = None) -> Column:
    """Whether a word looks like an identifier.

    It does with inner capitals, an underscore, a digit or a dollar sign; if it
    is a capitalised word of four letters or more, but no stop word; or if it is
    ``called``, that is, a parenthesis follows it somewhere. Single characters
    and words in capitals don't.
    """
    marked = token.rlike(r"[a-z][A-Z]|[_$0-9]")
    capital = (F.length(token) >= 4) & ~F.lower(token).isin(*sorted(STOP_WORDS))
    rest = F.lit(False) if called is None else ~token.rlike("^[A-Z]{2,}$") & called
    return (F.length(token) >= 2) & (marked | F.when(token.rlike("^[A-Z][a-z]+$"), capital).otherwise(rest))


def code_words(c: Column) -> Column:
    """How many words of a text look like identifiers, by :func:`is_code`; repeats count.

    A word is called if one of its occurrences has a parenthesis after it. Words
    are sorted, those before a parenthesis first among equal ones, so one pass
    knows that for all of them, and judges each distinct word once. Where nothing
    is called, words of small letters can't count and are passed over.
    """
    each = F.when(c.rlike(r"[A-Za-z0-9_$]\("), r"[A-Za-z0-9_$]{2,}\(?").otherwise(r"(?<![A-Za-z0-9_$])[a-z]*+[A-Z0-9_$][A-Za-z0-9_$]*+")
    found = F.transform(F.regexp_extract_all(c, each, F.lit(0)), lambda x: F.struct(F.rtrim(x, F.lit("(")).alias("word"), (~x.endswith("(")).alias("plain")))

    def step(s: Column, x: Column) -> Column:
        code = F.when(x["word"] == s["word"], s["code"]).otherwise(is_code(x["word"], ~x["plain"]))
        return F.struct(x["word"].alias("word"), code.alias("code"), (s["n"] + s["code"].cast("long")).alias("n"))

    none = F.struct(F.lit("").alias("word"), F.lit(False).alias("code"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(found), none, step, lambda s: s["n"] + s["code"].cast("long"))


#: What a signature of each kind says about its kind, and names of clients.
KIND_SAID = {"class": r"\b(class|record|struct)\b", "interface": r"\binterface\b", "enum": r"\benum\b", "type_alias": r"\b(type|delegate)\b", "type": r"\b(type|delegate)\b", "namespace": r"\b(namespace|package)\b", "function": r"\b(function|def)\b", "method": r"\bdef\b"}
CLIENTS = {"claude-code": "Claude Code", "Visual Studio Code": "Copilot", "Visual Studio Code - Insiders": "Copilot"}


def with_kind(kind: Column, signature: Column) -> Column:
    """The signature, after its kind unless it says that itself."""
    said = F.lit(False)
    for name, pattern in KIND_SAID.items():
        said = said | ((kind == name) & signature.rlike(pattern))
    return F.when(said, signature).otherwise(F.concat_ws(" ", kind, signature))


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def entry_header(kind: Column, name: Column, signature: Column, start: Column, end: Column, level: Column) -> Column:
    """The line of a packed entry: its lines, then the signature at levels 2 and 3, else kind and name."""
    return F.concat_ws(" ", line_range(start, end), F.when(level.isin(2, 3), with_kind(kind, signature)).otherwise(F.concat_ws(" ", kind, name)))


def entry_doc(doc: Column, most: int = 400) -> Column:
    return F.concat(F.lit("// "), truncate(collapse(F.coalesce(doc, F.lit(""))), most))


def qualified_prefix(qualified: Column, name: Column) -> Column:
    """What stands before the name in a qualified name; empty if nothing does."""
    return F.when(qualified.endswith(name), F.substr(qualified, F.lit(1), F.length(qualified) - F.length(name))).otherwise(F.lit(""))


def client_name(client: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CLIENTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, client), client)


def grouped(number: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(number, 0)
