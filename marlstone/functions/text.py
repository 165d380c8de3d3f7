"""Text functions as Column expressions: cleaning, predicates and scores of lines and code.

All stay inside the JVM. ``(?U)`` gives regex classes their Unicode meaning, ``(?d)`` makes ``\\n`` the only line end.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the line sanitiser knows by name or pattern (to SYMBOL_RUN).
PLACEHOLDERS = (
    r"%[dlu]",
    r"0x[0-9a-fA-F]+",
    r"(?U)^[\W\d_]+$",
    r"(.)\1{3,}",
    r"^[0-9]{8,}$",
    r"^[.%$#&*+=\-_]{3,}$",
    r"GCC:\s*\([^)]+\)\s*\d+\.\d+\.\d+",
    r"GCC:\s*\d+\.\d+\.\d+",
    r"GCC:.*?\d+\.\d+(?:\.\d+)*",
    r"^[a-zA-Z0-9]*[/~&@$>+=*\-;]+[a-zA-Z0-9]*$",
    r"[/~&@$>+=*\-;]{4,}",
)
SECTION_NAMES = (
    ".resources.dll", ".shstrtab", ".note.gnu.build-id", ".gnu.hash", ".gnu.version", ".gnu.version_r", ".rel.dyn", ".rel.plt", ".plt.got",
    ".eh_frame_hdr", ".eh_frame", ".init_array", ".fini_array", ".data.rel.ro", ".dynamic", ".got.plt", ".comment", ".note.ABI-tag",
)
SEQUENCES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LANGUAGES = (
    "Abkhazian", "Achinese", "Afrikaans", "Aragonese", "Old English", "Mapudungun", "Assamese", "Asturian", "Azerbaijani", "Balinese",
    "Belarusian", "Bulgarian", "Bhojpuri", "Buginese", "Chamorro", "Corsican", "Crimean Tatar", "Kashubian", "Church Slavic", "Lower Sorbian",
    "Dzongkha", "Esperanto", "Estonian", "Filipino", "Friulian", "Western Frisian", "Scottish Gaelic", "Galician", "Swiss German",
    "Gujarati", "Hiligaynon", "Hiri Motu", "Croatian", "Upper Sorbian", "Hungarian", "Armenian", "Interlingua", "Indonesian", "Interlingue",
    "Sichuan Yi", "Icelandic", "Inuktitut", "Japanese", "Javanese", "Georgian", "Kabardian", "Kuanyama", "Kalaallisut", "Central Khmer",
    "Kimbundu", "Kashmiri", "Letzeburgesch", "Limburgish", "Lithuanian", "Luba-Katanga", "Luba-Lulua", "Madurese", "Maithili", "Mandingo",
    "Malagasy", "Marshallese", "Minangkabau", "Macedonian", "Malayalam", "Mongolian", "Manipuri", "Moldavian", "Neapolitan", "Norwegian Bokmal",
    "North Ndebele", "Low Saxon", "Norwegian Nynorsk", "Norwegian", "South Ndebele", "Northern Sotho", "Nyamwezi", "Nyankole", "(Afan) Oromo",
    "Ossetian", "Pangasinan", "Pampanga", "Papiamento", "Portuguese", "Rajasthani", "Romanian", "Kinyarwanda", "Sanskrit", "Sardinian",
    "Sicilian", "Northern Sami", "Slovenian", "Southern Sami", "Lule Sami", "Inari Sami", "Skolt Sami", "Albanian", "Sundanese", "Tigrinya",
    "Setswana", "Tahitian", "Ukrainian", "Vietnamese", "Austrian", "English (British)", "Argentinian", "Spanish (Canary Islands)",
    "Brazilian Portuguese", "Chinese (simplified)", "Chinese (Hong Kong)", "Chinese (traditional)",
)
URLS = (r"https?://[^\s/$.?#].[^\s]*", r"ftp://[^\s/$.?#].[^\s]*", r"file://[^\s]*", r"www\.[^\s/$.?#].[^\s]*", r"[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?[/\s]")
PATHS = (
    r"^/(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+(?:\.[a-zA-Z0-9]+)?$",
    r"^[a-zA-Z]:\\(?:[a-zA-Z0-9_.-]+\\)*[a-zA-Z0-9_.-]+(?:\.[a-zA-Z0-9]+)?$",
    r"^\.{1,2}/(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+(?:\.[a-zA-Z0-9]+)?$",
    r"^(?:[a-zA-Z0-9_.-]+/)+[a-zA-Z0-9_.-]+\.[a-zA-Z0-9]+$",
    r"^(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+\.(?:py|js|java|cpp|c|txt|json|xml|html|css|md)$",
)
SPECIAL = r"\]\[%|/~&@$>+=*;\-<"
SYMBOL_RUN = r"[/~&@$>+=*\-|%;<]{3,}"
GIBBERISH = 0.65
ROOM_FOR_URLS = 100
COMMENTS = r'(?smd)("[^"\\]*+(?:\\.[^"\\]*+)*+")|/\*.*?\*/|//.*?$'  # possessive: literals of any length need no stack
LINE_COMMENTS = r"(?md)//.*$"
FENCE = "^[`json]+|[`json]+$"
EDGES = r"^_+|_+$|_{2,}"


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def non_blank_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda line: line.rlike(r"(?U)\S")))


def distinct_lines(c: Column) -> Column:
    """Stripped lines that are not blank, each at its first place."""
    return F.array_distinct(F.filter(F.transform(lines(c), strip), lambda line: line != ""))


def is_placeholder(c: Column) -> Column:
    return any_of(*[c.rlike(p) for p in PLACEHOLDERS])


def is_denied(c: Column) -> Column:
    """A language or section name."""
    return c.isin(*LANGUAGES, *SECTION_NAMES)


def has_sequence(c: Column) -> Column:
    return any_of(*[c.contains(s) for s in SEQUENCES])


def is_url(c: Column) -> Column:
    return strip(c).rlike("(?i)^(?:" + "|".join(URLS) + ")")


def is_path(c: Column) -> Column:
    return any_of(*[c.rlike(re.sub(r"(/|\\\\)\)([*+])", r"\1)\2+", p)) for p in PATHS])  # possessive: paths of any depth need no stack


def quality(c: Column) -> Column:
    """0 to 1: share of letters and digits, less special characters, cut down by runs of symbols; blank text: 1."""
    n = F.length(c)
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / n
    special = F.length(F.regexp_replace(c, f"[^{SPECIAL}]", "")) / n
    score = (alnum * 0.7 + (F.lit(1.0) - special) * 0.3) * F.when(c.rlike(SYMBOL_RUN), 0.3).otherwise(1.0)
    return F.when(strip(c) == "", 1.0).otherwise(score)


def strip_line_comments(c: Column) -> Column:
    """Without // comments (also those inside strings) and blank lines."""
    kept = F.filter(lines(F.regexp_replace(c, LINE_COMMENTS, "")), lambda line: line.rlike(r"(?U)\S"))
    return F.array_join(kept, "\n")


def strip_comments(c: Column) -> Column:
    """Without // and /* */ comments outside string literals; line ends stay."""
    return F.regexp_replace(c, COMMENTS, "$1")


def line_range(c: Column, start: int | Column, end: int | Column) -> Column:
    """Lines start up to end (from 0, end exclusive)."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.array_join(F.slice(lines(c), start + 1, F.greatest(end - start, F.lit(0))), "\n")


def clean_file_report(c: Column) -> Column:
    """Non-blank lines without what stands before their first colon."""
    return F.array_join(F.transform(F.filter(F.transform(lines(c), strip), lambda x: x != ""), lambda x: F.regexp_replace(x, r"^[^:]+:\s*", "")), "\n")


def without_last_field(c: Column) -> Column:
    """Comma-separated fields but the last."""
    f = F.split(c, ",", -1)
    return F.array_join(F.slice(f, F.lit(1), F.size(f) - 1), ",")


def head_and_tail(a: Column, n: int = 50) -> Column:
    """The first and last n of an array of more than 2 n, else all of it."""
    return F.when(F.size(a) > 2 * n, F.concat(F.slice(a, 1, n), F.slice(a, -n, n))).otherwise(a)


def compared_literal(c: Column) -> Column:
    """The literal of the first string comparison, in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(c, r'(?i)strcmp\([^,]+,\s*"([^"]+)"\)', 1))
    return F.when(found != "", found)


def unmask(code: Column, name: Column) -> Column:
    return F.replace(code, F.lit("[MASK]"), name)


def mask_first(code: Column, name: Column) -> Column:
    """The first place of name becomes [MASK]."""
    at = F.instr(code, name)
    masked = F.concat(F.substring(code, F.lit(1), at - 1), F.lit("[MASK]"), F.substring(code, at + F.length(name), F.length(code)))
    return F.when((at > 0) & (name != ""), masked).otherwise(code)


def mask_called_name(code: Column) -> Column:
    """In the first line, the first identifier before a parenthesis becomes [MASK]."""
    return F.regexp_replace(code, r"^([^\n]*?)\b([A-Za-z_]\w*)(\s*\()", "$1[MASK]$3")


def bin_name(path: Column) -> Column:
    """The last two parts of a path, without .json."""
    return F.replace(F.regexp_extract(path, r"([^/]+/[^/]+)/?$", 1), F.lit(".json"), F.lit(""))


def import_name(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def external_label(address: Column) -> Column:
    return F.format_string("EXT_%08x", address)


def strip_fence(c: Column) -> Column:
    """Without any of the characters ` j s o n at both ends, then back-ticks, then white space."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), FENCE, ""), "^`+|`+$", ""))


def canonical_name(c: Column) -> Column:
    """Stripped, lower case, runs of underscores (edge ones too) as a single one; null: empty."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), EDGES, "_")


def name_words(c: Column) -> Column:
    """Lower-case runs of letters, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))


def words(c: Column) -> Column:
    return F.split(strip(F.lower(c)), " ", -1)


def truth_name(c: Column) -> Column:
    """What stands after the last colon, without dots."""
    return strip(F.replace(F.element_at(F.split(strip(c), ":", -1), -1), F.lit("."), F.lit("")))


def predicted_name(c: Column) -> Column:
    """The name in a model's answer: first line, up to a dot, after the last colon, inside quotes or back-ticks, last word."""
    x = F.split_part(c, F.lit("\n"), F.lit(1))
    x = F.split_part(x, F.lit("."), F.lit(1))
    x = F.element_at(F.split(x, ":", -1), -1)
    for q in ('"', "`"):
        x = F.when(x.contains(q), F.split_part(x, F.lit(q), F.lit(2))).otherwise(x)
    x = strip(F.element_at(F.split(x, r"\.", -1), -1))
    return strip(F.element_at(F.split(x, " ", -1), -1))


def guarded_name(answer: Column, original: Column, most: int = 60) -> Column:
    """A normalised name that is overlong or missing gives way to the original; an empty original to a blank."""
    return F.when(original == "", " ").when(answer.isNull() | (F.length(answer) > most), original).otherwise(answer)


def clean_reply(c: Column) -> Column:
    return F.replace(strip(c), F.lit("assistant: "), F.lit(""))


def as_boolean(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))) == "true"


def verdict_of(reply: Column) -> Column:
    return F.lower(reply).contains("true")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sample_sentence(name: Column) -> Column:
    """The answer as training samples carry it."""
    return F.concat(F.lit("The predicted function name is: "), name, F.lit(". "))


def answer_sentence(name: Column) -> Column:
    """The answer as chat records carry it."""
    return F.concat(F.lit("The function name is: "), F.lower(name), F.lit("."))


def json_reply(reply: Column, key: str, close_quote: bool = True, drop_key: bool = True) -> Column:
    """A model's answer under ``key``: strict JSON, else the outermost braces as JSON, else their text, else the reply.

    A fallback text loses its braces and (with drop_key) the key; with close_quote it ends in a quote.
    """
    path = f"$.{key}"
    whole = F.when(F.try_parse_json(reply).isNotNull(), F.get_json_object(reply, path))
    braced = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    inner = F.when((braced != "") & F.try_parse_json(braced).isNotNull(), F.get_json_object(braced, path))
    text = strip(F.regexp_replace(strip(F.regexp_replace(braced, r"^\{+", "")), r"\}+$", ""))
    if drop_key:
        text = F.replace(text, F.lit(f'"{key}":'), F.lit(""))
    text = F.when(text.endswith('"'), text).otherwise(F.concat(text, F.lit('"'))) if close_quote else strip(text)
    bare = F.replace(reply, F.lit('{\n    "' + key + '":'), F.lit(""))
    return F.coalesce(whole, inner, F.when(braced != "", text), strip(bare) if close_quote else bare)
