"""Column functions on text: normal forms, patterns, money and dates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, Portuguese month names.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def normal_form(text: Column) -> Column:
    """Lower case, plain letters, single blanks: what matching compares."""
    return strip_accents(F.lower(collapse_blanks(text)))


def similarity_key(text: Column) -> Column:
    """The normal form with every digit as '#'."""
    return F.regexp_replace(normal_form(text), "[0-9]", "#")


def join_spaced_letters(text: Column) -> Column:
    """'P O D E R' -> 'PODER': blanks go between single letters."""
    return F.regexp_replace(text, r"(?<=(?<!\p{L})\p{L}) (?=\p{L}(?!\p{L}))", "")


def token_pattern(text: Column) -> Column:
    """One sign for each token: N with a digit, 1 of one character, W otherwise.
    Replacements over the whole line, each in one pass: runs without digits, digits,
    tokens that hold one, and what is left alone. A function of each token costs more."""
    rest = F.translate(text, "\x01\x02\x04", "...")
    blank = r" \t\r\n"
    for pattern, sign in ((f"[^{blank}0-9]{{2,}}+", "\x02"), ("[0-9]++", "\x01"), (f"[^{blank}\x01]*+\x01[^{blank}]*+", "\x04"), (f"[^{blank}\x02\x04]", "1")):
        rest = F.regexp_replace(rest, pattern, sign)
    return F.translate(rest, "\x02\x04 \t\r\n", "WN")


def longest_token(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, " "), lambda t: F.length(t))), F.lit(0))


def parse_money(text: Column) -> Column:
    """'R$ 1.234,50' -> 1234.50 as decimal(18,2); null when it is no amount."""
    digits = F.regexp_extract(text, r"([0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+),([0-9]{2})", 0)
    return F.when(digits != "", F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")).cast("decimal(18,2)")


def format_money(value: Column) -> Column:
    """1234.5 -> 'R$ 1.234,50'."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,"))


def parse_date(text: Column) -> Column:
    """'5/3/2024', '2024-03-05' and '5 de março de 2024' as dates, else null."""
    slash = F.regexp_extract(text, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 0)
    iso = F.regexp_extract(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    words = r"([0-9]{1,2}) de (\p{L}+) de ([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, words, 2)))
    spoken = F.when(month > 0, F.concat_ws("-", F.regexp_extract(text, words, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, words, 1), 2, "0")))
    return F.coalesce(F.try_to_date(F.when(slash != "", slash), "d/M/yyyy"), F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), F.try_to_date(spoken, "yyyy-MM-dd"))


def spoken_date(day: Column) -> Column:
    """A date as '5 de março de 2024'."""
    return F.concat(F.dayofmonth(day), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.lit(" de "), F.year(day))


def _bases() -> tuple[str, str]:
    """Characters that decompose into one base and marks, and those bases."""
    found = {}
    for i in range(0x80, 0x10000):
        whole = unicodedata.normalize("NFD", chr(i))
        plain = [c for c in whole if unicodedata.category(c) != "Mn"]
        if len(whole) > 1 and len(plain) == 1 and not 0xD800 <= i < 0xE000:
            found[chr(i)] = unicodedata.normalize("NFC", plain[0])
    return "".join(found), "".join(found.values())


MARKED, BASES = _bases()
#: What single letters may be spaced out with, as a class of a pattern.
JOINS = r"[\p{L}\p{Nd}$/.,\-\u2013\u00AA\u00BA\u00B0]"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_marks(text: Column) -> Column:
    """Letters without their accents and other marks, by canonical decomposition. Texts of
    as many bytes as characters have none."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(text, MARKED, BASES), r"\p{Mn}+", ""))


def spaced_letters_joined(text: Column) -> Column:
    """'P O D E R  X' -> 'PODER X': single characters one blank apart belong together."""
    return squeeze(F.regexp_replace(text, rf"(?<=(?<!\S){JOINS}) (?={JOINS}(?!\S))", ""))


def match_form(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(without_marks(spaced_letters_joined(text))), r"[^a-z0-9\s/\-.]+", " "))


def hash_form(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"\p{C}+", " "))


def digits_hidden(text: Column) -> Column:
    """Lower case with each digit as '#'; accents stay."""
    return F.regexp_replace(F.lower(squeeze(text)), "[0-9]", "#")


def table_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9]+", " "))


def name_key(text: Column) -> Column:
    return squeeze(F.upper(F.regexp_replace(without_marks(text), "[^A-Za-z0-9 ]+", " ")))


def letters_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(without_marks(text)), "[^a-z]+", "")


def title_key(text: Column) -> Column:
    """Letters and digits, accents kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "")


def undoubled(text: Column) -> Column:
    """'VVAALLOORR' -> 'VALOR' where at least three pairs, and 70 % of all, are equal."""
    half = F.length(text) / 2
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), half.cast("int") - 1))
    equal = F.size(F.filter(pairs, lambda i: text.substr(2 * i + 1, F.lit(1)) == text.substr(2 * i + 2, F.lit(1))))
    kept = F.array_join(F.transform(pairs, lambda i: text.substr(2 * i + 1, F.lit(1))), "")
    return F.when((F.length(text) >= 4) & (F.length(text) % 2 == 0) & (equal >= F.greatest(F.lit(3), F.ceil(half * 0.7))), kept).otherwise(text)


def spaces_mended(text: Column) -> Column:
    """A blank after , : ; and ), before (, and between letters and digits."""
    for pattern in (r"(?<=[,:;])(?=\S)", r"(?<=\))(?=\S)", r"(?<=\S)(?=\()", "(?<=[A-Za-z\u00C0-\u00FF])(?=[0-9])", "(?<=[0-9])(?=[A-Za-z\u00C0-\u00FF])"):
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


def cut_at(text: Column, keywords: list[str]) -> Column:
    """Up to the first keyword that does not begin the text, without what trails it."""
    places = [F.when(F.locate(k, F.lower(text)) > 1, F.locate(k, F.lower(text))) for k in keywords]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.regexp_replace(F.when(first.isNotNull(), text.substr(F.lit(1), first - 1)).otherwise(text), r"[\s,;.\-\u2013]+$", "")


def snippet(text: Column, at: Column, before: int = 40, most: int = 160) -> Column:
    """What stands around a place (from 1), blanks collapsed."""
    begin = F.greatest(F.lit(1), at - before)
    return squeeze(text.substr(begin, F.lit(most + before))).substr(1, most)


def shown(text: Column, most: int = 80) -> Column:
    """For display: no colour codes, visible line ends, cut with an ellipsis."""
    plain = F.regexp_replace(text, r"\x1B\[[0-9;]*m", "")
    for raw, seen in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(seen))
    return F.when(F.length(plain) > most, F.concat(plain.substr(1, most - 3), F.lit("..."))).otherwise(plain)


def contains_any(text: Column, hints: list[str], loose: bool = False) -> Column:
    """text in match form holds a hint; loosely, blanks count on neither side."""
    norm = [" ".join("".join(c for c in unicodedata.normalize("NFD", h.lower()) if unicodedata.category(c) != "Mn").split()) for h in hints]
    found = F.lit(False)
    for h in norm:
        found = found | text.contains(h)
        if loose:
            found = found | F.replace(text, F.lit(" "), F.lit("")).contains(h.replace(" ", ""))
    return found


def uppercase_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def loose_pattern(literal: str) -> str:
    """A pattern for a literal whose characters may have blanks between them."""
    return "".join(re.escape(c) + r"\s*" for c in literal if not c.isspace())


def found_spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, stop, kind, value>> of all matches; places count from 0. The
    characters U+0001 and U+0002 of a text are read as U+0003, so places stay."""
    pieces = F.split(F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), f"({pattern})", "\x01$1\x02"), "\x01")
    none = F.array().cast("array<struct<start:int,stop:int,kind:string,value:string>>")

    def add(state, piece):
        value = F.substring_index(piece, "\x02", 1)
        span = F.struct(state["at"].alias("start"), (state["at"] + F.length(value)).alias("stop"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.array_append(state["found"], span).alias("found"))

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(rest, F.struct(F.length(pieces[0]).alias("at"), none.alias("found")), add, lambda state: state["found"])


def greedy_spans(spans: Column) -> Column:
    """Spans that do not overlap: by start, the longest first; each is kept that
    starts at or after the end of the last one kept."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-(s["stop"] - s["start"])).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"))))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int,value:string>>")
    step = lambda state, s: F.when(s["start"] >= state["until"], F.struct(s["stop"].alias("until"), F.array_append(state["kept"], s).alias("kept"))).otherwise(state)
    return F.aggregate(ordered, F.struct(F.lit(0).alias("until"), none.alias("kept")), step, lambda state: state["kept"])


def any_date(text: Column) -> Column:
    """A whole text as a date: day, month and year by / or -, with four digits or
    two (from 50 on the last century), or spoken; null if there is no such day."""
    form = r"^\s*([0-9]{1,2})(/|-)([0-9]{1,2})(/|-)([0-9]{4}|[0-9]{2})\s*$"
    day, first, month, second, year = (F.regexp_extract(text, form, i) for i in range(1, 6))
    full = F.when(F.length(year) == 4, year).when(year >= "50", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    numbers = F.try_to_date(F.when((day != "") & (first == second), F.concat_ws("-", full, month, day)), "y-M-d")
    words = r"(?i)\b([0-9]{1,2})\s+de\s+(\p{L}+)\s+de\s+([0-9]{4})\b"
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, words, 2)))
    spoken = F.try_to_date(F.when(named > 0, F.concat_ws("-", F.regexp_extract(text, words, 3), named.cast("string"), F.regexp_extract(text, words, 1))), "y-M-d")
    return F.coalesce(numbers, spoken)


def recent(day: Column, as_of: Column, years: int = 5) -> Column:
    """From so many years before as_of to the day after it."""
    return day.between(F.add_months(as_of, -12 * years), F.date_add(as_of, 1))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def id_form(text: Column) -> Column:
    """ddd.ddd.ddd-dd for eleven digits, else the text as it is."""
    d = digits_only(text)
    return F.when(F.length(d) == 11, F.concat(d.substr(1, 3), F.lit("."), d.substr(4, 3), F.lit("."), d.substr(7, 3), F.lit("-"), d.substr(10, 2))).otherwise(text)


def length_score(a: Column, b: Column) -> Column:
    """1 for equal lengths, 0 for nothing against something."""
    return F.when(F.greatest(a, b) <= 0, F.lit(1.0)).otherwise(1 - F.abs(a - b) / F.greatest(a, b))


def relative_position(index: Column, total: Column) -> Column:
    """From 0 to 1 for an index (from 0) among so many; 0.5 among one or none."""
    return F.when(total <= 1, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), index / (total - 1))))
