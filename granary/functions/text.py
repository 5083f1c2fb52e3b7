"""Native column expressions for strings, identities, contacts and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def clean_spaces(x: Column) -> Column:
    """Runs of any white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, _SPACES, " "))


def is_empty(x: Column) -> Column:
    return x.isNull() | (clean_spaces(x) == "")


def norm_key(x: Column) -> Column:
    """Key for comparison: case, ё, spaces and punctuation do not matter."""
    folded = F.replace(F.translate(F.lower(clean_spaces(x)), "ё", "е"), F.lit("ß"), F.lit("ss"))
    return clean_spaces(F.regexp_replace(folded, "[^\\p{L}\\p{N}\\p{M}_]+", " "))


def phone_list(x: Column) -> Column:
    """Russian numbers as ``+7 (900) 000-12-34``, comma-joined; null unless all are recognised."""
    parts = F.filter(F.split(x, "[,;/]|\\s{2,}"), lambda p: F.trim(p) != "")
    digits = F.transform(parts, lambda p: F.regexp_replace(p, "\\D", ""))
    national = F.transform(digits, lambda d: F.when(d.rlike("^[78]\\d{10}$"), F.substring(d, 2, 10)).when(d.rlike("^[3489]\\d{9}$"), d))
    shaped = F.transform(national, lambda d: F.regexp_replace(d, "^(\\d{3})(\\d{3})(\\d{2})(\\d{2})$", "+7 ($1) $2-$3-$4"))
    return F.when((F.size(parts) > 0) & F.forall(national, lambda d: d.isNotNull()), F.array_join(shaped, ", "))


def phone_strict(x: Column) -> Column:
    """struct(value, error): a number of the +7 zone, or why it is none."""
    t = F.trim(x)
    digits = F.regexp_replace(t, "\\D", "")
    plus = t.startswith("+")
    national = F.when(plus & digits.rlike("^7\\d{10}$"), F.substring(digits, 2, 10)).when(~plus & digits.rlike("^[78]\\d{10}$"), F.substring(digits, 2, 10)).when(~plus & digits.rlike("^\\d{10}$"), digits)
    error = (
        F.when((t == "") | ~t.rlike("^[\\d\\s()+\\-.\\u00a0]+$"), "characters")
        .when(t.rlike("^.+\\+"), "plus")
        .when(national.isNull(), "length")
        .when(~national.rlike("^[34789]"), "zone")
    )
    return F.struct(F.when(error.isNull(), F.concat(F.lit("+7"), national)).alias("value"), error.alias("error"))


def phone_human(x: Column) -> Column:
    return F.regexp_replace(x, "^\\+7(\\d{3})(\\d{3})(\\d{2})(\\d{2})$", "+7 $1 $2-$3-$4")


def phone_masked(x: Column) -> Column:
    return F.when(x.rlike("^\\+7\\d{10}$"), F.regexp_replace(x, "^\\+7(\\d{3})\\d{5}(\\d{2})$", "+7 $1 ***-**-$2")).otherwise("***")


def _check_digit(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.coalesce(F.substring(digits, k + 1, 1).try_cast("int"), F.lit(0)) * w
    return total % 11 % 10


def inn_is_valid(inn: Column) -> Column:
    """Check digits of a tax number of ten or twelve digits."""
    at = lambda k: F.coalesce(F.substring(inn, k, 1).try_cast("int"), F.lit(-1))
    ten = inn.rlike("^\\d{10}$") & (_check_digit(inn, INN_10) == at(10))
    twelve = inn.rlike("^\\d{12}$") & (_check_digit(inn, INN_11) == at(11)) & (_check_digit(inn, INN_12) == at(12))
    return ten | twelve


def normalize_inn(x: Column) -> Column:
    """struct(value, note): note is empty, ``checksum``, ``zeros`` (restored) or ``invalid``."""
    digits = F.regexp_replace(x, "\\D", "")
    n = F.length(digits)
    ten, twelve = F.lpad(digits, 10, "0"), F.lpad(digits, 12, "0")
    value = F.when(n.isin(10, 12), digits).when((n > 0) & (n < 10) & inn_is_valid(ten), ten).when((n > 0) & (n < 12) & inn_is_valid(twelve), twelve)
    note = F.when(value.isNull(), "invalid").when(~n.isin(10, 12), "zeros").when(inn_is_valid(digits), "").otherwise("checksum")
    return F.struct(value.alias("value"), note.alias("note"))


def normalize_email(x: Column) -> Column:
    s = F.regexp_replace(F.translate(F.lower(clean_spaces(x)), " ", ""), "^mailto:", "")
    return F.when(s.rlike("^[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+(\\.[\\p{L}\\p{N}_-]+)+$"), s)


def title_name(x: Column) -> Column:
    """Words and hyphenated parts capitalised; a space after initials."""
    spaced = F.regexp_replace(clean_spaces(x), "(?<=[\\p{L}\\p{N}_])\\.(?=[\\p{L}\\p{N}_])", ". ")
    cap = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), cap), "-")
    return F.array_join(F.transform(F.split(spaced, " "), word), " ")


def initials(x: Column) -> Column:
    parts = F.split(title_name(x), " ")
    rest = F.transform(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""), lambda p: F.concat(F.substring(p, 1, 1), F.lit(".")))
    return F.when(F.size(parts) < 2, F.get(parts, F.lit(0))).otherwise(F.concat_ws(" ", F.get(parts, F.lit(0)), F.array_join(rest, " ")))


def protect_formula(x: Column) -> Column:
    """A quote before text that a spreadsheet would run as a formula."""
    return F.when(x.rlike("^[=+\\-@\\t\\r]") & ~x.rlike("^[-+]?\\d[\\d\\s.,]*$"), F.concat(F.lit("'"), x)).otherwise(x)


def file_stem(key: Column) -> Column:
    """Name for a file: unsafe characters become ``_``; changed or long ones get a hash."""
    safe = F.substring(F.regexp_replace(key, "[^\\p{L}\\p{N}_.-]+", "_"), 1, 80)
    return F.when(safe == key, key).otherwise(F.concat(safe, F.lit("_"), F.substring(F.sha1(key), 1, 12)))


def parse_command(x: Column) -> Column:
    """``/Start@bot x`` gives ``start``."""
    return F.nullif(F.lower(F.regexp_extract(x, "^/([^\\s@]+)", 1)), F.lit(""))


def redact(x: Column, known: tuple[str, ...] = ()) -> Column:
    """Known secrets (longest first), bot tokens, authorisation values and API keys become ``***``."""
    out = x
    for secret in sorted((s for s in known if len(s) >= 6), key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit("***"))
    out = F.regexp_replace(out, "(^|[^0-9])[0-9]{6,}:[A-Za-z0-9_-]{30,}", "$1***")
    out = F.regexp_replace(out, "(?i)((?:bearer|api-key|basic)\\s+)[A-Za-z0-9._~+/=-]{8,}", "$1***")
    return F.regexp_replace(out, "sk-[A-Za-z0-9_-]{16,}", "***")


def mask_contacts(x: Column) -> Column:
    """E-mail addresses and long digit runs of a text masked."""
    out = F.regexp_replace(x, "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+", "<email>")
    return F.regexp_replace(out, "[+]?[0-9][0-9 ()-]{8,}[0-9]", "<phone>")


def origin(url: Column) -> Column:
    """scheme://host of a URL, in lower case."""
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def safe_url(url: Column) -> Column:
    """URL without credentials, query and fragment."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.regexp_replace(bare, "://[^/@]*@", "://")


def clean_text(x: Column) -> Column:
    """Line ends unified, soft hyphens and hyphenated breaks joined, spaces collapsed."""
    s = F.regexp_replace(x, "\\r\\n?", "\n")
    s = F.regexp_replace(F.translate(s, "­", ""), "(?<=\\p{L})-\\n(?=\\p{Ll})", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[ \\t\\u00a0]+", " "), "\\n{3,}", "\n\n"))


def escape_data(x: Column) -> Column:
    """Control characters become spaces, angle brackets their look-alikes."""
    return F.translate(F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " "), "<>", "‹›")


def source_label(doc: Column, page: Column, section: Column) -> Column:
    return F.concat(F.lit("["), doc, F.when(page.isNotNull(), F.concat(F.lit(", стр. "), page.cast("string"))).when(section != "", F.concat(F.lit(", раздел «"), F.substring(section, 1, 80), F.lit("»"))).otherwise(""), F.lit("]"))


def person_name(x: Column) -> Column:
    """struct(value, error): a name of 2 to 60 characters, letters with spaces, hyphens, apostrophes and dots."""
    s = clean_spaces(x)
    letters = F.length(F.regexp_replace(s, "[^\\p{L}]", ""))
    error = F.when(~F.length(s).between(2, 60), "length").when(~s.rlike("^[\\p{L} .'’-]*$"), "characters").when(letters < 2, "letters")
    return F.struct(F.when(error.isNull(), s).alias("value"), error.alias("error"))


def comment(x: Column, longest: int = 1000) -> Column:
    """struct(value, error): a comment without white space around it, of at most ``longest`` characters."""
    s = F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")
    long = F.length(s) > longest
    return F.struct(F.when(~long, s).alias("value"), F.when(long, "length").alias("error"))


# Beginnings of column names and the type of their cells, tried in this order.
COLUMN_TYPES = (
    (("телефон", "тел", "phone", "моб"), "phone"),
    (("инн", "inn"), "inn"),
    (("email", "e mail", "почта", "mail"), "email"),
    (("дата", "date", "срок"), "date"),
    (("сумма", "цена", "стоимость", "количество", "кол во", "остаток", "итого", "amount", "price", "qty"), "number"),
    (("фио", "имя", "фамилия", "контакт", "клиент", "город", "населенный пункт", "name"), "name"),
)


def column_type(name: Column) -> Column:
    """Type of the cells of a column by its name: hints of two words anywhere, others as a
    word, or from four letters on as its beginning; text where none fits."""
    key = F.concat(F.lit(" "), norm_key(name), F.lit(" "))
    out = F.lit("text")
    for hints, kind in reversed(COLUMN_TYPES):
        held = F.lit(False)
        for h in hints:
            held = held | key.contains(h if " " in h else f" {h}" if len(h) >= 4 else f" {h} ")
        out = F.when(held, kind).otherwise(out)
    return out


def map_value(x: Column, mapping: dict[str, str]) -> Column:
    """The mapped value of a text: as written, then whatever its case, else the text itself."""
    out = x
    for k, v in reversed(list(mapping.items())):
        out = F.when(F.lower(x) == k.lower(), v).otherwise(out)
    for k, v in reversed(list(mapping.items())):
        out = F.when(x == k, v).otherwise(out)
    return out


def unwrap_lines(x: Column) -> Column:
    """Line breaks inside a sentence become spaces: no closing mark before, a small letter after."""
    return F.regexp_replace(x, "(?<=[^.!?:;\\n])[ \\t]*\\n(?=\\p{Ll})", " ")


def plain_heading(line: Column, following: Column) -> Column:
    """Whether a line of plain text is a heading: capitals only, three or more, short, with text below."""
    letters = F.regexp_replace(line, "[^\\p{L}]", "")
    return (F.length(line) <= 100) & (F.trim(following) != "") & (F.length(letters) >= 3) & (letters == F.upper(letters)) & ~letters.rlike("\\p{Ll}")


def strip_inline_marks(x: Column) -> Column:
    """Text without the marks of emphasis and code."""
    return F.trim(F.regexp_replace(x, "[*_`]+", ""))


def first_line(x: Column, longest: int = 120) -> Column:
    """The first line with something in it, cut to ``longest`` characters; empty without one."""
    return F.coalesce(F.substring(F.get(F.filter(F.transform(F.split(x, "\\r\\n|\\n|\\r"), lambda y: F.trim(y)), lambda y: y != ""), F.lit(0)), 1, longest), F.lit(""))


def running_key(line: Column) -> Column:
    """Key of a line that may repeat from page to page: digits count alike."""
    return F.regexp_replace(F.lower(clean_spaces(line)), "[0-9]+", "#")


def messages(x: Column, limit: int = 4096) -> Column:
    """A text as messages of at most ``limit`` characters, cut at line ends; longer lines are cut within.

    Empty lines at the beginning of a message are left out. An empty text is one empty message, a null text none.
    """
    found = F.regexp_extract_all(x, F.lit(rf"(?s)[^\n].{{0,{limit - 1}}}(?=\n|\z)|[^\n]{{{limit}}}"), F.lit(0))
    return F.when(F.size(found) > 0, found).when(x.isNotNull(), F.array(F.lit("")))


def file_name(x: Column) -> Column:
    """A name that file systems take, of at most 120 characters."""
    safe = clean_spaces(F.regexp_replace(x, "[<>:\"/\\\\|?*\\x00-\\x1f]", "_"))
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(safe, "^[ .]+|[ .]+$", ""), 1, 120), F.lit("")), F.lit("документ"))
