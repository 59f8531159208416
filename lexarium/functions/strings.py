"""String functions as column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_punctuation(c: Column) -> Column:
    return normalize_spaces(F.regexp_replace(c, r"\p{Punct}+", " "))


def mask_numbers(c: Column) -> Column:
    """Digits with inner points and commas become <N and the lengths of the runs between points, commas dropped."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d[\d,.]*|[^\d]+|\d)"), F.lit(1))
    lengths = lambda x: F.array_join(F.transform(F.filter(F.split(F.translate(x, ",", ""), "[.]"), lambda p: p != ""), lambda p: F.length(p).cast("string")), "_")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("<N"), lengths(x), F.lit(">"))).otherwise(x)), "")


def decode_entities(c: Column) -> Column:
    """The four basic entities; others are dropped."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&amp;", "\x00")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(F.regexp_replace(c, r"&[A-Za-z#0-9]+;", ""), F.lit("\x00"), F.lit("&"))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def separate_hangul(c: Column) -> Column:
    """A space at each border between Hangul and other visible characters."""
    c = F.regexp_replace(c, r"(?<=\p{IsHangul})(?=[^\p{IsHangul}\s])", " ")
    return F.regexp_replace(c, r"(?<=[^\p{IsHangul}\s])(?=\p{IsHangul})", " ")


def separate_brackets(c: Column) -> Column:
    return normalize_spaces(F.regexp_replace(c, r"([\[\](){}<>])", " $1 "))


def split_at_last(c: Column, delimiter: str) -> Column:
    """(left, right) at the last delimiter; null where there is none."""
    right = F.substring_index(c, delimiter, -1)
    left = F.substring(c, F.lit(1), F.length(c) - F.length(right) - len(delimiter))
    return F.when(F.contains(c, F.lit(delimiter)), F.struct(left.alias("left"), right.alias("right")))


def between(c: Column, start: str, end: str) -> Column:
    """The text between the first start and the first end behind it."""
    after = F.substring(c, F.locate(start, c) + len(start), F.length(c))
    return F.when(F.contains(c, F.lit(start)) & F.contains(after, F.lit(end)), F.substring_index(after, end, 1))


def tagged(c: Column, part: int) -> Column:
    """Words (0) or tags (1) of word/tag tokens."""
    return F.transform(F.split(c, " "), lambda x: F.substring_index(x, "/", -1) if part else F.regexp_replace(x, "/[^/]*$", ""))


def word_ngrams(words: Column, n: int, sep: str = "_") -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), sep)))


def qgrams(c: Column, q: int) -> Column:
    """(gram, start) of every q characters; none where the string is shorter."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))  # one pass; a substring counts from the front each time
    return F.transform(found, lambda g, i: F.struct(g.alias("gram"), i.alias("start")))


def segments(c: Column, k: int) -> Column:
    """k even parts: the front ones have floor(len / k) characters, the last len % k ones have one more."""
    n = F.length(c)
    size, longer = F.floor(n / k), n % k
    start = lambda i: i * size + F.greatest(F.lit(0), i - (F.lit(k) - longer))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(c, (start(i) + 1).cast("int"), (start(i + 1) - start(i)).cast("int")))


def compose_hangul(lead: Column, vowel: Column, tail: Column) -> Column:
    code = F.lit(0xAC00) + (lead * 21 + vowel) * 28 + tail
    raw = F.array(F.lit(0xE0) + F.shiftright(code, 12), F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(63), F.lit(0x80) + code.bitwiseAND(63))
    return F.decode(F.unhex(F.array_join(F.transform(raw, lambda b: F.hex(b)), "")), "UTF-8")


def decompose_hangul(c: Column) -> Column:
    """(lead, vowel, tail) numbers of a syllable; null for anything else."""
    code = F.ascii(c) - 0xAC00
    return F.when(code.between(0, 11171), F.struct(F.floor(code / 588).alias("lead"), (F.floor(code / 28) % 21).alias("vowel"), (code % 28).cast("long").alias("tail")))


def strip_parens(c: Column) -> Column:
    return normalize_spaces(F.regexp_replace(c, r"\([^()]*\)", " "))


def tidy_word(c: Column) -> Column:
    """Empty for dashes only, more than 20 characters or a tag; else lower case, letters, digits, dashes, spaces."""
    return F.when(c.rlike("^-+$") | (F.length(c) > 20) | c.rlike("^<.*>$"), "").otherwise(F.regexp_replace(F.lower(c), "[^a-zA-Z0-9- ]", ""))


def null_markers(c: Column, *markers: str) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*(markers or ("null", "empty"))), None).otherwise(c)


def strip_html(c: Column) -> Column:
    """Visible text: comments, scripts and styles go whole, other tags go alone."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return normalize_spaces(decode_entities(F.regexp_replace(c, r"<[^>]+>", " ")))


def strip_wiki(c: Column) -> Column:
    """Wiki markup to text: templates, files and references go, links keep what they show, headings keep words."""
    c = F.regexp_replace(c, r"(?s)\{\{[^{}]*\}\}|<ref[^>]*/>|<ref.*?</ref>|\[\[(?:File|Image|Category):[^\]]*\]\]", "")
    c = F.regexp_replace(c, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return normalize_spaces(F.regexp_replace(c, r"'{2,}|={2,}", ""))


def organization_name(c: Column, short_forms: dict[str, str]) -> Column:
    """Dots and commas collapsed, known abbreviations written out, company endings made one form."""
    c = normalize_spaces(F.regexp_replace(c, r"[.,]+", " "))
    c = F.regexp_replace(c, r"(?i)\bco\s+ltd\b", "Co., Ltd.")
    for short, long in short_forms.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b", long)
    return c


def organization_parts(c: Column) -> Column:
    """(kind, text, start) of university, college, school, division and department names in an English address."""
    found = []
    for kind, pattern in (("university", r"([^,]*\bUniv(?:ersity)?\b[^,]*)"), ("college", r"([^,]*\bCollege\b[^,]*)"), ("school", r"([^,]*\bSchool\b[^,]*)"), ("division", r"([^,]*\bDivision\b[^,]*)"), ("department", r"([^,]*\bDep(?:artmen)?t\b[^,]*)")):
        text = F.trim(F.regexp_extract(c, f"(?i){pattern}", 1))
        found.append(F.when(text != "", F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.locate("\x01", F.concat(F.lit(""), F.replace(c, text, F.lit("\x01")))) - 1).alias("start"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def strip_chapter(c: Column) -> Column:
    """Without the literal prefix of a chapter heading."""
    return F.trim(F.regexp_replace(c, "^ICD-10 Chapter ", ""))


def joined(words: Column, start: int, end: int, sep: str = " ") -> Column:
    """Words from start (0 the first) up to end, joined."""
    return F.array_join(F.slice(words, start + 1, max(0, end - start)), sep)


def item(words: Column, k: int, default: str = "") -> Column:
    return F.coalesce(F.get(words, F.lit(k)), F.lit(default))
