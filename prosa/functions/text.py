"""Column functions on texts, sentences and tokens. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prosa.functions import words as W

WORD = r"\p{L}+(?:['’-]\p{L}+)*"
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
PUNCTUATION_OR_DIGIT = r"[0-9!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
URL_OR_EMAIL = r"^(?:https?://|www\.)|^[^@\s]+@[^@\s]+\.[^@\s]+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """An array of sentences: cut after . ! or ? before white space, collapsed, without empty ones."""
    return F.filter(F.transform(F.split(col(text), r"(?<=[.!?])\s+"), collapse), lambda x: x != "")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORD), 0)


def is_upper(token: Column | str) -> Column:
    return (F.upper(col(token)) == col(token)) & (F.lower(col(token)) != col(token))


def is_title(token: Column | str) -> Column:
    return (F.initcap(col(token)) == col(token)) & (F.length(col(token)) > 1) & (F.lower(col(token)) != col(token))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(col(html), "<[^<>]*>", " ")


def squeeze_once(word: Column | str) -> Column:
    """Without the second letter of the last doubled pair: coooool -> cooool."""
    return F.regexp_replace(col(word), r"([\p{L}\p{N}_]*)([\p{L}\p{N}_])\2([\p{L}\p{N}_]*)", "$1$2$3")


def left_clean(token: Column | str) -> Column:
    """From the first word character on; empty if there is none."""
    return F.regexp_replace(F.coalesce(col(token), F.lit("")), r"^[^\p{L}\p{N}_]+", "")


def emphasis(token: Column | str, level: int, marks: str = "?!") -> Column:
    """A suffix of marks stays if it has `level` characters or more; otherwise the token ends with its last word character."""
    own = "".join(f"\\{x}" if x in r"\]^-[" else x for x in marks)
    suffix = F.regexp_extract(col(token), rf"^[\p{{L}}\p{{N}}_'’-]+([{own}]+)$", 1)
    return F.when(F.length(suffix) >= level, col(token)).otherwise(F.regexp_extract(col(token), r"^(.*[\p{L}\p{N}_])", 1))


def special_only(token: Column | str) -> Column:
    return F.regexp_replace(col(token), PUNCTUATION, "") == ""


def expand_contractions(text: Column | str, contractions: dict[str, str] | None = None) -> Column:
    """Tokens (between spaces) that are a contraction in any case become what it stands for; punctuation after one stays."""
    known = F.create_map(*[F.lit(x) for pair in (contractions or W.CONTRACTIONS).items() for x in pair])
    ending = r"([.,;:!?]*)$"

    def one(token: Column) -> Column:
        stem = F.regexp_replace(token, ending, "")
        found = F.try_element_at(known, F.lower(stem))
        return F.when(F.instr(token, "'") + F.lower(stem).isin("gonna", "gotta").cast("int") > 0, F.coalesce(F.concat(found, F.regexp_extract(token, ending, 1)), token)).otherwise(token)

    return F.array_join(F.transform(F.split(col(text), " "), one), " ")


def count_of(text: Column | str, char: str) -> Column:
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(char), F.lit("")))


def punctuation_emphasis(raw: Column | str) -> Column:
    """What exclamation marks (0.292 each, four at most) and question marks (0.18 each for 2 or 3, else 0.96) add."""
    marks, asks = F.least(count_of(raw, "!"), F.lit(4)), count_of(raw, "?")
    return marks * 0.292 + F.when(asks <= 1, 0.0).when(asks <= 3, asks * 0.18).otherwise(0.96)


def nth(tokens: Column | str, position: Column) -> Column:
    """The token at a position from 0; null outside."""
    return F.get(col(tokens), position)


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up by arithmetic alone, so that every engine gets the same digits at ties."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def mean_of_digits(x: Column | str, digits: int) -> Column:
    """The mean of values with so many digits, summed as integers: exact in any order of rows."""
    return F.sum(F.round(col(x) * 10**digits).cast("long")) / (F.count("*") * float(10**digits))
