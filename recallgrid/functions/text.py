"""String expressions: trimming, keys, identifiers, URLs and option texts.

Every function takes and returns a Column, so all of them run in the JVM.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.schemas import PREFIX_LENGTH

# White space in the Unicode sense plus the four ASCII separators.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"

# Fixed patterns of the source pages.
_OPTION_LETTER = r"^([a-e])\)\s*"
_VERDICT = r"(?iU)\s*\((correcta|incorrecta)\)"
_VERDICT_SPLIT = r"(?isU)^(.*?)\s*\((?:correcta|incorrecta)\):\s*(.*)$"
_REPEATED = r"(?iU)^(.+?)([a-e]\)|\s+)\s*\1$"
_STATED_PREFIX = "La respuesta correcta es:"
_STATED_FALLBACK = "correcta"


def strip(text: Column) -> Column:
    """Trim all white space; Spark's ``trim`` removes spaces only."""
    return F.btrim(text, F.lit(_SPACES))


def prefix_key(text: Column, length: int = PREFIX_LENGTH) -> Column:
    """Near-duplicate key: cut first, then trim, then lower-case."""
    return F.lower(strip(F.substring(text, 1, length)))


def safe_identifier(text: Column, keep_hyphen: bool = False) -> Column:
    """Replace every character outside letters, digits and ``_`` by ``_``."""
    allowed = "a-zA-Z0-9_-" if keep_hyphen else "a-zA-Z0-9_"
    return F.regexp_replace(text, f"[^{allowed}]", "_")


def url_file_name(url: Column) -> Column:
    """Last path segment of a URL, without query, fragment and parameters."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.substring_index(path, "/", -1), ";.*$", "")


def file_extension(name: Column, default: str = ".jpg") -> Column:
    """Extension with its dot; a leading dot alone is no extension."""
    found = F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def storage_name(question_id: Column, index: Column, url: Column) -> Column:
    """Object name of a stored image: ``{safe id}_{index}{extension}``."""
    return F.concat(
        safe_identifier(question_id.cast("string"), keep_hyphen=True),
        F.lit("_"),
        index.cast("string"),
        file_extension(url_file_name(url)),
    )


def drop_repeated_text(text: Column) -> Column:
    """``FooFoo``, ``Foo Foo`` and ``Fooa)Foo`` become ``Foo``."""
    once = F.when(
        text.rlike(_REPEATED), strip(F.regexp_replace(text, _REPEATED, "$1"))
    ).otherwise(text)
    half = F.floor(F.length(once) / 2).cast("int")
    first = F.substring(once, F.lit(1), half)
    second = F.substring(once, half + 1, half)
    doubled = (F.length(once) > 0) & (F.length(once) % 2 == 0) & (first == second)
    return F.when(doubled, first).otherwise(once)


def parse_option(raw: Column, position: Column, is_correct: Column) -> Column:
    """Option text ``b) Foo (correcta): because`` as an option struct."""
    lettered = F.regexp_extract(raw, _OPTION_LETTER, 1)
    letter = F.concat(
        F.when(lettered != "", lettered).otherwise(F.char((position + 97).cast("bigint"))),
        F.lit("."),
    )
    body = F.when(lettered != "", strip(F.regexp_replace(raw, _OPTION_LETTER, ""))).otherwise(raw)
    has_verdict = body.rlike(_VERDICT_SPLIT)
    has_colon = body.contains(":")
    short = (
        F.when(has_verdict, F.regexp_extract(body, _VERDICT_SPLIT, 1))
        .when(has_colon, F.substring_index(body, ":", 1))
        .otherwise(body)
    )
    rest = (
        F.when(has_verdict, F.regexp_extract(body, _VERDICT_SPLIT, 2))
        .when(has_colon, F.regexp_extract(body, r"(?s)^[^:]*:(.*)$", 1))
        .otherwise("")
    )
    cleaned = drop_repeated_text(strip(F.regexp_replace(strip(short), _VERDICT, "")))
    return F.struct(
        letter.alias("letter"),
        cleaned.alias("text"),
        strip(rest).alias("explanation"),
        is_correct.alias("is_correct"),
    )


def stated_answer(text: Column) -> Column:
    """The answer named in a sentence such as ``La respuesta correcta es: X``."""
    after_prefix = strip(F.substring_index(text, _STATED_PREFIX, -1))
    after_word = strip(
        F.regexp_replace(
            F.regexp_extract(text, rf"(?is)^.*{_STATED_FALLBACK}(.*)$", 1), r"(?U)^[:\s]+", ""
        )
    )
    return (
        F.when(text.contains(_STATED_PREFIX), after_prefix)
        .when(F.lower(text).contains("respuesta correcta"), after_word)
        .otherwise("")
    )


def answer_label(letter: Column, text: Column) -> Column:
    return F.concat_ws(" ", letter, text)
